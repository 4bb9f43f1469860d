"""Queries over documents with odd rows: empty and blank texts, nulls, control characters."""

import pathlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import oracle

FOLDER = pathlib.Path("/root/testdata/sf0.001")
TEXTS = [
    "plain", "", None, " ", "   ", "\n \t", "\u3000\u3000", "\ufeff", "\u2003", " " * 100, " " * 101, "\x7f", "a\nb",
    "é" * 50, "é" * 50 + "a", "ä", "x" * 101, "  x  ",
]


@pytest.fixture
def odd_folder(tmp_path):
    """The small tables with documents of every text under each ending of a name, and some names unknown."""
    for name in oracle.TABLES:
        if name != "documents":
            (tmp_path / f"{name}.parquet").symlink_to(FOLDER / f"{name}.parquet")
    rows = [
        (6 * number + ending, text, None if number == 3 else "de", None if number == 4 else "s", None if text is None else len(text))
        for number, text in enumerate([*TEXTS, "x" * 4000, "x" * 4001]) for ending in range(6)
    ]
    columns = zip(("doc_id", "text", "lang", "source", "n_chars"), zip(*rows))
    pq.write_table(pa.table({name: pa.array(values) for name, values in columns}), tmp_path / "documents.parquet")
    return str(tmp_path)


def test_blocking_docs(spark, odd_folder):
    assert oracle.compare(spark, odd_folder, "blocking_docs") is None


def test_file_admission(spark, odd_folder):
    assert oracle.compare(spark, odd_folder, "file_admission") is None
