import pytest

from samples import prose

CLASHING = (
    "doc_id2", "mark", "place", "fp", "low", "root", "spans", "needs", "kept", "items", "score", "label", "block", "bucket",
    "shard", "slot", "_id", "_mark", "_bucket", "n_bytes", "prefix", "sha256", "key", "word.count",
)


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty and very long texts, repeated rows, equal texts, equal ids."""
    shared = prose(99, 60)
    return [
        (1, prose(1, 120)), (2, prose(1, 120)), (3, None), (4, ""), (5, "\n \t"), (6, "x"), (7, prose(7, 40000)),
        (8, f"{prose(8, 30)} {shared}"), (9, f"{shared} {prose(9, 30)}"), (10, "a" * 70000), (11, "a" * 70000 + "b"),
        (12, prose(12, 50)), (12, prose(12, 50)), (12, prose(13, 50)), (None, prose(1, 120)), (None, None), (14, "äöü   漢字 é"),
        (15, "\x00\x01 \x7f odd"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with columns whose names the operators use themselves."""
    rows = [(*row, *range(len(CLASHING))) for row in odd_rows]
    names = ", ".join(f"`{name}` int" for name in CLASHING)
    return spark.createDataFrame(rows, f"doc_id long, text string, {names}").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
