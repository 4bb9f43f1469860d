"""The pipeline against its stages in plain Python."""

import base64
import hashlib
import pathlib
import random
import sys

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from bytelayout.llm import exact, jaccard, quality, simhash  # noqa: E402
from bytelayout.llm.rows import words_of  # noqa: E402
from bytelayout.llm.queries import VOCABULARY  # noqa: E402
from samples import prose  # noqa: E402


def write(spark, folder):
    """Documents with bad, equal, near and contaminated ones."""
    docs = [(k, prose(k, 90), "en", "s", 0) for k in range(80)]
    docs += [(100 + k, prose(k, 90), "en", "s", 0) for k in range(8)]
    docs += [(200 + k, prose(k + 20, 90).replace("ta", "TA", 1) + " ö", "en", "s", 0) for k in range(6)]
    docs += [(300 + k, " ".join(f"{w}###" for w in prose(k + 500, 60).upper().split()), "en", "s", 0) for k in range(40)]
    docs += [(400, prose(900, 30) + " " + prose(901, 14) + " " + prose(902, 30), "en", "s", 0), (401, None, None, None, None), (402, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0 if 300 <= i < 400 else 1) for i, *_ in docs if i < 400]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, prose(901, 14)), (2, prose(77, 3))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return [(i, text) for i, text, *_ in docs]


def components(docs):
    """The smallest id reachable from each over pairs of 5-word shingle sets with a Jaccard similarity of 0.8 or more."""
    sets = {}
    for i, text in docs:
        tokens = (text or "").lower().split()
        sets[i] = {tuple(tokens[k : k + 5]) for k in range(max(1, len(tokens) - 4))} if tokens else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {i: top(i) for i in sets}


def plain(spark, folder, docs):
    frames = [spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels")]
    model = quality.train_quality(*frames)
    rows = [(i, t or "") for i, t in docs if quality.score_texts(model, [(t or "").encode()])[0] >= 0.3]
    last = {t: max(i for i, other in rows if other == t) for _, t in rows}
    rows = sorted((i, t) for i, t in rows if last[t] == i)
    top = components(rows)
    rows = [(i, t) for i, t in rows if top[i] == i]
    windows = set()
    for text in (prose(901, 14), prose(77, 3)):
        tokens = words_of(text.encode())
        size = min(10, len(tokens))
        windows |= {tuple(tokens[k : k + size]) for k in range(len(tokens) - size + 1)}
    hit = lambda tokens: any(tuple(tokens[k : k + len(w)]) == w for w in windows for k in range(len(tokens)))
    rows = [(i, t) for i, t in rows if not hit(words_of(t.encode()))]
    with open(public_tokenizers.path(VOCABULARY), "rb") as stream:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, stream)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    found = []
    for i, t in rows:
        ids = library.encode_ordinary(t)
        found.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t)))
    return found


def test_pipeline_equals_plain_stages(spark, tmp_path):
    docs = write(spark, tmp_path)
    expected = plain(spark, tmp_path, docs)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == expected
    ids = {row[0] for row in expected}
    assert 400 not in ids and not ids & set(range(300, 340)) and not ids & set(range(8)) and set(range(30, 76)) <= ids


def test_stages_keep_the_columns(spark, tmp_path):
    write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.where("false"), str(tmp_path)).collect() == []


def edited(text, changes, seed):
    rng = random.Random(seed)
    tokens = text.split()
    for at in rng.sample(range(len(tokens)), changes):
        tokens[at] = f"new{seed}x{at}"
    return " ".join(tokens)


def test_near_copies_equal_brute_force_jaccard(spark, tmp_path):
    """All pairs of 5-word shingles with a similarity of 0.8 or more, and none below it, in chains and one large group."""
    docs = [(k, prose(k, 150)) for k in range(60)]
    docs += [(1000 * n + k, edited(prose(k, 150), n, 1000 * n + k)) for k in range(60) for n in (1, 2, 3, 4, 6, 9)]
    chain = prose(2000, 200)
    for k in range(12):  # the ends of the chain are not alike
        chain = edited(chain, 3, 20000 + k)
        docs.append((20000 + k, chain))
    docs += [(30000 + k, edited(prose(3000, 150), 1 + k % 5, 30000 + k)) for k in range(120)]
    docs += [(40000, None), (40001, ""), (40002, "two words"), (40003, "Two  WORDS")]
    top = components(docs)
    assert len(set(top.values())) < 0.6 * len(docs)
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(5), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in top if top[i] == i)


def test_texts_from_a_template_are_told_apart_by_sketches(spark):
    """400 texts with a shared half and some near 0.8: few pairs reach their sets, and the result is that of all pairs."""
    shared = prose(1, 300)
    docs = [(k, f"{shared} {prose(5000 + k, 75)}") for k in range(300)]
    docs += [(1000 + k, f"{shared} {prose(5000 + k, 75 - k % 40)} {prose(7000 + k, k % 40)}") for k in range(100)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    table = jaccard.facts_of(frame, "doc_id", "text", 5).withColumn("root", F.col("node")).toArrow()
    both = pa.concat_tables([table.append_column("left", pa.array([side] * len(docs))) for side in (True, False)])
    links, tried = jaccard.forest_of(both, 0.8)
    assert len(links) < 400 and tried < 0.1 * 400 * 399 / 2
    top = components(docs)
    assert {r.doc_id: r.component_id for r in jaccard.similar_documents(frame).collect()} == top


def test_blocks_of_a_key_give_the_same_pairs(spark, monkeypatch):
    docs = [(k, edited(prose(k % 6, 120), 1 + k % 9, k)) for k in range(150)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    expected = {r.doc_id: r.component_id for r in jaccard.similar_documents(frame).collect()}
    assert expected == components(docs)
    monkeypatch.setattr(jaccard, "LEFT_ROWS", 7)
    monkeypatch.setattr(jaccard, "RIGHT_ROWS", 11)
    monkeypatch.setattr(jaccard, "BROADCAST_BYTES", 0)
    assert {r.doc_id: r.component_id for r in jaccard.similar_documents(frame).collect()} == expected


def test_one_row_stays_of_equal_ids_and_texts(spark, tmp_path):
    """A third of the rows without an id and a third with the same one: one row of each text is left."""
    rows = [(None, prose(1, 80), k) for k in range(30)] + [(7, prose(2, 80), k) for k in range(30)]
    rows += [(None, prose(3, 80), 0), (None, prose(4, 80), 0), (7, prose(5, 80), 0), (9, None, 0), (9, "", 1)]
    rows += [(100 + k, prose(100 + k, 80), 0) for k in range(28)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `_id.mark` int").repartition(7)
    expected = sorted({text or "" for _, text, _ in rows})
    for keep in (exact.drop_exact_duplicates, simhash.drop_near_duplicates, jaccard.drop_similar):
        found = keep(docs)
        assert found.columns == docs.columns
        found = found.collect()
        assert sorted(r.text or "" for r in found) == expected
        assert {(r.doc_id, r.text or "", r[2]) for r in found} <= {(i, t or "", k) for i, t, k in rows}


def test_fingerprints_and_golay_codes_link_near_copies(spark, monkeypatch):
    """Without the minima, the fingerprints alone connect most of what is near, and nothing else.

    Not all: a pair may be given out by way of a third fingerprint whose set is not similar; the minima find it.
    """
    docs = [(1000 * n + k, edited(prose(k, 300), n, 1000 * n + k) if n else prose(k, 300)) for k in range(40) for n in (0, 1, 2, 6)]
    docs += [(40000, None), (40001, ""), (40002, "two words")]
    sets = {i: jaccard.shingles((text or "").encode()) for i, text in docs}
    prints = {i: jaccard.fingerprint_of(found) for i, found in sets.items()}
    near = {
        (a, b) for a in sets for b in sets
        if a < b and len(sets[a]) and len(sets[b]) and ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= 4
        and jaccard.similar(sets[a], sets[b], jaccard.SIMILARITY)
    }
    assert len(near) > 40
    monkeypatch.setattr(jaccard, "keys_of", lambda minima: [])
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.component_id for r in jaccard.similar_documents(frame).collect()}
    top = components(docs)
    assert all(top[i] == top[low] for i, low in found.items())
    assert sum(found[a] == found[b] for a, b in near) >= 0.8 * len(near), [pair for pair in near if found[pair[0]] != found[pair[1]]]
