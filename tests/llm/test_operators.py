"""Each operator on odd rows, on no rows, and against a plain version of its rule."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from bytelayout.llm import bpe, contamination, exact, html, jaccard, licenses, lm, quality, queries, repeats, sharding, simhash, suffixes
from bytelayout.llm.components import connected
from samples import prose

RANKS = public_tokenizers.path(queries.VOCABULARY)
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BENCHMARK = [("q1", "The taxi and OF the: in st"), ("q2", None), ("q3", ""), ("q4", "taxi")]


def words(text):
    return WORD.findall((text or "").encode().lower())


def by_row(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.fixture(scope="session")
def tests(spark):
    return spark.createDataFrame(BENCHMARK, "item_id string, text string")


OPERATORS = {
    "lm": lambda docs, tests: lm.score_documents(docs),
    "sharding": lambda docs, tests: sharding.shard(docs, [1.0, 2.0, 0.5], grown_weight=1.0),
    "bpe": lambda docs, tests: bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN),
    "html": lambda docs, tests: html.extract(docs, "doc_id", "text"),
    "exact": lambda docs, tests: exact.exact_duplicates(docs),
    "simhash": lambda docs, tests: simhash.near_duplicates(docs),
    "jaccard": lambda docs, tests: jaccard.similar_documents(docs),
    "quality": lambda docs, tests: quality.score_quality(docs, None),
    "licenses": lambda docs, tests: licenses.scan_licenses(docs),
    "contamination": lambda docs, tests: contamination.find_contamination(docs, tests),
    "repeats": lambda docs, tests: repeats.remove_repeats(docs),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_gives_a_row(odd, odd_rows, none, tests, name):
    found = OPERATORS[name](odd, tests).select("doc_id").collect()
    assert sorted((r[0] or 0) for r in found) == sorted((i or 0) for i, _ in odd_rows)
    assert OPERATORS[name](none, tests).collect() == []


@pytest.mark.parametrize("keep", [exact.drop_exact_duplicates, simhash.drop_near_duplicates, jaccard.drop_similar])
def test_dropping_keeps_columns_and_rows_of_other_texts(odd, none, keep):
    kept = keep(odd)
    assert kept.columns == odd.columns and keep(none).collect() == []
    texts = collections.Counter((row["text"] or "") for row in kept.collect())
    assert texts[""] == 1 if keep is exact.drop_exact_duplicates else texts["x"] == 1
    assert sum(n for text, n in texts.items() if text.startswith("a" * 9) and text.endswith("b")) == 1


# Language model


def test_scores_equal_counting(odd, odd_rows):
    texts = [words(text) for _, text in odd_rows]
    one, two = collections.Counter(), collections.Counter()
    for text in texts:
        one.update(text)
        two.update(zip(text, text[1:]))
    total = sum(one.values())
    expected = []
    for (doc_id, _), text in zip(odd_rows, texts):
        steps = score = 0
        for before, word in zip([None, *text], text):
            if before is not None and two[before, word] >= 2:
                score += round(math.log(two[before, word] / one[before]) * 1e6)
            else:
                steps += before is not None
                score += round((math.log(one[word] / total) + (before is not None) * math.log(0.4)) * 1e6)
        expected.append((doc_id, len(text), steps, score))
    for sizes in ({}, {"block_bytes": 4000, "bucket_bytes": 3000}):
        assert by_row(lm.score_documents(odd, **sizes)) == sorted(expected, key=repr)


def test_third_order_backs_off_twice(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "x b d")], "doc_id long, text string")
    found = {r.doc_id: r for r in lm.score_documents(docs, order=3).collect()}
    logs = [1 / 1 * 2 / 9, 2 / 2, 2 / 2]
    assert found[1].log_micro == sum(round(math.log(x) * 1e6) for x in logs) and found[1].n_backoff == 0
    # x; b after x was seen once; d after "x b" and after b was seen once.
    assert found[3].n_backoff == 3


# Sharding


def test_shards_follow_weights_and_move_only_into_a_new_one(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    found = sharding.shard(docs, [1.0, 1.0, 2.0], grown_weight=1.0, buckets=7).toPandas()
    share = found["shard"].value_counts(normalize=True)
    assert abs(share[2] - 0.5) < 0.02 and abs(share[0] - 0.25) < 0.02
    moved = found[found["grown_shard"] != found["shard"]]
    assert set(moved["grown_shard"]) == {3} and abs(len(moved) / len(found) - 0.2) < 0.02
    for _, part in found.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert all(zlib.crc32(str(i).encode()) == c for i, c in zip(found["doc_id"], found["text_crc32"]))


def test_weights_must_be_positive(odd):
    with pytest.raises(ValueError):
        sharding.shard(odd, [1.0, 0.0])


# Byte-level BPE


@pytest.fixture(scope="session")
def codec():
    with open(RANKS, "rb") as stream:
        return bpe.Codec(bpe.read_ranks(stream.read()), public_tokenizers.PATTERN)


@pytest.fixture(scope="session")
def library():
    with open(RANKS, "rb") as stream:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, stream)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_equal_the_library(codec, library, odd_rows):
    rng = random.Random(3)
    alphabets = ["ab", "the ingsST't's \n\t", "éñß漢字€😀 a", "0123 ٣", "aaaa", "!?.,;-_=#* ", " 　 \n"]
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (1, 3, 30, 300) for _ in range(8)]
    for text in [*texts, *((text or "")[:9000] for _, text in odd_rows), "a" * 5000, "<|endoftext|>"]:
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text)
        assert "".join(codec.decode(ids)) == text


def test_transducer_forgets_and_starts_over(library):
    with open(RANKS, "rb") as stream:
        small = bpe.Codec(bpe.read_ranks(stream.read()), public_tokenizers.PATTERN)
    small.transducer.max_states = 5
    text = "unbelievable thththth indistinguishability " * 3
    assert small.encode(text) == library.encode_ordinary(text)


def test_utf8_stream_cut_anywhere():
    data = "aé漢😀z".encode()
    for parts in (1, 2, 3, 5):
        stream = bpe.Utf8Stream()
        assert "".join(stream.feed(data[k : k + parts]) for k in range(0, len(data), parts)) + stream.close() == data.decode()
    for bad in (b"\xff", b"\xe6\xbc", b"\xc3(", b"\xed\xa0\x80a", b"\xf0\x9f"):
        stream = bpe.Utf8Stream()
        assert "".join(stream.feed(bad[k : k + 1]) for k in range(len(bad))) + stream.close() == bad.decode("utf-8", "replace")


def test_encode_and_decode_frames(spark, odd, library):
    docs = odd.where("length(text) < 2000")
    encoded = bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN)
    texts = sorted(r.text for r in docs.collect())
    assert sorted(tuple(r.ids) for r in encoded.collect()) == sorted(tuple(library.encode_ordinary(t)) for t in texts)
    assert sorted(r.text for r in bpe.decode_ids(encoded, RANKS, public_tokenizers.PATTERN).collect()) == texts


# Pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>Head &amp; line</h1><p>First <b>bold</b>&nbsp;text<br>goes on.<p>Second &lt;one&gt;
<div class="ad">Buy this now</div><p title="a > b">Third.</p><script>var t="</p>";</script>
<section id="comments"><p>I do not agree with this at all</p></section><form>Name <input></form></article>
<aside><p>Other stories that many people read today and tomorrow</p></aside><footer>&copy; us</footer>"""


def test_page_text():
    assert html.main_text(PAGE, html.trained()) == "Head & line\nFirst bold text goes on.\nSecond <one>\nThird."
    assert html.main_text("", html.trained()) == "" and html.main_text("<nav>a</nav>", html.trained()) == ""


def test_page_without_article():
    long = " ".join(["word"] * 40)
    page = f'<div class="menu"><a>a</a> <a>b</a></div><div><h2>On it</h2><p>{long}</p><p>Short.</p><p>{long}</p></div>'
    assert html.main_text(page, html.trained()) == f"On it\n{long}\nShort.\n{long}"


def test_tree_learns_its_table():
    table = np.array(html.LABELLED, float)
    assert all(html.decide(html.trained(), tuple(row[:-1])) == row[-1] for row in table)


# Exact duplicates


@pytest.mark.parametrize("options", [{}, {"hash_all": True}, {"broadcast_keys": 0}])
def test_exact_groups(odd, odd_rows, options):
    groups = collections.defaultdict(list)
    for doc_id, text in odd_rows:
        groups[text or ""].append(doc_id)
    largest = lambda ids: max((i for i in ids if i is not None), default=None)
    expected = [(i, largest(groups[t or ""]), len(groups[t or ""]), i == largest(groups[t or ""])) for i, t in odd_rows]
    found = exact.exact_duplicates(odd, **options)
    assert by_row(found.drop("sha256")) == sorted(expected, key=repr)
    if options.get("hash_all"):
        digests = {bytes(r[0]) for r in found.select("sha256").collect()}
        assert digests == {hashlib.sha256((t or "").encode()).digest() for _, t in odd_rows}


# Near duplicates


def plain_fingerprint(text):
    tokens = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(tokens[k : k + 4]) for k in range(max(1, len(tokens) - 3))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fingerprints(odd_rows):
    for _, text in odd_rows:
        if len(text or "") < 5000:
            assert simhash.fingerprint((text or "").encode()) % (1 << 64) == plain_fingerprint(text)


def test_any_four_flips_share_a_key():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**63), 2**63, 3000, dtype=np.int64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in x], np.uint64)
    code = simhash.Codewords()
    sides = []
    for fps in (x, (x.view(np.uint64) ^ flips).view(np.int64)):
        keys, places = code.keys(fps)
        sides.append(set(zip(keys.tolist(), places.tolist())))
    assert len({place for _, place in sides[0] & sides[1]}) == len(x)


@pytest.mark.parametrize("bucket_rows", [4096, 3])
def test_links_join_what_all_pairs_join(spark, bucket_rows):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(250):  # chains and dense groups
        fps.append(rng.choice(fps[-40:]) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for k, a in enumerate(fps):
        for b in fps[k + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                a_top, b_top = sorted((top(a), top(b)))
                root[b_top] = a_top
    rows = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(3)
    found = {r.node: r.root for r in connected(simhash.all_links(rows, bucket_rows=bucket_rows)).collect()}
    assert {f: found.get(f, f) for f in fps} == {f: top(f) for f in fps}


def test_components_of_a_long_chain(spark):
    links = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    assert {r.root for r in connected(links).collect()} == {0}
    assert connected(links.where("a < 0")).collect() == []
    rng = random.Random(4)
    pairs = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(200)], "a long, b long")
    assert by_row(connected(pairs, 1000)) == by_row(connected(pairs)) and by_row(connected(links, 10**6)) == by_row(connected(links))
    assert connected(links.where("a < 0"), 1000).collect() == []


# Quality


def test_held_out_quality(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(600):
        good = rng.random() < 0.8
        text = " ".join(rng.choice("alder birch cedar elm hazel oak".split()) + rng.choice(["", ",", "."]) for _ in range(rng.randint(3, 80)))
        rows.append((k, text if good else re.sub(r"(\w+)", r"\1###", text.upper())))
        if rng.random() < 0.7:
            labels.append((k, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.train_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    scores = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    held = [(scores[k], label) for k, label in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all((score >= 0.3) == bool(label) for score, label in held) and all(0 <= s <= 1 for s in scores.values())
    assert quality.keep_good(docs, model).count() == sum(s >= 0.3 for s in scores.values())


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_prior_from_positives_and_unlabelled_rows(share):
    random_rows = np.random.default_rng(5)
    good, bad = random_rows.normal(0, 1, (6000, 4)), random_rows.normal(1.2, 1, (4000, 4))
    n = int(4000 * share)
    unlabelled = np.concatenate((good[:n], bad[: 4000 - n]))
    assert abs(quality.estimate_prior(good[4000:], random_rows.permutation(unlabelled)) - share) < 0.08


def test_prior_where_all_are_positive_and_of_few_rows():
    rows = np.random.default_rng(6).normal(0, 1, (2000, 3))
    assert quality.estimate_prior(rows[:1000], rows[1000:]) > 0.9
    for n, m in ((1, 1), (1, 5), (3, 2)):
        assert 0 < quality.estimate_prior(rows[:n], rows[n : n + m]) <= 1


def test_sample_is_the_same_in_any_layout_and_bounded(spark):
    rows = spark.range(0, 20_000, 1, 3).selectExpr("id AS doc_id", "concat('t', id) AS text")
    one, other = quality.sampled(rows, 2_000), quality.sampled(rows.repartition(7), 2_000)
    assert by_row(one) == by_row(other) and 1_700 < one.count() < 2_100
    equal = spark.range(20_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'x' AS text")
    assert quality.sampled(equal, 2_000).count() <= 2_200 and quality.sampled(rows, 30_000).count() == 20_000


def test_a_real_model_scores_odd_rows(spark, odd, odd_rows, none):
    rows = [(k, "alder birch, cedar elm. " * (1 + k % 9)) for k in range(60)] + [(100 + k, "### $$$ " * (1 + k % 7)) for k in range(30)]
    labels = spark.createDataFrame([(k, 1) for k in range(40)], "doc_id long, quality int")
    model = quality.train_quality(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    found = quality.score_quality(odd, model).collect()
    assert sorted(r.doc_id or 0 for r in found) == sorted(i or 0 for i, _ in odd_rows)
    assert all(0 <= r.score <= 1 for r in found) and quality.score_quality(none, model).collect() == []
    empty = {model.scores(np.array([quality.features(b"")]))[0]}
    assert {r.score for r in found for i, text in odd_rows if i is not None and r.doc_id == i and not text} <= empty
    assert quality.train_quality(none, labels) is None


def test_no_labels_no_model(spark, odd):
    labels = spark.createDataFrame([(1, None), (None, 1), (77, 0)], "doc_id long, quality int")
    assert quality.train_quality(odd, labels) is None
    assert quality.keep_good(odd, None).count() == odd.count()


# Licenses


def test_base_phrases_at_all_places(spark):
    texts = [(1, "Under the MIT License. under-the-mit-license!"), (2, "CC BY-NC 4.0; Apache License, Version 2.0"), (3, "under the mit"), (4, None)]
    found = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for doc_id, text in texts:
        tokens = words(text)
        expected = sorted(
            (k, label) for label, phrase in licenses.BASE_PHRASES
            for k in range(len(tokens)) if tokens[k : k + len(phrase.split())] == phrase.encode().split()
        )
        assert sorted((d.first_word, d.label) for d in found[doc_id].detections if d.base) == expected
        assert found[doc_id].n_words == len(tokens)


def test_keywords_never_hide_a_match():
    rng = random.Random(6)
    ruleset = licenses.rules()
    scan = licenses.Scanner(ruleset)
    pool = "under the mit license apache version 2 0 cc by nc gnu general public spdx identifier licensed gpl copyright 2020 all rights reserved".split()
    for _ in range(300):
        folded = " " + " ".join(rng.choice(pool) for _ in range(14)) + " "
        plain = {(m.start(), m.end(), r) for r, p in scan.rules for m in p.finditer(folded)}
        assert plain == set(scan.detect(folded))


def drawn(rng, parsed):
    """A string that a parsed pattern matches."""
    made = ""
    for kind, value in parsed:
        kind = str(kind)
        if kind == "LITERAL":
            made += chr(value)
        elif kind == "ANY":
            made += "x"
        elif kind == "IN":
            kind, value = rng.choice(value)
            made += "x" if str(kind) == "CATEGORY" else chr(value if str(kind) == "LITERAL" else rng.randint(*value))
        elif kind == "BRANCH":
            made += drawn(rng, rng.choice(value[1]))
        elif kind == "SUBPATTERN":
            made += drawn(rng, value[3])
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = value
            made += "".join(drawn(rng, inner) for _ in range(rng.randint(low, min(high, low + 2))))
        else:
            raise ValueError(kind)
    return made


def test_keywords_are_in_every_string_of_a_pattern():
    rng = random.Random(9)
    scan = licenses.Scanner(licenses.rules())
    for rule, pattern in scan.rules:
        parsed = re._parser.parse(rule.pattern)
        for _ in range(60):
            folded = f" {drawn(rng, parsed)} "
            plain = {(m.start(), m.end()) for m in pattern.finditer(folded)}
            assert plain and plain == {(a, b) for a, b, r in scan.detect(folded) if r is rule}, (rule.label, folded)


@pytest.mark.parametrize("name, label", [("lgplv3", "lgpl-3"), ("lgplv2 1", "lgpl-2"), ("agplv3", "agpl-3"), ("gplv1", "gpl-1"), ("gpl3", "gpl-3"), ("apache2", "apache-2"), ("mpl2", "mpl-2"), ("epl2", "epl-2")])
def test_versions_joined_to_names(name, label):
    scan = licenses.Scanner(licenses.rules())
    assert label in {r.label for _, _, r in licenses.resolve(scan.detect(f" licensed under the {name} license "))}


def test_containment_and_priority():
    rule = lambda label, priority, base=False: licenses.Rule(label, "", priority, (), base)
    high, low, base = rule("high", 9), rule("low", 5), rule("base", 1, True)
    found = [(0, 10, high), (2, 6, low), (2, 6, base), (8, 14, low), (20, 30, low), (20, 30, high), (21, 24, low)]
    assert licenses.resolve(found) == [(0, 10, high), (2, 6, base), (8, 14, low), (20, 30, high)]


def test_named_licenses():
    scan = licenses.Scanner(licenses.rules())
    for text, label in (
        ("licensed under the gnu general public license version 3", "gpl-3"), ("spdx license identifier bsd 3 clause", "bsd-3"),
        ("released under the gnu affero general public license v3", "agpl-3"), ("released under gplv2", "gpl-2"),
        ("this is free and unencumbered software released into the public domain", "unlicense"),
    ):
        assert [r.label for _, _, r in licenses.resolve(scan.detect(f" {text} "))] == [label]


# Contamination


def test_hits_equal_a_plain_search(spark):
    rng = random.Random(8)
    pool = "a b c é d".split()
    items = [(f"i{k}", " ".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 3, 4, 6])))) for k in range(25)] + [("i1", "a a b"), (None, "d d d")]
    docs = [(k, rng.choice([" ", ", ", "\n"]).join(rng.choice(pool) for _ in range(rng.choice([0, 2, 9, 40]))).upper()) for k in range(80)]
    windows = collections.defaultdict(set)
    for item, text in items:
        tokens = words(text)
        for k in range(max(0, len(tokens) - 3) or bool(tokens)):
            windows[tuple(tokens[k : k + 4])].add(item or "")
    expected = []
    for doc_id, text in docs:
        tokens, hit, ids = words(text), set(), set()
        for window, names in windows.items():
            for k in range(len(tokens) - len(window) + 1):
                if tuple(tokens[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    ids |= names
        expected.append((doc_id, len(tokens), len(hit), sorted(ids)))
    found = contamination.find_contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), window=4
    ).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found) == expected
    texts = dict(docs)
    for row in found:
        assert sum(len(words(texts[row.doc_id][s.start : s.end])) for s in row.spans) == row.n_hit


def test_items_in_parts_equal_one_automaton(spark, odd):
    rng = random.Random(11)
    pool = "a b c é d".split()
    draw = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(f"i{k}", draw(rng.choice([0, 1, 3, 4, 6, 60]))) for k in range(20)] + [(None, "d d d")]
    docs = [(k % 70 or None, draw(rng.choice([0, 2, 5, 9, 30])).upper()) for k in range(90)]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    whole, parts = ([
        by_row(contamination.find_contamination(docs, items, window=6, part_bytes=size)),
        by_row(contamination.drop_contaminated(docs, items, window=6, part_bytes=size)),
    ] for size in (1 << 20, 150))
    assert whole == parts and any(row[2] for row in whole[0])


def test_items_are_bounded(odd, tests):
    with pytest.raises(ValueError):
        contamination.find_contamination(odd, tests, max_item_bytes=5)


# Repeats


def plain_repeats(rows, length):
    seen, found = set(), {}
    for doc_id, text in sorted(rows):
        data = (text or "").encode()
        covered = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            if data[k : k + length] in seen:
                covered[k : k + length] = True
            seen.add(data[k : k + length])
        runs = int((np.diff(np.concatenate(([0], covered.view(np.int8)))) == 1).sum())
        found[doc_id] = (len(data), int(covered.sum()), runs, np.frombuffer(data, np.uint8)[~covered].tobytes())
    return found


def repeat_docs(seed):
    rng = random.Random(seed)
    draw = lambda n: "".join(rng.choice("abcdef é") for _ in range(n))
    passages = [draw(rng.choice([90, 99, 100, 101, 140, 400])) for _ in range(10)]
    rows = []
    for k in range(200):
        parts = [rng.choice(passages) if rng.random() < 0.5 else draw(rng.choice([0, 1, 5, 60, 300])) for _ in range(rng.choice([0, 1, 2, 5]))]
        rows.append((k, rng.choice(["", "abc" * 90, "a" * 300]) if rng.random() < 0.1 else "".join(parts)))
    return [*rows, (500, None)]


@pytest.mark.parametrize("options", [{}, {"hot_contexts": 2}, {"length": 48, "gram": 8}])
def test_repeats_equal_a_set_of_strings(spark, options):
    rows = repeat_docs(len(options))
    expected = plain_repeats(rows, options.get("length", 100))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for r in repeats.remove_repeats(docs, **options).collect():
        assert (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) == expected[r.doc_id]


def test_repeats_across_strides_and_in_shuffled_lists(spark, monkeypatch):
    rows = repeat_docs(11)
    expected = plain_repeats(rows, 100)
    monkeypatch.setattr(repeats, "BROADCAST_BYTES", 0)
    docs = spark.createDataFrame([(k, t) for k, t in rows], "doc_id long, text string").repartition(2)
    for r in repeats.remove_repeats(docs).collect():
        assert bytes(r.kept) == expected[r.doc_id][3]
    data = [b"".join((t or "").encode() for _, t in rows)]
    whole = [np.concatenate(p) for p in zip(*repeats.anchors_of(data, 100, 32))]
    monkeypatch.setattr(repeats, "STRIDE", 1000)
    pieces = [np.concatenate(p) for p in zip(*repeats.anchors_of(data, 100, 32))]
    assert set(zip(*(p.tolist() for p in pieces))) == set(zip(*(p.tolist() for p in whole)))


def test_repeated_rows_are_one_document(odd, odd_rows):
    found = repeats.remove_repeats(odd).collect()
    twelve = [r for r in found if r.doc_id == 12]
    assert [r.n_removed for r in twelve] == [0, 0, 0]
    assert next(r for r in found if r.doc_id == 2).n_removed == len(odd_rows[0][1].encode())


def test_texts_without_id_whose_checksums_are_equal(spark):
    """Many texts share no id; two of them have the same CRC-32, and only one repeats something."""
    passage, plain, seen, rng = prose(1, 40)[:150], prose(2, 40)[:150], {}, random.Random(1)
    for k in range(400_000):
        text = f"{passage if k % 2 else plain} {rng.getrandbits(80):x}"
        other = seen.setdefault(zlib.crc32(text.encode()) % (1 << 31), text)
        if other != text and other[:20] != text[:20]:
            break
    assert zlib.crc32(text.encode()) % (1 << 31) == zlib.crc32(other.encode()) % (1 << 31)
    rows = [(-1, passage)] + [(None, t) for t in (text, other)]
    docs = spark.createDataFrame([(9 if i is None else 1, t) for i, t in rows] + [(None, prose(9, 5))], "doc_id long, text string").repartition(3)
    removed = {bytes(r.kept).decode(): r.n_removed for r in repeats.remove_repeats(docs).collect() if r.doc_id == 9}
    plain = next(t for t in (text, other) if not t.startswith(passage))
    assert removed.pop(plain) == 0 and list(removed.values()) == [len(passage.encode())]


ALONE = "Twelve words of plain text that stand for an article of its own."


@pytest.mark.parametrize("page", [
    f"<html><head><title>t</title><meta x><body><article><p>{ALONE}</p></article></body>",
    f"<body><article><svg class=i/><p>{ALONE}</p></article>",
    f"<body><noscript><img src=x><article><p>{ALONE}</p></article>",
    f"<body><article><p>{ALONE}</p></article><button>Go",
    f"<body><form id=aspnetForm><article><p>{ALONE}</p></article></form>",
    f"<body><div class='post has-comments'><article><p>{ALONE}</p></article></div>",
    f"<body><div class='content-sidebar-wrap'><main><p>{ALONE}</p></main><div class=sidebar>Other things here</div></div>",
    f"<body><article><p class='share-price'>{ALONE}</p></article>",
    f"<html><body><p>{ALONE}</p></body></html>",
    f"<body><article><p>{ALONE}</p></article><section class=comments><article class=comment><p>I like it very much indeed.</p></article></section>",
    f"<body><noscript><p>Enable scripts please.</p></noscript><article><p>{ALONE}</p></article><noscript><p>And here.</p></noscript>",
])
def test_odd_wrappers_and_missing_tags_lose_no_article(page):
    assert html.main_text(page, html.trained()).removesuffix("\nGo") == ALONE


@pytest.mark.parametrize("name", ["bpe", "html"])
def test_bytes_that_are_no_text(spark, tests, name):
    """Bytes that are no UTF-8 count as the replacement character."""
    docs = spark.createDataFrame([(1, 0)], "doc_id long, n int").selectExpr("doc_id", "CAST(X'FF4142' AS string) AS text")
    good = spark.createDataFrame([(1, "\ufffdAB")], "doc_id long, text string")
    assert by_row(OPERATORS[name](docs, tests)) == by_row(OPERATORS[name](good, tests))


def test_states_are_bounded_within_a_piece():
    """One piece of many letters starts over like many pieces do, and encodes the same."""
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000))
    with open(RANKS, "rb") as stream:
        found = bpe.Transducer(bpe.read_ranks(stream.read()), max_states=2_000)
    with open(RANKS, "rb") as stream:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, stream)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert list(found.encode(text.encode())) == library.encode_ordinary(text)
    assert len(found.states) <= 2_000 + bpe.LOOKED_AT


def test_suffix_order():
    rng = random.Random(0)
    for size in (1, 2, 5, 30, 400):
        for alphabet in (b"ab", b"abc\x00\xff", b"a"):
            data = bytes(rng.choice(alphabet) for _ in range(size))
            text = np.frombuffer(data + data[: size // 2], np.uint8)
            table = suffixes.words8(text, 108)
            order = suffixes.sorted_suffixes(text, 100, table)
            heads = [text[k : k + 100].tobytes() for k in order]
            assert sorted(order.tolist()) == list(range(len(text))) and heads == sorted(heads)
