"""Substring, suffix and near-duplicate operators against brute force on small tables with edge cases."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumisift.llm import hyperminhash, substring_dedup, suffix_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, removed string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}é" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    shared = [words(rng, 60), words(rng, 13), words(rng, 90, 3)]
    texts = [None, "", "   \n\t ", "one", "one two", "one two", "ONE two", "x" * 3000, "x" * 900, "ab" * 800, "  \x0b z"]
    for i in range(60):
        parts = [words(rng, rng.randrange(0, 80)), *rng.sample(shared, rng.randrange(3)), words(rng, rng.randrange(0, 40))]
        texts.append(" ".join(parts))
    base = words(rng, 120)
    for i in range(25):
        w = base.split()
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(30)}"
        texts.append(" ".join(w))
    texts += [base, base, shared[0] + "  " + shared[0]]
    return [(i * 3 + 1 if i != 7 else -4, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, "en", None, 1, "clash") for i, t in corpus]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("fan", [256, 5, 2])
def test_substring_windows(spark, corpus, docs, fan):
    width, first, split = 13, {}, {i: WORD.findall((t or "").encode()) for i, t in corpus}
    for i, w in split.items():
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, 1 << 60), i)
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark, docs, width, batch_bytes=3000, bucket_bytes=5000, fan=fan).collect()}
    assert len(got) == len(corpus)
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        r = got[i]
        assert (r["n_words"], r["n_removed"]) == (len(w), sum(gone))
        assert r["kept_text"].encode() == b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert sum(s["end"] - s["start"] for s in r["removed"]) == sum(gone)


def test_substring_null_and_equal_ids(spark):
    t = words(random.Random(1), 30)
    rows = spark.createDataFrame([(None, t), (None, t), (5, t), (5, t)], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["n_removed"]) for r in substring_dedup.remove_repeats(spark, rows).collect())
    assert got == [(False, 0), (False, 0), (True, 30), (True, 30)]


@pytest.mark.parametrize(("length", "fan"), [(160, 256), (400, 256), (400, 2)])
def test_suffix_strings(spark, corpus, docs, length, fan):
    data = {i: (t or "").encode() for i, t in corpus}
    count = Counter(b[k : k + length] for b in data.values() for k in range(len(b) - length + 1))
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeated_bytes(spark, docs, length, batch_bytes=3000, bucket_bytes=9000, fan=fan).collect()}
    assert len(got) == len(corpus)
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        r = got[i]
        assert (r["n_bytes"], r["n_removed"]) == (len(b), sum(gone))
        runs = re.findall(b"\1+", bytes(gone))
        assert len(r["removed"]) == len(runs)
        # never more than the longest string that also starts elsewhere, never less than a removed run
        assert r["longest_common"] >= max(map(len, runs), default=0)
        if not runs and (n := r["longest_common"]):
            shared = Counter(x[k : k + n] for x in data.values() for k in range(len(x) - n + 1))
            assert any(shared[b[k : k + n]] > 1 for k in range(len(b) - n + 1))
        assert hashlib.sha256(r["kept"]).digest() == hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).digest()


def test_suffix_rejects_short_lengths(spark, docs):
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeated_bytes(spark, docs, 50)


def _brute_components(corpus, width):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = {}
    for i, t in corpus:
        w = WORD.findall((t or "").encode().translate(lower))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, corpus, docs, width):
    want = _brute_components(corpus, width)
    rows = hyperminhash.near_duplicates(spark, docs, width).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    if width == 5:
        kept = hyperminhash.without_duplicates(spark, docs)
        assert kept.columns == docs.columns
        assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, (_, c) in want.items() if i == c}


def test_contained_pair_at_the_threshold_in_large_buckets(spark):
    # 600 documents share 80 words with 9001 and have 21 of their own; 9002 has 20, so only it links with 9001
    base = " ".join(f"b{k}" for k in range(80))
    own = lambda i, n: base + "".join(f" d{i}x{k}" for k in range(n))
    corpus = [(i, own(i, 21)) for i in range(600)] + [(9001, base), (9002, own(9002, 20))]
    want = _brute_components(corpus, 1)
    assert want[9002] == (100, 9001)
    rows = hyperminhash.near_duplicates(spark, spark.createDataFrame(corpus, "doc_id long, text string").repartition(3), 1).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want


def test_near_duplicates_null_id(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (2, "A b c d"), (3, "a b c d")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in hyperminhash.near_duplicates(spark, rows, 2).collect())
    assert got == [("2", "2", True), ("3", "2", False), ("3", "2", False), ("None", "None", True)]


@pytest.mark.parametrize("run", [substring_dedup.remove_repeats, suffix_dedup.remove_repeated_bytes, hyperminhash.near_duplicates])
def test_empty_table(spark, run):
    assert run(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimate_is_close(spark):
    import numpy as np

    rng = random.Random(2)
    a = [f"t{i}" for i in range(400)]
    b = a[:360] + [f"u{rng.random()}" for _ in range(40)]
    from lumisift.llm.text import Batch

    data = [" ".join(x).encode() for x in (a, b)]
    key, first = hyperminhash.shingles(Batch(np.arange(2), np.array([len(d) for d in data]), b" ".join(data)), 1)
    sig = hyperminhash.registers(key, first)
    guess, used = hyperminhash.estimate(sig[:1], sig[1:], np.array([400]), np.array([400]))
    assert used[0] > 180 and abs(guess[0] - 360 / 440) < 0.12


def test_query_sql_is_whole(spark, sf_dir):
    from lumisift.llm.queries import QUERIES

    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert QUERIES["op6_substring_dedup"](spark, sf_dir).agg(F.count("*")).first()[0] == n


def test_rows_of_one_id_are_one_node(spark):
    rng = random.Random(12)
    a, b, c = (words(rng, 40) for _ in range(3))
    rows = [(5, a), (5, b), (1, a), (2, b), (9, c), (9, c), (7, c), (8, words(rng, 30)), (8, ""), (8, words(rng, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in hyperminhash.near_duplicates(spark, docs).collect()}
    assert got == {(5, 1, False), (1, 1, True), (2, 1, False), (9, 7, False), (7, 7, True), (8, 8, True)}
