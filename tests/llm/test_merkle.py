"""The manifest against a plain version that builds the tree and folds every proof by itself."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lumisift.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, place string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, text, lang, source, n):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def climb(level):
    """The root of ``level`` and for each of its nodes the groups of siblings: (before, after)."""
    at, paths = list(range(len(level))), [[] for _ in level]
    while len(level) > 1:
        for k, p in enumerate(at):
            run = level[p // 16 * 16 : p // 16 * 16 + 16]
            paths[k].append((run[: p % 16], run[p % 16 + 1 :]))
            at[k] = p // 16
        level = [h(*level[p : p + 16]) for p in range(0, len(level), 16)]
    return level[0], paths


def plain(rows):
    by = {}
    for i, text, lang, source, n in rows:
        low = text
        if i is not None and text is not None and zlib.crc32(str(i).encode()) % 5 == 0:
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        by.setdefault(source, []).append((i is not None, i or 0, leaf(i, text, lang, source, n), leaf(i, low, lang, source, n), i))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(by[s])]) for s in names}
    root, tops = climb([trees[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for (_, _, own, hurt, i), path in zip(sorted(by[s]), trees[s][1], strict=True):
            folded = hurt
            for before, after in path + tops[k]:
                folded = h(*before, folded, *after)
            proof = h(*(d for before, after in path + tops[k] for d in before + after))
            out.append((i, own, trees[s][0], root, proof, folded, folded == root))
    return sorted(out, key=repr)


def documents(n, sources, seed):
    rng = random.Random(seed)
    rows = [(k * 3, f"Text {k} ÄA" * rng.randrange(4), rng.choice(["en", None]), rng.choice(sources), k) for k in range(n)]
    return rows + [(6, None, None, sources[0], None), (None, "A", "en", sources[0], 1), (None, "", "en", sources[-1], 1)] + rows[:2] * 3


@pytest.mark.parametrize("rows", [
    documents(700, ["s0", "s0", "s0", "s1", None, "", "Z", "é", "z"], 1), documents(40, [f"s{k}" for k in range(60)], 2), documents(14, ["a"], 3),
    documents(300, [None], 4), [(1, "One", "en", "x", 3)], [(10, "Aa", None, "x", 3), (11, "B", "en", "y", 3)],
])
def test_manifest(spark, rows):
    docs = spark.createDataFrame([(*(r[0], r[1], r[2], r[3], r[4]), "clash", "clash") for r in rows], SCHEMA).repartition(3)
    got = merkle.manifest(spark, docs, merkle.lowered_where_fifth())
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain([(r[0], r[1], r[2], r[3], r[4]) for r in rows])


def test_untampered_and_empty(spark):
    docs = spark.createDataFrame([(k, "Text", "en", f"s{k % 3}", 4, "", "") for k in range(100)], SCHEMA)
    assert merkle.manifest(spark, docs).where("verified").count() == 100
    assert merkle.manifest(spark, docs.where(F.lit(False))).count() == 0


def test_more_rows_than_the_default_limit_of_recursion(spark):
    key = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(key, "50")
    try:
        docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("T").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
        assert merkle.manifest(spark, docs).where("verified").count() == 4000
        assert spark.conf.get(key) == "50"
    finally:
        spark.conf.unset(key)
