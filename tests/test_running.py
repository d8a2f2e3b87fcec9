"""Ranges of equal depth: bounds on their rows, and sums, ranks and medians against plain versions."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lumisift.operators import evaluation, running

RANGES, LEAST = 64, 50


def _columns():
    rng = random.Random(8)
    tail = [rng.lognormvariate(0, 6) for _ in range(20000)]
    return {
        "outlier": [rng.uniform(0, 100) for _ in range(20000)] + [1e12, -1e12],
        "heavy_tail": tail + [-v for v in tail[:5000]],
        "special": [rng.gauss(0, 1) for _ in range(9000)] + [math.nan, math.inf, -math.inf, 0.0],
        "steps": [float(k) for k in range(10000)],
        "few": [1.0, 2.0, 3.0],
    }


@pytest.fixture(scope="module")
def columns(spark):
    plain = {k: sorted(set(v), key=lambda x: (math.isnan(x), x)) for k, v in _columns().items()}
    rows = [(k, x) for k, v in plain.items() for x in v]
    random.Random(1).shuffle(rows)
    return plain, spark.createDataFrame(rows, "k string, v double").repartition(7).cache()


def test_no_range_gathers_rows(columns):
    plain, df = columns
    got = running.in_ranges(df, ["k"], "v", RANGES, LEAST).groupBy("k", "_range").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
    for k, values in plain.items():
        own = sorted((r for r in got if r["k"] == k), key=lambda r: r["_range"])
        assert max(r["n"] for r in own) <= max(LEAST, len(values) / RANGES) + len(values) / RANGES / 4 + 1, k
        assert len(own) >= min(RANGES, len(values) // LEAST) * 0.9
        order = [(math.isnan(v), v) for r in own for v in (r["low"], r["high"])]
        assert order == sorted(order), k


def test_one_outlier_beside_200000_rows(spark):
    rows = spark.range(200000).select((F.xxhash64("id") % 1000003 / 10000.0).alias("v")).distinct().unionByName(spark.createDataFrame([(1e12,)], "v double"))
    n = rows.count()
    deepest = running.in_ranges(rows.withColumn("_all", F.lit(0)), ["_all"], "v").groupBy("_range").count().agg(F.max("count")).first()[0]
    assert deepest <= max(4096, n / 1024) + n / 4096 + 1
    last = running.numbered(rows, "v").orderBy(F.col("v").desc()).first()
    assert last["v"] == 1e12 and last["i"] == n


@pytest.mark.parametrize("descending", [False, True])
def test_sums(columns, descending):
    plain, df = columns
    got = running.running_sums(df.withColumn("w", F.lit(2)), ["k"], "v", ["w"], descending, RANGES, LEAST).collect()
    place = {(r["k"], repr(r["v"])): r["cum_w"] for r in got}
    for k, values in plain.items():
        for i, v in enumerate(reversed(values) if descending else values):
            assert place[k, repr(v)] == 2 * (i + 1)


def test_medians_of_mostly_equal_values(spark):
    rng = random.Random(3)
    rows = [("a", 7.0 if rng.random() < 0.99 else rng.gauss(0, 1e6)) for _ in range(5000)] + [("b", rng.choice([1e12, rng.random(), math.inf])) for _ in range(5001)] + [(None, 1.0)]
    got = {r["k"]: r["median"] for r in running.medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", 16, 20).collect()}
    assert got == {k: statistics.median(v for g, v in rows if g == k) for k in ("a", "b")}


def test_long_integers_beyond_doubles(spark):
    ids = [(1 << 62) + k for k in range(3000)]
    got = running.running_sums(spark.createDataFrame([(i,) for i in ids], "i long").withColumn("w", F.lit(1)), [], "i", ["w"], ranges=16, least=10).collect()
    assert {r["i"]: r["cum_w"] for r in got} == {i: k + 1 for k, i in enumerate(ids)}


def test_ranking_of_heavy_tailed_scores(spark):
    """Ties and a budget that ends inside a tie, on scores over 300 orders of magnitude."""
    rng = random.Random(6)
    rows = [(k, int(rng.random() < 0.2), rng.choice([10.0 ** rng.randrange(-150, 150), 5.0, 1e300])) for k in range(4000)]
    df = spark.createDataFrame([(e, y, "m", s) for e, y, s in rows], "entity long, label long, model string, score double")
    got = evaluation.ranking_metrics(df, ["model"], 100).first()
    left, hit, seen, found, ap = 100, 0.0, 0, 0, 0.0
    for s in sorted({s for *_, s in rows}, reverse=True):
        y = [label for _, label, x in rows if x == s]
        hit += sum(y) * min(left, len(y)) / len(y)
        left -= min(left, len(y))
        seen, found = seen + len(y), found + sum(y)
        ap += sum(y) * found / seen
    positives = sum(y for _, y, _ in rows)
    assert got["recall_at_budget"] == pytest.approx(hit / positives) and got["precision_at_budget"] == pytest.approx(hit / 100) and got["average_precision"] == pytest.approx(ap / positives)
