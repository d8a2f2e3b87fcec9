"""What differs from SQL only on larger tables, in small."""

import hashlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lumisift.functions import scalars as S
from lumisift.operators import evaluation, retrieval, tables
from lumisift.plans.registry import ORACLE, QUERIES

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _both(spark, folder, name, tables):
    """Rows of a query over these tables by Spark and by its SQL, columns in order of their names."""
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for table, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(columns)} from ({ORACLE[name]})").fetchall()
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))), sorted(map(repr, want))


def _events(spark, *points):
    """Measurements (user, second, value, k) of one band."""
    rows = [(i, 1704067200.0 + t, user, "view", value, f'{{"k": {k}}}') for i, (user, t, value, k) in enumerate(points)]
    return spark.createDataFrame(rows, EVENTS.replace("timestamp", "double")).withColumn("ts", F.timestamp_seconds("ts").cast("timestamp_ntz"))


def test_digest_of_many_rows(spark):
    n = 100_000
    got = tables.snapshot_row(spark.range(n), ["id"], "ids", "none", "none").first()
    want = sum(int(hashlib.sha256(f'{{"id":{i}}}'.encode()).hexdigest()[:12], 16) for i in range(n))
    assert want > 2**63 and (got["n"], got["content"]) == (n, str(want))


def test_doubles_are_rounded_as_by_sql(spark):
    values = [409.84 / 51.2, 8.0046875, 0.0078125, -0.0078125, 1e303, 60310.0000005, float("inf"), 0.1]
    got = [r["x"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(S.rounded(F.col("v")).alias("x")).collect()]
    assert got == [duckdb.execute("select round(?::double, 6)", [v]).fetchone()[0] for v in values]


def test_magnitude_channel_of_one_point(spark, tmp_path):
    got, want = _both(spark, tmp_path, "e1_channel_features", {"events": _events(spark, (1, 0, 20.0, 3), (2, 0, 30.0, 4), (2, 86400, 40.0, 5))})
    assert got == want and len(got) == 2


def test_flux_whose_excursion_ends_in_a_half(spark, tmp_path):
    # 409.84 / 51.2 is 8.0046875, whose double times a million lies just below the half
    got, want = _both(spark, tmp_path, "e2_flux_features", {"events": _events(spark, (1, 0, 51.2, 0), (1, 86400, 51.2, 0), (1, 172800, 461.04, 0))})
    assert got == want and len(got) == 1


def test_source_with_a_channel_of_one_point(spark, tmp_path):
    many = [(2, 86400 * i, 30.0 + i * i, i) for i in range(6)]
    one = _events(spark, (2, 0, 20.0, 3)).withColumn("event_type", F.lit("click")).withColumn("event_id", F.lit(99).cast("long"))
    got, want = _both(spark, tmp_path, "e7_source_features", {"events": _events(spark, *many).unionByName(one)})
    assert got == want and len(got) == 1


def test_benchmarks_agree_as_stored(spark, tmp_path):
    # of this fold and score_a, precisions differ by 1.7e-6 before and by 1e-6 after rounding to six decimals
    r = np.random.default_rng(3959)
    labels, order = r.integers(0, 2, 80), r.permutation(80)
    chars = np.empty(80, int)
    chars[order] = 100 * np.arange(80, 0, -1)
    rows = [(1, 0, 1), *((80 + i, int(chars[i]), int(labels[i])) for i in range(80))]
    df = spark.createDataFrame(rows, "doc_id long, n_chars long, quality int")
    got, want = _both(spark, tmp_path, "c20_benchmark_agreement", {"documents": df.select("doc_id", "n_chars"), "labels": df.select("doc_id", "quality")})
    assert got == want and len(got) == 3


def test_host_whose_chance_ties_in_doubles(spark, tmp_path):
    # 1 - exp(-x) of both hosts is the same double, -expm1(-x) is not
    names = [(k, f"Customer#{k:09d}", "BUILDING") for k in (7484, 3884)]
    customer = spark.createDataFrame(names, "c_custkey long, c_name string, c_mktsegment string")
    got, want = _both(spark, tmp_path, "d15_host_association", {"events": _events(spark, (284, 0, 20.0, 3)), "customer": customer})
    assert got == want and "Customer#000003884" in got[0]


def test_queries_cut_off_in_the_only_time_block(spark):
    # no cell is old enough as a whole, which once made a query meet every entry
    r = np.random.default_rng(5)
    n, key = 4000, r.normal(size=(4000, 2)).round(2)
    entries = [(f"e{i:04d}", key[i].tolist(), [float(i)], int(i % 5), float(r.random()), "c", 0) for i in range(n)]
    queries = [(f"q{i:02d}", r.normal(size=2).tolist(), 1, float(r.uniform(0.3, 1)), "c", 0) for i in range(50)]
    stratum = "calibration string, population long"
    e = spark.createDataFrame(entries, f"id string, key array<double>, residual array<double>, source_group long, usable_at double, {stratum}")
    q = spark.createDataFrame(queries, f"id string, key array<double>, source_group long, cutoff double, {stratum}")
    fit = {x[0]: [y for y in entries if y[3] != 1 and y[4] <= x[3]] for x in queries}
    assert retrieval.pairs(e, q, 3).count() < 0.05 * sum(map(len, fit.values()))
    got = {x["query"]: x["neighbours"] for x in retrieval.recall(e, q, 3).collect()}
    far = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2
    assert got == {x[0]: [y[0] for y in sorted(fit[x[0]], key=lambda y: (far(x[1], y[1]), y[0]))[:3]] for x in queries}


def test_bootstrap_broadcasts_no_rows(spark):
    # rows in files too small for Spark's threshold
    n = 150_000
    rows = spark.range(n).select(F.col("id").alias("entity"), (F.col("id") % 5 == 0).cast("long").alias("label"), (F.col("id") * 7 % 100 / 100.0).alias("a"))
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    assert evaluation.bootstrap(rows, ["a"], 2, 50).count() == 1
    runs = store.executionsList()
    sent = []
    for i in range(before, runs.size()):
        values, nodes = store.executionMetrics(runs.apply(i).executionId()), store.planGraph(runs.apply(i).executionId()).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if "BroadcastExchange" in node.name():
                metrics = [node.metrics().apply(j) for j in range(node.metrics().size())]
                sent += [int(values.get(m.accumulatorId()).get().replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.get(m.accumulatorId()).isDefined()]
    assert sent and max(sent) < n
