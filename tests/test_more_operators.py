"""Operators without SQL, or with hot keys, against plain versions."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisift.operators import legacy, running, scores, search, surprise
from lumisift.sources import files


def test_epochs_need_a_query_of_their_own(spark):
    rng = random.Random(1)
    rows = [(i, sorted(rng.uniform(0, 20) for _ in range(rng.randrange(0, 9))), sorted(rng.uniform(0, 20) for _ in range(rng.randrange(0, 9)))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, r array<double>, q array<double>")
    got = {x["id"]: x["n"] for x in df.select("id", scores.epochs_uncovered(F.col("r"), F.col("q"), 1.0).alias("n")).collect()}
    for i, refs, queries in rows:
        free, missed = list(queries), 0
        for r in refs:
            free = [q for q in free if q >= r - 1.0]
            if free and free[0] <= r + 1.0:
                free.pop(0)
            else:
                missed += 1
        assert got[i] == missed


def test_medians_and_running_sums(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.8 else "b", rng.choice([1.0, 1.0, rng.gauss(0, 5), 1e6])) for _ in range(3000)] + [("one", 4.0), ("none", None)]
    got = {r["k"]: (r["median"], r["n"]) for r in running.medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    for k in ("hot", "b", "one"):
        own = [v for g, v in rows if g == k]
        assert got[k] == (pytest.approx(statistics.median(own)), len(own))
    assert "none" not in got
    places = [(r["v"], r["i"]) for r in running.numbered(spark.createDataFrame([(float(v),) for v in (5, -3, 2, 100, 7)], "v double"), "v").collect()]
    assert sorted(places) == [(-3.0, 1), (2.0, 2), (5.0, 3), (7.0, 4), (100.0, 5)]
    assert running.medians(spark.createDataFrame([], "v double"), [], "v").count() == 0


def test_legacy_features(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        t = i * 0.7 + rng.uniform(0, 0.3)
        rows.append(("sine", t, 18 + 0.6 * np.sin(2 * np.pi * t / 3.1) + rng.normal(0, 0.02), 0.02))
        rows.append(("flat", t, 18 + rng.normal(0, 0.02), 0.02))
        rows.append(("pulse", t, 18 + rng.normal(0, 0.02) - (2.0 if 20 <= i < 24 else 0.0), 0.02))
    rows += [("few", 1.0, 18.0, 0.1), ("same", None, 18.0, 0.1)]
    df = spark.createDataFrame([(s, None if t is None else float(t), float(m), float(e)) for s, t, m, e in rows], "source_id string, mjd double, magnitude double, magnitude_error double")
    got = {r["source_id"]: r for r in legacy.legacy_features(df).collect()}
    assert got["sine"]["periodic"] and got["sine"]["period"] == pytest.approx(3.1, rel=0.02) and got["sine"]["reason"] == "periodic_variable"
    assert got["flat"]["reason"] == "low_amplitude" and got["few"]["reason"] == "too_few_points" and "same" not in got
    assert got["pulse"]["is_candidate"] and got["pulse"]["n_below"] == 4 and got["pulse"]["amplitude"] == pytest.approx(2, abs=0.1)


def test_clipping():
    x = np.concatenate([np.random.default_rng(4).normal(0, 1, 200), [50.0, -60.0]])
    mid, dev = legacy.clipped(x)
    assert abs(mid) < 0.3 and 0.8 < dev < 1.2


@pytest.mark.parametrize("family", search.FAMILIES)
def test_shapes_have_a_unit_peak_at_phase_zero(family):
    q = np.linspace(-30, 60, 90001)
    y = search.shape(family, q)
    assert y.max() == pytest.approx(1) and abs(q[y.argmax()]) < 2e-3 and (y >= 0).all() and y[0] < 1e-6
    want = {"gaussian": np.exp(-0.5), "exponential": np.exp(-1), "fallback": 2 ** (-5 / 3), "bazin": np.exp(-1 - np.log(2) / 3) / (1 + np.exp(-3 - np.log(2))) * 1.5 * 2 ** (1 / 3)}[family]
    assert float(search.shape(family, np.array([1.0]))[0]) == pytest.approx(want)


def test_alias_resolution():
    assert files.resolve(["oid", "mjd", "jd"])["mjd"] == "mjd"
    with pytest.raises(ValueError, match="several"):
        files.resolve(["oid", "magpsf", "mag"])
    with pytest.raises(ValueError, match="no column"):
        files.resolve(["oid"], {"mjd": "when"})


def test_outputs_are_never_overwritten(spark, tmp_path):
    df = spark.range(3)
    files.publish(df, f"{tmp_path}/out")
    with pytest.raises(Exception, match="already exists"):
        files.publish(df, f"{tmp_path}/out")


def test_canonical_rows_keep_their_problems(spark):
    raw = spark.createDataFrame([("001", "2460000.5", "1", "18.2", "10", "-20", "detected"), (" ", "2460001.5", "2", "1x", "10", "-20", "no")], "oid string, jd string, fid string, magpsf string, ra string, dec string, detected string")
    a, b = files.canonical(raw, "ztf").orderBy("mjd").collect()
    assert (a["source_id"], a["mjd"], a["band"], a["is_detection"], a["problem"]) == ("001", 60000.0, "g", True, None)
    assert b["problem"] == "missing source_id" and b["magnitude"] is None and b["is_detection"] is False


def test_stores_keep_what_they_hold(spark, tmp_path):
    from lumisift.streaming import stores

    store = stores.Store(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), stores.SNAPSHOT)
    stores.append_snapshots(store, rows(("s", 1, 5.0), ("s", 1, 5.0), ("t", 9, 1.0)))
    stores.append_snapshots(store, rows(("s", 1, 5.0), ("s", 2, 5.0), ("s", 3, 4.0), ("s", 4, 6.0)))
    assert {r["snapshot_id"] for r in store.read("snapshots", stores.SNAPSHOT).collect()} == {1, 9, 4}
    assert {(r["snapshot_id"], r["reason"]) for r in store.read("diverted", stores.SNAPSHOT + ", reason string").collect()} == {(2, "watermark_reused"), (3, "watermark_went_back")}


def test_surprise_components_against_plain_sums(spark):
    rng = np.random.default_rng(3)
    t, b, c = rng.normal(size=(3, 40, 8))
    rows = [(i, t[i].tolist() if i != 7 else None, b[i].tolist(), c[i].tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, t array<double>, b array<double>, c array<double>").repartition(3)
    keep = [i for i in range(40) if i != 7]
    cov = surprise.residual_covariance(df.select(F.zip_with("t", "b", lambda x, y: x - y).alias("r")), "r", 8)
    assert np.allclose(cov, np.cov((t - b)[keep].T) + 1e-6 * np.eye(8))
    got = {r["id"]: r for r in surprise.surprise_components(df, "t", "b", "c", cov).collect()}
    assert len(got) == 40 and got[7]["predictive_surprise"] is None and got[7]["spectral_wedge"] is None
    for i in keep:
        d, e = t[i] - b[i], t[i] - c[i]
        wedge = sum(np.cross(t[i][k + 1 : k + 4], b[i][k + 1 : k + 4]) for k in (0, 4))
        want = [d @ np.linalg.solve(cov, d), e @ np.linalg.solve(cov, e), 1 - t[i] @ b[i] / np.linalg.norm(t[i]) / np.linalg.norm(b[i]), np.linalg.norm(wedge), np.linalg.norm(c[i] - b[i])]
        assert np.allclose(list(got[i])[4:], want)


def test_isolation_forest_finds_planted_rows(spark):
    rng = random.Random(4)
    rows = [(i, rng.gauss(0, 1), rng.gauss(5, 2) if i % 10 else None) for i in range(600)] + [(1000 + i, 9.0 + i, -9.0) for i in range(5)] + [(2000, None, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double").repartition(3)
    run = lambda d: {r["id"]: r for r in surprise.isolation_scores(d, "id", ["a", "b"], trees=40, sample=64).collect()}
    got = run(df)
    assert len(got) == 606 and got == run(df.repartition(2))  # however the rows are stored
    assert {i for i, _ in sorted(got.items(), key=lambda x: -x[1]["score"])[:5]} == {1000, 1001, 1002, 1003, 1004}
    assert all(0 <= r["isolation"] <= 1 for r in got.values()) and not got[2000]["valid"] and got[2000]["score"] == 0
    assert surprise.isolation_scores(df.where("id = 3"), "id", ["a", "b"]).first()["isolation"] is None


def test_path_lengths_follow_the_tree():
    x = np.random.default_rng(1).normal(size=(50, 3))
    tree = {k: np.array(v) for k, v in surprise.grow(x, np.random.default_rng(2), 6).items()}
    for row, got in zip(x, surprise.path_lengths(tree, x), strict=True):
        at = 0
        while tree["feature"][at] >= 0:
            at = tree["left"][at] if row[tree["feature"][at]] <= tree["cut"][at] else tree["right"][at]
        assert got == tree["leaf"][at]


def test_cohort_contract(spark):
    schema = "entity string, first double, last double, cutoff double"
    good = [("a", 1.0, 2.0, 3.0), ("b", 1.0, 3.0, 3.0)]
    freeze = lambda rows: surprise.freeze_cohort(spark.createDataFrame(rows, schema), "entity", "first", "last", "cutoff")
    assert freeze(good).first()["frozen"]
    for bad in ([good[0]], [*good, good[0]], [*good, ("c", 1.0, 4.0, 3.0)], [*good, (" ", 1.0, 2.0, 3.0)], [*good, ("c", None, None, 3.0)], [*good, ("c", 1.0, 2.0, float("nan"))], []):
        assert not freeze(bad).first()["frozen"]
    exact = lambda rows: surprise.same_population(freeze(good), spark.createDataFrame(rows, schema), "entity").first()["exact"]
    assert exact(good[::-1]) and not exact(good[:1]) and not exact([good[0], ("c", 1.0, 3.0, 3.0)]) and not exact([])
