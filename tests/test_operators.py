"""Edge cases of the operators, against plain Python."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisift.functions import scalars as S
from lumisift.operators import crossmatch, curves, evaluation, search, tables
from lumisift.plans.components import components
from lumisift.plans.scratch import Scratch


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_numbers_and_flags(spark):
    rows = spark.createDataFrame([(" 1.5 ",), ("",), ("abc",), ("inf",), ("NaN",), (None,)], "t string")
    got = rows.select(S.number(F.col("t")).alias("n"), S.malformed(F.col("t")).alias("bad")).collect()
    assert [r["n"] for r in got] == [1.5, None, None, None, None, None]
    assert [r["bad"] for r in got] == [False, False, True, True, True, False]
    assert one(spark, S.flag(F.lit(" Yes "))) is True and one(spark, S.flag(F.lit("2"))) is None
    assert one(spark, S.passband(F.lit("ZTF_R"))) == "r" and one(spark, S.passband(F.lit("null"))) is None


def test_separation_wraps(spark):
    assert one(spark, S.separation_arcsec(F.lit(359.9999), F.lit(0.0), F.lit(0.0001), F.lit(0.0))) == pytest.approx(0.72, abs=1e-9)
    assert one(spark, S.separation_arcsec(F.lit(10.0), F.lit(90.0), F.lit(200.0), F.lit(90.0))) == pytest.approx(0, abs=1e-6)


def test_cone_match_at_the_wrap_and_the_pole(spark):
    sources = spark.createDataFrame([("a", 359.9999, 0.0), ("b", 10.0, 89.9999), ("c", 50.0, -90.0), ("d", 180.0, 0.0)], "source_id string, ra_deg double, dec_deg double")
    catalog = spark.createDataFrame([("near0", 0.0001, 0.0, "star"), ("pole", 190.0, 89.9999, "star"), ("south", 230.0, -89.9999, "agn")], "name string, ra_deg double, dec_deg double, otype string")
    got = {r["source_id"]: r["names"] for r in crossmatch.cone_match(sources, catalog, 2.0).collect()}
    assert got == {"a": "near0", "b": "pole", "c": "south", "d": ""}


def test_others_median_and_scatter():
    rng = np.random.default_rng(0)
    for n in (2, 3, 4, 7, 12):
        x = np.round(rng.normal(size=n), 1)
        mid = curves.others_median(x)
        scatter = curves.others_scatter(x, mid)
        for i in range(n):
            rest = [float(v) for j, v in enumerate(x) if j != i]
            m = statistics.median(rest)
            assert mid[i] == pytest.approx(m)
            want = 0.0 if len(rest) < 2 else 1.4826 * statistics.median([abs(v - m) for v in rest])
            assert scatter[i] == pytest.approx(want)


def test_slope_needs_two_times(spark):
    rows = spark.createDataFrame([("a", 1.0, 5.0, 1.0), ("a", 1.0, 6.0, 1.0), ("b", 1.0, 1.0, None), ("b", 3.0, 5.0, 1.0)], "k string, t double, x double, e double")
    got = {r["k"]: r["slope"] for r in curves.weighted_slope(rows, ["k"], "t", "x", "e").collect()}
    assert got["a"] is None and got["b"] == pytest.approx(2.0)


def test_ranking_metrics_with_ties(spark):
    rows = spark.createDataFrame([(1, 0.5, "m"), (0, 0.5, "m"), (0, 0.5, "m"), (1, 0.1, "m")], "label long, score double, model string")
    r = evaluation.ranking_metrics(rows, ["model"], 1).first()
    assert r["recall_at_budget"] == pytest.approx(1 / 6) and r["precision_at_budget"] == pytest.approx(1 / 3)
    assert r["average_precision"] == pytest.approx(0.5 * 1 / 3 + 0.5 * 2 / 4)
    none = evaluation.ranking_metrics(rows.withColumn("label", F.lit(0)), ["model"], 2).first()
    assert none["average_precision"] == 0


def test_bootstrap_of_equal_scores_has_no_difference(spark):
    rows = spark.range(200).select(F.col("id").alias("entity"), (F.col("id") % 3 == 0).cast("long").alias("label"), (F.col("id") * 7 % 11).cast("double").alias("a"), (F.col("id") * 7 % 11).cast("double").alias("b"))
    got = {r["model"]: r for r in evaluation.bootstrap(rows, ["a", "b"], 50, 20).collect()}
    assert got["b"]["mean_delta"] == 0 and got["a"]["low"] < got["a"]["mean_recall"] < got["a"]["high"]


def test_template_search_finds_a_pulse(spark):
    rng = np.random.default_rng(1)
    t = np.arange(32.0)
    rows = []
    for s in range(6):
        y = rng.normal(0, 1, 32) + (30 * np.exp(-0.5 * ((t - 15.5) / 3) ** 2) if s == 0 else 0)
        rows += [(str(s), "s", "g", float(a), float(b), 1.0) for a, b in zip(t, y, strict=True)]
    rows.append(("short", "s", "g", 1.0, 1.0, 1.0))
    df = spark.createDataFrame(rows, "source_id string, survey string, band string, mjd double, flux double, flux_error double")
    for kw in ({}, {"null": "gaussian"}, {"correlation_days": 2.0}):
        got = {r["source_id"]: r for r in search.search(df, n_centers=9, **kw).collect()}
        assert got["0"]["p_value"] <= 0.05 and got["0"]["max_z"] > 20 and got["0"]["least_z"] > 10
        assert got["short"]["p_value"] is None and len(got) == 7


def test_long_channels_are_searched(spark):
    rng = np.random.default_rng(3)
    t = np.arange(50000) / 500
    y = rng.normal(0, 1, len(t)) + 3 * np.exp(-0.5 * ((t - t[-1] / 2) / 3) ** 2)
    rows = [("hot", "s", "g", float(a), float(b), 1.0) for a, b in zip(t, y, strict=True)]
    rows += [("hot", "s", "r", float(a), 0.0, 1.0) for a in range(2)] + [("short", "s", "g", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "source_id string, survey string, band string, mjd double, flux double, flux_error double")
    found = search.search(df, families=("gaussian",)).cache()
    hot = found.where("source_id = 'hot' and band = 'g'").first()
    assert hot["n"] == 50000 and hot["p_value"] == 0.01 and (hot["center"], hot["width"]) == (pytest.approx(t[-1] / 2), 3.0)
    assert hot["amplitude"] == pytest.approx(3, abs=0.2) and hot["least_z"] < hot["max_z"]
    got = {r["source_id"]: r for r in search.correct(found, 1, 1, 0.05, 99).collect()}
    assert (got["hot"]["n_channels"], got["hot"]["n_unsearched"], got["hot"]["object_p"], got["hot"]["status"]) == (2, 1, 0.02, "detected")
    assert (got["short"]["n_channels"], got["short"]["object_p"], got["short"]["stable_z"], got["short"]["status"]) == (1, None, None, "insufficient_epochs")


def test_blocks_of_epochs_change_nothing():
    rng = np.random.default_rng(4)
    t, e, y = np.sort(rng.uniform(0, 20, 50)), rng.uniform(0.5, 2, 50), rng.normal(size=50)
    for tau in (None, 2.0):
        whole, parts = (search.Bank(t, e, (1.0, 3.0), 5, search.FAMILIES, tau, n) for n in (64, 7))
        assert parts.z(parts.white(y)[None]) == pytest.approx(whole.z(whole.white(y)[None]))
        cov = np.diag(e**2) if tau is None else np.outer(e, e) * (0.8 * np.exp(-np.abs(t[:, None] - t) / tau) + 0.2 * np.eye(50))
        f, c, w = whole.specs[3]
        g, low = search.shape(f, (t - c) / w), []
        for i in range(50):
            keep = np.arange(50) != i
            p = np.linalg.inv(cov[np.ix_(keep, keep)])
            a = np.stack([np.ones(49), g[keep]])
            gram, rhs = a @ p @ a.T, a @ p @ y[keep]
            low.append(max(0.0, (rhs[1] - gram[0, 1] * rhs[0] / gram[0, 0]) / np.sqrt(gram[1, 1] - gram[0, 1] ** 2 / gram[0, 0])))
        assert parts.influence(y, 3) == pytest.approx(low, abs=1e-9)


def test_influence_equals_refitting_without_the_point():
    rng = np.random.default_rng(2)
    t, e = np.sort(rng.uniform(0, 20, 12)), rng.uniform(0.5, 2, 12)
    y = rng.normal(size=12) + 8 * np.exp(-0.5 * ((t - 9) / 3) ** 2)
    bank = search.Bank(t, e, (3.0,), 3, ("gaussian",), None)
    best = int(np.argmax(bank.z(bank.white(y - y[0])[None])[0]))
    f, c, w = bank.specs[best]
    g = search.shape(f, (t - c) / w)
    low = []
    for i in range(12):
        keep = np.arange(12) != i
        a = np.stack([np.ones(11), g[keep]], 1) / e[keep, None]
        q = a[:, 1] - a[:, 0] * (a[:, 0] @ a[:, 1]) / (a[:, 0] @ a[:, 0])
        low.append(max(0.0, q @ (y[keep] / e[keep]) / np.linalg.norm(q)))
    assert bank.influence(y - y[0], best) == pytest.approx(low, rel=1e-6, abs=1e-9)


def _dense(t, e, tau):
    return np.outer(e, e) * (0.8 * np.exp(-np.abs(t[:, None] - t) / tau) + 0.2 * np.eye(len(t)))


@pytest.mark.parametrize("tau", [0.01, 2.0, 1e6])
def test_correlated_noise_equals_the_dense_matrix(tau):
    rng = np.random.default_rng(7)
    t, e = np.sort(rng.uniform(0, 100, 300)), rng.uniform(0.1, 3, 300)
    t[10], t[200:204] = t[9], t[200]  # equal times
    cov, noise, y = _dense(t, e, tau), search.Correlated(t, e, tau), rng.normal(size=(3, 300))
    inverse = np.linalg.inv(cov)
    white = noise.whiten(y, 0, None)[0]
    assert white @ white.T == pytest.approx(y @ inverse @ y.T, rel=1e-8)
    assert white == pytest.approx(np.linalg.solve(np.linalg.cholesky(cov), y.T).T, rel=1e-6, abs=1e-9)
    assert noise.by_covariance(white[0]) == pytest.approx(inverse @ y[0], rel=1e-6, abs=1e-9)
    assert noise.precision == pytest.approx(np.diag(inverse), rel=1e-8)
    first, state = noise.whiten(y[:, :120], 0, None)
    assert np.concatenate([first, noise.whiten(y[:, 120:], 120, state)[0]], 1) == pytest.approx(white)


def test_long_channels_of_correlated_noise(spark):
    """100,000 epochs: the memory of the correlation is short against the pulse, which is found; a block changes nothing."""
    rng, n, tau = np.random.default_rng(9), 100000, 0.5
    t = np.arange(n) / 500
    slow = np.zeros(n)
    keep = np.exp(-np.diff(t, prepend=0) / tau)
    for k in range(1, n):
        slow[k] = keep[k] * slow[k - 1] + np.sqrt(0.8 * (1 - keep[k] ** 2)) * rng.normal()
    y = slow + np.sqrt(0.2) * rng.normal(size=n) + 6 * np.exp(-0.5 * ((t - t[-1] / 2) / 3) ** 2)
    df = spark.createDataFrame([("hot", "s", "g", float(a), float(b), 1.0) for a, b in zip(t, y, strict=True)], "source_id string, survey string, band string, mjd double, flux double, flux_error double")
    hot = search.search(df, families=("gaussian",), correlation_days=tau).first()
    assert hot["n"] == n and hot["p_value"] == 0.01 and (hot["center"], hot["width"]) == (pytest.approx(t[-1] / 2), 3.0)
    assert 4 < hot["max_z"] < 40 and hot["amplitude"] == pytest.approx(6, abs=2)


@pytest.mark.parametrize("kw", [{}, {"correlation_days": 0.7}, {"null": "gaussian"}])
def test_search_against_a_dense_bank(spark, kw):
    """Best template, its statistics and those without each observation, from generalised least squares with a dense matrix."""
    rng = np.random.default_rng(5)
    curves = {str(k): (np.sort(rng.uniform(0, 20, n)), rng.normal(0, 1, n), rng.uniform(0.5, 2, n)) for k, n in enumerate((3, 9, 40))}
    rows = [(s, "s", "g", float(a), float(b), float(c)) for s, (t, y, e) in curves.items() for a, b, c in zip(t, y, e, strict=True)]
    df = spark.createDataFrame(rows, "source_id string, survey string, band string, mjd double, flux double, flux_error double")
    got = {r["source_id"]: r for r in search.search(df, each=True, **kw).collect()}
    for s, (t, y, e) in curves.items():
        inverse = np.linalg.inv(_dense(t, e, kw["correlation_days"]) if "correlation_days" in kw else np.diag(e**2))

        def fit(g, keep, t=t, y=y, inverse=inverse):
            p = inverse if keep.all() else np.linalg.inv(np.linalg.inv(inverse)[np.ix_(keep, keep)])
            a = np.stack([np.ones(keep.sum()), g[keep]])
            gram, rhs = a @ p @ a.T, a @ p @ y[keep]
            left = gram[1, 1] - gram[0, 1] ** 2 / gram[0, 0]
            return (max(0.0, (rhs[1] - gram[0, 1] * rhs[0] / gram[0, 0]) / np.sqrt(left)), left) if left > 1e-10 else (0.0, left)

        every = np.ones(len(t), bool)
        specs = [(f, c, w) for f in search.FAMILIES for c in np.linspace(t.min(), t.max(), 5) for w in (1.0, 3.0)]
        z = [fit(search.shape(f, (t - c) / w), every)[0] for f, c, w in specs]
        r = got[s]
        f, c, w = next(x for x in specs if (x[0], x[2]) == (r["family"], r["width"]) and x[1] == pytest.approx(r["center"]))
        assert r["max_z"] == pytest.approx(max(z), rel=1e-6) and z[specs.index((f, c, w))] == pytest.approx(max(z), rel=1e-6)  # of three points several fit alike
        for i in range(len(t)):
            want, left = fit(search.shape(f, (t - c) / w), np.arange(len(t)) != i)
            if left > 1e-6:
                assert r["z_without"][i] == pytest.approx(want, rel=1e-5, abs=1e-7)
        assert r["least_z"] == min(x for x in r["z_without"] if x is not None) and 0.01 <= r["p_value"] <= 1


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 9), (5, 4), (7, 7), *((100, 101 + i) for i in range(50)), *((200 + i, 201 + i) for i in range(40))]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got[9] == got[1] == 1 and got[5] == got[4] == 4 and got[150] == 100 and got[240] == 200 and 7 not in got
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


def test_reconcile_quarantines_conflicts(spark):
    rows = spark.createDataFrame([(1, 0, 5.0), (1, 1, 5.0), (2, 0, 5.0), (2, 1, 6.0)], "id long, file int, v double")
    got = {r["id"]: (r["state"], r["v"]) for r in tables.reconcile(rows, "id", ["v"]).collect()}
    assert got == {1: ("accepted", 5.0), 2: ("quarantined", None)}


def test_wilson(spark):
    low, high = S.wilson(F.lit(0), F.lit(10))
    assert one(spark, low) == 0 and math.isclose(one(spark, high), 0.2775, abs_tol=1e-3)
