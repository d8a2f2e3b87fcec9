"""Retrieval, bootstrap, injection, forecasts, diffs, queues and spectra against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisift.operators import evaluation, neighbours, retrieval, review, search, tables, temporal

ENTRY = "id string, key array<double>, residual array<double>, source_group long, usable_at double, calibration string, population long"
QUERY = "id string, key array<double>, source_group long, cutoff double, calibration string, population long"


def memory(rng, n):
    centres = [[rng.gauss(0, 5) for _ in range(4)] for _ in range(20)]
    rows = []
    for k in range(n):
        c = rng.choice(centres)
        key = [round(v + rng.gauss(0, 0.5), 3) for v in c] if rng.random() < 0.9 else c  # a tenth are repeated keys, so ties
        rows.append((f"e{k:05d}", key, [rng.random(), rng.random()], rng.randrange(9), rng.uniform(0, 100), rng.choice("ab"), rng.randrange(2)))
    return rows


def brute_recall(entries, queries, k, temperature):
    out = {}
    for q, key, group, cutoff, cal, pop in queries:
        near = sorted((sum((a - b) ** 2 for a, b in zip(key, e[1], strict=True)), e[0], e[2]) for e in entries if e[3] != group and e[4] <= cutoff and (e[5], e[6]) == (cal, pop))[:k]
        if not near:
            out[q] = (0, None, 0.0, None)
            continue
        raw = [math.exp(-(d - near[0][0]) / temperature) for d, _, _ in near]
        w = [x / sum(raw) for x in raw]
        entropy = -sum(x * math.log(x) for x in w if x > 0)
        even = entropy / math.log(len(w)) if len(w) > 1 else 0.0
        out[q] = (len(near), [e for _, e, _ in near], (1 - 0.5 * even) / (1 + math.exp(min(60, near[0][0]))), [sum(x * r[i] for x, (_, _, r) in zip(w, near, strict=True)) for i in range(2)])
    return out


def test_recall_equals_all_pairs(spark):
    rng = random.Random(1)
    entries = memory(rng, 1200)
    queries = [(f"q{k}", rng.choice(entries)[1] if k % 3 else [rng.gauss(0, 6) for _ in range(4)], rng.randrange(9), rng.uniform(-5, 110), rng.choice("abc"), rng.randrange(2)) for k in range(80)]
    got = {r["query"]: r for r in retrieval.recall(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(queries, QUERY), 5, 0.7).collect()}
    for q, (n, names, gate, residual) in brute_recall(entries, queries, 5, 0.7).items():
        r = got[q]
        assert (r["n"], r["neighbours"], r["supported"]) == (n, names, n > 0)
        assert r["gate"] == pytest.approx(gate) and (residual is None and r["residual"] is None or r["residual"] == pytest.approx(residual))
    assert any(n == 0 for n, *_ in brute_recall(entries, queries, 5, 0.7).values())
    assert retrieval.recall(spark.createDataFrame([], ENTRY), spark.createDataFrame(queries, QUERY), 5).where("supported").count() == 0


def test_few_entries_are_read(spark):
    """Near-linear: four times the entries for the same queries read well under all pairs."""
    rng = random.Random(2)
    entries = memory(rng, 4000)
    queries = spark.createDataFrame([(f"q{k}", rng.choice(entries)[1], 0, 90.0, "a", 1) for k in range(50)], QUERY)
    met = [retrieval.pairs(spark.createDataFrame(entries[:n], ENTRY), queries, 5).count() for n in (1000, 4000)]
    eligible = sum(e[3] != 0 and e[4] <= 90 and e[5] == "a" and e[6] == 1 for e in entries)
    assert met[1] < 0.35 * eligible * 50, (met, eligible)


def test_bootstrap_counts_and_recalls(spark):
    rng = random.Random(3)
    rows = [(k, int(rng.random() < 0.3), float(rng.randrange(12)), rng.random(), k // 70) for k in range(210)]
    df = spark.createDataFrame(rows, "entity long, label long, a double, b double, block long").repartition(3)
    got = {r["model"]: r for r in evaluation.bootstrap(df, ["a", "b"], 40, 15, seed=7, incumbent="b", block="block", ranges=8).collect()}
    recalls = {"a": [], "b": []}
    for rep in range(1, 41):
        per = {"a": [], "b": []}
        for block in range(3):
            own = sorted(r for r in rows if r[4] == block)
            drawn = [own[int(hashlib.sha256(f"7|{block}|{rep}|{i}".encode()).hexdigest()[:13], 16) % len(own)] for i in range(1, len(own) + 1)]
            assert len(drawn) == len(own)
            for m, c in (("a", 2), ("b", 3)):
                left, hits = 15, 0.0
                for s in sorted({r[c] for r in drawn}, reverse=True):
                    tie = [r[1] for r in drawn if r[c] == s]
                    hits += sum(tie) * max(0, min(left, len(tie))) / len(tie)
                    left -= len(tie)
                per[m].append(hits / sum(r[1] for r in drawn))
        for m in per:
            recalls[m].append(float(np.mean(per[m])))
    for m in recalls:
        delta = np.array(recalls[m]) - recalls["b"]
        want = [np.mean(recalls[m]), *np.quantile(recalls[m], [0.025, 0.975]), delta.mean(), *np.quantile(delta, [0.025, 0.975])]
        assert [got[m][c] for c in ("mean_recall", "low", "high", "mean_delta", "delta_low", "delta_high")] == pytest.approx(want)
    small = {r["model"]: r["low"] for r in evaluation.bootstrap(df, ["a"], 5, 10**6).collect()}
    assert small["a"] == pytest.approx(1.0)  # a budget beyond the rows takes all


def test_injection(spark):
    rng = np.random.default_rng(4)
    curves = {}
    for c in range(12):
        n = 2 if c == 5 else int(rng.integers(3, 40))
        curves[f"c{c:02d}"] = (np.sort(rng.uniform(0, 30, n)), rng.normal(5, 1, n), rng.uniform(0.5, 2, n))
    rows = [(s, "s", "g", float(a), float(b), float(e)) for s, (t, y, err) in curves.items() for a, b, e in zip(t, y, err, strict=True)] + [("c99", "s", "g", 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, "source_id string, survey string, band string, mjd double, flux double, flux_error double").repartition(3)
    got = {r["amplitude"]: r for r in search.inject_and_recover(df, [2.0, 6.0], 60, 1.5, 5.0, seed=3).collect()}
    names = sorted(s for s, (t, *_) in curves.items() if len(set(t)) >= 3)
    for a, amplitude in enumerate((2.0, 6.0)):
        z = []
        for trial in range(60):
            draw = lambda what, a=a, trial=trial: int(hashlib.sha256(f"3|{what}|{a}|{trial}".encode()).hexdigest()[:13], 16)
            t, y, e = curves[names[draw("curve") % len(names)]]
            s = np.exp(-0.5 * ((t - (t[0] + draw("centre") / 16**13 * (t[-1] - t[0]))) / 1.5) ** 2)
            w = e**-2.0
            left = y - (y * w).sum() / w.sum() + amplitude * np.median(e) * s
            z.append((s * left * w).sum() / np.sqrt((s * s * w).sum()))
        assert (got[amplitude]["n"], got[amplitude]["recovered"]) == (60, int((np.array(z) >= 5).sum())) and got[amplitude]["median_z"] == pytest.approx(np.median(z))
        assert got[amplitude]["low"] <= got[amplitude]["fraction"] <= got[amplitude]["high"]


def test_forecasts(spark):
    rng = np.random.default_rng(5)
    series = {f"s{k}": (np.sort(rng.uniform(60000, 60030, n)), rng.normal(0, 1, n)) for k, n in enumerate((1, 2, 3, 5, 12, 30))}
    series["same"] = (np.array([60001.0, 60001.0]), np.array([1.0, 3.0]))
    known = [(s, 1.0, float(t), f"o{i:03d}", float(v)) for s, (ts, vs) in series.items() for i, (t, v) in enumerate(zip(ts, vs, strict=True))] + [("s5", 1.0, 60031.0, "o999", None)]
    later = [(s, 1.0, float(ts[-1] + d), 7.0, float(d)) for s, (ts, _) in series.items() for d in (0.5, 3.0)]
    got = temporal.forecast_error(
        spark.createDataFrame(known, "entity_id string, cutoff double, observed_at_mjd double, observation_id string, value double"), spark.createDataFrame(later, "entity_id string, cutoff double, observed_at_mjd double, horizon double, value double")
    ).first()
    off = {0: [], 1: [], 2: []}
    for ts, vs in series.values():
        for d in (0.5, 3.0):
            for degree in off:
                n = min(degree, len(set(ts)) - 1)
                y = vs[-1] if n == 0 else np.polyval(np.polyfit(ts - ts[-1], vs, n), d)
                off[degree].append(abs(d - y))
    assert (got["mae_last"], got["mae_line"], got["mae_parabola"]) == pytest.approx([np.mean(v) for v in off.values()], rel=1e-6)


def test_changed_rows(spark):
    old = [(1, "a", 1), (1, "a", 1), (1, "b", 2), (2, "x", 9), (3, None, 5), (4, "same", 0)]
    new = [(1, "a", 1), (1, "c", 2), (1, "d", 7), (2, "x", 8), (2, "y", 1), (3, "now", 5), (4, "same", 0)]
    got = tables.changed_rows(spark.createDataFrame(old, "k long, s string, n long"), spark.createDataFrame(new, "k long, s string, n long"), ["k"], ["s", "n"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "changed", "s,n"), (1, "changed", "s,n"), (2, "added", ""), (2, "changed", "n"), (3, "changed", "s")]


@pytest.mark.parametrize(("budget", "slots", "audits"), [(5, 2, 2), (8, 3, 1), (3, 0, 0), (2, 5, 9), (20, 4, 3)])
def test_queue(spark, budget, slots, audits):
    rng = random.Random(6)
    rows = [(f"c{k}", round(rng.random(), 1), round(rng.random(), 1), rng.random() < 0.8) for k in range(12)]
    got = review.review_queue(spark.createDataFrame(rows, "candidate_id string, priority double, anomaly double, eligible boolean").repartition(3), budget, slots, 0.6, audits, "seed").orderBy("rank").collect()
    eligible = [r for r in rows if r[3]]
    key = lambda r: hashlib.sha256(f"seed\0{r[0]}".encode()).hexdigest()
    audit = sorted(eligible, key=key)[: min(audits, budget)]
    rest = sorted((r for r in eligible if r not in audit), key=lambda r: (-r[1], -r[2], r[0].lower(), r[0]))
    reserve = min(slots, budget - len(audit))
    first = rest[: budget - len(audit) - reserve]
    odd = sorted((r for r in rest if r not in first and r[2] >= 0.6), key=lambda r: (-r[2], -r[1], r[0].lower(), r[0]))[:reserve]
    fill = [r for r in rest if r not in first and r not in odd][: budget - len(audit) - len(first) - len(odd)]
    want = [*((r[0], "priority") for r in first), *((r[0], "anomaly_reserve") for r in odd), *((r[0], "priority_fill") for r in fill), *((r[0], "random_audit") for r in audit)]
    assert [(r["candidate_id"], r["route"]) for r in got] == want and [r["rank"] for r in got] == list(range(1, len(want) + 1))
    assert all(r["propensity"] == (pytest.approx(len(audit) / len(eligible)) if r["route"] == "random_audit" else None) for r in got)


def test_effective_rank(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 3)) @ rng.normal(size=(3, 8)) + 0.01 * rng.normal(size=(500, 8))
    x[:, 5] = 2.0
    got = neighbours.representation_health(spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "v array<double>").repartition(4), "v").first()
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))
    p = values[values > 1e-12] / values.sum()
    assert got["n"] == 500 and got["rank_limit"] == 8 and got["collapsed"] == pytest.approx(1 / 8) and got["mean_std"] == pytest.approx(x.std(0).mean())
    assert got["effective_rank"] == pytest.approx(np.exp(-(p * np.log(p)).sum()), rel=1e-6) and got["rms"] == pytest.approx(np.sqrt((x**2).mean()))
    assert neighbours.representation_health(spark.createDataFrame([], "v array<double>"), "v").first()["n"] == 0


def test_baseline_scores(spark):
    """Separable rows with missing values: held-out order is right, a missing value is scored, labels of the scored rows are not used."""
    from lumisift.operators import legacy

    rng = random.Random(8)
    rows = [(k, int(rng.random() < 0.25), 0.0, None) for k in range(600)]
    rows = [(k, y, rng.gauss(3 * y, 1), None if rng.random() < 0.2 else rng.gauss(0, 1)) for k, y, *_ in rows]
    df = spark.createDataFrame(rows, "entity long, label long, a double, b double")
    train, later = df.where("entity < 400"), df.where("entity >= 400")
    got = {r["entity"]: r["score"] for r in legacy.baseline_scores(train, later, ["a", "b"], "label").collect()}
    flipped = {r["entity"]: r["score"] for r in legacy.baseline_scores(train, later.withColumn("label", 1 - F.col("label")), ["a", "b"], "label").collect()}
    assert got == flipped and len(got) == 200 and all(0 <= s <= 1 for s in got.values())
    positive, negative = ([got[k] for k, y, *_ in rows if k >= 400 and y == c] for c in (1, 0))
    assert np.mean([p > n for p in positive for n in negative]) > 0.95


def test_campaign_correction(spark):
    rows = [("a", "s", "g", 0.01, 9.0, 8.0), ("a", "s", "r", 0.5, 2.0, 1.0), ("b", "s", "g", 0.2, 3.0, None), ("c", "s", "g", None, None, None), ("d", "s", "g", 0.0001, 30.0, 4.0), ("d", "s", "r", None, None, None)]
    channels = spark.createDataFrame(rows, "source_id string, survey string, band string, p_value double, max_z double, least_z double")
    got = {r["source_id"]: r for r in search.correct(channels, None, 2, 0.05, 99).collect()}
    for s in "abcd":
        own = [r for r in rows if r[0] == s]
        ps = [r[3] for r in own if r[3] is not None]
        own_p = min(1.0, min(ps) * len(own)) if ps else None
        assert (got[s]["n_channels"], got[s]["n_unsearched"]) == (len(own), len(own) - len(ps)) and got[s]["object_p"] == (pytest.approx(own_p) if ps else None)
        assert got[s]["campaign_p"] == (pytest.approx(min(1.0, own_p * 4 * 2)) if ps else None)
        stable = [min(r[4], r[5] or 0.0) for r in own if r[3] is not None]
        assert got[s]["stable_z"] == (max(stable) if stable else None)
    assert got["c"]["status"] == "insufficient_epochs" and got["a"]["status"] == "unresolvable"  # 4 sources, 2 looks, 99 trials


def test_evidence_gate(spark):
    checks = spark.createDataFrame(
        [("a", "x", 0, "clear", 5, 40), ("a", "y", 0, "clear", 5, 40), ("b", "x", 0, "match", 1, 40), ("b", "x", 1, "clear", 5, 40), ("b", "y", 0, "clear", 5, 40), ("c", "x", 0, "clear", 5, 40), ("d", "x", 0, "clear", 5, 20), ("d", "y", 0, "clear", 5, 40)]
        + [(s, v, 0, "clear", 5, 40) for s in "ef" for v in "xy"], "source_id string, service string, attempt int, status string, checked_hour int, expires_hour int",
    )
    own = spark.createDataFrame([("a", True, False), ("b", True, False), ("c", True, False), ("d", True, False), ("e", False, True), ("f", True, True), ("g", None, None)], "source_id string, quality_passed boolean, manual_required boolean")
    got = {r["source_id"]: (r["decision"], r["reasons"]) for r in review.evidence_gate(own, checks, ["x", "y"], 30).collect()}
    assert got == {"a": ("reportable", ""), "b": ("match", "x:match"), "c": ("incomplete", "y:missing"), "d": ("incomplete", "x:expired"), "e": ("quality", ""), "f": ("manual", ""), "g": ("incomplete", "x:missing,y:missing")}
