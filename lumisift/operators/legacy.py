"""Features of small groups that need array math: clipped baselines and periodicity, one Arrow group for each source."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.operators.running import medians


def clipped(x: np.ndarray, sigma: float = 3.0, rounds: int = 5) -> tuple[float, float]:
    """Median and standard deviation of what stays within ``sigma`` deviations of the median."""
    for _ in range(rounds):
        keep = np.abs(x - np.median(x)) <= sigma * x.std()
        if keep.all():
            break
        x = x[keep]
    return float(np.median(x)), float(x.std())


def best_period(t: np.ndarray, y: np.ndarray, e: np.ndarray, shortest: float, longest: float, per_peak: int = 5, step: int = 4096) -> tuple[float, float] | None:
    """Best period and false-alarm probability of the standard-normalised periodogram with a floating mean.

    The probability is 1 - (1 - (1 - power)^((n - 3) / 2))^(independent frequencies), with (highest - lowest) * span of
    these. Frequencies are taken in blocks, so memory does not grow with their number.
    """
    span = t.max() - t.min()
    if len(t) < 10 or span < 2:
        return None
    w = 1 / e**2
    w = w / w.sum()
    y = y - w @ y
    total = w @ y**2
    if total <= 0:
        return None
    n = max(1, int(np.ceil((1 / shortest - 1 / longest) * span * per_peak)))
    grid, best = 1 / longest + np.arange(n + 1) / (span * per_peak), (-1.0, 0.0)
    for i in range(0, len(grid), step):
        f = grid[i : i + step]
        arg = 2 * np.pi * np.outer(f, t - t.min())
        c, s = np.cos(arg), np.sin(arg)
        c, s = c - (c @ w)[:, None], s - (s @ w)[:, None]
        cc, ss, cs, yc, ys = (c * c) @ w, (s * s) @ w, (c * s) @ w, c @ (w * y), s @ (w * y)
        d = np.maximum(cc * ss - cs**2, 1e-12)
        power = (ss * yc**2 + cc * ys**2 - 2 * cs * yc * ys) / (total * d)
        k = int(np.argmax(power))
        best = max(best, (float(power[k]), float(f[k])))
    power = min(max(best[0], 0.0), 1.0)
    one = (1 - power) ** ((len(t) - 3) / 2)
    return 1 / best[1], float(-np.expm1(max(1.0, (1 / shortest - 1 / longest) * span) * np.log1p(-min(one, 1 - 1e-15))))


SCHEMA = "source_id string, n_points long, baseline double, deviation double, peak double, peak_time double, amplitude double, peak_snr double, n_below long, periodic boolean, period double, fap double, score double, is_candidate boolean, reason string"


def legacy_features(rows: DataFrame, least_points: int = 8, least_amplitude: float = 0.5, least_snr: float = 3.0, least_below: int = 2, sigma: float = 3.0, fap: float = 0.01, shortest: float = 0.1, longest: float = 50.0) -> DataFrame:
    """One row a source: clipped baseline, peak, points below the threshold, periodicity, score and the first reason against it."""

    def one(key: tuple, group: pa.Table) -> pa.Table:
        g = group.sort_by([("mjd", "ascending"), ("magnitude", "ascending")])
        t, m, e = (np.asarray(g.column(c), float) for c in ("mjd", "magnitude", "magnitude_error"))
        out = dict.fromkeys(c.split()[0] for c in SCHEMA.split(", ")) | {"source_id": key[0].as_py(), "n_points": len(t), "is_candidate": False}
        base, dev = clipped(m, sigma) if len(m) else (0.0, 0.0)
        dev = dev if dev > 1e-4 else float(m.std()) if len(m) else 0.0
        if len(t) < least_points or dev <= 1e-6:
            out["reason"] = "too_few_points" if len(t) < least_points else "insufficient_variability"
        else:
            k = int(np.argmin(m))
            amplitude, below = base - m[k], int((m <= base - sigma * dev).sum())
            snr = amplitude / np.hypot(dev, e[k])
            found = best_period(t, m, e, shortest, longest)
            periodic = bool(found and found[1] < fap)
            against = [(periodic, "periodic_variable"), (amplitude < least_amplitude, "low_amplitude"), (snr < least_snr, "low_peak_snr"), (below < least_below, "too_few_significant_points")]
            reason = next((name for bad, name in against if bad), "")
            score = 0.45 * min(1.0, amplitude / least_amplitude) + 0.35 * min(1.0, snr / least_snr) + 0.20 * min(1.0, below / least_below)
            out |= {"baseline": base, "deviation": dev, "peak": m[k], "peak_time": t[k], "amplitude": amplitude, "peak_snr": snr, "n_below": below, "periodic": periodic, "period": found and found[0], "fap": found and found[1]}
            out |= {"score": score, "is_candidate": not reason, "reason": reason}
        kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        return pa.Table.from_pylist([out], pa.schema([(n, kinds[k]) for n, k in (c.split() for c in SCHEMA.split(", "))]))

    good = rows.where("magnitude is not null and magnitude_error > 0 and mjd is not null").select("source_id", "mjd", "magnitude", "magnitude_error")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # much work for few bytes: not coalesced
    return good.repartition(tasks, "source_id").groupBy("source_id").applyInArrow(one, SCHEMA)


def clipped_covariance(rows: DataFrame, features: list[str], clip: float = 5.0, ridge: float = 1e-6) -> DataFrame:
    """(a, b, covariance, n): sample covariances of columns clipped at ``clip`` robust deviations of their medians."""
    stats = None
    for f in features:  # named features, a few; each is one row
        mid = medians(rows, [], f).select(F.col("median").alias(f"m_{f}"))
        stats = mid if stats is None else stats.crossJoin(mid)
    near = rows.crossJoin(F.broadcast(stats))
    spread = None
    for f in features:
        off = medians(near.select(F.abs(F.col(f) - F.col(f"m_{f}")).alias("off")), [], "off").select((1.4826 * F.col("median")).alias(f"s_{f}"))
        spread = off if spread is None else spread.crossJoin(off)
    near = near.crossJoin(F.broadcast(spread))
    bound = {f: F.greatest(F.col(f"m_{f}") - clip * F.col(f"s_{f}"), F.least(F.col(f"m_{f}") + clip * F.col(f"s_{f}"), F.col(f))) for f in features}
    cut = near.select(*(bound[f].alias(f) for f in features))
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    one = cut.agg(*(F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs), F.count("*").alias("n"))
    items = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(f"`{a}|{b}`") + (ridge if a == b else 0.0)).alias("covariance")) for a, b in pairs))
    return one.select(F.explode(items).alias("x"), "n").select("x.*", "n")


def baseline_scores(train: DataFrame, rows: DataFrame, features: list[str], label: str, seed: int = 1) -> DataFrame:
    """``rows`` with a class-balanced logistic score: medians and indicators for missing values, standardised inputs."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    flags = {f"missing_{f}": F.col(f).isNull().cast("double") for f in features}
    full = [f"full_{f}" for f in features]
    share = train.agg(F.avg(F.col(label).cast("double")).alias("share")).first()["share"] or 0.5
    weight = F.when(F.col(label) == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9))
    stages = [
        Imputer(strategy="median", inputCols=features, outputCols=full), VectorAssembler(inputCols=[*full, *flags], outputCol="_raw"), StandardScaler(withMean=True, inputCol="_raw", outputCol="_x"),
        LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", regParam=1e-3, maxIter=50),
    ]
    model = Pipeline(stages=stages).fit(train.withColumns(flags).withColumn("_w", weight))
    return model.transform(rows.withColumns(flags)).withColumn("score", vector_to_array("probability")[1]).select(*rows.columns, "score")
