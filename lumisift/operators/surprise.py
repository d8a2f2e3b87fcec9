"""Components of surprise for vectors, an isolation forest, and the frozen population that such models are fitted on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.functions.scalars import digest
from lumisift.operators.decisions import robust_fit, robust_scores

#: Standardised features of the forest are cut here.
ABS_CLIP = 1e6


def second_moments(rows: DataFrame, column: str, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sums and sums of products of a vector column: partial sums in tasks, at most ``size * (size + 1) + 1`` totals here."""

    def partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + size + size * size)
        for part in parts:
            x = _matrix(part.column(0).drop_null(), size)
            total += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["pos", "v"])

    sums = rows.select(F.col(column).cast("array<double>")).mapInArrow(partial, "pos long, v double").groupBy("pos").agg(F.sum("v").alias("v"))
    got = np.zeros(1 + size + size * size)
    for r in sums.collect():
        got[r["pos"]] = r["v"]
    return int(got[0]), got[1 : 1 + size], got[1 + size :].reshape(size, size)


def residual_covariance(rows: DataFrame, column: str, size: int, ridge: float = 1e-6) -> np.ndarray:
    """Sample covariance of a vector column, with a ridge; needs two rows."""
    n, s, p = second_moments(rows, column, size)
    if n < 2:
        raise ValueError("a covariance needs two rows")
    return (p - np.outer(s, s) / n) / (n - 1) + ridge * np.eye(size)


def surprise_components(rows: DataFrame, target: str, base: str, corrected: str, covariance: np.ndarray) -> DataFrame:
    """``rows`` with predictive and corrected surprise (squared Mahalanobis length of the residual), angular disagreement
    and spectral wedge of the vectors read as quaternion channels, and the length of the route between both predictions.

    Vectors have as many numbers as the covariance, a multiple of four; a null vector gives null components.
    """
    size = len(covariance)
    if covariance.shape != (size, size) or size % 4 or not np.isfinite(covariance).all():
        raise ValueError("the covariance must be finite and square, with a multiple of four rows")
    whiten = np.linalg.inv(np.linalg.cholesky(covariance))
    names = ["predictive_surprise", "corrected_surprise", "angular_disagreement", "spectral_wedge", "route_disagreement"]

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            vectors = part.column(part.num_columns - 1)
            known = np.ones(len(part), bool)
            for f in range(3):
                known &= ~np.asarray(vectors.field(f).is_null())
            t, b, c = (_matrix(vectors.field(f).filter(pa.array(known)), size) for f in range(3))
            channels = (-1, size // 4, 4)
            tc, bc = t.reshape(channels), b.reshape(channels)
            length = np.maximum(np.linalg.norm(t, axis=1) * np.linalg.norm(b, axis=1), np.finfo(float).eps)
            got = np.stack([
                (((t - b) @ whiten.T) ** 2).sum(1), (((t - c) @ whiten.T) ** 2).sum(1), 1 - (t * b).sum(1) / length,
                np.linalg.norm(np.cross(tc[..., 1:], bc[..., 1:]).sum(1), axis=1), np.linalg.norm(c - b, axis=1),
            ])
            out = np.full((len(names), len(part)), np.nan)
            out[:, known] = got
            columns = [pa.array(x, mask=~known) for x in out]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [*part.schema.names[:-1], *names])

    vectors = F.struct(*(F.col(c).cast("array<double>").alias(n) for c, n in ((target, "t"), (base, "b"), (corrected, "c")))).alias("_vectors")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"{n} double" for n in names])
    return rows.select("*", vectors).mapInArrow(score, schema)


def _matrix(lists: pa.Array, size: int) -> np.ndarray:
    """Arrow lists of ``size`` numbers as rows of a matrix."""
    flat = np.asarray(lists.flatten(), float)
    if len(flat) != len(lists) * size:
        raise ValueError(f"vectors must have {size} numbers")
    return flat.reshape(-1, size)


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random binary tree of ``n`` rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator, deepest: int) -> dict[str, list]:
    """One isolation tree: random cuts of random features that still vary; ``feature`` is -1 in a leaf."""
    tree = {"feature": [], "cut": [], "left": [], "right": [], "leaf": []}
    todo = [(np.arange(len(x)), 0, -1, "")]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(tree["feature"])
        if side:
            tree[side][parent] = me
        low, high = x[rows].min(0), x[rows].max(0)
        varies = np.flatnonzero(high > low)
        leaf = depth >= deepest or len(rows) < 2 or not len(varies)
        f = -1 if leaf else int(rng.choice(varies))
        cut = 0.0 if leaf else float(rng.uniform(low[f], high[f]))
        for name, v in zip(tree, (f, cut, me, me, float(depth + mean_path(len(rows))) if leaf else 0.0), strict=True):
            tree[name].append(v)
        if not leaf:
            below = x[rows, f] <= cut
            todo += [(rows[below], depth + 1, me, "left"), (rows[~below], depth + 1, me, "right")]
    return tree


def isolation_scores(rows: DataFrame, key: str, features: list[str], trees: int = 200, sample: int = 256, seed: int = 1) -> DataFrame:
    """(key, robust, isolation, valid, score): 0.55 of the robust score and 0.45 of the forest's, 0 where invalid.

    A tree is grown in a task of its own on at most ``sample`` rows that a hash of seed, tree and key draws for it, from a
    pool of about ``trees * sample`` rows drawn by a hash of seed and key, independently of how the rows are stored; the
    parameters bound the pool and the model. The forest's score is cut to the range between its 5 % and 95 % quantiles over all rows, taken from a
    mergeable sketch. Missing features are at the median, rows without any are not fitted on; fewer than two rows to fit on
    leave the robust score alone.
    """
    robust = robust_scores(rows, key, features)
    fit = {r["feature"]: r for r in robust_fit(rows, features).collect()}  # a row for each named feature
    used = [f for f in features if f in fit]
    seen = rows.where(F.coalesce(*features).isNotNull())
    n = seen.count()
    robust = robust.select(key, F.col("score").alias("robust"), "valid")
    if n < 2 or not used:
        return robust.select(key, "robust", F.lit(None).cast("double").alias("isolation"), "valid", F.col("robust").alias("score"))
    z = lambda f: (F.col(f).cast("double") - fit[f]["centre"]) / fit[f]["scale"]
    x = F.array(*(F.greatest(F.lit(-ABS_CLIP), F.least(F.lit(ABS_CLIP), F.coalesce(z(f), F.lit(0.0)))) for f in used)).alias("x")
    chance = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 53)) / float(1 << 53)
    share = min(1.0, trees * sample / n)
    pool = seen.where(chance(key) < share).select(key, x)
    drawn = pool.select(key, "x", F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree")).withColumn("u", chance("tree", key))
    drawn = drawn.where(F.col("u") < 1.5 * sample / (n * share))

    def plant(name: tuple, group: pa.Table) -> pa.Table:
        at = np.argsort(np.asarray(group["u"]), kind="stable")[:sample]
        tree = grow(_matrix(group["x"].combine_chunks(), len(used))[at], np.random.default_rng([seed, name[0].as_py()]), int(np.ceil(np.log2(max(min(sample, n), 2)))))
        return pa.table({"tree": [name[0].as_py()], "n": [len(at)], **{k: [v] for k, v in tree.items()}})

    grown = drawn.select("tree", "x", "u").groupBy("tree").applyInArrow(plant, "tree long, n long, feature array<long>, cut array<double>, left array<long>, right array<long>, leaf array<double>")
    forest = [{k: np.array(r[k]) for k in ("feature", "cut", "left", "right", "leaf")} | {"n": r["n"]} for r in grown.orderBy("tree").collect()]
    usual = float(mean_path(np.mean([t["n"] for t in forest]))) if forest else 0.0

    def depth(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            v, total = _matrix(part.column(1), len(used)), np.zeros(len(part))
            for t in forest:
                total += path_lengths(t, v)
            raw = 2.0 ** (-total / len(forest) / max(usual, 1e-12))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw)], [key, "raw"])

    if not forest:
        return robust.select(key, "robust", F.lit(None).cast("double").alias("isolation"), "valid", F.col("robust").alias("score"))
    kind = rows.schema[key].dataType.simpleString()
    raw = rows.select(key, x).mapInArrow(depth, f"`{key}` {kind}, raw double")
    fitted = raw.join(seen.select(key), key, "left_semi").agg(F.percentile_approx("raw", [0.05, 0.95], 10000), F.min("raw"), F.max("raw")).first()
    low, high = fitted[0] if fitted[0][1] > fitted[0][0] else fitted[1:]
    high = high if high > low else low + 1.0
    unit = F.when(F.col("valid"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("raw") - low) / (high - low)))).otherwise(0.0)
    both = robust.join(raw, key).withColumn("isolation", unit)
    return both.select(key, "robust", "isolation", "valid", F.when(F.col("valid"), 0.55 * F.col("robust") + 0.45 * F.col("isolation")).otherwise(0.0).alias("score"))


def path_lengths(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Depth at which a tree isolates each row, leaves of several rows counted by their mean path."""
    at = np.zeros(len(x), np.int64)
    while (inside := np.flatnonzero(tree["feature"][at] >= 0)).size:
        node = at[inside]
        at[inside] = np.where(x[inside, tree["feature"][node]] <= tree["cut"][node], tree["left"][node], tree["right"][node])
    return tree["leaf"][at]


def _population(rows: DataFrame, entity: str):
    """Count and order-free digest of the entities."""
    part = F.conv(F.substring(digest("entity"), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.select(F.col(entity).cast("string").alias("entity")).agg(F.count("*").alias("n_entities"), F.sum(part).cast("string").alias("population"))


def freeze_cohort(rows: DataFrame, entity: str, first: str, last: str, cutoff: str) -> DataFrame:
    """One row: the population that a model may be fitted on, its cutoffs, and how many rows break the contract.

    An entity must be named, come once and have finite times up to its cutoff; a cohort has two entities or more.
    """
    late = F.coalesce(F.col(last) > F.col(cutoff), F.lit(True)) | F.coalesce(F.isnan(F.col(cutoff).cast("double")), F.lit(True)) | F.col(first).isNull()
    named = F.coalesce(F.trim(F.col(entity).cast("string")) != "", F.lit(False))
    repeated = rows.where(named).groupBy(entity).agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("n_repeated"))
    facts = rows.agg(F.min(cutoff).alias("first_cutoff"), F.max(cutoff).alias("last_cutoff"), F.count_if(~named).alias("n_unnamed"), F.count_if(late).alias("n_late"))
    one = _population(rows, entity).crossJoin(facts).crossJoin(repeated)  # single rows
    return one.withColumn("frozen", (F.col("n_entities") >= 2) & (F.col("n_repeated") + F.col("n_unnamed") + F.col("n_late") == 0))


def same_population(cohort: DataFrame, rows: DataFrame, entity: str) -> DataFrame:
    """One row: whether the entities of ``rows`` are exactly those of a frozen cohort."""
    now = _population(rows, entity).select(F.col("n_entities").alias("n_found"), F.col("population").alias("_now"))
    exact = F.col("frozen") & (F.col("n_entities") == F.col("n_found")) & F.coalesce(F.col("population") == F.col("_now"), F.lit(False))
    return cohort.crossJoin(now).select("*", exact.alias("exact")).drop("_now")
