"""Template search over light curves: a bank of shapes, resampled nulls, and corrections for many looks.

A channel (source, survey, band) is the unit of work: Spark groups by it and every group is one small curve, so
a thousand times more sources are a thousand times more groups. The numbers inside a group are plain array math.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.plans.places import placed
from lumisift.plans.scratch import Scratch

EPOCHS = 2048  # of a block of templates and resampled curves

#: Correlated noise: the share that decays with the time between epochs, and the share of each epoch alone (fixed values).
SHARED, ALONE = 0.8, 0.2

#: Logarithms of each family's law over phase = (time - centre) / width, before and after the centre (fixed values: a
#: rise of a third of the width, and the -5/3 decline of fallback).
_RISE = 3.0
LAWS = {
    "gaussian": (lambda q: -q * q / 2, lambda q: -q * q / 2),
    "exponential": (lambda q: _RISE * q, lambda q: -q),
    "fallback": (lambda q: -q * q / 2, lambda q: -5 / 3 * np.log1p(q)),
}


def _two_sided(phase: np.ndarray, decline: float, rise: float) -> np.ndarray:
    """Logarithm of exp(-decline t) / (1 + exp(-rise t)), moved and scaled so that its greatest value is 0 at phase 0."""
    top = np.log(rise / decline - 1) / rise
    law = lambda t: -decline * t - np.logaddexp(0, -rise * t)
    return law(phase + top) - law(top)


def shape(family: str, phase: np.ndarray) -> np.ndarray:
    """Unit-peak shape over phase."""
    if family == "bazin":
        return np.exp(_two_sided(phase, 1.0, _RISE))
    if family not in LAWS:
        raise ValueError(f"unknown family {family}")
    before, after = LAWS[family]
    return np.exp(np.where(phase < 0, before(np.minimum(phase, 0)), after(np.maximum(phase, 0))))


FAMILIES = ("gaussian", "exponential", "bazin", "fallback")


class Independent:
    """Whitening by the errors alone."""

    def __init__(self, t: np.ndarray, e: np.ndarray):
        self.e = e

    def whiten(self, rows: np.ndarray, a: int, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Whitened values of some curves from epoch a on, given what the epochs before left; and what these leave."""
        return rows / self.e[a : a + rows.shape[-1]], None

    def without_each(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Products of two whitened curves without each observation: sums over the others, from both ends."""
        x = p * q
        return np.concatenate([[0.0], np.cumsum(x[:-1])]) + np.concatenate([np.cumsum(x[:0:-1])[::-1], [0.0]])


class Correlated:
    """Whitening of noise that is correlated as SHARED exp(-dt / tau), plus ALONE at dt = 0, in time linear in the epochs.

    The correlation of two epochs is a product over the epochs between them, so what all earlier epochs say of one is
    a single number, carried along: the matrix factors as L D L', where L takes its rows from that recursion, and solving
    with L is one pass over the epochs. No matrix of the epochs is made. ``t`` ascends.
    """

    def __init__(self, t: np.ndarray, e: np.ndarray, tau: float):
        self.e, self.keep = e, np.exp(-np.diff(t, prepend=t[0]) / tau)  # the share of the state that reaches each epoch
        self.d, self.w = np.empty(len(t)), np.empty(len(t))
        known = 0.0
        for n in range(len(t)):
            known = 0.0 if n == 0 else self.keep[n] ** 2 * (known + self.d[n - 1] * self.w[n - 1] ** 2)
            self.d[n] = SHARED + ALONE - SHARED**2 * known
            self.w[n] = (1 - SHARED * known) / self.d[n]
        self.root = np.sqrt(self.d)

    def whiten(self, rows: np.ndarray, a: int, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        out = np.moveaxis(rows / self.e[a : a + rows.shape[-1]], -1, 0).copy()
        state = np.zeros(out.shape[1:]) if state is None else state
        for k in range(len(out)):
            state = self.keep[a + k] * state
            out[k] -= SHARED * state
            state = state + self.w[a + k] * out[k]
        return np.moveaxis(out, 0, -1) / self.root[a : a + len(out)], state

    def without_each(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Products of two whitened curves without each observation: a rank-one part, of its column, leaves the inverse covariance."""
        return p @ q - self.by_covariance(p) * self.by_covariance(q) / self.precision

    def by_covariance(self, white: np.ndarray) -> np.ndarray:
        """The inverse covariance times a curve, from the whitened curve."""
        out, later = white / self.root, 0.0
        for n in range(len(out) - 1, -1, -1):
            out[n] -= self.w[n] * later
            later = self.keep[n] * (later + SHARED * out[n])
        return out / self.e

    @functools.cached_property
    def precision(self) -> np.ndarray:
        """The diagonal of the inverse covariance."""
        out, later = np.empty(len(self.d)), 0.0
        for n in range(len(out) - 1, -1, -1):
            out[n] = 1 / self.d[n] + self.w[n] ** 2 * later
            later = self.keep[n] ** 2 * (SHARED**2 / self.d[n] + (1 - SHARED * self.w[n]) ** 2 * later)
        return out / self.e**2


class Bank:
    """All templates of one curve, with a constant background profiled out.

    Noise is independent, or correlated over ``correlation_days``; either way templates are made for ``step`` epochs at a
    time, and time and memory are linear in the epochs, so any length fits.
    """

    def __init__(self, t: np.ndarray, e: np.ndarray, widths: tuple[float, ...], n_centers: int, families: tuple[str, ...], correlation_days: float | None, step: int = 1 << 14):
        self.t, self.step, self.full, self.whole = t, step, None, None
        self.noise = Correlated(t, e, correlation_days) if correlation_days else Independent(t, e)
        centers = np.linspace(t.min(), t.max(), n_centers)
        self.specs = [(f, c, w) for f in families for c in centers for w in widths]
        self.states: dict[int, np.ndarray | None] = {}  # of the whitening of templates, at the start of each block
        state = None
        for a, b in self.blocks():
            self.states[a] = state
            if correlation_days or len(t) <= step:
                white, state = self.noise.whiten(self.shapes(a, b), a, state)
                self.full = white if len(t) <= step else None
        self.flat = self.white(np.ones(len(t)))
        self.one = self.flat / np.linalg.norm(self.flat)
        self.shared = sum(self.raw(a, b) @ self.one[a:b] for a, b in self.blocks())
        self.norm = np.sqrt(sum(((self.raw(a, b) - np.outer(self.shared, self.one[a:b])) ** 2).sum(1) for a, b in self.blocks()))
        good = self.norm > 1e-10
        self.specs = [s for s, g in zip(self.specs, good, strict=True) if g]
        self.norm, self.shared = self.norm[good], self.shared[good]
        self.states = {a: x if x is None else x[good] for a, x in self.states.items()}
        if self.full is not None:
            self.full = self.full[good]
            self.whole = (self.full - np.outer(self.shared, self.one)) / self.norm[:, None]

    def white(self, y: np.ndarray) -> np.ndarray:
        """A whole curve, whitened."""
        return self.noise.whiten(y, 0, None)[0]

    def shapes(self, a: int, b: int) -> np.ndarray:
        """All templates at the epochs from a to b, a family at a time."""
        out = np.empty((len(self.specs), b - a))
        for family in dict.fromkeys(f for f, _, _ in self.specs):
            at = [i for i, (f, _, _) in enumerate(self.specs) if f == family]
            centre, width = (np.array([self.specs[i][k] for i in at])[:, None] for k in (1, 2))
            out[at] = shape(family, (self.t[a:b] - centre) / width)
        return out

    def blocks(self) -> list[tuple[int, int]]:
        return [(a, min(a + self.step, len(self.t))) for a in range(0, len(self.t), self.step)]

    def raw(self, a: int, b: int) -> np.ndarray:
        """Whitened templates at the epochs from a to b."""
        if self.full is not None:
            return self.full[:, a:b]
        return self.noise.whiten(self.shapes(a, b), a, self.states[a])[0]

    def design(self, a: int, b: int) -> np.ndarray:
        """Whitened templates without background, of unit length over all epochs, at the epochs from a to b."""
        if self.whole is not None:
            return self.whole[:, a:b]
        return (self.raw(a, b) - np.outer(self.shared, self.one[a:b])) / self.norm[:, None]

    def z(self, white_curves: np.ndarray) -> np.ndarray:
        return self.z_of_parts(lambda a, b: white_curves[:, a:b])

    def z_of_parts(self, curves: Callable[[int, int], np.ndarray]) -> np.ndarray:
        """z of curves that are made for one block of epochs after the other."""
        return np.maximum(0.0, sum(curves(a, b) @ self.design(a, b).T for a, b in self.blocks()))

    def influence(self, y: np.ndarray, best: int) -> np.ndarray:
        """z of the chosen template when each observation is deleted and the background fitted again; NaN where it can't be."""
        f, c, w = self.specs[best]
        v = self.white(y)
        g = (self.white(shape(f, (self.t - c) / w)) - self.shared[best] * self.one) / self.norm[best]
        less = self.noise.without_each
        gram = less(self.flat, self.flat), less(self.flat, g), less(g, g)
        some = gram[0] > 0
        base = np.where(some, gram[0], 1.0)
        norm = gram[2] - gram[1] ** 2 / base
        ok = some & (norm > 1e-12 * np.maximum(1.0, gram[2]))
        z = (less(g, v) - gram[1] * less(self.flat, v) / base) / np.sqrt(np.where(ok, norm, 1.0))
        return np.where(ok, np.maximum(z, 0.0), np.nan)


SCHEMA = "source_id string, survey string, band string, n long, family string, center double, width double, max_z double, amplitude double, delta_chi_square double, p_value double, least_z double"
_WITHOUT = ", z_without array<double>"


def search(
    rows: DataFrame,
    widths: tuple[float, ...] = (1.0, 3.0),
    n_centers: int = 5,
    families: tuple[str, ...] = FAMILIES,
    trials: int = 99,
    block: int = 1,
    null: str = "wild",
    seed: int = 1,
    correlation_days: float | None = None,
    each: bool = False,
) -> DataFrame:
    """Best template of every channel with an empirical p-value; ``null`` is wild (sign flips) or gaussian.

    ``correlation_days`` takes the noise as correlated, ``each`` adds z_without, the statistic without each observation in
    order of time (null where it can't be fitted). Channels with fewer than three points have null results: they are
    reported, not dropped. Templates and resampled curves are made for a block of epochs at a time.
    """
    if trials < 99 or null not in ("wild", "gaussian"):
        raise ValueError("at least 99 trials of a wild or gaussian null")
    schema = SCHEMA + _WITHOUT * each

    def one(key: tuple, group: pa.Table) -> pa.Table:
        g = group.sort_by([("mjd", "ascending"), ("flux", "ascending")])
        t, y, e = (np.asarray(g.column(c), float) for c in ("mjd", "flux", "flux_error"))
        out = dict.fromkeys(("family", "center", "width", "max_z", "amplitude", "delta_chi_square", "p_value", "least_z"))
        bank = None
        if len(t) >= 3 and t[0] < t[-1]:
            # whole sign blocks in each block of epochs
            bank = Bank(t, e, widths, n_centers, families, correlation_days, -(-max(EPOCHS, (1 << 21) // trials) // block) * block)
        if bank and bank.specs:
            white = bank.white(y - y[0])
            z = bank.z(white[None])[0]
            best = int(np.argmax(z))
            rng = np.random.default_rng([seed, *("/".join(k.as_py() or "" for k in key)).encode()])
            rest = white - (white @ bank.one) * bank.one

            def resampled(a: int, b: int) -> np.ndarray:
                if null == "gaussian":
                    return rng.normal(size=(trials, b - a))
                signs = rng.integers(0, 2, (trials, -(-(b - a) // block))) * 2 - 1
                return np.repeat(signs, block, axis=1)[:, : b - a] * rest[a:b]

            worse = (bank.z_of_parts(resampled).max(1) >= z[best]).sum()
            family, center, width = bank.specs[best]
            without = bank.influence(y - y[0], best)
            out = {"family": family, "center": center, "width": width, "max_z": z[best], "amplitude": z[best] / bank.norm[best], "delta_chi_square": z[best] ** 2, "p_value": (1 + worse) / (trials + 1)}
            out["least_z"] = None if np.isnan(without).all() else float(np.nanmin(without))
            out["z_without"] = [None if np.isnan(x) else x for x in without.tolist()]
        names = dict(zip(("source_id", "survey", "band"), (k.as_py() for k in key), strict=True)) | {"n": len(t)} | out
        kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
        return pa.Table.from_pylist([names], pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))]))

    usable = rows.where((F.col("flux_error") > 0) & F.col("flux").isNotNull() & F.col("mjd").isNotNull()).select("source_id", "survey", "band", "mjd", "flux", "flux_error")
    # as many tasks as the session has partitions: small curves are much work for their bytes, so they must not be coalesced
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return usable.repartition(tasks, "source_id", "survey", "band").groupBy("source_id", "survey", "band").applyInArrow(one, schema)


def correct(channels: DataFrame, universe: int | None, looks: int, alpha: float, trials: int) -> DataFrame:
    """Per source: the least p-value corrected for its channels, then for the campaign; and the stable statistic.

    Channels without a result count as looks too, and are told in n_unsearched. A source with only these has no p-value.
    ``universe`` is the number of sources that the campaign tests; None takes those of ``channels``.
    """
    stable = F.least("max_z", F.when(F.col("p_value").isNotNull(), F.coalesce("least_z", F.lit(0.0))))
    g = channels.groupBy("source_id").agg(F.count("*").alias("n_channels"), F.count_if(F.col("p_value").isNull()).alias("n_unsearched"), F.min("p_value").alias("p"), F.max(stable).alias("stable_z"))
    size = g.agg(F.count("*").alias("universe")) if universe is None else channels.sparkSession.createDataFrame([(universe,)], "universe long")
    g = g.crossJoin(F.broadcast(size))  # one row
    searched = F.col("p").isNotNull()
    own = F.when(searched, F.least(F.lit(1.0), F.col("p") * F.col("n_channels")))
    all_ = F.when(searched, F.least(F.lit(1.0), own * F.col("universe") * looks))
    status = F.when(~searched, "insufficient_epochs").when(F.col("universe") * looks / (trials + 1) > alpha, "unresolvable").when(all_ <= alpha, "detected").otherwise("not_significant")
    return g.select("source_id", "n_channels", "n_unsearched", own.alias("object_p"), all_.alias("campaign_p"), "stable_z", status.alias("status"))


def inject_and_recover(rows: DataFrame, amplitudes: list[float], trials: int, width: float, threshold: float, seed: int = 1) -> DataFrame:
    """Gaussian pulses injected into supplied curves and looked for by a matched filter at their place, by amplitude.

    Curves have three epochs or more; their error-weighted mean is taken off. A trial draws a curve by its place in the
    order of all curves, and a centre between its first and last epoch, both by hash, and injects a pulse of ``amplitude`` median
    errors. Trials meet their curve by an equi-join on the place, so there are as many pairs as trials.
    """
    from lumisift.functions.scalars import wilson

    key, spark = ["source_id", "survey", "band"], rows.sparkSession
    good = rows.where("flux_error > 0 and flux is not null and mjd is not null").select(*key, "mjd", "flux", "flux_error")
    w = 1 / F.pow("flux_error", F.lit(2))
    base = F.sum(F.col("flux") * w) / F.sum(w)
    curves = good.groupBy(*key).agg(base.alias("base"), F.min("mjd").alias("first"), F.max("mjd").alias("last"), F.median("flux_error").alias("error"), F.count_distinct("mjd").alias("n")).where("n >= 3")
    curves = placed(Scratch(spark, "injection"), curves, key, "curves")
    n = curves.agg(F.count("*").alias("n"))  # one row
    t = spark.range(len(amplitudes) * trials).select((F.col("id") / trials).cast("int").alias("a"), (F.col("id") % trials).alias("trial"))
    part = lambda what: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(what), F.col("a").cast("string"), F.col("trial").cast("string")), 256), 1, 13), 16, 10).cast("long")
    t = t.crossJoin(F.broadcast(n)).where("n > 0").select("a", "trial", (part("curve") % F.col("n")).alias("place"), (part("centre") / float(16**13)).alias("u"))
    size = F.get(F.array(*(F.lit(float(a)) for a in amplitudes)), F.col("a"))
    pick = t.join(curves.drop("n"), "place").select("a", "trial", *key, "base", (F.col("first") + F.col("u") * (F.col("last") - F.col("first"))).alias("centre"), (size * F.col("error")).alias("height"))
    s = F.exp(-0.5 * F.pow((F.col("mjd") - F.col("centre")) / width, 2))
    j = pick.join(good, key).withColumn("s", s).withColumn("w", w)
    m = j.groupBy("a", "trial").agg(F.sum(F.col("s") * F.col("s") * F.col("w")).alias("ss"), F.sum(F.col("s") * (F.col("flux") - F.col("base") + F.col("height") * F.col("s")) * F.col("w")).alias("sy"))
    z = F.when(F.col("ss") > 0, F.col("sy") / F.sqrt("ss")).otherwise(0.0)
    g = m.withColumn("z", z).groupBy("a").agg(F.count("*").alias("n"), F.count_if(F.col("z") >= threshold).alias("recovered"), F.median("z").alias("median_z"))
    low, high = wilson(F.col("recovered"), F.col("n"))
    amplitude = F.get(F.array(*(F.lit(float(a)) for a in amplitudes)), F.col("a")).alias("amplitude")
    return g.select(amplitude, "n", "recovered", (F.col("recovered") / F.col("n")).alias("fraction"), low.alias("low"), high.alias("high"), "median_z")
