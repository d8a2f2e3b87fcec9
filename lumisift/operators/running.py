"""Running sums, ranks and medians over a whole column or a hot key, without a window that one task would hold.

Rows are cut into ranges of about equal numbers of rows, at quantiles that a mergeable sketch (Spark's percentile_approx)
finds per key in one pass; a range's sums give every range its start, and only rows of one range are ordered together. The
cuts follow the rows, not the values, so outliers, heavy tails, NaN (the greatest) and infinities don't gather rows: a range
holds at most ``rows / ranges`` rows, or ``least`` if that is more, and a quarter of ``rows / ranges`` more for the sketch's
error; rows of one double value aside (1024 long integers beyond 2^53 can share one). Callers group equal values
first, so that ties are one row; rows with a null key are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_STRIDE = 32  # cuts are looked up by strides, then inside one


def in_ranges(levels: DataFrame, keys: list[str], order: str, ranges: int = 1024, least: int = 4096) -> DataFrame:
    """``levels`` with ``_range``, a number that grows with ``order``: ranges of about equal numbers of rows in each key."""
    x = F.col(order).cast("double")
    cuts = F.percentile_approx(x, [i / ranges for i in range(1, ranges)], 8 * ranges)
    sketch = levels.groupBy(*keys).agg(F.count("*").alias("_n"), cuts.alias("_cuts")).where(F.col("_n") > least)
    every = F.greatest(F.lit(1), F.floor(F.lit(float(ranges * least)) / F.col("_n"))).cast("int")  # of a small key not all cuts
    sketch = sketch.withColumn("_every", every).withColumn("_cuts", F.filter("_cuts", lambda c, i: (i + 1) % F.col("_every") == 0))
    sketch = sketch.withColumn("_strides", F.filter("_cuts", lambda c, i: i % _STRIDE == _STRIDE - 1)).select(*keys, "_cuts", "_strides")
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c < x))
    out = levels.join(sketch if keys != ["_all"] else F.broadcast(sketch), keys, "left")  # without keys it is one row
    out = out.withColumn("_stride", F.when(F.col("_cuts").isNotNull(), below("_strides") * _STRIDE))
    place = F.when(F.col("_cuts").isNotNull(), F.col("_stride") + below(F.slice("_cuts", F.col("_stride") + 1, F.lit(_STRIDE)))).otherwise(0)
    return out.withColumn("_range", place).drop("_cuts", "_strides", "_stride")


def running_sums(levels: DataFrame, keys: list[str], order: str, sums: list[str], descending: bool = False, ranges: int = 1024, least: int = 4096) -> DataFrame:
    """``levels`` with cum_<sum>, over the rows of its key up to and including each; ``order`` is unique in a key."""
    keys = keys or ["_all"]
    levels = levels.withColumn("_all", F.lit(0)) if keys == ["_all"] else levels
    cut = in_ranges(levels, keys, order, ranges, least)
    way = (lambda c: F.col(c).desc()) if descending else F.col
    outer = Window.partitionBy(*keys).orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)  # at most ``ranges`` rows
    inner = Window.partitionBy(*keys, "_range").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    starts = cut.groupBy(*keys, "_range").agg(*(F.sum(s).alias(f"_{s}") for s in sums))
    starts = starts.select(*keys, "_range", *(F.coalesce(F.sum(f"_{s}").over(outer), F.lit(0)).alias(f"_before_{s}") for s in sums))
    out = cut.withColumns({f"_own_{s}": F.sum(s).over(inner) for s in sums}).join(starts.hint("merge"), [*keys, "_range"])  # in the windows' order; rows are never broadcast
    return out.select(*levels.columns, *((F.col(f"_before_{s}") + F.col(f"_own_{s}")).alias(f"cum_{s}") for s in sums)).drop("_all")


def numbered(rows: DataFrame, order: str, name: str = "i") -> DataFrame:
    """``rows`` of distinct ``order`` values with their place from 1."""
    return running_sums(rows.withColumn("_one", F.lit(1)), [], order, ["_one"]).withColumnRenamed("cum__one", name).drop("_one")


def medians(rows: DataFrame, keys: list[str], value: str, ranges: int = 1024, least: int = 4096) -> DataFrame:
    """(keys, median, n): exact medians of large groups from running counts of distinct values."""
    if not keys:
        return medians(rows.withColumn("_one", F.lit(0)), ["_one"], value, ranges, least).drop("_one")
    levels = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    total = levels.groupBy(*keys).agg(F.sum("n").alias("n_all"))
    r = running_sums(levels, keys, value, ["n"], ranges=ranges, least=least).join(total, keys)
    at = lambda rank: F.min(F.when(F.col("cum_n") >= rank, F.col(value)))
    low, high = at(F.floor((F.col("n_all") + 1) / 2)), at(F.floor(F.col("n_all") / 2) + 1)
    return r.groupBy(*keys).agg(((low + high) / 2).alias("median"), F.max("n_all").alias("n"))
