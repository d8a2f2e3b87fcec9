"""Forecast data on two time axes: what was observed, and what was known at a cut-off."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefixes(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Rows observed and available at each (entity_id, cutoff)."""
    return cutoffs.join(rows, "entity_id").where("observed_at_mjd <= cutoff and available_at_mjd <= cutoff")


def targets(rows: DataFrame, cutoffs: DataFrame, horizons: list[float]) -> DataFrame:
    """Rows after each cut-off, up to each horizon; a horizon without rows gives none."""
    h = cutoffs.withColumn("horizon", F.explode(F.array(*(F.lit(float(x)) for x in horizons))))
    return h.join(rows, "entity_id").where("observed_at_mjd > cutoff and observed_at_mjd <= cutoff + horizon")


def normalisation(prefix: DataFrame, floor: float = 1e-3) -> DataFrame:
    """Centre and scale of the detected prefix of each (entity_id, cutoff)."""
    keys = ["entity_id", "cutoff"]
    v = prefix.where("value is not null").withColumn("m", F.median("value").over(Window.partitionBy(*keys)))
    return v.groupBy(*keys).agg(F.count("*").alias("n"), F.min("m").alias("centre"), F.greatest(1.4826 * F.median(F.abs(F.col("value") - F.col("m"))), F.median("value_error"), F.lit(floor)).alias("scale"))


def forecast_error(prefix: DataFrame, target: DataFrame) -> DataFrame:
    """Mean absolute error, by horizon, of the last known value and of a line and a parabola through the prefix.

    Time counts from the last known epoch in units of the prefix's length, and the fits come from mergeable covariances of it
    and its square, which keeps them well conditioned; a fit that the epochs don't determine falls back to the one before.
    """
    keys = ["entity_id", "cutoff"]
    v = prefix.where("value is not null")
    ends = v.groupBy(*keys).agg(F.max_by("value", F.struct("observed_at_mjd", "observation_id")).alias("last"), F.max("observed_at_mjd").alias("t"), F.greatest(F.max("observed_at_mjd") - F.min("observed_at_mjd"), F.lit(1e-9)).alias("span"))
    x = (F.col("observed_at_mjd") - F.col("t")) / F.col("span")
    v = v.join(ends, keys).withColumn("x", x).withColumn("xx", F.col("x") * F.col("x"))
    c = lambda a, b: F.covar_pop(a, b)
    fit = v.groupBy(*keys, "last", "t", "span").agg(F.avg("value").alias("my"), F.avg("x").alias("mx"), F.avg("xx").alias("mxx"), F.var_pop("x").alias("uu"), F.var_pop("xx").alias("vv"), c("x", "xx").alias("uv"), c("x", "value").alias("uy"), c("xx", "value").alias("vy"))
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    curved = det > 1e-9 * F.col("uu") * F.col("vv")
    fit = fit.withColumn("slope", F.when(F.col("uu") > 1e-12, F.col("uy") / F.col("uu")))
    fit = fit.withColumn("b", F.when(curved, (F.col("uy") * F.col("vv") - F.col("vy") * F.col("uv")) / det)).withColumn("c", F.when(curved, (F.col("vy") * F.col("uu") - F.col("uy") * F.col("uv")) / det))
    t = target.where("value is not null").join(fit, keys).withColumn("x", x)
    line = F.coalesce(F.col("my") + F.col("slope") * (F.col("x") - F.col("mx")), F.col("last"))
    parabola = F.coalesce(F.col("my") + F.col("b") * (F.col("x") - F.col("mx")) + F.col("c") * (F.col("x") * F.col("x") - F.col("mxx")), line)
    off = lambda y: F.avg(F.abs(F.col("value") - y))
    return t.groupBy("horizon").agg(F.count("*").alias("n"), off(F.col("last")).alias("mae_last"), off(line).alias("mae_line"), off(parabola).alias("mae_parabola"))


def complete_horizons(target: DataFrame, horizons: list[float]) -> DataFrame:
    """(entity_id, cutoff) that have a target at every horizon."""
    return target.groupBy("entity_id", "cutoff").agg(F.countDistinct("horizon").alias("n_horizons")).where(F.col("n_horizons") == len(horizons))


def tokens(rows: DataFrame, longest: int, vocabulary: DataFrame) -> DataFrame:
    """The latest ``longest`` rows of each sequence as tokens: (back, step, value, error, band_id, detected, present).

    Rows go by time, band, detection, value and error. Steps are in median cadences, values and errors in robust
    deviations of the detected values (of all values, if none is detected); what is missing is 0, and ``present`` tells. A
    band that ``vocabulary`` (term, id) lacks is 0. ``back`` counts from the last row, 1.
    """
    by = [("observed_at_mjd", False), (F.lower("band"), False), ("band", False), (~F.col("is_detection"), False), ("value", True), ("value_error", True)]
    up = [F.asc_nulls_last(c) if nulls else F.asc(c) for c, nulls in ((F.col(c) if isinstance(c, str) else c, n) for c, n in by)]
    down = [F.desc_nulls_first(c) if nulls else F.desc(c) for c, nulls in ((F.col(c) if isinstance(c, str) else c, n) for c, n in by)]
    one, whole = Window.partitionBy("entity_id"), Window.partitionBy("entity_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = rows.withColumn("back", F.row_number().over(one.orderBy(*down))).where(F.col("back") <= longest)
    v = v.withColumn("dt", F.col("observed_at_mjd") - F.lag("observed_at_mjd").over(one.orderBy(*up)))
    seen = F.when(F.col("is_detection"), F.col("value"))
    v = v.withColumn("basis", F.when(F.count(seen).over(whole) > 0, seen).otherwise(F.col("value"))).withColumn("cadence", F.coalesce(F.median(F.when(F.col("dt") > 0, F.col("dt"))).over(whole), F.lit(1.0)))
    v = v.withColumn("centre", F.coalesce(F.median("basis").over(whole), F.lit(0.0))).withColumn("off", F.col("basis") - F.col("centre"))
    mad, sd = 1.4826 * F.median(F.abs("off")).over(whole), F.sqrt(F.avg(F.col("off") * F.col("off")).over(whole))
    error = F.median(F.when(F.col("is_detection") & (F.col("value_error") > 0), F.col("value_error"))).over(whole)
    v = v.withColumn("scale", F.when(mad > 0, mad).when(sd > 0, sd).otherwise(F.coalesce(error, F.lit(1.0))))
    v = v.join(vocabulary.select(F.col("term").alias("band"), F.col("id").alias("band_id")), "band", "left")
    present = F.col("value").isNotNull()
    return v.select(
        "entity_id", "back", F.coalesce(F.col("dt") / F.col("cadence"), F.lit(0.0)).alias("step"), F.when(present, (F.col("value") - F.col("centre")) / F.col("scale")).otherwise(0.0).alias("value"),
        F.when(present & F.col("value_error").isNotNull(), F.col("value_error") / F.col("scale")).otherwise(0.0).alias("error"), F.coalesce("band_id", F.lit(0)).alias("band_id"), F.col("is_detection").cast("int").alias("detected"), present.cast("int").alias("present"),
    )
