"""Row and table contracts: each gives flags or findings as data, so that a caller can stop, split or report.

All are row expressions or one grouping on the key they are about; counts are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisift.functions.scalars import NULL_WORDS, finite


def missing_identifier(c: Column) -> Column:
    """Null, blank or a word for missing."""
    return F.coalesce(F.lower(F.trim(c)).isin(*NULL_WORDS), F.lit(True))


def bad_position(ra: Column, dec: Column) -> Column:
    return F.coalesce(~((finite(ra) >= 0) & (ra < 360) & finite(dec).between(-90, 90)), F.lit(True))


def presence_warning(detected: Column, magnitude: Column, flux: Column, limit: Column) -> Column:
    """What a measurement lacks: a detection its value, a non-detection its limit or flux."""
    value = F.coalesce(finite(magnitude), finite(flux)).isNull()
    bound = F.coalesce(finite(limit), finite(flux)).isNull()
    return F.when(detected & value, "detection_without_measurement").when(~detected & bound, "nondetection_without_limit_or_flux")


def time_scale(rows: DataFrame, time: str) -> DataFrame:
    """One row: how the times of a table are to be read, from one aggregate over it."""
    t = finite(F.col(time))
    n = F.count(t)
    old, far = F.count_if(t > 2_000_000), F.count_if(t > 3_000_000)
    scale = F.when(n == 0, "empty").when(far > 0, "implausible").when((old > 0) & (old < n), "mixed").when(old == n, "jd").otherwise("mjd")
    return rows.agg(scale.alias("scale"), n.alias("n_times"))


def as_mjd(rows: DataFrame, time: str) -> DataFrame:
    """``rows`` with column mjd: Julian dates are shifted, mixed or implausible scales give nulls."""
    shift = F.when(F.col("scale") == "jd", F.col(time) - 2_400_000.5).when(F.col("scale") == "mjd", F.col(time))
    return rows.crossJoin(F.broadcast(time_scale(rows, time).select("scale"))).withColumn("mjd", shift)


def clean_legacy(rows: DataFrame, value: str, error: str, time: str, flags: str, max_error: float, max_flags: int) -> DataFrame:
    """Finite rows with an error in (0, max] and, if any row has flags at all, none above the maximum."""
    good = finite(F.col(value)).isNotNull() & finite(F.col(time)).isNotNull() & (finite(F.col(error)) > 0) & (F.col(error) <= max_error)
    any_flag = rows.agg(F.coalesce(F.bool_or(F.col(flags).isNotNull()), F.lit(False)).alias("_any"))
    return rows.crossJoin(F.broadcast(any_flag)).where(good & (~F.col("_any") | F.col(flags).isNull() | (F.col(flags) <= max_flags))).drop("_any")


def after_cutoff(rows: DataFrame, entity: str, time: str, cutoff: Column) -> DataFrame:
    """Entities with an observation later than their cut-off, and how many."""
    return rows.groupBy(entity).agg(F.count_if(F.col(time) > cutoff).alias("n_late"), F.max(time).alias("latest")).where("n_late > 0")


def repeated_entities(rows: DataFrame, entity: str) -> DataFrame:
    """Entities that are not unique by their name in lower case, blank ones included."""
    name = F.lower(F.trim(F.col(entity).cast("string")))
    return rows.groupBy(name.alias("entity")).agg(F.count("*").alias("n")).where("n > 1 or entity is null or entity = ''")


def entities_in_several_splits(rows: DataFrame, entity: str, split: str) -> DataFrame:
    return rows.groupBy(entity).agg(F.sort_array(F.collect_set(split)).alias("splits")).where("size(splits) > 1")


def bad_labels_and_scores(rows: DataFrame, label: str, scores: list[str]) -> DataFrame:
    """One row: labels other than 0 and 1, and scores that are no finite numbers."""
    wrong = F.count_if(F.coalesce(~F.col(label).isin(0, 1), F.lit(True)))
    return rows.agg(F.count("*").alias("n_rows"), wrong.alias("n_bad_labels"), *(F.count_if(finite(F.col(s).cast("double")).isNull()).alias(f"n_bad_{s}") for s in scores))


def split_order(rows: DataFrame, split: str, entity: str, time: str, before: str, after: str) -> DataFrame:
    """One row: whether one split ends before another begins, and the entities that both have."""
    per = rows.where(F.col(split).isin(before, after)).groupBy(entity).agg(F.max(F.when(F.col(split) == before, F.col(time))).alias("hi"), F.min(F.when(F.col(split) == after, F.col(time))).alias("lo"))
    return per.agg(F.max("hi").alias("last_before"), F.min("lo").alias("first_after"), F.count_if(F.col("hi").isNotNull() & F.col("lo").isNotNull()).alias("n_shared")).withColumn("ordered", F.col("last_before") < F.col("first_after"))


def first_per_class(rows: DataFrame, cls: str, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each class: a top-k that Spark prunes before the shuffle."""
    from pyspark.sql import Window

    return rows.withColumn("place", F.row_number().over(Window.partitionBy(cls).orderBy(*order))).where(F.col("place") <= limit)


def valid_measurements(rows: DataFrame, max_error: float) -> DataFrame:
    """Masks of usable magnitudes, fluxes and limits; an error counts where it is finite and in (0, max]."""
    ok = lambda e: F.coalesce((finite(F.col(e)) > 0) & (F.col(e) <= max_error), F.lit(False))
    usable = F.coalesce(F.col("quality"), F.lit(False))
    return rows.withColumns({
        "valid_magnitude": usable & F.col("is_detection") & finite(F.col("magnitude")).isNotNull(),
        "valid_flux": usable & finite(F.col("flux")).isNotNull() & ok("flux_error"),
        "valid_limit": usable & ~F.col("is_detection") & finite(F.col("limiting_magnitude")).isNotNull(),
        "valid_error": usable & F.col("is_detection") & ok("magnitude_error"),
    })


def eligibility(quality: Column, gate: Column, excluded: Column, policy: str) -> tuple[Column, Column]:
    """Whether a candidate may be reviewed, and why not: ``triage`` ignores the gate, ``gate-clear`` needs it clear."""
    reasons = [F.when(~quality, "quality gate failed"), F.when(excluded, "explicitly excluded")]
    if policy == "gate-clear":
        reasons.insert(1, F.when(F.coalesce(gate != "clear", F.lit(True)), F.concat(F.lit("gate is "), F.coalesce(gate, F.lit("missing")))))
    elif policy != "triage":
        raise ValueError(f"unknown policy {policy}")
    found = F.array_compact(F.array(*reasons))
    return F.size(found) == 0, F.concat_ws("; ", found)
