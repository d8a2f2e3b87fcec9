"""Matching positions against catalogue tables: cones, nearest objects and moving objects.

The sky is cut into declination zones and, inside each, right-ascension cells wide enough for the radius at
that zone. The catalogue side keeps its own cell; the source side is copied to the (at most nine) cells that its
cone can touch; an equi-join on the cell and an exact distance do the rest. No pair outside touching cells is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisift.functions.scalars import separation_arcsec


def _zone(dec: Column, height: float) -> Column:
    return F.floor((dec + 90) / height)


def _cells_in(zone: Column, height: float) -> Column:
    """How many right-ascension cells a zone has: each at least ``height`` wide on the sky at the zone's narrow end."""
    edge = F.least(F.lit(90.0), F.greatest(F.abs(zone * height - 90), F.abs((zone + 1) * height - 90)))
    return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(edge)) / height)).cast("long")


def cone_pairs(sources: DataFrame, catalog: DataFrame, radius_arcsec: float, also: tuple[str, ...] = ()) -> DataFrame:
    """All (source columns, catalogue row, separation) within the radius; ``also`` names further columns that must be equal."""
    height = max(radius_arcsec / 3600 * 1.001, 0.05)
    cat = catalog.withColumn("_z", _zone(F.col("dec_deg"), height)).withColumn("_n", _cells_in(F.col("_z"), height))
    cat = cat.withColumn("_c", F.least(F.floor(F.pmod(F.col("ra_deg"), F.lit(360.0)) / 360 * F.col("_n")), F.col("_n") - 1))
    cat = cat.select(F.struct(*catalog.columns).alias("object"), "_z", "_c", *also)
    s = sources.withColumn("_z", F.explode(F.sequence(_zone(F.col("dec_deg"), height) - 1, _zone(F.col("dec_deg"), height) + 1)))
    s = s.withColumn("_n", _cells_in(F.col("_z"), height)).withColumn("_c0", F.floor(F.pmod(F.col("ra_deg"), F.lit(360.0)) / 360 * F.col("_n")))
    s = s.withColumn("_c", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(F.col("_c0") + d, F.col("_n"))))))
    sep = separation_arcsec(F.col("ra_deg"), F.col("dec_deg"), F.col("object.ra_deg"), F.col("object.dec_deg"))
    return s.join(cat, ["_z", "_c", *also]).withColumn("separation", sep).where(F.col("separation") <= radius_arcsec).select(*sources.columns, "object", "separation")


def cone_match(sources: DataFrame, catalog: DataFrame, radius_arcsec: float, names: int = 10) -> DataFrame:
    """Per source: number of objects in the cone and the first names."""
    hits = cone_pairs(sources, catalog, radius_arcsec).groupBy("source_id").agg(F.count("*").alias("n_match"), F.array_join(F.slice(F.sort_array(F.collect_set("object.name")), 1, names), ";").alias("names"))
    return sources.select("source_id").join(hits, "source_id", "left").select("source_id", F.coalesce("n_match", F.lit(0)).alias("n_match"), F.coalesce("names", F.lit("")).alias("names"), F.col("n_match").isNotNull().alias("matched"))


def nearest_match(sources: DataFrame, catalog: DataFrame, radius_arcsec: float) -> DataFrame:
    """Per matched source: the nearest object, ties to the smaller name."""
    near = cone_pairs(sources, catalog, radius_arcsec).groupBy("source_id").agg(F.min(F.struct("separation", "object.name", "object.otype")).alias("m"))
    return near.select("source_id", F.col("m.name").alias("name"), F.col("m.otype").alias("otype"), F.col("m.separation").alias("separation"))


def moving_match(detections: DataFrame, ephemeris: DataFrame, radius_arcsec: float, tolerance_days: float) -> DataFrame:
    """Per source: epochs, epochs with an ephemeris object at that place and time, and whether all are covered."""
    slot = F.floor(F.col("mjd") / tolerance_days)
    det = detections.select("source_id", "ra_deg", "dec_deg", "mjd", F.explode(F.array(*(slot + d for d in (-1, 0, 1)))).alias("_slot"))
    near = cone_pairs(det, ephemeris.withColumn("_slot", slot), radius_arcsec, ("_slot",)).where(F.abs(F.col("mjd") - F.col("object.mjd")) <= tolerance_days)
    covered = near.select("source_id", "mjd").distinct().groupBy("source_id").agg(F.count("*").alias("n_covered"))
    epochs = detections.groupBy("source_id").agg(F.countDistinct("mjd").alias("n_epochs"))
    return epochs.join(covered, "source_id", "left").select("source_id", "n_epochs", F.coalesce("n_covered", F.lit(0)).alias("n_covered"), (F.coalesce("n_covered", F.lit(0)) == F.col("n_epochs")).alias("all_covered"))
