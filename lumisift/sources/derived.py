"""Photometry-shaped views over the star-schema tables: the same formulas in Spark and as SQL for the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_MJD = 40587
#: Catalogue object type of a market segment; unknown segments are of unknown type.
OTYPES = {"AUTOMOBILE": "variable", "BUILDING": "star", "FURNITURE": "galaxy", "HOUSEHOLD": "agn", "MACHINERY": "unknown"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def phot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per measurement, in the columns of the canonical table."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    seen = F.col("value") >= 5
    error = F.lit(0.5) + F.col("k") / F.lit(100.0)
    return e.select(
        F.col("user_id").cast("string").alias("source_id"),
        F.concat(F.lit("s"), F.col("user_id") % 2).alias("survey"),
        F.col("event_type").alias("band"),
        (_micros("ts") / F.lit(86400e6) + EPOCH_MJD).alias("mjd"),
        F.col("value").alias("flux"),
        error.alias("flux_error"),
        seen.alias("is_detection"),
        F.when(seen, 25 - 2.5 * F.log10("value")).alias("magnitude"),
        F.when(seen, 1.0857 * error / F.col("value")).alias("magnitude_error"),
        F.when(~seen, 25 - 2.5 * F.log10(5 * error)).alias("limiting_magnitude"),
        F.col("event_id").cast("string").alias("observation_id"),
        (F.col("k") != 13).alias("quality"),
        ((F.col("user_id") * 137.5) % 360).alias("ra_deg"),
        ((F.col("user_id") * 7.3) % 120 - 60).alias("dec_deg"),
        F.col("k"),
        F.col("event_id"),
    )


PHOT = f"""phot AS (
  SELECT CAST(user_id AS VARCHAR) AS source_id, 's' || CAST(user_id % 2 AS VARCHAR) AS survey, event_type AS band, epoch_us(ts) / 86400e6 + {EPOCH_MJD} AS mjd,
         value AS flux, 0.5e0 + k / 100e0 AS flux_error, value >= 5 AS is_detection,
         CASE WHEN value >= 5 THEN 25 - 2.5e0 * log10(value) END AS magnitude, CASE WHEN value >= 5 THEN 1.0857e0 * (0.5e0 + k / 100e0) / value END AS magnitude_error,
         CASE WHEN value < 5 THEN 25 - 2.5e0 * log10(5 * (0.5e0 + k / 100e0)) END AS limiting_magnitude, CAST(event_id AS VARCHAR) AS observation_id,
         k <> 13 AS quality, (user_id * 137.5e0) % 360 AS ra_deg, (user_id * 7.3e0) % 120 - 60 AS dec_deg, k, event_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue of reference objects."""
    otype = F.coalesce(F.create_map(*(F.lit(x) for kv in OTYPES.items() for x in kv))[F.col("c_mktsegment")], F.lit("unknown"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"),
        ((F.col("c_custkey") * 137.5 + 0.0004 * (F.col("c_custkey") % 5)) % 360).alias("ra_deg"),
        ((F.col("c_custkey") * 7.3) % 120 - 60).alias("dec_deg"),
        otype.alias("otype"),
    )


CATALOG = f"""catalog AS (
  SELECT c_name AS name, (c_custkey * 137.5e0 + 0.0004e0 * (c_custkey % 5)) % 360 AS ra_deg, (c_custkey * 7.3e0) % 120 - 60 AS dec_deg,
         CASE c_mktsegment {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in OTYPES.items())} ELSE 'unknown' END AS otype FROM customer)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One position per source."""
    return phot(spark, sf_dir).groupBy("source_id").agg(F.min("ra_deg").alias("ra_deg"), F.min("dec_deg").alias("dec_deg"))


SOURCES = "sources AS (SELECT source_id, min(ra_deg) AS ra_deg, min(dec_deg) AS dec_deg FROM phot GROUP BY source_id)"


def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast rows with two time axes: when observed and when available."""
    p = phot(spark, sf_dir)
    return p.select(
        F.col("source_id").alias("entity_id"), "observation_id", F.col("mjd").alias("observed_at_mjd"), (F.col("mjd") + F.col("k") / 20.0).alias("available_at_mjd"), "band",
        F.when(F.col("is_detection"), F.col("flux")).alias("value"), F.when(F.col("is_detection"), F.col("flux_error")).alias("value_error"), "is_detection",
    )


ASOF = """asof_rows AS (
  SELECT source_id AS entity_id, observation_id, mjd AS observed_at_mjd, mjd + k / 20e0 AS available_at_mjd, band,
         CASE WHEN is_detection THEN flux END AS value, CASE WHEN is_detection THEN flux_error END AS value_error, is_detection FROM phot)"""


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with a binary label, a time and three scores."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return labels.join(docs.select("doc_id", "n_chars").hint("merge"), "doc_id").select(  # small files of many rows: never broadcast
        F.col("doc_id").alias("entity"), F.col("quality").cast("long").alias("label"), F.floor(F.col("doc_id") / 20).alias("time"),
        (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("score_a"), F.floor(F.col("n_chars") / 500).cast("double").alias("score_b"),
        ((F.col("doc_id") * 7919) % 1009 / 1009.0).alias("score_c"),
    )


RANKING = """ranking AS (
  SELECT l.doc_id AS entity, CAST(quality AS BIGINT) AS label, l.doc_id // 20 AS time, n_chars / (n_chars + 1000e0) AS score_a,
         CAST(n_chars // 500 AS DOUBLE) AS score_b, (l.doc_id * 7919) % 1009 / 1009e0 AS score_c FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service checks: two per source and service, statuses from a digest bucket."""
    services = F.explode(F.array(*(F.lit(s) for s in ("catalog", "moving", "registry", "spectra")))).alias("service")
    base = sources(spark, sf_dir).select("source_id", services).select("*", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("attempt"))
    bucket = F.conv(F.substring(F.sha2(F.concat_ws("|", "source_id", "service", F.col("attempt").cast("string")), 256), 1, 2), 16, 10).cast("int")
    status = F.when(F.col("b") < 150, "clear").when(F.col("b") < 185, "match").when(F.col("b") < 210, "error").when(F.col("b") < 235, "pending").otherwise("stale")
    return base.withColumn("b", bucket).select("source_id", "service", "attempt", status.alias("status"), (F.col("b") % 24).alias("checked_hour"), (F.col("b") % 24 + 24).alias("expires_hour"))


CHECKS = """checks AS (
  SELECT source_id, service, attempt, CASE WHEN b < 150 THEN 'clear' WHEN b < 185 THEN 'match' WHEN b < 210 THEN 'error' WHEN b < 235 THEN 'pending' ELSE 'stale' END AS status,
         b % 24 AS checked_hour, b % 24 + 24 AS expires_hour
  FROM (SELECT source_id, service, attempt, CAST('0x' || substr(sha256(source_id || '|' || service || '|' || CAST(attempt AS VARCHAR)), 1, 2) AS INTEGER) AS b
        FROM sources, (SELECT unnest(['catalog', 'moving', 'registry', 'spectra']) AS service), (SELECT unnest([0, 1]) AS attempt)))"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    verdict = F.when(F.col("o_orderstatus") == "F", "approve").when(F.col("o_orderstatus") == "O", "reject").otherwise("defer")
    return o.select(
        F.col("o_orderkey").alias("review_id"), F.col("o_custkey").alias("candidate"), F.col("o_orderpriority").alias("version"), (F.col("o_orderkey") % 7).alias("reviewer"),
        F.when(F.col("o_orderkey") % 2 == 0, "screener").otherwise("reviewer").alias("role"), verdict.alias("verdict"), F.expr("unix_micros(cast(o_orderdate as timestamp)) div 86400000000").alias("day"),
    )


REVIEWS = """reviews AS (
  SELECT o_orderkey AS review_id, o_custkey AS candidate, o_orderpriority AS version, o_orderkey % 7 AS reviewer, CASE WHEN o_orderkey % 2 = 0 THEN 'screener' ELSE 'reviewer' END AS role,
         CASE o_orderstatus WHEN 'F' THEN 'approve' WHEN 'O' THEN 'reject' ELSE 'defer' END AS verdict, epoch_us(o_orderdate) // 86400000000 AS day FROM orders)"""
