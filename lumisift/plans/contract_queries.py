"""Queries over file scans, row contracts and sinks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.functions import scalars as S
from lumisift.operators import contracts
from lumisift.plans.queries import _with, query
from lumisift.plans.scratch import Scratch
from lumisift.sources import derived as D
from lumisift.sources import files

RAW = ("oid", "meanra", "meandec", "jd", "fid", "magpsf", "sigmapsf", "detected", "diffmaglim", "catflags")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measurements in the spelling of an export, some rows broken."""
    k, text = F.col("k"), lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return D.phot(spark, sf_dir).select(
        F.when(k == 95, " nan ").otherwise(F.concat(F.lit("0"), "source_id")).alias("oid"), F.when(k == 93, "400.5").otherwise(text("ra_deg")).alias("meanra"), text("dec_deg").alias("meandec"),
        (F.col("mjd") + 2400000.5).cast("string").alias("jd"), (k % 3 + 1).cast("string").alias("fid"), F.when(k == 97, "12,x").otherwise(text("magnitude")).alias("magpsf"),
        text("magnitude_error").alias("sigmapsf"), F.when(k == 91, "perhaps").when(F.col("is_detection"), "Detected").otherwise(" non-detection").alias("detected"), text("limiting_magnitude").alias("diffmaglim"),
        F.element_at(F.array(*map(F.lit, ("0", "2", "clean", "?"))), (k % 4 + 1).cast("int")).alias("catflags"),
    )


_CANON = """canon AS (
  SELECT CASE WHEN k = 95 THEN NULL ELSE '0' || source_id END AS source_id, 'ztf' AS survey, ['g', 'r', 'i'][k % 3 + 1] AS band, mjd + 2400000.5e0 - 2400000.5e0 AS mjd,
         CASE WHEN k <> 97 THEN magnitude END AS magnitude, magnitude_error, CASE k WHEN 93 THEN 400.5e0 ELSE ra_deg END AS ra_deg, dec_deg, limiting_magnitude,
         CASE WHEN k <> 91 THEN is_detection END AS is_detection, [TRUE, FALSE, TRUE, NULL][k % 4 + 1] AS quality,
         CASE k WHEN 95 THEN 'missing source_id' WHEN 97 THEN 'malformed magnitude' WHEN 91 THEN 'unrecognised detection value' WHEN 93 THEN 'position out of range' END AS problem FROM phot)"""
_CANON_DOUBLES = "mjd magnitude magnitude_error ra_deg dec_deg limiting_magnitude"


def _written(spark: SparkSession, sf_dir: str, separator: str) -> str:
    scratch = Scratch(spark, "export")
    path = f"{scratch.root}/raw"
    _raw(spark, sf_dir).write.csv(path, header=True, sep=separator)
    return path


def _canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.canonical(_raw(spark, sf_dir), "ztf")


@query(_with(D.PHOT, _CANON) + "SELECT * FROM canon", _CANON_DOUBLES)
def a1_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.canonical(files.scan_text(spark, _written(spark, sf_dir, ","), list(RAW)), "ztf")


@query(
    _with(D.PHOT)
    + """SELECT sha256(event_type) AS marker, n AS seen_rows, CAST(1 AS BIGINT) AS markers, event_type <> 'view' AS agrees
         FROM (SELECT band AS event_type, count(*) AS n FROM phot GROUP BY band)"""
)
def a2_snapshot_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, out = D.phot(spark, sf_dir).withColumn("marker", F.sha2("band", 256)), None
    side = rows.groupBy("band", "marker").agg((F.count("*") + (F.first("band") == "view").cast("int")).alias("n_rows"))
    for band in ("click", "error", "purchase", "signup", "view"):
        one = files.snapshot_identity(rows.where(F.col("band") == band), "marker", side.where(F.col("band") == band))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    _with(D.PHOT)
    + "SELECT count(*) AS n_records, CAST(1 AS BIGINT) AS n_contracts, count(*) FILTER (hi > lo + 20) AS n_late, CAST(0 AS BIGINT) AS n_ragged FROM (SELECT source_id, min(mjd) AS lo, max(mjd) AS hi FROM phot GROUP BY source_id)"
)
def a3_sequence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'sequences').root}/jsonl"
    files.sequences(D.phot(spark, sf_dir), "source_id", "mjd", "flux", F.min("mjd") + 20).write.json(path)
    return files.sequence_contract(spark.read.schema(files.SEQUENCES).json(path))


@query(_with(D.PHOT, _CANON) + "SELECT band, count(*) AS n_rows, count(magnitude) AS n_magnitudes, count(problem) AS n_problems FROM canon GROUP BY band")
def a4_export_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.canonical(files.scan_text(spark, _written(spark, sf_dir, "\t"), list(RAW), "\t"), "ztf")
    return rows.groupBy("band").agg(F.count("*").alias("n_rows"), F.count("magnitude").alias("n_magnitudes"), F.count("problem").alias("n_problems"))


@query(
    """WITH f AS (SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda x: CASE x WHEN 'small' THEN 'flux' WHEN 'red' THEN 'wavelength' WHEN 'ring' THEN 'name' WHEN 'widget' THEN 'label' ELSE x END) AS fields FROM part)
       SELECT CASE WHEN list_contains(fields, 'wavelength') THEN 'spectra' WHEN list_contains(fields, 'flux') THEN 'photometry' WHEN list_contains(fields, 'name') THEN 'registry'
                   WHEN list_contains(fields, 'label') THEN 'classification' ELSE 'unknown' END AS kind, count(*) AS n_files FROM f GROUP BY ALL"""
)
def a5_asset_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*map(F.lit, ("small", "flux", "red", "wavelength", "ring", "name", "widget", "label")))
    fields = F.transform(F.split("p_name", " "), lambda x: F.coalesce(F.try_element_at(names, x), x))
    return D.table(spark, sf_dir, "part").groupBy(files.asset_kind(fields).alias("kind")).agg(F.count("*").alias("n_files"))


@query(_with(D.PHOT) + "SELECT CAST(dec_deg AS DOUBLE) AS dec_deg, count(*) AS n FROM phot GROUP BY ALL", "dec_deg")
def a6_alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = D.phot(spark, sf_dir).select(F.col("dec_deg").alias("meandec"), F.col("ra_deg").alias("dec"))
    names = files.resolve(raw.columns, {"dec_deg": "meandec"})
    return raw.groupBy(F.col(names["dec_deg"]).alias("dec_deg")).agg(F.count("*").alias("n"))


@query(
    _with(D.PHOT, D.SOURCES)
    + "SELECT source_id, ra_deg, dec_deg, count(*) FILTER (is_detection) AS n_detections, count(*) FILTER (NOT is_detection) AS n_limits, count(p.magnitude) AS n_magnitudes FROM phot p JOIN sources s USING (source_id, ra_deg, dec_deg) GROUP BY ALL",
    "ra_deg dec_deg",
)
def a7_broker_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.phot(spark, sf_dir)
    seen = p.where("is_detection").select("source_id", "mjd", "band", "magnitude", "magnitude_error", F.lit(True).alias("is_detection"))
    unseen = p.where("not is_detection").select("source_id", "mjd", "band", "limiting_magnitude", F.lit(False).alias("is_detection"))
    rows = seen.unionByName(unseen, allowMissingColumns=True).join(D.sources(spark, sf_dir), "source_id")
    return rows.groupBy("source_id", "ra_deg", "dec_deg").agg(F.count_if("is_detection").alias("n_detections"), F.count_if(~F.col("is_detection")).alias("n_limits"), F.count("magnitude").alias("n_magnitudes"))


_OBJECTS = "objects AS (SELECT source_id AS oid, band, max(mjd) AS lastmjd, count(*) AS ndet FROM phot GROUP BY ALL)"


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.phot(spark, sf_dir).groupBy(F.col("source_id").alias("oid"), "band").agg(F.max("mjd").alias("lastmjd"), F.count("*").alias("ndet"))


@query(
    _with(D.PHOT, _OBJECTS)
    + """SELECT oid, lastmjd, ndet FROM (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY lastmjd DESC, ndet DESC) AS i FROM objects WHERE band IN ('click', 'view'))
         WHERE i = 1 AND CAST(oid AS BIGINT) % 5 <> 0 ORDER BY lastmjd DESC, oid LIMIT 40""",
    "lastmjd",
)
def a8_object_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _objects(spark, sf_dir)
    lists = [o.where(F.col("band") == b).drop("band") for b in ("click", "view")]
    return files.objects_by_recency(lists, o.where("cast(oid as bigint) % 5 = 0"), 40)


@query(_with(D.PHOT) + "SELECT CAST(c_custkey AS VARCHAR) AS source_id FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT source_id FROM phot)")
def a9_previous_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "runs")
    p = D.phot(spark, sf_dir).select("source_id")
    scratch.table(p.where("cast(source_id as bigint) % 2 = 0"), "one")
    scratch.table(p.where("cast(source_id as bigint) % 2 = 1"), "two")
    earlier = spark.read.parquet(*scratch.paths).distinct()
    return D.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("source_id")).join(earlier, "source_id", "left_anti")


@query(_with(D.PHOT) + "SELECT source_id, count(*) AS n, sum(k) AS score, max(mjd) AS last FROM phot GROUP BY source_id", "last")
def a10_flattening(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = D.phot(spark, sf_dir).groupBy("source_id").agg(F.collect_list(F.struct("mjd", "magnitude", F.col("k").alias("rb"))).alias("detections"))
    rows = nested.select("source_id", F.explode("detections").alias("d")).select("source_id", "d.*")
    return rows.groupBy("source_id").agg(F.count("*").alias("n"), F.sum("rb").alias("score"), F.max("mjd").alias("last"))


@query(_with(D.PHOT) + "SELECT CAST(source_id AS BIGINT) % 3 AS run_id, band, count(*) AS n FROM phot GROUP BY ALL")
def a12_run_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.phot(spark, sf_dir).withColumn("run_id", F.col("source_id").cast("bigint") % 3)
    out = files.publish(rows, f"{Scratch(spark, 'run').root}/normalised", "run_id")
    return out.groupBy(F.col("run_id").cast("bigint").alias("run_id"), "band").agg(F.count("*").alias("n"))


@query(_with(D.PHOT, D.SOURCES, D.CHECKS) + "SELECT status AS decision, count(*) AS n, count(DISTINCT source_id) AS n_sources FROM checks WHERE status IN ('clear', 'match') GROUP BY status")
def a13_split_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.checks(spark, sf_dir).withColumnRenamed("status", "decision")
    out = files.publish(rows, f"{Scratch(spark, 'report').root}/decisions", "decision")
    return out.where(F.col("decision").isin("clear", "match")).groupBy("decision").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("n_sources"))


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.phot(spark, sf_dir).select("source_id", S.channel(F.col("survey"), F.col("band")).alias("channel"))


@query(
    _with(D.PHOT, "per AS (SELECT source_id AS entity, count(DISTINCT survey || '/' || band) AS channels FROM phot GROUP BY source_id)")
    + "SELECT count(*) AS n_entities, CAST(sum(channels) AS BIGINT) AS n_channels, max(channels) <= 100 AS within FROM per"
)
def a14_entity_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = files.shard_manifest(files.entity_shards(_channels(spark, sf_dir), "source_id", "channel", 100, 4))
    return shards.agg(F.sum("n_entities").alias("n_entities"), F.sum("n_channels").alias("n_channels"), (F.max("n_channels") <= 100).alias("within"))


@query(
    _with(D.PHOT, "per AS (SELECT source_id, CAST(source_id AS BIGINT) % 10 = 7 AS twice FROM phot GROUP BY source_id)")
    + "SELECT count(*) AS n_entities, count(*) FILTER (twice) AS n_split, count(*) FILTER (twice) = 0 AS agrees FROM per"
)
def a15_shard_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest against shards in which a tenth of the entities stand twice."""
    shards = files.entity_shards(_channels(spark, sf_dir), "source_id", "channel", 100, 4)
    twice = shards.unionByName(shards.where("cast(entity as bigint) % 10 = 7").withColumn("shard", F.concat("shard", F.lit("-again"))))
    found = files.verify_shards(twice, files.shard_manifest(shards)).agg(F.sum("n_split").alias("n_split"), F.bool_and("agrees").alias("agrees"))
    return found.crossJoin(F.broadcast(shards.agg(F.count_distinct("entity").alias("n_entities"))))


@query(
    _with(D.PHOT, "per AS (SELECT source_id, CAST(source_id AS BIGINT) % 10 = 7 AS twice, min(survey) AS contract FROM phot GROUP BY source_id)")
    + "SELECT count(*) + count(*) FILTER (twice) AS n_rows, count(*) FILTER (twice) AS n_repeated, count(DISTINCT contract) = 1 AS one_contract, count(DISTINCT contract) = 1 AND count(*) FILTER (twice) = 0 AS mergeable FROM per"
)
def a16_shard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of shards that repeat some entities and were made under the contracts of two surveys."""
    r = D.phot(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("n"), F.min("survey").alias("contract"))
    number = F.col("source_id").cast("bigint")
    return files.merge_shard_results([r.where(number % 2 == 1), r.where(number % 2 == 0), r.where(number % 10 == 7)], "contract", "source_id")


@query(
    _with(D.PHOT)
    + """SELECT CASE WHEN event_id % 11 = 0 THEN 'conflict' WHEN event_id % 5 = 0 THEN 'duplicate' ELSE 'accepted' END AS status, count(*) AS n_ids,
         CAST(sum(1 + CAST(event_id % 5 = 0 AS INT) + CAST(event_id % 11 = 0 AS INT)) AS BIGINT) AS n_rows FROM phot GROUP BY ALL"""
)
def a17_native_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.phot(spark, sf_dir).select(F.col("event_id").alias("row_id"), "mjd", F.col("k").alias("quality_bitmask"))
    rows = p.union(p.where("row_id % 5 = 0")).union(p.where("row_id % 11 = 0").withColumn("mjd", F.col("mjd") + 1))
    return files.native_cadence(rows).groupBy("status").agg(F.count("*").alias("n_ids"), F.sum("n").alias("n_rows"))


# ---- expressions


@query(
    _with(D.PHOT, "w AS (SELECT ['good', ' TRUE', '0', '3', '-1', 'clear', 'odd', ''][k % 8 + 1] AS word FROM phot)")
    + """SELECT word, CASE word WHEN 'good' THEN TRUE WHEN ' TRUE' THEN TRUE WHEN '3' THEN TRUE WHEN '0' THEN FALSE WHEN '-1' THEN FALSE END AS positive,
         CASE word WHEN 'good' THEN TRUE WHEN 'clear' THEN TRUE WHEN '0' THEN TRUE WHEN '3' THEN FALSE WHEN ' TRUE' THEN FALSE END AS flagged, count(*) AS n FROM w GROUP BY ALL"""
)
def b3_quality_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*map(F.lit, ("good", " TRUE", "0", "3", "-1", "clear", "odd", "")))
    w = D.phot(spark, sf_dir).select(F.element_at(words, (F.col("k") % 8 + 1).cast("int")).alias("word"))
    return w.groupBy("word", S.quality(F.col("word"), "quality").alias("positive"), S.quality(F.col("word"), "catflags").alias("flagged")).agg(F.count("*").alias("n"))


@query(
    _with(D.PHOT)
    + """SELECT 'all' AS table_name, 'mjd' AS scale, count(*) AS n_times FROM phot UNION ALL SELECT 'jd', 'jd', count(*) FROM phot UNION ALL SELECT 'half', 'mixed', count(*) FROM phot
         UNION ALL SELECT 'unix', 'implausible', count(*) FROM phot"""
)
def b5_time_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.phot(spark, sf_dir)
    cases = {"all": F.col("mjd"), "jd": F.col("mjd") + 2400000.5, "half": F.col("mjd") + F.when(F.col("k") < 50, 2400000.5).otherwise(0.0), "unix": F.col("mjd") * 86400}
    out = [contracts.time_scale(p.select(c.alias("t")), "t").select(F.lit(n).alias("table_name"), "scale", "n_times") for n, c in cases.items()]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query(
    _with(D.PHOT) + "SELECT observation_id, CASE WHEN (60330e0 - mjd) * 24e0 >= -1 / 60e0 THEN greatest(0e0, (60330e0 - mjd) * 24e0) END AS age FROM phot", "age"
)
def b10_age_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.phot(spark, sf_dir).select("observation_id", S.age_hours(F.col("mjd"), 60330.0).alias("age"))


@query("SELECT p_type, p_brand, count(*) AS n FROM part WHERE list_contains(['ECONOMY', 'STANDARD'], upper(p_type)) GROUP BY ALL")
def b14_label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "part").where(S.has_label(F.lit(" economy, Standard"), F.col("p_type"))).groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))


@query(_with(D.PHOT) + "SELECT observation_id, CASE WHEN k % 3 = 0 THEN k / 100e0 WHEN k % 3 = 1 THEN flux ELSE NULL END AS probability FROM phot", "probability")
def b15_first_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    p = D.phot(spark, sf_dir).select("observation_id", F.when(k % 3 == 0, (k / 100).cast("string")).otherwise("-").alias("prob"), F.when(k % 3 == 1, F.col("flux").cast("string")).otherwise(" ").alias("probability"))
    return p.select("observation_id", S.first_number("prob", "probability").alias("probability"))


@query(
    _with(D.PHOT, "c AS (SELECT source_id, band, max(flux) AS m FROM phot GROUP BY ALL)")
    + "SELECT source_id, max(m) FILTER (band = 'click') AS band_click_peak, max(m) FILTER (band = 'error') AS band_error_peak, max(m) FILTER (band = 'view') AS band_view_peak FROM c GROUP BY source_id",
    "band_click_peak band_error_peak band_view_peak",
)
def b17_feature_flattening(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = D.phot(spark, sf_dir).groupBy("source_id").pivot("band", ["click", "error", "view"]).agg(F.max("flux"))
    return wide.select("source_id", *(F.col(b).alias(f"band_{b}_peak") for b in ("click", "error", "view")))


@query(
    _with(D.PHOT)
    + "SELECT source_id, count(DISTINCT band) >= 2 AND count(*) FILTER (is_detection) >= 4 AND CAST(source_id AS BIGINT) % 4 > 0 AND CAST(source_id AS BIGINT) % 3 < 2 AS fit_able FROM phot GROUP BY source_id"
)
def b18_fit_ability(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.phot(spark, sf_dir).groupBy("source_id").agg(F.count_distinct("band").alias("bands"), F.count_if("is_detection").alias("n"))
    number = F.col("source_id").cast("bigint")
    distance, population = F.when(number % 4 > 0, number * 10.0), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (number % 3 + 1).cast("int"))
    return g.select("source_id", ((F.col("bands") >= 2) & (F.col("n") >= 4) & distance.isNotNull() & population.isin("a", "b")).alias("fit_able"))


# ---- contracts


@query(
    _with(D.PHOT, _CANON)
    + "SELECT count(*) AS n, count(*) FILTER (source_id IS NULL) AS n_missing_id, count(*) FILTER (ra_deg >= 360) AS n_bad_position, count(*) FILTER (band IS NULL) AS n_missing_band FROM canon"
)
def c1_c2_identifiers_and_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = lambda c: F.count_if(contracts.missing_identifier(F.col(c)))
    return _canon(spark, sf_dir).agg(F.count("*").alias("n"), bad("source_id").alias("n_missing_id"), F.count_if(contracts.bad_position(F.col("ra_deg"), F.col("dec_deg"))).alias("n_bad_position"), bad("band").alias("n_missing_band"))


@query(
    _with(D.PHOT)
    + """SELECT CASE WHEN is_detection AND k % 5 = 0 THEN 'detection_without_measurement' WHEN NOT is_detection AND k % 5 = 0 AND k % 2 = 0 THEN 'nondetection_without_limit_or_flux' ELSE 'none' END AS warning, count(*) AS n FROM phot GROUP BY ALL"""
)
def c6_presence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda c, gone: F.when(~gone, F.col(c))
    k = F.col("k")
    w = contracts.presence_warning(F.col("is_detection"), some("magnitude", k % 5 == 0), some("flux", k % 5 == 0), some("limiting_magnitude", k % 2 == 0))
    return D.phot(spark, sf_dir).groupBy(F.coalesce(w, F.lit("none")).alias("warning")).agg(F.count("*").alias("n"))


@query(_with(D.PHOT) + "SELECT source_id, count(*) AS n, sum(k) AS total FROM phot WHERE magnitude IS NOT NULL AND magnitude_error > 0 AND magnitude_error <= 0.1e0 AND (k % 7 = 0 OR k % 9 <= 3) GROUP BY source_id")
def c7_legacy_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.phot(spark, sf_dir).withColumn("catflags", F.when(F.col("k") % 7 != 0, F.col("k") % 9))
    return contracts.clean_legacy(rows, "magnitude", "magnitude_error", "mjd", "catflags", 0.1, 3).groupBy("source_id").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query(_with(D.PHOT) + "SELECT source_id, count(*) FILTER (mjd > 60320e0 + CAST(source_id AS BIGINT) % 20) AS n_late, max(mjd) AS latest FROM phot GROUP BY source_id HAVING n_late > 0", "latest")
def c9_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.after_cutoff(D.phot(spark, sf_dir), "source_id", "mjd", F.lit(60320.0) + F.col("source_id").cast("bigint") % 20)


@query(
    _with(D.PHOT)
    + """SELECT source_id, count(*) FILTER (quality AND magnitude IS NOT NULL) AS n_magnitude, count(*) FILTER (quality AND flux_error <= 1.2e0) AS n_flux, count(*) FILTER (quality AND NOT is_detection) AS n_limit,
         count(*) FILTER (quality AND is_detection AND magnitude_error <= 1.2e0) AS n_error FROM phot GROUP BY source_id"""
)
def c11_validity_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = contracts.valid_measurements(D.phot(spark, sf_dir), 1.2)
    return v.groupBy("source_id").agg(*(F.count_if(f"valid_{c}").alias(f"n_{c}") for c in ("magnitude", "flux", "limit", "error")))


@query(
    _with(D.PHOT, D.SOURCES, D.CHECKS)
    + """SELECT policy, source_id, service, attempt, (checked_hour >= 6 AND checked_hour % 5 > 0 AND (policy = 'triage' OR status = 'clear')) AS eligible,
         concat_ws('; ', CASE WHEN checked_hour < 6 THEN 'quality gate failed' END, CASE WHEN policy = 'gate-clear' AND status <> 'clear' THEN 'gate is ' || status END, CASE WHEN checked_hour % 5 = 0 THEN 'explicitly excluded' END) AS reason
         FROM checks, (SELECT unnest(['triage', 'gate-clear']) AS policy)"""
)
def c12_review_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, out = D.checks(spark, sf_dir), []
    for policy in ("triage", "gate-clear"):
        ok, why = contracts.eligibility(F.col("checked_hour") >= 6, F.col("status"), F.col("checked_hour") % 5 == 0, policy)
        out.append(c.select(F.lit(policy).alias("policy"), "source_id", "service", "attempt", ok.alias("eligible"), why.alias("reason")))
    return out[0].union(out[1])


@query("SELECT lower(trim(p_name)) AS entity, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def c13_entity_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.repeated_entities(D.table(spark, sf_dir, "part"), "p_name")


@query("SELECT o_custkey AS entity, list_sort(list(DISTINCT o_orderstatus)) AS splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1".replace("list_sort(list(DISTINCT o_orderstatus))", "array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',')"))
def c14_disjoint_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contracts.entities_in_several_splits(D.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "entity"), "entity", "o_orderstatus")
    return found.select("entity", F.array_join("splits", ",").alias("splits"))


@query(_with(D.RANKING) + "SELECT count(*) AS n_rows, count(*) FILTER (entity % 10 = 3) AS n_bad_labels, CAST(0 AS BIGINT) AS n_bad_score_a, count(*) FILTER (entity % 7 = 0) AS n_bad_score_b FROM ranking")
def c18_labels_and_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.ranking(spark, sf_dir).withColumn("label", F.when(F.col("entity") % 10 != 3, F.col("label"))).withColumn("score_b", F.when(F.col("entity") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("score_b")))
    return contracts.bad_labels_and_scores(r, "label", ["score_a", "score_b"])


@query("SELECT p_brand, p_partkey, p_size, place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS place FROM part WHERE p_size >= 30 OR p_type = 'ECONOMY') WHERE place <= 5")
def c21_first_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.table(spark, sf_dir, "part").where("p_size >= 30 or p_type = 'ECONOMY'")
    return contracts.first_per_class(p, "p_brand", [F.desc("p_size"), F.desc("p_retailprice"), F.col("p_partkey")], 5).select("p_brand", "p_partkey", "p_size", "place")


@query(
    _with(D.PHOT, "e AS (SELECT source_id, max(mjd) FILTER (band = 'click') AS hi, min(mjd) FILTER (band = 'view') AS lo FROM phot GROUP BY source_id)")
    + "SELECT max(hi) AS last_before, min(lo) AS first_after, count(*) FILTER (hi IS NOT NULL AND lo IS NOT NULL) AS n_shared, max(hi) < min(lo) AS ordered FROM e",
    "last_before first_after",
)
def c22_split_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.split_order(D.phot(spark, sf_dir), "band", "source_id", "mjd", "click", "view")
