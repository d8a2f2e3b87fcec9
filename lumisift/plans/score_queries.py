"""Queries over scores, decisions, joins of evidence and versioned tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumisift.operators import contracts, curves, review, scores
from lumisift.plans.queries import _SOURCE_SQL, ORACLE, QUERIES, _with, query
from lumisift.plans.scratch import Scratch
from lumisift.sources import derived as D
from lumisift.streaming import archive, ledger, letters, stores

_FEAT = """feat AS (
  SELECT source_id, CAST(source_id AS BIGINT) AS number, count(*) FILTER (is_detection) AS n_detections, count(DISTINCT band) FILTER (is_detection) AS n_bands, max(magnitude) - min(magnitude) AS amp,
         median(magnitude) - min(magnitude) AS bright, max(flux / flux_error) AS sigma, avg(CASE WHEN quality THEN 0e0 ELSE 1e0 END) AS rejected, max(mjd) AS last, min(mjd) AS first,
         avg(CASE WHEN magnitude IS NULL THEN 1e0 ELSE 0e0 END) AS missing FROM phot GROUP BY source_id)"""


def _feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    g = D.phot(spark, sf_dir).groupBy("source_id").agg(
        F.count_if("is_detection").alias("n_detections"), F.count_distinct(F.when(F.col("is_detection"), F.col("band"))).alias("n_bands"), (F.max("magnitude") - F.min("magnitude")).alias("amp"),
        (F.median("magnitude") - F.min("magnitude")).alias("bright"), F.max(F.col("flux") / F.col("flux_error")).alias("sigma"), share(~F.col("quality")).alias("rejected"), F.max("mjd").alias("last"), F.min("mjd").alias("first"),
        share(F.col("magnitude").isNull()).alias("missing"),
    )
    return g.withColumn("number", F.col("source_id").cast("bigint"))


_SOFT = "CASE WHEN {0} > 0 THEN 1 - exp(-({0}) / {1}) ELSE 0e0 END"


def _soft(x: str, scale: float) -> str:
    return _SOFT.format(x, f"{scale}e0")


_PRIORITY = f"""pin AS (SELECT *, max_brightening AS b, median_p90_p10 AS t, max_excursion AS fx, median_excursion AS ft, coalesce(max_significance, greatest(max_peak_significance, max_flux_significance)) AS sg,
         greatest(max_rise_rate, max_fade_rate) AS rate, greatest(max_flux_rise_rate, max_flux_fade_rate) AS frate FROM src),
  comp AS (SELECT source_id, n_detections,
         CASE WHEN coalesce(b, t) IS NOT NULL THEN 0.6e0 * {_soft("greatest(coalesce(b, t), coalesce(t, b))", 0.8)} + 0.4e0 * {_soft("t", 0.8)}
              WHEN coalesce(fx, ft) IS NOT NULL THEN 0.6e0 * {_soft("greatest(coalesce(fx, ft), coalesce(ft, fx))", 1.0)} + 0.4e0 * {_soft("ft", 1.0)} ELSE 0e0 END AS amplitude,
         coalesce(1 / (1 + exp(-greatest(-60e0, least(60e0, (sg - 4) / 1.5e0)))), 0e0) AS significance_score,
         CASE WHEN rate IS NOT NULL THEN {_soft("rate", 0.5)} ELSE {_soft("frate", 0.5)} END AS temporal,
         CASE WHEN has_prior THEN 0.65e0 * greatest({_soft("prior_contrast_mag", 1.0)}, {_soft("prior_flux_contrast", 3.0)}) + 0.35e0 * coalesce(exp(-greatest(0e0, prior_gap_days) / 7e0), 0e0) ELSE 0e0 END AS nondetection,
         0.5e0 * {_soft("n_detections", 8.0)} + 0.2e0 * {_soft("n_bands", 2.0)} + 0.3e0 * {_soft("n_significant", 2.0)} AS sampling,
         greatest(0e0, least(1e0, 1 - 0.4e0 * error_missing - 0.25e0 * quality_rejected - 0.2e0 * error_missing - 0.15e0 * rejected_detections)) AS data_quality FROM pin)"""


def _from_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every source's light curves, by the names that scores and gates go by."""
    names = {
        "max_brightening": "brightening", "median_p90_p10": "typical_amplitude", "max_excursion": "flux_excursion", "median_excursion": "typical_flux_excursion", "max_significance": "significance", "max_peak_significance": "mag_significance",
        "max_flux_significance": "flux_significance", "max_rise_rate": "rise", "max_fade_rate": "fade", "max_flux_rise_rate": "flux_rise", "max_flux_fade_rate": "flux_fade", "prior_gap_days": "gap", "prior_contrast_mag": "contrast",
        "prior_flux_contrast": "flux_contrast", "rejected_detections": "detection_rejected",
    }
    return curves.source_features(D.phot(spark, sf_dir)).withColumnsRenamed(names).withColumn("missing_fraction", F.col("error_missing"))


@query(
    _with(D.PHOT, _SOURCE_SQL, _PRIORITY)
    + """SELECT source_id, amplitude, significance_score, temporal, nondetection, sampling, data_quality,
         greatest(0e0, least(0.999999e0, (0.24e0 * amplitude + 0.22e0 * significance_score + 0.15e0 * temporal + 0.12e0 * nondetection + 0.12e0 * sampling + 0.15e0 * data_quality)
           * CASE WHEN n_detections < 3 THEN 0.65e0 + 0.35e0 * n_detections / 3 ELSE 1e0 END * (0.75e0 + 0.25e0 * data_quality))) AS priority FROM comp""",
    "amplitude significance_score temporal nondetection sampling data_quality priority",
)
def j1_review_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.review_priority(_from_curves(spark, sf_dir)).select("source_id", "amplitude", "significance_score", "temporal", "nondetection", "sampling", "data_quality", "priority")


@query(
    _with(D.PHOT, _SOURCE_SQL)
    + """SELECT source_id, concat_ws('; ', CASE WHEN n_detections < 55 THEN 'too few detections' END, CASE WHEN n_bands < 1 THEN 'no band with detections' END, CASE WHEN error_missing >= 1 THEN 'no complete measurement' END, CASE WHEN error_missing >= 1 THEN 'no valid uncertainty' END) AS quality_reasons,
         n_detections >= 55 AND n_bands >= 1 AND error_missing < 1 AS quality_passed FROM src"""
)
def j6_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.quality_reasons(_from_curves(spark, sf_dir), 55).select("source_id", "quality_reasons", "quality_passed")


_FLARE = """fin AS (SELECT *, greatest(0e0, least(1e0, amp / 5)) AS smoothness, (last - first) * (1 + number % 15) AS duration, greatest(0e0, least(1e0, amp / 1.5e0)) AS amp_score, greatest(0e0, least(1e0, sigma / 10)) AS snr_score,
         CASE WHEN number % 4 > 0 THEN number % 11 / 10e0 END AS probability, number % 13 = 0 AS agn, CASE WHEN number % 3 = 0 THEN number % 10 / 10e0 END AS colour, CASE WHEN number % 4 = 1 THEN 0.1e0 END AS redshift, number % 5 - 2e0 AS slope FROM feat),
  fsc AS (SELECT *, greatest(0e0, 0.25e0 * smoothness + 0.2e0 * greatest(0e0, least(1e0, duration / 10)) + 0.2e0 * amp_score + 0.15e0 * snr_score + 0.1e0 * coalesce(probability, 0e0)
           + 0.1e0 * greatest(0e0, least(1e0, 1 - ((SELECT max(last) FROM feat) - last) / 30)) - 0.1e0 * least(1e0, duration / 120)) AS score, (SELECT max(last) FROM feat) - first AS age,
           CASE WHEN duration > 365 AND NOT agn THEN 'long_running_variable_or_unclear' WHEN agn OR coalesce(colour >= 0.8e0, FALSE) THEN 'possible_agn_flare' WHEN redshift IS NOT NULL AND smoothness >= 0.65e0 AND duration >= 10 THEN 'possible_tde_candidate'
                WHEN smoothness >= 0.65e0 AND duration >= 10 AND slope < 0 THEN 'nuclear_flare_candidate_needs_host_check' ELSE 'low_priority_blackhole_related' END AS kind FROM fin)"""


@query(
    _with(D.PHOT, _FEAT, _FLARE)
    + """SELECT source_id, score, kind, CASE WHEN duration > 120 THEN 'long_running_source' WHEN score >= 0.5e0 AND age <= 60 AND kind <> 'long_running_variable_or_unclear' THEN 'high_priority' ELSE 'review_later' END AS tier FROM fsc""",
    "score",
)
def j9_flare_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumisift.functions.scalars import unit

    n = F.col("number")
    f = _feat(spark, sf_dir).withColumn("duration", (F.col("last") - F.col("first")) * (1 + n % 15)).withColumns({
        "smoothness": unit(F.col("amp") / 5), "duration_score": unit(F.col("duration") / 10), "amp_score": unit(F.col("amp") / 1.5), "snr_score": unit(F.col("sigma") / 10), "probability": F.when(n % 4 > 0, n % 11 / 10.0),
        "known_agn": n % 13 == 0, "infrared_colour": F.when(n % 3 == 0, n % 10 / 10.0), "redshift": F.when(n % 4 == 1, 0.1), "slope": n % 5 - 2.0,
    })
    return scores.flare_scores(f, 60.0, 120.0, 0.5).select("source_id", "score", "kind", "tier")


_UNIT = "greatest(0e0, least(1e0, {}))"


@query(
    f"""WITH o AS (SELECT p_partkey, ['TNO', 'CEN', 'PAR', 'HYP', 'HTC'][p_partkey % 5 + 1] AS class, CASE WHEN p_partkey % 5 >= 2 THEN 'cn' ELSE 'an' END AS kind, p_size * 3e0 AS a, p_size * 7e0 AS ad, p_size * 1e0 AS q, p_size / 50e0 AS e, p_retailprice AS per_y,
                CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 10 * 1e0 END AS condition, p_retailprice AS arc, p_size * 10e0 AS n_obs FROM part),
       k AS (SELECT *, CASE WHEN kind LIKE 'c%' AND (class IN ('PAR', 'HYP') OR a >= 100 OR ad >= 100 OR e >= 0.98e0) THEN 'oort_cloud_like_comet' WHEN class = 'CEN' THEN 'centaur_transition_object' WHEN class = 'TNO' THEN 'kuiper_belt_tno' ELSE 'other_distant_object' END AS reservoir FROM o),
       s AS (SELECT *, CASE reservoir WHEN 'kuiper_belt_tno' THEN {_UNIT.format(f"0.6e0 * {_UNIT.format('(q - 30.1e0) / 20')} + 0.4e0 * {_UNIT.format('(a - 30.1e0) / 100')}")} WHEN 'centaur_transition_object' THEN {_UNIT.format('(a - 5.5e0) / (30.1e0 - 5.5e0)')}
              WHEN 'oort_cloud_like_comet' THEN {_UNIT.format(f"0.3e0 * {_UNIT.format('ln(1 + a) / ln(1001e0)')} + 0.25e0 * {_UNIT.format('ln(1 + ad) / ln(5001e0)')} + 0.2e0 * {_UNIT.format('ln(1 + per_y) / ln(10001e0)')} + 0.15e0 * {_UNIT.format('(e - 0.9e0) / 0.1e0')} + 0.1e0 * CAST(class IN ('PAR', 'HYP') AS INT)")} ELSE 0e0 END AS signal FROM k)
       SELECT p_partkey, reservoir, signal, {_UNIT.format(f"0.65e0 * signal + 0.25e0 * {_UNIT.format('1 - coalesce(condition, 4.5e0) / 9')} + 0.1e0 * {_UNIT.format(f'0.55e0 * {_UNIT.format("ln(1 + arc) / ln(3651e0)")} + 0.45e0 * {_UNIT.format("ln(1 + n_obs) / ln(1001e0)")}')}")} AS score FROM s""",
    "signal score",
)
def j10_reservoir_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = D.table(spark, sf_dir, "part"), F.col("p_partkey")
    o = p.select(
        k, F.element_at(F.array(*map(F.lit, ("TNO", "CEN", "PAR", "HYP", "HTC"))), (k % 5 + 1).cast("int")).alias("class"), F.when(k % 5 >= 2, "cn").otherwise("an").alias("kind"), (F.col("p_size") * 3.0).alias("a"),
        (F.col("p_size") * 7.0).alias("ad"), (F.col("p_size") * 1.0).alias("q"), (F.col("p_size") / 50.0).alias("e"), F.col("p_retailprice").alias("per_y"), F.when(k % 3 > 0, (k % 10).cast("double")).alias("condition"),
        F.col("p_retailprice").alias("arc"), (F.col("p_size") * 10.0).alias("n_obs"),
    )
    return scores.reservoir_scores(o).select("p_partkey", "reservoir", "signal", "score")


_VERIFY = """ver AS (SELECT source_id, number, CASE WHEN number % 11 = 0 THEN 'reject_moving_object' WHEN number % 7 = 0 THEN 'reject_known_object' WHEN number % 5 = 0 OR number % 6 = 1 THEN 'needs_check_before_reporting' ELSE 'likely_new_candidate' END AS verification FROM feat)"""


def _verified(f: DataFrame) -> DataFrame:
    n = F.col("number")
    return f.withColumn("verification", scores.verification(n % 11 == 0, n % 7 == 0, F.when(n % 5 > 0, True), n % 6 != 1))


@query(_with(D.PHOT, _FEAT, _VERIFY) + "SELECT source_id, verification FROM ver")
def j12_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verified(_feat(spark, sf_dir)).select("source_id", "verification")


@query(
    _with(D.PHOT, _FEAT, _VERIFY)
    + """SELECT source_id, CASE verification WHEN 'reject_known_object' THEN verification WHEN 'reject_moving_object' THEN verification ELSE
           CASE WHEN cat = 'reject_variable' THEN 'reject_known_variable' WHEN cat LIKE 'review%' THEN 'needs_manual_catalogue_review' WHEN cat = 'possible_host' THEN 'needs_manual_host_review'
                WHEN verification = 'needs_check_before_reporting' THEN 'block_pending_check' WHEN cat IS NULL THEN 'reject_catalogue_status' WHEN veto <> '' THEN 'reject_freshness_veto' ELSE 'reportable_candidate' END END AS decision, veto
         FROM (SELECT f.*, verification, CASE f.number % 12 WHEN 0 THEN 'reject_variable' WHEN 3 THEN 'review_star' WHEN 6 THEN 'possible_host' WHEN 9 THEN NULL ELSE 'pass' END AS cat,
                CASE WHEN f.number % 8 = 2 THEN 'class' WHEN f.number % 40 > 35 THEN 'first_detection_too_old' WHEN n_detections > 45 THEN 'too_many_detections' WHEN last - first > 29.5e0 THEN 'span_too_long' ELSE '' END AS veto
               FROM feat f JOIN ver USING (source_id))"""
)
def j13_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("number")
    cat = F.when(n % 12 == 0, "reject_variable").when(n % 12 == 3, "review_star").when(n % 12 == 6, "possible_host").when(n % 12 != 9, "pass")
    f = _verified(_feat(spark, sf_dir)).withColumns({"catalogue": cat, "object_class": F.when(n % 8 == 2, " agn").otherwise("SN"), "age": (n % 40).cast("double")})
    return scores.shortlist(f, 35.0, 45, 29.5, ("AGN", "QSO")).select("source_id", "decision", "veto")


@query(
    _with(D.PHOT)
    + """SELECT observation_id, least(1e0, greatest(core, reserve)) AS priority, CASE WHEN reserve > core THEN 'anomaly_reserve' ELSE 'core' END AS route
         FROM (SELECT observation_id, r * n * sqrt(v * u) * sqrt(o * g) AS core, 0.35e0 * a * r * o AS reserve
               FROM (SELECT observation_id, k / 100e0 AS r, (k * 7 % 100) / 100e0 AS n, (k * 13 % 100) / 100e0 AS v, (k * 29 % 100) / 100e0 AS u, (k * 3 % 100) / 100e0 AS o, (k * 17 % 100) / 100e0 AS g, (k * 41 % 100) / 100e0 AS a FROM phot))""",
    "priority",
)
def j14_followup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lambda m: (F.col("k") * m % 100) / 100.0
    priority, route = scores.followup(x(1), x(7), x(13), x(29), x(3), x(17), x(41))
    return D.phot(spark, sf_dir).select("observation_id", priority.alias("priority"), route.alias("route"))


@query(
    _with(D.PHOT, D.SOURCES, D.CHECKS, "w AS (SELECT source_id, service, min(list_position(['match', 'error', 'stale', 'pending', 'clear'], status)) AS p, min(expires_hour) AS expires_hour, count(*) AS n_epochs FROM checks GROUP BY ALL)")
    + "SELECT source_id, service, ['match', 'error', 'stale', 'pending', 'clear'][p] AS status, expires_hour, n_epochs FROM w"
)
def j5_worst_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.worst_status(D.checks(spark, sf_dir), ["source_id", "service"])


@query(
    _with(
        D.PHOT, D.SOURCES, D.CHECKS,
        "mx AS (SELECT source_id, service, max(checked_hour) AS checked_hour FROM checks GROUP BY ALL)",
        "lt AS (SELECT source_id, service, arg_min(status, attempt) AS status, arg_min(expires_hour, attempt) AS expires_hour, count(DISTINCT status) > 1 AS conflicting FROM checks JOIN mx USING (source_id, service, checked_hour) GROUP BY ALL)",
        "st AS (SELECT s.source_id, v.service, CASE WHEN status IS NULL THEN 'missing' WHEN conflicting THEN 'failing' WHEN expires_hour <= 34 THEN 'stale' WHEN status <> 'clear' THEN 'failing' ELSE 'pass' END AS state FROM sources s, (SELECT unnest(['catalog', 'registry', 'archive']) AS service) v LEFT JOIN lt ON lt.source_id = s.source_id AND lt.service = v.service)",
    )
    + """SELECT source_id, coalesce(string_agg(service, ',' ORDER BY service) FILTER (state = 'missing'), '') AS missing, coalesce(string_agg(service, ',' ORDER BY service) FILTER (state = 'failing'), '') AS failing,
         coalesce(string_agg(service, ',' ORDER BY service) FILTER (state = 'stale'), '') AS stale, bool_and(state = 'pass') AS reportable FROM st GROUP BY source_id"""
)
def j20_required_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.required_evidence(D.sources(spark, sf_dir), D.checks(spark, sf_dir), ["catalog", "registry", "archive"], 34)


@query(
    _with(D.PHOT, "e AS (SELECT source_id, list_sort(list(DISTINCT mjd)) AS own, list_sort(list(DISTINCT mjd) FILTER (CAST(source_id AS BIGINT) % 4 > 0 OR k <> 50)) AS given FROM phot WHERE is_detection GROUP BY source_id)")
    + "SELECT source_id, len(own) AS n_epochs, own = given AS canonical FROM e"
)
def j21_check_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.phot(spark, sf_dir).where("is_detection").groupBy("source_id")
    kept = F.when((F.col("source_id").cast("bigint") % 4 > 0) | (F.col("k") != 50), F.col("mjd"))
    e = g.agg(F.array_sort(F.collect_set("mjd")).alias("own"), F.array_sort(F.collect_set(kept)).alias("given"))
    return e.select("source_id", F.size("own").cast("long").alias("n_epochs"), (F.col("own") == F.col("given")).alias("canonical"))


@query(
    _with(D.REVIEWS, "l AS (SELECT candidate, version, reviewer, arg_max(verdict, review_id) AS verdict FROM reviews GROUP BY ALL)")
    + "SELECT candidate, version, count(*) AS n, bool_or(verdict = 'reject') AS blocked, bool_or(verdict = 'approve') AND NOT bool_or(verdict = 'reject') AS cleared FROM l GROUP BY ALL"
)
def j17_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.adjudication(D.reviews(spark, sf_dir))


@query(
    _with(
        D.REVIEWS,
        "cur AS (SELECT candidate, arg_max(version, (day, review_id)) AS version FROM reviews GROUP BY candidate)",
        "l AS (SELECT candidate, version, reviewer, arg_max(verdict, review_id) AS verdict FROM reviews GROUP BY ALL)",
        "adj AS (SELECT candidate, version, bool_or(verdict = 'approve') AND NOT bool_or(verdict = 'reject') AS cleared FROM l JOIN cur USING (candidate, version) GROUP BY ALL)",
        "act AS (SELECT candidate, version, reviewer, role, arg_max(verdict, review_id) AS verdict FROM reviews JOIN cur USING (candidate, version) GROUP BY ALL)",
        "app AS (SELECT candidate, count(*) FILTER (role = 'screener' AND verdict = 'approve') > 0 AND count(*) FILTER (role = 'reviewer' AND verdict = 'approve') > 0 AND count(DISTINCT reviewer) FILTER (verdict = 'approve') > 1 AND NOT bool_or(verdict = 'reject') AS approved FROM act GROUP BY candidate)",
    )
    + "SELECT candidate, version, concat_ws(',', CASE WHEN candidate % 3 = 0 THEN 'gate' END, CASE WHEN NOT cleared THEN 'adjudication' END, CASE WHEN NOT approved THEN 'approval' END) AS blockers FROM adj JOIN app USING (candidate)"
)
def j18_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.reviews(spark, sf_dir)
    now = review.current_versions(r)
    j = now.join(scores.adjudication(r).select("candidate", "version", "cleared"), ["candidate", "version"]).join(review.approvals(r).select("candidate", "version", "approved"), ["candidate", "version"])
    gate = F.col("candidate") % 3 == 0
    blockers = F.concat_ws(",", F.array_compact(F.array(F.when(gate, "gate"), F.when(~F.col("cleared"), "adjudication"), F.when(~F.col("approved"), "approval"))))
    return j.select("candidate", "version", blockers.alias("blockers"))


_EPOCHS = """ep AS (SELECT source_id, list_sort(list(mjd) FILTER (band = 'click')) AS refs, list_sort(list(mjd) FILTER (band = 'view')) AS qs FROM phot GROUP BY source_id)"""


def _epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda b: F.array_sort(F.collect_list(F.when(F.col("band") == b, F.col("mjd"))))
    return D.phot(spark, sf_dir).groupBy("source_id").agg(of("click").alias("references"), of("view").alias("queries"))


# SQL has no running state over an array; tests/test_operators.py holds it against the plain loop
@query()
def d17_epoch_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _epochs(spark, sf_dir)
    return e.select("source_id", F.size("references").alias("n_references"), scores.epochs_uncovered(F.col("references"), F.col("queries"), 1.5).alias("n_uncovered"))


@query(
    _with(D.PHOT, D.SOURCES, D.CHECKS)
    + """SELECT source_id, service, attempt, reason, CASE WHEN reason <> '' THEN 'stale' ELSE status END AS bound_status FROM (
           SELECT *, CASE WHEN status <> 'clear' THEN '' WHEN expires_hour <= 30 THEN 'expired' WHEN n % 7 = 0 THEN 'digest' WHEN n % 5 = 0 THEN 'identity' WHEN n % 9 > 6 THEN 'position' WHEN n % 2 = 0 THEN 'epochs' ELSE '' END AS reason
           FROM (SELECT *, CAST(source_id AS BIGINT) AS n FROM checks))"""
)
def j3_evidence_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("source_id").cast("bigint")
    c = D.checks(spark, sf_dir).withColumns({
        "digest": F.sha2("source_id", 256), "expected_digest": F.sha2(F.when(n % 7 == 0, "other").otherwise(F.col("source_id")), 256), "queried": F.when(n % 5 > 0, F.col("source_id")), "offset": (n % 9).cast("double"),
        "references": F.array(F.lit(1.0), F.lit(1.1), F.lit(9.0)), "queries": F.when(n % 2 == 0, F.array(F.lit(1.0), F.lit(9.0))).otherwise(F.array(F.lit(0.9), F.lit(1.2), F.lit(8.9))),
    })
    return scores.bound_checks(c, 30, 6.0, 0.5).select("source_id", "service", "attempt", "reason", "bound_status")


@query(ORACLE["d15_host_association"].replace("SELECT * REPLACE (round(separation, 6) AS separation, round(chance, 6) AS chance)", "SELECT decision, count(*) AS n, count(host) FILTER (decision = 'accepted') AS n_accepted", 1) + " GROUP BY decision")
def j15_host_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = QUERIES["d15_host_association"](spark, sf_dir)
    return out.groupBy("decision").agg(F.count("*").alias("n"), F.count(F.when(F.col("decision") == "accepted", F.col("host"))).alias("n_accepted"))


@query(_with(D.PHOT, _FEAT) + "SELECT source_id, 0.7e0 * ln(1 + amp) + 0.3e0 * ln(1 + sigma) AS rank_score FROM feat", "rank_score")
def h13_weighted_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.weighted_rank(_feat(spark, sf_dir), {"amp": 0.7, "sigma": 0.3}).select("source_id", "rank_score")


# ---- joins


@query(_with(D.PHOT, _FEAT) + "SELECT source_id, n_detections, c_mktsegment AS segment, c_acctbal AS balance FROM feat LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) c ON c.c_custkey = number")
def d1_metadata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = D.table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("number"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    return _feat(spark, sf_dir).select("source_id", "number", "n_detections").join(meta, "number", "left").drop("number")


@query(_with(D.PHOT, _FEAT, D.CATALOG) + "SELECT source_id, coalesce(otype = 'star', FALSE) AS matched, coalesce(name, '') AS names, CAST(coalesce(length(name), 0) AS BIGINT) AS n FROM feat LEFT JOIN catalog ON name = 'Customer#' || lpad(CAST(number * 2 AS VARCHAR), 9, '0') AND otype = 'star'")
def d2_match_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.catalog(spark, sf_dir).where("otype = 'star'").select("name")
    j = _feat(spark, sf_dir).withColumn("name", F.concat(F.lit("Customer#"), F.lpad((F.col("number") * 2).cast("string"), 9, "0"))).join(c.withColumn("hit", F.lit(True)), "name", "left")
    hit = F.coalesce("hit", F.lit(False))
    return j.select("source_id", hit.alias("matched"), F.when(hit, F.col("name")).otherwise("").alias("names"), F.when(hit, F.length("name")).otherwise(0).cast("long").alias("n"))


@query(_with(D.PHOT, "m AS (SELECT source_id, median(mjd) AS mid FROM phot GROUP BY source_id)") + "SELECT observation_id, mjd - mid AS offset_days FROM phot JOIN m USING (source_id)", "offset_days")
def d3_own_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.phot(spark, sf_dir)
    return p.join(p.groupBy("source_id").agg(F.median("mjd").alias("mid")), "source_id").select("observation_id", (F.col("mjd") - F.col("mid")).alias("offset_days"))


@query("SELECT p_partkey, p_size, l.n AS n_lines FROM (SELECT * FROM part ORDER BY p_size DESC, p_partkey LIMIT 25) p LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey) l ON l_partkey = p_partkey")
def d4_ephemeris_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = D.table(spark, sf_dir, "part").orderBy(F.desc("p_size"), "p_partkey").limit(25).select("p_partkey", "p_size")
    table = D.table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n_lines"))
    return top.join(table, "p_partkey", "left")


@query(
    _with(D.PHOT, _FEAT)
    + "SELECT lower(source_id) AS entity, amp AS detector, sigma AS pipeline, bright AS anomaly FROM feat WHERE number % 2 = 0 AND number % 3 < 2 AND n_detections > 0",
    "detector pipeline anomaly",
)
def d5_three_way_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _feat(spark, sf_dir).withColumn("entity", F.lower("source_id"))
    detector = f.where("number % 2 = 0").select("entity", F.col("amp").alias("detector"))
    pipeline = f.where("number % 3 < 2").select("entity", F.col("sigma").alias("pipeline"))
    return detector.join(pipeline, "entity").join(f.where("n_detections > 0").select("entity", F.col("bright").alias("anomaly")), "entity")


@query(
    _with(D.PHOT, _FEAT, "h AS (SELECT source_id, max(abs(flux - k)) FILTER (k < 30) AS e3, max(abs(flux - k)) FILTER (k >= 30) AS e7 FROM phot GROUP BY source_id)")
    + "SELECT source_id, greatest(e3, e7) AS priority FROM feat JOIN h USING (source_id) WHERE n_detections >= 10", "priority",
)
def d6_forecast_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.phot(spark, sf_dir).withColumn("horizon", F.when(F.col("k") < 30, 3.0).otherwise(7.0))
    errors = p.groupBy("source_id", "horizon").agg(F.max(F.abs(F.col("flux") - F.col("k"))).alias("e")).groupBy("source_id").agg(F.collect_list("e").alias("errors"))
    return _feat(spark, sf_dir).where("n_detections >= 10").join(errors, "source_id").select("source_id", F.array_max("errors").alias("priority"))


@query("SELECT o_orderkey, o_custkey, c_name, coalesce(c_name, 'alias of ' || CAST(o_custkey // 2 AS VARCHAR)) AS known_as, c_name IS NOT NULL AS by_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 12) ON c_custkey = o_custkey WHERE o_orderstatus = 'P'")
def d10_two_stage_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
    named = D.table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    exact = o.join(named, "o_custkey", "left")
    second = F.concat(F.lit("alias of "), F.floor(F.col("o_custkey") / 2).cast("string"))
    return exact.select("o_orderkey", "o_custkey", "c_name", F.coalesce("c_name", second).alias("known_as"), F.col("c_name").isNotNull().alias("by_name"))


@query(
    _with(D.REVIEWS, "cur AS (SELECT candidate, arg_max(version, (day, review_id)) AS version FROM reviews GROUP BY candidate)")
    + "SELECT candidate, cur.version, count(review_id) AS n_reviews, count(*) FILTER (verdict = 'approve') AS n_approve FROM cur LEFT JOIN (SELECT * FROM reviews WHERE role = 'screener') r USING (candidate, version) GROUP BY ALL"
)
def d18_version_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.reviews(spark, sf_dir)
    j = review.current_versions(r).join(r.where("role = 'screener'"), ["candidate", "version"], "left")
    return j.groupBy("candidate", "version").agg(F.count("review_id").alias("n_reviews"), F.count_if(F.col("verdict") == "approve").alias("n_approve"))


@query(
    _with(D.REVIEWS, "enrolled AS (SELECT candidate, version, min(day) AS day FROM reviews WHERE role = 'screener' GROUP BY ALL)")
    + """SELECT e.candidate, e.version, count(r.review_id) AS n_outcomes, arg_max(r.verdict, r.review_id) AS label, CASE WHEN count(r.review_id) = 0 THEN 'pending' ELSE 'matured' END AS status
         FROM enrolled e LEFT JOIN (SELECT * FROM reviews WHERE role = 'reviewer') r ON r.candidate = e.candidate AND r.version = e.version AND r.day <= e.day + 400 GROUP BY ALL"""
)
def d20_matured_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.reviews(spark, sf_dir)
    e = r.where("role = 'screener'").groupBy("candidate", "version").agg(F.min("day").alias("enrolled"))
    o = r.where("role = 'reviewer'").select("candidate", "version", "day", "review_id", "verdict")
    j = e.join(o, ["candidate", "version"], "left").withColumn("ok", F.col("day") <= F.col("enrolled") + 400)
    g = j.groupBy("candidate", "version").agg(F.count_if("ok").alias("n_outcomes"), F.max_by(F.when(F.col("ok"), F.col("verdict")), F.when(F.col("ok"), F.col("review_id"))).alias("label"))
    return g.withColumn("status", F.when(F.col("n_outcomes") == 0, "pending").otherwise("matured"))


@query(
    _with(D.PHOT, "c AS (SELECT source_id, band, sum(k) AS p FROM phot GROUP BY ALL)")
    + "SELECT source_id, arg_max(band, (p, band)) FILTER (band IN ('click', 'error', 'view')) AS top_transient, arg_max(band, (p, band)) FILTER (band IN ('purchase', 'signup')) AS top_stamp FROM c GROUP BY source_id"
)
def d22_top_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.phot(spark, sf_dir).groupBy("source_id", "band").agg(F.sum("k").alias("p"))
    best = lambda *names: F.max_by(F.when(F.col("band").isin(*names), F.col("band")), F.when(F.col("band").isin(*names), F.struct("p", "band")))
    return c.groupBy("source_id").agg(best("click", "error", "view").alias("top_transient"), best("purchase", "signup").alias("top_stamp"))


@query(
    _with(D.PHOT) + "SELECT CAST(source_id AS BIGINT) // 3 AS entity, ['a', 'b'][CAST(source_id AS BIGINT) // 3 % 2 + 1] AS population, count(DISTINCT source_id) AS n_aliases, count(*) AS n_rows FROM phot GROUP BY ALL"
)
def d23_alias_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.phot(spark, sf_dir)
    entity = F.floor(F.col("source_id").cast("bigint") / 3)
    members = p.select("source_id").distinct().select("source_id", entity.alias("entity"), F.when(entity % 2 == 0, "a").otherwise("b").alias("population"))
    return p.join(members, "source_id").groupBy("entity", "population").agg(F.count_distinct("source_id").alias("n_aliases"), F.count("*").alias("n_rows"))


@query(_with(D.REVIEWS) + "SELECT verdict, count(*) AS n FROM reviews WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = candidate AND c_nationkey % 7 = reviewer) GROUP BY verdict")
def d24_authenticated(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate"), (F.col("c_nationkey") % 7).alias("reviewer"))
    return D.reviews(spark, sf_dir).join(keys, ["candidate", "reviewer"], "left_semi").groupBy("verdict").agg(F.count("*").alias("n"))


# ---- aggregations, orders and sets


@query(_with(D.PHOT) + "SELECT source_id, count(DISTINCT CASE WHEN magnitude < 21.5e0 OR flux / flux_error > 30 THEN event_id END) AS n_significant FROM phot GROUP BY source_id")
def e8_significant_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.phot(spark, sf_dir)
    hits = p.where("magnitude < 21.5").select("source_id", "event_id").unionByName(p.where("flux / flux_error > 30").select("source_id", "event_id"))
    per = hits.groupBy("source_id").agg(F.count_distinct("event_id").alias("n_significant"))
    return p.select("source_id").distinct().join(per, "source_id", "left").na.fill(0, ["n_significant"])


@query(_with(D.PHOT) + "SELECT count(*) AS n_rows, count(DISTINCT source_id) AS n_sources, count(DISTINCT survey || band) AS n_channels, count(*) FILTER (is_detection) AS n_detections, count(*) FILTER (NOT quality) AS n_rejected FROM phot")
def e14_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.phot(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.count_distinct("source_id").alias("n_sources"), F.count_distinct(F.concat("survey", "band")).alias("n_channels"), F.count_if("is_detection").alias("n_detections"), F.count_if(~F.col("quality")).alias("n_rejected"))


@query(
    _with(D.PHOT, "f AS (SELECT * FROM phot WHERE band = 'error')", "fixed AS (SELECT source_id, max(mjd) AS solved FROM phot WHERE band = 'signup' GROUP BY source_id)")
    + """SELECT (SELECT count(*) FROM phot) AS n_events, (SELECT count(*) FROM f) AS n_failures, (SELECT count(*) FROM f LEFT JOIN fixed USING (source_id) WHERE solved IS NULL OR solved <= mjd) AS n_unresolved,
         (SELECT count(*) FROM f WHERE k % 10 = 0) AS n_drift"""
)
def e28_health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.phot(spark, sf_dir)
    fixed = p.where("band = 'signup'").groupBy("source_id").agg(F.max("mjd").alias("at"))
    failed = F.col("band") == "error"
    j = p.join(fixed, "source_id", "left")
    unresolved = failed & F.coalesce(F.col("at") <= F.col("mjd"), F.lit(True))
    return j.agg(F.count("*").alias("n_events"), F.count_if(failed).alias("n_failures"), F.count_if(unresolved).alias("n_unresolved"), F.count_if(failed & (F.col("k") % 10 == 0)).alias("n_drift"))


@query(
    _with(
        D.PHOT, "sp AS (SELECT source_id AS object, k AS nu, avg(flux) AS flux FROM phot GROUP BY ALL)", "tr AS (SELECT band, k AS nu, avg(flux_error) * (k % 7) AS response FROM phot GROUP BY band, k)",
        "j AS (SELECT object, band, nu, flux, response, lead(nu) OVER w - nu AS d, lead(response) OVER w AS r2, lead(flux) OVER w AS f2 FROM sp JOIN tr USING (nu) WINDOW w AS (PARTITION BY object, band ORDER BY nu))",
    )
    + "SELECT object, band, count(*) AS n, CASE WHEN sum(d * (response + r2) / 2) > 0 THEN sum(d * (flux * response + f2 * r2) / 2) / sum(d * (response + r2) / 2) END AS mean_flux FROM j GROUP BY ALL",
    "mean_flux",
)
def e31_band_mean_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.phot(spark, sf_dir)
    spectra = p.groupBy(F.col("source_id").alias("object"), F.col("k").alias("nu")).agg(F.avg("flux").alias("flux"))
    transmission = p.groupBy("band", F.col("k").alias("nu")).agg(F.avg("flux_error").alias("e")).select("band", "nu", (F.col("e") * (F.col("nu") % 7)).alias("response"))
    return scores.band_mean_flux(spectra, transmission)


@query(
    """SELECT p_brand, p_type, n, mean, mean - t * sd / sqrt(n) AS low, mean + t * sd / sqrt(n) AS high FROM (
         SELECT *, CASE WHEN n > 120 THEN 1.98e0 WHEN n > 60 THEN 2e0 WHEN n > 30 THEN 2.042e0 WHEN n > 20 THEN 2.086e0 WHEN n > 15 THEN 2.131e0 WHEN n > 10 THEN 2.228e0 WHEN n > 1 THEN [12.706e0, 4.303e0, 3.182e0, 2.776e0, 2.571e0, 2.447e0, 2.365e0, 2.306e0, 2.262e0][n - 1] END AS t
         FROM (SELECT p_brand, p_type, count(p_retailprice) AS n, avg(p_retailprice) AS mean, stddev_samp(p_retailprice) AS sd FROM part GROUP BY ALL))""",
    "mean low high",
)
def e35_repeat_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.t_interval(D.table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_retailprice")


@query(_with(D.PHOT, _FEAT) + "SELECT source_id, row_number() OVER (ORDER BY n_detections DESC, source_id) AS place FROM feat ORDER BY place LIMIT 50")
def f6_final_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _feat(spark, sf_dir).orderBy(F.desc("n_detections"), "source_id").limit(50)
    return top.select("source_id", F.row_number().over(Window.orderBy(F.desc("n_detections"), "source_id")).cast("long").alias("place"))


@query(_with(D.PHOT) + "SELECT source_id, kind, count(*) AS n, count(magnitude) AS n_magnitude, count(limit_) AS n_limit FROM (SELECT source_id, 'detection' AS kind, magnitude, NULL AS limit_ FROM phot WHERE is_detection UNION ALL SELECT source_id, 'limit', NULL, limiting_magnitude FROM phot WHERE NOT is_detection) GROUP BY ALL")
def g1_heterogeneous_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.phot(spark, sf_dir)
    a, b = p.where("is_detection").select("source_id", F.lit("detection").alias("kind"), "magnitude"), p.where("not is_detection").select("source_id", F.lit("limit").alias("kind"), F.col("limiting_magnitude").alias("limit_"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("source_id", "kind").agg(F.count("*").alias("n"), F.count("magnitude").alias("n_magnitude"), F.count("limit_").alias("n_limit"))


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) WHERE i = 1")
def g4_first_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"), F.min_by("o_orderpriority", "o_orderkey").alias("o_orderpriority"))


@query(
    _with(D.REVIEWS, "l AS (SELECT candidate, arg_max(verdict, review_id) FILTER (role = 'reviewer') AS v FROM reviews GROUP BY candidate)")
    + """SELECT policy, candidate, CASE WHEN v = 'approve' THEN 1 WHEN v IS NOT NULL OR policy = 'count_as_negative' THEN 0 END AS label FROM l, (SELECT unnest(['count_as_negative', 'exclude']) AS policy) WHERE v IS NOT NULL OR policy = 'count_as_negative'"""
)
def h15_matured_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_r = F.col("role") == "reviewer"
    latest = D.reviews(spark, sf_dir).groupBy("candidate").agg(F.max_by(F.when(is_r, F.col("verdict")), F.when(is_r, F.col("review_id"))).alias("v"))
    label = F.when(F.col("v") == "approve", 1).otherwise(0).alias("label")
    both = [latest.select(F.lit("count_as_negative").alias("policy"), "candidate", label), latest.where("v is not null").select(F.lit("exclude").alias("policy"), "candidate", label)]
    return both[0].union(both[1])


@query(
    _with(D.PHOT, D.ASOF)
    + """SELECT observation_id, CASE WHEN r <> '' THEN 'excluded' WHEN observed_at_mjd <= 60315 THEN 'train' WHEN observed_at_mjd <= 60320 THEN 'validation' ELSE 'test' END AS part, r AS reasons FROM (
           SELECT *, concat_ws(',', CASE WHEN observed_at_mjd <= 60315 AND available_at_mjd > 60315 THEN 'late_for_training' END, CASE WHEN observed_at_mjd > 60315 AND observed_at_mjd <= 60320 AND available_at_mjd > 60320 THEN 'late_for_validation' END, CASE WHEN value IS NULL THEN 'no_value' END) AS r FROM asof_rows)"""
)
def h6_asof_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen, there = F.col("observed_at_mjd"), F.col("available_at_mjd")
    reasons = F.array(F.when((seen <= 60315) & (there > 60315), "late_for_training"), F.when((seen > 60315) & (seen <= 60320) & (there > 60320), "late_for_validation"), F.when(F.col("value").isNull(), "no_value"))
    r = D.asof(spark, sf_dir).withColumn("reasons", F.concat_ws(",", F.array_compact(reasons)))
    part = F.when(F.col("reasons") != "", "excluded").when(seen <= 60315, "train").when(seen <= 60320, "validation").otherwise("test")
    return r.select("observation_id", part.alias("part"), "reasons")


# ---- versioned tables


@query(_with(D.REVIEWS) + "SELECT candidate, version, count(*) AS n FROM reviews WHERE verdict <> 'defer' GROUP BY ALL")
def k2_batch_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of decisions; one is tried again, and one that repeats a decision is refused as a whole."""
    book = ledger.Decisions(spark, Scratch(spark, "ledger").root)
    r = D.reviews(spark, sf_dir).where("verdict <> 'defer'").select(*(F.col(c).cast("string").alias(n) for n, c in (("decision_id", "review_id"), ("candidate", "candidate"), ("version", "version"), ("reviewer", "reviewer"), ("verdict", "verdict"))))
    for odd in (0, 1, 0):
        book.publish(f"odd{odd}", r.where(f"cast(candidate as long) % 2 = {odd}"))
    try:
        book.publish("again", r.limit(1).unionByName(r.limit(1)))
    except ledger.Refused:
        return book.rows().groupBy(F.col("candidate").cast("long").alias("candidate"), "version").agg(F.count("*").alias("n"))
    raise AssertionError("a batch with a repeated decision was published")


@query(
    _with(D.REVIEWS, "f AS (SELECT candidate, version, day, review_id, row_number() OVER (PARTITION BY candidate ORDER BY day, review_id) AS i FROM reviews WHERE role = 'screener' AND day BETWEEN 9500 AND 10500)")
    + "SELECT candidate, version, day, review_id FROM f WHERE i = 1"
)
def k5_cohort_enrolment(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "cohort")
    path = f"{scratch.root}/enrolled"
    window = D.reviews(spark, sf_dir).where("role = 'screener' and day between 9500 and 10500")
    first = window.groupBy("candidate").agg(F.min(F.struct("day", "review_id", "version")).alias("x")).select("candidate", "x.version", "x.day", "x.review_id")
    first.where("candidate % 3 > 0").write.parquet(path)
    # the second run retries everything: entities enrolled already add nothing
    held = spark.read.parquet(path).select("candidate")
    first.join(held, "candidate", "left_anti").write.parquet(f"{path}-2")
    return spark.read.parquet(path, f"{path}-2")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 97 = 5")
def k6_digest_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumisift.functions.scalars import digest

    names = ("o_orderkey", "o_custkey", "o_orderstatus")
    o = D.table(spark, sf_dir, "orders").select(*names, digest(*names).alias("stored"))
    changed = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 97 == 5, F.concat("o_orderstatus", F.lit("x"))).otherwise(F.col("o_orderstatus")))
    return changed.where(F.col("stored") != digest(*names)).select("o_orderkey")


@query(
    _with(
        D.PHOT, "snap AS (SELECT band AS stream, CAST(floor(mjd) AS BIGINT) AS snapshot_id, max(mjd) AS watermark FROM phot GROUP BY ALL)",
        "old AS (SELECT stream, max(snapshot_id) AS last_old FROM snap WHERE snapshot_id <= 60320 GROUP BY stream)",
    )
    + """SELECT stream, max(watermark) AS watermark, max(snapshot_id) AS snapshot_id, count(*) AS n_accepted, count(*) FILTER (snapshot_id % 5 = 0 AND snapshot_id < last_old) AS n_refused FROM snap LEFT JOIN old USING (stream) GROUP BY stream""",
    "watermark",
)
def l2_stream_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors over two runs against one checkpoint: daily snapshots, of which the second run brings some old ones again."""
    snap = D.phot(spark, sf_dir).groupBy(F.col("band").alias("stream"), F.floor("mjd").alias("snapshot_id")).agg(F.max("mjd").alias("watermark"))
    root, schema = Scratch(spark, "cursor").root, "stream string, snapshot_id long, watermark double"
    for n, where in enumerate(("snapshot_id <= 60320", "snapshot_id > 60320 or snapshot_id % 5 = 0")):
        snap.where(where).select("stream", "snapshot_id", "watermark").write.parquet(f"{root}/in/run={n}")
        letters.run(spark, f"{root}/in", schema, "stream", letters.Cursors, letters.CURSOR, root)
    return letters.latest(spark, letters.CURSOR, "stream", root)


@query("SELECT doc_id FROM documents WHERE doc_id % 89 = 7 AND text IS NOT NULL")
def l4_replay_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "archive")
    d = D.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("payload"))
    stored = scratch.table(d.withColumn("digest", F.sha2("payload", 256)), "stored")
    damaged = stored.withColumn("payload", F.when(F.col("doc_id") % 89 == 7, F.concat("payload", F.lit("!").cast("binary"))).otherwise(F.col("payload")))
    return damaged.where(F.sha2("payload", 256) != F.col("digest")).select("doc_id")


@query(
    _with(D.PHOT, "o AS (SELECT source_id, mjd AS opened, event_id FROM phot WHERE band = 'error')")
    + """SELECT event_id, (SELECT min(mjd) FROM phot p WHERE p.source_id = o.source_id AND p.band = 'signup' AND p.mjd > o.opened) - opened AS days_open FROM o""",
    "days_open",
)
def l7_incident_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the next resolution of the source after each incident: one shuffle, one ordered pass from the end
    w = Window.partitionBy("source_id").orderBy(F.desc("mjd")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    p = D.phot(spark, sf_dir).where(F.col("band").isin("error", "signup"))
    after = F.last(F.when(F.col("band") == "signup", F.col("mjd")), ignorenulls=True).over(w)
    return p.withColumn("fixed", after).where("band = 'error'").select("event_id", (F.col("fixed") - F.col("mjd")).alias("days_open"))




@query(
    _with(D.PHOT, "c AS (SELECT band, max(event_id) AS cursor FROM phot WHERE k < 50 GROUP BY band)")
    + """SELECT stream, reason, count(*) AS n FROM (SELECT band AS stream, CASE WHEN k < 50 OR event_id > coalesce(cursor, -1) THEN 'accepted' ELSE 'watermark_went_back' END AS reason FROM phot LEFT JOIN c USING (band)) GROUP BY ALL"""
)
def l1_snapshot_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = stores.Store(spark, Scratch(spark, "snapshots").root)
    rows = D.phot(spark, sf_dir).select(F.col("band").alias("stream"), F.col("event_id").alias("snapshot_id"), F.col("event_id").cast("double").alias("watermark"), "k")
    for batch in (rows.where("k < 50"), rows.where("k < 50"), rows):
        stores.append_snapshots(store, batch)
    good = store.read("snapshots", stores.SNAPSHOT).select("stream", F.lit("accepted").alias("reason"))
    bad = store.read("diverted", stores.SNAPSHOT + ", reason string").select("stream", "snapshot_id", "reason").distinct().select("stream", "reason")
    return good.union(bad).groupBy("stream", "reason").agg(F.count("*").alias("n"))


@query(_with(D.PHOT) + "SELECT band AS event_type, count(*) FILTER (event_id % 10 > 0) AS n_match, count(*) FILTER (event_id % 10 = 0) AS n_drift FROM phot GROUP BY band")
def l5_schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every tenth event the payload is given another field."""
    payload = F.when(F.col("event_id") % 10 == 0, F.regexp_replace("props", r"\}$", ',"extra":1}')).otherwise(F.col("props"))
    return archive.schema_drift(archive.events_stream(spark, sf_dir).withColumn("payload", payload), "event_type", "payload", ["k"])


@query(_with(D.PHOT) + "SELECT event_id % 11 = 0 AS poisoned, count(*) AS n, sum(CASE WHEN event_id % 11 > 0 THEN flux END) AS total FROM phot GROUP BY ALL", "total")
def l8_cadence_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = stores.Store(spark, Scratch(spark, "cadence").root)
    rows = D.phot(spark, sf_dir).select(F.col("event_id").alias("row_id"), F.col("flux").alias("value"))
    for batch in (rows, rows, rows.where("row_id % 11 = 0").withColumn("value", F.col("value") + 1), rows):
        stores.append_cadence(store, batch)
    return stores.cadence_view(store).groupBy("poisoned").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
