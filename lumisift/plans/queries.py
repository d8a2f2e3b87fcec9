"""Queries over the derived views, each with the SQL that says the same where SQL can."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.functions import scalars as S
from lumisift.operators import crossmatch, curves, decisions, evaluation, neighbours, review, search, tables, temporal
from lumisift.plans.scratch import Scratch
from lumisift.sources import derived as D
from lumisift.streaming import archive, ledger, letters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CUTS = "cutoffs AS (SELECT entity_id, min(observed_at_mjd) + unnest([5e0, 15e0]) AS cutoff FROM asof_rows GROUP BY entity_id)"
HORIZONS = [3.0, 7.0]
#: Double columns of each query, rounded to six decimals at the very end on both sides.
DOUBLES = {
    "h4_training_vocabulary": "term",
    "j7_class_and_rank": "rank_score",
    "j8_blended_score": "blended",
    "d15_host_association": "separation chance",
    "e29_robust_fit": "centre scale",
    "h10_robust_anomaly": "observed_fraction score",
    "e30_trace_summary": "maximum q95 area first_crossing",
    "e1_channel_features": "first_time last_time span_days median_cadence_days median scatter p90_p10 peak peak_time brightening contrast relative_flux peak_significance rise_slope fade_slope rise_rate fade_rate median_error missing_error_fraction",
    "e7_source_features": "first_time last_time magnitude_error_missing flux_error_missing error_missing band_missing quality_rejected rejected_detections median_p90_p10 max_p90_p10 max_brightening max_relative_flux max_peak_significance median_peak_significance median_scatter max_rise_rate max_fade_rate max_span_days median_excursion max_excursion max_flux_significance max_flux_rise_rate max_flux_fade_rate prior_gap_days prior_contrast_mag prior_flux_contrast max_prior_snr baseline_days max_significance",
    "e2_flux_features": "first_time last_time span_days median_cadence_days median scatter p90_p10 peak peak_time contrast scale excursion peak_significance rise_rate fade_rate median_error missing_error_fraction",
    "e3_significant_points": "peak_significance",
    "e5_weighted_slope": "slope",
    "e12_flare_features": "duration amplitude slope rising_fraction",
    "e13_centroid": "ra_deg dec_deg",
    "d11_prior_nondetection": "gap_days contrast_mag prior_snr flux_contrast",
    "b9_photometric_scores": "flux_ujy error_ujy saturated squashed logscore",
    "c3_position_spread": "spread",
    "d8_nearest_match": "separation",
    "d16_nearest_neighbours": "similarity",
    "d12_prefix_join": "cutoff latest",
    "d13_target_join": "cutoff horizon first",
    "e32_prefix_normalisation": "cutoff centre scale",
    "e34_forecast_error": "horizon mae_last mae_line mae_parabola",
    "h5_complete_horizons": "cutoff",
    "f9_sequence_tokens": "step token",
    "e16_ranking_metrics": "average_precision precision_at_budget recall_at_budget",
    "e19_calibration": "brier ece",
    "e20_rolling_origin": "average_precision precision_at_budget recall_at_budget",
    "e24_wilson_interval": "low high",
    "f1_review_queue": "priority anomaly propensity",
    "e21_bootstrap": "mean_recall low high mean_delta delta_low delta_high", "e22_paired_bootstrap": "mean_recall low high mean_delta delta_low delta_high", "i11_injection_recovery": "fraction low high median_z",
    "d21_overlap_reconciliation": "mjd flux",
}


def query(sql: str | None = None, doubles: str = ""):
    """Register a function under its name, with its SQL and the names of its double columns."""
    of_query = doubles

    def add(f):
        doubles = (of_query or DOUBLES.get(f.__name__, "")).split()

        @functools.wraps(f)
        def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            kinds = dict(out.dtypes)
            return out.withColumns({c: S.rounded(F.col(c)) if kinds[c] == "double" else F.round(c, 6) for c in doubles})

        QUERIES[f.__name__] = rounded
        if sql:
            ORACLE[f.__name__] = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in doubles)}) FROM ({sql})" if doubles else sql
        return rounded

    return add


def _with(*views: str) -> str:
    return "WITH " + ", ".join(views) + " "


def _cutoffs(rows: DataFrame) -> DataFrame:
    first = rows.groupBy("entity_id").agg(F.min("observed_at_mjd").alias("t"))
    return first.select("entity_id", "t", F.explode(F.array(F.lit(5.0), F.lit(15.0))).alias("d")).select("entity_id", (F.col("t") + F.col("d")).alias("cutoff"))


# ---- features of light curves


_SEP = "degrees(2 * asin(sqrt(least(1e0, pow(sin(radians({d2} - {d1}) / 2), 2) + cos(radians({d1})) * cos(radians({d2})) * pow(sin(radians({r2} - {r1}) / 2), 2))))) * 3600"
_C = "source_id, survey, band"


def _channel_sql(p: str, rows: str, x: str, e: str, sign: int) -> str:
    """Views ending in ``{p}_channels``: all features of a channel, by generic statements over y, which grows with brightness."""
    same = "a.source_id = b.source_id AND a.survey = b.survey AND a.band = b.band"
    slope = lambda name, side: f"""{p}_{name}_c AS (SELECT v.*, CASE WHEN min(CASE WHEN e > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {_C}) = 1 THEN 1 / (e * e) ELSE 1e0 END AS w
        FROM {p}_v v JOIN {p}_pk USING ({_C}) WHERE mjd {side} tp),
      {p}_{name}_m AS (SELECT *, sum(w * mjd) OVER c / sum(w) OVER c AS mt, sum(w * x) OVER c / sum(w) OVER c AS mx FROM {p}_{name}_c WINDOW c AS (PARTITION BY {_C})),
      {p}_{name} AS (SELECT {_C}, CASE WHEN max(mjd) - min(mjd) >= 1e-3 THEN sum(w * (mjd - mt) * (x - mx)) / nullif(sum(w * (mjd - mt) * (mjd - mt)), 0) END AS {name}_slope FROM {p}_{name}_m GROUP BY ALL)"""  # noqa: E731
    return f"""
  {p}_v AS (SELECT {_C}, row_number() OVER () AS id, mjd, {x} AS x, {sign} * {x} AS y, {e} AS e FROM {rows} WHERE {x} IS NOT NULL),
  {p}_mid AS (SELECT *, median(x) OVER (PARTITION BY {_C}) AS mid FROM {p}_v),
  {p}_gaps AS (SELECT {_C}, median(gap) AS median_cadence_days FROM (
    SELECT {_C}, mjd - lag(mjd) OVER (PARTITION BY {_C} ORDER BY mjd) AS gap FROM (SELECT DISTINCT {_C}, mjd FROM {p}_v)) GROUP BY ALL),
  {p}_base AS (SELECT {_C}, count(*) AS n, min(mjd) AS first_time, max(mjd) AS last_time, max(mjd) - min(mjd) AS span_days, min(mid) AS median, CASE WHEN count(*) < 2 THEN 0e0 ELSE 1.4826e0 * median(abs(x - mid)) END AS scatter,
    greatest(0e0, quantile_cont(x, 0.9) - quantile_cont(x, 0.1)) AS p90_p10, greatest(0e0, max(y) - {sign} * min(mid)) AS brightening, median(e) AS median_error, avg(CASE WHEN e IS NULL THEN 1e0 ELSE 0e0 END) AS missing_error_fraction FROM {p}_mid GROUP BY ALL),
  {p}_pk AS (SELECT {_C}, id AS pid, x AS peak, mjd AS tp FROM {p}_v QUALIFY row_number() OVER (PARTITION BY {_C} ORDER BY y DESC, mjd, e NULLS LAST) = 1),
  {p}_o AS (SELECT a.id, any_value(a.{_C.replace(", ", "), any_value(a.")}), any_value(a.y) AS y, any_value(a.e) AS e, median(b.y) AS mid, median(b.e) / sqrt(count(*)) AS be, count(*) FILTER (b.e > 0) = count(*) AND any_value(a.e) > 0 AS ok
    FROM {p}_v a JOIN {p}_v b ON {same} AND a.id <> b.id GROUP BY a.id),
  {p}_z AS (SELECT a.id, any_value(a.y) - any_value(a.mid) AS contrast, CASE WHEN any_value(a.ok) THEN (any_value(a.y) - any_value(a.mid)) / sqrt(pow(any_value(a.e), 2) + pow(CASE WHEN count(*) < 2 THEN 0e0 ELSE 1.4826e0 * median(abs(b.y - a.mid)) END, 2) + pow(any_value(a.be), 2)) END AS z
    FROM (SELECT o.*, v.source_id, v.survey, v.band FROM (SELECT id, y, e, mid, be, ok FROM {p}_o) o JOIN {p}_v v USING (id)) a JOIN {p}_v b ON {same} AND a.id <> b.id GROUP BY a.id),
  {p}_s AS (SELECT {_C}, greatest(0e0, max(CASE WHEN id = pid THEN contrast END)) AS contrast, max(CASE WHEN id = pid THEN z END) AS zp, count(*) FILTER (z >= 3) AS n_significant FROM {p}_v JOIN {p}_z USING (id) JOIN {p}_pk USING ({_C}) GROUP BY ALL),
  {slope("rise", "<=")}, {slope("fade", ">=")},
  {p}_all AS (SELECT {p}_base.*, median_cadence_days, peak, tp AS peak_time, coalesce(contrast, 0e0) AS contrast, greatest(0e0, zp) AS peak_significance, coalesce(n_significant, 0) AS n_significant, rise_slope, fade_slope,
    CASE WHEN greatest(abs(median), scatter, coalesce(median_error, 0)) > 0 THEN greatest(abs(median), scatter, coalesce(median_error, 0)) ELSE 1e0 END AS scale
    FROM {p}_base JOIN {p}_gaps USING ({_C}) JOIN {p}_pk USING ({_C}) LEFT JOIN {p}_s USING ({_C}) JOIN {p}_rise USING ({_C}) JOIN {p}_fade USING ({_C})),
  {p}_channels AS (SELECT {_C}, n, first_time, last_time, span_days, median_cadence_days, median, scatter, p90_p10, peak, peak_time, contrast, peak_significance, n_significant, median_error, missing_error_fraction, """ + (
        "brightening, pow(10, 0.4e0 * brightening) AS relative_flux, rise_slope, fade_slope, -rise_slope AS rise_rate, fade_slope AS fade_rate" if sign < 0
        else "scale, contrast / scale AS excursion, greatest(0e0, rise_slope / scale) AS rise_rate, greatest(0e0, -fade_slope / scale) AS fade_rate"
    ).replace("greatest(0e0, rise_slope / scale)", "CASE WHEN rise_slope IS NOT NULL THEN greatest(0e0, rise_slope / scale) END").replace("greatest(0e0, -fade_slope / scale)", "CASE WHEN fade_slope IS NOT NULL THEN greatest(0e0, -fade_slope / scale) END") + f" FROM {p}_all)"


@query(_with(D.PHOT, _channel_sql("m", "phot", "magnitude", "magnitude_error", -1)) + "SELECT * FROM m_channels")
def e1_channel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.channel_features(D.phot(spark, sf_dir))


@query(_with(D.PHOT, _channel_sql("f", "phot", "flux", "flux_error", 1)) + "SELECT * FROM f_channels")
def e2_flux_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.channel_features(D.phot(spark, sf_dir), "flux", "flux_error", bright_is_low=False)


_SOURCE_SQL = (
    "usable AS (SELECT * FROM phot WHERE quality AND is_detection), "
    + _channel_sql("m", "usable", "magnitude", "magnitude_error", -1) + ", " + _channel_sql("f", "usable", "flux", "flux_error", 1)
    + """,
  counts AS (SELECT source_id, count(*) AS n_observations, count(*) FILTER (is_detection) AS n_detections_raw, count(*) FILTER (is_detection AND quality) AS n_detections, count(*) FILTER (NOT is_detection) AS n_nondetections_raw,
    count(*) FILTER (NOT is_detection AND quality) AS n_nondetections, count(*) FILTER (NOT is_detection AND quality AND limiting_magnitude IS NOT NULL) AS n_with_limit, count(*) FILTER (NOT is_detection AND quality AND flux IS NOT NULL) AS n_with_forced_flux,
    count(DISTINCT band) FILTER (is_detection AND quality) AS n_bands, min(mjd) FILTER (is_detection AND quality) AS first_time, max(mjd) FILTER (is_detection AND quality) AS last_time,
    coalesce(count(*) FILTER (is_detection AND magnitude IS NOT NULL AND NOT coalesce(magnitude_error > 0, FALSE)) / CAST(nullif(count(*) FILTER (is_detection AND magnitude IS NOT NULL), 0) AS DOUBLE), 0e0) AS magnitude_error_missing,
    coalesce(count(*) FILTER (is_detection AND flux IS NOT NULL AND NOT coalesce(flux_error > 0, FALSE)) / CAST(nullif(count(*) FILTER (is_detection AND flux IS NOT NULL), 0) AS DOUBLE), 0e0) AS flux_error_missing,
    coalesce(count(*) FILTER (is_detection AND NOT coalesce(magnitude_error > 0, FALSE) AND NOT coalesce(flux_error > 0, FALSE)) / CAST(nullif(count(*) FILTER (is_detection), 0) AS DOUBLE), 0e0) AS error_missing,
    avg(CASE WHEN band IS NULL THEN 1e0 ELSE 0e0 END) AS band_missing, avg(CASE WHEN quality THEN 0e0 ELSE 1e0 END) AS quality_rejected,
    coalesce(count(*) FILTER (is_detection AND NOT quality) / CAST(nullif(count(*) FILTER (is_detection), 0) AS DOUBLE), 0e0) AS rejected_detections FROM phot GROUP BY source_id),
  by_mag AS (SELECT source_id, count(*) AS n_channels, median(p90_p10) AS median_p90_p10, max(p90_p10) AS max_p90_p10, max(brightening) AS max_brightening, max(relative_flux) AS max_relative_flux, max(peak_significance) AS max_peak_significance,
    median(peak_significance) AS median_peak_significance, sum(n_significant) AS n_significant, median(scatter) AS median_scatter, max(n) AS max_channel_detections, max(greatest(0e0, rise_rate)) AS max_rise_rate, max(greatest(0e0, fade_rate)) AS max_fade_rate,
    max(span_days) AS max_span_days FROM m_channels GROUP BY source_id),
  by_flux AS (SELECT source_id, median(excursion) AS median_excursion, max(excursion) AS max_excursion, max(peak_significance) AS max_flux_significance, sum(n_significant) AS n_significant_flux, max(rise_rate) AS max_flux_rise_rate, max(fade_rate) AS max_flux_fade_rate
    FROM f_channels GROUP BY source_id),
  firsts AS (SELECT source_id, survey, band, min(mjd) AS t1, arg_min(magnitude, (mjd, magnitude)) AS m1, arg_min(flux, (mjd, magnitude)) AS f1, arg_min(flux_error, (mjd, magnitude)) AS e1 FROM usable GROUP BY ALL),
  lasts AS (SELECT source_id, survey, band, max(mjd) AS t0, arg_max(limiting_magnitude, (mjd, limiting_magnitude)) AS l0, arg_max(flux, (mjd, limiting_magnitude)) AS f0, arg_max(flux_error, (mjd, limiting_magnitude)) AS e0
    FROM phot JOIN firsts USING (source_id, survey, band) WHERE quality AND NOT is_detection AND mjd < t1 GROUP BY ALL),
  prior AS (SELECT source_id, count(*) AS n_channels_with_prior, min(t1 - t0) AS prior_gap_days, max(l0 - m1) AS prior_contrast_mag, max(greatest(0e0, (f1 - f0) / sqrt(e1 * e1 + e0 * e0))) AS prior_flux_contrast, max(abs(f0 / e0)) AS max_prior_snr
    FROM firsts JOIN lasts USING (source_id, survey, band) GROUP BY source_id),
  src AS (SELECT counts.*, coalesce(n_channels, 0) AS n_channels, coalesce(CAST(n_significant AS BIGINT), 0) AS n_significant, coalesce(CAST(n_significant_flux AS BIGINT), 0) AS n_significant_flux, coalesce(n_channels_with_prior, 0) AS n_channels_with_prior,
    coalesce(max_channel_detections, 0) AS max_channel_detections, by_mag.* EXCLUDE (source_id, n_channels, n_significant, max_channel_detections), by_flux.* EXCLUDE (source_id, n_significant_flux), prior.* EXCLUDE (source_id, n_channels_with_prior),
    last_time - first_time AS baseline_days, greatest(max_peak_significance, max_flux_significance) AS max_significance, coalesce(n_channels_with_prior, 0) > 0 AS has_prior, coalesce(prior_gap_days <= 7, FALSE) AS has_recent_prior
    FROM counts LEFT JOIN by_mag USING (source_id) LEFT JOIN by_flux USING (source_id) LEFT JOIN prior USING (source_id))"""
)


@query(_with(D.PHOT, _SOURCE_SQL) + "SELECT * FROM src")
def e7_source_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.source_features(D.phot(spark, sf_dir))


@query(
    _with(
        D.PHOT,
        "v AS (SELECT source_id, survey, band, event_id, mjd, magnitude AS x, magnitude_error AS e FROM phot WHERE magnitude IS NOT NULL)",
        """o AS (SELECT a.source_id, a.survey, a.band, a.event_id, any_value(a.x) AS x, any_value(a.e) AS e, median(b.x) AS mid, median(b.e) / sqrt(count(*)) AS be
                 FROM v a JOIN v b ON a.source_id = b.source_id AND a.survey = b.survey AND a.band = b.band AND a.event_id <> b.event_id GROUP BY ALL)""",
        """s AS (SELECT o.source_id, o.survey, o.band, o.event_id, any_value(o.x) AS x, (any_value(mid) - any_value(o.x)) /
                        sqrt(pow(any_value(o.e), 2) + pow(CASE WHEN count(*) < 2 THEN 0e0 ELSE 1.4826e0 * median(abs(b.x - o.mid)) END, 2) + pow(any_value(be), 2)) AS z
                 FROM o JOIN v b ON o.source_id = b.source_id AND o.survey = b.survey AND o.band = b.band AND o.event_id <> b.event_id GROUP BY ALL)""",
    )
    + """SELECT source_id, survey, band, count(*) AS n, count(*) FILTER (z >= 3) AS n_significant, greatest(0e0, arg_min(z, x)) AS peak_significance FROM s GROUP BY ALL
         UNION ALL SELECT source_id, survey, band, 1, 0, NULL FROM v GROUP BY ALL HAVING count(*) = 1"""
)
def e3_significant_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.significant_points(D.phot(spark, sf_dir))


@query(
    _with(
        D.PHOT,
        "v AS (SELECT source_id, survey, band, mjd AS t, magnitude AS x, 1 / pow(magnitude_error, 2) AS w FROM phot WHERE magnitude IS NOT NULL)",
        "m AS (SELECT *, sum(w * t) OVER c / sum(w) OVER c AS mt, sum(w * x) OVER c / sum(w) OVER c AS mx FROM v WINDOW c AS (PARTITION BY source_id, survey, band))",
    )
    + """SELECT source_id, survey, band, count(*) AS n, CASE WHEN min(t) < max(t) THEN sum(w * (t - mt) * (x - mx)) / nullif(sum(w * (t - mt) * (t - mt)), 0) END AS slope FROM m GROUP BY ALL"""
)
def e5_weighted_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.weighted_slope(D.phot(spark, sf_dir), curves.CHANNEL, "mjd", "magnitude", "magnitude_error")


@query(
    _with(D.PHOT, "v AS (SELECT *, magnitude - lag(magnitude) OVER (PARTITION BY source_id ORDER BY mjd, event_id) AS d FROM phot WHERE magnitude IS NOT NULL)")
    + """SELECT source_id, max(mjd) - min(mjd) AS duration, max(magnitude) - min(magnitude) AS amplitude, regr_slope(magnitude, mjd) AS slope,
         avg(CASE WHEN d < 0 THEN 1e0 WHEN d IS NOT NULL THEN 0e0 END) AS rising_fraction FROM v GROUP BY source_id"""
)
def e12_flare_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.flare_features(D.phot(spark, sf_dir))


@query(
    _with(D.PHOT, "m AS (SELECT band, avg(cos(radians(dec_deg)) * cos(radians(ra_deg))) AS x, avg(cos(radians(dec_deg)) * sin(radians(ra_deg))) AS y, avg(sin(radians(dec_deg))) AS z FROM phot GROUP BY band)")
    + "SELECT band, CASE WHEN degrees(atan2(y, x)) < 0 THEN degrees(atan2(y, x)) + 360 ELSE degrees(atan2(y, x)) END AS ra_deg, degrees(asin(z / sqrt(x * x + y * y + z * z))) AS dec_deg FROM m"
)
def e13_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.centroid(D.phot(spark, sf_dir), ["band"])


@query(
    _with(
        D.PHOT,
        "f AS (SELECT *, first_value(mjd) OVER w AS t0, first_value(magnitude) OVER w AS m0, first_value(flux) OVER w AS f0, first_value(flux_error) OVER w AS e0 FROM phot WHERE is_detection WINDOW w AS (PARTITION BY source_id, survey, band ORDER BY mjd, magnitude))",
        "first AS (SELECT DISTINCT source_id, survey, band, t0, m0, f0, e0 FROM f)",
        "j AS (SELECT p.*, t0, m0, f0, e0, row_number() OVER (PARTITION BY p.source_id, p.survey, p.band ORDER BY mjd DESC, limiting_magnitude DESC) AS i FROM phot p JOIN first USING (source_id, survey, band) WHERE NOT is_detection AND mjd < t0)",
    )
    + """SELECT source_id, survey, band, t0 - mjd AS gap_days, limiting_magnitude - m0 AS contrast_mag, abs(flux / flux_error) AS prior_snr,
         greatest(0e0, (f0 - flux) / sqrt(pow(e0, 2) + pow(flux_error, 2))) AS flux_contrast FROM j WHERE i = 1"""
)
def d11_prior_nondetection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.prior_nondetection(D.phot(spark, sf_dir))


# ---- expressions and row checks


@query(
    _with(D.PHOT, "r AS (SELECT band, CASE WHEN k % 10 = 0 THEN ' ' WHEN k % 11 = 0 THEN 'abc' WHEN k % 13 = 0 THEN 'NaN' ELSE CAST(flux AS VARCHAR) END AS raw FROM phot)")
    + "SELECT band, count(*) FILTER (raw NOT IN (' ', 'abc', 'NaN')) AS n_valid, count(*) FILTER (raw = ' ') AS n_blank, count(*) FILTER (raw IN ('abc', 'NaN')) AS n_malformed FROM r GROUP BY band"
)
def b1_numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    raw = F.when(k % 10 == 0, " ").when(k % 11 == 0, "abc").when(k % 13 == 0, "NaN").otherwise(F.col("flux").cast("string"))
    r = D.phot(spark, sf_dir).withColumn("raw", raw)
    return r.groupBy("band").agg(F.count(S.number(F.col("raw"))).alias("n_valid"), F.count_if(F.trim("raw") == "").alias("n_blank"), F.count_if(S.malformed(F.col("raw"))).alias("n_malformed"))


@query(
    _with(D.PHOT, "r AS (SELECT ['Detected', ' no ', '1', 'maybe', ''][k % 5 + 1] AS word, ['ZTF_g', 'zr', ' 3 ', 'nan', 'u-band'][k % 5 + 1] AS name, survey FROM phot)")
    + """SELECT word, CASE lower(trim(word)) WHEN 'detected' THEN TRUE WHEN '1' THEN TRUE WHEN 'no' THEN FALSE END AS flag, CASE k WHEN 0 THEN 'g' WHEN 1 THEN 'r' WHEN 2 THEN 'i' WHEN 4 THEN 'u-band' END AS band,
         survey || CASE k WHEN 3 THEN '' ELSE '/' || CASE k WHEN 0 THEN 'g' WHEN 1 THEN 'r' WHEN 2 THEN 'i' WHEN 4 THEN 'u-band' END END AS channel, count(*) AS n
         FROM (SELECT *, list_position(['Detected', ' no ', '1', 'maybe', ''], word) - 1 AS k FROM r) GROUP BY ALL"""
)
def b2_flags_and_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("k") % 5 + 1).cast("int")
    words = F.element_at(F.array(*map(F.lit, ("Detected", " no ", "1", "maybe", ""))), at)
    names = F.element_at(F.array(*map(F.lit, ("ZTF_g", "zr", " 3 ", "nan", "u-band"))), at)
    r = D.phot(spark, sf_dir).select(words.alias("word"), names.alias("name"), "survey")
    return r.groupBy("word", S.flag(F.col("word")).alias("flag"), S.passband(F.col("name")).alias("band"), S.channel(F.col("survey"), F.col("name")).alias("channel")).agg(F.count("*").alias("n"))


@query(
    _with(D.PHOT)
    + """SELECT observation_id, 3631e0 * pow(10e0, -0.4e0 * magnitude) * 1e6 AS flux_ujy, ln(10e0) / 2.5e0 * 3631e0 * pow(10e0, -0.4e0 * magnitude) * magnitude_error * 1e6 AS error_ujy,
         CASE WHEN flux > 0 THEN 1 - exp(-flux / 10e0) ELSE 0e0 END AS saturated, 1 / (1 + exp(-greatest(least(flux - 10, 60e0), -60e0))) AS squashed,
         greatest(0e0, least(1e0, ln(1 + greatest(flux, 0)) / ln(101e0))) AS logscore FROM phot"""
)
def b9_photometric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, f = F.col("magnitude"), F.col("flux")
    return D.phot(spark, sf_dir).select("observation_id", (S.ab_flux_jy(m) * 1e6).alias("flux_ujy"), (S.ab_flux_error_jy(m, F.col("magnitude_error")) * 1e6).alias("error_ujy"), S.saturate(f, 10.0).alias("saturated"), S.logistic(f - 10).alias("squashed"), S.log_score(f, 100.0).alias("logscore"))


@query(
    _with(D.CATALOG) + "SELECT otype, CASE WHEN otype IN ('star', 'variable') THEN 'veto' WHEN otype IN ('galaxy', 'agn') THEN 'host' ELSE 'unknown' END AS category, count(*) AS n FROM catalog GROUP BY ALL"
)
def b13_object_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.catalog(spark, sf_dir).groupBy("otype", S.object_category(F.col("otype")).alias("category")).agg(F.count("*").alias("n"))


_JUDGED_SQL = "judged AS (SELECT *, CASE WHEN NOT quality THEN 'bad_quality' WHEN flux_error > 1.4 THEN 'error_too_large' WHEN NOT is_detection AND limiting_magnitude < 22 THEN 'shallow_limit' END AS reason FROM phot)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.judged(D.phot(spark, sf_dir), [("bad_quality", ~F.col("quality")), ("error_too_large", F.col("flux_error") > 1.4), ("shallow_limit", ~F.col("is_detection") & (F.col("limiting_magnitude") < 22))])


@query(_with(D.PHOT, _JUDGED_SQL) + "SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n, count(DISTINCT source_id) AS n_sources FROM judged GROUP BY ALL")
def c8_accept_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("n_sources"))


@query(_with(D.PHOT, _JUDGED_SQL) + "SELECT event_id, source_id, survey, band, mjd, flux, flux_error, reason FROM judged WHERE reason IS NOT NULL", "mjd flux flux_error")
def c8_rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rejected rows as they came, each with its reason."""
    return _judged(spark, sf_dir).where("reason is not null").select("event_id", "source_id", "survey", "band", "mjd", "flux", "flux_error", "reason")


@query(
    _with(
        D.PHOT,
        "p AS (SELECT DISTINCT source_id, ra_deg, dec_deg + (k % 3) * 0.0001e0 AS dec_deg FROM phot)",
        f"q AS (SELECT a.source_id, count(*) AS pairs, max({_SEP.format(d1='a.dec_deg', d2='b.dec_deg', r1='a.ra_deg', r2='b.ra_deg')}) AS spread FROM p a JOIN p b USING (source_id) GROUP BY a.source_id)",
    )
    + "SELECT source_id, CAST(sqrt(pairs) AS BIGINT) AS positions, spread, spread <= 0.5 AS consistent FROM q"
)
def c3_position_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.position_spread(D.phot(spark, sf_dir).withColumn("dec_deg", F.col("dec_deg") + (F.col("k") % 3) * 0.0001), 0.5)


@query(_with(D.PHOT) + "SELECT source_id, band, k, count(*) AS n FROM phot GROUP BY ALL HAVING count(*) > 1")
def c4_duplicate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.duplicates(D.phot(spark, sf_dir), ["source_id", "band", "k"])


@query(_with(D.PHOT) + "SELECT source_id, count(*) AS n FROM phot GROUP BY source_id HAVING count(*) >= 60")
def c10_minimum_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.phot(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("n")).where("n >= 60")


@query(
    """SELECT count(*) FILTER (l AND r) AS "both", count(*) FILTER (l AND r IS NULL) AS only_left, count(*) FILTER (r AND l IS NULL) AS only_right
       FROM (SELECT DISTINCT o_custkey AS key, TRUE AS l FROM orders) FULL JOIN (SELECT c_custkey AS key, TRUE AS r FROM customer WHERE c_custkey % 3 > 0) USING (key)"""
)
def c15_cohort_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = D.table(spark, sf_dir, "orders"), D.table(spark, sf_dir, "customer").where("c_custkey % 3 > 0")
    return tables.set_agreement(orders.select(F.col("o_custkey").alias("key")), customer.select(F.col("c_custkey").alias("key")), "key")


@query(
    """WITH o AS (SELECT DISTINCT o_custkey AS key FROM orders), c AS (SELECT c_custkey AS key FROM customer WHERE c_custkey % 3 > 0)
       SELECT key, 'left' AS only_in FROM o WHERE key NOT IN (SELECT key FROM c) UNION ALL SELECT key, 'right' FROM c WHERE key NOT IN (SELECT key FROM o)"""
)
def c15_cohort_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities that one of two cohorts lacks."""
    orders, customer = D.table(spark, sf_dir, "orders"), D.table(spark, sf_dir, "customer").where("c_custkey % 3 > 0")
    return tables.set_differences(orders.select(F.col("o_custkey").alias("key")), customer.select(F.col("c_custkey").alias("key")), "key")


_MODELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW", "6-NEVER"]


@query(
    f"""WITH d AS (SELECT o_orderpriority AS model, o_custkey % 250 AS fold, o_orderkey % 13 AS horizon, count(*) AS n FROM orders GROUP BY ALL),
        g AS (SELECT model, fold, horizon, TRUE AS wanted FROM (SELECT unnest({_MODELS}) AS model), (SELECT unnest(range(250)) AS fold), (SELECT unnest(range(13)) AS horizon))
        SELECT model, fold, horizon, coalesce(n, 0) AS n, CASE WHEN wanted IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' END AS state
        FROM g FULL JOIN d USING (model, fold, horizon) WHERE wanted IS NULL OR n IS NULL OR n > 1"""
)
def c16_complete_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order against a declared grid, which lacks a model that occurs and has one that does not."""
    o = D.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model"), (F.col("o_custkey") % 250).alias("fold"), (F.col("o_orderkey") % 13).alias("horizon"))
    return tables.grid_gaps(o, {"model": _MODELS, "fold": list(range(250)), "horizon": list(range(13))})


# ---- matching


_PAIR_SQL = _SEP.format(d1="s.dec_deg", d2="c.dec_deg", r1="s.ra_deg", r2="c.ra_deg")


@query(
    _with(D.PHOT, D.CATALOG, D.SOURCES, f"j AS (SELECT source_id, name FROM sources s JOIN catalog c ON {_PAIR_SQL} <= 4000)")
    + """SELECT s.source_id, count(name) AS n_match, coalesce(array_to_string(list_sort(list(DISTINCT name))[1:10], ';'), '') AS names, count(name) > 0 AS matched FROM sources s LEFT JOIN j USING (source_id) GROUP BY s.source_id"""
)
def d7_cone_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossmatch.cone_match(D.sources(spark, sf_dir), D.catalog(spark, sf_dir), 4000.0)


@query(
    _with(D.PHOT, D.CATALOG, D.SOURCES, f"j AS (SELECT source_id, name, otype, {_PAIR_SQL} AS separation FROM sources s JOIN catalog c ON {_PAIR_SQL} <= 4000)")
    + "SELECT source_id, arg_min(name, (separation, name)) AS name, arg_min(otype, (separation, name)) AS otype, min(separation) AS separation FROM j GROUP BY source_id"
)
def d8_nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossmatch.nearest_match(D.sources(spark, sf_dir), D.catalog(spark, sf_dir), 4000.0)


@query(
    _with(
        D.PHOT,
        "det AS (SELECT source_id, ra_deg, dec_deg, mjd FROM phot WHERE is_detection)",
        "eph AS (SELECT ra_deg, dec_deg + 2e0 / 3600 AS dec_deg, mjd + 0.001e0 AS mjd FROM phot WHERE event_id % 7 = 0)",
        f"hit AS (SELECT source_id, count(DISTINCT s.mjd) AS n FROM det s JOIN eph c ON abs(s.mjd - c.mjd) <= 0.01 AND {_PAIR_SQL} <= 5 GROUP BY source_id)",
    )
    + "SELECT source_id, count(DISTINCT mjd) AS n_epochs, coalesce(any_value(n), 0) AS n_covered, coalesce(any_value(n), 0) = count(DISTINCT mjd) AS all_covered FROM det LEFT JOIN hit USING (source_id) GROUP BY source_id"
)
def d9_moving_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.phot(spark, sf_dir)
    eph = p.where("event_id % 7 = 0").select("ra_deg", (F.col("dec_deg") + 2.0 / 3600).alias("dec_deg"), (F.col("mjd") + 0.001).alias("mjd"))
    return crossmatch.moving_match(p.where("is_detection").select("source_id", "ra_deg", "dec_deg", "mjd"), eph, 5.0, 0.01)


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
       s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 12) AS similarity FROM v JOIN v q ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
       SELECT query_id, id, similarity, CAST(i AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS i FROM s) WHERE i <= 10"""
)
def d16_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = D.table(spark, sf_dir, "embeddings")
    return neighbours.nearest(v, v.where("vec_id % 100 = 0"), 10, "vec_id", "embedding")


@query(
    """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
       s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 12) AS similarity FROM v JOIN v q ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND q.label IS NOT DISTINCT FROM v.label)
       SELECT query_id, id, similarity, CAST(i AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS i FROM s) WHERE i <= 10""",
    "similarity",
)
def d16_same_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours among the vectors of the query's own provenance."""
    v = D.table(spark, sf_dir, "embeddings")
    return neighbours.nearest(v, v.where("vec_id % 100 = 0"), 10, "vec_id", "embedding", provenance="label")


# ---- two time axes


@query(
    _with(D.PHOT, D.ASOF, CUTS)
    + "SELECT entity_id, cutoff, count(*) AS n, max(observed_at_mjd) AS latest FROM cutoffs JOIN asof_rows USING (entity_id) WHERE observed_at_mjd <= cutoff AND available_at_mjd <= cutoff GROUP BY ALL"
)
def d12_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.asof(spark, sf_dir)
    return temporal.prefixes(rows, _cutoffs(rows)).groupBy("entity_id", "cutoff").agg(F.count("*").alias("n"), F.max("observed_at_mjd").alias("latest"))


_TARGET_SQL = "targets AS (SELECT entity_id, cutoff, horizon, observed_at_mjd, observation_id, value FROM (SELECT *, unnest([3e0, 7e0]) AS horizon FROM cutoffs) JOIN asof_rows USING (entity_id) WHERE observed_at_mjd > cutoff AND observed_at_mjd <= cutoff + horizon)"
_PREFIX_SQL = "prefix AS (SELECT c.entity_id, cutoff, observed_at_mjd, observation_id, value, value_error FROM cutoffs c JOIN asof_rows USING (entity_id) WHERE observed_at_mjd <= cutoff AND available_at_mjd <= cutoff)"


@query(_with(D.PHOT, D.ASOF, CUTS, _TARGET_SQL) + "SELECT entity_id, cutoff, horizon, count(*) AS n, min(observed_at_mjd) AS first FROM targets GROUP BY ALL")
def d13_target_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.asof(spark, sf_dir)
    return temporal.targets(rows, _cutoffs(rows), HORIZONS).groupBy("entity_id", "cutoff", "horizon").agg(F.count("*").alias("n"), F.min("observed_at_mjd").alias("first"))


@query(
    _with(D.PHOT, D.ASOF, CUTS, _PREFIX_SQL, "m AS (SELECT *, median(value) OVER (PARTITION BY entity_id, cutoff) AS mid FROM prefix WHERE value IS NOT NULL)")
    + "SELECT entity_id, cutoff, count(*) AS n, min(mid) AS centre, greatest(1.4826e0 * median(abs(value - mid)), median(value_error), 1e-3) AS scale FROM m GROUP BY ALL"
)
def e32_prefix_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.asof(spark, sf_dir)
    return temporal.normalisation(temporal.prefixes(rows, _cutoffs(rows)))


@query(
    _with(
        D.PHOT, D.ASOF, CUTS, _PREFIX_SQL, _TARGET_SQL,
        "ends AS (SELECT entity_id, cutoff, arg_max(value, (observed_at_mjd, observation_id)) AS last, max(observed_at_mjd) AS t, greatest(max(observed_at_mjd) - min(observed_at_mjd), 1e-9) AS span FROM prefix WHERE value IS NOT NULL GROUP BY ALL)",
        "known AS (SELECT entity_id, cutoff, value, (observed_at_mjd - t) / span AS x FROM prefix JOIN ends USING (entity_id, cutoff) WHERE value IS NOT NULL)",
        """sums AS (SELECT entity_id, cutoff, avg(value) AS my, avg(x) AS mx, avg(x * x) AS mxx, var_pop(x) AS uu, var_pop(x * x) AS vv, covar_pop(x, x * x) AS uv, covar_pop(x, value) AS uy, covar_pop(x * x, value) AS vy FROM known GROUP BY ALL)""",
        """fit AS (SELECT *, CASE WHEN uu > 1e-12 THEN uy / uu END AS slope, CASE WHEN uu * vv - uv * uv > 1e-9 * uu * vv THEN (uy * vv - vy * uv) / (uu * vv - uv * uv) END AS b,
                   CASE WHEN uu * vv - uv * uv > 1e-9 * uu * vv THEN (vy * uu - uy * uv) / (uu * vv - uv * uv) END AS c FROM sums JOIN ends USING (entity_id, cutoff))""",
        "p AS (SELECT horizon, value, last, (observed_at_mjd - t) / span AS x, my, mx, mxx, slope, b, c FROM targets JOIN fit USING (entity_id, cutoff) WHERE value IS NOT NULL)",
        "q AS (SELECT *, coalesce(my + slope * (x - mx), last) AS line FROM p)",
    )
    + """SELECT horizon, count(*) AS n, avg(abs(value - last)) AS mae_last, avg(abs(value - line)) AS mae_line, avg(abs(value - coalesce(my + b * (x - mx) + c * (x * x - mxx), line))) AS mae_parabola FROM q GROUP BY horizon"""
)
def e34_forecast_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.asof(spark, sf_dir)
    cut = _cutoffs(rows)
    return temporal.forecast_error(temporal.prefixes(rows, cut), temporal.targets(rows, cut, HORIZONS))


@query(_with(D.PHOT, D.ASOF, CUTS, _TARGET_SQL) + "SELECT entity_id, cutoff, count(DISTINCT horizon) AS n_horizons FROM targets GROUP BY ALL HAVING count(DISTINCT horizon) = 2")
def h5_complete_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.asof(spark, sf_dir)
    return temporal.complete_horizons(temporal.targets(rows, _cutoffs(rows), HORIZONS), HORIZONS)


_ENTITY_SPLIT_SQL = "e AS (SELECT entity_id, min(available_at_mjd) AS t FROM asof_rows GROUP BY entity_id), sp AS (SELECT entity_id, row_number() OVER (ORDER BY t, entity_id) <= greatest(1, floor(count(*) OVER () * 0.7e0)) AS train FROM e)"
_ORDER = "observed_at_mjd {0}, lower(band) {0}, band {0}, NOT is_detection {0}, value {0} NULLS {1}, value_error {0} NULLS {1}"


@query(
    _with(D.PHOT, D.ASOF, _ENTITY_SPLIT_SQL)
    + "SELECT band AS term, CAST(row_number() OVER (ORDER BY band) AS INTEGER) AS id FROM (SELECT DISTINCT band FROM asof_rows JOIN sp USING (entity_id) WHERE train AND band IS NOT NULL AND band <> 'error')"
)
def h4_band_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of the training entities, but one that is held back so that later rows have an unknown band."""
    rows = D.asof(spark, sf_dir)
    return evaluation.vocabulary(rows.join(evaluation.entity_split(rows, 0.7, 0.85), "entity_id").where("band <> 'error'"), "band")


@query(
    _with(
        D.PHOT, D.ASOF, _ENTITY_SPLIT_SQL, "voc AS (SELECT band, row_number() OVER (ORDER BY band) AS band_id FROM (SELECT DISTINCT band FROM asof_rows JOIN sp USING (entity_id) WHERE train AND band IS NOT NULL AND band <> 'error'))",
        f"kept AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY {_ORDER.format('DESC', 'FIRST')}) AS back FROM asof_rows QUALIFY back <= 32)",
        f"d AS (SELECT *, observed_at_mjd - lag(observed_at_mjd) OVER (PARTITION BY entity_id ORDER BY {_ORDER.format('ASC', 'LAST')}) AS dt, count(CASE WHEN is_detection THEN value END) OVER (PARTITION BY entity_id) AS n_seen FROM kept)",
        "b AS (SELECT *, CASE WHEN n_seen > 0 THEN CASE WHEN is_detection THEN value END ELSE value END AS basis, coalesce(median(CASE WHEN dt > 0 THEN dt END) OVER (PARTITION BY entity_id), 1e0) AS cadence FROM d)",
        "c AS (SELECT *, coalesce(median(basis) OVER (PARTITION BY entity_id), 0e0) AS centre FROM b)",
        """s AS (SELECT *, 1.4826e0 * median(abs(basis - centre)) OVER (PARTITION BY entity_id) AS mad, sqrt(avg(pow(basis - centre, 2)) OVER (PARTITION BY entity_id)) AS sd,
                      median(CASE WHEN is_detection AND value_error > 0 THEN value_error END) OVER (PARTITION BY entity_id) AS err FROM c)""",
        "t AS (SELECT *, CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd ELSE coalesce(err, 1e0) END AS scale FROM s)",
    )
    + """SELECT entity_id, CAST(back AS INTEGER) AS back, coalesce(dt / cadence, 0e0) AS step, CASE WHEN value IS NOT NULL THEN (value - centre) / scale ELSE 0e0 END AS value,
         CASE WHEN value IS NOT NULL AND value_error IS NOT NULL THEN value_error / scale ELSE 0e0 END AS error, CAST(coalesce(band_id, 0) AS INTEGER) AS band_id, CAST(is_detection AS INTEGER) AS detected, CAST(value IS NOT NULL AS INTEGER) AS present
         FROM t LEFT JOIN voc USING (band)""",
    "step value error",
)
def f9_sequence_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.tokens(D.asof(spark, sf_dir), 32, h4_band_vocabulary(spark, sf_dir))


# ---- evaluation


_METRIC_SQL = """
  g AS (SELECT {k}, score, count(*) AS n, sum(label) AS p FROM long GROUP BY ALL),
  c AS (SELECT *, sum(n) OVER w AS cum_n, sum(p) OVER w AS cum_p FROM g WINDOW w AS (PARTITION BY {k} ORDER BY score DESC)),
  metrics AS (SELECT {k}, CAST(sum(n) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS positives, coalesce(sum(p * cum_p / cum_n) / nullif(sum(p), 0), 0) AS average_precision,
    coalesce(sum(p * greatest(0, least(n, {b} - (cum_n - n))) / n) / nullif(least({b}, sum(n)), 0), 0) AS precision_at_budget,
    coalesce(sum(p * greatest(0, least(n, {b} - (cum_n - n))) / n) / nullif(sum(p), 0), 0) AS recall_at_budget FROM c GROUP BY {k})"""
_LONG_SQL = "long AS (SELECT *, unnest(['score_a', 'score_b', 'score_c']) AS model, unnest([score_a, score_b, score_c]) AS score FROM {t})"
SCORES = ["score_a", "score_b", "score_c"]


@query(_with(D.RANKING, _LONG_SQL.format(t="ranking"), _METRIC_SQL.format(k="model", b=50)) + "SELECT * FROM metrics")
def e16_ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.ranking_metrics(evaluation.melt(D.ranking(spark, sf_dir), ["entity"], SCORES), ["model"], 50)


@query(
    _with(
        D.RANKING,
        "long AS (SELECT label, unnest(['score_a', 'score_c']) AS model, unnest([score_a, score_c]) AS score FROM ranking)",
        "b AS (SELECT model, least(floor(score * 10), 9) AS bin, count(*) AS n, abs(avg(label) - avg(score)) AS gap, sum(pow(score - label, 2)) AS sq FROM long GROUP BY ALL)",
    )
    + "SELECT model, sum(sq) / sum(n) AS brier, sum(gap * n) / sum(n) AS ece FROM b GROUP BY model"
)
def e19_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.calibration(evaluation.melt(D.ranking(spark, sf_dir), ["entity"], ["score_a", "score_c"]), ["model"], 10)


@query(
    _with(
        D.RANKING, "folds AS (SELECT *, time // 4 AS fold FROM ranking)", _LONG_SQL.format(t="folds"), _METRIC_SQL.format(k="fold, model", b=10),
        "h AS (SELECT fold, coalesce(sum(count(*)) OVER (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS history FROM folds GROUP BY fold)",
    )
    + "SELECT metrics.*, CAST(history AS BIGINT) AS history FROM metrics JOIN h USING (fold) WHERE history >= 1"
)
def e20_rolling_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.rolling_origin(D.ranking(spark, sf_dir), SCORES, 4, 10)


def _bootstrap_sql(block: str, incumbent: str, replicates: int, budget: int) -> str:
    return _with(
        D.RANKING, f"r AS (SELECT {block} AS block, entity, label, score_a, score_b, score_c, row_number() OVER (PARTITION BY {block} ORDER BY entity) AS i, count(*) OVER (PARTITION BY {block}) AS size FROM ranking)",
        f"d AS (SELECT block, rep, CAST('0x' || substr(sha256('1|' || block || '|' || rep || '|' || i), 1, 13) AS BIGINT) % size + 1 AS i, count(*) AS w FROM r, (SELECT unnest(range(1, {replicates + 1})) AS rep) GROUP BY ALL)",
        "x AS (SELECT block, rep, w, label, model, score FROM (SELECT * FROM d JOIN r USING (block, i)) UNPIVOT (score FOR model IN (score_a, score_b, score_c)))",
        "g AS (SELECT block, rep, model, score, sum(w) AS n, sum(w * label) AS p FROM x GROUP BY ALL)", "c AS (SELECT *, sum(n) OVER (PARTITION BY block, rep, model ORDER BY score DESC) AS cum FROM g)",
        f"h AS (SELECT block, rep, model, coalesce(sum(p * greatest(0, least(n, {budget} - (cum - n))) / n) / nullif(sum(p), 0), 0) AS recall FROM c GROUP BY ALL)", "m AS (SELECT rep, model, avg(recall) AS recall FROM h GROUP BY ALL)",
        f"e AS (SELECT m.*, m.recall - b.recall AS delta FROM m JOIN m b ON b.rep = m.rep AND b.model = '{incumbent}')",
    ) + """SELECT model, avg(recall) AS mean_recall, quantile_cont(recall, 0.025) AS low, quantile_cont(recall, 0.975) AS high, avg(delta) AS mean_delta,
                  quantile_cont(delta, 0.025) AS delta_low, quantile_cont(delta, 0.975) AS delta_high FROM e GROUP BY model"""  # fmt: skip


@query(_bootstrap_sql("CAST(0 AS BIGINT)", "score_a", 200, 50))
def e21_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.bootstrap(D.ranking(spark, sf_dir), SCORES, 200, 50)


@query(_bootstrap_sql("time // 15", "score_b", 100, 5))
def e22_paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities drawn inside blocks of time, every score against a named incumbent."""
    r = D.ranking(spark, sf_dir).withColumn("block", F.floor(F.col("time") / 15))
    return evaluation.bootstrap(r, SCORES, 100, 5, incumbent="score_b", block="block")


@query(
    _with(D.RANKING, "g AS (SELECT time, count(*) AS n, sum(label) AS s FROM ranking GROUP BY time)", "w AS (SELECT *, s / n AS p, 1.959963984540054e0 AS z FROM g)")
    + """SELECT time, n, CAST(s AS BIGINT) AS successes, greatest(0e0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)) AS low,
         least(1e0, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)) AS high FROM w"""
)
def e24_wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.ranking(spark, sf_dir).groupBy("time").agg(F.count("*").alias("n"), F.sum("label").alias("successes"))
    low, high = S.wilson(F.col("successes"), F.col("n"))
    return g.select("time", "n", "successes", low.alias("low"), high.alias("high"))


_SPLIT_SQL = """
  t AS (SELECT time, row_number() OVER (ORDER BY time) AS i, count(*) OVER () AS blocks FROM (SELECT DISTINCT time FROM ranking)),
  u AS (SELECT *, least(greatest(floor(blocks * 0.7e0), 1), blocks - 2) AS n1 FROM t),
  s AS (SELECT ranking.*, CASE WHEN i <= n1 THEN 'train' WHEN i <= n1 + least(greatest(floor(blocks * 0.15e0), 1), blocks - n1 - 1) THEN 'validation' ELSE 'test' END AS split FROM ranking JOIN u USING (time))"""


@query(_with(D.RANKING, _SPLIT_SQL) + "SELECT split, count(*) AS n, min(time) AS first, max(time) AS last FROM s GROUP BY split")
def h1_chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluation.chronological_split(D.ranking(spark, sf_dir))
    return s.groupBy("split").agg(F.count("*").alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))


@query(
    _with(
        D.RANKING, _SPLIT_SQL, "o AS (SELECT *, entity % 300 AS physical, CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS part FROM s)",
        "p AS (SELECT *, max(part) OVER (PARTITION BY physical) AS last FROM o)",
    )
    + "SELECT split, count(*) AS n, count(DISTINCT physical) AS entities FROM p WHERE part = last GROUP BY split"
)
def h2_purged_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluation.chronological_split(D.ranking(spark, sf_dir).withColumn("physical", F.col("entity") % 300))
    return evaluation.purge_entities(s, "physical").groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("physical").alias("entities"))


# ---- review


@query(
    _with(
        D.PHOT,
        "cand AS (SELECT source_id AS candidate_id, avg(flux) / (avg(flux) + 10) AS priority, stddev_pop(flux) / (stddev_pop(flux) + 10) AS anomaly, count(*) FILTER (quality) >= 40 AS eligible FROM phot GROUP BY source_id)",
        "e AS (SELECT * FROM cand WHERE eligible)",
        "audit AS (SELECT *, 'random_audit' AS route FROM e ORDER BY sha256('seed' || chr(0) || candidate_id), lower(candidate_id), candidate_id LIMIT 4)",
        "pri AS (SELECT *, 'priority' AS route FROM e WHERE candidate_id NOT IN (SELECT candidate_id FROM audit) ORDER BY priority DESC, anomaly DESC, lower(candidate_id), candidate_id LIMIT 10)",
        "ano AS (SELECT *, 'anomaly_reserve' AS route FROM e WHERE anomaly >= 0.42 AND candidate_id NOT IN (SELECT candidate_id FROM audit UNION ALL SELECT candidate_id FROM pri) ORDER BY anomaly DESC, priority DESC, lower(candidate_id), candidate_id LIMIT 6)",
        "got AS (SELECT * FROM audit UNION ALL SELECT * FROM pri UNION ALL SELECT * FROM ano)",
        "fill AS (SELECT *, 'priority_fill' AS route FROM e WHERE candidate_id NOT IN (SELECT candidate_id FROM got) ORDER BY priority DESC, anomaly DESC, lower(candidate_id), candidate_id LIMIT (SELECT 20 - count(*) FROM got))",
    )
    + """SELECT CAST(row_number() OVER (ORDER BY CASE route WHEN 'priority' THEN 0 WHEN 'anomaly_reserve' THEN 1 WHEN 'priority_fill' THEN 2 ELSE 3 END,
                CASE route WHEN 'random_audit' THEN sha256('seed' || chr(0) || candidate_id) END, CASE route WHEN 'anomaly_reserve' THEN -anomaly END, priority DESC, anomaly DESC, lower(candidate_id), candidate_id) AS INTEGER) AS rank,
                candidate_id, priority, anomaly, route, CASE WHEN route = 'random_audit' THEN least(4, (SELECT count(*) FROM e)) / CAST((SELECT count(*) FROM e) AS DOUBLE) END AS propensity
         FROM (SELECT * FROM got UNION ALL SELECT * FROM fill)"""
)
def f1_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean, sd = F.avg("flux"), F.stddev_pop("flux")
    c = D.phot(spark, sf_dir).groupBy(F.col("source_id").alias("candidate_id")).agg((mean / (mean + 10)).alias("priority"), (sd / (sd + 10)).alias("anomaly"), (F.count_if("quality") >= 40).alias("eligible"))
    return review.review_queue(c, 20, 6, 0.42, 4, "seed")


_LATEST_SQL = """n AS (SELECT *, max(checked_hour) OVER (PARTITION BY source_id, service) AS newest FROM checks),
  latest AS (SELECT source_id, service, min(newest) AS checked_hour, arg_min(status, attempt) AS status, arg_min(expires_hour, attempt) AS expires_hour, count(DISTINCT status) > 1 AS conflicting FROM n WHERE checked_hour = newest GROUP BY ALL)"""


@query(_with(D.PHOT, D.SOURCES, D.CHECKS, _LATEST_SQL) + "SELECT * FROM latest")
def f7_latest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.latest_checks(D.checks(spark, sf_dir))


@query(
    _with(
        D.PHOT, D.SOURCES, D.CHECKS, _LATEST_SQL, "need AS (SELECT source_id, unnest(['catalog', 'moving', 'registry']) AS service FROM sources)", "m AS (SELECT source_id, service, bool_or(status = 'match') AS matched FROM checks GROUP BY ALL)",
        "own AS (SELECT source_id, avg(CASE WHEN quality THEN 1e0 ELSE 0e0 END) >= 0.99e0 AS passed, max(flux / flux_error) > 190 AS manual FROM phot GROUP BY source_id)",
        """j AS (SELECT need.*, matched, CASE WHEN status IS NULL THEN 'missing' WHEN conflicting THEN 'conflicting' WHEN status <> 'clear' THEN status WHEN expires_hour <= 30 THEN 'expired' END AS reason
                FROM need LEFT JOIN latest USING (source_id, service) LEFT JOIN m USING (source_id, service))""",
        """g AS (SELECT source_id, bool_or(coalesce(matched, FALSE)) AS any_match, count(reason) AS n_open, coalesce(array_to_string(list_sort(list(service || ':match') FILTER (matched)), ','), '') AS matches,
                coalesce(array_to_string(list_sort(list(service || ':' || reason) FILTER (reason IS NOT NULL)), ','), '') AS open FROM j GROUP BY source_id)""",
    )
    + """SELECT source_id, CASE WHEN any_match THEN 'match' WHEN n_open > 0 THEN 'incomplete' WHEN NOT passed THEN 'quality' WHEN manual THEN 'manual' ELSE 'reportable' END AS decision,
         CASE WHEN any_match THEN matches ELSE open END AS reasons FROM g JOIN own USING (source_id)"""
)
def j2_evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.phot(spark, sf_dir).groupBy("source_id").agg((F.avg(F.col("quality").cast("double")) >= 0.99).alias("quality_passed"), (F.max(F.col("flux") / F.col("flux_error")) > 190).alias("manual_required"))
    return review.evidence_gate(own, D.checks(spark, sf_dir), ["catalog", "moving", "registry"], 30)


_ACTIVE_SQL = """active AS (SELECT candidate, version, reviewer, role, arg_max(verdict, review_id) AS verdict FROM reviews GROUP BY ALL),
  cur AS (SELECT candidate, arg_max(version, (day, review_id)) AS version FROM reviews GROUP BY candidate),
  a AS (SELECT active.* FROM active JOIN cur USING (candidate, version))"""


@query(_with(D.REVIEWS, _ACTIVE_SQL) + "SELECT * FROM active")
def f8_latest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.active_decisions(D.reviews(spark, sf_dir))


@query(
    _with(
        D.REVIEWS, _ACTIVE_SQL,
        """g AS (SELECT candidate, version, count(*) AS n_active, bool_or(verdict = 'reject') AS rejected, count(DISTINCT reviewer) FILTER (role = 'screener' AND verdict = 'approve') AS s,
                      count(DISTINCT reviewer) FILTER (role = 'reviewer' AND verdict = 'approve') AS r, count(DISTINCT reviewer) FILTER (verdict = 'approve') AS people FROM a GROUP BY ALL)""",
    )
    + "SELECT candidate, version, n_active, rejected, s > 0 AND r > 0 AND people > 1 AND NOT rejected AS approved FROM g"
)
def j16_independent_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.approvals(D.reviews(spark, sf_dir))


@query(
    _with(
        D.REVIEWS, "cur AS (SELECT candidate, arg_max(version, (day, review_id)) AS version, 'campaign' || candidate % 3 AS campaign, coalesce(min(day) FILTER (role = 'screener'), 9000) * 24 AS recorded FROM reviews GROUP BY candidate)",
        "per AS (SELECT candidate, count(*) AS events, min(day) * 24 AS first_hour, count(DISTINCT verdict) > 1 AS disagreed FROM reviews JOIN cur USING (candidate, version) WHERE role = 'reviewer' GROUP BY candidate)",
        "seen AS (SELECT c_custkey AS candidate, CASE WHEN c_acctbal > 5000 THEN 1 WHEN c_acctbal > 0 THEN 0 END AS label, TRUE AS observed FROM customer WHERE c_mktsegment <> 'BUILDING')",
        "j AS (SELECT campaign, events, label, observed, disagreed, first_hour - recorded AS hours FROM cur LEFT JOIN per USING (candidate) LEFT JOIN seen USING (candidate))",
    )
    + """SELECT campaign, count(*) AS candidates, CAST(coalesce(sum(events), 0) AS BIGINT) AS review_events, count(events) AS reviewed, count(observed) AS observed, count(*) - count(observed) AS missing, count(label) AS labelled,
         count(*) FILTER (label = 1) AS positive, count(*) FILTER (events IS NOT NULL AND label IS NOT NULL) AS reviewed_labelled, count(*) FILTER (events IS NOT NULL AND label = 1) AS reviewed_positive, count(*) FILTER (disagreed) AS disagreements,
         count(*) FILTER (events IS NOT NULL AND NOT coalesce(hours >= 0, FALSE)) AS invalid_latency, CAST(median(CASE WHEN hours >= 0 THEN hours END) AS DOUBLE) AS median_hours,
         count(*) FILTER (events IS NOT NULL AND label = 1) / CAST(nullif(count(*) FILTER (events IS NOT NULL AND label IS NOT NULL), 0) AS DOUBLE) AS review_yield FROM j GROUP BY campaign""",
    "median_hours review_yield",
)
def e27_outcome_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.reviews(spark, sf_dir)
    recorded = F.coalesce(F.min(F.when(F.col("role") == "screener", F.col("day"))), F.lit(9000)) * 24
    current = r.groupBy("candidate").agg(F.max_by("version", F.struct("day", "review_id")).alias("version"), recorded.alias("recorded_hour")).withColumn("campaign", F.concat(F.lit("campaign"), F.col("candidate") % 3))
    label = F.when(F.col("c_acctbal") > 5000, 1).when(F.col("c_acctbal") > 0, 0)
    outcomes = D.table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("candidate"), label.alias("label"))
    return review.outcome_report(current, r.where("role = 'reviewer'").withColumn("hour", F.col("day") * 24), outcomes)


@query(_with(D.REVIEWS) + "SELECT review_id, day, row_number() OVER (PARTITION BY day ORDER BY review_id) <= 5 AS accepted FROM reviews")
def f13_nightly_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.nightly_quota(D.reviews(spark, sf_dir), 5)


@query(
    _with(D.REVIEWS, "s AS (SELECT verdict AS state, lag(verdict) OVER (PARTITION BY candidate ORDER BY day, review_id) AS before FROM reviews)")
    + "SELECT before, state, count(*) AS n FROM s WHERE before IS NOT NULL AND before <> state AND (before, state) NOT IN (('defer', 'approve'), ('defer', 'reject'), ('approve', 'reject')) GROUP BY ALL"
)
def j19_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.createDataFrame([("defer", "approve"), ("defer", "reject"), ("approve", "reject")], "from_state string, to_state string")
    return review.transitions(D.reviews(spark, sf_dir).withColumnRenamed("verdict", "state"), allowed)


@query(
    _with(
        D.PHOT,
        "files AS (SELECT 0 AS file, event_id, mjd, flux FROM phot UNION ALL SELECT 1, event_id, mjd, flux FROM phot WHERE event_id % 5 = 0 UNION ALL SELECT 2, event_id, mjd, flux + 1 FROM phot WHERE event_id % 11 = 0)",
        "g AS (SELECT event_id, count(*) AS n_rows, count(DISTINCT (mjd, flux)) AS kinds, arg_min(mjd, file) AS m, arg_min(flux, file) AS f FROM files GROUP BY event_id)",
    )
    + "SELECT event_id, n_rows, CASE WHEN kinds = 1 THEN 'accepted' ELSE 'quarantined' END AS state, CASE WHEN kinds = 1 THEN m END AS mjd, CASE WHEN kinds = 1 THEN f END AS flux FROM g"
)
def d21_overlap_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.phot(spark, sf_dir).select("event_id", "mjd", "flux")
    files = p.withColumn("file", F.lit(0)).unionByName(p.where("event_id % 5 = 0").withColumn("file", F.lit(1))).unionByName(p.where("event_id % 11 = 0").withColumn("flux", F.col("flux") + 1).withColumn("file", F.lit(2)))
    return tables.reconcile(files, "event_id", ["mjd", "flux"])


@query(
    """WITH a AS (SELECT l_partkey, l_quantity FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT l_partkey, l_quantity FROM lineitem WHERE l_linenumber >= 3)
       SELECT 'added' AS change, count(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT 'removed', count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)"""
)
def g2_version_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "lineitem")
    return tables.multiset_change(rows.where("l_linenumber <= 3").select("l_partkey", "l_quantity"), rows.where("l_linenumber >= 3").select("l_partkey", "l_quantity"))


@query(
    """WITH a AS (SELECT l_partkey, l_quantity, l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT l_partkey, l_quantity, l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber >= 3),
       o AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity, l_returnflag, l_linestatus) AS i FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)),
       n AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity, l_returnflag, l_linestatus) AS i FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)),
       j AS (SELECT l_partkey, CASE WHEN o.l_quantity IS NULL THEN 'added' WHEN n.l_quantity IS NULL THEN 'removed' ELSE 'changed' END AS change,
                    concat_ws(',', CASE WHEN o.l_quantity <> n.l_quantity THEN 'l_quantity' END, CASE WHEN o.l_returnflag <> n.l_returnflag THEN 'l_returnflag' END, CASE WHEN o.l_linestatus <> n.l_linestatus THEN 'l_linestatus' END) AS fields
             FROM o FULL JOIN n USING (l_partkey, i))
       SELECT l_partkey, change, fields, count(*) AS n FROM j GROUP BY ALL"""
)
def g2_changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part: line items added, removed and changed between two versions, by the fields that changed."""
    rows, fields = D.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_returnflag", "l_linestatus"]
    got = tables.changed_rows(rows.where("l_linenumber <= 3"), rows.where("l_linenumber >= 3"), ["l_partkey"], fields)
    return got.groupBy("l_partkey", "change", "fields").agg(F.count("*").alias("n"))


@query(
    """SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}'), 1, 12) AS BIGINT)) AS VARCHAR) AS content,
              'orders' AS name, 'status' AS label_policy, 'by_customer' AS split_policy FROM orders"""
)
def k7_snapshot_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.snapshot_row(D.table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"], "orders", "status", "by_customer")


#: Four batches of candidate records: of each window of days the newest review of every candidate.
_WINDOWS = (8766, 9496, 10227)
_RECORDS_SQL = """w AS (SELECT *, CAST(1 + (day >= 8766)::INT + (day >= 9496)::INT + (day >= 10227)::INT AS BIGINT) AS batch FROM reviews),
  records AS (SELECT candidate, batch, arg_max(version, (day, review_id)) AS version, arg_max(verdict, (day, review_id)) AS state,
                     arg_max('{"review_id":' || review_id || ',"reviewer":' || reviewer || '}', (day, review_id)) AS payload FROM w {where} GROUP BY candidate, batch)"""


def _published(spark: SparkSession, sf_dir: str, where: str = "true") -> ledger.Candidates:
    """A ledger with four batches; the second is tried again, and a batch of another campaign is refused."""
    book = ledger.Candidates(spark, Scratch(spark, "ledger").root)
    r = D.reviews(spark, sf_dir).where(where)
    batch = F.lit(1) + sum((F.col("day") >= d).cast("int") for d in _WINDOWS)
    payload = F.concat(F.lit('{"review_id":'), "review_id", F.lit(',"reviewer":'), "reviewer", F.lit("}"))
    r = r.withColumn("batch", batch).withColumn("payload", payload)
    for n in (1, 2, 3, 4, 2):
        newest = r.where(F.col("batch") == n).groupBy("candidate").agg(F.max_by(F.struct("version", F.col("verdict").alias("state"), "payload"), F.struct("day", "review_id")).alias("x"))
        owner = F.concat(F.lit("campaign"), F.col("candidate") % 3)
        records = newest.select(F.col("candidate").cast("string").alias("candidate"), owner.alias("campaign"), "x.state", "x.version", "x.payload")
        book.publish(f"batch{n}", records)
    try:
        book.publish("other", records.withColumn("campaign", F.lit("elsewhere")))
    except ledger.Refused:
        return book
    raise AssertionError("a batch of another campaign was published")


@query(_with(D.REVIEWS, _RECORDS_SQL.replace("{where}", "")) + "SELECT candidate, version, arg_min(state, batch) AS state, arg_min(payload, batch) AS payload, min(batch) AS commit FROM records GROUP BY candidate, version")
def k3_first_seen_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir).archive().withColumn("candidate", F.col("candidate").cast("long"))


@query(
    _with(D.REVIEWS, _RECORDS_SQL.replace("{where}", ""))
    + "SELECT candidate, 'campaign' || candidate % 3 AS campaign, arg_max(state, batch) AS state, arg_max(version, batch) AS version, arg_max(payload, batch) AS payload, min(batch) AS first_seen, max(batch) AS last_seen FROM records GROUP BY candidate"
)
def k1_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir).current().withColumn("candidate", F.col("candidate").cast("long"))


@query(
    _with(D.REVIEWS, "cur AS (SELECT candidate, arg_max(version, (day, review_id)) AS version FROM reviews WHERE review_id % 2 = 0 GROUP BY candidate)")
    + """SELECT CASE WHEN c.version IS NULL THEN 'unknown_candidate' WHEN c.version <> r.version THEN 'stale_version' ELSE 'accepted' END AS outcome, count(*) AS n
         FROM reviews r LEFT JOIN cur c ON r.candidate = c.candidate WHERE review_id % 2 = 1 GROUP BY ALL"""
)
def k4_append_to_current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions appended twice under one name; the accepted ones are counted in the table, the others as returned."""
    book, rows = _published(spark, sf_dir, "review_id % 2 = 0"), D.reviews(spark, sf_dir).where("review_id % 2 = 1")
    held = ledger.Decisions(spark, f"{book.root}-decisions")
    new = rows.select(*(F.col(c).cast("string").alias(n) for n, c in (("decision_id", "review_id"), ("candidate", "candidate"), ("version", "version"), ("reviewer", "reviewer"), ("verdict", "verdict"))))
    for _ in range(2):
        judged = held.append("odd", new, book.current())
    outcome = judged.where("outcome <> 'accepted'").select("outcome").unionByName(held.rows().select(F.lit("accepted").alias("outcome")))
    return outcome.groupBy("outcome").agg(F.count("*").alias("n"))


_REPEATED_SQL = "rep AS (SELECT source_id, survey, band, mjd, flux, event_id FROM phot UNION ALL SELECT source_id, survey, band, mjd, flux, event_id FROM phot WHERE event_id % 5 = 0 UNION ALL SELECT source_id, survey, band, mjd, flux + 1, event_id FROM phot WHERE event_id % 11 = 0)"


def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files of one archive: all rows, some of them again, and some again with another value."""
    p = D.phot(spark, sf_dir).select("source_id", "survey", "band", "mjd", "flux", "event_id")
    return p.unionByName(p.where("event_id % 5 = 0")).unionByName(p.where("event_id % 11 = 0").withColumn("flux", F.col("flux") + 1))


@query(_with(D.PHOT, _REPEATED_SQL) + "SELECT source_id, survey, event_id, count(*) AS n FROM rep WHERE event_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def c5_reused_observation_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.duplicates(_repeated(spark, sf_dir).where("event_id is not null"), ["source_id", "survey", "event_id"])


@query(_with(D.PHOT, _REPEATED_SQL) + "SELECT source_id, survey, band, mjd, flux, count(*) AS n FROM rep GROUP BY ALL HAVING count(*) > 1", "mjd flux")
def c4_repeated_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that agree in source, channel, time and value."""
    return tables.duplicates(_repeated(spark, sf_dir), ["source_id", "survey", "band", "mjd", "flux"])


@query(
    """SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0)) AS missing,
              (SELECT count(*) FROM (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0 EXCEPT SELECT o_custkey FROM orders)) AS extra,
              (SELECT count(*) FROM (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0 INTERSECT SELECT o_custkey FROM orders)) AS common"""
)
def g3_entity_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = D.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    b = D.table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("key"))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(a.subtract(b), "missing").crossJoin(n(b.subtract(a), "extra")).crossJoin(n(a.intersect(b), "common"))


@query(_with(D.REVIEWS) + "SELECT review_id, candidate, day FROM reviews ORDER BY day DESC, review_id DESC LIMIT 50 OFFSET 100")
def f15_paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.reviews(spark, sf_dir).select("review_id", "candidate", "day").orderBy(F.col("day").desc(), F.col("review_id").desc()).offset(100).limit(50)


@query(
    _with(D.PHOT, D.ASOF, "e AS (SELECT entity_id, min(available_at_mjd) AS t FROM asof_rows GROUP BY entity_id)", "r AS (SELECT *, row_number() OVER (ORDER BY t, entity_id) AS i, count(*) OVER () AS n FROM e)")
    + "SELECT entity_id, CASE WHEN i <= greatest(1, floor(n * 0.7e0)) THEN 'train' WHEN i <= greatest(2, floor(n * 0.85e0)) THEN 'validation' ELSE 'test' END AS split FROM r"
)
def h3_entity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.entity_split(D.asof(spark, sf_dir), 0.7, 0.85)


@query(
    _with(D.RANKING, _SPLIT_SQL, "v AS (SELECT DISTINCT score_b AS term FROM s WHERE split = 'train')")
    + "SELECT term, CAST(row_number() OVER (ORDER BY term) AS INTEGER) AS id FROM v"
)
def h4_training_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.vocabulary(evaluation.chronological_split(D.ranking(spark, sf_dir)), "score_b")


# ---- scores and decisions


_CLASS_SQL = """g AS (SELECT source_id, avg(flux) / (avg(flux) + 10) AS score, count(*) FILTER (is_detection) AS n, min(mjd) FILTER (is_detection) AS first, max(mjd) FILTER (is_detection) AS last,
    max(k) / 100e0 AS probability, CAST(source_id AS BIGINT) % 11 = 0 AS moving, CAST(source_id AS BIGINT) % 7 = 0 AS known, count(*) > 50 AS is_candidate,
    ['SN', 'AGN', ' agn ', 'QSO', 'TDE'][CAST(source_id AS BIGINT) % 5 + 1] AS object_class FROM phot GROUP BY source_id),
  c AS (SELECT *, CASE WHEN moving THEN 'moving_object' WHEN known THEN 'known_transient' WHEN is_candidate THEN 'new_candidate' ELSE 'not_transient' END AS class,
    greatest(0e0, score - CASE WHEN known THEN 0.3e0 ELSE 0 END - CASE WHEN moving THEN 0.45e0 ELSE 0 END) AS rank_score FROM g)"""


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen, i = F.col("is_detection"), F.col("source_id").cast("long")
    g = D.phot(spark, sf_dir).groupBy("source_id").agg(
        (F.avg("flux") / (F.avg("flux") + 10)).alias("score"), F.count_if(seen).alias("n"), F.min(F.when(seen, F.col("mjd"))).alias("first"), F.max(F.when(seen, F.col("mjd"))).alias("last"),
        (F.max("k") / 100.0).alias("probability"), (F.count("*") > 50).alias("is_candidate"),
    )
    kinds = F.element_at(F.array(*map(F.lit, ("SN", "AGN", " agn ", "QSO", "TDE"))), (i % 5 + 1).cast("int"))
    return decisions.classify(g.withColumns({"moving": i % 11 == 0, "known": i % 7 == 0, "object_class": kinds}))


@query(_with(D.PHOT, _CLASS_SQL) + "SELECT source_id, class, rank_score FROM c")
def j7_class_and_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classed(spark, sf_dir).select("source_id", "class", "rank_score")


@query(
    _with(
        D.PHOT, _CLASS_SQL, "m AS (SELECT *, max(last) OVER () AS newest FROM c)",
        "a AS (SELECT *, greatest(0e0, newest - first) AS age, greatest(0e0, last - first) AS span FROM m)",
        """b AS (SELECT *, (0.45e0 * score + 0.25e0 * greatest(0e0, least(1e0, probability)) + 0.15e0 * greatest(0e0, least(1e0, 1 - (newest - last) / 30e0)) + 0.15e0 * greatest(0e0, least(1e0, 1 - age / 28e0))
                  - 0.1e0 * greatest(0e0, least(1e0, n / 80e0))) * CASE WHEN class <> 'new_candidate' THEN 0.5e0 ELSE 1 END AS raw,
                  CASE WHEN upper(trim(object_class)) IN ('AGN') THEN 'class' WHEN age > 29.9 THEN 'old_first_detection' WHEN n > 75 THEN 'too_many_detections' WHEN span > 29.5 THEN 'long_span' ELSE '' END AS veto FROM a)""",
        "d AS (SELECT *, raw * CASE WHEN veto <> '' THEN 0.35e0 ELSE 1 END AS blended FROM b)",
    )
    + """SELECT source_id, class, blended, veto, CASE WHEN class = 'new_candidate' AND veto <> '' THEN 'early_veto' WHEN class = 'new_candidate' AND (age > 28 OR n > 80) THEN 'possible_variable'
         WHEN class = 'new_candidate' AND blended >= 0.3 THEN 'high_priority' ELSE 'review_later' END AS tier FROM d"""
)
def j8_blended_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decisions.blended(_classed(spark, sf_dir), 28.0, 80, 0.3, 29.9, 75, 29.5, ("AGN",))
    return out.select("source_id", "class", "blended", "veto", "tier")


_NEAR_SQL = f"j AS (SELECT source_id, name, otype, {_PAIR_SQL} AS separation FROM sources s JOIN catalog c ON {_PAIR_SQL} <= 4000)"


@query(
    _with(
        D.PHOT, D.CATALOG, D.SOURCES, _NEAR_SQL,
        "g AS (SELECT source_id, count(*) AS n, bool_or(otype = 'variable') AS v, bool_or(otype = 'star') AS st, bool_or(otype IN ('galaxy', 'agn')) AS h FROM j GROUP BY source_id)",
    )
    + """SELECT s.source_id, coalesce(n, 0) AS n_match, CASE WHEN v THEN 'reject_variable' WHEN st AND NOT h THEN 'review_star' WHEN h THEN 'possible_host' WHEN n > 0 THEN 'review_match' ELSE 'pass' END AS decision
         FROM sources s LEFT JOIN g USING (source_id)"""
)
def j11_catalogue_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.catalogue_decision(D.sources(spark, sf_dir), D.catalog(spark, sf_dir), 4000.0)


@query(
    _with(D.PHOT, D.CATALOG, D.SOURCES, _NEAR_SQL)
    + """SELECT source_id, CASE WHEN bool_or(otype IN ('star', 'variable')) THEN 'match' ELSE 'clear' END AS status,
         NOT bool_or(otype IN ('star', 'variable')) AND (bool_or(otype IN ('galaxy', 'agn')) OR bool_or(otype = 'unknown')) AS manual FROM j GROUP BY source_id"""
)
def j4_catalogue_interpretation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.catalogue_interpretation(D.sources(spark, sf_dir), D.catalog(spark, sf_dir), 4000.0)


@query(
    _with(
        D.PHOT, D.CATALOG, D.SOURCES,
        "h AS (SELECT catalog.*, 0.05e0 + length(name) / 100e0 AS density, ascii(right(name, 1)) % 5 * 20e0 AS half_light, CASE WHEN ascii(right(name, 1)) % 4 > 0 THEN ascii(right(name, 1)) % 4 * 1e0 END AS sigma FROM catalog)",
        f"p AS (SELECT source_id, c.name, {_PAIR_SQL} AS separation, half_light, sigma, density FROM sources s JOIN h c ON {_PAIR_SQL} <= 4000)",
        "q AS (SELECT *, 1 - exp(-pi() * pow(greatest(sqrt(pow(separation, 2) + 4 * pow(half_light, 2)), 3 * coalesce(sigma, 0)) / 3600e0, 2) * density) AS chance FROM p)",
        "r AS (SELECT *, row_number() OVER w AS place, lead(chance) OVER w AS next FROM q WINDOW w AS (PARTITION BY source_id ORDER BY chance, name))",
    )
    + """SELECT source_id, name AS host, separation, chance, CASE WHEN sigma IS NULL THEN 'uncertainty_incomplete' WHEN chance > 0.2 THEN 'chance_too_high' WHEN next < 5 * chance THEN 'ambiguous' ELSE 'accepted' END AS decision
         FROM r WHERE place = 1"""
)
def d15_host_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.ascii(F.right("name", F.lit(1)))
    hosts = D.catalog(spark, sf_dir).withColumns({"density": 0.05 + F.length("name") / 100.0, "half_light": last % 5 * 20.0, "sigma": F.when(last % 4 > 0, last % 4 * 1.0)})
    return decisions.host_association(D.sources(spark, sf_dir), hosts, 4000.0, 0.2, 5.0)


_ROBUST = ["flux", "flux_error", "magnitude", "limiting_magnitude"]
_ROBUST_SQL = """l AS (SELECT event_id, unnest(['flux', 'flux_error', 'magnitude', 'limiting_magnitude']) AS feature, unnest([flux, flux_error, magnitude, limiting_magnitude]) AS v FROM phot),
  m AS (SELECT *, median(v) OVER (PARTITION BY feature) AS mid FROM l WHERE v IS NOT NULL),
  fit AS (SELECT feature, any_value(mid) AS centre, CASE WHEN 1.4826e0 * median(abs(v - mid)) > 1e-9 THEN 1.4826e0 * median(abs(v - mid)) WHEN stddev_pop(v) > 1e-9 THEN stddev_pop(v) ELSE 1 END AS scale, count(*) AS n FROM m GROUP BY feature HAVING count(*) >= 2)"""


@query(_with(D.PHOT, _ROBUST_SQL) + "SELECT * FROM fit")
def e29_robust_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.robust_fit(D.phot(spark, sf_dir), _ROBUST)


@query(
    _with(D.PHOT, _ROBUST_SQL, "g AS (SELECT event_id, avg(pow((v - centre) / scale, 2)) AS ms, count(v) AS seen, count(*) AS n_all FROM l JOIN fit USING (feature) GROUP BY event_id)")
    + "SELECT event_id, seen / n_all AS observed_fraction, seen > 0 AND seen / n_all >= 0.5 AS valid, CASE WHEN seen > 0 AND seen / n_all >= 0.5 THEN 1 - exp(-sqrt(ms) / 3) ELSE 0 END AS score FROM g"
)
def h10_robust_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.robust_scores(D.phot(spark, sf_dir), "event_id", _ROBUST)


@query(
    _with(
        D.PHOT,
        "v AS (SELECT source_id, mjd, event_id, flux, flux >= 12 AS up, (lead(mjd) OVER w - mjd) * (lead(flux) OVER w + flux) / 2 AS area, sum(CASE WHEN flux >= 12 THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY mjd, event_id ROWS UNBOUNDED PRECEDING) AS run FROM phot WINDOW w AS (PARTITION BY source_id ORDER BY mjd, event_id))",
        "r AS (SELECT source_id, max(n) AS longest_run FROM (SELECT source_id, run, count(*) FILTER (up) AS n FROM v GROUP BY ALL) GROUP BY source_id)",
    )
    + "SELECT source_id, max(flux) AS maximum, quantile_cont(flux, 0.95) AS q95, coalesce(sum(area), 0) AS area, min(mjd) FILTER (up) AS first_crossing, any_value(longest_run) AS longest_run FROM v JOIN r USING (source_id) GROUP BY source_id"
)
def e30_trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.trace_summary(D.phot(spark, sf_dir), "source_id", "mjd", "event_id", "flux", 12.0)


# ---- template search


@query()
def i2_template_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(D.phot(spark, sf_dir))


@query()
def i3_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each observation: the statistic of its channel's best template with and without it."""
    found = search.search(D.phot(spark, sf_dir), each=True)
    return found.select("source_id", "survey", "band", "max_z", F.posexplode("z_without").alias("epoch", "z_without"))


@query()
def i4_gaussian_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(D.phot(spark, sf_dir), null="gaussian")


@query()
def i7_correlated_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(D.phot(spark, sf_dir), correlation_days=2.0)


@query()
def i8_campaign_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.correct(search.search(D.phot(spark, sf_dir)), None, 1, 0.05, 99)


@query(
    _with(
        D.PHOT, "good AS (SELECT source_id, survey, band, mjd, flux, flux_error FROM phot WHERE flux_error > 0 AND flux IS NOT NULL AND mjd IS NOT NULL)",
        "curve AS (SELECT *, row_number() OVER (ORDER BY source_id, survey, band) - 1 AS place, count(*) OVER () AS n FROM (SELECT source_id, survey, band, sum(flux / pow(flux_error, 2)) / sum(1 / pow(flux_error, 2)) AS base, min(mjd) AS first, max(mjd) AS last, median(flux_error) AS error FROM good GROUP BY ALL HAVING count(DISTINCT mjd) >= 3))",
        "trial AS (SELECT a, t, [1e0, 5e0, 20e0, 80e0][a + 1] AS amplitude, CAST('0x' || substr(sha256('1|curve|' || a || '|' || t), 1, 13) AS BIGINT) AS c, CAST('0x' || substr(sha256('1|centre|' || a || '|' || t), 1, 13) AS BIGINT) / 4503599627370496e0 AS u FROM (SELECT unnest(range(4)) AS a), (SELECT unnest(range(200)) AS t))",
        "pick AS (SELECT a, t, amplitude, source_id, survey, band, base, first + u * (last - first) AS centre, amplitude * error AS height FROM trial JOIN curve ON place = c % n)",
        "j AS (SELECT a, t, amplitude, exp(-0.5e0 * pow(mjd - centre, 2)) AS s, 1 / pow(flux_error, 2) AS w, flux - base AS y, height FROM pick JOIN good USING (source_id, survey, band))",
        "z AS (SELECT a, t, amplitude, CASE WHEN sum(s * s * w) > 0 THEN sum(s * (y + height * s) * w) / sqrt(sum(s * s * w)) ELSE 0e0 END AS z FROM j GROUP BY ALL)",
        "g AS (SELECT amplitude, count(*) AS n, count(*) FILTER (z >= 5) AS recovered, median(z) AS median_z FROM z GROUP BY amplitude)", "f AS (SELECT *, recovered / CAST(n AS DOUBLE) AS p, 1.959963984540054e0 AS q FROM g)",
    )
    + """SELECT amplitude, n, recovered, p AS fraction, greatest(0e0, (p + q * q / (2 * n) - q * sqrt(p * (1 - p) / n + q * q / (4 * n * n))) / (1 + q * q / n)) AS low,
         least(1e0, (p + q * q / (2 * n) + q * sqrt(p * (1 - p) / n + q * q / (4 * n * n))) / (1 + q * q / n)) AS high, median_z FROM f"""
)
def i11_injection_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.inject_and_recover(D.phot(spark, sf_dir), [1.0, 5.0, 20.0, 80.0], 200, 1.0, 5.0)


# ---- streams


@query("SELECT event_type, count(*) AS n, count(*) AS n_digests FROM events GROUP BY event_type")
def l6_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.event_log(spark, sf_dir)


@query(
    """WITH e AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type AS stream, event_id || '|' || event_type || '|' || props AS payload FROM events),
       r AS (SELECT *, CASE WHEN value IS NULL THEN 'no_value' WHEN value <= 0 THEN 'not_positive' WHEN k IS NULL THEN 'no_key' WHEN k = 13 THEN 'flagged' END AS reason FROM e)
       SELECT sha256(payload) AS digest, stream, reason, payload, CAST(CASE WHEN event_id % 2 = 0 AND event_id % 4 = 0 THEN 2 ELSE 1 END AS BIGINT) AS arrivals, CASE WHEN event_id % 3 = 0 THEN 'resolved' ELSE 'open' END AS status,
              CASE WHEN event_id % 3 = 0 THEN 'checked by hand' END AS resolution, CAST(0 AS BIGINT) AS n_refused FROM r WHERE reason IS NOT NULL
       UNION ALL SELECT sha256(payload), NULL, NULL, NULL, 0, 'unknown', NULL, 1 FROM r WHERE reason IS NULL AND event_id % 101 = 0"""
)
def l3_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad payloads of two runs of a stream; the second repeats some and brings the resolutions, some of them for payloads that were good."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    reason = F.when(F.col("value").isNull(), "no_value").when(F.col("value") <= 0, "not_positive").when(k.isNull(), "no_key").when(k == 13, "flagged")
    e = D.table(spark, sf_dir, "events").withColumn("payload", F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")).withColumn("reason", reason)
    bad = e.where("reason is not null").select("event_id", F.sha2("payload", 256).alias("digest"), F.col("event_type").alias("stream"), "reason", "payload", F.lit(None).cast("string").alias("resolution"))
    closed = e.where("event_id % 3 = 0 and reason is not null or event_id % 101 = 0 and reason is null").select(F.sha2("payload", 256).alias("digest"), F.lit("checked by hand").alias("resolution"))
    root, columns = Scratch(spark, "letters").root, ["digest", "stream", "reason", "payload", "resolution"]
    for n, rows in enumerate((bad.where("event_id % 2 = 0"), bad.where("event_id % 2 = 1 or event_id % 4 = 0"))):
        rows.select(*columns).write.parquet(f"{root}/in/part={n}")
        if n:
            closed.select("digest", *(F.lit(None).cast("string").alias(c) for c in columns[1:4]), "resolution").write.parquet(f"{root}/in/part={n + 10}")
        letters.run(spark, f"{root}/in", ", ".join(f"{c} string" for c in columns), "digest", letters.Letters, letters.LETTER, root)
    return letters.latest(spark, letters.LETTER, "digest", root)


@query("SELECT epoch_us(ts) // 86400000000 AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def f14_stream_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.windowed_counts(spark, sf_dir)
