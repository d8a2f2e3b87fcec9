"""Score tables: weighted components from fixed scales and weights, and the ordered rules that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumisift.functions.scalars import log_score, logistic, saturate, unit
from lumisift.operators.decisions import first_rule

# Fixed values of the review priority: weights, then scales.
WEIGHTS = {"amplitude": 0.24, "significance": 0.22, "temporal": 0.15, "nondetection": 0.12, "sampling": 0.12, "data_quality": 0.15}
AMPLITUDE_MAG, FLUX_FRACTION, SIGMA_MIDPOINT, SIGMA_WIDTH = 0.8, 1.0, 4.0, 1.5
RATE_MAG, RATE_FLUX, CONTRAST_MAG, CONTRAST_SIGMA, RECENCY_DAYS, DETECTIONS, PREFERRED = 0.5, 0.5, 1.0, 3.0, 7.0, 8.0, 3


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def _rising(x: Column, scale: float) -> Column:
    return F.coalesce(saturate(x, scale), F.lit(0.0))


def review_priority(features: DataFrame) -> DataFrame:
    """Bounded priority of each source with its six components; magnitudes first, fluxes where they are missing."""
    top = lambda *names: F.greatest(*(F.col(n) for n in names))  # noqa: E731  nulls are skipped
    size = lambda high, typical, scale: 0.6 * _rising(top(high, typical), scale) + 0.4 * _rising(F.col(typical), scale)
    by_mag = top("brightening", "typical_amplitude").isNotNull()
    by_flux = top("flux_excursion", "typical_flux_excursion").isNotNull()
    amplitude = F.when(by_mag, size("brightening", "typical_amplitude", AMPLITUDE_MAG)).when(by_flux, size("flux_excursion", "typical_flux_excursion", FLUX_FRACTION)).otherwise(0.0)
    sigma = F.coalesce("significance", top("mag_significance", "flux_significance"))
    certain = F.coalesce(logistic((sigma - SIGMA_MIDPOINT) / SIGMA_WIDTH), F.lit(0.0))
    rate = F.when(top("rise", "fade").isNotNull(), _rising(top("rise", "fade"), RATE_MAG)).otherwise(_rising(top("flux_rise", "flux_fade"), RATE_FLUX))
    contrast = F.greatest(_rising(F.col("contrast"), CONTRAST_MAG), _rising(F.col("flux_contrast"), CONTRAST_SIGMA))
    recent = F.coalesce(F.exp(-F.greatest(F.lit(0.0), F.col("gap")) / RECENCY_DAYS), F.lit(0.0))
    before = F.when(F.coalesce("has_prior", F.lit(False)), 0.65 * contrast + 0.35 * recent).otherwise(0.0)
    sampling = 0.5 * _rising(_zero("n_detections"), DETECTIONS) + 0.2 * _rising(_zero("n_bands"), 2.0) + 0.3 * _rising(_zero("n_significant"), 2.0)
    share = lambda c, default: unit(F.coalesce(F.col(c), F.lit(default)))
    quality = unit(1 - 0.40 * share("missing_fraction", 1.0) - 0.25 * share("quality_rejected", 0.0) - 0.20 * share("error_missing", 0.0) - 0.15 * share("detection_rejected", 0.0))
    r = features.withColumns({"amplitude": amplitude, "significance_score": certain, "temporal": rate, "nondetection": before, "sampling": sampling, "data_quality": quality})
    name = lambda k: "significance_score" if k == "significance" else k
    raw = sum((w * F.col(name(k)) for k, w in WEIGHTS.items()), F.lit(0.0))
    sparse = F.when(_zero("n_detections") < PREFERRED, 0.65 + 0.35 * _zero("n_detections") / PREFERRED).otherwise(1.0)
    priority = F.greatest(F.lit(0.0), F.least(F.lit(0.999999), raw * sparse * (0.75 + 0.25 * F.col("data_quality"))))
    return r.withColumn("priority", priority)


def quality_reasons(features: DataFrame, least: int) -> DataFrame:
    """Reasons for which a source has too little to be reviewed, joined; empty if it passes."""
    reasons = F.array(
        F.when(F.col("n_detections") < least, "too few detections"), F.when(F.col("n_bands") < 1, "no band with detections"),
        F.when(F.coalesce("missing_fraction", F.lit(1.0)) >= 1, "no complete measurement"), F.when(F.coalesce("error_missing", F.lit(1.0)) >= 1, "no valid uncertainty"),
    )
    text = F.concat_ws("; ", F.array_compact(reasons))
    return features.withColumns({"quality_reasons": text, "quality_passed": text == ""})


def flare_scores(features: DataFrame, fresh_days: float, max_days: float, least_score: float) -> DataFrame:
    """Score, class and tier of nuclear flares; recency counts from the newest time of the table."""
    r = features.crossJoin(F.broadcast(features.agg(F.max("last").alias("newest"))))
    recency = unit(1 - F.greatest(F.lit(0.0), F.col("newest") - F.coalesce("last", "newest")) / 30.0)
    parts = 0.25 * _zero("smoothness") + 0.20 * _zero("duration_score") + 0.20 * _zero("amp_score") + 0.15 * _zero("snr_score") + 0.10 * unit(_zero("probability")) + 0.10 * recency
    score = F.greatest(F.lit(0.0), parts - 0.10 * unit(_zero("duration") / max(max_days, 1.0)))
    agn = F.coalesce(F.col("known_agn"), F.lit(False))
    smooth, long = _zero("smoothness") >= 0.65, _zero("duration") >= 10
    kind = first_rule(
        ((_zero("duration") > 365) & ~agn, "long_running_variable_or_unclear"), (agn | (F.col("infrared_colour") >= 0.8), "possible_agn_flare"), (F.col("redshift").isNotNull() & smooth & long, "possible_tde_candidate"),
        (smooth & long & (_zero("slope") < 0), "nuclear_flare_candidate_needs_host_check"), otherwise="low_priority_blackhole_related",
    )
    r = r.withColumns({"score": score, "kind": kind, "age": F.greatest(F.lit(0.0), F.col("newest") - F.col("first"))})
    tier = first_rule(
        (F.col("duration") > max_days, "long_running_source"), ((F.col("score") >= least_score) & (F.col("age") <= fresh_days) & (F.col("kind") != "long_running_variable_or_unclear"), "high_priority"), otherwise="review_later"
    )
    return r.withColumn("tier", tier).drop("newest")


def reservoir_scores(orbits: DataFrame) -> DataFrame:
    """Class and score of distant objects from orbit elements (class, kind, a, ad, q, e, per_y, condition, arc, n_obs)."""
    comet = F.col("kind").startswith("c") & (F.col("class").isin("PAR", "HYP") | (_zero("a") >= 100) | (_zero("ad") >= 100) | (_zero("e") >= 0.98))
    kind = first_rule((comet, "oort_cloud_like_comet"), (F.col("class") == "CEN", "centaur_transition_object"), (F.col("class") == "TNO", "kuiper_belt_tno"), otherwise="other_distant_object")
    tno = unit(0.6 * unit((_zero("q") - 30.1) / 20) + 0.4 * unit((_zero("a") - 30.1) / 100))
    centaur = unit((_zero("a") - 5.5) / (30.1 - 5.5))
    open_orbit = F.col("class").isin("PAR", "HYP").cast("double")
    oort = unit(0.30 * log_score(_zero("a"), 1000.0) + 0.25 * log_score(_zero("ad"), 5000.0) + 0.20 * log_score(_zero("per_y"), 10000.0) + 0.15 * unit((_zero("e") - 0.9) / 0.1) + 0.10 * open_orbit)
    r = orbits.withColumn("reservoir", kind)
    signal = F.when(F.col("reservoir") == "oort_cloud_like_comet", oort).when(F.col("reservoir") == "centaur_transition_object", centaur).when(F.col("reservoir") == "kuiper_belt_tno", tno).otherwise(0.0)
    orbit = unit(1 - F.coalesce("condition", F.lit(4.5)) / 9)
    support = unit(0.55 * log_score(_zero("arc"), 3650.0) + 0.45 * log_score(_zero("n_obs"), 1000.0))
    return r.withColumn("signal", signal).withColumn("score", unit(0.65 * F.col("signal") + 0.25 * orbit + 0.10 * support))


def verification(moving: Column, known: Column, checked: Column, succeeded: Column) -> Column:
    pending = ~F.coalesce(checked, F.lit(False)) | ~F.coalesce(succeeded, F.lit(False))
    return first_rule((moving, "reject_moving_object"), (known, "reject_known_object"), (pending, "needs_check_before_reporting"), otherwise="likely_new_candidate")


def shortlist(rows: DataFrame, max_age: float, max_detections: int, max_span: float, vetoed: tuple[str, ...]) -> DataFrame:
    """Final decision from ``verification`` and ``catalogue``, then freshness vetoes in order."""
    veto = first_rule(
        (F.upper(F.trim("object_class")).isin(*vetoed), "class"), (F.col("age") > max_age, "first_detection_too_old"), (F.col("n_detections") > max_detections, "too_many_detections"),
        (F.greatest(F.lit(0.0), F.col("last") - F.col("first")) > max_span, "span_too_long"), otherwise="",
    )
    v, c = F.col("verification"), F.col("catalogue")
    rule = first_rule(
        (v == "reject_known_object", "reject_known_object"), (v == "reject_moving_object", "reject_moving_object"), (c == "reject_variable", "reject_known_variable"), (c.startswith("review"), "needs_manual_catalogue_review"),
        (c == "possible_host", "needs_manual_host_review"), (v == "needs_check_before_reporting", "block_pending_check"), (F.coalesce(v != "likely_new_candidate", F.lit(True)), "reject_verification_status"),
        (F.coalesce(c != "pass", F.lit(True)), "reject_catalogue_status"), (F.col("veto") != "", "reject_freshness_veto"), otherwise="reportable_candidate",
    )
    return rows.withColumn("veto", veto).withColumn("decision", rule)


def followup(reality: Column, novelty: Column, value: Column, urgency: Column, visible: Column, gain: Column, anomaly: Column) -> tuple[Column, Column]:
    """Priority and the route that set it: the product of the factors, or the reserve for anomalies."""
    core = reality * novelty * F.sqrt(F.greatest(value * urgency, F.lit(0.0))) * F.sqrt(F.greatest(visible * gain, F.lit(0.0)))
    reserve = 0.35 * anomaly * reality * visible
    return F.least(F.lit(1.0), F.greatest(core, reserve)), F.when(reserve > core, "anomaly_reserve").otherwise("core")


def worst_status(checks: DataFrame, keys: list[str]) -> DataFrame:
    """One status of several epochs: the most conservative one, and the earliest expiry."""
    order = ["match", "error", "stale", "pending", "clear"]
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("status"))
    g = checks.groupBy(*keys).agg(F.min(rank).alias("worst"), F.min("expires_hour").alias("expires_hour"), F.count("*").alias("n_epochs"))
    return g.select(*keys, F.element_at(F.array(*map(F.lit, order)), F.col("worst").cast("int")).alias("status"), "expires_hour", "n_epochs")


def required_evidence(sources: DataFrame, checks: DataFrame, required: list[str], now_hour: int) -> DataFrame:
    """Missing, not passing and stale checks of every source; only a fresh clear one without a rival passes."""
    from lumisift.operators.review import latest_checks

    need = sources.select("source_id", F.explode(F.array(*map(F.lit, required))).alias("service"))
    j = need.join(latest_checks(checks), ["source_id", "service"], "left")
    state = first_rule((F.col("status").isNull(), "missing"), (F.col("conflicting"), "failing"), (F.col("expires_hour") <= now_hour, "stale"), (F.col("status") != "clear", "failing"), otherwise="pass")
    g = j.withColumn("state", state)
    listed = lambda s: F.array_join(F.sort_array(F.collect_list(F.when(F.col("state") == s, F.col("service")))), ",")
    return g.groupBy("source_id").agg(listed("missing").alias("missing"), listed("failing").alias("failing"), listed("stale").alias("stale"), F.bool_and(F.col("state") == "pass").alias("reportable"))


def epochs_uncovered(references: Column, queries: Column, tolerance: float) -> Column:
    """How many sorted reference epochs have no query epoch of their own within the tolerance, matched in order."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("missed"))

    def step(acc: Column, ref: Column) -> Column:
        # the first query epoch from `at` on that is not too early; queries are sorted, so it is found by counting
        at = F.greatest(acc["at"], F.size(F.filter(queries, lambda q: q < ref - tolerance)))
        hit = F.coalesce(F.get(queries, at) <= ref + tolerance, F.lit(False))
        return F.struct((at + hit.cast("int")).alias("at"), (acc["missed"] + (~hit).cast("int")).alias("missed"))

    return F.aggregate(references, start, step, lambda a: a["missed"])


def bound_checks(checks: DataFrame, now_hour: int, radius: float, tolerance: float) -> DataFrame:
    """Clear checks that may not count are downgraded with a reason; a match always stays a match."""
    missed = epochs_uncovered(F.col("references"), F.col("queries"), tolerance)
    reason = first_rule(
        (F.col("status") != "clear", ""), (F.coalesce(F.col("expires_hour") <= now_hour, F.lit(True)), "expired"), (F.coalesce(F.col("digest") != F.col("expected_digest"), F.lit(True)), "digest"),
        (F.coalesce(F.col("queried") != F.col("source_id"), F.lit(True)), "identity"), (F.coalesce(F.col("offset") > radius, F.lit(True)), "position"), (F.coalesce(missed > 0, F.lit(True)), "epochs"), otherwise="",
    )
    return checks.withColumn("reason", reason).withColumn("bound_status", F.when(F.col("reason") != "", "stale").otherwise(F.col("status")))


def adjudication(decisions: DataFrame) -> DataFrame:
    """Per candidate version: blocked by any latest rejection, cleared by an approval where nothing blocks."""
    latest = decisions.groupBy("candidate", "version", "reviewer").agg(F.max_by("verdict", "review_id").alias("verdict"))
    g = latest.groupBy("candidate", "version").agg(F.bool_or(F.col("verdict") == "reject").alias("blocked"), F.bool_or(F.col("verdict") == "approve").alias("any"), F.count("*").alias("n"))
    return g.select("candidate", "version", "n", "blocked", (F.col("any") & ~F.col("blocked")).alias("cleared"))


def weighted_rank(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Sum of weight * log(1 + component), for weights that are not negative, and the place by it."""
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    return rows.withColumn("rank_score", sum((w * F.log1p(F.col(c)) for c, w in weights.items()), F.lit(0.0)))


def t_interval(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and 95 % t interval over repeats; between tabulated degrees of freedom the smaller one counts."""
    table = [(1, 12.706), (2, 4.303), (3, 3.182), (4, 2.776), (5, 2.571), (6, 2.447), (7, 2.365), (8, 2.306), (9, 2.262), (10, 2.228), (15, 2.131), (20, 2.086), (30, 2.042), (60, 2.000), (120, 1.980)]
    g = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    critical = F.lit(None).cast("double")
    for freedom, t in table:
        critical = F.when(F.col("n") - 1 >= freedom, t).otherwise(critical)
    half = critical * F.col("sd") / F.sqrt("n")
    return g.select(*keys, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def band_mean_flux(spectra: DataFrame, transmission: DataFrame) -> DataFrame:
    """Per object and band: the integral of flux * response over that of response, by trapezoids over frequency.

    ``spectra`` (object, nu, flux), ``transmission`` (band, nu, response) on the same frequencies; an equi-join.
    """
    j = spectra.join(transmission, "nu")
    w = Window.partitionBy("object", "band").orderBy("nu")
    width, after = F.lead("nu").over(w) - F.col("nu"), F.lead("response").over(w)
    j = j.withColumns({"area": width * (F.col("response") + after) / 2, "signal": width * (F.col("flux") * F.col("response") + F.lead("flux").over(w) * after) / 2})
    g = j.groupBy("object", "band").agg(F.sum("signal").alias("s"), F.sum("area").alias("a"), F.count("*").alias("n"))
    return g.select("object", "band", "n", F.when(F.col("a") > 0, F.col("s") / F.col("a")).alias("mean_flux"))
