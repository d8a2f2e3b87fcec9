"""Queries over further features, queues, tokens, masks and models, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumisift.functions import scalars as S
from lumisift.operators import evaluation, legacy, neighbours, retrieval, review, surprise
from lumisift.plans.queries import ORACLE, QUERIES, _with, query
from lumisift.plans.score_queries import _FEAT, _feat
from lumisift.plans.scratch import Scratch
from lumisift.sources import derived as D


@query()
def e10_e11_legacy_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy.legacy_features(D.phot(spark, sf_dir))


@query(
    _with(
        D.PHOT, _FEAT, "m AS (SELECT median(amp) AS ma, median(bright) AS mb, median(sigma) AS ms FROM feat)",
        "s AS (SELECT 1.4826e0 * median(abs(amp - ma)) AS sa, 1.4826e0 * median(abs(bright - mb)) AS sb, 1.4826e0 * median(abs(sigma - ms)) AS ss FROM feat, m)",
        "c AS (SELECT greatest(ma - 5 * sa, least(ma + 5 * sa, amp)) AS a, greatest(mb - 5 * sb, least(mb + 5 * sb, bright)) AS b, greatest(ms - 5 * ss, least(ms + 5 * ss, sigma)) AS g FROM feat, m, s)",
    )
    + """SELECT 'amp' AS a, 'amp' AS b, covar_samp(a, a) + 1e-6 AS covariance, count(*) AS n FROM c UNION ALL SELECT 'amp', 'bright', covar_samp(a, b), count(*) FROM c UNION ALL SELECT 'amp', 'sigma', covar_samp(a, g), count(*) FROM c
         UNION ALL SELECT 'bright', 'bright', covar_samp(b, b) + 1e-6, count(*) FROM c UNION ALL SELECT 'bright', 'sigma', covar_samp(b, g), count(*) FROM c UNION ALL SELECT 'sigma', 'sigma', covar_samp(g, g) + 1e-6, count(*) FROM c""",
    "covariance",
)
def e25_clipped_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy.clipped_covariance(_feat(spark, sf_dir), ["amp", "bright", "sigma"])


@query("SELECT count(*) AS n_features, avg(sd) AS mean_std, min(sd) AS least_std, count(*) FILTER (sd < 1e-4) / count(*) AS collapsed FROM (SELECT pos, stddev_pop(v) AS sd FROM (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos)", "mean_std least_std collapsed")
def e26_representation_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = D.table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("pos", "v")).groupBy("pos").agg(F.stddev_pop(F.col("v").cast("double")).alias("sd"))
    return per.agg(F.count("*").alias("n_features"), F.avg("sd").alias("mean_std"), F.min("sd").alias("least_std"), (F.count_if(F.col("sd") < 1e-4) / F.count("*")).alias("collapsed"))


@query()
def e26_effective_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.representation_health(D.table(spark, sf_dir, "embeddings"), "embedding")


@query()
def h8_h9_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.ranking(spark, sf_dir).withColumn("score_b", F.when(F.col("entity") % 9 > 0, F.col("score_b")))
    early = F.col("entity") % 3 < 2
    return legacy.baseline_scores(r.where(early), r.where(~early), ["score_a", "score_b", "score_c"], "label").select("entity", "label", "score")


@query(
    _with(D.PHOT)
    + """SELECT CASE WHEN survey = 's0' THEN k % 4 = 0 ELSE NOT (k % 7 = 0 OR k % 11 = 0 OR k = 5) END AS usable, survey, count(*) AS n FROM phot WHERE is_detection GROUP BY ALL"""
)
def b4_broker_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    p = D.phot(spark, sf_dir).where("is_detection").withColumns({
        "isdiffpos": F.element_at(F.array(*map(F.lit, (" T", "f", "-1", "0"))), (k % 4 + 1).cast("int")), "flag_edge": (k % 7 == 0).cast("int"), "flag_saturated": (k % 11 == 0).cast("int"), "withdrawn": F.when(k == 5, "60300.5"),
    })
    usable = S.broker_quality(F.col("survey") == "s0", F.col("isdiffpos"), [F.col("flag_edge"), F.col("flag_saturated")], F.col("withdrawn"))
    return p.groupBy(usable.alias("usable"), "survey").agg(F.count("*").alias("n"))


@query(
    _with(D.PHOT)
    + "SELECT source_id AS entity_id, count(*) FILTER (is_detection) AS n_detector, count(*) AS n_sequence, count(*) FILTER (quality) AS n_pipeline, max(mjd) AS cutoff FROM phot WHERE mjd <= 60325 GROUP BY source_id", "cutoff",
)
def a11_aligned_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.phot(spark, sf_dir).where("mjd <= 60325").withColumnRenamed("source_id", "entity_id")
    detector = rows.where("is_detection").groupBy("entity_id").agg(F.count("*").alias("n_detector"))
    sequence = rows.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("mjd", "flux"))).alias("s")).select("entity_id", F.size("s").cast("long").alias("n_sequence"), F.element_at("s", -1)["mjd"].alias("cutoff"))
    pipeline = rows.where("quality").groupBy("entity_id").agg(F.count("*").alias("n_pipeline"))
    return sequence.join(detector, "entity_id", "left").join(pipeline, "entity_id", "left").na.fill(0, ["n_detector", "n_pipeline"])


@query(
    _with(
        D.PHOT, D.SOURCES, D.CHECKS, _FEAT,
        """c AS (SELECT source_id, string_agg('{"service":"' || service || '","attempt":' || attempt || ',"status":"' || status || '","checked_hour":' || checked_hour || ',"expires_hour":' || expires_hour || '}', ',' ORDER BY service, attempt) AS checks
                 FROM checks GROUP BY source_id)""",
        """t AS (SELECT source_id, string_agg('{"survey":"' || survey || '","band":"' || band || '","n":' || n || ',"first":"' || first || '","last":"' || last || '"}', ',' ORDER BY survey, band) AS timeline
                 FROM (SELECT source_id, survey, band, count(*) AS n, arg_min(observation_id, (mjd, event_id)) AS first, arg_max(observation_id, (mjd, event_id)) AS last FROM phot GROUP BY ALL) GROUP BY source_id)""",
        """d AS (SELECT source_id, '{"source_id":"' || source_id || '","features":{"n_detections":' || n_detections || ',"n_bands":' || n_bands || '},"checks":[' || checks || '],"timeline":[' || timeline || ']}' AS dossier
                 FROM feat JOIN c USING (source_id) JOIN t USING (source_id))""",
    )
    + "SELECT source_id, dossier, sha256(dossier) AS digest FROM d"
)
def a18_dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One portable row of evidence for each source: features, all checks, the history of its channels, and a digest."""
    listed = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    checks = D.checks(spark, sf_dir).groupBy("source_id").agg(listed("service", "attempt", "status", "checked_hour", "expires_hour").alias("checks"))
    when = F.struct("mjd", "event_id")
    ends = D.phot(spark, sf_dir).groupBy("source_id", "survey", "band").agg(F.count("*").alias("n"), F.min_by("observation_id", when).alias("first"), F.max_by("observation_id", when).alias("last"))
    j = _feat(spark, sf_dir).join(checks, "source_id").join(ends.groupBy("source_id").agg(listed("survey", "band", "n", "first", "last").alias("timeline")), "source_id")
    dossier = F.to_json(F.struct("source_id", F.struct("n_detections", "n_bands").alias("features"), "checks", "timeline"))
    return j.select("source_id", dossier.alias("dossier")).withColumn("digest", F.sha2("dossier", 256))


_STORED = ORACLE["e20_rolling_origin"].replace("JOIN documents d ON l.doc_id = d.doc_id", "JOIN documents d ON l.doc_id = d.doc_id WHERE l.doc_id % 11 > 0")


@query(
    f"""SELECT model, count(*) AS n, count(*) FILTER (coalesce(abs(a.average_precision - b.average_precision) > 1e-6, TRUE)) AS n_disagree
        FROM ({ORACLE["e20_rolling_origin"]}) a FULL JOIN ({_STORED}) b USING (fold, model) GROUP BY model"""
)
def c20_benchmark_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored benchmark, made when some entities were not labelled yet, against one made anew; both with six decimals, as stored."""
    r = D.ranking(spark, sf_dir)
    rolled = lambda rows: evaluation.rolling_origin(rows, ["score_a", "score_b", "score_c"], 4, 10).select("fold", "model", S.rounded(F.col("average_precision")).alias("average_precision"))
    stored = Scratch(spark, "benchmark").table(rolled(r.where("entity % 11 > 0")).withColumnRenamed("average_precision", "stored"), "stored")
    j = rolled(r).join(stored, ["fold", "model"], "full")
    wrong = F.coalesce(F.abs(F.col("stored") - F.col("average_precision")) > 1e-6, F.lit(True))
    return j.groupBy("model").agg(F.count("*").alias("n"), F.count_if(wrong).alias("n_disagree"))


@query(
    _with(D.REVIEWS, "cur AS (SELECT candidate, arg_max(version, (day, review_id)) AS version FROM reviews GROUP BY candidate)")
    + """SELECT CASE WHEN c.version IS NULL THEN 'stale_version' WHEN day > 10000 THEN 'after_cutoff' WHEN verdict = 'defer' THEN 'no_label' ELSE 'valid' END AS outcome, count(*) AS n
         FROM reviews r LEFT JOIN cur c ON c.candidate = r.candidate AND c.version = r.version GROUP BY ALL"""
)
def c19_matured_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.reviews(spark, sf_dir)
    j = r.join(review.current_versions(r).withColumn("current", F.lit(True)), ["candidate", "version"], "left")
    outcome = F.when(F.col("current").isNull(), "stale_version").when(F.col("day") > 10000, "after_cutoff").when(F.col("verdict") == "defer", "no_label").otherwise("valid")
    return j.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(
    _with(
        D.PHOT, _FEAT, "e AS (SELECT source_id, number % 5 AS grp, number % 2 AS pop, amp, sqrt(2e0) * sigma / 100 AS sg, bright, last FROM feat WHERE amp IS NOT NULL)",
        "q AS (SELECT source_id AS query, grp AS q_grp, pop, amp AS q_amp, sg AS q_sg, last AS cutoff FROM e WHERE CAST(source_id AS BIGINT) % 10 = 0)",
        "p AS (SELECT query, source_id AS entry, pow(q_amp - amp, 2) + pow(q_sg - sg, 2) AS d, sg, bright FROM q JOIN e USING (pop) WHERE q_grp <> grp AND last + 0.25e0 <= cutoff)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, entry) AS i, min(d) OVER (PARTITION BY query) AS d1 FROM p QUALIFY i <= 3)", "w AS (SELECT *, exp(-(d - d1)) / sum(exp(-(d - d1))) OVER (PARTITION BY query) AS weight FROM r)",
        "g AS (SELECT query, count(*) AS n, string_agg(entry, ',' ORDER BY i) AS neighbours, min(d) AS nearest, -sum(CASE WHEN weight > 0 THEN weight * ln(weight) ELSE 0e0 END) AS entropy, sum(weight * sg) AS recalled_sg, sum(weight * bright) AS recalled_bright FROM w GROUP BY query)",
    )
    + """SELECT query, coalesce(n, 0) AS n, coalesce(neighbours, '') AS neighbours, nearest, coalesce(entropy, 0e0) AS entropy, recalled_sg, recalled_bright,
         coalesce((1 - 0.5e0 * CASE WHEN n > 1 THEN entropy / ln(n) ELSE 0e0 END) / (1 + exp(least(60e0, nearest))), 0e0) AS gate, n IS NOT NULL AS supported FROM q LEFT JOIN g USING (query)""",
    "nearest entropy recalled_sg recalled_bright gate",
)
def d14_memory_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _feat(spark, sf_dir).where("amp is not null").select(
        F.col("source_id").alias("id"), (F.col("number") % 5).alias("source_group"), F.lit("c").alias("calibration"), (F.col("number") % 2).alias("population"),
        F.array("amp", F.sqrt(F.lit(2.0)) * F.col("sigma") / 100).alias("key"), F.array(F.sqrt(F.lit(2.0)) * F.col("sigma") / 100, "bright").alias("residual"), "last",
    )
    q = e.where("cast(id as bigint) % 10 = 0").select("id", "source_group", "calibration", "population", "key", F.col("last").alias("cutoff"))
    got = retrieval.recall(e.withColumn("usable_at", F.col("last") + 0.25).drop("last"), q, 3)
    return got.select("query", "n", F.coalesce(F.array_join("neighbours", ","), F.lit("")).alias("neighbours"), "nearest", "entropy", F.get("residual", F.lit(0)).alias("recalled_sg"), F.get("residual", F.lit(1)).alias("recalled_bright"), "gate", "supported")


@query(
    _with(
        D.REVIEWS, "cur AS (SELECT candidate, arg_max(version, (day, review_id)) AS version FROM reviews GROUP BY candidate)",
        "tot AS (SELECT candidate, version, count(*) AS n_reviews, arg_max(verdict, review_id) AS latest FROM reviews GROUP BY ALL)", "act AS (SELECT candidate, version, count(*) AS n_active FROM (SELECT DISTINCT candidate, version, reviewer, role FROM reviews) GROUP BY ALL)",
    )
    + "SELECT candidate, version, n_reviews, n_active, latest FROM cur JOIN tot USING (candidate, version) JOIN act USING (candidate, version)"
)
def d19_version_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.reviews(spark, sf_dir)
    total = r.groupBy("candidate", "version").agg(F.count("*").alias("n_reviews"), F.max_by("verdict", "review_id").alias("latest"))
    active = review.active_decisions(r).groupBy("candidate", "version").agg(F.count("*").alias("n_active"))
    return review.current_versions(r).join(total, ["candidate", "version"]).join(active, ["candidate", "version"])


@query(_with(D.PHOT) + "SELECT event_id, row_number() OVER (PARTITION BY source_id ORDER BY mjd, band, event_id) AS place FROM phot")
def f5_canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.phot(spark, sf_dir).select("event_id", F.row_number().over(Window.partitionBy("source_id").orderBy("mjd", "band", "event_id")).cast("long").alias("place"))


_TOKENS = "tok AS (SELECT event_id, source_id, mjd, flux, row_number() OVER w AS i, count(*) OVER (PARTITION BY source_id) AS n, mjd - lag(mjd) OVER w AS step, mjd - first_value(mjd) OVER w AS elapsed FROM phot WHERE is_detection WINDOW w AS (PARTITION BY source_id ORDER BY mjd, event_id))"
_MASK = "mask AS (SELECT *, greatest(1, floor(n * 0.3e0)) AS size, CAST('0x' || substr(sha256(source_id), 1, 4) AS BIGINT) % (n - greatest(1, floor(n * 0.3e0)) + 1) AS start FROM tok WHERE n >= 2)"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source_id").orderBy("mjd", "event_id")
    p = D.phot(spark, sf_dir).where("is_detection")
    return p.select(
        "event_id", "source_id", "mjd", "flux", F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy("source_id")).alias("n"), (F.col("mjd") - F.lag("mjd").over(w)).alias("step"), (F.col("mjd") - F.first("mjd").over(w)).alias("elapsed")
    )


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of a fixed share of each sequence, from a place by hash; at least one row stays as context."""
    size = F.greatest(F.lit(1), F.floor(F.col("n") * 0.3))
    draw = F.conv(F.substring(F.sha2("source_id", 256), 1, 4), 16, 10).cast("bigint")
    t = _tokens(spark, sf_dir).where("n >= 2").withColumn("size", size).withColumn("start", F.pmod(draw, F.col("n") - F.col("size") + 1))
    return t.withColumn("masked", (F.col("i") > F.col("start")) & (F.col("i") <= F.col("start") + F.col("size")))


@query(_with(D.PHOT, _TOKENS) + "SELECT event_id, coalesce(ln(1 + step), 0e0) AS log_step, ln(1 + elapsed) AS log_elapsed FROM tok", "log_step log_elapsed")
def f10_forecast_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select("event_id", F.coalesce(F.log1p("step"), F.lit(0.0)).alias("log_step"), F.log1p("elapsed").alias("log_elapsed"))


@query(_with(D.PHOT, _TOKENS, _MASK) + "SELECT event_id, i > start AND i <= start + size AS masked FROM mask")
def f11_target_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir).select("event_id", "masked")


@query(
    _with(D.PHOT, _TOKENS, _MASK, "ctx AS (SELECT source_id, median(flux) AS centre FROM mask WHERE NOT (i > start AND i <= start + size) GROUP BY source_id)")
    + "SELECT event_id, flux - centre AS rebased FROM mask JOIN ctx USING (source_id)", "rebased",
)
def f12_context_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _masked(spark, sf_dir)
    context = m.where("not masked").groupBy("source_id").agg(F.median("flux").alias("centre"))
    return m.join(context, "source_id").select("event_id", (F.col("flux") - F.col("centre")).alias("rebased"))


@query(
    _with(D.PHOT, _TOKENS, "k AS (SELECT source_id, count(*) AS n_valid, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY i) AS ids FROM tok WHERE i > n - 8 GROUP BY source_id)")
    + "SELECT source_id, n_valid, ids || repeat(',-1', 8 - CAST(n_valid AS INTEGER)) AS padded, repeat('1', CAST(n_valid AS INTEGER)) || repeat('0', 8 - CAST(n_valid AS INTEGER)) AS mask FROM k"
)
def h7_padded_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _tokens(spark, sf_dir).where("i > n - 8").groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "event_id"))), lambda x: x["event_id"]).alias("ids"))
    pad = lambda filler, x: F.concat(x, F.array_repeat(F.lit(filler), F.lit(8) - F.size(x)))
    ones = F.transform("ids", lambda _: F.lit(1))
    return last.select("source_id", F.size("ids").cast("long").alias("n_valid"), F.array_join(pad(-1, F.col("ids")).cast("array<string>"), ",").alias("padded"), F.array_join(pad(0, ones).cast("array<string>"), "").alias("mask"))


@query(
    _with(
        D.PHOT, _FEAT, "c AS (SELECT source_id AS candidate_id, amp AS priority, bright AS anomaly, (number * 37 % 100) / 100e0 AS campaign_p FROM feat)",
        "a1 AS (SELECT candidate_id, 'priority' AS route FROM c ORDER BY priority DESC, anomaly DESC, candidate_id LIMIT 8)",
        "a2 AS (SELECT candidate_id, 'detector_reserve' AS route FROM c WHERE campaign_p <= 0.2e0 AND candidate_id NOT IN (SELECT candidate_id FROM a1) ORDER BY campaign_p, candidate_id LIMIT 4)",
        "a3 AS (SELECT candidate_id, 'embedding_reserve' AS route FROM c WHERE candidate_id NOT IN (SELECT candidate_id FROM a1 UNION ALL SELECT candidate_id FROM a2) ORDER BY anomaly DESC, candidate_id LIMIT 4)",
        "a4 AS (SELECT candidate_id, 'audit' AS route FROM c WHERE candidate_id NOT IN (SELECT candidate_id FROM a1 UNION ALL SELECT candidate_id FROM a2 UNION ALL SELECT candidate_id FROM a3) ORDER BY sha256('seed' || chr(0) || candidate_id), candidate_id LIMIT 4)",
    )
    + "FROM a1 UNION ALL FROM a2 UNION ALL FROM a3 UNION ALL FROM a4"
)
def f2_four_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _feat(spark, sf_dir).select(F.col("source_id").alias("candidate_id"), F.col("amp").alias("priority"), F.col("bright").alias("anomaly"), (F.col("number") * 37 % 100 / 100.0).alias("campaign_p"))
    routes = [
        ("priority", F.lit(True), [F.desc("priority"), F.desc("anomaly")], 8), ("detector_reserve", F.col("campaign_p") <= 0.2, [F.col("campaign_p")], 4),
        ("embedding_reserve", F.lit(True), [F.desc("anomaly")], 4), ("audit", F.lit(True), [F.sha2(F.concat(F.lit("seed\0"), "candidate_id"), 256)], 4),
    ]
    return review.routed_queue(c, routes)


@query(
    _with(
        D.PHOT, "c AS (SELECT survey, CAST(source_id AS BIGINT) AS number, count(*) FILTER (is_detection) AS hits, count(*) AS size FROM phot GROUP BY ALL)",
        "m AS (SELECT *, row_number() OVER (PARTITION BY survey ORDER BY number) AS i, count(*) OVER (PARTITION BY survey) AS n FROM c)",
        "d AS (SELECT survey, rep, CAST('0x' || substr(sha256('1|' || survey || '|' || rep || '|' || i), 1, 13) AS BIGINT) % n + 1 AS i FROM m, (SELECT unnest(range(1, 201)) AS rep))",
        "r AS (SELECT survey, rep, sum(hits) / sum(size) AS ratio FROM d JOIN m USING (survey, i) GROUP BY ALL)",
        "v AS (SELECT r.*, r.ratio - b.ratio AS delta FROM r JOIN (SELECT rep, ratio FROM r WHERE survey = 's0') b USING (rep))",
        "p AS (SELECT survey, count(*) AS n_clusters, sum(hits) / sum(size) AS ratio FROM c GROUP BY survey)",
    )
    + """SELECT survey, n_clusters, p.ratio, quantile_cont(v.ratio, 0.025) AS low, quantile_cont(v.ratio, 0.975) AS high, quantile_cont(delta, 0.025) AS delta_low, quantile_cont(delta, 0.975) AS delta_high
         FROM v JOIN p USING (survey) GROUP BY survey, n_clusters, p.ratio""",
    "ratio low high delta_low delta_high",
)
def e23_cluster_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.phot(spark, sf_dir).groupBy("survey", F.col("source_id").cast("long").alias("number")).agg(F.count_if("is_detection").alias("hits"), F.count("*").alias("size"))
    return evaluation.ratio_bootstrap(p, "survey", "number", "hits", "size", "s0", 200)


@query()
def h11_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surprise.isolation_scores(_feat(spark, sf_dir), "source_id", ["amp", "bright", "sigma", "rejected", "missing"])


@query()
def h12_surprise_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    # predictions: the mean vector of the label, and the same moved half of the way to the mean of all
    e = D.table(spark, sf_dir, "embeddings")
    size = e.agg(F.max(F.size("embedding"))).first()[0]
    cells = e.select("label", F.posexplode("embedding").alias("pos", "v")).groupBy("label", "pos").agg(F.sum(F.col("v").cast("double")).alias("s"), F.count("v").alias("n"))
    vector = lambda v: F.transform(F.array_sort(F.collect_list(F.struct("pos", v.alias("v")))), lambda x: x["v"])
    own = cells.groupBy("label").agg(vector(F.col("s") / F.col("n")).alias("base"))
    every = cells.groupBy("pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).agg(vector(F.col("s") / F.col("n")).alias("mean"))  # one row
    rows = e.join(own, "label").crossJoin(F.broadcast(every)).withColumn("corrected", F.zip_with("base", "mean", lambda a, b: (a + b) / 2))
    rows = rows.select("vec_id", "embedding", "base", "corrected")
    covariance = surprise.residual_covariance(rows.select(F.zip_with("embedding", "base", lambda a, b: a - b).alias("residual")), "residual", size)
    return surprise.surprise_components(rows, "embedding", "base", "corrected", covariance).drop("embedding", "base", "corrected")


@query(
    _with(
        D.PHOT, _FEAT, "c AS (SELECT source_id, first, last, last + 1 AS cutoff, CAST('0x' || substr(sha256('{\"entity\":\"' || source_id || '\"}'), 1, 12) AS BIGINT) AS part FROM feat)",
        "f AS (SELECT count(*) AS n_entities, CAST(sum(part) AS VARCHAR) AS population, min(cutoff) AS first_cutoff, max(cutoff) AS last_cutoff, 0 AS n_unnamed, 0 AS n_late, 0 AS n_repeated, true AS frozen FROM c)",
    )
    + """SELECT 'same' AS embeddings, *, n_entities AS n_found, true AS exact FROM f UNION ALL SELECT 'smaller', f.*, n, n = n_entities FROM f, (SELECT count(*) AS n FROM c WHERE CAST(source_id AS BIGINT) % 9 <> 4)""",
    "first_cutoff last_cutoff",
)
def h14_reference_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _feat(spark, sf_dir).select("source_id", "first", "last", (F.col("last") + 1).alias("cutoff"))
    cohort = surprise.freeze_cohort(f, "source_id", "first", "last", "cutoff")
    rows = {"same": f, "smaller": f.where(F.col("source_id").cast("long") % 9 != 4)}
    same, smaller = (surprise.same_population(cohort, r, "source_id").select(F.lit(k).alias("embeddings"), "*") for k, r in rows.items())
    return same.unionByName(smaller)
