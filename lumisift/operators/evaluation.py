"""Ranking metrics that do not depend on the order of ties, rolling folds, bootstrap intervals and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lumisift.operators.running import numbered, running_sums
from lumisift.plans.scratch import Scratch


_BROADCAST = 100_000  # rows of a table of levels or sizes that is broadcast


def _beside(small: DataFrame) -> DataFrame:
    """A written table for a join: broadcast by its rows, as the driver builds it from them and not from small files."""
    return F.broadcast(small) if small.count() <= _BROADCAST else small.hint("merge")


def melt(rows: DataFrame, keys: list[str], scores: list[str]) -> DataFrame:
    """(keys, label, model, score), one row for each score column."""
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("model"), F.col(s).alias("score")) for s in scores))).alias("x")
    return rows.select(*keys, "label", pairs).select(*keys, "label", "x.*")


def by_score(rows: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """Per unit and distinct score: rows, positives and both summed over higher scores and this one."""
    n = F.count("*") if weight is None else F.sum(weight)
    p = F.sum("label") if weight is None else F.sum(weight * F.col("label"))
    return running_sums(rows.groupBy(*keys, "score").agg(n.alias("n"), p.alias("p")), keys, "score", ["n", "p"], descending=True)


def ranking_metrics(rows: DataFrame, keys: list[str], budget: int, weight: Column | None = None) -> DataFrame:
    """Average precision over score levels, and expected precision and recall when a budget of rows is reviewed."""
    g = by_score(rows, keys, weight)
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.lit(budget) - (F.col("cum_n") - F.col("n"))))
    m = g.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("p").alias("positives"), F.sum(F.col("p") * F.col("cum_p") / F.col("cum_n")).alias("_ap"), F.sum(F.col("p") * taken / F.col("n")).alias("_hit"))
    slots = F.least(F.lit(budget), F.col("n"))
    return m.select(
        *keys, "n", "positives", F.coalesce(F.col("_ap") / F.nullif("positives", F.lit(0)), F.lit(0.0)).alias("average_precision"),
        F.coalesce(F.col("_hit") / F.nullif(slots, F.lit(0)), F.lit(0.0)).alias("precision_at_budget"), F.coalesce(F.col("_hit") / F.nullif("positives", F.lit(0)), F.lit(0.0)).alias("recall_at_budget"),
    )


def calibration(rows: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Brier score and expected calibration error over equal-width bins, the last one closed."""
    b = rows.withColumn("bin", F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)))
    g = b.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.abs(F.avg("label") - F.avg("score")).alias("gap"), F.sum(F.pow(F.col("score") - F.col("label"), 2)).alias("sq"))
    return g.groupBy(*keys).agg((F.sum("sq") / F.sum("n")).alias("brier"), (F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"))


def rolling_origin(rows: DataFrame, scores: list[str], block_days: int, budget: int, min_history: int = 1) -> DataFrame:
    """Metrics of each score over each later time block; what lies before a block is its history."""
    fold = F.floor(F.col("time") / block_days)
    folds = rows.withColumn("fold", fold)
    w = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    history = folds.groupBy("fold").agg(F.count("*").alias("n_fold")).withColumn("history", F.coalesce(F.sum("n_fold").over(w), F.lit(0))).select("fold", "history")
    return ranking_metrics(melt(folds, ["fold"], scores), ["fold", "model"], budget).join(history, "fold").where(F.col("history") >= min_history)


def bootstrap(rows: DataFrame, scores: list[str], replicates: int, budget: int, seed: int = 1, incumbent: str | None = None, block: str | None = None, ranges: int = 64) -> DataFrame:
    """Interval of the budget recall of each score, and of its difference from the incumbent's (the first, if not named).

    Every replicate draws as many entities of a time block as it has, with replacement, the same ones for every score; its
    recall is the mean over blocks. Draw i of a replicate is a hash of (seed, block, replicate, i), so draws are a map over
    the rows, whose counts sum to the block's size. Scores are ordered once: every row has its place in each score's order,
    places are cut into ranges, the drawn rows are summed by range, and only the range in which the budget ends is read by ties.
    """
    scratch, unit = Scratch(rows.sparkSession, "bootstrap"), ["block"]
    base = rows.select((F.lit(0) if block is None else F.col(block)).cast("long").alias("block"), "entity", "label", *scores).withColumn("_one", F.lit(1))
    base = running_sums(base, unit, "entity", ["_one"]).withColumnRenamed("cum__one", "i").drop("_one")
    base = scratch.table(base, "base")
    size = scratch.table(base.groupBy("block").agg(F.count("*").alias("size")), "size")
    table = base.join(_beside(size), "block")
    for k, s in enumerate(scores):  # named scores, a few
        levels = running_sums(base.groupBy("block", s).agg(F.count("*").alias("n")), unit, s, ["n"], descending=True)
        levels = scratch.table(levels.select("block", s, (F.col("cum_n") - F.col("n")).alias(f"above{k}")), f"levels{k}")
        table = table.join(_beside(levels), ["block", s])
    table = scratch.table(table.select("block", "i", "label", "size", *(f"above{k}" for k in range(len(scores)))), "rows")
    scratch.drop_all_but(table)
    text = F.concat_ws("|", F.lit(str(seed)), F.col("block").cast("string"), F.col("rep").cast("string"), F.col("i").cast("string"))
    pick = F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long") % F.col("size") + 1
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a small file would be one task, of all draws
    slots = table.select("block", "i", "size").repartition(spread).select("block", "i", "size", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    drawn = slots.select("block", "rep", pick.alias("i")).repartition("block", "i")  # one shuffle for the sum and the join
    weights = drawn.groupBy("block", "rep", "i").agg(F.count("*").alias("w"))
    drawn = scratch.table(weights.join(table.hint("merge"), ["block", "i"]), "drawn")
    scratch.drop(table)
    models = F.explode(F.array(*(F.struct(F.lit(s).alias("model"), F.col(f"above{k}").alias("above")) for k, s in enumerate(scores)))).alias("x")
    key = ["block", "rep", "model"]
    long = drawn.select("block", "rep", "label", "w", "size", models).select("block", "rep", "label", "w", "x.*", F.floor(F.col("x.above") * ranges / F.col("size")).alias("range"))
    per = long.groupBy(*key, "range").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("label")).alias("p"))
    upto = Window.partitionBy(*key).orderBy("range")
    per = per.withColumn("cum_n", F.sum("n").over(upto)).withColumn("cum_p", F.sum("p").over(upto))
    last = F.coalesce(F.min(F.when(F.col("cum_n") >= budget, F.col("range"))), F.max("range"))
    ends = per.groupBy(*key).agg(last.alias("range"), F.max("cum_p").alias("positives")).join(per.hint("merge"), [*key, "range"])
    ends = scratch.table(ends.select(*key, "range", "positives", (F.col("cum_n") - F.col("n")).alias("before_n"), (F.col("cum_p") - F.col("p")).alias("before_p")), "ends")
    ties = long.join(_beside(ends), [*key, "range"]).groupBy(*key, "above").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("label")).alias("p"), F.min("before_n").alias("before_n"), F.min("before_p").alias("before_p"), F.min("positives").alias("positives"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("above").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = F.greatest(F.lit(0), F.least(F.col("n"), budget - F.col("before_n") - F.col("earlier")))
    hits = ties.withColumn("earlier", earlier).groupBy(*key).agg((F.min("before_p") + F.sum(F.col("p") * taken / F.col("n"))).alias("hits"), F.min("positives").alias("positives"))
    m = hits.groupBy("rep", "model").agg(F.avg(F.coalesce(F.col("hits") / F.nullif("positives", F.lit(0)), F.lit(0.0))).alias("recall"))
    first = m.where(F.col("model") == (incumbent or scores[0])).select("rep", F.col("recall").alias("base"))
    d = m.join(first, "rep").withColumn("delta", F.col("recall") - F.col("base"))
    q = lambda c, p: F.percentile(c, F.lit(p))  # noqa: E731  (of the replicates)
    return d.groupBy("model").agg(F.avg("recall").alias("mean_recall"), q("recall", 0.025).alias("low"), q("recall", 0.975).alias("high"), F.avg("delta").alias("mean_delta"), q("delta", 0.025).alias("delta_low"), q("delta", 0.975).alias("delta_high"))


def chronological_split(rows: DataFrame, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """``rows`` with a split by distinct times: equal times never fall on two sides."""
    times = rows.select("time").distinct()
    n = F.col("blocks")
    n_train = F.least(F.greatest(F.floor(n * train), F.lit(1)), n - 2)
    n_valid = F.least(F.greatest(F.floor(n * validation), F.lit(1)), n - n_train - 1)
    ranked = numbered(times, "time").select("time", "i").crossJoin(F.broadcast(times.agg(F.count("*").alias("blocks"))))
    part = F.when(F.col("i") <= n_train, "train").when(F.col("i") <= n_train + n_valid, "validation").otherwise("test")
    return rows.join(ranked.select("time", part.alias("split")), "time")


def purge_entities(split: DataFrame, entity: str) -> DataFrame:
    """``split`` without the rows of entities that also occur in a later part."""
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "validation", 1).otherwise(2)
    last = F.max(order).over(Window.partitionBy(entity))
    return split.withColumn("_o", order).withColumn("_l", last).where("_o = _l").drop("_o", "_l")


def entity_split(rows: DataFrame, train: float, validation: float) -> DataFrame:
    """(entity_id, split): entities in the order of their first availability, cut at two fractions of their number."""
    first = rows.groupBy("entity_id").agg(F.min("available_at_mjd").alias("t"))
    n = F.col("n")
    # places of distinct times, then of the entities that begin at one
    times = running_sums(first.groupBy("t").agg(F.count("*").alias("k")), [], "t", ["k"])
    own = F.row_number().over(Window.partitionBy("t").orderBy("entity_id"))
    placed = first.withColumn("own", own).join(times, "t").select("entity_id", (F.col("cum_k") - F.col("k") + F.col("own")).alias("i"))
    ranked = placed.crossJoin(F.broadcast(first.agg(F.count("*").alias("n"))))
    part = F.when(F.col("i") <= F.greatest(F.lit(1), F.floor(n * train)), "train").when(F.col("i") <= F.greatest(F.lit(2), F.floor(n * validation)), "validation").otherwise("test")
    return ranked.select("entity_id", part.alias("split"))


def vocabulary(split: DataFrame, column: str) -> DataFrame:
    """(term, id): values of the training rows in order, from 1; 0 is left for the unknown."""
    terms = split.where("split = 'train'").select(F.col(column).alias("term")).where("term is not null").distinct()
    if isinstance(terms.schema["term"].dataType, NumericType):
        return numbered(terms, "term", "id").select("term", F.col("id").cast("int").alias("id"))
    return terms.select("term", F.row_number().over(Window.orderBy("term")).alias("id"))  # names: as few as there are words


def ratio_bootstrap(clusters: DataFrame, group: str, number: str, outcome: str, size: str, base: str, replicates: int, seed: int = 1) -> DataFrame:
    """Per group: the ratio of sums, its 95 % interval and that of its difference from group ``base``, drawing whole clusters.

    Every replicate draws as many clusters of a group as it has, with replacement; draw i of a replicate is a hash of
    (seed, group, replicate, i), so draws are a map over the clusters and meet them again by an equi-join. ``number`` is a
    distinct number of each cluster, in whose order they are drawn. A replicate without size has no ratio.
    """
    c = running_sums(clusters.select(group, number, outcome, size).withColumn("_one", F.lit(1)), [group], number, ["_one"]).withColumnRenamed("cum__one", "i")
    n = clusters.groupBy(group).agg(F.count("*").alias("n"))
    text = F.concat_ws("|", F.lit(str(seed)), F.col(group), F.col("rep").cast("string"), F.col("i").cast("string"))
    pick = F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long") % F.col("n") + 1
    draws = c.select(group, "i").join(n, group).select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    draws = draws.select(group, "rep", pick.alias("i")).groupBy(group, "rep", "i").agg(F.count("*").alias("w"))
    per = draws.join(c, [group, "i"]).groupBy(group, "rep").agg((F.sum(F.col("w") * F.col(outcome)) / F.nullif(F.sum(F.col("w") * F.col(size)), F.lit(0))).alias("ratio"))
    against = per.where(F.col(group) == base).select("rep", F.col("ratio").alias("base"))
    per = per.join(against, "rep", "left").withColumn("delta", F.col("ratio") - F.col("base"))
    q = lambda c, p: F.percentile(c, F.lit(p))  # noqa: E731  (of the replicates)
    spread = per.groupBy(group).agg(q("ratio", 0.025).alias("low"), q("ratio", 0.975).alias("high"), q("delta", 0.025).alias("delta_low"), q("delta", 0.975).alias("delta_high"))
    point = clusters.groupBy(group).agg(F.count("*").alias("n_clusters"), (F.sum(outcome) / F.nullif(F.sum(size), F.lit(0))).alias("ratio"))
    return point.join(spread, group)
