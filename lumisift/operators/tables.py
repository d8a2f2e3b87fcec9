"""Checks and set operations over evidence tables, record digests and first-seen archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumisift.functions.scalars import digest, separation_arcsec


def duplicates(rows: DataFrame, values: list[str]) -> DataFrame:
    """Groups of rows that agree in all values, nulls included."""
    return rows.groupBy(*values).agg(F.count("*").alias("n")).where("n > 1")


def set_agreement(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many keys both tables have, and how many only one of them."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    j = a.join(b, key, "full_outer")
    return j.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The keys that only one of two tables has, and which one."""
    only = lambda a, b, name: a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("only_in", F.lit(name))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def judged(rows: DataFrame, rules: list[tuple[str, object]]) -> DataFrame:
    """``rows`` with the name of the first rule (name, condition that rejects) that they break, null where accepted."""
    reason = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        reason = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(reason)
    return rows.withColumn("reason", reason)


def grid_gaps(rows: DataFrame, declared: dict[str, list]) -> DataFrame:
    """Cells of a declared grid that are missing or come more than once, and rows' cells outside of it."""
    dims, spark = list(declared), rows.sparkSession
    have = rows.groupBy(*dims).agg(F.count("*").alias("n"))
    grid = None
    for d in dims:  # declared values, short lists
        one = spark.createDataFrame([(v,) for v in declared[d]], f"{d} {rows.schema[d].dataType.simpleString()}")
        grid = one if grid is None else grid.crossJoin(F.broadcast(one))
    j = grid.withColumn("_wanted", F.lit(True)).join(have, dims, "full")
    state = F.when(F.col("_wanted").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return j.select(*dims, F.coalesce("n", F.lit(0)).alias("n"), state.alias("state")).where("state is not null")


def position_spread(rows: DataFrame, tolerance_arcsec: float) -> DataFrame:
    """Per source: distinct positions, the largest distance of any two, and whether it is in tolerance."""
    p = rows.select("source_id", "ra_deg", "dec_deg").distinct()
    q = p.select("source_id", F.col("ra_deg").alias("ra2"), F.col("dec_deg").alias("dec2"))
    sep = separation_arcsec(F.col("ra_deg"), F.col("dec_deg"), F.col("ra2"), F.col("dec2"))
    return p.join(q, "source_id").groupBy("source_id").agg(F.sqrt(F.count("*")).cast("long").alias("positions"), F.max(sep).alias("spread")).withColumn("consistent", F.col("spread") <= tolerance_arcsec)


def reconcile(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Per identity over several files: one accepted value, or quarantine if files disagree."""
    g = rows.groupBy(key).agg(F.count("*").alias("n_rows"), F.count_distinct(F.struct(*values)).alias("kinds"), F.min(F.struct("file", *values)).alias("pick"))
    return g.select(key, "n_rows", F.when(F.col("kinds") == 1, "accepted").otherwise("quarantined").alias("state"), *(F.when(F.col("kinds") == 1, F.col(f"pick.{v}")).alias(v) for v in values))


def multiset_change(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows added and removed between two versions, with their counts."""
    plus = new.exceptAll(old).withColumn("change", F.lit("added"))
    return plus.unionByName(old.exceptAll(new).withColumn("change", F.lit("removed"))).groupBy("change").agg(F.count("*").alias("n"))


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, change, fields): rows of each identity that were added, removed or changed, and the fields that differ.

    Equal rows cancel first, as often as both versions have them. What is left of an identity is aligned in the order
    of its fields: two rows are one change, one that finds no partner was added or removed.
    """
    side = lambda a, b, x: a.select(*keys, *fields).exceptAll(b.select(*keys, *fields)).withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*fields))).select(*keys, "_place", F.struct(*fields).alias(x))
    both = side(old, new, "_old").join(side(new, old, "_new"), [*keys, "_place"], "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    differ = F.array_compact(F.array(*(F.when(~F.col(f"_old.{f}").eqNullSafe(F.col(f"_new.{f}")), F.lit(f)) for f in fields)))
    return both.select(*keys, change.alias("change"), F.when(change == "changed", F.array_join(differ, ",")).otherwise("").alias("fields"))


def snapshot_row(rows: DataFrame, columns: list[str], name: str, label: str, split: str) -> DataFrame:
    """Name, label and split policy, row count and an order-free content digest: the sum of 48-bit parts of the rows' own digests."""
    part = F.conv(F.substring(digest(*columns), 1, 12), 16, 10).cast("decimal(20,0)")  # a long holds some 65,000 rows
    return rows.agg(F.count("*").alias("n"), F.sum(part).cast("string").alias("content")).select(F.lit(name).alias("name"), "n", "content", F.lit(label).alias("label_policy"), F.lit(split).alias("split_policy"))


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key; later ones never replace it."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")
