"""Merkle manifest of a dataset: levels of hash nodes, stored with links to parents, and a recursive climb to the root.

Every row is a leaf, H of its fields; H is the lowercase hexadecimal SHA-256 of its inputs joined, digests as text. Per
source, leaves ascend by id, and while several nodes remain, every ``ARITY`` consecutive ones become the H of their
digests. The subroots of the sources, ordered by source, are joined into the root in the same way.

Leaves are numbered by one range shuffle, so neither a window nor a task holds a source. Each built level is written as
node rows: the node, its parent, and the digests of its siblings to the left and to the right. A recursive query then
climbs from the leaves' runs over these rows: each step appends the siblings to the proof and folds them around the hash
of every leaf of the run, tampered where ``tampered`` says so. What the climb reaches at the root is compared with it.

Scale: texts are read once and never shuffled; a leaf is about 100 bytes, levels shrink by ``ARITY``, and the leaves of a
run climb together, since they share all siblings beyond their own run. On the driver are three numbers and the root.

Edge cases: a null field is written ``-``, an empty text ``0:``. Null ids come first in their source, null sources before
all others; rows with one id are ordered by their hash, and equal rows are leaves of their own. A source of one row has
its leaf as subroot, a table of one source its subroot as root; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.plans.places import placed
from lumisift.plans.scratch import Scratch

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEVELS = 64  # ids of nodes: the place of their first leaf times this, plus the level; levels over subroots from 32
_OVER = 32
_HEX = 64

_CLIMB = """
    WITH RECURSIVE climb(run, at, proof, folds) AS (
        SELECT node, node, '', folds FROM {runs}
        UNION ALL
        SELECT c.run, n.parent, concat(c.proof, n.before, n.after), transform(c.folds, f -> sha2(concat(n.before, f, n.after), 256))
        FROM climb c JOIN {nodes} n ON n.node = c.at)
    SELECT run, proof, folds FROM climb WHERE at = {root}"""


def leaf_hash(**changed: Column) -> Column:
    """H of the fields of a row, each as its byte length, a colon and its text; ``changed`` replaces columns."""
    spelled = (changed.get(c, F.col(c)).cast("string") for c in FIELDS)
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in spelled)), 256)


def lowered_where_fifth(id_col: str = "doc_id") -> Column:
    """The hash of the tampered row: texts of ids whose unsigned crc32 is divisible by 5 lose their capitals A-Z; else null."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
    return F.when(hit & F.col("text").isNotNull(), leaf_hash(text=F.translate(F.col("text").cast("string"), _UPPER, _LOWER)))


def _height(size: Column) -> Column:
    """Levels over ``size`` leaves until one node remains."""
    out = F.when(size <= 1, 0)
    for k in range(1, 15):
        out = out.when(size <= ARITY**k, k)
    return out.otherwise(15)


def _parents(children: DataFrame, level: int, over: int) -> DataFrame:
    """Nodes of ``level`` from those below: (first, start, size, rank, kids in order, kid ids, digest)."""
    width = ARITY ** level
    first = F.col("start") + F.expr(f"(first - start) div {width}") * width
    kid = F.struct(F.col("first").alias("at"), "node", "digest")
    out = children.groupBy(first.alias("up")).agg(F.min("start").alias("start"), F.min("size").alias("size"), F.min("rank").alias("rank"), F.sort_array(F.collect_list(kid)).alias("kids"))
    joined = F.array_join("kids.digest", "")
    return out.select(F.col("up").alias("first"), "start", "size", "rank", "kids", (F.col("up") * _LEVELS + over + level).alias("node"), joined.alias("joined"), F.sha2(joined, 256).alias("digest"))


def _links(parents: DataFrame) -> DataFrame:
    """Node rows of the kids: the node, its parent, the digests before and after it in its run."""
    each = parents.select(F.posexplode("kids").alias("slot", "kid"), F.col("node").alias("parent"), "joined")
    return each.select(F.col("kid.node").alias("node"), "parent", *_siblings("joined", F.col("slot")))


def _siblings(joined: str, slot: Column) -> tuple[Column, Column]:
    text = F.col(joined)
    return F.substring(text, F.lit(1), slot * _HEX).alias("before"), F.substring(text, slot * _HEX + _HEX + 1, F.length(text)).alias("after")


@contextmanager
def _no_row_limit(spark: SparkSession):
    """Recursive queries return as many rows as there are runs and levels; the default stops at a million."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def manifest(spark: SparkSession, docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Per row: leaf, subroot, root, hash of its proof, the root folded from the tampered leaf, and whether that is the root.

    ``tampered`` gives the hash of the changed row, or null where a row stays as it is.
    """
    scratch = Scratch(spark, "merkle")
    hurt = F.lit(None).cast("string") if tampered is None else tampered
    leaves = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf_hash()).alias("leaf"), F.unhex(hurt).alias("hurt"), F.monotonically_increasing_id().alias("tie"))
    raw = scratch.table(leaves, "leaves")
    leaves = placed(scratch, raw, ["source", "doc_id", "leaf", "tie"], "ordered")
    scratch.drop(raw)
    sources = scratch.table(leaves.groupBy("source").agg(F.min("place").alias("start"), F.count("*").alias("size")), "sources")
    n_sources, largest = sources.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    if not n_sources:
        return spark.createDataFrame([], SCHEMA)
    ranked = scratch.table(placed(scratch, sources, ["start"], "by-source").withColumnRenamed("place", "rank"), "ranked")

    runs = scratch.table(_runs(leaves, ranked), "runs", "zstd")  # digests as text are twice their bytes
    scratch.drop_all_but(runs)
    levels, links, level = [runs], [], 1
    while ARITY**level < largest:
        level += 1
        below = levels[-1].where(_height(F.col("size")) >= level)
        levels.append(scratch.table(_parents(below, level, 0), f"level{level}"))
        links.append(_links(levels[-1]))
    subroots = [t.where(_height(F.col("size")) == k + 1 if k else _height(F.col("size")) <= 1).select("rank", "node", "digest") for k, t in enumerate(levels)]
    subroots = scratch.table(_union(subroots), "subroots")

    tops, top = subroots.select(F.col("rank").alias("first"), F.lit(0).cast("long").alias("start"), F.lit(n_sources).alias("size"), "rank", "node", "digest"), 0
    while ARITY**top < n_sources:
        top += 1
        tops = scratch.table(_parents(tops, top, _OVER), f"top{top}")
        links.append(_links(tops))
    root_node, root = tops.select("node", "digest").first()
    climbed = runs.select("node", _first_folds().alias("folds"))
    if links:
        nodes = scratch.table(_union(links), "nodes", "zstd")
        scratch.drop_all_but(runs, subroots, nodes)
        with _no_row_limit(spark):
            climbed = scratch.table(spark.sql(_CLIMB, runs=climbed, nodes=nodes, root=root_node), "climbed", "zstd")
    else:
        climbed = scratch.table(climbed.select(F.col("node").alias("run"), F.lit("").alias("proof"), "folds"), "climbed")
    scratch.drop_all_but(runs, subroots, climbed)

    rows = runs.select(F.col("node").alias("run"), "rank", "joined", "kids").join(climbed, "run").join(subroots.select("rank", F.col("digest").alias("subroot")), "rank")
    each = rows.select("joined", "proof", "folds", "subroot", F.posexplode("kids").alias("slot", "kid"))
    folded = F.element_at("folds", F.col("slot") + 1)
    return each.select(
        F.col("kid.doc_id").alias("doc_id"), F.substring("joined", F.col("slot") * _HEX + 1, F.lit(_HEX)).alias("leaf"), "subroot", F.lit(root).alias("root"),
        F.sha2(F.concat(*_siblings("joined", F.col("slot")), F.col("proof")), 256).alias("proof_sha256"), folded.alias("folded_root"), (folded == root).alias("verified"),
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _runs(leaves: DataFrame, sources: DataFrame) -> DataFrame:
    """Nodes of the first level, with their leaves; the lone leaf of a source is its own node, of level 0."""
    s = sources.withColumnRenamed("source", "_source")
    leaves = leaves.join(s, leaves["source"].eqNullSafe(s["_source"]))
    first = F.col("start") + F.expr(f"(place - start) div {ARITY}") * ARITY
    kid = F.struct(F.col("place").alias("at"), "doc_id", "leaf", "hurt")
    out = leaves.groupBy(first.alias("first")).agg(F.min("start").alias("start"), F.min("size").alias("size"), F.min("rank").alias("rank"), F.sort_array(F.collect_list(kid)).alias("kids"))
    out = out.withColumn("joined", F.array_join(F.transform("kids.leaf", lambda x: F.lower(F.hex(x))), ""))
    lone = F.col("size") == 1
    node = F.col("first") * _LEVELS + F.when(lone, 0).otherwise(1)
    return out.withColumn("node", node).withColumn("digest", F.when(lone, F.col("joined")).otherwise(F.sha2("joined", 256)))


def _first_folds() -> Column:
    """For each leaf of a run, its hash, tampered or not, folded with the run's other leaves."""

    def fold(kid: Column, slot: Column) -> Column:
        own = F.lower(F.hex(F.coalesce(kid["hurt"], kid["leaf"])))
        before, after = _siblings("joined", slot)
        return F.when(F.col("size") == 1, own).otherwise(F.sha2(F.concat(before, own, after), 256))

    return F.transform("kids", fold)
