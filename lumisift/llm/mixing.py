"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target is its share by weight of all words, at most ``most`` times its own size; what is over goes to
the others by weight (water filling). Every document of a source is due target/size copies: the whole part is
certain and the fraction is its inclusion probability. The flight phase of the cube method moves probabilities of
undecided documents along a null vector of the two balancing constraints (documents, words) until one is 0 or 1, so both
totals of the source stay at their expectation. Documents that hold much of a block are settled first, against all others;
then the vectors take two large documents and a small one, so that small ones are undecided last.

Blocks of at most ``block`` documents of one source fly in parallel; what each leaves undecided (two documents
at most) is dealt into new blocks, level by level, until a source has a single block, whose last one or two
documents land on the combination nearest to the expected words, with a few exchanges. A hot source is just more blocks; a thousand-fold
input adds one level.

All draws come from a hash of the seed, the source, ids and sizes, and equal rows are numbered and dealt round-robin over
the blocks, so reruns agree, on any layout of the files. ``mixed_documents`` adds copies and taken; input columns of
these names give way. Edge cases: null or empty
texts have size 0 and are taken 0 words; a null source is the last source; null or repeated doc_ids are rows
like others (ties in order are between interchangeable rows); an empty table gives no rows.
"""

from __future__ import annotations

import math
import random
from collections import deque
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumisift.llm.text import WORD
from lumisift.operators.running import running_sums
from lumisift.plans.places import placed
from lumisift.plans.scratch import Scratch


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size)."""
    scratch = Scratch(sizes.sparkSession, "targets")
    per = scratch.table(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")).withColumn("_last", F.col("source").isNull()), "sources")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = placed(scratch, per, ["_last", "source"], "ranked").withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    # sources reach their cap in the order of cap/weight; the level that the others share is the last one not reached
    levels = running_sums(ranked.groupBy((F.col("cap") / F.col("w")).alias("ratio")).agg(F.sum("cap").alias("cap"), F.sum("w").alias("w")), [], "ratio", ["cap", "w"])
    total = ranked.agg(F.sum("source_size").alias("all_words"), F.sum("w").alias("all_w"))  # one row
    share = (F.col("all_words") - (F.col("cum_cap") - F.col("cap"))) / (F.col("all_w") - (F.col("cum_w") - F.col("w")))
    water = levels.crossJoin(F.broadcast(total)).select("ratio", share.alias("share")).agg(F.max(F.when(F.col("share") < F.col("ratio"), F.col("share"))).alias("water"))
    out = ranked.crossJoin(F.broadcast(water))  # one row
    return out.select("source", "source_size", "n_docs", F.coalesce(F.least("cap", F.col("water") * F.col("w")), F.col("cap")).alias("target"))


def _undecided(p: float) -> bool:
    return 1e-9 < p < 1 - 1e-9


def flight(p: list[float], x: list[float], rng: random.Random, large: float = 0.02) -> list[float]:
    """Probabilities after the flight phase for the totals of 1 and ``x``, which descends; at most two stay between 0 and 1.

    A document of over ``large`` of all words is settled first, against all others at once. The others are taken three at a
    time: the two largest and the smallest, which mostly evens out the difference, so that what stays undecided is small.
    """
    p = [v if _undecided(v) else float(round(v)) for v in p]
    for a in range(min(len(x), math.ceil(1 / large))):
        if x[a] > large * sum(x):
            _spread(p, x, a, rng)
    todo, big, small = deque(i for i, v in enumerate(p) if 0 < v < 1), [], []
    while True:
        while len(big) < 2 and todo:
            big.append(todo.popleft())
        if not small and todo:
            small.append(todo.pop())
        if len(big) + len(small) < 3:
            break
        a, b, c = big + small
        u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
        _move(p, [a, b, c], u if any(u) else (1.0, -1.0, 0.0), rng)
        big, small = [i for i in big if 0 < p[i] < 1], [i for i in small if 0 < p[i] < 1]
    held = big + small
    if len(held) == 2 and x[held[0]] == x[held[1]]:
        _move(p, held, (1.0, -1.0), rng)
    return p


def _spread(p: list[float], x: list[float], a: int, rng: random.Random) -> None:
    """Settle document a: the others share what keeps both totals, by the room that each has."""
    while 0 < p[a] < 1:
        at = [i for i, v in enumerate(p) if i != a and 0 < v < 1]
        room, size = np.array([p[i] * (1 - p[i]) for i in at]), np.array([x[i] for i in at]) / x[a]
        gram = np.array([[room.sum(), (room * size).sum()], [(room * size).sum(), (room * size * size).sum()]])
        if len(at) < 3 or np.linalg.det(gram) <= 1e-9 * gram[0, 0] * gram[1, 1]:
            return
        c = np.linalg.solve(gram, [-1.0, -1.0])
        _move(p, [a, *at], (1.0, *(room * (c[0] + c[1] * size)).tolist()), rng)


def _move(p: list[float], at: list[int], u: tuple[float, ...], rng: random.Random) -> None:
    big = max(map(abs, u))
    u = [v / big for v in u]
    up = min((1 - p[i]) / v if v > 0 else -p[i] / v for i, v in zip(at, u, strict=True) if v)
    down = min(p[i] / v if v > 0 else (p[i] - 1) / v for i, v in zip(at, u, strict=True) if v)
    step = up if rng.random() * (up + down) < down else -down
    for i, v in zip(at, u, strict=True):
        q = p[i] + step * v
        p[i] = 0.0 if q < 1e-9 else 1.0 if q > 1 - 1e-9 else q


def landing(p: list[float], x: list[float], exchanges: int = 8) -> list[float]:
    """Decide the last documents so that the words come nearest to their expectation, then the documents.

    At most ``exchanges`` decided documents change sides while that brings the words nearer.
    """
    p = list(p)
    at = [i for i, q in enumerate(p) if 0 < q < 1]
    miss = lambda s: sum((v - p[i]) * x[i] for v, i in zip(s, at, strict=True))
    best = min(([(mask >> k) & 1 for k in range(len(at))] for mask in range(1 << len(at))), key=lambda s: (abs(miss(s)), abs(sum(v - p[i] for v, i in zip(s, at, strict=True)))))
    off = miss(best)
    for v, i in zip(best, at, strict=True):
        p[i] = float(v)
    for _ in range(exchanges):
        i = min(range(len(p)), key=lambda i: abs(off + (1 - 2 * p[i]) * x[i]), default=None)
        if i is None or abs(off + (1 - 2 * p[i]) * x[i]) >= abs(off):
            break
        off, p[i] = off + (1 - 2 * p[i]) * x[i], 1 - p[i]
    return p


def _alike_numbered(sizes: DataFrame, least: int) -> DataFrame:
    """``sizes`` with nth: where more than ``least`` rows are alike in id, source and size their number, else 0.

    A row's number is that of its like in earlier partitions of the written table and its place in its own, so no task
    numbers more than a partition; which of equal rows gets which number makes no difference.
    """
    alike, part = ["doc_id", "source", "size"], F.shiftright("own", 33).alias("part")
    per = sizes.groupBy(*alike, part).agg(F.count("*").alias("n"))
    total = per.groupBy(*alike).agg(F.sum("n").alias("total")).where(F.col("total") > least).drop("total")
    same = lambda a, b: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in alike))
    hot = per.join(total, same(per, total), "left_semi")
    before = Window.partitionBy(*alike).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    hot = hot.select(*(F.col(c).alias(f"_{c}") for c in alike), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    rows = sizes.withColumn("part", F.shiftright("own", 33))
    rows = rows.join(hot, reduce(lambda x, y: x & y, (rows[c].eqNullSafe(hot[f"_{c}"]) for c in (*alike, "part"))), "left")
    few = rows.where("_before is null").select(*sizes.columns, F.lit(0).cast("long").alias("nth"))
    own = F.row_number().over(Window.partitionBy(*alike, "part").orderBy("own"))
    return few.unionByName(rows.where("_before is not null").select(*sizes.columns, (F.col("_before") + own).cast("long").alias("nth")))


_ROW = "row long, doc_id long, source string, size long, source_size long, target double, whole int, p double, deal long"


def mix(
    spark: SparkSession,
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    most: float = 3.0,
    block: int = 2000,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: Column | None = None,
) -> DataFrame:
    """Per row: row (``row_col``, null if not given), doc_id, source, size, source_size, target, copies."""
    scratch = Scratch(spark, "mixing")
    words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    row = F.lit(None).cast("long") if row_col is None else row_col
    own = F.monotonically_increasing_id().alias("own")
    sizes = scratch.table(docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.alias("size"), own), "sizes")
    targets = scratch.table(source_targets(sizes, weights, most), "targets")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.least(F.floor(due + 1e-12), F.lit(math.ceil(most)))
    to = targets.select(F.col("source").alias("_source"), "source_size", "n_docs", "target")
    sizes = _alike_numbered(sizes, max(1, block // 8))
    now = sizes.join(to, F.col("source").eqNullSafe(F.col("_source"))).select(
        "row", "doc_id", "source", "size", "source_size", "target", whole.cast("int").alias("whole"), F.greatest(due - whole, F.lit(0.0)).alias("p"),
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size") + F.col("nth"), F.ceil(F.col("n_docs") / block)).alias("deal"),
    )
    left = targets.agg(F.max("n_docs")).first()[0] or 0
    done = None
    while True:
        last = left <= block
        fly = _flyer(last, seed)
        flown = scratch.table(now.groupBy("source", "deal").applyInArrow(fly, _ROW), "flown")
        decided = flown.where("p = 0 or p = 1")
        done = decided if done is None else done.unionByName(decided)
        if last:
            break
        left = 2 * -(-left // block) * 2  # blocks are dealt by hash, so some may be empty and others larger
        blocks = F.lit(max(1, -(-left // block)))
        now = flown.where("p > 0 and p < 1").withColumn("deal", F.pmod(F.xxhash64(F.lit(seed + left), "doc_id", "size", "deal"), blocks.cast("long")))
    return done.select("row", "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("p")).cast("int").alias("copies"))


def _flyer(last: bool, seed: int):
    def fly(group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("doc_id", "ascending"), ("row", "ascending")])
        p, x = group.column("p").to_pylist(), [float(s) for s in group.column("size").to_pylist()]
        p = flight(p, x, random.Random(f"{seed} {group.column('source')[0].as_py()} {group.column('deal')[0].as_py()} {len(p)} {sum(x)}"))
        if last:
            p = landing(p, x)
        return group.set_column(group.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    return fly


def mixed_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The documents of ``docs`` that the mix takes, with copies and taken (words, copies counted)."""
    scratch = Scratch(spark, "mixed")
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # so that no column of ours clashes
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), *(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    numbered = scratch.table(numbered, "numbered")
    columns = {k: names[options.pop(k, v)] for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    got = mix(spark, numbered, row_col=F.col("_row"), **columns, **options)
    taken = got.where("copies > 0").select(F.col("row").alias("_row"), "copies", (F.col("copies") * F.col("size")).alias("taken"))
    return numbered.join(taken, "_row").select(*(F.col(n).alias(c) for c, n in names.items() if c not in ("copies", "taken")), "copies", "taken")
