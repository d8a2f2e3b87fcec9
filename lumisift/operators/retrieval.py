"""Exact nearest neighbours among eligible entries, by pivots and distance bounds inside time blocks.

Entries are dealt to the nearest of some pivots and, by when they became usable, to blocks of time: a cell of a stratum
(calibration, population). Of each cell its earliest time and the least and greatest distance from its pivot are kept.
A query first meets the cells of its nearest pivot; the k-th eligible entry there gives a radius. At distance d from a
pivot it is at least d - greatest and least - d from any entry of a cell (triangle inequality), so only cells that can reach
into the radius and hold something old enough are then met (all old enough, if the first held fewer than k), and the result
is that of all pairs. Pairs live in tasks only, a block at a time: of a query and (a slice of) a cell k of them leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumisift.plans.scratch import Scratch

STRATUM = ["calibration", "population"]
CELL = [*STRATUM, "pivot", "block"]
_ROOM = 1e-9  # for rounding in the bounds
_SLICE = 8192  # entries or queries that a task holds of a cell, about
_PAIRS = 2_000_000  # pairs that a task holds at once
_FOUND = "query string, entry string, distance double, residual array<double>"


def _matrix(keys: pa.Array | pa.ChunkedArray) -> np.ndarray:
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    return np.asarray(keys.flatten(), np.float64).reshape(len(keys), -1)


def _distances(key: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((key - p) ** 2).sum(1) for p in pivots], 1))


def _dealt(entries: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``entries`` with their nearest pivot and its distance."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                d = _distances(_matrix(part.column("key")), pivots)
                at = d.argmin(1)
                more = [pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(d)), at])]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "pivot", "near"])

    return entries.mapInArrow(run, _kind(entries, pivot="int", near="double"))


def _kind(rows: DataFrame, **more: str) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in [*rows.dtypes, *more.items()])


def _slices(rows: Column) -> Column:
    return F.ceil(rows / _SLICE).cast("int")


def _slice_of(id_: str, slices: Column) -> Column:
    return F.pmod(F.xxhash64(id_), slices).cast("int")


def _each(slices: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), slices - 1))


def _reached(queries: DataFrame, cells: DataFrame, pivots: np.ndarray, first: bool) -> DataFrame:
    """(query row, pivot, block): the cells that a query meets, those of its nearest pivot or those in its radius but these."""

    def run(key: tuple, asked: pa.Table, cells: pa.Table) -> pa.Table:
        column = lambda c: cells.column(c).to_numpy()
        pivot, begin, near, far = column("pivot"), column("from"), column("near"), column("far")
        cutoff = asked.column("cutoff").to_numpy()
        rows, met = [], []
        step = max(1, _PAIRS // max(1, cells.num_rows))
        for i in range(0, asked.num_rows if cells.num_rows else 0, step):
            part = slice(i, i + step)
            d = _distances(_matrix(asked.column("key")[part]), pivots)[:, pivot]
            old = begin <= cutoff[part, None]
            nearest = pivot[np.where(old, d, np.inf).argmin(1)][:, None] == pivot
            if first:
                wanted = old & nearest
            else:
                radius = asked.column("radius").fill_null(np.inf).to_numpy()[part, None]
                wanted = old & ~nearest & (np.maximum(d - far, near - d) <= radius * (1 + _ROOM) + _ROOM)
            row, cell = np.nonzero(wanted)
            rows.append(row + i)
            met.append(cell)
        rows, met = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, met))
        out = asked.select(names).take(pa.array(rows))
        return out.append_column("pivot", cells.column("pivot").take(pa.array(met))).append_column("block", cells.column("block").take(pa.array(met)))

    names = [c for c in queries.columns if c not in ("radius", "_slice")]
    kind = _kind(queries.select(names), pivot="int", block="int")
    return queries.groupBy(*STRATUM, "_slice").cogroup(cells.groupBy(*STRATUM, "_slice")).applyInArrow(run, kind)


def _nearest(k: int, scale: float) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The ``k`` nearest eligible entries of a cell for every query that meets it; ties to the smaller id."""

    def run(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if not asked.num_rows or not held.num_rows:
            return pa.table({"query": pa.array([], pa.string()), "entry": pa.array([], pa.string()), "distance": pa.array([], pa.float64()), "residual": pa.array([], pa.list_(pa.float64()))})
        held = held.sort_by("id")  # so that places are in the order of ids
        entry, usable = _matrix(held.column("key")), held.column("usable_at").to_numpy()
        groups = pa.chunked_array([*asked.column("source_group").chunks, *held.column("source_group").chunks], asked.column("source_group").type)
        codes = groups.combine_chunks().dictionary_encode().indices.to_numpy()
        own, theirs = codes[: asked.num_rows], codes[asked.num_rows :]
        query, cutoff = _matrix(asked.column("key")), asked.column("cutoff").to_numpy()
        step = max(1, _PAIRS // held.num_rows)
        for i in range(0, asked.num_rows, step):
            part = slice(i, i + step)
            d = np.zeros((len(query[part]), len(entry)))
            for a, b in zip(query[part].T, entry.T, strict=True):
                d += (a[:, None] - b) ** 2
            d *= scale
            fit = (usable <= cutoff[part, None]) & (theirs != own[part, None])
            d[~fit] = np.inf
            last = np.partition(d, k - 1, axis=1)[:, k - 1, None] if len(entry) > k else np.inf
            row, at = np.nonzero(fit & (d <= last))
            order = np.lexsort((at, d[row, at], row))
            row, at = row[order], at[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, at = row[kept], at[kept]
            named = [asked.column("id").take(pa.array(row + i)), held.column("id").take(pa.array(at)), pa.chunked_array([pa.array(d[row, at])]), held.column("residual").take(pa.array(at))]
            out.append(pa.Table.from_arrays(named, ["query", "entry", "distance", "residual"]))
        return pa.concat_tables(out)

    return run


def _met(reached: DataFrame, dealt: DataFrame, cells: DataFrame, k: int, scale: float) -> DataFrame:
    """(query, entry, distance, residual): of every cell that a query meets its nearest entries, by slices of both."""
    asked = reached.groupBy(*CELL).agg(_slices(F.count("*")).alias("_q"))
    sizes = cells.join(asked, CELL).select(*CELL, _slices(F.col("n")).alias("_e"), "_q")
    left = reached.join(sizes, CELL).withColumn("_qs", _slice_of("id", F.col("_q"))).withColumn("_es", _each(F.col("_e"))).drop("_q", "_e")
    right = dealt.join(sizes, CELL).withColumn("_es", _slice_of("id", F.col("_e"))).withColumn("_qs", _each(F.col("_q"))).drop("_q", "_e")
    keys = [*CELL, "_es", "_qs"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_nearest(k, scale), _FOUND)


def pairs(entries: DataFrame, queries: DataFrame, k: int, n_pivots: int | None = None, n_blocks: int = 8, scale: float = 1.0) -> DataFrame:
    """(query, entry, distance, residual): the ``k`` nearest eligible entries of a query, and some that are near.

    ``entries`` has id, key (array of doubles, scaled so that plain distance is meant), residual, source_group, usable_at (from when
    it may be used), calibration and population; ``queries`` has id, key, source_group, cutoff, calibration and population. The
    distance is squared and multiplied by ``scale``. Pivots are one for 8000 entries, 32 to 512, if not given.
    """
    scratch = Scratch(entries.sparkSession, "retrieval")
    named = lambda rows, time, *more: rows.where(" and ".join(f"{c} is not null" for c in (*STRATUM, "source_group", time))).select("id", "key", F.col("source_group").cast("string").alias("source_group"), time, *STRATUM, *more)
    entries = scratch.table(named(entries, "usable_at", "residual"), "entries")
    queries = scratch.table(named(queries, "cutoff"), "queries")
    facts = entries.agg(F.count("*").alias("n"), F.percentile_approx("usable_at", [i / n_blocks for i in range(1, n_blocks)], 10000).alias("cuts")).first()
    n_pivots = n_pivots or max(32, min(512, facts["n"] // 8000))
    chosen = entries.groupBy("key").agg(F.min(F.xxhash64("key")).alias("h")).orderBy("h").limit(n_pivots).collect()  # n_pivots keys, different ones
    pivots = np.array([r["key"] for r in chosen] or [[0.0]], np.float64)
    block = sum((F.col("usable_at") > c).cast("int") for c in facts["cuts"] or [])
    dealt = scratch.table(_dealt(entries, pivots).withColumn("block", F.lit(0) + block), "dealt")
    scratch.drop(entries)
    cells = scratch.table(dealt.groupBy(*CELL).agg(F.count("*").alias("n"), F.min("usable_at").alias("from"), F.min("near").alias("near"), F.max("near").alias("far")), "cells")
    slices = F.lit(max(1, -(-queries.count() // _SLICE)))
    spread, asked = cells.withColumn("_slice", _each(slices)), queries.withColumn("_slice", _slice_of("id", slices))
    near = scratch.table(_met(scratch.table(_reached(asked, spread, pivots, True), "first"), dealt, cells, k, scale), "near")
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance"))
    radius = near.withColumn("place", place).where(F.col("place") == k).select(F.col("query").alias("id"), F.sqrt(F.col("distance") / scale).alias("radius"))
    rest = scratch.table(_reached(asked.join(radius, "id", "left"), spread, pivots, False), "rest")
    return near.unionByName(_met(rest, dealt, cells, k, scale))


def recall(entries: DataFrame, queries: DataFrame, k: int, temperature: float = 1.0, scale: float = 1.0, **index) -> DataFrame:
    """Per query: the nearest eligible entries, their softmax weights, the recalled residual, and the gate.

    The distance is squared and multiplied by ``scale``; ties go to the smaller id. Entries have a residual (array of doubles).
    A query without an eligible entry is unsupported: gate 0 and no residual.
    """
    met = pairs(entries, queries, k, scale=scale, **index)
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "entry"))
    near = met.withColumn("place", place).where(F.col("place") <= k)
    whole = Window.partitionBy("query")
    near = near.withColumn("raw", F.exp(-(F.col("distance") - F.min("distance").over(whole)) / temperature))
    near = near.withColumn("weight", F.col("raw") / F.sum("raw").over(whole))
    parts = near.select("query", "entry", "distance", "place", "weight", F.posexplode("residual").alias("at", "value")).groupBy("query", "at").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
    residual = parts.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("residual"))
    entropy = -F.sum(F.when(F.col("weight") > 0, F.col("weight") * F.ln("weight")).otherwise(0.0))
    per = near.groupBy("query").agg(
        F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("place", "entry"))), lambda x: x["entry"]).alias("neighbours"), F.min("distance").alias("nearest"), entropy.alias("entropy")
    )
    even = F.when(F.col("n") > 1, F.col("entropy") / F.ln("n")).otherwise(0.0)
    gate = (1 - 0.5 * even) / (1 + F.exp(F.least(F.lit(60.0), F.col("nearest"))))
    out = queries.select(F.col("id").alias("query")).join(per.join(residual, "query"), "query", "left")
    return out.select("query", F.coalesce("n", F.lit(0)).alias("n"), "neighbours", "nearest", F.coalesce("entropy", F.lit(0.0)).alias("entropy"), "residual", F.coalesce(gate, F.lit(0.0)).alias("gate"), F.col("n").isNotNull().alias("supported"))
