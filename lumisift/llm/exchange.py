"""Which of a batch's 64-bit keys occur in other batches: counting through Spark without a row for each key.

Each batch sorts its distinct (key, value) pairs once and cuts them by the key's top bits into buckets. One
blob for each (batch, bucket) is shuffled; delta coding and byte planes leave about six bytes for a key. The
task that gets a bucket interleaves the sorted lists of all batches and sends four bits for each pair back:

1. another batch has the key;  2. another batch has the pair;
3. the key has several values;  4. the key has a smaller value somewhere.

Hash keys spread evenly, and a key comes at most once (for each of its values) from a batch, so a hot key
costs a task one entry for each batch and never a row for each occurrence. The number of buckets follows the
size of the input, so a bucket holds a bounded number of keys of each batch.

A blob for each batch and final bucket would be a number that grows with the square of the input. So keys travel by
digits of their bucket, in levels of at most ``FAN`` buckets each: behind a level that is not the last, the blobs of
about ``width`` batches for one bucket are merged into one sorted list, a node, which is cut by the next digit and sent
on as a batch's list would be. Answers come back the same way: a pair's bits are those inside its node or those that
the node got. Every level moves each distinct key once, in blobs of constant size, so rows and bytes grow with the
input times the number of levels (one up to ``FAN`` buckets, two up to its square), and a node is as large as a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.llm.text import PACKED, Batch, unpack
from lumisift.plans.scratch import Scratch

OTHER_BATCH, SAME_PAIR, MANY_VALUES, SMALLER_VALUE = range(4)
_BLOBS = "bucket int, batch_id long, n int, keys binary, vals binary"
_HITS = "batch_id long, pass int, bucket int, bits binary"
#: Most buckets that one list is cut into.
FAN = 256

Hits = dict[int, list[tuple[int, bytes]]]


class Buckets(NamedTuple):
    """``width`` buckets at each of ``levels`` levels, for so many batches."""

    width: int
    levels: int
    batches: int

    def nodes(self, level: int) -> int:
        """Nodes behind a level in each of its buckets."""
        return max(1, -(-self.batches // self.width**level))


def planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(b: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, n).T).view(np.uint64).ravel()


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


class Pairs:
    """The distinct (key, value) pairs of some items in sorted order, and where each item's pair is."""

    def __init__(self, keys: np.ndarray, vals: np.ndarray | None = None):
        n = len(keys)
        order = np.argsort(keys, kind="stable") if vals is None else np.lexsort((vals, keys))
        k = keys[order]
        new_key = np.ones(n, bool)
        new_key[1:] = k[1:] != k[:-1]
        new = new_key
        if vals is not None:
            v = vals[order]
            new = new_key.copy()
            new[1:] |= v[1:] != v[:-1]
        self.keys = k[new]
        self.vals = v[new] if vals is not None else np.zeros(len(self.keys), np.uint64)
        self.inverse = np.empty(n, np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.count = np.diff(np.append(first, n))
        # for each pair: items with its key, and distinct values of its key
        of_key = np.cumsum(new_key[new]) - 1
        self.key_count = np.bincount(of_key, self.count, len(first) and of_key[-1] + 1).astype(np.int64)[of_key]
        self.key_values = np.bincount(of_key)[of_key] if len(first) else np.zeros(0, np.int64)


def _blobs(keys: np.ndarray, vals: np.ndarray, sender: int, buckets: int) -> pa.RecordBatch:
    """Sorted pairs cut by the key into buckets, one blob for each that is not empty."""
    owner = bucket_of(keys, buckets)
    lowest = int(owner[0]) if len(keys) else 0
    edge = np.searchsorted(owner, np.arange(lowest, int(owner[-1]) + 2 if len(keys) else 1))
    out = {k: [] for k in ("bucket", "batch_id", "n", "keys", "vals")}
    for b in np.flatnonzero(np.diff(edge)):
        k, v = keys[edge[b] : edge[b + 1]], vals[edge[b] : edge[b + 1]]
        out["bucket"].append(lowest + int(b))
        out["batch_id"].append(sender)
        out["n"].append(len(k))
        out["keys"].append(planes(np.diff(k, prepend=np.uint64(0))))
        out["vals"].append(planes(v) if v.any() else None)
    return pa.RecordBatch.from_pydict(out, pa.schema([("bucket", pa.int32()), ("batch_id", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())]))


class _Interleaved:
    """The pairs of several blobs of one bucket in order, and what the lists say about each other."""

    def __init__(self, rows: list[dict]):
        self.rows, self.sizes = rows, np.array([r["n"] for r in rows])
        keys = np.concatenate([np.cumsum(unplanes(r["keys"], r["n"])) for r in rows])
        vals = np.concatenate([np.zeros(r["n"], np.uint64) if r["vals"] is None else unplanes(r["vals"], r["n"]) for r in rows])
        at = np.repeat(np.arange(len(rows)), self.sizes)
        order = np.lexsort((vals, keys))
        keys, vals, at = keys[order], vals[order], at[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        first, of = np.flatnonzero(new), np.cumsum(new) - 1
        last = np.append(first[1:], len(keys)) - 1
        pair = new.copy()
        pair[1:] |= vals[1:] != vals[:-1]
        self.bits = np.zeros((4, len(keys)), bool)
        self.bits[OTHER_BATCH, order] = (np.minimum.reduceat(at, first) != np.maximum.reduceat(at, first))[of]
        self.bits[SAME_PAIR, order] = ~(pair & np.append(pair[1:], True))
        self.bits[MANY_VALUES, order] = (vals[first] != vals[last])[of]
        self.bits[SMALLER_VALUE, order] = vals[first][of] < vals
        self.keys, self.vals = keys[pair], vals[pair]
        self.pair_of = np.empty(len(keys), np.int64)
        self.pair_of[order] = np.cumsum(pair) - 1

    def answers(self, number: int) -> pa.Table:
        edge = np.concatenate([[0], np.cumsum(self.sizes)])
        return pa.table(
            {
                "batch_id": pa.array([r["batch_id"] for r in self.rows], pa.int64()),
                "pass": pa.array([number] * len(self.rows), pa.int32()),
                "bucket": pa.array([r["bucket"] for r in self.rows], pa.int32()),
                "bits": pa.array([np.packbits(self.bits[:, a:b], axis=None).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()),
            }
        )


def exchange(
    scratch: Scratch, packed: DataFrame, hits: DataFrame | None, emit: Callable[[Batch, Hits], tuple[np.ndarray, np.ndarray]], number: int, buckets: Buckets
) -> DataFrame:
    """One pass: ``emit`` gives a batch's sorted distinct pairs from its texts and earlier answers; returns new answers, written."""
    width, kept = buckets.width, []

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                keys, vals = emit(unpack(row), read_hits(row.get("hits")))
                yield _blobs(keys, vals, row["batch_id"], width)

    def interleave(group: pa.Table) -> pa.Table:
        return _Interleaved(group.to_pylist()).answers(number)

    def node_of(level: int):
        return F.pmod(F.xxhash64("batch_id"), F.lit(buckets.nodes(level))).alias("node")

    def answers(blobs: DataFrame, level: int) -> DataFrame:
        if level == buckets.levels:
            return blobs.groupBy("bucket").applyInArrow(interleave, _HITS)
        blobs = scratch.table(blobs.select("*", node_of(level)), f"blobs{number}-{level}")  # read on the way there and back
        kept.append(blobs)

        def forward(key: tuple, group: pa.Table) -> pa.Table:
            node = _Interleaved(group.to_pylist())
            return pa.Table.from_batches([_blobs(node.keys, node.vals, key[1].as_py(), width ** (level + 1))])

        def back(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            node = _Interleaved(mine.to_pylist())
            got = _placed([(r["bucket"], r["bits"]) for r in theirs.to_pylist()], node.keys, width ** (level + 1))
            node.bits |= got[:, node.pair_of]
            return node.answers(number)

        further = answers(blobs.groupBy("bucket", "node").applyInArrow(forward, _BLOBS), level + 1)
        further = further.select(F.floor(F.col("bucket") / width).cast("int").alias("parent"), "batch_id", "bucket", "bits")
        return blobs.groupBy("bucket", "node").cogroup(further.groupBy("parent", "batch_id")).applyInArrow(back, _HITS)

    out = scratch.table(answers(with_hits(packed, hits).mapInArrow(send, _BLOBS), 1), f"hits{number}")
    scratch.drop(*kept)
    return out


def with_hits(packed: DataFrame, hits: DataFrame | None) -> DataFrame:
    """Batches with the answers of all passes so far; a batch's answers are bounded by its own size."""
    if hits is None:
        return packed
    by_batch = hits.groupBy("batch_id").agg(F.collect_list(F.struct("pass", "bucket", "bits")).alias("hits"))
    return packed.join(by_batch, "batch_id", "left").select(*(c.split()[0] for c in PACKED.split(", ")), "hits")


def read_hits(rows: list[dict] | None) -> Hits:
    out: Hits = {}
    for r in rows or []:
        out.setdefault(r["pass"], []).append((r["bucket"], r["bits"]))
    return {k: sorted(v) for k, v in out.items()}


def bits_for(hits: Hits, number: int, keys: np.ndarray, buckets: Buckets) -> np.ndarray:
    """The four bits of each sorted pair that the batch sent in a pass."""
    return _placed(hits.get(number, []), keys, buckets.width)


def _placed(rows: list[tuple[int, bytes]], keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bits of sorted pairs from the answers of the buckets that they were sent to."""
    of = bucket_of(keys, buckets)
    out = np.zeros((4, len(keys)), bool)
    for b, bits in rows:
        start, end = np.searchsorted(of, [b, b + 1])
        out[:, start:end] = np.unpackbits(np.frombuffer(bits, np.uint8), count=4 * (end - start)).reshape(4, -1)
    return out


def buckets_for(packed: DataFrame, bucket_bytes: int, fan: int = FAN) -> Buckets:
    """Buckets for a packed table: at least one for so many bytes of text, in levels of equal width up to ``fan``."""
    total, batches = packed.agg(F.sum("n_bytes"), F.count("*")).first()
    least, levels = max(1, -(-(total or 0) // bucket_bytes)), 1
    while fan**levels < least:
        levels += 1
    width = max(1, round(least ** (1 / levels)))
    return Buckets(width if width**levels >= least else width + 1, levels, batches)
