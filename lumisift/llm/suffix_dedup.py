"""Repeated byte strings: sampled suffixes of shards merged by refinement of their common intervals.

Each batch of whole documents is a shard. Its suffixes are sampled at content-defined anchors (the leftmost
minimal 16-gram hash of every 48 starts), which cut the text into phrases; equal texts have equal anchors
inside, so equal strings have equal phrase sequences in every shard.

The shards' suffixes are interleaved by refinement, in the way that Holt and McMillan merge Burrows-Wheeler
transforms, but by fingerprint: a pass sends one key for each still open prefix interval of a shard, and the
interleaved buckets say which intervals other shards share. An interval that is alone is closed: its longest common
prefix with any other suffix is below the depth of the pass. Depths grow from two phrases over twelve to
``length - 47`` bytes, common to all strings that belong to an anchor. No suffix is sorted again; closed ones are not
sent again. The order inside the merge is that of fingerprints, not of bytes, and no transform is kept: identity and
depth of the intervals are all that finding repeats needs. (A byte-by-byte merge takes a pass for each of ``length``
bytes.) ``longest_common`` is, of a document's suffixes, the greatest common prefix with any other suffix that the
passes know of, in bytes: zero, whole phrases, ``length - 47``, or the longest removed run.

What is open at the end are repeated intervals. Each anchor stands for up to 48 starts of ``length``-byte
strings. Where all suffixes of an interval agree in what precedes them and in the rest up to the last of
these strings, all its starts repeat; only where they differ are the single starts compared, by 64-bit hashes
of the whole strings, as the exact check. Every start of every document is decided so, none is sampled away.

Edge cases: a null text is empty; texts under ``length`` bytes lose nothing; a null doc_id stays null and does
not matter. Removed bytes may cut a UTF-8 character, so kept data is binary. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumisift.llm.exchange import FAN, MANY_VALUES, OTHER_BATCH, SAME_PAIR, Buckets, Pairs, bits_for, buckets_for, exchange, read_hits, with_hits
from lumisift.llm.text import _BYTE_BASE, Batch, id_list, mix, pack, prefix_hash, span_hash, unpack
from lumisift.plans.scratch import Scratch

SCHEMA = "doc_id long, n_bytes long, n_removed long, removed array<struct<start:int,end:int>>, kept binary, longest_common long"
GRAM, SPREAD = 16, 48
PHRASES = (2, 12)


class Shard:
    """Sampled suffixes of one batch."""

    def __init__(self, batch: Batch, length: int):
        self.length, data = length, batch.data
        n = len(data)
        self.n, self.prefix = n, prefix_hash(data.astype(np.uint64) + np.uint64(1), _BYTE_BASE)
        none = np.zeros(0, np.int64)
        ends = batch.starts + batch.sizes
        grams = n - GRAM + 1
        reach = GRAM + SPREAD - 1
        self.anchor = self.lo = self.hi = self.succ = none
        if grams < SPREAD or not (batch.sizes >= length).any():
            return
        at = np.arange(grams)
        bits = np.uint64(max(20, int(n).bit_length()))
        low = self.span(at, at + GRAM) >> bits << bits | at.astype(np.uint64)
        w = 1
        while 2 * w <= SPREAD:
            low = np.minimum(low[:-w], low[w:])
            w *= 2
        if w < SPREAD:
            low = np.minimum(low[: len(low) - (SPREAD - w)], low[SPREAD - w :])
        chosen = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # by start
        inside = np.zeros(n + 1, np.int8)
        long = batch.sizes >= length
        np.add.at(inside, batch.starts[long], 1)
        np.add.at(inside, ends[long] - reach + 1, -1)
        start = np.flatnonzero(np.cumsum(inside)[: len(chosen)])
        doc_end = ends[np.searchsorted(batch.starts, start, "right") - 1]
        a = chosen[start]
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        first = np.flatnonzero(new)
        all_anchors, anchor_end = a[first], doc_end[first]
        whole = start + length <= doc_end
        has = np.add.reduceat(whole, first) if len(first) else none
        keep = has > 0
        self.anchor, self.lo = all_anchors[keep], start[first][keep]
        self.hi = self.lo + has[keep] - 1
        # the last anchor that any string of this anchor is sure to contain
        sure = np.searchsorted(all_anchors, np.minimum(self.anchor + length - reach - SPREAD + 1, anchor_end[keep]), "right") - 1
        own = np.flatnonzero(keep)
        self.succ = [all_anchors[np.maximum(own, np.minimum(own + d, sure))] for d in PHRASES]

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return span_hash(self.prefix, start, end, _BYTE_BASE)

    def refine(self, hits, buckets: Buckets):
        """The next pass' items from the answers so far, or once all are there the repeated starts and each anchor's common prefix."""
        active, common = np.arange(len(self.anchor)), np.zeros(len(self.anchor), np.int64)
        for number in (1, 2):
            pairs = Pairs(self.span(self.anchor[active], self.succ[number - 1][active]) if len(active) else np.zeros(0, np.uint64))
            if number not in hits:
                return pairs
            got = bits_for(hits, number, pairs.keys, buckets)
            active = active[(got[OTHER_BATCH] | (pairs.key_count > 1))[pairs.inverse]]
            common[active] = self.succ[number - 1][active] - self.anchor[active]
        a, lo, hi = self.anchor[active], self.lo[active], self.hi[active]
        core = self.span(a, a + self.length - SPREAD + 1)
        around = mix(self.span(lo, hi + self.length) + (a - lo).astype(np.uint64))
        pairs = Pairs(core, around)
        if 3 not in hits:
            return pairs
        got = bits_for(hits, 3, pairs.keys, buckets)
        same = (got[SAME_PAIR] | (pairs.count > 1))[pairs.inverse]
        mixed = (got[MANY_VALUES] | (pairs.key_values > 1))[pairs.inverse]
        common[active[same | mixed]] = self.length - SPREAD + 1
        single = _ranges(lo[mixed], hi[mixed])
        pairs = Pairs(self.span(single, single + self.length))
        if 4 not in hits:
            return pairs
        got = bits_for(hits, 4, pairs.keys, buckets)
        again = (got[OTHER_BATCH] | (pairs.key_count > 1))[pairs.inverse]
        return np.concatenate([_ranges(lo[same], hi[same]), single[again]]), common


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the closed ranges."""
    sizes = hi - lo + 1
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(lo - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)


def remove_repeated_bytes(spark: SparkSession, docs: DataFrame, length: int = 400, batch_bytes: int = 2 << 20, bucket_bytes: int = 8 << 20, fan: int = FAN) -> DataFrame:
    """Per row of ``docs``: removed byte intervals (end exclusive), the remaining bytes, and the longest common prefix known. ``length`` from 160."""
    if length < 160:
        raise ValueError("length must be 160 or more: an anchor's strings have to share most of their bytes")
    scratch = Scratch(spark, "suffix")
    packed = scratch.table(pack(docs, batch_bytes), "packed")
    buckets = buckets_for(packed, bucket_bytes, fan)
    hits = None

    def emit(batch: Batch, hits) -> tuple[np.ndarray, np.ndarray]:
        pairs = Shard(batch, length).refine(hits, buckets)
        return pairs.keys, pairs.vals

    def marked(hits: dict, done: int) -> dict:
        return {n: hits.get(n, []) for n in range(1, done + 1)}  # a pass in which the batch had nothing open

    for number in (1, 2, 3, 4):
        new = exchange(scratch, packed, hits, lambda b, h, n=number: emit(b, marked(h, n - 1)), number, buckets)
        hits = new if hits is None else hits.unionByName(new)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                batch = unpack(row)
                shard = Shard(batch, length)
                start, common = shard.refine(marked(read_hits(row["hits"]), 4), buckets)
                step = np.zeros(len(batch.data) + 1, np.int64)
                np.add.at(step, start, 1)
                np.add.at(step, start + length, -1)
                longest = np.zeros(len(batch.ids), np.int64)
                np.maximum.at(longest, np.searchsorted(batch.starts, shard.anchor, "right") - 1, common)
                yield _rows(batch, np.cumsum(step)[:-1] > 0, longest)

    return with_hits(packed, hits).mapInArrow(cut, SCHEMA)


def _rows(batch: Batch, gone: np.ndarray, longest: np.ndarray) -> pa.RecordBatch:
    spans, kept, n_removed = [], [], []
    for i, (a, size) in enumerate(zip(batch.starts, batch.sizes, strict=True)):
        g = gone[a : a + size]
        step = np.diff(np.concatenate([[0], g.astype(np.int8), [0]]))
        spans.append([{"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)])
        kept.append(batch.data[a : a + size][~g].tobytes())
        n_removed.append(int(g.sum()))
        longest[i] = max(longest[i], max((x["end"] - x["start"] for x in spans[-1]), default=0))
    return pa.RecordBatch.from_arrays(
        [id_list(batch.ids), pa.array(batch.sizes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary()), pa.array(longest)],
        ["doc_id", "n_bytes", "n_removed", "removed", "kept", "longest_common"],
    )
