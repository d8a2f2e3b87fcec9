"""Repeated token windows: Rabin-Karp hashes of every window, counted in Spark, merged into removal intervals.

Every run of ``window`` consecutive words of every document is hashed by a rolling polynomial over the words'
own hashes. Batches send their distinct window hashes with the smallest doc_id that has each; the bucket of a
hash answers whether a smaller doc_id has it anywhere (see ``exchange``). A word goes if any window over it
starts in a document with a smaller doc_id; overlapping windows merge into maximal intervals.

Scale: one shuffle of about eight bytes a word (two beyond ``fan`` buckets), one of the compressed texts; a passage that a third of all
documents share costs one entry a batch. At 64 bits two different windows among ten billion are expected to
collide about twice; nothing else is approximate.

Edge cases: null or empty text and texts of fewer than ``window`` words keep all words. A null doc_id counts as
larger than every other; documents with equal ids (or both null) do not remove each other's words. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumisift.llm.exchange import FAN, SMALLER_VALUE, Pairs, bits_for, buckets_for, exchange, read_hits, with_hits
from lumisift.llm.text import Batch, id_list, pack, run_hashes, unpack, word_hashes
from lumisift.plans.scratch import Scratch

SCHEMA = "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string"


def _windows(batch: Batch, window: int):
    """Word bounds, first words, and for each window its first word, its owner as an unsigned number and its pairs."""
    starts, ends, first = batch.words()
    doc = batch.doc_of(first)
    h = run_hashes(word_hashes(batch.data, starts, ends), window)
    at = np.flatnonzero(doc[: len(h)] == doc[window - 1 :]) if len(h) else np.zeros(0, np.int64)
    owner = batch.ids[doc[at]].view(np.uint64) ^ np.uint64(1 << 63)  # unsigned in the order of the signed ids
    keys = h[at]
    pairs = Pairs(keys)
    least = np.full(len(pairs.keys), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, pairs.inverse, owner)
    return starts, ends, first, at, owner, pairs, least


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = 13, batch_bytes: int = 2 << 20, bucket_bytes: int = 4 << 20, fan: int = FAN) -> DataFrame:
    """Per row of ``docs``: word counts, removed word intervals (end exclusive) and the kept words joined by a space."""
    scratch = Scratch(spark, "substring")
    packed = scratch.table(pack(docs, batch_bytes), "packed")
    buckets = buckets_for(packed, bucket_bytes, fan)

    def emit(batch: Batch, _) -> tuple[np.ndarray, np.ndarray]:
        *_, pairs, least = _windows(batch, window)
        return pairs.keys, least

    hits = exchange(scratch, packed, None, emit, 1, buckets)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                batch = unpack(row)
                starts, ends, first, at, owner, pairs, least = _windows(batch, window)
                elsewhere = bits_for(read_hits(row["hits"]), 1, pairs.keys, buckets)[SMALLER_VALUE]
                bad = at[elsewhere[pairs.inverse] | (owner > least[pairs.inverse])]
                step = np.zeros(len(starts) + 1, np.int64)
                np.add.at(step, bad, 1)
                np.add.at(step, bad + window, -1)
                gone = np.cumsum(step)[:-1] > 0
                yield _rows(batch, starts, ends, first, gone)

    return with_hits(packed, hits).mapInArrow(cut, SCHEMA)


def _rows(batch: Batch, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    spans, texts = [], []
    for a, b in zip(first[:-1], first[1:], strict=True):
        g = gone[a:b]
        step = np.diff(np.concatenate([[0], g.astype(np.int8), [0]]))
        spans.append([{"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)])
        texts.append(b" ".join(batch.raw[x:y] for x, y, z in zip(starts[a:b].tolist(), ends[a:b].tolist(), g.tolist(), strict=True) if not z))
    total = np.concatenate([[0], np.cumsum(gone)])
    return pa.RecordBatch.from_arrays(
        [
            id_list(batch.ids),
            pa.array(np.diff(first), pa.int64()),
            pa.array(np.diff(total[first]), pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            pa.array(texts, pa.binary()).cast(pa.string()),
        ],
        ["doc_id", "n_words", "n_removed", "removed", "kept_text"],
    )
