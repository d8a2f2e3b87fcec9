"""Words, rolling hashes and packed batches shared by the text operators.

A *word* is a maximal run of bytes other than space and \\t..\\r, so it can be found in UTF-8 without decoding.
All hashing is vectorised: prefix sums of a polynomial over Z/2^64 give the hash of any span in O(1), as in
Rabin and Karp, and a 64-bit finaliser spreads the result over all bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id inside numpy; sorts last

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_powers: dict[tuple[int, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**n (or of its inverse) modulo 2^64, kept between calls of a Python worker."""
    have = _powers.get((base, inverse))
    if have is None or len(have) <= n:
        step = pow(base, -1, 1 << 64) if inverse else base
        row = np.full(1 << max(16, (n + 1).bit_length()), step, np.uint64)
        row[0] = 1
        have = _powers[base, inverse] = np.multiply.accumulate(row)
    return have[: n + 1]


def prefix_hash(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums P with P[i] = sum of values[j] * base**j for j < i."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(base, len(values))[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Position-free hash of values[start:end] for each pair."""
    return mix((prefix[end] - prefix[start]) * powers(base, len(prefix) - 1, True)[start])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of one buffer."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(data.astype(np.uint64) + np.uint64(1), _BYTE_BASE), starts, ends, _BYTE_BASE)


def run_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive values."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return span_hash(prefix_hash(values, _WORD_BASE), at, at + length, _WORD_BASE)


class Batch:
    """Some whole documents: ids (NO_ID for null), raw UTF-8 bytes joined by one space each, and their offsets."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: bytes):
        self.ids = ids
        self.sizes = sizes
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
        self.raw = data
        self.data = np.frombuffer(data, np.uint8)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each document the index of its first word (one more entry at the end)."""
        starts, ends = word_bounds(self.data)
        return starts, ends, np.concatenate([np.searchsorted(starts, self.starts), [len(starts)]])

    def doc_of(self, first: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), np.diff(first))


def batches_of(ids: pa.Array, texts: pa.Array, limit: int) -> Iterator[Batch]:
    """Cut Arrow columns into batches of about ``limit`` bytes; a null text is empty."""
    texts = texts.cast(pa.large_binary())
    group, size = [], 0
    for i, t in zip(ids.to_pylist(), texts, strict=True):
        b = t.as_py() or b""
        group.append((NO_ID if i is None else i, b))
        size += len(b)
        if size >= limit:
            yield _batch(group)
            group, size = [], 0
    if group:
        yield _batch(group)


def _batch(group: list[tuple[int, bytes]]) -> Batch:
    return Batch(np.array([i for i, _ in group], np.int64), np.array([len(b) for _, b in group], np.int64), b" ".join(b for _, b in group))


PACKED = "batch_id long, n_bytes long, ids binary, sizes binary, packed binary"


def pack(docs: DataFrame, batch_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for some megabytes of whole documents, compressed: the unit in which texts are shuffled or stored.

    The composition of a batch follows the task that reads the input, so the result must be written once
    (``Scratch.table``) before its ``batch_id`` is used as a key.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, n, codec = TaskContext.get().partitionId() << 32, 0, pa.Codec("zstd", 3)
        for part in parts:
            for b in batches_of(part.column(0), part.column(1), batch_bytes):
                packed = codec.compress(b.raw, asbytes=True)
                yield pa.RecordBatch.from_pydict({"batch_id": [base + n], "n_bytes": [len(b.raw)], "ids": [b.ids.tobytes()], "sizes": [b.sizes.tobytes()], "packed": [packed]})
                n += 1

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PACKED)


def unpack(row: dict) -> Batch:
    data = pa.Codec("zstd").decompress(row["packed"], row["n_bytes"], asbytes=True) if row["n_bytes"] else b""
    return Batch(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64), data)


def id_list(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)
