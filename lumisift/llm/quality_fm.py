"""Quality score of a text by a factorisation machine.

Inputs: hashed words (log counts, scaled to unit length), statistics of the text's structure (lengths, shares of
symbols, capitals, digits, repeats and the like, standardised) and metadata columns as hashed categories. The
machine adds a bias, linear weights and low-rank interactions of all pairs, scored in linear time by
1/2 * sum over factors of (sum v x)^2 - sum (v x)^2. It is fitted by Adagrad on the driver, on a bounded sample of labelled
rows: at most ``max_rows``, and in a hash order as many whole texts as ``max_bytes`` hold (both are parameters), whose
features, 12 bytes for each of a text's words at most, come to the driver. Every document is then scored, whole, where it
is read: no shuffle.

Edge cases: null or empty texts have no words and are scored from their structure; null metadata is a category
of its own; without labelled rows of both classes, as in an empty table, every score is 0.5. Repeated rows score alike;
of labelled rows that share an id one is trained on. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumisift.llm.text import Batch, batches_of, id_list, mix, word_hashes
from lumisift.llm.training import fold, labelled_rows, one_row_an_id
from lumisift.plans.scratch import Scratch

WORD_BITS = 15
META_BITS = 6
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_LOWER = np.isin(np.arange(256), np.arange(97, 123)) | (np.arange(256) >= 128)
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_MARK = np.isin(np.arange(256), list(b".,;:!?"))
_LINE = np.arange(256) == 10
_OTHER = (np.arange(256) > 32) & ~(_UPPER | _LOWER | _DIGIT | _MARK) & (np.arange(256) < 127)
N_STATS = 12


@dataclass
class Features:
    """Sparse part as CSR (index, value, first) and structure statistics, one row for each document."""

    index: np.ndarray
    value: np.ndarray
    first: np.ndarray
    stats: np.ndarray


def features(batch: Batch, meta: list[list[str | None]]) -> Features:
    starts, ends, first = batch.words()
    doc = batch.doc_of(first)
    n, n_words = len(batch.ids), np.diff(first)
    slot = (word_hashes(batch.data, starts, ends) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key, count = np.unique(doc * (1 << WORD_BITS) + slot, return_counts=True)
    of, value = key >> WORD_BITS, np.log1p(count)
    norm = np.sqrt(np.bincount(of, value**2, n))
    value = value / np.maximum(norm[of], 1e-12)
    index = [key & ((1 << WORD_BITS) - 1)]
    rows, values = [of], [value]
    for c, column in enumerate(meta):
        slots = [(hash_text(f"{c}={v}") >> (64 - META_BITS)) for v in column]
        index.append((1 << WORD_BITS) + np.array(slots, np.int64))
        rows.append(np.arange(n))
        values.append(np.full(n, 0.3))
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    total = lambda flag: np.concatenate([[0], np.cumsum(flag)])
    per = lambda flag: (lambda t: t[batch.starts + batch.sizes] - t[batch.starts])(total(flag[batch.data]))
    size, words = np.maximum(batch.sizes, 1), np.maximum(n_words, 1)
    distinct, lines = np.bincount(of, minlength=n), per(_LINE) + 1
    lengths = ends - starts
    squares = np.bincount(doc, lengths.astype(float) ** 2, n) / words
    mean = np.bincount(doc, lengths, n) / words
    stats = [np.log1p(n_words), np.log1p(batch.sizes), mean, np.sqrt(np.maximum(0, squares - mean**2)), distinct / words, np.log1p(words / lines)]
    stats += [per(f) / size for f in (_UPPER, _DIGIT, _MARK, _OTHER)]
    capital = total(_UPPER[batch.data[starts]])[first]
    stats += [np.diff(capital) / words, np.bincount(of, (count > 3) * count, n) / words]
    return Features(np.concatenate(index)[order], np.concatenate(values)[order].astype(np.float32), np.searchsorted(row[order], np.arange(n + 1)), np.stack(stats, 1).astype(np.float32))


def hash_text(s: str) -> int:
    h = np.uint64(1469598103934665603)
    for b in s.encode():
        h = np.uint64((int(h) ^ b) * 1099511628211 & (1 << 64) - 1)
    return int(mix(np.array([h]))[0])


def _sum_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows between ``first`` marks, empty ones included."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[:-1][full], axis=0)
    return out


class Machine:
    """Factorisation machine with logistic output."""

    def __init__(self, size: int, rank: int, seed: int):
        self.bias, self.linear = 0.0, np.zeros(size, np.float32)
        self.factors = np.random.default_rng(seed).normal(0, 0.05, (size, rank)).astype(np.float32)
        self.mean, self.scale = np.zeros(N_STATS, np.float32), np.ones(N_STATS, np.float32)

    def with_stats(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CSR with the standardised statistics as the last N_STATS inputs."""
        z = np.clip((f.stats - self.mean) / self.scale, -4, 4) * 0.5
        n, per = len(z), np.diff(f.first)
        base = len(self.linear) - N_STATS
        row = np.concatenate([np.repeat(np.arange(n), per), np.repeat(np.arange(n), N_STATS)])
        order = np.argsort(row, kind="stable")
        index = np.concatenate([f.index, np.tile(base + np.arange(N_STATS), n)])[order]
        value = np.concatenate([f.value, z.ravel()])[order].astype(np.float32)
        return index, value, f.first + N_STATS * np.arange(n + 1)

    def raw(self, index: np.ndarray, value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.factors[index] * value[:, None]
        sums = _sum_by(vx, first)
        pairs = 0.5 * (sums**2 - _sum_by(vx**2, first)).sum(1)
        return self.bias + _sum_by(self.linear[index] * value, first) + pairs, sums

    def score(self, f: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.with_stats(f))[0], -30, 30)))

    def fit(self, parts: list[Features], y: np.ndarray, epochs: int, rate: float, decay: float, seed: int) -> None:
        stats = np.concatenate([p.stats for p in parts])
        self.mean, self.scale = stats.mean(0), stats.std(0) + 1e-3
        index, value, first = self.with_stats(_join(parts))
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
        weight = np.sqrt(weight / weight.mean())
        rng = np.random.default_rng(seed)
        g_bias, g_lin, g_fac = 1.0, np.full(len(self.linear), 1e-2, np.float32), np.full(len(self.linear), 1e-2, np.float32)
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
                at = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
                bounds = np.concatenate([[0], np.cumsum(first[rows + 1] - first[rows])])
                i, x = index[at], value[at]
                raw, sums = self.raw(i, x, bounds)
                error = (weight[rows] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows])) / len(rows)
                of = np.repeat(np.arange(len(rows)), np.diff(bounds))
                e = (error[of] * x).astype(np.float32)
                used, inverse = np.unique(i, return_inverse=True)
                lin = np.bincount(inverse, e, len(used)).astype(np.float32) + decay * self.linear[used]
                step = e[:, None] * (sums[of].astype(np.float32) - self.factors[i] * x[:, None])
                fac = np.stack([np.bincount(inverse, step[:, k], len(used)) for k in range(step.shape[1])], 1).astype(np.float32) + decay * self.factors[used]
                g_bias += float(error.sum()) ** 2
                g_lin[used] += lin**2
                g_fac[used] += (fac**2).mean(1)
                self.bias -= rate * float(error.sum()) / g_bias**0.5
                self.linear[used] -= rate * lin / np.sqrt(g_lin[used])
                self.factors[used] -= 0.3 * rate * fac / np.sqrt(g_fac[used])[:, None]


def _join(parts: list[Features]) -> Features:
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.first) for p in parts]))])
    return Features(np.concatenate([p.index for p in parts]), np.concatenate([p.value for p in parts]), first, np.concatenate([p.stats for p in parts]))


def _within(sample: DataFrame, max_bytes: int) -> DataFrame:
    """The rows of a written sample, in a hash order, that ``max_bytes`` of text hold; their ids are at most the sample's rows."""
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    sizes = sample.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")).withColumn("upto", upto)
    return sample.join(F.broadcast(sizes.where(F.col("upto") <= max_bytes).select("id")), "id", "left_semi")


def score_documents(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    folds: int = 3,
    held_out: int = 1,
    max_rows: int = 6000,
    max_bytes: int = 64 << 20,
    rank: int = 8,
    epochs: int = 8,
    rate: float = 0.1,
    decay: float = 1e-5,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    meta_cols: tuple[str, ...] = (),
) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. ``meta_cols`` must not hold labels or identifiers."""
    meta = [F.col(c).cast("string").alias(f"meta{i}") for i, c in enumerate(meta_cols)]
    size = (1 << WORD_BITS) + (1 << META_BITS) + N_STATS

    def parts_of(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[Batch, Features, pa.RecordBatch]]:
        for part in parts:
            done = 0
            for b in batches_of(part.column("id"), part.column("text"), 1 << 20):
                own = part.slice(done, len(b.ids))
                done += len(b.ids)
                yield b, features(b, [own.column(f"meta{i}").to_pylist() for i in range(len(meta_cols))]), own

    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, f, own in parts_of(parts):
            yield pa.RecordBatch.from_pydict({k: [getattr(f, k).tobytes()] for k in ("index", "value", "first", "stats")} | {"label": [np.array(own.column("label"), np.int64).tobytes()]})

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *meta)
    named = source.withColumnsRenamed({"id": id_col, "text": text_col})
    sample = one_row_an_id(labelled_rows(named, labels, label, folds, held_out, max_rows, id_col, text_col, tuple(f"meta{i}" for i in range(len(meta_cols)))))
    sample = _within(Scratch(spark, "quality").table(sample, "sample"), max_bytes)
    got = sample.mapInArrow(gather, "index binary, value binary, first binary, stats binary, label binary").collect()
    machine = Machine(size, rank, seed)
    if got:
        got.sort(key=lambda r: bytes(r["label"]) + bytes(r["first"]))
        fs = [Features(np.frombuffer(r["index"], np.int64), np.frombuffer(r["value"], np.float32), np.frombuffer(r["first"], np.int64), np.frombuffer(r["stats"], np.float32).reshape(-1, N_STATS)) for r in got]
        y = np.concatenate([np.frombuffer(r["label"], np.int64) for r in got]).astype(np.float64)
        if 0 < y.mean() < 1:
            machine.fit(fs, y, epochs, rate, decay, seed)
        else:
            machine.factors[:] = 0
    model = spark.sparkContext.broadcast(machine)  # (2^15 + 2^6 + 12) * (rank + 1) floats, whatever the input

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, f, own in parts_of(parts):
            yield pa.RecordBatch.from_arrays([id_list(b.ids), own.column("held_out"), pa.array(model.value.score(f), pa.float64())], ["doc_id", "held_out", "score"])

    held = F.coalesce(fold("id", folds) == held_out, F.lit(False)).alias("held_out")
    out = source.select("id", "text", *(f"meta{i}" for i in range(len(meta_cols))), held).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
