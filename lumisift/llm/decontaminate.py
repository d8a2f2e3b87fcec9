"""Benchmark decontamination by latent semantic retrieval.

Words (lower case, punctuation removed) are hashed to 2^13 terms. Document frequencies over all documents give
squared inverse-frequency weights; terms in more than a twentieth of the documents keep a token weight. The
latent space is the span of the leading right singular vectors of the TF-IDF matrix of all passages of 40 words of
all documents, found by a randomised range finder with power iterations whose products A^T (A Q) are summed over Spark
tasks. The terms of these passages, two bytes a word, are written once and read for each product.

Every document is cut into overlapping passages of 8, 16, 32 and 64 words, as the lengths of the items ask, stepping a
quarter of that (half, for the shortest); every passage is projected and compared by cosine with every benchmark item of its length class, in the task that
reads the document. Candidates at ``cosine`` or more that share enough words are verified on the words
themselves: the longest common subsequence with the item over the passage and its surroundings must reach
``whole`` of the item's words, or ``part`` of them if the item's answer (its last fifth) is there in one run.

The model (2^13 x rank floats) and one block of items at a time (about ``item_block``, some 2 kB each beside their own
words) are broadcast, so their size is bounded; documents are read once for each block. Nothing but the answers is shuffled.

Edge cases: null or empty texts and items match nothing; null ids are carried as null; repeated documents and
items are reported each; an empty benchmark or table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.llm.text import Batch, batches_of, word_hashes
from lumisift.plans.scratch import Scratch

TERMS_BITS, STEP = 13, 4
CLASSES = ((8, 12), (16, 24), (32, 48), (64, None))  # passage words, and the longest item they serve
PASSAGE, BLOCK, PAD = 40, 8192, 1 << TERMS_BITS  # words of a passage the space is fitted on, passages summed at a time, the term of no word
COMMON = 0.05
_SPACES = b" \t\n\r\v\f"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_DROP = bytes(c for c in range(128) if not chr(c).isalnum() and c not in _SPACES)


def normal_words(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normalised words of all documents, and where each document's begin (one more at the end)."""
    texts = [batch.raw[a : a + s].translate(_TABLE, _DROP) for a, s in zip(batch.starts.tolist(), batch.sizes.tolist(), strict=True)]
    clean = Batch(batch.ids, np.array([len(t) for t in texts], np.int64), b" ".join(texts))
    starts, ends, first = clean.words()
    return word_hashes(clean.data, starts, ends), first


def terms(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - TERMS_BITS)).astype(np.int64)


def _passages(docs: DataFrame) -> DataFrame:
    """All words of all documents: the terms of passages (binary, some thousand a row), and from each task its documents and document frequencies."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n, held = np.zeros(PAD, np.int64), 0, []
        row = lambda **x: pa.RecordBatch.from_pylist([x], pa.schema([("docs", pa.int64()), ("found", pa.binary()), ("terms", pa.binary())]))
        for part in parts:
            for b in batches_of(part.column(0), part.column(1), 1 << 20):
                h, first = normal_words(b)
                t, size = terms(h), np.diff(first)
                count += np.bincount(np.unique(b.doc_of(first) << TERMS_BITS | t) & (PAD - 1), minlength=PAD)
                n += len(b.ids)
                begin = np.concatenate([[0], np.cumsum(-(-size // PASSAGE) * PASSAGE)])  # documents are padded to whole passages
                padded = np.full(begin[-1], PAD, np.int16)
                padded[np.arange(len(t)) + np.repeat(begin[:-1] - first[:-1], size)] = t
                held.append(padded.tobytes())
                if sum(map(len, held)) >= 2 * PASSAGE * BLOCK:
                    yield row(terms=b"".join(held))
                    held = []
        yield row(docs=n, found=count.tobytes(), terms=b"".join(held) or None)

    return docs.mapInArrow(run, "docs long, found binary, terms binary")


def _frequencies(passages: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequency of each term, and the number of documents."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n = np.zeros(PAD, np.int64), 0
        for part in parts:
            n += sum(part.column(0).to_pylist())
            for found in part.column(1):
                count += np.frombuffer(found.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, PAD)), pa.array(np.concatenate([[n], count]))], ["term", "n"])

    per_task = passages.where("found is not null").select("docs", "found")
    rows = per_task.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # one row a term
    got = {r["term"]: r["n"] for r in rows}
    return np.array([got.get(t, 0) for t in range(PAD)], np.float64), got.get(-1, 0)


def _weights(df: np.ndarray, n: int) -> np.ndarray:
    idf = np.log((n + 1) / (df + 1)) + 0.01
    return np.where(df > max(5, COMMON * n), 1e-3, idf**2)


def _squared_norms(t: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Squared length of each passage (row of terms): a term counts its number times its weight."""
    t = np.sort(t, axis=1)
    new = np.ones(t.shape, bool)
    new[:, 1:] = t[:, 1:] != t[:, :-1]
    at = np.flatnonzero(new)
    return np.bincount(at // t.shape[1], (np.diff(at, append=t.size) * weight[t.ravel()[at]]) ** 2, minlength=len(t))


def _list_sums(rows: np.ndarray, index: np.ndarray, first: np.ndarray, size: np.ndarray, some: int = 256) -> np.ndarray:
    """Sums of ``rows[index[first : first + size]]`` for lists of falling size, the next member of many lists at a time."""
    out, buffer = np.empty((len(size), rows.shape[1]), rows.dtype), np.empty((some, rows.shape[1]), rows.dtype)
    for lo in range(0, len(size), some):
        f, s, sums = first[lo : lo + some], size[lo : lo + some], out[lo : lo + some]
        np.take(rows, index[f], axis=0, out=sums, mode="clip")
        for j, n in enumerate(np.searchsorted(-s, -np.arange(1, s[0])).tolist(), 1):  # n lists have more than j members
            sums[:n] += np.take(rows, index[f[:n] + j], axis=0, out=buffer[:n], mode="clip")
    return out


def _add_by_term(t: np.ndarray, rows: np.ndarray, out: np.ndarray, longest: int = 64) -> None:
    """Add a passage's row to ``out`` at each of its terms; lists of passages are cut at ``longest``, their sums summed again."""
    key = t.ravel()
    index = np.argsort(key, kind="stable")[: np.count_nonzero(key < PAD)]
    key, index = key[index], index // t.shape[1]
    while len(key):
        at = np.flatnonzero(np.diff(key, prepend=-1))
        size = np.diff(at, append=len(key))
        lists = -(-size // longest)
        skip = (np.arange(lists.sum()) - np.repeat(np.cumsum(lists) - lists, lists)) * longest
        size, key = np.minimum(longest, np.repeat(size, lists) - skip), np.repeat(key[at], lists)
        order = np.argsort(-size, kind="stable")
        rows = _list_sums(rows, index, (np.repeat(at, lists) + skip)[order], size[order])
        if len(key) == len(at):
            out[key[order]] += rows
            return
        index = np.argsort(order)


def _product(passages: DataFrame, weight: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A^T (A q) over all passages, summed in the tasks and then by parts of 64 terms."""
    shared, part_terms = passages.sparkSession.sparkContext.broadcast((np.append(weight, 0.0), np.concatenate([q * weight[:, None], np.zeros((1, q.shape[1]))]).astype(np.float32))), 64

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, q = shared.value
        out = np.zeros((PAD, q.shape[1]))
        for part in parts:
            for row in part.column(0):
                every = np.frombuffer(row.as_py(), np.int16).reshape(-1, PASSAGE)
                for lo in range(0, len(every), BLOCK):
                    t = every[lo : lo + BLOCK]
                    y = np.zeros((len(t), q.shape[1]), np.float32)
                    buffer = np.empty_like(y)
                    for i in range(PASSAGE):
                        y += np.take(q, t[:, i], axis=0, out=buffer, mode="clip")
                    y /= _squared_norms(t, weight)[:, None].astype(np.float32)
                    _add_by_term(t, y, out)
        out *= weight[:PAD, None]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(0, PAD, part_terms)), pa.array([out[i : i + part_terms].tobytes() for i in range(0, PAD, part_terms)], pa.binary())], ["part", "sums"])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for part in parts:
            for at, sums in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                total[at] = total.get(at, 0) + np.frombuffer(sums.as_py(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "sums"])

    schema = "part long, sums binary"
    rows = passages.where("terms is not null").select("terms").mapInArrow(run, schema).repartition("part").mapInArrow(add, schema).collect()
    out = np.zeros(q.shape)
    for r in rows:
        out[r["part"] : r["part"] + part_terms] = np.frombuffer(r["sums"], np.float64).reshape(-1, q.shape[1])
    shared.destroy()
    return out


def latent_space(spark: SparkSession, docs: DataFrame, rank: int, iterations: int = 2, seed: int = 3) -> np.ndarray:
    """Term vectors: weight times the leading right singular vectors, one row a term."""
    scratch = Scratch(spark, "latent")
    passages = scratch.table(_passages(docs), "passages", codec="zstd")
    weight = _weights(*_frequencies(passages))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(PAD, rank + 8)))[0]
    for _ in range(iterations):
        q = np.linalg.qr(_product(passages, weight, q))[0]
    small = q.T @ _product(passages, weight, q)
    scratch.drop(passages)
    vectors = np.linalg.eigh((small + small.T) / 2)[1][:, ::-1][:, :rank]
    return ((q @ vectors) * weight[:, None]).astype(np.float32)


@dataclass
class Items:
    """One block of benchmark items: words, and for each length class the unit latent vectors."""

    ids: list
    words: list[np.ndarray]
    by_class: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    has: np.ndarray | None = None

    @staticmethod
    def of(rows: list, space: np.ndarray) -> Items:
        texts = [(r["text"] or "").encode() for r in rows]
        batch = Batch(np.arange(len(rows)), np.array([len(t) for t in texts], np.int64), b" ".join(texts))
        h, first = normal_words(batch)
        out = Items([r["item_id"] for r in rows], [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)])
        vec = np.stack([space[terms(w)].sum(0) if len(w) else np.zeros(space.shape[1], np.float32) for w in out.words])
        vec /= np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-12)
        size, done = np.array([len(w) for w in out.words]), 0
        for _, longest in CLASSES:
            own = np.flatnonzero((size > done) & (size <= (longest or 1 << 62)))
            done = longest
            out.by_class.append((own, np.ascontiguousarray(vec[own].T)))
        out.has = np.zeros((len(rows), 1 << TERMS_BITS - 3), np.uint8)  # a bit for each term
        for i, w in enumerate(out.words):
            t = terms(w)
            np.bitwise_or.at(out.has[i], t >> 3, (1 << (t & 7)).astype(np.uint8))
        return out

    def hold(self, item: np.ndarray, term: np.ndarray) -> np.ndarray:
        return (self.has[item, term >> 3] >> (term & 7).astype(np.uint8) & 1).astype(bool)


def common_subsequence(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, one machine operation for each text word that the item has."""
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in text:
        if m := where.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def _verify(item: np.ndarray, text: np.ndarray, whole: float, part: float) -> tuple[int, bool, bool]:
    a, b = item.tolist(), text.tolist()
    lcs = common_subsequence(a, b)
    tail = a[-max(3, len(a) // 5) :]
    answer = any(b[i : i + len(tail)] == tail for i in range(len(b) - len(tail) + 1) if b[i] == tail[0])
    return lcs, answer, lcs >= whole * len(a) or (lcs >= part * len(a) and answer)


def _hits(batch: Batch, space: np.ndarray, items: Items, cosine: float, whole: float, part: float) -> list[tuple[int, int, float, int, bool]]:
    """(document, item, cosine, common words, answer) for every leak in a batch, best passage of each pair."""
    h, first = normal_words(batch)
    n = np.diff(first)
    if not len(h):
        return []
    t = terms(h)
    blocks = -(-n // STEP)
    block_first = np.concatenate([[0], np.cumsum(blocks)])
    # documents are padded to whole blocks with a term of no weight, then four gathers make the block sums
    padded = np.full(block_first[-1] * STEP, len(space))
    padded[np.arange(len(h)) + np.repeat(block_first[:-1] * STEP - first[:-1], n)] = t
    full = np.concatenate([space, np.zeros((1, space.shape[1]), np.float32)])
    sums = sum(full[padded[i::STEP]] for i in range(STEP))
    doc_of_block = np.repeat(np.arange(len(n)), blocks)
    best: dict[tuple[int, int], tuple[int, bool, float]] = {}
    seen: set[tuple[int, int, int]] = set()
    sizes = np.array([len(w) for w in items.words])
    wide, stride = 1, 1
    for (width, _), (own, vec) in zip(CLASSES, items.by_class, strict=True):
        while wide < width // STEP:  # sums over twice as many blocks, at steps of a quarter passage
            more = np.concatenate([sums[wide // stride :], np.zeros((wide // stride, sums.shape[1]), np.float32)])[: len(sums)]
            sums, wide = sums + more, 2 * wide
            if wide > 4:
                sums, stride = sums[::2], 2 * stride
        if not len(own):
            continue
        at, some = np.arange(len(sums)) * stride, max(64, min(2048, (1 << 20) // len(own)))
        for lo in range(0, len(at), some):
            a, w = at[lo : lo + some], sums[lo : lo + some]
            cos = (w @ vec) / np.maximum(np.sqrt(np.einsum("ij,ij->i", w, w)), 1e-12)[:, None]
            i, j = np.nonzero(cos >= cosine)
            docs, of_item, score = doc_of_block[a[i]], own[j], cos[i, j]
            words = first[docs] + (a[i] - block_first[docs]) * STEP
            at_word = words[:, None] + np.arange(width)
            inside = at_word < first[docs + 1][:, None]
            shared = (items.hold(of_item[:, None], t[np.minimum(at_word, len(t) - 1)]) & inside).sum(1)
            enough = np.flatnonzero(shared >= 0.4 * np.minimum(sizes[of_item], width))
            for doc, item, word, c in zip(docs[enough].tolist(), of_item[enough].tolist(), words[enough].tolist(), score[enough].tolist(), strict=True):
                need = items.words[item]
                lo_w, hi_w = max(first[doc], word - len(need)), min(first[doc + 1], word + width + len(need))
                key = (doc, item, (word - int(first[doc])) // max(STEP, width // 2))
                if key in seen or best.get((doc, item), (0,))[0] == len(need):
                    continue
                lcs, answer, leak = _verify(need, h[lo_w:hi_w], whole, part)
                if leak:
                    seen.add(key)
                    if lcs > best.get((doc, item), (0,))[0]:
                        best[doc, item] = (lcs, answer, c)
    return [(d, i, c, n_lcs, ans) for (d, i), (n_lcs, ans, c) in sorted(best.items())]


def _item_blocks(spark: SparkSession, benchmark: DataFrame, space: np.ndarray, size: int, item_col: str, text_col: str) -> Iterator:
    """Broadcast blocks of at most about ``size`` items."""
    source = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    parts = max(1, -(-source.count() // size))
    for i in range(parts):
        rows = source.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i).orderBy("item_id", "text").collect()
        if rows:
            yield spark.sparkContext.broadcast(Items.of(rows, space))


TUNING = {"rank": 96, "cosine": 0.42, "whole": 0.8, "part": 0.5, "item_block": 8192}


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", **tuning) -> DataFrame:
    """(doc_id, item_id, cosine, common_words, item_words, answer), one row for each leaking pair."""
    o = TUNING | tuning
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    space = latent_space(spark, source, o["rank"])
    shared = spark.sparkContext.broadcast(space)
    schema = "doc_id long, item_id long, cosine double, common_words long, item_words long, answer boolean"

    def searcher(items):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                ids, done = part.column(0), 0
                for b in batches_of(ids, part.column(1), 1 << 19):
                    got = _hits(b, shared.value, items.value, o["cosine"], o["whole"], o["part"])
                    rows = [(ids[done + d].as_py(), items.value.ids[i], c, n, len(items.value.words[i]), a) for d, i, c, n, a in got]
                    done += len(b.ids)
                    yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "cosine", "common_words", "item_words", "answer"), r, strict=True)) for r in rows], pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("common_words", pa.int64()), ("item_words", pa.int64()), ("answer", pa.bool_())]))

        return run

    out = spark.createDataFrame([], schema)
    for items in _item_blocks(spark, benchmark, space, o["item_block"], item_col, text_col):
        out = out.unionByName(source.mapInArrow(searcher(items), schema))
    return out


def clean_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", **tuning) -> DataFrame:
    """``docs`` without the documents that leak an item; columns unchanged, no shuffle."""
    o = TUNING | tuning
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    space = latent_space(spark, source, o["rank"])
    shared = spark.sparkContext.broadcast(space)
    at = docs.columns.index(text_col)

    def filterer(items):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                keep, done = np.ones(part.num_rows, bool), 0
                texts = part.column(at).cast(pa.string()) if part.num_rows else part.column(at)
                for b in batches_of(pa.array(np.arange(part.num_rows)), texts, 1 << 19):
                    for d, *_ in _hits(b, shared.value, items.value, o["cosine"], o["whole"], o["part"]):
                        keep[done + d] = False
                    done += len(b.ids)
                yield part.filter(pa.array(keep))

        return run

    for items in _item_blocks(spark, benchmark, space, o["item_block"], item_col, text_col):
        docs = docs.mapInArrow(filterer(items), docs.schema)
    return docs
