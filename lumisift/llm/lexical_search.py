"""Ranked lexical search over posting lists in blocks of similar documents, exact.

Documents are cut, as they are read, into shards that keep the terms which items ask for. Document frequencies and sizes
are counted over all shards in Spark and give every posting its impact. In a shard, the posting list of a term is
clustered: its documents go to the nearest of some representatives drawn from the list, by signed projections of their
impact vectors. Each block stores the greatest impact of each coordinate (the terms of the items that open the list) over
its documents. The product of that summary with an item is a bound of all scores in the block, so a block is skipped only
if its bound is below the score that a place in the result needs; the documents of the other blocks are scored exactly.

The score that a place needs is the ``top``-th best exact score of first documents, met in the rarest lists of every
shard. A list is clustered and opened only where a document without the rarer terms could still reach it, as told by
the greatest impacts of the shard's remaining lists. Both only save work: no document above the bar lies elsewhere.

Scale: texts are read once for each block of items (``block_chars`` of item text; one for most benchmarks), and never
shuffled; shuffled are counts of terms, and at most ``top`` rows an item and task. A task holds one shard, of
``shard_docs`` documents or some megabytes of terms. On the driver: the items of a block, and a number for each of their terms.

Edge cases: null or empty texts of either side have no terms; they are in no result and in no count. Rows sharing a doc_id
are documents of their own, equal rows too; a null doc_id comes last among equal scores. Equal items (same item_id and
text) are one. Empty tables give no rows; other columns are ignored. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumisift.llm.text import NO_ID, Batch, batches_of, mix, word_hashes
from lumisift.plans.scratch import Scratch

SCHEMA = "item_id long, rank int, doc_id long, score long"
_FOUND = "item int, item_id long, doc_id long, score long"
_SHARD = "n_docs long, n_terms long, ids binary, sizes binary, ends binary, terms binary, counts binary"
_BLOCKS = "block_list binary, block_ends binary, members binary, summary_ends binary, summary_terms binary, summary_max binary"
_INT = {"ids": np.int64, "sizes": np.int64, "summary_max": np.int64}

_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_IN_TERM = np.zeros(256, bool)
_IN_TERM[48:58] = _IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True


def _terms_of(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """The document and the hash of every term of a batch."""
    inside = np.zeros(len(batch.data) + 2, np.int8)
    inside[1:-1] = _IN_TERM[batch.data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return np.searchsorted(batch.starts, starts, "right") - 1, word_hashes(_fold[batch.data], starts, ends)


class Items:
    """Some items: the sorted hashes of their terms, and for each item its terms (places in that list) and how often it has them."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in rows]
        batch = next(batches_of(pa.array(self.ids, pa.int64()), pa.array([t for _, t in rows], pa.string()), 1 << 62))
        of, hashes = _terms_of(batch)
        self.hashes = np.unique(hashes)
        place = np.searchsorted(self.hashes, hashes)
        self.terms, self.times = [], []
        for k in range(len(rows)):
            t, n = np.unique(place[of == k], return_counts=True)
            self.terms.append(t)
            self.times.append(n.astype(np.int64))


def _shards(docs: DataFrame, items: Items, id_col: str, text_col: str, shard_docs: int, shard_terms: int) -> DataFrame:
    """Forward rows of a shard each; documents without a term of any item are only counted."""
    wanted = items.hashes

    def flush(group: list[tuple], n_docs: int, n_terms: int) -> pa.RecordBatch:
        ids, sizes, lengths, terms, counts = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*group, strict=True)) if group else (np.zeros(0, np.int64),) * 5
        own = {"ids": ids, "sizes": sizes, "ends": np.cumsum(lengths).astype(np.int32), "terms": terms.astype(np.int32), "counts": counts.astype(np.int32)}
        return pa.RecordBatch.from_pydict({"n_docs": [n_docs], "n_terms": [n_terms], **{k: [v.tobytes()] for k, v in own.items()}})

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, n_docs, n_terms, held, postings = [], 0, 0, 0, 0
        for part in parts:
            for batch in batches_of(part.column(0), part.column(1), 2 << 20):
                doc, hashes = _terms_of(batch)
                sizes = np.bincount(doc, minlength=len(batch.ids))
                n_docs, n_terms = n_docs + int((sizes > 0).sum()), n_terms + len(doc)
                at = np.searchsorted(wanted, hashes)
                known = wanted[np.minimum(at, len(wanted) - 1)] == hashes
                pairs, counts = np.unique(doc[known] * len(wanted) + at[known], return_counts=True)
                doc, terms = pairs // len(wanted), pairs % len(wanted)
                lengths = np.bincount(doc, minlength=len(batch.ids))
                kept = lengths > 0
                group.append((batch.ids[kept], sizes[kept], lengths[kept], terms, counts))
                held, postings = held + int(kept.sum()), postings + len(terms)
                if held >= shard_docs or postings >= shard_terms:
                    yield flush(group, n_docs, n_terms)
                    group, n_docs, n_terms, held, postings = [], 0, 0, 0, 0
        if n_docs:
            yield flush(group, n_docs, n_terms)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _SHARD)


def _frequencies(shards: DataFrame, n: int) -> np.ndarray:
    """The number of documents that have each term."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for part in parts:
            for b in part.column(0).to_pylist():
                total += np.bincount(np.frombuffer(b, np.int32), minlength=n)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": has, "n": total[has]})

    out = np.zeros(n, np.int64)
    found = shards.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return out


class Weights:
    """What the score takes from the whole corpus."""

    def __init__(self, frequencies: np.ndarray, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.of_term = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * frequencies + 1))).astype(np.int64)

    def impacts(self, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        m = 100 - 25 + (25 * sizes * self.n_docs) // self.n_terms
        tf = counts.astype(np.int64)
        return self.of_term[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Shard:
    """The documents of a shard by document and by term."""

    def __init__(self, row: dict, weights: Weights):
        get = {k: np.frombuffer(v, _INT.get(k, np.int32)) for k, v in row.items() if isinstance(v, bytes)}
        self.ids, self.terms, self.stored = get["ids"], get["terms"], get
        self.starts = np.concatenate([[0], get["ends"]]).astype(np.int64)
        self.lengths = np.diff(self.starts)
        self.doc = np.repeat(np.arange(len(self.ids)), self.lengths)
        self.impacts = weights.impacts(self.terms, get["counts"], get["sizes"][self.doc])
        order = np.argsort(self.terms, kind="stable")
        self.by_list = self.doc[order]
        self.lists, first = np.unique(self.terms[order], return_index=True)
        self.list_starts = np.append(first, len(order))
        self.greatest = np.maximum.reduceat(self.impacts[order], first) if len(first) else np.zeros(0, np.int64)

    def of_item(self, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of an item in the shard, the rarest first, and the most that each can add."""
        at = np.searchsorted(self.lists, terms)
        here = self.lists[np.minimum(at, len(self.lists) - 1)] == terms if len(self.lists) else np.zeros(len(terms), bool)
        at, most = at[here], self.greatest[at[here]] * times[here]
        order = np.argsort(self.list_starts[at + 1] - self.list_starts[at], kind="stable")
        return at[order], most[order]

    def to_open(self, terms: np.ndarray, times: np.ndarray, bar: int) -> np.ndarray:
        """The lists without which no document of the shard reaches the bar."""
        at, most = self.of_item(terms, times)
        return at[np.cumsum(most[::-1])[::-1] >= bar]

    def members(self, at: int) -> np.ndarray:
        return self.by_list[self.list_starts[at] : self.list_starts[at + 1]]

    def postings_of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all postings of some documents, and which of them each belongs to."""
        n = self.lengths[docs]
        which = np.repeat(np.arange(len(docs)), n)
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[docs], n), which

    def best(self, docs: np.ndarray, times: np.ndarray, bar: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Of some documents the ids and exact scores of the ``top`` best at or above the bar; ``times`` is over all terms."""
        at, which = self.postings_of(docs)
        scores = np.zeros(len(docs), np.int64)
        np.add.at(scores, which, self.impacts[at] * times[self.terms[at]])
        ids, keep = self.ids[docs], np.flatnonzero(scores >= bar)
        keep = keep[np.lexsort((ids[keep], -scores[keep]))[:top]]
        return ids[keep], scores[keep]

    def sketches(self) -> np.ndarray:
        """Signed projections of the documents' impact vectors, of length one."""
        bits = np.unpackbits(mix(self.lists.astype(np.uint64) + np.uint64(1)).view(np.uint8).reshape(-1, 8), axis=1)
        signs = (bits.astype(np.float32) * 2 - 1)[np.searchsorted(self.lists, self.terms)]
        out = np.add.reduceat(signs * self.impacts.astype(np.float32)[:, None], self.starts[:-1]) if len(self.ids) else np.zeros((0, 64), np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _rows(part: pa.RecordBatch, weights: Weights) -> Iterator[Shard]:
    for row in part.to_pylist():
        yield Shard(row, weights)


def _answers(items: Items, found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    item = np.repeat([k for k, _, _ in found], [len(s) for _, s, _ in found]).astype(np.int32) if found else np.zeros(0, np.int32)
    ids = np.concatenate([i for _, i, _ in found]) if found else np.zeros(0, np.int64)
    scores = np.concatenate([s for _, _, s in found]) if found else np.zeros(0, np.int64)
    names = pa.array([items.ids[k] for k in item], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(item), names, pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(scores, pa.int64())], ["item", "item_id", "doc_id", "score"])


def _dense(items: Items, k: int, out: np.ndarray) -> np.ndarray:
    """The item's counts over all terms, in ``out``, which is zero elsewhere."""
    out[items.terms[k]] = items.times[k]
    return out


def _first_documents(items: Items, weights: Weights, top: int):
    """Exact scores of the documents in each item's rarest lists of a shard, until some three times ``top`` are met."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(len(items.hashes), np.int64)
        for part in parts:
            for shard in _rows(part, weights):
                found = []
                for k, terms in enumerate(items.terms):
                    at, _ = shard.of_item(terms, items.times[k])
                    n = np.cumsum(shard.list_starts[at + 1] - shard.list_starts[at])
                    at = at[: np.searchsorted(n, 3 * top) + 1]
                    if len(at):
                        docs = np.unique(np.concatenate([shard.members(a) for a in at]))
                        found.append((k, *shard.best(docs, _dense(items, k, times), 1, top)))
                        times[terms] = 0
                yield _answers(items, found)

    return run


def _blocked(items: Items, weights: Weights, bars: np.ndarray, block: int):
    """Shards with the blocks and summaries of the lists that some item must open in them."""

    columns = [c.split()[0] for c in f"{_SHARD}, {_BLOCKS}".split(", ")]

    def lists_in_blocks(shard: Shard) -> dict[str, np.ndarray]:
        asked: dict[int, list[int]] = {}
        for k, terms in enumerate(items.terms):
            for a in shard.to_open(terms, items.times[k], int(bars[k])).tolist():
                asked.setdefault(a, []).append(k)
        sketches, flag = shard.sketches() if asked else None, np.zeros(len(items.hashes), bool)
        out: dict[str, list] = {"block_list": [], "sizes": [], "members": [], "entries": [], "summary_terms": [], "summary_max": []}
        for a in sorted(asked):
            docs = shard.members(a)
            n = -(-len(docs) // block)
            nearest = np.argmax(sketches[docs] @ sketches[docs[:: -(-len(docs) // n)]].T, axis=1) if n > 1 else np.zeros(len(docs), np.int64)
            order = np.argsort(nearest, kind="stable")
            docs, cell = docs[order], np.unique(nearest[order], return_inverse=True)[1]
            coordinates = np.concatenate([items.terms[k] for k in asked[a]])
            flag[coordinates] = True
            at, which = shard.postings_of(docs)
            at, which = at[flag[shard.terms[at]]], which[flag[shard.terms[at]]]
            flag[coordinates] = False
            key = cell[which] * len(flag) + shard.terms[at]
            order = np.argsort(key, kind="stable")
            keys, first = np.unique(key[order], return_index=True)
            out["block_list"].append(np.full(cell[-1] + 1, a, np.int32))
            out["sizes"].append(np.bincount(cell))
            out["members"].append(docs.astype(np.int32))
            out["entries"].append(np.bincount(keys // len(flag), minlength=cell[-1] + 1))
            out["summary_terms"].append((keys % len(flag)).astype(np.int32))
            out["summary_max"].append(np.maximum.reduceat(shard.impacts[at][order], first))
        flat = {k: np.concatenate(v) if v else np.zeros(0, np.int32) for k, v in out.items()}
        ends = {"block_ends": np.cumsum(flat.pop("sizes")).astype(np.int32), "summary_ends": np.cumsum(flat.pop("entries")).astype(np.int32)}
        return flat | ends

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                made = lists_in_blocks(Shard(row, weights))
                row |= {k: v.astype(_INT.get(k, np.int32)).tobytes() for k, v in made.items()}
                yield pa.RecordBatch.from_pydict({k: [row[k]] for k in columns})

    return run


def _searched(items: Items, weights: Weights, bars: np.ndarray, top: int):
    """The ``top`` best documents of each shard and item, from blocks whose summary reaches the bar."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(len(items.hashes), np.int64)
        for part in parts:
            for shard in _rows(part, weights):
                s, found = shard.stored, []
                block_starts, summary_starts = (np.concatenate([[0], s[c]]) for c in ("block_ends", "summary_ends"))
                for k, terms in enumerate(items.terms):
                    lists, docs = shard.to_open(terms, items.times[k], int(bars[k])), []
                    _dense(items, k, times)
                    lows, highs = np.searchsorted(s["block_list"], lists), np.searchsorted(s["block_list"], lists, "right")
                    for low, high in zip(lows.tolist(), highs.tolist(), strict=True):
                        a, b = summary_starts[low], summary_starts[high]
                        bound = np.add.reduceat(s["summary_max"][a:b] * times[s["summary_terms"][a:b]], summary_starts[low:high] - a)
                        docs += [s["members"][block_starts[x] : block_starts[x + 1]] for x in np.flatnonzero(bound >= bars[k]) + low]
                    if docs:
                        found.append((k, *shard.best(np.unique(np.concatenate(docs)), times, int(bars[k]), top)))
                    times[terms] = 0
                yield _answers(items, found)

    return run


def _ranked(found: DataFrame, top: int) -> DataFrame:
    by = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)


def _search_block(spark: SparkSession, docs: DataFrame, items: Items, top: int, id_col: str, text_col: str, shard_docs: int, block: int) -> DataFrame:
    scratch = Scratch(spark, "lexical")
    shards = scratch.table(_shards(docs, items, id_col, text_col, shard_docs, 8 << 20), "shards")
    n_docs, n_terms = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_docs:
        return spark.createDataFrame([], SCHEMA)
    weights = Weights(_frequencies(shards, len(items.hashes)), n_docs, n_terms)
    first = _ranked(shards.mapInArrow(_first_documents(items, weights, top), _FOUND), top).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    bars = np.ones(len(items.ids), np.int64)
    for r in first.where(F.col("n") >= top).collect():  # a row for each item of the block
        bars[r["item"]] = r["least"]
    index = scratch.table(shards.mapInArrow(_blocked(items, weights, bars, block), f"{_SHARD}, {_BLOCKS}"), "index")
    out = scratch.table(_ranked(index.mapInArrow(_searched(items, weights, bars, top), _FOUND), top), "ranked")
    scratch.drop_all_but(out)
    return out.select("item_id", "rank", "doc_id", "score")


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", shard_docs: int = 4096, block: int = 16, block_chars: int = 32 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents of positive score."""
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    chars = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, out = max(1, -(-chars // block_chars)), None
    for k in range(n):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()  # about block_chars of items
        held = Items([(r["item_id"], r["text"]) for r in sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))]) if rows else None
        if held is not None and len(held.hashes):
            found = _search_block(spark, docs, held, top, id_col, text_col, shard_docs, block)
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], SCHEMA) if out is None else out
