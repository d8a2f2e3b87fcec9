"""Near-duplicate documents by HyperMinHash.

Sketch: a document's set of word shingles is hashed; the top 8 bits pick one of 256 registers, which keeps the
least remainder in 16 bits, as its count of leading zeros (6 bits) and the 10 bits after the leading one.
Candidates: an empty register borrows from the first filled one in a fixed order of its own, and 42 bands of 6
registers are the bucket keys; a pair at a similarity of 0.8 is missed with odds of 3e-6, one at 0.9 never, and
texts that merely share common words do not meet. (Far larger corpora want 512 registers in bands of 7 or 8.)
Before verification the share of equal registers, less the collisions expected from cutting hashes to 16 bits,
estimates the similarity: likely pairs are verified first, and a pair that they connect needs no more. No pair is left
out for its estimate; every link is confirmed on the full shingle sets.

Groups: equal sets become one representative first. Then every member of a bucket is compared with the bucket's
pivots, its least and greatest documents and one by hash: a linear number of pairs. Confirmed links are contracted.
What can still be missing are links between members of different components, in buckets with two members or more that
are no pivots. They are found exactly: shingles in order of rarity among these documents, and a pair only where the
first few of both share one (a prefix filter with places and size classes), so that near copies which differ too much
make no rows with each other. So each colliding pair is confirmed, refuted or inside one component already.

Edge cases: null, empty or blank texts have no shingles and link with nothing. A text with fewer words than a
shingle has one shingle, its whole sequence. Rows sharing a doc_id are one node, which has the links of all their texts. A null doc_id links with
nothing (component null, kept true). Ties fall to the smaller id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.llm.text import NO_ID, Batch, batches_of, id_list, mix, run_hashes, word_hashes
from lumisift.plans.components import components, star_round
from lumisift.plans.scratch import Scratch

BUCKET_BITS, MANTISSA_BITS = 8, 10
REGISTERS, BANDS, ROWS = 1 << BUCKET_BITS, 42, 6
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_REST = 64 - BUCKET_BITS
_COLLISION = 0.169919487159739  # constant of the expected number of collisions in the published analysis


def shingles(batch: Batch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents, sorted in each, and where each document's begin (one more at the end)."""
    data = _LOWER[batch.data]
    starts, ends, first = batch.words()
    doc = batch.doc_of(first)
    words = word_hashes(data, starts, ends)
    h = run_hashes(words, width)
    at = np.flatnonzero(doc[: len(h)] == doc[width - 1 :]) if len(h) else np.zeros(0, np.int64)
    keys, docs = [h[at]], [doc[at]]
    for short in range(1, width):
        only = np.flatnonzero(np.diff(first) == short)
        if len(only):
            whole = run_hashes(words, short)[first[:-1][only]]
            keys.append(mix(whole + np.uint64(short)))
            docs.append(only)
    key, of = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    key, of = key[new], of[new]
    return key, np.searchsorted(of, np.arange(len(batch.ids) + 1))


def registers(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of 256 registers for each document; 0 is empty."""
    n = len(first) - 1
    out = np.zeros((n, REGISTERS), np.uint16)
    slot = np.repeat(np.arange(n), np.diff(first)) * REGISTERS + (key >> np.uint64(_REST)).astype(np.int64)
    new = np.ones(len(slot), bool)
    new[1:] = slot[1:] != slot[:-1]
    least = (key[new] & np.uint64((1 << _REST) - 1)) | np.uint64(1)
    bits = np.frexp(least.astype(np.float64))[1].astype(np.int64)
    zeros = np.clip(_REST - bits, 0, 62)
    body = (least << (zeros + 1 + BUCKET_BITS).astype(np.uint64)) >> np.uint64(64 - MANTISSA_BITS)
    out.ravel()[slot[new]] = ((zeros + 1) << MANTISSA_BITS) + body.astype(np.int64)
    return out


def _orders() -> np.ndarray:
    at = np.arange(REGISTERS * REGISTERS, dtype=np.uint64)
    return np.argsort(mix(at).reshape(REGISTERS, REGISTERS), axis=1)


def filled(sig: np.ndarray) -> np.ndarray:
    """Registers with each empty one replaced by the first filled one in its own order of all registers."""
    out, orders = sig.copy(), _orders()
    rows, cols = np.nonzero(out == 0)
    for t in range(REGISTERS):
        if not len(rows):
            break
        got = sig[rows, orders[cols, t]]
        out[rows, cols] = got
        rows, cols = rows[got == 0], cols[got == 0]
    return out


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates, and the registers each rests on."""
    used = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1)
    ratio = np.maximum(n, m) / np.maximum(1, np.minimum(n, m))
    chance = _COLLISION * 4 * ratio / (1 + ratio) ** 2 * 2.0 ** (BUCKET_BITS - MANTISSA_BITS)
    return np.maximum(0, same - chance) / np.maximum(1, used), used


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id reachable over confirmed links), kept."""
    return _near_duplicates(Scratch(spark, "hyperminhash"), docs, width, threshold, id_col, text_col)


def _near_duplicates(scratch: Scratch, docs: DataFrame, width: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    per_cent = round(threshold * 100)

    def sketch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for part in parts:
            for b in batches_of(part.column(0), part.column(1), 1 << 19):
                key, first = shingles(b, width)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(key ^ np.uint64(s)))]) for s in (1, 2)]
                digest = [(s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums]
                texts = [codec.compress(b.raw[a : a + s], asbytes=True) for a, s in zip(b.starts.tolist(), b.sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [id_list(b.ids), pa.array(np.diff(first), pa.int64()), pa.array(digest[0]), pa.array(digest[1]), pa.array([r.tobytes() for r in registers(key, first)], pa.binary()), pa.array(b.sizes, pa.int64()), pa.array(texts, pa.binary())],
                    ["doc_id", "n_shingles", "d1", "d2", "sig", "n_bytes", "packed"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = scratch.table(source.mapInArrow(sketch, "doc_id long, n_shingles long, d1 long, d2 long, sig binary, n_bytes long, packed binary"), "rows")
    usable = rows.where("doc_id is not null and n_shingles > 0")
    least = usable.groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "sig")).alias("rep"))
    reps = scratch.table(least.select("d1", "d2", "n_shingles", "rep.doc_id", "rep.sig"), "reps")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            parts_of = filled(sig)[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS // 3, 3).astype(np.uint64)
            halves = parts_of[..., 0] << np.uint64(32) | parts_of[..., 1] << np.uint64(16) | parts_of[..., 2]
            keys = mix(mix(halves[..., 0] ^ mix(np.arange(BANDS, dtype=np.uint64))) + halves[..., 1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], ["band", "doc"])

    # a similarity of the threshold or more between different sets needs more shingles than this
    bands = reps.where(100 * F.col("n_shingles") >= per_cent * (F.col("n_shingles") + 1)).select("doc_id", "sig").mapInArrow(cut, "band long, doc long")
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    members = scratch.table(bands.join(shared.hint("merge"), "band"), "members")
    # the documents that share a bucket, with their full sets: sides that grow with the input are merged by sort
    ids = members.select(F.col("doc").alias("doc_id")).distinct()
    sets = scratch.table(_sets(rows.join(ids.hint("merge"), "doc_id", "left_semi"), width), "sets")

    links = scratch.table(_confirm(_pivot_pairs(members), sets, per_cent).unionByName(_shared_ids(usable, reps)), "links")
    edges = scratch.table(star_round(scratch.table(star_round(links), "star")), "star")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    left = scratch.table(_unsettled(scratch, members, labels), "unsettled")
    more = _prefix_pairs(scratch, left, sets, per_cent)
    links = edges.unionByName(scratch.table(_confirm(more, sets, per_cent), "links"))
    comp = scratch.table(components(links, scratch), "components")
    scratch.drop_all_but(rows, reps, comp)

    found = reps.select("d1", "d2", "n_shingles", F.col("doc_id").alias("rep")).join(comp, F.col("rep") == comp.node, "left")
    found = found.select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n_shingles", "d1", "d2").join(found, ["d1", "d2", "n_shingles"], "left")
    id_ = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", id_.alias("component_id"), F.coalesce(F.col("doc_id") == id_, F.lit(True)).alias("kept"))


def _shared_ids(usable: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges from each id that several texts share to the representatives of these texts."""
    text = F.struct("d1", "d2", "n_shingles")
    several = usable.groupBy("doc_id").agg(F.min(text).alias("lo"), F.max(text).alias("hi")).where("lo <> hi").select("doc_id")
    own = usable.select("doc_id", "d1", "d2", "n_shingles").join(several.hint("merge"), "doc_id", "left_semi").distinct()
    to = own.join(reps.select("d1", "d2", "n_shingles", F.col("doc_id").alias("rep")), ["d1", "d2", "n_shingles"]).where("doc_id <> rep")
    return to.select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b"))


def _pivots() -> Column:
    """Of each bucket: the least document, the greatest, and one by hash."""
    return F.array_distinct(F.array(F.min("doc"), F.max("doc"), F.min_by("doc", F.xxhash64("band", "doc"))))


def _pivot_pairs(members: DataFrame) -> DataFrame:
    """Each member of a bucket with each of the bucket's pivots, a pair once."""
    pivots = members.groupBy("band").agg(_pivots().alias("pivots"))
    pairs = members.join(pivots.hint("merge"), "band").select("doc", F.explode("pivots").alias("pivot")).where("doc <> pivot")
    return pairs.select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b")).distinct()


def _unsettled(scratch: Scratch, members: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc, comp) of the buckets with several components that hold a pair which no pivot is part of."""
    placed = members.join(labels.hint("merge"), F.col("doc") == F.col("node"), "left").select("band", "doc", F.coalesce("component", "doc").alias("comp"))
    placed = scratch.table(placed, "placed")
    apart = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), (F.count("*") - F.size(_pivots())).alias("others"))
    return placed.join(apart.where("lo < hi and others > 1").select("band").hint("merge"), "band").select("doc", "comp").distinct()


def _need(n, m, per_cent: int):
    """Common shingles that two sets of n and m need for the threshold."""
    return -(-per_cent * (n + m) // (100 + per_cent))


_WIDE = np.log(1.05)


def _prefixes(shingle: np.ndarray, per_cent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, sides and places of one set's shingles in order of rarity.

    Two sets with enough in common share one of the first few of each, in any common order; how few depends on both
    sizes. As the smaller of a pair a set gives the fewest, under the class of its size; as the larger one, for every
    class of sizes that can match it, as many as the least size of the class asks.
    """
    n = len(shingle)
    own = int(np.log(n) / _WIDE)
    keys, sides, places = [], [], []

    def give(size_class: int, length: int, larger: bool) -> None:
        keys.append(mix(shingle[:length] + mix(np.array([size_class], np.uint64))))
        sides.append(np.full(length, larger))
        places.append(np.arange(length))

    give(own, n - _need(n, n, per_cent) + 1, False)
    least = -(-per_cent * n // 100)
    for c in range(int(np.log(least) / _WIDE), own + 1):
        give(c, n - _need(n, max(least, int(np.exp(c * _WIDE)) - 1), per_cent) + 1, True)
    return np.concatenate(keys), np.concatenate(sides), np.concatenate(places)


def _prefix_pairs(scratch: Scratch, left: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """All pairs of ``left`` in different components that can be similar enough, by a filter on their rarest shingles.

    A pair comes from a shared shingle of both prefixes whose places leave room for enough common ones. Of a key, most
    documents may be copies of one text: members of its most frequent component are paired with the others alone.
    """

    def exploded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for doc, comp, own, keys in zip(*(part.column(c).to_pylist() for c in ("doc", "comp", "own", "set")), strict=True):
                key = np.frombuffer(keys, np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(key), x, np.int64)) for x in (doc, comp, own)), pa.array(key)], ["doc", "comp", "own", "shingle"])

    # rows that share an id are sets of their own under it
    sized = sets.select("doc", F.xxhash64("set").alias("own"), "set").join(left.hint("merge"), "doc")
    words = scratch.table(sized.mapInArrow(exploded, "doc long, comp long, own long, shingle long"), "shingles")
    often = words.groupBy("shingle").agg(F.count("*").alias("n"))
    ranked = words.join(often.hint("merge"), "shingle").groupBy("doc", "comp", "own").agg(F.collect_list(F.struct("n", "shingle")).alias("ranked"))

    def prefixes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = part.column("ranked")
            n, shingle = (lists.flatten().field(f).to_numpy() for f in ("n", "shingle"))
            edge = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for i, (doc, comp) in enumerate(zip(part.column("doc").to_pylist(), part.column("comp").to_pylist(), strict=True)):
                own = slice(edge[i], edge[i + 1])
                keys, sides, places = _prefixes(shingle[own][np.lexsort((shingle[own], n[own]))].view(np.uint64), per_cent)
                size = edge[i + 1] - edge[i]
                numbers = (np.full(len(keys), x, np.int64) for x in (doc, comp, size))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sides), *map(pa.array, numbers), pa.array(places.astype(np.int64))], ["key", "larger", "doc", "comp", "n", "place"])

    asked = scratch.table(ranked.mapInArrow(prefixes, "key long, larger boolean, doc long, comp long, n long, place long"), "prefixes")
    by_comp = asked.groupBy("key", "comp").agg(F.count("*").alias("k"), F.count_if("larger").alias("larger"))
    main = by_comp.groupBy("key").agg(F.max(F.struct("k", "comp")).alias("m"), F.count("*").alias("comps"), F.sum("larger").alias("larger"), F.sum("k").alias("k"))
    main = main.where("comps > 1 and larger > 0 and larger < k").select("key", F.col("m.comp").alias("main"))
    asked = scratch.table(asked.join(main.hint("merge"), "key"), "shared")
    side = lambda x, which: asked.where(which).select("key", "main", *(F.col(c).alias(f"{c}_{x}") for c in ("doc", "comp", "n", "place")))
    need = F.ceil(per_cent * (F.col("n_a") + F.col("n_b")) / (100 + per_cent) - 1e-9)
    room = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= need
    fits = (F.col("comp_a") != F.col("comp_b")) & (F.col("n_a") <= F.col("n_b")) & (100 * F.col("n_a") >= per_cent * F.col("n_b")) & room
    small, large = side("a", "not larger"), side("b", "larger").drop("main")
    minor = small.where("comp_a <> main").join(large.hint("merge"), "key").where(fits)
    major = small.where("comp_a = main").join(side("b", "larger and comp <> main").drop("main").hint("merge"), "key").where(fits)
    return minor.unionByName(major).select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")).distinct()


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """(doc, n, sig, set): sketches and full shingle sets of some documents, from their stored texts."""

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for part in parts:
            done = 0
            texts = [codec.decompress(t, n, asbytes=True) if n else b"" for t, n in zip(part.column("packed").to_pylist(), part.column("n_bytes").to_pylist(), strict=True)]
            for b in batches_of(part.column("doc_id"), pa.array(texts, pa.binary()), 1 << 19):
                key, first = shingles(b, width)
                whole = pa.array([key[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([id_list(b.ids), part.column("sig").slice(done, len(b.ids)), whole], ["doc", "sig", "set"])
                done += len(b.ids)

    return rows.select("doc_id", "n_bytes", "packed", "sig").mapInArrow(sets, "doc long, sig binary, set binary")


class _Joined:
    """Which documents of one batch are connected."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x


def _confirm(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough, less those that others of a batch connect already.

    The estimate from the sketches orders the work of a batch, likely pairs first; no pair is left out for it.
    """
    side = lambda x: sets.select(F.col("doc").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("set").alias(f"set_{x}")).hint("merge")

    def similar(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            sig = [np.frombuffer(b"".join(part.column(f"sig_{x}").to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in "ab"]
            a, b = ([np.frombuffer(s.as_py(), np.uint64) for s in part.column(f"set_{x}")] for x in "ab")
            n, m = (np.array([len(s) for s in x]) for x in (a, b))
            guess, _ = estimate(*sig, n, m)
            ids, joined, found = [part.column(x).to_pylist() for x in "ab"], _Joined(), []
            for i in np.argsort(-guess, kind="stable").tolist():
                x, y = joined.root(ids[0][i]), joined.root(ids[1][i])
                if x == y or 100 * min(n[i], m[i]) < per_cent * max(n[i], m[i]):
                    continue
                both = len(np.intersect1d(a[i], b[i], assume_unique=True))
                if 100 * both >= per_cent * (n[i] + m[i] - both):
                    joined.up[y] = x
                    found.append(i)
            yield part.select(["a", "b"]).take(pa.array(found, pa.int64()))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(similar, "a long, b long")


def without_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose component has a smaller id; columns unchanged.

    Rows that share a kept id all stay, and so do rows with a null id.
    """
    scratch = Scratch(spark, "duplicates")
    found = _near_duplicates(scratch, docs, width, threshold, id_col, text_col)
    gone = found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    kept_too = found.where("kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone = scratch.table(gone.join(kept_too, "_gone", "left_anti"), "gone")
    scratch.drop_all_but(gone)
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col("_gone"), "left_anti")
