"""Toxicity by a support vector machine over a gapped subsequence kernel with Nystroem landmarks.

A text is a bag of pieces: its words in lower case without punctuation inside them, digits read as the letters
they imitate, runs of words of one or two letters joined. The kernel of two pieces counts common subsequences of
three characters, each weighted by decay^(its span) in both, and is normalised; a piece with inserted characters or
gaps keeps most of its subsequences. Spans up to 8 characters count. Landmarks are pieces of the training texts:
the ones that speak most for a toxic label, no two alike, and some common ones. A piece's Nystroem features are its
kernels with the landmarks times the inverse root of the landmarks' own kernel matrix, where a linear machine
(squared hinge) is trained. Labels belong to texts, so training is multiple-instance: a toxic text's most
toxic piece is positive, every piece of the clean texts negative, in rounds; disguised variants of the positives
(inserted characters, doubled or dropped letters) are added as positives.

Insults may share a stem that clean texts hold now and then, so that no single piece tells. Whole texts are therefore
kernel arguments too: the pieces that speak for the label are gathered into groups of like ones, whose centroids are a second
set of landmarks; the kernel of a text with a group sums those of its distinct pieces beyond ``NEAR``. A second machine of
the same kind over these sums, damped, and the largest margin of the pieces gives the text's margin, made a probability by
logistic calibration.

Training takes a sample of ``max_rows`` labelled rows. Spark counts its pieces, makes their features and sums the
Newton steps; texts and pieces' features stay in the tasks, some 66 numbers for each text of the sample come to the driver.
The piece machine is linear in the kernel, so all landmarks fold into one weight for each of the 2^18 subsequences: scoring a
piece is a sum over its subsequences, and kernels with the groups are only made where a bound of all of them reaches
``NEAR``. Every text is scored whole where it is read, without a shuffle.

Edge cases: null and empty texts, and texts without a piece of three letters, get the score of a margin below
all others; long pieces are cut into overlapping windows; without labels of both classes all scores are 0. Rows that
share an id are one training row. Near copies among the training rows count once, for the least id. A null id is
never held out and never trained on. Extra columns are ignored by scoring and kept by ``drop_toxic``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.llm.text import mix
from lumisift.llm.training import fold, labelled_rows, one_row_an_id
from lumisift.plans.scratch import Scratch

DECAY, SPAN, LONGEST = 0.7, 8, 24
NEAR, ALIKE = 0.55, 0.5  # kernels that count for a text, and those that make one group
SHORT = 50  # texts of fewer distinct pieces count as texts of so many
_KEEP = {**{c: c for c in range(97, 123)}, **{c: c + 32 for c in range(65, 91)}}
#: Digits and signs read as letters, for disguised words.
_LIKE = dict(zip(b"013457@", b"oieastb", strict=True)) | {64: 97}
_SPACES = b" \t\n\r\v\f"
_TABLE = bytes(_KEEP.get(c, _LIKE.get(c, c)) for c in range(256))
_DROP = bytes(c for c in range(256) if c not in _KEEP and c not in _LIKE and c not in _SPACES and not 128 <= c < 192)
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)
# Other letters by the low bits of their later bytes, where capitals equal their small letters in Latin and Cyrillic.
_CODE[128:192] = 27 + (np.arange(128, 192) & 31)
BITS = 6
CODES = 1 << 3 * BITS


def pieces(text: bytes) -> list[bytes]:
    """Pieces of a UTF-8 text, in order, repeats included."""
    words = text.translate(_TABLE, _DROP).split()
    out = [w for w in words if 3 <= len(w) <= LONGEST]
    for w in words:
        if len(w) > LONGEST:
            out += [w[i : i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2)]
    run: list[bytes] = []
    for w in [*words, b"..."]:
        if len(w) <= 2:
            run.append(w)
            continue
        if len(run) >= 3:
            whole = b"".join(run)
            out += [whole[i : i + LONGEST] for i in range(0, max(1, len(whole) - LONGEST // 2), LONGEST // 2)]
        run = []
    return [w for w in out if len(w) >= 3]


_triples: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _triples:
        t = np.array([c for c in combinations(range(n), 3) if c[2] - c[0] < SPAN])
        _triples[n] = t, (DECAY ** (t[:, 2] - t[:, 0] + 1)).astype(np.float32)
    return _triples[n]


def subsequences(same_length: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces of one length: subsequence numbers, their weights, and the norm of each piece."""
    n = len(same_length[0])
    codes = _CODE[np.frombuffer(b"".join(same_length), np.uint8)].reshape(-1, n)
    t, w = _places(n)
    u = (codes[:, t[:, 0]] << 2 * BITS) | (codes[:, t[:, 1]] << BITS) | codes[:, t[:, 2]]
    order = np.argsort(u, axis=1)
    s, sw = np.take_along_axis(u, order, 1), w[order]
    total = np.cumsum(sw, 1)
    end = np.ones(s.shape, bool)
    end[:, :-1] = s[:, 1:] != s[:, :-1]
    # the sum of each group is the cumulative sum at its end less that at the end of the group before
    at = np.where(end, total, 0)
    before = np.concatenate([np.zeros((len(s), 1), np.float32), np.maximum.accumulate(at, 1)[:, :-1]], 1)
    return u, w, np.sqrt((np.where(end, total - before, 0) ** 2).sum(1))


def by_length(items: list[bytes], step: int = 2048) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    lens = np.fromiter(map(len, items), np.int64, len(items))
    for n in np.unique(lens):
        at = np.flatnonzero(lens == n)
        for i in range(0, len(at), step):
            yield at[i : i + step], [items[j] for j in at[i : i + step]]


def margins(items: list[bytes], weight: np.ndarray) -> np.ndarray:
    """Weighted subsequences of each piece, over its norm."""
    out = np.zeros(len(items), np.float32)
    for at, some in by_length(items):
        u, w, norm = subsequences(some)
        out[at] = (weight[u] * w).sum(1) / norm
    return out


def sparse(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The subsequence numbers of one piece and their normalised weights."""
    u, w, norm = subsequences([piece])
    number, at = np.unique(u[0], return_inverse=True)
    return number, (np.bincount(at, w) / norm[0]).astype(np.float32)


class Landmarks:
    """Pieces by their subsequences: a row for each subsequence that any of them has, a column for each piece."""

    def __init__(self, items: list[bytes]):
        each = [sparse(p) for p in items]
        self.numbers = np.unique(np.concatenate([u for u, _ in each]))
        self.row = np.zeros(CODES, np.int32)
        self.row[self.numbers] = np.arange(1, len(self.numbers) + 1)
        self.weights = np.zeros((len(self.numbers) + 1, len(items)), np.float32)
        for k, (u, w) in enumerate(each):
            self.weights[self.row[u], k] = w

    def kernels(self, items: list[bytes]) -> np.ndarray:
        """Kernels of pieces with the landmarks."""
        out = np.zeros((len(items), self.weights.shape[1]), np.float32)
        for at, some in by_length(items, 128):
            u, w, norm = subsequences(some)
            out[at] = np.einsum("nt,ntm->nm", w[None, :] / norm[:, None], self.weights[self.row[u]])
        return out

    def groups(self, weight: np.ndarray, most: int) -> np.ndarray:
        """Centroids of like pieces, as columns: leaders by ``weight``, each group widened once around its centroid."""
        kernels, left, found = self.weights.T @ self.weights, np.ones(len(weight), bool), []
        for i in np.argsort(-weight, kind="stable"):
            if left[i]:
                own = left & (kernels[i] >= ALIKE)
                centre = kernels[:, own] @ weight[own] / np.sqrt(weight[own] @ kernels[np.ix_(own, own)] @ weight[own])
                own |= left & (centre >= ALIKE)
                left &= ~own
                found.append((weight[own].sum(), np.where(own, weight, 0)))
        found.sort(key=lambda f: -f[0])
        out = np.stack([self.weights @ w for _, w in found[:most]], 1)
        return (out / np.linalg.norm(out, axis=0)).astype(np.float32)

    def folded(self, coefficients: np.ndarray) -> np.ndarray:
        """One weight for each subsequence, of a sum of kernels with these coefficients."""
        out = np.zeros(CODES, np.float32)
        out[self.numbers] = self.weights[1:] @ coefficients
        return out


def disguised(piece: bytes) -> list[bytes]:
    """Variants with inserted, doubled and dropped characters, or a letter in front or behind."""
    out = [b"a" + piece, piece + b"a"]
    for i in range(1, len(piece)):
        out.append(piece[:i] + b"x" + piece[i:])
        out.append(piece[:i] + piece[i - 1 : i] + piece[i:])
        if len(piece) > 5 and i < len(piece) - 1:
            out.append(piece[:i] + piece[i + 1 :])
    out.append(b"x".join(piece[i : i + 2] for i in range(0, len(piece), 2)))
    return [w for w in out if 3 <= len(w) <= LONGEST]


def _sums(z: np.ndarray, y: float, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What some rows of one label add to a Newton step of the squared-hinge machine: its matrix and its right side."""
    x = np.concatenate([z, np.ones((len(z), 1), np.float32)], 1).astype(np.float64)
    slack = 1 - y * (x @ w)
    on = slack > 0
    c = weight[on, None] * x[on]
    return np.concatenate([c.T @ x[on], (c.T @ (y * slack[on]))[:, None]], 1)


class Model:
    """Subsequence weights and bias of pieces; groups and weights of texts; and the calibration of a text's margin."""

    def __init__(self):
        self.weight, self.bias, self.slope, self.shift = np.zeros(CODES, np.float32), -1.0, 0.0, -30.0
        self.row, self.groups, self.any = np.zeros(CODES, np.int32), np.zeros((1, 0), np.float32), np.zeros(1, np.float32)
        self.text_weight = None

    def gather(self, marks: Landmarks, groups: np.ndarray) -> None:
        self.row, self.groups, self.any = marks.row, groups, groups.max(1)

    def of_pieces(self, items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Margins of pieces, and their kernels with the groups as far as these pass ``NEAR``."""
        margin, near = np.zeros(len(items), np.float32), np.zeros((len(items), self.groups.shape[1]), np.float32)
        for at, some in by_length(items):
            u, w, norm = subsequences(some)
            margin[at] = (self.weight[u] * w).sum(1) / norm
            if self.groups.shape[1]:
                close = np.flatnonzero((self.any[self.row[u]] * w).sum(1) / norm >= NEAR)
                for i in range(0, len(close), 128):
                    c = close[i : i + 128]
                    k = np.einsum("nt,ntg->ng", w[None, :] / norm[c, None], self.groups[self.row[u[c]]])
                    near[at[c]] = np.maximum(0, k - NEAR) / (1 - NEAR)
        return margin, near

    def features(self, texts: list[list[bytes]]) -> np.ndarray:
        """A row for each text: its largest margin, the damped sums over its distinct pieces for each group, and its length."""
        number: dict[bytes, int] = {}
        at = [np.array([number.setdefault(p, len(number)) for p in set(t)], np.int64) for t in texts]
        margin, near = self.of_pieces(list(number))
        margin = margin + self.bias
        hit = near.any(1)
        total = np.array([near[a[hit[a]]].sum(0) if len(a) else np.zeros(near.shape[1]) for a in at]).reshape(len(at), -1)
        best = np.array([margin[a].max() if len(a) else self.bias - 1 for a in at])
        return np.concatenate([best[:, None], np.log1p(3 * total), np.sqrt(np.maximum(0, total - 1.2)), np.log(np.maximum(SHORT, [[len(a)] for a in at]))], 1).astype(np.float64)

    def text_margins(self, features: np.ndarray) -> np.ndarray:
        if self.text_weight is None:
            return features[:, 0]
        return np.concatenate([features, np.ones((len(features), 1))], 1) @ self.text_weight

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        margin = np.where([len(t) > 0 for t in texts], self.text_margins(self.features(texts)), -np.inf)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift if self.slope else np.full(len(texts), self.shift), -30, 30)))


def copy_keys(pieces_of: set[bytes]) -> list[int]:
    """Keys of which near copies share one: any six of eight least hashes."""
    if not pieces_of:
        return []
    h = np.fromiter((zlib.crc32(p) for p in pieces_of), np.uint64, len(pieces_of))
    least = np.array([mix(h ^ s).min() for s in mix(np.arange(8, dtype=np.uint64))])
    keys = np.zeros(len(_SIXES), np.uint64)
    for k in range(6):
        keys = mix(keys ^ least[_SIXES[:, k]] ^ np.arange(len(_SIXES), dtype=np.uint64))
    return keys.view(np.int64).tolist()


_SIXES = np.array(list(combinations(range(8), 6)))


class Trainer:
    """Training over a written table of labelled texts (id, label, pieces, keys), of which the driver sees sums.

    Pieces are counted, made features and summed for Newton steps in tasks. To the driver come the landmarks, one piece
    for each toxic text, matrices of the landmarks' order and the features of each text.
    """

    def __init__(self, scratch: Scratch, texts: DataFrame, n_toxic: int, n_common: int, n_groups: int, cost: float):
        self.scratch, self.cost, self.n_groups, self.spark = scratch, cost, n_groups, texts.sparkSession
        # a copied text would make all its words look like evidence
        keys = texts.select("id", F.explode("keys").alias("key"))
        copies = keys.join(keys.groupBy("key").agg(F.min("id").alias("first")), "key").where("first < id").select("id").distinct()
        self.own = scratch.table(texts.where("size(pieces) > 0").join(copies, "id", "left_anti").select("id", "label", "pieces").coalesce(8), "own")
        self.n = {r["label"]: r["count"] for r in self.own.groupBy("label").count().collect()}
        self.n1, self.n0 = self.n.get(1, 0), self.n.get(0, 0)
        if not self.n1 or not self.n0:
            return
        counted = self.own.select("label", F.explode("pieces").alias("piece")).groupBy("piece").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
        odds = F.col("toxic") / self.n1 * F.log((F.col("toxic") + 0.5) / (self.n1 + 1) * (self.n0 + 1) / (F.col("clean") + 0.5))
        self.counts = scratch.table(counted.withColumn("odds", F.when(F.col("toxic") > 0, odds)).coalesce(8), "counts")
        common = [bytes(r[0]) for r in self.counts.where("clean > 0").orderBy(F.desc("clean"), "piece").select("piece").limit(n_common).collect()]
        self.marks = Landmarks([*self._apart(n_toxic), *common])
        values, vectors = np.linalg.eigh((self.marks.weights.T @ self.marks.weights).astype(np.float64))
        good = values > 1e-6
        self.root = (vectors[:, good] / np.sqrt(values[good])) @ vectors[:, good].T  # inverse root of the landmarks' kernels
        shared = self.spark.sparkContext.broadcast((self.marks, self.root.astype(np.float32)))
        # pieces of toxic texts alone, too often for chance among so many pieces, are positive whatever stands beside them
        distinct = max(2, self.counts.where("toxic > 0").count())
        sure = (F.col("clean") == 0) & (F.col("toxic") * float(np.log((self.n0 + self.n1) / self.n1)) > float(np.log(distinct) + 3))
        taught = self.counts.where((F.col("clean") > 0) | sure).select("piece", F.when(sure, F.sqrt("toxic")).otherwise(-1.0).cast("float").alias("weight"))

        def features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                marks, root = shared.value
                z = marks.kernels(part.column(0).to_pylist()) @ root
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in z], pa.binary()), part.column(1)], ["z", "weight"])

        self.features = scratch.table(taught.mapInArrow(features, "z binary, weight float"), "features")

    def _apart(self, n: int, alike: float = 0.9, block: int = 500) -> list[bytes]:
        """The pieces that speak most for the label, no two of which are alike, from as many blocks as it takes."""
        chosen: list[bytes] = []
        lists: dict[int, list[tuple[int, float]]] = {}
        ranked = self.counts.where("odds > 0").orderBy(F.desc("odds"), "piece").select("piece")
        for begin in count(0, block):
            rows = ranked.offset(begin).limit(block).collect()
            for p in (bytes(r[0]) for r in rows):
                u, w = sparse(p)
                like = [0.0] * len(chosen)
                for a, x in zip(u.tolist(), w.tolist(), strict=True):
                    for k, y in lists.get(a, ()):
                        like[k] += x * y
                if max(like, default=0.0) >= alike:
                    continue
                for a, x in zip(u.tolist(), w.tolist(), strict=True):
                    lists.setdefault(a, []).append((len(chosen), x))
                chosen.append(p)
                if len(chosen) == n:
                    return chosen
            if len(rows) < block:
                return chosen
        return chosen

    def newton(self, w: np.ndarray, z: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The machine over the stored pieces, and the positive ones given, from a start; the last coefficient is the bias."""
        ridge = np.eye(len(w)) / self.cost
        ridge[-1, -1] *= 1e-3
        for _ in range(25):
            shared = self.spark.sparkContext.broadcast(w)

            def stored(parts: Iterator[pa.RecordBatch], at=shared, size=len(w)) -> Iterator[pa.RecordBatch]:
                total = np.zeros((size, size + 1))
                for part in parts:
                    x = np.frombuffer(b"".join(part.column(0).to_pylist()), np.float32).reshape(-1, size - 1)
                    weight = part.column(1).to_numpy()
                    for y in (-1.0, 1.0):
                        own = weight * y > 0
                        total += _sums(x[own], y, np.abs(weight[own]), at.value)
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

            total = _sums(z, 1.0, weight, w)
            for r in self.features.mapInArrow(stored, "sums binary").collect():
                total += np.frombuffer(r[0]).reshape(len(w), -1)
            step = np.linalg.solve(ridge + total[:, :-1], ridge @ w - total[:, -1])
            w = w - step
            if np.abs(step).max() < 1e-3 * max(1.0, np.abs(w).max()):
                break
        return w

    def first_best(self) -> dict[bytes, tuple[int, int]]:
        """The piece of each toxic text that speaks most for the label: how many texts have it as theirs, and its clean texts."""
        each = self.own.where("label = 1").select("id", F.explode("pieces").alias("piece")).join(self.counts, "piece")
        best = each.groupBy("id").agg(F.max(F.struct("odds", "piece", "clean")).alias("b"))
        return self._tally(best.select("b.piece", "b.clean"))

    def next_best(self, model: Model) -> dict[bytes, tuple[int, int]]:
        """The same by the margins of a model."""
        shared = self.spark.sparkContext.broadcast(model)

        def most(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                out = []
                for p in part.column(0).to_pylist():
                    m = margins(p, shared.value.weight)
                    out.append(max(zip(m.tolist(), p, strict=True))[1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["piece"])

        best = self.own.where("label = 1").select("pieces").mapInArrow(most, "piece binary")
        return self._tally(best.join(self.counts.select("piece", "clean"), "piece"))

    def _tally(self, best: DataFrame) -> dict[bytes, tuple[int, int]]:
        return {bytes(r["piece"]): (r["n"], r["clean"]) for r in best.groupBy("piece").agg(F.count("*").alias("n"), F.max("clean").alias("clean")).collect()}

    def not_clean(self, items: list[bytes]) -> list[bytes]:
        """Those that no clean text has."""
        if not items:
            return []
        asked = self.spark.createDataFrame([(bytearray(p),) for p in items], "piece binary")
        held = {bytes(r[0]) for r in self.counts.where("clean > 0").select("piece").join(F.broadcast(asked), "piece", "left_semi").collect()}
        return [p for p in items if p not in held]

    def train(self, rounds: int) -> Model:
        model = Model()
        if not self.n1 or not self.n0:
            return model
        w, best, variants, before = np.zeros(self.root.shape[1] + 1), self.first_best(), [], None
        for _ in range(rounds):
            if best == before:
                break
            positive = {p: n for p, (n, clean) in best.items() if clean == 0}
            seen = sorted(positive)
            variants = self.not_clean(sorted({v for p in seen if positive[p] >= 2 for v in disguised(p)} - set(seen)))
            z = self.marks.kernels([*seen, *variants]) @ self.root.astype(np.float32)
            w = self.newton(w, z, np.concatenate([np.sqrt([positive[p] for p in seen]), np.full(len(variants), 4.0)]))
            model.weight, model.bias = self.marks.folded(self.root @ w[:-1]), float(w[-1])
            before, best = best, self.next_best(model)
        self._group(model)
        self.fit_texts(model, variants)
        return model

    def _group(self, model: Model, most: int = 600) -> None:
        """Groups of the ``most`` pieces that speak most for the label and stand in two toxic texts or more."""
        rows = self.counts.where("odds > 0 and toxic > 1").orderBy(F.desc("odds"), "piece").limit(most).select("piece", "odds").collect()
        if rows:
            marks = Landmarks([bytes(r["piece"]) for r in rows])
            model.gather(marks, marks.groups(np.array([r["odds"] for r in rows], np.float32), self.n_groups))

    def fit_texts(self, model: Model, variants: list[bytes]) -> None:
        """The machine of texts, over the sample and the variants as texts of one piece, and its calibration."""
        shared = self.spark.sparkContext.broadcast(model)

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                x = shared.value.features(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])

        rows = self.own.select("label", "pieces").mapInArrow(run, "label int, x binary").collect()
        own = np.frombuffer(b"".join(r["x"] for r in rows)).reshape(len(rows), -1)
        x = np.concatenate([own, model.features([[v] for v in variants])]) if variants else own
        toxic = np.concatenate([np.array([r["label"] == 1 for r in rows]), np.ones(len(variants), bool)])
        weight = np.concatenate([np.ones(len(own)), np.full(len(variants), 0.2 * self.n1 / max(1, len(variants)))])  # as much as a fifth of the toxic texts
        w, free_sign = np.zeros(x.shape[1] + 1), np.arange(x.shape[1] + 1) >= x.shape[1] - 1  # length and bias; all else speaks for the label or not at all
        ridge = np.diag(np.where(np.arange(len(w)) == len(w) - 1, 1e-3, 1.0))
        for _ in range(50):
            total = sum(_sums(x[toxic == (y > 0)], y, weight[toxic == (y > 0)], w) for y in (-1.0, 1.0))
            slope = ridge @ w - total[:, -1]
            on = np.flatnonzero(free_sign | (w > 0) | (slope < 0))
            new = w.copy()
            new[on] -= np.linalg.solve((ridge + total[:, :-1])[np.ix_(on, on)], slope[on])
            new = np.where(free_sign, new, np.maximum(0, new))
            if np.abs(new - w).max() < 1e-4 * max(1.0, np.abs(w).max()):
                break
            w = new
        model.text_weight = w
        model.slope, model.shift = _calibrate(model.text_margins(x), np.where(toxic, 0.999, 0.001), weight)


def _calibrate(m: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit, by Newton steps halved until the loss falls; the slope is held back a little."""
    x = np.stack([m, np.ones(len(m))], 1)
    hold = np.array([1e-1, 1e-3])

    def loss(b: np.ndarray) -> float:
        t = x @ b
        return float((weight * (np.logaddexp(0, t) - target * t)).sum() + 0.5 * (hold * b * b).sum())

    b = np.array([1.0, 0.0])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        q = weight * np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve(x.T @ (q[:, None] * x) + np.diag(hold), x.T @ (weight * (p - target)) + hold * b)
        size = 1.0
        while loss(b - size * step) > loss(b) and size > 1e-6:
            size /= 2
        b = b - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return float(b[0]), float(b[1])


def _in_groups(part: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch in groups of some megabytes, with each group's first row."""
    group, size, begin = [], 0, 0
    for i, x in enumerate(part.column(column).cast(pa.large_binary())):
        b = x.as_py() or b""
        group.append(b)
        size += len(b)
        if size >= limit:
            yield begin, group
            group, size, begin = [], 0, i + 1
    if group:
        yield begin, group


def fit(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, max_rows: int = 6000,
    n_toxic: int = 72, n_common: int = 24, n_groups: int = 32, rounds: int = 3, cost: float = 10.0, id_col: str = "doc_id", text_col: str = "text",
) -> Model:
    """A model from at most ``max_rows`` labelled documents outside the held-out fold, with at most n_toxic + n_common landmarks and n_groups groups."""

    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for begin, group in _in_groups(part, "text"):
                own = part.slice(begin, len(group))
                sets = [set(pieces(t)) for t in group]
                arrays = [own.column("id"), own.column("label"), pa.array([sorted(x) for x in sets], pa.list_(pa.binary())), pa.array([copy_keys(x) for x in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "label", "pieces", "keys"])

    scratch = Scratch(spark, "toxicity")
    sample = labelled_rows(docs, labels, label, folds, held_out, max_rows, id_col, text_col)
    texts = scratch.table(one_row_an_id(sample.mapInArrow(gather, "id long, label int, pieces array<binary>, keys array<long>")).coalesce(8), "texts")
    model = Trainer(scratch, texts, n_toxic, n_common, n_groups, cost).train(rounds)
    scratch.drop_all_but()
    return model


def score_documents(spark: SparkSession, docs: DataFrame, model: Model, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    shared = spark.sparkContext.broadcast(model)  # some megabytes, whatever the input

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for begin, group in _in_groups(part, "text"):
                own = part.slice(begin, len(group))
                score = shared.value.scores([pieces(t) for t in group])
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("held_out"), pa.array(score, pa.float64())], ["doc_id", "held_out", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out")
    out = source.select("doc_id", held, "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more; columns unchanged, no shuffle."""
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = [np.zeros(0, bool)]
            texts = pa.RecordBatch.from_arrays([part.column(at).cast(pa.string())], ["text"])
            for _, group in _in_groups(texts, "text"):
                keep.append(shared.value.scores([pieces(t) for t in group]) < threshold)
            yield part.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
