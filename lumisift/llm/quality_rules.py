"""Quality rules with thresholds taken from quantile sketches per language and source.

Four rates are measured on every whole text: symbols for 100 words, repeated lines for 100 lines, words in
repeated 3-word windows for 100 words, and characters for a word. The sketch of a group is a table of counts in
logarithmic bins (each 2 % wide, so quantiles are right to 1 %); two sketches merge by adding their counts, so
Spark builds them with partial sums, and the sketch of a language, or of everything, is the sum of its groups'.
A group of at least ``min_docs`` documents uses its own sketch, a smaller one its language's, then the whole
table's. The fence of a rate is its upper quartile plus ``reach`` times the quartile distance (at least a small
spread, so that constant rates don't reject everything); characters for a word have a lower fence as well.
Thresholds are joined to the documents and a document outside a fence is dropped.

Edge cases: null or empty texts have no words and fail the base rule. Null languages and sources are groups of
their own. Documents that fail the base rule don't enter the sketches. A table where no group passes has no
fences, and nothing but the base rule drops a document. Repeated rows count as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumisift.llm.text import Batch, batches_of, id_list, run_hashes, word_hashes
from lumisift.plans.scratch import Scratch

SYMBOLS = b"#*$%&|<>"
GAMMA = 1.02
#: Least quartile distance of each rate.
RATES = {"symbols": 2.0, "lines": 5.0, "repeats": 5.0, "length": 0.5}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def measure(batch: Batch) -> dict[str, np.ndarray]:
    """The counts of every document of a batch."""
    starts, ends, first = batch.words()
    doc = batch.doc_of(first)
    lead = np.concatenate([[0], np.cumsum((batch.data & 0xC0) != 0x80)])
    chars = np.concatenate([[0], np.cumsum(lead[ends] - lead[starts])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[batch.data])])
    h = run_hashes(word_hashes(batch.data, starts, ends), 3)
    at = np.flatnonzero(doc[: len(h)] == doc[2:]) if len(h) else np.zeros(0, np.int64)
    order = at[np.lexsort((h[at], doc[at]))]
    same = (h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    step = np.zeros(len(starts) + 1, np.int64)
    np.add.at(step, order[again], 1)
    np.add.at(step, order[again] + 3, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(step)[:-1] > 0)])
    lines, repeated = [], []
    for a, s in zip(batch.starts.tolist(), batch.sizes.tolist(), strict=True):
        full = [x for x in batch.raw[a : a + s].split(b"\n") if x.strip(b" \t\n\r\v\f")]
        lines.append(len(full))
        repeated.append(len(full) - len(set(full)))
    return {
        "n_words": np.diff(first),
        "word_chars": np.diff(chars[first]),
        "n_symbols": symbols[batch.starts + batch.sizes] - symbols[batch.starts],
        "n_dup_lines": np.array(repeated, np.int64),
        "n_repeat_words": np.diff(covered[first]),
        "n_lines": np.array(lines, np.int64),
    }


def _rates() -> dict[str, Column]:
    words = F.greatest("n_words", F.lit(1))
    return {
        "symbols": 100e0 * F.col("n_symbols") / words,
        "lines": 100e0 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeats": 100e0 * F.col("n_repeat_words") / words,
        "length": F.col("word_chars") / words.cast("double"),
    }


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rate, bin, n): counts in logarithmic bins; bin null holds zeros."""
    long = rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(k).alias("rate"), F.col(k).alias("v")) for k in RATES))).alias("x")).select(*keys, "x.*")
    slot = F.when(F.col("v") > 0, F.ceil(F.log("v") / F.lit(float(np.log(GAMMA)))))
    return long.groupBy(*keys, "rate", slot.alias("bin")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the sketches that agree in ``keys``."""
    return sketch.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rate, n, q1, q3) from a sketch."""
    whole = Window.partitionBy(*keys, "rate")
    upto = F.sum("n").over(whole.orderBy(F.col("bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    value = F.coalesce(2 * F.pow(F.lit(GAMMA), F.col("bin")) / (1 + GAMMA), F.lit(0e0))
    at = sketch.select(*keys, "rate", value.alias("v"), upto.alias("upto"), F.sum("n").over(whole).alias("total"))
    q = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * p), F.col("v")))
    return at.groupBy(*keys, "rate").agg(F.max("total").alias("n"), q(0.25).alias("q1"), q(0.75).alias("q3"))


def apply_rules(
    spark: SparkSession,
    docs: DataFrame,
    min_docs: int = 50,
    reach: float = 3.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept, and the fence that a dropped document broke."""
    scratch = Scratch(spark, "rules")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            done = 0
            for b in batches_of(part.column(0), part.column(1), 1 << 20):
                n = len(b.ids)
                counts = {k: pa.array(v, pa.int64()) for k, v in measure(b).items()}
                yield pa.RecordBatch.from_arrays([id_list(b.ids), part.column(2).slice(done, n), part.column(3).slice(done, n), *counts.values()], ["doc_id", "lang", "source", *counts])
                done += n

    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), key(lang_col).alias("lang"), key(source_col).alias("source"))
    counted = scratch.table(source.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in (*BASE, "n_lines"))), "counts")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = counted.withColumns(_rates()).withColumn("base_failed", failed)
    own = scratch.table(sketches(rows.where("not base_failed"), ["lang", "source"]), "sketches")
    by_lang = merged(own, ["lang"])
    levels = [(own, ["lang", "source"]), (by_lang, ["lang"]), (merged(by_lang, []), [])]
    groups = own.select("lang", "source", "rate").distinct()
    for i, (sketch, keys) in enumerate(levels):
        q = quartiles(sketch, keys).select(*keys, "rate", *(F.col(c).alias(f"{c}_{i}") for c in ("n", "q1", "q3")))
        groups = groups.join(q, [*keys, "rate"], "left")
    pick = lambda c: F.when(F.col("n_0") >= min_docs, F.col(f"{c}_0")).when(F.col("n_1") >= min_docs, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2"))
    least = F.create_map(*(F.lit(x) for kv in RATES.items() for x in kv))[F.col("rate")]
    spread = F.greatest(pick("q3") - pick("q1"), least)
    fences = groups.select("lang", "source", "rate", (pick("q3") + reach * spread).alias("high"), F.when(F.col("rate") == "length", pick("q1") - reach * spread).alias("low"))
    wide = fences.groupBy("lang", "source").agg(*(F.max(F.when(F.col("rate") == k, F.col(e))).alias(f"{e}_{k}") for k in RATES for e in ("high", "low")))
    out = rows.join(scratch.table(wide, "fences"), ["lang", "source"], "left")
    broken = F.array_compact(F.array(*(F.when((F.col(k) > F.col(f"high_{k}")) | (F.col(k) < F.col(f"low_{k}")), F.lit(k)) for k in RATES)))
    return out.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.size(broken) == 0)).alias("kept"), F.array_join(broken, ",").alias("broken"))
