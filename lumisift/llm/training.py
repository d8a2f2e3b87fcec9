"""Labelled rows for the classifiers: a bounded, repeatable sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, limit: int, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, label, *extra) of the rows of at most ``limit`` labelled documents outside the held-out fold, the first in a hash order.

    The ids of the sample are at most ``limit`` numbers, so joining them is a broadcast of bounded size. Of an id's
    labels the greatest counts. Rows may share an id: see ``one_row_an_id``.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.where(fold("id", folds) != held_out).groupBy("id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(limit)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c) for c in extra))
    return source.join(F.broadcast(chosen), "id").select("id", "text", "label", *extra)


def one_row_an_id(rows: DataFrame) -> DataFrame:
    """Of rows that share an id the least by a hash of the row, combined before the shuffle."""
    row = F.struct(*(c for c in rows.columns if c != "id"))
    return rows.groupBy("id").agg(F.min_by(row, F.xxhash64(row)).alias("row")).select(*("id" if c == "id" else f"row.{c}" for c in rows.columns))
