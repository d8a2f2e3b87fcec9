"""Stores that batches are appended to: what is held decides what a batch may add; nothing that is held changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Store:
    """Parquet tables under one folder of the shared storage, each appended to by whole batches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.begun = spark, root, set()

    def read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if name in self.begun else self.spark.createDataFrame([], schema)

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}")
        self.begun.add(name)


SNAPSHOT = "stream string, snapshot_id long, watermark double"


def append_snapshots(store: Store, batch: DataFrame) -> None:
    """Snapshots whose watermark goes on; a retry is no row, one that goes back or reuses a watermark is diverted."""
    held = store.read("snapshots", SNAPSHOT)
    cursor = held.groupBy("stream").agg(F.max("watermark").alias("cursor"))
    new = batch.select("stream", "snapshot_id", "watermark").distinct().join(held.select("stream", "snapshot_id"), ["stream", "snapshot_id"], "left_anti")
    new = new.withColumn("place", F.row_number().over(Window.partitionBy("stream", "watermark").orderBy("snapshot_id"))).join(cursor, "stream", "left")
    why = F.when(F.col("watermark") < F.col("cursor"), "watermark_went_back").when((F.col("watermark") == F.col("cursor")) | (F.col("place") > 1), "watermark_reused")
    judged = new.withColumn("reason", why)
    # the diverted rows first: the accepted ones change what is held
    store.append("diverted", judged.where("reason is not null").select("stream", "snapshot_id", "watermark", "reason"))
    store.append("snapshots", judged.where("reason is null").select("stream", "snapshot_id", "watermark"))


def append_cadence(store: Store, batch: DataFrame) -> None:
    """Values of native identities: a value that is held already adds nothing, another one is kept beside it."""
    held = store.read("cadence", "row_id long, value double")
    store.append("cadence", batch.select("row_id", "value").distinct().join(held, ["row_id", "value"], "left_anti"))


def cadence_view(store: Store) -> DataFrame:
    """One row for each identity: poisoned for good once two batches disagreed."""
    g = store.read("cadence", "row_id long, value double").groupBy("row_id").agg(F.count("*").alias("n_values"), F.min("value").alias("value"))
    return g.select("row_id", (F.col("n_values") > 1).alias("poisoned"), F.when(F.col("n_values") == 1, F.col("value")).alias("value"))
