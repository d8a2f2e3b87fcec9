"""Structured Streaming over event files: idempotent logs, dead letters, drift and cadence state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.plans.scratch import Scratch


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(f"{sf_dir}")


def drain(stream: DataFrame, name: str, write, mode: str = "append") -> str:
    """Run ``write(batch, path, epoch)`` over everything that is there; returns the folder it wrote to."""
    root = Scratch(stream.sparkSession, name).root
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, epoch: write(df, f"{root}/out", epoch)).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{root}/out"


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only log with content-addressed ids: a second stream over the same events adds nothing; counts by type."""
    log = Scratch(spark, "eventlog").root

    def insert(df: DataFrame, path: str, epoch: int) -> None:
        held = spark.read.schema("digest string, event_type string").option("ignoreMissingFiles", "true").parquet(log) if epoch or second else spark.createDataFrame([], "digest string, event_type string")
        df.dropDuplicates(["digest"]).join(held.select("digest"), "digest", "left_anti").write.mode("append").parquet(log)

    for second in (False, True):
        ids = events_stream(spark, sf_dir).withColumn("digest", F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props"), 256))
        drain(ids.select("digest", "event_type"), "log", insert)
    return spark.read.parquet(log).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("digest").alias("n_digests"))


def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and summed values of each UTC day and type, closed by a watermark."""
    s = events_stream(spark, sf_dir).withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", "1 hour")
    agg = s.groupBy(F.window("time", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    path = drain(agg, "days", lambda df, path, epoch: df.write.mode("overwrite").parquet(path), "complete")
    return spark.read.parquet(path).select((F.unix_micros("w.start").cast("long") / 86400000000).cast("long").alias("day"), "event_type", "n")


def schema_drift(events: DataFrame, group: str, payload: str, contract: list[str]) -> DataFrame:
    """Events of a stream, by group, whose payload has the contract's fields, and those that drifted from it."""
    want = F.array(*map(F.lit, sorted(contract)))

    def write(df: DataFrame, path: str, epoch: int) -> None:
        drift = ~F.coalesce(F.array_sort(F.json_object_keys(payload)) == want, F.lit(False))
        df.withColumn("drift", drift).groupBy(group).agg(F.count_if(~F.col("drift")).alias("n_match"), F.count_if("drift").alias("n_drift")).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    out = events.sparkSession.read.parquet(drain(events, "drift", write))
    return out.groupBy(group).agg(F.sum("n_match").alias("n_match"), F.sum("n_drift").alias("n_drift"))
