"""Keyed streaming state: cursors that only go on, and dead letters that a later resolution closes.

Both are processors of ``transformWithState``; their state lives in the checkpoint, so a second run over new files goes on
from what the first one left. Rows of a key in a micro-batch are few: snapshots of a stream, arrivals of one payload.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

CURSOR = "stream string, watermark double, snapshot_id long, n_accepted long, n_refused long"


class Cursors(StatefulProcessor):
    """Of each stream the latest watermark and its snapshot; snapshots at or before it are refused, its own retry is no row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cursor", "watermark double, snapshot_id long, n_accepted long, n_refused long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.state.get() if self.state.exists() else None
        mark, snapshot, accepted, refused = held or (None, None, 0, 0)
        for r in sorted(rows, key=lambda r: (r["watermark"], r["snapshot_id"])):
            if mark is None or r["watermark"] > mark:
                mark, snapshot, accepted = r["watermark"], r["snapshot_id"], accepted + 1
            elif r["snapshot_id"] != snapshot:
                refused += 1
        self.state.update((mark, snapshot, accepted, refused))
        yield Row(stream=key[0], watermark=mark, snapshot_id=snapshot, n_accepted=accepted, n_refused=refused)

    def close(self) -> None:
        pass


LETTER = "digest string, stream string, reason string, payload string, arrivals long, status string, resolution string, n_refused long"


class Letters(StatefulProcessor):
    """Of each payload, by digest: why it was refused, how often it came, and the one resolution that closed it.

    A resolution without a letter is kept as unknown; one for a closed letter, or a second one, is refused and counted.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("letter", LETTER.replace("digest string, ", ""))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.state.get() if self.state.exists() else None
        stream, reason, payload, arrivals, status, resolution, refused = held or (None, None, None, 0, "unknown", None, 0)
        for r in sorted(rows, key=lambda r: (r["resolution"] is not None, r["resolution"] or "", r["stream"] or "")):
            if r["resolution"] is None:
                stream, reason, payload = (r["stream"], r["reason"], r["payload"]) if not arrivals else (stream, reason, payload)
                arrivals, status = arrivals + 1, "open" if status == "unknown" else status
            elif status == "open":
                status, resolution = "resolved", r["resolution"]
            else:
                refused += 1
        self.state.update((stream, reason, payload, arrivals, status, resolution, refused))
        yield Row(digest=key[0], stream=stream, reason=reason, payload=payload, arrivals=arrivals, status=status, resolution=resolution, n_refused=refused)

    def close(self) -> None:
        pass


@contextmanager
def _state_store(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(spark: SparkSession, source: str, schema: str, key: str, processor: type[StatefulProcessor], output: str, root: str) -> None:
    """Feed the new files of ``source`` to a processor, by key; its answers go to ``root``/out, its state to ``root``/state."""

    def write(df: DataFrame, epoch: int) -> None:
        df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")  # a repeated epoch replaces itself

    rows = spark.readStream.schema(schema).parquet(source)
    with _state_store(spark):
        answers = rows.groupBy(key).transformWithState(statefulProcessor=processor(), outputStructType=output, outputMode="Update", timeMode="None")
        answers.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, output: str, key: str, root: str) -> DataFrame:
    """The newest answer of each key."""
    names = [c.split()[0] for c in output.split(", ")]
    out = spark.read.schema(f"{output}, epoch long").parquet(f"{root}/out")
    return out.groupBy(key).agg(F.max_by(F.struct(*(n for n in names if n != key)), "epoch").alias("x")).select(*(key if n == key else f"x.{n}" for n in names))
