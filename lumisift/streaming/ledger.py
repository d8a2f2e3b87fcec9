"""Versioned tables that batches are published to as a whole, by one rename of a manifest.

A batch is staged as Parquet in a folder of its own and judged there against the commits read so far. Its manifest is
then renamed to the next number in ``commits``, which fails if another writer took that number; the batch is judged
again against what that writer published, and tries the next one. Readers see the folders of the manifests and nothing
else, so a batch that failed half way, or was refused, shows nothing; a batch whose name is published already adds
nothing, so retries are safe. Manifests hold a name and a folder; rows never pass the driver.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Refused(ValueError):
    """A batch that was not published, with its first reasons."""


class Commits:
    """One table: batches of rows of ``schema``, in the order of their commits."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def commits(self) -> list[dict]:
        """Published batches: number, name and folder."""
        path = self._path("commits")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return []
        rows = self.spark.read.schema("batch string, folder string").json(f"{self.root}/commits").select("*", F.col("_metadata.file_name").alias("n"))
        return sorted(({"n": int(r["n"].removesuffix(".json")), "batch": r["batch"], "folder": r["folder"]} for r in rows.collect()), key=lambda c: c["n"])

    def rows(self, upto: list[dict] | None = None) -> DataFrame:
        """The rows of all published batches, with the number of their commit."""
        held = self.commits() if upto is None else upto
        if not held:
            return self.spark.createDataFrame([], f"{self.schema}, commit long")
        table = self.spark.read.schema(self.schema).parquet(*(f"{self.root}/batches/{c['folder']}" for c in held))
        numbers = self.spark.createDataFrame([(c["folder"], c["n"]) for c in held], "_folder string, commit long")
        return table.withColumn("_folder", F.regexp_extract(F.col("_metadata.file_path"), "/batches/([^/]+)/", 1)).join(numbers, "_folder").drop("_folder")

    def refusals(self, batch: DataFrame, held: DataFrame) -> DataFrame:
        """(key, reason) of the rows for which a batch may not be published; none here."""
        return self.spark.createDataFrame([], "key string, reason string")

    def publish(self, name: str, batch: DataFrame) -> bool:
        """Publish a batch as a whole; False if its name is published already. Raises ``Refused`` and leaves nothing."""
        folder = f"{uuid.uuid4().hex}"
        held = self.commits()
        if any(c["batch"] == name for c in held):
            return False
        staged_path = f"{self.root}/batches/{folder}"
        batch.write.parquet(staged_path)
        staged = self.spark.read.schema(self.schema).parquet(staged_path)
        while True:
            found = self.refusals(staged, self.rows(held)).limit(5).collect()
            if found:
                self._delete(f"batches/{folder}")
                raise Refused("; ".join(f"{r['key']}: {r['reason']}" for r in found))
            if self._rename(held[-1]["n"] + 1 if held else 1, {"batch": name, "folder": folder}):
                return True
            held = self.commits()
            if any(c["batch"] == name for c in held):
                self._delete(f"batches/{folder}")
                return False

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _delete(self, name: str) -> None:
        path = self._path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _rename(self, n: int, manifest: dict) -> bool:
        """Write the manifest beside the commits, then rename it to its number; False if that is taken."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        draft, to = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"commits/{n:020d}.json")
        fs = draft.getFileSystem(conf)
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        fs.mkdirs(to.getParent())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(draft, to, options)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(draft, False)
            return False
        return True


CANDIDATE = "candidate string, campaign string, state string, version string, payload string"


class Candidates(Commits):
    """Candidate records: an id belongs to one campaign, a batch has it once, and its newest record is the current one."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root, CANDIDATE)

    def refusals(self, batch: DataFrame, held: DataFrame) -> DataFrame:
        blank = " or ".join(f"{c} is null or trim({c}) = ''" for c in ("candidate", "campaign", "state", "version", "payload"))
        empty = batch.where(blank).select("candidate", F.lit("incomplete").alias("reason"))
        twice = batch.groupBy("candidate").count().where("count > 1").select("candidate", F.lit("twice_in_batch").alias("reason"))
        owner = held.groupBy("candidate").agg(F.min("campaign").alias("owner"))
        other = batch.join(owner, "candidate").where("campaign <> owner").select("candidate", F.lit("other_campaign").alias("reason"))
        return empty.unionByName(twice).unionByName(other).withColumnRenamed("candidate", "key")

    def current(self) -> DataFrame:
        """Per candidate: its newest record, and the commits that it was first and last seen in."""
        newest = lambda c: F.max_by(c, "commit").alias(c)
        return self.rows().groupBy("candidate").agg(newest("campaign"), newest("state"), newest("version"), newest("payload"), F.min("commit").alias("first_seen"), F.max("commit").alias("last_seen"))

    def archive(self) -> DataFrame:
        """Per candidate and version: the record it was first seen with; later ones never replace it."""
        first = lambda c: F.min_by(c, "commit").alias(c)
        return self.rows().groupBy("candidate", "version").agg(first("state"), first("payload"), F.min("commit").alias("commit"))


DECISION = "decision_id string, candidate string, version string, reviewer string, verdict string"


class Decisions(Commits):
    """Decisions on candidate versions, each once."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root, DECISION)

    def refusals(self, batch: DataFrame, held: DataFrame) -> DataFrame:
        again = batch.join(held.select("decision_id").distinct(), "decision_id", "left_semi").select("decision_id", F.lit("held_already").alias("reason"))
        return again.unionByName(batch.groupBy("decision_id").count().where("count > 1").select("decision_id", F.lit("twice_in_batch").alias("reason"))).withColumnRenamed("decision_id", "key")

    def append(self, name: str, new: DataFrame, current: DataFrame) -> DataFrame:
        """Publish the decisions against the exact current version of a known candidate; returns all with their outcome.

        ``name`` makes a retry add nothing. The outcome is judged once, on the view given.
        """
        known = current.select("candidate", F.col("version").alias("_version"))
        why = F.when(F.col("_version").isNull(), "unknown_candidate").when(F.col("_version") != F.col("version"), "stale_version").otherwise("accepted")
        judged = new.join(known, "candidate", "left").select(*(c.split()[0] for c in DECISION.split(", ")), why.alias("outcome"))
        self.publish(name, judged.where("outcome = 'accepted'").drop("outcome"))
        return judged
