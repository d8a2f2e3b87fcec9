"""The corpus pipeline: toxicity, near duplicates, benchmark leaks, personal data and mixing, one after another.

Each stage works on all that its predecessor kept, written as Parquet and read again. All but the last return
the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumisift.llm import decontaminate, hyperminhash, mixing, personal_data, toxicity
from lumisift.plans.scratch import Scratch


#: Allocator settings of Python workers: what a batch has used goes back to the machine, not into the worker's reserve.
_LEAN = {"MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def _small_batches(spark: SparkSession) -> None:
    """Documents go to Python by the thousand at most, also when the caller writes a stage's result: texts may be long."""
    for name, value in _LEAN.items():
        spark.sparkContext.environment.setdefault(name, value)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= 1000:
        spark.conf.set(key, "1000")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5."""
    _small_batches(spark)
    model = toxicity.fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(spark, docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by word 5-shingles at a similarity of 0.8 or more."""
    _small_batches(spark)
    return hyperminhash.without_duplicates(spark, docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    _small_batches(spark)
    return decontaminate.clean_documents(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind."""
    return personal_data.redact(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies and the words taken."""
    return mixing.mixed_documents(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal_data", redact),
    ("mixing", mix),
]

#: SQL cannot express a trained kernel machine, sketches or balanced sampling; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        docs = scratch.table(out, name)
    return docs
