"""Cosine nearest neighbours of a stated query set against all vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str, block: int = 2048, provenance: str | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): the k most similar other vectors of each query; ties to the smaller id.

    With ``provenance``, a column, only vectors of the query's own provenance are compared with it.

    Queries go out in blocks of a fixed number; each task multiplies its rows with a block and keeps k rows for
    each query, so what is shuffled is k rows for each query and task, and a window picks the final k.
    """
    spark = vectors.sparkSession
    origin = F.lit("") if provenance is None else F.coalesce(F.concat(F.lit("="), F.col(provenance).cast("string")), F.lit(""))
    columns = [F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"), origin.alias("origin")]
    base = vectors.select(*columns).where("vec is not null")
    parts = max(1, -(-queries.count() // block))
    numbered = queries.select(*columns).where("vec is not null")
    out = spark.createDataFrame([], "query_id long, id long, similarity double")
    for i in range(parts):
        rows = numbered.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i).orderBy("id").collect()
        if not rows:
            continue
        q = np.array([r["vec"] for r in rows], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in rows]), q, np.array([r["origin"] for r in rows])))

        def best(parts_in: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, origins = shared.value
            for part in parts_in:
                if not part.num_rows:
                    continue
                own = part.column(0).to_numpy()
                v = np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                s = np.round(q @ v.T, 12)
                s[(ids[:, None] == own) | (origins[:, None] != np.array(part.column(2).to_pylist()))] = -np.inf
                order = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :k]
                got = np.take_along_axis(s, order, 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, order.shape[1])), pa.array(own[order].ravel()), pa.array(got.ravel())], ["query_id", "id", "similarity"])

        out = out.unionByName(base.mapInArrow(best, "query_id long, id long, similarity double"))
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return out.where("similarity >= -1").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def representation_health(vectors: DataFrame, vec_col: str, least_std: float = 0.05) -> DataFrame:
    """One row: n, mean and least deviation of the features, collapsed share, rms, and the effective rank and its share.

    The second moments are summed in tasks and by row of the matrix in Spark; a matrix of the vectors' length comes to the
    driver. The effective rank is exp of the entropy of the covariance's spectrum.
    """
    spark, schema = vectors.sparkSession, "n long, rank_limit long, mean_std double, least_std double, collapsed double, rms double, effective_rank double, effective_share double"

    def moments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for part in parts:
            if part.num_rows:
                v = np.stack(part.column(0).to_numpy(zero_copy_only=False)).astype(np.float64)
                one = np.concatenate([v, np.ones((len(v), 1))], 1)
                n, total = n + len(v), one.T @ one + (0 if total is None else total)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array([r.tobytes() for r in total], pa.binary())], ["row", "sums"])

    def add(group: pa.Table) -> pa.Table:
        return pa.table({"row": [group.column("row")[0].as_py()], "sums": [sum(np.frombuffer(x) for x in group.column("sums").to_pylist()).tobytes()]})

    rows = vectors.select(F.col(vec_col).cast("array<double>").alias("v")).where("v is not null").mapInArrow(moments, "row long, sums binary").groupBy("row").applyInArrow(add, "row long, sums binary").collect()
    if not rows:
        return spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)], schema)
    total = np.stack([np.frombuffer(r["sums"]) for r in sorted(rows, key=lambda r: r["row"])])
    n, mean, d = total[-1, -1], total[-1, :-1] / total[-1, -1], len(total) - 1
    covariance = total[:-1, :-1] / n - np.outer(mean, mean)
    std, spectrum = np.sqrt(np.maximum(0, np.diag(covariance))), np.maximum(0, np.linalg.eigvalsh((covariance + covariance.T) / 2))
    limit, rank = int(min(d, n - 1)), 0.0
    if limit and spectrum.sum() > 0:
        p = spectrum[spectrum > 0] / spectrum.sum()
        rank = float(np.exp(-(p * np.log(p)).sum()))
    rms = float(np.sqrt(max(0.0, np.trace(total[:-1, :-1]) / (n * d))))
    return spark.createDataFrame([(int(n), limit, float(std.mean()), float(std.min()), float((std < least_std).mean()), rms, rank, min(1.0, rank / limit) if limit else 0.0)], schema)
