"""Files in and out: scans of delimited and JSON exports, names of columns, and sinks that never overwrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumisift.functions import scalars as S
from lumisift.operators import contracts

#: Names under which exports write the canonical columns (fixed values); the canonical name wins.
ALIASES = {
    "source_id": ("oid", "object_id", "objectid"),
    "mjd": ("jd", "time"),
    "band": ("fid", "filter", "filtercode"),
    "magnitude": ("magpsf", "mag"),
    "magnitude_error": ("sigmapsf", "magerr", "mag_err"),
    "ra_deg": ("ra", "meanra"),
    "dec_deg": ("dec", "meandec"),
    "is_detection": ("detected",),
    "limiting_magnitude": ("diffmaglim",),
    "quality": ("catflags",),
}
NUMBERS = ("mjd", "magnitude", "magnitude_error", "ra_deg", "dec_deg", "limiting_magnitude")


def resolve(columns: list[str], explicit: dict[str, str] | None = None) -> dict[str, str]:
    """Canonical name to the column that holds it. Several aliases of one name are an error; ``explicit`` decides."""
    found: dict[str, str] = {}
    for name, others in ALIASES.items():
        if explicit and name in explicit:
            if explicit[name] not in columns:
                raise ValueError(f"no column {explicit[name]!r} for {name!r}")
            found[name] = explicit[name]
            continue
        there = [name] if name in columns else [c for c in columns if c.lower() in others]
        if len(there) > 1:
            raise ValueError(f"several columns for {name!r}: {there}")
        if there:
            found[name] = there[0]
    return found


def scan_text(spark: SparkSession, path: str, columns: list[str], separator: str = ",") -> DataFrame:
    """A delimited export, all columns as text: identifiers keep their zeros, and no pass infers types."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, header=True, sep=separator)


def canonical(raw: DataFrame, survey: str, explicit: dict[str, str] | None = None) -> DataFrame:
    """Canonical measurements of a text scan, with ``problem`` where a row breaks the contract (null if none)."""
    names = resolve(raw.columns, explicit)
    col = lambda n: F.col(names[n]) if n in names else F.lit(None).cast("string")
    read = {n: S.number(col(n)) for n in NUMBERS}
    malformed = [F.when(S.malformed(col(n)), f"malformed {n}") for n in NUMBERS]
    timed = contracts.as_mjd(raw.withColumn("_t", read["mjd"]), "_t")
    detected = S.flag(col("is_detection")) if "is_detection" in names else read["magnitude"].isNotNull()
    problem = F.coalesce(
        F.when(contracts.missing_identifier(col("source_id")), "missing source_id"), *malformed, F.when(F.col("mjd").isNull(), "no usable time"),
        F.when(detected.isNull(), "unrecognised detection value"), F.when(contracts.bad_position(read["ra_deg"], read["dec_deg"]), "position out of range"),
    )
    quality = S.quality(col("quality"), names["quality"]) if "quality" in names else F.lit(True)
    return timed.select(
        S.identifier(col("source_id")).alias("source_id"), F.lit(survey).alias("survey"), S.passband(col("band")).alias("band"), "mjd", *(read[n].alias(n) for n in NUMBERS if n != "mjd"),
        detected.alias("is_detection"), quality.alias("quality"), problem.alias("problem"),
    )


def snapshot_identity(rows: DataFrame, marker: str, sidecar: DataFrame) -> DataFrame:
    """One row for each sidecar row (marker, n_rows): whether the table carries this one marker and so many rows."""
    seen = rows.agg(F.count("*").alias("seen_rows"), F.count_distinct(marker).alias("markers"), F.min(marker).alias("seen_marker"), F.count_if(F.col(marker).isNull()).alias("unmarked"))
    ok = (F.col("markers") == 1) & (F.col("unmarked") == 0) & F.col("seen_marker").rlike("^[0-9a-f]{64}$") & (F.col("seen_marker") == F.col("marker")) & (F.col("seen_rows") == F.col("n_rows"))
    return sidecar.crossJoin(F.broadcast(seen)).select("marker", "seen_rows", "markers", F.coalesce(ok, F.lit(False)).alias("agrees"))


SEQUENCES = "object_id string, cutoff double, times array<double>, values array<double>, flux_unit string"


def sequences(rows: DataFrame, entity: str, time: str, value: str, cutoff: Column) -> DataFrame:
    """One record of arrays in order of time for each entity."""
    both = F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).alias("v"))))
    g = rows.groupBy(F.col(entity).alias("object_id")).agg(both.alias("x"), cutoff.alias("cutoff"))
    return g.select("object_id", "cutoff", F.col("x.t").alias("times"), F.col("x.v").alias("values"), F.lit("mJy").alias("flux_unit"))


def sequence_contract(records: DataFrame) -> DataFrame:
    """One row: records, distinct units, records with a time after the cut-off, and with arrays of unequal length."""
    late = F.exists("times", lambda t: t > F.col("cutoff"))
    return records.agg(F.count("*").alias("n_records"), F.count_distinct("flux_unit").alias("n_contracts"), F.count_if(late).alias("n_late"), F.count_if(F.size("times") != F.size("values")).alias("n_ragged"))


KINDS = (
    ("spectra", ("wavelength", "flux_density", "spectrum")),
    ("photometry", ("magnitude", "mag", "flux", "mjd")),
    ("crossmatch", ("separation", "match_name")),
    ("registry", ("name", "discovery_date")),
    ("classification", ("label", "probability", "class")),
)


def asset_kind(fields: Column) -> Column:
    """Kind of a file by its fields; the first kind that shares one wins."""
    out = F.lit("unknown")
    for kind, names in reversed(KINDS):
        out = F.when(F.arrays_overlap(fields, F.array(*map(F.lit, names))), kind).otherwise(out)
    return out


def publish(rows: DataFrame, path: str, *partitions: str) -> DataFrame:
    """Write a run output once (an existing path is an error) and return what was written."""
    writer = rows.write.mode("errorifexists")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    return rows.sparkSession.read.parquet(path)


def entity_shards(rows: DataFrame, entity: str, channel: str, most: int, groups: int) -> DataFrame:
    """(entity, channels, shard): entities are whole, and a shard has at most ``most`` channels unless one entity alone has more.

    Entities are dealt to hash groups; inside a group they are cut where the running sum passes a multiple of half of
    ``most``, so no group needs another one. ``groups`` should grow with the entities.
    """
    from pyspark.sql import Window

    per = rows.groupBy(F.col(entity).alias("entity")).agg(F.count_distinct(channel).alias("channels"))
    per = per.withColumn("g", F.pmod(F.crc32(F.col("entity").cast("binary")), F.lit(groups)))
    before = F.coalesce(F.sum("channels").over(Window.partitionBy("g").orderBy("entity").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.select("entity", "channels", F.concat_ws("-", "g", F.floor(before / max(1, most // 2)).cast("long")).alias("shard"))


def shard_manifest(shards: DataFrame) -> DataFrame:
    return shards.groupBy("shard").agg(F.count("*").alias("n_entities"), F.sum("channels").alias("n_channels"), F.bit_xor(F.crc32(F.col("entity").cast("binary"))).alias("digest"))


def verify_shards(shards: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per shard of either side whether counts and digests agree; and entities in several shards."""
    split = shards.groupBy("entity").agg(F.count_distinct("shard").alias("n"), F.min("shard").alias("shard")).where("n > 1").groupBy("shard").agg(F.count("*").alias("n_split"))
    seen = shard_manifest(shards).withColumnsRenamed({c: f"seen_{c}" for c in ("n_entities", "n_channels", "digest")})
    j = manifest.join(seen, "shard", "full").join(split, "shard", "left").na.fill(0, ["n_split"])
    same = F.lit(True)
    for c in ("n_entities", "n_channels", "digest"):
        same = same & F.col(c).eqNullSafe(F.col(f"seen_{c}"))
    return j.select("shard", "n_split", (same & (F.col("n_split") == 0)).alias("agrees"))


def merge_shard_results(results: list[DataFrame], contract: str, entity: str) -> DataFrame:
    """One row over several result tables: rows, contracts (must be one) and entities that occur more than once."""
    every = results[0]
    for r in results[1:]:
        every = every.unionByName(r, allowMissingColumns=True)
    per = every.groupBy(entity).agg(F.count("*").alias("n"), F.min(contract).alias("lo"), F.max(contract).alias("hi"))
    ok = (F.min("lo") == F.max("hi")) & (F.max("n") == 1)
    return per.agg(F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 1).alias("n_repeated"), (F.min("lo") == F.max("hi")).alias("one_contract"), ok.alias("mergeable"))


def native_cadence(rows: DataFrame) -> DataFrame:
    """Rows (row_id, mjd, quality_bitmask): one accepted row for each id whose rows agree, else the reason."""
    value = F.struct("mjd", "quality_bitmask")
    g = rows.groupBy("row_id").agg(F.count("*").alias("n"), F.count_distinct(value).alias("values"), F.min("mjd").alias("mjd"), F.count_if(S.finite(F.col("mjd")).isNull()).alias("untimed"))
    reason = F.when(F.col("row_id") < 0, "negative_id").when(F.col("untimed") > 0, "missing_time").when(F.col("values") > 1, "conflict").when(F.col("n") > 1, "duplicate")
    return g.select("row_id", "n", "mjd", F.coalesce(reason, F.lit("accepted")).alias("status"))


def objects_by_recency(batches: list[DataFrame], excluded: DataFrame, limit: int) -> DataFrame:
    """Newest row of each object over several lists without the excluded ones, the ``limit`` most recent (a top-k report)."""
    every = batches[0]
    for b in batches[1:]:
        every = every.unionByName(b, allowMissingColumns=True)
    newest = every.groupBy("oid").agg(F.max(F.struct("lastmjd", "ndet")).alias("x")).select("oid", "x.lastmjd", "x.ndet")
    return newest.join(excluded.select("oid").distinct(), "oid", "left_anti").orderBy(F.desc("lastmjd"), "oid").limit(limit)
