"""Tables and documents written by the plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremora.fixed import Box

# The stored columns are the contract of the written tables.
OBS_KEY = ("source", "source_event_id")
OBS_UPDATED = ("canonical_id", "mw", "mw_method", "country")
OBS_STORED = (
    "source", "source_event_id", "origin_time", "longitude", "latitude", "depth_km", "magnitude", "magnitude_type",
    "mw", "mw_method", "author", "place", "country", "canonical_id",
)
EVENT_STORED = (
    "canonical_id", "origin_time", "longitude", "latitude", "depth_km", "preferred_mw", "preferred_mag", "preferred_mag_type",
    "preferred_source", "mag_source", "n_sources", "country",
)


def manifest(rows: DataFrame, source: str, batch_id: str, start: str, end: str, box: Box, min_mag: float | None, fetched_at: str) -> DataFrame:
    """One row describing a landed batch, with the whole description as a JSON document."""
    counted = rows.agg(F.count(F.lit(1)).alias("n_events"))
    described = counted.select(
        F.lit(source).alias("source"), F.lit(batch_id).alias("batch_id"), F.lit(start).alias("query_start"), F.lit(end).alias("query_end"),
        F.struct(*[F.lit(float(v)).alias(n) for n, v in box._asdict().items()]).alias("bbox"),
        F.lit(min_mag).cast("double").alias("min_magnitude"), "n_events", F.lit(fetched_at).alias("fetched_at"),
    )
    return described.withColumn("document", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))


def land(rows: DataFrame, path: str) -> None:
    """Land rows under their own source= and batch_id= in one write.

    A batch that is there already is left as it is, so landing again changes nothing. Existing batches are read off the folder names.
    """
    spark = rows.sparkSession
    try:
        held = spark.read.schema("source string, batch_id string").parquet(path).distinct()
        rows = rows.join(held, ["source", "batch_id"], "left_anti")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
    rows.write.mode("append").partitionBy("source", "batch_id").parquet(path)


def append_raw(rows: DataFrame, path: str, source: str, batch_id: str) -> None:
    """Land one batch; a second landing of the same batch has no effect."""
    land(rows.withColumn("source", F.lit(source)).withColumn("batch_id", F.lit(batch_id)), path)


def append_manifest(description: DataFrame, path: str) -> None:
    description.select("source", "batch_id", "document").write.mode("append").partitionBy("source", "batch_id").text(path)


def overwrite(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def with_columns(df: DataFrame, names: Sequence[str], like: DataFrame) -> DataFrame:
    """`names` in order; those missing from `df` are NULL with the type they have in `like`."""
    kinds = dict(like.dtypes)
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names])


def merged(stored: DataFrame, new: DataFrame, key: Sequence[str] = OBS_KEY, updated: Sequence[str] = OBS_UPDATED) -> DataFrame:
    """Upsert as one full outer join: known keys take only `updated` from the new row, NULLs included."""
    columns = stored.columns
    incoming = with_columns(new, columns, stored).select(
        *[F.col(c).alias(c if c in key else f"_new_{c}") for c in columns], F.lit(True).alias("_came")
    )
    held = stored.withColumn("_held", F.lit(True))
    joined = held.join(incoming, list(key), "full_outer")
    pick = []
    for c in columns:
        if c in key:
            pick.append(F.col(c))
            continue
        takes_new = F.col("_came") if c in updated else F.col("_held").isNull()
        pick.append(F.when(takes_new, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
    return joined.select(*pick)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions under `path`, oldest first, on whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    names = [s.getPath().getName() for s in store.listStatus(folder)]
    done = lambda n: store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and done(n))


def publish(df: DataFrame, path: str) -> None:
    """Write `df` as the next version of the table at `path`; readers see it once it is complete, the versions before stay."""
    last = max(_versions(df.sparkSession, path), default=0)
    df.write.mode("overwrite").parquet(f"{path}/v={last + 1}")


def current(spark: SparkSession, path: str) -> DataFrame:
    found = _versions(spark, path)
    if not found:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/v={found[-1]}")


def last_per_key(rows: DataFrame, key: Sequence[str], arrival: str | None) -> DataFrame:
    """One row per key: the last by `arrival`, ties and rows without an arrival by their values."""
    rest = [c for c in rows.columns if c not in key and c != arrival]
    order = F.struct(*([F.col(arrival)] if arrival else []), *rest)
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(new: DataFrame, path: str, key: Sequence[str] = OBS_KEY, updated: Sequence[str] = OBS_UPDATED, arrival: str | None = None) -> None:
    """Merge into the published table at `path` as its next version; of repeated incoming keys the last one counts."""
    stored = current(new.sparkSession, path)
    publish(merged(stored, last_per_key(new, key, arrival), key, updated), path)


def replace_events(events: DataFrame, path: str) -> None:
    overwrite(events.select(*EVENT_STORED), path)


def write_document(document: DataFrame, path: str) -> None:
    """One JSON document per row of a single-column DataFrame."""
    document.write.mode("overwrite").text(path)


def as_document(df: DataFrame, column: str = "value") -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(column))


def run_summary(linked: DataFrame, events: DataFrame, country: str = "Peru") -> DataFrame:
    """(metric, n): observations per source and in total, events, events of the focus country."""
    per_source = linked.groupBy(F.concat(F.lit("source:"), F.col("source")).alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    total = linked.agg(F.count(F.lit(1)).alias("n")).select(F.lit("observations").alias("metric"), "n")
    counted = events.agg(F.count(F.lit(1)).alias("e"), F.count_if(F.col("country") == country).alias("c"))
    named = counted.select(F.inline(F.array(
        F.struct(F.lit("events").alias("metric"), F.col("e").alias("n")),
        F.struct(F.lit(f"events:{country}").alias("metric"), F.col("c").alias("n")),
    )))
    return per_source.unionByName(total).unionByName(named)
