"""One preferred record per group of linked observations, and audits of the grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.fixed import LARGE_GROUP_OBS, ORIGIN_PRIORITY
from tremora.functions.magnitude import method_rank, source_rank


def canonical_events(linked: DataFrame, priority: Sequence[str] = ORIGIN_PRIORITY) -> DataFrame:
    """Preferred origin and magnitude per canonical_id.

    Origin: best source rank, then known depth, then known Mw. Magnitude: best conversion method, then
    best source rank. Ties go to the earliest observation in (t_us, source, source_event_id).
    """
    place = source_rank(F.col("source"), tuple(priority))
    tie = ("t_us", "source", "source_event_id")
    ranked = linked.select(
        "canonical_id", "source",
        F.struct(
            place.alias("r"), F.col("depth_km").isNull().alias("d"), F.col("mw").isNull().alias("m"), *tie,
            "latitude", "longitude", "depth_km", "country",
        ).alias("origin"),
        F.struct(
            (-method_rank(F.col("mw_method"))).alias("r"), place.alias("s"), *tie, "mw", "magnitude", "magnitude_type",
        ).alias("size"),
    )
    # The rank fields lead each struct, so a plain minimum picks the row; it combines map-side.
    best = ranked.groupBy("canonical_id").agg(
        F.min("origin").alias("o"), F.min("size").alias("s"), F.count(F.lit(1)).alias("n_obs"),
        F.array_sort(F.collect_set("source")).alias("names"),
    )
    return best.select(
        "canonical_id", F.col("o.t_us").alias("t_us"), F.timestamp_micros("o.t_us").alias("origin_time"),
        "o.latitude", "o.longitude", "o.depth_km",
        F.col("s.mw").alias("preferred_mw"), F.col("s.magnitude").alias("preferred_mag"),
        F.col("s.magnitude_type").alias("preferred_mag_type"), F.col("o.source").alias("preferred_source"),
        F.col("s.source").alias("mag_source"), F.size("names").cast("long").alias("n_sources"), "n_obs",
        "o.country", F.concat_ws(",", "names").alias("sources"),
    )


def preferred_members(linked: DataFrame, events: DataFrame, priority: Sequence[str] = ORIGIN_PRIORITY) -> DataFrame:
    """Bridge rows (canonical_id, source, source_event_id, is_preferred)."""
    place = source_rank(F.col("source"), tuple(priority))
    rank = F.struct(
        place, F.col("depth_km").isNull(), F.col("mw").isNull(), "t_us", "source", "source_event_id"
    )
    ranked = linked.filter("canonical_id IS NOT NULL").withColumn("_rank", rank)
    chosen = ranked.groupBy("canonical_id").agg(F.min("_rank").alias("_best"))
    return (
        ranked.join(events.select("canonical_id"), "canonical_id", "left_semi").join(chosen, "canonical_id")
        .select("canonical_id", "source", "source_event_id", (F.col("_rank") == F.col("_best")).alias("is_preferred"))
        .distinct()
    )


def large_groups(events: DataFrame, limit: int = LARGE_GROUP_OBS) -> DataFrame:
    """How many events absorbed more than `limit` observations, and the largest group."""
    return events.agg(
        F.count_if(F.col("n_obs") > limit).alias("n_large"), F.max("n_obs").alias("max_obs")
    )


def fusion_ratio(linked: DataFrame) -> DataFrame:
    # Ids are dense, so the largest one is the number of events.
    counts = linked.agg(F.count(F.lit(1)).alias("n_observations"), F.max("canonical_id").alias("n_events"))
    share = F.lit(1.0) - F.try_divide(F.col("n_events").cast("double"), F.col("n_observations").cast("double"))
    return counts.withColumn("fusion_pct", F.lit(100.0) * F.coalesce(share, F.lit(0.0)))
