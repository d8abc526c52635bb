"""A catalog derived from the given `events` table, so that every plan has real rows to work on.

Times stretch 30 days to about ten years, users become clusters and event types become magnitude
types. Three networks report: one everything, one the larger events a second later and slightly
shifted, one the western part three seconds later. All arithmetic is integer or double in a fixed
order, so another engine computes identical values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremora.functions.geo import country_of
from tremora.functions.magnitude import to_mw
from tremora.operators.normalize import sane_depth
from tremora.session import configure

_TYPES = "CASE event_type WHEN 'error' THEN 'mww' WHEN 'click' THEN 'mb' WHEN 'purchase' THEN 'Ms' WHEN 'view' THEN 'ML' END"
_LAT = "{a} + CAST((user_id * 7919) % {m} AS DOUBLE) / 100.0D + CAST((event_id * 31) % 41 - 20 AS DOUBLE) / 100.0D"
_LON = "{a} + CAST((user_id * 104729) % {m} AS DOUBLE) / 100.0D + CAST((event_id * 17) % 41 - 20 AS DOUBLE) / 100.0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def reports(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """One row per event as first reported: event_id, t_us, latitude, longitude, depth_raw, magnitude, type."""
    lat = _LAT.format(a="-58.0D", m=7200) if wide else _LAT.format(a="-18.5D", m=1900)
    lon = _LON.format(a="-84.0D", m=2500) if wide else _LON.format(a="-81.5D", m=1350)
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id",
        "946684800000000L + 120L * (unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000L) AS t_us",
        f"{lat} AS latitude", f"{lon} AS longitude",
        "CAST(-5 + (event_id * 37) % 850 AS DOUBLE) AS depth_raw",
        "CAST(40 + CAST(floor(value / 11.513D) AS BIGINT) AS DOUBLE) / 10.0D AS magnitude",
        f"{_TYPES} AS magnitude_type",
    )


def raw_observations(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """The three networks' reports, before normalisation."""
    first = reports(spark, sf_dir, wide)
    network = F.explode(F.expr("""
        filter(array(
            struct('usgs' AS source, 0L AS dt, 0.0D AS dlat, true AS sees),
            struct('isc' AS source, 1000000L AS dt, 0.02D AS dlat, magnitude >= 4.2D AS sees),
            struct('igp' AS source, 3000000L AS dt, -0.02D AS dlat, longitude <= -72.0D AS sees)
        ), n -> n.sees)"""))
    return first.withColumn("n", network).select(
        F.col("n.source").alias("source"), F.concat(F.col("n.source"), F.col("event_id").cast("string")).alias("source_event_id"),
        "event_id", (F.col("t_us") + F.col("n.dt")).alias("t_us"),
        (F.col("latitude") + F.col("n.dlat")).alias("latitude"), "longitude", "depth_raw", "magnitude",
        F.when(F.col("n.source") != "igp", F.col("magnitude_type")).alias("magnitude_type"),
    )


def observations(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """Normalised observations with t_us beside origin_time."""
    raw = raw_observations(spark, sf_dir, wide)
    c = to_mw(F.col("magnitude"), F.col("magnitude_type"))
    return raw.withColumn("_c", c).select(
        "source", "source_event_id", "event_id", "t_us", "latitude", "longitude",
        sane_depth(F.col("depth_raw")).alias("depth_km"), "magnitude", "magnitude_type",
        F.col("_c.mw").alias("mw"), F.col("_c.method").alias("mw_method"),
        country_of(F.col("latitude"), F.col("longitude")).alias("country"),
    )


def catalog(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """Single-network event catalog used by the statistics, feature and experiment plans."""
    first = reports(spark, sf_dir, wide)
    return first.select(
        F.col("event_id").alias("canonical_id"), "t_us", "latitude", "longitude",
        sane_depth(F.col("depth_raw")).alias("depth_km"),
        F.col("magnitude").alias("preferred_mw"), F.col("magnitude").alias("preferred_mag"),
        F.col("magnitude_type").alias("preferred_mag_type"),
        country_of(F.col("latitude"), F.col("longitude")).alias("country"),
    )
