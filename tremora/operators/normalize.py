"""From native columns to validated observations, and the predicates applied to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremora.fixed import Box
from tremora.functions.geo import country_of, in_box
from tremora.functions.magnitude import SCHEMES, to_mw
from tremora.schema import OBS


def sane_depth(depth: Column) -> Column:
    return F.when(depth < 0, F.lit(0.0)).when(depth > 800, F.lit(None).cast("double")).otherwise(depth)


def null_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def valid_position(lat: Column, lon: Column) -> Column:
    return lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)


def to_observations(native: DataFrame, scheme: str = "scordilis") -> DataFrame:
    """Validate ranges, clamp depth, fill Mw and country; columns missing from `native` become NULL."""
    for field in OBS.fields:
        if field.name not in native.columns:
            native = native.withColumn(field.name, F.lit(None).cast(field.dataType))
    for name in ("latitude", "longitude", "depth_km", "magnitude", "mw"):
        native = native.withColumn(name, null_if_nan(F.col(name).cast("double")))
    kept = native.filter(valid_position(F.col("latitude"), F.col("longitude")) & F.col("origin_time").isNotNull())
    converted = to_mw(F.col("magnitude"), F.col("magnitude_type"), scheme)
    given = F.col("mw").isNotNull()
    return (
        kept.withColumn("_c", converted)
        .withColumn("depth_km", sane_depth(F.col("depth_km")))
        .withColumn("mw_method", F.when(given, F.col("mw_method")).otherwise(F.col("_c.method")))
        .withColumn("mw", F.coalesce("mw", "_c.mw"))
        .withColumn("country", F.coalesce("country", country_of(F.col("latitude"), F.col("longitude"))))
        .drop("_c")
    )


def fan_out_schemes(events: DataFrame, mag: str = "preferred_mag", kind: str = "preferred_mag_type") -> DataFrame:
    """One row per typed event and conversion scheme, with the Mw that scheme gives."""
    options = [F.struct(F.lit(s).alias("scheme"), to_mw(F.col(mag), F.col(kind), s)["mw"].alias("mw")) for s in SCHEMES]
    typed = events.filter(F.col(mag).isNotNull() & F.col(kind).isNotNull())
    return typed.select("*", F.inline(F.array(*options))).filter("mw IS NOT NULL")


def within(events: DataFrame, start_us: int, end_us: int, box: Box | None = None, min_mag: float | None = None,
           mag: str = "magnitude") -> DataFrame:
    """Closed time window, closed box and minimum magnitude; an unknown magnitude counts as -99."""
    kept = events.filter(F.col("t_us").between(start_us, end_us))
    if box is not None:
        kept = kept.filter(in_box(F.col("latitude"), F.col("longitude"), box))
    if min_mag is not None:
        kept = kept.filter(F.coalesce(F.col(mag), F.lit(-99.0)) >= min_mag)
    return kept


def moment_typed(kind: Column) -> Column:
    return F.lower(F.coalesce(kind, F.lit(""))).startswith("mw")
