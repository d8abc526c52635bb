"""Polygon collections in GeoJSON as one vertex table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Coordinates stay text until the geometry type says how deep they nest.
COLLECTION = """
    features array<struct<
        properties: struct<NOMBDEP: string, NOMBPROV: string, NOMBDIST: string>,
        geometry: struct<type: string, coordinates: string>>>
"""


def _title(c: Column) -> Column:
    """Capital after anything that is not a letter, as str.title does; initcap only looks at blanks."""
    spaced = F.regexp_replace(F.lower(c), r"([^\p{L}]+)", "$1\u0001")
    return F.regexp_replace(F.regexp_replace(F.initcap(F.regexp_replace(spaced, "\u0001", "\u0001 ")), "\u0001 ", ""), "\u0001", "")


def vertices(documents: DataFrame, column: str = "value") -> DataFrame:
    """(region_id, department, province, ring_id, is_hole, seq, lon, lat) from collection documents.

    The region id joins the names that are present. Ring 0 of a polygon is its outline, later rings are
    holes; features without geometry are skipped.
    """
    features = documents.select(F.from_json(column, COLLECTION).alias("d")).select(F.explode("d.features").alias("f"))
    names = [_title(F.col(f"f.properties.{p}")) for p in ("NOMBDEP", "NOMBPROV", "NOMBDIST")]
    shaped = features.filter("f.geometry.coordinates IS NOT NULL").select(
        F.concat_ws("/", *names).alias("region_id"), names[0].alias("department"), names[1].alias("province"),
        F.when(
            F.col("f.geometry.type") == "MultiPolygon",
            F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"),
        ).otherwise(F.array(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))).alias("polygons"),
    )
    parts = shaped.select("region_id", "department", "province", F.posexplode("polygons").alias("polygon", "rings"))
    rings = parts.select("region_id", "department", "province", "polygon", F.posexplode("rings").alias("ring", "points"))
    return rings.select(
        "region_id", "department", "province", (F.col("polygon") * 100_000 + F.col("ring")).cast("long").alias("ring_id"),
        (F.col("ring") > 0).alias("is_hole"), F.posexplode("points").alias("seq", "xy"),
    ).select("region_id", "department", "province", "ring_id", "is_hole", F.col("seq").cast("long").alias("seq"), F.col("xy")[0].alias("lon"), F.col("xy")[1].alias("lat"))


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    return vertices(spark.read.text(path, wholetext=True))
