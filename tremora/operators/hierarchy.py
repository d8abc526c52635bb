"""Hierarchies of units as nested intervals, and sums over subtrees without a group per level.

A unit is named by its path, such as `department/province/district`. Units sorted by path are numbered 1..N, so every node of the
hierarchy, being a prefix of paths, covers an interval of numbers, and a parent's interval encloses its children's. The sum of a node is the
difference of two running sums at the ends of its interval, whatever its level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.functions.geo import Lattice
from tremora.operators import regions
from tremora.operators.ranking import dense_ids, prefix_sums

TOTAL = ""  # path of the root


def numbered(units: DataFrame, path: str = "region_id") -> DataFrame:
    """`units` with `position`, 1..N in the order of distinct paths."""
    places = dense_ids(units.select(path).distinct(), [path], "position")
    return units.join(places, path)


def nested_intervals(places: DataFrame, path: str = "region_id", separator: str = "/") -> DataFrame:
    """(node, name, parent, level, low, high) from (path, position): every prefix of a path with the numbers it covers.

    Level 0 is the root, which encloses all; a unit of the finest level covers its own number.
    """
    parts = F.split(path, f"\\Q{separator}\\E")
    depths = places.select(path, "position", parts.alias("parts"), F.explode(F.sequence(F.lit(0), F.size(parts))).alias("level"))
    joined = lambda n: F.array_join(F.slice("parts", F.lit(1), n), separator)
    named = depths.select(
        F.when(F.col("level") > 0, joined(F.col("level"))).otherwise(TOTAL).alias("node"), F.col("level").cast("long").alias("level"), "position",
        F.when(F.col("level") > 0, F.get("parts", F.col("level") - 1)).alias("name"), F.when(F.col("level") > 0, joined(F.col("level") - 1)).alias("parent"),
    )
    return named.groupBy("node", "name", "parent", "level").agg(F.min("position").alias("low"), F.max("position").alias("high"))


def subtree_sums(units: DataFrame, values: Sequence[str], path: str = "region_id", separator: str = "/") -> DataFrame:
    """(node, name, parent, level, low, high, n, values...): numbers of units and sums of `values` of every node.

    Several rows of one path count as one unit; a NULL value counts as zero.
    """
    each = units.groupBy(path).agg(*[F.sum(F.coalesce(F.col(v).cast("double"), F.lit(0.0))).alias(v) for v in values])
    placed = numbered(each, path)
    upto = prefix_sums(placed.select("position", *values), [], ["position"], {f"_{v}": v for v in values}).select("position", *[f"_{v}" for v in values])
    nodes = nested_intervals(placed.select(path, "position"), path, separator)
    before = upto.select((F.col("position") + 1).alias("low"), *[F.col(f"_{v}").alias(f"_before_{v}") for v in values])
    ends = nodes.join(upto.withColumnRenamed("position", "high"), "high").join(before, "low", "left")
    sums = [(F.col(f"_{v}") - F.coalesce(f"_before_{v}", F.lit(0.0))).alias(v) for v in values]
    return ends.select("node", "name", "parent", "level", "low", "high", (F.col("high") - F.col("low") + 1).alias("n"), *sums)


def unit_rates(vertices: DataFrame, cells: DataFrame, lattice: Lattice, cutoff: float = 0.08) -> DataFrame:
    """(region_id, cen_lon, cen_lat, area_km2, rate_m5, rate_m6): density of the nearest cell within `cutoff` times the area.

    `cells` comes from `regions.cell_rates` with densities; a unit without a cell that near has rate 0.
    """
    places = regions.shapes(regions.edges_of(vertices)).select("region_id", F.col("cen_lon").alias("lon"), F.col("cen_lat").alias("lat"), "area_km2", F.col("region_id").alias("point_id"))
    dense = regions.nearest_cell_density(places, cells, lattice, cutoff)
    rates = [(F.col(f"density_{m}") * F.col("area_km2")).alias(f"rate_{m}") for m in ("m5", "m6")]
    return dense.select("region_id", F.col("lon").alias("cen_lon"), F.col("lat").alias("cen_lat"), "area_km2", *rates)
