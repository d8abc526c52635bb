"""Connected components by alternating large-star and small-star contraction.

Every round is two hash aggregations and two equi-joins over the edges; vertices only ever carry the
smallest neighbour, so no adjacency list is collected however large a component is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.session import materialize


def _pointed_at_minimum(arcs: DataFrame) -> DataFrame:
    """arcs(u, v) with m = the smallest of u and all its v."""
    smallest = arcs.groupBy("u").agg(F.min("v").alias("_v")).select("u", F.least("u", "_v").alias("m"))
    return arcs.join(smallest, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    pointed = _pointed_at_minimum(both)
    return pointed.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    pointed = _pointed_at_minimum(down)
    # Each down-neighbour points at the minimum, and so does the vertex itself.
    return pointed.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"),
        F.expr("bit_xor(xxhash64(u, v))").alias("h"),
    ).first()
    return row["n"], row["s"], row["h"]


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every vertex of `edges`; component is the smallest vertex id in it."""
    current = materialize(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).filter("u > v").distinct()
    )
    before = _signature(current)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        current = materialize(_small_star(_large_star(current)))
        after = _signature(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
