"""Isotonic regression by parallel pooling; neither points nor blocks meet on the driver or in one task.

Points with the same x are one block. Blocks are numbered along x and cut into windows of a bounded number; a task pools
neighbours of a window that are out of order until none is left. Only the block ends of neighbouring windows are then compared: while
some are out of order, the blocks (by now fewer) are numbered again, windows move by a third, and are pooled again. Pooling in any order
ends in the same blocks. Several regressions, told apart by key columns, are fitted in the same pass.

The fitted map goes through (first x, mean) and (last x, mean) of each block, is linear between them and constant outside.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.operators.ranking import dense_ids, laid_out
from tremora.session import materialize

#: Blocks that a task pools at a time.
WINDOW = 100_000


def _pool(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (window, keys..., low, high, total, weight), sorted by window, keys and low."""
    stack: list[list] = []
    group = None

    def batch(schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*stack), schema)], schema=schema)

    for rows in stream:
        schema = rows.schema
        *names, lows, highs, totals, weights = (c.to_pylist() for c in rows.columns)
        for *key, low, high, total, weight in zip(*names, lows, highs, totals, weights):
            if key != group:
                if stack:
                    yield batch(schema)
                stack, group = [], key
            while stack and stack[-1][-2] * weight >= total * stack[-1][-1]:
                *_, low, _, before, held = stack.pop()
                total, weight = total + before, weight + held
            stack.append([*key, low, high, total, weight])
    if stack:
        yield batch(schema)


def _out_of_order(blocks: DataFrame, keys: Sequence[str]) -> bool:
    """Whether the last block of a window is above the first of the next one; one row per window is compared."""
    end = F.struct(*keys, (F.col("total") / F.col("weight")).alias("mean"))
    place = F.struct(*keys, "low")
    ends = blocks.groupBy("window").agg(F.min_by(end, place).alias("first"), F.max_by(end, place).alias("last"))
    before = ends.withColumn("before", F.lag("last").over(Window.orderBy("window"))).filter("before IS NOT NULL")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"before.{k}").eqNullSafe(F.col(f"first.{k}"))
    return not before.filter(same & (F.col("before.mean") > F.col("first.mean"))).isEmpty()


def fit(points: DataFrame, keys: Sequence[str] = (), x: str = "p", y: str = "y", window: int | None = None) -> DataFrame:
    """Blocks (keys, low, high, total, weight) of the isotonic regression of `y` on `x`, for each value of `keys`.

    Rows without x or y take no part; there are no blocks where no row is left.
    """
    keys, most = list(keys), window or WINDOW
    seen = points.select(*keys, F.col(x).cast("double").alias("low"), F.col(y).cast("double").alias("_y")).filter("low IS NOT NULL AND NOT isnan(low) AND _y IS NOT NULL")
    blocks = materialize(seen.groupBy(*keys, "low").agg(F.sum("_y").alias("total"), F.count(F.lit(1)).cast("double").alias("weight")).withColumn("high", F.col("low")))
    columns, turn = [*keys, "low", "high", "total", "weight"], 0
    while True:
        if blocks.count() <= most:
            numbered, last = blocks.withColumn("window", F.lit(0).cast("long")), True
        else:
            moved = F.col("_no") + F.lit(turn % 3 * (most // 3))
            numbered, last = dense_ids(blocks, [*keys, "low"], "_no").withColumn("window", F.floor(moved / F.lit(most)).cast("long")), False
        dealt = numbered.select("window", *columns).repartition("window").sortWithinPartitions("window", *keys, "low")
        pooled = materialize(dealt.mapInArrow(_pool, dealt.schema))
        if last or not _out_of_order(pooled, keys):
            return pooled.select(*columns)
        blocks, turn = pooled.select(*columns), turn + 1


def knots(blocks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, x, value): the corners of the fitted map."""
    ends = F.when(F.col("low") < F.col("high"), F.array("low", "high")).otherwise(F.array("low"))
    return blocks.select(*keys, F.explode(ends).alias("x"), (F.col("total") / F.col("weight")).alias("value"))


def _between(x: Column, below: Column, above: Column) -> Column:
    span = above["x"] - below["x"]
    inside = F.when(span > 0, below["value"] + (above["value"] - below["value"]) * (x - below["x"]) / span).otherwise(below["value"])
    return F.when(below.isNull(), above["value"]).when(above.isNull(), below["value"]).otherwise(inside)


def interpolated(corners: DataFrame, asked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, x, value) at the distinct `x` of `asked`: linear between corners, constant outside, NULL where a key has none.

    Corners and questions are sorted once into range partitions; what a partition lacks comes from the nearest others, one
    row per partition and key.
    """
    keys = list(keys)
    points = asked.select(*keys, "x").filter("x IS NOT NULL AND NOT isnan(x)").distinct()
    corner = F.struct("x", "value")
    both = corners.select(*keys, "x", corner.alias("corner"), F.lit(False).alias("asked")).unionByName(points.withColumn("corner", F.lit(None)).withColumn("asked", F.lit(True)), allowMissingColumns=True)
    placed = laid_out(both, [*keys, "x"])
    here = Window.partitionBy("_part", *keys).orderBy("_at")
    upto, onward = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(0, Window.unboundedFollowing)
    ends = placed.groupBy("_part", *keys).agg(F.max_by("corner", F.when(F.col("corner").isNotNull(), F.col("_at"))).alias("last"), F.min_by("corner", F.when(F.col("corner").isNotNull(), F.col("_at"))).alias("first"))
    along = Window.partitionBy(*keys).orderBy("_part")
    carried = ends.select(
        F.col("_part").alias("_of"), *[F.col(k).alias(f"_of_{k}") for k in keys],
        F.last("last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    match = F.col("_part") == F.col("_of")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    looked = placed.join(carried, match).select(
        *keys, "x", "asked", F.coalesce(F.last("corner", ignorenulls=True).over(upto), "before").alias("below"),
        F.coalesce(F.first("corner", ignorenulls=True).over(onward), "after").alias("above"),
    )
    return looked.filter("asked").select(*keys, "x", _between(F.col("x"), F.col("below"), F.col("above")).alias("value"))


def apply(blocks: DataFrame, rows: DataFrame, keys: Sequence[str] = (), x: str = "p", out: str = "p_cal") -> DataFrame:
    """`rows` with `out`, the fitted value at `x` within [0, 1]; NULL where x is or where the key has no blocks."""
    keys = list(keys)
    asked = rows.select(*keys, F.col(x).cast("double").alias("x"))
    values = interpolated(knots(blocks, keys), asked, keys)
    renamed = values.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("x").alias("_x"), F.when(F.col("value").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "value"))).alias(out))
    match = F.col(x).cast("double") == F.col("_x")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return rows.join(renamed, match, "left").drop("_x", *[f"_key_{k}" for k in keys])
