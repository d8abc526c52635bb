"""Order-dependent operators that never pull a whole order through one task.

`dense_ids` numbers rows 1..K; `prefix_sums` accumulates along an order; `with_previous` looks one row
back; `exact_quantiles` reads interpolated quantiles off the prefix sums. All of them sort once into range partitions, work inside
each partition in parallel and combine only one small row per partition (and key).

The sorted rows are written to the checkpoint folder before anything is counted, so that partition
sizes and row positions describe the same layout even if a task is retried.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.session import materialize

_RANGE_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def laid_out(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """`df` sorted and written, with `_at` (position) and `_part` (range partition)."""
    placed = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    return placed.withColumn("_part", F.shiftright("_at", _RANGE_BITS))


def dense_ids(df: DataFrame, order: Sequence[Column | str], out: str) -> DataFrame:
    """Add `out` = 1..K following `order`, which must be a total order."""
    placed = laid_out(df, order)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: the only rows that meet in a single task.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.col("_at").bitwiseAND(F.lit((1 << _RANGE_BITS) - 1))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + within + 1)
        .drop("_at", "_part", "_offset")
    )


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """Add inclusive running sums along `order` within `keys`; `sums` maps output to input column.

    Rows that tie in `order` take an arbitrary sequence, so aggregate ties first where that matters, and
    let `order` end in columns that tell rows apart so that no value can crowd one partition.
    """
    placed = laid_out(df, [*keys, *order])
    group = [*keys, "_part"]
    totals = placed.groupBy(*group).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group, *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums]
    )
    inside = Window.partitionBy(*group).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.join(offsets, group)
    running = running.select("*", *[(F.col(f"_o_{o}") + F.sum(c).over(inside)).alias(o) for o, c in sums.items()])
    return running.drop("_at", "_part", *[f"_o_{o}" for o in sums])


def with_previous(df: DataFrame, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Add `out`, the value of the row before in a total order; only one row per partition is compared across."""
    placed = laid_out(df, order)
    inside = Window.partitionBy("_part").orderBy("_at")
    lasts = placed.groupBy("_part").agg(F.max_by(value, "_at").alias("_last"))
    carried = lasts.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_carry"))
    looked = placed.join(F.broadcast(carried), "_part")
    return looked.withColumn(out, F.coalesce(F.lag(value).over(inside), F.col("_carry"))).drop("_at", "_part", "_carry")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], weight: str | None = None
) -> DataFrame:
    """(keys, q, quantile) with linear interpolation between the two neighbouring order statistics.

    `weight` names a column of row multiplicities.
    """
    keys = list(keys)
    counted = df.groupBy(*keys, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
    running = prefix_sums(counted, keys, [value], {"_upto": "_n"})
    total = running.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    asked = F.array(*[F.lit(float(q)) for q in probabilities])
    placed = running.join(total, keys) if keys else running.withColumn("_total", total.scalar())
    rank = lambda q: q * (F.col("_total") - 1).cast("double")
    first, last = F.col("_upto") - F.col("_n"), F.col("_upto") - 1
    # A distinct value answers a probability if it holds the order statistic below or above its rank.
    touched = F.filter(
        asked, lambda q: F.floor(rank(q)).between(first, last) | F.ceil(rank(q)).between(first, last)
    )
    hits = placed.withColumn("q", F.explode(touched))
    low = F.max(F.when(F.floor(rank(F.col("q"))).between(first, last), F.col(value)))
    high = F.max(F.when(F.ceil(rank(F.col("q"))).between(first, last), F.col(value)))
    share = F.max(rank(F.col("q")) - F.floor(rank(F.col("q"))))
    return (
        hits.groupBy(*keys, "q")
        .agg(low.alias("_low"), high.alias("_high"), share.alias("_share"))
        .select(*keys, "q", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share")).alias("quantile"))
    )
