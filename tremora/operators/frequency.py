"""Frequency-magnitude statistics: distribution, completeness and b-value.

Everything is read off one table of magnitude bins with counts and moments per bin, so the catalog is
aggregated once, map-side, however many cutoffs or methods are then tried. A bin table has about a
hundred rows per group, which is what later windows and arrays hold.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG10_E = math.log10(math.e)


def bin_of(mag: Column, width: float) -> Column:
    """Bin k holds [k*width - width/2, k*width + width/2); rounding keeps 4.3/0.1 from falling short."""
    return F.floor(F.round(mag / F.lit(width), 6) + F.lit(0.5)).cast("long")


def center_of(bin_index: Column, width: float) -> Column:
    return F.round(bin_index * F.lit(width), 5)


def magnitude_bins(events: DataFrame, mag: str, keys: Sequence[str] = (), width: float = 0.1) -> DataFrame:
    m = F.col(mag)
    scaled = F.round(m / F.lit(width), 6)
    return (
        events.filter(m.isNotNull() & ~F.isnan(m))
        .groupBy(*keys, bin_of(m, width).alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum(m).alias("s1"), F.sum(m * m).alias("s2"),
            F.min(F.floor(scaled)).cast("long").alias("low"), F.max(F.ceil(scaled)).cast("long").alias("high"),
        )
    )


def _filled(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bins from floor(min) to ceil(max) per group, absent ones with zero counts."""
    held = F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n", "s1", "s2"))))
    grouped = bins.groupBy(*keys).agg(held.alias("held"), F.min("low").alias("low"), F.max("high").alias("high"))
    spread = grouped.filter("low IS NOT NULL").select(
        *keys, "held", F.explode(F.sequence("low", F.greatest("low", "high"))).alias("bin")
    )
    got = F.try_element_at("held", F.col("bin"))
    return spread.select(
        *keys, "bin", F.coalesce(got["n"], F.lit(0)).alias("n"),
        F.coalesce(got["s1"], F.lit(0.0)).alias("s1"), F.coalesce(got["s2"], F.lit(0.0)).alias("s2"),
    )


def _at_or_above(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)


def frequency_distribution(events: DataFrame, mag: str, keys: Sequence[str] = (), width: float = 0.1) -> DataFrame:
    """(keys, center, n_bin, n_cum) with n_cum = events at or above the bin."""
    filled = _filled(magnitude_bins(events, mag, keys, width), keys)
    return filled.select(
        *keys, center_of(F.col("bin"), width).alias("center"), F.col("n").alias("n_bin"),
        F.sum("n").over(_at_or_above(keys)).alias("n_cum"),
    )


def _fit_columns(cut: Column, width: float) -> dict[str, Column]:
    """b, sigma and a from suffix sums c_n, c_s1, c_s2 at cutoff bin centre `cut`."""
    n = F.col("c_n").cast("double")
    mean = F.try_divide(F.col("c_s1"), n)
    excess = mean - (cut - F.lit(width / 2))
    usable = (F.col("c_n") >= 2) & (excess > 0)
    b = F.when(usable, F.lit(LOG10_E) / F.when(excess > 0, excess))
    squares = F.greatest(F.col("c_s2") - n * mean * mean, F.lit(0.0))
    scatter = F.sqrt(F.try_divide(squares, n * (n - F.lit(1.0))))
    return {
        "b": b,
        "sigma_b": F.when(usable, F.lit(2.30) * b * b * scatter),
        "a": F.when(usable, F.log10(n) + b * cut),
        "mean_mag": mean,
    }


def _suffixes(filled: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    above = _at_or_above(keys)
    sums = filled.select(
        *keys, "bin", "n", center_of(F.col("bin"), width).alias("center"),
        F.sum("n").over(above).alias("c_n"), F.sum("s1").over(above).alias("c_s1"), F.sum("s2").over(above).alias("c_s2"),
    )
    return sums.select("*", *[c.alias(name) for name, c in _fit_columns(F.col("center"), width).items()])


def completeness_peak(
    events: DataFrame, mag: str, keys: Sequence[str] = (), width: float = 0.1, correction: float = 0.2
) -> DataFrame:
    """(keys, n, mc): centre of the fullest bin, the lowest one on ties, plus a correction."""
    bins = magnitude_bins(events, mag, keys, width)
    peak = F.max(F.struct("n", (-F.col("bin")).alias("down")))["down"]
    return bins.groupBy(*keys).agg(F.sum("n").alias("n"), peak.alias("_down")).select(
        *keys, "n", (center_of(-F.col("_down"), width) + F.lit(correction)).alias("mc")
    )


def _goodness(suffixes: DataFrame, keys: Sequence[str], min_events: int) -> DataFrame:
    upward = Window.partitionBy(*keys).orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    observed = suffixes.withColumn("curve", F.collect_list(F.struct("center", "c_n")).over(upward))
    misfit = F.aggregate(
        "curve", F.lit(0.0),
        lambda acc, x: acc + F.abs(x["c_n"] - F.pow(F.lit(10.0), F.col("a") - F.col("b") * x["center"])),
    )
    total = F.aggregate("curve", F.lit(0).cast("long"), lambda acc, x: acc + x["c_n"]).cast("double")
    fit = F.lit(100.0) * (F.lit(1.0) - F.try_divide(misfit, total))
    return observed.withColumn("r", F.when((F.col("c_n") >= min_events) & F.col("b").isNotNull(), fit)).drop("curve")


def completeness_fit(
    events: DataFrame, mag: str, keys: Sequence[str] = (), width: float = 0.1, min_events: int = 25
) -> DataFrame:
    """(keys, mc, r, level, b): the lowest cutoff whose fitted law explains 95 %, else 90 %, else the best."""
    tried = _goodness(_suffixes(_filled(magnitude_bins(events, mag, keys, width), keys), keys, width), keys, min_events)
    return _choose_cutoff(tried, keys)


def _choose_cutoff(tried: DataFrame, keys: Sequence[str]) -> DataFrame:
    row = F.struct("center", "r", "b")
    first = lambda level: F.min(F.when(F.col("r") >= level, row))
    best = F.max(F.when(F.col("r").isNotNull(), F.struct("r", (-F.col("center")).alias("down"), "b")))
    found = tried.groupBy(*keys).agg(first(95.0).alias("f95"), first(90.0).alias("f90"), best.alias("top"))
    fallback = F.struct((-F.col("top.down")).alias("center"), F.col("top.r").alias("r"), F.col("top.b").alias("b"))
    pick = F.coalesce("f95", "f90", F.when(F.col("top").isNotNull(), fallback))
    level = F.when(F.col("f95").isNotNull(), 95).when(F.col("f90").isNotNull(), 90).otherwise(0)
    return found.select(*keys, pick.alias("_p"), level.alias("level")).select(
        *keys, F.col("_p.center").alias("mc"), F.col("_p.r").alias("r"), "level", F.col("_p.b").alias("b")
    )


def b_value(
    events: DataFrame, mag: str, mc: float | str, keys: Sequence[str] = (), width: float = 0.1
) -> DataFrame:
    """(keys, mc, n, b, sigma_b, a, mean_mag) at a given cutoff: a number or a column constant per key."""
    cut = F.col(mc) if isinstance(mc, str) else F.lit(float(mc))
    m = F.col(mag)
    # The guard keeps magnitudes printed to one decimal inside the cutoff's own bin.
    kept = events.filter(m.isNotNull() & (m >= cut - F.lit(width / 2 + 1e-9)))
    grouping = [*keys, mc] if isinstance(mc, str) else list(keys)
    stats = kept.groupBy(*grouping).agg(
        F.count(F.lit(1)).alias("c_n"), F.sum(m).alias("c_s1"), F.sum(m * m).alias("c_s2")
    )
    columns = _fit_columns(cut, width)
    return stats.select(*keys, cut.alias("mc"), F.col("c_n").alias("n"), *[c.alias(k) for k, c in columns.items()])


def frequency_law(
    events: DataFrame, mag: str, keys: Sequence[str] = (), width: float = 0.1, method: str = "peak",
    min_events: int = 25, min_group: int = 0,
) -> DataFrame:
    """Cutoff by `method` ("peak" or "fit", falling back to the peak) and the law above it, in one scan.

    Groups with fewer than `min_group` events are left out.
    """
    suffixes = _suffixes(_filled(magnitude_bins(events, mag, keys, width), keys), keys, width)
    everything = Window.partitionBy(*keys)
    fullest = F.max(F.struct("n", (-F.col("bin")).alias("down"))).over(everything)
    marked = suffixes.withColumn("n_group", F.max("c_n").over(everything)).withColumn(
        "cut", F.lit(round(0.2 / width)).cast("long") - fullest["down"]
    )
    if method == "fit":
        tried = _goodness(marked, keys, min_events)
        at = lambda level: F.min(F.when(F.col("r") >= level, F.col("bin"))).over(everything)
        top = -F.max(F.when(F.col("r").isNotNull(), F.struct("r", (-F.col("bin")).alias("down")))).over(everything)["down"]
        marked = tried.withColumn("_fit", F.coalesce(at(95.0), at(90.0), top)).withColumn("cut", F.coalesce("_fit", "cut"))
    return (
        marked.filter((F.col("bin") == F.col("cut")) & (F.col("n_group") >= min_group))
        .select(*keys, "n_group", F.col("center").alias("mc"), F.col("c_n").alias("n"), "b", "sigma_b", "a", "mean_mag")
    )


def rate_at_least(law: DataFrame, m0: float, years: float, out: str = "rate") -> DataFrame:
    return law.withColumn(out, F.pow(F.lit(10.0), F.col("a") - F.col("b") * F.lit(m0)) / F.lit(years))


def depth_histogram(events: DataFrame, depth: str = "depth_km", width: int = 20, top: int = 680) -> DataFrame:
    """Counts per depth bin; the last bin is closed on both sides and empty bins are listed."""
    d = F.col(depth)
    inside = events.filter(d.between(0.0, float(top)))
    last = top // width - 1
    slot = F.least(F.floor(d / F.lit(float(width))), F.lit(last)).cast("long")
    counted = inside.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    slots = events.sparkSession.range(last + 1).withColumnRenamed("id", "slot")
    return slots.join(counted, "slot", "left").select(
        (F.col("slot") * width).alias("depth_from"), F.coalesce("n", F.lit(0)).alias("n")
    )
