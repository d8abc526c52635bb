"""Catalog summaries, seasonality tests and the neighbour-country table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremora.fixed import MONTH_LENGTHS, MONTH_NAMES, NEIGHBOUR_ORDER, YEAR_DAYS
from tremora.functions.rates import chi_square_tail
from tremora.operators.ranking import with_previous


def at(t_us: Column) -> Column:
    return F.timestamp_micros(t_us)


def year_of(t_us: Column) -> Column:
    return F.year(at(t_us)).cast("long")


def decade_of(t_us: Column) -> Column:
    return F.floor(year_of(t_us) / 10).cast("long") * 10


def summary(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("n_events"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"),
        F.min("preferred_mw").alias("mw_min"), F.max("preferred_mw").alias("mw_max"),
    )


def by_decade(events: DataFrame) -> DataFrame:
    return events.groupBy(decade_of(F.col("t_us")).alias("decade")).agg(F.count(F.lit(1)).alias("n"))


def neighbours(events: DataFrame, recent_us: int) -> DataFrame:
    """Counts of M>=5/6/7, recent M>=5, and the largest event with its date, per listed country."""
    m = F.col("preferred_mw")
    largest = F.max(F.struct("preferred_mw", (-F.col("t_us")).alias("back")))
    table = (
        events.filter(F.col("country").isin(*NEIGHBOUR_ORDER) & m.isNotNull())
        .groupBy("country")
        .agg(
            F.count_if(m >= 5.0).alias("n_m5"), F.count_if(m >= 6.0).alias("n_m6"), F.count_if(m >= 7.0).alias("n_m7"),
            F.count_if((m >= 5.0) & (F.col("t_us") >= recent_us)).alias("recent_m5"), largest.alias("_l"),
        )
    )
    return table.select(
        "country", "n_m5", "n_m6", "n_m7", "recent_m5", F.bround("_l.preferred_mw", 1).alias("max_mw"),
        F.date_format(at(-F.col("_l.back")), "yyyy-MM-dd").alias("max_date"),
    )


def monthly_counts(events: DataFrame) -> DataFrame:
    """(month 1..12, name, n), months without events included."""
    counted = events.groupBy(F.month(at(F.col("t_us"))).cast("long").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    months = events.sparkSession.range(1, 13).withColumnRenamed("id", "month")
    names = F.array(*[F.lit(n) for n in MONTH_NAMES])
    return months.join(counted, "month", "left").select(
        "month", F.element_at(names, F.col("month").cast("int")).alias("name"), F.coalesce("n", F.lit(0)).alias("n")
    )


def chi_square(monthly: DataFrame) -> DataFrame:
    """One row (chi2, df): statistic of the twelve counts against month lengths."""
    share = F.element_at(F.array(*[F.lit(d / sum(MONTH_LENGTHS)) for d in MONTH_LENGTHS]), F.col("month").cast("int"))
    # sum (n - N s)^2 / (N s) = sum n^2 / (N s) - N, because the shares add to one.
    stat = F.try_divide(F.sum(F.col("n") * F.col("n") / share), F.sum("n")) - F.sum("n")
    return monthly.agg(stat.alias("chi2")).select("chi2", F.lit(len(MONTH_LENGTHS) - 1).cast("long").alias("df"))


def chi_square_p(monthly: DataFrame) -> DataFrame:
    """One row (chi2, df, p): the statistic with its upper-tail p-value, NULL without events."""
    return chi_square(monthly).withColumn("p", chi_square_tail(F.col("chi2"), len(MONTH_LENGTHS) - 1))


def periodicity(events: DataFrame, min_events: int = 0) -> DataFrame:
    """Annual periodicity: resultant of day-of-year angles, its p-value and mean length."""
    angle = F.dayofyear(at(F.col("t_us"))).cast("double") * F.lit(2 * math.pi / YEAR_DAYS)
    sums = events.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.cos(angle)).alias("c"), F.sum(F.sin(angle)).alias("s")
    ).filter(F.col("n") > min_events)
    r2 = F.col("c") * F.col("c") + F.col("s") * F.col("s")
    n = F.col("n").cast("double")
    return sums.select("n", F.exp(-F.try_divide(r2, n)).alias("p"), F.try_divide(F.sqrt(r2), n).alias("r_mean"))


def largest_events(events: DataFrame, k: int, min_mag: float | None = None) -> DataFrame:
    """Top k by magnitude; ties go to the earlier event."""
    kept = events if min_mag is None else events.filter(F.col("preferred_mw") >= min_mag)
    return kept.orderBy(F.desc("preferred_mw"), "t_us", "canonical_id").limit(k)


def latest_events(events: DataFrame, min_mag: float = 5.0, k: int = 100) -> DataFrame:
    """The last k events of at least `min_mag`, as served to clients; k up to 2000."""
    if min_mag < 0 or not 0 < k <= 2000:
        raise ValueError("min_mag must be >= 0 and k in 1..2000")
    return (
        events.filter(F.col("preferred_mw") >= min_mag)
        .orderBy(F.desc("t_us"), "canonical_id").limit(k)
    )


def stable_order(events: DataFrame) -> DataFrame:
    return events.orderBy("t_us", "canonical_id")


def gap_groups(events: DataFrame, gap_us: int) -> DataFrame:
    """Time gap to the predecessor and whether it breaks a chain of events closer than `gap_us`."""
    looked = with_previous(events.select("canonical_id", "t_us"), ["t_us", "canonical_id"], "t_us", "_before")
    gap = F.col("t_us") - F.col("_before")
    return looked.select(
        "canonical_id", "t_us", gap.alias("gap_us"), F.coalesce(gap > gap_us, F.lit(True)).alias("starts_chain")
    )
