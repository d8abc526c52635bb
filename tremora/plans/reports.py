"""JSON documents assembled from the statistics, the forecast and the regional roll-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.fixed import MONTH_NAMES
from tremora.operators import context, forecasting, frequency, regions


def _list_of(df: DataFrame, order: str, name: str) -> DataFrame:
    """All rows of a small report table (bins, decades, top-k) as one ordered array."""
    row = F.struct(F.col(order), *[c for c in df.columns if c != order])
    return df.agg(F.array_sort(F.collect_list(row)).alias(name))


def dashboard_document(events: DataFrame, since_us: int = 946_684_800_000_000, min_decade: int = 100, k: int = 12) -> DataFrame:
    """One row `value`: JSON with the catalog range, distribution curve, completeness and law, decades and largest events."""
    modern = events.filter(F.col("t_us") >= since_us)
    curve = _list_of(frequency.frequency_distribution(modern, "preferred_mw").select("center", "n_cum"), "center", "curve")
    law = frequency.frequency_law(modern, "preferred_mw", method="fit").select(F.struct("mc", "n", "b", "sigma_b", "a").alias("law"))
    dated = events.withColumn("decade", context.decade_of(F.col("t_us")))
    peaks = frequency.completeness_peak(dated, "preferred_mw", ["decade"]).filter(F.col("n") >= min_decade)
    decades = _list_of(peaks, "decade", "mc_by_decade")
    date = F.date_format(context.at(F.col("t_us")), "yyyy-MM-dd")
    top = context.largest_events(events, k).select(
        (-F.col("preferred_mw")).alias("order"), date.alias("date"), F.bround("latitude", 2).alias("lat"), F.bround("longitude", 2).alias("lon"),
        F.bround("preferred_mw", 1).alias("mw"), F.bround("depth_km", 0).alias("depth"),
    )
    largest = _list_of(top, "order", "big_events")
    summary = context.summary(events)
    span = summary.select(F.struct(
        "n_events", F.date_format(context.at(F.col("first_us")), "yyyy-MM-dd").alias("date_min"), F.date_format(context.at(F.col("last_us")), "yyyy-MM-dd").alias("date_max")
    ).alias("meta"))
    parts = span.select(
        "meta", curve.scalar().alias("fmd"), law.scalar().alias("law"), decades.scalar().alias("mc_by_decade"), largest.scalar().alias("big_events")
    )
    return parts.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def context_document(events: DataFrame, recent_us: int, since_us: int = 946_684_800_000_000, focus: str = "Peru") -> DataFrame:
    """One row `value`: JSON with the seasonality tests of the focus country and the neighbour table."""
    local = events.filter((F.col("country") == focus) & (F.col("t_us") >= since_us))
    m5, m6 = (local.filter(F.col("preferred_mw") >= m) for m in (5.0, 6.0))
    monthly = context.monthly_counts(m5)
    counts = monthly.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("month", "n"))), lambda x: x["n"]).alias("counts_m5"),
        F.max_by("name", F.struct("n", -F.col("month"))).alias("top_month"), F.sum("n").alias("n_m5"),
    )
    big = context.largest_events(local, 8, 7.0).select(
        (-F.col("preferred_mw")).alias("order"), "t_us", F.date_format(context.at(F.col("t_us")), "MMM").alias("month")
    )
    p6 = context.periodicity(m6, min_events=5).select("p").scalar()
    since_year = events.agg(context.year_of(F.min("t_us")).alias("y")).scalar()
    document = counts.select(
        F.struct(
            F.array(*[F.lit(m) for m in MONTH_NAMES]).alias("months"), "counts_m5", "n_m5", m6.agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_m6"), "top_month",
            context.chi_square(monthly).select(F.round("chi2", 2)).scalar().alias("chi2"), F.round(context.chi_square_p(monthly).select("p").scalar(), 3).alias("p_chi2"),
            F.round(context.periodicity(m5).select("p").scalar(), 3).alias("schuster_p_m5"), F.round(p6, 3).alias("schuster_p_m6"),
            F.coalesce(p6 < 0.05, F.lit(False)).alias("significant"), _list_of(big, "order", "big").scalar().getField("month").alias("big_months"),
        ).alias("seasonality"),
        F.struct(
            since_year.alias("since_year"), context.year_of(F.lit(recent_us)).alias("recent_year"), _list_of(context.neighbours(events, recent_us), "country", "c").scalar().alias("by_country")
        ).alias("neighbours"),
    )
    return document.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def forecast_document(snapshot: DataFrame, horizon_days: int = 30, mc: float = 4.5, b: float = 1.0) -> DataFrame:
    """One row `value`: JSON describing a forecast snapshot and its ten strongest cells."""
    top = forecasting.top_cells(snapshot).select(
        (-F.col("p_m5_30d")).alias("order"), F.bround("cen_lat", 4).alias("cen_lat"), F.bround("cen_lon", 4).alias("cen_lon"), F.bround("p_m5_30d", 4).alias("p_m5_30d")
    )
    described = snapshot.agg(
        F.date_format(context.at(F.max("t_us")), "yyyy-MM-dd'T'HH:mm:ss").alias("forecast_time"), F.count(F.lit(1)).alias("n_cells"), F.max("p_m5_30d").alias("max_p_m5")
    )
    document = described.select(
        "*", F.lit(horizon_days).alias("horizon_days"), F.lit(mc).alias("mc"), F.lit(b).alias("b_value"), _list_of(top, "order", "t").scalar().alias("top_m5_cells")
    )
    return document.select(F.to_json(F.struct("*")).alias("value"))


def region_documents(units: DataFrame, levels: Sequence[str]) -> DataFrame:
    """One JSON document `value` per administrative unit: names, level, rates, and P and recurrence per horizon.

    `units` is the roll-up of `regions.superpose`; a document holds four horizons, however many units there are.
    """
    keys = [*levels, "level"]
    p = regions.horizon_probabilities(units, keys)
    row = F.struct("days", F.bround("p_m5", 6).alias("p_m5"), F.bround("p_m6", 6).alias("p_m6"))
    packed = p.groupBy(*keys).agg(
        F.array_sort(F.collect_list(row)).alias("horizons"), F.bround(F.max("recur_m5"), 2).alias("recur_m5"), F.bround(F.max("recur_m6"), 1).alias("recur_m6")
    )
    return packed.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
