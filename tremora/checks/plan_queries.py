"""Whole plans: sources to written catalog, and the statistics of what was written."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tremora.checks import sql as S
from tremora.checks.registry import query
from tremora.checks.statistics_queries import _bins
from tremora.operators import frequency
from tremora.plans.catalog_build import build_catalog
from tremora.plans.driver_tables import observations
from tremora.session import scratch_path

_SOURCES = ("usgs", "isc", "igp")


def _built(spark, sf):
    """(run summary, folder) of a catalog built from the three networks' reports; a fourth source is asked for and unknown."""
    seen = observations(spark, sf).withColumn("origin_time", F.timestamp_micros("t_us")).drop("t_us")
    readers = {name: partial(seen.filter, F.col("source") == name) for name in _SOURCES}
    out = scratch_path(spark, "catalog")
    return build_catalog(spark, [*_SOURCES, "emsc"], readers, out, "1960-01-01", "2030-12-31"), out


@query("plan_catalog_build", f"""WITH RECURSIVE {S.events_of_linked()} SELECT 'source:' || source AS metric, count(*) AS n FROM linked GROUP BY 1 UNION ALL SELECT 'observations', count(*) FROM linked
    UNION ALL SELECT 'events', count(*) FROM canon UNION ALL SELECT 'events:Peru', count(*) FROM canon WHERE country = 'Peru' UNION ALL SELECT 'unknown:emsc', 0""")
def _(spark, sf):
    return _built(spark, sf)[0]


@query("plan_law_of_built_catalog", f"WITH RECURSIVE {S.events_of_linked()}, {_bins('canon', 'country')} SELECT country, center, n AS n_bin, c_n::BIGINT AS n_cum FROM suf")
def _(spark, sf):
    events = spark.read.parquet(f"{_built(spark, sf)[1]}/events")
    return frequency.frequency_distribution(events, "preferred_mw", ["country"])


@query("plan_members_of_built_catalog", f"WITH RECURSIVE {S.events_of_linked()} SELECT l.canonical_id, count(*) AS n, min(l.source_event_id) FILTER (l.source = c.preferred_source) AS preferred FROM linked l JOIN canon c USING (canonical_id) GROUP BY 1")
def _(spark, sf):
    members = spark.read.parquet(f"{_built(spark, sf)[1]}/members")
    return members.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("is_preferred"), F.col("source_event_id"))).alias("preferred"))
