"""The catalog build: read sources, filter, associate, choose preferred records, write tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremora.fixed import STUDY_BOX, Box
from tremora.operators.canonical import canonical_events, preferred_members
from tremora.operators.linkage import LinkRule, associate
from tremora.operators.normalize import within
from tremora.session import configure
from tremora.sinks.tables import overwrite, run_summary
from tremora.sources.landing import landed_sources


def build_catalog(
    spark: SparkSession, wanted: Sequence[str], readers: Mapping[str, Callable[[], DataFrame]], out: str,
    start: str, end: str, box: Box = STUDY_BOX, min_mag: float | None = None, rule: LinkRule = LinkRule(), focus: str = "Peru",
) -> DataFrame:
    """Write `observations`, `events`, `events_focus` and `members` under `out`; return the run summary, sources left out included.

    `start` and `end` are ISO times, both inclusive. Every stage after a write reads the written table,
    so nothing upstream of it is computed twice.
    """
    configure(spark)
    limits = spark.range(1).select(*[F.unix_micros(F.to_timestamp(F.lit(x))).alias(n) for n, x in (("a", start), ("b", end))]).first()
    observed, told = landed_sources(spark, list(wanted), readers)
    kept = within(observed.withColumn("t_us", F.unix_micros("origin_time")), limits["a"], limits["b"], box, min_mag)
    overwrite(associate(kept, rule), f"{out}/observations")
    linked = spark.read.parquet(f"{out}/observations")
    overwrite(canonical_events(linked), f"{out}/events")
    events = spark.read.parquet(f"{out}/events")
    overwrite(events.filter(F.col("country") == focus), f"{out}/events_focus")
    overwrite(preferred_members(linked, events), f"{out}/members")
    left_out = told.filter("status <> 'landed'").select(F.concat(F.col("status"), F.lit(":"), "source").alias("metric"), "n")
    return run_summary(linked, events, focus).unionByName(left_out)
