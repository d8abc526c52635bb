"""Windows over time ranges and the combination of landed sources."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremora.fixed import DAY_US
from tremora.schema import OBS
from tremora.session import scratch_path

log = logging.getLogger(__name__)


def time_chunks(spark: SparkSession, start_us: int, end_us: int, step_days: int) -> DataFrame:
    """(chunk, start_us, end_us): fixed steps, the last one cut at the end."""
    step = step_days * DAY_US
    n = max(0, math.ceil((end_us - start_us) / step))
    begin = F.lit(start_us) + F.col("id") * F.lit(step)
    return spark.range(n).select(
        F.col("id").alias("chunk"), begin.alias("start_us"), F.least(begin + F.lit(step), F.lit(end_us)).alias("end_us")
    )


def balanced_windows(events: DataFrame, start_us: int, end_us: int, max_rows: int, min_width_us: int = 2_000_000) -> DataFrame:
    """(depth, slot, from_us, to_us, n, truncated): halve [start, end) until a window holds fewer than
    `max_rows` rows or is no wider than `min_width_us`.

    Window `slot` of a depth covers 1/2^depth of the range. Rows are counted once at the finest depth and
    the counts are rolled up to all depths together, so the number of halvings costs no further scans.
    """
    span = end_us - start_us
    deepest = max(0, math.ceil(math.log2(max(span, 1) / min_width_us)))
    position = (F.col("t_us") - F.lit(start_us)).cast("decimal(38,0)") * F.lit(1 << deepest).cast("decimal(38,0)")
    finest = (
        events.filter((F.col("t_us") >= start_us) & (F.col("t_us") < end_us))
        .select(F.floor(position / F.lit(span).cast("decimal(38,0)")).cast("long").alias("fine"))
        .groupBy("fine").agg(F.count(F.lit(1)).alias("n"))
    )
    levels = finest.select(
        F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("depth"), "fine", "n"
    ).withColumn("slot", F.floor(F.col("fine") / F.pow(F.lit(2.0), F.lit(deepest) - F.col("depth"))).cast("long"))
    counts = levels.groupBy("depth", "slot").agg(F.sum("n").alias("n"))
    # A window is halved when it is full and not yet at the finest depth; its halves exist even if empty.
    halved = counts.filter((F.col("n") >= max_rows) & (F.col("depth") < deepest))
    halves = halved.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("slot") * 2, F.col("slot") * 2 + 1)).alias("slot"))
    root = events.sparkSession.range(1).select(F.lit(0).alias("depth"), F.col("id").alias("slot"))
    reached = root.unionByName(halves).join(counts, ["depth", "slot"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    kept = reached.filter((F.col("n") < max_rows) | (F.col("depth") == deepest))
    scale = F.pow(F.lit(2.0), F.col("depth")).cast("decimal(38,0)")
    edge = lambda k: F.lit(start_us) + F.floor(k.cast("decimal(38,0)") * F.lit(span).cast("decimal(38,0)") / scale).cast("long")
    return kept.select(
        F.col("depth").cast("long").alias("depth"), "slot", edge(F.col("slot")).alias("from_us"), edge(F.col("slot") + 1).alias("to_us"), "n",
        (F.col("n") >= max_rows).alias("truncated"),
    )


def last_per_id(rows: DataFrame, keys: tuple[str, ...] = ("source", "source_event_id"), arrival: str = "arrival") -> DataFrame:
    """The last arrived row per native id; rows without an id are dropped.

    A maximum over (arrival, row) combines map-side, so an id reported over and over stays one row per task.
    """
    rest = [c for c in rows.columns if c not in (*keys, arrival)]
    named = rows.filter(F.col(keys[-1]).isNotNull() & (F.col(keys[-1]) != ""))
    picked = named.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(arrival)).alias("_r"), F.max(arrival).alias(arrival))
    return picked.select(*keys, arrival, *[F.col(f"_r.{c}").alias(c) for c in rest])


def optional(spark: SparkSession, reader: Callable[[], DataFrame], name: str) -> DataFrame:
    """The source, or an empty observation table with a warning if its file is absent."""
    try:
        return reader()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("%s: file not found, continuing without it", name)
        return spark.createDataFrame([], OBS)


def landed_sources(spark: SparkSession, wanted: list[str], readers: Mapping[str, Callable[[], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(all observations of the wanted sources, (source, status, n, problem) of each).

    Every source is landed in a table of its own, so one that breaks in its last file is left out like one that breaks in its
    first, and its status says so. Unknown names have status `unknown`. It is an error if nothing remains.
    """
    frames, told = [], []
    for name in wanted:
        if name not in readers:
            log.warning("unknown source ignored: %s", name)
            told.append((name, "unknown", 0, None))
            continue
        path = scratch_path(spark, f"landed-{name}")
        try:
            frame = readers[name]()
            frame.write.parquet(path)
            landed = spark.read.schema(frame.schema).parquet(path)
            told.append((name, "landed", landed.count(), None))
            frames.append(landed)
        except Exception as problem:  # noqa: BLE001 - one broken source must not stop the others
            log.error("source %s failed: %s", name, problem)
            told.append((name, "failed", 0, str(problem).split("\n", 1)[0][:200]))
    if not frames:
        raise RuntimeError("no source returned data")
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return union, spark.createDataFrame(told, "source string, status string, n long, problem string")


def union_sources(spark: SparkSession, wanted: list[str], readers: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """All observations of the wanted sources that could be read to the end."""
    return landed_sources(spark, wanted, readers)[0]
