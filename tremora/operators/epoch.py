"""Superposed-epoch counts of targets after triggers, with a Monte-Carlo null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.fixed import (
    COUNTRY_BOXES, DAY_US, EPOCH_CURVE_DRAWS, EPOCH_DRAWS, EPOCH_WINDOWS_DAYS, REMOTE_KM, SOUTH_CENTROID, SOUTH_TARGET_BOX, Box,
)
from tremora.functions.geo import haversine_km, in_box

_SMALL = 400_000  # buckets that may be broadcast
_SLOTS = 2  # times in a row of a bucket
_CHUNK_BITS = 12  # 4,096 buckets are summed in one go
_DIGITS = 13  # hexadecimal digits of a draw: 52 bits


def uniform_draw(draw: Column, item: Column, stream: Column) -> Column:
    """A repeatable uniform number in [0, 1) from three integers: the leading bits of a digest of them, so draws are independent."""
    digest = F.md5(F.concat_ws(",", draw.cast("string"), item.cast("string"), stream.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("long").cast("double") / F.lit(float(16**_DIGITS))


def _counted(ends: DataFrame, targets: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """`ends` with one column for each kind: the sum, over the rows of an end, is the number of such targets up to its time `at`.

    `targets` holds t_us and, for each kind, how many of it a row stands for. Their times are cumulated over as many buckets as there are
    times, without a checkpoint and with no other table sent around. A window end looks up its bucket, which holds the number of targets before it and the times inside it, a few to a row:
    one equi-join without arrays, in which only ends in a crowded bucket meet several rows. The planner takes the window ends for as few as
    the rows they are drawn from, so the side to be sent around is named here.
    """
    # Equal times collapse, so no instant can crowd a bucket.
    arrivals = targets.filter(F.col("t_us").isNotNull()).groupBy(F.col("t_us").alias("time")).agg(*[F.sum(k).alias(k) for k in kinds])
    first, last, n = arrivals.agg(F.min("time"), F.max("time"), F.count(F.lit(1))).first()
    none = F.lit(0).cast("long")
    if not n:
        return ends.select("*", *[none.alias(k) for k in kinds])
    size = (last - first) // n + 1
    bucket = lambda t: F.greatest(F.least(F.floor((t - F.lit(first)) / F.lit(size)), F.lit(n)), F.lit(-1)).cast("long")
    empty = targets.sparkSession.range(-1, n + 1).select(F.col("id").alias("bucket"), F.lit(None).cast("long").alias("time"), *[none.alias(k) for k in kinds])
    every = arrivals.select(bucket(F.col("time")).alias("bucket"), "time", *kinds).unionByName(empty).groupBy("bucket").agg(
        *[F.sum(k).alias(k) for k in kinds], F.sort_array(F.collect_list(F.when(F.col("time").isNotNull(), F.struct("time", *kinds)))).alias("times")
    ).withColumn("chunk", F.shiftright(F.col("bucket") + 1, _CHUNK_BITS))
    # One row per chunk of buckets: the only rows that meet in a single task.
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = every.groupBy("chunk").agg(*[F.sum(k).alias(k) for k in kinds]).select(
        "chunk", *[F.coalesce(F.sum(k).over(earlier), none).alias(f"off_{k}") for k in kinds]
    )
    within = Window.partitionBy("chunk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = every.select("chunk", "bucket", "times", *[F.coalesce(F.sum(k).over(within), none).alias(k) for k in kinds]).join(offsets.hint("merge"), "chunk")
    starts = F.sequence(F.lit(1), F.greatest(F.size("times"), F.lit(1)), F.lit(_SLOTS))
    held = held.select("*", F.posexplode(F.transform(starts, lambda at: F.slice("times", at, F.lit(_SLOTS)))).alias("row", "part")).select(
        "bucket", *[F.when(F.col("row") == 0, F.col(k) + F.col(f"off_{k}")).otherwise(none).alias(f"before_{k}") for k in kinds],
        *[F.get("part", F.lit(j))["time"].alias(f"time_{j}") for j in range(_SLOTS)], *[F.get("part", F.lit(j))[k].alias(f"{k}_{j}") for k in kinds for j in range(_SLOTS)],
    )
    placed = ends.withColumn("bucket", bucket(F.col("at"))).join(F.broadcast(held) if n <= _SMALL else held.hint("merge"), "bucket")
    reached = lambda k, j: F.when(F.col(f"time_{j}") <= F.col("at"), F.col(f"{k}_{j}")).otherwise(none)
    return placed.select(*ends.columns, *[sum((reached(k, j) for j in range(_SLOTS)), F.col(f"before_{k}")).alias(k) for k in kinds])


def _ends(windows: DataFrame, columns: Sequence[str], start: str, width: str) -> DataFrame:
    """Both ends of each window, the first one to be taken off."""
    return windows.select(
        *columns,
        F.inline(F.array(
            F.struct(F.col(start).alias("at"), F.lit(-1).cast("long").alias("sign")),
            F.struct((F.col(start) + F.col(width)).alias("at"), F.lit(1).cast("long").alias("sign")),
        )),
    )


def followers(triggers: DataFrame, targets: DataFrame, keys: Sequence[str], start: str, width: str) -> DataFrame:
    """(keys, n): targets in (start, start + width] summed over trigger rows; a target counts once per trigger.

    Only sums per key are shuffled.
    """
    counted = _counted(_ends(triggers, keys, start, width), targets.select("t_us", F.lit(1).cast("long").alias("_n")), ["_n"])
    return counted.groupBy(*keys).agg(F.sum(F.col("sign") * F.col("_n")).alias("n"))


def _spread(triggers: DataFrame) -> DataFrame:
    """Triggers are few and their draws many: dealt out, so that every task draws."""
    return triggers.repartition(int(triggers.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _windows(days: Sequence[int]) -> Column:
    return F.array(*[F.lit(d).cast("long") for d in days])


def observed_counts(triggers: DataFrame, targets: DataFrame, days: Sequence[int] = EPOCH_WINDOWS_DAYS, keys: Sequence[str] = ()) -> DataFrame:
    spread = triggers.select(*keys, "t_us", F.explode(_windows(days)).alias("days")).withColumn("width", F.col("days") * F.lit(DAY_US))
    return followers(spread, targets, [*keys, "days"], "t_us", "width").withColumnRenamed("n", "observed")


def _drawn(triggers: DataFrame, first_us: int, last_us: int, days: Sequence[int], draws: int, keep: Sequence[str]) -> DataFrame:
    """(keep, days, draw, start, width): for each trigger, window and draw a uniform time in [first, last - window]."""
    random = (
        _spread(triggers.select(*keep, "canonical_id")).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(draws).cast("long"))).alias("draw"))
        .select(*keep, "canonical_id", "draw", F.explode(_windows(days)).alias("days"))
        .withColumn("width", F.col("days") * F.lit(DAY_US))
    )
    room = (F.lit(last_us - first_us) - F.col("width")).cast("double")
    u = uniform_draw(F.col("draw"), F.col("canonical_id"), F.col("days"))
    return random.withColumn("start", F.lit(first_us) + F.floor(u * room).cast("long"))


def null_counts(
    triggers: DataFrame, targets: DataFrame, first_us: int, last_us: int,
    days: Sequence[int] = EPOCH_WINDOWS_DAYS, draws: int = EPOCH_DRAWS, keys: Sequence[str] = (),
) -> DataFrame:
    """(keys, days, draw, n): counts after as many uniform times in [first, last - window] as there are triggers."""
    return followers(_drawn(triggers, first_us, last_us, days, draws, keys), targets, [*keys, "days", "draw"], "start", "width")


def _rated(null: DataFrame, observed: DataFrame, sizes: DataFrame, keys: Sequence[str], draws: int) -> DataFrame:
    cell = [*keys, "days"]
    stats = null.join(observed, cell).groupBy(*cell, "observed").agg(
        F.avg("n").alias("expected"), F.stddev_pop("n").alias("sd"), F.count_if(F.col("n") >= F.col("observed")).alias("as_large")
    )
    rated = stats.select(
        *cell, "observed", "expected", F.try_divide(F.col("observed").cast("double"), F.col("expected")).alias("rate_ratio"),
        ((F.col("observed") - F.col("expected")) / (F.col("sd") + F.lit(1e-9))).alias("beta"),
        ((F.lit(1.0) + F.col("as_large")) / F.lit(1.0 + draws)).alias("p"),
    )
    sizes = sizes.filter("n_triggers >= 3")
    return rated.join(sizes, list(keys)) if keys else rated.crossJoin(F.broadcast(sizes))


def epoch_test(
    triggers: DataFrame, targets: DataFrame, first_us: int, last_us: int,
    days: Sequence[int] = EPOCH_WINDOWS_DAYS, draws: int = EPOCH_DRAWS, keys: Sequence[str] = (),
) -> DataFrame:
    """Per window: observed, expected, rate ratio, beta and one-sided p. Fewer than three triggers give no rows.

    `keys` are columns of `triggers` that tell several tests apart; all run in the same pass.
    """
    observed = observed_counts(triggers, targets, days, keys)
    null = null_counts(triggers, targets, first_us, last_us, days, draws, keys)
    sizes = triggers.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_triggers"))
    return _rated(null, observed, sizes, keys, draws)


def distance_controlled(
    events: DataFrame, thresholds: Sequence[float], min_target: float, first_us: int, last_us: int,
    source: str = "Chile", focus: str = "Peru", near: Box = SOUTH_TARGET_BOX, centre: tuple[float, float] = SOUTH_CENTROID,
    remote_km: float = REMOTE_KM, draws: int = EPOCH_DRAWS,
) -> DataFrame:
    """The experiment under three settings and several trigger thresholds: (setting, threshold, days, ...).

    `whole`: targets anywhere in the focus country; `near`: targets in a box close to the triggers; `remote`: the same targets, but only
    triggers at least `remote_km` from its centre, so that aftershocks of near ones are no evidence. A random time depends on the trigger,
    the window and the draw only, so it is drawn and looked up once for all settings and thresholds; each of them is a sum of its own.
    """
    km = haversine_km(F.col("latitude"), F.col("longitude"), F.lit(centre[0]), F.lit(centre[1]))
    # triggers come from the source's box, which overlaps its neighbours', not from rows tagged with its name
    box = COUNTRY_BOXES[source]
    strong = events.filter(in_box(F.col("latitude"), F.col("longitude"), box) & (F.col("preferred_mw") >= min(thresholds)))
    triggers = strong.select("canonical_id", "t_us", F.col("preferred_mw").alias("mw"), (km >= remote_km).alias("remote"))
    flag = lambda condition: F.when(condition, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    targets = events.filter(F.col("preferred_mw") >= min_target).select(
        "t_us", flag(F.col("country") == focus).alias("whole"), flag(in_box(F.col("latitude"), F.col("longitude"), near)).alias("near")
    ).filter("whole + near > 0")
    cells = [(setting, float(t)) for setting in ("whole", "near", "remote") for t in thresholds]

    def by_cell(rows: DataFrame, keys: Sequence[str], value: dict[str, Column], out: str) -> DataFrame:
        """(setting, threshold, keys, out): sums over the triggers of each cell; none if it has no trigger."""
        part = lambda setting, t: (F.col("mw") >= t) & (F.col("remote") if setting == "remote" else F.lit(True))
        sums = rows.groupBy(*keys).agg(*[F.sum(F.when(part(s, t), value[s])).alias(f"_{k}") for k, (s, t) in enumerate(cells)])
        named = [F.struct(F.lit(s).alias("setting"), F.lit(t).alias("threshold"), F.col(f"_{k}").alias(out)) for k, (s, t) in enumerate(cells)]
        return sums.select(*keys, F.inline(F.array(*named))).filter(F.col(out).isNotNull())

    def counts(windows: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
        counted = _counted(_ends(windows, [*keys, "mw", "remote"], "start", "width"), targets, ["whole", "near"])
        found = {kind: F.col("sign") * F.col(kind) for kind in ("whole", "near")}
        return by_cell(counted, keys, found | {"remote": found["near"]}, out)

    days = EPOCH_WINDOWS_DAYS
    real = triggers.select("mw", "remote", F.col("t_us").alias("start"), F.explode(_windows(days)).alias("days")).withColumn("width", F.col("days") * F.lit(DAY_US))
    null = counts(_drawn(triggers, first_us, last_us, days, draws, ["mw", "remote"]), ["days", "draw"], "n")
    one = F.lit(1).cast("long")
    sizes = by_cell(triggers, [], {"whole": one, "near": one, "remote": one}, "n_triggers")
    return _rated(null, counts(real, ["days"], "observed"), sizes, ["setting", "threshold"], draws)


def epoch_curve(
    triggers: DataFrame, targets: DataFrame, first_us: int, last_us: int, reach_days: int = 30, draws: int = EPOCH_CURVE_DRAWS
) -> DataFrame:
    """(lag, mean_count, low, high): daily counts around triggers and the 95 % band of random times."""
    lags = F.explode(F.sequence(F.lit(-reach_days), F.lit(reach_days)))
    n = F.lit(DAY_US)
    per_lag = lambda df, keys: followers(
        df.withColumn("lag", lags).withColumn("start", F.col("t0") + F.col("lag") * n).withColumn("width", n), targets, keys, "start", "width"
    )
    real = per_lag(triggers.select(F.col("t_us").alias("t0")), ["lag"])
    drawn = _spread(triggers.select("canonical_id")).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(draws).cast("long"))).alias("draw"))
    room = float(last_us - first_us - 2 * reach_days * DAY_US)
    u = uniform_draw(F.col("draw"), F.col("canonical_id"), F.lit(0))
    random = drawn.select("draw", (F.lit(first_us + reach_days * DAY_US) + F.floor(u * F.lit(room)).cast("long")).alias("t0"))
    band = per_lag(random, ["lag", "draw"]).groupBy("lag").agg(  # `draws` values per lag
        F.expr("percentile(n, 0.025)").alias("low"), F.expr("percentile(n, 0.975)").alias("high")
    )
    size = triggers.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    return real.join(band, "lag").withColumn("k", size).select(
        "lag", (F.col("n") / F.col("k")).alias("mean_count"), (F.col("low") / F.col("k")).alias("low"), (F.col("high") / F.col("k")).alias("high")
    )
