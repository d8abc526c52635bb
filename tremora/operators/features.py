"""Leakage-safe cell x instant feature table.

Instants are regular, t_k = start + k*step, so the instants whose window holds an event are a short
integer range. Events are reduced to panes (cell, step) in a map-side aggregation; panes are combined into every window, target
and as-of quantity by (i, j, k). Neighbourhoods are built from those aggregates, not from events. There is
no range join, and a crowded cell shrinks to one row per step before anything is copied.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.fixed import DAY_US, NEVER_DAYS
from tremora.functions.geo import Lattice
from tremora.functions.rates import Triggering, days_between, energy, log_energy

WINDOWS_DAYS = (7, 30, 90, 365)


@dataclass(frozen=True)
class FeatureSpec:
    lattice: Lattice = Lattice()
    min_mag: float = 4.5
    horizon_days: int = 30
    step_days: int = 30
    start_us: int = 946_684_800_000_000  # 2000-01-01T00:00:00Z
    end_us: int | None = None  # last event minus the horizon if not given
    min_active_events: int = 5
    active_until_us: int | None = None  # choose active cells from events up to this time only
    triggering: Triggering | None = None
    triggering_window_days: int = 730

    @property
    def step_us(self) -> int:
        return self.step_days * DAY_US

    @property
    def horizon_us(self) -> int:
        return self.horizon_days * DAY_US


def floor_div(x: Column, d: int) -> Column:
    """Exact integer floor division; double division would lose the last microsecond."""
    return ((x - F.pmod(x, F.lit(d).cast("long"))) / F.lit(d)).cast("long")


def ceil_div(x: Column, d: int) -> Column:
    return -floor_div(-x, d)


def grid_events(events: DataFrame, spec: FeatureSpec) -> DataFrame:
    """(i, j, t_us, mag) of events on the lattice at or above the minimum magnitude."""
    grid = spec.lattice
    placed = events.filter(F.col("preferred_mw") >= spec.min_mag).select(
        grid.row_of(F.col("latitude")).alias("i"), grid.column_of(F.col("longitude")).alias("j"), "t_us",
        F.col("preferred_mw").alias("mag"),
    )
    return placed.filter(grid.contains(F.col("i"), F.col("j")))


def active_cells(placed: DataFrame, min_events: int) -> DataFrame:
    return (
        placed.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n_events")).filter(F.col("n_events") >= min_events)
    )


def instant_count(placed: DataFrame, spec: FeatureSpec) -> int:
    """Number of instants; reads one aggregated value when the end is not given."""
    end = spec.end_us
    if end is None:
        last = placed.agg(F.max("t_us")).first()[0]
        if last is None:
            raise ValueError("no events left after the magnitude and lattice filters")
        end = last - spec.horizon_us
    return max(0, (end - spec.start_us) // spec.step_us + 1)


def instants_of(spec: FeatureSpec, n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


@dataclass(frozen=True)
class _Span:
    """Events seen from an instant `steps` after the one they arrive at: those whose lag to the arrival is in [low, high) days."""

    steps: int
    low: int
    high: int


_ARRIVAL = 1 << 20  # not the offset of an instant that sees a pane


def _spans(steps: range, step: int, nearest: int, farthest: int) -> list[_Span]:
    """The part of each pane that an instant has at an age in [nearest, farthest) days; whole panes are (0, step)."""
    cut = [_Span(o, max(0, nearest - o * step), min(step, farthest - o * step)) for o in steps]
    return [c for c in cut if c.low < c.high]


def _per_instant(placed: DataFrame, spec: FeatureSpec, n: int) -> DataFrame:
    """Everything one cell contributes to each instant: (i, j, k, aggregates).

    Events are reduced to panes first, one per cell and step: those that arrive at the same instant, i.e. are seen there for the
    first time. All windows end on whole days, so a window is made of whole panes and of at most two panes cut at a whole
    day, and each cut is a conditional aggregate beside that of the whole pane. A pane, not an event, is copied to the instants that see
    it. The decay of an event depends on its exact lag; a pane holds its sum for each of these instants.
    """
    step, s = spec.step_days, spec.step_us
    kernel_days = spec.triggering_window_days if spec.triggering is not None else 0
    since = F.col("t_us") - F.lit(spec.start_us)
    arrival = ceil_div(since, s)
    lag, mag = arrival * F.lit(s) - since, F.col("mag")  # in [0, step)
    held = placed.select("i", "j", "t_us", "mag", arrival.alias("a"), lag.alias("_lag"))

    sums: dict[str, Column] = {}

    def part(name: str, span: _Span, of) -> Column:
        """The pane's aggregate `of` its events within `span`, once for all spans with the same cut."""
        key = f"_{name}_{span.low}_{span.high}"
        whole = (span.low, span.high) == (0, step)
        # a window is (t - w, t], so an age counts up to, not including, its end; targets lie in (t, t + h]
        inside = (F.col("_lag") >= F.lit(span.low * DAY_US)) & (F.col("_lag") < F.lit(span.high * DAY_US))
        sums.setdefault(key, of(F.lit(True) if whole else inside))
        return F.col(key)

    def past(name: str, days: int, of) -> dict[int, Column]:
        return {c.steps: part(name, c, of) for c in _spans(range(0, -(-days // step)), step, 0, days)}

    def future(name: str, days: int, of) -> dict[int, Column]:
        # an age of -h days is ahead, an age of 0 is not: the same half-open range, before the arrival
        return {c.steps: part(name, c, of) for c in _spans(range(-(-(-days // step)) - 1, 0), step, -days, 0)}

    def hit(m: float):
        return lambda inside: F.max(F.when(inside & (mag >= m), 1).otherwise(0))

    count, largest = (lambda inside: F.count_if(inside)), (lambda inside: F.max(F.when(inside, mag)))
    released = lambda inside: F.sum(F.when(inside, energy(mag)))
    columns: dict[str, dict[int, Column]] = {f"c{w}": past("c", w, count) for w in WINDOWS_DAYS}
    columns |= {f"m{w}": past("m", w, largest) for w in (30, 90, 365)}
    columns |= {f"e{w}": past("e", w, released) for w in (30, 365)}
    columns |= {"y6": future("y6", spec.horizon_days, hit(6.0)), "y5": future("y5", spec.horizon_days, hit(5.0)), "y5w": future("y5", 7, hit(5.0))}
    columns["trig"] = {}
    if spec.triggering is not None:
        for span in _spans(range(0, -(-kernel_days // step)), step, 0, kernel_days):
            age = (F.col("_lag") + F.lit(span.steps * s)).cast("double") / F.lit(float(DAY_US))
            decay = spec.triggering.kernel(mag, age)
            columns["trig"][span.steps] = part(f"trig{span.steps}", span, lambda inside, decay=decay: F.sum(F.when(inside, decay)))
    first = [F.count(F.lit(1)).alias("_came"), F.max("t_us").alias("_last"), F.max(F.when(mag >= 5.0, F.col("t_us"))).alias("_last5")]
    panes = held.groupBy("i", "j", "a").agg(*[c.alias(k) for k, c in sums.items()], *first)

    offsets = sorted({o for by in columns.values() for o in by})
    # What is older than the first instant is seen there for the first time, whatever its pane: one more copy for the arrival.
    copies = panes.withColumn("o", F.explode(F.array(*[F.lit(o) for o in [*offsets, _ARRIVAL]])))
    arrives = F.col("o") == _ARRIVAL
    copies = copies.withColumn("k", F.when(arrives, F.greatest(F.col("a"), F.lit(0))).otherwise(F.col("a") + F.col("o"))).filter(F.col("k").between(0, n - 1))

    def seen_from(by: dict[int, Column]) -> Column:
        """The pane's value for the instant of this copy; NULL for instants that do not see it."""
        value = F.lit(None)
        for _, steps in groupby(sorted(by.items()), key=lambda item: str(item[1])):
            run = [o for o, _ in steps]
            value = F.when(F.col("o").between(run[0], run[-1]), by[run[0]]).otherwise(value)
        return value

    total = lambda c: F.max if c[0] in "my" else F.sum
    return copies.groupBy("i", "j", "k").agg(
        *[total(c)(seen_from(by) if by else F.lit(None).cast("double")).alias(c) for c, by in columns.items()],
        F.sum(F.when(arrives, F.col("_came"))).alias("came"), F.max(F.when(arrives, F.col("_last"))).alias("last_t"),
        F.max(F.when(arrives, F.col("_last5"))).alias("last_t5"),
    )


_OWN = ("c7", "c30", "c90", "c365", "m30", "m90", "m365", "e30", "e365", "trig", "y6", "y5", "y5w", "came", "last_t", "last_t5")
_NEAR = ("nb_c30", "nb_c365", "nb_m365", "nb_trig")
_STRIP = 32  # lattice rows per strip


def _neighbourhoods(cell: DataFrame) -> DataFrame:
    """(i, j, k) with the sums of the 3 x 3 cells around each, for every cell with activity around it.

    Rows are laid out by instant and strip of lattice rows, strip borders being copied to both sides
    (about one row in sixteen). A strip then knows all its neighbourhoods, so the ninefold spread, of the four columns
    that neighbours need, is aggregated where it is produced. Cells are addressed by (i, j), so a neighbourhood cannot wrap around
    the lattice edge.
    """
    strip = lambda i: F.floor(i / F.lit(_STRIP)).cast("long")
    i = F.col("i")
    homes = F.array_distinct(F.array(strip(i - 1), strip(i), strip(i + 1)))
    passed_on = [F.col(c).alias(f"nb_{c}") for c in ("c30", "c365", "m365", "trig")]
    active = cell.filter("c365 > 0 OR trig IS NOT NULL").select("i", "j", "k", *passed_on)
    laid_out = active.withColumn("strip", F.explode(homes)).repartition("k", "strip")
    steps = [F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    spread = laid_out.withColumn("o", F.explode(F.array(*steps))).filter(strip(i + F.col("o.di")) == F.col("strip"))
    moved = spread.select("k", "strip", (i + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"), *_NEAR)
    totals = [F.sum("nb_c30").alias("nb_c30"), F.sum("nb_c365").alias("nb_c365"), F.max("nb_m365").alias("nb_m365"), F.sum("nb_trig").alias("nb_trig")]
    return moved.groupBy("k", "strip", "i", "j").agg(*totals).drop("strip")


def feature_table(events: DataFrame, spec: FeatureSpec = FeatureSpec()) -> DataFrame:
    placed = grid_events(events, spec)
    n = instant_count(placed, spec)
    cell = _per_instant(placed, spec, n)

    region = cell.groupBy("k").agg(F.sum("c30").alias("reg_cnt_30d"), F.max("m30").alias("reg_maxmag_30d"))
    near = _neighbourhoods(cell)

    seen = placed if spec.active_until_us is None else placed.filter(F.col("t_us") <= spec.active_until_us)
    cells = active_cells(seen, spec.min_active_events).select("i", "j")
    scaffold = cells.select("i", "j", F.explode(instants_of(spec, n)).alias("k"), F.lit(True).alias("wanted"))
    # Partitioned by cell once: serves both the aggregation by (i, j, k) and the running columns. A cell
    # holds at most three rows per instant here.
    together = cell.unionByName(near, allowMissingColumns=True).unionByName(scaffold, allowMissingColumns=True).repartition("i", "j")
    dense = together.groupBy("i", "j", "k").agg(F.max("wanted").alias("wanted"), *[F.max(c).alias(c) for c in (*_OWN, *_NEAR)])
    so_far = Window.partitionBy("i", "j").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    running = dense.select(
        "*", F.sum(F.coalesce("came", F.lit(0))).over(so_far).alias("cnt_all"),
        F.max("last_t").over(so_far).alias("t_last"), F.max("last_t5").over(so_far).alias("t_last5"),
    ).filter("wanted").join(region, "k", "left")

    grid, zero = spec.lattice, lambda c: F.coalesce(F.col(c), F.lit(0.0))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    t_k = F.lit(spec.start_us) + F.col("k") * F.lit(spec.step_us)
    since = lambda c: F.coalesce(days_between(t_k, F.col(c)), F.lit(NEVER_DAYS))
    return running.select(
        grid.cell_id(F.col("i"), F.col("j")).alias("cell_id"), "i", "j",
        grid.centroid_lat(F.col("i")).alias("cen_lat"), grid.centroid_lon(F.col("j")).alias("cen_lon"), t_k.alias("t_us"),
        count("c7").alias("cnt_7d"), count("c30").alias("cnt_30d"), count("c90").alias("cnt_90d"),
        count("c365").alias("cnt_365d"), F.col("cnt_all").cast("long").alias("cnt_all"),
        zero("m30").alias("maxmag_30d"), zero("m90").alias("maxmag_90d"), zero("m365").alias("maxmag_365d"),
        log_energy(F.col("e30")).alias("logE_30d"), log_energy(F.col("e365")).alias("logE_365d"),
        since("t_last").alias("days_since_last"), since("t_last5").alias("days_since_M5"),
        count("nb_c30").alias("nb_cnt_30d"), count("nb_c365").alias("nb_cnt_365d"), zero("nb_m365").alias("nb_maxmag_365d"),
        F.log1p(zero("trig")).alias("etas_cell"), F.log1p(zero("nb_trig")).alias("etas_nb"),
        count("reg_cnt_30d").alias("reg_cnt_30d"), zero("reg_maxmag_30d").alias("reg_maxmag_30d"),
        count("y6").alias("y_m6_30d"), count("y5").alias("y_m5_30d"), count("y5w").alias("y_m5_7d"),
    )


def positives(features: DataFrame, targets=("y_m6_30d", "y_m5_30d", "y_m5_7d")) -> DataFrame:
    long = features.select(F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("y")) for t in targets])).alias("r"))
    return long.groupBy("r.target").agg(F.sum("r.y").alias("n_pos"), F.avg("r.y").alias("share"))
