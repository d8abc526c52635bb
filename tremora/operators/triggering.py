"""Self-exciting intensity: values at events and instants, likelihood and fit.

The decay (lag + c)^-p of a pair is written as a sum of fifty to a hundred exponentials of the lag, to twelve digits. For each exponential
the sum over predecessors is one number that fades with time, grows when an event enters the window and shrinks when one leaves it. So
the events are laid out once in the order of time, cut into parts, and each part is read twice from end to end: first for what
it adds to the sums, then, starting from what all parts before it have added, for the sums at its events. The work grows with the number
of events, however many lie in a window; one row per part reaches the driver.

A part is kept as one row with its columns as an Arrow batch, so that a reading is a single call on arrays. Rows of one instant are one
step of the sums, and steps at which events only leave concern the slow exponentials alone: the fast ones have forgotten them by then.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import astuple, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.fixed import DAY_US, PLAUSIBLE_RANGES
from tremora.functions.rates import Triggering, branching_ratio, days_between, decay, decay_integral, productivity
from tremora.session import materialize

PENALTY = 1e12
_CROWD = 65_536  # rows of a part
_STEPS = np.arange(0.36, 0.2, -0.01)  # of the logarithm of the exponents, the widest that is exact enough
_EXACT = 1e-14
_SLOW, _NODES = 2.0, 14  # exponents that fade by less over the span are replaced by so many
_FADED = 200.0  # what has faded by more is as good as gone; smaller numbers would only be slow
_GONE = 45.0  # an exponential that fades by more over the window has forgotten an event before it leaves
_LANES, _LENGTH = 32, 64  # stretches that are read side by side, and steps of each
_BLOCK = 4096  # steps whose exponentials are held at once
_BATCH_BYTES = 1 << 24  # of parts that cross to Python at once
_ASK, _ENTER, _LEAVE = 0, 1, 2
_ROW = pa.schema([("at", pa.int64()), ("kind", pa.int32()), ("id", pa.int64()), ("t", pa.int64()), ("m", pa.float64()), ("n", pa.int64())])


def _tiles(series: DataFrame, window_us: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """(rows, parts): three rows per event in the order of time, and (part, rows) with all rows of a part as one Arrow batch.

    An event asks for the sum, enters it and leaves it a window later, after those who ask then. At equal times the lower id enters
    first and nobody sees their own id; an event without an id sees and is seen by none of its instant. Repeated rows are counted in `n`.
    """
    events = series.filter("t_us IS NOT NULL").groupBy(F.col("canonical_id").alias("id"), F.col("t_us").alias("t"), F.col("mag").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("id").isNotNull()
    turn = lambda at, kind, rank: F.struct(at.alias("at"), F.lit(kind).alias("kind"), rank.alias("rank"))
    turns = F.array(
        turn(F.col("t"), _ASK, F.when(known, 1).otherwise(0)), turn(F.col("t"), _ENTER, F.when(known, 1).otherwise(2)), turn(F.col("t") + F.lit(window_us), _LEAVE, F.lit(3))
    )
    rows = events.select("id", "t", "m", "n", F.inline(turns))
    order = ("at", "rank", "id", "kind")
    least = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # keeps small catalogs parallel too
    size = 3 * series.count()
    parts = max(min(least, size // 1024), math.ceil(size / crowd), 1)
    laid = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    spark = series.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH_BYTES))
    typed = laid.select(*[F.col(c).cast(k).alias(c) for c, k in zip(_ROW.names, ("long", "int", "long", "long", "double", "long"))], F.spark_partition_id().alias("part"))
    # a reading is short beside the start of a task, so a task reads several parts, a few at once
    return laid, materialize(typed.mapInArrow(_packed, "part int, rows binary")).coalesce(spark.sparkContext.defaultParallelism)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [batch for batch in batches if batch.num_rows]
    if held:
        columns = [pa.concat_arrays([batch.column(c) for batch in held]) for c in _ROW.names]
        rows = pa.RecordBatch.from_arrays(columns, schema=_ROW).serialize().to_pybytes()
        yield pa.RecordBatch.from_pydict({"part": held[0].column("part")[:1], "rows": pa.array([rows], pa.binary())})


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        for part, rows in zip(batch.column("part").to_pylist(), batch.column("rows")):
            yield part, pa.ipc.read_record_batch(rows.as_buffer(), _ROW)


@dataclass(frozen=True)
class _Exponentials:
    """sum of weights[k] * exp(-exponents[k] * lag) for the decay and, as further columns, the decay / (lag + c) and the decay * ln(lag + c)."""

    exponents: np.ndarray
    weights: np.ndarray


def _exponentials(c: float, p: float, span_days: float) -> _Exponentials:
    """y^-p is the integral of exp(p x - y e^x) / gamma(p) over all x: by the trapezoid rule, for y = lag + c from c to span + c.

    The step leaves an error far below 1e-12; where y e^x is so small that the exponential is one, the rest is a geometric series, kept
    as a constant.
    """
    if not (c > 0 and p > 0):
        raise ValueError(f"a decay needs c > 0 and p > 0, not {c} and {p}")
    # how far the rule is off: the gamma function at p + 1 and 2 pi / step beside it
    off = lambda h: 20 * (2 * math.pi / h) ** (p + 0.5) * math.exp(-math.pi**2 / h) / math.gamma(p + 1)
    step = float(next((h for h in _STEPS if off(h) < _EXACT), _STEPS[-1]))
    grid = np.arange(-40 / p, 6, step)
    mass = step * np.exp(p * grid - np.exp(grid))
    gamma, digamma = mass.sum(), (mass * grid).sum() / mass.sum()
    lowest = -16 * math.log(10) / (p + 1) - math.log(span_days + c)
    x = np.arange(lowest, math.log(60 / c) + step, step)
    plain = step * np.exp(p * x) / gamma
    fine = np.exp(-c * np.exp(x))
    ratio = math.exp(-p * step)
    rest, steps = ratio / (1 - ratio), ratio / (1 - ratio) ** 2
    deeper = math.exp(-(p + 1) * step)
    steeper = plain * np.exp(x) / p
    constant = (plain[0] * rest, steeper[0] * deeper / (1 - deeper), -plain[0] * ((lowest - digamma) * rest - step * steps))
    weights = np.vstack((constant, np.column_stack((plain * fine, steeper * fine, -plain * (x - digamma) * fine))))
    exponents = np.concatenate(([0.0], np.exp(x)))
    # over the span a slow exponential is a polynomial of its exponent: Lagrange's, through a few of them
    slow = exponents * span_days < _SLOW
    nodes = _SLOW / span_days * (0.5 - 0.5 * np.cos((np.arange(_NODES) + 0.5) * math.pi / _NODES))
    gaps = nodes[:, None] - nodes + np.eye(_NODES)
    away = exponents[slow][:, None, None] - nodes + np.zeros((_NODES, 1))
    away[:, np.arange(_NODES), np.arange(_NODES)] = 1.0
    shares = (away / (gaps + np.eye(_NODES) * (1 - np.diag(gaps)))).prod(axis=2)
    return _Exponentials(np.concatenate((nodes, exponents[~slow])), np.vstack((shares.T @ weights[slow], weights[~slow])))


def _fade(days: np.ndarray, exponents: np.ndarray) -> np.ndarray:
    return np.exp(-np.minimum(days[..., None] * exponents, _FADED))


@dataclass(frozen=True)
class _Steps:
    """A part's rows by instant: times, what enters and leaves (a column per kind of sum), and which step an asking row belongs to.

    `inside` is what entered at the same instant before the asking row.
    """

    at: np.ndarray
    gains: np.ndarray
    losses: np.ndarray
    asks: np.ndarray
    of: np.ndarray
    inside: np.ndarray
    fresh: np.ndarray


def _steps(rows: pa.RecordBatch, theta: Triggering, kinds: int) -> _Steps:
    """The second kind of sum is weighted by magnitude."""
    at, kind, m, n = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("at", "kind", "m", "n"))
    size = n * np.exp(theta.alpha * (m.astype(float) - theta.m0))
    sizes = np.column_stack((size, size * (m - theta.m0)))[:, :kinds]
    gains, losses = np.where((kind == _ENTER)[:, None], sizes, 0.0), np.where((kind == _LEAVE)[:, None], sizes, 0.0)
    starts = np.concatenate(([0], np.nonzero(np.diff(at))[0] + 1))
    of = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(at)))
    upto = np.cumsum(gains, axis=0, dtype=np.longdouble) - gains
    asks = np.nonzero(kind == _ASK)[0]
    inside = (upto[asks] - upto[starts[of[asks]]]).astype(float)
    summed = lambda a: np.add.reduceat(a, starts, axis=0)
    return _Steps(at[starts], summed(gains), summed(losses), asks, of[asks], inside, summed((kind != _LEAVE).astype(np.int64)) > 0)


def _halves(steps: _Steps, f: _Exponentials, window_days: float):
    """(exponentials, times, gains, losses, steps) of the slow exponentials at all steps and of the fast ones at those where not only some leave."""
    slow = f.exponents * window_days < _GONE
    yield slow, steps.at, steps.gains, steps.losses, np.arange(len(steps.at))
    yield ~slow, steps.at[steps.fresh], steps.gains[steps.fresh], None, np.nonzero(steps.fresh)[0]


def _added(steps: _Steps, f: _Exponentials, window_days: float) -> np.ndarray:
    """(kind, exponent): what the part adds to the sums, at its last instant."""
    out = np.zeros((steps.gains.shape[1], len(f.exponents)))
    for which, at, gains, losses, _ in _halves(steps, f, window_days):
        fade = f.exponents[which]
        gone = np.exp(-window_days * fade)
        for k in range(0, len(at), _BLOCK):
            cut = slice(k, k + _BLOCK)
            left = _fade((steps.at[-1] - at[cut]) / DAY_US, fade)
            out[:, which] += gains[cut].T @ left
            if losses is not None:
                out[:, which] -= (losses[cut].T @ left) * gone
    return out


def _block(gap: np.ndarray, gains: np.ndarray, fade: np.ndarray, state: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums before each step, state after the last one); `gap` is the time before each step, `gains` is (step, kind, exponent or 1).

    The steps are cut into stretches that are read side by side from nothing; what lies before a stretch fades along it.
    """
    n, kinds = gains.shape[:2]
    lanes = min(_LANES, n)
    length = -(-n // lanes)
    short = lanes * length - n
    if short:
        gap, gains = np.concatenate((gap, np.zeros(short))), np.concatenate((gains, np.zeros((short, *gains.shape[1:]))))
    left = np.ascontiguousarray(_fade(gap.reshape(lanes, length).T, fade))
    gains = gains.reshape(lanes, length, kinds, -1).transpose(1, 2, 0, 3)
    before, upto = np.empty((length, kinds, lanes, len(fade))), np.empty((length, lanes, len(fade)))
    now, whole = np.zeros((kinds, lanes, len(fade))), np.ones((lanes, len(fade)))
    for k in range(length):
        np.multiply(now, left[k], out=before[k])
        np.add(before[k], gains[k], out=now)
        np.multiply(whole, left[k], out=upto[k])
        whole = upto[k]
    begin = np.empty_like(now)
    for lane in range(lanes):
        begin[:, lane] = state
        state = state * whole[lane] + now[:, lane]
    sums = (before.reshape(-1, len(fade)) @ weights).reshape(length, kinds, lanes, -1).transpose(2, 0, 1, 3)
    far = np.stack([upto.transpose(1, 0, 2) @ (begin[kind][:, :, None] * weights) for kind in range(kinds)], axis=2)
    return (sums + far).reshape(lanes * length, kinds, -1)[:n], state


def _at_events(steps: _Steps, f: _Exponentials, window_days: float, state: np.ndarray, since: int | None, columns: int) -> np.ndarray:
    """(asking row, kind, column): the sums over predecessors, from the state that the parts before leave at the time `since`."""
    weights = f.weights[:, :columns]
    found = steps.inside[:, :, None] * weights.sum(axis=0)
    for which, at, gains, losses, places in _halves(steps, f, window_days):
        fade, now, last = f.exponents[which], state[:, which], steps.at[0] if since is None else since
        sums = np.empty((len(steps.at), gains.shape[1], columns))
        gone = np.exp(-window_days * fade)
        for k in range(0, len(at), _LANES * _LENGTH):
            cut = slice(k, k + _LANES * _LENGTH)
            gap = np.diff(at[cut], prepend=last) / DAY_US
            moved = gains[cut][:, :, None] if losses is None else gains[cut][:, :, None] - losses[cut][:, :, None] * gone
            sums[places[cut]], now = _block(gap, moved, fade, now, weights[which])
            last = at[cut][-1]
        found += sums[steps.of]
    return found


def _carried(parts: DataFrame, candidates: Sequence[Triggering], fades: Sequence[_Exponentials], window_days: float, kinds: int) -> dict[int, list[tuple[int | None, np.ndarray]]]:
    """Per part and candidate: the state that the parts before it leave behind, and its time."""

    def ends(batches):
        for part, rows in _unpacked(batches):
            states = [_added(_steps(rows, theta, kinds), f, window_days).ravel().tolist() for theta, f in zip(candidates, fades)]
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "last": rows.column("at")[-1:], "states": pa.array([states], pa.list_(pa.list_(pa.float64())))})

    found = sorted(parts.mapInArrow(ends, "part int, last long, states array<array<double>>").collect())  # one row per part
    states, since, carried = [np.zeros((kinds, len(f.exponents))) for f in fades], None, {}
    for part, last, added in found:
        carried[part] = [(since, s) for s in states]
        states = [
            np.reshape(a, s.shape) + (0 if since is None else s * np.exp(-f.exponents * ((last - since) / DAY_US))) for a, s, f in zip(added, states, fades)
        ]
        since = last
    return carried


def _summed(parts: DataFrame, candidates: Sequence[Triggering], window_us: int, kinds: int, columns: int):
    """A function of a task's batches: (candidate, asking rows, sums over their predecessors by kind and column of the exponentials)."""
    window_days = window_us / DAY_US
    fades = [_exponentials(theta.c, theta.p, window_days) for theta in candidates]
    carried = _carried(parts, candidates, fades, window_days, kinds)

    def run(batches):
        for part, rows in _unpacked(batches):
            for k, (theta, f) in enumerate(zip(candidates, fades)):
                steps, (since, state) = _steps(rows, theta, kinds), carried[part][k]
                kept = rows.take(pa.array(steps.asks))
                yield k, kept, _at_events(steps, f, window_days, state, since, columns) * kept.column("n").to_numpy()[:, None, None]

    return run


def _rates(parts: DataFrame, candidates: Sequence[Triggering], window_us: int) -> DataFrame:
    """(theta, mu, k, alpha, c, p, id, t, m, rate) for every event and candidate."""
    run = _summed(parts, candidates, window_us, 1, 1)

    def sums(batches):
        for k, kept, found in run(batches):
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("id", "t", "m")), pa.array(np.full(len(found), k)), pa.array(found.ravel())], names=["id", "t", "m", "theta", "s0"])

    summed = parts.mapInArrow(sums, "id long, t long, m double, theta long, s0 double")
    named = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("mu", "k", "alpha", "c", "p"), astuple(th)[:5])]) for th in candidates])
    return summed.withColumn("th", named[F.col("theta").cast("int")]).select(
        "theta", "th.*", "id", "t", "m", (F.col("th.mu") + F.col("th.k") * F.greatest("s0", F.lit(0.0))).alias("rate")
    )


def intensity_at_events(series: DataFrame, theta: Triggering, window_days: float, crowd: int = _CROWD) -> DataFrame:
    """(id, t, m, rate): intensity at each event. `series` has canonical_id, t_us, mag.

    Predecessors are at most `window_days` old; at equal times the lower id counts as the earlier event,
    with a lag of zero.
    """
    window_us = int(window_days * DAY_US)
    return _rates(_tiles(series, window_us, crowd)[1], [theta], window_us).select("id", "t", "m", "rate")


def _neg_loglik(rates: DataFrame, m0: float, first_us: int, last_us: int) -> DataFrame:
    """(theta, neg_loglik) from the rates at events and the closed-form integral."""
    rest = days_between(F.lit(last_us), F.col("t"))
    offspring = productivity(F.col("m"), F.col("k"), F.col("alpha"), m0) * decay_integral(rest, F.col("c"), F.col("p"))
    rate = F.col("rate")
    summed = rates.groupBy("theta").agg(
        (F.sum(offspring - F.ln(F.when(rate > 0, rate))) + F.max("mu") * F.lit((last_us - first_us) / DAY_US)).alias("v"),
        F.count_if(rate <= 0).alias("bad"),
    )
    v = F.col("v")
    impossible = (F.col("bad") > 0) | v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(math.inf))
    return summed.select("theta", F.when(impossible, F.lit(PENALTY)).otherwise(v).alias("neg_loglik"))


def log_likelihood(
    series: DataFrame, candidates: Sequence[Triggering], first_us: int, last_us: int, window_days: float, crowd: int = _CROWD
) -> DataFrame:
    """(theta, neg_loglik) per candidate over [first, last]; impossible parameters or rates score the penalty."""
    window_us = int(window_days * DAY_US)
    valid = [k for k, theta in enumerate(candidates) if theta.valid()]
    usable = [candidates[k] for k in valid]
    scored = _neg_loglik(_rates(_tiles(series, window_us, crowd)[1], usable, window_us), usable[0].m0, first_us, last_us)
    index = F.array(*[F.lit(k).cast("long") for k in valid])
    scored = scored.select(index[F.col("theta").cast("int")].alias("theta"), "neg_loglik")
    rejected = [(k, PENALTY) for k in range(len(candidates)) if k not in valid]
    if not rejected:
        return scored
    return scored.unionByName(series.sparkSession.createDataFrame(rejected, "theta long, neg_loglik double"))


def start_point(n_events: int, span_days: float, m0: float) -> Triggering:
    # The usual starting point of the search.
    return Triggering(0.5 * n_events / max(span_days, 1.0), 0.1, 1.5, 0.05, 1.1, m0)


#: Box of the search, wide enough for any catalog: without clustering the optimum lies on its edge instead of at infinity.
BOUNDS = {"mu": (1e-6, 1e4), "k": (1e-8, 1e3), "alpha": (1e-3, 5.0), "c": (1e-4, 50.0), "p": (0.3, 5.0)}


@dataclass(frozen=True)
class Fit:
    theta: Triggering
    score: float
    start_score: float
    rounds: int
    converged: bool
    at_bound: bool


def _event_terms(theta: Triggering, last_us: int, t: np.ndarray, m: np.ndarray, s: Sequence[np.ndarray]) -> list[float]:
    """Of some events: score without background, gradient (5) and outer products (15), all in logarithms of the parameters."""
    m = m - theta.m0
    rate = theta.mu + theta.k * s[0]
    slope = np.column_stack((np.full(len(t), theta.mu), theta.k * s[0], theta.alpha * theta.k * s[1], -theta.p * theta.c * theta.k * s[2], -theta.p * theta.k * s[3])) / rate[:, None]
    rest, q, size = (last_us - t) / DAY_US + theta.c, 1 - theta.p, theta.k * np.exp(theta.alpha * m)
    a, b = np.log(rest), math.log(theta.c)
    if abs(q) < 1e-8:
        area, by_p = a - b, -(a * a - b * b) / 2
    else:
        area = (rest**q - theta.c**q) / q
        by_p = -((rest**q * a - theta.c**q * b) / q - area / q)
    by_c = rest**-theta.p - theta.c**-theta.p
    expected = np.column_stack((np.zeros(len(t)), size * area, size * area * m * theta.alpha, size * by_c * theta.c, size * by_p * theta.p))
    return [(size * area).sum() - np.log(rate).sum(), *(expected - slope).sum(axis=0), *(slope.T @ slope)[np.triu_indices(5)]]


def _score_and_slopes(rows: DataFrame, parts: DataFrame, theta: Triggering, first_us: int, last_us: int, window_us: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(negative log-likelihood, gradient, outer-product curvature) at `theta`: two readings of the parts, one row per part on the driver.

    Of the six sums (plain and weighted by magnitude, for three columns of the exponentials) four are needed.
    """
    run = _summed(parts, [theta], window_us, 2, 3)

    def terms(batches):
        for _, kept, s in run(batches):
            sums = (np.maximum(s[:, 0, 0], 0.0), s[:, 1, 0], s[:, 0, 1], s[:, 0, 2])
            values = _event_terms(theta, last_us, kept.column("t").to_numpy(), kept.column("m").to_numpy(zero_copy_only=False), sums)
            yield pa.RecordBatch.from_pydict({"v": pa.array([[float(v) for v in values]], pa.list_(pa.float64()))})

    row = np.sum([r["v"] for r in parts.mapInArrow(terms, "v array<double>").collect()], axis=0)
    background = theta.mu * (last_us - first_us) / DAY_US
    curvature = np.zeros((5, 5))
    curvature[np.triu_indices(5)] = row[6:]
    curvature += np.triu(curvature, 1).T
    return row[0] + background, row[1:6] + np.array([background, 0, 0, 0, 0]), curvature


def fit(
    series: DataFrame, first_us: int, last_us: int, m0: float, window_days: float,
    start: Triggering | None = None, rounds: int = 200, tolerance: float = 1e-4, crowd: int = _CROWD,
) -> Fit:
    """Maximum-likelihood parameters by damped Newton steps on their logarithms within BOUNDS.

    The curvature is the sum of outer products of the events' slopes. The search has converged when the step at hand
    promises to gain less than `tolerance` of log-likelihood; without that within `rounds` evaluations it raises.
    """
    window_us = int(window_days * DAY_US)
    rows, parts = _tiles(series.select("canonical_id", "t_us", "mag"), window_us, crowd)
    if start is None:
        start = start_point(series.count(), (last_us - first_us) / DAY_US, m0)
    low, high = (np.log([BOUNDS[n][side] for n in BOUNDS]) for side in (0, 1))
    as_theta = lambda logs: replace(start, **{n: math.exp(v) for n, v in zip(BOUNDS, logs)})
    point = np.clip(np.log(astuple(start)[:5]), low, high)
    score, slope, curvature = _score_and_slopes(rows, parts, as_theta(point), first_us, last_us, window_us)
    begun, damping = score, 1e-3
    for used in range(1, rounds + 1):
        # parameters that the slope presses against a bound stay there
        free = ~(((point <= low) & (slope > 0)) | ((point >= high) & (slope < 0)))
        g, h = slope[free], curvature[np.ix_(free, free)]
        ridge = 1e-9 * max(1.0, float(np.trace(h))) * np.eye(len(g))
        if not len(g) or g @ np.linalg.solve(h + ridge, g) / 2 < tolerance:
            return Fit(as_theta(point), float(score), float(begun), used, True, bool((~free).any()))
        step = np.zeros(5)
        step[free] = -np.linalg.solve(h + damping * np.diag(np.diag(h)) + ridge, g)
        trial = np.clip(point + np.clip(step, -1.5, 1.5), low, high)
        if np.abs(trial - point).max() < 1e-9:
            return Fit(as_theta(point), float(score), float(begun), used, True, bool((~free).any()))
        new = _score_and_slopes(rows, parts, as_theta(trial), first_us, last_us, window_us)
        if np.isfinite(new[0]) and new[0] <= score:
            point, (score, slope, curvature), damping = trial, new, max(damping / 4, 1e-9)
        else:
            damping = max(damping * 6, 1e-3)
    raise RuntimeError(f"no optimum within {rounds} evaluations; last score {score}")


def plausibility(theta: Triggering, b: float, span_days: float, n_events: int, spark) -> DataFrame:
    """(name, value, low, high, ok) plus the background share mu*T/N without bounds."""
    ratio = branching_ratio(F.lit(theta.k), F.lit(theta.alpha), F.lit(theta.c), F.lit(theta.p), b)
    values = {"p": F.lit(theta.p), "c": F.lit(theta.c), "alpha_ln10": F.lit(theta.alpha / math.log(10.0)), "n": ratio, "background_share": F.lit(theta.mu * span_days / n_events)}
    limits = {name: (low, high) for name, low, high in PLAUSIBLE_RANGES}
    rows = [F.struct(F.lit(n).alias("name"), v.cast("double").alias("value"), *(F.lit(x).cast("double").alias(k) for k, x in zip(("low", "high"), limits.get(n, (None, None))))) for n, v in values.items()]
    table = spark.range(1).select(F.inline(F.array(*rows)))
    return table.withColumn("ok", F.col("value").between(F.col("low"), F.col("high")))


def intensity_curve(series: DataFrame, theta: Triggering, first_us: int, step_us: int, n: int) -> DataFrame:
    """(k, t_us, intensity) at n regular instants from the whole earlier history (strictly before t).

    Each event is copied to the instants after it and summed map-side, so only n rows are shuffled.
    """
    since = F.col("t_us") - F.lit(first_us)
    first = F.greatest((since - F.pmod(since, F.lit(step_us))) / F.lit(step_us) + 1, F.lit(0)).cast("long")
    reached = series.filter(first < n).select("t_us", "mag", F.explode(F.sequence(first, F.lit(n - 1).cast("long"))).alias("k"))
    instant = F.lit(first_us) + F.col("k") * F.lit(step_us)
    sums = reached.groupBy("k").agg(F.sum(theta.kernel(F.col("mag"), days_between(instant, F.col("t_us")))).alias("s"))
    instants = series.sparkSession.range(n).withColumnRenamed("id", "k")
    return instants.join(sums, "k", "left").select("k", instant.alias("t_us"), (F.lit(theta.mu) + F.coalesce("s", F.lit(0.0))).alias("intensity"))
