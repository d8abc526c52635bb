import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tremora.functions.geo import haversine_km, in_box
from tremora.functions.magnitude import to_mw
from tremora.functions.rates import Triggering, branching_ratio, chi_square_tail, decay_integral, extrapolated_rate, poisson_probability
from tremora.operators import context, epoch, frequency, metrics, triggering
from tremora.operators.ranking import dense_ids, exact_quantiles, prefix_sums


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# --- magnitudes ---


@pytest.mark.parametrize("mag, kind, mw, method", [
    (6.3, "mww", 6.3, "direct"), (5.1, "Mw", 5.1, "direct"), (5.0, "Ms", 5.42, "scordilis_ms"), (7.0, "Ms", 7.01, "scordilis_ms"), (4.0, "mb", 4.43, "scordilis_mb"),
    (3.2, "ML", 3.2, "assume_ml"), (2.9, "Md", 2.9, "assume_md"), (4.1, "m", 4.1, "assume_unknown"), (None, "mb", None, "none"), (4.5, None, 4.5, "assume_unknown"),
])
def test_to_mw(spark, mag, kind, mw, method):
    got = value(spark, to_mw(F.lit(mag).cast("double"), F.lit(kind).cast("string")))
    assert got["method"] == method and got["mw"] == (None if mw is None else pytest.approx(mw))


# --- frequency-magnitude law ---


def law(spark, b, lowest, total, below=()):
    """A catalog with exactly the expected number of events in every bin of 0.1, and some bins below `lowest` with given counts."""
    ratio = 10 ** (-0.1 * b)
    bins = [(round(lowest + 0.1 * k, 1), round(total * (1 - ratio) * ratio**k)) for k in range(80)]
    bins += [(round(lowest - 0.1 * (k + 1), 1), n) for k, n in enumerate(below)]
    table = spark.createDataFrame([x for x in bins if x[1] > 0], "m double, copies int")
    return table.select("m", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("m"), dict(bins)


def test_distribution_counts_every_bin(spark):
    df, bins = law(spark, 1.2, 2.6, 40_000, below=(5000, 800))
    got = frequency.frequency_distribution(df, "m").orderBy("center").toPandas()
    assert {round(c, 1): n for c, n in zip(got.center, got.n_bin) if n} == {m: n for m, n in bins.items() if n}
    assert got.n_cum.tolist() == got.n_bin[::-1].cumsum()[::-1].tolist()


@pytest.mark.parametrize("b, lowest", [(0.7, 3.4), (1.0, 4.1), (1.3, 2.2)])
def test_slope_of_an_exact_law(spark, b, lowest):
    df, bins = law(spark, b, lowest, 80_000)
    got = frequency.b_value(df, "m", lowest).first()
    assert got["n"] == sum(bins.values()) and got["b"] == pytest.approx(b, abs=0.01)
    assert got["sigma_b"] == pytest.approx(b / math.sqrt(80_000), rel=0.3)
    assert got["a"] == pytest.approx(math.log10(got["n"]) + got["b"] * lowest, abs=0.05)


def test_completeness_of_a_thinned_law(spark):
    """Below 3.4 ever fewer events are seen, so the fullest bin is 3.4; the fit finds the first cutoff that a law describes."""
    df, bins = law(spark, 1.1, 3.4, 60_000, below=(9000, 4000, 1500, 300))
    assert frequency.completeness_peak(df, "m", correction=0.0).first()["mc"] == pytest.approx(3.4)
    assert frequency.completeness_peak(df, "m", correction=0.1).first()["mc"] == pytest.approx(3.5)
    fit = frequency.completeness_fit(df, "m").first()
    assert 3.3 <= fit["mc"] <= 3.5 and fit["r"] >= 90 and fit["b"] == pytest.approx(1.1, abs=0.15)


def test_thin_data_has_no_law(spark):
    one = spark.createDataFrame([(4.2,)], "m double")
    got = frequency.b_value(one, "m", 4.0).first()
    assert got["n"] == 1 and got["b"] is None
    assert frequency.completeness_fit(one, "m").first()["mc"] is None


# --- seasonality ---


def test_published_chi_square(spark):
    counts = [168, 155, 138, 149, 171, 287, 189, 238, 130, 191, 182, 132]
    monthly = spark.createDataFrame([(k + 1, n) for k, n in enumerate(counts)], "month long, n long")
    assert context.chi_square(monthly).first()["chi2"] == pytest.approx(131.81, abs=0.005)
    assert context.chi_square_p(monthly).first()["p"] == pytest.approx(0.0, abs=1e-9)
    assert context.chi_square_p(monthly.withColumn("n", F.lit(0))).first()["p"] is None


@pytest.mark.parametrize("df", [1, 2, 11, 24, 999, 1000])
def test_chi_square_tail(spark, df):
    """Against the finite sums that hold for whole and half shapes, from far below to far above the mean."""

    def closed(x):
        # a term of shape a adds to the tail what it takes to get from a to a + 1
        whole = df % 2 == 0
        tail, a = (math.exp(-x), 1.0) if whole else (math.erfc(math.sqrt(x)), 0.5)
        while a < df / 2:
            tail += math.exp(a * math.log(x) - x - math.lgamma(a + 1))
            a += 1
        return tail

    xs = [df * f for f in (0.01, 0.3, 0.7, 0.95, 1.0, 1.05, 1.3, 2.0, 4.0)] + [df + 1.999, df + 2.0, df + 2.001]
    found = spark.createDataFrame([(float(x),) for x in xs] + [(0.0,), (None,)], "x double").select("x", chi_square_tail(F.col("x"), df).alias("p")).collect()
    for r in found[:-2]:
        assert r["p"] == pytest.approx(closed(r["x"] / 2), rel=1e-9, abs=1e-11), r
    assert found[-2]["p"] == 1.0 and found[-1]["p"] is None


def test_gap_groups_across_partitions(spark):
    times = [0, 10, 25, 1000, 1005, 2010]
    df = spark.createDataFrame(list(enumerate(times)), "canonical_id long, t_us long")
    got = context.gap_groups(df.repartition(5), gap_us=20).orderBy("t_us").toPandas()
    assert got.starts_chain.tolist() == [True, False, False, True, False, True]
    assert got.gap_us.iloc[1:].astype(int).tolist() == [10, 15, 975, 5, 1005]


# --- rates and scores ---


def test_rates(spark):
    p = [value(spark, poisson_probability(F.lit(r), 30)) for r in (0.0, 1.0, 10.0)]
    assert p[0] == 0.0 and p[0] < p[1] < p[2] <= 1
    assert value(spark, extrapolated_rate(F.lit(10), F.lit(1.0), 1.0, 6.0, 5.0)) == pytest.approx(1.0)


def predictions(spark, y, p, ref=None):
    return spark.createDataFrame(pd.DataFrame({"model": "x", "y": y, "p": np.asarray(p, float), "ref": np.asarray(p if ref is None else ref, float)}))


def test_hand_computed_scores(spark):
    """Four forecasts: Brier (0.04 + 0.16 + 0.09 + 0.01) / 4; three of the four pairs rank rightly."""
    got = metrics.evaluate(predictions(spark, [0, 1, 1, 0], [0.2, 0.6, 0.7, 0.1], [0.5] * 4), ["model"], p_ref="ref").first()
    assert got["brier"] == pytest.approx(0.075) and got["roc_auc"] == 1.0 and got["bss"] == pytest.approx(1 - 0.075 / 0.25)
    mixed = metrics.evaluate(predictions(spark, [1, 0, 1, 0], [0.2, 0.6, 0.7, 0.1]), ["model"]).first()
    assert mixed["roc_auc"] == pytest.approx(0.75) and mixed["pr_auc"] == pytest.approx((1 + 2 / 3) / 2)


def test_reference_is_read_with_the_predictions(spark):
    """Skill against a reference that varies by row, and against the forecast itself."""
    y, p, ref = [1, 0, 0, 1, 0, 0], [0.8, 0.3, 0.3, 0.4, 0.1, 0.0], [0.5, 0.2, 0.4, 0.3, 0.1, 0.6]
    error = lambda q: sum((a - b) ** 2 for a, b in zip(y, q)) / len(y)
    assert metrics.evaluate(predictions(spark, y, p, ref), ["model"], p_ref="ref").first()["bss"] == pytest.approx(1 - error(p) / error(ref), abs=1e-6)
    assert metrics.evaluate(predictions(spark, y, p), ["model"], p_ref="ref").first()["bss"] == pytest.approx(0.0, abs=1e-12)


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_has_no_ranking(spark, label):
    got = metrics.evaluate(predictions(spark, [label] * 3, [0.2, 0.5, 0.5]), ["model"]).first()
    assert got["roc_auc"] is None and got["pr_auc"] is None and got["n"] == 3


def test_scores_against_direct_computation(spark):
    rng = np.random.default_rng(4)
    p = np.round(rng.random(3000), 2)
    y = (rng.random(3000) < p * 0.3).astype(int)
    got = metrics.evaluate(predictions(spark, y, p), ["model"]).first()
    q = np.clip(p, 1e-7, 1 - 1e-7)
    pos, neg = q[y == 1], q[y == 0]
    auc = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    ap, seen = 0.0, 0
    for level in sorted(set(q), reverse=True):
        hits = y[q == level].sum()
        seen += hits
        ap += hits / y.sum() * seen / (q >= level).sum()
    assert got["roc_auc"] == pytest.approx(auc) and got["pr_auc"] == pytest.approx(ap)
    assert got["logloss"] == pytest.approx(float(-np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))))


@pytest.mark.parametrize("strategy", ["quantile", "width"])
def test_reliability_bins(spark, strategy):
    """Scores 0.005, 0.015 ... with the label set in every fourth: each of five bins holds forty of them and a quarter of hits."""
    p = [(k + 0.5) / 200 for k in range(200)]
    got = metrics.reliability(predictions(spark, [int(k % 4 == 0) for k in range(200)], p), ["model"], strategy=strategy, n_bins=5).toPandas()
    assert got.n.tolist() == [40] * 5
    assert sorted(got.filter(regex="obs|freq").iloc[:, 0].round(6)) == [0.25] * 5
    constant = metrics.reliability(predictions(spark, [0, 1, 0], [0.3, 0.3, 0.3]), ["model"], strategy=strategy).toPandas()
    assert constant.n.tolist() == [3]


# --- orders ---


def test_orders_match_pandas(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 2000), "x": rng.random(2000), "v": rng.integers(0, 9, 2000)})
    df = spark.createDataFrame(pdf).repartition(7)
    got = prefix_sums(df, ["g"], ["x"], {"run": "v"}).toPandas().sort_values(["g", "x"]).reset_index(drop=True)
    assert (got.run == got.groupby("g").v.cumsum()).all()
    numbered = dense_ids(df, ["x"], "k").toPandas().sort_values("x")
    assert numbered.k.tolist() == list(range(1, 2001))
    q = exact_quantiles(df, ["g"], "x", [0.0, 0.1, 0.5, 0.93, 1.0]).toPandas()
    for r in q.itertuples():
        assert r.quantile == pytest.approx(np.quantile(pdf[pdf.g == r.g].x, r.q))


# --- triggering ---


@pytest.mark.parametrize("c, p, span", [(0.4, 1.0, 25.0), (0.4, 1.35, 25.0), (2.0, 0.8, 3.0)])
def test_decay_integral_is_the_area(spark, c, p, span):
    steps = np.linspace(0, span, 400_001)
    area = np.trapezoid((steps + c) ** -p, steps)
    assert value(spark, decay_integral(F.lit(span), F.lit(c), F.lit(p))) == pytest.approx(area, rel=1e-6)


def test_branching_ratio_is_a_mean(spark):
    """Mean productivity over the law's magnitudes, by summation, times the whole decay; none outside its domain."""
    k, alpha, c, p = 0.08, 1.1, 0.3, 1.6
    beta, m = 0.9 * math.log(10), np.linspace(0, 40, 400_001)
    mean = np.trapezoid(k * np.exp(alpha * m) * beta * np.exp(-beta * m), m)
    ratio = lambda a, q: value(spark, branching_ratio(F.lit(k), F.lit(a), F.lit(c), F.lit(q), 0.9))
    assert ratio(alpha, p) == pytest.approx(mean * c ** (1 - p) / (p - 1), rel=1e-5)
    assert ratio(alpha, 1.0) is None and ratio(beta, p) is None


def test_curve_of_one_event(spark):
    hour = 3_600_000_000
    series = spark.createDataFrame([(7, 5 * hour, 6.2)], "canonical_id long, t_us long, mag double")
    theta = Triggering(0.25, 0.4, 0.8, 0.2, 1.3, 5.0)
    got = [r["intensity"] for r in triggering.intensity_curve(series, theta, 0, hour, 30).orderBy("k").collect()]
    assert got[:6] == [0.25] * 6
    assert got[6:] == pytest.approx([0.25 + 0.4 * math.exp(0.8 * 1.2) * ((k - 5) / 24 + 0.2) ** -1.3 for k in range(6, 30)])


@pytest.mark.parametrize("crowd", [4096, 7])
def test_likelihood_against_direct_sum(spark, crowd):
    rng = np.random.default_rng(9)
    t = np.sort(rng.integers(0, 400 * 86_400, 150)) * 1_000_000
    t[40:60] = t[40]  # equal times count in id order
    m = np.round(4 + rng.exponential(0.4, 150), 1)
    series = spark.createDataFrame(pd.DataFrame({"canonical_id": np.arange(150), "t_us": t, "mag": m}))
    thetas = [Triggering(0.3, 0.05, 1.2, 0.05, 1.15, 4.0), Triggering(0.2, 0.02, 0.9, 0.3, 1.0, 4.0), Triggering(-1, 0.02, 0.9, 0.3, 1.0, 4.0)]
    got = {r["theta"]: r["neg_loglik"] for r in triggering.log_likelihood(series, thetas, 0, int(t[-1]), 60.0, crowd).collect()}
    d, last = t / 86_400e6, t[-1] / 86_400e6
    for k, th in enumerate(thetas[:2]):
        rate = np.array([th.mu + sum(th.k * math.exp(th.alpha * (m[j] - 4)) * (d[i] - d[j] + th.c) ** -th.p for j in range(i) if d[j] >= d[i] - 60) for i in range(150)])
        rest = last - d
        area = np.log((rest + th.c) / th.c) if th.p == 1 else ((rest + th.c) ** (1 - th.p) - th.c ** (1 - th.p)) / (1 - th.p)
        expected = th.mu * last + np.sum(th.k * np.exp(th.alpha * (m - 4)) * area) - np.log(rate).sum()
        assert got[k] == pytest.approx(expected, rel=1e-9)
    assert got[2] == 1e12


@pytest.mark.parametrize("c, p, span", [(0.398, 1.534, 365.0), (0.05, 1.0, 365.0), (1e-4, 0.3, 365.0), (50.0, 5.0, 10.0)])
def test_exponentials_are_the_decay(c, p, span):
    found, lag = triggering._exponentials(c, p, span), np.concatenate(([0.0], np.geomspace(c / 100, span, 200)))
    got, y = np.exp(-np.outer(lag, found.exponents)) @ found.weights, lag + c
    assert np.abs(got[:, 0] * y**p - 1).max() < 1e-11 and np.abs(got[:, 1] * y ** (p + 1) - 1).max() < 1e-11
    assert np.abs(got[:, 2] * y**p - np.log(y)).max() < 1e-9


@pytest.mark.parametrize("crowd", [65_536, 50])
def test_intensity_of_crowded_windows(spark, crowd):
    """Three rows per event are laid out however many share a window; ties, repeated rows, missing ids and events a whole window apart."""
    rng = np.random.default_rng(3)
    n, day = 900, 86_400_000_000
    t = np.sort(rng.integers(0, 12 * day, n))
    t[100:160], t[700] = t[100], t[300] + 5 * day
    rows = [(k, int(x), float(m)) for k, (x, m) in enumerate(zip(t, np.round(4.5 + rng.exponential(0.4, n), 1)))]
    rows += [*rows[120:123], (None, rows[100][1], 5.5), (None, rows[400][1], 6.0), (5, None, 5.0)]
    series = spark.createDataFrame(rows, "canonical_id long, t_us long, mag double")
    theta = Triggering(0.481, 0.171, 0.866, 0.398, 1.534, 4.5)
    assert triggering._tiles(series, 5 * day, crowd)[0].count() == 3 * (n + 2)
    got = {(r["id"], r["t"], r["m"]): r["rate"] for r in triggering.intensity_at_events(series, theta, 5.0, crowd).collect()}
    seen = [x for x in rows if x[1] is not None]
    earlier = lambda x, y: x[1] < y[1] or (x[1] == y[1] and None not in (x[0], y[0]) and x[0] < y[0])
    expected = {}
    for y in seen:
        part = sum(0.171 * math.exp(0.866 * (x[2] - 4.5)) * ((y[1] - x[1]) / day + 0.398) ** -1.534 for x in seen if earlier(x, y) and y[1] - x[1] <= 5 * day)
        expected[y] = expected.get(y, 0.481) + part
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(v, rel=1e-10) for k, v in expected.items())


def clustered(seed, days=400.0):
    """Background events and, for each, followers in two generations whose delays follow a power law."""
    r = np.random.default_rng(seed)
    times = list(r.uniform(0, days, 160))
    for parents in (list(times), None):
        parents = parents if parents is not None else times[160:]
        for x in parents:
            times += [x + 0.05 * ((1 - u) ** (-1 / 0.4) - 1) for u in r.random(r.poisson(0.5))]
    t = np.sort([x for x in times if x < days])
    return pd.DataFrame({"canonical_id": np.arange(len(t)), "t_us": (t * 86_400e6).astype("int64"), "mag": 4.5 + np.round(r.exponential(0.4, len(t)), 1)})


def test_readings_of_the_fit_are_short(spark):
    """Half the exponentials, one row per part, no more tasks than cores, rows of one instant in one step, no leaving for fast exponentials."""
    found = triggering._exponentials(0.05, 1.1, 365.0)
    assert len(found.exponents) < 70
    day, n = 86_400_000_000, 3000
    series = spark.createDataFrame([(k, (k // 3) * day, 5.0) for k in range(n)], "canonical_id long, t_us long, mag double")
    _, parts = triggering._tiles(series, 365 * day, 100)
    held = parts.collect()
    assert len(held) > 20 and parts.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    theta, asked = Triggering(0.3, 0.05, 0.7, 0.05, 1.1, 4.5), 0
    for _, rows in triggering._unpacked([pa.RecordBatch.from_pydict({"part": [r["part"]], "rows": pa.array([bytes(r["rows"])], pa.binary())}) for r in held]):
        steps = triggering._steps(rows, theta, 1)
        slow, fast = triggering._halves(steps, found, 365.0)
        assert len(steps.at) == len(set(rows.column("at").to_pylist())) and len(slow[1]) == len(steps.at)
        assert fast[3] is None and len(fast[1]) == len({a for a, k in zip(rows.column("at").to_pylist(), rows.column("kind").to_pylist()) if k != triggering._LEAVE})
        asked += len(steps.asks)
    assert asked == n


def test_slopes_are_derivatives(spark):
    series = spark.createDataFrame(clustered(5))
    theta, width = Triggering(0.3, 0.05, 0.7, 0.08, 1.3, 4.5), 100 * 86_400_000_000
    now, before = triggering._tiles(series, width, 50)
    score, slope, _ = triggering._score_and_slopes(now, before, theta, 0, int(400 * 86_400e6), width)
    for k, name in enumerate(("mu", "k", "alpha", "c", "p")):
        sides = [replace(theta, **{name: getattr(theta, name) * math.exp(h)}) for h in (1e-4, -1e-4)]
        up, down = (r["neg_loglik"] for r in triggering.log_likelihood(series, sides, 0, int(400 * 86_400e6), 100.0).orderBy("theta").collect())
        assert slope[k] == pytest.approx((up - down) / 2e-4, rel=1e-3, abs=1e-3)
    assert triggering.log_likelihood(series, [theta], 0, int(400 * 86_400e6), 100.0).first()["neg_loglik"] == pytest.approx(score)


def test_fit_finds_the_optimum_from_two_sides(spark):
    series, last = spark.createDataFrame(clustered(11)), int(400 * 86_400e6)
    one = triggering.fit(series, 0, last, 4.5, 200.0)
    two = triggering.fit(series, 0, last, 4.5, 200.0, start=Triggering(0.9, 0.01, 0.5, 0.3, 1.6, 4.5))
    assert one.converged and two.converged and one.score < one.start_score and two.score < two.start_score
    assert one.score == pytest.approx(two.score, abs=0.01)
    assert 0.25 < one.theta.mu < 0.6 and 1.1 < one.theta.p < 2.2 and not one.at_bound


def test_fit_without_clustering_ends_at_the_edge(spark):
    t = (np.arange(300) * 86_400e6).astype("int64")
    series = spark.createDataFrame(pd.DataFrame({"canonical_id": np.arange(300), "t_us": t, "mag": np.full(300, 5.0)}))
    found = triggering.fit(series, 0, int(t[-1]), 5.0, 100.0)
    assert found.converged and found.theta.mu == pytest.approx(1.0, rel=0.1)


def test_fit_that_does_not_end_is_an_error(spark):
    with pytest.raises(RuntimeError):
        triggering.fit(spark.createDataFrame(clustered(5)), 0, int(400 * 86_400e6), 4.5, 100.0, rounds=1)


# --- random times ---


@pytest.mark.parametrize("small", [400_000, 0])
def test_the_draws_are_not_the_broadcast_side(spark, monkeypatch, small):
    """Their number is not known to the planner, which takes them for as few as the triggers."""
    monkeypatch.setattr(epoch, "_SMALL", small)
    triggers = spark.range(5).selectExpr("id AS canonical_id", "id * 1000 AS t_us")
    targets = spark.range(40).selectExpr("CASE WHEN id < 38 THEN (id * 7919) % 90 * 1000000000L WHEN id = 38 THEN 0L END AS t_us")
    null = epoch.null_counts(triggers, targets, 0, 100 * 86_400_000_000, days=[1, 7], draws=20)
    join = next(line for line in null._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join [" in line)
    assert ("BuildRight" if small else "SortMergeJoin") in join
    times = sorted(r[0] for r in targets.collect() if r[0] is not None)
    starts = triggers.selectExpr("canonical_id AS i").crossJoin(spark.range(1, 21).withColumnRenamed("id", "draw")).crossJoin(spark.createDataFrame([(1,), (7,)], "days long"))
    expected = {}
    for r in starts.withColumn("u", epoch.uniform_draw(F.col("draw"), F.col("i"), F.col("days"))).collect():
        width = r["days"] * 86_400_000_000
        begin = math.floor(r["u"] * float(100 * 86_400_000_000 - width))
        key = (r["days"], r["draw"])
        expected[key] = expected.get(key, 0) + sum(begin < x <= begin + width for x in times)
    assert {(r["days"], r["draw"]): r["n"] for r in null.collect()} == expected


def test_draws_are_independent_and_uniform(spark):
    """The distance between two items' draws varies from draw to draw, and the null has the spread of independent draws."""
    draws = spark.range(1, 2001).select(*[epoch.uniform_draw(F.col("id"), F.lit(i), F.lit(7)).alias(f"u{i}") for i in (11, 977)]).toPandas()
    offset = (draws.u11 - draws.u977) % 1
    assert offset.std() == pytest.approx(math.sqrt(1 / 12), rel=0.05)
    assert abs(np.corrcoef(draws.u11, draws.u977)[0, 1]) < 0.08 and draws.u11.mean() == pytest.approx(0.5, abs=0.03)


def test_null_spread_on_a_clustered_target(spark):
    day, r = 86_400_000_000, np.random.default_rng(6)
    times = np.concatenate([r.integers(0, 1000 * day, 60), 500 * day + r.integers(0, 5 * day, 240)])
    targets = spark.createDataFrame([(int(x),) for x in times], "t_us long")
    triggers = spark.createDataFrame([(k, k * day) for k in range(12)], "canonical_id long, t_us long")
    got = epoch.null_counts(triggers, targets, 0, 1000 * day, days=(30,), draws=800).toPandas()
    ordered, start = np.sort(times), r.uniform(0, 970 * day, (4000, 12))
    own = (np.searchsorted(ordered, start + 30 * day, "right") - np.searchsorted(ordered, start, "right")).sum(axis=1)
    assert len(got) == 800 and got.n.mean() == pytest.approx(own.mean(), rel=0.1) and got.n.std() == pytest.approx(own.std(), rel=0.1)


def test_followers_against_direct_counts(spark):
    r = np.random.default_rng(2)
    times = sorted([int(x) for x in r.integers(0, 1000, 50)] + [400] * 30)
    starts = [(k % 3, int(x), int(w)) for k, (x, w) in enumerate(zip(r.integers(-100, 1100, 60), r.integers(0, 300, 60)))] + [(0, 399, 1), (1, 400, 5)]
    got = epoch.followers(spark.createDataFrame(starts, "g int, s long, w long"), spark.createDataFrame([(x,) for x in times], "t_us long"), ["g"], "s", "w").collect()
    assert {x["g"]: x["n"] for x in got} == {g: sum(s < x <= s + w for h, s, w in starts if h == g for x in times) for g in range(3)}
    none = epoch.followers(spark.createDataFrame(starts, "g int, s long, w long"), spark.createDataFrame([], "t_us long"), ["g"], "s", "w")
    assert [x["n"] for x in none.collect()] == [0, 0, 0]


def test_settings_share_their_random_times(spark):
    """All settings and thresholds in one pass over the draws give what each gives alone."""
    day, r = 86_400_000_000, np.random.default_rng(8)
    rows = [(k, int(r.integers(0, 400 * day)), float(r.uniform(-30, -15)), float(r.uniform(-75, -67)), float(r.choice([4.0, 5.0, 6.2, 6.8]))) for k in range(120)]
    rows += [rows[5], (None, 7 * day, -20.0, -70.0, 6.9), (500, None, -20.0, -70.0, 6.9), (501, day, -20.0, -70.0, None), (502, None, -15.0, -70.0, 5.0)]
    events = spark.createDataFrame(rows, "canonical_id long, t_us long, latitude double, longitude double, preferred_mw double")
    events = events.withColumn("country", F.when(F.col("latitude") > -18.0, "Peru"))
    got = epoch.distance_controlled(events, (6.0, 6.5, 9.0), 4.5, 0, 400 * day, draws=30)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("sequence(1, 30") <= 1 and got._jdf.queryExecution().analyzed().toString().count("md5(") == 1
    km = haversine_km(F.col("latitude"), F.col("longitude"), F.lit(epoch.SOUTH_CENTROID[0]), F.lit(epoch.SOUTH_CENTROID[1]))
    strong = events.filter(in_box(F.col("latitude"), F.col("longitude"), epoch.COUNTRY_BOXES["Chile"]))
    large = events.filter("preferred_mw >= 4.5")
    goals = {"whole": large.filter("country = 'Peru'"), "near": large.filter(in_box(F.col("latitude"), F.col("longitude"), epoch.SOUTH_TARGET_BOX))}
    expected = {}
    for setting in ("whole", "near", "remote"):
        for threshold in (6.0, 6.5, 9.0):
            triggers = strong.filter((F.col("preferred_mw") >= threshold) & (km >= 600.0 if setting == "remote" else F.lit(True)))
            for x in epoch.epoch_test(triggers, goals["whole" if setting == "whole" else "near"], 0, 400 * day, draws=30).collect():
                expected[setting, threshold, x["days"]] = [x[c] for c in ("observed", "expected", "rate_ratio", "beta", "p", "n_triggers")]
    found = {(x["setting"], x["threshold"], x["days"]): [x[c] for c in ("observed", "expected", "rate_ratio", "beta", "p", "n_triggers")] for x in got.collect()}
    assert found.keys() == expected.keys() and len(found) == 24
    assert all(found[k] == pytest.approx(expected[k]) for k in expected)


def test_counts_after_windows_are_looked_up_without_a_checkpoint(spark):
    """Times crowded into one bucket take several rows of it."""
    times = [*range(40), 10**9]
    starts = [(k % 2, s, w) for k, (s, w) in enumerate([(-5, 10), (3, 30), (20, 10**6), (39, 10**9), (10, 2 * 10**9)])]
    got = epoch.followers(spark.createDataFrame(starts, "g int, s long, w long"), spark.createDataFrame([(x,) for x in times], "t_us long"), ["g"], "s", "w")
    assert "ExistingRDD[bucket" not in got._jdf.queryExecution().sparkPlan().toString()
    assert {x["g"]: x["n"] for x in got.collect()} == {g: sum(s < x <= s + w for h, s, w in starts if h == g for x in times) for g in range(2)}
