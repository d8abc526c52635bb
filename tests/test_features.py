from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremora.functions.geo import Lattice
from tremora.functions.rates import Triggering
from tremora.operators import features, forecasting, metrics
from tremora.operators.features import FeatureSpec, feature_table

DAY = 86_400_000_000


def us(*date):
    return int(datetime(*date, tzinfo=timezone.utc).timestamp()) * 1_000_000


NOW = us(2016, 9, 15)
# (days before NOW, latitude, longitude, magnitude): one active cell, the cell north of it, and one far off
HISTORY = [
    (3, -9.62, -78.88, 4.3), (20, -9.70, -78.80, 5.1), (75, -9.55, -78.99, 4.4), (300, -9.62, -78.88, 4.9), (500, -9.62, -78.88, 5.6),
    (40, -9.38, -78.88, 4.7), (10, -15.10, -75.20, 5.0),
]


def catalog(spark, extra=()):
    rows = [(NOW - int(d * DAY), lat, lon, m) for d, lat, lon, m in [*HISTORY, *extra]]
    return spark.createDataFrame(rows, "t_us long, latitude double, longitude double, preferred_mw double")


def spec(**more):
    return FeatureSpec(lattice=Lattice(0.25), min_mag=4.0, start_us=NOW, end_us=NOW, min_active_events=1, **more)


def cell_row(spark, extra=(), i=35, j=10):
    return feature_table(catalog(spark, extra), spec()).filter((F.col("i") == i) & (F.col("j") == j)).first().asDict()


def test_windows_of_one_cell(spark):
    got = cell_row(spark)
    assert got["cell_id"] == 35 * 54 + 10
    assert [got[f"cnt_{w}"] for w in ("7d", "30d", "90d", "365d", "all")] == [1, 2, 3, 4, 5]
    assert got["nb_cnt_365d"] == 5 and got["nb_cnt_30d"] == 2 and got["maxmag_365d"] == 5.1 and got["nb_maxmag_365d"] == 5.1
    assert got["days_since_last"] == pytest.approx(3.0) and got["days_since_M5"] == pytest.approx(20.0)
    assert got["cen_lat"] == pytest.approx(-9.625) and got["cen_lon"] == pytest.approx(-78.875)
    north = cell_row(spark, i=36)
    assert (north["cnt_all"], north["nb_cnt_365d"], north["maxmag_365d"]) == (1, 5, 4.7)


def test_what_comes_later_reaches_only_targets(spark):
    plain = cell_row(spark)
    later = cell_row(spark, [(-2, -9.62, -78.88, 5.2), (-25, -9.62, -78.88, 6.1), (-31, -9.62, -78.88, 7.0)])
    assert {k: v for k, v in plain.items() if k[:2] != "y_"} == {k: v for k, v in later.items() if k[:2] != "y_"}
    assert (plain["y_m5_7d"], plain["y_m5_30d"], plain["y_m6_30d"]) == (0, 0, 0)
    assert (later["y_m5_7d"], later["y_m5_30d"], later["y_m6_30d"]) == (1, 1, 1)
    late = cell_row(spark, [(-8, -9.62, -78.88, 5.0), (-30.5, -9.62, -78.88, 6.5)])
    assert (late["y_m5_7d"], late["y_m5_30d"], late["y_m6_30d"]) == (0, 1, 0)


def test_edges_do_not_wrap(spark):
    # Column 0 of one row must not see the last column of the row below.
    rows = [(NOW - 50 * DAY, -11.9, -81.4, 5.0), (NOW - 50 * DAY, -12.1, -68.1, 5.0)]
    df = spark.createDataFrame(rows, "t_us long, latitude double, longitude double, preferred_mw double")
    assert [r["nb_cnt_365d"] for r in feature_table(df, spec()).collect()] == [1, 1]


def test_against_direct_windows(spark):
    rng = np.random.default_rng(7)
    n = 400
    pdf = pd.DataFrame({
        "t_us": us(2009, 6, 1) + rng.integers(0, 700 * 86_400, n) * 1_000_000,
        "latitude": -12 + rng.uniform(-2.0, 2.0, n), "longitude": -77 + rng.uniform(-2.0, 2.0, n), "preferred_mw": np.round(4 + rng.exponential(0.6, n), 1),
    })
    pdf.loc[: n // 3, ["latitude", "longitude"]] = (-12.1, -77.1)  # a third of all rows in one cell
    # Events exactly at an instant and at window limits.
    pdf.loc[0:3, "t_us"] = [us(2010, 3, 1), us(2010, 3, 1) - 30 * DAY, us(2010, 3, 1) + 30 * DAY, us(2010, 3, 1) - 365 * DAY]
    theta = Triggering(0.4, 0.2, 0.9, 0.3, 1.3, 4.0)
    s = FeatureSpec(lattice=Lattice(0.5), min_mag=4.0, start_us=us(2010, 3, 1), end_us=us(2010, 11, 1), step_days=30, min_active_events=3, triggering=theta, triggering_window_days=200)
    got = feature_table(spark.createDataFrame(pdf).repartition(5), s).toPandas()
    pdf["i"], pdf["j"] = np.floor((pdf.latitude + 18.5) / 0.5), np.floor((pdf.longitude + 81.5) / 0.5)
    counts = pdf.groupby(["i", "j"]).size()
    assert len(got) == (counts >= 3).sum() * 9
    for r in got.itertuples():
        cell = pdf[(pdf.i == r.i) & (pdf.j == r.j)]
        near = pdf[(abs(pdf.i - r.i) <= 1) & (abs(pdf.j - r.j) <= 1)]
        past = lambda d, w: d[(d.t_us <= r.t_us) & (d.t_us > r.t_us - w * DAY)]
        ahead = cell[(cell.t_us > r.t_us) & (cell.t_us <= r.t_us + 30 * DAY)]
        assert (r.cnt_7d, r.cnt_30d, r.cnt_90d, r.cnt_365d) == tuple(len(past(cell, w)) for w in (7, 30, 90, 365))
        assert r.cnt_all == (cell.t_us <= r.t_us).sum() and r.nb_cnt_30d == len(past(near, 30)) and r.nb_cnt_365d == len(past(near, 365))
        assert r.reg_cnt_30d == len(past(pdf, 30)) and r.reg_maxmag_30d == (past(pdf, 30).preferred_mw.max() if len(past(pdf, 30)) else 0)
        assert r.y_m5_30d == int((ahead.preferred_mw >= 5).any()) and r.y_m6_30d == int((ahead.preferred_mw >= 6).any())
        assert r.logE_365d == pytest.approx(np.log10(1 + (10 ** (1.5 * past(cell, 365).preferred_mw)).sum()))
        w = past(near, 200)
        lag = (r.t_us - w.t_us) / DAY
        assert r.etas_nb == pytest.approx(np.log1p((0.2 * np.exp(0.9 * (w.preferred_mw - 4)) * (lag + 0.3) ** -1.3).sum()))
        known = cell[cell.t_us <= r.t_us].t_us
        assert r.days_since_last == pytest.approx((r.t_us - known.max()) / DAY if len(known) else 99_999.0)


def test_active_cells_can_ignore_the_future(spark):
    df = catalog(spark, [(-9, -9.62, -78.88, 5.0)])  # a sixth event in the active cell, nine days later
    assert features.active_cells(features.grid_events(df, spec()), 6).count() == 1
    early = FeatureSpec(lattice=Lattice(0.25), min_mag=4.0, start_us=NOW, end_us=NOW, min_active_events=6, active_until_us=NOW)
    assert feature_table(df, early).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    """Labels follow a step in one column and, on one side of it, a second column; one label in ten is wrong."""
    r = np.random.default_rng(12)
    pdf = pd.DataFrame({c: r.uniform(0, 10, 2400) for c in forecasting.FEATURE_COLUMNS})
    truth = (pdf.maxmag_90d > 6) | ((pdf.maxmag_90d > 3) & (pdf.logE_365d > 7))
    pdf["y"] = (truth ^ (r.random(2400) < 0.1)).astype(int)
    pdf["cell_id"], pdf["t_us"] = np.arange(2400), 0
    return spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("profile", ["trees_a", "trees_b"])
def test_trees_learn_the_rule(spark, labelled, profile):
    model = forecasting.train_trees(labelled, "y", profile, maxIter=12)
    scored = forecasting.tree_probability(model, labelled)
    assert scored.filter("p < 0 OR p > 1 OR p IS NULL").isEmpty()
    assert metrics.evaluate(scored.select(F.lit("x").alias("model"), "y", "p"), ["model"]).first()["roc_auc"] > 0.85
    top = [r["feature"] for r in forecasting.split_importance(model, labelled).orderBy("rank").collect()]
    assert top[:2] == ["maxmag_90d", "logE_365d"] and len(top) == 8
    drop = {r["feature"]: r["auc_drop"] for r in forecasting.permutation_importance(model, labelled, "y", ["maxmag_90d", "cen_lon"]).collect()}
    assert drop["maxmag_90d"] > 0.2 > 0.03 > abs(drop["cen_lon"])


def test_feature_columns_must_be_complete(spark, labelled):
    with pytest.raises(ValueError):
        forecasting.feature_names(labelled.drop("cnt_7d"))
    with pytest.raises(ValueError):
        forecasting.feature_names(labelled.withColumn("etas_nb", F.lit(0.0)))
    assert forecasting.feature_names(labelled.select(*reversed(labelled.columns))) == list(forecasting.FEATURE_COLUMNS)


def test_isotonic_map(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1), (0.4, 1)], "p double, y int")
    model = forecasting.fit_isotonic(df)
    asked = spark.createDataFrame([(0.05,), (0.2,), (0.25,), (0.35,), (0.9,)], "p double")
    got = [r["p_cal"] for r in forecasting.apply_isotonic(model, asked).orderBy("p").collect()]
    assert got == pytest.approx([0.0, 0.5, 0.5, 0.75, 1.0])


def test_verdicts(spark):
    rows = [("poisson_smooth", 0.64, 0.0073, 0.0012), ("a", 0.62, 0.0058, -0.0014), ("b", 0.59, 0.0054, -0.0013)]
    scores = spark.createDataFrame(rows, "model string, roc_auc double, pr_auc double, bss double")
    got = forecasting.model_verdict(scores, ["a", "b"]).first()
    assert got["best"] == "a" and got["verdict"] == "not supported" and got["d_roc"] == pytest.approx(-0.02)
    better = scores.replace({0.62: 0.70, 0.0058: 0.02})
    assert forecasting.model_verdict(better, ["a", "b"]).first()["verdict"] == "partial"


def test_models_side_by_side_share_the_tasks(spark, monkeypatch):
    seen = []

    class Learner:
        def __init__(self, **settings):
            pass

        def fit(self, rows):
            seen.append((rows.rdd.getNumPartitions(), rows.count()))

    monkeypatch.setattr(forecasting, "GBTClassifier", Learner)
    monkeypatch.setattr(forecasting, "_TASK_ROWS", 10)
    rows = spark.range(400, numPartitions=50).select(*[F.col("id").cast("double").alias(c) for c in forecasting.FEATURE_COLUMNS], (F.col("id") % 2).alias("y"))
    for models, tasks in ((1, 41), (2, 41), (10, 9), (12, 9)):
        forecasting.train_side_by_side([(rows, "trees_a")] * models, "y")
        assert seen == [(tasks, 400)] * models
        seen.clear()
