"""Baselines, folds, metrics, calibration, trees, snapshots, epoch tests, triggering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.checks import feature_queries as FQ
from tremora.checks import sql as S
from tremora.checks.registry import query, rounded
from tremora.fixed import DAY_US, TRIGGER_ALPHA, TRIGGER_C, TRIGGER_K, TRIGGER_MU, TRIGGER_P
from tremora.functions.rates import Triggering
from tremora.operators import epoch, forecasting, metrics, triggering
from tremora.operators.ranking import exact_quantiles
from tremora.plans import reports as plan_reports
from tremora.plans.driver_tables import catalog
from tremora.session import materialize

TARGET, FIRST_TEST, MC = "y_m5_30d", 2005, 4.0
_SPEC = forecasting.RateSpec(m0=5.0, mc=MC, horizon_days=30.0)

# --- the shared part of the check SQL: one row per active cell and instant with what the baselines read -

_CORE = f"""{S.grid()}, own AS (SELECT b.cell_id, b.k, b.t, count(*) FILTER (e.t_us <= b.t) AS cnt_all, count(*) FILTER ({S.past(30)}) AS cnt_30d, count(*) FILTER ({S.past(365)}) AS cnt_365d,
        coalesce(max((({S.ahead(30)}) AND e.mag >= 5.0)::INT), 0) AS y FROM base b LEFT JOIN ev e ON e.i = b.i AND e.j = b.j GROUP BY ALL),
    nb AS (SELECT b.cell_id, b.k, count(*) FILTER ({S.past(365)}) AS nb365 FROM base b LEFT JOIN ev e ON e.i BETWEEN b.i - 1 AND b.i + 1 AND e.j BETWEEN b.j - 1 AND b.j + 1 GROUP BY ALL),
    f AS (SELECT own.*, nb365, year(make_timestamp(t)) AS year FROM own JOIN nb USING (cell_id, k))"""
_YEARS = "greatest((t - (-315619200000000)) / 86400000000.0::DOUBLE / 365.25, 1.0)"
_GR = "pow(10.0, -1.0)"
_LT = f"1 - exp(-(cnt_all / {_YEARS} * {_GR}) * 30.0 / 365.25)"
_1Y = f"1 - exp(-(cnt_365d * {_GR}) * 30.0 / 365.25)"
_SM = f"1 - exp(-(0.5 * cnt_365d * {_GR} + 0.5 * nb365 / 9.0 * {_GR}) * 30.0 / 365.25)"
_SM6 = _SM.replace(_GR, "pow(10.0, -2.0)")
_SCORED = f"""{_CORE}, scored AS (SELECT 'poisson_lt' AS model, year, y, {_LT} AS p FROM f UNION ALL SELECT 'poisson_1y', year, y, {_1Y} FROM f UNION ALL SELECT 'poisson_smooth', year, y, {_SM} FROM f)"""
# Probabilities are compared on ten decimals, so that equal rates tie in both engines.
_PRED = f"{_SCORED}, pred AS (SELECT model, y, greatest(1e-7, least(round(p, 10), 1 - 1e-7)) AS p, 0.01::DOUBLE AS p_ref FROM scored)"


def _predictions(spark, sf):
    scored = forecasting.baseline_predictions(FQ.table(spark, sf), TARGET, _SPEC)
    return scored.select("model", "y", F.round("p", 10).alias("p"), F.lit(0.01).alias("p_ref"))


def _baseline_query(name: str, model: str, formula: str) -> None:
    @query(name, f"WITH {_CORE} SELECT cell_id, t AS t_us, round({formula}, 8) AS p FROM f")
    def _(spark, sf):
        return rounded(FQ.table(spark, sf).select("cell_id", "t_us", forecasting.BASELINES[model](_SPEC).alias("p")), 8)


_baseline_query("mod_02_long_term", "poisson_lt", _LT)
_baseline_query("mod_03_last_year", "poisson_1y", _1Y)
_baseline_query("mod_04_smoothed", "poisson_smooth", _SM)


@query("mod_01_climatology", f"WITH {_CORE} SELECT round(avg(y), 8) AS p FROM f WHERE year < {FIRST_TEST}")
def _(spark, sf):
    train, _ = forecasting.split_at_year(FQ.table(spark, sf), FIRST_TEST)
    return rounded(forecasting.climatology(train, TARGET), 8)


@query("mod_06_year_split", f"WITH {_CORE} SELECT CASE WHEN year < {FIRST_TEST} THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(year) AS first_year, max(year) AS last_year FROM f GROUP BY 1")
def _(spark, sf):
    train, test = forecasting.split_at_year(FQ.table(spark, sf).select("t_us"), FIRST_TEST)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    year = F.year(F.timestamp_micros("t_us")).cast("long")
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))


@query("mod_07_walk_forward", f"WITH {_CORE}, fold AS (SELECT DISTINCT year AS fold FROM f WHERE year >= {FIRST_TEST}) SELECT fold, count(*) FILTER (year < fold) AS n_train, (sum(y) FILTER (year < fold))::BIGINT AS pos_train, count(*) FILTER (year = fold) AS n_test, (sum(y) FILTER (year = fold))::BIGINT AS pos_test FROM fold, f GROUP BY 1")
def _(spark, sf):
    return forecasting.walk_forward(FQ.table(spark, sf), TARGET, FIRST_TEST)


@query("mod_08_three_way_folds", f"""WITH {_CORE}, fold AS (SELECT DISTINCT year AS fold FROM f WHERE year >= {FIRST_TEST}),
    sizes AS (SELECT fold, count(*) FILTER (year = fold) AS n_test, (sum(y) FILTER (year = fold))::BIGINT AS pos_test, count(*) FILTER (year < fold - 1) AS n_fit, coalesce(sum(y) FILTER (year < fold - 1), 0)::BIGINT AS pos_fit,
        count(*) FILTER (year = fold - 1) AS n_calib, coalesce(sum(y) FILTER (year = fold - 1), 0)::BIGINT AS pos_calib, round(avg(y) FILTER (year < fold), 8) AS climatology FROM fold, f GROUP BY 1)
    SELECT * FROM sizes WHERE n_calib > 0 AND pos_fit >= 20""")
def _(spark, sf):
    return rounded(forecasting.three_way_folds(FQ.table(spark, sf), TARGET, FIRST_TEST), 8)


@query("mod_09_class_weight", f"WITH {_CORE} SELECT round((count(*) - sum(y)) / greatest(sum(y), 1), 6) AS weight FROM f WHERE year < {FIRST_TEST}")
def _(spark, sf):
    train, _ = forecasting.split_at_year(FQ.table(spark, sf), FIRST_TEST)
    return rounded(forecasting.positive_weight(train, TARGET))


@query("set_04_pooled_predictions", f"WITH {_SCORED} SELECT model, count(*) AS n, sum(y)::BIGINT AS n_pos FROM scored WHERE year >= {FIRST_TEST} GROUP BY 1")
def _(spark, sf):
    scored = forecasting.baseline_predictions(FQ.table(spark, sf), TARGET, _SPEC).withColumn("year", F.year(F.timestamp_micros("t_us")))
    first, later = scored.filter(F.col("year") == FIRST_TEST), scored.filter(F.col("year") > FIRST_TEST)
    return first.unionByName(later).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos"))


# --- metrics ----------------------------------------------------------------------------------------


@query("agg_19_brier", f"WITH {_PRED} SELECT model, count(*) AS n, sum(y)::BIGINT AS n_pos, round(avg(y), 8) AS base_rate, round(avg(pow(p - y, 2)), 8) AS brier FROM pred GROUP BY 1")
def _(spark, sf):
    scores = metrics.score_counts(_predictions(spark, sf), ["model"])
    return rounded(metrics.proper_scores(scores, ["model"]).drop("logloss"), 8)


@query("agg_20_log_loss", f"WITH {_PRED} SELECT model, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 8) AS logloss FROM pred GROUP BY 1")
def _(spark, sf):
    scores = metrics.score_counts(_predictions(spark, sf), ["model"])
    return rounded(metrics.proper_scores(scores, ["model"]).select("model", "logloss"), 8)


_RANKS = f"{_PRED}, g AS (SELECT model, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM pred GROUP BY ALL), tot AS (SELECT model, sum(pos) AS pp, sum(neg) AS nn FROM g GROUP BY 1)"


@query("agg_21_roc_auc", f"WITH {_RANKS}, c AS (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY p) - neg AS below FROM g) SELECT model, round(sum(pos * (below + neg / 2.0)) / (any_value(pp)::DOUBLE * any_value(nn)), 8) AS roc_auc FROM c JOIN tot USING (model) GROUP BY 1")
def _(spark, sf):
    scores = metrics.score_counts(_predictions(spark, sf), ["model"])
    return rounded(metrics.ranking_scores(scores, ["model"]).select("model", "roc_auc"), 8)


@query("agg_22_pr_auc", f"WITH {_RANKS}, c AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY p DESC) AS tp, sum(neg) OVER (PARTITION BY model ORDER BY p DESC) AS fp FROM g) SELECT model, round(sum(pos * (tp::DOUBLE / (tp + fp))) / any_value(pp), 8) AS pr_auc FROM c JOIN tot USING (model) GROUP BY 1")
def _(spark, sf):
    scores = metrics.score_counts(_predictions(spark, sf), ["model"])
    return rounded(metrics.ranking_scores(scores, ["model"]).select("model", "pr_auc"), 8)


@query("agg_23_skill", f"WITH {_PRED} SELECT model, round(1 - avg(pow(p - y, 2)) / avg(pow(p_ref - y, 2)), 8) AS bss FROM pred GROUP BY 1")
def _(spark, sf):
    return rounded(metrics.evaluate(_predictions(spark, sf), ["model"], p_ref="p_ref").select("model", "bss"), 8)


@query("agg_24_reliability", f"""WITH {_PRED}, q AS (SELECT model, list_sort(list_distinct(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM pred GROUP BY 1),
    slot AS (SELECT model, p, y, len(list_filter(edges[2:len(edges) - 1], lambda x: x <= p)) AS bin FROM pred JOIN q USING (model)) SELECT model, bin, round(avg(p), 8) AS mean_pred, round(avg(y), 8) AS obs_freq, count(*) AS n FROM slot GROUP BY ALL""")
def _(spark, sf):
    return rounded(metrics.reliability(_predictions(spark, sf), ["model"]), 8)


@query("agg_24_reliability_equal_width", f"""WITH {_PRED}, q AS (SELECT model, min(p) AS lo, max(p) AS hi FROM pred GROUP BY 1),
    slot AS (SELECT model, p, y, len(list_filter([1, 2, 3, 4, 5, 6, 7, 8, 9], lambda k: lo + (hi - lo) / 10 * k <= p)) AS bin FROM pred JOIN q USING (model)) SELECT model, bin, round(avg(p), 8) AS mean_pred, round(avg(y), 8) AS obs_freq, count(*) AS n FROM slot GROUP BY ALL""")
def _(spark, sf):
    return rounded(metrics.reliability(_predictions(spark, sf), ["model"], strategy="width"), 8)


@query("agg_24_quantile_edges", f"WITH {_PRED} SELECT model, q, round(v, 10) AS quantile FROM (SELECT model, unnest([0.05, 0.5, 0.95])::DOUBLE AS q, unnest(quantile_cont(p, [0.05, 0.5, 0.95])) AS v FROM pred GROUP BY 1)")
def _(spark, sf):
    clipped = _predictions(spark, sf).withColumn("p", F.greatest(F.lit(1e-7), "p"))
    return rounded(exact_quantiles(clipped, ["model"], "p", [0.05, 0.5, 0.95]), 10)


@query("agg_34_verdict", f"WITH {_PRED}, s AS (SELECT model, 1 - avg(pow(p - y, 2)) / avg(pow(p_ref - y, 2)) AS bss FROM pred GROUP BY 1) SELECT round(a.bss, 8) AS bss_recent, round(b.bss, 8) AS bss_long, CASE WHEN a.bss > b.bss THEN 'supported' ELSE 'inconclusive' END AS verdict FROM s a JOIN s b ON a.model = 'poisson_1y' AND b.model = 'poisson_lt'")
def _(spark, sf):
    return rounded(forecasting.recent_rate_verdict(metrics.evaluate(_predictions(spark, sf), ["model"], p_ref="p_ref")), 8)


# --- calibration, trees, snapshots ------------------------------------------------------------------


def _isotonic_sql(history: str, label: str) -> str:
    """knots: the isotonic fit at every distinct p, as max over starts of min over ends of the mean between them."""
    return f"""g AS (SELECT p, sum({label})::DOUBLE AS s, count(*)::DOUBLE AS w FROM {history} GROUP BY 1),
    c AS (SELECT p, row_number() OVER (ORDER BY p) AS i, sum(s) OVER (ORDER BY p) AS cs, sum(w) OVER (ORDER BY p) AS cw, s, w FROM g),
    means AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS m FROM c a JOIN c b ON b.i >= a.i),
    ends AS (SELECT a, b, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM means),
    knots AS (SELECT c.p, max(e.m) AS v FROM c JOIN ends e ON e.b = c.i AND e.a <= c.i GROUP BY 1)"""


@query("mod_05_isotonic", f"WITH {_SCORED}, h AS (SELECT y, round(p, 10) AS p FROM scored WHERE model = 'poisson_smooth'), {_isotonic_sql('h', 'y')} SELECT p, round(v, 8) AS p_cal, count(*) AS n FROM h JOIN knots USING (p) GROUP BY ALL")
def _(spark, sf):
    scored = forecasting.baseline_predictions(FQ.table(spark, sf), TARGET, _SPEC, ["poisson_smooth"]).select(F.round("p", 10).alias("p"), "y")
    calibrated = forecasting.apply_isotonic(forecasting.fit_isotonic(scored), scored)
    return calibrated.groupBy("p", F.round("p_cal", 8).alias("p_cal")).agg(F.count(F.lit(1)).alias("n"))


@query("mod_05_baseline_comparison")
def _(spark, sf):
    return forecasting.baseline_comparison(materialize(FQ.table(spark, sf)), TARGET, FIRST_TEST, mc=MC)


def _split(spark, sf):
    return forecasting.split_at_year(materialize(FQ.table(spark, sf)), FIRST_TEST)


def _scores(parts, profiles, **overrides):
    """Scores on the test years of models trained on the years before."""
    train, test = parts
    models = forecasting.train_side_by_side([(train, name) for name in profiles], TARGET, **overrides)
    scored = [forecasting.tree_probability(m, test).select(F.lit(name).alias("model"), F.col(TARGET).alias("y"), "p") for name, m in zip(profiles, models)]
    return metrics.evaluate(reduce(DataFrame.unionByName, scored), ["model"])


def _tree_query(name: str, *profiles: str) -> None:
    @query(name)
    def _(spark, sf):
        return _scores(_split(spark, sf), profiles)


_tree_query("mod_10_trees_a", "trees_a")
_tree_query("mod_11_trees_b", "trees_b")
_tree_query("mod_11_tree_scores", "trees_a", "trees_b")

# SQL knows which rows are scored, not their scores: here two boosting rounds are enough.
_TESTED = f"WITH {_CORE}, z AS (SELECT cell_id, t, y FROM f WHERE year(make_timestamp(t)) >= {FIRST_TEST})"


@query("mod_10_scored_counts", f"{_TESTED} SELECT model, count(*) AS n, sum(y)::BIGINT AS n_pos, round(sum(y) / count(*), 10) AS base_rate FROM z, (VALUES ('trees_a'), ('trees_b')) v(model) GROUP BY 1")
def _(spark, sf):
    return _scores(_split(spark, sf), ("trees_a", "trees_b"), maxIter=2).select("model", "n", "n_pos", F.round("base_rate", 10).alias("base_rate"))


@query("mod_12_feature_list", "SELECT unnest(['cnt_7d','cnt_30d','cnt_90d','cnt_365d','cnt_all','maxmag_30d','maxmag_90d','maxmag_365d','logE_30d','logE_365d','days_since_last','days_since_M5','nb_cnt_30d','nb_cnt_365d','nb_maxmag_365d','reg_cnt_30d','reg_maxmag_30d','cen_lat','cen_lon','etas_cell','etas_nb']) AS feature, (SELECT count(*) FROM base) AS n FROM (SELECT 1)".replace("SELECT unnest", f"WITH {S.grid()} SELECT unnest", 1))
def _(spark, sf):
    table = FQ.table(spark, sf)
    counted = table.agg(*[F.count(c).alias(c) for c in forecasting.feature_names(table)])
    return counted.unpivot([], counted.columns, "feature", "n")


@query("mod_13_probabilities")
def _(spark, sf):
    train, test = _split(spark, sf)
    return forecasting.tree_probability(forecasting.train_trees(train, TARGET), test).select("cell_id", "t_us", "p")


@query("mod_13_scored_rows", f"{_TESTED} SELECT cell_id, t AS t_us FROM z")
def _(spark, sf):
    train, test = _split(spark, sf)
    model = forecasting.train_trees(train, TARGET, maxIter=2)
    return forecasting.tree_probability(model, test).filter(F.col("p").between(0, 1)).select("cell_id", "t_us")


@query("mod_14_importance")
def _(spark, sf):
    train, test = _split(spark, sf)
    model = forecasting.train_trees(train, TARGET)
    top = materialize(forecasting.split_importance(model, train))
    names = [r["feature"] for r in top.collect()]  # eight rows
    return top.join(forecasting.permutation_importance(model, test, TARGET, names), "feature", "left")


@query("agg_34_backtest_verdict")
def _(spark, sf):
    pooled = forecasting.backtest_folds(materialize(FQ.table(spark, sf)), TARGET, FIRST_TEST, mc=MC)
    scores = metrics.evaluate(pooled, ["model"], p_ref="p_ref")
    return forecasting.model_verdict(scores, list(forecasting.TREES))


_CALIBRATED = f"""WITH {_CORE}, smooth AS (SELECT cell_id, t, y, cnt_365d, cnt_30d, round({_SM}, 12) AS p FROM f), last AS (SELECT max(t) AS t FROM f), h AS (SELECT y, p FROM smooth WHERE t < (SELECT t FROM last)), {_isotonic_sql('h', 'y')},
    now AS (SELECT * FROM smooth WHERE t = (SELECT t FROM last)), lower AS (SELECT now.*, k.p AS p0, k.v AS v0 FROM now ASOF LEFT JOIN knots k ON now.p >= k.p), both_ AS (SELECT lower.*, k.p AS p1, k.v AS v1 FROM lower ASOF LEFT JOIN knots k ON lower.p <= k.p)
    SELECT cell_id, cnt_30d, cnt_365d, round(CASE WHEN p0 IS NULL THEN v1 WHEN p1 IS NULL THEN v0 WHEN p0 = p1 THEN v0 ELSE v0 + (v1 - v0) * (p - p0) / (p1 - p0) END, 6) AS p_m5_30d FROM both_"""


@query("mod_15_calibrated_m5", _CALIBRATED)
def _(spark, sf):
    snapshot = forecasting.forecast_snapshot(materialize(FQ.table(spark, sf)), mc=MC)
    return rounded(snapshot.select("cell_id", "cnt_30d", "cnt_365d", "p_m5_30d"))


_CALIBRATED_M6 = _CALIBRATED.replace(_SM, _SM6).replace("p_m5_30d", "p_m6_30d").replace("AND e.mag >= 5.0", "AND e.mag >= 6.0")


@query("mod_15_calibrated_m6", _CALIBRATED_M6)
def _(spark, sf):
    snapshot = forecasting.forecast_snapshot(materialize(FQ.table(spark, sf)), mc=MC)
    return rounded(snapshot.select("cell_id", "cnt_30d", "cnt_365d", "p_m6_30d"))


@query("mod_15_forecast_snapshot")
def _(spark, sf):
    return forecasting.forecast_snapshot(materialize(FQ.table(spark, sf)), mc=MC).drop("t_us")


_LATEST = f"{_CORE}, snap AS (SELECT cell_id, {_SM} AS p, cnt_365d FROM f WHERE t = (SELECT max(t) FROM f))"


def _raw_snapshot(spark, sf):
    """The latest instant with the uncalibrated smoothed baseline as both probabilities."""
    now, _ = forecasting.split_latest(FQ.table(spark, sf))
    return now.withColumn("p_m5_30d", forecasting.smoothed(_SPEC)).withColumn("p_m6_30d", forecasting.smoothed(forecasting.RateSpec(m0=6.0, mc=MC)))


@query("mod_17_grid_view", f"WITH {_LATEST} SELECT round(-18.5 + (cell_id // 54 + 0.5) * 0.25, 6) AS lat, round(-81.5 + (cell_id % 54 + 0.5) * 0.25, 6) AS lon, round(p, 6) AS p, cnt_365d FROM snap")
def _(spark, sf):
    return rounded(forecasting.grid_view(_raw_snapshot(spark, sf), "m5"))


@query("top_04_top_cells", f"WITH {_LATEST} SELECT cell_id, round(p, 8) AS p FROM snap ORDER BY round(p, 8) DESC, cell_id LIMIT 10")
def _(spark, sf):
    snapshot = _raw_snapshot(spark, sf).withColumn("p", F.round("p_m5_30d", 8))
    return forecasting.top_cells(snapshot, by="p").select("cell_id", "p")


@query("top_07_latest_instant", f"WITH {_CORE} SELECT CASE WHEN t = (SELECT max(t) FROM f) THEN 'latest' ELSE 'history' END AS part, count(*) AS n, max(t) AS t_us FROM f GROUP BY 1")
def _(spark, sf):
    now, history = forecasting.split_latest(FQ.table(spark, sf).select("t_us"))
    both = now.withColumn("part", F.lit("latest")).unionByName(history.withColumn("part", F.lit("history")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("t_us").alias("t_us"))


@query("mod_18_dashboard")
def _(spark, sf):
    return plan_reports.dashboard_document(catalog(spark, sf))


@query("snk_07_context_document")
def _(spark, sf):
    return plan_reports.context_document(catalog(spark, sf, True), 1_199_145_600_000_000)


@query("snk_07_forecast_document")
def _(spark, sf):
    return plan_reports.forecast_document(forecasting.forecast_snapshot(materialize(FQ.table(spark, sf)), mc=MC), mc=MC)


# --- epoch tests ------------------------------------------------------------------------------------


def _epoch_inputs(spark, sf):
    wide = catalog(spark, sf, True)
    triggers = wide.filter((F.col("country") == "Chile") & (F.col("preferred_mw") >= 6.0))
    targets = wide.filter((F.col("country") == "Peru") & (F.col("preferred_mw") >= 4.5))
    first, last = wide.agg(F.min("t_us"), F.max("t_us")).first()
    return triggers, targets, first, last


_WINDOWS = "(SELECT unnest([1, 7, 30, 90])::BIGINT AS days)"
_EPOCH = f"""{S.cat(True)}, trig AS (SELECT * FROM cat WHERE country = 'Chile' AND preferred_mw >= 6.0), targ AS (SELECT t_us, row_number() OVER (ORDER BY t_us) AS upto FROM cat WHERE country = 'Peru' AND preferred_mw >= 4.5),
    span AS (SELECT min(t_us) AS lo, max(t_us) AS hi FROM cat)"""
_OBSERVED = f"observed AS (SELECT w.days, sum((SELECT count(*) FROM targ WHERE targ.t_us > trig.t_us AND targ.t_us <= trig.t_us + w.days * {DAY_US}))::BIGINT AS observed FROM trig, {_WINDOWS} w GROUP BY 1)"


def _mix(draw: str, item: str, stream: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(',', {draw}, {item}, {stream})), 1, 13))::BIGINT::DOUBLE / {float(16**13)!r}::DOUBLE)"


_NULL = f"""draws AS (SELECT d.draw, w.days, lo + floor({_mix('d.draw', 'trig.canonical_id', 'w.days')} * (hi - lo - w.days * {DAY_US})::DOUBLE)::BIGINT AS s, w.days * {DAY_US} AS width FROM trig, span, (SELECT unnest(range(1, 3001)) AS draw) d, {_WINDOWS} w),
    lows AS (SELECT draw, days, s, width, coalesce(targ.upto, 0) AS a FROM draws ASOF LEFT JOIN targ ON draws.s >= targ.t_us),
    highs AS (SELECT draw, days, a, coalesce(targ.upto, 0) AS b FROM (SELECT *, s + width AS e FROM lows) x ASOF LEFT JOIN targ ON x.e >= targ.t_us),
    nulls AS (SELECT days, draw, sum(b - a)::BIGINT AS n FROM highs GROUP BY ALL)"""


@query("join_08_followers", f"WITH {_EPOCH}, {_OBSERVED} SELECT * FROM observed")
def _(spark, sf):
    triggers, targets, _, _ = _epoch_inputs(spark, sf)
    return epoch.observed_counts(triggers, targets)


@query("agg_17_null_counts", f"WITH {_EPOCH}, {_NULL} SELECT days, draw, n FROM nulls")
def _(spark, sf):
    return epoch.null_counts(*_epoch_inputs(spark, sf))


@query("agg_16_epoch_test", f"""WITH {_EPOCH}, {_OBSERVED}, {_NULL}, st AS (SELECT days, observed, avg(n) AS expected, stddev_pop(n) AS sd, count(*) FILTER (n >= observed) AS big FROM nulls JOIN observed USING (days) GROUP BY ALL)
    SELECT days, observed, round(expected, 6) AS expected, round(observed / expected, 6) AS rate_ratio, round((observed - expected) / (sd + 1e-9), 6) AS beta, round((1.0 + big) / 3001.0, 8) AS p, (SELECT count(*) FROM trig) AS n_triggers FROM st WHERE (SELECT count(*) FROM trig) >= 3""")
def _(spark, sf):
    return rounded(epoch.epoch_test(*_epoch_inputs(spark, sf)), 6, p=8)


_CASES = f"""{S.cat(True)}, far AS (SELECT -16.25::DOUBLE AS latitude, -72.0::DOUBLE AS longitude), span AS (SELECT min(t_us) AS lo, max(t_us) AS hi FROM cat),
    strong AS (SELECT canonical_id, t_us, preferred_mw, {S.haversine('cat', 'far')} AS km FROM cat, far WHERE cat.latitude BETWEEN -56.0 AND -17.0 AND cat.longitude BETWEEN -76.0 AND -66.0),
    trig AS (SELECT canonical_id, t_us, threshold, setting FROM strong, (VALUES (6.0::DOUBLE), (6.5::DOUBLE)) v(threshold), (VALUES ('whole'), ('near'), ('remote')) w(setting) WHERE preferred_mw >= threshold AND (setting <> 'remote' OR km >= 600.0)),
    aim AS (SELECT 'whole' AS goal, t_us FROM cat WHERE country = 'Peru' AND preferred_mw >= 4.5 UNION ALL SELECT 'near', t_us FROM cat WHERE latitude BETWEEN -18.5 AND -14.0 AND longitude BETWEEN -76.0 AND -68.0 AND preferred_mw >= 4.5),
    targ AS (SELECT goal, t_us, row_number() OVER (PARTITION BY goal ORDER BY t_us) AS upto FROM aim),
    draws AS (SELECT setting, threshold, CASE setting WHEN 'whole' THEN 'whole' ELSE 'near' END AS goal, d.draw, w.days, CASE WHEN d.draw = 0 THEN t_us ELSE lo + floor({_mix('d.draw', 'trig.canonical_id', 'w.days')} * (hi - lo - w.days * {DAY_US})::DOUBLE)::BIGINT END AS s, w.days * {DAY_US} AS width
        FROM trig, span, (SELECT unnest(range(0, 3001)) AS draw) d, {_WINDOWS} w),
    lows AS (SELECT draws.*, coalesce(targ.upto, 0) AS a FROM draws ASOF LEFT JOIN targ ON draws.goal = targ.goal AND draws.s >= targ.t_us),
    highs AS (SELECT setting, threshold, draw, days, a, coalesce(targ.upto, 0) AS b FROM (SELECT *, s + width AS e FROM lows) x ASOF LEFT JOIN targ ON x.goal = targ.goal AND x.e >= targ.t_us),
    sums AS (SELECT setting, threshold, days, draw, sum(b - a)::BIGINT AS n FROM highs GROUP BY ALL), seen AS (SELECT setting, threshold, days, n AS observed FROM sums WHERE draw = 0),
    st AS (SELECT setting, threshold, days, observed, avg(n) AS expected, stddev_pop(n) AS sd, count(*) FILTER (n >= observed) AS big FROM sums JOIN seen USING (setting, threshold, days) WHERE draw > 0 GROUP BY ALL),
    tot AS (SELECT setting, threshold, count(*) AS n_triggers FROM trig GROUP BY ALL HAVING count(*) >= 3)"""


@query("agg_16_distance_controlled", f"WITH {_CASES} SELECT setting, threshold, days, observed, round(expected, 6) AS expected, round(observed / nullif(expected, 0), 6) AS rate_ratio, round((observed - expected) / (sd + 1e-9), 6) AS beta, round((1.0 + big) / 3001.0, 8) AS p, n_triggers FROM st JOIN tot USING (setting, threshold)")
def _(spark, sf):
    wide = catalog(spark, sf, True)
    first, last = wide.agg(F.min("t_us"), F.max("t_us")).first()
    return rounded(epoch.distance_controlled(wide, (6.0, 6.5), 4.5, first, last), 6, p=8)


_LAGS = f"(SELECT unnest(range(-30, 31)) AS lag)"


@query("agg_18_epoch_curve", f"""WITH {_EPOCH}, real AS (SELECT l.lag, sum((SELECT count(*) FROM targ WHERE targ.t_us > trig.t_us + l.lag * {DAY_US} AND targ.t_us <= trig.t_us + (l.lag + 1) * {DAY_US})) AS n FROM trig, {_LAGS} l GROUP BY 1),
    starts AS (SELECT d.draw, l.lag, lo + 30 * {DAY_US} + floor({_mix('d.draw', 'trig.canonical_id', '0')} * (hi - lo - 60 * {DAY_US})::DOUBLE)::BIGINT + l.lag * {DAY_US} AS s FROM trig, span, (SELECT unnest(range(1, 301)) AS draw) d, {_LAGS} l),
    lows AS (SELECT draw, lag, s, coalesce(targ.upto, 0) AS a FROM starts ASOF LEFT JOIN targ ON starts.s >= targ.t_us),
    highs AS (SELECT draw, lag, a, coalesce(targ.upto, 0) AS b FROM (SELECT *, s + {DAY_US} AS e FROM lows) x ASOF LEFT JOIN targ ON x.e >= targ.t_us),
    nulls AS (SELECT lag, draw, sum(b - a)::BIGINT AS n FROM highs GROUP BY ALL), band AS (SELECT lag, quantile_cont(n, 0.025) AS low, quantile_cont(n, 0.975) AS high FROM nulls GROUP BY 1), k AS (SELECT greatest(count(*), 1) AS k FROM trig)
    SELECT lag, round(n / k, 6) AS mean_count, round(low / k, 6) AS low, round(high / k, 6) AS high FROM real JOIN band USING (lag), k""")
def _(spark, sf):
    return rounded(epoch.epoch_curve(*_epoch_inputs(spark, sf)).withColumn("lag", F.col("lag").cast("long")))


# --- triggering -------------------------------------------------------------------------------------

THETA = Triggering(TRIGGER_MU, TRIGGER_K, TRIGGER_ALPHA, TRIGGER_C, TRIGGER_P, 4.5)
_FLAT = Triggering(0.5, 0.1, 1.0, 0.05, 1.0, 4.5)


def _series(spark, sf):
    return catalog(spark, sf).filter(F.col("preferred_mw") >= 4.5).select("canonical_id", "t_us", F.col("preferred_mw").alias("mag"))


_EVENTS = f"{S.cat()}, s AS (SELECT canonical_id AS id, t_us AS t, preferred_mw AS m FROM cat WHERE preferred_mw >= 4.5), span AS (SELECT min(t) AS lo, max(t) AS hi FROM s)"
_PAIRS = f"""{_EVENTS},
    rates AS (SELECT a.id, a.t, a.m, 0.481 + coalesce(sum(0.171 * exp(0.866 * (b.m - 4.5)) * pow((a.t - b.t) / 86400000000.0 + 0.398, -1.534)), 0) AS rate1,
        0.5 + coalesce(sum(0.1 * exp(1.0 * (b.m - 4.5)) * pow((a.t - b.t) / 86400000000.0 + 0.05, -1.0)), 0) AS rate2
        FROM s a LEFT JOIN s b ON b.t <= a.t AND b.t >= a.t - 365 * {DAY_US} AND (b.t, b.id) < (a.t, a.id) GROUP BY ALL)"""


@query("win_07_intensity_at_events", f"WITH {_PAIRS} SELECT id, t, round(rate1, 6) AS rate FROM rates")
def _(spark, sf):
    return rounded(triggering.intensity_at_events(_series(spark, sf), THETA, 365.0).select("id", "t", "rate"))


@query("agg_31_log_likelihood", f"""WITH {_PAIRS} SELECT 0::BIGINT AS theta, round(0.481 * any_value((hi - lo) / 86400000000.0) + sum(0.171 * exp(0.866 * (m - 4.5)) * (pow((hi - t) / 86400000000.0 + 0.398, -0.534) - pow(0.398, -0.534)) / (-0.534)) - sum(ln(rate1)), 4) AS neg_loglik FROM rates, span
    UNION ALL SELECT 1::BIGINT, round(0.5 * any_value((hi - lo) / 86400000000.0) + sum(0.1 * exp(1.0 * (m - 4.5)) * ln(((hi - t) / 86400000000.0 + 0.05) / 0.05)) - sum(ln(rate2)), 4) FROM rates, span
    UNION ALL SELECT 2::BIGINT, 1e12""")
def _(spark, sf):
    series = _series(spark, sf)
    first, last = series.agg(F.min("t_us"), F.max("t_us")).first()
    impossible = Triggering(-1.0, 0.1, 1.0, 0.05, 1.1, 4.5)
    return rounded(triggering.log_likelihood(series, [THETA, _FLAT, impossible], first, last, 365.0), 4)


@query("win_08_intensity_curve", f"WITH {_PAIRS}, inst AS (SELECT unnest(range(0, 1500)) AS k), t AS (SELECT k, lo + k * 2 * {DAY_US} AS t_us FROM inst, span) SELECT k, t_us, round(0.481 + coalesce(sum(0.171 * exp(0.866 * (s.m - 4.5)) * pow((t_us - s.t) / 86400000000.0 + 0.398, -1.534)), 0), 6) AS intensity FROM t LEFT JOIN s ON s.t < t.t_us GROUP BY 1, 2")
def _(spark, sf):
    series = _series(spark, sf)
    first = series.agg(F.min("t_us")).first()[0]
    return rounded(triggering.intensity_curve(series, THETA, first, 2 * DAY_US, 1500))


def _fitted(spark, sf):
    series = _series(spark, sf)
    first, last, n = series.agg(F.min("t_us"), F.max("t_us"), F.count(F.lit(1))).first()
    return triggering.fit(series, first, last, 4.5, 365.0), n, (last - first) / DAY_US


@query("agg_32_fit")
def _(spark, sf):
    found, _, _ = _fitted(spark, sf)
    theta = found.theta
    return spark.createDataFrame(
        [(theta.mu, theta.k, theta.alpha, theta.c, theta.p, found.score, found.rounds, found.converged, found.at_bound)],
        "mu double, k double, alpha double, c double, p double, neg_loglik double, rounds long, converged boolean, at_bound boolean",
    )


_START = "th AS (SELECT count(*) AS n, 0.5 * count(*) / greatest(any_value((hi - lo) / 86400000000.0), 1.0) AS mu FROM s, span)"


@query("agg_32_fit_start", f"""WITH {_EVENTS}, {_START}, pair AS (SELECT a.id, a.t, a.m, coalesce(sum(0.1 * exp(1.5 * (b.m - 4.5)) * pow((a.t - b.t) / 86400000000.0 + 0.05, -1.1)), 0) AS r
        FROM s a LEFT JOIN s b ON b.t <= a.t AND b.t >= a.t - 365 * {DAY_US} AND (b.t, b.id) < (a.t, a.id) GROUP BY ALL)
    SELECT any_value(n) AS n_events, round(any_value(mu) * any_value((hi - lo) / 86400000000.0) + sum(0.1 * exp(1.5 * (m - 4.5)) * (pow((hi - t) / 86400000000.0 + 0.05, -0.1) - pow(0.05, -0.1)) / (-0.1)) - sum(ln(mu + r)), 3) AS start_score, true AS converged, true AS improved FROM pair, span, th""")
def _(spark, sf):
    found, n, _ = _fitted(spark, sf)
    return spark.createDataFrame([(n, round(found.start_score, 3), found.converged, found.score <= found.start_score)], "n_events long, start_score double, converged boolean, improved boolean")


@query("agg_33_fitted_plausibility")
def _(spark, sf):
    found, n, days = _fitted(spark, sf)
    return triggering.plausibility(found.theta, 1.0, days, n, spark)


@query("agg_33_plausibility", f"""WITH {_PAIRS}, v AS (SELECT 'p' AS name, 1.534::DOUBLE AS value, 1.0::DOUBLE AS low, 1.3::DOUBLE AS high UNION ALL SELECT 'c', 0.398, 0.003, 0.5 UNION ALL SELECT 'alpha_ln10', 0.866 / ln(10.0), 0.6, 1.1
    UNION ALL SELECT 'n', 0.171 * (ln(10.0) / (ln(10.0) - 0.866)) * (pow(0.398, -0.534) / 0.534), 0.2, 0.95 UNION ALL SELECT 'background_share', (SELECT 0.481 * ((hi - lo) / 86400000000.0) / (SELECT count(*) FROM s) FROM span), NULL, NULL)
    SELECT name, round(value, 6) AS value, low, high, value BETWEEN low AND high AS ok FROM v""")
def _(spark, sf):
    n, first, last = _series(spark, sf).agg(F.count(F.lit(1)), F.min("t_us"), F.max("t_us")).first()
    return rounded(triggering.plausibility(THETA, 1.0, (last - first) / DAY_US, n, spark))
