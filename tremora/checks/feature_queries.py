"""Cell x instant features, as-of and interval lookups, targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremora.checks import sql as S
from tremora.checks.registry import EXACT, query, rounded
from tremora.fixed import DAY_US, TRIGGER_ALPHA, TRIGGER_C, TRIGGER_K, TRIGGER_MU, TRIGGER_P
from tremora.functions.geo import Lattice
from tremora.functions.rates import Triggering
from tremora.operators import features
from tremora.plans.driver_tables import catalog

_THETA = Triggering(TRIGGER_MU, TRIGGER_K, TRIGGER_ALPHA, TRIGGER_C, TRIGGER_P, 4.0)
SPEC = features.FeatureSpec(lattice=Lattice(0.25), min_mag=4.0, triggering=_THETA, triggering_window_days=365)


def table(spark, sf):
    return features.feature_table(catalog(spark, sf), SPEC)


def _placed(spark, sf):
    return features.grid_events(catalog(spark, sf), SPEC)


_OWN = "FROM base b LEFT JOIN ev e ON e.i = b.i AND e.j = b.j"
_AROUND = "FROM base b LEFT JOIN ev e ON e.i BETWEEN b.i - 1 AND b.i + 1 AND e.j BETWEEN b.j - 1 AND b.j + 1"
_KERNEL = "0.171 * exp(0.866 * (e.mag - 4.0)) * pow((b.t - e.t_us) / 86400000000.0 + 0.398, -1.534)"


def _flag(days: int, m: float) -> str:
    return f"coalesce(max((({S.ahead(days)}) AND e.mag >= {m})::INT), 0)::BIGINT"


_COLUMNS = {
    "days_since_last": "coalesce((b.t - max(e.t_us) FILTER (e.t_us <= b.t))::DOUBLE / 86400000000.0::DOUBLE, 99999.0)",
    "days_since_M5": "coalesce((b.t - max(e.t_us) FILTER (e.t_us <= b.t AND e.mag >= 5.0))::DOUBLE / 86400000000.0::DOUBLE, 99999.0)",
    "cnt_7d": f"count(*) FILTER ({S.past(7)})", "cnt_30d": f"count(*) FILTER ({S.past(30)})", "cnt_90d": f"count(*) FILTER ({S.past(90)})", "cnt_365d": f"count(*) FILTER ({S.past(365)})",
    "cnt_all": "count(*) FILTER (e.t_us <= b.t)",
    "maxmag_30d": f"coalesce(max(e.mag) FILTER ({S.past(30)}), 0)", "maxmag_90d": f"coalesce(max(e.mag) FILTER ({S.past(90)}), 0)", "maxmag_365d": f"coalesce(max(e.mag) FILTER ({S.past(365)}), 0)",
    "logE_30d": f"round(log10(1 + coalesce(sum(pow(10.0, 1.5 * e.mag)) FILTER ({S.past(30)}), 0)), 6)", "logE_365d": f"round(log10(1 + coalesce(sum(pow(10.0, 1.5 * e.mag)) FILTER ({S.past(365)}), 0)), 6)",
    "y_m6_30d": _flag(30, 6.0), "y_m5_30d": _flag(30, 5.0), "y_m5_7d": _flag(7, 5.0),
    "etas_cell": f"round(ln(1 + coalesce(sum(CASE WHEN {S.past(365)} THEN {_KERNEL} END), 0)), 6)",
}


def _own(*names: str) -> str:
    picked = ", ".join(f"{_COLUMNS[n]} AS {n}" for n in names)
    return f"WITH {S.grid()} SELECT b.cell_id, b.t AS t_us, {picked} {_OWN} GROUP BY b.cell_id, b.k, b.t"


def _column_query(name: str, *columns: str) -> None:
    @query(name, _own(*columns))
    def _(spark, sf):
        return rounded(table(spark, sf).select("cell_id", "t_us", *columns), 6, days_since_last=EXACT, days_since_M5=EXACT)


_column_query("join_05_trailing_windows", "cnt_7d", "cnt_30d", "cnt_90d", "cnt_365d")
_column_query("join_06_targets", "y_m6_30d", "y_m5_30d", "y_m5_7d")
_column_query("win_02_running_count", "cnt_all")
_column_query("win_03_window_aggregates", "maxmag_30d", "maxmag_90d", "maxmag_365d", "logE_30d", "logE_365d")
_column_query("win_04_any_ahead", "y_m5_7d")
_column_query("win_09_triggering_feature", "etas_cell")

_SINCE = ", ".join(f"{_COLUMNS[c]} AS {c}" for c in ("days_since_last", "days_since_M5"))


@query("join_04_as_of", f"WITH {S.grid()} SELECT b.cell_id, b.t AS t_us, {_SINCE} {_OWN} GROUP BY b.cell_id, b.k, b.t")
def _(spark, sf):
    return table(spark, sf).select("cell_id", "t_us", "days_since_last", "days_since_M5")


@query("win_06_last_before", f"WITH {S.grid()} SELECT b.cell_id, b.t AS t_us, {_COLUMNS['days_since_last']} AS days_since_last {_OWN} GROUP BY b.cell_id, b.k, b.t")
def _(spark, sf):
    return table(spark, sf).select("cell_id", "t_us", "days_since_last")


@query("join_07_neighbourhood", f"WITH {S.grid()} SELECT b.cell_id, b.t AS t_us, count(*) FILTER ({S.past(30)}) AS nb_cnt_30d, count(*) FILTER ({S.past(365)}) AS nb_cnt_365d, coalesce(max(e.mag) FILTER ({S.past(365)}), 0) AS nb_maxmag_365d, round(ln(1 + coalesce(sum(CASE WHEN {S.past(365)} THEN {_KERNEL} END), 0)), 6) AS etas_nb {_AROUND} GROUP BY b.cell_id, b.k, b.t")
def _(spark, sf):
    return rounded(table(spark, sf).select("cell_id", "t_us", "nb_cnt_30d", "nb_cnt_365d", "nb_maxmag_365d", "etas_nb"))


@query("join_09_cells_by_instants", f"WITH {S.grid()} SELECT cell_id, t AS t_us FROM base")
def _(spark, sf):
    placed = _placed(spark, sf)
    n = features.instant_count(placed, SPEC)
    cells = features.active_cells(placed, SPEC.min_active_events)
    grid = SPEC.lattice
    return cells.select(grid.cell_id(F.col("i"), F.col("j")).alias("cell_id"), F.explode(features.instants_of(SPEC, n)).alias("k")).select(
        "cell_id", (F.lit(SPEC.start_us) + F.col("k") * F.lit(SPEC.step_us)).alias("t_us")
    )


@query("join_15_active_events", f"WITH {S.grid()} SELECT e.i, e.j, count(*) AS n, max(e.mag) AS max_mag FROM ev e SEMI JOIN active a ON a.i = e.i AND a.j = e.j GROUP BY 1, 2")
def _(spark, sf):
    placed = _placed(spark, sf)
    kept = placed.join(features.active_cells(placed, SPEC.min_active_events), ["i", "j"], "left_semi")
    return kept.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.max("mag").alias("max_mag"))


@query("agg_25_active_cells", f"WITH {S.grid()} SELECT * FROM active")
def _(spark, sf):
    return features.active_cells(_placed(spark, sf), SPEC.min_active_events)


@query("agg_26_region_windows", f"WITH {S.grid()} SELECT t AS t_us, (SELECT count(*) FROM ev e WHERE {S.past(30)}) AS reg_cnt_30d, (SELECT coalesce(max(e.mag), 0) FROM ev e WHERE {S.past(30)}) AS reg_maxmag_30d FROM inst b")
def _(spark, sf):
    return table(spark, sf).select("t_us", "reg_cnt_30d", "reg_maxmag_30d").distinct()


@query("agg_28_positives", f"WITH {S.grid()}, f AS (SELECT {_COLUMNS['y_m6_30d']} AS y6, {_COLUMNS['y_m5_30d']} AS y5, {_COLUMNS['y_m5_7d']} AS y5w {_OWN} GROUP BY b.cell_id, b.k, b.t) SELECT 'y_m6_30d' AS target, sum(y6)::BIGINT AS n_pos, round(avg(y6), 8) AS share FROM f UNION ALL SELECT 'y_m5_30d', sum(y5)::BIGINT, round(avg(y5), 8) FROM f UNION ALL SELECT 'y_m5_7d', sum(y5w)::BIGINT, round(avg(y5w), 8) FROM f")
def _(spark, sf):
    return rounded(features.positives(table(spark, sf)), 8)


@query("date_02_instants", f"WITH {S.grid()} SELECT k, t AS t_us FROM inst")
def _(spark, sf):
    n = features.instant_count(_placed(spark, sf), SPEC)
    return spark.range(n).select(F.col("id").alias("k"), (F.lit(SPEC.start_us) + F.col("id") * F.lit(SPEC.step_us)).alias("t_us"))


_ALL = ", ".join(f"{e} AS {n}" for n, e in _COLUMNS.items())


@query("mod_16_feature_table", f"""WITH {S.grid()}, own AS (SELECT b.cell_id, b.i, b.j, b.k, b.t, {_ALL} {_OWN} GROUP BY b.cell_id, b.i, b.j, b.k, b.t),
    nb AS (SELECT b.cell_id, b.k, count(*) FILTER ({S.past(30)}) AS nb_cnt_30d, count(*) FILTER ({S.past(365)}) AS nb_cnt_365d, coalesce(max(e.mag) FILTER ({S.past(365)}), 0) AS nb_maxmag_365d, round(ln(1 + coalesce(sum(CASE WHEN {S.past(365)} THEN {_KERNEL} END), 0)), 6) AS etas_nb {_AROUND} GROUP BY b.cell_id, b.k),
    reg AS (SELECT k, (SELECT count(*) FROM ev e WHERE {S.past(30)}) AS reg_cnt_30d, (SELECT coalesce(max(e.mag), 0) FROM ev e WHERE {S.past(30)}) AS reg_maxmag_30d FROM inst b)
    SELECT own.* EXCLUDE (k, t), t AS t_us, -18.5::DOUBLE + (i + 0.5) * 0.25 AS cen_lat, -81.5::DOUBLE + (j + 0.5) * 0.25 AS cen_lon, nb_cnt_30d, nb_cnt_365d, nb_maxmag_365d, etas_nb, reg_cnt_30d, reg_maxmag_30d
    FROM own JOIN nb USING (cell_id, k) JOIN reg USING (k)""")
def _(spark, sf):
    return rounded(table(spark, sf), 6, days_since_last=EXACT, days_since_M5=EXACT)
