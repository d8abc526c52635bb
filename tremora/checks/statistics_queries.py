"""Frequency-magnitude statistics, summaries, seasonality, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremora.checks import sql as S
from tremora.checks.registry import query, rounded
from tremora.fixed import MACRO_BOXES
from tremora.operators import context, frequency, normalize, regions
from tremora.plans.driver_tables import catalog
from tremora.plans.reports import context_document
from tremora.session import scratch_path
from tremora.sinks import tables as sinks

_Y2008 = 1_199_145_600_000_000


def _bins(source: str, keys: str = "", mag: str = "preferred_mw") -> str:
    """bins, range_, filled, suf: zero-filled bins with suffix sums and law columns per group."""
    k, kk = (f"{keys}, ", f"{keys}") if keys else ("", "1")
    same = f"AND b.{keys} = r.{keys}" if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""bins AS (SELECT {k}floor(round({mag} / 0.1::DOUBLE, 6) + 0.5::DOUBLE)::BIGINT AS bin, count(*) AS n, sum({mag}) AS s1, sum({mag} * {mag}) AS s2 FROM {source} GROUP BY ALL),
    range_ AS (SELECT {k}floor(min(round({mag} / 0.1::DOUBLE, 6)))::BIGINT AS lo, ceil(max(round({mag} / 0.1::DOUBLE, 6)))::BIGINT AS hi FROM {source} {f'GROUP BY {keys}' if keys else ''}),
    slots AS (SELECT {k}unnest(range(lo, hi + 1)) AS bin FROM range_),
    filled AS (SELECT {f'r.{keys}, ' if keys else ''}r.bin, coalesce(n, 0) AS n, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2 FROM slots r LEFT JOIN bins b ON b.bin = r.bin {same}),
    cums AS (SELECT {k}bin, n, round(bin * 0.1, 5) AS center, sum(n) OVER w AS c_n, sum(s1) OVER w AS c_s1, sum(s2) OVER w AS c_s2 FROM filled WINDOW w AS ({part} ORDER BY bin DESC ROWS UNBOUNDED PRECEDING)),
    suf AS (SELECT *, c_s1 / c_n AS mean_mag,
        CASE WHEN c_n >= 2 AND c_s1 / c_n - (center - 0.05) > 0 THEN log10(exp(1)) / (c_s1 / c_n - (center - 0.05)) END AS b,
        CASE WHEN c_n >= 2 AND c_s1 / c_n - (center - 0.05) > 0 THEN 2.30 * pow(log10(exp(1)) / (c_s1 / c_n - (center - 0.05)), 2) * sqrt(greatest(c_s2 - c_s1 * c_s1 / c_n, 0) / (c_n * (c_n - 1.0))) END AS sigma_b,
        CASE WHEN c_n >= 2 AND c_s1 / c_n - (center - 0.05) > 0 THEN log10(c_n) + log10(exp(1)) / (c_s1 / c_n - (center - 0.05)) * center END AS a FROM cums)"""


def _fit(keys: str = "") -> str:
    """..., tried, gft: misfit per cutoff and the chosen cutoff."""
    same = f"AND o.{keys} = c.{keys}" if keys else ""
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""tried AS (SELECT {f'c.{keys}, ' if keys else ''}c.bin, c.center, c.b, 100.0 * (1 - sum(abs(o.c_n - pow(10, c.a - c.b * o.center))) / sum(o.c_n)) AS r
        FROM suf c JOIN suf o ON o.bin >= c.bin {same} WHERE c.c_n >= 25 AND c.b IS NOT NULL GROUP BY ALL),
    gft AS (SELECT {k}coalesce(min(bin) FILTER (r >= 95), min(bin) FILTER (r >= 90), arg_max(bin, (r, -bin))) AS bin,
        CASE WHEN count(*) FILTER (r >= 95) > 0 THEN 95 WHEN count(*) FILTER (r >= 90) > 0 THEN 90 ELSE 0 END AS level FROM tried {group})"""


_LAW = "round(b, 6) AS b, round(sigma_b, 6) AS sigma_b, round(a, 6) AS a, round(mean_mag, 6) AS mean_mag"


@query("agg_04_frequency_distribution", f"WITH {S.cat()}, {_bins('cat')} SELECT center, n AS n_bin, c_n::BIGINT AS n_cum FROM suf")
def _(spark, sf):
    return frequency.frequency_distribution(catalog(spark, sf), "preferred_mw")


@query("win_01_cumulative_by_country", f"WITH {S.cat(True)}, {_bins('cat', 'country')} SELECT country, center, n AS n_bin, c_n::BIGINT AS n_cum FROM suf")
def _(spark, sf):
    return frequency.frequency_distribution(catalog(spark, sf, True), "preferred_mw", ["country"])


@query("agg_05_completeness_peak", f"WITH {S.cat(True)}, {_bins('cat', 'country')} SELECT country, sum(n)::BIGINT AS n, round(arg_max(center, (n, -bin)) + 0.2, 5) AS mc FROM suf GROUP BY 1")
def _(spark, sf):
    return rounded(frequency.completeness_peak(catalog(spark, sf, True), "preferred_mw", ["country"]), 5)


@query("agg_06_completeness_fit", f"WITH {S.cat(True)}, {_bins('cat', 'country')}, {_fit('country')} SELECT country, t.center AS mc, round(t.r, 6) AS r, g.level, round(t.b, 6) AS b FROM gft g JOIN tried t USING (country, bin)")
def _(spark, sf):
    # Countries with too few events for any cutoff have no row in the SQL.
    return rounded(frequency.completeness_fit(catalog(spark, sf, True), "preferred_mw", ["country"]).filter("mc IS NOT NULL"))


@query("agg_07_b_value", f"WITH {S.cat()}, {_bins('cat')} SELECT 4.5::DOUBLE AS mc, c_n::BIGINT AS n, {_LAW} FROM suf WHERE bin = 45")
def _(spark, sf):
    return rounded(frequency.b_value(catalog(spark, sf), "preferred_mw", 4.5))


@query("agg_08_law_and_rate", f"WITH {S.cat()}, {_bins('cat')} SELECT mc, n, round(b, 6) AS b, round(sigma_b, 6) AS sigma_b, round(a, 6) AS a, round(mean_mag, 6) AS mean_mag, n_group, round(pow(10, a - b * 6.0) / 10.0, 6) AS rate FROM (SELECT center AS mc, c_n::BIGINT AS n, b, sigma_b, a, mean_mag, (SELECT sum(n)::BIGINT FROM suf) AS n_group FROM suf WHERE bin = (SELECT arg_max(bin, (n, -bin)) + 2 FROM suf))")
def _(spark, sf):
    return rounded(frequency.rate_at_least(frequency.frequency_law(catalog(spark, sf), "preferred_mw"), 6.0, 10.0))


_MACRO = " UNION ALL ".join(
    f"SELECT '{name}' AS region, * FROM cat WHERE latitude BETWEEN {b.min_lat} AND {b.max_lat} AND longitude BETWEEN {b.min_lon} AND {b.max_lon}" for name, b in MACRO_BOXES.items()
)


@query("join_14_boxes", f"WITH {S.cat()}, boxed AS ({_MACRO}) SELECT region, count(*) AS n, round(avg(preferred_mw), 6) AS mean_mw FROM boxed GROUP BY 1")
def _(spark, sf):
    boxed = regions.boxes_containing(catalog(spark, sf), MACRO_BOXES)
    return rounded(boxed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.avg("preferred_mw").alias("mean_mw")))


_CHOSEN = f"SELECT {{k}}, (SELECT sum(n)::BIGINT FROM suf x WHERE x.{{k}} = s.{{k}}) AS n_group, center AS mc, c_n::BIGINT AS n, round(b, 6) AS b, round(sigma_b, 6) AS sigma_b, round(a, 6) AS a, round(mean_mag, 6) AS mean_mag FROM suf s"


@query("agg_09_law_by_macro_region", f"WITH {S.cat()}, boxed AS ({_MACRO}), {_bins('boxed', 'region')}, {_fit('region')} {_CHOSEN.format(k='region')} JOIN gft g USING (region, bin)")
def _(spark, sf):
    boxed = regions.boxes_containing(catalog(spark, sf), MACRO_BOXES)
    return rounded(frequency.frequency_law(boxed, "preferred_mw", ["region"], method="fit"))


@query("agg_09_law_by_decade", f"WITH {S.cat()}, dated AS (SELECT *, year(make_timestamp(t_us)) // 10 * 10 AS decade FROM cat), {_bins('dated', 'decade')}, peak AS (SELECT decade, arg_max(bin, (n, -bin)) + 2 AS bin FROM suf GROUP BY 1 HAVING sum(n) >= 100) {_CHOSEN.format(k='decade')} JOIN peak USING (decade, bin)")
def _(spark, sf):
    dated = catalog(spark, sf).withColumn("decade", context.decade_of(F.col("t_us")))
    return rounded(frequency.frequency_law(dated, "preferred_mw", ["decade"], min_group=100))


_FAN = " UNION ALL ".join(
    f"SELECT '{s}' AS scheme, {S.mw(s)} AS mw FROM (SELECT preferred_mag AS magnitude, preferred_mag_type AS magnitude_type FROM cat WHERE preferred_mag_type IS NOT NULL)"
    for s in ("scordilis", "digiacomo", "peru", "igp_national")
)


@query("agg_09_b_by_scheme", f"""WITH {S.cat()}, fan AS ({_FAN}), kept AS (SELECT scheme, count(*) AS n, avg(mw) AS m, sum(mw) AS s1, sum(mw * mw) AS s2 FROM fan WHERE mw >= 4.5 - 0.05 - 1e-9 GROUP BY 1)
    SELECT scheme, 4.5::DOUBLE AS mc, n, round(log10(exp(1)) / (m - 4.45), 6) AS b, round(2.30 * pow(log10(exp(1)) / (m - 4.45), 2) * sqrt((s2 - n * m * m) / (n * (n - 1.0))), 6) AS sigma_b, round(log10(n) + log10(exp(1)) / (m - 4.45) * 4.5, 6) AS a, round(m, 6) AS mean_mag FROM kept""")
def _(spark, sf):
    return rounded(frequency.b_value(normalize.fan_out_schemes(catalog(spark, sf)), "mw", 4.5, ["scheme"]))


@query("agg_09_b_moment_typed", f"WITH {S.cat()}, typed AS (SELECT * FROM cat WHERE lower(coalesce(preferred_mag_type, '')) LIKE 'mw%'), {_bins('typed')} SELECT (SELECT sum(n)::BIGINT FROM suf) AS n_group, center AS mc, c_n::BIGINT AS n, round(b, 6) AS b, round(sigma_b, 6) AS sigma_b, round(a, 6) AS a, round(mean_mag, 6) AS mean_mag FROM suf WHERE bin = (SELECT arg_max(bin, (n, -bin)) + 2 FROM suf) AND (SELECT sum(n) FROM suf) > 300")
def _(spark, sf):
    typed = catalog(spark, sf).filter(normalize.moment_typed(F.col("preferred_mag_type")))
    return rounded(frequency.frequency_law(typed, "preferred_mw", min_group=301))


@query("agg_10_summary", f"WITH {S.cat()} SELECT count(*) AS n_events, min(t_us) AS first_us, max(t_us) AS last_us, min(preferred_mw) AS mw_min, max(preferred_mw) AS mw_max FROM cat")
def _(spark, sf):
    return context.summary(catalog(spark, sf))


@query("agg_11_by_decade", f"WITH {S.cat()} SELECT year(make_timestamp(t_us)) // 10 * 10 AS decade, count(*) AS n FROM cat GROUP BY 1")
def _(spark, sf):
    return context.by_decade(catalog(spark, sf))


@query("agg_12_neighbours", f"""WITH {S.cat(True)} SELECT country, count(*) FILTER (preferred_mw >= 5) AS n_m5, count(*) FILTER (preferred_mw >= 6) AS n_m6, count(*) FILTER (preferred_mw >= 7) AS n_m7,
    count(*) FILTER (preferred_mw >= 5 AND t_us >= {_Y2008}) AS recent_m5, max(preferred_mw) AS max_mw, strftime(make_timestamp(-arg_max(-t_us, (preferred_mw, -t_us))), '%Y-%m-%d') AS max_date
    FROM cat WHERE country <> 'Other' GROUP BY 1""")
def _(spark, sf):
    return context.neighbours(catalog(spark, sf, True), _Y2008)


_MONTHLY = f"{S.cat()}, {S.months()}, monthly AS (SELECT m.month, count(c.canonical_id) AS n FROM months m LEFT JOIN (SELECT *, month(make_timestamp(t_us)) AS mon FROM cat WHERE country = 'Peru' AND preferred_mw >= 5.0) c ON c.mon = m.month GROUP BY 1)"
_NAMES = "['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic']"
_DAYS = "[31, 28.25, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]"


def _felt(spark, sf, min_mag=5.0):
    return catalog(spark, sf).filter((F.col("country") == "Peru") & (F.col("preferred_mw") >= min_mag))


@query("agg_13_monthly_counts", f"WITH {_MONTHLY} SELECT month, ({_NAMES})[month] AS name, n FROM monthly")
def _(spark, sf):
    return context.monthly_counts(_felt(spark, sf))


@query("agg_14_chi_square", f"WITH {_MONTHLY}, e AS (SELECT n, (SELECT sum(n) FROM monthly) * ({_DAYS})[month]::DOUBLE / 365.25 AS expected FROM monthly) SELECT round(sum(pow(n - expected, 2) / expected), 6) AS chi2, 11::BIGINT AS df FROM e")
def _(spark, sf):
    return rounded(context.chi_square(context.monthly_counts(_felt(spark, sf))))


# the power series of the lower tail at 11 / 2
@query("agg_14_chi_square_p", f"WITH {_MONTHLY}, e AS (SELECT n, (SELECT sum(n) FROM monthly) * ({_DAYS})[month]::DOUBLE / 365.25 AS expected FROM monthly), c AS (SELECT sum(pow(n - expected, 2) / expected) AS chi2 FROM e) SELECT round(chi2, 6) AS chi2, 11::BIGINT AS df, round(greatest(1 - sum(exp((5.5 + k) * ln(chi2 / 2) - chi2 / 2 - lgamma(6.5 + k))), 0), 6) + 0 AS p FROM c, range(0, 20000) r(k) GROUP BY chi2")
def _(spark, sf):
    return rounded(context.chi_square_p(context.monthly_counts(_felt(spark, sf))))


_ANGLES = "SELECT count(*) AS n, sum(cos(2 * pi() * dayofyear(make_timestamp(t_us)) / 365.25)) AS c, sum(sin(2 * pi() * dayofyear(make_timestamp(t_us)) / 365.25)) AS s FROM cat WHERE country = 'Peru' AND preferred_mw >= {m}"


@query("agg_15_periodicity", f"WITH {S.cat()}, m5 AS ({_ANGLES.format(m=5.0)}), m6 AS ({_ANGLES.format(m=6.0)}), u AS (SELECT 'm5' AS label, * FROM m5 UNION ALL SELECT 'm6', * FROM m6 WHERE n > 5) SELECT label, n, round(exp(-(c * c + s * s) / n), 6) AS p, round(sqrt(c * c + s * s) / n, 6) AS r_mean FROM u")
def _(spark, sf):
    m5 = context.periodicity(_felt(spark, sf)).select(F.lit("m5").alias("label"), "*")
    m6 = context.periodicity(_felt(spark, sf, 6.0), min_events=5).select(F.lit("m6").alias("label"), "*")
    return rounded(m5.unionByName(m6))


_NEIGHBOUR = "country STRING, n_m5 BIGINT, n_m6 BIGINT, n_m7 BIGINT, recent_m5 BIGINT, max_mw DOUBLE, max_date STRING"
_CONTEXT = f"""seasonality STRUCT<months: ARRAY<STRING>, counts_m5: ARRAY<BIGINT>, n_m5: BIGINT, n_m6: BIGINT, top_month: STRING, chi2: DOUBLE, p_chi2: DOUBLE, schuster_p_m5: DOUBLE, schuster_p_m6: DOUBLE, significant: BOOLEAN, big_months: ARRAY<STRING>>,
    neighbours STRUCT<since_year: BIGINT, recent_year: BIGINT, by_country: ARRAY<STRUCT<{_NEIGHBOUR.replace(" STRING", ": STRING").replace(" BIGINT", ": BIGINT").replace(" DOUBLE", ": DOUBLE")}>>>"""


@query("snk_07_context_fields", f"""WITH {S.cat(True)}, {S.months()},
    felt AS (SELECT *, month(make_timestamp(t_us)) AS mon, 2 * pi() * dayofyear(make_timestamp(t_us)) / 365.25 AS angle FROM cat WHERE country = 'Peru' AND t_us >= 946684800000000 AND preferred_mw >= 5.0),
    monthly AS (SELECT m.month, count(f.canonical_id) AS n FROM months m LEFT JOIN felt f ON f.mon = m.month GROUP BY 1),
    expected AS (SELECT month, n, (SELECT sum(n) FROM monthly) * ({_DAYS})[month]::DOUBLE / 365.25 AS x FROM monthly),
    year AS (SELECT string_agg(n::VARCHAR, ',' ORDER BY month) AS counts_m5, sum(n)::BIGINT AS felt_m5, ({_NAMES})[arg_max(month, (n, -month))] AS top_month, sum(pow(n - x, 2) / x) AS chi2 FROM expected),
    tail AS (SELECT greatest(1 - sum(exp((5.5 + k) * ln(chi2 / 2) - chi2 / 2 - lgamma(6.5 + k))), 0) AS p_chi2 FROM year, range(0, 20000) r(k)),
    s5 AS (SELECT exp(-(pow(sum(cos(angle)), 2) + pow(sum(sin(angle)), 2)) / count(*)) AS p5 FROM felt),
    s6 AS (SELECT count(*) AS felt_m6, CASE WHEN count(*) > 5 THEN exp(-(pow(sum(cos(angle)), 2) + pow(sum(sin(angle)), 2)) / count(*)) END AS p6 FROM felt WHERE preferred_mw >= 6),
    big AS (SELECT coalesce(string_agg(strftime(make_timestamp(t_us), '%b'), ',' ORDER BY preferred_mw DESC, t_us), '') AS big_months FROM (SELECT * FROM felt WHERE preferred_mw >= 7 ORDER BY preferred_mw DESC, t_us, canonical_id LIMIT 8)),
    near AS (SELECT country, count(*) FILTER (preferred_mw >= 5) AS n_m5, count(*) FILTER (preferred_mw >= 6) AS n_m6, count(*) FILTER (preferred_mw >= 7) AS n_m7,
        count(*) FILTER (preferred_mw >= 5 AND t_us >= {_Y2008}) AS recent_m5, round(max(preferred_mw), 1) AS max_mw, strftime(make_timestamp(-arg_max(-t_us, (preferred_mw, -t_us))), '%Y-%m-%d') AS max_date FROM cat WHERE country <> 'Other' GROUP BY 1)
    SELECT near.*, (SELECT year(make_timestamp(min(t_us)))::BIGINT FROM cat) AS since_year, 2008::BIGINT AS recent_year, array_to_string({_NAMES}, ',') AS months, counts_m5, felt_m5, felt_m6, top_month, round(chi2, 2) AS chi2, round(p_chi2, 3) AS p_chi2, round(p5, 3) AS p5, round(p6, 3) AS p6, coalesce(p6 < 0.05, false) AS significant, big_months
    FROM near, year, tail, s5, s6, big""")
def _(spark, sf):
    """Every field of the context document, read back from its JSON."""
    path = scratch_path(spark, "context")
    sinks.write_document(context_document(catalog(spark, sf, True), _Y2008), path)
    read = spark.read.schema(_CONTEXT).json(path)
    season = [F.array_join(f"seasonality.{c}", ",").alias(c) for c in ("months", "counts_m5", "big_months")]
    named = {"n_m5": "felt_m5", "n_m6": "felt_m6", "top_month": "top_month", "chi2": "chi2", "p_chi2": "p_chi2", "schuster_p_m5": "p5", "schuster_p_m6": "p6", "significant": "significant"}
    fields = read.select(*season, *[F.col(f"seasonality.{c}").alias(n) for c, n in named.items()], "neighbours.since_year", "neighbours.recent_year", F.inline("neighbours.by_country"))
    return rounded(fields)


@query("agg_30_depth_histogram", f"WITH {S.cat()}, d AS (SELECT least(floor(depth_km / 20), 33)::BIGINT AS slot FROM cat WHERE depth_km BETWEEN 0 AND 680) SELECT r.slot * 20 AS depth_from, count(d.slot) AS n FROM (SELECT unnest(range(0, 34)) AS slot) r LEFT JOIN d ON d.slot = r.slot GROUP BY 1")
def _(spark, sf):
    return frequency.depth_histogram(catalog(spark, sf))


# --- order and top-k --------------------------------------------------------------------------------


@query("top_01_stable_order", f"WITH {S.cat()} SELECT canonical_id, t_us, row_number() OVER (ORDER BY t_us, canonical_id) AS position FROM cat")
def _(spark, sf):
    from tremora.operators.ranking import dense_ids
    return dense_ids(catalog(spark, sf).select("canonical_id", "t_us"), ["t_us", "canonical_id"], "position")


@query("top_02_largest", f"WITH {S.cat()} SELECT canonical_id, t_us, preferred_mw FROM cat ORDER BY preferred_mw DESC, t_us, canonical_id LIMIT 12")
def _(spark, sf):
    return context.largest_events(catalog(spark, sf), 12).select("canonical_id", "t_us", "preferred_mw")


@query("top_03_latest", f"WITH {S.cat()} SELECT canonical_id, t_us, preferred_mw FROM cat WHERE preferred_mw >= 5.0 ORDER BY t_us DESC, canonical_id LIMIT 100")
def _(spark, sf):
    return context.latest_events(catalog(spark, sf)).select("canonical_id", "t_us", "preferred_mw")


@query("top_06_peaks", f"WITH {_MONTHLY}, {_bins('cat')} SELECT arg_max(month, (n, -month)) AS top_month, (SELECT arg_max(center, (n, -bin)) FROM suf) AS peak FROM monthly")
def _(spark, sf):
    months = context.monthly_counts(_felt(spark, sf)).agg(F.max_by("month", F.struct("n", -F.col("month"))).alias("top_month"))
    peak = frequency.completeness_peak(catalog(spark, sf), "preferred_mw", correction=0.0).select("mc")
    return months.withColumn("peak", peak.scalar())
