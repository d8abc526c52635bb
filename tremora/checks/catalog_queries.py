"""Normalisation, predicates, association, canonical events, scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tremora.checks import sql as S
from tremora.checks.registry import query, rounded
from tremora.fixed import ORIGIN_PRIORITY, SOUTH_CENTROID, STUDY_BOX
from tremora.functions.geo import Lattice, country_of, haversine_km, in_box
from tremora.functions.magnitude import clean_type, method_rank, source_rank, to_mw
from tremora.functions.rates import (
    branching_ratio,
    clip, days_between, decay_integral, elapsed_years, energy, extrapolated_rate, log_energy, poisson_probability, yearly_rate,
)
from tremora.operators import canonical, context, normalize
from tremora.operators.linkage import associate, close_pairs
from tremora.plans.driver_tables import catalog, observations, raw_observations, reports
from tremora.sinks.tables import with_columns
from tremora.sources.landing import union_sources

ID = ("source", "source_event_id")


def linked_observations(spark, sf):
    return associate(observations(spark, sf))


# --- normalisation ----------------------------------------------------------------------------------


@query("norm_01_valid_positions", f"WITH {S.raw(True)} SELECT source, source_event_id, latitude, longitude FROM raw WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180")
def _(spark, sf):
    raw = raw_observations(spark, sf, wide=True)
    return raw.filter(normalize.valid_position(F.col("latitude"), F.col("longitude"))).select(*ID, "latitude", "longitude")


@query("norm_02_utc_times", f"WITH {S.reports()} SELECT event_id, t_us, strftime(make_timestamp(t_us), '%Y-%m-%d %H:%M:%S') AS utc FROM reports")
def _(spark, sf):
    return reports(spark, sf).select("event_id", "t_us", F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("norm_03_depth", f"WITH {S.reports()} SELECT event_id, {S.DEPTH} AS depth_km FROM reports")
def _(spark, sf):
    return reports(spark, sf).select("event_id", normalize.sane_depth(F.col("depth_raw")).alias("depth_km"))


@query("norm_04_derived_fields", f"WITH {S.raw()} SELECT source, source_event_id, round(coalesce(given, {S.mw()}), 8) AS mw, CASE WHEN given IS NOT NULL THEN 'given' ELSE {S.mw_method()} END AS mw_method, {S.COUNTRY} AS country FROM (SELECT *, CASE WHEN magnitude_type = 'ML' THEN magnitude + 0.1 END AS given FROM raw)")
def _(spark, sf):
    raw = raw_observations(spark, sf).withColumn("mw", F.when(F.col("magnitude_type") == "ML", F.col("magnitude") + 0.1))
    raw = raw.withColumn("mw_method", F.when(F.col("mw").isNotNull(), "given")).withColumn("origin_time", F.timestamp_micros("t_us"))
    return rounded(normalize.to_observations(raw).select(*ID, "mw", "mw_method", "country"), 8)


@query("norm_05_country", f"WITH {S.reports(True)} SELECT event_id, {S.COUNTRY} AS country FROM reports")
def _(spark, sf):
    return reports(spark, sf, True).select("event_id", country_of(F.col("latitude"), F.col("longitude")).alias("country"))


@query("norm_06_magnitude_type", "SELECT event_id, lower(trim(coalesce(CASE WHEN event_type <> 'signup' THEN ' ' || upper(event_type) || ' ' END, ''))) AS kind FROM events")
def _(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    kind = F.when(F.col("event_type") != "signup", F.concat(F.lit(" "), F.upper("event_type"), F.lit(" ")))
    return events.select("event_id", clean_type(kind).alias("kind"))


def _scheme_query(number: int, scheme: str) -> None:
    @query(f"norm_{number:02d}_mw_{scheme}", f"WITH {S.raw()} SELECT source, source_event_id, round({S.mw(scheme)}, 8) AS mw, {S.mw_method(scheme)} AS method FROM raw")
    def _(spark, sf):
        c = to_mw(F.col("magnitude"), F.col("magnitude_type"), scheme)
        return rounded(raw_observations(spark, sf).select(*ID, c["mw"].alias("mw"), c["method"].alias("method")), 8)


for _number, _scheme in ((8, "scordilis"), (9, "digiacomo"), (10, "peru"), (11, "igp_national")):
    _scheme_query(_number, _scheme)


@query("norm_07_mw_dispatch", f"WITH {S.raw()} SELECT {S.mw_method()} AS method, count(*) AS n, round(sum({S.mw()}), 4) AS mw_sum FROM raw GROUP BY 1")
def _(spark, sf):
    # A scheme nobody defined converts like the default one.
    c = to_mw(F.col("magnitude"), F.col("magnitude_type"), "undefined")
    raw = raw_observations(spark, sf).select(c["mw"].alias("mw"), c["method"].alias("method"))
    return rounded(raw.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.sum("mw").alias("mw_sum")), 4)


_FAN = " UNION ALL ".join(
    f"SELECT '{s}' AS scheme, {S.mw(s)} AS mw FROM (SELECT preferred_mag AS magnitude, preferred_mag_type AS magnitude_type FROM cat WHERE preferred_mag_type IS NOT NULL)"
    for s in ("scordilis", "digiacomo", "peru", "igp_national")
)


@query("norm_12_scheme_fan_out", f"WITH {S.cat()} SELECT scheme, count(*) AS n, round(avg(mw), 6) AS mean_mw, round(max(mw), 6) AS max_mw FROM ({_FAN}) GROUP BY 1")
def _(spark, sf):
    fan = normalize.fan_out_schemes(catalog(spark, sf))
    return rounded(fan.groupBy("scheme").agg(F.count(F.lit(1)).alias("n"), F.avg("mw").alias("mean_mw"), F.max("mw").alias("max_mw")))


@query("norm_13_method_rank", f"WITH {S.obs()} SELECT mw_method, ({S.METHOD_RANK})::BIGINT AS rank, count(*) AS n FROM obs GROUP BY 1, 2")
def _(spark, sf):
    ranked = observations(spark, sf).select("mw_method", method_rank(F.col("mw_method")).cast("long").alias("rank"))
    return ranked.groupBy("mw_method", "rank").agg(F.count(F.lit(1)).alias("n"))


@query("norm_14_source_rank", f"WITH {S.obs()} SELECT source, ({S.SOURCE_RANK})::BIGINT AS rank, count(*) AS n FROM (SELECT source FROM obs UNION ALL SELECT 'other' FROM obs) GROUP BY 1, 2")
def _(spark, sf):
    o = observations(spark, sf).select("source")
    both = o.unionByName(o.select(F.lit("other").alias("source")))
    return both.select("source", source_rank(F.col("source"), ORIGIN_PRIORITY).cast("long").alias("rank")).groupBy("source", "rank").agg(F.count(F.lit(1)).alias("n"))


@query("norm_15_missing_columns", f"WITH {S.obs()} SELECT source, source_event_id, longitude, latitude, depth_km, magnitude, magnitude_type, NULL::VARCHAR AS author, NULL::VARCHAR AS place, country FROM obs")
def _(spark, sf):
    o = observations(spark, sf)
    like = normalize.to_observations(o.limit(0).withColumn("origin_time", F.timestamp_micros("t_us")))
    wanted = ["source", "source_event_id", "longitude", "latitude", "depth_km", "magnitude", "magnitude_type", "author", "place", "country"]
    return with_columns(o, wanted, like)


@query("norm_16_nan_to_null", "SELECT event_id, CASE WHEN event_type <> 'view' THEN value END AS value FROM events")
def _(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    dirty = F.when(F.col("event_type") == "view", F.lit(float("nan"))).otherwise(F.col("value"))
    return events.select("event_id", normalize.null_if_nan(dirty).alias("value"))


@query("norm_17_points", f"WITH {S.reports()} SELECT event_id, longitude AS x, latitude AS y FROM reports")
def _(spark, sf):
    point = F.struct(F.col("longitude").alias("x"), F.col("latitude").alias("y")).alias("point")
    return reports(spark, sf).select("event_id", point).select("event_id", "point.x", "point.y")


# --- predicates -------------------------------------------------------------------------------------

_Y2002, _Y2005 = 1_009_843_200_000_000, 1_104_537_600_000_000


@query("flt_01_time_window", f"WITH {S.obs()} SELECT source, count(*) AS n, min(t_us) AS first_us, max(t_us) AS last_us FROM obs WHERE t_us BETWEEN {_Y2002} AND {_Y2005} GROUP BY 1")
def _(spark, sf):
    kept = normalize.within(observations(spark, sf), _Y2002, _Y2005)
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))


@query("flt_02_box", f"WITH {S.obs(True)} SELECT source, count(*) AS n, round(sum(latitude), 4) AS lat_sum FROM obs WHERE latitude BETWEEN -60 AND 15 AND longitude BETWEEN -85 AND -58 GROUP BY 1")
def _(spark, sf):
    kept = observations(spark, sf, True).filter(in_box(F.col("latitude"), F.col("longitude"), STUDY_BOX))
    return rounded(kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("latitude").alias("lat_sum")), 4)


@query("flt_03_min_magnitude", f"WITH {S.obs()} SELECT source, count(*) AS n FROM (SELECT source, CASE WHEN magnitude_type = 'mb' THEN NULL ELSE magnitude END AS m FROM obs) WHERE coalesce(m, -99) >= 4.5 GROUP BY 1")
def _(spark, sf):
    partly = observations(spark, sf).withColumn("magnitude", F.when(~F.col("magnitude_type").eqNullSafe("mb"), F.col("magnitude")))
    return normalize.within(partly, -(1 << 62), 1 << 62, min_mag=4.5).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("flt_04_known_magnitude", f"WITH {S.cat()} SELECT count(*) AS n FROM (SELECT CASE WHEN preferred_mag_type IS NOT NULL THEN preferred_mw END AS m FROM cat) WHERE m IS NOT NULL")
def _(spark, sf):
    some = catalog(spark, sf).withColumn("preferred_mw", F.when(F.col("preferred_mag_type").isNotNull(), F.col("preferred_mw")))
    return some.na.drop(subset=["preferred_mw"]).agg(F.count(F.lit(1)).alias("n"))


@query("flt_05_country_subset", f"WITH {S.cat(True)} SELECT canonical_id, t_us, preferred_mw FROM cat WHERE country = 'Peru'")
def _(spark, sf):
    return catalog(spark, sf, True).filter(F.col("country") == "Peru").select("canonical_id", "t_us", "preferred_mw")


@query("flt_06_year_range", f"WITH {S.cat()} SELECT year(make_timestamp(t_us)) AS year, count(*) AS n FROM cat WHERE year(make_timestamp(t_us)) >= 2002 AND year(make_timestamp(t_us)) < 2005 GROUP BY 1")
def _(spark, sf):
    # A range on the time itself instead of on its year can be pushed to files that store it.
    kept = catalog(spark, sf).filter((F.col("t_us") >= _Y2002) & (F.col("t_us") < _Y2005))
    return kept.groupBy(context.year_of(F.col("t_us")).alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_07_moment_typed", f"WITH {S.cat()} SELECT canonical_id, preferred_mw FROM cat WHERE lower(coalesce(preferred_mag_type, '')) LIKE 'mw%'")
def _(spark, sf):
    return catalog(spark, sf).filter(normalize.moment_typed(F.col("preferred_mag_type"))).select("canonical_id", "preferred_mw")


@query("flt_08_group_size", f"WITH {S.cat(True)} SELECT country, count(*) AS n FROM cat GROUP BY 1 HAVING count(*) >= 200")
def _(spark, sf):
    return catalog(spark, sf, True).groupBy("country").agg(F.count(F.lit(1)).alias("n")).filter("n >= 200")


_TO_SOUTH = S.haversine("c", "s")


@query("flt_09_remote_events", f"WITH {S.cat(True)}, s AS (SELECT -16.25::DOUBLE AS latitude, -72.0::DOUBLE AS longitude) SELECT c.canonical_id, round({_TO_SOUTH}, 6) AS km FROM cat c, s WHERE c.country = 'Chile' AND {_TO_SOUTH} >= 600")
def _(spark, sf):
    chile = catalog(spark, sf, True).filter(F.col("country") == "Chile")
    km = haversine_km(F.col("latitude"), F.col("longitude"), F.lit(SOUTH_CENTROID[0]), F.lit(SOUTH_CENTROID[1]))
    return rounded(chile.withColumn("km", km).filter(F.col("km") >= 600.0).select("canonical_id", "km"))


# --- association ------------------------------------------------------------------------------------


@query("join_01_close_pairs", f"WITH {S.obs()}, pairs AS (SELECT a.source_event_id AS a_id, b.source_event_id AS b_id, {S.haversine('a', 'b')} AS km, b.t_us - a.t_us AS gap_us FROM obs a JOIN obs b ON b.t_us >= a.t_us AND b.t_us <= a.t_us + 16000000 WHERE (a.t_us, a.source, a.source_event_id) < (b.t_us, b.source, b.source_event_id)) SELECT a_id, b_id, gap_us, round(km, 6) AS km FROM pairs WHERE km <= 100.0")
def _(spark, sf):
    km = haversine_km(F.col("a_latitude"), F.col("a_longitude"), F.col("b_latitude"), F.col("b_longitude"))
    return rounded(close_pairs(observations(spark, sf)).select(
        F.col("a_source_event_id").alias("a_id"), F.col("b_source_event_id").alias("b_id"), (F.col("b_t_us") - F.col("a_t_us")).alias("gap_us"), km.alias("km")
    ))


@query("join_02_components", f"WITH RECURSIVE {S.linked()} SELECT n_obs, count(*) AS n_groups FROM (SELECT canonical_id, count(*) AS n_obs FROM linked GROUP BY 1) GROUP BY 1")
def _(spark, sf):
    sizes = linked_observations(spark, sf).groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n_obs"))
    return sizes.groupBy("n_obs").agg(F.count(F.lit(1)).alias("n_groups"))


@query("join_03_dense_ids", f"WITH RECURSIVE {S.linked()} SELECT source, source_event_id, canonical_id FROM linked")
def _(spark, sf):
    return linked_observations(spark, sf).select(*ID, "canonical_id")


@query("join_16_preferred_members", f"WITH RECURSIVE {S.events_of_linked()} SELECT canonical_id, source, source_event_id, rn = 1 AS is_preferred FROM origin")
def _(spark, sf):
    linked = linked_observations(spark, sf)
    return canonical.preferred_members(linked, canonical.canonical_events(linked))


@query("agg_01_canonical_events", f"WITH RECURSIVE {S.events_of_linked()} SELECT canonical_id, t_us, round(latitude, 8) AS latitude, round(longitude, 8) AS longitude, depth_km, round(preferred_mw, 8) AS preferred_mw, preferred_mag, preferred_mag_type, preferred_source, mag_source, n_sources, n_obs, country, sources FROM canon")
def _(spark, sf):
    return rounded(canonical.canonical_events(linked_observations(spark, sf)).drop("origin_time"), 8)


@query("agg_02_large_groups", f"WITH RECURSIVE {S.events_of_linked()} SELECT count(*) FILTER (n_obs > 2) AS n_large, max(n_obs) AS max_obs FROM canon")
def _(spark, sf):
    return canonical.large_groups(canonical.canonical_events(linked_observations(spark, sf)), limit=2)


@query("agg_03_fusion_ratio", f"WITH RECURSIVE {S.linked()} SELECT count(*) AS n_observations, max(canonical_id) AS n_events, round(100.0 * (1.0 - max(canonical_id)::DOUBLE / count(*)), 6) AS fusion_pct FROM linked")
def _(spark, sf):
    return rounded(canonical.fusion_ratio(linked_observations(spark, sf)))


@query("agg_35_group_shares", f"WITH RECURSIVE {S.events_of_linked()} SELECT n_sources, count(*) AS n_events, round(count(*)::DOUBLE / sum(count(*)) OVER (), 8) AS share FROM canon GROUP BY 1")
def _(spark, sf):
    events = canonical.canonical_events(linked_observations(spark, sf))
    counted = events.groupBy("n_sources").agg(F.count(F.lit(1)).alias("n_events"))  # one row per number of sources
    return rounded(counted.withColumn("share", F.col("n_events") / F.sum("n_events").over(Window.partitionBy())), 8)


@query("win_05_first_per_group", f"WITH RECURSIVE {S.events_of_linked()} SELECT canonical_id, preferred_source, mag_source FROM canon")
def _(spark, sf):
    events = canonical.canonical_events(linked_observations(spark, sf))
    return events.select("canonical_id", "preferred_source", "mag_source")


@query("win_10_gap_chains", f"WITH {S.obs()}, g AS (SELECT source_event_id, t_us, t_us - lag(t_us) OVER (ORDER BY t_us, source_event_id) AS gap_us FROM obs) SELECT source_event_id AS canonical_id, t_us, gap_us, coalesce(gap_us > 16000000, true) AS starts_chain FROM g")
def _(spark, sf):
    keyed = observations(spark, sf).select(F.col("source_event_id").alias("canonical_id"), "t_us")
    return context.gap_groups(keyed, gap_us=16_000_000)


@query("win_11_dense_numbering", f"WITH RECURSIVE {S.linked()} SELECT canonical_id, min(t_us) AS first_us FROM linked GROUP BY 1")
def _(spark, sf):
    return linked_observations(spark, sf).groupBy("canonical_id").agg(F.min("t_us").alias("first_us"))


# --- set operations ---------------------------------------------------------------------------------


@query("set_01_union_sources", f"WITH {S.obs()} SELECT source, count(*) AS n, count(author) AS n_author FROM (SELECT source, NULL AS author FROM obs UNION ALL SELECT 'usgs', 'x' FROM obs) GROUP BY 1")
def _(spark, sf):
    o = observations(spark, sf)
    extra = o.withColumn("source", F.lit("usgs")).withColumn("author", F.lit("x"))
    both = union_sources(spark, ["first", "second", "nowhere"], {"first": lambda: o, "second": lambda: extra})
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("author").alias("n_author"))


@query("set_02_distinct_keys", f"WITH {S.obs()} SELECT DISTINCT source, event_id FROM (SELECT source, event_id FROM obs UNION ALL SELECT source, event_id FROM obs)")
def _(spark, sf):
    o = observations(spark, sf).select("source", "event_id")
    return o.unionByName(o).dropDuplicates(["source", "event_id"])


@query("set_03_distinct_values", f"WITH {S.obs()} SELECT country, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT magnitude) AS n_magnitudes FROM obs GROUP BY 1")
def _(spark, sf):
    return observations(spark, sf).groupBy("country").agg(
        F.concat_ws(",", F.array_sort(F.collect_set("source"))).alias("sources"), F.countDistinct("magnitude").alias("n_magnitudes")
    )


# --- scalar functions -------------------------------------------------------------------------------


@query("math_01_haversine", f"WITH {S.cat()}, s AS (SELECT -12.05::DOUBLE AS latitude, -77.05::DOUBLE AS longitude) SELECT c.canonical_id, round({_TO_SOUTH}, 6) AS km FROM cat c, s")
def _(spark, sf):
    km = haversine_km(F.col("latitude"), F.col("longitude"), F.lit(-12.05), F.lit(-77.05))
    return rounded(catalog(spark, sf).select("canonical_id", km.alias("km")))


_CELL = "floor((latitude - (-18.5)::DOUBLE) / 0.1::DOUBLE)::BIGINT AS i, floor((longitude - (-81.5)::DOUBLE) / 0.1::DOUBLE)::BIGINT AS j"


@query("math_02_grid_cells", f"WITH {S.cat()} SELECT canonical_id, i, j, i * 135 + j AS cell_id FROM (SELECT canonical_id, {_CELL} FROM cat) WHERE i BETWEEN 0 AND 189 AND j BETWEEN 0 AND 134")
def _(spark, sf):
    grid = Lattice(0.1)
    placed = catalog(spark, sf).select("canonical_id", grid.row_of(F.col("latitude")).alias("i"), grid.column_of(F.col("longitude")).alias("j"))
    inside = placed.filter(grid.contains(F.col("i"), F.col("j")))
    return inside.withColumn("cell_id", grid.cell_id(F.col("i"), F.col("j")))


@query("math_03_centroids", f"WITH {S.cat()} SELECT canonical_id, round(-18.5 + (i + 0.5) * 0.1, 6) AS cen_lat, round(-81.5 + (j + 0.5) * 0.1, 6) AS cen_lon FROM (SELECT canonical_id, {_CELL} FROM cat)")
def _(spark, sf):
    grid = Lattice(0.1)
    return rounded(catalog(spark, sf).select(
        "canonical_id", grid.centroid_lat(grid.row_of(F.col("latitude"))).alias("cen_lat"), grid.centroid_lon(grid.column_of(F.col("longitude"))).alias("cen_lon")
    ))


@query("math_04_poisson", "SELECT event_id, round(1 - exp(-(value / 100.0) * 30 / 365.25), 8) AS p FROM events")
def _(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    return rounded(events.select("event_id", poisson_probability(F.col("value") / 100.0, 30).alias("p")), 8)


@query("math_05_extrapolated_rate", "SELECT event_id, round(user_id::DOUBLE / 2.5 * pow(10.0, -1.0 * (6.0 - 4.5)), 8) AS rate FROM events")
def _(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    return rounded(events.select("event_id", extrapolated_rate(F.col("user_id"), F.lit(2.5), 1.0, 6.0, 4.5).alias("rate")), 8)


@query("math_06_elapsed_years", f"WITH {S.cat()} SELECT canonical_id, round(greatest((t_us - (-315619200000000)) / 86400000000.0 / 365.25, 1.0), 8) AS years FROM cat")
def _(spark, sf):
    return rounded(catalog(spark, sf).select("canonical_id", elapsed_years(F.col("t_us")).alias("years")), 8)


@query("math_07_log_energy", f"WITH {S.cat(True)} SELECT country, round(log10(1 + coalesce(sum(pow(10.0, 1.5 * preferred_mw)) FILTER (preferred_mw >= 6.5), 0)), 6) AS log_energy FROM cat GROUP BY 1")
def _(spark, sf):
    big = F.sum(F.when(F.col("preferred_mw") >= 6.5, energy(F.col("preferred_mw"))))
    return rounded(catalog(spark, sf, True).groupBy("country").agg(log_energy(big).alias("log_energy")))


@query("math_08_omori_integral", "SELECT event_id, round(CASE WHEN event_type = 'view' THEN ln((value + 0.05) / 0.05) ELSE (pow(value + 0.05, -0.2) - pow(0.05, -0.2)) / (-0.2) END, 8) AS integral FROM events")
def _(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    p = F.when(F.col("event_type") == "view", 1.0).otherwise(1.2)
    return rounded(events.select("event_id", decay_integral(F.col("value"), F.lit(0.05), p).alias("integral")), 8)


@query("math_09_branching_ratio", "SELECT event_id, round(CASE WHEN p <= 1 OR alpha >= ln(10.0) THEN NULL ELSE 0.02 * (ln(10.0) / (ln(10.0) - alpha)) * (pow(0.05, 1 - p) / (p - 1)) END, 8) AS ratio FROM (SELECT event_id, 0.5 + (user_id % 20)::DOUBLE / 10.0 AS p, (event_id % 30)::DOUBLE / 10.0 AS alpha FROM events)")
def _(spark, sf):
    # p and alpha vary by row
    p, alpha = F.lit(0.5) + (F.col("user_id") % 20).cast("double") / 10.0, (F.col("event_id") % 30).cast("double") / 10.0
    ratio = branching_ratio(F.lit(0.02), alpha, F.lit(0.05), p, 1.0)
    return rounded(spark.read.parquet(f"{sf}/events.parquet").select("event_id", ratio.alias("ratio")), 8)


@query("math_10_inverse_poisson", "SELECT event_id, round(-ln(1 - greatest(1e-9, least(value / 400.0, 0.999))) / (30 / 365.25), 6) AS rate FROM events")
def _(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    return rounded(events.select("event_id", yearly_rate(F.col("value") / 400.0, 30.0, 1e-9).alias("rate")))


@query("math_11_rate_density", f"WITH {S.cat()} SELECT canonical_id, round(preferred_mw / (pow(0.1 * 111.32, 2) * cos(radians(latitude))), 8) AS density FROM cat")
def _(spark, sf):
    from tremora.functions.geo import cell_area_km2
    density = F.col("preferred_mw") / cell_area_km2(F.col("latitude"), 0.1)
    return rounded(catalog(spark, sf).select("canonical_id", density.alias("density")), 8)


@query("math_12_clip", "SELECT event_id, greatest(1e-7, least(value / 100.0, 1 - 1e-7))::DOUBLE AS p FROM events")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", clip(F.col("value") / 100.0, 1e-7, 1 - 1e-7).alias("p"))


@query("math_13_half_even", "SELECT event_id, round_even((event_id % 16)::DOUBLE / 8.0, 2) AS r FROM events")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.bround((F.col("event_id") % 16).cast("double") / 8.0, 2).alias("r"))


@query("str_01_text", "SELECT event_id, lpad((user_id)::VARCHAR, 8, '0') AS filled, regexp_replace((user_id)::VARCHAR || '.0', '\\.0$', '') AS stripped, upper(trim('  ' || event_type || ' ')) AS upped, concat_ws(',', event_type, (user_id)::VARCHAR) AS joined, string_split(props, ':')[2] AS part, starts_with(event_type, 's') AS starts, contains(event_type, 'ew') AS has FROM events")
def _(spark, sf):
    from tremora.sources.text_catalogs import _zero_filled
    user = F.col("user_id").cast("string")
    return spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", _zero_filled(user, 8).alias("filled"), F.regexp_replace(F.concat(user, F.lit(".0")), r"\.0$", "").alias("stripped"),
        F.upper(F.trim(F.concat(F.lit("  "), F.col("event_type"), F.lit(" ")))).alias("upped"), F.concat_ws(",", "event_type", user).alias("joined"),
        F.split("props", ":")[1].alias("part"), F.col("event_type").startswith("s").alias("starts"), F.col("event_type").contains("ew").alias("has"),
    )


@query("date_01_parts", f"WITH {S.cat()}, d AS (SELECT canonical_id, make_timestamp(t_us) AS ts FROM cat) SELECT canonical_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, dayofyear(ts) AS doy, year(ts) // 10 * 10 AS decade, strftime(ts, '%b') AS abbreviation, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM d")
def _(spark, sf):
    ts = F.timestamp_micros("t_us")
    # Text goes out and is parsed back, as source readers do.
    parsed = F.try_to_timestamp(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
    long = lambda c: c.cast("long")
    return catalog(spark, sf).select(
        "canonical_id", long(F.year(parsed)).alias("year"), long(F.month(parsed)).alias("month"), long(F.day(parsed)).alias("day"), long(F.dayofyear(parsed)).alias("doy"),
        context.decade_of(F.col("t_us")).alias("decade"), F.date_format(parsed, "MMM").alias("abbreviation"), F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
    )


@query("date_03_days", f"WITH {S.cat()} SELECT canonical_id, (t_us - (SELECT min(t_us) FROM cat))::DOUBLE / 86400000000.0::DOUBLE AS days FROM cat")
def _(spark, sf):
    c = catalog(spark, sf)
    return c.withColumn("t0", c.agg(F.min("t_us")).scalar()).select("canonical_id", days_between(F.col("t_us"), F.col("t0")).alias("days"))


@query("arr_01_sorted_values", f"WITH {S.cat(True)} SELECT country, array_to_string(list_sort(list_distinct(list(preferred_mw))), ';') AS magnitudes, len(list_filter(list_distinct(list(preferred_mw)), lambda x: x <= 5.0)) AS at_most_5 FROM cat GROUP BY 1")
def _(spark, sf):
    grouped = catalog(spark, sf, True).groupBy("country").agg(F.array_sort(F.collect_set("preferred_mw")).alias("m"))
    return grouped.select("country", F.array_join(F.col("m").cast("array<string>"), ";").alias("magnitudes"), F.size(F.filter("m", lambda x: x <= 5.0)).cast("long").alias("at_most_5"))


@query("json_01_round_trip", "SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k, event_type AS kind FROM events")
def _(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    document = F.to_json(F.struct(F.from_json("props", "k bigint").alias("inner"), F.col("event_type").alias("kind")))
    parsed = events.select("event_id", F.from_json(document, "inner struct<k: bigint>, kind string").alias("d"))
    return parsed.select("event_id", "d.inner.k", "d.kind")


@query("cond_01_defaults", f"WITH {S.cat()} SELECT canonical_id, coalesce(preferred_mag_type, 'unknown') AS kind, coalesce(depth_km, -1.0) AS depth, depth_km IS NULL AS no_depth FROM cat")
def _(spark, sf):
    return catalog(spark, sf).select(
        "canonical_id", F.coalesce("preferred_mag_type", F.lit("unknown")).alias("kind"),
        F.coalesce(F.nanvl(F.col("depth_km"), F.lit(None).cast("double")), F.lit(-1.0)).alias("depth"), F.col("depth_km").isNull().alias("no_depth"),
    )
