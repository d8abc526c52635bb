"""Polygons from the nation and region tables, cell assignment and forecast roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremora.checks import model_queries as MQ
from tremora.checks import sql as S
from tremora.checks.registry import query, rounded
from tremora.functions.geo import Lattice
from tremora.operators import hierarchy, regions
from tremora.session import materialize
from tremora.sources.shapes import vertices as parse_vertices

# Nations become 25 tiles of a sheared 5 x 5 lattice; every tile has a square hole, nations of one region share a parent.
_CORNERS = [(0, 0), (1, 0), (1, 1), (0, 1)]
_HOLE = [(0.4, 0.4), (0.5, 0.4), (0.5, 0.5), (0.4, 0.5)]


def _lon(u, v):
    return F.lit(-81.5) + F.lit(2.7) * u + F.lit(0.3) * v


def _lat(u, v):
    return F.lit(-18.5) + F.lit(3.8) * v + F.lit(0.2) * u


def vertex_table(spark, sf):
    nation = spark.read.parquet(f"{sf}/nation.parquet").join(spark.read.parquet(f"{sf}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    c, r = (F.col("n_nationkey") % 5).cast("double"), F.floor(F.col("n_nationkey") / 5).cast("double")
    rows = [
        F.struct(F.lit(ring).cast("long").alias("ring_id"), F.lit(ring == 1).alias("is_hole"), F.lit(seq).cast("long").alias("seq"), _lon(c + F.lit(float(a)), r + F.lit(float(b))).alias("lon"), _lat(c + F.lit(float(a)), r + F.lit(float(b))).alias("lat"))
        for ring, corners in ((0, _CORNERS), (1, _HOLE)) for seq, (a, b) in enumerate(corners)
    ]
    return nation.select(F.col("n_name").alias("region_id"), F.col("r_name").alias("parent"), F.inline(F.array(*rows)))


def _vertex_sql() -> str:
    """tile, vert, edge"""
    parts = [
        f"SELECT region_id, parent, {ring}::BIGINT AS ring_id, {ring == 1} AS is_hole, {seq}::BIGINT AS seq, -81.5::DOUBLE + 2.7::DOUBLE * (c + {float(a)}::DOUBLE) + 0.3::DOUBLE * (r + {float(b)}::DOUBLE) AS lon, -18.5::DOUBLE + 3.8::DOUBLE * (r + {float(b)}::DOUBLE) + 0.2::DOUBLE * (c + {float(a)}::DOUBLE) AS lat FROM tile"
        for ring, corners in ((0, _CORNERS), (1, _HOLE)) for seq, (a, b) in enumerate(corners)
    ]
    return f"""tile AS (SELECT n_name AS region_id, r_name AS parent, (n_nationkey % 5)::DOUBLE AS c, (n_nationkey // 5)::DOUBLE AS r FROM nation JOIN region ON n_regionkey = r_regionkey),
    vert AS ({' UNION ALL '.join(parts)}),
    edge AS (SELECT region_id, ring_id, is_hole, lon AS x1, lat AS y1, coalesce(lead(lon) OVER w, first(lon) OVER w) AS x2, coalesce(lead(lat) OVER w, first(lat) OVER w) AS y2 FROM vert WINDOW w AS (PARTITION BY region_id, ring_id ORDER BY seq))"""


_POINTS = f"{S.grid()}, pts AS (SELECT DISTINCT cell_id AS point_id, -81.5::DOUBLE + (j + 0.5) * 0.25 AS lon, -18.5::DOUBLE + (i + 0.5) * 0.25 AS lat FROM base)"
_INSIDE = f"{_POINTS}, {_vertex_sql()}, hit AS (SELECT point_id, region_id FROM pts, edge WHERE (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1) GROUP BY ALL HAVING count(*) % 2 = 1)"
_S = "greatest(0.0, least(1.0, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))))"
_DIST = f"sqrt(pow(lon - x1 - {_S} * (x2 - x1), 2) + pow(lat - y1 - {_S} * (y2 - y1), 2))"
_ASSIGNED = f"{_INSIDE}, near AS (SELECT point_id, region_id, min({_DIST}) AS d FROM pts, edge WHERE point_id NOT IN (SELECT point_id FROM hit) GROUP BY ALL), best AS (SELECT point_id, min(round(d, 9)) AS d FROM near GROUP BY 1), assigned AS (SELECT point_id, min(region_id) AS region_id, true AS inside FROM hit GROUP BY 1 UNION ALL SELECT n.point_id, min(n.region_id), false FROM near n JOIN best b ON b.point_id = n.point_id AND round(n.d, 9) = b.d GROUP BY 1)"


def _points(spark, sf):
    return MQ._raw_snapshot(spark, sf).select(F.col("cell_id").alias("point_id"), F.col("cen_lon").alias("lon"), F.col("cen_lat").alias("lat"))


@query("join_10_point_in_polygon", f"WITH {_INSIDE} SELECT point_id, min(region_id) AS region_id FROM hit GROUP BY 1")
def _(spark, sf):
    hits = regions.containing_regions(_points(spark, sf), regions.edges_of(vertex_table(spark, sf)))
    return hits.groupBy("point_id").agg(F.min("region_id").alias("region_id"))


@query("join_11_nearest_region", f"WITH {_INSIDE}, near AS (SELECT point_id, region_id, min({_DIST}) AS d FROM pts, edge WHERE point_id NOT IN (SELECT point_id FROM hit) GROUP BY ALL), best AS (SELECT point_id, min(d) AS d FROM near GROUP BY 1) SELECT point_id, round(best.d, 6) AS distance, min(region_id) AS region_id FROM near JOIN best USING (point_id) WHERE near.d <= best.d + 1e-9 GROUP BY ALL")
def _(spark, sf):
    edges = regions.edges_of(vertex_table(spark, sf))
    points = materialize(_points(spark, sf))
    outside = points.join(regions.containing_regions(points, edges), "point_id", "left_anti")
    return rounded(regions.nearest_regions(outside, edges, tile=0.2).select("point_id", "region_id", "distance"))


_LEVELS = f"{_vertex_sql()}, crossed AS (SELECT *, x1 * y2 - x2 * y1 AS k FROM edge), ring AS (SELECT region_id, ring_id, is_hole, sum(k) / 2 AS a, sum((x1 + x2) * k) / 6 AS mx, sum((y1 + y2) * k) / 6 AS my FROM crossed GROUP BY ALL), shp AS (SELECT region_id, sum(a * d) AS a, sum(mx * d) AS mx, sum(my * d) AS my FROM (SELECT *, sign(a) * CASE WHEN is_hole THEN -1 ELSE 1 END AS d FROM ring) GROUP BY 1), shape AS (SELECT region_id, mx / a AS cen_lon, my / a AS cen_lat, a * 111.32 * 111.32 * cos(radians(my / a)) AS area_km2 FROM shp)"


@query("agg_29_area_and_centroid", f"WITH {_LEVELS} SELECT region_id, round(cen_lon, 6) AS cen_lon, round(cen_lat, 6) AS cen_lat, round(area_km2, 4) AS area_km2 FROM shape")
def _(spark, sf):
    return rounded(regions.shapes(regions.edges_of(vertex_table(spark, sf))), 6, area_km2=4)


# Regions hold nations, nations four units each: the quarters of the nation's tile.
_QUARTERS = [(0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (0.0, 0.5)]


def unit_vertices(spark, sf):
    """Vertices of the units, named region/nation/unit."""
    nation = spark.read.parquet(f"{sf}/nation.parquet").join(spark.read.parquet(f"{sf}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    c, r = (F.col("n_nationkey") % 5).cast("double"), F.floor(F.col("n_nationkey") / 5).cast("double")
    rows = [
        F.struct(F.lit(f"unit_{k}").alias("unit"), F.lit(seq).cast("long").alias("seq"), _lon(c + F.lit(u + a / 2), r + F.lit(v + b / 2)).alias("lon"), _lat(c + F.lit(u + a / 2), r + F.lit(v + b / 2)).alias("lat"))
        for k, (u, v) in enumerate(_QUARTERS) for seq, (a, b) in enumerate(_CORNERS)
    ]
    placed = nation.select("r_name", "n_name", F.inline(F.array(*rows)))
    return placed.select(F.concat_ws("/", "r_name", "n_name", "unit").alias("region_id"), F.lit(0).cast("long").alias("ring_id"), F.lit(False).alias("is_hole"), "seq", "lon", "lat")


def _unit_sql() -> str:
    """uvert, leaf, node: units, their numbers in path order, and the intervals of all nodes"""
    parts = [
        f"SELECT r_name || '/' || n_name || '/unit_{k}' AS region_id, {seq}::BIGINT AS seq, -81.5::DOUBLE + 2.7::DOUBLE * (c + {u + a / 2}::DOUBLE) + 0.3::DOUBLE * (r + {v + b / 2}::DOUBLE) AS lon, -18.5::DOUBLE + 3.8::DOUBLE * (r + {v + b / 2}::DOUBLE) + 0.2::DOUBLE * (c + {u + a / 2}::DOUBLE) AS lat FROM nat"
        for k, (u, v) in enumerate(_QUARTERS) for seq, (a, b) in enumerate(_CORNERS)
    ]
    return f"""nat AS (SELECT r_name, n_name, (n_nationkey % 5)::DOUBLE AS c, (n_nationkey // 5)::DOUBLE AS r FROM nation JOIN region ON n_regionkey = r_regionkey),
    uvert AS ({' UNION ALL '.join(parts)}),
    leaf AS (SELECT region_id, row_number() OVER (ORDER BY region_id) AS position, string_split(region_id, '/') AS w FROM (SELECT DISTINCT region_id FROM uvert)),
    prefix AS (SELECT '' AS node, NULL AS name, NULL AS parent, 0::BIGINT AS level, position FROM leaf UNION ALL SELECT w[1], w[1], '', 1, position FROM leaf
        UNION ALL SELECT w[1] || '/' || w[2], w[2], w[1], 2, position FROM leaf UNION ALL SELECT region_id, w[3], w[1] || '/' || w[2], 3, position FROM leaf),
    node AS (SELECT node, name, parent, level, min(position) AS low, max(position) AS high FROM prefix GROUP BY ALL)"""


@query("join_13_hierarchy", f"WITH {_unit_sql()} SELECT * FROM node")
def _(spark, sf):
    units = unit_vertices(spark, sf).select("region_id").distinct()
    return hierarchy.nested_intervals(hierarchy.numbered(units))


@query("join_13_region_parents", f"WITH {_LEVELS} SELECT DISTINCT region_id, parent FROM vert")
def _(spark, sf):
    return vertex_table(spark, sf).select("region_id", "parent").distinct()


_BOTH = f"{MQ._CORE}, snap AS (SELECT cell_id, {MQ._SM} AS p, {MQ._SM6} AS p6 FROM f WHERE t = (SELECT max(t) FROM f))"
_RATES = f"{_BOTH}, cells AS (SELECT cell_id, -18.5::DOUBLE + (cell_id // 54 + 0.5) * 0.25 AS cen_lat, -81.5::DOUBLE + (cell_id % 54 + 0.5) * 0.25 AS cen_lon, -ln(1 - greatest(1e-9, least(p, 0.999))) / (30 / 365.25) AS rate_m5, -ln(1 - greatest(1e-12, least(p6, 0.999))) / (30 / 365.25) AS rate_m6 FROM snap)"


def _cells(spark, sf):
    return regions.cell_rates(MQ._raw_snapshot(spark, sf), 30.0, 0.25)


@query("join_12_nearest_cell", f"WITH {_RATES}, {_LEVELS}, dens AS (SELECT *, rate_m5 / (pow(0.25 * 111.32, 2) * cos(radians(cen_lat))) AS density FROM cells), near AS (SELECT s.region_id, arg_min(density, (round(sqrt(pow(s.cen_lon - d.cen_lon, 2) + pow(s.cen_lat - d.cen_lat, 2)), 9), cell_id)) AS density FROM shape s JOIN dens d ON sqrt(pow(s.cen_lon - d.cen_lon, 2) + pow(s.cen_lat - d.cen_lat, 2)) < 0.2 GROUP BY 1) SELECT region_id AS point_id, round(coalesce(density, 0), 10) AS density_m5 FROM shape LEFT JOIN near USING (region_id)")
def _(spark, sf):
    places = regions.shapes(regions.edges_of(vertex_table(spark, sf))).select(F.col("region_id").alias("point_id"), F.col("cen_lon").alias("lon"), F.col("cen_lat").alias("lat"))
    return rounded(regions.nearest_cell_density(places, _cells(spark, sf), Lattice(0.25), cutoff=0.2).select("point_id", "density_m5"), 10)


def _superposed(spark, sf):
    vertices = vertex_table(spark, sf)
    cells = materialize(_cells(spark, sf))
    points = cells.select(F.col("cell_id").alias("point_id"), F.col("cen_lon").alias("lon"), F.col("cen_lat").alias("lat"))
    assigned = regions.assign_regions(points, vertices)
    parents = vertices.select("region_id", "parent").distinct()
    rated = cells.join(assigned, F.col("cell_id") == F.col("point_id")).join(parents, "region_id")
    return regions.superpose(rated, ["parent", "region_id"])


_UNITS = f"{_RATES}, {_ASSIGNED.replace(S.grid() + ', ', '')}, rated AS (SELECT c.*, a.region_id, t.parent FROM cells c JOIN assigned a ON a.point_id = c.cell_id JOIN tile t USING (region_id)), units AS (SELECT parent, region_id, (2 - grouping(parent) - grouping(region_id))::BIGINT AS level, count(*) AS n, sum(rate_m5) AS rate_m5, sum(rate_m6) AS rate_m6 FROM rated GROUP BY ROLLUP (parent, region_id))"


@query("agg_27_superposed_rates", f"WITH {_UNITS} SELECT parent, region_id, level, n, round(rate_m5, 6) AS rate_m5, round(rate_m6, 8) AS rate_m6 FROM units")
def _(spark, sf):
    return rounded(_superposed(spark, sf).select("parent", "region_id", "level", "n", "rate_m5", "rate_m6"), 6, rate_m6=8)


@query("agg_27_horizon_probabilities", f"WITH {_UNITS} SELECT parent, region_id, level, days::BIGINT AS days, round(1 - exp(-rate_m5 * days / 365.25), 6) AS p_m5, round(CASE WHEN rate_m5 > 0 THEN 1 / rate_m5 END, 6) AS recur_m5, round(1 - exp(-rate_m6 * days / 365.25), 6) AS p_m6, round(CASE WHEN rate_m6 > 0 THEN 1 / rate_m6 END, 5) AS recur_m6 FROM units, (SELECT unnest([7, 30, 90, 365]) AS days)")
def _(spark, sf):
    return rounded(regions.horizon_probabilities(_superposed(spark, sf), ["parent", "region_id", "level"]).select("parent", "region_id", "level", "days", "p_m5", "recur_m5", "p_m6", "recur_m6"), 6, recur_m6=5)


@query("top_05_region_ranking", f"WITH {_UNITS}, pr AS (SELECT parent, region_id, level, round(1 - exp(-rate_m5 * 30 / 365.25), 8) AS p_m5 FROM units) SELECT *, row_number() OVER (PARTITION BY level ORDER BY p_m5 DESC, coalesce(region_id, parent)) AS rank FROM pr")
def _(spark, sf):
    p30 = regions.horizon_probabilities(_superposed(spark, sf), ["parent", "region_id", "level"], [30])
    named = rounded(p30.select("parent", "region_id", "level", "p_m5"), 8).withColumn("_name", F.coalesce("region_id", "parent"))
    return regions.ranked(named, ["level"], "p_m5", "_name").drop("_name")


@query("snk_07_region_documents", f"WITH {_UNITS}, pr AS (SELECT parent, region_id, level, list(round_even(1 - exp(-rate_m5 * d / 365.25), 6) ORDER BY d) AS p FROM units, (SELECT unnest([7, 30, 90, 365]) AS d) GROUP BY ALL) SELECT parent, region_id, level, round(p[2], 5) AS p30, round(p[4], 5) AS p365 FROM pr")
def _(spark, sf):
    from tremora.plans.reports import region_documents
    documents = region_documents(_superposed(spark, sf), ["parent", "region_id"])
    schema = "parent string, region_id string, level bigint, horizons array<struct<days: bigint, p_m5: double>>"
    d = documents.select(F.from_json("value", schema).alias("d"))
    return rounded(d.select("d.parent", "d.region_id", "d.level", F.col("d.horizons")[1]["p_m5"].alias("p30"), F.col("d.horizons")[3]["p_m5"].alias("p365")), 5)


_UNIT_RATES = f"""{_RATES}, {_unit_sql()}, uedge AS (SELECT region_id, lon AS x1, lat AS y1, coalesce(lead(lon) OVER w, first(lon) OVER w) AS x2, coalesce(lead(lat) OVER w, first(lat) OVER w) AS y2 FROM uvert WINDOW w AS (PARTITION BY region_id ORDER BY seq)),
    uk AS (SELECT *, x1 * y2 - x2 * y1 AS k FROM uedge), ush AS (SELECT region_id, sum(k) / 2 AS a, sum((x1 + x2) * k) / 6 / (sum(k) / 2) AS cx, sum((y1 + y2) * k) / 6 / (sum(k) / 2) AS cy FROM uk GROUP BY 1),
    dens AS (SELECT *, pow(0.25 * 111.32, 2) * cos(radians(cen_lat)) AS cell_area FROM cells),
    unear AS (SELECT s.region_id, arg_min(rate_m5 / cell_area, (round(sqrt(pow(cx - cen_lon, 2) + pow(cy - cen_lat, 2)), 9), cell_id)) AS d5, arg_min(rate_m6 / cell_area, (round(sqrt(pow(cx - cen_lon, 2) + pow(cy - cen_lat, 2)), 9), cell_id)) AS d6 FROM ush s JOIN dens ON sqrt(pow(cx - cen_lon, 2) + pow(cy - cen_lat, 2)) < 0.2 GROUP BY 1),
    unit AS (SELECT region_id, abs(a) * 111.32 * 111.32 * cos(radians(cy)) AS area, coalesce(d5, 0) AS d5, coalesce(d6, 0) AS d6 FROM ush LEFT JOIN unear USING (region_id)),
    rolled AS (SELECT node, name, parent, level, count(*) AS n, sum(d5 * area) AS rate_m5, sum(d6 * area) AS rate_m6 FROM prefix JOIN leaf USING (position) JOIN unit USING (region_id) GROUP BY ALL)"""


def _unit_sums(spark, sf):
    rates = hierarchy.unit_rates(unit_vertices(spark, sf), _cells(spark, sf), Lattice(0.25), cutoff=0.2)
    return hierarchy.subtree_sums(rates, ["rate_m5", "rate_m6"])


@query("agg_27_hierarchy_rates", f"WITH {_UNIT_RATES} SELECT node, name, parent, level, n, round(rate_m5, 6) AS rate_m5, round(rate_m6, 8) AS rate_m6 FROM rolled")
def _(spark, sf):
    return rounded(_unit_sums(spark, sf).drop("low", "high"), 6, rate_m6=8)


@query("agg_27_hierarchy_probabilities", f"WITH {_UNIT_RATES} SELECT node, level, days::BIGINT AS days, round(1 - exp(-rate_m5 * days / 365.25), 6) AS p_m5, round(1 - exp(-rate_m6 * days / 365.25), 6) AS p_m6, round(CASE WHEN rate_m5 > 1e-9 THEN 1 / rate_m5 END, 4) AS recur_m5, round(CASE WHEN rate_m6 > 1e-9 THEN 1 / rate_m6 END, 2) AS recur_m6 FROM rolled, (SELECT unnest([7, 30, 90, 365]) AS days)")
def _(spark, sf):
    # a difference of running sums may leave the last bit of a rate that is zero
    clean = _unit_sums(spark, sf)
    for m in ("m5", "m6"):
        clean = clean.withColumn(f"rate_{m}", F.when(F.col(f"rate_{m}") > 1e-9, F.col(f"rate_{m}")).otherwise(0.0))
    return rounded(regions.horizon_probabilities(clean, ["node", "level"]), 6, recur_m5=4, recur_m6=2)


@query("src_13_geojson", f"WITH {_vertex_sql()}, named AS (SELECT upper(parent[1]) || lower(parent[2:]) AS department, 'Nation_' || regexp_extract(region_id, '[0-9]+$') AS province, * FROM vert) SELECT department || '/' || province AS region_id, department, province, ring_id, is_hole, seq, round(lon, 9) AS lon, round(lat, 9) AS lat FROM named WHERE strpos(parent, ' ') = 0 UNION ALL SELECT 'Middle East/' || province, 'Middle East', province, ring_id, is_hole, seq, round(lon, 9), round(lat, 9) FROM named WHERE strpos(parent, ' ') > 0")
def _(spark, sf):
    # One collection document per region; each nation's rings are four points each.
    points = vertex_table(spark, sf).groupBy("parent", "region_id", "ring_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.array("lon", "lat").alias("xy")))).alias("p"))
    rings = points.groupBy("parent", "region_id").agg(F.array_sort(F.collect_list(F.struct("ring_id", F.transform("p", lambda x: x["xy"]).alias("r")))).alias("rings"))
    feature = F.struct(
        F.struct(F.col("parent").alias("NOMBDEP"), F.col("region_id").alias("NOMBPROV")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.transform("rings", lambda x: x["r"]).alias("coordinates")).alias("geometry"),
    )
    documents = rings.groupBy("parent").agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value"))
    return rounded(parse_vertices(documents), 9)
