"""Polygons as vertex tables: area, point-in-polygon, nearest region and forecast roll-ups.

Vertices are (region_id, ring_id, is_hole, seq, lon, lat) plus parents; rings need not be closed.
Points meet edges through equi-joins on square tiles, never through a nested loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.fixed import HORIZONS_DAYS, KM_PER_DEGREE, Box
from tremora.functions.geo import Lattice, cell_area_km2, in_box
from tremora.functions.rates import poisson_probability, yearly_rate
from tremora.operators.tiles import tile_index, tile_of
from tremora.session import materialize


def edges_of(vertices: DataFrame) -> DataFrame:
    """(region_id, ring_id, is_hole, x1, y1, x2, y2), each ring closed back to its first vertex."""
    ring = Window.partitionBy("region_id", "ring_id").orderBy("seq")
    whole = Window.partitionBy("region_id", "ring_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    closed = vertices.select(
        "region_id", "ring_id", "is_hole", F.col("lon").alias("x1"), F.col("lat").alias("y1"),
        F.coalesce(F.lead("lon").over(ring), F.first("lon").over(whole)).alias("x2"),
        F.coalesce(F.lead("lat").over(ring), F.first("lat").over(whole)).alias("y2"),
    )
    return closed.filter("x1 <> x2 OR y1 <> y2")


def shapes(edges: DataFrame) -> DataFrame:
    """(region_id, cen_lon, cen_lat, area_km2): planar shoelace; holes count negative whatever their direction."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    rings = edges.groupBy("region_id", "ring_id", "is_hole").agg(
        (F.sum(cross) / 2).alias("a"),
        (F.sum((F.col("x1") + F.col("x2")) * cross) / 6).alias("mx"), (F.sum((F.col("y1") + F.col("y2")) * cross) / 6).alias("my"),
    )
    direction = F.signum("a") * F.when(F.col("is_hole"), -1.0).otherwise(1.0)
    sums = rings.groupBy("region_id").agg(
        F.sum(F.col("a") * direction).alias("a"), F.sum(F.col("mx") * direction).alias("mx"), F.sum(F.col("my") * direction).alias("my")
    )
    cen_lat = F.try_divide(F.col("my"), F.col("a"))
    return sums.select(
        "region_id", F.try_divide(F.col("mx"), F.col("a")).alias("cen_lon"), cen_lat.alias("cen_lat"),
        (F.col("a") * F.lit(KM_PER_DEGREE * KM_PER_DEGREE) * F.cos(F.radians(cen_lat))).alias("area_km2"),
    )


def containing_regions(points: DataFrame, edges: DataFrame, tile: float = 1.0) -> DataFrame:
    """(point_id, region_id) for every region that contains the point (even-odd rule, holes respected)."""
    return tile_index(edges, tile).regions_of(points)


def _segment_distance() -> Column:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = ((F.col("lon") - F.col("x1")) * dx + (F.col("lat") - F.col("y1")) * dy) / (dx * dx + dy * dy)
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    ox, oy = F.col("lon") - F.col("x1") - s * dx, F.col("lat") - F.col("y1") - s * dy
    return F.sqrt(ox * ox + oy * oy)


def nearest_regions(points: DataFrame, edges: DataFrame, tile: float = 1.0) -> DataFrame:
    """(point_id, region_id, distance): region with the nearest boundary in planar degrees, lowest id on ties.

    Search squares grow fourfold until the best distance lies within the searched reach, so the answer is
    exact however far a point is, and near points never look far. Raises ValueError without edges.
    """
    if edges.isEmpty():
        raise ValueError("no edges to be near to")
    answers, open_points, reach = None, points.select("point_id", "lon", "lat"), tile
    while True:
        filed = edges.select("region_id", "x1", "y1", "x2", "y2")
        for axis, (a, b) in {"tx": ("x1", "x2"), "ty": ("y1", "y2")}.items():
            filed = filed.withColumn(axis, F.explode(F.sequence(tile_of(F.least(a, b), reach), tile_of(F.greatest(a, b), reach))))
        near = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in (-1, 0, 1) for q in (-1, 0, 1)])
        asked = open_points.withColumn("o", F.explode(near)).select(
            "point_id", "lon", "lat", (tile_of(F.col("lon"), reach) + F.col("o.p")).alias("tx"), (tile_of(F.col("lat"), reach) + F.col("o.q")).alias("ty")
        )
        best = asked.join(filed, ["tx", "ty"]).groupBy("point_id").agg(F.min(F.struct(_segment_distance().alias("d"), "region_id")).alias("b"))
        looked = materialize(open_points.join(best, "point_id", "left").select("*", F.coalesce(F.col("b.d") <= reach, F.lit(False)).alias("sure")))
        # Everything within `reach` was looked at; a best distance beyond it could still be beaten.
        settled = looked.filter("sure").select("point_id", F.col("b.region_id").alias("region_id"), F.col("b.d").alias("distance"))
        answers = settled if answers is None else answers.unionByName(settled)
        open_points = looked.filter("NOT sure").select("point_id", "lon", "lat")
        # No two points of a map are further apart than this many degrees.
        if reach > 1024 or open_points.isEmpty():
            return answers
        reach *= 4


def assign_regions(points: DataFrame, vertices: DataFrame, tile: float = 1.0) -> DataFrame:
    """(point_id, region_id, inside): first containing region by id, else the nearest one."""
    edges = materialize(edges_of(vertices))
    points = points.select("point_id", "lon", "lat")
    inside = materialize(containing_regions(points, edges, tile).groupBy("point_id").agg(F.min("region_id").alias("region_id")))
    outside = points.join(inside, "point_id", "left_anti")
    matched = inside.withColumn("inside", F.lit(True))
    if outside.isEmpty():
        return matched
    return matched.unionByName(nearest_regions(outside, edges, tile).select("point_id", "region_id").withColumn("inside", F.lit(False)))


def boxes_containing(events: DataFrame, boxes: dict[str, Box], out: str = "region") -> DataFrame:
    """One row per event and box that contains it; an event may match several boxes of the fixed list."""
    hits = [F.when(in_box(F.col("latitude"), F.col("longitude"), box), F.lit(name)) for name, box in boxes.items()]
    return events.withColumn(out, F.explode(F.filter(F.array(*hits), lambda name: name.isNotNull())))


# --- rates ------------------------------------------------------------------------------------------


def cell_rates(snapshot: DataFrame, horizon_days: float = 30.0, res: float | None = None) -> DataFrame:
    """Yearly M5 and M6 rates per forecast cell, and rate densities per km2 when `res` is given."""
    rated = snapshot.select(
        "cell_id", "cen_lat", "cen_lon",
        yearly_rate(F.col("p_m5_30d"), horizon_days, 1e-9).alias("rate_m5"), yearly_rate(F.col("p_m6_30d"), horizon_days, 1e-12).alias("rate_m6"),
    )
    if res is None:
        return rated
    area = cell_area_km2(F.col("cen_lat"), res)
    return rated.select("*", (F.col("rate_m5") / area).alias("density_m5"), (F.col("rate_m6") / area).alias("density_m6"))


def nearest_cell_density(places: DataFrame, cells: DataFrame, lattice: Lattice, cutoff: float = 0.08) -> DataFrame:
    """Densities of the nearest cell centre strictly within `cutoff` degrees, else zero.

    `places` has point_id, lon, lat. Centres within the cutoff lie in the place's own lattice cell or one
    of its neighbours when the cutoff is at most a cell.
    """
    ring = max(1, int(-(-cutoff // lattice.res)))
    steps = range(-ring, ring + 1)
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in steps for b in steps])
    asked = places.select("point_id", "lon", "lat", F.explode(near).alias("o")).select(
        "point_id", "lon", "lat", (lattice.row_of(F.col("lat")) + F.col("o.a")).alias("i"), (lattice.column_of(F.col("lon")) + F.col("o.b")).alias("j")
    )
    addressed = cells.withColumn("i", lattice.row_of(F.col("cen_lat"))).withColumn("j", lattice.column_of(F.col("cen_lon")))
    dx, dy = F.col("lon") - F.col("cen_lon"), F.col("lat") - F.col("cen_lat")
    found = asked.join(addressed, ["i", "j"]).withColumn("d", F.sqrt(dx * dx + dy * dy)).filter(F.col("d") < cutoff)
    # centres equally far but for rounding tie, and the lowest id is taken
    best = found.groupBy("point_id").agg(F.min(F.struct(F.round("d", 9).alias("d"), "cell_id", "density_m5", "density_m6")).alias("b"))
    return places.join(best, "point_id", "left").select(
        *places.columns, F.coalesce("b.density_m5", F.lit(0.0)).alias("density_m5"), F.coalesce("b.density_m6", F.lit(0.0)).alias("density_m6")
    )


def superpose(rated: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Sum rates along a hierarchy in one roll-up: (levels..., level, n, rate_m5, rate_m6).

    Level 0 is the grand total, level len(levels) the finest units; the finest column is the last.
    """
    rolled = rated.rollup(*levels).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), F.sum("rate_m5").alias("rate_m5"), F.sum("rate_m6").alias("rate_m6")
    )
    depth = F.lit(len(levels)) - F.length(F.replace(F.bin("_g"), F.lit("0"), F.lit("")))
    return rolled.withColumn("level", depth.cast("long")).drop("_g")


def horizon_probabilities(rates: DataFrame, keep: Sequence[str], horizons: Sequence[int] = HORIZONS_DAYS) -> DataFrame:
    """One row per unit and horizon: P of at least one event, and the recurrence in years (NULL for rate 0)."""
    spread = rates.withColumn("days", F.explode(F.array(*[F.lit(h).cast("long") for h in horizons])))
    p = lambda c: poisson_probability(F.col(c), F.col("days").cast("double"))
    recur = lambda c: F.when(F.col(c) > 0, F.lit(1.0) / F.col(c))
    return spread.select(
        *keep, "days", p("rate_m5").alias("p_m5"), p("rate_m6").alias("p_m6"), recur("rate_m5").alias("recur_m5"), recur("rate_m6").alias("recur_m6")
    )


def ranked(units: DataFrame, level: Sequence[str], by: str, tie: str) -> DataFrame:
    """Rank units within a level by descending probability."""
    return units.withColumn("rank", F.row_number().over(Window.partitionBy(*level).orderBy(F.desc(by), tie)).cast("long"))
