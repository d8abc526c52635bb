"""The tile index against the even-odd rule over all edges."""

import math
import random

import pytest

from tremora.operators import regions, tiles


def ring(region, ring_id, points, hole=False):
    return [(region, ring_id, hole, k, float(x), float(y)) for k, (x, y) in enumerate(points)]


def star(cx, cy, n, inner, outer, turn=0.0):
    out = []
    for k in range(2 * n):
        r, a = (outer, inner)[k % 2], turn + math.pi * k / n
        out.append((cx + r * math.cos(a), cy + r * math.sin(a)))
    return out


VERTICES = (
    ring("a", 0, star(0.3, 0.2, 9, 1.1, 3.7)) + ring("a", 1, star(0.3, 0.2, 5, 0.2, 0.8), True)
    + ring("b", 0, [(-3, -3), (2, -3), (2, 2), (-3, 2)])  # vertices and edges on tile borders
    + ring("c", 0, [(10, 10), (14, 10), (14, 14), (10, 14)]) + ring("c", 1, [(11, 11), (13, 11), (13, 13), (11, 13)], True)
    + ring("d", 0, [(-1, -1), (0, 0), (1, -1), (0, 1)]) + ring("e", 0, star(4.0, 4.0, 200, 0.5, 2.0))
)
DDL = "region_id string, ring_id long, is_hole boolean, seq long, lon double, lat double"


def by_rule(points, edges):
    found = set()
    for k, x, y in points:
        odd = {}
        for e in edges:
            if (e.y1 > y) != (e.y2 > y) and x < e.x1 + (y - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1):
                odd[e.region_id] = not odd.get(e.region_id, False)
        found |= {(k, region) for region, inside in odd.items() if inside}
    return found


@pytest.mark.parametrize(("size", "most"), [(1.0, 48), (1.0, 3), (0.7, 5), (4.0, 2), (16.0, 4)])
def test_points_on_and_off_borders(spark, size, most):
    r = random.Random(5)
    points = [(r.uniform(-5, 15), r.uniform(-5, 15)) for _ in range(900)]
    points += [(x / 2, y / 2) for x in range(-8, 10) for y in range(-8, 10)]  # tile corners and vertices
    points = [(k, x, y) for k, (x, y) in enumerate(points)]
    edges = regions.edges_of(spark.createDataFrame(VERTICES, DDL)).cache()
    index = tiles.tile_index(edges, size, most)
    got = [tuple(x) for x in index.regions_of(spark.createDataFrame(points, "point_id long, lon double, lat double").repartition(3)).collect()]
    assert len(got) == len(set(got)) and set(got) == by_rule(points, edges.collect())


def test_crowded_tile_is_cut(spark):
    edges = regions.edges_of(spark.createDataFrame(ring("x", 0, star(0.5, 0.5, 2500, 0.2, 0.45)), DDL))
    index = tiles.tile_index(edges)
    sizes = index.crossed.groupBy("level", "tx", "ty").count().collect()
    assert max(s["level"] for s in sizes) >= 2 and max(s["count"] for s in sizes) < 200
    points = spark.range(100_000).selectExpr("id AS point_id", "rand(1) AS lon", "rand(2) AS lat")
    share = index.regions_of(points).count() / 100_000
    assert 0.25 < share < 0.36  # the star covers n * sin(pi / n) * 0.2 * 0.45


def test_nothing(spark):
    none = regions.edges_of(spark.createDataFrame([], DDL))
    points = spark.createDataFrame([(1, 0.0, 0.0)], "point_id long, lon double, lat double")
    assert regions.containing_regions(points, none).count() == 0
    with pytest.raises(ValueError):
        regions.nearest_regions(points, none)
