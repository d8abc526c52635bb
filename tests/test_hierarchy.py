"""Nested intervals and their sums against plain grouping."""

import random
from collections import defaultdict

import pytest

from tremora.functions.geo import Lattice
from tremora.operators import hierarchy


def units(seed=1):
    r = random.Random(seed)
    names = [f"{d}/{p} {k}/{'xyz'[u]}" for d in ("A", "A B", "a") for p in ("p", "q") for k in range(3) for u in range(3)]
    return [(name, r.uniform(0, 2), r.choice([0.0, 1e-6, 3.0])) for name in names if r.random() < 0.8] + [("B", 1.5, None), ("B2/only", 0.25, 0.5)]


def wanted(rows):
    n, a, b = defaultdict(set), defaultdict(float), defaultdict(float)
    for name, x, y in rows:
        parts = name.split("/")
        for k in range(len(parts) + 1):
            node = "/".join(parts[:k])
            n[node].add(name)
            a[node] += x
            b[node] += y or 0.0
    return {k: (len(n[k]), a[k], b[k]) for k in n}


def test_sums_of_all_levels(spark):
    rows = units() + [units()[0]]  # one unit in two rows
    found = hierarchy.subtree_sums(spark.createDataFrame(rows, "region_id string, a double, b double").repartition(4), ["a", "b"]).collect()
    expected = wanted(rows)
    assert {r.node for r in found} == set(expected)
    for r in found:
        n, a, b = expected[r.node]
        assert r.n == n and r.a == pytest.approx(a) and r.b == pytest.approx(b, abs=1e-12)


def test_intervals_enclose_each_other(spark):
    places = hierarchy.numbered(spark.createDataFrame(units(), "region_id string, a double, b double").select("region_id"))
    nodes = {r.node: r for r in hierarchy.nested_intervals(places).collect()}
    for r in nodes.values():
        assert r.level == (len(r.node.split("/")) if r.node else 0)
        if r.level:
            up = nodes[r.parent]
            assert up.low <= r.low <= r.high <= up.high and r.node.endswith(r.name)
    same_level = sorted((r.low, r.high) for r in nodes.values() if r.level == 1)
    assert all(a[1] < b[0] for a, b in zip(same_level, same_level[1:]))
    assert (nodes[""].low, nodes[""].high) == (1, len(units()))


def test_unit_rate_is_density_times_area(spark):
    square = [(-81.4, -18.4), (-81.2, -18.4), (-81.2, -18.2), (-81.4, -18.2)]
    far = [(x + 9, y + 9) for x, y in square]
    rows = [(name, 0, False, k, x, y) for name, ring in (("u", square), ("v", far)) for k, (x, y) in enumerate(ring)]
    vertices = spark.createDataFrame(rows, "region_id string, ring_id long, is_hole boolean, seq long, lon double, lat double")
    cells = spark.createDataFrame([(0, -18.375, -81.375, 2e-4, 3e-6)], "cell_id long, cen_lat double, cen_lon double, density_m5 double, density_m6 double")
    got = {r.region_id: r for r in hierarchy.unit_rates(vertices, cells, Lattice(0.25), cutoff=0.2).collect()}
    assert got["u"].rate_m5 == pytest.approx(2e-4 * got["u"].area_km2) and got["u"].rate_m6 == pytest.approx(3e-6 * got["u"].area_km2)
    assert got["u"].area_km2 == pytest.approx((0.2 * 111.32) ** 2 * 0.949, rel=1e-3) and (got["v"].rate_m5, got["v"].rate_m6) == (0.0, 0.0)


def test_nothing(spark):
    none = spark.createDataFrame([], "region_id string, a double")
    assert hierarchy.subtree_sums(none, ["a"]).count() == 0
