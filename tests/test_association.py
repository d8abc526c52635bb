import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremora.functions.geo import haversine_km
from tremora.operators.canonical import canonical_events, preferred_members
from tremora.operators.components import connected_components
from tremora.operators.linkage import LinkRule, associate, close_pairs, pair_sides

T0 = 1_500_000_000_000_000
SCHEMA = "source string, source_event_id string, t_us long, latitude double, longitude double, depth_km double, magnitude double, magnitude_type string, mw double, mw_method string, country string"


def row(source, sid, t, lat, lon, mw=5.0, method="direct", kind="mww", depth=50.0):
    return (source, sid, t, lat, lon, depth, mw, kind, mw, method, "Peru")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def groups(df):
    found = {}
    for r in df.select("source_event_id", "canonical_id").collect():
        found.setdefault(r["canonical_id"], set()).add(r["source_event_id"])
    return {frozenset(v) for v in found.values()}


def haversine(a, b):
    p1, l1, p2, l2 = (math.radians(v) for v in (a[3], a[4], b[3], b[4]))
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin((l2 - l1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))


def brute(rows, rule):
    parent = {r[1]: r[1] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            if abs(a[2] - b[2]) > rule.dt_us or haversine(a, b) > rule.distance_km:
                continue
            if rule.depth_km is not None and None not in (a[5], b[5]) and abs(a[5] - b[5]) > rule.depth_km:
                continue
            if rule.mw is not None and None not in (a[8], b[8]) and abs(a[8] - b[8]) > rule.mw:
                continue
            pairs.add(frozenset((a[1], b[1])))
            parent[root(a[1])] = root(b[1])
    found = {}
    for r in rows:
        found.setdefault(root(r[1]), set()).add(r[1])
    return pairs, {frozenset(v) for v in found.values()}


@pytest.mark.parametrize("a, b, km", [((90.0, 0.0), (0.0, 33.0), 6371.0088 * math.pi / 2), ((0.0, 179.5), (0.0, -179.5), 6371.0088 * math.radians(1)), ((5.0, 5.0), (5.0, 5.0), 0.0)])
def test_distances(spark, a, b, km):
    got = spark.range(1).select(haversine_km(*[F.lit(v) for v in (*a, *b)]).alias("km")).first()["km"]
    assert got == pytest.approx(km, rel=1e-6, abs=1e-9)


def test_reports_of_two_events(spark):
    """A shock seen by four reports of three networks, and a later one at the same place seen by two."""
    first = [
        row("isc", "i-7", T0 + 4_000_000, 11.20, -60.10, 5.9), row("emsc", "e-1", T0, 11.25, -60.05, 5.8, "assume_unknown", "m"),
        row("usgs", "u-9", T0 + 9_000_000, 11.31, -60.12, 5.7), row("usgs", "u-10", T0 + 12_000_000, 11.30, -60.10, 5.6),
    ]
    second = [row("usgs", "u-11", T0 + 60_000_000, 11.22, -60.08, 4.9), row("emsc", "e-2", T0 + 70_000_000, 11.22, -60.08, 4.8)]
    linked = associate(frame(spark, first + second))
    assert groups(linked) == {frozenset(r[1] for r in first), frozenset(r[1] for r in second)}
    events = canonical_events(linked)
    found = {r["n_obs"]: r for r in events.collect()}
    assert found[4]["n_sources"] == 3 and found[4]["sources"] == "emsc,isc,usgs" and found[4]["preferred_source"] == "isc"
    assert found[2]["n_sources"] == 2 and found[4]["canonical_id"] < found[2]["canonical_id"]
    members = preferred_members(linked, events).filter("is_preferred").collect()
    assert len(members) == 2 and "i-7" in {r["source_event_id"] for r in members}


@pytest.mark.parametrize("step, together", [(0.4, True), (1.5, False)])
def test_same_time_at_growing_distance(spark, step, together):
    """Three reports of one second in a row: neighbours 44 km apart are one event, 167 km apart three."""
    found = groups(associate(frame(spark, [row("s", f"x{k}", T0, 40.0 + step * k, 15.0) for k in range(3)])))
    assert len(found) == (1 if together else 3)


def test_time_limit_is_inclusive(spark):
    rows = [row("s", "a", T0, 0.0, 0.0), row("s", "b", T0 + 16_000_000, 0.0, 0.0), row("s", "c", T0 + 32_000_001, 0.0, 0.0)]
    assert groups(associate(frame(spark, rows))) == {frozenset("ab"), frozenset("c")}


def test_chain_is_one_group(spark):
    rows = [row("s", f"e{k:03d}", T0 + k * 10_000_000, -12.0, -77.0) for k in range(200)]
    assert associate(frame(spark, rows)).agg(F.max("canonical_id")).first()[0] == 1


def random_rows(seed, n, spread, seconds, poles=False):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lat = rng.choice([89.7, -89.8, 0.0]) + rng.uniform(-0.2, 0.2) if poles else -12 + rng.uniform(-spread, spread)
        lon = rng.choice([179.9, -179.9, 0.0, 90.0]) + rng.uniform(-0.05, 0.05) if poles else -77 + rng.uniform(-spread, spread)
        depth = rng.choice([None, rng.uniform(0, 60)])
        mw = rng.choice([None, rng.uniform(4, 6)])
        rows.append(row("s", f"e{k:04d}", T0 + int(rng.uniform(0, seconds * 1e6)), lat, lon, mw, depth=depth))
    return rows


@pytest.mark.parametrize("rule, poles", [(LinkRule(), False), (LinkRule(), True), (LinkRule(depth_km=10.0, mw=0.3), False), (LinkRule(dt_seconds=3, distance_km=40), False)])
def test_pairs_and_groups_match_brute_force(spark, rule, poles):
    rows = random_rows(3, 300, 3.0, 900, poles)
    pairs, expected = brute(rows, rule)
    df = frame(spark, rows)
    got = close_pairs(df, rule).select("a_source_event_id", "b_source_event_id").collect()
    assert {frozenset(r) for r in got} == pairs and len(got) == len(pairs)
    assert groups(associate(df, rule)) == expected


def test_crowded_cells_are_subdivided_exactly(spark):
    """A third of all rows are copies of one point, and two dense clouds face each other near the limit."""
    rng = random.Random(5)
    rows = [row("s", f"c{k:04d}", T0, -12.0, -77.0) for k in range(200)]
    rows += [row("s", f"x{k:04d}", T0 + rng.randrange(8_000_000), -12 + rng.uniform(-0.2, 0.2), -77 + rng.uniform(-0.2, 0.2)) for k in range(150)]
    rows += [row("s", f"y{k:04d}", T0 + rng.randrange(8_000_000), -12 + rng.uniform(-0.2, 0.2), -75.85 + rng.uniform(-0.15, 0.15)) for k in range(150)]
    rows += [row("s", f"z{k:04d}", T0 + 15_000_000 + rng.randrange(30_000_000), -12 + rng.uniform(-0.9, 0.9), -77 + rng.uniform(-0.9, 0.9)) for k in range(100)]
    _, expected = brute(rows, LinkRule())
    for direct in (100_000, 20):
        assert groups(associate(frame(spark, rows), direct_pairs=direct)) == expected


@pytest.mark.parametrize("small", [0, 200_000])
def test_crowded_buckets_are_cut_into_sections(spark, monkeypatch, small):
    """Over a third of all rows lie in one bucket, others around it; no section pair gets more than its share."""
    monkeypatch.setattr("tremora.operators.linkage._SMALL", small)
    rng = random.Random(8)
    rows = random_rows(4, 250, 3.0, 900)
    rows += [row("s", f"h{k:04d}", T0 + rng.randrange(30_000_000), -12 + rng.uniform(-0.3, 0.3), -77 + rng.uniform(-0.3, 0.3)) for k in range(350)]
    pairs, _ = brute(rows, LinkRule())
    df = frame(spark, rows)
    got = close_pairs(df, crowd=40).select("a_source_event_id", "b_source_event_id").collect()
    assert {frozenset(r) for r in got} == pairs and len(got) == len(pairs)
    whole = [side.groupBy(*keys).count().agg(F.max("count")).first()[0] for *sides, keys in [pair_sides(df, LinkRule(), 10**6)] for side in sides]
    cut = [side.groupBy(*keys).count().agg(F.max("count")).first()[0] for *sides, keys in [pair_sides(df, LinkRule(), 40)] for side in sides]
    assert min(whole) > 150 and max(cut) < 80


def test_components_of_path_star_and_isolated(spark):
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, 1001 + k) for k in range(50)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").toPandas()
    assert len(found) == 301 + 51 and found["node"].is_unique
    assert set(found[found.node <= 300].component) == {0} and set(found[found.node >= 1000].component) == {1000}


def test_no_links_at_all(spark):
    rows = [row("s", f"e{k}", T0 + k * 60_000_000, 0.0, 0.0) for k in range(5)]
    got = associate(frame(spark, rows)).toPandas().sort_values("t_us")
    assert got.canonical_id.tolist() == [1, 2, 3, 4, 5]


def test_cells_carry_their_boxes_into_the_candidates(spark, monkeypatch):
    from tremora.operators import linkage

    plans, write = [], linkage.materialize
    monkeypatch.setattr(linkage, "materialize", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df))[1])
    found = groups(associate(frame(spark, [row("s", "a", T0, 40.0, 15.0), row("s", "b", T0 + 20_000_000, 40.0, 15.0), row("s", "c", T0 + 5_000_000, 40.0, 15.0)])))
    assert found == {frozenset("abc")}
    candidates = next(p for p in plans if "root_a" in p)
    assert candidates.count("Join ") == 1  # the two sides meet; neither is looked up by cell before
