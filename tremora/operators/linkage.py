"""Space-time association of observations of one physical event.

Two observations are linked if their times differ by at most `dt_seconds` and their great-circle
distance is at most `distance_km` (optionally also depth and Mw within a tolerance when both are
known). Groups are the connected components of that relation.

`close_pairs` lists the pairs themselves: a bucketed equi-join, the earlier side copied to the buckets
its window reaches, crowded buckets cut into sections on both sides. `associate` only needs the groups, so it does not list pairs: observations first
collapse into space-time cells so small that all members are linked by construction; cells are then
compared through their bounding boxes, and only cells whose boxes leave the answer open are opened.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremora.fixed import LINK_DISTANCE_KM, LINK_DT_SECONDS
from tremora.functions.geo import cartesian_km, chord_km, haversine_km
from tremora.operators.components import connected_components
from tremora.operators.ranking import dense_ids
from tremora.session import materialize

_SPACE = ("x", "y", "z")
_SLACK_KM = 1e-6  # boxes closer to the limit than this are decided by the exact distance
_DIRECT_PAIRS = 100_000  # point comparisons allowed for one pair of cells before it is subdivided
_MAX_DEPTH = 24
_SMALL = 200_000  # rows of five numbers that may be broadcast


@dataclass(frozen=True)
class LinkRule:
    dt_seconds: float = LINK_DT_SECONDS
    distance_km: float = LINK_DISTANCE_KM
    depth_km: float | None = None
    mw: float | None = None

    @property
    def dt_us(self) -> int:
        return int(self.dt_seconds * 1_000_000)

    @property
    def chord(self) -> float:
        return chord_km(self.distance_km)

    @property
    def tolerances(self) -> dict[str, float]:
        given = {"depth_km": self.depth_km, "mw": self.mw}
        return {name: value for name, value in given.items() if value is not None}


def _exactly_close(rule: LinkRule, a: str, b: str) -> Column:
    """The link test between two sides whose columns start with the prefixes `a` and `b`."""
    gap = F.abs(F.col(f"{b}t_us") - F.col(f"{a}t_us"))
    distance = haversine_km(*[F.col(f"{s}{c}") for s in (a, b) for c in ("latitude", "longitude")])
    close = (gap <= F.lit(rule.dt_us)) & (distance <= F.lit(rule.distance_km))
    for c, tol in rule.tolerances.items():
        close = close & F.coalesce(F.abs(F.col(f"{a}{c}") - F.col(f"{b}{c}")) <= F.lit(tol), F.lit(True))
    return close


def _reach(low: Column, high: Column, margin: float, cell: float, cells_per_bucket: int) -> Column:
    """All buckets that can hold something within `margin` of [low, high]."""
    bucket = lambda x: F.floor(F.floor(x / F.lit(cell)) / F.lit(cells_per_bucket)).cast("long")
    return F.sequence(bucket(low - F.lit(margin)), bucket(high + F.lit(margin)))


def _dealt(rows: DataFrame, parts: DataFrame, small: bool, keys: list[str], columns: list[str], own: str, other: str) -> DataFrame:
    """`rows` with the sections (s_a, s_b) in which each one is compared: its own section with every one of the other side."""
    parts = F.broadcast(parts) if small else parts
    count = lambda side: F.coalesce(F.col(f"n_{side}"), F.lit(1))
    section = F.pmod(F.xxhash64(*columns), count(own)).alias(f"s_{own}")
    return rows.join(parts, keys, "left").select(*rows.columns, section, F.explode(F.sequence(F.lit(0).cast("long"), count(other) - 1)).alias(f"s_{other}"))


def pair_sides(obs: DataFrame, rule: LinkRule, crowd: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """(earlier side with a_ columns, later side with b_ columns, keys): rows that may be linked have the same keys in exactly one place.

    A bucket that more than `crowd` rows lie in is cut into sections of about `crowd` rows on both sides, and each section of one
    meets each of the other under keys of its own. Rows equal in every column stay in one section.
    """
    span, side = max(1, 8 * rule.dt_us), 4 * rule.chord + 1e-9
    x, y, z = cartesian_km(F.col("latitude"), F.col("longitude"))
    placed = obs.withColumn("x", x).withColumn("y", y).withColumn("z", z)
    slot = lambda c, width: F.floor(c / F.lit(width)).cast("long")
    late = placed.select(
        *[F.col(c).alias(f"b_{c}") for c in obs.columns], slot(F.col("t_us"), span).alias("kt"),
        *[slot(F.col(c), side).alias(f"k{c}") for c in _SPACE],
    )
    early = placed.select(
        *[F.col(c).alias(f"a_{c}") for c in obs.columns], *_SPACE,
        F.explode(F.sequence(slot(F.col("t_us"), span), slot(F.col("t_us") + F.lit(rule.dt_us), span))).alias("kt"),
    )
    for c in _SPACE:
        early = early.withColumn(f"k{c}", F.explode(_reach(F.col(c), F.col(c), rule.chord + _SLACK_KM, side, 1)))
    early = early.drop(*_SPACE)
    keys = ["kt", *(f"k{c}" for c in _SPACE)]
    crowded = materialize(late.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd))
    held = crowded.count()
    if not held:
        return early, late, keys
    # rows of a crowded bucket are also the earlier side of the buckets after and around it
    spread = crowded.select(*keys, F.col("n").alias("own"), "n").withColumn("_t", F.explode(F.sequence(F.col("kt"), F.col("kt") + 1)))
    for c in _SPACE:
        spread = spread.withColumn(f"_{c}", F.explode(F.sequence(F.col(f"k{c}") - 1, F.col(f"k{c}") + 1)))
    itself = (F.col("_t") == F.col("kt")) & (F.col("_x") == F.col("kx")) & (F.col("_y") == F.col("ky")) & (F.col("_z") == F.col("kz"))
    spread = spread.select(*[F.col(f"_{k[1:]}").alias(k) for k in keys], "n", F.when(itself, F.col("n")).otherwise(0).alias("own"))
    sections = lambda n: F.greatest(F.ceil(n / F.lit(crowd)), F.lit(1)).cast("long")
    parts = spread.groupBy(*keys).agg(sections(F.sum("n")).alias("n_a"), sections(F.sum("own")).alias("n_b"))
    small = held * 54 <= _SMALL  # each crowded bucket reaches at most 54
    early = _dealt(early, parts, small, keys, [f"a_{c}" for c in obs.columns], "a", "b")
    late = _dealt(late, parts, small, keys, [f"b_{c}" for c in obs.columns], "b", "a")
    return early, late, [*keys, "s_a", "s_b"]


def close_pairs(obs: DataFrame, rule: LinkRule = LinkRule(), order: tuple[str, ...] = ("source", "source_event_id"), crowd: int = 4096) -> DataFrame:
    """Linked pairs as a_* and b_* columns, a before b in (t_us, *order). Buckets of over `crowd` rows are compared in sections."""
    early, late, keys = pair_sides(obs, rule, crowd)
    rank = lambda s: F.struct(*[F.col(f"{s}_{c}") for c in ("t_us", *order)])
    return early.join(late, keys).filter((rank("a") < rank("b")) & _exactly_close(rule, "a_", "b_")).drop(*keys)


# --- association without listing pairs -------------------------------------------------------------


def _measures(rule: LinkRule) -> list[str]:
    return ["t_us", *_SPACE, *rule.tolerances]


def _cell_key(rule: LinkRule, width: dict[str, float]) -> list[Column]:
    keys = []
    for m in _measures(rule):
        # An unknown depth or Mw is compatible with everything and forms its own cells.
        keys.append(F.coalesce(F.floor(F.col(m) / F.lit(width[m])).cast("long"), F.lit(-(1 << 62))).alias(f"c_{m}"))
    return keys


def _widths(rule: LinkRule) -> dict[str, float]:
    """Cell widths that make any two members of a cell linked."""
    side = rule.chord / math.sqrt(3.0) * 0.999
    width: dict[str, float] = {"t_us": max(rule.dt_us, 1), **{c: max(side, 1e-9) for c in _SPACE}}
    width.update({c: max(tol * 0.999, 1e-9) for c, tol in rule.tolerances.items()})
    return width


def _box_aggregates(rule: LinkRule) -> list[Column]:
    out = []
    for m in _measures(rule):
        out += [F.min(m).alias(f"lo_{m}"), F.max(m).alias(f"hi_{m}")]
    return out


def _gap(m: str) -> Column:
    return F.greatest(F.col(f"b.lo_{m}") - F.col(f"a.hi_{m}"), F.col(f"a.lo_{m}") - F.col(f"b.hi_{m}"), F.lit(0))


def _spread(m: str) -> Column:
    return F.greatest(F.col(f"b.hi_{m}") - F.col(f"a.lo_{m}"), F.col(f"a.hi_{m}") - F.col(f"b.lo_{m}"))


def _length(parts: list[Column]) -> Column:
    return F.sqrt(reduce(lambda p, q: p + q, [p * p for p in parts]))


def _boxes_may_link(rule: LinkRule) -> Column:
    near = (_gap("t_us") <= rule.dt_us) & (_length([_gap(c) for c in _SPACE]) <= rule.chord + _SLACK_KM)
    for c, tol in rule.tolerances.items():
        near = near & F.coalesce(_gap(c) <= F.lit(tol), F.lit(True))
    return near


def _boxes_must_link(rule: LinkRule) -> Column:
    sure = (_spread("t_us") <= rule.dt_us) & (_length([_spread(c) for c in _SPACE]) <= rule.chord - _SLACK_KM)
    for c, tol in rule.tolerances.items():
        sure = sure & F.coalesce(_spread(c) <= F.lit(tol), F.lit(True))
    return sure


def _summaries(points: DataFrame, cell: str, rule: LinkRule) -> DataFrame:
    return points.groupBy(cell).agg(F.count(F.lit(1)).alias("n"), *_box_aggregates(rule))


def _compare(frontier: DataFrame, boxes: DataFrame, rule: LinkRule) -> DataFrame:
    """Frontier rows (root_a, root_b, a_cell, b_cell) that may link, with the verdict `sure`."""
    a, b = boxes.alias("a"), boxes.alias("b")
    return (
        frontier.alias("f")
        .join(a, F.col("f.a_cell") == F.col("a.cell"))
        .join(b, F.col("f.b_cell") == F.col("b.cell"))
        .filter(_boxes_may_link(rule))
        .select("f.root_a", "f.root_b", "f.a_cell", "f.b_cell",
                (F.col("a.n") * F.col("b.n")).alias("work"), _boxes_must_link(rule).alias("sure"))
    )


def _resolve(unsure: DataFrame, members: DataFrame, rule: LinkRule, direct_pairs: int) -> DataFrame:
    """Exact (root_a, root_b) links among cell pairs whose boxes did not decide.

    Cell pairs with little work are compared point by point. The others are subdivided: a crowded pair
    of neighbours is normally decided by two of its sub-boxes, after which the whole pair is done.
    """
    width = _widths(rule)
    found: list[DataFrame] = []
    points = members
    for depth in range(1, _MAX_DEPTH + 1):
        small = unsure if depth == _MAX_DEPTH else unsure.filter(F.col("work") <= direct_pairs)
        pa, pb = points.alias("a"), points.alias("b")
        found.append(
            small.alias("f")
            .join(pa, F.col("f.a_cell") == F.col("a.cell"))
            .join(pb, F.col("f.b_cell") == F.col("b.cell"))
            .filter(_exactly_close(rule, "a.", "b."))
            .select("root_a", "root_b").distinct()
        )
        large = unsure.filter(F.col("work") > direct_pairs)
        if depth == _MAX_DEPTH or large.isEmpty():
            break
        finer = {m: w / 2**depth for m, w in width.items()}
        finer["t_us"] = max(1.0, float(width["t_us"]) / 2**depth)
        parents = large.select(F.explode(F.array("a_cell", "b_cell")).alias("cell")).distinct()
        opened = points.join(parents, "cell", "left_semi").withColumn("_key", F.struct("cell", *_cell_key(rule, finer)))
        named = materialize(
            opened.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), *_box_aggregates(rule))
            .withColumn("child", F.monotonically_increasing_id())
        )
        points = materialize(
            opened.join(named.select("_key", "child"), "_key").drop("cell", "_key").withColumnRenamed("child", "cell")
        )
        family = named.select(F.col("_key.cell").alias("parent"), F.col("child"))
        pairs = (
            large.alias("f")
            .join(family.alias("a"), F.col("f.a_cell") == F.col("a.parent"))
            .join(family.alias("b"), F.col("f.b_cell") == F.col("b.parent"))
            .select("f.root_a", "f.root_b", F.col("a.child").alias("a_cell"), F.col("b.child").alias("b_cell"))
        )
        compared = materialize(_compare(pairs, named.drop("_key").withColumnRenamed("child", "cell"), rule))
        decided = compared.filter("sure").select("root_a", "root_b").distinct()
        found.append(decided)
        unsure = compared.filter("NOT sure").join(decided, ["root_a", "root_b"], "left_anti")
    return reduce(DataFrame.unionByName, found).distinct()


def associate(
    obs: DataFrame,
    rule: LinkRule = LinkRule(),
    order: tuple[str, ...] = ("source", "source_event_id"),
    out: str = "canonical_id",
    direct_pairs: int = _DIRECT_PAIRS,
) -> DataFrame:
    """Observations plus `out`: dense group ids 1..K by first appearance in (t_us, *order)."""
    x, y, z = cartesian_km(F.col("latitude"), F.col("longitude"))
    placed = obs.withColumn("x", x).withColumn("y", y).withColumn("z", z)
    width = _widths(rule)
    keyed = placed.select("*", *_cell_key(rule, width))
    key = [f"c_{m}" for m in _measures(rule)]

    cells = materialize(
        keyed.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t_us", *order)).alias("head"), *_box_aggregates(rule))
        .withColumn("cell", F.monotonically_increasing_id())
    )

    # Candidate cell pairs: cells nest in buckets of 8 cells per axis, so a bucket holds a bounded
    # number of cells however many observations they summarise.
    per = 8
    # Both sides carry their boxes and sizes from here on: looking them up by cell would shuffle the copies of a cell once more.
    box_columns = [c for c in cells.columns if c.startswith(("lo_", "hi_"))]
    home = cells.select(
        F.col("cell").alias("b_cell"), "n", *box_columns,
        *[F.floor(F.col(f"c_{m}") / per).cast("long").alias(f"k_{m}") for m in ("t_us", *_SPACE)],
    )
    scan = cells.select(F.col("cell").alias("a_cell"), "n", *box_columns)
    for m in ("t_us", *_SPACE):
        margin = float(rule.dt_us) if m == "t_us" else rule.chord + _SLACK_KM
        scan = scan.withColumn(f"k_{m}", F.explode(_reach(F.col(f"lo_{m}"), F.col(f"hi_{m}"), margin, width[m], per)))
    bucket = [f"k_{m}" for m in ("t_us", *_SPACE)]
    a, b = scan.alias("a"), home.alias("b")
    candidates = (
        a.join(b, bucket)
        .filter((F.col("a.a_cell") < F.col("b.b_cell")) & _boxes_may_link(rule))
        .select(F.col("a.a_cell").alias("root_a"), F.col("b.b_cell").alias("root_b"), "a_cell", "b_cell",
                (F.col("a.n") * F.col("b.n")).alias("work"), _boxes_must_link(rule).alias("sure"))
    )
    candidates = materialize(candidates)
    sure = candidates.filter("sure").select("root_a", "root_b")
    unsure = candidates.filter("NOT sure")
    links = sure
    if not unsure.isEmpty():
        involved = unsure.select(F.explode(F.array("a_cell", "b_cell")).alias("cell")).distinct()
        open_cells = cells.select("cell", *key).join(involved, "cell")
        columns = ["t_us", "latitude", "longitude", *_SPACE, *rule.tolerances]
        # Copies of a point answer the same questions once.
        members = materialize(keyed.join(open_cells, key).select("cell", *columns).distinct())
        links = sure.unionByName(_resolve(unsure, members, rule, direct_pairs))

    labels = connected_components(links, "root_a", "root_b")
    grouped = (
        cells.select("cell", "head", *key)
        .join(labels.withColumnRenamed("node", "cell"), "cell", "left")
        .withColumn("component", F.coalesce("component", "cell"))
    )
    heads = grouped.groupBy("component").agg(F.min("head").alias("head"))
    numbered = dense_ids(heads, ["head"], out).select("component", out)
    names = grouped.join(numbered, "component").select(*key, out)
    return keyed.join(names, key).drop(*key, *_SPACE)
