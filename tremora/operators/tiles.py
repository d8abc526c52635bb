"""A tile index of polygons: a point meets only the edges of its own tile, and none where a tile lies inside a region.

Square tiles are outside, inside or crossed by a region's boundary. A crossed tile keeps its edges and the parity of its south-west
corner, i.e. whether that corner is inside. A point of the tile is reached from the corner along the western border and then
eastward; each edge met on the way turns inside into outside. Corners of the first tiles are judged by counting crossings of each tile
row from the east. Tiles with many edges are cut into 4 x 4 smaller ones, whose corners are judged like any point of the larger tile.

Points on a boundary count as the even-odd rule of an eastward ray counts them: edges are half open, ties are decided
as if a point lay a trifle to the east, and far less than that to the north.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.session import materialize

#: Tiles with more edges are cut, at most so often: edges that share a vertex cannot be told apart by smaller tiles.
EDGES, DEEPEST, _CUT = 48, 4, 4
_SLACK = 1e-9  # of a tile; edges are filed a trifle too widely rather than too narrowly
_EDGE = ("x1", "y1", "x2", "y2")


def tile_of(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(size)).cast("long")


def _straddles(y: Column) -> Column:
    return (F.col("y1") > y) != (F.col("y2") > y)


def _crossing_x(y: Column) -> Column:
    return F.col("x1") + F.try_divide((y - F.col("y1")) * (F.col("x2") - F.col("x1")), F.col("y2") - F.col("y1"))


def _flips(lon: Column, lat: Column, west: Column, south: Column) -> Column:
    """How often (0 to 2) an edge is met between the corner (west, south) and the point."""
    across = F.when(_straddles(lat), _crossing_x(lat))
    eastward = F.coalesce((across > west) & (across <= lon), F.lit(False))
    rise = F.try_divide(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    height = F.when((F.col("x1") > west) != (F.col("x2") > west), F.col("y1") + (west - F.col("x1")) * rise)
    above = lambda y: (height > y) | ((height == y) & (rise > 0))
    return eastward.cast("int") + F.coalesce(above(south) != above(lat), F.lit(False)).cast("int")


def _filed(edges: DataFrame, size: float) -> DataFrame:
    """Edges with the tiles (tx, ty) that they pass through, row by row."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn("ty", F.explode(F.sequence(tile_of(low, size), tile_of(high, size))))
    bottom, top = F.greatest(low, F.col("ty") * F.lit(size)), F.least(high, (F.col("ty") + 1) * F.lit(size))
    flat = F.col("y1") == F.col("y2")
    a, b = (F.when(flat, F.col(x)).otherwise(_crossing_x(y)) for x, y in (("x1", bottom), ("x2", top)))
    margin = F.lit(_SLACK * size)
    first, last = (F.greatest(F.least("x1", "x2"), F.least(a, b) - margin), F.least(F.greatest("x1", "x2"), F.greatest(a, b) + margin))
    return rows.withColumn("tx", F.explode(F.sequence(tile_of(F.least(first, last), size), tile_of(F.greatest(first, last), size))))


def _first_parities(edges: DataFrame, filed: DataFrame, size: float) -> DataFrame:
    """(region_id, ty, tx, odd, crossed) of all tiles between the first and last crossed one of each region and row."""
    crossed = filed.groupBy("region_id", "ty", "tx").agg(F.lit(True).alias("crossed"))
    spans = crossed.groupBy("region_id", "ty").agg(F.min("tx").alias("a"), F.max("tx").alias("b"))
    wanted = spans.select("region_id", "ty", F.explode(F.sequence("a", "b")).alias("tx"), F.lit(0).cast("long").alias("met"), F.lit(True).alias("wanted"))
    line = F.col("ty") * F.lit(size)
    lines = edges.filter("y1 <> y2").withColumn("ty", F.explode(F.sequence(tile_of(F.least("y1", "y2"), size), tile_of(F.greatest("y1", "y2"), size) + 1)))
    met = lines.filter(_straddles(line)).select("region_id", "ty", (F.ceil(_crossing_x(line) / F.lit(size)).cast("long") - 1).alias("tx"))
    counts = met.groupBy("region_id", "ty", "tx").agg(F.count(F.lit(1)).alias("met")).withColumn("wanted", F.lit(False))
    tiles = wanted.unionByName(counts).groupBy("region_id", "ty", "tx").agg(F.sum("met").alias("met"), F.max("wanted").alias("wanted"))
    from_east = Window.partitionBy("region_id", "ty").orderBy(F.desc("tx")).rowsBetween(Window.unboundedPreceding, 0)
    judged = tiles.withColumn("odd", (F.sum("met").over(from_east) % 2).cast("int")).filter("wanted")
    return judged.select("region_id", "ty", "tx", "odd").join(crossed, ["region_id", "ty", "tx"], "left").withColumn("crossed", F.coalesce("crossed", F.lit(False)))


@dataclass
class TileIndex:
    """inside: (level, tx, ty, region_id); crossed: the same, odd and an edge, one row per edge; sizes: of tiles by level."""

    inside: DataFrame
    crossed: DataFrame
    sizes: Sequence[float]

    def keyed(self, points: DataFrame) -> DataFrame:
        """Points once per level, with their tile there; a point has one leaf tile at most."""
        tiles = [F.struct(F.lit(k).alias("level"), tile_of(F.col("lon"), s).alias("tx"), tile_of(F.col("lat"), s).alias("ty"), F.lit(s).alias("size")) for k, s in enumerate(self.sizes)]
        return points.select("point_id", "lon", "lat", F.inline(F.array(*tiles)))

    def regions_of(self, points: DataFrame) -> DataFrame:
        """(point_id, region_id) for every region that contains the point."""
        asked = self.keyed(points)
        whole = asked.join(self.inside, ["level", "tx", "ty"]).select("point_id", "region_id")
        west, south = F.col("tx") * F.col("size"), F.col("ty") * F.col("size")
        met = asked.join(self.crossed, ["level", "tx", "ty"]).groupBy("point_id", "region_id").agg(
            (F.max("odd") + F.sum(_flips(F.col("lon"), F.col("lat"), west, south))).alias("n")
        )
        return whole.unionByName(met.filter("n % 2 = 1").select("point_id", "region_id"))


def tile_index(edges: DataFrame, size: float = 1.0, most: int | None = None, deepest: int | None = None) -> TileIndex:
    """Index of `edges` (region_id, x1, y1, x2, y2); rings must be closed."""
    most, deepest = most or EDGES, DEEPEST if deepest is None else deepest
    edges = edges.select("region_id", *_EDGE)
    filed = materialize(_filed(edges, size))
    tiles = materialize(_first_parities(edges, filed, size))
    insides, leaves, sizes, place = [], [], [size], ["tx", "ty"]
    while True:
        level = F.lit(len(sizes) - 1).alias("level")
        insides.append(tiles.filter("NOT crossed AND odd = 1").select(level, "tx", "ty", "region_id"))
        held = filed.join(tiles.filter("crossed").select("region_id", "tx", "ty", "odd"), ["region_id", "tx", "ty"])
        crowded = materialize(filed.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(*place))
        if len(sizes) > deepest or crowded.isEmpty():
            leaves.append(held.select(level, "tx", "ty", "region_id", "odd", *_EDGE))
            break
        leaves.append(held.join(crowded, place, "left_anti").select(level, "tx", "ty", "region_id", "odd", *_EDGE))
        cut = materialize(held.join(crowded, place, "left_semi"))
        fine, parent = sizes[-1] / _CUT, [F.col("tx").alias("px"), F.col("ty").alias("py")]
        steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in range(_CUT) for b in range(_CUT)])
        west, south = F.col("px") * F.lit(sizes[-1]), F.col("py") * F.lit(sizes[-1])
        spread = cut.select("region_id", "odd", *_EDGE, *parent, F.inline(steps))
        corners = spread.select("region_id", "odd", *_EDGE, "px", "py", (F.col("px") * _CUT + F.col("dx")).alias("tx"), (F.col("py") * _CUT + F.col("dy")).alias("ty"))
        lon, lat = F.col("tx") * F.lit(fine), F.col("ty") * F.lit(fine)
        parities = corners.groupBy("region_id", "tx", "ty").agg(((F.max("odd") + F.sum(_flips(lon, lat, west, south))) % 2).cast("int").alias("odd"))
        again = _filed(cut.select("region_id", *_EDGE, *parent), fine).filter((F.floor(F.col("tx") / _CUT) == F.col("px")) & (F.floor(F.col("ty") / _CUT) == F.col("py")))
        filed = materialize(again.select("region_id", *_EDGE, "tx", "ty"))
        crossed = filed.groupBy("region_id", "tx", "ty").agg(F.lit(True).alias("crossed"))
        tiles = materialize(parities.join(crossed, ["region_id", "tx", "ty"], "left").withColumn("crossed", F.coalesce("crossed", F.lit(False))))
        sizes.append(fine)
    return TileIndex(reduce(DataFrame.unionByName, insides), reduce(DataFrame.unionByName, leaves), sizes)
