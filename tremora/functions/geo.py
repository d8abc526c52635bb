"""Column builders for positions: distance, boxes, cartesian coordinates, grid cells."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tremora.fixed import COUNTRY_BOXES, EARTH_RADIUS_KM, KM_PER_DEGREE, Box


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def cartesian_km(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates. Straight-line distance never exceeds great-circle distance."""
    phi, lam, r = F.radians(lat), F.radians(lon), F.lit(EARTH_RADIUS_KM)
    return r * F.cos(phi) * F.cos(lam), r * F.cos(phi) * F.sin(lam), r * F.sin(phi)


def chord_km(distance_km: float) -> float:
    """Straight-line length that subtends a given great-circle distance."""
    half_turn = min(distance_km / EARTH_RADIUS_KM, math.pi) / 2
    return 2 * EARTH_RADIUS_KM * math.sin(half_turn)


def in_box(lat: Column, lon: Column, box: Box) -> Column:
    return lat.between(box.min_lat, box.max_lat) & lon.between(box.min_lon, box.max_lon)


def country_of(lat: Column, lon: Column, boxes: Mapping[str, Box] = COUNTRY_BOXES, other: str = "Other") -> Column:
    """Name of the first box, in mapping order, that contains the point."""
    hits = [F.when(in_box(lat, lon, box), F.lit(name)) for name, box in boxes.items()]
    return F.coalesce(*hits, F.lit(other))


@dataclass(frozen=True)
class Lattice:
    """Square cells of `res` degrees over a box; cells are addressed by (i, j)."""

    res: float = 0.1
    box: Box = COUNTRY_BOXES["Peru"]

    @property
    def rows(self) -> int:
        return round((self.box.max_lat - self.box.min_lat) / self.res)

    @property
    def columns(self) -> int:
        return round((self.box.max_lon - self.box.min_lon) / self.res)

    def row_of(self, lat: Column) -> Column:
        return F.floor((lat - F.lit(self.box.min_lat)) / F.lit(self.res)).cast("long")

    def column_of(self, lon: Column) -> Column:
        return F.floor((lon - F.lit(self.box.min_lon)) / F.lit(self.res)).cast("long")

    def contains(self, i: Column, j: Column) -> Column:
        return i.between(0, self.rows - 1) & j.between(0, self.columns - 1)

    def cell_id(self, i: Column, j: Column) -> Column:
        return i * F.lit(self.columns).cast("long") + j

    def centroid_lat(self, i: Column) -> Column:
        return F.lit(self.box.min_lat) + (i + F.lit(0.5)) * F.lit(self.res)

    def centroid_lon(self, j: Column) -> Column:
        return F.lit(self.box.min_lon) + (j + F.lit(0.5)) * F.lit(self.res)


def cell_area_km2(lat: Column, res: float) -> Column:
    side = res * KM_PER_DEGREE
    return F.lit(side * side) * F.cos(F.radians(lat))
