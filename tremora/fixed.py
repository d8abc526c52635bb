"""Physical constants, boxes, priorities and thresholds the results depend on."""

from __future__ import annotations

from typing import NamedTuple

EARTH_RADIUS_KM = 6371.0088
KM_PER_DEGREE = 111.32
YEAR_DAYS = 365.25
DAY_US = 86_400_000_000
NEVER_DAYS = 99_999.0
RATE_ORIGIN_US = -315_619_200_000_000  # 1960-01-01T00:00:00Z
PROB_EPS = 1e-7


class Box(NamedTuple):
    """Latitude/longitude rectangle, closed on all four sides."""

    min_lat: float
    max_lat: float
    min_lon: float
    max_lon: float


# Country rectangles in priority order: the first that contains a point names it.
COUNTRY_BOXES = {
    "Peru": Box(-18.5, 0.5, -81.5, -68.0),
    "Ecuador": Box(-5.0, 2.0, -82.0, -75.0),
    "Chile": Box(-56.0, -17.0, -76.0, -66.0),
    "Bolivia": Box(-23.0, -9.0, -70.0, -57.5),
    "Colombia": Box(-4.5, 13.0, -82.0, -66.0),
}
STUDY_BOX = Box(-60.0, 15.0, -85.0, -58.0)
MACRO_BOXES = {
    "Perú-Norte": Box(-8.0, 0.5, -81.5, -68.0),
    "Perú-Centro": Box(-14.0, -8.0, -81.5, -68.0),
    "Perú-Sur": Box(-18.5, -14.0, -76.0, -68.0),
}
SOUTH_TARGET_BOX = MACRO_BOXES["Perú-Sur"]
SOUTH_CENTROID = (-16.25, -72.0)
REMOTE_KM = 600.0

ORIGIN_PRIORITY = ("igp", "isc", "usgs", "emsc")
LINK_DT_SECONDS = 16.0
LINK_DISTANCE_KM = 100.0
LARGE_GROUP_OBS = 12

# Order of the neighbour-country table.
NEIGHBOUR_ORDER = ("Peru", "Chile", "Ecuador", "Colombia", "Bolivia")
MONTH_LENGTHS = (31, 28.25, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
MONTH_NAMES = ("Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic")

HORIZONS_DAYS = (7, 30, 90, 365)
EPOCH_WINDOWS_DAYS = (1, 7, 30, 90)
EPOCH_DRAWS = 3000
EPOCH_CURVE_DRAWS = 300

# Published triggering parameters reused for the feature table, and plausible ranges.
TRIGGER_MU, TRIGGER_K, TRIGGER_ALPHA, TRIGGER_C, TRIGGER_P = 0.481, 0.171, 0.866, 0.398, 1.534
PLAUSIBLE_RANGES = (("p", 1.0, 1.3), ("c", 0.003, 0.5), ("alpha_ln10", 0.6, 1.1), ("n", 0.2, 0.95))
