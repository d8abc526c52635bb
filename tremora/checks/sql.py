"""Common table expressions of the check SQL: the derived catalog, written independently of the Spark plans."""

from __future__ import annotations


def _coordinates(wide: bool) -> str:
    lat, lon = ("-58.0", 7200), ("-84.0", 2500)
    if not wide:
        lat, lon = ("-18.5", 1900), ("-81.5", 1350)
    return f"""
        {lat[0]}::DOUBLE + ((user_id * 7919) % {lat[1]})::DOUBLE / 100.0::DOUBLE + ((event_id * 31) % 41 - 20)::DOUBLE / 100.0::DOUBLE AS latitude,
        {lon[0]}::DOUBLE + ((user_id * 104729) % {lon[1]})::DOUBLE / 100.0::DOUBLE + ((event_id * 17) % 41 - 20)::DOUBLE / 100.0::DOUBLE AS longitude"""


def _reports(wide: bool) -> str:
    return f"""SELECT event_id, user_id, 946684800000000 + 120 * (epoch_us(ts) - 1704067200000000) AS t_us, {_coordinates(wide)},
        (-5 + (event_id * 37) % 850)::DOUBLE AS depth_raw,
        (40 + floor(value / 11.513::DOUBLE)::BIGINT)::DOUBLE / 10.0::DOUBLE AS magnitude,
        CASE event_type WHEN 'error' THEN 'mww' WHEN 'click' THEN 'mb' WHEN 'purchase' THEN 'Ms' WHEN 'view' THEN 'ML' END AS magnitude_type
        FROM events"""


COUNTRY = """CASE
    WHEN latitude BETWEEN -18.5 AND 0.5 AND longitude BETWEEN -81.5 AND -68.0 THEN 'Peru'
    WHEN latitude BETWEEN -5.0 AND 2.0 AND longitude BETWEEN -82.0 AND -75.0 THEN 'Ecuador'
    WHEN latitude BETWEEN -56.0 AND -17.0 AND longitude BETWEEN -76.0 AND -66.0 THEN 'Chile'
    WHEN latitude BETWEEN -23.0 AND -9.0 AND longitude BETWEEN -70.0 AND -57.5 THEN 'Bolivia'
    WHEN latitude BETWEEN -4.5 AND 13.0 AND longitude BETWEEN -82.0 AND -66.0 THEN 'Colombia'
    ELSE 'Other' END"""

DEPTH = "CASE WHEN depth_raw < 0 THEN 0.0::DOUBLE WHEN depth_raw > 800 THEN NULL ELSE depth_raw END"

_KIND = "lower(trim(coalesce(magnitude_type, '')))"
_SURFACE = "CASE WHEN {x} <= 6.1::DOUBLE THEN 0.67::DOUBLE * {x} + 2.07::DOUBLE ELSE 0.99::DOUBLE * {x} + 0.08::DOUBLE END"
_VIA = "(CASE WHEN magnitude < 5.9::DOUBLE THEN 1.644::DOUBLE * magnitude + (-3.753)::DOUBLE ELSE 2.763::DOUBLE * magnitude + (-10.301)::DOUBLE END)"

# scheme -> [(condition on the cleaned type, value, method)], before the default tail
_SCHEME_SQL = {
    "scordilis": [],
    "digiacomo": [("ms%", "exp(-0.222::DOUBLE + 0.233::DOUBLE * magnitude) + 2.863::DOUBLE", "digiacomo_ms"),
                  ("mb%", "exp(-4.664::DOUBLE + 0.859::DOUBLE * magnitude) + 4.555::DOUBLE", "digiacomo_mb")],
    "peru": [("mb%", "0.9588::DOUBLE * magnitude + 0.458::DOUBLE", "peru_cahuari_mb"),
             ("ms%", "0.7044::DOUBLE * magnitude + 1.702::DOUBLE", "peru_cahuari_ms"),
             ("ml%", "0.9879::DOUBLE * magnitude + 0.3316::DOUBLE", "peru_cahuari_mld"),
             ("md%", "0.9879::DOUBLE * magnitude + 0.3316::DOUBLE", "peru_cahuari_mld"),
             ("mc%", "0.9879::DOUBLE * magnitude + 0.3316::DOUBLE", "peru_cahuari_mld")],
    "igp_national": [("mb%", _SURFACE.format(x=_VIA), "igp_mb_ms_mw")],
}
_TAIL = [("ms%", _SURFACE.format(x="magnitude"), "scordilis_ms"), ("mb%", "0.85::DOUBLE * magnitude + 1.03::DOUBLE", "scordilis_mb"),
         ("ml%", "magnitude", "assume_ml"), ("md%", "magnitude", "assume_md"), ("mc%", "magnitude", "assume_md")]


def mw(scheme: str = "scordilis") -> str:
    cases = " ".join(f"WHEN {_KIND} LIKE '{p}' THEN {v}" for p, v, _ in _SCHEME_SQL[scheme] + _TAIL)
    return f"CASE WHEN magnitude IS NULL THEN NULL WHEN {_KIND} LIKE 'mw%' THEN magnitude {cases} ELSE magnitude END"


def mw_method(scheme: str = "scordilis") -> str:
    cases = " ".join(f"WHEN {_KIND} LIKE '{p}' THEN '{m}'" for p, _, m in _SCHEME_SQL[scheme] + _TAIL)
    return f"CASE WHEN magnitude IS NULL THEN 'none' WHEN {_KIND} LIKE 'mw%' THEN 'direct' {cases} ELSE 'assume_unknown' END"


METHOD_RANK = """CASE WHEN mw_method = 'direct' THEN 100 WHEN mw_method LIKE '%ms%' THEN 80 WHEN mw_method LIKE '%mb%' THEN 70
    WHEN mw_method LIKE '%ml%' THEN 40 WHEN mw_method LIKE '%md%' THEN 30 WHEN mw_method LIKE 'assume%' THEN 10 ELSE 0 END"""
SOURCE_RANK = "CASE lower(source) WHEN 'igp' THEN 0 WHEN 'isc' THEN 1 WHEN 'usgs' THEN 2 WHEN 'emsc' THEN 3 ELSE 4 END"


def reports(wide: bool = False) -> str:
    return f"reports AS ({_reports(wide)})"


def raw(wide: bool = False) -> str:
    """reports, raw"""
    return f"""{reports(wide)}, raw AS (
        SELECT 'usgs' AS source, 'usgs' || event_id AS source_event_id, event_id, t_us, latitude + 0.0::DOUBLE AS latitude, longitude, depth_raw, magnitude, magnitude_type FROM reports
        UNION ALL
        SELECT 'isc', 'isc' || event_id, event_id, t_us + 1000000, latitude + 0.02::DOUBLE, longitude, depth_raw, magnitude, magnitude_type FROM reports WHERE magnitude >= 4.2
        UNION ALL
        SELECT 'igp', 'igp' || event_id, event_id, t_us + 3000000, latitude + (-0.02)::DOUBLE, longitude, depth_raw, magnitude, NULL FROM reports WHERE longitude <= -72.0)"""


def obs(wide: bool = False) -> str:
    """reports, raw, obs"""
    return f"""{raw(wide)}, obs AS (SELECT source, source_event_id, event_id, t_us, latitude, longitude, {DEPTH} AS depth_km, magnitude, magnitude_type,
        {mw()} AS mw, {mw_method()} AS mw_method, {COUNTRY} AS country FROM raw)"""


def cat(wide: bool = False) -> str:
    """reports, cat"""
    return f"""{reports(wide)}, cat AS (SELECT event_id AS canonical_id, t_us, latitude, longitude, {DEPTH} AS depth_km, magnitude AS preferred_mw,
        magnitude AS preferred_mag, magnitude_type AS preferred_mag_type, {COUNTRY} AS country FROM reports)"""


def haversine(a: str, b: str) -> str:
    s1 = f"sin(radians({b}.latitude - {a}.latitude) / 2)"
    s2 = f"sin(radians({b}.longitude - {a}.longitude) / 2)"
    h = f"{s1} * {s1} + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * {s2} * {s2}"
    return f"2 * 6371.0088::DOUBLE * asin(sqrt(least(1.0::DOUBLE, {h})))"


def linked() -> str:
    """reports, raw, obs, pairs, linked: canonical ids by transitive closure of the pairs."""
    return f"""{obs()}, pairs AS (
        SELECT a.source_event_id AS a_id, b.source_event_id AS b_id, a.source AS a_source, b.source AS b_source, {haversine('a', 'b')} AS km, b.t_us - a.t_us AS gap_us
        FROM obs a JOIN obs b ON b.t_us >= a.t_us AND b.t_us <= a.t_us + 16000000
        WHERE (a.t_us, a.source, a.source_event_id) < (b.t_us, b.source, b.source_event_id) AND {haversine('a', 'b')} <= 100.0),
    arcs AS (SELECT a_id AS u, b_id AS v FROM pairs UNION ALL SELECT b_id, a_id FROM pairs),
    reach AS (SELECT source_event_id AS u, source_event_id AS v FROM obs UNION SELECT reach.u, arcs.v FROM reach JOIN arcs ON reach.v = arcs.u),
    heads AS (SELECT reach.u AS id, min((o.t_us, o.source, o.source_event_id)) AS head FROM reach JOIN obs o ON o.source_event_id = reach.v GROUP BY reach.u),
    linked AS (SELECT o.*, dense_rank() OVER (ORDER BY h.head) AS canonical_id FROM obs o JOIN heads h ON h.id = o.source_event_id)"""


def events_of_linked() -> str:
    """..., linked, canon"""
    return f"""{linked()}, origin AS (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY {SOURCE_RANK}, (depth_km IS NULL)::INT, (mw IS NULL)::INT, t_us, source, source_event_id) AS rn FROM linked),
    size AS (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY -({METHOD_RANK}), {SOURCE_RANK}, t_us, source, source_event_id) AS rn FROM linked),
    tally AS (SELECT canonical_id, count(*) AS n_obs, count(DISTINCT source) AS n_sources, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM linked GROUP BY 1),
    canon AS (SELECT o.canonical_id, o.t_us, o.latitude, o.longitude, o.depth_km, s.mw AS preferred_mw, s.magnitude AS preferred_mag, s.magnitude_type AS preferred_mag_type,
        o.source AS preferred_source, s.source AS mag_source, t.n_sources, t.n_obs, o.country, t.sources
        FROM origin o JOIN size s ON s.canonical_id = o.canonical_id AND s.rn = 1 JOIN tally t ON t.canonical_id = o.canonical_id WHERE o.rn = 1)"""


DAY = 86_400_000_000


def grid(min_mag: float = 4.0, res: str = "0.25", rows: int = 76, columns: int = 54, min_events: int = 5) -> str:
    """reports, cat, ev, active, inst, base: the active cell x instant scaffold."""
    return f"""{cat()}, ev AS (SELECT * FROM (SELECT floor((latitude - (-18.5)::DOUBLE) / {res}::DOUBLE)::BIGINT AS i, floor((longitude - (-81.5)::DOUBLE) / {res}::DOUBLE)::BIGINT AS j,
        t_us, preferred_mw AS mag FROM cat WHERE preferred_mw >= {min_mag}) WHERE i BETWEEN 0 AND {rows - 1} AND j BETWEEN 0 AND {columns - 1}),
    active AS (SELECT i, j, count(*) AS n_events FROM ev GROUP BY 1, 2 HAVING count(*) >= {min_events}),
    inst AS (SELECT k, 946684800000000 + k * 30 * {DAY} AS t FROM (SELECT unnest(range(0, ((SELECT max(t_us) FROM ev) - 30 * {DAY} - 946684800000000) // (30 * {DAY}) + 1)) AS k)),
    base AS (SELECT i, j, i * {columns} + j AS cell_id, k, t FROM active, inst)"""


def past(days: int, a: str = "e") -> str:
    return f"{a}.t_us <= b.t AND {a}.t_us > b.t - {days} * {DAY}"


def ahead(days: int, a: str = "e") -> str:
    return f"{a}.t_us > b.t AND {a}.t_us <= b.t + {days} * {DAY}"


def months() -> str:
    return "months AS (SELECT unnest(range(1, 13)) AS month)"
