"""Pieces of DuckDB SQL that the oracle queries share."""

from __future__ import annotations

from ..fixtures import ctes

R2 = "12742000.0E0"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"({R2} * atan2(sqrt({a}), sqrt(1.0E0 - {a})))"


def planar(lat: str, lon: str, lat0: str, lon0: str, compat: bool = False) -> tuple[str, str]:
    r = "" if compat else "radians"
    up = f"sin({r}({lon} - ({lon0}))) * cos({r}({lat}))"
    along = f"(cos({r}({lat0})) * sin({r}({lat})) - sin({r}({lat0})) * cos({r}({lat})) * cos({r}({lon} - ({lon0}))))"
    b = f"atan2({up}, {along})"
    d = hav(f"({lat0})", f"({lon0})", lat, lon)
    return f"({d} * cos({b}))", f"({d} * sin({b}))"


def angle(ax: str, ay: str, bx: str, by: str) -> str:
    return f"acos(greatest(-1.0E0, least(1.0E0, ({ax} * {bx} + {ay} * {by}) / (sqrt({ax} * {ax} + {ay} * {ay}) * sqrt({bx} * {bx} + {by} * {by})))))"


def turn(p: tuple[str, str], at: tuple[str, str], e: tuple[str, str]) -> str:
    return f"(pi() - {angle(*planar(*p, *at), *planar(*e, *at))})"


#: Segments of the fixture network.
SEGS = f"""
segs0 AS (SELECT road_id, lat AS s_lat, lon AS s_lon, lead(lat) OVER w AS e_lat, lead(lon) OVER w AS e_lon, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon,
  row_number() OVER w - 1 AS seg_id FROM points WINDOW w AS (PARTITION BY road_id ORDER BY pos)),
segs1 AS (SELECT *, {hav("s_lat", "s_lon", "e_lat", "e_lon")} AS len, CASE WHEN p_lat IS NULL THEN 0.0E0 ELSE {turn(("p_lat", "p_lon"), ("s_lat", "s_lon"), ("e_lat", "e_lon"))} END AS turn FROM segs0 WHERE e_lat IS NOT NULL),
segs AS (SELECT road_id, seg_id, s_lat, s_lon, e_lat, e_lon, len, sum(len) OVER (PARTITION BY road_id ORDER BY seg_id) AS sum_prev,
  sum(len) OVER (PARTITION BY road_id ORDER BY seg_id DESC) AS sum_after, sum(turn) OVER (PARTITION BY road_id ORDER BY seg_id) AS cum_angle,
  CAST(trunc((s_lat + e_lat) / 2 / 0.001E0) AS BIGINT) AS gx, CAST(trunc((s_lon + e_lon) / 2 / 0.001E0) AS BIGINT) AS gy FROM segs1),
rds AS (SELECT e.road_id, from_node, to_node, level, sum(len) AS length_m, arg_max(s_lat, seg_id) AS l_slat, arg_max(s_lon, seg_id) AS l_slon, arg_max(s.e_lat, seg_id) AS l_elat, arg_max(s.e_lon, seg_id) AS l_elon,
  arg_min(s_lat, seg_id) AS f_slat, arg_min(s_lon, seg_id) AS f_slon, arg_min(s.e_lat, seg_id) AS f_elat, arg_min(s.e_lon, seg_id) AS f_elon FROM edges e JOIN segs s USING (road_id) GROUP BY ALL)"""


def net(*more: str) -> str:
    """Common table expressions of the network (points, edges, segs, rds) and of further views."""
    return ctes("points", "edges", *more) + "," + SEGS


def hit(source: str, extra: str) -> str:
    """Common table expressions h0..hits: distance and nearest point of rows of ``source`` (lat, lon, ends of a segment) and what else is named."""
    mid = ("((s_lat + e_lat) / 2)", "((s_lon + e_lon) / 2)")
    s, e, p = planar("s_lat", "s_lon", *mid), planar("e_lat", "e_lon", *mid), planar("lat", "lon", *mid)
    return f"""
h0 AS (SELECT *, {s[0]} AS sx, {s[1]} AS sy, {e[0]} AS ex, {e[1]} AS ey, {p[0]} AS px, {p[1]} AS py FROM ({source}) AS src),
h1 AS (SELECT *, ((px - sx) * (ex - sx) + (py - sy) * (ey - sy)) / ((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) AS t FROM h0),
h2 AS (SELECT *, sx + (ex - sx) * t AS fx, sy + (ey - sy) * t AS fy FROM h1),
h3 AS (SELECT *, least(sx, ex) <= fx AND fx <= greatest(sx, ex) AND least(sy, ey) <= fy AND fy <= greatest(sy, ey) AS inside,
  (px - sx) * (px - sx) + (py - sy) * (py - sy) AS ds, (px - ex) * (px - ex) + (py - ey) * (py - ey) AS de FROM h2),
hits AS (SELECT {extra}, s_lat, s_lon, CASE WHEN inside THEN sqrt((px - fx) * (px - fx) + (py - fy) * (py - fy)) WHEN ds < de THEN sqrt(ds) ELSE sqrt(de) END AS dist,
  CASE WHEN inside THEN s_lat + (e_lat - s_lat) * t WHEN ds < de THEN s_lat ELSE e_lat END AS c_lat,
  CASE WHEN inside THEN s_lon + (e_lon - s_lon) * t WHEN ds < de THEN s_lon ELSE e_lon END AS c_lon FROM h3)"""
