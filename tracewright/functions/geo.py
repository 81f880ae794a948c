"""Geometry as Column expressions; everything stays inside whole-stage code generation.

Coordinates are degrees, distances metres, angles radians unless a name says otherwise. Points are given by two columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
GRID_DEGREES = 0.001


def col(x) -> Column:
    """A column by its name, a column as it is, a number as a literal."""
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


@dataclass(frozen=True)
class Vec:
    """A planar point or vector of two columns, with the usual operations."""

    x: Column
    y: Column

    def __sub__(self, other: Vec) -> Vec:
        return Vec(self.x - other.x, self.y - other.y)

    def __add__(self, other: Vec) -> Vec:
        return Vec(self.x + other.x, self.y + other.y)

    def scale(self, k) -> Vec:
        return Vec(self.x * k, self.y * k)

    def dot(self, other: Vec) -> Column:
        return self.x * other.x + self.y * other.y

    def cross(self, other: Vec) -> Column:
        return self.x * other.y - self.y * other.x

    def length(self) -> Column:
        return F.sqrt(self.x * self.x + self.y * self.y)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    return haversine_m(lat1, lon1, lat2, lon2) / 1000


def with_planar(df: DataFrame, name: str, lat, lon, lat0, lon0, compat: bool = False) -> DataFrame:
    """Adds ``name``_x (to the north) and ``name``_y (to the east): local planar coordinates around an origin.

    A point is its distance from the origin in the direction of its bearing. ``compat`` takes sine and cosine of degrees for the
    bearing, which keeps distances but distorts directions. The parts are columns of their own, so the generated code has each
    once, however often the coordinates are used.
    """
    lat, lon, lat0, lon0 = map(col, (lat, lon, lat0, lon0))
    r = (lambda c: c) if compat else F.radians
    df = df.withColumn("_up", F.sin(r(lon - lon0)) * F.cos(r(lat)))
    df = df.withColumn("_along", F.cos(r(lat0)) * F.sin(r(lat)) - F.sin(r(lat0)) * F.cos(r(lat)) * F.cos(r(lon - lon0)))
    scale = F.coalesce(F.try_divide(haversine_m(lat0, lon0, lat, lon), F.sqrt(F.col("_up") * F.col("_up") + F.col("_along") * F.col("_along"))), F.lit(0.0))
    df = df.withColumn("_scale", scale)
    return df.withColumn(f"{name}_x", F.col("_scale") * F.col("_along")).withColumn(f"{name}_y", F.col("_scale") * F.col("_up")).drop("_up", "_along", "_scale")


def vec(name: str) -> Vec:
    """The vector of columns that ``with_planar`` added."""
    return Vec(F.col(f"{name}_x"), F.col(f"{name}_y"))


def angle_between(a: Vec, b: Vec) -> Column:
    """Angle of two vectors; the cosine is clamped, a vector of no length gives null."""
    cosine = F.try_divide(a.dot(b), a.length() * b.length())
    return F.acos(F.when(cosine > 1, 1.0).when(cosine < -1, -1.0).otherwise(cosine))


FRAME = ("_lat0", "_lon0", "_s_x", "_s_y", "_e_x", "_e_y")


def with_frame(segs: DataFrame, compat: bool = False) -> DataFrame:
    """Adds to segments what ``with_hit`` needs of them alone: their middle, and their ends in planar coordinates around it."""
    df = segs.withColumn("_lat0", (F.col("s_lat") + F.col("e_lat")) / 2).withColumn("_lon0", (F.col("s_lon") + F.col("e_lon")) / 2)
    return with_planar(with_planar(df, "_s", "s_lat", "s_lon", "_lat0", "_lon0", compat), "_e", "e_lat", "e_lon", "_lat0", "_lon0", compat)


def with_hit(df: DataFrame, compat: bool = False) -> DataFrame:
    """Adds ``_hit``, struct(dist, lat, lon): how far the point lat, lon is from the segment s_lat, s_lon, e_lat, e_lon, and its nearest point.

    The perpendicular foot counts if it lies in the rectangle of the ends, else the nearer end (the second on a tie). Rows that come
    from a join should have had ``with_frame`` on the side of the segments, which is then done once for each.
    """
    own = [c for c in df.columns if c not in FRAME]
    if "_s_x" not in df.columns:
        df = with_frame(df, compat)
    df = with_planar(df, "_p", "lat", "lon", "_lat0", "_lon0", compat)
    s, e, p = vec("_s"), vec("_e"), vec("_p")
    # the foot s + v t of the perpendicular through p
    df = df.withColumn("_t", F.try_divide((p - s).dot(e - s), (e - s).dot(e - s)))
    df = df.withColumn("_f_x", s.x + (e.x - s.x) * F.col("_t")).withColumn("_f_y", s.y + (e.y - s.y) * F.col("_t"))
    f = vec("_f")
    inside = (F.least(s.x, e.x) <= f.x) & (f.x <= F.greatest(s.x, e.x)) & (F.least(s.y, e.y) <= f.y) & (f.y <= F.greatest(s.y, e.y))
    df = df.withColumn("_in", F.coalesce(inside, F.lit(False))).withColumn("_ds", (p - s).dot(p - s)).withColumn("_de", (p - e).dot(p - e))
    first = F.col("_ds") < F.col("_de")

    def pick(at_foot, at_start, at_end):
        return F.when(F.col("_in"), at_foot).when(first, at_start).otherwise(at_end)

    t = F.col("_t")
    hit = F.struct(
        pick((p - f).length(), F.sqrt("_ds"), F.sqrt("_de")).alias("dist"),
        pick(F.col("s_lat") + (F.col("e_lat") - F.col("s_lat")) * t, F.col("s_lat"), F.col("e_lat")).alias("lat"),
        pick(F.col("s_lon") + (F.col("e_lon") - F.col("s_lon")) * t, F.col("s_lon"), F.col("e_lon")).alias("lon"),
    )
    return df.select(*own, hit.alias("_hit"))


def grid_cell(x, size: float = GRID_DEGREES) -> Column:
    """Cell number of a coordinate, truncated toward zero."""
    return (col(x) / size).cast("int")


def with_turn(df: DataFrame, name: str, before: tuple, at: tuple, after: tuple, compat: bool = False) -> DataFrame:
    """Adds by how much one turns at the middle of three points (pairs of latitude and longitude)."""
    df = with_planar(with_planar(df, "_b", *before, *at, compat), "_a", *after, *at, compat)
    return df.withColumn(name, F.pi() - angle_between(vec("_b"), vec("_a"))).drop("_b_x", "_b_y", "_a_x", "_a_y")
