"""Plot-ready rows: coloured points of traces and lines of roads, as GeoJSON features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colour import gradient


def chosen(traces: DataFrame, ids: list[int] | None = None, first: int = 0, last: int | None = None, step: int = 1) -> DataFrame:
    """Traces by a list of ids, or every ``step``-th from first to before last."""
    if ids is not None:
        return traces.where(F.col("traj_id").isin(ids))
    rows = traces.where((F.col("traj_id") >= first) & (F.pmod(F.col("traj_id") - first, F.lit(step)) == 0))
    return rows if last is None else rows.where(F.col("traj_id") < last)


def spaced(traces: DataFrame, seconds: int) -> DataFrame:
    """Rows at least ``seconds`` after the row before (the first always)."""
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("traj_id").orderBy("seq"))
    return traces.withColumn("_g", gap).where(F.col("_g").isNull() | (F.col("_g") >= seconds)).drop("_g")


def coloured(traces: DataFrame) -> DataFrame:
    """Adds the place in the trace and its colour."""
    w = Window.partitionBy("traj_id")
    n = F.row_number().over(w.orderBy("seq")) - 1
    return traces.withColumn("place", n).withColumn("colour", gradient(F.col("place"), F.count(F.lit(1)).over(w)))


def point_features(rows: DataFrame) -> DataFrame:
    """A line of GeoJSON for each point."""
    return rows.select(F.format_string('{"type":"Feature","geometry":{"type":"Point","coordinates":[%.6f,%.6f]},"properties":{"trace":%d,"place":%d,"colour":"%s"}}', "lon", "lat", "traj_id", "place", "colour").alias("value"))


def road_features(points: DataFrame, roads: DataFrame | None = None) -> DataFrame:
    """A line of GeoJSON for each road, or each of those in ``roads``."""
    rows = points if roads is None else points.join(roads.select("road_id").distinct(), "road_id", "left_semi")
    line = F.array_sort(F.collect_list(F.struct("pos", F.format_string("[%.6f,%.6f]", "lon", "lat").alias("p"))))
    shape = rows.groupBy("road_id").agg(F.array_join(F.transform(line, lambda x: x["p"]), ",").alias("c"))
    return shape.select(F.format_string('{"type":"Feature","geometry":{"type":"LineString","coordinates":[%s]},"properties":{"road":%d}}', "c", "road_id").alias("value"))


def trace_lines(points: DataFrame, visits: DataFrame) -> DataFrame:
    """A line of GeoJSON for each road of each trace: ``visits`` has traj_id, road_id; a road that a trace visits again is drawn once."""
    line = F.array_sort(F.collect_list(F.struct("pos", F.format_string("[%.6f,%.6f]", "lon", "lat").alias("p"))))
    shape = points.groupBy("road_id").agg(F.array_join(F.transform(line, lambda x: x["p"]), ",").alias("c"))
    drawn = visits.select("traj_id", "road_id").distinct().join(shape, "road_id")
    return drawn.select(F.format_string('{"type":"Feature","geometry":{"type":"LineString","coordinates":[%s]},"properties":{"trace":%d,"road":%d}}', "c", "traj_id", "road_id").alias("value"))
