"""Road networks: segments, linear referencing, turns, degrees, and the text tables they come from.

``points`` has road_id, pos, lat, lon; ``edges`` has road_id, from_node, to_node. Windows partition by road, so no network is
gathered in one task; everything stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import angle_between, grid_cell, haversine_m, vec, with_frame, with_hit, with_planar, with_turn
from ..session import stored

MIN_TURN_LENGTH_M = 15.0
LEVELS = 7


def segments(points: DataFrame, compat: bool = False) -> DataFrame:
    """Segments of roads: ends, length, inclusive prefix and suffix sums, turn made since the road's start, grid cell of the middle.

    Roads of one point, and points equal to the one before, are dropped; segments are numbered densely.
    """
    w = Window.partitionBy("road_id").orderBy("pos")
    before = F.lag(F.struct("lat", "lon")).over(w)
    kept = points.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before.lat") != F.col("lat")) | (F.col("_before.lon") != F.col("lon"))).drop("_before")
    nxt = F.lead(F.struct("lat", "lon")).over(w)
    prev = F.lag(F.struct("lat", "lon")).over(w)
    ends = kept.select("road_id", "pos", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), nxt.alias("_n"), prev.alias("_p"), (F.row_number().over(w) - 1).alias("seg_id"))
    ends = ends.where("_n IS NOT NULL").select("*", F.col("_n.lat").alias("e_lat"), F.col("_n.lon").alias("e_lon"))
    ends = with_turn(ends, "_t", ("_p.lat", "_p.lon"), ("s_lat", "s_lon"), ("e_lat", "e_lon"), compat)
    turn = F.when(F.col("_p").isNull(), 0.0).otherwise(F.col("_t"))
    out = ends.select("road_id", "seg_id", "s_lat", "s_lon", "e_lat", "e_lon", haversine_m("s_lat", "s_lon", "e_lat", "e_lon").alias("len"), turn.alias("_turn"))
    order = Window.partitionBy("road_id").orderBy("seg_id")
    so_far, still = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    return out.select(
        "road_id", "seg_id", "s_lat", "s_lon", "e_lat", "e_lon", "len",
        F.sum("len").over(so_far).alias("sum_prev"),
        F.sum("len").over(still).alias("sum_after"),
        F.sum("_turn").over(so_far).alias("cum_angle"),
        grid_cell((F.col("s_lat") + F.col("e_lat")) / 2).alias("gx"),
        grid_cell((F.col("s_lon") + F.col("e_lon")) / 2).alias("gy"),
    )


def levelled(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Edges with their level from ``types`` (road_id, type 1..7); a missing or other type is level 0."""
    level = F.when(F.col("type").between(1, LEVELS), F.col("type") - 1).otherwise(0).cast("int")
    return edges.drop("level").join(types.select("road_id", "type"), "road_id", "left").withColumn("level", level).drop("type")


def roads(edges: DataFrame, segs: DataFrame) -> DataFrame:
    """Roads that have a segment: nodes, level, length, number of segments, first and last ends."""
    first, last = F.min_by(F.struct("s_lat", "s_lon", "e_lat", "e_lon"), "seg_id"), F.max_by(F.struct("s_lat", "s_lon", "e_lat", "e_lon"), "seg_id")
    shape = segs.groupBy("road_id").agg(F.sum("len").alias("length_m"), F.count(F.lit(1)).cast("int").alias("n_seg"), first.alias("first"), last.alias("last"), F.max_by("cum_angle", "seg_id").alias("turned"))
    return edges.select("road_id", "from_node", "to_node", "level").join(shape, "road_id")


def successors(rds: DataFrame) -> DataFrame:
    """Pairs of roads a, b where b starts at the node that a ends at."""
    a = rds.select(F.col("road_id").alias("road_a"), F.col("to_node").alias("node"))
    return a.join(rds.select(F.col("road_id").alias("road_b"), F.col("from_node").alias("node")), "node").select("road_a", "road_b", "node")


def turns(rds: DataFrame, compat: bool = False) -> DataFrame:
    """Turn between each road and its successors: road_a, road_b, turn."""
    pairs = successors(rds)
    a = rds.select(F.col("road_id").alias("road_a"), F.col("last").alias("a"))
    b = rds.select(F.col("road_id").alias("road_b"), F.col("first").alias("b"))
    joined = pairs.join(a, "road_a").join(b, "road_b")
    return with_turn(joined, "turn", ("a.s_lat", "a.s_lon"), ("b.s_lat", "b.s_lon"), ("b.e_lat", "b.e_lon"), compat).select("road_a", "road_b", "turn")


def distant_turns(pairs: DataFrame, rds: DataFrame, compat: bool = False) -> DataFrame:
    """Turn between roads that needn't touch (short roads lie between): the last direction of a against the first of b."""
    a = rds.select(F.col("road_id").alias("road_a"), F.col("last").alias("a"))
    b = rds.select(F.col("road_id").alias("road_b"), F.col("first").alias("b"))
    joined = pairs.join(a, "road_a").join(b, "road_b")
    at = ("b.s_lat", "b.s_lon")
    for name, lat, lon in (("_s", "a.s_lat", "a.s_lon"), ("_e", "a.e_lat", "a.e_lon"), ("_n", "b.e_lat", "b.e_lon")):
        joined = with_planar(joined, name, lat, lon, *at, compat)
    return joined.select("road_a", "road_b", (F.pi() - angle_between(vec("_s") - vec("_e"), vec("_n"))).alias("turn"))


def degrees(edges: DataFrame) -> DataFrame:
    """In- and out-degree of every node; one exchange for both."""
    ends = edges.select(F.col("from_node").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("to_node").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def next_degree(edges: DataFrame) -> DataFrame:
    """Each road with the number of roads that leave the node it ends at."""
    out = edges.groupBy(F.col("from_node").alias("to_node")).agg(F.count(F.lit(1)).alias("n_next"))
    return edges.select("road_id", "to_node").join(out, "to_node", "left").select("road_id", F.coalesce("n_next", F.lit(0)).alias("n_next"))


def located(positions: DataFrame, segs: DataFrame) -> DataFrame:
    """The segment that each (road_id, to_node) lies on, by half-open ranges of suffix sums, with position and turn so far.

    A position at or beyond the road's start is on the first segment, one at or beyond its end on the last.
    """
    # the next segment's own sum, so that ranges meet without a gap or an overlap of rounding
    low = F.lead("sum_after").over(Window.partitionBy("road_id").orderBy("seg_id"))
    s = segs.select("road_id", "seg_id", "s_lat", "s_lon", "e_lat", "e_lon", "len", "sum_after", "cum_angle", low.alias("_low"))
    p = F.col("to_node")
    on = ((p <= F.col("sum_after")) | (F.col("seg_id") == 0)) & (F.col("_low").isNull() | (p > F.col("_low")))
    ratio = (F.col("sum_after") - p) / F.col("len")
    joined = positions.join(s, "road_id").where(on)
    return joined.select(
        *positions.columns, "seg_id", F.col("cum_angle").alias("turned"),
        (F.col("s_lat") + (F.col("e_lat") - F.col("s_lat")) * ratio).alias("at_lat"),
        (F.col("s_lon") + (F.col("e_lon") - F.col("s_lon")) * ratio).alias("at_lon"),
    )


def project(points: DataFrame, segs: DataFrame, compat: bool = False) -> DataFrame:
    """Each point (road_id, lat, lon) on its known road: nearest segment (the first on a tie), distance and position."""
    keys = points.columns
    every = with_hit(points.join(with_frame(segs.select("road_id", "seg_id", "s_lat", "s_lon", "e_lat", "e_lon", "sum_after"), compat), "road_id"), compat)
    left = F.col("sum_after") - haversine_m("_hit.lat", "_hit.lon", "s_lat", "s_lon")
    best = F.min_by(F.struct("_hit.dist", left.alias("to_node"), "seg_id"), F.struct("_hit.dist", "seg_id"))
    return every.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.dist").alias("err"), F.col("_b.to_node").alias("to_node"), F.col("_b.seg_id").alias("seg_id"))


def renumbered(ids: DataFrame, column: str = "id") -> DataFrame:
    """old, new: dense numbers from 0 by rising id, without gathering the ids in one task.

    Ids are dealt in ranges; a range's first number is the sum of the sizes of those before it. The ranges are stored: bounds come
    from a sample, so sizes and ranks of ranges that were dealt twice would not belong together.
    """
    distinct = ids.select(F.col(column).alias("old")).where("old IS NOT NULL").distinct()
    ranged = stored(distinct.repartitionByRange("old").withColumn("_part", F.spark_partition_id()))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy("old")) - 1
    # the ranges are numbered in order; sizes are one row a partition
    local = ranged.withColumn("_rank", inner)
    sizes = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return local.join(F.broadcast(base), "_part").select("old", (F.col("_base") + F.col("_rank")).cast("long").alias("new"))

