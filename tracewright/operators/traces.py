"""Traces: pairs of rows, interval checks, gaps, run collapse and trailing sums, all as windows over one trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m

INTERVAL_S = 15
MAX_GAP_S = 4096
MAX_GAPS = 24
SPEED_RANGE = (-2.0, 40.0)


def trace():
    """The window over a trace in its order."""
    return Window.partitionBy("traj_id").orderBy("seq")


def segment_speeds(traces: DataFrame) -> DataFrame:
    """Speed between each row and the one before: traj_id, seq, dist, elapsed, speed; accepted speeds only."""
    pairs = traces.select("traj_id", "seq", "ts", "lat", "lon", F.lag(F.struct("ts", "lat", "lon")).over(trace()).alias("p")).where("p IS NOT NULL")
    d = pairs.select("traj_id", "seq", haversine_m("p.lat", "p.lon", "lat", "lon").alias("dist"), (F.col("ts") - F.col("p.ts")).alias("elapsed"))
    return d.withColumn("speed", F.try_divide("dist", "elapsed")).where(F.col("speed").between(*SPEED_RANGE))


def trip_speeds(traces: DataFrame) -> DataFrame:
    """Totals of the accepted pairs by trace."""
    return segment_speeds(traces).groupBy("traj_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.sum("dist"), 4).alias("dist_m"), F.round(F.avg("speed"), 6).alias("avg_speed"))


def constant_interval(traces: DataFrame, seconds: int = INTERVAL_S) -> DataFrame:
    """The rows of traces whose neighbours are all ``seconds`` apart."""
    step = F.abs(F.col("ts") - F.lag("ts").over(trace()))
    good = traces.select("traj_id", step.alias("step")).groupBy("traj_id").agg(F.bool_and(F.col("step").isNull() | (F.col("step") == seconds)).alias("ok")).where("ok")
    return traces.join(good.select("traj_id"), "traj_id", "left_semi")


def gap_failures(traces: DataFrame, limit: int = MAX_GAP_S) -> DataFrame:
    """Traces with a gap of ``limit`` seconds or more: traj_id, first position after it, reason."""
    gap = F.col("ts") - F.lag("ts").over(trace())
    return traces.select("traj_id", "seq", gap.alias("gap")).where(F.col("gap") >= limit).groupBy("traj_id").agg(F.min("seq").alias("seq")).withColumn("reason", F.lit("gap too long"))


def missing_candidates(points: DataFrame, found: DataFrame) -> DataFrame:
    """Traces that have a position without a candidate road: traj_id, first such position, reason."""
    bare = points.select("traj_id", "seq").join(found.select("traj_id", "seq"), ["traj_id", "seq"], "left_anti")
    return bare.groupBy("traj_id").agg(F.min("seq").alias("seq")).withColumn("reason", F.lit("no road near"))


def without(traces: DataFrame, *failures: DataFrame) -> DataFrame:
    """Traces that no failure names."""
    for f in failures:
        traces = traces.join(f.select("traj_id").distinct(), "traj_id", "left_anti")
    return traces


def collapsed(rows: DataFrame, road: str = "road_id") -> DataFrame:
    """Rows where the road changes, renumbered: traj_id, n, road."""
    changed = rows.withColumn("_b", F.lag(road).over(trace())).where(F.col("_b").isNull() | (F.col("_b") != F.col(road)))
    return changed.select("traj_id", (F.row_number().over(trace()) - 1).alias("n"), road)


def next_distinct(rows: DataFrame, road: str = "road_id") -> DataFrame:
    """Adds to_road: the next other road of the trace, the same road at its end."""
    nxt = F.lead(road).over(trace())
    marked = rows.withColumn("_n", F.when(nxt != F.col(road), nxt))
    ahead = F.first("_n", ignorenulls=True).over(trace().rowsBetween(0, Window.unboundedFollowing))
    return marked.withColumn("to_road", F.coalesce(ahead, F.col(road))).drop("_n")


def paced(path: DataFrame) -> DataFrame:
    """Times in proportion to distance inside a gap.

    ``path`` has traj_id, gap, n, passed (metres since the node before), t0, t1 (the gap's ends); adds t.
    """
    w = Window.partitionBy("traj_id", "gap").orderBy("n")
    done = F.sum("passed").over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("passed").over(Window.partitionBy("traj_id", "gap"))
    return path.withColumn("t", F.col("t0") + F.coalesce(F.try_divide(done, total), F.lit(0.0)) * (F.col("t1") - F.col("t0")))


def trailing(steps: DataFrame, gaps: int = MAX_GAPS) -> DataFrame:
    """For each row and each number k of steps up to it: traj_id, seq, k, turned and detour over the last k steps.

    ``steps`` has traj_id, seq, angle, length (of the step to this row), lat, lon. One window pass: running sums are kept and
    the k-th earlier row comes from a lagged array, so nothing is joined.
    """
    so_far = trace().rowsBetween(Window.unboundedPreceding, 0)
    sums = steps.select("traj_id", "seq", "lat", "lon", F.sum("angle").over(so_far).alias("a"), F.sum("length").over(so_far).alias("l"))
    earlier = F.collect_list(F.struct("a", "l", "lat", "lon")).over(trace().rowsBetween(-gaps, -1))
    held = sums.select("*", F.reverse(earlier).alias("_e"))
    every = held.select("traj_id", "seq", "lat", "lon", "a", "l", F.posexplode("_e").alias("k0", "e"))
    detour = F.col("l") - F.col("e.l") - haversine_m("lat", "lon", "e.lat", "e.lon")
    return every.select("traj_id", "seq", (F.col("k0") + 1).alias("k"), (F.col("a") - F.col("e.a")).alias("turned"), detour.alias("detour"))


def level_speeds(steps: DataFrame) -> DataFrame:
    """Mean speed of every level: sums of length over sums of time; all seven levels, null where nothing drove.

    ``steps`` has level, length, elapsed.
    """
    spark = steps.sparkSession
    sums = steps.groupBy("level").agg(F.sum("length").alias("length_m"), F.sum("elapsed").alias("time_s"))
    return spark.range(7).select(F.col("id").cast("int").alias("level")).join(sums, "level", "left").withColumn("speed", F.try_divide("length_m", "time_s"))


def gps_sigma(errors: DataFrame, column: str = "err") -> DataFrame:
    """Mean and population deviation of GPS errors."""
    return errors.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("sigma"))
