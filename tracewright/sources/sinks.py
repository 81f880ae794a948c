"""Writers of the text formats. Parquet is the format to keep data in; these are for exchange.

A format whose lines have an order over the whole table is written by range-partitioned parts, whose names sort in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import TRIP_COLUMNS


def write_traces(traces: DataFrame, path: str) -> None:
    """``ts lat lon road`` with eight decimals, after each trace a line of minus its number minus 1."""
    body = F.format_string("%d %.8f %.8f %d", "ts", "lat", "lon", "road_id")
    rows = traces.select("traj_id", "seq", body.alias("value"))
    ends = traces.groupBy("traj_id").agg((F.max("seq") + 1).alias("seq")).select("traj_id", "seq", (-F.col("traj_id") - 1).cast("string").alias("value"))
    rows.unionByName(ends).repartitionByRange("traj_id").sortWithinPartitions("traj_id", "seq").select("value").write.text(path)


def write_failures(failures: DataFrame, path: str) -> None:
    """``Failed`` and the terminator for each failed trace; reasons go to a table beside."""
    failures.write.parquet(path.rstrip("/") + "_reasons")
    failures.select("traj_id").distinct().repartitionByRange("traj_id").sortWithinPartitions("traj_id").select(F.concat(F.lit("Failed\n"), (-F.col("traj_id") - 1).cast("string")).alias("value")).write.text(path)


def write_trips(trips: DataFrame, path: str) -> None:
    """The six columns of preprocessed rows, by trace and place, with a header."""
    named = trips.select("traj_id", "seq", *[F.col(a).alias(b) for a, b in zip(("traj_id", "road_id", "to_road", "t", "to_node", "elapsed"), TRIP_COLUMNS, strict=True)])
    named.repartitionByRange("traj_id").sortWithinPartitions("traj_id", "seq").select(*TRIP_COLUMNS).write.option("header", True).csv(path)


VALUES_A_LINE = 100_000


def write_statistics(stats: DataFrame, path: str, a_line: int = VALUES_A_LINE) -> None:
    """``N Secs:`` and its values with one decimal for each interval, in the order of intervals and values.

    Values are dealt in ranges, so no interval is gathered; those of one range make lines of up to ``a_line`` values.
    """
    ranged = stats.select("interval_s", "value").repartitionByRange("interval_s", "value").withColumn("_part", F.spark_partition_id())
    number = F.row_number().over(Window.partitionBy("interval_s", "_part").orderBy("value")) - 1
    chunks = ranged.withColumn("_chunk", F.floor(number / a_line))
    line = F.array_join(F.transform(F.sort_array(F.collect_list("value")), lambda v: F.format_string("%.1f", v)), " ")
    body = chunks.groupBy("interval_s", "_part", "_chunk").agg(line.alias("value"))
    heads = stats.select("interval_s").distinct().select("interval_s", F.lit(-1).alias("_part"), F.lit(-1).cast("long").alias("_chunk"), F.format_string("%d Secs:", "interval_s").alias("value"))
    every = body.unionByName(heads)
    every.repartitionByRange("interval_s", "_part", "_chunk").sortWithinPartitions("interval_s", "_part", "_chunk").select("value").write.text(path)


def write_params(speeds: DataFrame, sigma: DataFrame, path: str) -> None:
    """Mean speeds of the seven levels and the deviation of GPS errors, eight lines."""
    a = speeds.select((F.col("level") + 1).alias("n"), F.format_string("lv%d: %.6f", F.col("level") + 1, F.coalesce("speed", F.lit(0.0))).alias("value"))
    b = sigma.select(F.lit(8).alias("n"), F.format_string("gps_std_error: %.6f", "sigma").alias("value"))
    a.unionByName(b).orderBy("n").select("value").coalesce(1).write.text(path)


def write_sequences(seqs: DataFrame, path: str) -> None:
    """The number of traces, then a line of road ids for each, in the order of traces."""
    body = seqs.select("traj_id", F.array_join(F.col("roads").cast("array<string>"), " ").alias("value"))
    head = seqs.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(-1).cast("long").alias("traj_id"), "value")
    head.unionByName(body).repartitionByRange("traj_id").sortWithinPartitions("traj_id").select("value").write.text(path)


def write_numbers(rows: DataFrame, path: str) -> None:
    """A CSV with a header, seven significant digits."""
    rows.select(*[F.format_string("%.7g", F.col(c).cast("double")).alias(c) for c in rows.columns]).write.option("header", True).csv(path)


def write_distributions(parameters: DataFrame, path: str) -> None:
    """``N Secs limit`` and five numbers with ten decimals for each interval."""
    row = F.format_string("%d Secs %d\n%.10f %.10f %.10f %.10f %.10f", "interval_s", "up_lim", "val0", "sig1", "s1", "sig2", "mu2")
    parameters.orderBy("interval_s").select(row.alias("value")).coalesce(1).write.text(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """The largest id, then a line for every id from 0: the id and its numbers."""
    from ..operators.features import id_range

    head = vectors.select(F.max("road_id").cast("string").alias("value")).select(F.lit(-1).cast("long").alias("road_id"), "value")
    body = id_range(vectors).select("road_id", F.concat_ws(" ", F.col("road_id").cast("string"), F.array_join(F.col("vec").cast("array<string>"), " ")).alias("value"))
    head.unionByName(body).repartitionByRange("road_id").sortWithinPartitions("road_id").select("value").write.text(path)


def write_report(report: DataFrame, path: str) -> None:
    """A line for each measure, four decimals."""
    names = [c for c in report.columns]
    report.select(F.explode(F.array(*[F.format_string(f"{n} = %.4f", F.col(n)) for n in names])).alias("value")).coalesce(1).write.text(path)


def write_keyed(keyed: DataFrame, mapping: DataFrame, path: str) -> None:
    """Lines under their new numbers, in order; ``mapping`` has old, new."""
    rows = keyed.join(mapping, F.col("id") == F.col("old")).select("new", F.concat_ws(" ", F.col("new").cast("string"), "rest").alias("value"))
    rows.repartitionByRange("new").sortWithinPartitions("new").select("value").write.text(path)


def write_features(features: DataFrame, path: str) -> None:
    """GeoJSON features, a line each."""
    features.write.text(path)


def numbered(seqs: DataFrame) -> DataFrame:
    """Traces with dense numbers by their id, for formats that pair traces by line."""
    from ..operators.roadnet import renumbered

    ids = renumbered(seqs.select(F.col("traj_id").alias("id")))
    return seqs.join(ids, F.col("traj_id") == F.col("old")).drop("traj_id", "old").withColumnRenamed("new", "traj_id")


