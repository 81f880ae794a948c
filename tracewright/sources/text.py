"""Readers of the text formats: maps, traces, statistics, parameters, vectors, tables of numbers.

Lines are numbered by their place, so rows that belong together (a trace and its end, a header and its values) are found by
windows over parts of a file and the counts of the parts before; no reader gathers a file in one task. The files of a folder
follow each other by name, numbers in it by value.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"\s+"
VECTOR = 16


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (rising, not dense: file, begin of its part, place in the task) and value, of lines that aren't blank.

    Spark deals files to tasks by size, so places in tasks alone would not follow the order of the files.
    """
    read = spark.read.text(path)
    files = sorted(read.inputFiles(), key=lambda f: [int(x) if i % 2 else x for i, x in enumerate(re.split(r"([0-9]+)", f))])
    ranks = spark.createDataFrame(list(enumerate(files)), "_file int, _path string")
    placed = read.select("value", F.input_file_name().alias("_path"), F.input_file_block_start().alias("_start"), F.monotonically_increasing_id().alias("_line"))
    rank = F.coalesce("_file", F.raise_error(F.lit("a file that was not there before")).cast("int")).alias("file")
    place = F.struct(rank, F.col("_start").alias("start"), F.col("_line").alias("line"))
    return placed.join(F.broadcast(ranks), "_path", "left").select("value", place.alias("line_no")).where(F.trim("value") != "")


def tokens(value: str | Column = "value") -> Column:
    return F.split(F.trim(F.col(value) if isinstance(value, str) else value), SPACE)


def running(rows: DataFrame, flag: Column, name: str, before: bool = False) -> DataFrame:
    """Adds the number of flagged rows up to each line (or before it), in line order, by parts of the file."""
    part = F.struct("line_no.file", "line_no.start")
    frame = Window.partitionBy("_part").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    rows = rows.withColumn("_part", part).withColumn("_f", flag.cast("long"))
    counts = rows.groupBy("_part").agg(F.sum("_f").alias("_n"))
    base = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    local = rows.withColumn(name, F.coalesce(F.sum("_f").over(frame), F.lit(0)))
    return local.join(base, "_part").withColumn(name, F.col("_base") + F.col(name)).drop("_part", "_f", "_base")


def read_edges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges (road_id, from_node, to_node, n) and points (road_id, pos, lat, lon) of ``id from to n lat lon ...``; roads of one point are skipped."""
    t = tokens()
    rows = spark.read.text(path).where(F.trim("value") != "").select(t.alias("t")).select(F.get("t", 0).cast("int").alias("road_id"), F.get("t", 1).cast("int").alias("from_node"), F.get("t", 2).cast("int").alias("to_node"), F.get("t", 3).cast("int").alias("n"), F.slice("t", 5, F.size("t")).alias("c")).where("n > 1")
    pts = rows.select("road_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.get("c", i * 2).cast("double").alias("lat"), F.get("c", i * 2 + 1).cast("double").alias("lon")))).alias("pos", "p"))
    return rows.drop("c"), pts.select("road_id", "pos", "p.lat", "p.lon")


def read_types(spark: SparkSession, path: str, clamp: bool = True) -> DataFrame:
    """road_id, type_name, level of ``id name type`` with types 1..7; with ``clamp`` others are level 0."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(tokens().alias("t")).select(F.get("t", 0).cast("int").alias("road_id"), F.get("t", 1).alias("type_name"), F.element_at("t", -1).cast("int").alias("type"))
    level = F.when(F.col("type").between(1, 7), F.col("type") - 1).otherwise(0) if clamp else F.col("type") - 1
    return rows.select("road_id", "type_name", "type", level.cast("int").alias("level"))


def read_traces(spark: SparkSession, path: str, interval: int | None = None, labelled: bool = False) -> tuple[DataFrame, DataFrame]:
    """Traces (traj_id, seq, ts, lat, lon, road_id) and failures (traj_id, reason).

    Rows are ``ts lat lon [road]``; a row whose first value is below 1 ends a trace. A line ``Failed`` makes its trace a failure.
    With ``interval``, traces of another step fail; with ``labelled``, rows without a road do too. Empty traces vanish, their number stays.
    """
    raw = lines(spark, path).select("line_no", tokens().alias("t")).withColumn("_ts", F.expr("try_cast(get(t, 0) AS BIGINT)"))
    rows = running(raw, F.coalesce(F.col("_ts") < 1, F.lit(False)), "traj_id", before=True)
    failed = rows.where("get(t, 0) = 'Failed'").select("traj_id", F.lit("failed").alias("reason"))
    own = rows.where("_ts >= 1").select("traj_id", "line_no", F.col("_ts").alias("ts"), F.get("t", 1).cast("double").alias("lat"), F.get("t", 2).cast("double").alias("lon"), F.expr("try_cast(get(t, 3) AS BIGINT)").alias("road_id"))
    w = Window.partitionBy("traj_id").orderBy("line_no")
    own = own.withColumn("seq", (F.row_number().over(w) - 1).cast("int")).withColumn("_step", F.abs(F.col("ts") - F.lag("ts").over(w)))
    bad = F.lit(False)
    if interval is not None:
        bad = bad | F.coalesce(F.col("_step") != interval, F.lit(False))
    if labelled:
        bad = bad | F.col("road_id").isNull()
    uneven = own.groupBy("traj_id").agg(F.bool_or(bad).alias("bad")).where("bad").select("traj_id", F.lit("uneven or unlabelled").alias("reason"))
    failures = failed.unionByName(uneven)
    return own.select("traj_id", "seq", "ts", "lat", "lon", "road_id").join(failures.select("traj_id").distinct(), "traj_id", "left_anti"), failures


def read_numbers(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV of numbers with a header; names and fields may have white space around."""
    schema = T.StructType([T.StructField(c.strip(), T.DoubleType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("enforceSchema", True).csv(path)


TRIP_COLUMNS = ["trajID", "originID", "transitionID", "timestamp", "toNode", "elapsed"]


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    """Preprocessed rows as trips; a row with a negative field is dropped, elapsed loses its fraction for lights only (see there)."""
    rows = lines(spark, path).select("line_no", F.split("value", ",").alias("t"))
    n = [F.expr(f"try_cast(trim(get(t, {i})) AS DOUBLE)") for i in range(6)]
    named = rows.select("line_no", *[c.alias(x) for c, x in zip(n, TRIP_COLUMNS, strict=True)])
    kept = named.where(" AND ".join(f"{x} >= 0" for x in TRIP_COLUMNS))
    seq = F.row_number().over(Window.partitionBy("trajID").orderBy("line_no")) - 1
    return kept.select(F.col("trajID").cast("long").alias("traj_id"), seq.cast("int").alias("seq"), F.col("originID").cast("long").alias("road_id"), F.col("transitionID").cast("long").alias("to_road"), F.col("timestamp").alias("t"), F.col("toNode").alias("to_node"), "elapsed")


def read_vectors(spark: SparkSession, path: str, single: bool = False) -> DataFrame:
    """road_id and its 16 numbers; the first line (the largest id) has no numbers and is skipped."""
    kind = "array<float>" if single else "array<double>"
    rows = spark.read.text(path).select(tokens().alias("t")).where(F.size("t") > 1)
    return rows.select(F.get("t", 0).cast("int").alias("road_id"), F.slice("t", 2, VECTOR).cast(kind).alias("vec"))


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """name, value of ``name: value`` lines: speeds lv1..lv7 and gps_std_error."""
    return spark.read.text(path).where(F.col("value").contains(":")).select(F.trim(F.split_part("value", F.lit(":"), F.lit(1))).alias("name"), F.trim(F.split_part("value", F.lit(":"), F.lit(2))).cast("double").alias("value"))


def level_speeds(params: DataFrame) -> DataFrame:
    """level (0..6), speed."""
    return params.where(F.col("name").rlike("^lv[1-7]$")).select((F.substring("name", 3, 1).cast("int") - 1).alias("level"), F.col("value").alias("speed"))


def gps_sigma(params: DataFrame) -> DataFrame:
    return params.where("name = 'gps_std_error'").select(F.col("value").alias("sigma"))


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """interval_s, value of lines ``N Secs:`` each followed by a line of values."""
    raw = lines(spark, path).withColumn("head", F.col("value").contains("Secs"))
    numbered = running(raw, F.col("head"), "block")
    heads = numbered.where("head").select("block", F.get(tokens(), 0).cast("int").alias("interval_s"))
    values = numbered.where("NOT head").select("block", F.explode(tokens()).alias("v"))
    return values.join(heads, "block").select("interval_s", F.col("v").cast("double").alias("value"))


def read_distributions(spark: SparkSession, path: str) -> DataFrame:
    """interval_s, up_lim, val0, sig1, s1, sig2, mu2 of lines ``N Secs limit`` each followed by five numbers."""
    raw = lines(spark, path).withColumn("head", F.col("value").contains("Secs"))
    numbered = running(raw, F.col("head"), "block").withColumn("t", tokens())
    heads = numbered.where("head").select("block", F.get("t", 0).cast("int").alias("interval_s"), F.get("t", 2).cast("long").alias("up_lim"))
    names = ("val0", "sig1", "s1", "sig2", "mu2")
    values = numbered.where("NOT head").select("block", *[F.get("t", i).cast("double").alias(n) for i, n in enumerate(names)])
    return heads.join(values, "block").drop("block")


def read_sequences(spark: SparkSession, path: str, collapse: bool = False) -> DataFrame:
    """traj_id, roads of a count line and then a line of road ids for each trace; ``collapse`` drops repeats of neighbours."""
    from ..operators.rating import without_repeats

    raw = lines(spark, path).where(F.trim("value").rlike("^[0-9]"))
    rows = running(raw, F.lit(True), "n").where("n > 1").select((F.col("n") - 2).alias("traj_id"), tokens().cast("array<long>").alias("roads"))
    return rows.withColumn("roads", without_repeats(F.col("roads"))) if collapse else rows


def read_matrix(spark: SparkSession, path: str, columns: list[str], target: str = "vel") -> DataFrame:
    """x (all columns but the target) and y."""
    rows = read_numbers(spark, path, columns)
    return rows.select(F.array(*[c for c in columns if c != target]).alias("x"), F.col(target).alias("y"))


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """id and the rest of its line; of lines that repeat an id the last counts."""
    rows = lines(spark, path).select("line_no", tokens().alias("t"), F.trim("value").alias("v"))
    keyed = rows.select("line_no", F.get("t", 0).cast("long").alias("id"), F.trim(F.regexp_replace("v", r"^\S+", "")).alias("rest"))
    return keyed.groupBy("id").agg(F.max_by("rest", "line_no").alias("rest"))


def read_plot_traces(spark: SparkSession, path: str, most_lines: int = 2_000_000) -> DataFrame:
    """Traces for plotting: of the first ``most_lines`` lines of a file, up to the end of the last trace begun in them; failed traces are left out.

    Lines are counted by parts of the file and the counts before them, so the file is neither sorted nor gathered.
    """
    raw = lines(spark, path).select("line_no", tokens().alias("t")).withColumn("_ts", F.expr("try_cast(get(t, 0) AS BIGINT)"))
    placed = running(running(raw, F.coalesce(F.col("_ts") < 1, F.lit(False)), "traj_id", before=True), F.lit(True), "n")
    last = placed.where(F.col("n") <= most_lines).agg(F.max("traj_id").alias("last")).first()["last"]
    own, _ = read_traces(spark, path)
    return own.where(F.col("traj_id") <= F.lit(-1 if last is None else last))
