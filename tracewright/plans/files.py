"""Queries of the text formats as round trips: what is written from the fixture tables is read back, and must be what SQL says of the tables.

A reader's query writes plain lines and reads them by the reader; a writer's query writes by the writer and reads plain lines.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import ctes, read, view
from ..operators import plot, rating, roadnet, speed_model
from ..session import shared_folder
from ..sources import sinks, text

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def place(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def lines_of(rows: DataFrame, *order: str) -> str:
    """Writes the column ``value`` in the order of others, by ranges; gives the folder."""
    path = place(rows.sparkSession)
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)
    return path


def back(spark, path: str) -> DataFrame:
    return spark.read.text(path).where("value <> ''")


# ---- maps ---------------------------------------------------------------------------------------------------------


def edge_lines(spark, d) -> str:
    """``id from to n lat lon ...`` of the fixture network; every seventh road has one point only."""
    pts = F.array_sort(F.collect_list(F.struct("pos", F.format_string("%.8f %.8f", "lat", "lon").alias("p"))))
    pts = view(spark, d, "points").where("road_id % 7 <> 0 OR pos = 0").groupBy("road_id").agg(F.count(F.lit(1)).alias("n"), F.transform(pts, lambda x: x["p"]).alias("p"))
    rows = view(spark, d, "edges").drop("n").join(pts, "road_id")
    return lines_of(rows.select("road_id", F.format_string(" %d %d  %d %d %s ", "road_id", "from_node", "to_node", "n", F.array_join("p", " ")).alias("value")), "road_id")


_points8 = ctes("points", "edges") + ", pts AS (SELECT road_id, pos, round(lat, 8) AS lat, round(lon, 8) AS lon FROM points WHERE road_id % 7 <> 0)"


@query(_points8 + " SELECT p.road_id, from_node, to_node, CAST(pos AS BIGINT) AS pos, round(lat, 6) AS lat, round(lon, 6) AS lon FROM pts p JOIN edges e ON p.road_id = e.road_id")
def src1_edges(spark, d):
    edges, pts = text.read_edges(spark, edge_lines(spark, d))
    return pts.join(edges, "road_id").select(*[F.col(c).cast("long").alias(c) for c in ("road_id", "from_node", "to_node", "pos")], F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def type_lines(spark, d) -> str:
    rows = view(spark, d, "edges").where("road_id % 11 <> 0")
    return lines_of(rows.select("road_id", F.format_string("%d kind%d %d", "road_id", F.col("road_id") % 9, F.col("road_id") % 9).alias("value")), "road_id")


@query(ctes("edges") + " SELECT road_id, 'kind' || (road_id % 9) AS type_name, road_id % 9 - 1 AS level FROM edges WHERE road_id % 11 <> 0")
def src2_types(spark, d):
    return text.read_types(spark, type_lines(spark, d), clamp=False).select(F.col("road_id").cast("long").alias("road_id"), "type_name", F.col("level").cast("long").alias("level"))


@query(ctes("edges") + " SELECT road_id, CASE WHEN road_id % 9 BETWEEN 1 AND 7 THEN road_id % 9 - 1 ELSE 0 END AS level FROM edges WHERE road_id % 11 <> 0")
def src14_clamped_types(spark, d):
    return text.read_types(spark, type_lines(spark, d)).select(F.col("road_id").cast("long").alias("road_id"), F.col("level").cast("long").alias("level"))


@query(_points8 + ", e AS (SELECT * FROM edges WHERE road_id % 7 <> 0) SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT from_node AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT to_node, 1, 0 FROM e) AS x GROUP BY node")
def src13_degrees(spark, d):
    edges, _ = text.read_edges(spark, edge_lines(spark, d))
    return roadnet.degrees(edges.withColumn("from_node", F.col("from_node").cast("long")).withColumn("to_node", F.col("to_node").cast("long")))


@query(ctes("edges") + " SELECT road_id AS id, 'b ' || from_node AS rest FROM edges")
def src19_renumber_inputs(spark, d):
    """Every id has two lines; the later counts."""
    e = view(spark, d, "edges").select("road_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("k"), "from_node")
    return text.read_keyed(spark, lines_of(e.select("k", "road_id", F.format_string("%d %s %d", "road_id", "k", "from_node").alias("value")), "k", "road_id"))


@query(_points8 + " SELECT road_id, count(*) AS n, round(sum(lat), 4) AS lat, round(sum(lon), 4) AS lon FROM pts GROUP BY road_id")
def src20_map_for_plots(spark, d):
    _, pts = text.read_edges(spark, edge_lines(spark, d))
    return pts.groupBy(F.col("road_id").cast("long").alias("road_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("lat"), 4).alias("lat"), F.round(F.sum("lon"), 4).alias("lon"))


# ---- traces -------------------------------------------------------------------------------------------------------


def placed_traces(spark, d) -> DataFrame:
    return view(spark, d, "traces").join(view(spark, d, "placed").select("traj_id", "seq", "road_id"), ["traj_id", "seq"])


def trace_lines(spark, d, failing: bool = False) -> str:
    """Traces as text; with ``failing``, every fifth is a line that says so."""
    t = placed_traces(spark, d)
    body = t.select("traj_id", "seq", F.format_string("%d %.8f %.8f %d", "ts", "lat", "lon", "road_id").alias("value"))
    if failing:
        body = body.where("traj_id % 5 <> 4 OR seq = 0").withColumn("value", F.when(F.col("traj_id") % 5 == 4, "Failed").otherwise(F.col("value")))
    ends = t.groupBy("traj_id").agg((F.max("seq") + 1).alias("seq")).select("traj_id", "seq", (-F.col("traj_id") - 1).cast("string").alias("value"))
    return lines_of(body.unionByName(ends), "traj_id", "seq")


_nth = ctes("traces", "placed") + ", ids AS (SELECT traj_id, row_number() OVER (ORDER BY traj_id) - 1 AS n FROM (SELECT DISTINCT traj_id FROM traces) AS t)"
_trace_rows = " SELECT n AS traj_id, CAST(t.seq AS BIGINT) AS seq, t.ts, round(lat, 6) AS lat, round(lon, 6) AS lon, road_id FROM traces t JOIN ids USING (traj_id) JOIN placed p ON p.traj_id = t.traj_id AND p.seq = t.seq"


def _trace_columns(t: DataFrame) -> DataFrame:
    return t.select("traj_id", F.col("seq").cast("long").alias("seq"), "ts", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "road_id")


@query(_nth + _trace_rows + " WHERE t.traj_id % 5 <> 4")
def src3_traces(spark, d):
    return _trace_columns(text.read_traces(spark, trace_lines(spark, d, failing=True))[0])


@query(_nth + _trace_rows)
def src4_labelled_traces(spark, d):
    return _trace_columns(text.read_traces(spark, trace_lines(spark, d), interval=15, labelled=True)[0])


@query(_nth + ", c AS (SELECT traj_id, count(*) + 1 AS lines FROM traces GROUP BY traj_id), r AS (SELECT traj_id, sum(lines) OVER (ORDER BY traj_id) - lines AS before FROM c)" + _trace_rows + " JOIN r ON r.traj_id = t.traj_id WHERE before < 300")
def src21_plot_traces(spark, d):
    """The traces that begin in the first 300 lines."""
    return _trace_columns(text.read_plot_traces(spark, trace_lines(spark, d), 300))


@query(ctes("traces", "placed") + " SELECT printf('%d %.8f %.8f %d', t.ts, lat, lon, road_id) AS value FROM traces t JOIN placed p ON p.traj_id = t.traj_id AND p.seq = t.seq UNION ALL SELECT CAST(-traj_id - 1 AS VARCHAR) FROM (SELECT DISTINCT traj_id FROM traces) AS t")
def snk1_traces(spark, d):
    path = place(spark)
    sinks.write_traces(placed_traces(spark, d), path)
    return back(spark, path)


@query(ctes("traces") + " SELECT unnest(['Failed', CAST(-traj_id - 1 AS VARCHAR)]) AS value FROM (SELECT DISTINCT traj_id FROM traces WHERE traj_id % 3 = 1) AS t")
def snk11_failures(spark, d):
    path = place(spark)
    sinks.write_failures(view(spark, d, "traces").where("traj_id % 3 = 1").select("traj_id", F.lit("no road near").alias("reason")).distinct(), path)
    return back(spark, path)


# ---- trips and tables of numbers ----------------------------------------------------------------------------------

_trip = ctes("trips") + " SELECT traj_id, road_id, to_road, round(t, 3) AS t, round(to_node, 3) AS to_node, elapsed FROM trips"


def trip_folder(spark, d) -> str:
    path = place(spark)
    sinks.write_trips(view(spark, d, "trips"), path)
    return path


@query(_trip)
def snk2_trips(spark, d):
    rows = text.read_numbers(spark, trip_folder(spark, d), text.TRIP_COLUMNS)
    a, b, c, t, left, e = text.TRIP_COLUMNS
    return rows.select(*[F.col(x).cast("long").alias(y) for x, y in ((a, "traj_id"), (b, "road_id"), (c, "to_road"))], F.round(t, 3).alias("t"), F.round(left, 3).alias("to_node"), F.col(e).alias("elapsed"))


@query(_trip + " WHERE to_node >= 0")
def src6_trips(spark, d):
    rows = text.read_trips(spark, trip_folder(spark, d))
    return rows.select("traj_id", "road_id", "to_road", F.round("t", 3).alias("t"), F.round("to_node", 3).alias("to_node"), "elapsed")


_NUMBERS = ["event", "value", "half"]


def number_lines(spark, d) -> str:
    e = read(spark, d, "events").select(F.col("event_id").alias("k"), F.format_string(" %d , %.4f ,%.1f", "event_id", "value", F.col("event_id") / 2).alias("value"))
    head = spark.createDataFrame([(-1, " event , value ,half")], "k long, value string")
    path = place(spark)
    e.unionByName(head).repartition(1).sortWithinPartitions("k").select("value").write.text(path)
    return path


@query("SELECT CAST(event_id AS DOUBLE) AS event, round(value, 3) AS value, event_id / 2.0E0 AS half FROM events")
def src5_numbers(spark, d):
    return text.read_numbers(spark, number_lines(spark, d), _NUMBERS).withColumn("value", F.round("value", 3))


@query("SELECT round(CAST(event_id AS DOUBLE) + event_id / 2.0E0, 3) AS x, round(value, 3) AS y FROM events")
def src17_matrix(spark, d):
    rows = text.read_matrix(spark, number_lines(spark, d), _NUMBERS, target="value")
    return rows.select(F.round(F.get("x", 0) + F.get("x", 1), 3).alias("x"), F.round("y", 3).alias("y"))


@query("SELECT CAST(event_id AS DOUBLE) AS event, CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE event_id < 1000000")
def snk6_numbers(spark, d):
    path = place(spark)
    sinks.write_numbers(read(spark, d, "events").where("event_id < 1000000").select("event_id", "value"), path)
    return text.read_numbers(spark, path, ["event_id", "value"]).select(F.col("event_id").alias("event"), F.round(F.col("value") * 100).cast("long").alias("cents"))


# ---- vectors, sequences, models -----------------------------------------------------------------------------------


def road_vectors(spark, d) -> DataFrame:
    vec = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: (F.col("road_id") * i % 13) / F.lit(4.0))
    return view(spark, d, "edges").where("road_id % 3 <> 1").select(F.col("road_id").cast("int").alias("road_id"), vec.alias("vec"))


def vector_folder(spark, d) -> str:
    path = place(spark)
    sinks.write_vectors(road_vectors(spark, d), path)
    return path


_vectors = ctes("edges") + ", v AS (SELECT road_id FROM edges WHERE road_id % 3 <> 1), ids AS (SELECT unnest(range((SELECT max(road_id) + 1 FROM v))) AS i) SELECT i AS road_id, CASE WHEN v.road_id IS NULL THEN 0 ELSE (i * 2 % 13) / 4.0E0 END AS second, CASE WHEN v.road_id IS NULL THEN 0 ELSE (i * 16 % 13) / 4.0E0 END AS last FROM ids LEFT JOIN v ON i = v.road_id"


@query(_vectors)
def src7_vectors(spark, d):
    rows = text.read_vectors(spark, vector_folder(spark, d))
    return rows.select(F.col("road_id").cast("long").alias("road_id"), F.get("vec", 1).alias("second"), F.get("vec", 15).alias("last"))


@query(_vectors)
def src8_single_vectors(spark, d):
    rows = text.read_vectors(spark, vector_folder(spark, d), single=True)
    return rows.select(F.col("road_id").cast("long").alias("road_id"), F.get("vec", 1).cast("double").alias("second"), F.get("vec", 15).cast("double").alias("last"))


@query(ctes("edges") + ", v AS (SELECT max(road_id) AS m FROM edges WHERE road_id % 3 <> 1) SELECT n_words, count(*) AS n FROM (SELECT 17 AS n_words FROM (SELECT unnest(range(m + 1)) FROM v) AS r UNION ALL SELECT 1) AS x GROUP BY n_words")
def snk8_vectors(spark, d):
    return back(spark, vector_folder(spark, d)).groupBy(F.size(F.split("value", " ")).alias("n_words")).agg(F.count(F.lit(1)).alias("n"))


def road_sequences(spark, d) -> DataFrame:
    rows = view(spark, d, "placed").groupBy("traj_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "road_id"))), lambda x: x["road_id"]).alias("roads"))
    return sinks.numbered(rows).select("traj_id", "roads")


def sequence_folder(spark, d) -> str:
    path = place(spark)
    sinks.write_sequences(road_sequences(spark, d), path)
    return path


_sequence = _nth + ", s AS (SELECT n AS traj_id, seq, road_id, lag(road_id) OVER (PARTITION BY n ORDER BY seq) AS b FROM placed JOIN ids USING (traj_id)) SELECT traj_id, string_agg(road_id::VARCHAR, ' ' ORDER BY seq) AS roads FROM s"


def _joined(rows: DataFrame) -> DataFrame:
    return rows.select("traj_id", F.array_join(F.col("roads").cast("array<string>"), " ").alias("roads"))


@query(_sequence + " GROUP BY traj_id")
def src15_sequences(spark, d):
    return _joined(text.read_sequences(spark, sequence_folder(spark, d)))


@query(_sequence + " WHERE b IS NULL OR b <> road_id GROUP BY traj_id")
def src16_collapsed_sequences(spark, d):
    return _joined(text.read_sequences(spark, sequence_folder(spark, d), collapse=True))


@query(_sequence.replace("SELECT traj_id, string_agg", "SELECT string_agg").replace(" AS roads FROM s", " AS value FROM s") + " GROUP BY traj_id UNION ALL SELECT CAST(count(DISTINCT traj_id) AS VARCHAR) FROM placed")
def snk5_sequences(spark, d):
    return back(spark, sequence_folder(spark, d))


def _model() -> speed_model.Perceptron:
    return speed_model.Perceptron(2, (4, 3), seed=1)


def _weights(m: speed_model.Perceptron) -> list[tuple[int, float]]:
    return [(i, round(float(v), 9)) for i, v in enumerate(np.concatenate([m.flat(), m.mean, m.scale]))]


_weight_rows = ", ".join(f"({i}, {v!r}::DOUBLE)" for i, v in _weights(_model()))


@query(f"SELECT CAST(place AS BIGINT) AS place, weight FROM (VALUES {_weight_rows}) AS w(place, weight)")
def snk9_save_model(spark, d):
    """The stored arrays of a model of fixed weights, as they lie in the file."""
    path = place(spark)
    speed_model.save(spark, _model(), path)
    row = spark.read.parquet(path).select(F.posexplode(F.concat("flat", "mean", "scale")).alias("place", "weight"))
    return row.select(F.col("place").cast("long").alias("place"), F.round("weight", 9).alias("weight"))


@query(f"SELECT CAST(place AS BIGINT) AS place, weight FROM (VALUES {_weight_rows}) AS w(place, weight)")
def src18_load_model(spark, d):
    path = place(spark)
    speed_model.save(spark, _model(), path)
    return spark.createDataFrame(_weights(speed_model.load(spark, path)), "place long, weight double")


# ---- statistics and parameters ------------------------------------------------------------------------------------


def given_params(spark, d) -> DataFrame:
    return view(spark, d, "edges").where("level < 6").groupBy("level").agg(F.round(F.avg(F.col("road_id") % 10), 4).alias("speed"))


def param_folder(spark, d) -> str:
    path = place(spark)
    every = spark.range(7).select(F.col("id").cast("int").alias("level")).join(given_params(spark, d), "level", "left")
    sinks.write_params(every, spark.range(1).select(F.lit(4.07).alias("sigma")), path)
    return path


_speeds = ctes("edges") + ", s AS (SELECT level, round(avg(road_id % 10), 4) AS speed FROM edges WHERE level < 6 GROUP BY level), every AS (SELECT i AS level, coalesce(speed, 0) AS speed FROM (SELECT unnest(range(7)) AS i) AS r LEFT JOIN s ON s.level = i)"


@query(_speeds + " SELECT CAST(level AS BIGINT) AS level, round(speed, 4) AS speed FROM every")
def src9_level_speeds(spark, d):
    return text.level_speeds(text.read_params(spark, param_folder(spark, d))).select(F.col("level").cast("long").alias("level"), F.round("speed", 4).alias("speed"))


@query("SELECT 4.07E0 AS sigma")
def src10_gps_sigma(spark, d):
    return text.gps_sigma(text.read_params(spark, param_folder(spark, d)))


@query(_speeds + " SELECT printf('lv%d: %.6f', level + 1, speed) AS value FROM every UNION ALL SELECT 'gps_std_error: 4.070000'")
def snk4_params(spark, d):
    return back(spark, param_folder(spark, d))


def given_statistics(spark, d) -> DataFrame:
    return read(spark, d, "lineitem").select((F.lit(30) + 15 * (F.col("l_linenumber") % 5)).cast("int").alias("interval_s"), F.col("l_quantity").cast("double").alias("value"))


def statistics_folder(spark, d) -> str:
    path = place(spark)
    sinks.write_statistics(given_statistics(spark, d), path, a_line=1000)
    return path


_statistics = "SELECT CAST(30 + 15 * (l_linenumber % 5) AS BIGINT) AS interval_s, CAST(l_quantity AS DOUBLE) AS value, count(*) AS n FROM lineitem GROUP BY ALL"


@query(_statistics)
def src11_statistics(spark, d):
    rows = text.read_statistics(spark, statistics_folder(spark, d))
    return rows.groupBy(F.col("interval_s").cast("long").alias("interval_s"), "value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT word, count(*) AS n FROM (SELECT printf('%.1f', l_quantity) AS word FROM lineitem UNION ALL SELECT unnest([CAST(30 + 15 * k AS VARCHAR), 'Secs:']) FROM (SELECT DISTINCT l_linenumber % 5 AS k FROM lineitem) AS i) AS w GROUP BY word")
def snk3_statistics(spark, d):
    return back(spark, statistics_folder(spark, d)).select(F.explode(F.split("value", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


_PAR = "SELECT CAST(30 + 15 * i AS INT) AS interval_s, CAST(40 + i AS BIGINT) AS up_lim, 0.05E0 + 0.01E0 * i AS val0, 3.0E0 + i AS sig1, 0.4E0 AS s1, 5.0E0 + i AS sig2, 8.0E0 + i AS mu2"


def distribution_folder(spark) -> str:
    path = place(spark)
    sinks.write_distributions(spark.sql(_PAR + " FROM (SELECT id AS i FROM range(24)) AS r"), path)
    return path


_from = " FROM (SELECT unnest(range(24)) AS i) AS r"


@query(f"SELECT CAST(interval_s AS BIGINT) AS interval_s, up_lim, round(val0, 6) AS val0, sig1, s1, sig2, mu2 FROM ({_PAR}{_from}) AS p")
def src12_distributions(spark, d):
    return text.read_distributions(spark, distribution_folder(spark)).withColumn("interval_s", F.col("interval_s").cast("long")).withColumn("val0", F.round("val0", 6))


@query(f"SELECT unnest([printf('%d Secs %d', interval_s, up_lim), printf('%.10f %.10f %.10f %.10f %.10f', val0, sig1, s1, sig2, mu2)]) AS value FROM ({_PAR}{_from}) AS p")
def snk7_distributions(spark, d):
    return back(spark, distribution_folder(spark))


# ---- reports, maps ------------------------------------------------------------------------------------------------


def given_report(spark, d):
    """Errors, distances along roads and sequence scores of a trace for each order, from its lines."""
    t = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("traj_id"))
    errors = t.agg(F.avg("l_quantity").alias("mae"), F.sqrt(F.avg(F.col("l_quantity") * F.col("l_quantity"))).alias("rmse"), F.avg(F.when(F.col("l_linenumber") % 2 == 1, 1.0).otherwise(0.0)).alias("accuracy"), F.sum((F.col("l_quantity") > 45).cast("long")).alias("n_far"))
    network = rating.network_errors(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("traj_id"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity")).alias("there"), F.lit(30.0).alias("back")).withColumn("back", F.when(F.col("there").isNotNull(), F.col("back"))))
    scores = t.agg((F.min("l_tax") * 10).alias("recall"), (F.min("l_discount") * 10).alias("precision"), F.avg("l_tax").alias("f1"))
    return errors, network, scores


_report = """WITH e AS (SELECT l_orderkey AS traj_id, avg(l_quantity) AS mae, sqrt(avg(l_quantity * l_quantity)) AS rmse, avg(CASE WHEN l_linenumber % 2 = 1 THEN 1.0E0 ELSE 0.0E0 END) AS accuracy, sum(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS n_far,
  avg(d) AS rn_mae, sqrt(avg(d * d)) AS rn_rmse, count(*) FILTER (d IS NULL) AS skipped, min(l_tax) * 10 AS recall, min(l_discount) * 10 AS prec, avg(l_tax) AS f1
FROM (SELECT *, CASE WHEN l_linenumber % 4 <> 0 THEN least(l_quantity, 30.0E0) END AS d FROM lineitem) AS l GROUP BY l_orderkey),
r AS (SELECT round(avg(recall), 4) AS recall, round(avg(prec), 4) AS precision, round(avg(f1), 4) AS f1, round(avg(accuracy), 4) AS accuracy, round(avg(mae), 4) AS mae, round(avg(rmse), 4) AS rmse, round(avg(rn_mae), 4) AS rn_mae, round(avg(rn_rmse), 4) AS rn_rmse FROM e)"""


@query(_report + " SELECT * FROM r")
def agg15_report(spark, d):
    return rating.report(*given_report(spark, d))


@query(_report + " SELECT unnest([" + ", ".join(f"printf('{n} = %.4f', {n})" for n in ("recall", "precision", "f1", "accuracy", "mae", "rmse", "rn_mae", "rn_rmse")) + "]) AS value FROM r")
def snk10_report(spark, d):
    path = place(spark)
    sinks.write_report(rating.report(*given_report(spark, d)), path)
    return back(spark, path)


@query(_report + " SELECT CAST(sum(n_far) AS BIGINT) AS far_points, CAST(sum(skipped) AS BIGINT) AS skipped_points, count(*) FILTER (recall = 0) AS zero_recall, count(*) FILTER (prec = 0) AS zero_precision FROM e")
def fl26_odd_ones(spark, d):
    return rating.odd_ones(*given_report(spark, d))


_shape = "string_agg(printf('[%.6f,%.6f]', lon, lat), ',' ORDER BY pos)"


@query(ctes("points", "placed") + f""", v AS (SELECT DISTINCT traj_id, road_id FROM placed), s AS (SELECT road_id, {_shape} AS c FROM points GROUP BY road_id)
SELECT '{{"type":"Feature","geometry":{{"type":"LineString","coordinates":[' || c || ']}},"properties":{{"trace":' || traj_id || ',"road":' || v.road_id || '}}}}' AS value FROM v JOIN s USING (road_id)""")
def snk12_trace_map(spark, d):
    path = place(spark)
    sinks.write_features(plot.trace_lines(view(spark, d, "points"), view(spark, d, "placed")), path)
    return back(spark, path)


@query(ctes("edges") + ", m AS (SELECT road_id, row_number() OVER (ORDER BY road_id) - 1 AS new FROM edges) SELECT new || ' from ' || from_node AS value FROM m JOIN edges USING (road_id)")
def snk14_renumbered(spark, d):
    e = view(spark, d, "edges")
    path = place(spark)
    keyed = e.select(F.col("road_id").alias("id"), F.format_string("from %d", "from_node").alias("rest"))
    sinks.write_keyed(keyed, roadnet.renumbered(e.select(F.col("road_id").alias("id"))), path)
    return back(spark, path)

