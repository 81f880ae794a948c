"""Text formats: readers on hand-made files, and round trips through the writers."""

import pytest
from pyspark.sql import functions as F

from tracewright.operators import plot, rating, roadnet
from tracewright.sources import sinks, text


def write(tmp_path, name, body):
    p = tmp_path / name
    p.write_text(body)
    return str(p)


def test_maps(spark, tmp_path):
    e = write(tmp_path, "e.txt", "0 10 11 3 41.1 -8.7 41.1004 -8.699 41.101 -8.698\n5 11 12 1 41.1 -8.7\n 7 12 10 2 41.0 -8.0 41.2 -8.2 \n")
    edges, points = text.read_edges(spark, e)
    assert sorted(r.road_id for r in edges.collect()) == [0, 7]
    assert points.where("road_id = 0").orderBy("pos").collect()[2].lon == -8.698
    t = write(tmp_path, "t.txt", "0 residential 5\n7 odd 9\n")
    assert {r.road_id: r.level for r in text.read_types(spark, t).collect()} == {0: 4, 7: 0}


def test_traces(spark, tmp_path):
    body = "100 41.1 -8.7 3\n115 41.2 -8.8 4\n-1\n100 41.1 -8.7 3\n120 41.2 -8.8 4\n-2\nFailed\n-3\n200 41.0 -8.0\n-4\n"
    p = write(tmp_path, "x.txt", body)
    own, failed = text.read_traces(spark, p)
    assert sorted((r.traj_id, r.seq, r.ts, r.road_id) for r in own.collect()) == [(0, 0, 100, 3), (0, 1, 115, 4), (1, 0, 100, 3), (1, 1, 120, 4), (3, 0, 200, None)]
    assert [(r.traj_id, r.reason) for r in failed.collect()] == [(2, "failed")]
    even, failed = text.read_traces(spark, p, interval=15, labelled=True)
    assert {r.traj_id for r in even.collect()} == {0} and {r.traj_id for r in failed.collect()} == {1, 2, 3}
    sinks.write_traces(own.where("traj_id < 2"), str(tmp_path / "out"))
    back, _ = text.read_traces(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, own.where("traj_id < 2").collect()))
    assert text.read_plot_traces(spark, p, 2).count() == 2
    sinks.write_failures(failed, str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "bad_reasons")).count() == 3
    again, bad = text.read_traces(spark, str(tmp_path / "bad"))
    assert again.count() == 0 and bad.count() == 3


def test_tables(spark, tmp_path):
    p = write(tmp_path, "t.csv", "trajID, originID ,transitionID,timestamp,toNode,elapsed\n0,0,1,0,182.5,15\n0,0,1,15,-1,15\n")
    assert text.read_trips(spark, p).count() == 1
    assert text.read_numbers(spark, p, text.TRIP_COLUMNS).count() == 2
    trips = text.read_trips(spark, p)
    sinks.write_trips(trips, str(tmp_path / "trips"))
    assert [tuple(r) for r in text.read_trips(spark, str(tmp_path / "trips")).collect()] == [tuple(r) for r in trips.collect()]
    m = text.read_matrix(spark, p, text.TRIP_COLUMNS, "elapsed").first()
    assert len(m.x) == 5 and m.y == 15
    sinks.write_numbers(spark.createDataFrame([(1.23456789, 2.0)], "a double, b double"), str(tmp_path / "n"))
    assert text.read_numbers(spark, str(tmp_path / "n"), ["a", "b"]).first().a == pytest.approx(1.234568)


def test_parameters(spark, tmp_path):
    speeds = spark.createDataFrame([(i, float(i + 1)) for i in range(7)], "level int, speed double")
    sinks.write_params(speeds, spark.createDataFrame([(4.07,)], "sigma double"), str(tmp_path / "p"))
    params = text.read_params(spark, str(tmp_path / "p"))
    assert text.level_speeds(params).where("level = 3").first().speed == 4 and text.gps_sigma(params).first().sigma == pytest.approx(4.07)
    stats = spark.createDataFrame([(30, 1.0), (30, -2.5), (45, 3.0)], "interval_s int, value double")
    sinks.write_statistics(stats, str(tmp_path / "s"))
    assert sorted(map(tuple, text.read_statistics(spark, str(tmp_path / "s")).collect())) == sorted(map(tuple, stats.collect()))
    dist = spark.createDataFrame([(30, 9, 0.1, 2.0, 0.4, 3.0, 7.0)], "interval_s int, up_lim long, val0 double, sig1 double, s1 double, sig2 double, mu2 double")
    sinks.write_distributions(dist, str(tmp_path / "d"))
    assert [tuple(r) for r in text.read_distributions(spark, str(tmp_path / "d")).collect()] == [tuple(r) for r in dist.collect()]


def test_vectors_and_sequences(spark, tmp_path):
    vec = spark.createDataFrame([(0, [1.0] * 16), (3, [2.5] * 16)], "road_id int, vec array<double>")
    sinks.write_vectors(vec, str(tmp_path / "v"))
    back = {r.road_id: r.vec for r in text.read_vectors(spark, str(tmp_path / "v")).collect()}
    assert back[3] == [2.5] * 16 and back[1] == [0.0] * 16 and len(back) == 4
    assert text.read_vectors(spark, str(tmp_path / "v"), single=True).first().vec
    seqs = spark.createDataFrame([(0, [1, 1, 2]), (1, [3])], "traj_id long, roads array<long>")
    sinks.write_sequences(seqs, str(tmp_path / "q"))
    assert sorted((r.traj_id, r.roads) for r in text.read_sequences(spark, str(tmp_path / "q")).collect()) == [(0, [1, 1, 2]), (1, [3])]
    assert sorted(r.roads for r in text.read_sequences(spark, str(tmp_path / "q"), collapse=True).collect()) == [[1, 2], [3]]


def test_renumbering(spark, tmp_path):
    p = write(tmp_path, "m.txt", "9 a b\n4 c\n9 d e\n")
    keyed = text.read_keyed(spark, p)
    assert {r.id: r.rest for r in keyed.collect()} == {9: "d e", 4: "c"}
    mapping = roadnet.renumbered(keyed)
    assert {r.old: r.new for r in mapping.collect()} == {4: 0, 9: 1}
    sinks.write_keyed(keyed, mapping, str(tmp_path / "k"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "k")).collect()) == ["0 c", "1 d e"]


def test_report_and_features(spark, tmp_path):
    t = spark.createDataFrame([(0, 0, 41.0, -8.0, 100), (0, 1, 41.1, -8.1, 115)], "traj_id int, seq int, lat double, lon double, ts long")
    f = plot.point_features(plot.coloured(t))
    sinks.write_features(f, str(tmp_path / "f"))
    assert "#ff0000" in "".join(r.value for r in spark.read.text(str(tmp_path / "f")).collect())
    truth = t.withColumn("road_id", F.lit(1))
    errors = rating.trace_errors(rating.paired(truth, truth))
    net = errors.select("traj_id", F.lit(0.0).alias("rn_mae"), F.lit(0.0).alias("rn_rmse"))
    scores = rating.sequence_scores(spark.createDataFrame([(0, [1, 2], [1])], "traj_id int, truth array<long>, found array<long>"), lambda x: F.lit(1.0))
    r = rating.report(errors, net, scores)
    assert (r.first().recall, r.first().precision, r.first().accuracy) == (0.5, 1.0, 1.0)
    sinks.write_report(r, str(tmp_path / "r"))
    assert "recall = 0.5000" in [x.value for x in spark.read.text(str(tmp_path / "r")).collect()]


def test_stream(spark, tmp_path):
    from tracewright.streaming.online import online_speeds

    rows = [(1, 100, 41.0, -8.0), (1, 110, 41.001, -8.0), (1, 120, 42.0, -8.0), (2, 100, 41.0, -8.0)]
    spark.createDataFrame(rows, "traj_id long, ts long, lat double, lon double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("traj_id long, ts long, lat double, lon double").parquet(str(tmp_path / "in"))
    q = online_speeds(stream).writeStream.format("memory").queryName("speeds").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = spark.table("speeds").collect()
    assert len(found) == 1 and found[0].speed == pytest.approx(11.119, abs=0.01)


def parts(tmp_path, name, *bodies):
    """A folder of parts, each larger than those before: Spark reads the largest first."""
    (tmp_path / name).mkdir()
    for i, b in enumerate(bodies):
        (tmp_path / name / f"part-{i + 9}.txt").write_text(b + "\n" * 40 * i)
    return str(tmp_path / name)


def test_traces_of_several_parts(spark, tmp_path):
    """A failed trace, one that goes on in the next part, and numbers of traces over all parts."""
    p = parts(tmp_path, "x", "100 41.1 -8.7 3\n-1\nFailed\n", "-2\n200 41.0 -8.0 5\n", "215 41.2 -8.1 6\n-3\n300 41.3 -8.3 7\n-4\n")
    own, failed = text.read_traces(spark, p)
    assert sorted((r.traj_id, r.seq, r.ts, r.road_id) for r in own.collect()) == [(0, 0, 100, 3), (2, 0, 200, 5), (2, 1, 215, 6), (3, 0, 300, 7)]
    assert [(r.traj_id, r.reason) for r in failed.collect()] == [(1, "failed")]


def test_labelled_traces_of_several_parts(spark, tmp_path):
    p = parts(tmp_path, "x", "100 41.1 -8.7 3\n115 41.2 -8.8 4\n", "130 41.3 -8.9 5\n-1\n200 41.0 -8.0 6\n", "215 41.2 -8.1 7\n-2\n100 41.0 -8.0\n-3\n")
    own, failed = text.read_traces(spark, p, interval=15, labelled=True)
    assert sorted((r.traj_id, r.seq, r.ts, r.road_id) for r in own.collect()) == [(0, 0, 100, 3), (0, 1, 115, 4), (0, 2, 130, 5), (1, 0, 200, 6), (1, 1, 215, 7)]
    assert [r.traj_id for r in failed.collect()] == [2]


def test_plot_traces_of_several_parts(spark, tmp_path):
    p = parts(tmp_path, "x", "100 41.1 -8.7 3\n115 41.2 -8.8 4\n-1\n", "200 41.0 -8.0 6\n", "215 41.2 -8.1 7\n-2\n300 41.0 -8.0 8\n-3\n")
    assert sorted((r.traj_id, r.ts) for r in text.read_plot_traces(spark, p, 4).collect()) == [(0, 100), (0, 115), (1, 200), (1, 215)]


def test_keyed_lines_of_several_parts(spark, tmp_path):
    p = parts(tmp_path, "m", "9 a\n4 c\n", "9 b\n", "9 d\n4 e\n")
    assert {r.id: r.rest for r in text.read_keyed(spark, p).collect()} == {9: "d", 4: "e"}


def test_sequences_of_several_parts(spark, tmp_path):
    """The line of the count is the first of the first file; part-10 follows part-9."""
    p = parts(tmp_path, "q", "3\n1 1 2\n", "3\n", "4 4\n")
    assert sorted((r.traj_id, r.roads) for r in text.read_sequences(spark, p).collect()) == [(0, [1, 1, 2]), (1, [3]), (2, [4, 4])]


def test_collapsed_sequences_of_several_parts(spark, tmp_path):
    p = parts(tmp_path, "q", "3\n1 1 2\n", "3\n", "4 4\n")
    assert sorted((r.traj_id, r.roads) for r in text.read_sequences(spark, p, collapse=True).collect()) == [(0, [1, 2]), (1, [3]), (2, [4])]


def many_sequences(spark, tmp_path, collapse):
    """Traces written and read back in a session that makes each range exchange anew, with bounds of its own sample."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")}
    try:
        for k in kept:
            spark.conf.set(k, "false")
        ids = spark.range(0, 60000, 3).select((F.col("id") * 7 % 60013).alias("id"))
        seqs = sinks.numbered(ids.select(F.col("id").alias("traj_id"), F.array("id", "id", F.col("id") + 1).alias("roads")))
        sinks.write_sequences(seqs, str(tmp_path / "q"))
        found = sorted((r.traj_id, r.roads) for r in text.read_sequences(spark, str(tmp_path / "q"), collapse=collapse).collect())
        return found, sorted(r.id for r in ids.collect())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_sequences_of_many_ranges(spark, tmp_path):
    found, ids = many_sequences(spark, tmp_path, collapse=False)
    assert found == [(n, [i, i, i + 1]) for n, i in enumerate(ids)]


def test_collapsed_sequences_of_many_ranges(spark, tmp_path):
    found, ids = many_sequences(spark, tmp_path, collapse=True)
    assert found == [(n, [i, i + 1]) for n, i in enumerate(ids)]
