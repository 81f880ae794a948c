"""Queries over geometry, road networks, candidates and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import ctes, read, view
from ..functions import geo
from ..functions import probability as prob
from ..functions.time import cycle_time, second_of_day, wrap_midpoint
from ..operators import candidates, plot, roadnet, routing, traces
from .sql import hav, hit, net, planar, turn

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def base(spark: SparkSession, d: str):
    """Edges, points and segments of the fixture network."""
    pts = view(spark, d, "points")
    return view(spark, d, "edges"), pts, roadnet.segments(pts)


@query(ctes("traces") + f" SELECT traj_id, CAST(seq AS BIGINT) AS seq, round({hav('41.1E0', '(-8.7E0)', 'lat', 'lon')}, 4) AS metres, round({hav('41.1E0', '(-8.7E0)', 'lat', 'lon')} / 1000, 6) AS km FROM traces")
def fn1_haversine(spark, d):
    return view(spark, d, "traces").select("traj_id", F.col("seq").cast("long"), F.round(geo.haversine_m(41.1, -8.7, "lat", "lon"), 4).alias("metres"), F.round(geo.haversine_km(41.1, -8.7, "lat", "lon"), 6).alias("km"))


_p, _c = planar("lat", "lon", "41.12E0", "-8.68E0"), planar("lat", "lon", "41.12E0", "-8.68E0", True)


@query(ctes("traces") + f" SELECT traj_id, CAST(seq AS BIGINT) AS seq, round({_p[0]}, 3) AS x, round({_p[1]}, 3) AS y, round({_c[0]}, 3) AS cx, round({_c[1]}, 3) AS cy FROM traces")
def fn4_planar_xy(spark, d):
    t = geo.with_planar(view(spark, d, "traces"), "p", "lat", "lon", 41.12, -8.68)
    t = geo.with_planar(t, "c", "lat", "lon", 41.12, -8.68, compat=True)
    return t.select("traj_id", F.col("seq").cast("long"), *[F.round(x, 3).alias(n) for x, n in (("p_x", "x"), ("p_y", "y"), ("c_x", "cx"), ("c_y", "cy"))])


@query("""SELECT event_id, round(1 - abs(((user_id * 7919 + event_id * 61) % 86400) - 43200) / 43200.0E0, 6) AS cycle, CAST(((event_id % 172800 - 86400) % 86400 + 86400) % 86400 AS BIGINT) AS sec,
  round(CASE WHEN event_id % 100000 + 0.5E0 >= 86400 THEN event_id % 100000 + 0.5E0 - 86400 ELSE event_id % 100000 + 0.5E0 END, 3) AS mid FROM events""")
def fn14_time_of_day(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", F.round(cycle_time(F.col("user_id") * 7919 + F.col("event_id") * 61), 6).alias("cycle"), second_of_day(F.col("event_id") % 172800 - 86400).alias("sec"), F.round(wrap_midpoint(F.col("event_id") % 100000 + F.lit(0.5)), 3).alias("mid"))


@query(ctes("traces") + " SELECT gx, gy, count(*) AS n FROM (SELECT CAST(trunc(lat / 0.001E0) AS BIGINT) AS gx, CAST(trunc(lon / 0.001E0) AS BIGINT) AS gy FROM traces) AS c GROUP BY gx, gy")
def fn18_grid_cells(spark, d):
    return view(spark, d, "traces").groupBy(geo.grid_cell("lat").cast("long").alias("gx"), geo.grid_cell("lon").cast("long").alias("gy")).agg(F.count(F.lit(1)).alias("n"))


_z, _t = "(abs(x) / sqrt(2.0E0))", "(1 / (1 + 0.3275911E0 * (abs(x) / sqrt(2.0E0))))"
_phi = f"(0.5E0 * (1 + CASE WHEN x < 0 THEN -1 ELSE 1 END * (1 - (((((1.061405429E0 * {_t} - 1.453152027E0) * {_t}) + 1.421413741E0) * {_t} - 0.284496736E0) * {_t} + 0.254829592E0) * {_t} * exp(-{_z} * {_z}))))"


@query(f"""SELECT event_id, round({_phi}, 6) AS phi, round(exp(-x * x / 2) / sqrt(2 * pi()), 6) AS density, round(1 / (1 + exp(-x)), 6) AS logistic,
  round(exp(-pow(value / 4.07E0, 2) / 2) / (4.07E0 * sqrt(2 * pi())), 8) AS emission, round(exp(-abs(x) / 2) / 2, 6) AS detour, round(1 / greatest(x, 1.0E0), 6) AS preference
FROM (SELECT event_id, value, (event_id % 13 - 6) / 2.0E0 AS x FROM events) AS e""")
def fn10_probabilities(spark, d):
    e = read(spark, d, "events").withColumn("x", (F.col("event_id") % 13 - 6) / F.lit(2.0))
    return e.select(
        "event_id", F.round(prob.normal_cdf("x"), 6).alias("phi"), F.round(prob.normal_density("x"), 6).alias("density"), F.round(prob.logistic("x"), 6).alias("logistic"),
        F.round(prob.emission("value"), 8).alias("emission"), F.round(prob.detour_density("x"), 6).alias("detour"), F.round(prob.travel_time_preference("x"), 6).alias("preference"),
    )


@query(net() + " SELECT road_id, seg_id, round(len, 4) AS len, round(sum_prev, 4) AS sum_prev, round(sum_after, 4) AS sum_after, round(cum_angle, 5) AS cum_angle, gx, gy FROM segs")
def w1_segments(spark, d):
    s = base(spark, d)[2]
    return s.select("road_id", F.col("seg_id").cast("long"), *[F.round(c, 4).alias(c) for c in ("len", "sum_prev", "sum_after")], F.round("cum_angle", 5).alias("cum_angle"), F.col("gx").cast("long"), F.col("gy").cast("long"))


@query(ctes("edges") + ", types AS (SELECT road_id, road_id % 9 AS type FROM edges WHERE road_id % 11 <> 0) SELECT e.road_id, CAST(CASE WHEN type BETWEEN 1 AND 7 THEN type - 1 ELSE 0 END AS BIGINT) AS level FROM edges e LEFT JOIN types t ON e.road_id = t.road_id")
def jn2_road_levels(spark, d):
    e = view(spark, d, "edges")
    types = e.where("road_id % 11 <> 0").select("road_id", (F.col("road_id") % 9).alias("type"))
    return roadnet.levelled(e, types).select("road_id", F.col("level").cast("long"))


@query(net() + " SELECT road_id, from_node, to_node, CAST(level AS BIGINT) AS level, round(length_m, 4) AS length_m FROM rds")
def agg5_road_lengths(spark, d):
    e, _, s = base(spark, d)
    return roadnet.roads(e, s).select("road_id", "from_node", "to_node", F.col("level").cast("long"), F.round("length_m", 4).alias("length_m"))


@query(net() + f" SELECT a.road_id AS road_a, b.road_id AS road_b, round({turn(('a.l_slat', 'a.l_slon'), ('b.f_slat', 'b.f_slon'), ('b.f_elat', 'b.f_elon'))}, 5) AS turn FROM rds a JOIN rds b ON a.to_node = b.from_node")
def jn4_successor_turns(spark, d):
    e, _, s = base(spark, d)
    return roadnet.turns(roadnet.roads(e, s)).select("road_a", "road_b", F.round("turn", 5).alias("turn"))


def _distant_sql() -> str:
    from .sql import angle

    at = ("b.f_slat", "b.f_slon")
    s, e, n = planar("a.l_slat", "a.l_slon", *at), planar("a.l_elat", "a.l_elon", *at), planar("b.f_elat", "b.f_elon", *at)
    back = (f"({s[0]} - {e[0]})", f"({s[1]} - {e[1]})")
    return net() + f" SELECT a.road_id AS road_a, b.road_id AS road_b, round(pi() - {angle(*back, *n)}, 5) AS turn FROM (SELECT DISTINCT x.road_id AS ra, z.road_id AS rb FROM rds x JOIN rds y ON x.to_node = y.from_node JOIN rds z ON y.to_node = z.from_node WHERE x.road_id <> z.road_id) AS p JOIN rds a ON p.ra = a.road_id JOIN rds b ON p.rb = b.road_id"


@query(_distant_sql())
def fn33_distant_turns(spark, d):
    e, _, s = base(spark, d)
    rds = roadnet.roads(e, s)
    one = roadnet.successors(rds)
    two = one.select("road_a", F.col("road_b").alias("m")).join(one.select(F.col("road_a").alias("m"), "road_b"), "m").where("road_a <> road_b").select("road_a", "road_b").distinct()
    return roadnet.distant_turns(two, rds).select("road_a", "road_b", F.round("turn", 5).alias("turn"))


@query(ctes("edges") + " SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT from_node AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT to_node, 1, 0 FROM edges) AS e GROUP BY node")
def agg4_node_degrees(spark, d):
    return roadnet.degrees(view(spark, d, "edges"))


@query(ctes("edges") + " SELECT e.road_id, (SELECT count(*) FROM edges f WHERE f.from_node = e.to_node) AS n_next FROM edges e")
def jn16_next_degree(spark, d):
    return roadnet.next_degree(view(spark, d, "edges"))


@query(ctes("edges") + " SELECT max(road_id) AS max_id, count(*) AS n FROM edges")
def agg21_max_road(spark, d):
    return view(spark, d, "edges").agg(F.max("road_id").alias("max_id"), F.count(F.lit(1)).alias("n"))


@query(ctes("edges") + " SELECT road_id * 3 AS old, row_number() OVER (ORDER BY road_id) - 1 AS new FROM edges")
def set5_renumber(spark, d):
    return roadnet.renumbered(view(spark, d, "edges").select((F.col("road_id") * 3).alias("id")))


@query(net("placed") + """, n AS (SELECT *, lead(sum_after) OVER (PARTITION BY road_id ORDER BY seg_id) AS low FROM segs)
SELECT traj_id, CAST(seq AS BIGINT) AS seq, p.road_id, seg_id, round(cum_angle, 5) AS turned, round(s_lat + (e_lat - s_lat) * (sum_after - to_node) / len, 7) AS at_lat, round(s_lon + (e_lon - s_lon) * (sum_after - to_node) / len, 7) AS at_lon
FROM placed p JOIN n AS s ON p.road_id = s.road_id WHERE (to_node <= sum_after OR seg_id = 0) AND (to_node > low OR low IS NULL)""")
def jn8_locate(spark, d):
    s = base(spark, d)[2]
    found = roadnet.located(view(spark, d, "placed"), s)
    return found.select("traj_id", F.col("seq").cast("long"), "road_id", F.col("seg_id").cast("long"), F.round("turned", 5).alias("turned"), F.round("at_lat", 7).alias("at_lat"), F.round("at_lon", 7).alias("at_lon"))


@query(net("placed", "traces") + "," + hit("SELECT t.traj_id, t.seq, t.lat, t.lon, s.* FROM traces t JOIN placed p ON t.traj_id = p.traj_id AND t.seq = p.seq JOIN segs s ON s.road_id = p.road_id", "traj_id, seq, road_id, seg_id, sum_after") + f"""
SELECT traj_id, CAST(seq AS BIGINT) AS seq, road_id, round(dist, 3) AS err, round(sum_after - {hav("c_lat", "c_lon", "s_lat", "s_lon")}, 3) AS to_node FROM (SELECT *, row_number() OVER (PARTITION BY traj_id, seq, road_id ORDER BY dist, seg_id) AS rn FROM hits) AS h WHERE rn = 1""")
def agg22_project(spark, d):
    s = base(spark, d)[2]
    pts = view(spark, d, "traces").join(view(spark, d, "placed").select("traj_id", "seq", "road_id"), ["traj_id", "seq"]).select("traj_id", "seq", "road_id", "lat", "lon")
    return roadnet.project(pts, s).select("traj_id", F.col("seq").cast("long"), "road_id", F.round("err", 3).alias("err"), F.round("to_node", 3).alias("to_node"))


def near_sql(points: str) -> str:
    """The nearest segment of every road within the cap of rows of a view."""
    # segments are entered in bands of latitude, which makes a hash join of what would be a range join
    bands = "(SELECT *, unnest(range(CAST(floor((least(s_lat, e_lat) - 0.0095) / 0.01E0) AS BIGINT), CAST(floor((greatest(s_lat, e_lat) + 0.0095) / 0.01E0) AS BIGINT) + 1)) AS band FROM segs)"
    box = "s.band = CAST(floor({p}.lat / 0.01E0) AS BIGINT) AND {p}.lat BETWEEN least(s.s_lat, s.e_lat) - 0.0095 AND greatest(s.s_lat, s.e_lat) + 0.0095 AND {p}.lon BETWEEN least(s.s_lon, s.e_lon) - 0.0135 AND greatest(s.s_lon, s.e_lon) + 0.0135".format(p="t")
    return net(points) + "," + hit(f"SELECT t.traj_id, t.seq, t.lat, t.lon, s.* FROM {points} t JOIN {bands} s ON {box}", "traj_id, seq, road_id, seg_id, sum_after") + f""",
best AS (SELECT traj_id, seq, road_id, dist AS err, greatest(sum_after - {hav("c_lat", "c_lon", "s_lat", "s_lon")}, 0) AS to_node FROM (SELECT *, row_number() OVER (PARTITION BY traj_id, seq, road_id ORDER BY dist, seg_id) AS rn FROM hits WHERE dist <= 960) AS h WHERE rn = 1)"""


CANDIDATES = """, r2 AS (SELECT *, row_number() OVER (PARTITION BY traj_id, seq ORDER BY err, road_id) AS rk FROM best),
lim AS (SELECT traj_id, seq, coalesce(least(greatest(60, ceil(max(CASE WHEN rk = 2 THEN err END) / 60) * 60), 960), 960) AS radius FROM r2 GROUP BY traj_id, seq),
cand AS (SELECT b.*, radius FROM best b JOIN lim USING (traj_id, seq) WHERE err <= radius)"""
_near = near_sql("traces")
_candidates = _near + CANDIDATES


@query(near_sql("sparse") + CANDIDATES + f""", pt AS (SELECT traj_id, seq, ts, lat, lon, lag(seq) OVER w AS s0, lag(ts) OVER w AS t0, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM sparse WINDOW w AS (PARTITION BY traj_id ORDER BY seq))
SELECT p.traj_id, CAST(p.seq AS BIGINT) AS seq, a.road_id AS road_a, b.road_id AS road_b, round(a.to_node, 3) AS left_a, round(b.to_node, 3) AS left_b, CAST(ts - t0 AS DOUBLE) AS span, round({hav("lat0", "lon0", "lat", "lon")}, 3) AS straight
FROM pt p JOIN cand a ON a.traj_id = p.traj_id AND a.seq = p.s0 JOIN cand b ON b.traj_id = p.traj_id AND b.seq = p.seq""")
def jn5_transitions(spark, d):
    from ..operators import matching

    pts = view(spark, d, "sparse")
    segs = base(spark, d)[2]
    t = matching.transitions(matching.with_turns(candidates.candidates(pts, segs), segs), pts)
    return t.select("traj_id", F.col("seq").cast("long"), "road_a", "road_b", F.round("left_a", 3).alias("left_a"), F.round("left_b", 3).alias("left_b"), "span", F.round("straight", 3).alias("straight"))


@query(_candidates + " SELECT traj_id, CAST(seq AS BIGINT) AS seq, road_id, round(err, 3) AS err, round(to_node, 3) AS to_node, CAST(radius AS BIGINT) AS radius FROM cand")
def jn1_candidates(spark, d):
    found = candidates.candidates(view(spark, d, "traces"), base(spark, d)[2])
    return found.select("traj_id", F.col("seq").cast("long"), "road_id", F.round("err", 3).alias("err"), F.round("to_node", 3).alias("to_node"), F.col("radius").cast("long"))


@query(_near + " SELECT traj_id, CAST(seq AS BIGINT) AS seq, CAST(greatest(ceil(err / 60), 1) AS BIGINT) AS ring, count(*) AS n_roads FROM best GROUP BY ALL")
def agg19_ring_counts(spark, d):
    found = candidates.ring_counts(view(spark, d, "traces"), base(spark, d)[2])
    return found.select("traj_id", F.col("seq").cast("long"), F.col("ring").cast("long"), "n_roads")


_speeds = ctes("traces") + f""", pairs AS (SELECT traj_id, seq, {hav("plat", "plon", "lat", "lon")} AS d, CAST(ts - pts AS DOUBLE) AS e FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(ts) OVER w AS pts FROM traces WINDOW w AS (PARTITION BY traj_id ORDER BY seq)) AS a WHERE plat IS NOT NULL),
ok AS (SELECT *, d / nullif(e, 0) AS v FROM pairs WHERE d / nullif(e, 0) BETWEEN -2 AND 40)"""


@query(_speeds + " SELECT traj_id, count(*) AS n_pairs, round(sum(d), 4) AS dist_m, round(avg(v), 6) AS avg_speed FROM ok GROUP BY traj_id")
def w5_segment_speed(spark, d):
    return traces.trip_speeds(view(spark, d, "traces"))


@query(_speeds + " SELECT traj_id, CAST(seq AS BIGINT) AS seq, round(v, 5) AS speed FROM ok")
def fl13_accepted_speeds(spark, d):
    return traces.segment_speeds(view(spark, d, "traces")).select("traj_id", F.col("seq").cast("long"), F.round("speed", 5).alias("speed"))


_jumpy = "(SELECT traj_id, seq, ts + CASE WHEN traj_id % 4 = 1 AND seq >= 9 THEN 5 ELSE 0 END AS ts FROM traces) AS j"


@query(ctes("traces") + f" SELECT traj_id, count(*) AS n FROM (SELECT *, bool_and(step IS NULL OR step = 15) OVER (PARTITION BY traj_id) AS ok FROM (SELECT *, abs(ts - lag(ts) OVER (PARTITION BY traj_id ORDER BY seq)) AS step FROM {_jumpy}) AS a) AS b WHERE ok GROUP BY traj_id")
def fl4_constant_interval(spark, d):
    t = view(spark, d, "traces")
    return traces.constant_interval(t.withColumn("ts", F.col("ts") + F.when((F.col("traj_id") % 4 == 1) & (F.col("seq") >= 9), 5).otherwise(0))).groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"))


_raw = "(SELECT user_id AS traj_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events) AS r"


@query(f"SELECT traj_id, CAST(min(seq) AS BIGINT) AS seq, 'gap too long' AS reason FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY traj_id ORDER BY seq) AS gap FROM {_raw}) AS g WHERE gap >= 4096 GROUP BY traj_id")
def fl6_gap_failures(spark, d):
    e = read(spark, d, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    raw = e.select(F.col("user_id").alias("traj_id"), seq.alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"))
    return traces.gap_failures(raw).withColumn("seq", F.col("seq").cast("long"))


@query(_candidates + " SELECT traj_id, CAST(min(seq) AS BIGINT) AS seq, 'no road near' AS reason FROM (SELECT traj_id, seq FROM traces EXCEPT SELECT traj_id, seq FROM cand) AS b GROUP BY traj_id")
def fl7_missing_candidates(spark, d):
    t = view(spark, d, "traces")
    return traces.missing_candidates(t, candidates.candidates(t, base(spark, d)[2])).withColumn("seq", F.col("seq").cast("long"))


@query("""WITH r AS (SELECT o_orderkey AS line_no, CASE WHEN o_orderkey % 7 = 3 THEN -1 ELSE o_custkey + 1 END AS ts FROM orders),
f AS (SELECT *, sum(CASE WHEN ts < 1 THEN 1 ELSE 0 END) OVER (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM r)
SELECT line_no, ts, CAST(coalesce(n, 0) AS BIGINT) AS traj_id FROM f WHERE ts >= 1""")
def w16_framing(spark, d):
    from ..sources.text import running

    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("line_no"), F.when(F.col("o_orderkey") % 7 == 3, F.lit(-1).cast("long")).otherwise(F.col("o_custkey") + 1).alias("ts"))
    return running(o, F.col("ts") < 1, "traj_id", before=True).where("ts >= 1").select("line_no", "ts", F.col("traj_id").cast("long"))


_steps = ctes("traces") + ", steps AS (SELECT traj_id, seq, lat, lon, 0.1E0 * (seq % 5) AS angle, 70.0E0 + seq % 3 AS length FROM traces)"


@query(_steps + f""", sums AS (SELECT *, sum(angle) OVER w AS a, sum(length) OVER w AS l FROM steps WINDOW w AS (PARTITION BY traj_id ORDER BY seq))
SELECT x.traj_id, CAST(x.seq AS BIGINT) AS seq, CAST(x.seq - y.seq AS BIGINT) AS k, round(x.a - y.a, 5) AS turned, round(x.l - y.l - {hav("x.lat", "x.lon", "y.lat", "y.lon")}, 3) AS detour FROM sums x JOIN sums y ON x.traj_id = y.traj_id AND y.seq BETWEEN x.seq - 24 AND x.seq - 1""")
def w10_trailing_sums(spark, d):
    steps = view(spark, d, "traces").select("traj_id", "seq", "lat", "lon", (F.lit(0.1) * (F.col("seq") % 5)).alias("angle"), (F.lit(70.0) + F.col("seq") % 3).alias("length"))
    return traces.trailing(steps).select("traj_id", F.col("seq").cast("long"), F.col("k").cast("long"), F.round("turned", 5).alias("turned"), F.round("detour", 3).alias("detour"))


@query(ctes("placed", "edges") + """, steps AS (SELECT p.traj_id, e.level, 15.0E0 * (1 + p.seq % 3) AS elapsed, abs(p.to_node - 100) AS length FROM placed p JOIN edges e USING (road_id)),
s AS (SELECT level, sum(length) AS l, sum(elapsed) AS t FROM steps GROUP BY level) SELECT CAST(r.level AS BIGINT) AS level, round(l, 4) AS length_m, round(t, 4) AS time_s, round(l / t, 6) AS speed FROM (SELECT unnest(range(7)) AS level) AS r LEFT JOIN s ON r.level = s.level""")
def agg1_level_speeds(spark, d):
    p = view(spark, d, "placed").join(view(spark, d, "edges").select("road_id", "level"), "road_id")
    found = traces.level_speeds(p.select("level", F.abs(F.col("to_node") - 100).alias("length"), (F.lit(15.0) * (1 + F.col("seq") % 3)).alias("elapsed")))
    return found.select(F.col("level").cast("long"), F.round("length_m", 4).alias("length_m"), F.round("time_s", 4).alias("time_s"), F.round("speed", 6).alias("speed"))


@query(_candidates + " SELECT round(avg(m), 4) AS mean, round(stddev_pop(m), 4) AS sigma FROM (SELECT min(err) AS m FROM cand GROUP BY traj_id, seq) AS e")
def agg2_gps_sigma(spark, d):
    errs = candidates.candidates(view(spark, d, "traces"), base(spark, d)[2]).groupBy("traj_id", "seq").agg(F.min("err").alias("err"))
    return traces.gps_sigma(errs).select(F.round("mean", 4).alias("mean"), F.round("sigma", 4).alias("sigma"))


@query(ctes("placed") + " SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY seq) - 1 AS n, road_id FROM (SELECT *, lag(road_id) OVER (PARTITION BY traj_id ORDER BY seq) AS b FROM placed) AS a WHERE b IS NULL OR b <> road_id")
def w13_run_collapse(spark, d):
    return traces.collapsed(view(spark, d, "placed")).select("traj_id", F.col("n").cast("long"), "road_id")


@query(ctes("trips") + " SELECT traj_id, CAST(seq AS BIGINT) AS seq, road_id, to_road FROM trips")
def w12_next_distinct(spark, d):
    return traces.next_distinct(view(spark, d, "placed")).select("traj_id", F.col("seq").cast("long"), "road_id", "to_road")


@query(ctes("placed") + """, p AS (SELECT traj_id, CAST(floor(seq / 4E0) AS BIGINT) AS gap, seq AS n, to_node AS passed FROM placed)
SELECT traj_id, gap, CAST(n AS BIGINT) AS n, round(60E0 * gap + coalesce(sum(passed) OVER (PARTITION BY traj_id, gap ORDER BY n) / nullif(sum(passed) OVER (PARTITION BY traj_id, gap), 0), 0) * 60, 5) AS t FROM p""")
def w14_paced_times(spark, d):
    p = view(spark, d, "placed").select("traj_id", F.floor(F.col("seq") / 4).alias("gap"), F.col("seq").alias("n"), F.col("to_node").alias("passed"))
    paced = traces.paced(p.withColumn("t0", F.col("gap") * 60.0).withColumn("t1", F.col("gap") * 60.0 + 60))
    return paced.select("traj_id", "gap", F.col("n").cast("long"), F.round("t", 5).alias("t"))


_hop = """h AS (SELECT a.road_id AS ra, b.road_id AS rb, b.length_m AS m FROM rds a JOIN rds b ON a.to_node = b.from_node)"""


@query(net() + f", {_hop}, " + """d0 AS (SELECT road_id AS source, road_id, 0.0E0 AS metres FROM rds),
d1 AS (SELECT source, road_id, min(metres) AS metres FROM (SELECT * FROM d0 UNION ALL SELECT source, rb, metres + m FROM d0 JOIN h ON road_id = ra) AS x GROUP BY ALL),
d2 AS (SELECT source, road_id, min(metres) AS metres FROM (SELECT * FROM d1 UNION ALL SELECT source, rb, metres + m FROM d1 JOIN h ON road_id = ra) AS x GROUP BY ALL),
d3 AS (SELECT source, road_id, min(metres) AS metres FROM (SELECT * FROM d2 UNION ALL SELECT source, rb, metres + m FROM d2 JOIN h ON road_id = ra) AS x GROUP BY ALL)
SELECT source, road_id, round(metres, 3) AS metres FROM d3""")
def gr3_relaxed_distances(spark, d):
    e, _, s = base(spark, d)
    rds = roadnet.roads(e, s)
    return routing.relaxed(rds.select("road_id"), rds, 3).select("source", "road_id", F.round("metres", 3).alias("metres"))


_ask = """ask AS (SELECT DISTINCT a.road_id AS road_a, CAST(floor(a.to_node) AS DOUBLE) AS left_a, b.road_id AS road_b, CAST(floor(b.to_node) AS DOUBLE) AS left_b
  FROM placed a JOIN placed b ON a.traj_id = b.traj_id AND b.seq = a.seq + 4 JOIN rds ra ON ra.road_id = a.road_id JOIN rds rb ON rb.road_id = b.road_id)"""


@query(net("placed") + f", {_hop}, {_ask}, " + """w AS (SELECT ra AS s, rb AS t, 0.0E0 AS mid, 1 AS n FROM h),
w2 AS (SELECT s, t, mid FROM w UNION ALL SELECT w.s, h.rb, w.mid + r.length_m FROM w JOIN rds r ON r.road_id = w.t JOIN h ON h.ra = w.t),
w3 AS (SELECT s, t, min(mid) AS mid FROM (SELECT * FROM w2 UNION ALL SELECT w2.s, h.rb, w2.mid + r.length_m FROM w2 JOIN rds r ON r.road_id = w2.t JOIN h ON h.ra = w2.t) AS x GROUP BY ALL),
w4 AS (SELECT s, t, min(mid) AS mid FROM (SELECT * FROM w3 UNION ALL SELECT w3.s, h.rb, w3.mid + r.length_m FROM w3 JOIN rds r ON r.road_id = w3.t JOIN h ON h.ra = w3.t) AS x GROUP BY ALL),
w5 AS (SELECT s, t, min(mid) AS mid FROM (SELECT * FROM w4 UNION ALL SELECT w4.s, h.rb, w4.mid + r.length_m FROM w4 JOIN rds r ON r.road_id = w4.t JOIN h ON h.ra = w4.t) AS x GROUP BY ALL)
SELECT road_a, left_a, road_b, left_b, round(CASE WHEN road_a = road_b THEN abs(left_a - left_b) ELSE f.mid + left_a + rb.length_m - left_b END, 3) AS there,
  round(CASE WHEN road_a = road_b THEN abs(left_a - left_b) ELSE g.mid + left_b + ra.length_m - left_a END, 3) AS back
FROM ask JOIN rds ra ON ra.road_id = road_a JOIN rds rb ON rb.road_id = road_b LEFT JOIN w5 f ON f.s = road_a AND f.t = road_b LEFT JOIN w5 g ON g.s = road_b AND g.t = road_a""")
def gr3_network_distance(spark, d):
    e, _, s = base(spark, d)
    rds = roadnet.roads(e, s)
    p = view(spark, d, "placed").join(rds.select("road_id"), "road_id")
    a = p.select("traj_id", (F.col("seq") + 4).alias("seq"), F.col("road_id").alias("road_a"), F.floor("to_node").cast("double").alias("left_a"))
    asked = a.join(p.select("traj_id", "seq", F.col("road_id").alias("road_b"), F.floor("to_node").cast("double").alias("left_b")), ["traj_id", "seq"]).select("road_a", "left_a", "road_b", "left_b").distinct()
    found = routing.network_distances(asked, routing.network(rds))
    return found.select("road_a", "left_a", "road_b", "left_b", F.round("there", 3).alias("there"), F.round("back", 3).alias("back"))


@query(ctes("traces") + """ SELECT traj_id, CAST(seq AS BIGINT) AS seq, CAST(n AS BIGINT) AS place, '#' || lower(format('{:02x}', 255 - k)) || '00' || lower(format('{:02x}', k)) AS colour
FROM (SELECT *, CAST(floor(n * 255 / greatest(c - 1, 1)::DOUBLE) AS INTEGER) AS k FROM (SELECT traj_id, seq, row_number() OVER (PARTITION BY traj_id ORDER BY seq) - 1 AS n, count(*) OVER (PARTITION BY traj_id) AS c FROM traces) AS a) AS b""")
def fn41_colours(spark, d):
    return plot.coloured(view(spark, d, "traces")).select("traj_id", F.col("seq").cast("long"), F.col("place").cast("long"), "colour")


@query(ctes("traces") + " SELECT traj_id, count(*) AS n FROM traces WHERE traj_id >= 3 AND (traj_id - 3) % 4 = 0 GROUP BY traj_id")
def fl24_chosen_traces(spark, d):
    return plot.chosen(view(spark, d, "traces"), first=3, step=4).groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT traj_id, count(*) AS n FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY traj_id ORDER BY seq) AS gap FROM {_raw}) AS g WHERE gap IS NULL OR gap >= 20000 GROUP BY traj_id")
def fl25_spaced_points(spark, d):
    e = read(spark, d, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    raw = e.select(F.col("user_id").alias("traj_id"), seq.alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"))
    return plot.spaced(raw, 20000).groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"))


@query(ctes("points") + """ SELECT '{"type":"Feature","geometry":{"type":"LineString","coordinates":[' || string_agg(printf('[%.6f,%.6f]', lon, lat), ',' ORDER BY pos) || ']},"properties":{"road":' || road_id || '}}' AS value FROM points GROUP BY road_id""")
def snk13_road_features(spark, d) -> DataFrame:
    return plot.road_features(view(spark, d, "points"))
