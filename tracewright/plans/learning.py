"""Queries over features, lights, distributions, matching, recovery and rating."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import ctes, read, view
from ..operators import candidates, criterion, distributions, features, lights, matching, rating, recovery, roadnet, speed_model, traces
from ..session import stored
from .network import CANDIDATES, base, near_sql
from .network import QUERIES as _NETWORK
from .sql import hav, net

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- features -----------------------------------------------------------------------------------------------------

_pairs = ctes("trips", "edges") + """, p0 AS (SELECT *, lead(road_id) OVER w AS nr, lead(to_node) OVER w AS nn FROM trips WINDOW w AS (PARTITION BY traj_id ORDER BY seq)),
prs AS (SELECT traj_id, seq, road_id, to_road, t AS t0, to_node AS to_node0, elapsed, CASE WHEN road_id = nr THEN to_node - nn ELSE to_node END AS passed, CASE WHEN road_id = nr THEN (to_node + nn) / 2 ELSE to_node / 2 END AS at_m,
  CASE WHEN t + elapsed / 2 >= 86400 THEN t + elapsed / 2 - 86400 ELSE t + elapsed / 2 END AS mid_t FROM p0 WHERE nr IS NOT NULL),
okp AS (SELECT *, passed / nullif(elapsed, 0) AS speed, sum(passed) OVER (PARTITION BY traj_id) AS total_m FROM prs)"""


@query(_pairs + " SELECT traj_id, round(sum(elapsed), 4) AS total_s, round(sum(passed), 4) AS total_m FROM prs GROUP BY traj_id")
def agg6_trip_totals(spark, d):
    t = features.trip_totals(features.pairs(view(spark, d, "trips")))
    return t.select("traj_id", F.round("total_s", 4).alias("total_s"), F.round("total_m", 4).alias("total_m"))


_samples = _pairs + """, o AS (SELECT *, sum(passed) OVER w AS done, lag(speed) OVER w AS bs, lag(elapsed) OVER w AS be FROM okp WHERE speed BETWEEN -2 AND 40 WINDOW w AS (PARTITION BY traj_id ORDER BY seq)),
smp AS (SELECT traj_id, seq, road_id, to_road, 'middle' AS kind, at_m AS to_node, mid_t AS t, (done - passed / 2) / nullif(total_m, 0) AS journey, greatest(speed, 0) AS vel FROM o
  UNION ALL SELECT traj_id, seq, road_id, to_road, 'boundary', to_node0, t0, (done - passed) / nullif(total_m, 0), greatest((bs * be + speed * elapsed) / (be + elapsed), 0) FROM o WHERE bs IS NOT NULL)"""


@query(_samples + " SELECT traj_id, CAST(seq AS BIGINT) AS seq, road_id, to_road, kind, round(to_node, 4) AS to_node, round(t, 3) AS t, round(journey, 6) AS journey, round(vel, 6) AS vel FROM smp")
def w7_samples(spark, d):
    s = features.samples(features.pairs(view(spark, d, "trips")))
    return s.select("traj_id", F.col("seq").cast("long"), "road_id", "to_road", "kind", F.round("to_node", 4).alias("to_node"), F.round("t", 3).alias("t"), F.round("journey", 6).alias("journey"), F.round("vel", 6).alias("vel"))


_frequency = ctes("placed") + ", freq AS (SELECT road_id, count(DISTINCT traj_id) AS n_traces, count(DISTINCT traj_id) * 100.0E0 / (SELECT count(DISTINCT traj_id) FROM placed) AS percent FROM placed GROUP BY road_id)"


@query(_frequency + " SELECT road_id, n_traces, round(percent, 6) AS percent FROM freq")
def agg3_road_frequency(spark, d):
    return features.road_frequency(view(spark, d, "placed")).select("road_id", "n_traces", F.round("percent", 6).alias("percent"))


@query(_frequency + " SELECT i AS road_id, round(coalesce(percent, 0), 6) AS v0, 2 AS width FROM (SELECT unnest(range((SELECT max(road_id) + 1 FROM freq))) AS i) AS r LEFT JOIN freq ON road_id = i".replace("2 AS width", "CAST(2 AS BIGINT) AS width"))
def jn15_id_range(spark, d):
    v = features.road_frequency(view(spark, d, "placed")).select("road_id", F.array("percent", F.col("n_traces").cast("double")).alias("vec"))
    return features.id_range(v, 2).select("road_id", F.round(F.get("vec", 0), 6).alias("v0"), F.size("vec").cast("long").alias("width"))


# ---- lights -------------------------------------------------------------------------------------------------------

_light = ctes("trips") + """, l0 AS (SELECT *, floor(elapsed) AS el, lag(road_id) OVER w AS pr, lag(to_road) OVER w AS pto, lag(t) OVER w AS pt, lag(to_node) OVER w AS pn, lag(floor(elapsed)) OVER w AS pe FROM trips WHERE to_node >= 0 WINDOW w AS (PARTITION BY traj_id ORDER BY seq)),
l1 AS (SELECT *, pr IS NOT NULL AND road_id <> to_road AND road_id <> pr AS changed, pr IS NOT NULL AND road_id <> to_road AND road_id = pr AS same, (pn - to_node) / nullif(pe, 0) AS v FROM l0),
l2 AS (SELECT *, CASE WHEN same AND v >= -1 AND to_node <= 200 THEN CASE WHEN v < 1 THEN 1 ELSE 2 END END AS kind, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY traj_id ORDER BY seq) AS run FROM l1),
l3 AS (SELECT *, last_value(kind IGNORE NULLS) OVER w AS lk, max(CASE WHEN kind = 1 THEN 1 ELSE 0 END) OVER w AS slow FROM l2 WINDOW w AS (PARTITION BY traj_id, run ORDER BY seq)),
l4 AS (SELECT *, coalesce(lag(lk) OVER w = 1, false) AS stopped, coalesce(lag(lk) OVER w = 2 AND lag(slow) OVER w = 1, false) AS recovered FROM l3 WINDOW w AS (PARTITION BY traj_id ORDER BY seq)),
ivl AS (SELECT pr AS road_id, pto AS to_road, pt - pn / 3 AS lo, t AS hi, 2 AS weight FROM l4 WHERE changed AND stopped
  UNION ALL SELECT pr, pto, pt - pn / 3, (pt - pn / 3 + t + CASE WHEN t < pt THEN 86400 ELSE 0 END) / 2, -2 FROM l4 WHERE changed AND NOT stopped AND coalesce(pn / nullif(pe, 0) < 1, false)
  UNION ALL SELECT pr, pto, (pt - pn / 3 + t + CASE WHEN t < pt THEN 86400 ELSE 0 END) / 2, t, 2 FROM l4 WHERE changed AND NOT stopped AND coalesce(pn / nullif(pe, 0) < 1, false)
  UNION ALL SELECT pr, pto, pt + pe / 2, t, 2 FROM l4 WHERE changed AND NOT stopped AND NOT coalesce(pn / nullif(pe, 0) < 1, false)
  UNION ALL SELECT road_id, to_road, pt - pn / 3, t - floor(to_node / 3), -1 FROM l4 WHERE kind = 1
  UNION ALL SELECT road_id, to_road, pt - pn / 3, t - floor(to_node / 3), 1 FROM l4 WHERE kind = 2 AND (stopped OR recovered)),
vld AS (SELECT * FROM (SELECT road_id, to_road, CAST(((round(lo) % 86400) + 86400) % 86400 AS BIGINT) AS l, CAST(((round(hi) % 86400) + 86400) % 86400 AS BIGINT) AS r, weight FROM ivl) AS x WHERE l <= r OR (l >= 86300 AND r <= 100)),
dlt AS (SELECT road_id, to_road, sec, greatest(-127, least(127, sum(d))) AS delta FROM (SELECT road_id, to_road, l AS sec, weight AS d FROM vld UNION ALL SELECT road_id, to_road, r + 1, -weight FROM vld UNION ALL SELECT road_id, to_road, 0, weight FROM vld WHERE l > r) AS x WHERE sec < 86400 GROUP BY ALL),
scr0 AS (SELECT road_id, to_road, sec, sum(delta) OVER (PARTITION BY road_id, to_road ORDER BY sec) AS s FROM dlt),
scr AS (SELECT road_id, to_road, sec, CAST(CASE WHEN abs(s) > 127 THEN s % 128 ELSE s END AS BIGINT) AS score FROM scr0),
pri AS (SELECT road_id, to_road, CAST(sum(abs(weight)) AS BIGINT) AS cnt, 1 / (1 + exp(-sum(CASE WHEN weight < 0 THEN 2 * weight ELSE weight END) / sum(abs(weight))::DOUBLE)) AS percent FROM vld GROUP BY ALL)"""


def light_series(spark, d):
    ok = lights.valid(lights.intervals(view(spark, d, "trips")))
    return ok, lights.scores(lights.deltas(ok))


@query(_light + " SELECT road_id, to_road, round(lo, 4) AS lo, round(hi, 4) AS hi, CAST(weight AS BIGINT) AS weight, count(*) AS n FROM ivl GROUP BY ALL")
def lt1_light_intervals(spark, d):
    found = lights.intervals(view(spark, d, "trips"))
    return found.groupBy("road_id", "to_road", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), F.col("weight").cast("long").alias("weight")).agg(F.count(F.lit(1)).alias("n"))


@query(_light + " SELECT road_id, to_road, sec, CAST(delta AS BIGINT) AS delta FROM dlt")
def lt2_light_deltas(spark, d):
    ok = lights.valid(lights.intervals(view(spark, d, "trips")))
    return lights.deltas(ok).select("road_id", "to_road", F.col("sec").cast("long"), F.col("delta").cast("long"))


@query(_light + " SELECT road_id, to_road, sec, score FROM scr")
def w8_light_scores(spark, d):
    return light_series(spark, d)[1].select("road_id", "to_road", F.col("sec").cast("long"), F.col("score").cast("long"))


_phases = _light + """, nr AS (SELECT DISTINCT road_id, to_road, ((sec + o) % 86400 + 86400) % 86400 AS at_s FROM scr, (SELECT unnest(range(-3, 4)) AS o) AS x),
prb AS (SELECT n.*, o, ((at_s + o) % 86400 + 86400) % 86400 AS sec FROM nr n, (SELECT unnest([-3, -2, -1, 1, 2, 3]) AS o) AS x),
prs2 AS (SELECT p.road_id, p.to_road, at_s, o, coalesce(s.score, 0) AS score FROM prb p ASOF LEFT JOIN scr s ON p.road_id = s.road_id AND p.to_road = s.to_road AND p.sec >= s.sec),
crs AS (SELECT road_id, to_road, at_s AS sec FROM prs2 GROUP BY ALL HAVING abs(sum(CASE WHEN o < 0 THEN score END)) > 6 AND abs(sum(CASE WHEN o > 0 THEN score END)) > 6 AND sign(sum(CASE WHEN o < 0 THEN score END)) <> sign(sum(CASE WHEN o > 0 THEN score END)))"""


@query(_phases + " SELECT road_id, to_road, CAST(sec AS BIGINT) AS sec FROM crs")
def w9_phase_changes(spark, d):
    return lights.phase_changes(light_series(spark, d)[1]).select("road_id", "to_road", F.col("sec").cast("long"))


@query(_light + " SELECT road_id, to_road, cnt, round(percent, 6) AS percent FROM pri")
def agg8_light_prior(spark, d):
    return lights.prior(light_series(spark, d)[0]).select("road_id", "to_road", "cnt", F.round("percent", 6).alias("percent"))


#: Answers, by qid, for rows of a common table expression qs (qid, road_id, to_road, t, to_node).
_ANSWERS = """,
ar AS (SELECT qid, q.road_id, q.to_road, CAST(((round(t - to_node / 3) % 86400) + 86400) % 86400 AS BIGINT) AS a, percent FROM qs q JOIN pri USING (road_id, to_road) WHERE q.road_id <> q.to_road),
wide AS (SELECT road_id, to_road, sec + o AS sec FROM crs, (SELECT unnest([-86400, 0, 86400]) AS o) AS x),
pf AS (SELECT ar.*, (SELECT max(w.sec) FROM wide w WHERE w.road_id = ar.road_id AND w.to_road = ar.to_road AND w.sec BETWEEN a - 300 AND a - 1) AS past, (SELECT min(w.sec) FROM wide w WHERE w.road_id = ar.road_id AND w.to_road = ar.to_road AND w.sec BETWEEN a + 1 AND a + 300) AS ahead FROM ar),
pd AS (SELECT *, ((ahead - past) % 86400 + 86400) % 86400 AS period FROM pf),
pb AS (SELECT qid, road_id, to_road, o, f, ((at_s + o) % 86400 + 86400) % 86400 AS sec FROM (SELECT qid, road_id, to_road, a AS at_s, 1.0E0 AS f FROM pd UNION ALL SELECT qid, road_id, to_road, a - period, 0.25E0 FROM pd WHERE period IS NOT NULL UNION ALL SELECT qid, road_id, to_road, a + period, 0.25E0 FROM pd WHERE period IS NOT NULL) AS x, (SELECT unnest(range(-5, 6)) AS o) AS y),
ac AS (SELECT qid, sum(f * coalesce(score, 0) * exp(-o * o / 2.0E0) / sqrt(2 * pi())) AS acc FROM pb p ASOF LEFT JOIN scr s ON p.road_id = s.road_id AND p.to_road = s.to_road AND p.sec >= s.sec GROUP BY qid),
grn AS (SELECT q.qid, coalesce(CASE WHEN abs(acc) < 1e-9 THEN percent ELSE 1 / (1 + exp(-acc)) END, 1) AS green FROM qs q LEFT JOIN ac ON q.qid = ac.qid LEFT JOIN pri p ON p.road_id = q.road_id AND p.to_road = q.to_road)"""


@query(_phases + ", qs AS (SELECT row_number() OVER (ORDER BY traj_id, seq) AS qid, * FROM trips)" + _ANSWERS + """
SELECT q.traj_id, CAST(q.seq AS BIGINT) AS seq, round(green, 6) AS green FROM qs q JOIN grn USING (qid)""")
def lt4_light_query(spark, d):
    ok, series = light_series(spark, d)
    ok, series = stored(ok), stored(series)
    found = lights.query(view(spark, d, "trips"), series, lights.phase_changes(series), lights.prior(ok), ("traj_id", "seq"))
    return found.select("traj_id", F.col("seq").cast("long"), F.round("green", 6).alias("green"))


# ---- training rows ------------------------------------------------------------------------------------------------

_vec12 = ", ".join(f"((s.road_id * {i + 3}) % 17) / 8.0E0 - 1 AS vec{i}" for i in range(1, 13))


def given_embedding(spark, d):
    """Twelve numbers a road that follow from its id, in place of learned ones, for rows that SQL can check."""
    made = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: ((F.col("road_id") * (i + 3)) % 17) / F.lit(8.0) - 1)
    return view(spark, d, "edges").select("road_id", made.alias("vec"))


def training_rows(spark, d, embedding):
    """The rows of the speed model's matrix: samples, road vectors, and the lights' answers at each sample."""
    e, _, s = base(spark, d)
    ok, series = (stored(x) for x in light_series(spark, d))
    smp = features.samples(features.pairs(view(spark, d, "trips")))
    vec = features.road_vectors(roadnet.roads(e, s), embedding, features.road_frequency(view(spark, d, "placed")), roadnet.next_degree(e))
    return features.feature_rows(smp, vec, features.green_of(smp, series, lights.phase_changes(series), lights.prior(ok)))


@query(_phases.replace(ctes("trips"), net("trips", "placed"), 1) + ", " + _samples[len(ctes("trips", "edges")) + 2 :] + """,
freq AS (SELECT road_id, count(DISTINCT traj_id) * 100.0E0 / (SELECT count(DISTINCT traj_id) FROM placed) AS percent FROM placed GROUP BY road_id),
nx AS (SELECT a.road_id, count(b.road_id) AS n FROM edges a LEFT JOIN edges b ON a.to_node = b.from_node GROUP BY a.road_id),
qs AS (SELECT row_number() OVER (ORDER BY traj_id, seq, kind) AS qid, * FROM smp)""" + _ANSWERS + f"""
SELECT traj_id, CAST(seq AS BIGINT) AS seq, kind, {_vec12.replace("AS vec", "AS vec")}, round(coalesce(percent, 0), 6) AS vec13, CAST(level AS DOUBLE) AS vec14, round(length_m / 1000, 6) AS vec15, CAST(n AS DOUBLE) AS vec16, round(s.to_node, 4) AS "toNode",
  round(greatest(0, 1 - s.to_node / 1000 / (length_m / 1000)), 6) AS "roadRatio", round(green, 6) AS "greenProb", round(1 - abs(t - 43200) / 43200, 6) AS time, round(journey, 6) AS journey, round(vel, 6) AS vel
FROM qs s JOIN grn USING (qid) JOIN rds r ON s.road_id = r.road_id LEFT JOIN freq f ON f.road_id = s.road_id LEFT JOIN nx ON nx.road_id = s.road_id""")
def fn42_feature_rows(spark, d):
    rows = training_rows(spark, d, given_embedding(spark, d))
    plain = {"traj_id", "seq", "kind"}
    return rows.select("traj_id", F.col("seq").cast("long"), "kind", *[F.round(c, 4 if c == "toNode" else 6).alias(c) for c in rows.columns if c not in plain])


# ---- distributions ------------------------------------------------------------------------------------------------

_VALUE = "l_quantity * (0.2E0 + l_discount * 10) - 2"
_stats = f"""WITH st AS (SELECT CAST(30 + 15 * (l_linenumber % 5) AS INT) AS interval_s, ({_VALUE}) / 2 AS x FROM lineitem), va AS (SELECT * FROM st WHERE x >= 0),
bn AS (SELECT interval_s, CAST(floor(x) AS BIGINT) AS bin, count(*) AS n, sum(CASE WHEN x = 0 THEN 1 ELSE 0 END) AS z FROM va GROUP BY ALL),
cn AS (SELECT interval_s, bin, n, sum(n) OVER (PARTITION BY interval_s ORDER BY bin) AS upto, CAST(floor(sum(n) OVER (PARTITION BY interval_s) * 0.999E0) AS BIGINT) AS accept, sum(z) OVER (PARTITION BY interval_s) AS begins FROM bn),
hist AS (SELECT interval_s, bin, (least(upto, accept) - least(upto - n, accept)) / accept::DOUBLE AS share FROM cn WHERE least(upto, accept) > least(upto - n, accept)),
lim AS (SELECT interval_s, min(bin) + 1 AS up_lim FROM cn WHERE upto >= accept GROUP BY interval_s)"""


def stats(spark, d, negative=False):
    line = read(spark, d, "lineitem").select((F.lit(30) + 15 * (F.col("l_linenumber") % 5)).cast("int").alias("interval_s"), (F.col("l_quantity") * (F.lit(0.2) + F.col("l_discount") * 10) - 2).alias("value"))
    values = distributions.accepted_values(line, negative)
    return values, distributions.binned(values)


@query(_stats + " SELECT CAST(interval_s AS BIGINT) AS interval_s, bin, round(share, 8) AS share FROM hist")
def agg10_histogram(spark, d):
    return distributions.histogram(stats(spark, d)[1]).select(F.col("interval_s").cast("long"), "bin", F.round("share", 8).alias("share"))


_negative = _stats.replace(f"({_VALUE}) / 2 AS x", f"-({_VALUE}) / 2 AS x").replace("WHERE x >= 0)", "WHERE x > 0)")


@query(_negative + " SELECT CAST(interval_s AS BIGINT) AS interval_s, bin, round(share, 8) AS share FROM hist")
def fl19_negative_histogram(spark, d):
    return distributions.histogram(stats(spark, d, negative=True)[1]).select(F.col("interval_s").cast("long"), "bin", F.round("share", 8).alias("share"))


@query(_stats + """, rk AS (SELECT *, row_number() OVER (PARTITION BY interval_s ORDER BY x) - 1 AS i FROM va), ac AS (SELECT DISTINCT interval_s, accept, begins FROM cn)
SELECT CAST(r.interval_s AS BIGINT) AS interval_s, round(max(CASE WHEN i = begins + floor((accept - begins) * (0.6827E0 * 0.5E0)) THEN x END), 6) AS sig, round(max(CASE WHEN i = begins + floor((accept - begins) * ((0.9973E0 + 1) / 2)) THEN x END), 6) AS sig3,
  round(max(CASE WHEN i = begins + floor((accept - begins) * 0.75E0) THEN x END), 6) AS third FROM rk r JOIN ac a ON r.interval_s = a.interval_s GROUP BY r.interval_s""")
def agg11_seeds(spark, d):
    s = distributions.seeds(*stats(spark, d))
    return s.select(F.col("interval_s").cast("long"), *[F.round(c, 6).alias(c) for c in ("sig", "sig3", "third")])


@query(_stats + " SELECT CAST(interval_s AS BIGINT) AS interval_s, up_lim FROM lim")
def fl20_limits(spark, d):
    return distributions.limits(stats(spark, d)[1]).select(F.col("interval_s").cast("long"), "up_lim")


def _phi(x: str) -> str:
    z, t = f"(abs({x}) / sqrt(2.0E0))", f"(1 / (1 + 0.3275911E0 * (abs({x}) / sqrt(2.0E0))))"
    return f"(0.5E0 * (1 + CASE WHEN {x} < 0 THEN -1 ELSE 1 END * (1 - (((((1.061405429E0 * {t} - 1.453152027E0) * {t}) + 1.421413741E0) * {t} - 0.284496736E0) * {t} + 0.254829592E0) * {t} * exp(-{z} * {z}))))"


def _mix(x: str) -> str:
    return f"(s1 / (1 - {_phi('(0.0E0 * sig1)')}) / (sig1 * sqrt(2 * pi())) * exp(-{x} * {x} / (2 * sig1 * sig1)) + (1 - val0 - s1) / (1 - {_phi('(-mu2 / sig2)')}) / (sig2 * sqrt(2 * pi())) * exp(-({x} - mu2) * ({x} - mu2) / (2 * sig2 * sig2)))"


_GRID = "SELECT CAST(pid AS INT) AS pid, 0.05E0 + 0.05E0 * (pid % 3) AS val0, 2.0E0 + pid AS sig1, 0.3E0 + 0.1E0 * (pid % 4) AS s1, 4.0E0 + pid % 5 AS sig2, 6.0E0 + 2.0E0 * (pid % 7) AS mu2"
_loss = _stats + f""", par AS ({_GRID} FROM (SELECT unnest(range(40)) AS pid) AS p),
gr AS (SELECT l.interval_s, b.bin, coalesce(share, 0) AS share FROM lim l, LATERAL (SELECT unnest(range(up_lim + 1)) AS bin) AS b LEFT JOIN hist h ON h.interval_s = l.interval_s AND h.bin = b.bin),
es AS (SELECT interval_s, bin, share, pid, {_mix('bin')} + CASE WHEN bin = 0 THEN val0 ELSE 0 END AS est FROM gr, par),
ls AS (SELECT interval_s, pid, sum(abs(share - est / tot)) AS loss FROM (SELECT *, sum(est) OVER (PARTITION BY interval_s, pid) AS tot FROM es) AS e GROUP BY ALL)"""


def grid_losses(spark, d):
    counts = stats(spark, d)[1]
    hist, lims = stored(distributions.histogram(counts)), stored(distributions.limits(counts))
    grid = spark.sql(_GRID + " FROM (SELECT id AS pid FROM range(40)) AS p")
    return distributions.losses(hist, lims, lims.select("interval_s").join(grid))


@query(_loss + " SELECT CAST(interval_s AS BIGINT) AS interval_s, CAST(pid AS BIGINT) AS pid, round(loss, 6) AS loss FROM ls")
def agg12_losses(spark, d):
    return grid_losses(spark, d).select(F.col("interval_s").cast("long"), F.col("pid").cast("long"), F.round("loss", 6).alias("loss"))


@query(_loss + " SELECT CAST(interval_s AS BIGINT) AS interval_s, CAST(arg_min(pid, loss) AS BIGINT) AS pid, round(min(loss), 6) AS loss FROM ls GROUP BY interval_s")
def agg13_best_parameters(spark, d):
    return distributions.best(grid_losses(spark, d)).select(F.col("interval_s").cast("long"), F.col("pid").cast("long"), F.round("loss", 6).alias("loss"))


_PAR = "SELECT CAST(30 + 15 * pid AS INT) AS interval_s, 0.05E0 + 0.01E0 * pid AS val0, 3.0E0 + pid AS sig1, 0.4E0 AS s1, 5.0E0 + pid AS sig2, 8.0E0 + pid AS mu2"
_surv = f"""par AS ({_PAR} FROM (SELECT unnest(range(5)) AS pid) AS p), gd AS (SELECT interval_s, CAST(bin AS BIGINT) AS bin, val0, {_mix('bin')} AS d FROM par, (SELECT unnest(range(8192)) AS bin) AS b),
kp AS (SELECT * FROM (SELECT *, sum(CASE WHEN d < 1e-40 THEN 1 ELSE 0 END) OVER (PARTITION BY interval_s ORDER BY bin) AS gone FROM gd) AS g WHERE gone = 0 OR (gone = 1 AND d < 1e-40)),
sv AS (SELECT interval_s, bin, greatest(1e-150, sum(d + CASE WHEN bin = 0 THEN val0 ELSE 0 END) OVER (PARTITION BY interval_s ORDER BY bin DESC) / sum(d + CASE WHEN bin = 0 THEN val0 ELSE 0 END) OVER (PARTITION BY interval_s)) AS p FROM kp)"""


def survival_table(spark):
    return distributions.survival(spark.sql(_PAR + " FROM (SELECT id AS pid FROM range(5)) AS p"))


@query(f"WITH {_surv} SELECT CAST(interval_s AS BIGINT) AS interval_s, bin, round(p, 8) AS p FROM sv")
def agg14_survival(spark, d):
    return survival_table(spark).select(F.col("interval_s").cast("long"), F.col("bin").cast("long"), F.round("p", 8).alias("p"))


@query(f"""WITH {_surv}, ask AS (SELECT event_id, value * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS value, CAST(10 + event_id % 120 AS BIGINT) AS gap_s FROM events),
la AS (SELECT interval_s, max(bin) AS last FROM sv GROUP BY interval_s),
br AS (SELECT interval_s, coalesce(lead(interval_s) OVER (ORDER BY interval_s), interval_s) AS next_s FROM la),
g AS (SELECT event_id, floor(abs(value) / 2) AS b, least(greatest(gap_s, 30), 90) AS gg FROM ask),
j AS (SELECT g.event_id, g.b, g.gg, br.interval_s, br.next_s FROM g JOIN br ON gg >= interval_s AND (gg < next_s OR (interval_s = next_s AND gg = interval_s)))
SELECT event_id, round(CASE WHEN j.next_s = j.interval_s THEN l.p ELSE l.p * (j.next_s - gg) / (j.next_s - j.interval_s) + r.p * (gg - j.interval_s) / (j.next_s - j.interval_s) END, 8) AS p
FROM j JOIN la a ON a.interval_s = j.interval_s JOIN la c ON c.interval_s = j.next_s JOIN sv l ON l.interval_s = j.interval_s AND l.bin = least(b, a.last) JOIN sv r ON r.interval_s = j.next_s AND r.bin = least(b, c.last)""")
def fn22_survival_lookup(spark, d):
    asked = read(spark, d, "events").select("event_id", (F.col("value") * F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)).alias("value"), (10 + F.col("event_id") % 120).alias("gap_s"))
    return distributions.lookup(asked, stored(survival_table(spark))).select("event_id", F.round("p", 8).alias("p"))


def side_tables(spark):
    """Survival tables of given parameters for turns, for longer and for shorter ways."""
    grid = spark.sql(_PAR + " FROM (SELECT id AS pid FROM range(5)) AS p")
    return tuple(stored(distributions.survival(grid.withColumn("sig1", F.col("sig1") + k).withColumn("mu2", F.col("mu2") + 2 * k))) for k in range(3))


def _side_sql() -> str:
    """Common table expressions sv0..sv2, la, br and steps: three tables, and rows to rate."""
    tables = []
    for k in range(3):
        one = _surv.replace("par AS", f"par{k} AS").replace("FROM par,", f"FROM par{k},").replace("gd AS", f"gd{k} AS").replace("FROM gd)", f"FROM gd{k})").replace("kp AS", f"kp{k} AS").replace("FROM kp)", f"FROM kp{k})").replace("sv AS", f"sv{k} AS")
        tables.append(one.replace("3.0E0 + pid AS sig1", f"3.0E0 + pid + {k} AS sig1").replace("8.0E0 + pid AS mu2", f"8.0E0 + pid + {2 * k} AS mu2"))
    return "WITH " + ",\n".join(tables) + """, rws AS (SELECT event_id, (event_id % 63) / 20.0E0 - 1.5E0 AS turned, value * CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS detour, (event_id % 50) / 2.0E0 AS seconds, CAST(20 + event_id % 90 AS BIGINT) AS gap_s FROM events),
g AS (SELECT *, least(greatest(gap_s, 30), 90) AS gg, least(greatest(floor((gap_s - 30) / 15.0E0), 0), 4) AS i FROM rws), h AS (SELECT *, CAST(30 + 15 * i AS BIGINT) AS lo, CAST(least(45 + 15 * i, 90) AS BIGINT) AS hi FROM g)"""


def _chance_sql(k: int, value: str) -> str:
    at = lambda side: f"(SELECT s.p FROM sv{k} s WHERE s.interval_s = {side} AND s.bin = least(floor(abs({value}) / 2), (SELECT max(bin) FROM sv{k} m WHERE m.interval_s = {side})))"
    return f"(CASE WHEN lo = hi THEN {at('lo')} ELSE ({at('lo')} * (hi - gg) + {at('hi')} * (gg - lo)) / (hi - lo) END)"


def rated_steps(spark, d):
    n = F.col("event_id")
    return read(spark, d, "events").select("event_id", ((n % 63) / 20.0 - 1.5).alias("turned"), (F.col("value") * F.when(n % 3 == 0, -1).otherwise(1)).alias("detour"), ((n % 50) / 2.0).alias("seconds"), (20 + n % 90).alias("gap_s"))


@query(_side_sql() + f" SELECT event_id, round(CASE WHEN detour < 0 THEN {_chance_sql(2, 'detour')} ELSE {_chance_sql(1, 'detour')} END, 8) AS p FROM h")
def fn23_detour_chance(spark, d):
    _, longer, shorter = side_tables(spark)
    return criterion.detour_chance(rated_steps(spark, d).withColumnRenamed("detour", "value"), longer, shorter).select("event_id", F.round("p", 8).alias("p"))


@query(_side_sql() + f" SELECT event_id, round(CASE WHEN detour < 0 THEN 1 ELSE {_chance_sql(1, 'detour')} END, 8) AS p FROM h")
def fn24_search_chance(spark, d):
    _, longer, shorter = side_tables(spark)
    return criterion.detour_chance(rated_steps(spark, d).withColumnRenamed("detour", "value"), longer, shorter, searching=True).select("event_id", F.round("p", 8).alias("p"))


@query(_side_sql() + f""" SELECT event_id, round({_chance_sql(0, 'degrees(turned)')} / greatest(seconds, 1) * CASE WHEN detour < 0 THEN {_chance_sql(2, 'detour')} ELSE {_chance_sql(1, 'detour')} END, 8) AS p,
  round({_chance_sql(0, 'degrees(turned)')} / greatest(seconds, 1) * CASE WHEN detour < 0 THEN 1 ELSE {_chance_sql(1, 'detour')} END, 8) AS searched FROM h""")
def fn26_step_chance(spark, d):
    tables = side_tables(spark)
    once = criterion.step_chance(rated_steps(spark, d), *tables)
    again = criterion.step_chance(rated_steps(spark, d), *tables, searching=True)
    return once.select("event_id", F.round("p", 8).alias("p")).join(again.select("event_id", F.round("p", 8).alias("searched")), "event_id")


@query()
def ml6_fit_distributions(spark, d):
    values, counts = stats(spark, d)
    return distributions.fit(distributions.histogram(counts), distributions.limits(counts), distributions.seeds(values, counts))


# ---- matching and recovery ----------------------------------------------------------------------------------------

_states = ctes("traces") + ", ob AS (SELECT traj_id, seq, CAST(floor((lon + 8.7E0) * 10000) AS BIGINT) % 7 AS a, CAST(floor((lon + 8.7E0) * 10000) AS BIGINT) % 5 AS b FROM traces)"


def two_states(spark, d):
    """Two states a point with whole costs, and costs of 2 for a change and 3 for staying in state 1, as log scores."""
    c = F.floor((F.col("lon") + 8.7) * 10000)
    t = view(spark, d, "traces")
    states = t.select("traj_id", "seq", F.explode(F.array(F.struct(F.lit(0).alias("state"), (-(c % 7)).cast("double").alias("log_emit")), F.struct(F.lit(1).alias("state"), (-(c % 5)).cast("double").alias("log_emit")))).alias("s")).select("traj_id", "seq", "s.*")
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(-float(p)).alias("log_p")) for a, b, p in ((0, 0, 0), (0, 1, 2), (1, 0, 2), (1, 1, 3))])
    return states, t.where("seq > 0").select("traj_id", "seq", F.explode(moves).alias("m")).select("traj_id", "seq", "m.*")


@query("WITH RECURSIVE " + _states.removeprefix("WITH ") + """, vit(traj_id, seq, c0, c1) AS (SELECT traj_id, seq, a, b FROM ob WHERE seq = 0
  UNION ALL SELECT v.traj_id, o.seq, o.a + least(v.c0, v.c1 + 2), o.b + least(v.c0 + 2, v.c1 + 3) FROM vit v JOIN ob o ON o.traj_id = v.traj_id AND o.seq = v.seq + 1)
SELECT traj_id, least(c0, c1) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY seq DESC) AS rn FROM vit) AS x WHERE rn = 1""")
def gr4_viterbi_cost(spark, d):
    states, moves = two_states(spark, d)
    path = matching.viterbi(states, moves)
    lit = path.join(states, ["traj_id", "seq", "state"]).select("traj_id", "seq", "state", "log_emit")
    step = lit.select("traj_id", (F.col("seq") + 1).alias("seq"), F.col("state").alias("a")).join(lit.select("traj_id", "seq", F.col("state").alias("b")), ["traj_id", "seq"]).join(moves, ["traj_id", "seq", "a", "b"])
    total = lit.select("traj_id", F.col("log_emit").alias("x")).unionByName(step.select("traj_id", F.col("log_p").alias("x")))
    return total.groupBy("traj_id").agg((-F.sum("x")).cast("long").alias("cost"))


def network_of(spark, d):
    """Segments, roads and turns of the fixture network, stored."""
    e, _, s = base(spark, d)
    s = stored(s)
    rds = stored(roadnet.roads(e, s))
    return s, rds, stored(roadnet.turns(rds))


def matched(spark, d, criterion=None, speeds=None, points="sparse"):
    """Sparse traces matched to the network: what ``matching.solve`` gives, the points, and the segments."""
    s, rds, trns = network_of(spark, d)
    pts = view(spark, d, points)
    return matching.solve(pts, s, rds, trns, criterion, speeds), pts, s


def given_criterion(spark):
    """The criterion of sparse traces, from survival tables of given parameters, for queries; learned ones come from ``distributions.fit``."""
    table = criterion.Survival.collected(survival_table(spark))
    return criterion.Solve(table, table, table)


def given_speeds(spark, d):
    """Mean speeds by level of the dense fixture traces."""
    p = view(spark, d, "placed").join(view(spark, d, "edges").select("road_id", "level"), "road_id")
    return traces.level_speeds(p.select("level", F.lit(135.0).alias("length"), F.lit(15.0).alias("elapsed")))


def _rows_of(solved):
    found = solved.matched.select("traj_id", "seq", "road_id", F.round("to_node", 3).alias("to_node"), F.round("length", 3).alias("length"), F.round("turn", 5).alias("turn"), "path")
    return found.unionByName(solved.failures, allowMissingColumns=True)


@query()
def gr4_map_match(spark, d):
    return _rows_of(matched(spark, d)[0])


@query()
def gr4_solve_match(spark, d):
    return _rows_of(matched(spark, d, given_criterion(spark), given_speeds(spark, d))[0])


@query()
def gr2_tiled_paths(spark, d):
    """The router's answers by tiles of the network, for networks too large to send."""
    s, rds, trns = network_of(spark, d)
    pts = view(spark, d, "sparse")
    cands = stored(matching.with_turns(candidates.candidates(pts, s), s))
    found = matching.score_by_tiles(matching.transitions(cands, pts), rds, trns)
    return found.select("traj_id", "seq", "road_a", "road_b", F.round("log_p", 4).alias("log_p"), F.round("length", 3).alias("length"), F.round("turn", 5).alias("turn"))


_log_emit = "greatest(-err * err / (2 * 4.07E0 * 4.07E0) - ln(4.07E0 * sqrt(2 * pi())), ln(1e-300))"
_best_scores = (near_sql("calm") + CANDIDATES).replace("WITH ", "WITH RECURSIVE ", 1) + f""", hop AS (SELECT a.road_id AS ra, b.road_id AS rb FROM rds a JOIN rds b ON a.to_node = b.from_node),
m1 AS (SELECT ra AS s, rb AS t, 0.0E0 AS mid FROM hop),""" + ",".join(
    f" m{i} AS (SELECT s, t, min(mid) AS mid FROM (SELECT * FROM m{i - 1} UNION ALL SELECT w.s, h.rb, w.mid + r.length_m FROM m{i - 1} w JOIN rds r ON r.road_id = w.t JOIN hop h ON h.ra = w.t) AS x GROUP BY ALL)" for i in range(2, 9)
) + f""",
pt AS (SELECT traj_id, seq, ts, lat, lon, lag(seq) OVER w AS s0, lag(ts) OVER w AS t0, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM calm WINDOW w AS (PARTITION BY traj_id ORDER BY seq)),
st AS (SELECT p.traj_id, p.seq, a.road_id AS road_a, b.road_id AS road_b, ts - t0 AS span, {hav("lat0", "lon0", "lat", "lon")} AS straight, CASE WHEN a.road_id = b.road_id THEN a.to_node - b.to_node ELSE a.to_node + mid + r.length_m - b.to_node END AS length
  FROM pt p JOIN cand a ON a.traj_id = p.traj_id AND a.seq = p.s0 JOIN cand b ON b.traj_id = p.traj_id AND b.seq = p.seq JOIN rds r ON r.road_id = b.road_id LEFT JOIN m8 ON s = a.road_id AND t = b.road_id),
tr AS (SELECT traj_id, seq, road_a, road_b, CASE WHEN road_a = road_b THEN -abs(length - straight) / 2 - ln(2.0E0) ELSE greatest(-abs(length - straight) / 2 - ln(2.0E0), ln(1e-300)) END AS log_p FROM st WHERE road_a = road_b OR length < span * 40),
em AS (SELECT traj_id, seq, road_id, {_log_emit} AS e FROM cand),
vit(traj_id, seq, road_id, score) AS (SELECT traj_id, seq, road_id, e FROM em WHERE seq = 0
  UNION ALL SELECT v.traj_id, t.seq, t.road_b, max(v.score + t.log_p + m.e) FROM vit v JOIN tr t ON t.traj_id = v.traj_id AND t.seq = v.seq + 1 AND t.road_a = v.road_id JOIN em m ON m.traj_id = t.traj_id AND m.seq = t.seq AND m.road_id = t.road_b GROUP BY v.traj_id, t.seq, t.road_b),
whole AS (SELECT traj_id FROM calm EXCEPT SELECT traj_id FROM (SELECT traj_id, seq FROM calm EXCEPT SELECT traj_id, seq FROM cand) AS b)"""


@query(_best_scores + """
SELECT v.traj_id, round(max(score), 3) AS score FROM vit v JOIN whole USING (traj_id) JOIN (SELECT traj_id, max(seq) AS n FROM calm GROUP BY traj_id) AS l ON l.traj_id = v.traj_id AND v.seq = n GROUP BY v.traj_id""")
def gr4_match_score(spark, d):
    """Log probability of each trace's best sequence, given the search for ways: what emissions and steps of the matched points add up to."""
    found = matched(spark, d, points="calm")[0].matched
    return found.groupBy("traj_id").agg(F.round(F.sum(F.col("log_emit") + F.coalesce("log_p", F.lit(0.0))), 3).alias("score"))


@query()
def gr6_even_recovery(spark, d):
    solved, pts, s = matched(spark, d, given_criterion(spark), given_speeds(spark, d))
    dense = recovery.recover(recovery.steps_of(solved.matched, pts), solved.net)
    return roadnet.located(dense, s).select("traj_id", "ts", "road_id", F.round("to_node", 3).alias("to_node"), F.round("at_lat", 7).alias("lat"), F.round("at_lon", 7).alias("lon"), "observed")


def learned_embedding(spark, d):
    seqs = view(spark, d, "placed").groupBy("traj_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "road_id"))), lambda x: x["road_id"]).alias("roads"))
    return speed_model.embed_roads(seqs.select("roads"))


def model_rows(spark, d, embedding):
    """x, y and the fold (a fifth of the samples is held out), with a learned embedding."""
    f = training_rows(spark, d, embedding)
    return stored(f.select(F.array(*features.NAMES).alias("x"), F.col("vel").alias("y"), F.pmod(F.xxhash64("traj_id", "seq"), F.lit(5)).alias("fold")))


_trained: dict = {}


def trained(spark, d):
    """The speed model of a folder of tables, by three rounds of up to fifty epochs, its losses, its rows and the embedding in them; kept for the session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _trained:
        embedding = stored(learned_embedding(spark, d))
        rows = model_rows(spark, d, embedding)
        _trained[key] = (*speed_model.train(rows.where("fold <> 0"), rows.where("fold = 0")), rows, embedding)
    return _trained[key]


@query()
def gr5_model_recovery(spark, d):
    solved, pts, _ = matched(spark, d, given_criterion(spark), given_speeds(spark, d))
    model, _, _, embedding = trained(spark, d)
    ok, series = (stored(x) for x in light_series(spark, d))
    light = lights.LightTable.collected(series, lights.phase_changes(series), lights.prior(ok))
    e, _, s = base(spark, d)
    vec = features.road_vectors(roadnet.roads(e, s), embedding, features.road_frequency(view(spark, d, "placed")), roadnet.next_degree(e))
    predict = recovery.speed_predictor(model, solved.net, features.vector_array(vec, solved.net.ids), light)
    dense = recovery.recover(recovery.steps_of(solved.matched, pts), solved.net, predict)
    return dense.select("traj_id", "ts", "road_id", F.round("to_node", 3).alias("to_node"), "observed")


@query()
def ml1_road_embedding(spark, d):
    vec = learned_embedding(spark, d)
    return features.id_range(vec.select("road_id", "vec"), 12).select("road_id", F.size("vec").alias("width"), F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x).alias("norm2"))


@query()
def ml2_speed_model(spark, d):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(trained(spark, d)[1])], "epoch int, loss double")


@query()
def ml5_infer(spark, d):
    model, _, rows, _ = trained(spark, d)
    return speed_model.infer(rows.select("x", "y"), model).select("y", "predicted")


@query()
def gr7_matched_statistics(spark, d):
    solved, pts, _ = matched(spark, d)
    steps = solved.matched.join(pts.select("traj_id", "seq", "lat", "lon"), ["traj_id", "seq"])
    steps = steps.select("traj_id", "seq", "lat", "lon", F.coalesce("turn", F.lit(0.0)).alias("angle"), F.coalesce("length", F.lit(0.0)).alias("length"))
    t = traces.trailing(steps)
    return t.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs("turned")), 6).alias("mean_turn"), F.round(F.avg("detour"), 4).alias("mean_detour"))


# ---- rating -------------------------------------------------------------------------------------------------------


def truth_and_found(spark, d):
    """Truth and a shifted copy with some other roads, of all traces."""
    p = view(spark, d, "placed").select("traj_id", "seq", "road_id")
    t = view(spark, d, "traces").join(p, ["traj_id", "seq"])
    f = t.where("NOT (traj_id % 6 = 5 AND seq = 3)").select("traj_id", "seq", (F.col("lat") + 0.0001 * (F.col("seq") % 3)).alias("lat"), "lon", (F.col("road_id") + F.when(F.col("seq") % 4 == 0, 1).otherwise(0)).alias("road_id"))
    return t, f


_rate = ctes("traces", "placed") + """, tr AS (SELECT t.traj_id, t.seq, lat, lon, road_id FROM traces t JOIN placed p ON t.traj_id = p.traj_id AND t.seq = p.seq),
fo AS (SELECT traj_id, seq, lat + 0.0001E0 * (seq % 3) AS lat, lon, road_id + CASE WHEN seq % 4 = 0 THEN 1 ELSE 0 END AS road_id FROM tr WHERE NOT (traj_id % 6 = 5 AND seq = 3))"""


@query(_rate + f""", pr AS (SELECT a.traj_id, {hav("a.lat", "a.lon", "b.lat", "b.lon")} AS dist, a.road_id = b.road_id AS same FROM tr a JOIN fo b ON a.traj_id = b.traj_id AND a.seq = b.seq WHERE a.traj_id % 6 <> 5 OR (SELECT max(seq) FROM tr z WHERE z.traj_id = a.traj_id) < 3)
SELECT traj_id, round(avg(dist), 4) AS mae, round(sqrt(avg(dist * dist)), 4) AS rmse, round(avg(CASE WHEN same THEN 1.0E0 ELSE 0.0E0 END), 6) AS accuracy, CAST(sum(CASE WHEN dist > 5000 THEN 1 ELSE 0 END) AS BIGINT) AS n_far FROM pr GROUP BY traj_id""")
def agg15_trace_errors(spark, d):
    e = rating.trace_errors(rating.paired(*truth_and_found(spark, d)))
    return e.select("traj_id", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("accuracy", 6).alias("accuracy"), "n_far")


@query(_rate + " SELECT a.traj_id, n_truth, n_found FROM (SELECT traj_id, count(*) AS n_truth FROM tr GROUP BY traj_id) AS a JOIN (SELECT traj_id, count(*) AS n_found FROM fo GROUP BY traj_id) AS b ON a.traj_id = b.traj_id WHERE n_truth <> n_found")
def jn13_uneven_traces(spark, d):
    return rating.uneven(*truth_and_found(spark, d))


@query("SELECT traj_id, count(*) AS n, count(*) FILTER (d IS NULL) AS skipped, round(avg(d), 4) AS rn_mae, round(sqrt(avg(d * d)), 4) AS rn_rmse FROM (SELECT l_orderkey AS traj_id, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE least(l_quantity, l_tax * 1000) END AS d FROM lineitem) AS x GROUP BY traj_id")
def agg16_network_errors(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("traj_id"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity")).alias("there"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_tax") * 1000).alias("back"))
    n = x.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"))
    return rating.network_errors(x).join(n, "traj_id").select("traj_id", "n", "skipped", F.round("rn_mae", 4).alias("rn_mae"), F.round("rn_rmse", 4).alias("rn_rmse"))


def sequences(spark, d):
    s = view(spark, d, "sequences")
    order = lambda c: F.transform(F.array_sort(c), lambda x: x["road_id"])
    return s.groupBy("traj_id").agg(order(F.collect_list(F.struct("r", "road_id"))).alias("truth"), order(F.collect_list(F.when(F.col("kept"), F.struct("place", "r", "road_id")))).alias("found"))


def weight(x):
    return x + F.lit(100.0)


_seqs = ctes("sequences") + """, sq AS (SELECT traj_id, list(road_id ORDER BY r) AS a, coalesce(list(road_id ORDER BY place, r) FILTER (kept), []) AS b FROM sequences GROUP BY traj_id),
lc AS (SELECT *, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE list_extract(list_reduce(a, lambda row, x: list_reduce(range(1, len(b) + 1), lambda cur, j: list_append(cur, CASE WHEN b[CAST(j AS BIGINT)] = x THEN row[CAST(j AS BIGINT)] + x + 100 ELSE greatest(row[CAST(j AS BIGINT) + 1], cur[CAST(j AS BIGINT)]) END), [0.0E0]), list_transform(range(len(b) + 1), lambda i: 0.0E0)), len(b) + 1) END AS shared,
  list_sum(list_transform(a, lambda x: x + 100.0E0)) AS la, coalesce(list_sum(list_transform(b, lambda x: x + 100.0E0)), 0) AS lb FROM (SELECT traj_id, list_transform(a, lambda x: x::DOUBLE) AS a, list_transform(b, lambda x: x::DOUBLE) AS b FROM sq) AS s)"""


@query(_seqs + " SELECT traj_id, round(shared, 3) AS shared FROM lc")
def seq1_weighted_lcs(spark, d):
    return sequences(spark, d).select("traj_id", F.round(rating.weighted_lcs(F.col("truth"), F.col("found"), weight), 3).alias("shared"))


_scores = _seqs + ", sc AS (SELECT traj_id, shared, coalesce(shared / nullif(la, 0), 0) AS recall, coalesce(shared / nullif(lb, 0), 0) AS prec FROM lc)"


@query(_scores + " SELECT traj_id, round(shared, 3) AS shared, round(recall, 6) AS recall, round(prec, 6) AS precision, round(coalesce(2 * recall * prec / nullif(recall + prec, 0), 0), 6) AS f1 FROM sc")
def agg17_sequence_scores(spark, d):
    s = rating.sequence_scores(sequences(spark, d), weight)
    return s.select("traj_id", F.round("shared", 3).alias("shared"), *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


@query(ctes("sequences") + " SELECT traj_id, string_agg(x::VARCHAR, ' ' ORDER BY r) AS roads FROM (SELECT traj_id, r, road_id % 3 AS x, lag(road_id % 3) OVER (PARTITION BY traj_id ORDER BY r) AS b FROM sequences) AS s WHERE b IS NULL OR b <> x GROUP BY traj_id")
def arr2_without_repeats(spark, d):
    s = sequences(spark, d).select("traj_id", F.transform("truth", lambda x: x % 3).alias("x"))
    return s.select("traj_id", F.array_join(rating.without_repeats(F.col("x")).cast("array<string>"), " ").alias("roads"))


@query(ctes("placed") + " SELECT traj_id, count(DISTINCT road_id) AS n_roads FROM placed GROUP BY traj_id")
def set2_distinct_roads(spark, d):
    return view(spark, d, "placed").select("traj_id", "road_id").distinct().groupBy("traj_id").agg(F.count(F.lit(1)).alias("n_roads"))


assert not QUERIES.keys() & _NETWORK.keys()
