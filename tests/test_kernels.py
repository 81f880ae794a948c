"""Kernels against brute force, and properties that must hold."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.fixtures import view
from tracewright.functions import geo
from tracewright.operators import candidates, criterion, distributions, features, lights, matching, rating, recovery, roadnet, routing, speed_model


@pytest.fixture(scope="module")
def net(spark, sf_dir):
    segs = roadnet.segments(view(spark, sf_dir, "points"))
    rds = roadnet.roads(view(spark, sf_dir, "edges"), segs)
    return routing.network(rds, roadnet.turns(rds))


def test_sums_of_segments(spark, sf_dir):
    segs = roadnet.segments(view(spark, sf_dir, "points")).toPandas()
    for _, s in segs.groupby("road_id"):
        s = s.sort_values("seg_id")
        assert s.sum_prev.iloc[-1] == pytest.approx(s.sum_after.iloc[0])
        assert s.cum_angle.iloc[0] == 0


def test_right_angle_and_repeated_point(spark):
    pts = spark.createDataFrame([(1, 0, 41.0, -8.0), (1, 1, 41.001, -8.0), (1, 2, 41.001, -8.0), (1, 3, 41.001, -7.999), (2, 0, 41.0, -8.0)], "road_id int, pos int, lat double, lon double")
    segs = roadnet.segments(pts).orderBy("seg_id").collect()
    assert [r.seg_id for r in segs] == [0, 1]
    assert segs[1].cum_angle == pytest.approx(math.pi / 2, abs=1e-3)


def test_compat_bearing_keeps_distance(spark):
    df = spark.createDataFrame([(41.15, -8.6)], "lat double, lon double")
    for compat in (False, True):
        r = geo.with_planar(df, "p", "lat", "lon", 41.14, -8.61, compat).select(F.sqrt(F.col("p_x") ** 2 + F.col("p_y") ** 2).alias("d"), geo.haversine_m("lat", "lon", 41.14, -8.61).alias("h")).first()
        assert r.d == pytest.approx(r.h)


def test_location_of_a_position(spark):
    lens = [10.0] * 5
    rows = [(1, i, 0.0, float(i), 0.0, float(i + 1), 10.0, 10.0 * (5 - i), 0.0) for i in range(len(lens))]
    segs = spark.createDataFrame(rows, "road_id int, seg_id int, s_lat double, s_lon double, e_lat double, e_lon double, len double, sum_after double, cum_angle double")
    asked = spark.createDataFrame([(1, 5.0), (1, 15.0), (1, 50.0), (1, 60.0), (1, 0.0)], "road_id int, to_node double")
    assert {r.to_node: r.seg_id for r in roadnet.located(asked, segs).collect()} == {5.0: 4, 15.0: 3, 50.0: 0, 60.0: 0, 0.0: 4}


def test_network_distance_by_all_paths(net):
    n, rng = len(net.ids), random.Random(2)

    def brute(a, b, left, into):
        if a == b:
            return abs(left - (net.length[b] - into))
        best, stack = float("inf"), [(a, 0.0, (a,))]
        while stack:
            x, d, seen = stack.pop()
            for y in net.after(x).tolist():
                if y == b:
                    best = min(best, d + left + into)
                elif y not in seen and len(seen) < 12:
                    stack.append((y, d + net.length[y], (*seen, y)))
        return best

    for _ in range(25):
        a, b = rng.randrange(n), rng.randrange(n)
        assert routing.way(net, a, b, 30.0, 20.0) == pytest.approx(brute(a, b, 30.0, 20.0))


def turn_of(net, path, q):
    """Turn of a whole path by its definition: rest of the first road, bends between roads of 15 m or more, whole roads, part of the last."""
    at = net.number(np.array(path)).tolist()
    turn = net.own_turn[at[0]] - q.turned_a
    long = [i for i in at if net.length[i] >= 15]
    for a, b in itertools.pairwise(long):
        k = net.start[a] + net.after(a).tolist().index(b) if b in net.after(a).tolist() and at.index(b) == at.index(a) + 1 else None
        turn += net.turn[k] if k is not None else routing.distant_turn(net, a, b)
    return turn + sum(net.own_turn[i] for i in at[1:-1]) + q.turned_b


def grid(short: bool):
    """A small network as arrays: nodes of a 3 by 3 grid, roads of 100 m both ways; ``short`` puts a road of 10 m into the first crossing."""
    import pandas as pd

    place = {n: (41.0 + 0.0009 * (n // 3), -8.0 + 0.0012 * (n % 3)) for n in range(9)}
    pairs = [(a, b) for a in range(9) for b in range(9) if a != b and abs(a // 3 - b // 3) + abs(a % 3 - b % 3) == 1]
    if short:
        place[9] = (place[4][0] + 0.00009, place[4][1])
        pairs = [(9 if a == 4 and b == 7 else a, b) for a, b in pairs] + [(4, 9)]
    metres = lambda a, b: float(routing.metres(*place[a], *place[b]))
    rows = pd.DataFrame([{"road_id": 10 * a + b, "level": 0, "length_m": metres(a, b), "turned": 0.1 * ((a + b) % 3), **{f"{w}_{c}": v for w in ("first", "last") for c, v in zip(("s_lat", "s_lon", "e_lat", "e_lon"), (*place[a], *place[b]), strict=True)}} for a, b in sorted(pairs)])
    ids = rows.road_id.tolist()
    follow = pd.DataFrame([(x, y, 0.0) for x in ids for y in ids if x % 10 == y // 10], columns=["road_a", "road_b", "turn"])
    net = routing.assembled(rows, follow, np.ones(7))
    net.turn = np.array([routing.distant_turn(net, a, int(b)) for a in range(len(ids)) for b in net.after(a)])  # roads that touch turn by the same rule
    return net


def all_paths(net, a, b, most):
    """Every way from road a to road b that enters no road twice and has at most so many roads."""
    stack = [(a,)]
    while stack:
        p = stack.pop()
        for y in net.after(p[-1]).tolist():
            if y == b:
                yield (*p, y)
            elif y not in p and len(p) < most:
                stack.append((*p, y))


@pytest.mark.parametrize("short", [False, True])
def test_best_path_by_all_paths(short):
    """On a grid the best-rated way is the least, in metres or in a rating that falls along the way; its turn is that of its roads."""
    net, rng = grid(short), random.Random(6)
    falling = criterion.Survival(np.array([15, 600]), [np.exp(-np.arange(2000) / 60.0)] * 2)
    flat = criterion.Survival(np.array([15, 600]), [np.ones(3)] * 2)
    seen_short = 0
    for _ in range(40):
        a, b = rng.sample(range(len(net.ids)), 2)
        left_a, left_b = rng.uniform(0, net.length[a]), rng.uniform(0, net.length[b])
        p0 = tuple(net.last[a, 2:] + (net.last[a, :2] - net.last[a, 2:]) * left_a / net.length[a])
        p1 = tuple(net.last[b, 2:] + (net.last[b, :2] - net.last[b, 2:]) * left_b / net.length[b])
        q = routing.Question(left_a, left_b, 0.03, 0.05, p0, p1, 60.0)
        straight = float(routing.metres(*p0, *p1))
        length = lambda p: left_a + sum(net.length[i] for i in p[1:-1]) + net.length[p[-1]] - left_b  # noqa: B023, E731
        ways = [p for p in all_paths(net, a, b, 7) if length(p) < 60 * 40]
        for c in (criterion.Preprocess(), criterion.Solve(flat, falling, falling)):
            score, metres, turn, path = routing.best_path(net, a, b, q, c)
            at = net.number(np.array(path)).tolist()
            assert metres == pytest.approx(length(at)) and metres == pytest.approx(min(map(length, ways)))
            assert turn == pytest.approx(turn_of(net, path, q))
            assert score == pytest.approx(c.rate(metres - straight, turn, metres, 60.0, True))
            seen_short += 49 in path
            worse = routing.best_path(net, a, b, q, c, floor=score * 1.01)
            assert worse is None or worse[0] >= score
    assert seen_short or not short


def test_turn_over_a_short_road_is_that_of_the_long_ones():
    net = grid(True)
    n = lambda road: int(net.number(np.array([road]))[0])
    q = routing.Question(50.0, 20.0, 0.0, 0.0, tuple(net.last[n(14), :2]), tuple(net.last[n(97), 2:]), 60.0)
    found = routing.best_path(net, n(14), n(97), q, criterion.Preprocess())
    assert found[3] == [14, 49, 97]
    assert found[2] == pytest.approx(net.own_turn[n(14)] + net.own_turn[n(49)] + routing.distant_turn(net, n(14), n(97)))


def test_tiles_give_what_the_whole_network_gives(spark, sf_dir):
    segs = roadnet.segments(view(spark, sf_dir, "points"))
    rds = roadnet.roads(view(spark, sf_dir, "edges"), segs)
    trns = roadnet.turns(rds)
    pts = view(spark, sf_dir, "sparse").where("traj_id < 4")
    trans = matching.transitions(matching.with_turns(candidates.candidates(pts, segs), segs), pts)
    key = lambda df: sorted((r.traj_id, r.seq, r.road_a, r.road_b, round(r.log_p, 6), round(r.length, 4), round(r.turn, 6)) for r in df.collect())
    whole = key(matching.score_transitions(trans, routing.network(rds, trns)))
    assert whole and key(matching.score_by_tiles(trans, rds, trns, group_rows=50)) == whole


def test_step_chance_in_both_forms(spark):
    par = "interval_s int, val0 double, sig1 double, s1 double, sig2 double, mu2 double"
    tables = [distributions.survival(spark.createDataFrame([(30, 0.1, 4.0 + k, 0.5, 5.0, 15.0), (60, 0.2, 6.0, 0.4, 5.0 + k, 20.0)], par)) for k in range(3)]
    c = criterion.Solve(*[criterion.Survival.collected(t) for t in tables])
    rows = [(t / 3, d * 7.5, s, g) for t in (-2, 0, 4) for d in (-9, -1, 0, 3, 40) for s in (0.2, 20.0) for g in (15, 30, 44, 60, 90)]
    asked = spark.createDataFrame(rows, "turned double, detour double, seconds double, gap_s int")
    for searching in (False, True):
        for r in criterion.step_chance(asked, *tables, searching=searching).collect():
            assert r.p == pytest.approx(c.rate(r.detour, r.turned, r.seconds, r.gap_s, searching))


def test_groups_decode_like_single_traces():
    import pandas as pd

    rng = random.Random(9)
    states, moves, want = [], [], {}
    for traj in range(40):
        steps = rng.randint(1, 6)
        emit = [{s: -rng.randint(0, 3) * 1.0 for s in rng.sample(range(1, 5), rng.randint(1, 4))} for _ in range(steps)]
        trans = [{}] + [{(a, b): -rng.randint(0, 3) * 1.0 for a in emit[i] for b in emit[i + 1] if rng.random() < 0.7} for i in range(steps - 1)]
        emit = [dict(sorted(e.items())) for e in emit]
        want[traj] = matching.decode(emit, trans)
        states += [(traj, 3 * i, s, v) for i, e in enumerate(emit) for s, v in e.items()]
        moves += [(traj, 3 * i, a, b, v) for i, t in enumerate(trans) for (a, b), v in t.items()]
    rng.shuffle(states)
    rng.shuffle(moves)
    got = matching.decode_group(pd.DataFrame(states, columns=["traj_id", "seq", "state", "log_emit"]), pd.DataFrame(moves, columns=["traj_id", "seq", "a", "b", "log_p"]))
    for traj, (path, broken) in want.items():
        own = got[got.traj_id == traj].sort_values("seq")
        if broken is None:
            assert own.state.tolist() == path and own.reason.isna().all()
        else:
            assert own.seq.tolist() == [3 * broken] and own.reason.notna().all()
    assert {b is None for _, b in want.values()} == {True, False}


def test_lights_and_training_rows_are_served_as_trained(spark, sf_dir):
    """What a worker computes for a place and time, chance of green and all 21 inputs, is what the training rows hold."""
    from tracewright.plans import learning

    segs = roadnet.segments(view(spark, sf_dir, "points"))
    rds = roadnet.roads(view(spark, sf_dir, "edges"), segs)
    net = routing.network(rds)
    ok, series = learning.light_series(spark, sf_dir)
    changes, priors = lights.phase_changes(series), lights.prior(ok)
    light = lights.LightTable.collected(series, changes, priors)
    smp = features.samples(features.pairs(view(spark, sf_dir, "trips"))).cache()
    green = {(r.traj_id, r.seq, r.kind): r.green for r in features.green_of(smp, series, changes, priors).collect()}
    rows = smp.toPandas()
    ours = light.green(rows.road_id, rows.to_road, rows.t, rows.to_node)
    assert [green[k] for k in zip(rows.traj_id, rows.seq, rows.kind, strict=True)] == pytest.approx(ours.tolist())
    assert len(set(np.round(ours, 6))) > 2
    vec = features.road_vectors(rds, learning.given_embedding(spark, sf_dir), features.road_frequency(view(spark, sf_dir, "placed")), roadnet.next_degree(view(spark, sf_dir, "edges")))
    at = net.number(rows.road_id.to_numpy())
    served = features.assembled(features.vector_array(vec, net.ids), at, rows.to_node.to_numpy(), ours, rows.t.to_numpy(), rows.journey.to_numpy())
    trained = learning.training_rows(spark, sf_dir, learning.given_embedding(spark, sf_dir)).toPandas()
    held = {(r.traj_id, r.seq, r.kind): [getattr(r, n) for n in features.NAMES] for r in trained.itertuples(index=False)}
    inside = [i for i, k in enumerate(zip(rows.traj_id, rows.seq, rows.kind, strict=True)) if k in held]
    assert inside
    for i in inside:
        assert served[i].tolist() == pytest.approx(held[rows.traj_id[i], rows.seq[i], rows.kind[i]])


def test_decoding_by_all_sequences():
    rng = random.Random(4)
    for _ in range(30):
        steps, states = rng.randint(1, 5), [1, 2, 3]
        emit = [{s: -rng.random() for s in states} for _ in range(steps)]
        trans = [{}] + [{(a, b): -rng.random() for a in states for b in states if rng.random() < 0.8} for _ in range(steps - 1)]
        path, broken = matching.decode(emit, trans)
        scores = {}
        for seq in itertools.product(states, repeat=steps):
            if all((a, b) in trans[i + 1] for i, (a, b) in enumerate(itertools.pairwise(seq))):
                scores[seq] = sum(emit[i][s] for i, s in enumerate(seq)) + sum(trans[i + 1][p] for i, p in enumerate(itertools.pairwise(seq)))
        if broken is None:
            assert scores[tuple(path)] == pytest.approx(max(scores.values()))
        else:
            assert not scores


def test_common_subsequence():
    assert rating.lcs_of([1, 2, 3, 4], [2, 4, 3], float) == (6.0, [2, 4])
    rng = random.Random(1)
    for _ in range(40):
        a, b = ([rng.randint(1, 4) for _ in range(rng.randint(0, 6))] for _ in range(2))
        subs = lambda s: {c for n in range(len(s) + 1) for c in itertools.combinations(s, n)}
        weight, own = rating.lcs_of(a, b, float)
        assert weight == rating.lcs_weight(np.array(a), np.array(b), np.array(a, float))
        assert weight == max(sum(c) for c in subs(a) & subs(b)) == sum(own)


def test_light_intervals_by_the_sequential_rules(spark):
    """The windows against a walk over rows with two flags."""
    rng, rows = random.Random(8), []
    for trip in range(60):
        road, left, t = rng.randint(1, 3), 220.0, rng.choice([100.0, 86_350.0])
        for seq in range(12):
            to = road if rng.random() < 0.05 else road + 10
            rows.append((trip, seq, road, to, t % 86400, left, 15.0))
            t += 15
            left -= rng.choice([0.0, 2.0, 40.0, 90.0])
            if left <= 0:
                road, left = rng.randint(1, 3), 220.0
    want, last, stopped, recovered = [], None, False, False
    for trip, _, road, to, t, left, e in rows:
        if last and trip == last[0] and road != to:
            bias = last[4] / 3
            if road != last[1]:
                mid = (last[3] - bias + t + (86400 if t < last[3] else 0)) / 2
                if stopped:
                    want.append((last[1], last[2], last[3] - bias, t, 2))
                elif last[4] / last[5] < 1:
                    want += [(last[1], last[2], last[3] - bias, mid, -2), (last[1], last[2], mid, t, 2)]
                else:
                    want.append((last[1], last[2], last[3] + last[5] / 2, t, 2))
                stopped = recovered = False
            else:
                v = (last[4] - left) / last[5]
                if v >= -1 and left <= 200:
                    if v < 1:
                        stopped, recovered = True, False
                        want.append((road, to, last[3] - bias, t - int(left / 3), -1))
                    elif stopped or recovered:
                        stopped, recovered = False, True
                        want.append((road, to, last[3] - bias, t - int(left / 3), 1))
        else:
            stopped = recovered = False
        last = (trip, road, to, t, left, e)
    df = spark.createDataFrame(rows, "traj_id int, seq int, road_id int, to_road int, t double, to_node double, elapsed double")
    got = [tuple(r) for r in lights.intervals(df).collect()]
    key = lambda x: tuple(round(float(v), 6) for v in x)
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_fit_finds_a_known_mixture():
    p = np.array([0.1, 4.0, 0.5, 5.0, 15.0])
    share = distributions.curve(p[None], 60)[0]
    found, loss = distributions.fit_one(share, np.array([0.15, 5.0, 0.4, 4.0, 12.0]))
    assert loss < 0.05


def test_fit_is_no_worse_than_a_grid_of_all_five():
    rng = np.random.default_rng(3)
    for p in ((0.1, 4.0, 0.5, 5.0, 15.0), (0.3, 2.0, 0.3, 8.0, 20.0), (0.05, 6.0, 0.6, 3.0, 9.0)):
        share = distributions.curve(np.array([p]), 50)[0] * rng.uniform(0.9, 1.1, 50)
        share /= share.sum()
        start = np.array(p) * rng.uniform(0.7, 1.3, 5)
        steps = start / distributions.WIDTH
        grid = np.array([start + steps * np.array(o) for o in itertools.product((-4, -2, 0, 2, 4), repeat=5)])
        grid = grid[(grid > 1e-10).all(1) & (grid[:, 0] < 1) & (grid[:, 0] + grid[:, 2] < 1)]
        least = np.abs(distributions.curve(grid, 50) - share).sum(1).min()
        assert distributions.fit_one(share, start)[1] <= least + 1e-9


def test_survival_starts_at_one_and_falls(spark):
    par = spark.createDataFrame([(30, 0.1, 4.0, 0.5, 5.0, 15.0)], "interval_s int, val0 double, sig1 double, s1 double, sig2 double, mu2 double")
    p = [r.p for r in distributions.survival(par).orderBy("bin").collect()]
    assert p[0] == pytest.approx(1) and all(a >= b for a, b in itertools.pairwise(p))


def test_recovery_keeps_observed_points(net):
    import pandas as pd

    a = 0
    b = int(net.after(a)[0])
    steps = pd.DataFrame([{"traj_id": 1, "seq": 1, "t0": 100, "t1": 160, "path": [int(net.ids[a]), int(net.ids[b])], "left_a": 80.0, "left_b": net.length[b] - 40.0, "done": 0.0, "whole": 120.0}])
    predict = lambda road, nxt, left, time, journey: np.full(len(road), 3.0)
    for pieces in (recovery.even(net, steps), recovery.simulate(net, steps, predict)):
        assert sum(pieces[0][0]) == pytest.approx(120.0) and sum(pieces[0][1]) == pytest.approx(60.0)
        rows = recovery.resample(net, next(steps.itertuples(index=False)), *pieces[0])
        assert [r[1] for r in rows] == [115, 130, 145, 160] and rows[-1][4]
        assert rows[0][3] == pytest.approx(50.0, abs=1.5) and rows[1][3] == pytest.approx(20.0, abs=3)


def test_gradients():
    m = speed_model.Perceptron(3, (5, 4))
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(7, 3)), rng.normal(size=7)
    grads, _ = m.gradients(x, y)
    flat, g = m.flat(), np.concatenate([a.ravel() for a in grads])
    order = np.concatenate([a.ravel() for a in grads])
    assert len(order) == len(flat)
    for i in range(0, len(flat), 5):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (m.load(up).gradients(x, y)[1] - m.load(down).gradients(x, y)[1]) / 2e-6
        m.load(flat)
        assert g[i] == pytest.approx(slope, abs=1e-4)


def test_training_learns(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    rows = spark.createDataFrame([([float(v) for v in a], float(2 * a[0] - a[1])) for a in x], "x array<double>, y double").repartition(3)
    model, history = speed_model.train(rows, rows, rounds=1, epochs=12, layers=(16,), size_of_batch=50)
    assert min(history) < 0.5 * history[0] or min(history) < 0.5
    speed_model.save(spark, model, str(tmp_path / "model"))
    assert np.allclose(speed_model.load(spark, str(tmp_path / "model")).predict(x), model.predict(x))
    assert speed_model.infer(rows, model).agg(F.min("predicted")).first()[0] >= 0.01


def test_early_stop():
    assert not speed_model.stops([5, 4, 3, 2, 1, 0.9, 0.8])
    assert speed_model.stops([1, 1, 1, 2, 2, 2, 2, 2])
    assert not speed_model.stops([9, 8, 7, 6, 5, 4, 3, 2])


def test_near_roads_enters_segments_where_positions_are(spark):
    """A long chain of roads and positions at its begin: what is met is not dealt again by road, and equal positions count alike."""
    step = 0.004
    segs = spark.createDataFrame([(i, 0, 41.0 + step * i, -8.7, 41.0 + step * (i + 1), -8.7, 444.8) for i in range(400)], "road_id long, seg_id int, s_lat double, s_lon double, e_lat double, e_lon double, sum_after double")
    points = spark.createDataFrame([(t, q, 41.0 + step * (q + 0.5), -8.7) for t in range(3) for q in range(5)], "traj_id long, seq int, lat double, lon double")
    plan = candidates.near_roads(points, segs, 960, broadcast_rows=100)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [cx#" in line and "Inner" in line]
    assert len(joins) == 1 and "BroadcastHashJoin" in joins[0]
    rings = candidates.ring_counts(points, segs, broadcast_rows=100).collect()
    assert len({(r.traj_id, r.seq) for r in rings}) == 15
    for r in rings:
        far = [max(0.0, abs(i - r.seq) - 0.5) * step * candidates.METRES_A_DEGREE for i in range(400)]
        assert r.n_roads == sum(max(1, -(-f // 60)) == r.ring for f in far if f <= 960)
    assert sorted(map(tuple, rings)) == sorted(map(tuple, candidates.ring_counts(points, segs, broadcast_rows=0).collect()))


def test_single_precision_steps_agree():
    rng = np.random.default_rng(4)
    m, x, y = speed_model.Perceptron(5, (8, 4), seed=2), rng.normal(size=(64, 5)), rng.normal(size=64)
    (grads, loss), (small, near) = m.gradients(x, y), m.single().gradients(x.astype(np.float32), y.astype(np.float32))
    assert near == pytest.approx(loss, rel=1e-5) and all(b.dtype == np.float32 and np.allclose(a, b, rtol=1e-3, atol=1e-5) for a, b in zip(grads, small, strict=True))


def test_packed_blocks_hold_every_row_once(spark):
    """Rows of uneven parts, some without rows, come back standardised and whole, dealt evenly; a held row never trains."""
    n = 5000
    rows = spark.range(n).repartition(7).select(F.array(F.col("id").cast("double"), F.lit(3.0)).alias("x"), (F.col("id") % 9).cast("double").alias("y"), (F.col("id") % 5 == 0).alias("held")).where("x[0] < 4900")
    m = speed_model.Perceptron(2, (4,))
    m.mean, m.scale = np.array([2500.0, 3.0]), np.array([1000.0, 1.0])
    blocks = speed_model.packed(rows, m, 3)
    files = blocks.select(F.input_file_name().alias("f"), F.length("y").alias("n")).groupBy("f").agg(F.sum("n")).collect()
    assert len(files) == 3
    found = []
    for r in blocks.collect():
        y = np.frombuffer(r.y, np.float32)
        x = np.frombuffer(r.x, np.float32).reshape(len(y), 2)
        assert len(y) <= speed_model.BLOCK and (x[:, 1] == 0).all()
        ids = np.rint(x[:, 0].astype(float) * 1000 + 2500).astype(int)
        assert (ids % 9 == y).all() and ((ids % 5 == 0) == r.held).all()
        found += ids.tolist()
    assert sorted(found) == list(range(4900))
    _, _, off = speed_model.epoch(blocks, m, 1e-3, 0)
    held = np.arange(0, 4900, 5)
    expected = ((m.predict(np.column_stack([held, np.full(len(held), 3)])) - held % 9) ** 2).mean()
    assert off == pytest.approx(expected, rel=1e-4) and speed_model.validate(blocks, m) == pytest.approx(expected, rel=1e-4)


def test_steps_in_chunks_agree_with_one():
    rng = np.random.default_rng(6)
    n = 2 * speed_model.CHUNK + 77
    m, x, y = speed_model.Perceptron(4, (6, 3), seed=1), rng.normal(size=(n, 4)), rng.normal(size=n)
    parts = [(m.gradients(x[a:b], y[a:b]), b - a) for a, b in ((0, 100), (100, 355), (355, n))]
    for i, g in enumerate(m.gradients(x, y)[0]):
        assert np.allclose(g, sum(p[0][i] * k for p, k in parts) / n, atol=1e-12)
    assert m.gradients(x, y)[1] == pytest.approx(((m.predict(x) - y) ** 2).mean())
    assert m.predict(x[:0]).shape == (0,)


def test_early_stop_counts_finer_epochs(spark, monkeypatch):
    """With a loss that never falls, a round has its coarse epoch and nine finer ones."""
    monkeypatch.setattr(speed_model, "epoch", lambda blocks, model, *a: (model, 1.0, 1.0))
    rows = spark.createDataFrame([([1.0, 2.0], 3.0)], "x array<double>, y double")
    assert len(speed_model.train(rows, rows, rounds=2, layers=(2,))[1]) == 2 * (1 + 9)


def test_router_uses_plain_numbers(monkeypatch):
    """A way is searched without array functions for single places, rated as ``rate`` does, and by a network that has been sent too."""
    import pickle

    net, calls, whole = grid(True), [], routing.metres
    tables = [criterion.Survival(np.array([15, 60, 90]), [np.exp(-np.arange(n) / (40.0 + k)) for n in (50, 90, 70)]) for k in range(3)]
    c = criterion.Solve(*tables)
    for gap in (10, 15, 44, 60, 75.4, 400):
        rate = c.searching(gap)
        for detour, turn, seconds in itertools.product((-50.0, 0.0, 3.0, 900.0), (-2.0, 0.0, 1.5), (0.2, 30.0)):
            assert rate(detour, turn, seconds) == c.rate(detour, turn, seconds, gap, True)
    assert c.turn.of(1.0, 75) == (tables[0].tables[1][int(1 / criterion.BIN)] * 15 + tables[0].tables[2][int(1 / criterion.BIN)] * 15) / 30
    monkeypatch.setattr(routing, "metres", lambda *a: calls.append(a) or whole(*a))
    n = lambda road: int(net.number(np.array([road]))[0])
    q = routing.Question(50.0, 20.0, 0.0, 0.0, tuple(net.last[n(14), :2]), tuple(net.last[n(97), 2:]), 60.0)
    net.bends.update({(a, b): 0.0 for a in range(len(net.ids)) for b in range(len(net.ids))})
    found = routing.best_path(net, n(14), n(97), q, c)
    assert found is not None and len(calls) == 1
    assert routing.best_path(pickle.loads(pickle.dumps(net)), n(14), n(97), q, c) == found
