"""The closed form against the sum (or maximum) over all paths, one by one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.functions import prob
from wakeline.operators import preselect, score_nn, score_phmm
from wakeline.plans import fixture

D, R = "/root/testdata/sf0.001", 6371.0088


def hav(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(min(1.0, h)))


def trans(new, old):
    dt = new[0] - old[0]
    return 0.0 if dt < 0 else min(1.0, math.exp(-2 * dt / 551 - 2 * hav(new, old) / 7))


def match(a, b):
    dt, km = abs(a[0] - b[0]), hav(a, b)
    if dt > 120 or km > 2:
        return 0.0
    x, y = dt / 120, km / 2
    return min(1.0, max(0.0, 0.57 + sum(w * math.exp(-k * ((x - cx) ** 2 + (y - cy) ** 2)) for w, k, cx, cy in prob.BUMPS)))


L = lambda p: math.log(p + 1e-300)


def paths(a, r, kappa, null, raw=False):
    """Log probability by (place, state)."""
    ka, kr, n = *kappa, len(a)
    total = sum(match(x, r) for x in a) + 1e-300
    e = [match(x, r) / (1.0 if raw else total) for x in a]

    def leave(i):
        pa, pm = (trans(a[i + 1], a[i]), match(a[i + 1], r)) if i + 1 < n else (0.0, 0.0)
        pr = trans(r, a[i])
        s = pa + pr + pm
        share = lambda p: 0.0 if s == 0 else 0.95 * p / s
        return share(pa) ** ka, share(pr) ** kr, 0.0 if null else share(pm) ** kr

    def stay(new, old, strict=False):
        ok = trans(new, old) > 0 and not (strict and new[0] == old[0] and hav(new, old) == 0)
        return 0.95**ka if ok else 0.0

    out = {}
    for i in range(n + 1):
        for state in ("RF", "M"):
            if state == "M" and i == 0:
                continue
            before = i if state == "RF" else i - 1
            x = L(1 / 3) + sum(L(leave(k)[0]) for k in range(before - 1)) if before else 0.0
            if state == "RF":
                x = x + L(leave(before - 1)[1]) if before else L(1 / 3)
            else:
                x = (x + L(leave(before - 1)[2]) if before else L(0.0 if null else 1 / 3)) + L(e[i - 1])
            if i < n:
                if state == "RF":
                    x += L(stay(a[i], r))
                else:
                    x += L(stay(a[i], a[i - 1] if a[i - 1][0] > r[0] else r, strict=True))
                    if a[i - 1][0] <= r[0]:
                        pass
                x += sum(L(stay(a[k], a[k - 1])) for k in range(i + 1, n))
            out[i, state] = x + L(0.05)
    return out


def lse(v):
    m = max(v)
    return m + math.log(sum(math.exp(x - m) for x in v))


@pytest.fixture(scope="module")
def cases(spark):
    rng = np.random.default_rng(7)
    tracks, rfs = {}, {}
    for k in range(80):
        n = int(rng.integers(1, 20))
        t = np.cumsum(rng.choice([0, 30, 90, 400, 90_000, 230_000], n, p=[0.1, 0.3, 0.3, 0.2, 0.05, 0.05])).astype(float)
        lat, lon = 29 + np.cumsum(rng.normal(0, 0.003, n)), -90 + np.cumsum(rng.normal(0, 0.003, n))
        if k % 7 == 0 and n > 1:
            lat[1], lon[1], t[1] = lat[0], lon[0], t[0]
        tracks[k] = list(zip(t.tolist(), lat.tolist(), lon.tolist(), strict=True))
        near = tracks[k][int(rng.integers(0, n))]
        rfs[k] = near if k % 9 == 0 else (near[0] + float(rng.integers(-150, 150)), near[1] + float(rng.normal(0, 0.01)), near[2])
    points = spark.createDataFrame([(k, 0, i, *p) for k, ps in tracks.items() for i, p in enumerate(ps)], "mmsi bigint, track_id int, seq bigint, t double, lat double, lon double")
    pairs = spark.createDataFrame([(1, 0, k, *r, k, 0) for k, r in rfs.items()], "rf_mmsi bigint, rf_track_id int, rf_signal_id bigint, rf_t double, rf_lat double, rf_lon double, mmsi bigint, track_id int")
    return tracks, rfs, points.persist(), pairs.persist()


@pytest.mark.parametrize("kappa", [(0.5, 2.0), (1.0, 1.0)])
def test_forward_equals_sum_over_paths(cases, kappa):
    tracks, rfs, points, pairs = cases
    for r in score_phmm.scores(pairs, points, kappa).collect():
        full, null = (lse(paths(tracks[r.mmsi], rfs[r.mmsi], kappa, n).values()) for n in (False, True))
        assert r.forward_score == pytest.approx(full, rel=1e-9)
        assert r.null_forward_score == pytest.approx(null, rel=1e-9)
        assert r.log_odds_score == pytest.approx(full - null, abs=1e-5)
        assert r.n_points == len(tracks[r.mmsi])


def test_single_models_equal_both(cases):
    *_, points, pairs = cases
    both = {r.mmsi: r for r in score_phmm.scores(pairs, points).collect()}
    for null, column in ((False, "forward_score"), (True, "null_forward_score")):
        for r in score_phmm.forward(pairs, points, null=null).collect():
            assert r.score == pytest.approx(both[r.mmsi][column], rel=1e-12)


def test_viterbi_is_the_best_path(cases):
    tracks, rfs, points, pairs = cases
    for r in score_phmm.viterbi(pairs, points).collect():
        p = paths(tracks[r.mmsi], rfs[r.mmsi], score_phmm.KAPPA, False, raw=True)
        assert r.log_prob == pytest.approx(max(p.values()), rel=1e-9)
        assert p[r.place, r.state] == pytest.approx(r.log_prob, rel=1e-9)
        path = r.path
        assert path[0] == "begin" and path[-1] == "end" and path.count(r.state) == 1 and path.count("AIS") == len(tracks[r.mmsi]) - (r.state == "M")
        assert path[1 + r.place - (r.state == "M")] == r.state


def test_rows_laid_out_are_not_shuffled(spark, tmp_path):
    points = fixture.tracks(spark, D)
    points.write.parquet(str(tmp_path / "points"))
    points = spark.read.parquet(str(tmp_path / "points"))
    preselect.candidates(fixture.detections(spark, D, points), points, 3.0, 1200.0).write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    for made in (score_phmm.scores(pairs, points), score_nn.SCORERS["nn_haversine"](pairs, points)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 2 and "BroadcastExchange" not in plan


def test_scores_sort_no_row_for_each_pair_and_point(cases):
    *_, points, pairs = cases
    for made in (score_phmm.scores(pairs, points), score_phmm.forward(pairs, points)):
        above = made._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0]
        assert "MapInArrow" in above and "Window" not in above and "Sort" not in above


def test_scores_equal_the_ways_laid_out_where_places_are_unknown(cases):
    *_, points, pairs = cases
    points = points.withColumns({c: F.when(F.col("seq") % 4 != 1, F.col(c)) for c in ("lat", "lon")})
    both = {r.mmsi: r for r in score_phmm.scores(pairs, points).collect()}
    ways = {}
    for r in score_phmm._moves(score_phmm.laid_out(pairs, points), score_phmm.KAPPA, [False, True]).collect():
        for k in (0, 1):
            ways.setdefault((r.mmsi, k), []).extend(x for j in range(1, 5) if (x := r[f"x{j}_{k}"]) is not None)
    assert len(ways) == 2 * len(both) > 0
    for (mmsi, k), v in ways.items():
        assert both[mmsi][("forward_score", "null_forward_score")[k]] == pytest.approx(lse(v) + math.log(0.05), rel=1e-9)
