import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import preselect, score_nn
from wakeline.plans import fixture
from wakeline.schema import PAIR

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def traffic(spark):
    points = fixture.tracks(spark, D).persist()
    return points, fixture.detections(spark, D, points).persist()


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_grid_join_equals_nested_join(spark, traffic):
    points, rf = traffic
    meta = preselect.track_meta(points)
    assert rows(preselect.box_pairs(rf, meta), *PAIR) == rows(preselect.box_pairs_nested(rf, meta), *PAIR)


def test_grid_join_has_no_nested_loop(spark, traffic):
    points, rf = traffic
    plan = preselect.box_pairs(rf, preselect.track_meta(points))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_forced_and_left_out_true_tracks(spark, traffic):
    points, rf = traffic
    closed = preselect.candidates(rf, points, 3.0, 1200.0)
    true = closed.where("is_true_match")
    assert true.count() == rf.count()
    left = preselect.candidates(rf, points, 3.0, 1200.0, leave_one_out=True)
    assert rows(left, *PAIR) == rows(closed.where("not is_true_match"), *PAIR)
    free = preselect.candidates(rf, points, 3.0, 1200.0, force_true=False)
    recall = preselect.prefilter_recall(rf, points, 3.0, 1200.0)
    assert recall.where("passed_prefilter").count() == free.where("is_true_match").count()


def test_candidates_grow_with_the_distance(spark, traffic):
    points, rf = traffic
    near = set(rows(preselect.candidates(rf, points, 3.0, 1200.0), *PAIR))
    assert near <= set(rows(preselect.candidates(rf, points, 6.0, 1200.0), *PAIR))


def test_margins_are_inclusive(spark):
    meta = spark.createDataFrame([(1, 0, 100.0, 200.0, 29.0, 30.0, -91.0, -90.0)], "mmsi bigint, track_id int, min_t double, max_t double, south double, north double, west double, east double")
    at = lambda t, lat, lon: (9, 0, 1, t, lat, lon)
    df = spark.createDataFrame([at(-500.0, 29.0, -91.0), at(800.0, 30.0, -90.0), at(800.001, 30.0, -90.0), at(0.0, 28.999, -91.0)], "rf_mmsi bigint, rf_track_id int, rf_signal_id bigint, t double, lat double, lon double")
    assert sorted(r.rf_t for r in preselect.box_pairs(df, meta).collect()) == [-500.0, 800.0]


def test_near_pairs_at_the_borders_of_slots(spark):
    rng = random.Random(8)
    pts = [(m, 0, float(rng.choice([80 * k + e for k in range(-3, 4) for e in (-10, -9, 0, 9, 10, 40)])), 29.0 + 0.01 * rng.randint(0, 3), -90.0) for m in range(6) for _ in range(4)]
    pts.append((0, 0, None, 29.0, -90.0))
    pairs = [(i, 0, 1, float(80 * rng.randint(-3, 3) + rng.choice([-20, -10, -1, 0, 1, 10, 20])), 29.0, -90.0, rng.randrange(7), 0) for i in range(400)]
    p = spark.createDataFrame(pts, "mmsi bigint, track_id int, t double, lat double, lon double")
    x = spark.createDataFrame(pairs, "rf_mmsi bigint, rf_track_id int, rf_signal_id bigint, rf_t double, rf_lat double, rf_lon double, mmsi bigint, track_id int")
    got = {r.rf_mmsi for r in preselect.near_pairs(x, p, 2.0, 10.0).collect()}
    close = lambda r, q: q[0] == r[6] and q[2] is not None and abs(q[2] - r[3]) <= 10 and (q[3] - 29) * 111.195 <= 2
    assert got == {r[0] for r in pairs if any(close(r, q) for q in pts)} and 20 < len(got) < 400


def test_nearest_fix_against_brute_force(spark):
    rng = np.random.default_rng(5)
    pts = [(int(k), int(i), float(rng.integers(0, 50)), float(i)) for k in range(3) for i in range(20)]
    left = [(int(rng.integers(0, 4)), float(rng.integers(-5, 60)), i) for i in range(200)]
    p = spark.createDataFrame(pts, "k bigint, seq bigint, t double, v double")
    x = spark.createDataFrame(left, "j bigint, t double, id bigint")
    got = {r.id: r.fix_v for r in preselect.nearest_fix(x, p, "k", "j", ["v"]).collect()}
    for j, t, i in left:
        mine = [(abs(b - t), b, s, v) for k, s, b, v in pts if k == j]
        assert got[i] == (min(mine)[3] if mine else None)


def test_one_point_track_and_leg_without_length(spark):
    pairs = spark.createDataFrame([(1, 0, 1, 0.0, 29.0, -90.0, 5, 0), (1, 0, 1, 0.0, 29.0, -90.0, 6, 0)], "rf_mmsi bigint, rf_track_id int, rf_signal_id bigint, rf_t double, rf_lat double, rf_lon double, mmsi bigint, track_id int")
    pts = spark.createDataFrame([(5, 0, 1, 10.0, 29.01, -90.0), (6, 0, 1, 10.0, 29.01, -90.0), (6, 0, 2, 10.0, 29.01, -90.0)], "mmsi bigint, track_id int, seq bigint, t double, lat double, lon double")
    for name, score in score_nn.SCORERS.items():
        got = [r.score for r in score(pairs, pts).orderBy("mmsi").collect()]
        assert len(got) == 2 and got[0] == pytest.approx(got[1]), name
    assert score_nn.segment(pairs, pts).first().score == pytest.approx(np.radians(0.01) * 6371.0088)


def test_sibling(spark):
    pairs = spark.createDataFrame([(1, 0, 1, 1, 1), (1, 0, 1, 1, 0), (2, 0, 1, 1, 0)], "rf_mmsi bigint, rf_track_id int, rf_signal_id bigint, mmsi bigint, track_id int")
    assert {r.rf_mmsi: r.has_sibling_candidate for r in preselect.sibling_overlap(pairs).collect()} == {1: True, 2: False}
    assert preselect.is_true() is not None and F is not None


def test_tracks_of_any_length_touch_few_cells(spark):
    rng = random.Random(5)
    points, rf = [], []
    for m in range(150):
        span, days = rng.choice([0.01, 1.0, 9.0, 80.0]), rng.choice([1 / 1440, 0.3, 9, 60])
        lat, lon, t = rng.uniform(-60, 60 - span / 2), rng.uniform(-170, 60), rng.uniform(0, 1e6)
        points += [(m, 0, t + k * days * 21600, k, lat + k * span / 8, lon + k * span / 4) for k in range(5)]
    for i in range(3000):
        m, _, t, _, lat, lon = rng.choice(points)
        rf.append((i, 0, 1, t + rng.uniform(-900, 900), lat + rng.uniform(-0.2, 0.2), lon + rng.uniform(-0.2, 0.2)))
    meta = preselect.track_meta(spark.createDataFrame(points, "mmsi long, track_id int, t double, seq long, lat double, lon double"))
    detections = spark.createDataFrame(rf, "rf_mmsi long, rf_track_id int, rf_signal_id long, t double, lat double, lon double")
    assert preselect.laid_over(meta).groupBy("mmsi", "track_id").count().agg({"count": "max"}).first()[0] <= 64
    a, b = (sorted(map(tuple, f(detections, meta).collect())) for f in (preselect.box_pairs, preselect.box_pairs_nested))
    assert a == b and len(a) > 3000
