"""Each bias experiment's groups and side, and labelled sequences, on hand-made tables."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from wakeline.operators import bias, simulate

KEYS = "model string, rf_mmsi long, rf_track_id int, rf_signal_id long"
FEATURES = ["n_points", "mean_intra_time_diff", "mean_intra_dist_diff", "stationary_ratio", "time_diff", "distance_diff"]


def split(spark):
    """Wrong picks have more points, shorter gaps, more standing still and nearer fixes than the right ones; correct picks would turn every sign round."""
    rows = []
    for k in range(12):
        near = k % 3
        rows.append(("m", k, 0, 1, "incorrect", 50.0 + near, 10.0 + near, 1.0 + near / 9, 0.5 + near / 9, 20.0 + near, 2.0 + near / 9))
        rows.append(("m", k, 0, 1, "shouldbe", 30.0 - near, 30.0 - near, 3.0 - near / 9, 0.2 - near / 99, 60.0 - near * 2, 4.0 - near / 9))
    rows += [("m", 100 + k, 0, 1, "correct", 90.0 + k, 1.0 + k / 9, 0.1 + k / 9, 0.9 + k / 99, 1.0 + k, 0.1 + k) for k in range(5)]
    return spark.createDataFrame(rows, KEYS + ", group string, " + ", ".join(f"{f} double" for f in FEATURES))


def test_each_experiment_has_its_groups_and_side(spark):
    df = split(spark)
    out = {r.experiment: r for r in bias.t_tests(df).collect()}
    assert list(out) == ["1", "2a", "2b", "3", "4a", "4b"]
    by = {}
    for r in df.collect():
        by.setdefault(r.group, []).append(r)
    for name, r in out.items():
        a, b = ([x[r.feature] for x in by[g]] for g in ("incorrect", "shouldbe"))
        if name[0] == "4":
            d = [x - y for x, y in zip(a, b, strict=True)]
            t = statistics.mean(d) / math.sqrt(statistics.variance(d) / 12)
        else:
            t = (statistics.mean(a) - statistics.mean(b)) / math.sqrt(statistics.variance(a) / 12 + statistics.variance(b) / 12)
        assert r.t == pytest.approx(t) and (r.n_a, r.n_b) == (12, 12)
        assert r.p_value < 1e-6 and r.p_two_sided == pytest.approx(2 * r.p_value, rel=1e-6)
        assert r.effect == ("chosen > should-be" if name in ("1", "3") else "chosen < should-be")


def test_t_without_variance_is_unknown(spark):
    df = split(spark).withColumns({f: F.lit(1.0) for f in FEATURES})
    assert all(r.t is None and r.p_value is None and r.effect is None for r in bias.t_tests(df).collect())


def test_time_difference_has_no_sign(spark):
    points = spark.createDataFrame([(7, 0, 100.0, 1, 0.0, 0.0), (7, 0, 400.0, 2, 0.1, 0.1)], "mmsi long, track_id int, t double, seq long, lat double, lon double")
    pairs = spark.createDataFrame([(1, 0, k, 7, 0, t, 0.0, 0.0) for k, t in enumerate((40.0, 130.0, 390.0, 500.0))], "rf_mmsi long, rf_track_id int, rf_signal_id long, mmsi long, track_id int, rf_t double, rf_lat double, rf_lon double")
    got = [r.time_diff for r in bias.nearest_in_track(pairs, points).orderBy("rf_signal_id").collect()]
    assert got == [60.0, 30.0, 10.0, 100.0]


def test_labelled_sequences(spark):
    rows = [(1, 0, 10.0 * k, 2 * k + s, 29.0 + k * 1e-4, -90.0, 45.0) for k in range(200) for s in (0, 1)]
    points = spark.createDataFrame(rows, "mmsi long, track_id int, t double, seq long, lat double, lon double, heading double")
    out = simulate.training_data(points, day=500.0).collect()
    by = {}
    for r in out:
        by.setdefault(r.state, []).append(r)
    m, rf = by.get("M", []), by.get("RF", [])
    assert m and all(r.t == r.ais_t and r.rf_t is not None and r.ais and r.rf for r in m) and all(r.t == r.rf_t and r.ais_t is None and r.ais is None for r in rf)
    assert len(by["AIS"]) == len(rows) - len({r.ais_t for r in m})
    times = [t for t in [r[2] for r in rows] + [r.rf_t for r in m + rf]]
    (begin,), (end,) = by["begin"], by["end"]
    assert begin.t == min(times) - 1 and end.t == max(times) + 1
