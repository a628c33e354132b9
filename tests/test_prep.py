import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import prep, view

REPORT = "mmsi bigint, seq bigint, t double, lat double, lon double"


def line(mmsi, n, step=60.0, speed=0.01, start=0.0):
    return [(mmsi, 1000 * mmsi + k, start + step * k, 29 + speed * k, -90.0) for k in range(n)]


def test_short_vessels_and_short_segments_differ_by_one(spark):
    df = spark.createDataFrame(line(1, 5) + line(2, 6), REPORT)
    assert {r.mmsi for r in prep.remove_short_tracks(df).collect()} == {2}
    assert {r.mmsi for r in prep.split_tracks(prep.add_speed(df)).collect()} == {1, 2}


def test_speed_of_first_row_and_of_equal_points_is_zero(spark):
    rows = [(1, 1, 0.0, 29.0, -90.0), (1, 2, 0.0, 29.1, -90.0), (1, 3, 60.0, 29.1, -90.0), (1, 4, 120.0, 29.2, -90.0)]
    out = prep.add_speed(spark.createDataFrame(rows, REPORT)).orderBy("seq").collect()
    assert [r.speed_kph for r in out[:3]] == [0.0, 0.0, 0.0] and out[3].speed_kph > 600
    assert out[0].time_diff is None and out[0].distance_diff is None


def test_split_is_strict_and_nulls_first_rows(spark):
    rows = line(1, 30) + line(1, 30, start=1e6) + line(2, 10)
    rows = [(m, k, t, lat, lon) for k, (m, _, t, lat, lon) in enumerate(rows)]
    out = prep.split_tracks(prep.add_speed(spark.createDataFrame(rows, REPORT)), gap_share=0.9)
    got = {(r.mmsi, r.track_id): (r.n, r.nulls) for r in out.groupBy("mmsi", "track_id").agg(F.count("*").alias("n"), F.count_if(F.col("time_diff").isNull()).alias("nulls")).collect()}
    assert got == {(1, 0): (30, 1), (1, 1): (30, 1), (2, 0): (10, 1)}


def test_fast_outliers_drop_the_whole_vessel(spark):
    rows = [r for m in range(1, 9) for r in line(m, 20)]
    rows.append((3, 99999, 20 * 60.0, 45.0, -90.0))
    out = prep.remove_high_speed_outliers(prep.add_speed(spark.createDataFrame(rows, REPORT)).where("time_diff is not null"))
    assert 3 not in {r.mmsi for r in out.collect()}


def test_exact_quantiles_close_in(spark, monkeypatch):
    v = np.random.default_rng(3).lognormal(0, 3, 20_000).round(2)
    df = spark.createDataFrame([(float(x),) for x in v], "v double").unionAll(spark.createDataFrame([(None,)], "v double"))
    monkeypatch.setattr(prep, "EXACT_LIMIT", 50)
    monkeypatch.setattr(prep.order_statistic, "__defaults__", (50,))
    for q, got in zip((0, 0.25, 0.99, 1), prep.exact_quantiles(df, "v", [0, 0.25, 0.99, 1]), strict=True):
        assert got == pytest.approx(np.quantile(v, q), rel=1e-12)


def test_empty_input(spark):
    out = prep.split_tracks(prep.add_speed(prep.remove_short_tracks(spark.createDataFrame([], REPORT))))
    assert out.count() == 0 and prep.track_characteristics(out).count() == 0


def test_characteristics_count_unknown_steps_as_certain(spark):
    out = prep.split_tracks(prep.add_speed(spark.createDataFrame(line(1, 6), REPORT)))
    row = prep.track_characteristics(out).first()
    step = np.exp(-2 * 60 / 551 - 2 * out.where("time_diff is not null").first().distance_diff / 7)
    p = np.array([1.0] + [step] * 5)
    assert row.mean_transition_strength == pytest.approx(p.mean()) and row.std_transition_strength == pytest.approx(p.std(ddof=1))
    assert row.std_transition_strength_corr == pytest.approx(np.sqrt(p).std())


def test_density_and_sample(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    df = spark.createDataFrame([(k, 0, *map(float, r)) for k, r in enumerate(x)], "mmsi bigint, track_id int, a double, b double")
    z = (x - x.mean(0)) / x.std(0)
    d2 = ((z[:, None] - z[None]) ** 2).sum(-1)
    expected = np.log(np.exp(-d2 / 0.5).sum(1)) - np.log(60) - 2 * np.log(0.5) - np.log(2 * np.pi)
    for block in (50_000, 17):
        got = {r.mmsi: r.log_density for r in prep.kde_log_density(df, ["mmsi", "track_id"], ["a", "b"], block_rows=block).collect()}
        assert np.allclose([got[k] for k in range(60)], expected)
    some = prep.weighted_sample(df.withColumn("sampling_weight", F.lit(1.0)), 10)
    assert some.count() == 10 and some.select("mmsi").distinct().count() == 10


def test_density_curves(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(v), 1.0) for v in rng.normal(size=40)] + [("b", float(v), float(v) ** 2) for v in rng.normal(size=15)] + [("b", None, None)]
    df = spark.createDataFrame(rows, "part string, x double, y double")
    got = prep.density_curves(df, "part", ["x", "y"], points=20).toPandas()
    assert set(zip(got.part, got.feature, strict=True)) == {("a", "x"), ("b", "x"), ("b", "y")}
    for (part, feature), one in got.groupby(["part", "feature"]):
        v = np.array([r[1 if feature == "x" else 2] for r in rows if r[0] == part and r[1] is not None])
        bw = v.std(ddof=1) * len(v) ** -0.2
        x = np.linspace(v.min() - 3 * bw, v.max() + 3 * bw, 20)
        expected = np.exp(-(((x[:, None] - v) / bw) ** 2) / 2).mean(1) / (bw * np.sqrt(2 * np.pi))
        one = one.sort_values("i")
        assert np.allclose(one.x, x) and np.allclose(one.density, expected)
    assert prep.density_curves(df.limit(0), "part", ["x"]).count() == 0


def test_vessel_speed_box(spark):
    v = [10.0, 11.0, 12.0, 13.0, 14.0, 60.0]
    df = spark.createDataFrame([(k, x + e) for k, x in enumerate(v) for e in (-1.0, 1.0)] + [(9, None)], "mmsi bigint, speed_kph double")
    row = prep.vessel_speed_box(df).first()
    assert (row.q1, row.med, row.q3) == tuple(np.quantile(v, [0.25, 0.5, 0.75]))
    assert (row.whisker_low, row.whisker_high, row.n_outliers, row.n_vessels) == (10.0, 14.0, 1, 6) and row["mean"] == pytest.approx(np.mean(v))
    empty = prep.vessel_speed_box(df.limit(0)).first()
    assert empty.n_vessels == 0 and empty.q1 is None


def test_map_markers_of_some_vessels(spark):
    points = spark.createDataFrame([(1, 0, 0.0, 29.0, -90.0, 90.0), (1, 0, 1.0, None, -90.0, 90.0), (2, 0, 0.0, 29.0, -90.0, None)], "mmsi bigint, track_id int, t double, lat double, lon double, heading double")
    rf = spark.createDataFrame([(1, 0, 5.0, 29.1, -90.0), (3, 0, 5.0, 29.1, -90.0)], "rf_mmsi bigint, rf_track_id int, t double, lat double, lon double")
    got = {(r.layer, r.mmsi, r.rotation) for r in view.map_markers(points, rf, [1, 2]).collect()}
    assert got == {("AIS", 1, 405.0), ("AIS", 2, None), ("RF", 1, None)}
    assert view.map_markers(points, rf).count() == 4 and view.map_markers(points, rf, []).count() == 0
