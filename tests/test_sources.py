import datetime as dt
import http.server
import json
import threading
import zipfile
from functools import partial

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wakeline.operators import preselect, simulate
from wakeline.plans import fixture, pipeline
from wakeline.sources import ais
from wakeline.streaming import live

D = "/root/testdata/sf0.001"
HEAD = "MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading,VesselName,IMO,CallSign,VesselType\n"


def test_zips_lookup_and_days(spark, tmp_path):
    for day, rows in (("01", "1,2024-01-01T00:00:00,29.0,-90.0,1.0,0,10,x,IMO1,c,70\n2,2024-01-01T00:01:00,29.0,-90.0,,0,,y,,c,\n"), ("02", "1,2024-01-02T00:00:00,29.1,-90.0,1.0,0,10,x,IMO1,c,70\n")):
        with zipfile.ZipFile(tmp_path / f"AIS_2024_01_{day}.zip", "w") as z:
            z.writestr("a.csv", HEAD + rows)
            z.writestr("note.txt", "no table")
    df = ais.with_time(ais.read_zips(spark, str(tmp_path / "*.zip")))
    assert df.count() == 3 and df.where("sog is null and vessel_type is null").count() == 1
    (tmp_path / "names.json").write_text(json.dumps({"70": "Cargo", "80": "Tanker"}))
    names = ais.read_lookup(spark, str(tmp_path / "names.json"))
    from wakeline.operators import prep

    assert prep.of_type(df, names).count() == 2
    out = str(tmp_path / "days")
    start, end = dt.date(2024, 1, 1), dt.date(2024, 1, 3)
    assert len(ais.missing_days(spark, out, start, end)) == 3
    ais.write_days(df.where(F.to_date("ts") == "2024-01-01"), out)
    ais.write_days(df.where(F.to_date("ts") == "2024-01-02"), out)
    assert ais.missing_days(spark, out, start, end) == [end] and spark.read.parquet(out).count() == 3
    assert ais.day_files(start, end, "http://x/")[0] == "http://x/AIS_2024_01_01.zip"


def test_download_skips_what_is_not_there(tmp_path):
    (tmp_path / "a.zip").write_bytes(b"x" * (ais.CHUNK + 7))

    class Quiet(http.server.SimpleHTTPRequestHandler):
        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), partial(Quiet, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        assert ais.download(f"{base}/a.zip", str(tmp_path / "out")) and (tmp_path / "out").read_bytes() == (tmp_path / "a.zip").read_bytes()
        assert not ais.download(f"{base}/none.zip", str(tmp_path / "none")) and not (tmp_path / "none").exists()
    finally:
        server.shutdown()
        server.server_close()
    assert not ais.download(f"{base}/a.zip", str(tmp_path / "late"))


def test_resume_works_on_new_keys_only(spark, tmp_path):
    seen = []

    def work(df):
        seen.append(df.count())
        return df.withColumn("y", F.col("x") * 2)

    path = str(tmp_path / "t")
    ais.resume(spark.range(5).withColumnRenamed("id", "x"), path, ["x"], work)
    out = ais.resume(spark.range(8).withColumnRenamed("id", "x"), path, ["x"], work)
    assert seen == [5, 3] and sorted(r.y for r in out.collect()) == list(range(0, 16, 2))
    ais.write_csv(out, str(tmp_path / "csv"))
    assert [r.x for r in ais.read_results(spark, str(tmp_path / "csv"), "x bigint, y bigint").collect()] == list(range(8))


def test_stream_equals_batch(spark, tmp_path):
    points = fixture.tracks(spark, D).persist()
    rf = fixture.detections(spark, D, points).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t")))
    rf = rf.select("rf_mmsi", "rf_track_id", "rf_signal_id", "ts", "t", "lat", "lon")
    rf.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rf.schema).parquet(str(tmp_path / "in"))
    live.to_parquet(live.candidates(stream, points, 3.0, 1200.0), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    expected = preselect.candidates(rf, points, 3.0, 1200.0, force_true=False)
    columns = ["rf_mmsi", "rf_track_id", "rf_signal_id", "mmsi", "track_id"]
    key = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(expected)


def test_simulated_sequences(spark):
    points = fixture.tracks(spark, D).persist()
    s = simulate.training_data(points, day=2000.0).persist()
    by = {r.state: r.n for r in s.groupBy("state").agg(F.count("*").alias("n")).collect()}
    n_tracks = points.select("mmsi", "track_id").distinct().count()
    assert by["begin"] == by["end"] == n_tracks
    assert by["AIS"] + s.where("ais is not null and state = 'M'").select("mmsi", "track_id", "ais").distinct().count() == points.count()
    assert s.where("state in ('RF', 'M') and rf is null").count() == 0 and s.where("state = 'RF' and ais is not null").count() == 0
    again = simulate.training_data(points, day=2000.0)
    assert s.exceptAll(again).count() == 0


def test_broken_archives_are_named_and_left_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "in/a.zip", "w") as z:
        z.writestr("a.csv", "MMSI,BaseDateTime,LAT,LON,SOG,Heading,IMO,VesselType\n5,2024-01-01T00:00:00,29.0,-90.0,1.0,90,IMO1,70\n6,2024-01-01T00:00:09,29.0,-90.0,1.0,90,IMO2,31\n")
    (tmp_path / "types.json").write_text('{"70": "Cargo", "31": "Tug"}')
    assert [r.path.rpartition("/")[2] for r in ais.broken_zips(spark, str(tmp_path / "in/*.zip")).collect()] == ["b.zip"]
    out = pipeline.ingest(spark, str(tmp_path / "in/*.zip"), str(tmp_path / "types.json"), str(tmp_path / "reports"))
    assert [r.mmsi for r in out.collect()] == [5]


def test_pipeline_resumes(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="tracks"):
        pipeline.run(spark, None, str(tmp_path))
    reports = fixture.reports(spark, D, 512).where("mmsi < 8")
    made = pipeline.run(spark, reports, str(tmp_path), leave_one_out=True, km=3.0, window=1200.0)
    assert {r.model for r in made["ranking_metrics"].collect()} <= set(pipeline.MODELS)
    runtimes = {r.model: r for r in made["runtime"].collect()}
    assert set(runtimes) == {"phmm", *pipeline.score_nn.SCORERS} and all(r.seconds > 0 and r.pairs == made["candidates"].count() for r in runtimes.values())
    names = {r.model for r in made["corrected_metrics"].collect()}
    assert {"forward_score_corrected", "log_odds_score_corrected"} <= names
    assert {r.model for r in made["correction"].collect()} == {"forward_alpha_1", "forward_tuned", "log_odds_raw", "log_odds_tuned"}
    for name, keys in (("tracks", ["mmsi", "track_id", "t", "seq"]), ("candidates", pipeline.PAIR)):
        rows = pd.concat(pd.read_parquet(f) for f in sorted((tmp_path / "gaussian" / name).glob("part-*")))[keys]
        listed = [tuple(r) for r in rows.itertuples(index=False)]
        assert listed == sorted(listed) and len(listed) == made[name].count() > 1
    pipeline.figures(spark, str(tmp_path), "gaussian")
    stages = pipeline.Stages(spark, f"{tmp_path}/gaussian")
    stages.need(["tracks", "candidates", "open_set", "leave_one_out"])
    again = stages.table("tracks", lambda: 1 / 0)
    assert again.count() == made["tracks"].count()
    stages.clean()
    with pytest.raises(FileNotFoundError, match="tracks, candidates"):
        stages.need(["tracks", "candidates"])
