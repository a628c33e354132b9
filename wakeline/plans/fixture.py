"""The driver's ``events`` table read as vessel traffic, in Spark and in SQL.

Time is compressed by ``divisor``, vessels start on a grid and move linearly.
Rows of type error are detections about 0.4 km off, all others are reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions import prob
from wakeline.operators import prep, preselect

TYPES = [("click", "Cargo"), ("view", "Tanker"), ("purchase", "Fishing"), ("signup", "Passenger"), ("error", "Detection")]


def _raw(spark: SparkSession, sf_dir: str, divisor: int) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / (divisor * 1e6)
    m = F.col("mmsi")
    x = e.select(F.col("user_id").alias("mmsi"), F.col("event_id").alias("seq"), t.alias("t"), "event_type", "value")
    lat = F.lit(29.0) + 0.03 * (m % 12) + F.col("t") * (4e-5 + 5e-6 * (m % 5)) + F.col("value") * 1e-7
    lon = F.lit(-90.0) + 0.03 * F.floor(m / 12) + F.col("t") * (2e-5 + 3e-6 * (m % 7)) + F.col("value") * 0.0
    return x.withColumns({"lat": lat, "lon": lon})


def reports(spark: SparkSession, sf_dir: str, divisor: int = 128) -> DataFrame:
    x = _raw(spark, sf_dir, divisor).where("event_type <> 'error'")
    return x.select("mmsi", "seq", "t", "lat", "lon", F.col("value").alias("sog"), (F.col("seq") % 360).cast("double").alias("heading"), F.col("event_type").alias("vessel_type"))


def type_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TYPES, "code string, name string")


def tracks(spark: SparkSession, sf_dir: str, divisor: int = 128) -> DataFrame:
    return prep.split_tracks(prep.add_speed(prep.remove_short_tracks(reports(spark, sf_dir, divisor))))


def detections(spark: SparkSession, sf_dir: str, points: DataFrame, divisor: int = 128) -> DataFrame:
    """Detections with the track of their vessel that is nearest in time as the true one, numbered in it."""
    x = _raw(spark, sf_dir, divisor).where("event_type = 'error'")
    x = x.select(F.col("mmsi").alias("rf_mmsi"), "seq", "t", (F.col("lat") + 0.004 * F.cos("seq")).alias("lat"), (F.col("lon") + 0.004 * F.sin("seq")).alias("lon"))
    near = preselect.nearest_fix(x, points, "mmsi", "rf_mmsi", ["track_id", "lat", "lon"]).where("fix_track_id is not null")
    return preselect.number_signals(near.withColumnRenamed("fix_track_id", "rf_track_id"))


# The same in SQL. Literals have exponents: plain ones would be decimals.
def hav(a: str, b: str, c: str, d: str) -> str:
    return f"CASE WHEN {a} + {b} + {c} + {d} IS NOT NULL THEN 2 * 6371.0088e0 * asin(sqrt(least(1e0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - ({b})) / 2), 2)))) END"


def transition(dt: str, km: str) -> str:
    return f"CASE WHEN {dt} < 0 THEN 0e0 WHEN ({dt}) + ({km}) IS NULL THEN 1e0 ELSE least(1e0, greatest(0e0, exp(-2e0 * ({dt}) / 551e0 - 2e0 * ({km}) / 7e0))) END"


def match(dt: str, km: str) -> str:
    x, y = f"(({dt}) / 120e0)", f"(({km}) / 2e0)"
    total = " + ".join([f"{prob.MATCH_BASE:e}", *(f"({w:e}) * exp(-{k} * (pow({x} - ({a:e}), 2) + pow({y} - ({b:e}), 2)))" for w, k, a, b in prob.BUMPS)])
    return f"CASE WHEN ({dt}) > 120 OR ({km}) > 2 THEN 0e0 ELSE least(1e0, greatest(0e0, {total})) END"


def ctes(divisor: int = 128, km: float = 6.0, window: float = 10800.0, margin: float = 600.0) -> dict[str, str]:
    """CTEs in the order in which they use each other."""
    side = lambda lat: f"{km}e0 / (111e0 * cos(radians({lat})))"
    own = "(rf_mmsi = mmsi AND rf_track_id = track_id)"
    inside = f"r.t >= min_t - {margin} AND r.t <= max_t + {margin} AND r.lat BETWEEN south AND north AND r.lon BETWEEN west AND east"
    rf_columns = "rf_mmsi, rf_track_id, rf_signal_id, r.t AS rf_t, r.lat AS rf_lat, r.lon AS rf_lon"
    return {
        "raw0": f"SELECT user_id AS mmsi, event_id AS seq, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / ({divisor} * 1e6) AS t, event_type, value FROM events",
        "raw": "SELECT *, 29e0 + 3e-2 * (mmsi % 12) + t * (4e-5 + 5e-6 * (mmsi % 5)) + value * 1e-7 AS lat, -90e0 + 3e-2 * floor(mmsi / 12) + t * (2e-5 + 3e-6 * (mmsi % 7)) + value * 0e0 AS lon FROM raw0",
        "ais": "SELECT mmsi, seq, t, lat, lon, value AS sog, CAST(seq % 360 AS DOUBLE) AS heading, event_type AS vessel_type FROM raw WHERE event_type <> 'error'",
        "long_enough": "SELECT * FROM ais QUALIFY count(*) OVER (PARTITION BY mmsi) > 5",
        "moved": f"SELECT *, t - lag(t) OVER w AS time_diff, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS distance_diff FROM long_enough WINDOW w AS (PARTITION BY mmsi ORDER BY t, seq)",
        "speeds": "SELECT *, CASE WHEN time_diff > 0 AND distance_diff > 0 THEN distance_diff / time_diff * 3600 ELSE 0e0 END AS speed_kph FROM moved",
        "gap": "SELECT quantile_cont(time_diff, 0.99) AS gap FROM speeds",
        "cut": "SELECT *, CAST(sum(CASE WHEN time_diff > gap THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY t, seq) AS INTEGER) AS track_id FROM speeds, gap",
        "cut2": "SELECT * EXCLUDE (gap), row_number() OVER (PARTITION BY mmsi, track_id ORDER BY t, seq) AS i FROM cut QUALIFY count(*) OVER (PARTITION BY mmsi, track_id) >= 5",
        "cut3": "SELECT * REPLACE (CASE WHEN i > 1 THEN time_diff END AS time_diff, CASE WHEN i > 1 THEN distance_diff END AS distance_diff, CASE WHEN i > 1 THEN speed_kph END AS speed_kph) FROM cut2",
        "tracks": "SELECT * FROM cut3 QUALIFY avg(speed_kph) OVER (PARTITION BY mmsi, track_id) >= 5",
        "rf0": "SELECT mmsi AS rf_mmsi, seq, t, lat + 4e-3 * cos(seq) AS lat, lon + 4e-3 * sin(seq) AS lon FROM raw WHERE event_type = 'error'",
        "fixed": "SELECT r.rf_mmsi, r.seq, any_value(r.t) AS t, any_value(r.lat) AS lat, any_value(r.lon) AS lon, arg_min(struct_pack(track_id := p.track_id, t := p.t, lat := p.lat, lon := p.lon), struct_pack(a := abs(p.t - r.t), b := p.t, c := p.seq)) AS fix FROM rf0 r JOIN tracks p ON r.rf_mmsi = p.mmsi GROUP BY r.rf_mmsi, r.seq",
        "rf": "SELECT rf_mmsi, seq, t, lat, lon, fix.track_id AS rf_track_id, fix.t AS fix_t, fix.lat AS fix_lat, fix.lon AS fix_lon, row_number() OVER (PARTITION BY rf_mmsi, fix.track_id ORDER BY t, seq) AS rf_signal_id FROM fixed",
        "ranges": "SELECT mmsi, track_id, count(*) AS n_points, min(t) AS min_t, max(t) AS max_t, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM tracks GROUP BY ALL",
        "meta": f"SELECT *, min_lat - {km} / 111e0 AS south, max_lat + {km} / 111e0 AS north, min_lon - {side('min_lat')} AS west, max_lon + {side('max_lat')} AS east FROM ranges",
        "boxed": f"SELECT {rf_columns}, mmsi, track_id FROM rf r JOIN meta ON {inside}",
        "near": f"SELECT * FROM boxed b WHERE EXISTS (SELECT 1 FROM tracks p WHERE p.mmsi = b.mmsi AND p.track_id = b.track_id AND abs(p.t - b.rf_t) <= {window} AND {hav('b.rf_lat', 'b.rf_lon', 'p.lat', 'p.lon')} <= {km})",
        "cand": f"SELECT *, false AS is_true_match FROM near WHERE NOT {own} UNION ALL SELECT {rf_columns}, rf_mmsi, rf_track_id, true FROM rf r",
    }
