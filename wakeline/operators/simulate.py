"""Simulated, labelled detections along tracks. All draws are hashes, so runs repeat."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import geo, prob
from wakeline.functions.draw import uniform
from wakeline.operators.preselect import nearest_fix
from wakeline.schema import TRACK

DAY = 86400


def normal(*parts: Column | str, seed: int) -> Column:
    return F.sqrt(-2 * F.log(uniform(*parts, F.lit("r"), seed=seed))) * F.cos(2 * math.pi * uniform(*parts, F.lit("a"), seed=seed))


def revisit_times(spark, seed: int = 42) -> DataFrame:
    """One day's overpasses, for all tracks (second of the day): a start before 03:00 and steps of 180 to 240 minutes and some seconds."""
    u = lambda k: uniform(F.lit(k), seed=seed)
    steps = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.when(k == 0, F.floor(3 * u("h")) * 3600 + F.floor(60 * u("m")) * 60).otherwise((180 + F.floor(61 * uniform(F.lit("step"), k, seed=seed))) * 60 + F.floor(60 * uniform(F.lit("sec"), k, seed=seed))))
    times = F.transform(steps, lambda _, i: F.aggregate(F.slice(steps, 1, i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x))
    return spark.range(1).select(F.explode(times).alias("second")).where(F.col("second") < DAY)


def overpasses(points: DataFrame, revisits: DataFrame, margin: float = 300.0, day: float = DAY) -> DataFrame:
    """(track key, t): overpasses on the days of a track, within its time range and margin.

    Every (track, day) meets the day's few overpasses; that list has at most
    nine rows.
    """
    days = points.groupBy(*TRACK, F.floor(F.col("t") / day).alias("d")).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    whole = Window.partitionBy(*TRACK)
    days = days.withColumns({"lo": F.min("lo").over(whole), "hi": F.max("hi").over(whole)})
    t = F.col("d") * day + F.col("second") * (day / DAY)
    return days.crossJoin(F.broadcast(revisits)).withColumn("t", t).where((F.col("t") >= F.col("lo") - margin) & (F.col("t") <= F.col("hi") + margin)).select(*TRACK, "t")


def gaussian_error(*key: Column | str, sigma: float = 800.0, seed: int = 42) -> tuple[Column, Column]:
    """(metres, bearing) of a two-dimensional normal offset."""
    east, north = (sigma * normal(*key, F.lit(side), seed=seed) for side in ("east", "north"))
    return F.hypot(east, north), F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def uniform_error(heading: Column, *key: Column | str, mean: float = 2000.0, deviation: float = 100.0, spread: float = 60.0, seed: int = 42) -> tuple[Column, Column]:
    """(metres, bearing) around a fixed distance and the heading."""
    return F.round(mean + deviation * normal(*key, F.lit("metres"), seed=seed), 6), F.pmod(heading + spread * (2 * uniform(*key, F.lit("bearing"), seed=seed) - 1), F.lit(360.0))


def training_data(points: DataFrame, model: str = "gaussian", margin: float = 300.0, seed: int = 42, day: float = DAY) -> DataFrame:
    """Labelled sequences: track key, t, ais_t, rf_t, ais and rf (structs of lat, lon), state in begin, AIS, RF, M, end.

    Each overpass gives a detection off the fix nearest in time. It is M where
    the match is likelier than a transition and RF otherwise. An M row stands at
    the time of its fix and takes that one point with it; all other points are
    AIS rows. begin and end lie a second outside all fixes and overpasses.
    """
    key = F.struct(*TRACK).alias("_track")
    at = overpasses(points, revisit_times(points.sparkSession, seed), margin, day).withColumn("_track", key)
    near = nearest_fix(at, points.withColumn("_track", key).withColumn("no", F.col("seq")), "_track", "_track", ["lat", "lon", "heading", "no"]).where("fix_t is not null")
    draw = ("mmsi", "track_id", "t")
    metres, bearing = gaussian_error(*draw, seed=seed) if model == "gaussian" else uniform_error(F.coalesce("fix_heading", F.lit(0.0)), *draw, seed=seed)
    lat, lon = geo.destination(F.col("fix_lat"), F.col("fix_lon"), bearing, metres)
    # A generator computes its columns once; as plain columns they would be copied into every later expression.
    rf = near.select("*", F.inline(F.array(F.struct(lat.alias("_lat"), lon.alias("_lon")))))
    km, apart = geo.haversine(F.col("fix_lat"), F.col("fix_lon"), F.col("_lat"), F.col("_lon")), F.abs(F.col("t") - F.col("fix_t"))
    rf = rf.select("*", F.inline(F.array(F.struct(km.alias("_km"), apart.alias("_apart")))))
    matched = prob.match(F.col("_apart"), F.col("_km")) > prob.transition(F.col("_apart"), F.col("_km"))
    at_fix = F.col("state") == "M"
    rf = rf.withColumn("state", F.when(matched, "M").otherwise("RF"))
    rf = rf.select(*TRACK, F.when(at_fix, F.col("fix_t")).otherwise(F.col("t")).alias("t"), F.when(at_fix, F.col("fix_t")).alias("ais_t"), F.col("t").alias("rf_t"), F.when(at_fix, F.struct(F.col("fix_lat").alias("lat"), F.col("fix_lon").alias("lon"))).alias("ais"), F.struct(F.col("_lat").alias("lat"), F.col("_lon").alias("lon")).alias("rf"), "state", "fix_no")
    nothing, never = F.lit(None).cast("struct<lat:double,lon:double>"), F.lit(None).cast("double")
    used = rf.where("state = 'M'").select(*TRACK, F.col("ais_t").alias("t"), F.col("fix_no").alias("seq")).distinct()
    alone = points.join(used, [*TRACK, "t", "seq"], "left_anti").select(*TRACK, "t", F.col("t").alias("ais_t"), never.alias("rf_t"), F.struct("lat", "lon").alias("ais"), nothing.alias("rf"), F.lit("AIS").alias("state"))
    body = rf.drop("fix_no").unionByName(alone)
    # Every fix is in the body: as a row of its own, or as the ais_t of a match.
    ends = body.groupBy(*TRACK).agg(F.least(F.min("ais_t"), F.min("rf_t")).alias("lo"), F.greatest(F.max("ais_t"), F.max("rf_t")).alias("hi"))
    marks = ends.select(*TRACK, F.inline(F.array(F.struct((F.col("lo") - 1).alias("t"), F.lit("begin").alias("state")), F.struct((F.col("hi") + 1).alias("t"), F.lit("end").alias("state")))))
    return body.unionByName(marks.select(*TRACK, "t", never.alias("ais_t"), never.alias("rf_t"), nothing.alias("ais"), nothing.alias("rf"), "state"))
