"""Preselection: which tracks may have produced a detection.

Detections have the RF key, t, lat, lon; points have the track key, t, lat, lon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.schema import RF, TRACK

KM, MARGIN_SECONDS, WINDOW_SECONDS = 6.0, 600.0, 3 * 3600.0
CELL_DEGREES, CELL_SECONDS = 0.25, 3600.0


def nearest_fix(left: DataFrame, points: DataFrame, key: str, left_key: str, carry: list[str]) -> DataFrame:
    """Each left row with the point of its key that is nearest in time, the earlier (then first) one on ties.

    One union and two window passes: the last point up to the row and the
    first one after it; linear in both inputs, where a join would pair every
    row with every point of its key.
    """
    found = F.struct(F.col("t").alias("at"), *carry)
    p = points.groupBy(key, "t").agg(F.min(F.struct("seq", *carry)).alias("_p")).select(key, "t", "_p.*")
    marks = p.select(F.col(key).alias("_key"), "t", F.lit(0).alias("_side"), found.alias("_fix"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"))
    rows = left.select(F.col(left_key).alias("_key"), "t", F.lit(1).alias("_side"), F.lit(None).cast(marks.schema["_fix"].dataType).alias("_fix"), F.struct("*").alias("_row"))
    w = Window.partitionBy("_key").orderBy("t", "_side")
    both = marks.unionByName(rows).withColumn("_before", F.last("_fix", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_after", F.first("_fix", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    near = F.when(F.col("_before").isNull(), F.col("_after")).when(F.col("_after").isNull(), F.col("_before")).when(F.col("t") - F.col("_before.at") <= F.col("_after.at") - F.col("t"), F.col("_before")).otherwise(F.col("_after"))
    return both.where("_side = 1").select("_row.*", near.alias("_near")).select("*", F.col("_near.at").alias("fix_t"), *(F.col(f"_near.{c}").alias(f"fix_{c}") for c in carry)).drop("_near")


def number_signals(detections: DataFrame) -> DataFrame:
    """rf_signal_id: running number of a track's detections, from 1."""
    w = Window.partitionBy("rf_mmsi", "rf_track_id").orderBy("t", "seq")
    return detections.withColumn("rf_signal_id", F.row_number().over(w).cast("bigint"))


def track_meta(points: DataFrame, km: float = KM) -> DataFrame:
    """Time range and box of each track; the box is widened by ``km``, west by the cosine at its south, east at its north.

    The box is part of the result, not only a prefilter: do not widen it.
    """
    seen = points.where("lat is not null and lon is not null and t is not null")
    m = seen.groupBy(*TRACK).agg(*(g(c).alias(f"{k}_{c}") for c in ("t", "lat", "lon") for k, g in (("min", F.min), ("max", F.max))), F.count("*").alias("n_points"))
    side = lambda lat: km / (geo.KM_PER_DEGREE * F.cos(F.radians(lat)))
    up = km / geo.KM_PER_DEGREE
    return m.select(*TRACK, "n_points", "min_t", "max_t", "min_lat", "max_lat", "min_lon", "max_lon", (F.col("min_lat") - up).alias("south"), (F.col("max_lat") + up).alias("north"), (F.col("min_lon") - side(F.col("min_lat"))).alias("west"), (F.col("max_lon") + side(F.col("max_lat"))).alias("east"))


def _inside(margin: float):
    return (F.col("t") >= F.col("min_t") - margin) & (F.col("t") <= F.col("max_t") + margin) & F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))


def _level(span, size: float):
    """The coarser grid, four times as wide with each level, on which a span of this length touches at most three cells."""
    return F.ceil(F.log2(F.greatest(span / (2 * size), F.lit(1.0))) / 2).cast("int")


def laid_over(meta: DataFrame, margin: float = MARGIN_SECONDS, cell: float = CELL_DEGREES, slot: float = CELL_SECONDS) -> DataFrame:
    """Tracks with the cells that their time range and box touch: at most 27 each, however long the track is.

    A cell is (level in time, level in space, slot, row, column).
    """
    wide = F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west"))
    t = meta.select(*TRACK, "min_t", "max_t", "south", "north", "west", "east", _level(F.col("max_t") - F.col("min_t") + 2 * margin, slot).alias("_a"), _level(wide, cell).alias("_b"))
    over = lambda lo, hi, step: F.explode(F.sequence(F.floor(lo / step), F.floor(hi / step)))
    time, space = slot * F.pow(F.lit(4.0), F.col("_a")), cell * F.pow(F.lit(4.0), F.col("_b"))
    t = t.withColumn("_s", over(F.col("min_t") - margin, F.col("max_t") + margin, time))
    return t.withColumn("_y", over(F.col("south"), F.col("north"), space)).withColumn("_x", over(F.col("west"), F.col("east"), space))


def box_pairs(detections: DataFrame, meta: DataFrame, margin: float = MARGIN_SECONDS, cell: float = CELL_DEGREES, slot: float = CELL_SECONDS) -> DataFrame:
    """Detections with the tracks whose time range and box hold them.

    A range join as a hash join: each track is laid over a space-time grid as
    coarse as it is long, a detection lies in one cell of each grid in use, and
    the exact condition follows. A detection meets a track in one cell only, so
    nothing has to be made distinct. The grids in use, a few dozen at most, come
    to the driver first. Hot cells, such as ports, are left to Spark's skew join.
    """
    tracks = laid_over(meta, margin, cell, slot)
    used = sorted((r._a, r._b) for r in tracks.select("_a", "_b").distinct().collect()) or [(0, 0)]
    rf = detections.withColumn("_g", F.explode(F.array(*(F.struct(F.lit(a).alias("_a"), F.lit(b).alias("_b")) for a, b in used)))).select("*", "_g._a", "_g._b").drop("_g")
    time, space = slot * F.pow(F.lit(4.0), F.col("_a")), cell * F.pow(F.lit(4.0), F.col("_b"))
    rf = rf.withColumns({"_s": F.floor(F.col("t") / time), "_y": F.floor(F.col("lat") / space), "_x": F.floor(F.col("lon") / space)})
    return rf.join(tracks, ["_a", "_b", "_s", "_y", "_x"]).where(_inside(margin)).select(*RF, F.col("t").alias("rf_t"), F.col("lat").alias("rf_lat"), F.col("lon").alias("rf_lon"), *TRACK)


def box_pairs_nested(detections: DataFrame, meta: DataFrame, margin: float = MARGIN_SECONDS) -> DataFrame:
    """The same pairs by the plain condition; for tests."""
    return detections.join(meta, _inside(margin)).select(*RF, F.col("t").alias("rf_t"), F.col("lat").alias("rf_lat"), F.col("lon").alias("rf_lon"), *TRACK)


def near_pairs(pairs: DataFrame, points: DataFrame, km: float = KM, window: float = WINDOW_SECONDS) -> DataFrame:
    """Pairs for which some point of the track lies within the window and the distance.

    The join key holds a slot of time eight windows long, so a pair reads the
    points of one slot of its track and not of all. A point stands in each slot
    that its window touches, two at most and 1.25 on average.
    """
    slot, reach = 8 * window, 1.001 * window
    slots = F.sequence(F.floor((F.col("t") - reach) / slot), F.floor((F.col("t") + reach) / slot))
    p = points.where("t is not null").select(*(F.col(c).alias(f"_{c}") for c in (*TRACK, "t", "lat", "lon")), F.explode(slots).alias("_slot"))
    close = (F.col("mmsi") == F.col("_mmsi")) & (F.col("track_id") == F.col("_track_id")) & (F.floor(F.col("rf_t") / slot) == F.col("_slot")) & (F.abs(F.col("_t") - F.col("rf_t")) <= window) & (geo.haversine(F.col("rf_lat"), F.col("rf_lon"), F.col("_lat"), F.col("_lon")) <= km)
    return pairs.join(p, close, "left_semi")


def is_true():
    return (F.col("rf_mmsi") == F.col("mmsi")) & (F.col("rf_track_id") == F.col("track_id"))


def candidates(detections: DataFrame, points: DataFrame, km: float = KM, window: float = WINDOW_SECONDS, margin: float = MARGIN_SECONDS, force_true: bool = True, leave_one_out: bool = False) -> DataFrame:
    """Candidate pairs with is_true_match.

    ``force_true``: the true track is a candidate whatever the filters say.
    ``leave_one_out``: the true track is none.
    """
    meta = track_meta(points, km)
    found = near_pairs(box_pairs(detections, meta, margin), points, km, window)
    if not (force_true or leave_one_out):
        return found.withColumn("is_true_match", is_true())
    others = found.where(~is_true()).withColumn("is_true_match", F.lit(False))
    if leave_one_out:
        return others
    own = detections.select(*RF, F.col("t").alias("rf_t"), F.col("lat").alias("rf_lat"), F.col("lon").alias("rf_lon"), F.col("rf_mmsi").alias("mmsi"), F.col("rf_track_id").alias("track_id"))
    own = own.join(meta.select(*TRACK), TRACK, "left_semi").withColumn("is_true_match", F.lit(True))
    return others.unionByName(own)


def prefilter_recall(detections: DataFrame, points: DataFrame, km: float = KM, window: float = WINDOW_SECONDS, margin: float = MARGIN_SECONDS) -> DataFrame:
    """Each detection and whether its own track passes the filters."""
    meta = track_meta(points, km).withColumnsRenamed({"mmsi": "_m", "track_id": "_k"})
    own = detections.join(meta, (F.col("rf_mmsi") == F.col("_m")) & (F.col("rf_track_id") == F.col("_k"))).where(_inside(margin))
    own = own.select(*RF, F.col("t").alias("rf_t"), F.col("lat").alias("rf_lat"), F.col("lon").alias("rf_lon"), F.col("_m").alias("mmsi"), F.col("_k").alias("track_id"))
    passed = near_pairs(own, points, km, window).select(*RF, F.lit(True).alias("passed_prefilter"))
    return detections.select(*RF).join(passed, RF, "left").withColumn("passed_prefilter", F.coalesce("passed_prefilter", F.lit(False)))


def prefilter_rate(recall: DataFrame) -> DataFrame:
    """The share of detections whose own track passes the filters."""
    return recall.agg(F.count("*").alias("n_signals"), F.avg(F.col("passed_prefilter").cast("double")).alias("recall"))


def sibling_overlap(pairs: DataFrame) -> DataFrame:
    """Each detection and whether another track of its own vessel is a candidate."""
    sibling = (F.col("rf_mmsi") == F.col("mmsi")) & (F.col("rf_track_id") != F.col("track_id"))
    return pairs.groupBy(*RF).agg(F.bool_or(sibling).alias("has_sibling_candidate"))
