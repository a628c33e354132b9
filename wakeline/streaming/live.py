"""Live detections against a table of tracks.

The track side is static, so each micro-batch runs the same range join and
semi join as a batch does; a watermark drops detections that come too late and
keeps duplicates out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wakeline.operators import preselect


def candidates(stream: DataFrame, points: DataFrame, km: float = preselect.KM, window: float = preselect.WINDOW_SECONDS, lateness: str = "1 hour") -> DataFrame:
    """Candidate pairs of a stream of detections (RF key, ts, t, lat, lon)."""
    fresh = stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["rf_mmsi", "rf_track_id", "rf_signal_id"])
    return preselect.near_pairs(preselect.box_pairs(fresh, preselect.track_meta(points, km)), points, km, window)


def detections_per_window(stream: DataFrame, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Detections of each vessel by tumbling window."""
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", width), "rf_mmsi").agg(F.count("*").alias("n"))


def to_parquet(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    out = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
