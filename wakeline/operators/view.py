"""Tables behind maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.schema import TRACK

# Fixed value: degrees by which an arrow that points north-east is turned back to north.
ARROW = 315


def map_markers(points: DataFrame, detections: DataFrame, vessels: list[int] | None = None) -> DataFrame:
    """(layer, mmsi, track_id, t, lat, lon, rotation): points as arrows turned by heading and detections as marks without one.

    With ``vessels`` only those; rows without a position are left out. An
    unknown heading has no rotation.
    """
    place = ["t", "lat", "lon"]
    ais = points.select(F.lit("AIS").alias("layer"), *TRACK, *place, (F.col("heading") + ARROW).cast("double").alias("rotation"))
    rf = detections.select(F.lit("RF").alias("layer"), F.col("rf_mmsi").alias("mmsi"), F.col("rf_track_id").alias("track_id"), *place, F.lit(None).cast("double").alias("rotation"))
    both = ais.unionByName(rf).where("lat is not null and lon is not null")
    return both if vessels is None else both.where(F.col("mmsi").isin(vessels))
