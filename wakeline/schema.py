"""Keys and declared schemas."""

from pyspark.sql import types as T

TRACK = ["mmsi", "track_id"]
RF = ["rf_mmsi", "rf_track_id", "rf_signal_id"]
PAIR = [*RF, *TRACK]

REPORT = T.StructType(
    [
        T.StructField("mmsi", T.LongType()),
        T.StructField("imo", T.StringType()),
        T.StructField("base_date_time", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("sog", T.DoubleType()),
        T.StructField("heading", T.DoubleType()),
        T.StructField("vessel_type", T.IntegerType()),
    ]
)
