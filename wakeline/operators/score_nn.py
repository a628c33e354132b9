"""Nearest-neighbour scores of candidate pairs; smaller is better.

``SCORERS`` is the extension point: a scorer takes (pairs, points) and returns
the pair key with a score. One merge join on the track serves a whole scorer, and the
aggregate keeps that partitioning; a broadcast of the pairs would leave all
work to the few tasks that read the points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.operators.prep import in_order
from wakeline.schema import PAIR, TRACK


def _min_over(pairs: DataFrame, points: DataFrame, score: Column) -> DataFrame:
    return pairs.hint("merge").join(points, TRACK).groupBy(*PAIR).agg(F.min(score).alias("score"))


def by_point(distance: Callable[..., Column]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A scorer from any distance of two points (lat, lon, lat, lon)."""
    return lambda pairs, points: _min_over(pairs, points.select(*TRACK, "lat", "lon"), distance(F.col("rf_lat"), F.col("rf_lon"), F.col("lat"), F.col("lon")))


def legs(points: DataFrame) -> DataFrame:
    """Each point with the next one of its track; a track of one point is a leg without length."""
    w = in_order(*TRACK)
    nexts = points.select(*TRACK, "t", "lat", "lon", *(F.lead(c).over(w).alias(f"{c}2") for c in ("t", "lat", "lon")), F.row_number().over(w).alias("_i"))
    kept = nexts.where("t2 is not null or _i = 1").withColumns({c: F.coalesce(c, F.col(c[:-1])) for c in ("t2", "lat2", "lon2")})
    return kept.drop("_i")


def _on_leg() -> tuple[Column, Column]:
    x1, y1 = geo.local_xy(F.col("lat"), F.col("lon"), F.col("rf_lat"), F.col("rf_lon"))
    x2, y2 = geo.local_xy(F.col("lat2"), F.col("lon2"), F.col("rf_lat"), F.col("rf_lon"))
    return geo.to_segment(x1, y1, x2, y2)


def segment(pairs: DataFrame, points: DataFrame) -> DataFrame:
    return _min_over(pairs, legs(points), _on_leg()[0])


def time_weighted(pairs: DataFrame, points: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Distance to the leg and time to the place on it, on common scales."""
    km, share = _on_leg()
    seconds = F.abs(F.col("t") + share * (F.col("t2") - F.col("t")) - F.col("rf_t"))
    return _min_over(pairs, legs(points), geo.combined_score(km, seconds, alpha))


SCORERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "nn_euclidean": by_point(geo.degrees_apart),
    "nn_haversine": by_point(geo.haversine),
    "nn_segment": segment,
    "nn_time_weighted": time_weighted,
}
