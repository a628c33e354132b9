"""Cleaning and segmenting position reports, and statistics of tracks.

Reports have mmsi, t (seconds), seq (tie-break), lat, lon. Unknown values are
NULL, never NaN: Spark holds NaN above every number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import draw, geo, prob
from wakeline.schema import TRACK

EXACT_LIMIT, BINS = 1_000_000, 4096


def in_order(*keys: str):
    return Window.partitionBy(*keys).orderBy("t", "seq")


def no_nan(df: DataFrame) -> DataFrame:
    return df.select(*(F.nanvl(c, F.lit(None).cast(k)).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes))


def of_type(reports: DataFrame, names: DataFrame, wanted: str = "Cargo") -> DataFrame:
    """Reports whose vessel_type code has the wanted name in the (code, name) lookup."""
    codes = names.where(F.col("name") == wanted).select(F.col("code").cast("string").alias("code")).distinct()
    return reports.join(codes, F.col("vessel_type").cast("string") == F.col("code"), "left_semi")


def remove_short_tracks(reports: DataFrame, most: int = 5) -> DataFrame:
    """Drops vessels with ``most`` reports or fewer."""
    return reports.withColumn("_n", F.count("*").over(Window.partitionBy("mmsi"))).where(F.col("_n") > most).drop("_n")


def add_speed(reports: DataFrame) -> DataFrame:
    """Seconds, kilometres and km/h since the vessel's report before; speed is 0 where either is not positive or unknown."""
    w = in_order("mmsi")
    seconds = F.col("t") - F.lag("t").over(w)
    km = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    moved = reports.withColumn("time_diff", seconds).withColumn("distance_diff", km)
    return moved.withColumn("speed_kph", F.when((F.col("time_diff") > 0) & (F.col("distance_diff") > 0), F.col("distance_diff") / F.col("time_diff") * 3600).otherwise(0.0))


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles by linear interpolation, NULLs left out.

    Up to ``EXACT_LIMIT`` values one aggregate does it. Beyond, the two order
    statistics of each quantile are closed in on by histograms: each pass
    counts ``BINS`` bins on the map side and keeps the bin that holds the rank,
    so no task ever holds all values.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if n <= EXACT_LIMIT:
        return list(values.agg(*(F.percentile("v", F.lit(q)).alias(f"q{k}") for k, q in enumerate(shares))).first())
    out = []
    for q in shares:
        rank = q * (n - 1)
        below = int(rank)
        a = order_statistic(values, below, low, high)
        b = a if rank == below else order_statistic(values, below + 1, low, high)
        out.append(a + (b - a) * (rank - below))
    return out


def order_statistic(values: DataFrame, rank: int, low: float, high: float, limit: int = EXACT_LIMIT) -> float:
    """The value at ``rank`` (from 0) of the sorted column v, which lies in [low, high]."""
    while True:
        part = values.where((F.col("v") >= low) & (F.col("v") <= high))
        width = (high - low) / BINS
        if width == 0 or low + width == low:
            return low
        bins = F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1))
        for row in part.groupBy(bins.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect():
            if rank < row.n:
                low, high, size = row.lo, row.hi, row.n
                break
            rank -= row.n
        if size <= limit:
            return values.where((F.col("v") >= low) & (F.col("v") <= high)).agg(F.percentile("v", F.lit(rank / max(1, size - 1)))).first()[0]


def remove_high_speed_outliers(reports: DataFrame) -> DataFrame:
    """Drops vessels with any report above Q3 + 1.5 times the interquartile range of all speeds."""
    q1, q3 = exact_quantiles(reports, "speed_kph", [0.25, 0.75])
    if q1 is None:
        return reports
    fast = F.coalesce(F.bool_or(F.col("speed_kph") > q3 + 1.5 * (q3 - q1)).over(Window.partitionBy("mmsi")), F.lit(False))
    return reports.withColumn("_fast", fast).where("not _fast").drop("_fast")


def remove_low_speed_outliers(reports: DataFrame, least: float = 5.0) -> DataFrame:
    """Drops vessels with a mean speed below ``least``; an unknown mean stays."""
    mean = F.avg("speed_kph").over(Window.partitionBy("mmsi"))
    return reports.withColumn("_mean", mean).where(~F.coalesce(F.col("_mean") < least, F.lit(False))).drop("_mean")


def split_tracks(reports: DataFrame, gap_share: float = 0.99, least_points: int = 5, least_speed: float = 5.0) -> DataFrame:
    """Cuts vessels where a gap exceeds the quantile of all gaps; keeps tracks with enough points and speed.

    A track's first point has no time, distance or speed difference.
    """
    (gap,) = exact_quantiles(reports, "time_diff", [gap_share])
    new = F.when(F.col("time_diff") > (float("inf") if gap is None else gap), 1).otherwise(0)
    cut = reports.withColumn("track_id", F.sum(new).over(in_order("mmsi").rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    whole = Window.partitionBy("mmsi", "track_id")
    cut = cut.withColumn("_n", F.count("*").over(whole)).withColumn("_first", F.row_number().over(in_order(*TRACK)) == 1).where(F.col("_n") >= least_points)
    for c in ("time_diff", "distance_diff", "speed_kph"):
        cut = cut.withColumn(c, F.when(~F.col("_first"), F.col(c)))
    return cut.withColumn("_mean", F.avg("speed_kph").over(whole)).where(F.col("_mean") >= least_speed).drop("_n", "_first", "_mean")


def track_characteristics(points: DataFrame) -> DataFrame:
    """One row of statistics for each track; deviations are sample ones, but population ones for the _corr and _log columns."""
    strength = prob.transition(F.col("time_diff"), F.col("distance_diff"))
    p = points.withColumn("_p", strength).withColumn("_c", F.sqrt("_p")).withColumn("_l", prob.log(F.col("_c")))
    stats = [
        F.count("*").alias("n_points"),
        ((F.max("t") - F.min("t")) / 60).alias("track_duration"),
        F.avg("speed_kph").alias("avg_speed_kph"),
        (F.max("lat") - F.min("lat")).alias("lat_span"),
        (F.max("lon") - F.min("lon")).alias("lon_span"),
    ]
    for name, column, deviation in (("intra_time_diff", "time_diff", F.stddev_samp), ("intra_dist_diff", "distance_diff", F.stddev_samp), ("transition_strength", "_p", F.stddev_samp), ("transition_strength_corr", "_c", F.stddev_pop), ("transition_strength_log", "_l", F.stddev_pop)):
        stats += [F.avg(column).alias(f"mean_{name}"), deviation(column).alias(f"std_{name}")]
    return p.groupBy(*TRACK).agg(*stats)


FEATURES = ["n_points", "track_duration", "avg_speed_kph", "lat_span", "lon_span", "mean_intra_time_diff"]


def kde_log_density(rows: DataFrame, keys: list[str], features: list[str] = FEATURES, bandwidth: float = 0.5, block_rows: int = 50_000) -> DataFrame:
    """Gaussian kernel log density of every row's standardised features; rows with an unknown feature have none.

    Every row meets every row. One side comes in blocks of about ``block_rows``
    rows by a hash of the key, each a broadcast of bounded size, and the other
    side sums a block on the map side. A row's own kernel is 1, so the plain
    sum cannot vanish.
    """
    full = rows.where(" and ".join(f"{f} is not null" for f in features))
    first = full.agg(F.count("*").alias("n"), *(g(f).alias(f"{k}_{f}") for f in features for k, g in (("m", F.avg), ("s", F.stddev_pop)))).first()
    n, d = first["n"], len(features)
    scale = {f: float(first[f"s_{f}"] or 1.0) for f in features}
    z = [((F.col(f) - F.lit(first[f"m_{f}"])) / scale[f]).cast("double").alias(f"z{k}") for k, f in enumerate(features)]
    scaled = full.select(*keys, *z)
    blocks, sums = max(1, -(-n // block_rows)), None
    for k in range(blocks):
        some = scaled.where(F.pmod(F.xxhash64(*keys), F.lit(blocks)) == k).select(*(F.col(f"z{i}").alias(f"y{i}") for i in range(d)))
        far = sum(((F.col(f"z{i}") - F.col(f"y{i}")) ** 2 for i in range(1, d)), (F.col("z0") - F.col("y0")) ** 2)
        part = scaled.join(F.broadcast(some)).groupBy(*keys).agg(F.sum(F.exp(-far / (2 * bandwidth**2))).alias("mass"))
        sums = part if sums is None else sums.unionByName(part)
    shift = math.log(max(n, 1)) + d * math.log(bandwidth) + d / 2 * math.log(2 * math.pi)
    return sums.groupBy(*keys).agg((F.log(F.sum("mass")) - shift).alias("log_density"))


def density_curves(rows: DataFrame, by: str, features: list[str] = FEATURES, points: int = 200, cut: float = 3.0) -> DataFrame:
    """(by, feature, i, x, density): one-dimensional Gaussian kernel densities on a grid of ``points`` places.

    The bandwidth is the sample deviation times n^(-1/5); the grid reaches
    ``cut`` bandwidths beyond the extremes. A feature without two different
    values has no curve. Each row adds to each place on the map side, so what
    is shuffled does not grow with the rows.
    """
    held = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features)))
    long = rows.select(by, held.alias("_x")).select(by, "_x.*").where("v is not null")
    width = F.stddev_samp("v") * F.pow(F.count("*").cast("double"), F.lit(-0.2))
    stats = long.groupBy(by, "feature").agg(width.alias("bw"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("bw > 0")
    place = F.col("lo") - cut * F.col("bw") + F.col("i") * (F.col("hi") - F.col("lo") + 2 * cut * F.col("bw")) / (points - 1)
    laid = long.join(stats, [by, "feature"]).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", place)
    kernel = F.exp(-F.pow((F.col("x") - F.col("v")) / F.col("bw"), F.lit(2.0)) / 2) / (F.col("bw") * math.sqrt(2 * math.pi))
    return laid.groupBy(by, "feature", "i").agg(F.first("x").alias("x"), F.avg(kernel).alias("density"))


def vessel_speed_box(reports: DataFrame) -> DataFrame:
    """One row of box-plot figures over the vessels' mean speeds; whiskers end at the last vessel within 1.5 interquartile ranges."""
    v = F.col("v")
    speeds = reports.groupBy("mmsi").agg(F.avg("speed_kph").alias("v")).where("v is not null")
    q1, med, q3 = exact_quantiles(speeds, "v", [0.25, 0.5, 0.75])
    inner = F.lit(False) if q1 is None else v.between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    quartiles = [F.lit(x).cast("double").alias(c) for c, x in (("q1", q1), ("med", med), ("q3", q3))]
    ends = [g(F.when(inner, v)).alias(f"whisker_{c}") for c, g in (("low", F.min), ("high", F.max))]
    return speeds.agg(F.count("*").alias("n_vessels"), F.avg("v").alias("mean"), *ends, F.count_if(~inner).alias("n_outliers")).select(*quartiles, "*")


def sampling_weight(log_density: Column, power: float = 0.25) -> Column:
    return F.exp(-log_density * power)


def weighted_sample(tracks: DataFrame, n: int, weight: str = "sampling_weight", keys: list[str] = TRACK, seed: int = 42) -> DataFrame:
    """n rows without replacement with chances by weight: the smallest of -ln(u) / weight, u a hash of the key."""
    u = draw.uniform(*keys, seed=seed)
    return tracks.withColumn("_k", -F.log(u) / F.col(weight)).orderBy("_k", *keys).limit(n).drop("_k")
