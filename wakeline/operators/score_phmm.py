"""Pair-HMM scores of candidate pairs in closed form.

A detection is one observation, so the Forward table has two columns, before
and after it is consumed. Both are running sums of log transitions along the
track, and the total is one log-sum-exp over the points where the detection
can be consumed.

Forward scores meet each pair with its track as arrays, behind a merge join on the
track: a row for each pair and point would have to be sorted for running sums, 38
times the pairs, and fills the disk. A track's points are in one row. Paths
(``viterbi``) have such rows; their windows share one order and the partitioning
of the join, so they are not shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wakeline.functions import geo, prob
from wakeline.operators.prep import in_order
from wakeline.schema import PAIR, TRACK

KAPPA = (0.5, 2.0)
START, END, STAY, CELLS = 1 / 3, 0.05, 0.95, 1 << 18
STEP = ["t", "lat", "lon", "p_next", "p_prev", "prev_t", "prev_km"]


def steps(points: DataFrame) -> DataFrame:
    """Points with the transition to the next point and from the one before, and that point's place."""
    w = in_order(*TRACK)
    before = {c: F.lag(c).over(w) for c in ("t", "lat", "lon")}
    ahead = {c: F.lead(c).over(w) for c in ("t", "lat", "lon")}
    km = lambda o: geo.haversine(F.col("lat"), F.col("lon"), o["lat"], o["lon"])
    out = F.when(ahead["t"].isNull(), 0.0).otherwise(prob.transition(ahead["t"] - F.col("t"), km(ahead)))
    back = F.when(before["t"].isNull(), 0.0).otherwise(prob.transition(F.col("t") - before["t"], km(before)))
    return points.select(*TRACK, "t", "seq", "lat", "lon", out.alias("p_next"), back.alias("p_prev"), before["t"].alias("prev_t"), km(before).alias("prev_km"))


def laid_out(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """One row for each pair and point of its track with all one-step probabilities."""
    km = geo.haversine(F.col("lat"), F.col("lon"), F.col("rf_lat"), F.col("rf_lon"))
    x = pairs.select(*PAIR, "rf_t", "rf_lat", "rf_lon").hint("merge").join(steps(points), TRACK).withColumn("km", km)
    since = F.col("t") - F.col("rf_t")
    return x.withColumns({"p_rf": prob.transition(-since, F.col("km")), "p_back": prob.transition(since, F.col("km")), "p_match": prob.match(F.abs(since), F.col("km"))})


def tracks_in_rows(points: DataFrame) -> DataFrame:
    """One row for each track with its steps as arrays, in order."""
    one = F.struct("t", "seq", *STEP[1:])
    rows = steps(points).groupBy(*TRACK).agg(F.array_sort(F.collect_list(one)).alias("_x"))
    return rows.select(*TRACK, *(F.col(f"_x.{c}").alias(c) for c in STEP))


def forward(pairs: DataFrame, points: DataFrame, kappa: tuple[float, float] = KAPPA, null: bool = False) -> DataFrame:
    """The pair key with n_points and the Forward log probability; ``null``: nothing may match."""
    return _forward(pairs, points, kappa, [null]).withColumnRenamed("score_0", "score")


def _moves(x: DataFrame, kappa: tuple[float, float], nulls: list[bool], raw: bool = False) -> DataFrame:
    """Log probabilities of the ways to consume the detection, for each model k.

    At point i: x1 after the point before it alone, x2 together with that
    point, each with all that follows; at the last point: x3 after it alone,
    x4 together with it. ``raw``: match emissions are not normalised.
    """
    ka, kr = kappa
    order = Window.partitionBy(*PAIR).orderBy("t", "seq")
    whole, ahead, upto = Window.partitionBy(*PAIR), order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    log, start = prob.log, prob.log(F.lit(START))
    last = F.lead("t").over(order).isNull()
    x = x.withColumns({"pm": F.coalesce(F.lead("p_match").over(order), F.lit(0.0)), "last": last, "i": F.row_number().over(order), "n": F.count("*").over(whole), "e": log(F.col("p_match") / (F.lit(1.0) if raw else F.sum("p_match").over(whole) + prob.FLOOR))})
    total = F.col("p_next") + F.col("p_rf") + F.col("pm")
    stay = STAY**ka
    seen_before = F.coalesce(F.col("prev_t") > F.col("rf_t"), F.lit(False))
    same = F.when(seen_before, (F.col("t") == F.col("prev_t")) & (F.col("prev_km") == 0)).otherwise((F.col("t") == F.col("rf_t")) & (F.col("km") == 0))
    after = F.when(seen_before, F.col("p_prev")).otherwise(F.col("p_back"))
    x = x.withColumns(
        {
            "aa": log(F.pow(prob.share(F.col("p_next"), total), F.lit(ka))),
            "ar": log(F.pow(prob.share(F.col("p_rf"), total), F.lit(kr))),
            "am": log(F.pow(prob.share(F.col("pm"), total), F.lit(kr))),
            "w": F.when(F.col("i") == 1, 0.0).otherwise(log(F.when(F.col("p_prev") > 0, stay).otherwise(0.0))),
            "from_rf": log(F.when(F.col("p_back") > 0, stay).otherwise(0.0)),
            "from_m": log(F.when(~same & (after > 0), stay).otherwise(0.0)),
        }
    )
    x = x.withColumns({"a0": start + F.coalesce(F.sum("aa").over(ahead), F.lit(0.0)), "s": F.sum("w").over(upto), "sn": F.sum("w").over(whole)})
    x = x.withColumn("r", F.col("a0") + F.col("ar"))
    for k, null in enumerate(nulls):
        am = prob.log(F.lit(0.0)) if null else F.lag("am").over(order)
        m = F.when(F.col("i") == 1, (log(F.lit(0.0)) if null else start) + F.col("e")).otherwise(F.lag("a0").over(order) + am + F.col("e"))
        x = x.withColumn(f"m_{k}", m)
        x = x.withColumns(
            {
                f"x1_{k}": F.coalesce(F.lag("r").over(order), start) + F.col("from_rf") + F.col("sn") - F.col("s"),
                f"x2_{k}": F.lag(f"m_{k}").over(order) + F.col("from_m") + F.col("sn") - F.col("s"),
                f"x3_{k}": F.when(F.col("last"), F.col("r")),
                f"x4_{k}": F.when(F.col("last"), F.col(f"m_{k}")),
            }
        )
    return x


def _log(p: np.ndarray) -> np.ndarray:
    return np.log(p + prob.FLOOR)


def _totals(x: dict[str, np.ndarray], rf: dict[str, np.ndarray], kappa: tuple[float, float], nulls: list[bool]) -> list[np.ndarray]:
    """Forward log probabilities of pairs whose tracks have equally many points, for each model: rows are pairs, columns points in order.

    The ways to consume the detection are those of ``_moves``. An unknown value is NaN here.
    """
    (ka, kr), t, km = kappa, x["t"], geo.haversine_of(x["lat"], x["lon"], rf["rf_lat"], rf["rf_lon"])
    since, stay, start = t - rf["rf_t"], STAY**ka, _log(np.float64(START))
    p_rf, p_back, p_match = prob.transition_of(-since, km), prob.transition_of(since, km), prob.match_of(np.abs(since), km)
    pm = np.hstack([p_match[:, 1:], np.zeros((len(t), 1))])
    e = _log(p_match / (p_match.sum(axis=1, keepdims=True) + prob.FLOOR))
    total = x["p_next"] + p_rf + pm
    share = lambda p, k: _log(np.where(total == 0, 0.0, p / np.where(total == 0, 1.0, total) * (1 - prob.RESERVED)) ** k)
    zero = lambda d: (d == 0) | np.isnan(d)
    later = x["prev_t"] > rf["rf_t"]
    same = np.where(later, (t == x["prev_t"]) & zero(x["prev_km"]), (t == rf["rf_t"]) & zero(km))
    after = np.where(later, x["p_prev"], p_back)
    aa, ar, am = share(x["p_next"], ka), share(p_rf, kr), share(pm, kr)
    w = _log(np.where(x["p_prev"] > 0, stay, 0.0))
    w[:, 0] = 0.0
    s = np.cumsum(w, axis=1)
    rest = s[:, -1:] - s
    from_rf, from_m = _log(np.where(p_back > 0, stay, 0.0)) + rest, _log(np.where(~same & (after > 0), stay, 0.0)) + rest
    a0 = start + np.hstack([np.zeros((len(t), 1)), np.cumsum(aa, axis=1)[:, :-1]])
    r, out = a0 + ar, []
    for null in nulls:
        none = _log(np.float64(0.0))
        m = np.hstack([(none if null else start) + e[:, :1], a0[:, :-1] + (none if null else am[:, :-1]) + e[:, 1:]])
        ways = np.hstack([start + from_rf[:, :1], r[:, :-1] + from_rf[:, 1:], m[:, :-1] + from_m[:, 1:], r[:, -1:], m[:, -1:]])
        top = ways.max(axis=1, keepdims=True)
        out.append((top + np.log(np.exp(ways - top).sum(axis=1, keepdims=True)))[:, 0] + _log(np.float64(END)))
    return out


def _kernel(schema: pa.Schema, kappa: tuple[float, float], nulls: list[bool]):
    """Pairs with the arrays of their tracks in, pairs with scores out; about ``CELLS`` pairs times points at once."""

    def run(batches):
        for b in batches:
            lists = {c: b.column(c) for c in STEP}
            ends = lists["t"].offsets.to_numpy().astype(np.int64)
            first, n = ends[:-1], np.diff(ends)
            flat = {c: a.values.to_numpy(zero_copy_only=False).astype(np.float64) for c, a in lists.items()}
            rf = {c: b.column(c).to_numpy(zero_copy_only=False).astype(np.float64)[:, None] for c in ("rf_t", "rf_lat", "rf_lon")}
            made = [np.empty(len(n)) for _ in nulls]
            for size in np.unique(n):
                rows = np.flatnonzero(n == size)
                for at in np.array_split(rows, -(-len(rows) * int(size) // CELLS)):
                    cells = first[at][:, None] + np.arange(size)
                    for out, v in zip(made, _totals({c: v[cells] for c, v in flat.items()}, {c: v[at] for c, v in rf.items()}, kappa, nulls), strict=True):
                        out[at] = v
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in PAIR), pa.array(n, pa.int64()), *map(pa.array, made)], schema=schema)

    return run


def _forward(pairs: DataFrame, points: DataFrame, kappa: tuple[float, float], nulls: list[bool]) -> DataFrame:
    met = pairs.select(*PAIR, "rf_t", "rf_lat", "rf_lon").hint("merge").join(tracks_in_rows(points), TRACK)
    out = met.select(*PAIR).schema
    out = T.StructType([*out, T.StructField("n_points", T.LongType()), *(T.StructField(f"score_{k}", T.DoubleType()) for k in range(len(nulls)))])
    return met.mapInArrow(_kernel(to_arrow_schema(out), kappa, nulls), out)


def scores(pairs: DataFrame, points: DataFrame, kappa: tuple[float, float] = KAPPA) -> DataFrame:
    """forward_score, normalized_forward_score, null_forward_score and log_odds_score of each pair, in one pass.

    Log-odds is rounded, or pairs without a possible match would be ranked by
    floating-point noise.
    """
    s = _forward(pairs, points, kappa, [False, True])
    return s.select(*PAIR, "n_points", F.col("score_0").alias("forward_score"), (F.col("score_0") / F.col("n_points")).alias("normalized_forward_score"), F.col("score_1").alias("null_forward_score"), F.round(F.col("score_0") - F.col("score_1"), 6).alias("log_odds_score"))


def viterbi(pairs: DataFrame, points: DataFrame, kappa: tuple[float, float] = KAPPA) -> DataFrame:
    """The most likely path of each pair: n_points, state (RF or M) and place (AIS points up to it) of the detection, log_prob, path.

    With one detection a path is AIS steps, one RF or M, and AIS steps again,
    so the best one is the best way to consume the detection. Match emissions
    are raw here. Ties: a path that ends in AIS comes first, then the earlier
    place, then RF.
    """
    x = _moves(laid_out(pairs, points), kappa, [False], raw=True)
    i = F.col("i").cast("bigint")
    ways = [(1, "RF", i - 1, 1), (2, "M", i - 1, 1), (3, "RF", i, 2), (4, "M", i, 3)]
    options = F.array(*(F.struct((-F.col(f"x{j}_0")).alias("cost"), F.lit(late).alias("late"), place.alias("place"), F.lit(state != "RF").alias("m")) for j, state, place, late in ways))
    best = x.select(*PAIR, "n", F.array_min(F.filter(options, lambda o: o["cost"].isNotNull())).alias("o")).groupBy(*PAIR).agg(F.max("n").alias("n_points"), F.min("o").alias("o"))
    state = F.when(F.col("o.m"), "M").otherwise("RF")
    before = F.col("o.place") - F.col("o.m").cast("bigint")
    steps_ = lambda k: F.array_repeat(F.lit("AIS"), k.cast("int"))
    path = F.concat(F.array(F.lit("begin")), steps_(before), F.array(state), steps_(F.col("n_points") - F.col("o.place")), F.array(F.lit("end")))
    return best.select(*PAIR, "n_points", state.alias("state"), F.col("o.place").alias("place"), (-F.col("o.cost") + prob.log(F.lit(END))).alias("log_prob"), path.alias("path"))
