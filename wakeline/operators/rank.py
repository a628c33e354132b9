"""Choosing and ranking candidates, over one long table.

Scores have model, the RF key, the track key, is_true_match, score and
``oriented``, the score with its sign turned so that larger is better. Ties go
to the lower track key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import draw
from wakeline.schema import RF, TRACK

KEYS = ["model", *RF]
BUCKETS = [(1, "1"), (4, "2-4"), (9, "5-9")]


def long_scores(scored: DataFrame, models: dict[str, str]) -> DataFrame:
    """One row for each model and pair of a wide table; models: score column -> max or min. NULL scores are left out, n_points stays if it is there."""
    rows = [F.struct(F.lit(c).alias("model"), F.round(F.col(c), 9).alias("score"), F.round(F.col(c) if mode == "max" else -F.col(c), 9).alias("oriented")) for c, mode in models.items()]
    more = [c for c in ("n_points",) if c in scored.columns]
    return scored.select(*RF, *TRACK, "is_true_match", *more, F.inline(F.array(*rows))).where("score is not null")


def ranked(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """rank from 1, candidate_count, and tied: how many candidates share the best score."""
    group = Window.partitionBy(*keys)
    order = group.orderBy(F.desc("oriented"), *TRACK)
    r = scores.withColumns({"rank": F.row_number().over(order).cast("bigint"), "candidate_count": F.count("*").over(group), "_best": F.max("oriented").over(group)})
    return r.withColumn("tied", F.sum((F.col("oriented") == F.col("_best")).cast("bigint")).over(group)).drop("_best")


def chosen(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """All candidates with ``chosen``, true for the best one of each detection."""
    return ranked(scores, keys).withColumn("chosen", F.col("rank") == 1)


def several(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Candidates of detections that have more than one."""
    return scores.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n > 1").drop("_n")


def tied_signals(scores: DataFrame) -> DataFrame:
    """Detections whose best score is shared, by model."""
    best = ranked(scores).where("rank = 1")
    return best.groupBy("model").agg(F.count("*").alias("n_signals"), F.count_if(F.col("tied") > 1).alias("n_tied"))


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def confusion(picks: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, tn and the metrics from candidates with ``chosen``; metrics have four decimals and are 0 where undefined."""
    yes, true = F.col("chosen"), F.col("is_true_match")
    c = picks.groupBy(*by).agg(F.count_if(yes & true).alias("tp"), F.count_if(yes & ~true).alias("fp"), F.count_if(~yes & true).alias("fn"), F.count_if(~yes & ~true).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return c.withColumns({"precision": F.round(precision, 4), "recall": F.round(recall, 4), "f1": F.round(ratio(2 * precision * recall, precision + recall), 4), "accuracy": F.round(ratio(tp + tn, tp + tn + fp + fn), 4)})


def summary(scores: DataFrame, keys: list[str] = KEYS, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row for each detection: candidate_count, rank_of_true, top1_score, margin (larger is surer), reciprocal_rank, hit_k."""
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("oriented")))
    s = ranked(scores, keys).groupBy(*keys).agg(F.count("*").alias("candidate_count"), F.min(F.when(F.col("is_true_match"), F.col("rank"))).alias("rank_of_true"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1_score"), at(1).alias("top1_oriented"), (at(1) - at(2)).alias("margin"))
    return s.withColumns({"reciprocal_rank": F.coalesce(1 / F.col("rank_of_true"), F.lit(0.0)), **{f"hit_{k}": F.coalesce(F.col("rank_of_true") <= k, F.lit(False)) for k in ks}})


def averages(ks: tuple[int, ...] = (1, 3, 5)) -> list[Column]:
    return [F.count("*").alias("n"), *(F.avg(F.col(f"hit_{k}").cast("double")).alias(f"recall_at_{k}") for k in ks), F.avg("reciprocal_rank").alias("mrr")]


def bucket(count: Column) -> Column:
    out = F.when(count <= BUCKETS[0][0], BUCKETS[0][1])
    for most, name in BUCKETS[1:]:
        out = out.when(count <= most, name)
    return out.otherwise("10+")


def stratified(summaries: DataFrame) -> DataFrame:
    """Averages of each model over all detections and by candidate-count bucket; empty buckets have no row."""
    rows = summaries.withColumn("stratum", F.explode(F.array(F.lit("all"), bucket(F.col("candidate_count")))))
    return rows.groupBy("model", "stratum").agg(*averages())


def random_floor(scores: DataFrame, keys: list[str] = RF) -> DataFrame:
    """What a uniform pick would score: the expected precision and its value over the detections."""
    per = scores.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("is_true_match").alias("true"))
    return per.agg(F.count("*").alias("n_signals"), F.round(F.avg(F.col("true") / F.col("n")), 6).alias("expected_precision"))


def random_picks(scores: DataFrame, repeats: int = 200, seed: int = 42, keys: list[str] = RF) -> DataFrame:
    """Precision of ``repeats`` uniform picks: repeat, precision. A pick is the candidate with the smallest hash."""
    draws = scores.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    pick = draws.groupBy("repeat", *keys).agg(F.min_by("is_true_match", draw.uniform("repeat", *keys, *TRACK, seed=seed)).alias("hit"))
    return pick.groupBy("repeat").agg(F.avg(F.col("hit").cast("double")).alias("precision"))
