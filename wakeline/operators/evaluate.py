"""Length correction, model comparison and paired tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.functions import draw, stats
from wakeline.operators import rank
from wakeline.schema import PAIR, RF, TRACK

SPLIT_SEED = 100
ALPHAS = [round(0.7 + k / 100, 2) for k in range(61)]


def permutation_split(keys: DataFrame, columns: list[str], share: float, seed: int, nearest: bool = False) -> DataFrame:
    """Keys with ``part``: 0 for the first ``share`` of a seeded permutation of the sorted keys, 1 for the others.

    The key list comes to the driver in order; ``nearest`` rounds the size to the
    nearest integer instead of up.
    """
    listed = [tuple(r) for r in keys.select(*columns).distinct().orderBy(*columns).collect()]
    n = len(listed)
    size = int(round(n * share)) if nearest else int(np.ceil(n * share))
    first = set(np.random.default_rng(seed).permutation(n)[:size].tolist())
    rows = [(*k, 0 if i in first else 1) for i, k in enumerate(listed)]
    schema = keys.select(*columns).schema.add("part", T.IntegerType())
    return keys.sparkSession.createDataFrame(rows, schema)


def hash_split(keys: DataFrame, columns: list[str], share: float, seed: int) -> DataFrame:
    """The same by md5 of the key: no driver list, sizes are near the share, and SQL can repeat it."""
    return keys.select(*columns).distinct().withColumn("part", (draw.uniform(*columns, seed=seed) >= share).cast("int"))


def sized(scores: DataFrame, sizes: DataFrame) -> DataFrame:
    """Scores with ``_n``, the points of the track: their own n_points where they have that column, else those of ``sizes``."""
    if "n_points" in scores.columns:
        return scores.withColumnRenamed("n_points", "_n")
    return scores.join(sizes.select(*TRACK, F.col("n_points").alias("_n")), TRACK, "left")


def corrected(scores: DataFrame, sizes: DataFrame, alpha) -> DataFrame:
    """Scores over n_points to the power alpha (a number or a column); one-candidate detections need none but take it as well."""
    a = alpha if not isinstance(alpha, (int, float)) else F.lit(float(alpha))
    return sized(scores, sizes).withColumns({c: F.round(F.col(c) / F.pow(F.col("_n"), a), 9) for c in ("score", "oriented")}).drop("_n")


def alpha_search(scores: DataFrame, sizes: DataFrame, alphas: list[float] = ALPHAS) -> DataFrame:
    """Precision of each alpha, four decimals, in one pass: (model, alpha, precision).

    Scores are shuffled once, by detection; the grid is laid out behind that, where
    the grouping by detection and alpha needs no shuffle and keeps three numbers: the
    best score of the true track, of tracks with a lower key, which win ties, and
    of tracks with a higher key. Of several true tracks the lowest key counts for ties.
    """
    n = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sized(scores, sizes).select(*rank.KEYS, F.struct(*TRACK).alias("_track"), "is_true_match", "oriented", "_n").repartition(n, *rank.KEYS)
    true = F.min(F.when(F.col("is_true_match"), F.col("_track"))).over(Window.partitionBy(*rank.KEYS))
    dealt = dealt.withColumn("_true", true).withColumn("_place", F.when(F.col("is_true_match"), 0).when(F.col("_track") < F.col("_true"), 1).otherwise(2)).drop("_track", "_true")
    rows = dealt.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas)))).withColumn("_v", F.round(F.col("oriented") / F.pow(F.col("_n"), F.col("alpha")), 9))
    best = rows.groupBy(*rank.KEYS, "alpha").agg(*(F.max(F.when(F.col("_place") == k, F.col("_v"))).alias(f"_{k}") for k in range(3)))
    hit = F.col("_0").isNotNull() & (F.col("_1").isNull() | (F.col("_0") > F.col("_1"))) & (F.col("_2").isNull() | (F.col("_0") >= F.col("_2")))
    return best.groupBy("model", "alpha").agg(F.round(F.avg(hit.cast("double")), 4).alias("precision"))


def best_alpha(searched: DataFrame) -> DataFrame:
    """The alpha of the highest precision by model, the lowest one on ties."""
    return searched.groupBy("model").agg(F.max_by("alpha", F.struct("precision", -F.col("alpha"))).alias("alpha"), F.max("precision").alias("precision"))


def held_out(scores: DataFrame, share: float = 0.2, seed: int = SPLIT_SEED) -> DataFrame:
    """(RF key, part) of detections with several candidates: part 0 tunes, part 1 evaluates."""
    return hash_split(rank.several(scores, RF), RF, share, seed)


def tuned_alpha(raw: DataFrame, sizes: DataFrame, split: DataFrame, alphas: list[float] = ALPHAS) -> DataFrame:
    """(model, alpha, precision): the best alpha on the tuning part, searched at once; one row a model."""
    best = best_alpha(alpha_search(raw.join(split.where("part = 0"), RF, "left_semi"), sizes, alphas))
    return raw.sparkSession.createDataFrame(best.collect(), best.schema)


def evaluation_population(scores: DataFrame, split: DataFrame) -> DataFrame:
    """All candidates without the detections that alpha was tuned on; those with one candidate stay."""
    return scores.join(split.where("part = 0"), RF, "left_anti")


def corrected_results(raw: DataFrame, sizes: DataFrame, split: DataFrame, best: DataFrame) -> DataFrame:
    """The evaluation population with every model's scores over n_points to its alpha, as model ``<name>_corrected``.

    Detections with one candidate keep it whatever its score.
    """
    sent = F.broadcast(best.select("model", F.col("alpha").alias("_alpha")))  # one row a model
    x = evaluation_population(raw, split).join(sent, "model")
    return corrected(x, sizes, F.col("_alpha")).drop("_alpha").withColumn("model", F.concat("model", F.lit("_corrected")))


def correction_variants(raw: DataFrame, sizes: DataFrame, best: DataFrame) -> DataFrame:
    """Scores of four variants with their ``alpha``: Forward over n, Forward and log-odds over n to the tuned alpha, and log-odds as it is (alpha NULL).

    Each score makes its variants in place, so no row is shuffled here if it knows its n_points.
    """
    sent = F.broadcast(best.select("model", F.col("alpha").alias("_alpha")))  # one row a model
    x = sized(raw.drop("alpha"), sizes).join(sent, "model", "left")
    over = lambda a: (F.round(F.col(c) / F.pow(F.col("_n"), a), 9).alias(c) for c in ("score", "oriented"))
    none = F.lit(None).cast("double").alias("alpha")
    forward = F.array(F.struct(F.lit("forward_alpha_1").alias("model"), *over(F.lit(1.0)), F.lit(1.0).alias("alpha")), F.struct(F.lit("forward_tuned").alias("model"), *over(F.col("_alpha")), F.col("_alpha").alias("alpha")))
    odds = F.array(F.struct(F.lit("log_odds_raw").alias("model"), "score", "oriented", none), F.struct(F.lit("log_odds_tuned").alias("model"), *over(F.col("_alpha")), F.col("_alpha").alias("alpha")))
    made = F.filter(F.when(F.col("model") == "forward_score", forward).when(F.col("model") == "log_odds_score", odds), lambda v: v["alpha"].isNotNull() | (v["model"] == "log_odds_raw"))
    kept = [c for c in x.columns if c not in ("model", "score", "oriented", "_n", "_alpha")]
    return x.select(*kept, F.inline(made)).select("model", *kept, "score", "oriented", "alpha")


def shared_population(scores: DataFrame) -> DataFrame:
    """Pairs that every model scored, so models are compared on the same detections."""
    models = scores.select("model").distinct().count()
    full = scores.groupBy(*PAIR).agg(F.countDistinct("model").alias("_m")).where(F.col("_m") == models).select(*PAIR)
    return scores.join(full, PAIR, "left_semi")


def model_metrics(scores: DataFrame) -> DataFrame:
    """Confusion counts and metrics by model."""
    return rank.confusion(rank.chosen(scores), ["model"])


def ranking_metrics(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy("model").agg(*rank.averages(), F.avg("margin").alias("mean_margin"))


def mcnemar_counts(summaries: DataFrame) -> DataFrame:
    """(model_a, model_b, n10, n01) of top-1 hits on the detections that both have; a < b by name."""
    hits = summaries.groupBy(*RF).agg(F.map_from_entries(F.collect_set(F.struct("model", "hit_1"))).alias("hits"))
    models = sorted(r.model for r in summaries.select("model").distinct().collect())
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    if not pairs:
        return summaries.sparkSession.createDataFrame([], "model_a string, model_b string, n10 bigint, n01 bigint")
    each = F.inline(F.array(*(F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col("hits")[a].alias("a"), F.col("hits")[b].alias("b")) for a, b in pairs)))
    return hits.select(each).groupBy("model_a", "model_b").agg(F.count_if(F.col("a") & ~F.col("b")).alias("n10"), F.count_if(~F.col("a") & F.col("b")).alias("n01"))


def mcnemar_statistics(summaries: DataFrame, exact_below: int = 25) -> DataFrame:
    """The counts with method and statistic: the smaller count where a binomial test is exact, else chi-square with continuity correction."""
    n10, n01 = F.col("n10"), F.col("n01")
    exact = n10 + n01 < exact_below
    chi2 = F.pow(F.abs(n10 - n01) - 1, F.lit(2)) / (n10 + n01)
    return mcnemar_counts(summaries).withColumns({"method": F.when(exact, "exact").otherwise("chi2"), "statistic": F.when(exact, F.least(n10, n01).cast("double")).otherwise(chi2)})


def mcnemar_table(summaries: DataFrame) -> DataFrame:
    """The counts with statistic, p_value and method."""
    rows = [(r.model_a, r.model_b, *stats.mcnemar(r.n10, r.n01).values()) for r in mcnemar_counts(summaries).orderBy("model_a", "model_b").collect()]
    return summaries.sparkSession.createDataFrame(rows, "model_a string, model_b string, n10 bigint, n01 bigint, statistic double, p_value double, method string")


def bootstrap(summaries: DataFrame, value: str, repeats: int = 1000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """(model, estimate, low, high): percentile interval of resampled means.

    Resampling n rows with replacement gives each row a nearly Poisson count,
    so each row draws its counts by hash and sums are taken on the map side.
    """
    u = draw.uniform("model", *RF, "b", seed=seed)
    drawn, term, total = F.lit(0), 0.36787944117144233, 0.0
    for k in range(1, 12):
        total += term
        term /= k
        drawn = drawn + (u > total).cast("int")
    x = summaries.select("model", *RF, F.col(value).cast("double").alias("v")).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    means = x.withColumn("c", drawn).groupBy("model", "b").agg((F.sum(F.col("c") * F.col("v")) / F.sum("c")).alias("m"))
    tail = (1 - ci) / 2
    bounds = means.groupBy("model").agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
    return summaries.groupBy("model").agg(F.avg(F.col(value).cast("double")).alias("estimate")).join(bounds, "model")


def runtime(stages: DataFrame) -> DataFrame:
    """Seconds for each pair by model, from rows (model, seconds, pairs)."""
    return stages.groupBy("model").agg(F.sum("seconds").alias("seconds"), F.sum("pairs").alias("pairs"), (F.sum("seconds") / F.sum("pairs")).alias("seconds_per_pair"))


def overview(pairs: DataFrame) -> DataFrame:
    """Counts of the preselection: detections, candidate rows, tracks, means, single- and multi-candidate detections."""
    per = pairs.withColumn("_n", F.count("*").over(Window.partitionBy(*RF)))
    return per.agg(F.countDistinct(*RF).alias("n_signals"), F.count("*").alias("n_candidates"), F.countDistinct(*TRACK).alias("n_tracks"), F.countDistinct(F.when(F.col("_n") == 1, F.struct(*RF))).alias("n_single"), F.countDistinct(F.when(F.col("_n") > 1, F.struct(*RF))).alias("n_multi")).withColumn("mean_candidates", F.round(F.col("n_candidates") / F.col("n_signals"), 6))
