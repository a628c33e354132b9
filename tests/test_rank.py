import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import bias, evaluate, openset, rank

LONG = "model string, rf_mmsi bigint, rf_track_id int, rf_signal_id bigint, mmsi bigint, track_id int, is_true_match boolean, score double, oriented double"


def long(spark, rows):
    return spark.createDataFrame([("m", rf, 0, 1, mmsi, 0, true, score, score) for rf, mmsi, true, score in rows], LONG)


def test_ties_go_to_the_lower_track_and_are_counted(spark):
    s = long(spark, [(1, 9, True, 2.0), (1, 3, False, 2.0), (1, 4, False, 1.0), (2, 5, True, 1.0)])
    assert {r.rf_mmsi: r.mmsi for r in rank.chosen(s).where("chosen").collect()} == {1: 3, 2: 5}
    assert tuple(rank.tied_signals(s).first()) == ("m", 2, 1)


def test_summary_without_a_true_candidate(spark):
    r = rank.summary(long(spark, [(1, 3, False, 2.0), (1, 4, False, 1.5)])).first()
    assert r.rank_of_true is None and r.reciprocal_rank == 0 and not r.hit_1 and not r.hit_5 and r.margin == 0.5
    alone = rank.summary(long(spark, [(1, 3, True, 2.0)])).first()
    assert alone.margin is None and alone.rank_of_true == 1


def test_counts_add_up(spark):
    rng = np.random.default_rng(2)
    rows = [(rf, m, m == rf % 5, float(rng.integers(0, 4))) for rf in range(50) for m in range(int(rng.integers(1, 12)))]
    s = long(spark, rows)
    c = evaluate.model_metrics(s).first()
    assert c.tp + c.fp == 50 and c.tp + c.fn == sum(t for _, _, t, _ in rows)
    strata = {r.stratum: r.n for r in rank.stratified(rank.summary(s)).collect()}
    assert strata.pop("all") == 50 == sum(strata.values())
    groups = {r.group: r.n for r in bias.splits(s).groupBy("group").agg(F.count("*").alias("n")).collect()}
    assert groups.get("correct", 0) == c.tp and groups.get("incorrect", 0) == c.fp


def test_alpha_grid_and_ties(spark):
    assert len(evaluate.ALPHAS) == 61 and evaluate.ALPHAS[0] == 0.7 and evaluate.ALPHAS[-1] == 1.3
    sizes = spark.createDataFrame([(3, 0, 10), (4, 0, 20)], "mmsi bigint, track_id int, n_points bigint")
    s = long(spark, [(1, 3, True, -10.0), (1, 4, False, -30.0)])
    assert evaluate.best_alpha(evaluate.alpha_search(s, sizes)).first().alpha == 0.7


def test_areas_with_ties_and_rejections(spark):
    rng = np.random.default_rng(4)
    label, score = rng.integers(0, 2, 200), rng.integers(0, 12, 200).astype(float)
    f = spark.createDataFrame([("m", int(a), float(b)) for a, b in zip(label, score, strict=True)], "model string, label int, accept_score double")
    p, q = score[label == 1], score[label == 0]
    auc = ((p[:, None] > q[None]) + 0.5 * (p[:, None] == q[None])).mean()
    ap, before = 0.0, 0.0
    for t in sorted(set(score), reverse=True):
        recall = (p >= t).mean()
        ap += (recall - before) * (p >= t).sum() / (score >= t).sum()
        before = recall
    r = openset.areas(f).first()
    assert r.auc == pytest.approx(auc) and r.ap == pytest.approx(ap)


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_cumulative_counts(spark, coalesce):
    """In one range and in several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    rng = np.random.default_rng(5)
    rows = [(m, int(rng.integers(0, 2)), float(rng.integers(0, 60)) if m == "a" else 1.0) for m in "ab" for _ in range(150)]
    got = {(r.model, r.accept_score): (r.tp, r.fp, r.all_p, r.all_q) for r in openset._steps(spark.createDataFrame(rows, "model string, label int, accept_score double")).collect()}
    assert got == {(m, s): tuple(sum(1 for a, l, v in rows if a == m and l == want and v >= low) for low in (s, -1.0) for want in (1, 0)) for m, _, s in rows}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_cumulative_counts_of_no_rows(spark):
    assert openset._steps(spark.createDataFrame([], "model string, label int, accept_score double")).count() == 0


def test_alpha_picks_go_to_the_lower_track_on_ties(spark):
    sizes = spark.createDataFrame([(3, 0, 10), (4, 0, 10)], "mmsi bigint, track_id int, n_points bigint")
    for mmsi, hit in ((3, 1.0), (4, 0.0)):
        s = long(spark, [(1, 3, mmsi == 3, -30.0), (1, 4, mmsi == 4, -30.0)])
        assert {r.precision for r in evaluate.alpha_search(s, sizes).collect()} == {hit}


def test_dark_frame_covers_the_universe(spark):
    s = long(spark, [(1, 1, True, 5.0), (1, 2, False, 1.0), (2, 2, True, 4.0), (2, 1, False, 3.0), (3, 3, True, 9.0)])
    split = spark.createDataFrame([(1, False), (2, True), (3, True)], "mmsi bigint, dark boolean")
    rows = {r.rf_mmsi: r for r in openset.dark_vessel_frame(s, split).collect()}
    assert {k: r.rejection_type for k, r in rows.items()} == {1: "positive", 2: "scored_rejection", 3: "automatic_rejection"}
    assert rows[3].accept_score == 2.0 and rows[3].candidate_count == 0 and rows[2].label == 0


def test_permutation_split_repeats(spark):
    v = spark.createDataFrame([(k % 10,) for k in range(50)], "mmsi bigint")
    a, b = (sorted(map(tuple, openset.dark_split(v).collect())) for _ in range(2))
    assert a == b and sum(d for _, d in a) == 2


def test_bootstrap_holds_the_mean(spark):
    rows = [("m", k, 0, 1, float(k % 3 == 0)) for k in range(600)]
    df = spark.createDataFrame(rows, "model string, rf_mmsi bigint, rf_track_id int, rf_signal_id bigint, v double")
    r = evaluate.bootstrap(df, "v", 300).first()
    half = 1.96 * np.sqrt(r.estimate * (1 - r.estimate) / 600)
    assert r.estimate == pytest.approx(1 / 3) and r.high - r.low == pytest.approx(2 * half, rel=0.25)


def test_random_floor_and_picks(spark):
    s = long(spark, [(1, 1, True, 0.0), (1, 2, False, 0.0), (2, 1, False, 0.0), (3, 1, True, 0.0)])
    assert rank.random_floor(s).first().expected_precision == 0.5
    assert rank.random_picks(s, 400).agg(F.avg("precision")).first()[0] == pytest.approx(0.5, abs=0.05)


def test_label_table_shows_missing(spark):
    s = long(spark, [(1, 1, True, 0.0), (2, 1, True, 0.0)]).withColumn("x", F.lit("a"))
    got = {(r.a, r.b): r.n for r in bias.label_table(s, s.where("rf_mmsi = 1").withColumnRenamed("x", "y"), "x", "y").collect()}
    assert got == {("a", "a"): 1, ("a", "<missing>"): 1}


def test_variants_of_scores_that_know_their_points_are_not_shuffled(spark):
    rows = [(m, k, 0, 1, t, 0, t == k, -1.5 * k - t, -1.5 * k - t) for m in ("forward_score", "log_odds_score") for k in range(4) for t in range(3)]
    raw = spark.createDataFrame(rows, "model string, rf_mmsi bigint, rf_track_id int, rf_signal_id bigint, mmsi bigint, track_id int, is_true_match boolean, score double, oriented double")
    sizes = spark.createDataFrame([(t, 0, 5 + t) for t in range(3)], "mmsi bigint, track_id int, n_points bigint")
    best = spark.createDataFrame([("forward_score", 0.8), ("log_odds_score", 1.2)], "model string, alpha double")
    known = evaluate.correction_variants(raw.withColumn("n_points", 5 + F.col("mmsi")), sizes, best)
    assert "Exchange hashpartitioning" not in known._jdf.queryExecution().executedPlan().toString()
    got = {(r.model, r.rf_mmsi, r.mmsi): (r.score, r.alpha) for r in known.collect()}
    assert got == {(r.model, r.rf_mmsi, r.mmsi): (r.score, r.alpha) for r in evaluate.correction_variants(raw, sizes, best).collect()}
    alphas = {"forward_alpha_1": 1.0, "forward_tuned": 0.8, "log_odds_raw": None, "log_odds_tuned": 1.2}
    assert got == {(m, k, t): (pytest.approx(round((-1.5 * k - t) / (5 + t) ** (a or 0.0), 9)), a) for m, a in alphas.items() for k in range(4) for t in range(3)}
    assert {r.model for r in evaluate.correction_variants(raw, sizes, best.limit(0)).collect()} == {"forward_alpha_1", "log_odds_raw"}
