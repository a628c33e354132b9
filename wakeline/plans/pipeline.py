"""The matching pipeline as stages with parquet outputs.

``python -m wakeline.plans.pipeline --reports DIR --out DIR`` runs from reports to
result tables; ``--archives GLOB --types FILE`` makes the reports from daily zip
files first. A stage whose output is there is not run again; ``--clean``
removes the outputs first; ``--plots-only`` runs nothing, fails with the names
of missing stages, and writes the small tables that figures are drawn from.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators import bias, evaluate, openset, prep, preselect, rank, score_nn, score_phmm, simulate
from wakeline.schema import PAIR, RF, TRACK
from wakeline.sources import ais

RAW = {"forward_score": "max", "log_odds_score": "max"}
FIGURES = ["metrics", "ranking_metrics", "stratified", "mcnemar", "alpha", "corrected_metrics", "correction", "open_set", "bias", "runtime"]
MODELS = {**dict.fromkeys(score_nn.SCORERS, "min"), "normalized_forward_score": "max", "log_odds_score": "max"}


class Stages:
    """Named tables below a folder, each made on first use."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out.rstrip("/")

    def table(self, name: str, make: Callable[[], DataFrame], order: list[str] | None = None) -> DataFrame:
        """The table, made if it is not there; with ``order`` its files follow one another in that order and rows are sorted in each."""
        path = f"{self.out}/{name}"
        if not ais.exists(self.spark, f"{path}/_SUCCESS"):
            began = time.monotonic()
            made = make()
            (made.orderBy(*order) if order else made).write.mode("overwrite").parquet(path)
            seconds = time.monotonic() - began
            row = [(name, seconds, self.spark.read.parquet(path).count())]
            ais.append(self.spark.createDataFrame(row, "model string, seconds double, pairs bigint").coalesce(1), f"{self.out}/runtimes")
        return self.spark.read.parquet(path)

    def missing(self, names: list[str]) -> list[str]:
        """Those of the tables that are not there, in the order given."""
        return [n for n in names if not ais.exists(self.spark, f"{self.out}/{n}/_SUCCESS")]

    def need(self, names: list[str]) -> None:
        """Fails with the missing tables in the order in which they are made."""
        missing = self.missing(names)
        if missing:
            raise FileNotFoundError(f"missing stages, in order: {', '.join(missing)}")

    def clean(self) -> None:
        ais.remove(self.spark, self.out)


def segmented(reports: DataFrame) -> DataFrame:
    """Short vessels, fast outliers and slow vessels out, then tracks."""
    moved = prep.add_speed(prep.remove_short_tracks(prep.no_nan(reports)))
    return prep.split_tracks(prep.remove_low_speed_outliers(prep.remove_high_speed_outliers(moved)))


def ingest(spark: SparkSession, archives: str, types: str, out: str, wanted: str = "Cargo") -> DataFrame:
    """Reports of one vessel type from zip files, with times, written by day; files that are no archives are named and left out."""
    broken = [r.path for r in ais.broken_zips(spark, archives).collect()]
    if broken:
        print(f"not read, no archives: {', '.join(broken)}")
    reports = prep.of_type(ais.read_zips(spark, archives), ais.read_lookup(spark, types), wanted)
    ais.write_days(ais.with_time(reports), out)
    return spark.read.parquet(out)


def run(spark: SparkSession, reports: DataFrame | None, out: str, error_model: str = "gaussian", leave_one_out: bool = False, kappa: tuple[float, float] = score_phmm.KAPPA, km: float = preselect.KM, window: float = preselect.WINDOW_SECONDS) -> dict[str, DataFrame]:
    """All stages of one error model; returns the tables by name. Without reports the tracks have to be there."""
    s = Stages(spark, f"{out}/{error_model}")
    if reports is None:
        s.need(["tracks"])
    points = s.table("tracks", lambda: segmented(reports), [*TRACK, "t", "seq"])
    labelled = s.table("labelled", lambda: simulate.training_data(points, error_model))
    rf = labelled.where("rf is not null").select(F.col("mmsi").alias("rf_mmsi"), F.col("track_id").alias("rf_track_id"), F.col("rf_t").alias("t"), F.lit(0).alias("seq"), "rf.lat", "rf.lon")
    rf = s.table("detections", lambda: preselect.number_signals(rf))
    pairs = s.table("candidates", lambda: preselect.candidates(rf, points, km, window), PAIR)
    suffix = "" if kappa == score_phmm.KAPPA else f"_kappa_{kappa[0]:g}_{kappa[1]:g}"
    wide = pairs
    for name, score in score_nn.SCORERS.items():
        wide = wide.join(s.table(name, lambda score=score: score(pairs, points)).withColumnRenamed("score", name), PAIR)
    wide = wide.join(s.table(f"phmm{suffix}", lambda: score_phmm.scores(pairs, points, kappa)).drop("n_points"), PAIR)
    long = s.table(f"scores{suffix}", lambda: rank.long_scores(wide, MODELS))
    raw = s.table(f"raw{suffix}", lambda: rank.long_scores(wide, RAW))
    sizes = points.groupBy(*TRACK).agg(F.count("*").alias("n_points"))
    split = s.table("split", lambda: evaluate.held_out(pairs))
    best = s.table(f"alpha{suffix}", lambda: evaluate.tuned_alpha(raw, sizes, split))
    held_out = s.table(f"evaluated{suffix}", lambda: evaluate.evaluation_population(long, split).unionByName(evaluate.corrected_results(raw, sizes, split, best)))
    made = {"tracks": points, "candidates": pairs, "scores": long, "alpha": best}
    summary = s.table(f"summary{suffix}", lambda: rank.summary(long))
    test = split.where("part = 1")
    dark = openset.dark_by_hash(points.select("mmsi"))

    def biases():
        near = bias.nearest_in_track(pairs.select(*PAIR, "rf_t", "rf_lat", "rf_lon"), points).select(*PAIR, "time_diff", "distance_diff")
        stats = prep.track_characteristics(points).select(*TRACK, "n_points", "mean_intra_time_diff", "mean_intra_dist_diff")
        some = held_out.where(F.col("model").isin("nn_time_weighted", "forward_score_corrected", "log_odds_score_corrected")).join(test, RF, "left_semi")
        return bias.t_tests(bias.splits(some).join(near, PAIR).join(stats, TRACK, "left").join(bias.stationary_ratio(points), TRACK, "left"))

    for name, make in {
        "metrics": lambda: evaluate.model_metrics(rank.several(long)),
        "ranking_metrics": lambda: evaluate.ranking_metrics(summary),
        "stratified": lambda: rank.stratified(summary),
        "mcnemar": lambda: evaluate.mcnemar_table(summary),
        "corrected_metrics": lambda: evaluate.model_metrics(held_out),
        "correction": lambda: evaluate.model_metrics(evaluate.correction_variants(raw, sizes, best).join(test, RF, "left_semi")),
        "open_set": lambda: openset.report(openset.dark_vessel_frame(long.unionByName(evaluate.corrected(raw.join(F.broadcast(best.select("model", F.col("alpha").alias("_a"))), "model"), sizes, F.col("_a")).drop("_a")), dark)),
        "bias": biases,
        **({"leave_one_out": lambda: openset.report(openset.leave_one_out_frame(long, rf))} if leave_one_out else {}),
    }.items():
        made[name] = s.table(name + suffix, make)
    scorers = [*score_nn.SCORERS, f"phmm{suffix}"]
    made["runtime"] = s.table(f"runtime{suffix}", lambda: evaluate.runtime(spark.read.parquet(f"{s.out}/runtimes").where(F.col("model").isin(scorers))))
    return made


def figures(spark: SparkSession, out: str, error_model: str, suffix: str = "") -> None:
    """The tables of figures as CSV, from stages that have run."""
    s = Stages(spark, f"{out}/{error_model}")
    s.need([name + suffix for name in FIGURES])
    for name in FIGURES:
        ais.write_csv(spark.read.parquet(f"{s.out}/{name}{suffix}"), f"{s.out}/csv/{name}{suffix}")


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--reports", help="parquet table of reports (mmsi, t, seq, lat, lon, heading)")
    p.add_argument("--archives", help="zip files to make the reports from")
    p.add_argument("--types", help="JSON file of vessel type names, with --archives")
    p.add_argument("--out", required=True)
    p.add_argument("--error-model", choices=["uniform", "gaussian", "both"], default="gaussian")
    p.add_argument("--leave-one-out", action="store_true")
    p.add_argument("--plots-only", action="store_true")
    p.add_argument("--kappa", default="0.5,2", help="pairs a,b; several ones are separated by ;")
    p.add_argument("--clean", action="store_true")
    a = p.parse_args()
    spark = SparkSession.builder.getOrCreate()
    reports = ingest(spark, a.archives, a.types, f"{a.out}/reports") if a.archives and not a.plots_only else spark.read.parquet(a.reports) if a.reports else None
    for model in ["uniform", "gaussian"] if a.error_model == "both" else [a.error_model]:
        if a.clean and not a.plots_only:
            Stages(spark, f"{a.out}/{model}").clean()
        for pair in a.kappa.split(";"):
            kappa = tuple(map(float, pair.split(",")))
            if not a.plots_only:
                run(spark, reports, a.out, model, a.leave_one_out, kappa)
            figures(spark, a.out, model, "" if kappa == score_phmm.KAPPA else f"_kappa_{kappa[0]:g}_{kappa[1]:g}")


if __name__ == "__main__":
    main()
