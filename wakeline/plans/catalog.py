"""Every operator as a query over the driver's tables, with its SQL."""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions import geo, prob
from wakeline.functions.draw import uniform_sql
from wakeline.operators import bias, evaluate, openset, prep, preselect, rank, score_nn, score_phmm, simulate
from wakeline.plans import fixture
from wakeline.plans.fixture import ctes, hav, match, transition
from wakeline.schema import PAIR, RF, TRACK

QUERIES: dict = {}
SQL: dict[str, str] = {}
KM, WINDOW, FINE, DEALT = 3.0, 1200.0, 512, 1 << 17
MODELS = {"nn_haversine": "min", "nn_segment": "min", "nn_time_weighted": "min", "normalized_forward_score": "max", "log_odds_score": "max"}
NN = {k: v for k, v in MODELS.items() if k.startswith("nn_")}
_kept: dict[tuple, DataFrame] = {}
atexit.register(_kept.clear)


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if it has one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def with_ctes(body: str, *more: tuple[str, str], divisor: int = 128, km: float = 6.0, window: float = 10800.0) -> str:
    parts = [*ctes(divisor, km, window).items(), *more]
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in parts) + "\n" + body


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Doubles rounded, for comparison with other engines."""
    return df.select(*(F.round(c, other.get(c, digits)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def kept(spark: SparkSession, *key, make) -> DataFrame:
    """A table that several queries of a session share, persisted on first use."""
    k = (spark.sparkContext.applicationId, *key)
    if k not in _kept:
        _kept[k] = make().persist()
    return _kept[k]


def traffic(spark: SparkSession, d: str, divisor: int = 128) -> tuple[DataFrame, DataFrame]:
    points = kept(spark, d, divisor, "tracks", make=lambda: fixture.tracks(spark, d, divisor))
    return points, kept(spark, d, divisor, "rf", make=lambda: fixture.detections(spark, d, points, divisor))


def pairs_of(spark: SparkSession, d: str, divisor: int = 128) -> tuple[DataFrame, DataFrame, DataFrame]:
    points, rf = traffic(spark, d, divisor)
    return points, rf, kept(spark, d, divisor, "pairs", make=lambda: preselect.candidates(rf, points, KM, WINDOW))


def scored(spark: SparkSession, d: str, models: dict[str, str] = MODELS) -> DataFrame:
    """The long score table of the fine fixture."""
    points, _, pairs = pairs_of(spark, d, FINE)

    def one(name):
        return kept(spark, d, "score", name, make=lambda: score_nn.SCORERS[name](pairs, points))

    wide = pairs
    for name in models:
        if name.startswith("nn_"):
            wide = wide.join(one(name).withColumnRenamed("score", name), PAIR)
    if len(models) > len(NN):
        s = kept(spark, d, "score", "phmm", make=lambda: score_phmm.scores(pairs, points))
        wide = wide.join(s.drop("n_points"), PAIR)
    return kept(spark, d, "long", *models, make=lambda: rank.long_scores(wide, models))


def sizes(spark: SparkSession, d: str) -> DataFrame:
    return traffic(spark, d, FINE)[0].groupBy(*TRACK).agg(F.count("*").alias("n_points"))


# SQL of the shared tables.
_PAIR, _RF = ", ".join(PAIR), ", ".join(RF)
_X1, _Y1, _X2, _Y2 = (f"(radians({a} - {b}) {'* cos(radians(rf_lat)) ' if a[:3] == 'lon' else ''}* 6371.0088e0)" for a, b in (("lon", "rf_lon"), ("lat", "rf_lat"), ("lon2", "rf_lon"), ("lat2", "rf_lat")))
LEGS = ("legs", "SELECT * FROM (SELECT mmsi, track_id, t, lat, lon, lead(t) OVER w AS t2, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM tracks WINDOW w AS (PARTITION BY mmsi, track_id ORDER BY t, seq)) WHERE t2 IS NOT NULL")
ONLEG = (
    "onleg",
    f"SELECT {_PAIR}, is_true_match, sqrt(pow(x1 + s * (x2 - x1), 2) + pow(y1 + s * (y2 - y1), 2)) AS km, abs(t + s * (t2 - t) - rf_t) AS secs FROM (SELECT *, CASE WHEN l2 = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, -(x1 * (x2 - x1) + y1 * (y2 - y1)) / l2)) END AS s FROM (SELECT *, pow(x2 - x1, 2) + pow(y2 - y1, 2) AS l2 FROM (SELECT c.*, l.t, l.t2, {_X1} AS x1, {_Y1} AS y1, {_X2} AS x2, {_Y2} AS y2 FROM cand c JOIN legs l USING (mmsi, track_id))))",
)
BYPOINT = ("bypoint", f"SELECT {_PAIR}, any_value(is_true_match) AS is_true_match, min(sqrt(pow(rf_lat - lat, 2) + pow(rf_lon - lon, 2))) AS nn_euclidean, min({hav('rf_lat', 'rf_lon', 'lat', 'lon')}) AS nn_haversine FROM cand JOIN tracks USING (mmsi, track_id) GROUP BY ALL")
BYLEG = ("byleg", f"SELECT {_PAIR}, min(km) AS nn_segment, min(km / 6e0 + (secs / 3600e0) / 3e0) AS nn_time_weighted FROM onleg GROUP BY ALL")


def phmm_ctes(ka: float = 0.5, kr: float = 2.0, raw: bool = False) -> list[tuple[str, str]]:
    log = lambda p: f"ln(({p}) + 1e-300)"
    stay = f"pow(0.95e0, {ka})"
    share = lambda p, k: log(f"pow(CASE WHEN tot = 0 THEN 0e0 ELSE {p} / tot * 0.95e0 END, {k})")
    start = log("1e0 / 3")
    w = f"WINDOW w AS (PARTITION BY {_PAIR} ORDER BY t, seq), g AS (PARTITION BY {_PAIR})"
    tw = "WINDOW w AS (PARTITION BY mmsi, track_id ORDER BY t, seq)"
    ways = []
    for k, null in ((0, False), (1, True)):
        am = log("0e0") if null else "lag(am) OVER w"
        first = log("0e0") if null else start
        ways.append(f"CASE WHEN i = 1 THEN {first} + e ELSE lag(a0) OVER w + {am} + e END AS m_{k}")
    tops = ", ".join(f"coalesce(lag(r) OVER w, {start}) + from_rf + sn - s AS x1_{k}, lag(m_{k}) OVER w + from_m + sn - s AS x2_{k}, CASE WHEN i = n THEN r END AS x3_{k}, CASE WHEN i = n THEN m_{k} END AS x4_{k}" for k in (0, 1))
    top = lambda k: f"greatest(x1_{k}, coalesce(x2_{k}, x1_{k}), coalesce(x3_{k}, x1_{k}), coalesce(x4_{k}, x1_{k}))"
    total = lambda k: f"max(top_{k}) + ln(sum(" + " + ".join(f"coalesce(exp(x{j}_{k} - top_{k}), 0e0)" for j in range(1, 5)) + f")) + {log('0.05e0')}"
    return [
        ("steps", f"SELECT mmsi, track_id, t, seq, lat, lon, CASE WHEN lead(t) OVER w IS NULL THEN 0e0 ELSE {transition('lead(t) OVER w - t', hav('lat', 'lon', 'lead(lat) OVER w', 'lead(lon) OVER w'))} END AS p_next, CASE WHEN lag(t) OVER w IS NULL THEN 0e0 ELSE {transition('t - lag(t) OVER w', hav('lat', 'lon', 'lag(lat) OVER w', 'lag(lon) OVER w'))} END AS p_prev, lag(t) OVER w AS prev_t, {hav('lat', 'lon', 'lag(lat) OVER w', 'lag(lon) OVER w')} AS prev_km FROM tracks {tw}"),
        ("laid0", f"SELECT {_PAIR}, rf_t, s.* EXCLUDE (mmsi, track_id), {hav('lat', 'lon', 'rf_lat', 'rf_lon')} AS km FROM cand c JOIN steps s USING (mmsi, track_id)"),
        ("laid", f"SELECT *, {transition('rf_t - t', 'km')} AS p_rf, {transition('t - rf_t', 'km')} AS p_back, {match('abs(t - rf_t)', 'km')} AS p_match FROM laid0"),
        ("h1", f"SELECT *, coalesce(lead(p_match) OVER w, 0e0) AS pm, row_number() OVER w AS i, count(*) OVER g AS n, {log('p_match' if raw else 'p_match / (sum(p_match) OVER g + 1e-300)')} AS e FROM laid {w}"),
        ("h2", "SELECT *, p_next + p_rf + pm AS tot, coalesce(prev_t > rf_t, false) AS later FROM h1"),
        ("h3", f"SELECT *, {share('p_next', ka)} AS aa, {share('p_rf', kr)} AS ar, {share('pm', kr)} AS am, CASE WHEN i = 1 THEN 0e0 ELSE {log(f'CASE WHEN p_prev > 0 THEN {stay} ELSE 0e0 END')} END AS w, {log(f'CASE WHEN p_back > 0 THEN {stay} ELSE 0e0 END')} AS from_rf, {log(f'CASE WHEN NOT (CASE WHEN later THEN t = prev_t AND prev_km = 0 ELSE t = rf_t AND km = 0 END) AND (CASE WHEN later THEN p_prev ELSE p_back END) > 0 THEN {stay} ELSE 0e0 END')} AS from_m FROM h2"),
        ("h4", f"SELECT *, {start} + coalesce(sum(aa) OVER (PARTITION BY {_PAIR} ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a0, sum(h3.w) OVER (PARTITION BY {_PAIR} ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s, sum(h3.w) OVER g AS sn FROM h3 WINDOW g AS (PARTITION BY {_PAIR})"),
        ("h5", "SELECT *, a0 + ar AS r FROM h4"),
        ("h6", f"SELECT *, {', '.join(ways)} FROM h5 {w}"),
        ("h7", f"SELECT *, {tops} FROM h6 {w}"),
        ("h8", f"SELECT *, max({top(0)}) OVER g AS top_0, max({top(1)}) OVER g AS top_1 FROM h7 {w}"),
        ("phmm", f"SELECT {_PAIR}, count(*) AS n_points, {total(0)} AS forward_score, {total(1)} AS null_forward_score FROM h8 GROUP BY ALL"),
    ]


def _long_cte(models: dict[str, str], source: str) -> tuple[str, str]:
    parts = [f"SELECT '{m}' AS model, {_RF}, mmsi, track_id, is_true_match, round({m}, 9) AS score, round({'' if mode == 'max' else '-'}{m}, 9) AS oriented FROM {source}" for m, mode in models.items()]
    return "long", " UNION ALL ".join(parts)


RANKED = ("ranked", f"SELECT *, row_number() OVER (PARTITION BY model, {_RF} ORDER BY oriented DESC, mmsi, track_id) AS rnk, count(*) OVER (PARTITION BY model, {_RF}) AS candidate_count, max(oriented) OVER (PARTITION BY model, {_RF}) AS best FROM long")
SUMMARY = (
    "summaries",
    f"SELECT model, {_RF}, count(*) AS candidate_count, min(rnk) FILTER (is_true_match) AS rank_of_true, max(score) FILTER (rnk = 1) AS top1_score, max(oriented) FILTER (rnk = 1) AS top1_oriented, max(oriented) FILTER (rnk = 1) - max(oriented) FILTER (rnk = 2) AS margin FROM ranked GROUP BY ALL",
)
SUMMARY2 = ("summary", "SELECT *, coalesce(1e0 / rank_of_true, 0e0) AS reciprocal_rank, coalesce(rank_of_true <= 1, false) AS hit_1, coalesce(rank_of_true <= 3, false) AS hit_3, coalesce(rank_of_true <= 5, false) AS hit_5 FROM summaries")


def ranking_sql(body: str, *more: tuple[str, str], models: dict[str, str] = NN, kappa: tuple[float, float] = score_phmm.KAPPA, long: list[tuple[str, str]] | None = None) -> str:
    """``long``: the CTEs that end in the table of scores, where it isn't the plain one of the models."""
    shared = [LEGS, ONLEG, BYPOINT, BYLEG]
    wide = "SELECT b.*, l.nn_segment, l.nn_time_weighted FROM bypoint b JOIN byleg l USING (" + _PAIR + ")"
    if len(models) > len(NN):
        shared += phmm_ctes(*kappa)
        wide = f"SELECT b.*, l.nn_segment, l.nn_time_weighted, p.forward_score, p.forward_score / p.n_points AS normalized_forward_score, round(p.forward_score - p.null_forward_score, 6) AS log_odds_score FROM bypoint b JOIN byleg l USING ({_PAIR}) JOIN phmm p USING ({_PAIR})"
    return with_ctes(body, *shared, ("wide", wide), *(long or [_long_cte(models, "wide")]), RANKED, SUMMARY, SUMMARY2, *more, divisor=FINE, km=KM, window=WINDOW)


def pair_sql(body: str, *more: tuple[str, str], divisor: int = 128) -> str:
    return with_ctes(body, *more, divisor=divisor, km=KM, window=WINDOW)


# 2.2, 2.4, 2.5, 2.10: cleaning and segmentation.
@query(with_ctes("SELECT mmsi, seq, round(time_diff, 6) AS time_diff, round(distance_diff, 6) AS distance_diff, round(speed_kph, 4) AS speed_kph FROM speeds"))
def track_speed(spark, d):
    s = prep.add_speed(prep.remove_short_tracks(fixture.reports(spark, d)))
    return rounded(s.select("mmsi", "seq", "time_diff", "distance_diff", "speed_kph"), speed_kph=4)


@query("WITH n AS (SELECT user_id AS mmsi, count(*) AS n_reports FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT * FROM n WHERE n_reports > 5")
def short_tracks_removed(spark, d):
    """Over one type of report: every vessel has more than five reports of all types together."""
    r = fixture.reports(spark, d).where("vessel_type = 'purchase'")
    return prep.remove_short_tracks(r).groupBy("mmsi").agg(F.count("*").alias("n_reports"))


@query(with_ctes("SELECT mmsi, count(*) AS n_reports FROM speeds GROUP BY mmsi HAVING NOT bool_or(speed_kph > (SELECT quantile_cont(speed_kph, 0.75) + 1.5e0 * (quantile_cont(speed_kph, 0.75) - quantile_cont(speed_kph, 0.25)) FROM speeds))"))
def iqr_outlier_vessels_removed(spark, d):
    s = prep.add_speed(prep.remove_short_tracks(fixture.reports(spark, d)))
    return prep.remove_high_speed_outliers(s).groupBy("mmsi").agg(F.count("*").alias("n_reports"))


@query(with_ctes("SELECT mmsi, count(*) AS n_reports, round(avg(speed_kph), 6) AS mean_speed FROM speeds GROUP BY mmsi HAVING NOT avg(speed_kph) < 22"))
def slow_vessels_removed(spark, d):
    s = prep.add_speed(prep.remove_short_tracks(fixture.reports(spark, d)))
    return rounded(prep.remove_low_speed_outliers(s, 22.0).groupBy("mmsi").agg(F.count("*").alias("n_reports"), F.avg("speed_kph").alias("mean_speed")))


@query("SELECT user_id AS mmsi, event_id AS seq, value AS sog FROM events WHERE event_type = 'click'")
def vessel_type_filter(spark, d):
    return prep.of_type(fixture.reports(spark, d), fixture.type_names(spark)).select("mmsi", "seq", "sog")


@query(with_ctes("SELECT mmsi, track_id, seq, round(time_diff, 6) AS time_diff, round(distance_diff, 6) AS distance_diff, round(speed_kph, 4) AS speed_kph FROM tracks"))
def continuous_tracks(spark, d):
    return rounded(traffic(spark, d)[0].select(*TRACK, "seq", "time_diff", "distance_diff", "speed_kph"), speed_kph=4)


_P = transition("time_diff", "distance_diff")
CHARACTER = (
    "characters",
    f"SELECT mmsi, track_id, count(*) AS n_points, (max(t) - min(t)) / 60 AS track_duration, avg(speed_kph) AS avg_speed_kph, max(lat) - min(lat) AS lat_span, max(lon) - min(lon) AS lon_span, avg(time_diff) AS mean_intra_time_diff, stddev_samp(time_diff) AS std_intra_time_diff, avg(distance_diff) AS mean_intra_dist_diff, stddev_samp(distance_diff) AS std_intra_dist_diff, avg(p) AS mean_transition_strength, stddev_samp(p) AS std_transition_strength, avg(sqrt(p)) AS mean_transition_strength_corr, stddev_pop(sqrt(p)) AS std_transition_strength_corr, avg(ln(sqrt(p) + 1e-300)) AS mean_transition_strength_log, stddev_pop(ln(sqrt(p) + 1e-300)) AS std_transition_strength_log FROM (SELECT *, {_P} AS p FROM tracks) GROUP BY mmsi, track_id",
)
_STATS = [f"{k}_{c}" for c in ("intra_time_diff", "intra_dist_diff", "transition_strength", "transition_strength_corr", "transition_strength_log") for k in ("mean", "std")]


@query(with_ctes("SELECT mmsi, track_id, n_points, " + ", ".join(f"round({c}, 6) AS {c}" for c in ["track_duration", "lat_span", "lon_span", *_STATS]) + ", round(avg_speed_kph, 4) AS avg_speed_kph FROM characters", CHARACTER))
def track_characteristics(spark, d):
    return rounded(prep.track_characteristics(traffic(spark, d)[0]), avg_speed_kph=4)


@query(with_ctes("SELECT mmsi, track_id, n_points, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("min_t", "max_t", "min_lat", "max_lat", "min_lon", "max_lon", "south", "north", "west", "east")) + " FROM meta"))
def track_metadata_bbox(spark, d):
    return rounded(preselect.track_meta(traffic(spark, d)[0]))


@query(with_ctes(f"SELECT {_RF}, seq, round(t, 6) AS t FROM rf"))
def rf_signal_numbering(spark, d):
    return rounded(traffic(spark, d)[1].select(*RF, "seq", "t"))


@query(with_ctes(f"SELECT {_RF}, round(fix_t, 6) AS fix_t, round(t - fix_t, 6) AS time_diff, round({hav('lat', 'lon', 'fix_lat', 'fix_lon')}, 6) AS distance_diff FROM rf"))
def nearest_fix_asof(spark, d):
    x = traffic(spark, d)[1]
    return rounded(x.select(*RF, "fix_t", (F.col("t") - F.col("fix_t")).alias("time_diff"), geo.haversine(F.col("lat"), F.col("lon"), F.col("fix_lat"), F.col("fix_lon")).alias("distance_diff")))


# 2.3: the range join and its variants.
@query(with_ctes(f"SELECT {_PAIR} FROM boxed"))
def preselect_bbox_pairs(spark, d):
    points, rf = traffic(spark, d)
    return preselect.box_pairs(rf, preselect.track_meta(points)).select(*PAIR)


@query(pair_sql(f"SELECT {_PAIR}, is_true_match FROM cand"))
def preselect_candidates(spark, d):
    return pairs_of(spark, d)[2].select(*PAIR, "is_true_match")


@query(with_ctes(f"SELECT {_PAIR}, is_true_match FROM cand"))
def preselect_candidates_full(spark, d):
    """The operator's own settings: 6 km and 3 hours."""
    points, rf = traffic(spark, d)
    return preselect.candidates(rf, points).select(*PAIR, "is_true_match")


@query(pair_sql(f"SELECT {_PAIR} FROM near WHERE NOT (rf_mmsi = mmsi AND rf_track_id = track_id)"))
def preselect_leave_one_out(spark, d):
    points, rf = traffic(spark, d)
    return preselect.candidates(rf, points, KM, WINDOW, leave_one_out=True).select(*PAIR)


@query(pair_sql(f"SELECT {_RF}, (rf_mmsi, rf_track_id, rf_signal_id) IN (SELECT (rf_mmsi, rf_track_id, rf_signal_id) FROM near WHERE rf_mmsi = mmsi AND rf_track_id = track_id) AS passed_prefilter FROM rf"))
def prefilter_recall(spark, d):
    points, rf = traffic(spark, d)
    return preselect.prefilter_recall(rf, points, KM, WINDOW)


@query(pair_sql("SELECT count(*) AS n_signals, round(avg(((rf_mmsi, rf_track_id, rf_signal_id) IN (SELECT (rf_mmsi, rf_track_id, rf_signal_id) FROM near WHERE rf_mmsi = mmsi AND rf_track_id = track_id))::INT), 6) AS recall FROM rf"))
def prefilter_recall_rate(spark, d):
    points, rf = traffic(spark, d)
    return rounded(preselect.prefilter_rate(preselect.prefilter_recall(rf, points, KM, WINDOW)))


@query(pair_sql(f"SELECT {_RF}, bool_or(rf_mmsi = mmsi AND rf_track_id <> track_id) AS has_sibling_candidate FROM cand GROUP BY ALL"))
def sibling_overlap(spark, d):
    return preselect.sibling_overlap(pairs_of(spark, d)[2])


@query(pair_sql("SELECT count(DISTINCT k) AS n_signals, count(*) AS n_candidates, count(DISTINCT (mmsi, track_id)) AS n_tracks, count(DISTINCT k) FILTER (n = 1) AS n_single, count(DISTINCT k) FILTER (n > 1) AS n_multi, round(count(*) / count(DISTINCT k), 6) AS mean_candidates FROM (SELECT *, (rf_mmsi, rf_track_id, rf_signal_id) AS k, count(*) OVER (PARTITION BY rf_mmsi, rf_track_id, rf_signal_id) AS n FROM cand)"))
def preselection_overview(spark, d):
    return evaluate.overview(pairs_of(spark, d)[2])


@query(pair_sql(f"SELECT candidate_count, count(*) AS n FROM (SELECT count(*) AS candidate_count FROM cand GROUP BY {_RF}) GROUP BY ALL"))
def candidate_count_histogram(spark, d):
    per = pairs_of(spark, d)[2].groupBy(*RF).agg(F.count("*").alias("candidate_count"))
    return per.groupBy("candidate_count").agg(F.count("*").alias("n"))


# 2.8: distances and probability surfaces.
def _nn(name: str):
    more = [BYPOINT] if name in ("nn_euclidean", "nn_haversine") else [LEGS, ONLEG, BYLEG]

    def run(spark, d):
        points, _, pairs = pairs_of(spark, d)
        return rounded(score_nn.SCORERS[name](pairs, points))

    run.__name__ = name
    query(pair_sql(f"SELECT {_PAIR}, round({name}, 6) AS score FROM {more[-1][0]}", *more))(run)


for _name in score_nn.SCORERS:
    _nn(_name)


@query(with_ctes(f"SELECT {_RF}, round({transition('t - fix_t', hav('lat', 'lon', 'fix_lat', 'fix_lon'))}, 6) AS p FROM rf"))
def transition_probability(spark, d):
    x = traffic(spark, d)[1]
    km = geo.haversine(F.col("lat"), F.col("lon"), F.col("fix_lat"), F.col("fix_lon"))
    return rounded(x.select(*RF, prob.transition(F.col("t") - F.col("fix_t"), km).alias("p")))


@query(with_ctes(f"SELECT {_RF}, round({match('abs(t - fix_t)', hav('lat', 'lon', 'fix_lat', 'fix_lon'))}, 6) AS p FROM rf", divisor=FINE))
def match_probability(spark, d):
    x = traffic(spark, d, FINE)[1]
    km = geo.haversine(F.col("lat"), F.col("lon"), F.col("fix_lat"), F.col("fix_lon"))
    return rounded(x.select(*RF, prob.match(F.abs(F.col("t") - F.col("fix_t")), km).alias("p")))


_GRID = "FROM range(0, 50) a(i), range(0, 50) b(j)"


@query(f"SELECT i, j, round({transition('i * 1102e0 / 49', 'j * 14e0 / 49')}, 6) AS p_transition, round({match('i * 120e0 / 49', 'j * 2e0 / 49')}, 6) AS p_match {_GRID}")
def probability_surface_grid(spark, d):
    g = spark.range(50).withColumnRenamed("id", "i").crossJoin(spark.range(50).withColumnRenamed("id", "j"))
    i, j = F.col("i"), F.col("j")
    return rounded(g.select("i", "j", prob.transition(i * 1102.0 / 49, j * 14.0 / 49).alias("p_transition"), prob.match(i * 120.0 / 49, j * 2.0 / 49).alias("p_match")))


@query(f"SELECT i, j, round({transition('(i - 50) * 1102e0 / 50', 'j * 14e0 / 99')}, 6) AS p_transition, round({match('abs(i - 50) * 120e0 / 50', 'j * 2e0 / 99')}, 6) AS p_match FROM range(0, 100) a(i), range(0, 100) b(j)")
def probability_surface_signed(spark, d):
    """100 x 100, with times before and after the fix."""
    g = spark.range(100).withColumnRenamed("id", "i").withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(99).cast("bigint"))))
    i, j = F.col("i") - 50, F.col("j")
    return rounded(g.select("i", "j", prob.transition(i * 1102.0 / 50, j * 14.0 / 99).alias("p_transition"), prob.match(F.abs(i) * 120.0 / 50, j * 2.0 / 99).alias("p_match")))


_B, _A = "radians(CAST(seq % 360 AS DOUBLE))", "(seq % 5000) / 6371000e0"
_LAT2 = f"asin(sin(radians(lat)) * cos({_A}) + cos(radians(lat)) * sin({_A}) * cos({_B}))"


@query(with_ctes(f"SELECT mmsi, seq, round(degrees({_LAT2}), 6) AS lat2, round(degrees(radians(lon) + atan2(sin({_B}) * sin({_A}) * cos(radians(lat)), cos({_A}) - sin(radians(lat)) * sin({_LAT2}))), 6) AS lon2 FROM ais"))
def great_circle_destination(spark, d):
    r = fixture.reports(spark, d)
    lat2, lon2 = geo.destination(F.col("lat"), F.col("lon"), F.col("heading"), (F.col("seq") % 5000).cast("double"))
    return rounded(r.select("mmsi", "seq", lat2.alias("lat2"), lon2.alias("lon2")))


_F = ["n_points", "track_duration", "avg_speed_kph", "lat_span", "lon_span", "mean_intra_time_diff"]


@query(
    with_ctes(
        "SELECT a.mmsi, a.track_id, round(ln(sum(exp(-(" + " + ".join(f"pow(a.z{k} - b.z{k}, 2)" for k in range(6)) + ") / 0.5e0))) - ln(count(*)) - 6 * ln(0.5e0) - 3 * ln(2 * pi()), 4) AS log_density FROM z a, z b GROUP BY a.mmsi, a.track_id",
        CHARACTER,
        ("z", "SELECT mmsi, track_id, " + ", ".join(f"({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER () AS z{k}" for k, f in enumerate(_F)) + " FROM characters"),
    )
)
def kde_log_density(spark, d):
    return rounded(prep.kde_log_density(prep.track_characteristics(traffic(spark, d)[0]), TRACK), 4)


_Z = ("z", "SELECT mmsi, track_id, " + ", ".join(f"({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER () AS z{k}" for k, f in enumerate(_F)) + " FROM characters")
_DENSITY = ("density", "SELECT a.mmsi, a.track_id, ln(sum(exp(-(" + " + ".join(f"pow(a.z{k} - b.z{k}, 2)" for k in range(6)) + ") / 0.5e0))) - ln(count(*)) - 6 * ln(0.5e0) - 3 * ln(2 * pi()) AS log_density FROM z a, z b GROUP BY a.mmsi, a.track_id")


@query(with_ctes(f"SELECT mmsi, track_id, round(log_density, 4) AS log_density, round(exp(-log_density * 0.25e0), 2) AS sampling_weight FROM density ORDER BY -ln({uniform_sql('mmsi', 'track_id', seed=42)}) / exp(-log_density * 0.25e0), mmsi, track_id LIMIT 100", CHARACTER, _Z, _DENSITY))
def weighted_track_sample(spark, d):
    tracks = prep.track_characteristics(traffic(spark, d)[0])
    density = prep.kde_log_density(tracks, TRACK).withColumn("sampling_weight", prep.sampling_weight(F.col("log_density")))
    return rounded(prep.weighted_sample(density, 100), 4, sampling_weight=2)


@query(with_ctes(f"SELECT mmsi, track_id, seq, round(lat, 6) AS lat, round(lon, 6) AS lon FROM tracks JOIN (SELECT mmsi, track_id FROM density ORDER BY -ln({uniform_sql('mmsi', 'track_id', seed=42)}) / exp(-log_density * 0.25e0), mmsi, track_id LIMIT 100) USING (mmsi, track_id)", CHARACTER, _Z, _DENSITY))
def sampled_points(spark, d):
    """All points of the sampled tracks."""
    points = traffic(spark, d)[0]
    density = prep.kde_log_density(prep.track_characteristics(points), TRACK).withColumn("sampling_weight", prep.sampling_weight(F.col("log_density")))
    return rounded(points.join(prep.weighted_sample(density, 100).select(*TRACK), TRACK, "left_semi").select(*TRACK, "seq", "lat", "lon"))


# 2.9: pair HMM.
@query(pair_sql(f"SELECT {_PAIR}, seq, round(p_match / (sum(p_match) OVER (PARTITION BY {_PAIR}) + 1e-300), 6) AS emission FROM laid", *phmm_ctes()[:3], divisor=FINE))
def match_emission_normalised(spark, d):
    from pyspark.sql import Window

    points, _, pairs = pairs_of(spark, d, FINE)
    x = score_phmm.laid_out(pairs, points)
    e = F.col("p_match") / (F.sum("p_match").over(Window.partitionBy(*PAIR)) + prob.FLOOR)
    return rounded(x.select(*PAIR, "seq", e.alias("emission")))


def _phmm(name: str, column: str, **how):
    def run(spark, d):
        points, _, pairs = pairs_of(spark, d, FINE)
        return rounded(score_phmm.forward(pairs, points, **how))

    run.__name__ = name
    query(pair_sql(f"SELECT {_PAIR}, n_points, round({column}, 6) AS score FROM phmm", *phmm_ctes(*how.get("kappa", score_phmm.KAPPA)), divisor=FINE))(run)


_phmm("phmm_forward", "forward_score")
_phmm("phmm_null_forward", "null_forward_score", null=True)
_phmm("phmm_kappa_one", "forward_score", kappa=(1.0, 1.0))


@query(pair_sql(f"SELECT {_PAIR}, n_points, round(forward_score, 6) AS forward_score, round(forward_score / n_points, 6) AS normalized_forward_score, round(null_forward_score, 6) AS null_forward_score, round(forward_score - null_forward_score, 6) AS log_odds_score FROM phmm", *phmm_ctes(), divisor=FINE))
def phmm_log_odds(spark, d):
    points, _, pairs = pairs_of(spark, d, FINE)
    s = kept(spark, d, "score", "phmm", make=lambda: score_phmm.scores(pairs, points))
    return rounded(s)


@query(pair_sql(f"SELECT {_PAIR}, any_value(n) AS n_points, round(max(greatest(x1_0, coalesce(x2_0, x1_0), coalesce(x3_0, x1_0), coalesce(x4_0, x1_0))) + ln(0.05e0 + 1e-300), 5) AS log_prob FROM h8 GROUP BY {_PAIR}", *phmm_ctes(raw=True), divisor=FINE))
def viterbi_path(spark, d):
    points, _, pairs = pairs_of(spark, d, FINE)
    return rounded(score_phmm.viterbi(pairs, points).select(*PAIR, "n_points", "log_prob"), 5)


@query()
def viterbi_states(spark, d):
    points, _, pairs = pairs_of(spark, d, FINE)
    return score_phmm.viterbi(pairs, points).select(*PAIR, "state", "place", F.array_join("path", ">").alias("path"))


# 2.11: ranking and evaluation.
@query(ranking_sql(f"SELECT model, {_RF}, mmsi, track_id, is_true_match, round(score, 6) AS score FROM ranked WHERE rnk = 1"))
def top1_choice(spark, d):
    return rounded(rank.chosen(scored(spark, d, NN)).where("chosen").select("model", *RF, *TRACK, "is_true_match", "score"))


_METRICS = "round(CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp / (tp + fp) END, 4) AS precision, round(CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp / (tp + fn) END, 4) AS recall, round(CASE WHEN tp = 0 THEN 0e0 ELSE 2e0 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END, 4) AS f1, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy"
_COUNTS = "count(*) FILTER (rnk = 1 AND is_true_match) AS tp, count(*) FILTER (rnk = 1 AND NOT is_true_match) AS fp, count(*) FILTER (rnk > 1 AND is_true_match) AS fn, count(*) FILTER (rnk > 1 AND NOT is_true_match) AS tn"


@query(ranking_sql(f"SELECT *, {_METRICS} FROM (SELECT model, {_COUNTS} FROM ranked GROUP BY model)", models=MODELS))
def model_metrics_long(spark, d):
    return evaluate.model_metrics(scored(spark, d))


@query(ranking_sql(f"SELECT *, {_METRICS} FROM (SELECT model, {_COUNTS} FROM ranked WHERE candidate_count > 1 GROUP BY model)"))
def confusion_metrics(spark, d):
    return evaluate.model_metrics(rank.several(scored(spark, d, NN)))


@query(ranking_sql(f"SELECT model, {_RF}, candidate_count, rank_of_true, round(top1_score, 6) AS top1_score, round(margin, 6) AS margin, round(reciprocal_rank, 6) AS reciprocal_rank, hit_1, hit_3, hit_5 FROM summary"))
def ranking_summary(spark, d):
    return rounded(rank.summary(scored(spark, d, NN)).drop("top1_oriented"))


_AVG = "count(*) AS n, round(avg(hit_1::INT), 6) AS recall_at_1, round(avg(hit_3::INT), 6) AS recall_at_3, round(avg(hit_5::INT), 6) AS recall_at_5, round(avg(reciprocal_rank), 6) AS mrr"


@query(ranking_sql(f"SELECT model, stratum, {_AVG} FROM (SELECT *, unnest(['all', CASE WHEN candidate_count <= 1 THEN '1' WHEN candidate_count <= 4 THEN '2-4' WHEN candidate_count <= 9 THEN '5-9' ELSE '10+' END]) AS stratum FROM summary) GROUP BY model, stratum", models=MODELS))
def stratified_ranking(spark, d):
    return rounded(rank.stratified(rank.summary(scored(spark, d))))


@query(ranking_sql(f"SELECT model, {_AVG}, round(avg(margin), 5) AS mean_margin FROM summary GROUP BY model"))
def score_margin(spark, d):
    return rounded(evaluate.ranking_metrics(rank.summary(scored(spark, d, NN))), mean_margin=5)


@query(ranking_sql("SELECT model, count(*) AS n_signals, count(*) FILTER (t > 1) AS n_tied FROM (SELECT model, count(*) FILTER (oriented = best) AS t FROM ranked GROUP BY model, " + _RF + ") GROUP BY model", models=MODELS))
def tied_signals(spark, d):
    return rank.tied_signals(scored(spark, d))


_SIZES = ("sizes", "SELECT mmsi, track_id, count(*) AS n_points FROM tracks GROUP BY ALL")
_LOGODDS = {"log_odds_score": "max"}
_GRIDDED = ("gridded", f"SELECT l.*, a.alpha, round(oriented / pow(n_points, a.alpha), 9) AS o FROM long l JOIN sizes USING (mmsi, track_id), (SELECT (70 + k) / 100e0 AS alpha FROM range(0, 61) g(k)) a WHERE model = 'log_odds_score'")
_SEARCH = ("searched", f"SELECT model, alpha, round(avg(is_true_match::INT), 4) AS precision FROM (SELECT * FROM gridded QUALIFY row_number() OVER (PARTITION BY {_RF}, alpha ORDER BY o DESC, mmsi, track_id) = 1) GROUP BY ALL")


def _log_odds(spark, d):
    return scored(spark, d).where("model = 'log_odds_score'")


@query(ranking_sql("SELECT * FROM searched", _SIZES, _GRIDDED, _SEARCH, models=MODELS))
def alpha_search(spark, d):
    return evaluate.alpha_search(_log_odds(spark, d), sizes(spark, d))


@query(ranking_sql("SELECT model, alpha, precision FROM searched ORDER BY precision DESC, alpha LIMIT 1", _SIZES, _GRIDDED, _SEARCH, models=MODELS))
def alpha_best(spark, d):
    return evaluate.best_alpha(evaluate.alpha_search(_log_odds(spark, d), sizes(spark, d)))


RAW = {"forward_score": "max", "log_odds_score": "max"}
_RAW = ("rawlong", _long_cte(RAW, "wide")[1])
_PARTS = ("parts", f"SELECT {_RF}, CASE WHEN {uniform_sql(*RF, seed=evaluate.SPLIT_SEED)} >= 0.2e0 THEN 1 ELSE 0 END AS part FROM cand GROUP BY {_RF} HAVING count(*) > 1")
_TGRID = ("tgrid", f"SELECT r.*, a.alpha, round(oriented / pow(n_points, a.alpha), 9) AS o FROM rawlong r JOIN sizes USING (mmsi, track_id) JOIN parts USING ({_RF}), (SELECT (70 + k) / 100e0 AS alpha FROM range(0, 61) g(k)) a WHERE part = 0")
_TSEARCH = ("tsearch", f"SELECT model, alpha, round(avg(is_true_match::INT), 4) AS precision FROM (SELECT * FROM tgrid QUALIFY row_number() OVER (PARTITION BY model, {_RF}, alpha ORDER BY o DESC, mmsi, track_id) = 1) GROUP BY ALL")
_BEST = ("best", "SELECT * FROM tsearch QUALIFY row_number() OVER (PARTITION BY model ORDER BY precision DESC, alpha) = 1")
TUNED = [_RAW, _SIZES, _PARTS, _TGRID, _TSEARCH, _BEST]
_EVAL = f"({_RF}) NOT IN (SELECT ({_RF}) FROM parts WHERE part = 0)"
_CORRECTED = f"SELECT model || '_corrected' AS model, {_RF}, mmsi, track_id, is_true_match, round(score / pow(n_points, alpha), 9) AS score, round(oriented / pow(n_points, alpha), 9) AS oriented FROM rawlong JOIN best USING (model) JOIN sizes USING (mmsi, track_id) WHERE {_EVAL}"
_VARIANT = "SELECT '{}' AS model, " + _RF + ", mmsi, track_id, is_true_match, {} AS score, {} AS oriented, {} AS alpha FROM rawlong JOIN best USING (model) JOIN sizes USING (mmsi, track_id) WHERE model = '{}'"
_VARIANTS = " UNION ALL ".join(
    _VARIANT.format(name, *(f"round({c} / pow(n_points, {a}), 9)" if a != "NULL" else c for c in ("score", "oriented")), a, model)
    for name, a, model in (("forward_alpha_1", "1e0", "forward_score"), ("log_odds_raw", "NULL", "log_odds_score"), ("forward_tuned", "alpha", "forward_score"), ("log_odds_tuned", "alpha", "log_odds_score"))
)


def raw_long(spark, d, kappa=score_phmm.KAPPA) -> DataFrame:
    """Forward and log-odds scores before any correction, dealt by detection, which later groupings keep."""
    points, _, pairs = pairs_of(spark, d, FINE)

    def make():
        at = (spark.sparkContext.applicationId, d, "score", "phmm")
        s = _kept[at] if kappa == score_phmm.KAPPA and at in _kept else score_phmm.scores(pairs, points, kappa)
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pairs.count() // DEALT)
        own = s.select(*PAIR, "n_points", *RAW).withColumn("is_true_match", preselect.is_true())
        return rank.long_scores(own.repartition(parts, *RF), RAW)

    return kept(spark, d, "raw", kappa, make=make)


def tuned(spark, d, kappa=score_phmm.KAPPA) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Raw scores, track sizes, the split of detections with several candidates, and the alphas tuned on its first part."""
    raw, n = raw_long(spark, d, kappa), sizes(spark, d)
    split = kept(spark, d, "split", make=lambda: evaluate.held_out(pairs_of(spark, d, FINE)[2]))
    return raw, n, split, kept(spark, d, "best", kappa, make=lambda: evaluate.tuned_alpha(raw, n, split))


@query(ranking_sql(f"SELECT *, {_METRICS} FROM (SELECT model, {_COUNTS} FROM (SELECT model, is_true_match, row_number() OVER (PARTITION BY {_RF} ORDER BY round(oriented / pow(n_points, 0.9e0), 9) DESC, mmsi, track_id) AS rnk FROM rawlong JOIN sizes USING (mmsi, track_id) WHERE model = 'forward_score') GROUP BY model)", _SIZES, _RAW, models=MODELS))
def length_corrected_top1(spark, d):
    s = raw_long(spark, d).where("model = 'forward_score'")
    return evaluate.model_metrics(evaluate.corrected(s, sizes(spark, d), 0.9))


@query(ranking_sql("SELECT model, alpha, precision FROM best", models=MODELS, long=[*TUNED, _long_cte(MODELS, "wide")]))
def alpha_tuned_split(spark, d):
    """Alpha of each score, tuned on a fifth of the detections with several candidates."""
    return tuned(spark, d)[3].select("model", "alpha", "precision")


@query(pair_sql(f"SELECT CASE WHEN n = 1 THEN 'single' WHEN part = 0 THEN 'tuning' ELSE 'evaluation' END AS population, count(*) AS n_signals, CAST(sum(n) AS BIGINT) AS n_candidates FROM (SELECT {_RF}, count(*) AS n FROM cand GROUP BY {_RF}) LEFT JOIN parts USING ({_RF}) GROUP BY 1", _PARTS, divisor=FINE))
def corrected_population(spark, d):
    pairs = pairs_of(spark, d, FINE)[2]
    per = pairs.groupBy(*RF).agg(F.count("*").alias("n")).join(tuned(spark, d)[2], RF, "left")
    name = F.when(F.col("n") == 1, "single").when(F.col("part") == 0, "tuning").otherwise("evaluation")
    return per.groupBy(name.alias("population")).agg(F.count("*").alias("n_signals"), F.sum("n").alias("n_candidates"))


_EVAL_LONG = [*TUNED, ("plain", _long_cte(MODELS, "wide")[1]), ("long", f"SELECT * FROM plain WHERE {_EVAL} UNION ALL {_CORRECTED}")]


def evaluated(spark, d) -> DataFrame:
    """Every model's scores and the corrected ones on the detections that alpha was not tuned on."""
    raw, n, split, best = tuned(spark, d)
    return evaluate.evaluation_population(scored(spark, d), split).unionByName(evaluate.corrected_results(raw, n, split, best))


@query(ranking_sql(f"SELECT *, {_METRICS} FROM (SELECT model, {_COUNTS} FROM ranked GROUP BY model)", models=MODELS, long=_EVAL_LONG))
def corrected_model_metrics(spark, d):
    return evaluate.model_metrics(evaluated(spark, d))


@query(ranking_sql(f"SELECT model, {_AVG} FROM summary GROUP BY model", models=MODELS, long=_EVAL_LONG))
def corrected_ranking_metrics(spark, d):
    return rounded(evaluate.ranking_metrics(rank.summary(evaluated(spark, d))).drop("mean_margin"))


_TEST_VARIANTS = [*TUNED, ("variants", _VARIANTS), ("long", f"SELECT * FROM variants WHERE ({_RF}) IN (SELECT ({_RF}) FROM parts WHERE part = 1)")]


def evaluation_variants(spark, d, kappa=score_phmm.KAPPA) -> DataFrame:
    raw, n, split, best = tuned(spark, d, kappa)
    return evaluate.correction_variants(raw, n, best).join(split.where("part = 1"), RF, "left_semi")


@query(ranking_sql(f"SELECT v.*, n_tied FROM (SELECT *, {_METRICS} FROM (SELECT model, any_value(alpha) AS alpha, {_COUNTS} FROM ranked GROUP BY model)) v JOIN (SELECT model, count(*) FILTER (t > 1) AS n_tied FROM (SELECT model, count(*) FILTER (oriented = best) AS t FROM ranked GROUP BY model, {_RF}) GROUP BY model) USING (model)", models=MODELS, long=_TEST_VARIANTS))
def correction_confusion(spark, d):
    """Confusion counts, metrics and ties of the four variants on the evaluation part."""
    v = evaluation_variants(spark, d)
    alphas = v.groupBy("model").agg(F.first("alpha").alias("alpha"))
    return evaluate.model_metrics(v.drop("alpha")).join(alphas, "model").join(rank.tied_signals(v.drop("alpha")).select("model", "n_tied"), "model")


@query(pair_sql(f"SELECT count(*) AS n_signals, round(avg(t / n), 6) AS expected_precision FROM (SELECT count(*) AS n, count(*) FILTER (is_true_match) AS t FROM cand GROUP BY {_RF})", divisor=FINE))
def random_floor(spark, d):
    return rank.random_floor(pairs_of(spark, d, FINE)[2])


@query(pair_sql(f"SELECT repeat, round(avg(hit::INT), 6) AS precision FROM (SELECT repeat, {_RF}, arg_min(is_true_match, {uniform_sql('repeat', *PAIR, seed=42)}) AS hit FROM cand, range(0, 50) g(repeat) GROUP BY ALL) GROUP BY repeat", divisor=FINE))
def random_pick_precision(spark, d):
    return rounded(rank.random_picks(pairs_of(spark, d, FINE)[2], 50).withColumn("repeat", F.col("repeat").cast("bigint")))


_MC = ("mc", f"SELECT a.model AS model_a, b.model AS model_b, count(*) FILTER (a.hit_1 AND NOT b.hit_1) AS n10, count(*) FILTER (NOT a.hit_1 AND b.hit_1) AS n01 FROM summary a JOIN summary b USING ({_RF}) WHERE a.model < b.model GROUP BY ALL")


@query(ranking_sql("SELECT * FROM mc", _MC, models=MODELS))
def mcnemar_counts(spark, d):
    return evaluate.mcnemar_counts(rank.summary(scored(spark, d)))


@query()
def mcnemar_test(spark, d):
    return evaluate.mcnemar_table(rank.summary(scored(spark, d)))


@query(ranking_sql("SELECT *, CASE WHEN n10 + n01 < 25 THEN 'exact' ELSE 'chi2' END AS method, round(CASE WHEN n10 + n01 < 25 THEN least(n10, n01)::DOUBLE ELSE pow(abs(n10 - n01) - 1, 2) / (n10 + n01) END, 6) AS statistic FROM mc", _MC, models=MODELS))
def mcnemar_statistics(spark, d):
    return rounded(evaluate.mcnemar_statistics(rank.summary(scored(spark, d))))


def _poisson_sql(u: str) -> str:
    term, total, steps = 0.36787944117144233, 0.0, []
    for k in range(1, 12):
        total += term
        term /= k
        steps.append(f"({u} > {total!r}e0)::INT")
    return " + ".join(steps)


_DRAWS = ("draws", f"SELECT model, b, {_poisson_sql('u')} AS c, reciprocal_rank AS v FROM (SELECT *, {uniform_sql('model', *RF, 'b', seed=42)} AS u FROM summary, range(1, 201) g(b))")


@query(ranking_sql("SELECT model, round(estimate, 6) AS estimate, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM (SELECT model, b, sum(c * v) / sum(c) AS m FROM draws GROUP BY ALL) JOIN (SELECT model, avg(reciprocal_rank) AS estimate FROM summary GROUP BY model) USING (model) GROUP BY ALL", _DRAWS))
def bootstrap_ci(spark, d):
    return rounded(evaluate.bootstrap(rank.summary(scored(spark, d, NN)), "reciprocal_rank", 200))


@query(ranking_sql("SELECT count(DISTINCT model) AS n_models, count(*) AS n_rows FROM long", models=MODELS))
def shared_population(spark, d):
    return evaluate.shared_population(scored(spark, d)).agg(F.countDistinct("model").alias("n_models"), F.count("*").alias("n_rows"))


@query("SELECT event_type AS model, round(sum(value), 6) AS seconds, CAST(sum(event_id % 7 + 1) AS BIGINT) AS pairs, round(sum(value) / sum(event_id % 7 + 1), 9) AS seconds_per_pair FROM events GROUP BY event_type")
def runtime_per_pair(spark, d):
    stages = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("model"), F.col("value").alias("seconds"), (F.col("event_id") % 7 + 1).alias("pairs"))
    return rounded(evaluate.runtime(stages), seconds_per_pair=9)


# Open set.
_DARK = ("dark", "SELECT mmsi, CAST('0x' || substr(md5(CAST(mmsi AS VARCHAR)), 1, 8) AS BIGINT) % 1000 < 200 AS dark FROM (SELECT DISTINCT mmsi FROM tracks)")
_FRAME = [
    ("sl", "SELECT l.*, a.dark AS dk, b.dark AS rf_dark FROM long l JOIN dark a ON l.mmsi = a.mmsi JOIN dark b ON l.rf_mmsi = b.mmsi"),
    ("tops", f"SELECT model, {_RF}, rf_dark, count(*) AS candidate_count, max(oriented) AS top FROM sl WHERE NOT dk GROUP BY ALL"),
    ("universe", f"SELECT DISTINCT model, {_RF} FROM sl WHERE rf_dark"),
    ("frame0", f"SELECT model, {_RF}, candidate_count, top, CASE WHEN rf_dark THEN 0 ELSE 1 END AS label, CASE WHEN rf_dark THEN 'scored_rejection' ELSE 'positive' END AS rejection_type FROM tops UNION ALL SELECT u.model, u.rf_mmsi, u.rf_track_id, u.rf_signal_id, 0, NULL, 0, 'automatic_rejection' FROM universe u ANTI JOIN tops USING (model, {_RF})"),
    ("frame", "SELECT *, coalesce(top, min(top) OVER (PARTITION BY model) - 1) AS accept_score FROM frame0"),
    ("tally0", "SELECT model, accept_score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM frame GROUP BY ALL"),
    ("tally", "SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY model) AS all_p, sum(q) OVER (PARTITION BY model) AS all_q FROM tally0 WINDOW w AS (PARTITION BY model ORDER BY accept_score DESC)"),
]


def _dark_frame(spark, d):
    vessels = traffic(spark, d, FINE)[0].select("mmsi")
    return openset.dark_vessel_frame(scored(spark, d, NN), openset.dark_by_hash(vessels))


@query(ranking_sql("SELECT * FROM dark", _DARK))
def dark_vessel_hash_split(spark, d):
    return openset.dark_by_hash(traffic(spark, d, FINE)[0].select("mmsi"))


@query()
def dark_vessel_split(spark, d):
    return openset.dark_split(traffic(spark, d, FINE)[0].select("mmsi"))


@query(ranking_sql(f"SELECT model, {_RF}, CAST(candidate_count AS BIGINT) AS candidate_count, label, rejection_type, round(accept_score, 6) AS accept_score FROM frame", _DARK, *_FRAME))
def dark_vessel_frame(spark, d):
    return rounded(_dark_frame(spark, d).select("model", *RF, "candidate_count", "label", "rejection_type", "accept_score"))


@query(ranking_sql("SELECT model, rejection_type, n, round(n / sum(n) OVER (PARTITION BY model, label), 6) AS share FROM (SELECT model, rejection_type, label, count(*) AS n FROM frame GROUP BY model, rejection_type, label)", _DARK, *_FRAME))
def rejection_summary(spark, d):
    return openset.rejections(_dark_frame(spark, d))


@query(ranking_sql("SELECT model, round(accept_score, 6) AS threshold, round(fp / all_q, 6) AS fpr, round(tp / all_p, 6) AS tpr FROM tally", _DARK, *_FRAME))
def roc_points(spark, d):
    return rounded(openset.roc_points(_dark_frame(spark, d)))


@query(ranking_sql("SELECT model, round(accept_score, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / all_p, 6) AS recall FROM tally", _DARK, *_FRAME))
def pr_points(spark, d):
    return rounded(openset.pr_points(_dark_frame(spark, d)))


@query(ranking_sql("SELECT model, round(sum(q * (tp - p / 2)) / (max(all_p) * max(all_q)), 6) AS auc, round(sum(p * tp / (tp + fp)) / max(all_p), 6) AS ap FROM tally GROUP BY model", _DARK, *_FRAME))
def roc_auc(spark, d):
    return rounded(openset.areas(_dark_frame(spark, d)))


_TALLY = "SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY model) AS all_p, sum(q) OVER (PARTITION BY model) AS all_q FROM (SELECT model, accept_score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM frame WHERE rejection_type <> 'automatic_rejection' GROUP BY ALL) WINDOW w AS (PARTITION BY model ORDER BY accept_score DESC)"
_AREA = "round(sum(q * (tp - p / 2)) / (max(all_p) * max(all_q)), 6) AS auc{0}, round(sum(p * tp / (tp + fp)) / max(all_p), 6) AS ap{0}"


@query(ranking_sql(f"SELECT * FROM (SELECT model, {_AREA.format('')} FROM tally GROUP BY model) JOIN (SELECT model, {_AREA.format('_scored')} FROM tally_scored GROUP BY model) USING (model) JOIN (SELECT model, round(avg((rejection_type = 'automatic_rejection')::INT), 6) AS automatic_rejection_rate FROM frame WHERE label = 0 GROUP BY model) USING (model)", _DARK, *_FRAME, ("tally_scored", _TALLY)))
def open_set_report(spark, d):
    return rounded(openset.report(_dark_frame(spark, d)))


@query(ranking_sql(f"SELECT model, CASE WHEN label = 1 THEN 'positive' WHEN candidate_count = 0 THEN 'automatic_rejection' ELSE 'scored_rejection' END AS rejection_type, count(*) AS n FROM (SELECT model, {_RF}, 1 AS label, count(*) AS candidate_count FROM long GROUP BY ALL UNION ALL SELECT model, {_RF}, 0, count(*) FILTER (NOT is_true_match) FROM long GROUP BY ALL) GROUP BY ALL"))
def leave_one_out_frame(spark, d):
    frame = openset.leave_one_out_frame(scored(spark, d, NN), traffic(spark, d, FINE)[1])
    return frame.groupBy("model", "rejection_type").agg(F.count("*").alias("n"))


# Bias.
_GROUPS = ("grouped", f"SELECT * FROM (SELECT *, CASE WHEN rnk = 1 AND is_true_match THEN 'correct' WHEN rnk = 1 THEN 'incorrect' WHEN is_true_match THEN 'shouldbe' END AS \"group\" FROM ranked) WHERE \"group\" IS NOT NULL")


@query(ranking_sql(f'SELECT model, {_RF}, mmsi, track_id, "group", round(score, 6) AS score FROM grouped', _GROUPS))
def correct_incorrect_shouldbe(spark, d):
    return rounded(bias.splits(scored(spark, d, NN)).select("model", *RF, *TRACK, "group", "score"))


@query(with_ctes("SELECT mmsi, track_id, round(avg(coalesce(speed_kph < 22, false)::INT), 6) AS stationary_ratio FROM tracks GROUP BY ALL"))
def stationary_ratio(spark, d):
    return rounded(bias.stationary_ratio(traffic(spark, d)[0], 22.0))


@query(ranking_sql('SELECT model, "group", count(n_points) AS n, round(avg(n_points), 6) AS mean, round(var_samp(n_points), 4) AS var FROM grouped JOIN sizes USING (mmsi, track_id) GROUP BY ALL', _SIZES, _GROUPS))
def welch_moments(spark, d):
    s = bias.splits(scored(spark, d, NN)).join(sizes(spark, d), TRACK)
    return rounded(bias.moments(s, "n_points"), var=4)


BIAS = ["nn_time_weighted", "forward_score_corrected", "log_odds_score_corrected"]


def bias_scores(spark, d) -> DataFrame:
    """NN time-weighted, corrected PHMM and corrected log-odds on the evaluation part of the detections with several candidates."""
    split = tuned(spark, d)[2]
    return evaluated(spark, d).where(F.col("model").isin(BIAS)).join(split.where("part = 1"), RF, "left_semi")


def _featured(spark, d):
    points, _, pairs = pairs_of(spark, d, FINE)
    near = bias.nearest_in_track(pairs.select(*PAIR, "rf_t", "rf_lat", "rf_lon"), points).select(*PAIR, "time_diff", "distance_diff")
    stats_ = prep.track_characteristics(points).select(*TRACK, "n_points", "mean_intra_time_diff", "mean_intra_dist_diff")
    return bias.splits(bias_scores(spark, d)).join(near, PAIR).join(stats_, TRACK, "left").join(bias.stationary_ratio(points), TRACK, "left")


@query()
def bias_t_tests(spark, d):
    return bias.t_tests(kept(spark, d, "featured", make=lambda: _featured(spark, d)))


_NEAREST = ("nearest", f"SELECT {_PAIR}, abs(rf_t - fix.t) AS time_diff, {hav('rf_lat', 'rf_lon', 'fix.lat', 'fix.lon')} AS distance_diff FROM (SELECT {_PAIR}, rf_t, rf_lat, rf_lon, arg_min(struct_pack(t := p.t, lat := p.lat, lon := p.lon), struct_pack(a := abs(p.t - rf_t), b := p.t, c := p.seq)) AS fix FROM cand JOIN tracks p USING (mmsi, track_id) GROUP BY ALL)")


@query(pair_sql(f"SELECT {_PAIR}, round(time_diff, 6) AS time_diff, round(distance_diff, 6) AS distance_diff, round(s, 6) AS reference_score, s = max(s) OVER (PARTITION BY {_RF}) AS is_match_ref FROM (SELECT *, round({transition('time_diff', 'distance_diff')}, 9) AS s FROM nearest)", _NEAREST, divisor=FINE))
def reference_label_transition(spark, d):
    points, _, pairs = pairs_of(spark, d, FINE)
    x = bias.reference_labels(pairs.select(*PAIR, "rf_t", "rf_lat", "rf_lon"), points)
    return rounded(x.select(*PAIR, "time_diff", "distance_diff", "reference_score", "is_match_ref"))


_BIAS_LONG = [*_EVAL_LONG[:-1], ("long", f"SELECT * FROM (SELECT * FROM plain UNION ALL {_CORRECTED}) WHERE model IN ({', '.join(map(repr, BIAS))}) AND ({_RF}) IN (SELECT ({_RF}) FROM parts WHERE part = 1)")]
_STATIONARY = ("still", "SELECT mmsi, track_id, avg(coalesce(speed_kph < 5, false)::INT) AS stationary_ratio FROM tracks GROUP BY ALL")
_FEATURES = ("features", f"SELECT g.*, time_diff, distance_diff, n_points, mean_intra_time_diff, mean_intra_dist_diff, stationary_ratio FROM grouped g JOIN nearest USING ({_PAIR}) LEFT JOIN characters USING (mmsi, track_id) LEFT JOIN still USING (mmsi, track_id)")


def _t_sql(experiment: str, feature: str, a: str, b: str, paired: bool) -> str:
    """Welch's or the paired t of two groups, from the table of features."""
    per = f"SELECT model, {_RF}, max({feature}) FILTER (\"group\" = '{a}') AS a, max({feature}) FILTER (\"group\" = '{b}') AS b FROM features GROUP BY ALL"
    head = f"SELECT '{experiment}' AS experiment, model, '{feature}' AS feature"
    if paired:
        return f"{head}, n AS n_a, n AS n_b, m / sqrt(v / n) AS t, n - 1e0 AS df FROM (SELECT model, count(a - b) AS n, avg(a - b) AS m, var_samp(a - b) AS v FROM ({per}) GROUP BY model)"
    return f"{head}, n_a, n_b, (ma - mb) / sqrt(x + y) AS t, pow(x + y, 2) / (x * x / (n_a - 1) + y * y / (n_b - 1)) AS df FROM (SELECT model, count(a) AS n_a, count(b) AS n_b, avg(a) AS ma, avg(b) AS mb, var_samp(a) / count(a) AS x, var_samp(b) / count(b) AS y FROM ({per}) GROUP BY model)"


# Written from the list of hypotheses: a chosen wrong track is longer, has shorter gaps in time and space, stands still more often, and has a fix nearer in time and space than the right one.
_HYPOTHESES = [("1", "n_points", False), ("2a", "mean_intra_time_diff", False), ("2b", "mean_intra_dist_diff", False), ("3", "stationary_ratio", False), ("4a", "time_diff", True), ("4b", "distance_diff", True)]


@query(ranking_sql("SELECT experiment, model, feature, n_a, n_b, round(t, 3) AS t, round(df, 3) AS df FROM (" + " UNION ALL ".join(_t_sql(e, f, "incorrect", "shouldbe", paired) for e, f, paired in _HYPOTHESES) + ")", _GROUPS, CHARACTER, _STATIONARY, _NEAREST, _FEATURES, models=MODELS, long=_BIAS_LONG))
def bias_t_statistics(spark, d):
    return rounded(bias.t_statistics(kept(spark, d, "featured", make=lambda: _featured(spark, d))), 3)


_REFERENCE = ("reference", f"SELECT *, s = max(s) OVER (PARTITION BY {_RF}) AS is_match_ref FROM (SELECT *, round({transition('time_diff', 'distance_diff')}, 9) AS s FROM nearest)")
_PHMM_PICK = f"SELECT r.*, f.is_match_ref FROM ranked r LEFT JOIN reference f USING ({_PAIR}) WHERE model = 'forward_score_corrected'"


def _reference(spark, d) -> tuple[DataFrame, DataFrame]:
    """Corrected Forward picks of the evaluation part, and reference labels of all pairs."""
    points, _, pairs = pairs_of(spark, d, FINE)
    picks = rank.chosen(bias_scores(spark, d).where("model = 'forward_score_corrected'"))
    return picks, bias.reference_labels(pairs.select(*PAIR, "rf_t", "rf_lat", "rf_lon"), points)


@query(ranking_sql(f"SELECT label_original, label_reference, count(*) AS n FROM (SELECT CASE WHEN is_true_match THEN 'correct' ELSE 'incorrect' END AS label_original, CASE WHEN is_match_ref THEN 'correct' WHEN NOT is_match_ref THEN 'incorrect' ELSE '<missing>' END AS label_reference FROM ({_PHMM_PICK}) WHERE rnk = 1) GROUP BY ALL", _NEAREST, _REFERENCE, models=MODELS, long=_BIAS_LONG))
def reference_label_transitions(spark, d):
    """How picks by the simulated truth fare by the reference label."""
    return bias.reference_transitions(*_reference(spark, d))


@query(ranking_sql(f"SELECT *, {_METRICS} FROM (SELECT model, {_COUNTS.replace('is_true_match', 'is_match_ref')} FROM ({_PHMM_PICK}) GROUP BY model)", _NEAREST, _REFERENCE, models=MODELS, long=_BIAS_LONG))
def reference_label_metrics(spark, d):
    picks, labels = _reference(spark, d)
    return rank.confusion(picks.drop("is_true_match").join(labels.select(*PAIR, F.col("is_match_ref").alias("is_true_match")), PAIR), ["model"])


_DIFFS = ("diffs", f"SELECT model, {_RF}, max(time_diff) FILTER (\"group\" = 'incorrect') - max(time_diff) FILTER (\"group\" = 'shouldbe') AS a, max(distance_diff) FILTER (\"group\" = 'incorrect') - max(distance_diff) FILTER (\"group\" = 'shouldbe') AS b FROM grouped JOIN nearest USING ({_PAIR}) GROUP BY ALL")


@query(ranking_sql("SELECT model, quadrant, n, round(100 * n / sum(n) OVER (PARTITION BY model), 6) AS percent FROM (SELECT model, quadrant, count(*) AS n FROM (SELECT model, CASE WHEN a < 0 AND b < 0 THEN 'both' WHEN a < 0 THEN 'only_time_diff' WHEN b < 0 THEN 'only_distance_diff' ELSE 'rest' END AS quadrant FROM diffs WHERE a IS NOT NULL AND b IS NOT NULL) GROUP BY model, quadrant)", _GROUPS, _NEAREST, _DIFFS, models=MODELS, long=_BIAS_LONG))
def difference_quadrants(spark, d):
    return bias.quadrants(kept(spark, d, "featured", make=lambda: _featured(spark, d)))


@query(ranking_sql(f"SELECT CAST(coalesce(sum(a * b), 0) AS BIGINT) AS \"both\", CAST(coalesce(sum(a * (1 - b)), 0) AS BIGINT) AS only_a, CAST(coalesce(sum(b * (1 - a)), 0) AS BIGINT) AS only_b, round(sum(a * b) / count(*), 6) AS jaccard FROM (SELECT max((model = 'nn_haversine')::INT) AS a, max((model = 'nn_segment')::INT) AS b FROM grouped WHERE \"group\" = 'incorrect' GROUP BY {_RF}) WHERE a + b > 0", _GROUPS))
def mistake_overlap_jaccard(spark, d):
    return bias.mistake_overlap(bias.splits(scored(spark, d, NN)), "nn_haversine", "nn_segment")


@query(ranking_sql("SELECT a, b, count(*) AS n FROM (SELECT coalesce(x.label, '<missing>') AS a, coalesce(y.label, '<missing>') AS b FROM (SELECT *, CASE WHEN hit_1 THEN 'hit' ELSE 'miss' END AS label FROM summary WHERE model = 'nn_segment') x FULL JOIN (SELECT *, CASE WHEN hit_1 THEN 'hit' ELSE 'miss' END AS label FROM summary WHERE model = 'nn_time_weighted' AND candidate_count > 1) y USING (" + _RF + ")) GROUP BY ALL"))
def label_contingency(spark, d):
    s = rank.summary(scored(spark, d, NN)).withColumn("label", F.when(F.col("hit_1"), "hit").otherwise("miss"))
    left = s.where("model = 'nn_segment'").withColumnRenamed("label", "x")
    right = s.where("model = 'nn_time_weighted' and candidate_count > 1").withColumnRenamed("label", "y")
    return bias.label_table(left, right, "x", "y")


# Views over finished tables, and simulation.
_BOX = "quantile_cont(n_points, 0.25) AS q1, median(n_points) AS med, quantile_cont(n_points, 0.75) AS q3, round(avg(n_points), 6) AS mean"


@query(ranking_sql(f'SELECT model, "group", {_BOX} FROM grouped JOIN sizes USING (mmsi, track_id) GROUP BY ALL', _SIZES, _GROUPS))
def boxplot_stats(spark, d):
    s = bias.splits(scored(spark, d, NN)).join(sizes(spark, d), TRACK)
    q = lambda x: F.percentile("n_points", F.lit(x))
    return s.groupBy("model", "group").agg(q(0.25).alias("q1"), F.median("n_points").alias("med"), q(0.75).alias("q3"), F.round(F.avg("n_points"), 6).alias("mean"))


@query(with_ctes("SELECT CAST(floor(time_diff / 50) AS BIGINT) AS bin, count(*) AS n FROM speeds WHERE time_diff < 9100 GROUP BY ALL"))
def histogram_bins(spark, d):
    s = prep.add_speed(prep.remove_short_tracks(fixture.reports(spark, d))).where("time_diff < 9100")
    return s.groupBy(F.floor(F.col("time_diff") / 50).alias("bin")).agg(F.count("*").alias("n"))


@query(with_ctes("SELECT mmsi, track_id, round(avg(lat), 6) AS center_lat, round(avg(lon), 6) AS center_lon, count(*) AS n_points FROM tracks GROUP BY ALL"))
def map_layer(spark, d):
    return rounded(traffic(spark, d)[0].groupBy(*TRACK).agg(F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lon"), F.count("*").alias("n_points")))


@query()
def simulated_training_data(spark, d):
    s = simulate.training_data(traffic(spark, d)[0], day=2000.0)
    return s.select(*TRACK, "t", "state", F.col("ais.lat").alias("ais_lat"), F.col("ais.lon").alias("ais_lon"), F.col("rf.lat").alias("rf_lat"), F.col("rf.lon").alias("rf_lon"))


KAPPAS = [(0.5, 2.0), (1.0, 1.0)]
_KAPPA_FRAME = [("variants", _VARIANTS), ("long", "SELECT * FROM variants"), ("dark", _DARK[1])]


def _kappa_sql(k: tuple[float, float]) -> str:
    closed = f"SELECT model, any_value(alpha) AS alpha, round(avg((rnk = 1 AND is_true_match)::INT) / avg((rnk = 1)::INT), 4) AS closed_set_precision FROM ranked WHERE ({_RF}) IN (SELECT ({_RF}) FROM parts WHERE part = 1) GROUP BY model"
    auc = "SELECT model, round(sum(q * (tp - p / 2)) / (max(all_p) * max(all_q)), 6) AS auc_scored_only FROM tally_scored GROUP BY model"
    return ranking_sql(f"SELECT {k[0]}e0 AS kappa_ais, {k[1]}e0 AS kappa_rf, model AS variant, alpha, closed_set_precision, auc_scored_only FROM ({closed}) JOIN ({auc}) USING (model)", *_FRAME, ("tally_scored", _TALLY), models=MODELS, kappa=k, long=[*TUNED, *_KAPPA_FRAME])


@query(" UNION ALL ".join(f"SELECT * FROM ({_kappa_sql(k)})" for k in KAPPAS))
def kappa_sensitivity(spark, d):
    """Four variants for each kappa: alpha tuned on the tuning part, precision on the other part, and the area under the ROC curve of scored dark-vessel detections."""
    out = None
    for ka, kr in KAPPAS:
        raw, n, split, best = tuned(spark, d, (ka, kr))
        all_ = evaluate.correction_variants(raw, n, best)
        test = all_.join(split.where("part = 1"), RF, "left_semi")
        closed = evaluate.model_metrics(test).select("model", F.col("precision").alias("closed_set_precision"))
        frame = openset.dark_vessel_frame(all_.drop("alpha")).where("rejection_type <> 'automatic_rejection'")
        auc = openset.areas(frame).select("model", F.round("auc", 6).alias("auc_scored_only"))
        alpha = all_.select("model", "alpha").distinct()
        rows = alpha.join(closed, "model").join(auc, "model")
        rows = rows.select(F.lit(ka).alias("kappa_ais"), F.lit(kr).alias("kappa_rf"), F.col("model").alias("variant"), "alpha", "closed_set_precision", "auc_scored_only")
        out = rows if out is None else out.unionByName(rows)
    return out
