"""Mixing sources to target weights by pivotal dependent rounding.

Sources weigh 5, 2, 1, repeating, in the order of their names; their shares of
all words are their targets, none above three times the source's size, the
excess going to the others by weight. A document's expected copies are target
over source size. Whole copies are certain; the fractional parts are rounded
in pairs: words move at random from one document of the pair to the other, so
that no expectation changes, until one of them has a whole copy or none. A
source's total words stay as they are in every pair.

Pairs are made inside groups of about ``GROUP`` documents of one source,
largest documents first; a document of over ``HEAVY`` times its group's mean size is
paired with all smaller ones of its group taken together, or its fraction would
outlast them. Each group leaves at most one fraction, and the
fractions meet in groups of ``FAN`` groups, level by level, until one is left
per source, which is rounded to the nearer side. So a hot source is many
tasks, and a level's input shrinks ``GROUP``- or ``FAN``-fold. Random draws are
hashes of the document id, so reruns agree.

Rows equal in source, id and text are counted first and share their copies
evenly (at most one apart). ``mixed`` counts rows equal in every column before
it shuffles them, so one row that is repeated without end is one row there; for
that its columns must be of kinds that Spark can group, so no maps.

Defined results: a null text has size 0, a document of size 0 is rounded by
itself; a null source is one source and comes last; a source of size 0 takes
nothing; repeated rows have one result each; rows without an id are told apart
by their texts; other columns are passed on by ``mixed`` whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep_narrow, packed, table, text_hash, word_count

WEIGHTS, MOST, GROUP, FAN, HEAVY, EPS, RUN = (5, 2, 1), 3, 4096, 64, 1, 1e-9, 65536
_ROW = "source string, doc_id bigint, size bigint, h bigint, m bigint, source_size bigint, target double, whole bigint, frac double, part bigint"


def water_filled(totals: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, ...) with target. Windows run over one row per source."""
    everything = Window.partitionBy(F.lit(0))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double")
    t = totals.withColumn("_w", weight).withColumn("_cap", F.col("source_size").cast("double") * most)
    full_first = Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(F.col("source_size")).over(everything) - F.coalesce(F.sum("_cap").over(full_first), F.lit(0.0))
    level = left / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(full_first), F.lit(0.0)))
    t = t.withColumn("_level", level)
    return t.withColumn("target", F.greatest(F.lit(0.0), F.least("_cap", F.max("_level").over(everything) * F.col("_w")))).drop("_w", "_cap", "_level")


def draw(doc_id, h: int, level: int) -> float:
    return (xxhash.xxh64_intdigest(f"{doc_id}:{h}:{level}", 6) + 0.5) / 2.0**64


def settle_heavy(sizes: list[int], fracs: list[float], draws: list[float]) -> None:
    """In place, for sizes in descending order: pair each heavy document with all smaller ones, which give or take in proportion to the room they have both ways."""
    s, f = np.array(sizes, np.float64), np.array(fracs)
    most = HEAVY * s.mean() if len(s) else 0
    for i in range(len(s) - 1):
        if s[i] <= most:
            break
        step = np.minimum(f[i + 1 :], 1 - f[i + 1 :])
        most_moved = float(s[i + 1 :] @ step)
        up, down = min(s[i] * (1 - f[i]), most_moved), min(s[i] * f[i], most_moved)
        if up + down <= EPS:
            continue
        moved = up if draws[i] * (up + down) < down else -down
        f[i] += moved / s[i]
        f[i + 1 :] -= step * (moved / most_moved)
    fracs[:] = f.tolist()


def pivot(sizes: list[int], fracs: list[float], draws: list[float]) -> None:
    """Round ``fracs`` in place, in the given order; at most one stays between 0 and 1."""
    held = None
    for i, f in enumerate(fracs):
        if not EPS < f < 1 - EPS:
            fracs[i] = float(round(f))
            continue
        if held is None:
            held = i
            continue
        up = min(sizes[held] * (1 - fracs[held]), sizes[i] * f)
        down = min(sizes[held] * fracs[held], sizes[i] * (1 - f))
        moved = up if draws[i] * (up + down) < down else -down
        fracs[held] += moved / sizes[held]
        fracs[i] -= moved / sizes[i]
        for k in (held, i):
            if not EPS < fracs[k] < 1 - EPS:
                fracs[k] = float(round(fracs[k]))
        if not 0 < fracs[held] < 1:
            held = i if 0 < fracs[i] < 1 else None


def _rounded(level: int, last: bool):
    def run(rows: pa.Table) -> pa.Table:
        ids, sizes, hashes, fracs = (rows.column(c).to_pylist() for c in ("doc_id", "size", "h", "frac"))
        draws = [draw(d, h, level) for d, h in zip(ids, hashes, strict=True)]
        order = sorted(range(len(ids)), key=lambda i: (-sizes[i], draws[i]))
        some = [fracs[i] for i in order]
        ranked = [sizes[i] for i in order], some, [draws[i] for i in order]
        settle_heavy(*ranked)
        pivot(*ranked)
        for i, f in zip(order, some, strict=True):
            fracs[i] = float(f > 0.5) if last else f
        return rows.set_column(rows.schema.get_field_index("frac"), "frac", pa.array(fracs, pa.float64()))

    return run


def copies(docs: DataFrame, size: Column, group: int = GROUP, fan: int = FAN) -> DataFrame:
    """(source, doc_id, size, h, m, source_size, target, copies): the copies that the m rows equal in source, id and text (hash h) take together."""
    given = docs.select(F.col("source").cast("string"), F.col("doc_id").cast("bigint"), size.cast("bigint").alias("size"), text_hash().alias("h"))
    units = keep_narrow(given.groupBy("source", "doc_id", "size", "h").agg(F.count("*").alias("m")), "units")
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n"))
    targets = keep_narrow(water_filled(totals), "targets").withColumnRenamed("source", "s")
    groups = max(1, -(-(targets.agg(F.max("n")).first()[0] or 0) // group))

    mass = F.when(F.col("source_size") > 0, F.col("m") * F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = units.join(targets, F.col("source").eqNullSafe(F.col("s"))).withColumn("whole", F.floor(mass + EPS)).withColumn("frac", F.greatest(mass - F.col("whole"), F.lit(0.0)))
    part = F.pmod(F.xxhash64("doc_id", "h"), F.ceil(F.col("n") / group))
    rows = keep_narrow(rows.select("source", "doc_id", "size", "h", "m", "source_size", "target", "whole", "frac", part.alias("part")), "rows")

    alone = (F.xxhash64("doc_id", "h", F.lit(6)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52) < F.col("frac")).cast("double")
    done = [rows.where("size = 0").withColumn("frac", alone), rows.where(f"size > 0 and frac <= {EPS}").withColumn("frac", F.lit(0.0))]
    open_, level = rows.where(f"size > 0 and frac > {EPS}"), 0
    while True:
        last = groups == 1
        made = keep_narrow(open_.groupBy("source", "part").applyInArrow(_rounded(level, last), _ROW), "rounded")
        done.append(made.where("frac in (0, 1)"))
        if last:
            break
        open_ = made.where("frac not in (0, 1)").withColumn("part", F.floor(F.col("part") / fan))
        level, groups = level + 1, -(-groups // fan)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("source", "doc_id", "size", "h", "m", "source_size", "target", (F.col("whole") + F.col("frac").cast("bigint")).alias("copies"))


def share_of(first: Column, rows: Column) -> Column:
    """Copies of so many rows from the row with this number (from 0) on, among m equal rows."""
    odd = F.col("copies") % F.col("m")
    return rows * F.floor(F.col("copies") / F.col("m")) + F.greatest(F.lit(0), F.least(first + rows, odd) - first)


def repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row so often, with its number in ``_row``, in runs so that no array grows with the count."""
    runs = rows.where(F.col(times) > 0).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(times) - 1, F.lit(RUN).cast("bigint"))))
    return runs.withColumn("_row", F.explode(F.sequence("_run", F.least(F.col("_run") + RUN, F.col(times)) - 1)))


def taken(docs: DataFrame, **how) -> DataFrame:
    """One row for each document row: doc_id, source, size, source_size, target, copies, taken."""
    rows = repeated(copies(docs, word_count("text"), **how), "m").withColumn("copies", share_of(F.col("_row"), F.lit(1)))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    Texts are shuffled once, to the counts of their key, and not sorted.
    """
    c = copies(docs, word_count("text"), **how).where("copies > 0").select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "m", "copies")
    given = packed(docs, s=F.col("source").cast("string"), d=F.col("doc_id").cast("bigint"), h=text_hash())
    key = [F.col("s").eqNullSafe(F.col("_s")), F.col("d").eqNullSafe(F.col("_d")), F.col("h") == F.col("_h")]
    rows = given.join(c.hint("shuffle_hash"), key)
    once = rows.where("m = 1").select("row", F.col("copies").alias("n"))
    unit = ["s", "d", "h", "m", "copies"]
    equal = rows.where("m > 1").groupBy(*unit, "row").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("s", "d", "h").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = equal.withColumn("n", share_of(before, F.col("k"))).select("row", "n")
    return repeated(once.unionByName(more), "n").select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op6_mixing": op6_mixing}
SQL: dict[str, str] = {}
