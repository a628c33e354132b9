"""Weighted rendezvous sharding.

Each record key draws a number u in (0, 1) for every shard, and the shard with
the smallest -ln(u) / weight takes the record. A new shard can only win
records for itself, and in proportion to its weight; no other record moves.
Draws are the leading 52 bits of md5("key:shard"), so any engine can repeat
them. Assigning is a projection: no shuffle.

Slots number a shard's records from 0 without gaps, in the order of md5 of the
whole record. Equal rows are counted before the shuffle, shards are cut into
ranges of that hash, so many that one holds about ``CUT_ROWS`` records, ranges are
numbered by themselves and shifted by the totals of those before them; no task
holds a whole shard, and records that share a key are spread. The counted rows,
without texts, are written once, so texts are read once.

Defined results: a null key is the empty text and all such records share a
shard; equal weights tie towards the smaller shard; repeated rows have one slot
each; an input column named like an output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep_narrow, table

SHARDS, CUT_ROWS, RUN = 8, 4096, 65536


def draw(key: Column, shard: int) -> Column:
    """u in (0, 1) of a key and a shard."""
    bits = head(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.lit(str(shard))))
    return (bits.cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a key, by weights of shards 0, 1, ..."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    bids = [F.struct((-F.log(draw(key, j)) / F.lit(float(w))).alias("bid"), F.lit(j).alias("shard")) for j, w in enumerate(weights)]
    return (F.least(*bids) if len(bids) > 1 else bids[0])["shard"]


def assigned(docs: DataFrame, key: str = "doc_id", weights: list[float] | None = None, grown: float = 1.0) -> DataFrame:
    """``docs`` with shard and grown_shard, the latter with one more shard of weight ``grown``."""
    weights = weights or [1.0] * SHARDS
    return docs.withColumns({"shard": rendezvous(F.col(key), weights), "grown_shard": rendezvous(F.col(key), [*weights, grown])})


def head(text: Column) -> Column:
    """The leading 52 bits of md5."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def slotted(rows: DataFrame, cut_rows: int = CUT_ROWS) -> DataFrame:
    """Rows (doc_id and others, shard) with slot, gapless from 0 in each shard."""
    names = rows.columns
    whole = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names))
    counted = keep_narrow(rows.groupBy(*names).agg(F.count("*").alias("_m")).withColumn("_at", head(whole)), "slots")
    n, shards = counted.agg(F.count("*"), F.countDistinct("shard")).first()
    cuts = max(1, -(-n // (cut_rows * max(1, shards))))
    counted = counted.withColumn("_cut", F.floor(F.col("_at") / F.lit(float(1 << 52)) * cuts).cast("int"))
    inside = Window.partitionBy("shard", "_cut").orderBy("_at", *names).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("_end", F.sum("_m").over(inside))
    totals = counted.groupBy("shard", "_cut").agg(F.sum("_m").alias("_all"))
    before = Window.partitionBy("shard").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.withColumn("_shift", F.coalesce(F.sum("_all").over(before), F.lit(0))).drop("_all")
    start = placed.join(F.broadcast(shifts), ["shard", "_cut"]).withColumn("_start", F.col("_shift") + F.col("_end") - F.col("_m"))
    runs = start.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_m") - 1, F.lit(RUN).cast("bigint"))))
    last = F.least(F.col("_run") + RUN, F.col("_m")) - 1
    return runs.withColumn("_k", F.explode(F.sequence("_run", last))).select(*names, (F.col("_start") + F.col("_k")).alias("slot"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = assigned(table(spark, sf_dir, "documents"))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint")
    rows = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "shard", "grown_shard")
    return slotted(rows).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op5_shards": op5_shards}
_HEAD = "CAST('0x' || substr(md5({}), 1, {}) AS BIGINT)"
_KEY = "coalesce(CAST(doc_id AS VARCHAR), '')"


def _least(n: int) -> str:
    """SQL of the shard of smallest bid among n of equal weight."""
    bids = ", ".join(f"-ln(({_HEAD.format(f"{_KEY} || ':{j}'", 13)} + 0.5e0) / 4503599627370496e0)" for j in range(n))
    return f"(list_position([{bids}], list_min([{bids}])) - 1)"


SQL = {
    # CRC-32 byte by byte, with a table that the query makes from the polynomial.
    "op5_shards": f"""
WITH steps AS (SELECT i, list_reduce([i]::BIGINT[] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM range(0, 256) r(i)),
tab AS (SELECT list(c ORDER BY i) AS tab FROM steps),
d AS (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS h, CAST({_least(SHARDS)} AS INTEGER) AS shard, CAST({_least(SHARDS + 1)} AS INTEGER) AS grown_shard FROM documents),
b AS (SELECT *, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS bytes FROM d),
r AS (SELECT *, CAST(len(bytes) + 1 AS BIGINT) AS size, CAST(xor(list_reduce([4294967295]::BIGINT[] || bytes, lambda a, x: xor(a >> 8, tab[CAST((xor(a, x) & 255) + 1 AS BIGINT)])), 4294967295) AS BIGINT) AS text_crc32 FROM b, tab)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY {_HEAD.format(f"{_KEY} || ':' || size || ':' || text_crc32 || ':' || shard || ':' || grown_shard", 13)}, doc_id, size, text_crc32, grown_shard) - 1 AS BIGINT) AS slot, grown_shard FROM r""",
}
