"""SimHash near-duplicate groups.

A fingerprint is the bitwise majority of the XXH64 values of a text's 3-word
shingles. Fingerprints link at two or fewer differing bits. Four blocks of 16
bits leave two blocks untouched by two flipped bits, so each linked pair
shares one of six block pairs; only fingerprints that meet there are compared.

A block bucket with up to ``PAIR_LIMIT`` fingerprints is joined with itself
and its pairs verified. In a larger one each fingerprint offers its remaining
32 bits and their 32 single-bit neighbours as keys: two fingerprints meet on
a key exactly if they differ in two or fewer bits, and each meeting gives one
link to its smallest member. So no link is lost and the rows stay linear in
the bucket's size.

Defined results: a null or blank text has fingerprint zero; a text of one or
two words hashes the whole sequence; exact copies share a fingerprint; repeated
rows are answered row by row; a component of null ids only has a null id; other
columns of the input are ignored. ``keep_one`` passes on whole rows: of rows
that agree in id and text one stays, different texts under one id are judged
apart, and a row without an id counts like any other, behind those with one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_text, forget, keep, keep_narrow, packed, raws, table, text_hash

SHINGLE, SEED, MAX_BITS, PAIR_LIMIT, CHUNK = 3, 42, 2, 64, 1 << 16
BLOCKS, ROUNDS, SENT_ROWS = 4, 60, 1 << 18


def fingerprint(raw: bytes | None) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text."""
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + SHINGLE - 1]
        shingles = zip(part, part[1:], part[2:]) if len(words) >= SHINGLE else [words]
        hashes = b"".join([digest(b" ".join(s), SEED) for s in shingles])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("fp", pa.int64())])
    for b in batches:
        fps = np.array([fingerprint(x) for x in raws(b.column("text"))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(fps)], schema=schema)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp) of every row: h hashes the text, fp is a signed long."""
    given = docs.select(F.col("doc_id").cast("bigint"), text_hash().alias("h"), F.col("text").cast("string"))
    return by_text(given, _fingerprints, "doc_id bigint, h bigint, fp bigint")


def _block(fp, k: int):
    return F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF))


def links(fps: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(a, b), a < b: links that connect all fingerprints (distinct longs in ``fp``) at two or fewer differing bits."""
    fp = F.col("fp")
    places = []
    for c, (i, j) in enumerate(combinations(range(BLOCKS), 2)):
        k, m = (x for x in range(BLOCKS) if x not in (i, j))
        places.append(F.struct(F.lit(c).alias("c"), F.shiftleft(_block(fp, i), 16).bitwiseOR(_block(fp, j)).alias("key"), F.shiftleft(_block(fp, k), 16).bitwiseOR(_block(fp, m)).alias("rest")))
    rows = fps.select("fp", F.inline(F.array(*places)))
    sizes = rows.groupBy("c", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keep_narrow(rows.join(sizes, ["c", "key"]), "met")

    few = met.where(F.col("n") <= pair_limit).select("c", "key", "fp")
    pairs = few.alias("x").join(few.withColumnRenamed("fp", "fp2"), ["c", "key"]).where((F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= MAX_BITS))
    pairs = pairs.select(F.col("fp").alias("a"), F.col("fp2").alias("b"))

    near = [F.col("rest"), *(F.col("rest").bitwiseXOR(F.lit(1 << b)) for b in range(32))]
    many = met.where(F.col("n") > pair_limit).select("c", "key", "fp", F.explode(F.array(*near)).alias("near"))
    first = many.groupBy("c", "key", "near").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = many.join(first, ["c", "key", "near"]).where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, label): the smallest node reachable over ``edges`` (a, b), for every node that has an edge.

    Large-star and small-star rounds in turn; each round is written to the
    shared folder and the one before it deleted, and only a count and a checksum
    come to the driver. The rounds needed grow with the logarithm of the
    longest chain; more than ``rounds`` is an error.
    """
    now = keep_narrow(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        old, now = now, keep_narrow(small.where("u <> v").distinct(), "edges")
        was, mark = mark, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        forget(old)
        if mark == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def labelled(made: DataFrame) -> DataFrame:
    """(fp, label, component_id) of the fingerprints in ``made`` (doc_id, fp)."""
    fps = keep_narrow(made.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    labels = components(links(fps))
    named = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ids = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return named.join(ids, "label").select("fp", "label", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text)."""
    made = keep(fingerprints(docs), "fingerprints")
    return made.join(labelled(made), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, rows: DataFrame, sent_rows: int = SENT_ROWS) -> DataFrame:
    """One row of each group, all columns of ``docs``: the smallest doc_id's, then the smallest text hash's; rows without an id come last.

    ``rows`` has (doc_id, h, label) of every row, written. Choices are settled on
    these narrow columns; rows that agree in doc_id and text are copies of one
    another. Texts are read once more and shuffled only if there are more than
    ``sent_rows`` keys to drop, or where a kept key stands on several rows.
    """
    key = ["doc_id", "h"]
    units = rows.groupBy(*key, "label").agg(F.count("*").alias("m"))
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), *key)).alias("x")).select(*(F.col(f"x.{c}").alias(f"_{c}") for c in key))
    chosen = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("h") == F.col("_h"))
    marks = units.join(first, chosen, "left").select(*key, F.when(F.col("_h").isNull(), "gone").when(F.col("m") > 1, "twice").alias("mark")).where("mark is not null")
    marks = keep_narrow(marks.select(*(F.col(c).alias(f"_{c}") for c in key), "mark"), "marks")
    few = marks.count() <= sent_rows
    given = packed(docs, doc_id=F.col("doc_id").cast("bigint"), h=text_hash())
    given = given.join(F.broadcast(marks) if few else marks.hint("shuffle_hash"), chosen, "left").where("mark is null or mark = 'twice'")
    once = given.where("mark is null").select("row.*")
    return once.unionByName(given.where("mark = 'twice'").dropDuplicates(key).select("row.*"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of linked fingerprints, all columns."""
    made = keep(fingerprints(docs), "fingerprints")
    return one_of_each(docs, keep_narrow(made.join(labelled(made).select("fp", "label"), "fp").select("doc_id", "h", "label"), "labels"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_near_dedup": op10_near_dedup}
SQL: dict[str, str] = {}
