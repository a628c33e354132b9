"""Near copies by SimHash, and by exact Jaccard similarity for what it leaves.

Two texts link if the sets of their ``WORDS``-word shingles have a Jaccard
similarity of ``LEAST`` or more; a group is a component of links.

A text's fingerprint is the bitwise majority of its shingles' codes. ``BLOCKS``
blocks of it, ``SAME`` at a time, are its places: fingerprints that differ in
``BLOCKS - SAME`` or fewer bits share one, and many that differ in more do. Where
up to ``FULL`` texts meet all are paired, elsewhere each with the place's centre.
Of the texts met within ``NEAR`` bits, each is compared with the nearest one.

Similar texts differ in up to 17 of 64 bits (half of them in 8 or more), which no
affordable blocks cover, so a fingerprint alone would lose links. All pairs that
are in different groups after that go through prefix filtering, which finds every
link: under any one order of all shingles, two similar sets share a shingle among
the first ``n - ceil(LEAST * n) + 1`` of each, so texts that meet on no such
shingle need no comparison.

The order puts shingles last that many texts hold, then goes by hash. What many
texts hold is known from a bounded sample of texts first, and then from the
counts of all prefixes: up to ``MOST_COMMON`` shingles that stand in more than
``HOT`` prefixes move to the end and the prefixes are taken anew. Any order gives
the same links; it bears on the number of meetings only.

A pair is compared only if the places where it meets leave room for enough
shared shingles: the first one that both hold has at most so many behind it.

Each shingle where texts meet has a centre, the member with the fewest shingles before it,
which in a large group is one with few words of its own, or one of lowest hash.
In each of ``STARS`` rounds a text is compared with one centre, so a round has no
more pairs than texts. Then all pairs that are in different groups still are
compared, so no link is lost.

Before the codes of two texts are compared, their parity bits are: each code
flips one of ``BITS`` bits (``LONG_BITS`` for sets above ``LONG``), so two sets
differ in no fewer codes than bits. A short and a long set are let through.

Defined results: words are ASCII lower-cased; a text of fewer words than a
shingle is one shingle; null and blank texts are copies of one another;
shingles are compared by a 64-bit code.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sent, by_text, forget, keep, keep_narrow, raws, text_hash
from .near_dedup import components, one_of_each

WORDS, LEAST, SAMPLE, MOST_COMMON, HOT, STARS, MEMO = 5, 0.8, 4096, 1 << 20, 32, 2, 150_000
BITS, LONG, LONG_BITS = 1024, 1000, 8192
BLOCKS, SAME, NEAR, FULL, CHUNK = 5, 2, 18, 64, 1 << 16
_MIX, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Numbers(dict):
    """Word -> 64-bit hash; a bounded memo."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, 1)
        return out


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.lower().split() if raw else []


def shingles(memo: Numbers, words: list[bytes], size: int = WORDS) -> np.ndarray:
    """Distinct codes of the shingles, ascending."""
    if not words:
        return np.zeros(0, np.int64)
    ids = np.array([memo[w] for w in words], np.uint64)
    size = min(size, len(ids))
    out = ids[: len(ids) - size + 1].copy()
    for k in range(1, size):
        out = out * _MIX + ids[k : len(ids) - size + 1 + k]
        out ^= out >> np.uint64(29)
    out *= _END
    out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


def prefix(codes: np.ndarray, common: np.ndarray, often: np.ndarray, least: float = LEAST) -> np.ndarray:
    """The first codes in the order of (known count, code) that two similar sets cannot both miss."""
    n = len(codes)
    if n and len(common):
        at = np.minimum(np.searchsorted(common, codes), len(common) - 1)
        codes = codes[np.lexsort((codes, np.where(common[at] == codes, often[at], 0)))]
    return codes[: n - ceil(least * n - 1e-9) + 1]


def parity(codes: np.ndarray) -> np.ndarray:
    """For each bit whether an odd number of codes falls there, as longs."""
    size = LONG_BITS if len(codes) > LONG else BITS
    return np.packbits(np.bincount(codes & (size - 1), minlength=size).astype(np.uint8) & 1).view(np.int64)


def simhash(codes: np.ndarray) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if it is set in over half of the codes."""
    set_ = np.zeros(64, np.int64)
    for at in range(0, len(codes), CHUNK):
        set_ += np.unpackbits(codes[at : at + CHUNK].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_ > len(codes)).tobytes(), "big", signed=True)


def _key(words: list[bytes]) -> int:
    h = xxhash.xxh64_intdigest(b" ".join(words), 2)
    return h - (1 << 64) if h >> 63 else h


def _sets(size: int):
    """(t, codes) of each row's text."""

    def run(batches):
        memo = Numbers()
        for b in batches:
            keys, sets = [], []
            for x in raws(b.column("text")):
                words = words_of(x)
                keys.append(_key(words))
                sets.append(shingles(memo, words, size))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["t", "codes"])

    return run


def _prefixes(sent, size: int, least: float):
    def run(batches):
        memo, (common, often) = Numbers(), sent.value
        for b in batches:
            keys, sizes, firsts, bits, prints = [], [], [], [], []
            for x in raws(b.column("text")):
                words = words_of(x)
                codes = shingles(memo, words, size)
                keys.append(_key(words))
                sizes.append(len(codes))
                firsts.append(prefix(codes, common, often, least).copy())
                bits.append(parity(codes))
                prints.append(simhash(codes))
            longs = pa.list_(pa.int64())
            made = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(firsts, longs), pa.array(bits, longs), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), *made], names=["doc_id", "h", "t", "n", "codes", "bits", "fp"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint"), text_hash().alias("h"), text.alias("text"))


Counts = tuple[np.ndarray, np.ndarray]


def _collected(counts: DataFrame) -> Counts:
    """Codes, ascending, and counts of the ``MOST_COMMON`` most frequent rows of (s, c)."""
    often = counts.orderBy(F.desc("c"), "s").limit(MOST_COMMON).toArrow().sort_by("s")
    return often["s"].to_numpy(), often["c"].to_numpy()


def sampled_counts(rows: DataFrame, size: int, sample: int = SAMPLE) -> Counts:
    """Shingles that several of about ``sample`` texts hold, and in how many texts they may stand."""
    k = max(1, rows.count() // sample)
    some = rows.where(F.pmod(F.xxhash64("h"), F.lit(k)) == 0).select("h", "text").dropDuplicates(["h"]).select("text")
    held = by_text(some, _sets(size), "t bigint, codes array<bigint>").select("t", F.explode("codes").alias("s")).distinct()
    codes, often = _collected(held.groupBy("s").agg(F.count("*").alias("c")).where("c > 1"))
    return codes, often * k


def merged(a: Counts, b: Counts) -> Counts:
    """Both, with the larger count where both know a code."""
    codes, counts = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.lexsort((-counts, codes))
    codes, first = np.unique(codes[order], return_index=True)
    return codes, counts[order][first]


def prefixed(rows: DataFrame, size: int = WORDS, least: float = LEAST, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, t) of every row, and (t, h, n, codes, bits, fp) of every text with its prefix in order. Reads the texts once or twice."""
    spark, known = rows.sparkSession, sampled_counts(rows, size)
    for last in (False, True):
        sent = Sent(spark, known)
        made = keep(by_text(rows, _prefixes(sent, size, least), "doc_id bigint, h bigint, t bigint, n bigint, codes array<bigint>, bits array<bigint>, fp bigint"), "prefixes")
        texts = keep(made.groupBy("t").agg(F.min_by(F.struct("h", "n", "codes", "bits", "fp"), "h").alias("x")).select("t", "x.*"), "texts")
        if last:
            break
        found = _collected(texts.select(F.explode("codes").alias("s")).groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") > hot))
        if not len(found[0]):
            break
        known = merged(known, found)
        forget(made)
        forget(texts)
        sent.gone()
    return made.select("doc_id", "h", "t"), texts


def masks(blocks: int = BLOCKS, same: int = SAME) -> list[int]:
    """Signed longs with the bits of ``same`` of the fingerprint's blocks, in all ways."""
    ends = [64 * k // blocks for k in range(blocks + 1)]
    bits = [(1 << hi) - (1 << lo) for lo, hi in zip(ends, ends[1:])]
    signed = (sum(some) for some in combinations(bits, same))
    return [x - (1 << 64) if x >> 63 else x for x in signed]


def nearest(texts: DataFrame, near: int = NEAR, full: int = FULL) -> DataFrame:
    """(a, b), a < b: for each text b the text before it with the nearest fingerprint of those that share a place. texts: (t, fp)."""
    places = F.array(*(F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for c, m in enumerate(masks())))
    rows = texts.select("t", "fp", F.inline(places))
    sizes = rows.groupBy("c", "key").agg(F.count("*").alias("m"), F.min(F.struct("t", "fp")).alias("centre")).where("m > 1")
    met = keep_narrow(rows.join(sizes, ["c", "key"]), "met")
    few = met.where(F.col("m") <= full).select("c", "key", "t", "fp")
    pairs = few.join(few.withColumnsRenamed({"t": "t2", "fp": "fp2"}), ["c", "key"]).select("t", "fp", "t2", "fp2")
    pairs = pairs.union(met.where(F.col("m") > full).select("t", "fp", F.col("centre.t"), F.col("centre.fp")))
    differ = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2")))
    best = pairs.where((F.col("t2") < F.col("t")) & (differ <= near)).groupBy("t").agg(F.min(F.struct(differ.alias("d"), "t2")).alias("x"))
    return best.select(F.col("x.t2").alias("a"), F.col("t").alias("b"))


def possible(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (a, b) whose parity bits allow the similarity asked for. texts: (t, n, bits)."""
    x, y = (texts.select(F.col("t").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab")
    counts = F.zip_with("bitsa", "bitsb", lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    differ = F.when(F.size("bitsa") == F.size("bitsb"), F.aggregate(counts, F.lit(0), lambda p, q: p + q)).otherwise(0)
    return pairs.join(x, "a").join(y, "b").where(differ <= (F.col("na") + F.col("nb")) * ((1 - least) / (1 + least)) + 1e-6).select("a", "b")


def similar(pairs: DataFrame, texts: DataFrame, rows: DataFrame, size: int, least: float) -> DataFrame:
    """The ``pairs`` (a, b) with the similarity asked for. texts: (t, h)."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct()
    given = rows.select("h", "text").join(texts.join(asked, "t", "left_semi").select("h"), "h", "left_semi").dropDuplicates(["h"]).select("text")
    sets = keep(by_text(given, _sets(size), "t bigint, codes array<bigint>"), "sets")
    both = pairs.join(sets.select(F.col("t").alias("a"), F.col("codes").alias("x")), "a").join(sets.select(F.col("t").alias("b"), F.col("codes").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return keep_narrow(both.where(shared >= least * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b"), "similar")


def labelled(texts: DataFrame, rows: DataFrame, size: int = WORDS, least: float = LEAST, stars: int = STARS) -> DataFrame:
    """(t, label) of every text (t, h, n, codes, bits, fp) that is similar to another: the smallest t of its group."""
    held = texts.select("t", "n", F.posexplode("codes").alias("i", "s"))
    met = keep(held.join(held.groupBy("s").agg(F.count("*").alias("c")).where("c > 1").drop("c"), "s"), "met")
    pairs = keep_narrow(possible(nearest(texts), texts, least), "pairs")
    edges = similar(pairs, texts, rows, size, least)
    labels = components(edges).select(F.col("node").alias("t"), "label")
    room = F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2"))
    near = (F.col("g") != F.col("g2")) & (F.least("n", "n2") >= least * F.greatest("n", "n2") - 1e-9) & (room >= least / (1 + least) * (F.col("n") + F.col("n2")) - 1e-6)
    carried = ["t", "n", "i", "g"]
    for k in range(stars + 1):
        now = met.join(labels, "t", "left").withColumn("g", F.coalesce("label", "t")).drop("label")
        if k or not edges.isEmpty():
            now = keep(now.join(now.groupBy("s").agg(F.min("g").alias("g1"), F.max("g").alias("g2")).where("g1 < g2").select("s"), "s"), "open")
        if k < stars:
            drawn = F.shiftrightunsigned(F.xxhash64("t", F.lit(k)), 24)
            place = F.shiftleft(F.least(F.col("i"), F.lit(1 << 22)).cast("bigint"), 40) + drawn if k % 2 == 0 else drawn
            centre = now.withColumn("place", place).groupBy("s").agg(F.min("place").alias("place"), *(F.min_by(c, "place").alias(f"{c}2") for c in carried))
            pairs = now.join(centre, "s").where(near).groupBy("t").agg(F.min_by("t2", "place").alias("t2")).select(F.least("t", "t2").alias("a"), F.greatest("t", "t2").alias("b")).distinct()
        else:
            other = now.select("s", *(F.col(c).alias(f"{c}2") for c in carried))
            pairs = now.join(other, "s").where(near & (F.col("t") < F.col("t2"))).select(F.col("t").alias("a"), F.col("t2").alias("b")).distinct()
        pairs = keep_narrow(possible(pairs, texts, least), "pairs")
        if not pairs.isEmpty():
            edges = edges.union(similar(pairs, texts, rows, size, least))
            labels = components(edges).select(F.col("node").alias("t"), "label")
    return labels


def grouped(docs: DataFrame, size: int = WORDS, least: float = LEAST, hot: int = HOT) -> DataFrame:
    """(doc_id, h, label) of every row: h is the hash of its text, rows of one group share a label."""
    rows = _rows(docs)
    made, texts = prefixed(rows, size, least, hot)
    return made.join(labelled(texts, rows, size, least), "t", "left").select("doc_id", "h", F.coalesce("label", "t").alias("label"))


def keep_one(docs: DataFrame, size: int = WORDS, least: float = LEAST) -> DataFrame:
    """One row of each group, all columns: by smallest doc_id, then text hash; rows without an id come last."""
    return one_of_each(docs, keep_narrow(grouped(docs, size, least), "labels"))
