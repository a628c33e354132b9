"""Benchmark decontamination.

Rare n-gram seeds join training passages to test items, then Smith-Waterman
alignment scores the meeting places, so edited and paraphrased copies count.

The first pass over the corpus counts, for every word trigram of the items,
the documents that hold it. An item's seeds are its trigrams that few
documents hold: at most ``RARE_SHARE`` of them, or at most twice the item's
own median, so that an item which leaked into a third of the corpus keeps at
least half of its trigrams. The second pass aligns each item with each stretch
of text where its seeds meet, inside the map task: no text is shuffled.

Items travel as a broadcast of flat arrays, made from at most ``BLOCK_BYTES``
of text; a larger benchmark is split into such blocks by a hash of the item and
each block is compared with all documents. A block's arrays and word table take
about ``EXPANDED`` times its text at most.

Words are lower-cased runs without ASCII punctuation. Match 2, mismatch -1,
gap -1; score = alignment / (2 * words of the item). A hit needs
``MIN_SCORE`` and an alignment worth ``min(MIN_WORDS, words of the item)``
matches. An item of one or two words is its own only seed: it hits every
document that holds it. ``decontaminated`` leaves such items out, as a word or
two do not show a leak.

Defined results: null or blank texts and items have no hits; an item without
an id counts like any other, its hits have a null item_id; repeated rows of
documents give repeated hits, repeated items one; of several places where an
item meets one document the best is reported, of equal ones the one that starts
first, then the one that ends first; other columns are ignored by
``contaminated`` and passed on by ``decontaminated``; a text of any length is
read whole, in pieces.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sent, batch, by_text, pieces, slices, table

GRAM, RARE_SHARE, RARE_LEAST, MIN_SCORE, MIN_WORDS, BLOCK_BYTES, EXPANDED, PIECE = 3, 0.001, 10, 0.5, 8, 8 << 20, 30, 1 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
CELLS = 1 << 20
HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("n_words", pa.int64())])
_SPACED = bytes(32 if x < 128 and not chr(x).isalnum() else x for x in range(256))
_BREAK = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]").search
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_SPACED).split() if text else []


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit code for each n-gram; seeds are compared by code and settled by the alignment."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    wide = ids.astype(np.uint64)
    out = wide[: len(ids) - n + 1].copy()
    for k in range(1, n):
        out = out * _MIX + wide[k : len(ids) - n + 1 + k]
    return out


class Seeds:
    """Seeds of one length: ascending codes, and where each stands in the items, as flat arrays."""

    def __init__(self, codes: np.ndarray, item: np.ndarray, offset: np.ndarray):
        order = np.lexsort((offset, item, codes))
        self.item, self.offset = item[order], offset[order]
        self.codes, first = np.unique(codes[order], return_index=True)
        self.first = np.append(first, len(order)).astype(np.int64)

    def rare(self, docs: np.ndarray, most: float) -> Seeds:
        """Each item's rare seeds. docs: documents by code."""
        size = np.diff(self.first)
        held = np.repeat(docs, size)
        order = np.lexsort((held, self.item))
        items, start, n = np.unique(self.item[order], return_index=True, return_counts=True)
        limit = np.maximum(most, 2 * held[order][start + (n - 1) // 2])
        kept = held <= limit[np.searchsorted(items, self.item)]
        return Seeds(np.repeat(self.codes, size)[kept], self.item[kept], self.offset[kept])


class Items:
    """The items of one block: ids, word numbers (from 1; 0 is any other word) and seeds by their length."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        parted = sorted(((i, w) for i, w in ((i, words_of(t)) for i, t in rows) if w), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        self.vocabulary = {w: k for k, w in enumerate(sorted({x for _, ws in parted for x in ws}), 1)}
        self.ids = [i for i, _ in parted]
        numbered = [np.array([self.vocabulary[x] for x in w], np.int32) for _, w in parted]
        self.ends = np.cumsum([0, *map(len, numbered)])
        self.flat = np.concatenate([np.zeros(0, np.int32), *numbered])
        self.seeds: dict[int, Seeds] = {}
        for n in range(1, GRAM + 1):
            mine = [k for k, w in enumerate(numbered) if min(GRAM, len(w)) == n]
            if mine:
                codes = [grams(numbered[k], n) for k in mine]
                at = [np.arange(len(c), dtype=np.int32) for c in codes]
                self.seeds[n] = Seeds(np.concatenate(codes), np.repeat(np.array(mine, np.int32), [len(c) for c in codes]), np.concatenate(at))

    def words(self, k: int) -> np.ndarray:
        return self.flat[self.ends[k] : self.ends[k + 1]]

    def number(self, text: str | None) -> np.ndarray:
        """Word numbers of a whole text, piece by piece."""
        known = self.vocabulary.get
        parts = [np.array([known(x, 0) for x in words_of(p)], np.int32) for p in pieces(text or "", PIECE, _BREAK)]
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.int32), *parts])

    def seeds_in(self, ids: np.ndarray):
        """(n, positions, index of the seed among those of length n) for each seed length."""
        for n, seeds in self.seeds.items():
            if len(ids) < n or not len(seeds.codes):
                continue
            full = ids[: len(ids) - n + 1] != 0
            for k in range(1, n):
                full = full & (ids[k : len(ids) - n + 1 + k] != 0)
            at = np.flatnonzero(full)
            if len(at):
                code = grams(ids, n)[at]
                found = np.minimum(np.searchsorted(seeds.codes, code), len(seeds.codes) - 1)
                same = seeds.codes[found] == code
                yield n, at[same], found[same]

    def keep_rare(self, docs: dict[int, np.ndarray], n_docs: int) -> None:
        most = max(RARE_LEAST, RARE_SHARE * n_docs)
        self.seeds = {n: s.rare(docs[n], most) for n, s in self.seeds.items()}


def count_seeds(items):
    """(n, seed, documents that hold it) of each task, and under n = 0 its documents; counts are arrays as long as the seeds."""

    def run(batches):
        total = {n: np.zeros(len(s.codes), np.int64) for n, s in items.value.seeds.items()}
        n_docs = 0
        for b in batches:
            n_docs += b.num_rows
            for lo, hi in slices(b.column(0), PIECE):
                for text in b.column(0).slice(lo, hi - lo).to_pylist():
                    for n, _, found in items.value.seeds_in(items.value.number(text)):
                        total[n][np.unique(found)] += 1
        held = {n: np.flatnonzero(t) for n, t in total.items()}
        schema = pa.schema([("n", pa.int32()), ("seed", pa.int64()), ("docs", pa.int64())])
        yield batch(schema, [[0], [0], [n_docs]])
        for n, at in held.items():
            yield batch(schema, [np.full(len(at), n, np.int32), at, total[n][at]])

    return run


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Smith-Waterman of each (item, stretch): (alignment, end in the stretch, exclusive; first best).

    Pairs of like length are aligned together: a row of all matrices at a
    time, horizontal gaps by a running maximum.
    """
    out: list[tuple[int, int]] = [(0, 0)] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    at = 0
    while at < len(order):
        some = [order[at]]
        while at + len(some) < len(order) and len(pairs[order[at + len(some)]][1]) * (len(some) + 1) <= CELLS // 8:
            some.append(order[at + len(some)])
        at += len(some)
        wide, high = max(len(pairs[i][1]) for i in some), max(len(pairs[i][0]) for i in some)
        a, b = np.full((len(some), high), -1, np.int32), np.zeros((len(some), wide), np.int32)
        for r, i in enumerate(some):
            a[r, : len(pairs[i][0])], b[r, : len(pairs[i][1])] = pairs[i]
        ramp = np.arange(1, wide + 1, dtype=np.int32) * -GAP
        row = np.zeros((len(some), wide + 1), np.int32)
        best, end = np.zeros(len(some), np.int32), np.zeros(len(some), np.int64)
        for i in range(high):
            now = np.maximum(row[:, :-1] + np.where(b == a[:, i : i + 1], MATCH, MISMATCH).astype(np.int32), row[:, 1:] + GAP)
            np.maximum(now, 0, out=now)
            now = np.maximum.accumulate(now + ramp, axis=1) - ramp
            row[:, 1:] = now
            j = now.argmax(axis=1)
            top = now[np.arange(len(some)), j]
            better = top > best
            best, end = np.where(better, top, best), np.where(better, j + 1, end)
        for r, i in enumerate(some):
            out[i] = int(best[r]), int(end[r])
    return out


def stretches(items: Items, ids: np.ndarray):
    """(item, from, to) where seeds of an item meet the text, by diagonal."""
    met: list[tuple[np.ndarray, np.ndarray]] = []
    for n, at, found in items.seeds_in(ids):
        seeds = items.seeds[n]
        lo, size = seeds.first[found], seeds.first[found + 1] - seeds.first[found]
        place = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        met.append((seeds.item[place].astype(np.int64), np.repeat(at, size) - seeds.offset[place]))
    if not sum(len(d) for _, d in met):
        return
    both = np.unique(np.concatenate([np.stack(m, 1) for m in met]), axis=0)
    sizes = items.ends[both[:, 0] + 1] - items.ends[both[:, 0]]
    slack = sizes // 3 + 2
    new = np.append(True, (both[1:, 0] != both[:-1, 0]) | (both[1:, 1] - both[:-1, 1] > slack[1:]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(both)) - 1
    for k, a, z, size, s in zip(both[first, 0].tolist(), both[first, 1].tolist(), both[last, 1].tolist(), sizes[first].tolist(), slack[first].tolist(), strict=True):
        yield k, max(0, a - s), min(len(ids), z + size + s)


def hits_of(items: Items, texts: list[str | None], least_words: int = 1) -> list[list[tuple]]:
    """For each text its hits (item_id, score, start, end, words of the item) with items of so many words."""
    asked, pairs = [], []
    for r, text in enumerate(texts):
        ids = items.number(text)
        for k, lo, hi in stretches(items, ids):
            item = items.words(k)
            if len(item) >= least_words:
                asked.append((r, k, lo))
                pairs.append((item, ids[lo:hi].copy()))
    good = []
    for (r, k, lo), (value, end), (item, part) in zip(asked, align(pairs), pairs, strict=True):
        if value >= MATCH * max(MIN_SCORE * len(item), min(MIN_WORDS, len(item))):
            good.append((r, k, lo, value, end, item, part))
    back = align([(item[::-1], part[:end][::-1]) for *_, end, item, part in good])
    best: dict[tuple[int, int], tuple] = {}
    for (r, k, lo, value, end, item, _), (_, length) in zip(good, back, strict=True):
        hit = (-value, lo + end - length, lo + end)
        best[r, k] = min(best.get((r, k), hit), hit)
    out: list[list[tuple]] = [[] for _ in texts]
    for (r, k), (value, start, end) in sorted(best.items()):
        n = len(items.words(k))
        out[r].append((items.ids[k], -value / (MATCH * n), start, end, n))
    return out


def find_hits(items):
    def run(batches):
        for b in batches:
            rows = []
            for lo, hi in slices(b.column(1), PIECE):
                ids, texts = (c.slice(lo, hi - lo).to_pylist() for c in b.columns[:2])
                for d, hits in zip(ids, hits_of(items.value, texts), strict=True):
                    rows += [(d, *h) for h in hits]
            if rows:
                yield batch(HITS, list(zip(*rows, strict=True)))

    return run


def drop_hits(items, text: str):
    """Passes on the rows of documents without a hit, whole."""

    def run(batches):
        for b in batches:
            column, clean = b.column(text), []
            for lo, hi in slices(column, PIECE):
                clean += [not h for h in hits_of(items.value, column.slice(lo, hi - lo).to_pylist(), GRAM)]
            yield b.filter(pa.array(clean, pa.bool_()))

    return run


def blocks(docs: DataFrame, bench: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Sent Items with their rare seeds, one block of the benchmark after the other. Runs a pass over ``docs`` for each block."""
    spark = docs.sparkSession
    tests = bench.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("text is not null").distinct()
    total = tests.agg(F.sum(F.octet_length("text")).cast("bigint")).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        rows = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow()
        items = Items(list(zip(rows["item_id"].to_pylist(), rows["text"].to_pylist(), strict=True)))
        del rows
        if not items.ids:
            continue
        sent = Sent(spark, items)
        made = by_text(docs.select(F.col("text").cast("string")), count_seeds(sent), "n int, seed bigint, docs bigint")
        counted = made.groupBy("n", "seed").agg(F.sum("docs").alias("docs")).toArrow()
        which, seed, held = (counted[c].to_numpy() for c in ("n", "seed", "docs"))
        docs_of = {m: np.zeros(len(s.codes), np.int64) for m, s in items.seeds.items()}
        for m, into in docs_of.items():
            into[seed[which == m]] = held[which == m]
        items.keep_rare(docs_of, int(held[which == 0].sum()))
        sent.gone()
        yield Sent(spark, items)


def contaminated(docs: DataFrame, bench: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document row and item that meet: doc_id, item_id, score, start_word, end_word (exclusive), n_words of the item."""
    given = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    kind = "doc_id bigint, item_id bigint, score double, start_word bigint, end_word bigint, n_words bigint"
    out = None
    for items in blocks(docs, bench, block_bytes):
        hits = by_text(given, find_hits(items), kind)
        out = hits if out is None else out.unionByName(hits)
    return docs.sparkSession.createDataFrame([], kind) if out is None else out


def decontaminated(docs: DataFrame, bench: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item of ``GRAM`` or more words."""
    out = docs
    for items in blocks(docs, bench, block_bytes):
        out = by_text(out, drop_hits(items, "text"), docs.schema)
    return out


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontaminate": op1_decontaminate}
SQL: dict[str, str] = {}
