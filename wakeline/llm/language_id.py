"""Language identification of mixed text.

Unicode script ranges narrow a word's candidates to the languages that use its
script; the word scores each of them by the log likelihood of its letter
trigrams and no other language can take it; a Viterbi pass over the words with
a penalty for every switch labels spans of one language. The document's
language is the one with most letters.

Trigram counts come from at most ``TRAIN`` labelled documents of each language
(distinct ids, those with the smallest hash), so what is gathered grows with
the languages and not with the documents. The model holds, for each script, the
trigram cells that training texts of it use, times the languages that use it.

Where no stretch of another language gains more than half a penalty over the
best single language, one span is the optimum and the pass is left out; the
result is the same. A text of more than ``SLICE`` characters is read in pieces
that end between words, with the Viterbi state carried over; a run of more
letters than that counts as several words.

Defined results: a null text and one without letters are ``und`` with score 0,
as is every text if nothing could be learned; a word in a script that no
language uses scores nothing and any language may take it; ties go to the first
language by name; several texts under one id count as the first of them by
hash in training; repeated rows are answered row by row; other columns are
ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Sent, batch, by_text, in_remainder, pieces, slices, table

TRAIN, BITS, SMOOTH, PENALTY, FOREIGN, SLICE, LEAST_SHARE = 800, 18, 0.5, 16.0, -1e4, 1 << 18, 0.01
CELLS = 1 << BITS
_BREAK = re.compile(r"[^\w]|[\d_]").search
# Ranges of Unicode blocks by script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x2D00, 0x2D2F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "ethiopic": [(0x1200, 0x137F)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
SPANS = pa.list_(pa.struct([("lang", pa.string()), ("from_word", pa.int64()), ("to_word", pa.int64())]))


def letters() -> np.ndarray:
    """By code point: 0 for no letter, else 1 + the script's place, the last for any other script."""
    out = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint8, 0x110000)
    script = np.full(0x110000, len(SCRIPTS) + 1, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for lo, hi in ranges:
            script[lo : hi + 1] = k
    return out * script


def parse(texts: list[str | None], kinds: np.ndarray):
    """Of texts taken together: trigram cells of letters, the first letter of each word, its script, and each text's first word."""
    parts = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    gap = np.zeros(1, np.uint32)
    codes = np.concatenate([gap, *(x for p in parts for x in (p, gap))])
    ends = np.cumsum([len(p) + 1 for p in parts])
    kind = kinds[np.minimum(codes, 0x10FFFF)]
    c = np.where(kind > 0, codes, 32).astype(np.uint32)
    at = np.flatnonzero(kind)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    cells = ((c[at - 1] * np.uint32(0x9E3779B1)) ^ (c[at] * np.uint32(0x85EBCA77)) ^ (c[at + 1] * np.uint32(0xC2B2AE3D)))
    cells = ((cells ^ (cells >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)
    first = np.flatnonzero(kind[at - 1] == 0)
    word_of = np.searchsorted(at[first], np.concatenate([[0], ends]))
    return cells.astype(np.int64), first, kind[at[first]], word_of


class Model:
    """Log likelihoods by script. ``rows`` maps a cell to its row (0: not seen) of ``logs``, cells x the languages in ``users``."""

    def __init__(self, langs: list[str], found: tuple[np.ndarray, ...], kinds: np.ndarray):
        """found: language, script, cell and count of each trigram seen."""
        self.langs, self.kinds = langs, kinds
        lang, script, cell, n = found
        letters_ = np.bincount(lang * 256 + script, n, len(langs) * 256).reshape(-1, 256) if len(langs) else np.zeros((0, 256))
        total = letters_.sum(axis=1)
        used = letters_ >= LEAST_SHARE * np.maximum(1, total)[:, None]
        seen = max(1, len(np.unique(cell)))
        self.users, self.rows, self.logs = {}, {}, {}
        for k in np.flatnonzero(used.any(axis=0)).tolist():
            users = np.flatnonzero(used[:, k])
            mine = (script == k) & used[lang, k]
            cells, at = np.unique(cell[mine], return_inverse=True)
            counts = np.zeros((len(cells) + 1, len(users)), np.float32)
            np.add.at(counts, (at + 1, np.searchsorted(users, lang[mine])), n[mine])
            logs = np.log((counts + SMOOTH) / (total[users] + SMOOTH * seen))
            self.users[k], self.logs[k] = users, np.ascontiguousarray(logs - logs.mean(axis=1, keepdims=True), np.float32)
            self.rows[k] = np.zeros(CELLS, np.int32)
            self.rows[k][cells] = np.arange(1, len(cells) + 1)
        self.slice = max(1 << 14, min(SLICE, (1 << 22) // max(1, len(langs))))

    def scored(self, cells: np.ndarray, first: np.ndarray, script: np.ndarray) -> np.ndarray:
        """Words x languages; minus infinity where a language is no candidate."""
        sizes = np.diff(np.append(first, len(cells)))
        out = np.full((len(first), len(self.langs)), -np.inf, np.float32)
        for k in np.unique(script).tolist():
            words = np.flatnonzero(script == k)
            if k not in self.users:
                out[words] = 0
                continue
            mine = cells if len(words) == len(first) else cells[np.repeat(script == k, sizes)]
            starts = np.append(0, np.cumsum(sizes[words])[:-1])
            out[np.ix_(words, self.users[k])] = np.add.reduceat(self.logs[k][self.rows[k][mine]], starts, axis=0)
        return out

    def label(self, texts: list[str | None]) -> list[tuple]:
        """For each text, not longer than a slice: language, score, spans (language, from word, to word)."""
        cells, first, script, word_of = parse(texts, self.kinds)
        if not len(first) or not self.langs:
            return [("und", 0.0, [])] * len(texts)
        scores = self.scored(cells, first, script)
        sizes = np.diff(np.append(first, len(cells)))
        out = []
        for lo, hi in zip(word_of[:-1].tolist(), word_of[1:].tolist(), strict=True):
            out.append(self._document(lambda lo=lo, hi=hi: [(scores[lo:hi], sizes[lo:hi])]) if hi > lo else ("und", 0.0, []))
        return out

    def label_long(self, text: str) -> tuple:
        """The same for a text of any length, scored anew for every pass over it."""

        def parts():
            for piece in pieces(text, self.slice, _BREAK):
                for at in range(0, len(piece), 2 * self.slice):
                    cells, first, script, _ = parse([piece[at : at + 2 * self.slice]], self.kinds)
                    if len(first):
                        yield self.scored(cells, first, script), np.diff(np.append(first, len(cells)))

        return self._document(parts) if self.langs and next(parts(), None) else ("und", 0.0, [])

    def _document(self, parts) -> tuple:
        """parts() gives (scores, letters) of the words, part by part, as often as it is called."""
        totals = sum((s.sum(axis=0, dtype=np.float64) for s, _ in parts()), np.zeros(len(self.langs)))
        best, words = int(totals.argmax()), sum(len(s) for s, _ in parts())
        runs = [(best, 0, words)]
        if totals[best] == -np.inf or not one_span((s for s, _ in parts()), best):
            runs = viterbi(s for s, _ in parts())
        held, mine, sums = np.zeros(len(self.langs)), np.zeros((len(self.langs), len(self.langs))), 0
        ends, r = [hi for *_, hi in runs], 0
        for s, sizes in parts():
            lo = 0
            while lo < len(s):
                hi = min(len(s), ends[r] - sums)
                k = runs[r][0]
                held[k] += sizes[lo:hi].sum()
                mine[k] += s[lo:hi].sum(axis=0, dtype=np.float64)
                lo = hi
                r += lo + sums == ends[r]
            sums += len(s)
        top = int(held.argmax())
        sure = 1 / np.exp(np.minimum(mine[top] - mine[top][top], 0)).sum()
        return self.langs[top], float(held[top] / held.sum() * sure), [{"lang": self.langs[k], "from_word": lo, "to_word": hi} for k, lo, hi in runs]


def one_span(parts, best: int, penalty: float = PENALTY) -> bool:
    """No stretch of another language gains more than half a penalty, so one span of the best language is the optimum.

    A word that is closed to a language counts as a loss of ``FOREIGN``, more
    than a stretch is likely to gain; if one does, the answer is no.
    """
    sum_ = low = 0.0
    for scores in parts:
        gain = sum_ + np.cumsum(np.maximum(scores - scores[:, best : best + 1], FOREIGN), axis=0, dtype=np.float64)
        lows = np.minimum(low, np.minimum.accumulate(np.vstack([np.zeros((1, gain.shape[1])) + sum_, gain[:-1]]), axis=0))
        if (gain - lows).max() > penalty / 2:
            return False
        sum_, low = gain[-1], np.minimum(lows[-1], gain[-1])
    return True


def viterbi(parts, penalty: float = PENALTY) -> list[tuple[int, int, int]]:
    """Best labelling of words as (language, from, to). Each language keeps where its span began and the spans before it, so no table of all words is held."""
    value, begun, before, n = None, [], [], 0
    for scores in parts:
        for row in scores.tolist():
            if value is None:
                value, begun, before = row, [0] * len(row), [None] * len(row)
                n = 1
                continue
            top = max(value)
            where, switched = value.index(top), top - penalty
            if min(value) < switched:
                chain = (before[where], where, begun[where], n)
                for k, v in enumerate(value):
                    if v < switched:
                        begun[k], before[k] = n, chain
            value = [(v if v >= switched else switched) + x for v, x in zip(value, row, strict=True)]
            n += 1
    k = value.index(max(value))
    runs, link = [(k, begun[k], n)], before[k]
    while link:
        link, k, lo, hi = link
        runs.append((k, lo, hi))
    return runs[::-1]


def _counted(langs: list[str], sent):
    """(lang, script, cell, n) of each slice of texts; no task holds a table of all cells."""
    where = {x: k for k, x in enumerate(langs)}
    schema = pa.schema([("lang", pa.int32()), ("script", pa.int32()), ("cell", pa.int32()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            for lo, hi in slices(b.column(1), SLICE):
                for name, text in zip(*(c.slice(lo, hi - lo).to_pylist() for c in b.columns), strict=True):
                    for piece in pieces(text or "", SLICE, _BREAK):
                        cells, first, script, _ = parse([piece], sent.value)
                        sizes = np.diff(np.append(first, len(cells)))
                        keys, n = np.unique(np.repeat(script.astype(np.int64), sizes) << BITS | cells, return_counts=True)
                        yield batch(schema, [np.full(len(keys), where[name]), keys >> BITS, keys & (CELLS - 1), n])

    return run


def fitted(docs: DataFrame, use: Column, train: int = TRAIN) -> Model:
    """A model from the rows of ``docs`` (doc_id, text, lang) where ``use`` holds and lang is known. Runs its passes at once."""
    spark, kinds = docs.sparkSession, letters()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = docs.where(use & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    known = known.select(F.col("lang").cast("string"), F.col("doc_id").cast("bigint"), text.alias("text"))
    ids = known.select("lang", "doc_id").distinct()
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 12).cast("double") / float(1 << 52)
    # Twice as many of the lowest hashes hold the sample, so no language is sorted whole; where ids fall short of that it is a little smaller.
    ahead = ids.withColumn("place", place).join(F.broadcast(sizes), "lang").where(F.col("place") * F.col("n") <= 2 * train + 100)
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    chosen = ahead.withColumn("k", F.row_number().over(order)).where(F.col("k") <= train).select("lang", "doc_id")
    texts = known.join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi").groupBy("lang", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("lang", "text")
    langs = sorted(r.lang for r in sizes.select("lang").collect())
    if not langs:
        return Model([], (np.zeros(0, np.int64),) * 4, kinds)
    made = by_text(texts, _counted(langs, Sent(spark, kinds)), "lang int, script int, cell int, n bigint")
    rows = made.groupBy("lang", "script", "cell").agg(F.sum("n").alias("n")).toArrow()
    lang, script, cell, n = (rows[c].to_numpy().astype(np.int64) for c in ("lang", "script", "cell", "n"))
    seen = np.unique(lang)
    return Model([langs[k] for k in seen], (np.searchsorted(seen, lang), script, cell, n), kinds)


def _labelled(sent):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", SPANS)])

    def run(batches):
        model = sent.value
        for b in batches:
            for lo, hi in slices(b.column(1), model.slice):
                ids, texts = (c.slice(lo, hi - lo).to_pylist() for c in b.columns)
                long = len(texts) == 1 and len(texts[0] or "") > model.slice
                rows = [model.label_long(texts[0])] if long else model.label(texts)
                yield batch(schema, [ids, *zip(*rows, strict=True)])

    return run


def labelled(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, spans (lang, from_word, to_word) of every row."""
    given = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return by_text(given, _labelled(Sent(docs.sparkSession, model)), "doc_id bigint, lang_pred string, score double, spans array<struct<lang:string,from_word:bigint,to_word:bigint>>")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), in_remainder("doc_id", 3, 1)
    return labelled(docs, fitted(docs, ~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").cast("bigint").alias("n_spans"))


QUERIES = {"op7_language_id": op7_language_id}
SQL: dict[str, str] = {}
