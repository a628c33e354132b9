"""License scan by ordered signature rules.

A text becomes its words (ASCII letters in lower case, runs of letters, digits
and non-ASCII characters) with single spaces. An Aho-Corasick automaton finds
which rules' keywords occur; only their regexes run. Detections are taken in
the order of their rules' priority, longer ones first; one that lies within an
interval already taken is suppressed.

The base phrases are counted at every place, and their labels stay whatever is
suppressed.

Defined results: a null text is empty; without detections labels are empty
strings, places null and the score 0; repeated rows are answered row by row;
other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sent, batch, by_text, raws, table
from .license_rules import BASE, CLASSES, regex, rules

_PLAIN = bytes(x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))
FOUND = pa.list_(pa.struct([("rule", pa.int32()), ("label", pa.string()), ("from_word", pa.int64()), ("to_word", pa.int64()), ("taken", pa.bool_())]))
_FOUND = "array<struct<rule:int,label:string,from_word:bigint,to_word:bigint,taken:boolean>>"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("found", FOUND)])


class Scanner:
    """Compiled on each worker from the rules' text."""

    def __init__(self, listed: list[tuple[str, str, str, str]]):
        self.rules = [(label, *CLASSES[kind]) for kind, label, _, _ in listed]
        self.compiled: list = [regex(rule) for *_, rule in listed]
        by_key: dict[str, list[int]] = {}
        for k, (_, _, key, _) in enumerate(listed):
            by_key.setdefault(key, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for key, mine in by_key.items():
            self.automaton.add_word(key, mine)
        self.automaton.make_automaton()

    def detections(self, text: str) -> list[tuple[int, int, int]]:
        """(from, to, rule) by characters, for every rule whose keyword occurs."""
        asked = {id(mine): mine for _, mine in self.automaton.iter(text)}
        out = []
        for k in sorted(k for mine in asked.values() for k in mine):
            if isinstance(self.compiled[k], str):
                self.compiled[k] = re.compile(self.compiled[k])
            out += [(*m.span(), k) for m in self.compiled[k].finditer(text)]
        return out

    def resolve(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool]]:
        """Each detection and whether it is taken."""
        order = sorted(found, key=lambda d: (self.rules[d[2]][1], d[0], -d[1], d[2]))
        out, kept, starts, ends = [], [], [], []  # ends: the furthest end up to that start
        at = 0
        while at < len(order):
            level, furthest, fresh = self.rules[order[at][2]][1], -1, []
            while at < len(order) and self.rules[order[at][2]][1] == level:
                lo, hi, k = order[at]
                before = bisect_right(starts, lo)
                good = furthest < hi and not (before and ends[before - 1] >= hi)
                if good:
                    fresh.append((lo, hi))
                    furthest = max(furthest, hi)
                out.append((lo, hi, k, good))
                at += 1
            kept = sorted([*kept, *fresh])
            starts, ends, most = [], [], -1
            for lo, hi in kept:
                most = max(most, hi)
                starts.append(lo)
                ends.append(most)
        return out

    def scan(self, raw: bytes | None) -> tuple:
        words = (raw or b"").lower().translate(_PLAIN).split()
        text = " " + b" ".join(words).decode("utf-8", "replace") + " "
        places, base = [], set()
        for phrase, label in BASE:
            at = text.find(f" {phrase} ")
            while at >= 0:
                places.append(at)
                base.add(label)
                at = text.find(f" {phrase} ", at + 1)
        found = self.resolve(self.detections(text))
        labels, score, rows = set(base), 0.0, []
        if found or places:
            marks = sorted({x for lo, hi, *_ in found for x in (lo, hi)} | {p + 1 for p in places})
            number, was, n = {}, 0, 0
            for m in marks:
                n += text.count(" ", was, m)
                number[m], was = n - 1, m
            for lo, hi, k, good in found:
                label, _, sure = self.rules[k]
                rows.append({"rule": k, "label": label, "from_word": number[lo], "to_word": number[hi], "taken": good})
                if good:
                    labels.add(label)
                    score = max(score, sure)
            starts = [number[p + 1] for p in places]
        if places:
            score = max(score, CLASSES["name"][1])
        first, last = (min(starts), max(starts)) if places else (None, None)
        return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, rows


def _scanned(sent):
    def run(batches):
        scanner = None
        for b in batches:
            scanner = scanner or Scanner(sent.value)
            rows = [scanner.scan(raw) for raw in raws(b.column(1))]
            if rows:
                yield batch(SCHEMA, [b.column(0).to_pylist(), *zip(*rows, strict=True)])

    return run


def scanned(docs: DataFrame, listed: list[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """For each row the base columns, labels, score and every detection with its words and whether it was taken."""
    given = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    ddl = f"doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, found {_FOUND}"
    return by_text(given, _scanned(Sent(docs.sparkSession, listed or rules())), ddl)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents")).drop("found")


QUERIES = {"op8_license_scan": op8_license_scan}
SQL: dict[str, str] = {}
