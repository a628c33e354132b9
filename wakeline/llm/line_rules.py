"""Quality rules with cross-document line frequency.

Lines are normalised (ASCII lower case, digits as 0, ASCII punctuation as
space, single spaces), hashed, and counted by the distinct documents of a host
that hold them; ``source`` stands for the host. A line held by more than
``LEAST_DOCS`` documents of its host is frequent, however large the host; with
``share`` given it must also stand in more than that share of them. A document
that loses more than ``MOST_LOST`` of its words is depleted and goes, as does one
that fails the base rules (too short, or too many repeated words).

A document is its doc_id, so exact copies under other ids count each; with
``copies_once`` texts are counted instead of documents. A row without an id
counts by its text.

Frequent lines are a broadcast up to ``SENT_ROWS`` of them; beyond, they are
joined by a shuffle, whose hot lines Spark's skew join splits, as both sides
are read from tables.

Defined results: a null or blank text has no words and fails; a null host is a
host of its own; repeated rows are answered row by row; a line without letters
or digits is never removed; other columns are ignored by ``judged`` and passed
on by ``cleaned``.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_text, keep, keep_narrow, raws, slices, table

LEAST_DOCS, MOST_LOST, LEAST_WORDS, MOST_REPEATED, WINDOW, SENT_ROWS, PIECE = 10, 0.5, 10, 20, 5, 1 << 18, 1 << 20
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_PLAIN = bytes(ord("0") if 48 <= x <= 57 else x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))
_LINES = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int64())]))
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("text_hash", pa.int64()), *((c, pa.int64()) for c in STATS), ("lines", _LINES)])
_DDL = "doc_id bigint, host string, text_hash bigint, " + ", ".join(f"{c} bigint" for c in STATS) + ", lines array<struct<h:bigint,w:bigint>>"


def signed_hash(raw: bytes) -> int:
    h = xxhash.xxh64_intdigest(raw, 0)
    return h - (1 << 64) if h >> 63 else h


def line_hash(line: bytes) -> int | None:
    """Hash of the normalised line; None without letters or digits."""
    plain = b" ".join(line.lower().translate(_PLAIN).split())
    return signed_hash(plain) if plain else None


def without(raw: bytes, gone: set[int]) -> bytes:
    """A text without the lines of these hashes."""
    return b"\n".join(line for line in raw.split(b"\n") if line_hash(line) not in gone)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 5-word window found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = [words[k:] for k in range(WINDOW)]
    if len(set(zip(*windows, strict=False))) == n:
        return 0
    first, marked = {}, bytearray(len(words))
    for at, w in enumerate(zip(*windows, strict=False)):
        was = first.setdefault(w, at)
        if was != at:
            marked[was : was + WINDOW] = marked[at : at + WINDOW] = b"\x01" * WINDOW
    return sum(marked)


def measure(text: str | None) -> tuple:
    """text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines as (hash, words)."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    seen, lines, dups = set(), {}, 0
    for line in raw.split(b"\n"):
        size = len(line.split())
        if not size:
            continue
        dups += line in seen
        seen.add(line)
        h = line_hash(line)
        if h is not None:
            lines[h] = lines.get(h, 0) + size
    return signed_hash(raw), len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dups, repeated_words(words), [{"h": h, "w": w} for h, w in lines.items()]


def _measured(batches):
    for b in batches:
        for lo, hi in slices(b.column(2), PIECE):
            ids, hosts, texts = (b.column(k).slice(lo, hi - lo) for k in range(3))
            made = zip(*map(measure, texts.to_pylist()), strict=True)
            columns = [ids, hosts, *(pa.array(c, f.type) for c, f in zip(made, list(_SCHEMA)[2:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def frequent_lines(made: DataFrame, least_docs: int = LEAST_DOCS, share: float | None = None, copies_once: bool = False) -> DataFrame:
    """(host, h, docs): hashes of lines above the limits."""
    unit = [F.lit(None).cast("bigint") if copies_once else F.col("doc_id"), F.when(F.lit(copies_once) | F.col("doc_id").isNull(), F.col("text_hash"))]
    rows = made.select("host", F.struct(*unit).alias("doc"), F.col("lines.h").alias("hs"))
    held = rows.select("host", "doc", F.explode("hs").alias("h")).distinct().groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > least_docs)
    if share is None:
        return held
    docs = rows.select("host", "doc").distinct().groupBy("host").agg(F.count("*").alias("all"))
    both = held.alias("x").join(docs.alias("y"), F.col("x.host").eqNullSafe(F.col("y.host")))
    return both.where(F.col("docs") > share * F.col("all")).select("x.host", "h", "docs")


def _measures(docs: DataFrame, host: str) -> DataFrame:
    given = docs.select(F.col("doc_id").cast("bigint"), F.col(host).cast("string").alias("host"), F.col("text").cast("string"))
    return keep(by_text(given, _measured, _DDL), "measured")


def _verdicts(made: DataFrame, most_lost: float = MOST_LOST, **limits) -> DataFrame:
    """The rows of ``made`` with lost_words, the hashes of removed lines (``gone``) and verdicts."""
    row = ["doc_id", "host", "text_hash"]
    lines = made.select(*row, F.inline("lines")).distinct()
    often = keep_narrow(frequent_lines(made, **limits), "often")
    often = F.broadcast(often) if often.count() <= SENT_ROWS else often
    hit = lines.alias("l").join(often.alias("o"), F.col("l.host").eqNullSafe(F.col("o.host")) & (F.col("l.h") == F.col("o.h")))
    lost = keep_narrow(hit.groupBy("l.doc_id", "l.host", "l.text_hash").agg(F.sum("w").alias("lost_words"), F.collect_set("l.h").alias("gone")), "lost")
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"k.{c}")) for c in row[:2]] + [F.col("m.text_hash") == F.col("k.text_hash")]
    out = made.drop("lines").alias("m").join(lost.alias("k"), same, "left").select("m.*", F.coalesce("lost_words", F.lit(0)).alias("lost_words"), "gone")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("depleted", F.col("lost_words") > most_lost * F.col("n_words")).withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def judged(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """For each row: doc_id, host, the measures, words lost with removed lines, base_failed, depleted, kept.

    Limits: least_docs, share, copies_once, most_lost.
    """
    return _verdicts(_measures(docs, host), **limits).drop("gone")


def _hashed(batches):
    for b in batches:
        hashes = [signed_hash(x or b"") for x in raws(b.column("text"))]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hashes, pa.int64())], names=[*b.schema.names, "_text_hash"])


def _stripped(batches):
    for b in batches:
        texts = [without(x, set(g)) if g else x for x, g in zip(raws(b.column("text")), b.column("_gone").to_pylist(), strict=True)]
        at = b.schema.get_field_index("text")
        columns = [pa.array(texts, pa.binary()).cast(pa.string()) if k == at else c for k, c in enumerate(b.columns[:-1])]
        yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])


def cleaned(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The kept rows of ``docs``, all columns, their texts without frequent lines.

    Verdict and removed lines are those of ``judged``, which depend on host and text only.
    """
    verdicts = _verdicts(_measures(docs, host), **limits).where("kept")
    verdicts = verdicts.groupBy("host", "text_hash").agg(F.first("gone").alias("_gone")).withColumnRenamed("host", "_host")
    hashed = docs.withColumn("text", F.col("text").cast("string"))
    kind = hashed.schema
    hashed = by_text(hashed, _hashed, hashed.select("*", F.lit(0).cast("bigint").alias("_text_hash")).schema)
    same = F.col(host).cast("string").eqNullSafe(F.col("_host")) & (F.col("_text_hash") == F.col("text_hash"))
    return by_text(hashed.join(verdicts, same).select(*docs.columns, "_gone"), _stripped, kind)


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", *STATS, "base_failed", "kept", "lost_words")


QUERIES = {"op2_line_rules": op2_line_rules}
SQL = {
    "op2_line_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, ws[i:i+4] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
marked AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(0, 5) AS x(k) GROUP BY r),
lines AS (
  SELECT r, doc_id, source, t, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS size,
         array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), ' ') AS plain
  FROM (SELECT r, doc_id, source, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d)),
full_lines AS (SELECT * FROM lines WHERE size > 0),
dup AS (SELECT r, count(*) AS n_dup_lines FROM (SELECT r, row_number() OVER (PARTITION BY r, line ORDER BY pos) AS k FROM full_lines) WHERE k > 1 GROUP BY r),
often AS (
  SELECT source, plain FROM full_lines WHERE plain <> ''
  GROUP BY source, plain HAVING count(DISTINCT coalesce('i' || doc_id, 't' || t)) > 10),
lost AS (SELECT r, sum(size) AS lost_words FROM full_lines l JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.plain = o.plain GROUP BY r),
m AS (
  SELECT d.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost_words, 0) AS lost_words
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN marked USING (r) LEFT JOIN lost USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT lost_words > 0.5 * n_words AS kept, CAST(lost_words AS BIGINT) AS lost_words
FROM f""",
}
