"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Every text becomes a bag of hashed features in two groups, words and word
shapes with a few text measures; each group is weighted by inverse document
frequency and has unit length. A truncated singular value decomposition of a
labelled sample gives the latent space. The sample's vectors are broadcast and
every document votes over its ``NEIGHBOURS`` nearest ones, by exact cosine
products computed block by block, compared to six decimals; a vote weighs as
much as its similarity, or next to nothing where that is not positive.

The sample is bounded: the ``SAMPLE`` labelled rows with the smallest hash of
their id. So what is collected and broadcast is at most ``SAMPLE`` vectors.

Defined results: a null text is an empty one; an empty text has its measures
for features and is voted on like any other; a document with several labels
has their mean; labels without quality or without a document are left out; with
no label at all every score is 0.5; ties among neighbours go to the first in
the sample's order, by doc_id; repeated rows are answered row by row.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sent, by_text, in_remainder, raws, table

SAMPLE, RANK, NEIGHBOURS, ACCEPT, SEED = 4096, 48, 15, 0.7, 7
WORDS, SHAPES = 3072, 1024
SHAPE_WEIGHT, MEMO, BLOCK, STEPS = 1.5, 150_000, 256, 1_000_000
_KINDS = bytes(
    ord("a") if x >= 128 or 97 <= x <= 122 else ord("A") if 65 <= x <= 90 else ord("0") if 48 <= x <= 57 else ord(".") if chr(x) in ".,;:?'\"()-" else x for x in range(256)
)
_RUNS = re.compile(rb"(.)\1+", re.S)


class Features(dict):
    """Word -> (word feature, shape feature); a bounded memo."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= MEMO:
            self.clear()
        shape = _RUNS.sub(rb"\1", word.translate(_KINDS).rstrip(b"."))
        self[word] = out = zlib.crc32(word.lower()) % WORDS, WORDS + zlib.crc32(shape) % (SHAPES - 128)
        return out


def counts_of(memo: Features, raw: bytes | None) -> np.ndarray:
    """Feature counts of one text. The last 128 shape features are text measures in steps."""
    raw = raw or b""
    words = raw.split()
    out = np.zeros(WORDS + SHAPES, np.float32)
    base = WORDS + SHAPES - 128
    n = len(words)
    out[base + min(15, n.bit_length())] = 1 + n / 8
    if n:
        ids = np.array([memo[w] for w in words], np.int64)
        out += np.bincount(ids.ravel(), minlength=len(out))
        step = lambda share: min(15, int(16 * share))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        measures = (
            float(np.mean(ids[1:, 0] == ids[:-1, 0])) if n > 1 else 0.0,
            len(set(words)) / n,
            sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))) / max(1, len(raw)) * 4,
            len(set(lines)) / max(1, len(lines)),
            min(1.0, len(raw) / n / 32),
        )
        for k, share in enumerate(measures, 1):
            out[base + 16 * k + step(share)] += 1 + n / 8
    return out


class Model:
    """What every document is scored with; ``fit`` runs on the driver over the bounded sample."""

    def __init__(self, idf, axes, vectors, labels):
        self.idf, self.axes, self.vectors, self.labels = idf, axes, vectors, labels

    @staticmethod
    def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """Counts made weights, in place."""
        np.log1p(x, out=x)
        x *= idf
        for part, weight in ((x[:, :WORDS], 1.0), (x[:, WORDS:], SHAPE_WEIGHT)):
            part *= weight / np.maximum(np.sqrt(np.einsum("ij,ij->i", part, part)), 1e-9)[:, None]
        return x

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Model:
        n = len(counts)
        idf = np.log((1 + n) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 0.1
        x = cls.weighted(counts, idf)
        rng = np.random.default_rng(SEED)
        rank = max(1, min(rank, n, x.shape[1]))
        y = x @ rng.standard_normal((x.shape[1], min(n, rank + 16)), np.float32)
        for _ in range(3):
            y = x @ (x.T @ np.linalg.qr(y)[0])
        q = np.linalg.qr(y)[0]
        axes = np.ascontiguousarray(np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32))
        return cls(idf, axes, np.ascontiguousarray(cls.unit(x @ axes).T), labels.astype(np.float32))

    @staticmethod
    def unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Scores of texts by their counts, which are used up."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        cosine = self.unit(self.weighted(counts, self.idf) @ self.axes) @ self.vectors
        return self.voted(np.rint(cosine * STEPS).astype(np.int32), k)

    def voted(self, steps: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Scores from similarities in steps, documents x sample: of equals at the k-th place the first ones vote."""
        k = min(k, len(self.labels))
        last = np.partition(steps, steps.shape[1] - k, axis=1)[:, steps.shape[1] - k, None]
        votes = steps >= last
        for r in np.flatnonzero(votes.sum(axis=1) > k):
            equal = np.flatnonzero(steps[r] == last[r])
            votes[r, equal[k - int((steps[r] > last[r]).sum()) :]] = False
        at = np.nonzero(votes)[1].reshape(len(steps), k)
        weight = np.maximum(np.take_along_axis(steps, at, axis=1), 1).astype(np.float64)
        return np.clip((weight * self.labels[at]).sum(axis=1) / weight.sum(axis=1), 0.0, 1.0)


def _sparse(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.float32()))])
    memo = Features()
    for b in batches:
        rows = [counts_of(memo, raw) for raw in raws(b.column(1))]
        at = [np.flatnonzero(r).astype(np.int32) for r in rows]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, schema.field(1).type), pa.array([r[k] for r, k in zip(rows, at, strict=True)], schema.field(2).type)], schema=schema)


def fitted(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from labels (doc_id, label) whose row is not ``held_out``."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg(F.col(label).cast("double")).alias("label"))
    known = known.join(docs.select(F.col("doc_id").cast("bigint")).distinct(), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    value = {r.doc_id: r.label for r in chosen}
    if not value:
        return Model(None, None, None, np.zeros(0, np.float32))
    ids = F.broadcast(spark.createDataFrame([(i,) for i in value], "doc_id bigint"))
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(ids, "doc_id")
    made = by_text(texts, _sparse, "doc_id bigint, at array<int>, n array<float>")
    rows = made.groupBy("doc_id").agg(F.min(F.struct("at", "n")).alias("f")).select("doc_id", "f.at", "f.n").toArrow().sort_by("doc_id")
    sizes = pc.list_value_length(rows["at"]).to_numpy()
    counts = np.zeros((len(rows), WORDS + SHAPES), np.float32)
    counts[np.repeat(np.arange(len(rows)), sizes), pc.list_flatten(rows["at"]).to_numpy()] = pc.list_flatten(rows["n"]).to_numpy()
    return Model.fit(counts, np.array([value[i] for i in rows["doc_id"].to_pylist()]))


def scored_batches(sent, text: str = "text", least: float | None = None):
    """Appends a score to each row; with ``least`` passes on the rows that reach it instead, unchanged."""

    def run(batches):
        memo, model = Features(), sent.value
        for b in batches:
            texts = raws(b.column(text))
            scores = [model.score(np.stack([counts_of(memo, x) for x in texts[k : k + BLOCK]])) for k in range(0, len(texts), BLOCK)]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            if least is not None:
                yield b.filter(pa.array(scores >= least))
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    given = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return by_text(given, scored_batches(Sent(docs.sparkSession, model)), "doc_id bigint, score double")


def accepted(docs: DataFrame, model: Model, least: float = ACCEPT) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``least`` or more."""
    return by_text(docs, scored_batches(Sent(docs.sparkSession, model), least=least), docs.schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), in_remainder("doc_id", 4, 2)
    model = fitted(docs, table(spark, sf_dir, "labels"), held_out)
    return scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
SQL: dict[str, str] = {}
