"""Whole queries without SQL against brute force over every row of their tables."""

import hashlib
import zlib

import numpy as np
import pandas as pd
import pytest
from test_methods import filled, greedy, slow_align, slow_fingerprint, union
from test_near_copies import groups

import corpus_pipeline
from wakeline.llm import decontaminate, language_id, quality_classifier, queries, token_counts
from wakeline.llm.common import in_remainder

SMALL, D = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def crc(key, modulus):
    return zlib.crc32(str(key).encode()) % modulus


def read(d, name):
    return pd.read_parquet(f"{d}/{name}.parquet")


def copied(src, into, **changed):
    """The folder ``into`` with some tables of ``src`` put in another way."""
    for name in ("documents", "labels"):
        table = read(src, name)
        changed.get(name, lambda t: t)(table).to_parquet(into / f"{name}.parquet")
    return str(into)


def votes(model, texts):
    """For each text the smallest and the largest score that its nearest neighbours allow, equal similarities taken in any order."""
    memo = quality_classifier.Features()
    out = []
    for t in texts:
        counts = quality_classifier.counts_of(memo, (t or "").encode())
        x = np.log1p(counts.astype(np.float64)) * model.idf
        words, shapes = np.split(x, [quality_classifier.WORDS])
        x = np.concatenate([words / max(np.linalg.norm(words), 1e-9), quality_classifier.SHAPE_WEIGHT * shapes / max(np.linalg.norm(shapes), 1e-9)])
        v = x @ model.axes
        cosine = v / max(np.linalg.norm(v), 1e-9) @ model.vectors
        k = min(quality_classifier.NEIGHBOURS, len(cosine))
        edge = np.sort(cosine)[-k]
        sure, open_ = np.flatnonzero(cosine > edge + 4e-6), np.flatnonzero(np.abs(cosine - edge) <= 4e-6)
        ends = []
        for sign in (1, -1):
            at = np.concatenate([sure, open_[np.argsort(sign * model.labels[open_], kind="stable")][: k - len(sure)]])
            w = np.maximum(cosine[at], 1e-6)
            ends.append(float((w * model.labels[at]).sum() / w.sum()))
        out.append(tuple(ends))
    return np.array(out)


@pytest.fixture(scope="module")
def quality(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    return quality_classifier.fitted(docs, spark.read.parquet(f"{D}/labels.parquet"), in_remainder("doc_id", 4, 2))


def test_quality_query(spark, quality):
    docs = read(D, "documents")
    got = queries.QUERIES["op4_quality_classifier"](spark, D).toPandas().set_index("doc_id").loc[docs.doc_id]
    low, high = votes(quality, docs.text).T
    assert len(got) == len(docs) and ((got.score >= low - 1e-4) & (got.score <= high + 1e-4)).all() and (high - low < 1e-3).mean() > 0.8
    assert (got.predicted == (got.score >= 0.7)).all() and got.held_out.tolist() == [crc(i, 4) == 2 for i in docs.doc_id]


def test_quality_learns_nothing_from_held_out_rows(spark, tmp_path):
    flip = lambda t: t.assign(quality=[1 - q if crc(i, 4) == 2 else q for i, q in zip(t.doc_id, t.quality, strict=True)])
    blank = lambda t: t.assign(lang="xx", source="elsewhere")
    other = copied(SMALL, tmp_path, labels=flip, documents=blank)
    a, b = (queries.QUERIES["op4_quality_classifier"](spark, d).toPandas().sort_values("doc_id") for d in (SMALL, other))
    assert not read(SMALL, "labels").quality.equals(read(other, "labels").quality) and a.score.tolist() == b.score.tolist()


def labelled(model, text):
    """Language, score and number of spans by a table of all words and languages."""
    cells, first, script, _ = language_id.parse([text], model.kinds)
    if not len(first):
        return "und", 0.0, 0
    s = model.scored(cells, first, script).astype(np.float64)
    sizes = np.diff(np.append(first, len(cells)))
    value, came = s[0], []
    for row in s[1:]:
        top = int(value.argmax())
        stay = value >= value[top] - language_id.PENALTY
        came.append(np.where(stay, np.arange(len(row)), top))
        value = np.where(stay, value, value[top] - language_id.PENALTY) + row
    path = [int(value.argmax())]
    for back in came[::-1]:
        path.append(int(back[path[-1]]))
    path = np.array(path[::-1])
    held = np.bincount(path, sizes, len(model.langs))
    top = int(held.argmax())
    sums = s[path == top].sum(axis=0)
    sure = 1 / np.exp(np.minimum(sums - sums[top], 0)).sum()
    return model.langs[top], float(held[top] / held.sum() * sure), 1 + int((path[1:] != path[:-1]).sum())


def test_language_query(spark):
    docs = read(D, "documents")
    table = spark.read.parquet(f"{D}/documents.parquet")
    model = language_id.fitted(table, ~in_remainder("doc_id", 3, 1))
    got = queries.QUERIES["op7_language_id"](spark, D).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for d in docs.itertuples():
        lang, score, spans = labelled(model, d.text)
        r = got.loc[d.doc_id]
        assert (r.lang_pred, r.n_spans, bool(r.held_out)) == (lang, spans, crc(d.doc_id, 3) == 1) and r.score == pytest.approx(score, abs=1e-6)


def test_language_learns_nothing_from_held_out_rows(spark, tmp_path):
    swap = lambda t: t.assign(source="elsewhere", lang=["zz" if crc(i, 3) == 1 else x for i, x in zip(t.doc_id, t.lang, strict=True)])
    a, b = (queries.QUERIES["op7_language_id"](spark, d).toPandas().sort_values("doc_id") for d in (SMALL, copied(SMALL, tmp_path, documents=swap)))
    assert a.lang_pred.tolist() == b.lang_pred.tolist() and a.score.tolist() == b.score.tolist()


def test_near_duplicate_query(spark):
    docs = read(D, "documents")
    got = queries.QUERIES["op10_near_dedup"](spark, D).toPandas().set_index("doc_id").loc[docs.doc_id]
    fps = [slow_fingerprint(t) for t in docs.text]
    assert got.fingerprint.tolist() == [f"{x:016x}" for x in fps]
    bits = np.array(fps, np.uint64)
    near = [(i, int(j)) for i in range(len(bits)) for j in np.flatnonzero(np.bitwise_count(bits[i] ^ bits[:i]) <= 2)]
    label = union(len(docs), near)
    least = {}
    for k, i in zip(label, docs.doc_id, strict=True):
        least[k] = min(i, least.get(k, i))
    assert got.component_id.tolist() == [least[k] for k in label] and len(least) < len(docs)


def test_token_query(spark):
    docs = read(SMALL, "documents")
    got = queries.QUERIES["op3_token_counts"](spark, SMALL).toPandas().set_index("doc_id")
    mark, listed = token_counts.read_vocabulary("/opt/tokenizers/byte_bpe_50k.json")
    pieces, memo = set(listed), {}
    assert len(got) == len(docs)
    for d in docs.itertuples():
        words = d.text.encode().split()
        for w in words:
            if w not in memo:
                memo[w] = greedy(w, mark, pieces) or 1
        assert (got.loc[d.doc_id].n_words, got.loc[d.doc_id].n_tokens) == (len(words), sum(memo[w] for w in words))


def test_mix_query(spark):
    """Each document takes its share of the target rounded down or up, and each source what is left over by one document at most."""
    docs = read(D, "documents")
    got = queries.QUERIES["op6_mixing"](spark, D).toPandas().set_index("doc_id").loc[docs.doc_id]
    size = np.array([len(t.encode().split()) for t in docs.text])
    assert got["size"].tolist() == size.tolist()
    sources = docs.source.tolist()
    total = {s: int(size[[x == s for x in sources]].sum()) for s in set(sources)}
    target = filled(total)
    for s, mine in got.assign(source=sources).groupby("source"):
        share = target[s] / total[s]
        copies = (mine.taken / mine["size"].clip(lower=1))[mine["size"] > 0]
        assert (mine.target - target[s]).abs().max() < 1e-6 * target[s] and copies.isin([np.floor(share), np.ceil(share)]).all()
        assert abs(mine.taken.sum() - target[s]) <= mine["size"].max()


def holds(words, items):
    """Whether a whole text aligns with an item of three or more words; no alignment is worth more than the item's words that it holds."""
    held = set(words)
    for item in items:
        least = max(0.5 * len(item), min(8, len(item)))
        if len(item) >= 3 and sum(w in held for w in item) >= least and slow_align(item, words) >= 2 * least:
            return True
    return False


def test_pipeline_query(spark):
    """Stage by stage by brute force; the mix draws at random, so its rounding is held to the shares."""
    docs = read(SMALL, "documents")
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality_classifier.fitted(table, spark.read.parquet(f"{SMALL}/labels.parquet"), in_remainder("doc_id", 4, 2))
    low, high = votes(model, docs.text).T
    assert not ((low < 0.7) & (high >= 0.7)).any()
    one = docs[low >= 0.7]
    one = one[one.doc_id.isin(set(groups(dict(zip(one.doc_id, one.text, strict=True))).values()))]
    bench = [decontaminate.words_of(t) for t in read(SMALL, "benchmark").text]
    mine = {w for item in bench for w in item}
    clean = one[[not holds([w if w in mine else b"" for w in decontaminate.words_of(t)], bench) for t in one.text]]
    size = clean.text.map(lambda t: len(t.encode().split()))
    total = size.groupby(clean.source).sum().to_dict()
    target = filled(total)

    out = corpus_pipeline.run(spark, SMALL).toPandas()
    times = out.doc_id.value_counts()
    assert len(clean) < len(one) < len(docs) and set(out.doc_id) <= set(clean.doc_id)
    for d, n in zip(clean.itertuples(), size, strict=True):
        share = target[d.source] / total[d.source]
        assert times.get(d.doc_id, 0) in (np.floor(share), np.ceil(share)) or not n
    taken = out.text.map(lambda t: len(t.encode().split())).groupby(out.source).sum()
    assert all(abs(taken.get(s, 0) - t) <= size[clean.source == s].max() for s, t in target.items())
    bid = lambda key, j: -np.log((int(hashlib.md5(f"{key}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)
    assert all((r.shard, r.grown_shard) == tuple(min(range(n), key=lambda j: bid(r.doc_id, j)) for n in (8, 9)) for r in out.itertuples())
    assert out.merge(docs, on="doc_id").eval("text_x == text_y").all() and {"shard", "grown_shard"} | set(docs.columns) == set(out.columns)
