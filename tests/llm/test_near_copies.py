"""Near copies against brute-force similarity."""

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from wakeline.llm import near_copies

DOCS = "doc_id bigint, text string, source string"


def shingled(text):
    words = text.lower().encode().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def groups(texts, least=0.8):
    """doc_id -> smallest doc_id of its group."""
    sets = {i: shingled(t or "") for i, t in texts.items()}
    label, holders = {i: i for i in sets}, {}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in sorted(sets):
        shared = {}
        for s in sets[i] or [None]:
            for j in holders.get(s, []):
                shared[j] = shared.get(j, 0) + 1
            holders.setdefault(s, []).append(i)
        for j, n in shared.items():
            if n >= least * (len(sets[i] | sets[j]) or 1):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: find(i) for i in sets}


def varied(rng):
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    texts = {}
    for base in range(12):
        text = [word() for _ in range(120)]
        for _ in range(10):
            texts[len(texts)] = " ".join(text)
            text = list(text)
            for p in rng.choice(120, rng.integers(1, 4), replace=False):
                text[p] = word()
    return texts | {1000: "one two", 1001: "One  TWO", 1002: "one three", 1003: "", 1004: None}


@pytest.mark.parametrize(("stars", "hot"), [(0, 32), (2, 2), (3, 5)])
def test_groups_equal_brute_force(spark, monkeypatch, stars, hot):
    monkeypatch.setattr(near_copies.labelled, "__defaults__", (5, 0.8, stars))
    monkeypatch.setattr(near_copies.prefixed, "__defaults__", (5, 0.8, hot))
    monkeypatch.setattr(near_copies.grouped, "__defaults__", (5, 0.8, hot))
    texts = varied(np.random.default_rng(11))
    want = groups(texts)
    docs = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], DOCS)
    out = near_copies.grouped(docs).collect()
    first = {}
    for r in out:
        first[r.label] = min(r.doc_id, first.get(r.label, r.doc_id))
    assert {r.doc_id: first[r.label] for r in out} == want and 12 < len(set(want.values())) < len(texts)


def test_stage_leaves_no_near_copies(spark):
    d = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{d}/documents.parquet")
    want = groups(dict(zip(docs.doc_id, docs.text, strict=True)))
    got = corpus_pipeline.dedup(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(set(want.values()))


def test_each_group_keeps_one_row_whatever_its_ids(spark):
    a, b, c, d = ("one two three four five six seven " + x for x in ("a", "b " * 30, "c " * 60, "d " * 90))
    rows = [(1, a), (1, b), (1, b), (2, b), (3, c), (None, c), (None, d), (None, d), (1, a.upper())]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], DOCS)
    out = near_copies.keep_one(docs)
    kept = sorted((r.doc_id or -1, r.text.lower()) for r in out.collect())
    assert kept == sorted([(1, a), (1, b), (3, c), (-1, d)]) and out.columns == docs.columns


def test_parity_bits_never_differ_more_than_sets():
    rng = np.random.default_rng(12)
    for _ in range(200):
        a, b = (np.unique(rng.integers(-(2**40), 2**40, rng.integers(0, 4000))) for _ in "ab")
        b = np.union1d(b[: len(b) // 8], a[: len(a) // 2])
        if (len(a) > near_copies.LONG) != (len(b) > near_copies.LONG):
            continue
        differ = sum(bin(x & (1 << 64) - 1).count("1") for x in (near_copies.parity(a) ^ near_copies.parity(b)).tolist())
        assert differ <= len(np.setxor1d(a, b))


def test_fingerprints_that_differ_in_few_bits_share_a_place():
    rng = np.random.default_rng(13)
    masks = near_copies.masks()
    assert len(masks) == 10 and {bin(m & (1 << 64) - 1).count("1") for m in masks} <= {24, 25, 26}
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, near_copies.BLOCKS - near_copies.SAME, replace=False))
        assert any(flips & m == 0 for m in masks)


def test_simhash_is_the_majority_of_codes(monkeypatch):
    rng = np.random.default_rng(14)
    for n in (0, 1, 2, 7, 300):
        codes = rng.integers(-(2**63), 2**63 - 1, n)
        bits = [sum(int(c) >> k & 1 for c in codes) for k in range(64)]
        want = sum(1 << k for k, x in enumerate(bits) if 2 * x > n)
        assert near_copies.simhash(codes) & (1 << 64) - 1 == want
        monkeypatch.setattr(near_copies, "CHUNK", 3)


@pytest.mark.parametrize("full", [0, 64])
def test_nearest_fingerprint_by_brute_force(spark, full):
    rng = np.random.default_rng(15)
    fps = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 20)]
    fps += [x ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 4), replace=False)) for x in fps for _ in range(5)]
    texts = spark.createDataFrame(list(enumerate(fps)), "t bigint, fp bigint")
    got = {r.b: r.a for r in near_copies.nearest(texts, full=full).collect()}
    apart = lambda a, b: bin((fps[a] ^ fps[b]) & (1 << 64) - 1).count("1")
    assert all(a < b and apart(a, b) <= near_copies.NEAR for b, a in got.items())
    close = [b for b in range(20, len(fps)) if any(apart(a, b) <= 3 for a in range(b))]
    assert len(close) == 100 and set(close) <= set(got)
    if full:
        assert all(apart(got[b], b) == min(apart(a, b) for a in range(b)) for b in close)


def test_stage_links_by_fingerprints(spark, monkeypatch):
    """Texts whose fingerprints are near are joined by the pairs of the fingerprints; nothing is left to compare after them."""
    base = [f"word{k}" for k in range(400)]
    texts = {k: " ".join(base[:200] + [f"other{k}"] * (k > 0) + base[200:]) for k in range(6)} | {9: "a text of its own that nothing else is like at all"}
    compared, plain = [], near_copies.similar
    monkeypatch.setattr(near_copies, "similar", lambda pairs, *more: compared.append(pairs.count()) or plain(pairs, *more))
    docs = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.dedup(spark, docs, "").collect()) == [0, 9]
    assert compared == [5]
