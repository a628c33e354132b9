"""Methods against brute force, round trips and held-out accuracy."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from wakeline.llm import chat_format, decontaminate, language_id, license_rules, license_scan, line_rules, mixing, near_dedup, quality_classifier, queries, shards, token_counts

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{D}/documents.parquet")


@pytest.fixture(scope="module")
def result(spark):
    made = {}

    def get(name, d="/root/testdata/sf0.01"):
        if (name, d) not in made:
            made[name, d] = queries.QUERIES[name](spark, d).toPandas()
        return made[name, d]

    return get


# Decontamination.
def slow_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_equals_the_plain_recursion():
    rng = np.random.default_rng(0)
    pairs = [(rng.integers(1, 6, rng.integers(1, 30)).astype(np.int32), rng.integers(0, 6, rng.integers(1, 60)).astype(np.int32)) for _ in range(120)]
    for (a, b), (value, end) in zip(pairs, decontaminate.align(pairs), strict=True):
        assert value == slow_align(a, b) and (not value or slow_align(a, b[:end]) == value)


def test_edited_copies_are_found_and_clean_text_is_left(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    items = [[word() for _ in range(40)] for _ in range(20)]
    rows = []
    for k in range(60):
        body, item = [word() for _ in range(300)], list(items[k % 20])
        if k < 40:
            for p in rng.choice(40, 6, replace=False):
                item[p] = word()
            if k % 2:
                del item[10:13]
            body[100:100] = item
        rows.append((k, " ".join(body).title() + ".", "s"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string")
    for size in (decontaminate.BLOCK_BYTES, 1500):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, size).collect()}
        assert got == {(k, k % 20) for k in range(40)}
        assert {r.doc_id for r in decontaminate.decontaminated(docs, bench, size).collect()} == set(range(40, 60))


def test_an_item_in_every_document_keeps_seeds(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(k, f"w{k} {text} v{k}") for k in range(200)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, text)], "item_id bigint, text string")
    assert decontaminate.contaminated(docs, bench).count() == 200


def test_hits_equal_brute_force_on_documents(spark, documents):
    """Every item that a full alignment of whole texts finds is found, and no other."""
    bench = pd.read_parquet(f"{D}/benchmark.parquet")
    items = decontaminate.Items(list(zip(bench.item_id.tolist(), bench.text.tolist(), strict=True)))
    some = documents[documents.text.str.len() < 1500].head(60)
    want = set()
    for d in some.itertuples():
        ids = items.number(d.text)
        for k, i in enumerate(items.ids):
            item = items.words(k)
            (value, _), = decontaminate.align([(item, ids)]) if len(ids) else [(0, 0)]
            if value >= 2 * max(0.5 * len(item), min(8, len(item))):
                want.add((d.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op1_decontaminate"](spark, D).collect()}
    assert {x for x in got if x[0] in set(some.doc_id)} == want and want and len(got) >= 3


def test_equal_places_give_the_first(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, f"x y {item} z {item} w")], "doc_id bigint, text string")
    (r,) = decontaminate.contaminated(docs, spark.createDataFrame([(5, item)], "item_id bigint, text string")).collect()
    assert (r.start_word, r.end_word, r.score) == (2, 12, 1.0)


def test_long_texts_are_read_whole(spark, monkeypatch):
    items = decontaminate.Items([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")])
    text = "Lorem ipsum, alpha BETA gamma-delta epsilon zeta eta theta iota kappa! dolor " * 9
    whole = decontaminate.hits_of(items, [text])
    monkeypatch.setattr(decontaminate, "PIECE", 7)
    assert decontaminate.hits_of(items, [text]) == whole and whole[0]


# Line rules.
def test_repeated_words_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        words = [bytes([97 + x]) for x in rng.integers(0, 3, rng.integers(0, 40))]
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        n = Counter(grams)
        assert line_rules.repeated_words(words) == len({k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)})


def test_frequent_lines_go_by_host(spark):
    shared = "this boiler plate line stands in very many documents of one host only"
    rows = [(k, f"{shared.upper()}!\nown words {chr(97 + k) * 3} make up the rest of this little text", "a") for k in range(26)]
    rows += [(100 + k, f"{shared}\n{shared} {k}\nother text {chr(97 + k) * 3} is here too with words", "b") for k in range(5)]
    out = {r.doc_id: r for r in line_rules.judged(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert all(out[k].lost_words == 13 and out[k].depleted == (13 > 0.5 * out[k].n_words) for k in range(26))
    assert all(out[100 + k].lost_words == 0 and not out[100 + k].depleted for k in range(5))


# Token counts.
def greedy(word, mark, pieces):
    rest, n, first = mark + word, 0, True
    while rest:
        size = next((k for k in range(len(rest), 0, -1) if rest[:k] in pieces and rest[:k].startswith(mark) == first), 0)
        if not size:
            return 0
        rest, n, first = rest[size:], n + 1, False
    return n


def test_automaton_equals_greedy_matching():
    rng = np.random.default_rng(3)
    for mark in (b" ", b"_"):
        pieces = {mark} | {mark + bytes((97 + rng.integers(0, 3, rng.integers(1, 5))).tolist()) for _ in range(8)}
        pieces |= {bytes((97 + rng.integers(0, 3, rng.integers(1, 6))).tolist()) for _ in range(12)}
        a = token_counts.Automaton(mark, sorted(pieces))
        for _ in range(500):
            word = bytes((97 + rng.integers(0, 3, rng.integers(1, 12))).tolist())
            assert a.count(mark + word) == greedy(word, mark, pieces)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"])
def test_counts_on_documents(spark, documents, name):
    mark, listed = token_counts.read_vocabulary(f"/opt/tokenizers/{name}")
    pieces, some = set(listed), documents.head(12)
    got = {r.doc_id: r for r in token_counts.token_counts(spark.createDataFrame(some[["doc_id", "text"]]), f"/opt/tokenizers/{name}").collect()}
    for r in some.itertuples():
        words = r.text.encode().split()
        assert (got[r.doc_id].n_words, got[r.doc_id].n_tokens) == (len(words), sum(greedy(w, mark, pieces) or 1 for w in words))


# Classifier and language: held-out accuracy.
def test_quality_on_held_out_rows(result):
    labels = pd.read_parquet("/root/testdata/sf0.1/labels.parquet")
    r = result("op4_quality_classifier", "/root/testdata/sf0.1").merge(labels, on="doc_id")
    assert (r.held_out == r.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all() and r.score.between(0, 1).all()
    h = r[r.held_out]
    assert (h.predicted == h.quality).mean() > 0.97 and h[h.quality == 1].predicted.mean() > 0.99 and ((r.score >= 0.7) == r.predicted).all()


def test_votes_are_exact_neighbours():
    rng = np.random.default_rng(4)
    counts = rng.poisson(0.02, (300, quality_classifier.WORDS + quality_classifier.SHAPES)).astype(np.float32)
    m = quality_classifier.Model.fit(counts[:200].copy(), rng.integers(0, 2, 200))
    got = m.score(counts[200:].copy())
    v = m.unit(m.weighted(counts[200:].copy(), m.idf) @ m.axes)
    for k in range(100):
        c = np.rint(v[k] @ m.vectors * quality_classifier.STEPS)
        near = np.argsort(-c, kind="stable")[: quality_classifier.NEIGHBOURS]
        w = np.maximum(c[near], 1)
        assert got[k] == pytest.approx((w * m.labels[near]).sum() / w.sum(), rel=1e-4)


def test_first_of_equal_neighbours_vote():
    rng = np.random.default_rng(14)
    m = quality_classifier.Model(None, None, None, rng.integers(0, 2, 60).astype(np.float32))
    steps = rng.integers(-3, 4, (400, 60)).astype(np.int32)
    for row, got in zip(steps, m.voted(steps), strict=True):
        near = sorted(range(60), key=lambda i: (-row[i], i))[: quality_classifier.NEIGHBOURS]
        w = np.maximum(row[near], 1)
        assert got == pytest.approx((w * m.labels[near]).sum() / w.sum())


def test_language_on_held_out_rows(result):
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    r = result("op7_language_id").merge(docs, on="doc_id")
    assert (r.held_out == r.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert (r[r.held_out].lang_pred == r[r.held_out].lang).mean() > 0.97


def test_viterbi_against_all_labellings_and_short_cut():
    from itertools import product

    rng = np.random.default_rng(5)
    for _ in range(150):
        s = rng.normal(0, 12, (int(rng.integers(1, 7)), 3)).astype(np.float32)
        cost = lambda p: sum(s[i, k] for i, k in enumerate(p)) - language_id.PENALTY * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max(cost(p) for p in product(range(3), repeat=len(s)))
        cut = int(rng.integers(0, len(s) + 1))
        halves = [x for x in (s[:cut], s[cut:]) if len(x)]
        path = [k for k, lo, hi in language_id.viterbi(halves) for _ in range(lo, hi)]
        assert len(path) == len(s) and cost(path) == pytest.approx(best, abs=1e-3)
        g = int(s.sum(0).argmax())
        if language_id.one_span(halves, g):
            assert cost([g] * len(s)) == pytest.approx(best, abs=1e-3)


def test_spans_of_a_mixed_text(spark, documents):
    clean = documents[documents.text.str.len() > 600].groupby("lang").text.apply(list)
    model = language_id.fitted(spark.createDataFrame(documents[["doc_id", "text", "lang"]]), F.lit(True))
    (lang, _, spans), = model.label([clean["en"][0][:500] + " " + clean["de"][0][:300]])
    assert lang == "en" and [s["lang"] for s in spans][0] == "en" and [s["lang"] for s in spans][-1] == "de" and len(spans) <= 4


def test_scripts_close_words_to_other_languages(spark):
    rows = [(k, "the house on the hill and the river", "en") for k in range(5)] + [(10 + k, "дом на холме и река у моста", "ru") for k in range(5)] + [(20 + k, "das haus auf dem berg und der fluss", "de") for k in range(5)]
    model = language_id.fitted(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    scores = model.scored(*language_id.parse(["the дом אבג"], model.kinds)[:3])
    assert model.langs == ["de", "en", "ru"] and np.isfinite(scores).tolist() == [[True, True, False], [False, False, True], [True, True, True]]
    (lang, _, spans), = model.label(["the house on the hill дом на холме и река у моста the river"])
    assert [s["lang"] for s in spans] == ["en", "ru", "en"] and lang == "en"


def test_every_language_is_learned_whatever_repeats(spark):
    letters = "abcdefghijklmnopqrst"
    rows = [(k, f"{c * 3}x {c * 4}y {c}z{c}", f"l{k:02}") for k, c in enumerate(letters)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    often = docs.crossJoin(spark.range(5000)).drop("id")
    one, many = language_id.fitted(docs, F.lit(True)), language_id.fitted(often, F.lit(True))
    assert one.langs == many.langs == [f"l{k:02}" for k in range(20)]
    assert all(np.array_equal(one.logs[k], many.logs[k]) for k in one.logs)


def test_long_texts_are_labelled_as_in_one_piece(spark, documents, monkeypatch):
    monkeypatch.setattr(language_id, "TRAIN", 50)
    model = language_id.fitted(spark.createDataFrame(documents[["doc_id", "text", "lang"]]), F.lit(True), 50)
    texts = [t for t in documents.text if len(t) > 400][:30]
    texts += [a[:300] + " " + b[-300:] for a, b in zip(texts, texts[7:], strict=False)]
    whole = model.label(texts)
    for size in (40, 333):
        model.slice = size
        for t, (lang, score, spans) in zip(texts, whole, strict=True):
            got = model.label_long(t)
            assert (got[0], got[2]) == (lang, spans) and got[1] == pytest.approx(score, abs=1e-4)


# Shards.
def test_rendezvous_moves_only_into_the_new_shard(spark):
    weights = [1.0, 2.0, 1.0, 4.0]
    n = 20_000
    r = shards.assigned(spark.range(n).withColumnRenamed("id", "doc_id"), weights=weights, grown=2.0).toPandas()
    moved = r[r.shard != r.grown_shard]
    assert (moved.grown_shard == 4).all() and len(moved) / n == pytest.approx(0.2, abs=0.015)
    assert np.allclose(r.shard.value_counts(normalize=True).sort_index(), np.array(weights) / 8, atol=0.015)


def test_shard_query(result):
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    r = result("op5_shards").merge(docs, on="doc_id")
    assert len(r) == len(docs) and (r["size"] == r.text.map(lambda t: len(t.encode()) + 1)).all() and (r.text_crc32 == r.text.map(lambda t: zlib.crc32(t.encode()))).all()
    for _, g in r.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    head = lambda key, j: (int(hashlib.md5(f"{key}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    assert all(row.shard == min(range(8), key=lambda j: -np.log(head(row.doc_id, j))) for row in r.head(100).itertuples())


# Mixing.
def filled(sizes, most=3):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        target = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target | {s: most * sizes[s] for s in capped}
        capped |= over


def test_targets_equal_the_iteration(spark):
    rng = np.random.default_rng(6)
    for _ in range(6):
        sizes = {(f"s{k}" if k else None): int(rng.choice([0, 5, 50, 5000])) for k in range(9)}
        sizes["s1"] += 7
        t = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r.source: r.target for r in mixing.water_filled(t).collect()}
        assert got == pytest.approx(filled(sizes), rel=1e-9, abs=1e-6)


def test_mix_meets_targets_and_repeats(spark, result):
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    r = result("op6_mixing").merge(docs[["doc_id", "source"]], on="doc_id")
    assert len(r) == len(docs) and (r.taken <= 3 * r["size"]).all() and (r.taken % r["size"].clip(lower=1) == 0).all()
    by = r.groupby("source").agg(n=("size", "sum"), s=("source_size", "first"), t=("target", "first"), k=("taken", "sum"))
    assert (by.n == by.s).all() and ((by.k - by.t).abs() < 0.02 * by.t).all() and by.t.sum() == pytest.approx(by.s.sum())
    again = queries.QUERIES["op6_mixing"](spark, "/root/testdata/sf0.01").toPandas()
    key = lambda x: sorted(map(tuple, x[["doc_id", "taken"]].to_numpy().tolist()))
    assert key(again) == key(r)


def test_pivot_keeps_sums_and_expectations():
    rng = np.random.default_rng(7)
    sizes = sorted(rng.integers(1, 60, 40).tolist() + [900], reverse=True)
    p, total = rng.uniform(0.1, 0.9, 41), np.zeros(41)
    for _ in range(1500):
        f, u = p.tolist(), rng.uniform(size=41).tolist()
        mixing.settle_heavy(sizes, f, u)
        mixing.pivot(sizes, f, u)
        assert sum(0 < x < 1 for x in f) <= 1 and np.dot(sizes, f) == pytest.approx(np.dot(sizes, p))
        total += f
    assert np.abs(total / 1500 - p).max() < 0.06


def test_reduction_tree(spark):
    docs = spark.createDataFrame([(k, "a " * (1 + k % 7), "x" if k % 3 else "y") for k in range(900)], "doc_id bigint, text string, source string")
    flat = mixing.taken(docs).groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t")).collect()
    deep = mixing.taken(docs, group=20, fan=3).groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t")).collect()
    for r in flat + deep:
        assert abs(r.k - r.t) <= 7


# Licenses.
def test_rules_are_hundreds_and_compile():
    import re

    listed = license_rules.rules()
    assert len(listed) >= 300 and all(re.compile(license_rules.regex(r)) for *_, r in listed)
    for *_, key, rule in listed:
        needed = [x.split("/") for x in rule.split() if x[0] != "["]
        assert any(all(key in choice for choice in choices) for choices in needed), (key, rule)


def test_two_hundred_rules_are_written_by_hand():
    assert len(set(license_rules.SIGNATURES)) >= 200


def test_prefilter_changes_nothing(documents):
    """Every regex over every text finds what the rules whose keyword occurs find."""
    listed = license_rules.rules()
    s = license_scan.Scanner(listed)
    more = [f"{r.replace('[', '').replace(']', '').replace('*', 'x').split('/')[0]} and so on" for *_, r in listed[::3]]
    slow = [__import__("re").compile(license_rules.regex(r)) for *_, r in listed]
    for t in [*documents.text, *more]:
        plain = " " + " ".join("".join(c if c.isalnum() or not c.isascii() else " " for c in "".join(x.lower() if x.isascii() else x for x in t)).split()) + " "
        assert s.detections(plain) == [(*m.span(), k) for k, r in enumerate(slow) for m in r.finditer(plain)]


def test_license_query_against_a_plain_word_scan(result, documents):
    import re

    r = {x.doc_id: x for x in result("op8_license_scan", D).itertuples()}
    assert len(r) == len(documents)
    for d in documents.itertuples():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), d.text))
        places = [(k, label) for phrase, label in license_rules.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        got, starts = r[d.doc_id], [k for k, _ in places]
        assert (got.n_words, got.n_base, got.base_labels) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        assert not places and got.first_word != got.first_word or (got.first_word, got.last_word) == (min(starts), max(starts))
        assert set(filter(None, got.base_labels.split(","))) <= set(got.labels.split(",")) | {""}


def scan(text):
    return license_scan.Scanner(license_rules.rules()).scan(text.encode())


def test_license_texts():
    assert scan("Licensed under the Apache License, Version 2.0.")[5] == "apache-2.0"
    assert scan("Released under the MIT License.")[5] == "mit"
    n, base, first, last, labels, all_labels, score, found = scan("See CC BY-NC 4.0. All rights reserved; this work is licensed under the GNU General Public License, version 3.")
    assert (n, base, first, last, labels) == (21, 3, 1, 16, "cc-by,gpl,reserved") and {"cc-by-nc", "gpl-3.0"} <= set(all_labels.split(",")) and score >= 0.9
    assert any(not f["taken"] for f in found)
    assert scan("a plain text about rights, terms and public matters")[5:7] == ("", 0.0)


def test_suppression_against_brute_force():
    s = license_scan.Scanner(license_rules.rules())
    rng = np.random.default_rng(8)
    for _ in range(200):
        found = [(int(a), int(a + b), int(k)) for a, b, k in zip(rng.integers(0, 30, 12), rng.integers(1, 12, 12), rng.integers(0, len(s.rules), 12), strict=True)]
        taken = []
        for lo, hi, k in sorted(found, key=lambda d: (s.rules[d[2]][1], d[0], -d[1], d[2])):
            if not any(a <= lo and hi <= b for a, b, _ in taken):
                taken.append((lo, hi, k))
        assert sorted(x[:3] for x in s.resolve(found) if x[3]) == sorted(taken)


# Near duplicates.
def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", low)]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(documents, monkeypatch):
    texts = [*documents.text.head(40), "one", "one TWO", "Ä b c d", "a b c a b c a b c a b c"]
    assert [near_dedup.fingerprint(t.encode()) for t in texts] == [slow_fingerprint(t) for t in texts]
    monkeypatch.setattr(near_dedup, "CHUNK", 7)
    assert [near_dedup.fingerprint(t.encode()) for t in texts] == [slow_fingerprint(t) for t in texts]


def union(n, edges):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("limit", [1, 3, 64])
def test_links_connect_what_brute_force_does(spark, limit):
    rng = np.random.default_rng(9)
    seeds, fps = rng.integers(0, 2**63, 30, dtype=np.int64), set()
    for s in seeds.tolist():
        x = s
        for _ in range(12):
            for b in rng.integers(0, 64, int(rng.integers(1, 4))).tolist():
                x ^= (1 << b) - (1 << 64 if b == 63 else 0)
            fps.add(x)
    fps = sorted(fps)
    edges = [(i, j) for i in range(len(fps)) for j in range(i) if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 2]
    got = near_dedup.links(spark.createDataFrame([(x,) for x in fps], "fp bigint"), limit)
    place = {x: k for k, x in enumerate(fps)}
    mine = [(place[r.a], place[r.b]) for r in got.collect()]
    assert set(mine) | {(b, a) for a, b in mine} <= set(edges) | {(b, a) for a, b in edges}
    assert union(len(fps), mine) == union(len(fps), edges)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 400)] + [(5000, 5001), (5001, 5002), (5002, 5000)]
    got = {r.node: r.label for r in near_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[k] == 0 for k in range(301)) and all(got[1000 + k] == 1000 for k in range(400)) and {got[5000], got[5001], got[5002]} == {5000} and len(got) == 704
    assert near_dedup.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# Chat.
def test_windows_keep_the_system_turn_and_limit_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, k, ("user", "assistant")[k % 2], f"turn {k} " + "w" * (40 * (k % 5))) for k in range(1, 60)]
    w = chat_format.windows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), budget=120, history=60).orderBy("window").collect()
    assert len(w) > 5
    seen = ""
    for k, r in enumerate(w):
        assert r.text.startswith("<|turn|>system\nbe kind<|end|>\n") and r.text.count("be kind") == 1
        if k:
            past = r.text[len("<|turn|>system\nbe kind<|end|>\n") : r.own_from]
            assert past.count("<|turn|>") <= 60 // 4 and past in seen
        assert all(r.own_from <= s["from"] <= s["to"] <= len(r.text) for s in r.loss)
        seen += r.text[r.own_from :]
    learned = "".join(r.text[s["from"] : s["to"]] for r in w for s in r.loss)
    assert learned == "".join(t for *_, role, t in rows if role == "assistant")


def plain_windows(rows, budget, history):
    """(begin, shown turns, own turns) of one conversation's (role, text) by a running sum."""
    tokens = [(len(t) + 3) // 4 + 4 for _, t in rows]
    lead = rows[0][0] == "system"
    room = max(budget - history - (tokens[0] if lead else 0), max(history, budget // 4))
    starts, at = [], 0
    for n in tokens:
        starts.append(at)
        at += n
    out, k = [], 0
    while k < len(rows):
        cell = [i for i in range(k, len(rows)) if starts[i] // room == starts[k] // room]
        k = cell[-1] + 1
        over = len(cell) > 1 and starts[cell[-1]] + tokens[cell[-1]] - starts[cell[0]] > room
        for own in ([cell[:-1], cell[-1:]] if over else [cell]):
            b = starts[own[0]]
            shown = [0] * (lead and b > 0) + [i for i in range(own[0]) if b - starts[i] <= history and not (lead and i == 0)]
            out.append((b, shown, own, sum(tokens[i] for i in shown + own)))
    return out, tokens, room


@pytest.mark.parametrize(("budget", "history", "cut"), [(1024, 256, 64), (120, 30, 3), (60, 10, 1), (300, 75, 7)])
def test_windows_equal_a_running_sum_and_keep_the_budget(spark, budget, history, cut):
    rng = np.random.default_rng(budget)
    convs = {}
    for c in range(12):
        sizes = rng.choice([0, 20, 90, 400, 1500], 150, p=[0.1, 0.4, 0.3, 0.15, 0.05]) if c else [2384] * 9
        roles = ["system" if c % 2 and k == 0 else ("user", "assistant")[k % 2] for k in range(len(sizes))]
        convs[c] = [(r, f"{k}:" + "w" * max(0, int(n) - 3)) for k, (r, n) in enumerate(zip(roles, sizes, strict=True))]
    rows = [(c, k, r, t, "x", 1, 2, 3) for c, ts in convs.items() for k, (r, t) in enumerate(ts)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, key string, cut int, line int, o int")
    got = {}
    for w in chat_format.windows(df, budget, history, cut).orderBy("conv_id", "window").collect():
        turns = [tuple(x[len("<|turn|>") :].split("\n", 1)) for x in w.text.split("<|end|>\n")[:-1]]
        own = w.text[w.own_from :].count("<|turn|>")
        got.setdefault(w.conv_id, []).append((w.window, turns[: len(turns) - own], turns[len(turns) - own :], [w.text[s["from"] : s["to"]] for s in w.loss]))
    for c, ts in convs.items():
        want, tokens, room = plain_windows(ts, budget, history)
        assert [(b, [ts[i] for i in shown], [ts[i] for i in own], [ts[i][1] for i in own if ts[i][0] == "assistant"]) for b, shown, own, _ in want] == got[c]
        for _, _, own, total in want:
            small_lead = budget - history - (tokens[0] if ts[0][0] == "system" else 0) >= max(history, budget // 4)
            assert total <= budget or (len(own) == 1 and tokens[own[0]] > room) or not small_lead


def test_main_paths_are_native(spark):
    for name in ("op5_shards", "op9_chat_format"):
        plan = queries.QUERIES[name](spark, D)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
