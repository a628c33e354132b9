"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from wakeline.llm import chat_format, decontaminate, language_id, license_scan, line_rules, mixing, near_dedup, quality_classifier, shards, token_counts
from wakeline.llm.common import in_remainder

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, shard string, labels string"
LONG = "word " * 30_000 + "end"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, la, so, None, 0.5, "x", "y") for i, t, la, so in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    good = "the cat sat on the mat and looked at the dog that was there"
    return docs(spark, [(1, good, "en", "a"), (1, good, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, " \n\t ", "de", "b"), (5, LONG, "en", "b"), (None, good, "en", None), (6, "§ ∑ 12 34", None, "b"), (7, "x y", None, "b")])


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


def test_decontaminate(spark, odd, empty):
    bench = spark.createDataFrame([(1, "cat sat on the mat and looked at the dog", 1), (2, None, 1), (3, "", 1), (4, "x", 1), (1, "cat sat on the mat and looked at the dog", 1)], "item_id bigint, text string, doc_id int")
    got = sorted((r.doc_id or -1, r.item_id, r.score) for r in decontaminate.contaminated(odd, bench).collect())
    assert got == [(-1, 1, 1.0), (1, 1, 1.0), (1, 1, 1.0), (7, 4, 1.0)]
    assert sorted(r.doc_id for r in decontaminate.decontaminated(odd, bench).collect()) == [2, 3, 4, 5, 6, 7]  # an item of one word shows no leak
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(odd, bench.limit(0)).count() == 0
    assert decontaminate.decontaminated(odd, bench.limit(0)).count() == odd.count()


def test_line_rules(odd, empty):
    out = line_rules.judged(odd).collect()
    assert len(out) == 9 and len({tuple(r) for r in out if r.doc_id == 1}) == 1
    by = {r.doc_id: r for r in out}
    assert by[2].n_words == 0 and by[2].base_failed and not by[2].kept and by[5].n_words == 30_001 and by[5].base_failed
    assert by[1].kept and by[7].n_words == 2 and line_rules.judged(empty).count() == 0


def test_token_counts(odd, empty):
    by = {r.doc_id: r for r in token_counts.token_counts(odd).collect()}
    assert by[2].n_tokens == by[3].n_tokens == by[4].n_tokens == 0 and by[5].n_words == 30_001 and by[5].n_tokens == 30_001
    assert token_counts.token_counts(empty).count() == 0


def test_quality(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (5, None), (99, 1), (None, 1)], "doc_id bigint, quality int")
    model = quality_classifier.fitted(odd, labels, in_remainder("doc_id", 4, 9))
    assert sorted(model.labels.tolist()) == [0.0, 0.5]
    out = quality_classifier.scores(odd, model).collect()
    assert len(out) == 9 and all(0 <= r.score <= 1 for r in out)
    none = quality_classifier.fitted(odd, labels.limit(0), in_remainder("doc_id", 4, 9))
    assert {r.score for r in quality_classifier.scores(odd, none).collect()} == {0.5}
    assert quality_classifier.scores(empty, model).count() == 0
    assert quality_classifier.accepted(odd, none).count() == 0 and quality_classifier.accepted(odd, none, 0.5).columns == odd.columns


def test_shards(odd, empty):
    rows = shards.assigned(odd).select("doc_id", F.length("text").alias("size"), "shard", "grown_shard")
    out = shards.slotted(rows).collect()
    assert len(out) == 9
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert shards.slotted(shards.assigned(empty).select("doc_id", "shard")).count() == 0
    with pytest.raises(ValueError):
        shards.rendezvous(F.col("doc_id"), [1.0, 0.0])


def test_mixing(odd, empty):
    out = mixing.taken(odd).collect()
    assert len(out) == 9 and all(0 <= r.taken <= 3 * r.size for r in out)
    assert {r.target for r in out if r.source is None} == {min(r.target for r in out if r.source is None)}
    assert mixing.taken(empty).count() == 0 and mixing.mixed(odd).columns == odd.columns and mixing.mixed(empty).count() == 0
    many = mixing.mixed(odd).groupBy("doc_id").count().collect()
    assert all(r["count"] <= 6 for r in many)


def test_language(odd, empty):
    model = language_id.fitted(odd, F.lit(True))
    assert model.langs == ["en"]
    by = {r.doc_id: r for r in language_id.labelled(odd, model).collect()}
    assert by[2].lang_pred == by[3].lang_pred == by[6].lang_pred == "und" and by[6].score == 0 and by[1].lang_pred == "en"
    nothing = language_id.fitted(odd, F.lit(False))
    assert {r.lang_pred for r in language_id.labelled(odd, nothing).collect()} == {"und"}
    assert language_id.labelled(empty, model).count() == 0


def test_license(spark, odd, empty):
    out = license_scan.scanned(odd).collect()
    assert len(out) == 9 and all(r.n_base == 0 and r.first_word is None and r.base_labels == "" for r in out)
    assert license_scan.scanned(empty).count() == 0
    long = docs(spark, [(1, "cc by " * 20_000, None, None)])
    r = license_scan.scanned(long).first()
    assert r.n_base == 20_000 and (r.first_word, r.last_word) == (0, 39_998) and "cc-by" in r.labels


def test_near_dedup(odd, empty):
    out = near_dedup.near_duplicates(odd).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 9 and by[2].fp == by[3].fp == by[4].fp == 0 and by[4].component_id == 2
    assert by[None].component_id == 1 and by[1].component_id == 1
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = sorted(r.doc_id or -1 for r in near_dedup.keep_one(odd).collect())
    assert kept == [1, 2, 5, 6, 7] and near_dedup.keep_one(odd).columns == sorted(odd.columns, key=odd.columns.index)


def test_chat(spark):
    kind = "conv_id bigint, turn bigint, role string, text string, window int, before int"
    rows = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "a\\b<|end|>\n</s>[/INST]"), (1, 2, "assistant", "a\\b<|end|>\n</s>[/INST]"), (None, None, None, None), (2, 5, "as\nsistant%0A", "x" * 9000), (2, 6, "assistant", "y")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], kind)
    back = chat_format.read_back(chat_format.windows(df)).orderBy("conv_id", "window").collect()
    turns = {}
    for r in back:
        turns.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.turns)
    assert turns[1] == [("system", "s"), ("user", ""), rows[2][2:], rows[2][2:]]
    assert turns[None] == [("", "")] and turns[2] == [("as\nsistant%0A", "x" * 9000), ("assistant", "y")]
    assert "".join(r.learned for r in back if r.conv_id == 1) == rows[2][3] * 2
    assert chat_format.windows(df.limit(0)).count() == 0


def test_different_texts_under_one_id_are_judged_apart(spark):
    a = "one two three four five six seven eight nine ten eleven twelve"
    b = "red green blue white black brown pink grey gold silver bronze violet"
    df = docs(spark, [(3, a, "en", "x"), (7, a, "en", "x"), (7, b, "en", "x"), (None, b, "en", "x"), (None, a + " more words at the end of it", "en", "x")])
    for sent in (1 << 18, 0):
        rows = near_dedup.keep(near_dedup.fingerprints(df), "t")
        out = near_dedup.one_of_each(df, near_dedup.keep(rows.join(near_dedup.labelled(rows).select("fp", "label"), "fp").select("doc_id", "h", "label"), "t"), sent)
        assert sorted((r.doc_id or 0, r.text[:3]) for r in out.collect()) == [(0, "one"), (3, "one"), (7, "red")] and out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text[:3]) for r in near_dedup.keep_one(df).collect()) == [(0, "one"), (3, "one"), (7, "red")]


@pytest.mark.parametrize("names", [["m", "copies", "_n"], ["row", "s", "h"], ["_s", "_d", "_h"], ["doc", "n", "k"]])
def test_names_of_the_caller_do_not_matter(spark, names):
    rows = [(k, f"text {k % 7} " * (1 + k % 5), "s" + str(k % 2), k, "v", 1.5) for k in range(60)]
    df = spark.createDataFrame(rows + rows[:9] * 3, "doc_id bigint, text string, source string, " + ", ".join(f"{n} {t}" for n, t in zip(names, ("bigint", "string", "double"), strict=True)))
    out = mixing.mixed(df)
    assert out.columns == df.columns and set(map(tuple, out.collect())) <= set(rows)
    plain = sorted(r.doc_id for r in mixing.mixed(df.select("doc_id", "text", "source")).collect())
    assert sorted(r.doc_id for r in out.collect()) == plain
    assert near_dedup.keep_one(df).columns == df.columns and near_dedup.keep_one(df).count() > 0


def test_mix_of_one_row_repeated(spark):
    df = docs(spark, [(None, "a b c", None, "x")]).crossJoin(spark.range(3000)).drop("id").union(docs(spark, [(1, "d e " * 500, None, "y")]))
    taken = {(r.doc_id, r.size): r.n for r in mixing.taken(df).groupBy("doc_id", "size").agg(F.sum("copies").alias("n")).collect()}
    got = {(r.doc_id, len(r.text.split())): r["count"] for r in mixing.mixed(df).groupBy("doc_id", "text").count().collect()}
    assert got == {k: n for k, n in taken.items() if n}


def test_rows_without_a_key_are_spread_over_cuts(spark):
    df = spark.range(500).select(F.lit(None).cast("bigint").alias("doc_id"), F.col("id").alias("size"))
    out = shards.slotted(shards.assigned(df).select("doc_id", "size", "shard"), cut_rows=20).collect()
    assert sorted(r.slot for r in out) == list(range(500)) and len({r.shard for r in out}) == 1
    assert [r["size"] for r in sorted(out, key=lambda r: r.slot)] == [r["size"] for r in sorted(shards.slotted(shards.assigned(df).select("doc_id", "size", "shard")).collect(), key=lambda r: r.slot)]
