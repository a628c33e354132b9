"""Frequent lines of large hosts, and texts without them."""

from wakeline.llm import line_rules

DOCS = "doc_id bigint, text string, source string, mark int"
OWN = "own words {0} a{0} b{0} c{0} d{0} e{0} f{0} g{0} h{0} i{0} j{0} k{0}"


def letters(k):
    return "".join(chr(97 + int(c)) for c in str(k))


def plain(line):
    low = "".join(c.lower() if c.isascii() else c for c in line)
    return " ".join("".join("0" if c in "123456789" else c if c.isalnum() or not c.isascii() else " " for c in low).split())


def test_kept_texts_lose_their_frequent_lines(spark):
    shared, other = "Read MORE of our stories, here!", "Copyright 20{0} by the makers"
    rows = [(k, "\n".join([shared, OWN.format(letters(k)), "", other.format(10 + k), "---"]), "a" if k % 2 else None, k) for k in range(60)]
    rows += [(100, f"{shared}\n" * 9 + OWN.format("z"), "a", 1), (101, None, "a", 2), (102, f"{shared}\n{OWN.format('y')}", "b", 3), (1, rows[1][1], "a", 7)]
    docs = spark.createDataFrame(rows, DOCS)
    held = {}
    for _, t, s, _ in rows:
        for p in {plain(x) for x in (t or "").split("\n")} - {""}:
            held.setdefault((s, p), set()).add(t)
    want = []
    for i, t, s, m in rows:
        left = "\n".join(x for x in (t or "").split("\n") if len(held.get((s, plain(x)), ())) <= 10)
        if t and 2 * len(left.split()) >= len(t.split()):
            want.append((i, left, s, m))
    out = line_rules.cleaned(docs)
    got = [tuple(r) for r in out.collect()]
    assert out.columns == docs.columns and sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 62
    lost = {r.doc_id: r.lost_words for r in line_rules.judged(docs).where("kept").collect()}
    texts = {i: t for i, t, *_ in rows}
    assert all(lost[i] == len(texts[i].split()) - len(t.split()) for i, t, *_ in got)


def test_a_count_is_enough_in_a_large_host(spark):
    line = "Read more of our stories here"
    rows = [(k, OWN.format(letters(k)) + (f"\n{line}" if k < 11 else ""), "big", k) for k in range(3000)]
    out = line_rules.judged(spark.createDataFrame(rows, DOCS)).where("lost_words > 0").collect()
    assert sorted(r.doc_id for r in out) == list(range(11)) and {r.lost_words for r in out} == {6}


def test_copies_are_documents_unless_texts_are_asked_for(spark):
    line = "this site uses cookies to make your visit better for all of us"
    rows = [(k, f"{line}\nshort own body of these pages", "a", k) for k in range(50)] + [(100 + k, f"{line}\n{OWN.format(letters(k))}", "b", 0) for k in range(3)]
    docs = spark.createDataFrame(rows, DOCS)
    out = line_rules.judged(docs).collect()
    assert {r.lost_words for r in out if r.host == "a"} == {19} and {r.lost_words for r in out if r.host == "b"} == {0}
    assert {r.lost_words for r in line_rules.judged(docs, copies_once=True).collect()} == {0}
    none = docs.withColumn("doc_id", docs.doc_id * None)
    assert {r.lost_words for r in line_rules.judged(none).collect()} == {0}
    assert {r.lost_words for r in line_rules.judged(docs, share=0.99).collect() if r.host == "a"} == {19}
    monkey = line_rules.SENT_ROWS
    line_rules.SENT_ROWS = 0
    try:
        assert sorted(map(str, line_rules.judged(docs).collect())) == sorted(map(str, out))
    finally:
        line_rules.SENT_ROWS = monkey
