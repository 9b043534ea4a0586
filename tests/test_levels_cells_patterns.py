"""Trees of any depth, interval joins by cells, and many patterns, against loops."""

from __future__ import annotations

import json
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.operators import cells, levels, patterns, search

# ---------------------------------------------------------------- trees

NODE = "question_id long, label string, parent string, kind string, marks int, top long, bottom long, topic string, inline boolean, right int"


def trees(seed, depth=6):
    rng = random.Random(seed)
    rows = []

    def grow(q, label, parent, level):
        top = rng.randint(0, 9)
        rows.append((q, label, parent, f"k{level}", rng.choice([None, None, rng.randint(0, 9)]), top, top + rng.randint(0, 5), rng.choice([None, None, "Unknown", "x", "y"]), rng.random() < 0.7, rng.randint(1, 99)))
        if level < depth:
            for k in range(rng.choice([0, 1, 2, 3]) if level > 1 else 2):
                grow(q, f"{label}({k})", label, level + 1)

    for q in range(12):
        grow(q, str(q), None, 0)
    return rows


def by_hand(rows):
    below = {}
    for r in rows:
        below.setdefault((r[0], r[2]), []).append(r)
    kids = lambda r: sorted(below.get((r[0], r[1]), []), key=lambda x: (x[5], x[1]))

    def marks(r):
        return r[4] if r[4] is not None else sum(map(marks, kids(r)))

    def right(r):
        return min(map(right, kids(r)), default=r[9])

    def topic(r):
        own = r[7] if r[7] not in (None, "Unknown") else None
        return own or next((t for t in map(topic, kids(r)) if t), None)

    def code(r):
        out = {"label": r[1], "kind": r[3], "marks": r[4], "bounds": {"top": r[5], "bottom": r[6]}, "topic": r[7], "children": [code(x) for x in kids(r)]}
        return {k: v for k, v in out.items() if v is not None and v != []}

    resolved = {}
    for group in below.values():
        own = sorted(group, key=lambda x: (x[5], x[1]))
        t = [topic(x) for x in own]
        for k, x in enumerate(own):
            between = t[k - 1] if x[2] is not None and 0 < k < len(own) - 1 and t[k - 1] == t[k + 1] else None
            resolved[x[:2]] = t[k] or between
    first = {}
    for r in below.values():
        for x in r:
            if x[2] is None and kids(x):
                at = kids(x)[0]
                while at[8] and kids(at):
                    at = kids(at)[0]
                first[x[0]] = at[5]
    source = lambda r: "explicit" if r[4] is not None else "aggregate" if kids(r) else "inferred"
    return {(*r[:2], marks(r), source(r), right(r)) for r in rows}, resolved, first, {r[0]: code(r) for r in rows if r[2] is None}


def test_trees_of_depth_six_equal_recursion(spark):
    rows = trees(5)
    assert max(r[1].count("(") for r in rows) == 6
    df = spark.createDataFrame(rows, NODE).repartition(3)
    marks, topics, first, codes = by_hand(rows)
    assert {tuple(r) for r in levels.built_marks(df).collect()} == marks
    known = F.coalesce(F.col("topic") != "Unknown", F.lit(False))
    assert {(r.question_id, r.label): r.resolved for r in levels.climbed_topics(df, known).collect()} == topics
    assert {r.question_id: r.top for r in levels.first_not_inline(df).collect()} == first
    coded = levels.encoded(df)
    assert {r.question_id: json.loads(r.tree) for r in coded.collect()} == codes
    back = levels.decoded(coded)
    assert {tuple(r) for r in back.drop("problem").collect()} == {r[:8] for r in rows}
    bad = {(r.question_id, r.label, r.problem) for r in levels.tree_checks(coded).collect()}
    assert bad == set()


def test_broken_documents_are_told(spark):
    docs = [(1, "not json"), (2, '{"label":"2","children":[{"kind":"x"},{"label":"2(a)","marks":-1,"children":[{"label":"2(a)"},{"label":"3","bounds":{"top":5,"bottom":4}}]}]}'), (3, None), (4, '{"label":"4"}')]
    got = {tuple(r) for r in levels.tree_checks(spark.createDataFrame(docs, "question_id long, tree string")).collect()}
    assert got == {(1, None, "no object"), (3, None, "no object"), (2, None, "no label"), (2, "2(a)", "negative marks"), (2, "2(a)", "repeated"), (2, "3", "bounds"), (2, "3", "not below its parent")}


# ---------------------------------------------------------------- intervals


@pytest.mark.parametrize("seed", [1, 2])
def test_cells_equal_all_pairs(spark, seed):
    rng = random.Random(seed)

    def some(n):
        out = []
        for i in range(n):
            a = rng.randint(-50, 300)
            out.append((rng.choice([1, 2, None]), i, rng.choice([a, a, a, None]), a + rng.choice([0, 0, 3, 20, 400, -1])))
        return out

    a, b = some(150), some(150)
    left, right = spark.createDataFrame(a, "k int, i int, lo int, hi int"), spark.createDataFrame(b, "k int, j int, lo_ int, hi_ int")
    got = [(r.i, r.j) for r in cells.by_cells(left, right, "k", "lo", "hi", "lo_", "hi_").collect()]
    want = {(x[1], y[1]) for x in a for y in b if x[0] is not None and x[0] == y[0] and None not in (x[2], y[2]) and x[2] <= x[3] and y[2] <= y[3] and y[2] <= x[3] and x[2] <= y[3]}
    assert sorted(got) == sorted(want) and len(want) > 100


def test_a_big_document_is_not_held_against_itself(spark):
    """100,000 spans and as many regions of one document: all pairs would be 10 billion."""
    began = time.time()
    left = spark.range(100_000).selectExpr("1 as k", "id as i", "id * 10 as lo", "id * 10 + if(id = 7, 500000, 12) as hi")
    right = spark.range(100_000).selectExpr("1 as k", "id as j", "id * 10 + 11 as lo_", "id * 10 + 13 as hi_")
    n = cells.by_cells(left, right, "k", "lo", "hi", "lo_", "hi_").count()
    want = sum(1 for i in range(100_000) if i != 7 for j in (i - 1, i) if j >= 0 and j * 10 + 11 <= i * 10 + 12 and i * 10 <= j * 10 + 13) + sum(1 for j in range(100_000) if j * 10 + 11 <= 70 + 500_000 and 70 <= j * 10 + 13)
    assert n == want and time.time() - began < 120


# ---------------------------------------------------------------- patterns

BITS = st.sampled_from(["abc", "a", "xyz", ".", "\\d", "[abc]", "[^x]", "(abc)", "(?:ab|cd)", "\\.", "a{2}", "(abc)?", "b*", "c+", "^", "$", "\\b", " ", "é", "x?", "y{0,2}", "Q", "\\(", "(a(bc))", "|"])


@settings(max_examples=400, deadline=None)
@given(st.lists(BITS, min_size=1, max_size=6), st.booleans(), st.lists(st.sampled_from(["abc", "ABC", "a", "b", "xyz", "XyZ", ".", "1", " ", "é", "É", "Q", "q", "(", "cd", "aa"]), max_size=12))
def test_a_required_literal_is_in_every_match(bits, fold, text):
    pattern, text = ("(?i)" if fold else "") + "".join(bits), "".join(text)
    literal = patterns.required_literal(pattern)
    try:
        compiled = re.compile(pattern, re.ASCII)
    except re.error:
        return
    if literal and compiled.search(text):
        assert literal in text.translate(patterns._LOWER)


def test_required_literals():
    want = {"abcdef": "abcdef", "(?i)Copper|tin": None, "ab(c|d)efgh": "efgh", "colou?r": "colo", "a\\.bc+": "a.bc", "[abc]def\\d{2}": "def", "(?i)é123x": None, "x(?i)abcd": None, "\\Qabc\\E": None, "ab": None, "abc*d": None, "[]abc]def": None, "(?:abc)def": "def", "abc\\x41": None}
    assert {p: patterns.required_literal(p) for p in want} == want


def test_five_thousand_rules_equal_one_match_each(spark):
    rng = random.Random(3)
    syllables = ["ka", "lo", "mi", "tu", "re", "sha", "po", "ne", "vi", "du"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    rules = [search.Rule(f"t{k % 40}", rng.choice(["{}", "(?i){}", "\\b{}\\b", "{}.?{}", "(?:{}|{})", "{}s*$"]).replace("{}", word()).replace("{}", word()), rng.choice([0.1, 0.25, 0.7])) for k in range(5000)]
    texts = [(k, " ".join(rng.choice([word(), word().upper(), word() + "s"]) for _ in range(30))) for k in range(60)] + [(100, None), (101, "")]
    df = spark.createDataFrame(texts, "key int, text string")
    got = {(r.key, r.topic): r.score for r in search.rule_scores(df, rules, "key", "text").collect()}
    compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
    want: dict = {}
    for key, text in texts:
        for r, c in zip(rules, compiled):
            if text is not None and c.search(text):
                want[key, r.topic] = want.get((key, r.topic), 0.0) + r.weight
    assert got == want and len(want) > 500
    few = rules[:50]
    a = {(r.key, r.topic, r.topic_ord): r.score for r in search.rule_scores(df, few, "key", "text").collect()}
    hits = search._hits(df, few, "key", "text").groupBy("key", "topic", "topic_ord").agg(F.array_sort(F.collect_list(F.struct("k", "weight"))).alias("h"))
    assert a == {(r.key, r.topic, r.topic_ord): sum(x.weight for x in r.h) for r in hits.collect()}


def test_patterns_that_do_not_compile(spark):
    own = ["(a(b)", "a)", "a{2,1}", "[(]a", "a*+", "plain", "[a", None, "(a(b)"]
    got = {r.pattern: r.reject for r in patterns.pattern_rejects(spark, spark.createDataFrame([(p,) for p in own], "pattern string")).collect()}
    assert set(got) == {"(a(b)", "a)", "a{2,1}", "[a"} and all(got.values())
    with pytest.raises(ValueError):
        patterns.pattern_rejects(spark, spark.createDataFrame([(p,) for p in own], "pattern string"), most=3)


def test_levels_are_not_sent_to_all_tasks(spark, monkeypatch):
    """Files of levels are small for their rows: sent to all tasks, millions of rows pass through the driver."""
    from quillmark.operators import levels as lv

    nodes = spark.range(1, 200).selectExpr("1L question_id", "'n' || id label", "case when id > 1 then 'n' || (id div 2) end parent", "'node' kind", "cast(id % 5 as int) marks", "id top", "id + 1 bottom", "cast(null as string) topic", "id right")
    plans, keep = [], lv.kept
    monkeypatch.setattr(lv, "kept", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    assert lv.built_marks(nodes).count() == lv.decoded(lv.encoded(nodes)).count() == 199
    assert len(plans) > 10 and not any("BroadcastHashJoin" in p for p in plans)
