from __future__ import annotations

import json
import random
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.functions import text as tx
from quillmark.operators import facets, layout, search, selection
from quillmark.sources import catalogue_files as cf
from quillmark.streaming import ingest


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "label, kind, parent, tokens",
    [("1", "question", None, []), ("1(a)", "letter", "1", ["1", "a"]), ("1(a)(ii)", "roman", "1(a)", ["1", "a", "ii"])],
)
def test_labels(spark, label, kind, parent, tokens):
    assert one(spark, tx.label_kind(F.col("l")), l=label) == kind
    assert one(spark, tx.parent_label(F.col("l")), l=label) == parent
    assert one(spark, tx.label_tokens(F.col("l")), l=label) == (tokens or ["1"])


@pytest.mark.parametrize("roman, value", [("i", 1), ("iv", 4), ("ix", 9), ("xii", 12), ("xiv", 14), ("q", 0)])
def test_roman(spark, roman, value):
    assert one(spark, tx.roman_value(F.col("r")), r=roman) == value


def test_letters_sort_before_romans(spark):
    labels = ["1(b)", "1(a)(ii)", "1(a)(i)", "1(i)", "1(a)(x)", "1(a)"]
    rows = spark.createDataFrame([(x,) for x in labels], "l string").orderBy(tx.label_sort_key(F.col("l"))).collect()
    assert [r.l for r in rows] == ["1(a)", "1(a)(i)", "1(a)(ii)", "1(a)(x)", "1(b)", "1(i)"]


def test_names(spark):
    assert one(spark, tx.year_of(F.col("n")), n="0478_s23_qp_12.pdf") == 2023
    assert one(spark, tx.year_of(F.col("n")), n="0478_w99_qp_12.pdf") == 1999
    assert one(spark, tx.year_of(F.col("n")), n="none") == 2024
    assert one(spark, tx.variant_of(F.col("n")), n="0478_s23_qp_12.pdf") == 2
    assert one(spark, tx.exam_code_of(F.col("n")), n="AB12_x") == "12"
    assert one(spark, tx.exam_code_of(F.col("n")), n="ABC_x") == "abc"
    assert one(spark, tx.paper_prefix(F.col("n")), n="notes.txt") == "notes"


def test_topics(spark):
    assert one(spark, tx.canonical_topic(F.col("t")), t="1) foo") == "01. foo"
    assert one(spark, tx.canonical_topic(F.col("t")), t="  ") == "00. Unknown"
    assert one(spark, tx.topic_slug(F.col("t")), t="01.  Foo   Bar") == "foo bar"
    assert one(spark, facets.is_unknown(F.col("t")), t="00. unknown") is True
    assert one(spark, facets.is_unknown(F.col("t")), t=" ") is False


def test_sanitised_takes_no_break_spaces(spark):
    assert one(spark, tx.sanitised(F.col("t")), t="a  b.....c\n") == "a b c"
    assert one(spark, tx.search_form(F.col("t")), t="A b\tc") == "ab\tc"


def test_keywords(spark):
    docs = spark.createDataFrame([(1, "Über den Fluss"), (2, "fl uss"), (3, None)], "id int, text string")
    hits = {tuple(r) for r in search.keyword_hits(docs, ["fluss", '"den"', '"über"', '"ber"', "", '""'], "id", "text").select("keyword", "id").collect()}
    assert hits == {("fluss", 1), ("fluss", 2), ('"den"', 1), ('"über"', 1)}
    assert search.keyword_hits(docs, [" "], "id", "text").count() == 0


def test_root_hit_returns_all_parts(spark):
    parts = spark.createDataFrame([(1, "a", "x", "root word"), (1, "b", "y", "root word"), (2, "a", "word", None)], "question_id int, label string, text string, root_text string")
    assert {tuple(r)[1:] for r in search.question_hits(parts, ["word"]).collect()} == {(1, "a"), (1, "b"), (2, "a")}


def test_config_is_checked():
    with pytest.raises(ValueError):
        selection.SelectionConfig(0)
    with pytest.raises(ValueError):
        selection.SelectionConfig(1, -1)
    with pytest.raises(ValueError):
        selection.SelectionConfig(1, 1, 1, "SOME")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 30), min_size=1, max_size=40), st.integers(1, 80), st.integers(0, 5), st.integers(0, 3))
def test_greedy_fill_equals_a_plain_loop(spark, marks, target, tolerance, seed):
    import hashlib

    df = spark.createDataFrame([("r", k, m) for k, m in enumerate(marks)], "run string, question_id long, marks int")
    got = [r.question_id for r in selection.greedy_fill(df, ["run"], selection.SelectionConfig(target, tolerance, seed)).orderBy("pos").collect()]
    total, want = 0, []
    for k in sorted(range(len(marks)), key=lambda k: hashlib.md5(f"{seed}:{k}".encode()).hexdigest()):
        if total < target and total + marks[k] <= target + tolerance:
            total += marks[k]
            want.append(k)
    assert got == want and total <= target + tolerance


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 120), min_size=1, max_size=30))
def test_paginate_equals_a_plain_loop(spark, heights):
    df = spark.createDataFrame([("r", k, h) for k, h in enumerate(heights)], "run string, grp int, height int")
    got = [(r.page, r.top) for r in layout.paginate(df, ["run"], 100, 10).orderBy("grp").collect()]
    page, y, want = 1, 0, []
    for h in heights:
        top = y + 10 if y else 0
        if y and top + h > 100:
            page, top = page + 1, 0
        want.append((page, top))
        y = top + h
    assert got == want


def record(k, **more):
    return {"schema_version": 9, "question_id": f"q{k}", "exam_code": "0478", "year": 2020, "paper": 1, "variant": 1, "question_number": k, "total_marks": 3, "part_count": 1, "topic": "T", "relative_path": f"T/q{k}", "child_text": {"1(a)": "text"}, "child_topics": {"1(a)": "U"}} | more


def test_catalogue(spark, tmp_path):
    lines = [json.dumps(record(1)), "", "{broken", json.dumps(record(2, is_valid=False)), json.dumps(record(3, relative_path=None)), json.dumps(record(4, exam_code="x"))]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    rows = cf.read_catalogue(spark, str(tmp_path))
    assert {r.question_id for r in rows.collect()} == {"q1", "q4"}
    assert {r.question_id: r.reject for r in cf.rejects(rows).collect()} == {"q1": None, "q4": "exam code"}
    assert cf.exploded_parts(rows).filter("question_id = 'q1'").first().topic == "U"
    with pytest.raises(Exception):
        cf.read_catalogue(spark, str(tmp_path), strict=True).collect()


def test_append_keeps_copies_within_the_batch(spark, tmp_path):
    path = str(tmp_path / "cat")
    frame = lambda ks: spark.read.schema(cf.QUESTION).json(spark.sparkContext.parallelize([json.dumps(record(k)) for k in ks]))
    cf.write_catalogue(frame([1, 2]), path)
    cf.append_new(spark, frame([2, 3, 3]), path)
    assert sorted(r.question_id for r in cf.read_catalogue(spark, path).collect()) == ["q1", "q2", "q3", "q3"]


def test_outdated(spark, tmp_path):
    for name, line in {"new": '{"schema_version": 10}', "old": '{"schema_version": 5}', "none": "{}", "bad": "{x", "alt": '{"_schema_version": 9}'}.items():
        (tmp_path / f"{name}.jsonl").write_text(line + "\n")
    got = {r.file.rsplit("/", 1)[1]: r.version for r in cf.outdated(spark, str(tmp_path)).collect()}
    assert got == {"old.jsonl": 5, "none.jsonl": 1, "bad.jsonl": 0}


def test_triage(spark, tmp_path):
    for n in ("0478_s23_qp_12.pdf", "9999_s23_qp_12.pdf", "0478_s23_ms_12.pdf", "notes.pdf"):
        (tmp_path / n).write_text("x")
    got = {r.path.rsplit("/", 1)[1]: r.status for r in cf.triaged_papers(spark, str(tmp_path), ["0478"]).collect()}
    assert got == {"0478_s23_qp_12.pdf": "supported", "9999_s23_qp_12.pdf": "unsupported", "notes.pdf": "invalid"}


def test_stream_keeps_the_first_of_each_id(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps(record(k)) for k in (1, 2, 1)))
    time.sleep(0.01)
    (src / "b.json").write_text("\n".join(json.dumps(record(k)) for k in (2, 3)))
    q = ingest.append_catalogue(ingest.first_seen(ingest.catalogue_stream(spark, str(src))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(r.question_id for r in spark.read.schema(cf.QUESTION).json(str(tmp_path / "out")).collect()) == ["q1", "q2", "q3"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9), st.booleans()), min_size=1, max_size=40), st.integers(0, 60), st.integers(0, 4))
def test_prune_smallest_equals_a_plain_loop(spark, leaves, target, tolerance):
    rows = [("r", q, k, m, p) for k, (q, m, p) in enumerate(leaves)]
    df = spark.createDataFrame(rows, "run string, question_id long, ord int, marks int, kept boolean")
    got = {r.ord for r in selection.prune_smallest(df, ["run"], target, tolerance, F.col("kept")).collect()}
    total, left, stop = sum(m for _, m, _ in leaves), {k: q for k, (q, _, _) in enumerate(leaves)}, False
    for m, q, k, p in sorted((m, q, k, p) for k, (q, m, p) in enumerate(leaves)):
        if stop or total <= target + tolerance or p or list(left.values()).count(q) <= 1:
            continue
        if abs(total - m - target) > abs(total - target):
            stop = True
            continue
        total -= m
        del left[k]
    assert got == set(left)


def test_options_of_many_leaves(spark):
    rng = random.Random(1)
    marks = {1: [rng.randint(0, 4) for _ in range(17)], 2: [3], 3: [9, 8], 4: [rng.randint(1, 9) for _ in range(10)]}
    parts = spark.createDataFrame([(q, k + 1, m, True) for q, row in marks.items() for k, m in enumerate(row)], "question_id long, ord int, marks int, is_valid boolean")
    opts = selection.options(parts, "SKIP")
    assert {r[0]: r[1] for r in opts.groupBy("question_id").count().collect()} == {q: 2 ** len(row) - 1 for q, row in marks.items()}
    pair = lambda df: {(r.question_id, r.mask, r.marks) for r in df.collect()}
    for most in (0, 7, 30):
        assert pair(selection.best_of_leaves(parts, most)) == pair(selection.best_within(opts, most))
    pins = spark.createDataFrame([(2, 1), (3, 4), (4, 512 + 3)], "question_id long, mask long")
    assert pair(selection.covering_leaves(parts, pins)) == pair(selection.covering_option(opts, pins))


def test_ranks_of_all_subsets(spark):
    """Negative, no and unknown marks, many leaves; no sort of listed subsets of up to 16 leaves."""
    rng = random.Random(2)
    marks = {1: [rng.randint(0, 4) for _ in range(17)], 2: [3], 3: [9, None, 8, None], 4: [rng.randint(-9, 9) for _ in range(16)], 5: [0, 0, 0], 6: [2**31 - 1, -(2**31), 0], 7: [None], None: [1, 2]}
    parts = spark.createDataFrame([(q, k + 1, m, True) for q, row in marks.items() for k, m in enumerate(row)] + [(8, 1, 1, False), (2, 2, 5, False)], "question_id long, ord int, marks int, is_valid boolean")
    ranked = selection.ranked_subsets(parts)
    old = selection.ranked_options(selection.options(parts, "SKIP"))
    assert [(f.name, f.dataType) for f in ranked.schema] == [(f.name, f.dataType) for f in old.schema]
    got = [tuple(r) for r in ranked.collect()]
    assert len(got) == len(set(got)) == sum(2 ** len(row) - 1 for row in marks.values())
    assert set(got) == {tuple(r) for r in old.collect()}
    few = selection.ranked_subsets(parts.filter("question_id in (2, 4, 5)"))
    assert "Window" not in few._jdf.queryExecution().executedPlan().toString()


def sequence_by_the_rule(c):
    """The rule as a plain scan over (number, pseudo, real)."""
    out, used, done, want = [], set(), set(), 1
    while True:
        after = [k for k in range(out[-1] + 1 if out else 0, len(c)) if k not in used]
        best = None
        for k in (k for k in after if c[k][0] == want):
            if best is None:
                best = k
                if c[k][2] and not c[k][1]:
                    break
            elif not c[best][2] and c[k][2]:
                best = k
                if not c[k][1]:
                    break
            elif c[best][1] and not c[k][1]:
                best = k
                break
        if best is None:
            if not after:
                return out
            if c[after[0]][0] in done:
                used.add(after[0])
                continue
            best = after[0]
        out.append(best)
        done.add(c[best][0])
        want = c[best][0] + 1


def test_sequence_goes_on_behind_a_missing_number(spark):
    rng = random.Random(7)
    docs = {0: [(1, False, True), (3, False, True), (4, False, True)]} | {d: [(rng.randint(1, 8), rng.random() < 0.4, rng.random() < 0.7) for _ in range(rng.randint(1, 25))] for d in range(1, 200)}
    rows = [(d, k, *x) for d, c in docs.items() for k, x in enumerate(c)]
    df = spark.createDataFrame(rows, "doc long, k int, num int, code boolean, placed boolean")
    got = {d: [] for d in docs}
    for r in sorted(layout.resolved_sequence(df, "doc", "num", ["k"], "k", "code", "placed").collect(), key=lambda r: r.pos):
        got[r.doc].append(r.id)
    assert got == {d: sequence_by_the_rule(c) for d, c in docs.items()} and got[0] == [0, 1, 2]
