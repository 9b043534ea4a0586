"""The selection pass: options against all subsets, pruning and whole passes against plain loops."""

from __future__ import annotations

import hashlib
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark import catalogue
from quillmark.operators import selection_pass as sp
from tests.conftest import SF

RUN = ["exam_code", "year"]
TOPICS = ("1-URGENT", "PROMO", "ECONOMY")


@settings(max_examples=60, deadline=None)
@given(marks=st.lists(st.integers(1, 6), min_size=1, max_size=7), most=st.integers(1, 20), usable=st.integers(0, 127))
def test_options_equal_all_subsets(marks, most, usable):
    leaves = [{"marks": m, "usable": bool(usable >> k & 1), "topic": None} for k, m in enumerate(marks)]
    own = [k for k, x in enumerate(leaves) if x["usable"]]
    subsets = [(sum(marks[k] for k in c), len(c), sum(1 << k for k in c)) for n in range(1, len(own) + 1) for c in combinations(own, n)]
    best = {s: max((n, -m) for t, n, m in subsets if t == s) for s in {t for t, _, _ in subsets if t <= most}}
    want = {(s, n, -m) for s, (n, m) in best.items()} | {x for x in subsets if x[1] == len(own)}
    got = sp.question_options(leaves, "SKIP", most)
    assert set(got) == want and got == sorted(got, key=lambda o: (-o[0], -o[1], o[2]))
    assert {o[2] for o in sp.question_options(leaves, "PRUNE", most)} == {sum(1 << k for k in own[:n]) for n in range(1, len(own) + 1)}
    assert [o[2] for o in sp.question_options(leaves, "ALL", most)] == ([sum(1 << k for k in own)] if own else [])


def test_requests_are_checked():
    for bad in ({"target": 0}, {"target": 5, "tolerance": -1}, {"target": 5, "mode": "X"}, {"target": 5, "min_questions": 0}, {"target": 5, "min_questions": 3, "max_questions": 2}):
        with pytest.raises(ValueError):
            sp.Request(**bad)


def test_pruning_one_step_at_a_time():
    row = lambda q, k, m, kept=False: {"question_id": q, "k": k, "marks": m, "kept": kept}
    assert sp.pruned([row(1, 0, 5), row(1, 1, 2), row(2, 0, 4)], 8, 0, "SKIP") == {(1, 1)}
    assert sp.pruned([row(1, 0, 1), row(1, 1, 5), row(2, 0, 4)], 8, 0, "PRUNE") == set()  # 5 would lead further off
    assert sp.pruned([row(1, 0, 1), row(1, 1, 3), row(2, 0, 7)], 8, 0, "PRUNE") == {(1, 1)}
    assert sp.pruned([row(1, 0, 3, True), row(1, 1, 3), row(1, 2, 3)], 3, 0, "SKIP") == {(1, 1)}  # a plan with one leaf beside its pins is left alone
    assert sp.pruned([row(1, 0, 3, True), row(1, 1, 3, True), row(1, 2, 3)], 3, 0, "SKIP") == set()
    assert sp.pruned([row(1, 0, 9)], 3, 0, "SKIP") == set()


def h(seed, *what):
    return hashlib.md5(f"{seed}:{':'.join(map(str, what))}".encode()).hexdigest()


def loop(questions, parts, c, pinned, part_pins, matched):
    """A build for every run, step by step over lists."""
    by_run: dict = {}
    for q in questions:
        by_run.setdefault(tuple(q[r] for r in RUN), []).append(q)
    leaves: dict = {}
    for p in sorted(parts, key=lambda p: p["ord"]):
        leaves.setdefault(p["question_id"], []).append(p)
    out = set()
    for run, qs in by_run.items():
        for attempt in range(5):
            seed, picks = c.seed + attempt, []
            pool = {}
            for q in qs:
                own = leaves.get(q["question_id"], [])
                i = q["question_id"]
                pin = [(i, p["label"]) in part_pins for p in own]
                hit = [(i, p["label"]) in matched for p in own]
                eff = [p["topic"] or q["topic"] for p in own]
                if not own or (c.topics and not (i in pinned or any(hit) or any(pin) or q["topic"] in c.topics or any(p["topic"] in c.topics for p in own))):
                    continue
                if c.keyword_mode:
                    want = [a or b for a, b in zip(pin, hit)]
                    if not any(want) and i not in pinned and not c.fills:
                        continue
                    use = want if any(want) else [True] * len(own)
                elif not c.topics or c.mode == "ALL":
                    use = [True] * len(own)
                elif c.mode == "PRUNE":
                    last = max((k for k, t in enumerate(eff) if t in c.topics), default=-1)
                    use = [k <= last for k in range(len(own))]
                else:
                    use = [t in c.topics for t in eff]
                rows = [{"marks": p["marks"], "topic": t, "usable": u and p["is_valid"], "pinned": x} for p, t, u, x in zip(own, eff, use, pin)]
                if any(r["usable"] for r in rows):
                    pool[i] = (rows, i in pinned, any(hit), {q["topic"], *eff})
            mode = "SKIP" if c.keyword_mode else c.mode
            total = lambda: sum(o[0] for _, o, _ in picks)  # noqa: B023, E731
            used = lambda: {i for i, _, _ in picks}  # noqa: B023, E731
            for i, (rows, whole, _, _) in pool.items():
                pins = sum(1 << k for k, r in enumerate(rows) if r["pinned"])
                if whole or pins:
                    options = sp.question_options(rows, mode, 10**6)
                    if mode == "SKIP":  # every subset is an option
                        own = [k for k, r in enumerate(rows) if r["usable"]]
                        options = sorted(((sum(rows[k]["marks"] for k in s), len(s), sum(1 << k for k in s)) for n in range(1, len(own) + 1) for s in combinations(own, n)), key=lambda o: (-o[0], -o[1], o[2]))
                    good = [o for o in options if o[2] & pins == pins]
                    picks.append((i, options[0] if whole or not good else min(good, key=lambda o: (o[0], o[1], -o[2])), "pinned"))
            order = sorted(pool, key=lambda i: (h(seed, i), i))
            if c.backfill:
                for i in [i for i in order if pool[i][2] and i not in used()]:
                    if total() >= c.target:
                        break
                    fits = [o for o in sp.question_options(pool[i][0], mode, c.target - total()) if o[0] <= c.target - total()]
                    if fits:
                        picks.append((i, fits[0], "keyword"))
            covered = lambda: {t for i, o, _ in picks for t in sp.topics_of(pool[i][0], o[2])}  # noqa: B023, E731
            if c.force_topics and c.topics and total() < c.target:
                have = {t: [i for i in pool if t in pool[i][3]] for t in c.topics}
                for t in sorted((t for t in have if have[t]), key=lambda t: (len(have[t]), h(seed, t))):  # noqa: B023
                    if t in covered():
                        continue
                    remaining, left = c.target - total(), len(set(c.topics) - covered())
                    best = []
                    for i in set(have[t]) - used():
                        f = sp.coverage_option(sp.question_options(pool[i][0], mode, max(1, remaining)), pool[i][0], t, remaining, left, seed, i)
                        if f:
                            best.append((f[0], -i, f[1]))
                    if best:
                        _, i, o = max(best)
                        picks.append((-i, o, "topic"))
            if c.fills and total() < c.target:
                size = 2 * sp.chance(seed, *run, "size") - 1
                for i in [i for i in order if i not in used()]:
                    if total() >= c.target or (c.max_questions is not None and len(picks) >= c.max_questions):
                        break
                    room = c.target + c.tolerance - total()
                    if o := sp.fill_option(sp.question_options(pool[i][0], mode, room), room, size, seed, i):
                        picks.append((i, o, "normal"))
            held = [{"question_id": i, "k": k, "marks": r["marks"], "kept": r["pinned"] or pool[i][1], "origin": g, "topic": r["topic"]} for i, o, g in sorted(picks) for k, r in enumerate(pool[i][0]) if o[2] >> k & 1]
            gone = set() if c.mode == "ALL" else sp.pruned([{x: r[x] for x in ("question_id", "k", "marks", "kept")} for r in held], c.target, c.tolerance, c.mode)
            held = [r for r in held if (r["question_id"], r["k"]) not in gone]
            if not (c.force_topics and c.topics) or set(c.topics) <= {r["topic"] for r in held}:
                break
        out |= {(*run, r["question_id"], r["k"], r["marks"], r["origin"]) for r in held}
    return out


@pytest.mark.parametrize(
    "name, request_, pins",
    [
        ("selection_all", sp.Request(50, 2, 42, "ALL", topics=TOPICS), False),
        ("selection_prune", sp.Request(30, 0, 7, "PRUNE", topics=TOPICS), True),
        ("selection_skip", sp.Request(35, 1, 1, "SKIP", topics=TOPICS, max_questions=6), False),
        ("selection_keywords", sp.Request(40, 2, 12345, "SKIP", keyword_mode=True), True),
    ],
)
def test_builds_equal_plain_loops(spark, name, request_, pins):
    from quillmark.plans.selection_queries import _sources

    q, p, *more = ([r.asDict() for r in x.collect()] for x in _sources(spark, SF))
    pinned, part_pins, matched = more if pins else ([], [], [])
    ids = {r["question_id"] for r in pinned}
    want = loop(q, p, request_, ids, {(r["question_id"], r["label"]) for r in part_pins}, {(r["question_id"], r["label"]) for r in matched})
    got = {tuple(r) for r in catalogue.QUERIES[name](spark, SF).collect()}
    assert got == want


def test_first_fit_goes_on_to_the_next_slice(spark):
    """Slices of one candidate give what one large slice gives."""
    from quillmark.plans.selection_queries import _sources

    q, p, pinned, part_pins, matched = _sources(spark, SF)
    c = sp.Request(12, 0, 3, "SKIP")
    pool = sp._pool(q, p, RUN, c, pinned.limit(0), part_pins.limit(0), matched.limit(0)).filter("exam_code = '0001'")
    none = sp._forced(pool, RUN, c)
    large = {tuple(map(str, r)) for r in sp._first_fit(pool, none, RUN, c, 3, "normal").collect()}
    small = {tuple(map(str, r)) for r in sp._first_fit(pool, none, RUN, c, 3, "normal", first=1).collect()}
    assert small == large and large


def test_warnings_of_a_build(spark):
    rows = [("e", 1, 5, 0, 30, "normal", "A"), ("e", 1, 6, 1, 25, "pinned", "Z"), ("f", 1, 7, 0, 10, "keyword", "A")]
    df = spark.createDataFrame(rows, "exam_code string, year int, question_id long, k int, marks int, origin string, topic string")
    got = {r.exam_code: r for r in sp.warnings(df, RUN, sp.Request(50, 2, topics=("A",))).collect()}
    assert (got["e"].excess, got["e"].mismatched, got["e"].pinned_marks) == (5, "Z", 25)
    assert (got["f"].excess, got["f"].mismatched, got["f"].keyword_parts) == (None, None, 1)


def test_part_pins_of_malformed_pins(spark):
    assert [tuple(r) for r in sp.part_pins_of(["3::3(a)", "nothing", "4::4(b)(i)"], spark).collect()] == [(3, "3(a)"), (4, "4(b)(i)")]


def test_greedy_fill_by_slices(spark):
    from quillmark.operators import selection
    from quillmark.plans.selection_queries import _totals

    totals = _totals(spark, SF)
    for c in (selection.SelectionConfig(50, 2, 42), selection.SelectionConfig(7, 0, 1), selection.SelectionConfig(10_000, 2, 3), selection.SelectionConfig(90, 5, 4, max_questions=3)):
        whole = {tuple(r) for r in selection.greedy_fill(totals, RUN, c).collect()}
        assert whole == {tuple(r) for r in selection.greedy_fill(totals, RUN, c, first=2).collect()} and whole


def test_pruning_orders_only_leaves_of_the_marks_it_ends_at(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quillmark.operators import selection

    df = spark.range(600).selectExpr("id % 2 run", "id div 6 question_id", "id % 6 + 1 ord", "cast(id div 2 % 6 + 1 as int) marks")
    seen, number = [], selection.numbered
    monkeypatch.setattr(selection, "numbered", lambda rows, order, name: seen.append(rows.count()) or number(rows, order, name))
    # 300 leaves of 1,050 marks a run: those of 1 and 2 go, and some of 3
    left = selection.prune_smallest(df, ["run"], 850, 2, F.lit(False)).groupBy("run").agg(F.sum("marks").alias("s"), F.min("marks").alias("m")).collect()
    assert seen == [100] and all(abs(r.s - 850) <= 2 and r.m == 3 for r in left) and len(left) == 2
