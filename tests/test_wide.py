"""Options of questions with 200 leaves, against loops."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from quillmark.operators import selection, wide


def test_options_of_wide_questions(spark):
    rng = random.Random(2)
    plans = {1: [rng.randint(1, 6) for _ in range(200)], 2: [rng.randint(1, 6) for _ in range(63)], 3: [3], 4: [50, 60], 5: [0, 0, 2]}
    df = spark.createDataFrame([(q, k + 1, m, True) for q, own in plans.items() for k, m in enumerate(own)] + [(6, 1, 2, False)], "question_id int, ord int, marks int, is_valid boolean")
    got = {(r.question_id, r.n_parts): (wide.mask_of(r.words), r.marks) for r in wide.prefixes(df).collect()}
    assert got == {(q, n): ((1 << n) - 1, sum(own[:n])) for q, own in plans.items() for n in range(1, len(own) + 1)}
    pins = spark.createDataFrame([(1, wide.words_of(1 << 199 | 1)), (2, wide.words_of(1 << 63)), (3, []), (9, [1])], "question_id int, words array<long>")
    got = {r.question_id: wide.mask_of(r.words) for r in wide.covering_options(df, pins).collect()}
    assert got == {1: 1 << 199 | 1, 2: (1 << 63) - 1, 3: 1}
    best = {r.question_id: (r.marks, r.n_parts, wide.mask_of(r.words)) for r in wide.best_options(df, 40).collect()}
    assert set(best) == {1, 2, 3, 5} and best[1][0] == best[2][0] == 40 and best[3] == (3, 1, 1)
    # most leaves of 40 marks: the smallest leaves first
    for q in (1, 2):
        own = plans[q]
        assert sum(m for k, m in enumerate(own) if best[q][2] >> k & 1) == 40
        total, n = 0, 0
        for m in sorted(own):
            if total + m > 40:
                break
            total, n = total + m, n + 1
        assert best[q][1] == n
    held = df.join(wide.best_options(df, 40).select("question_id", "words"), "question_id").filter(wide.holds("words", df["ord"] - 1))
    assert {r.question_id: r[1] for r in held.groupBy("question_id").sum("marks").collect()} == {q: x[0] for q, x in best.items()}


def test_best_within_equals_all_subsets():
    rng = random.Random(5)
    for _ in range(150):
        own, most = [rng.randint(0, 7) for _ in range(rng.randint(1, 9))], rng.randint(0, 20)
        subsets = [(sum(own[k] for k in c), len(c), -sum(1 << k for k in c)) for n in range(1, len(own) + 1) for c in combinations(range(len(own)), n)]
        want = max((x for x in subsets if x[0] <= most), default=(0, 0, 0))
        assert wide.best_within(own, most) == -want[2]


def test_narrow_questions_have_the_same_options(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(q, k + 1, rng.randint(1, 6), rng.random() < 0.8) for q in range(30) for k in range(rng.randint(1, 8))], "question_id int, ord int, marks int, is_valid boolean")
    mask = lambda rows: sorted((r.question_id, wide.mask_of(r.words), r.marks) for r in rows.collect())
    plain = lambda rows: sorted((r.question_id, r.mask, r.marks) for r in rows.collect())
    assert mask(wide.prefixes(df)) == plain(selection.options(df, "PRUNE"))
    assert mask(wide.best_options(df, 9)) == plain(selection.best_of_leaves(df, 9))


def test_masks_of_words():
    for mask in (0, 1, 1 << 61, 1 << 62, (1 << 200) - 1, 1 << 124 | 5):
        assert wide.mask_of(wide.words_of(mask)) == mask and all(0 <= w < 1 << 62 for w in wide.words_of(mask))


def test_narrow_masks_still_fail_beyond_their_bits(spark):
    df = spark.createDataFrame([(1, k, 1, True) for k in range(63)], "question_id int, ord int, marks int, is_valid boolean")
    with pytest.raises(Exception, match="wide"):
        selection.options(df, "PRUNE").collect()


def test_prefixes_and_best_options_of_very_wide_questions(spark):
    """Prefixes are windows and not Python lists; the best option brings few of the leaves together."""
    df = spark.range(20000).selectExpr("1 question_id", "id ord", "cast(id * 7 % 6 + 1 as int) marks", "true is_valid")
    plan = wide.prefixes(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "MapInArrow" not in plan
    own = [r.marks for r in df.orderBy("ord").collect()]
    best = wide.best_options(df, 40).collect()[0]
    assert wide.mask_of(best.words) == wide.best_within(own, 40) and (best.marks, best.n_parts) == (40, 40)
    assert "Window" in wide.best_options(df, 40)._jdf.queryExecution().executedPlan().toString()
