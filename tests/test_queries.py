from __future__ import annotations

import pytest

from quillmark import catalogue
from tests.conftest import SF
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, name):
    same(catalogue.QUERIES[name](spark, SF), catalogue.SQL[name], SF)


def test_every_query_but_the_listed_ones_has_sql():
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"full_selection", "selection_all", "selection_prune", "selection_skip", "selection_keywords"}


def test_prune_across_plans_against_a_plain_loop(spark):
    from quillmark.plans.selection_queries import _RUN
    from quillmark.sources.corpus import parts, questions

    p = parts(spark, SF).join(questions(spark, SF).select("question_id", *_RUN), "question_id")
    runs: dict = {}
    for r in p.collect():
        runs.setdefault((r.exam_code, r.year), []).append((r.marks, r.question_id, r.ord, r.ord == 1))
    want = set()
    for run, leaves in runs.items():
        total, left, stop = sum(x[0] for x in leaves), {x[1:3] for x in leaves}, False
        for m, q, k, kept in sorted(leaves):
            if stop or total <= 32 or kept or sum(1 for a, _ in left if a == q) <= 1:
                continue
            if abs(total - m - 30) > abs(total - 30):
                stop = True
                continue
            total -= m
            left.discard((q, k))
        want |= {(*run, *x) for x in left}
    got = {(r.exam_code, r.year, r.question_id, r.ord) for r in catalogue.QUERIES["prune_across_plans"](spark, SF).collect()}
    assert got == want


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_whole_queries_leave_no_question_out(spark):
    from quillmark.sources.corpus import parts

    n = parts(spark, SF).count()
    for name in ("atomic_groups", "composite_offsets", "page_points", "composition"):
        assert catalogue.QUERIES[name](spark, SF).count() == n
    ids = parts(spark, SF).select("question_id").distinct().count()
    for name in ("question_pages", "prune_across_plans"):
        assert catalogue.QUERIES[name](spark, SF).select("question_id").distinct().count() == ids
