"""What queries move and leave on disk."""

from __future__ import annotations

import pytest

import __spark_entry__ as e
from pyspark.sql import functions as F
from quillmark.operators import bounds, reports
from quillmark.operators import selection_pass as sp
from quillmark.operators.storage import kept
from tests.conftest import SF
from tests.oracle import same


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for k in range(files.length()) if (f := files.apply(k).getName()).startswith("shuffle_")}


def test_written_tables_leave_no_shuffle(spark):
    held = _shuffle_files(spark)
    t = kept(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert t.count() == 7
    left = {f.split("_")[1] for f in _shuffle_files(spark) - held}
    assert len(left) <= 1  # that of the count


@pytest.mark.parametrize("name", ["context_lookup", "tree_problems"])
def test_one_shuffle_of_the_leaves(spark, name):
    df = e.queries()[name](spark, SF)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    same(df, e.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", ["inline_bounds", "part_tree_sizes", "part_tree_round_trip", "selection_pins"])
def test_staged_leaves_give_the_sql_rows(spark, name):
    same(e.queries()[name](spark, SF), e.oracle_sql()[name], SF)


def test_repeated_and_null_labels_keep_their_contexts_and_problems(spark):
    n = spark.createDataFrame([(1, "r", [], True), (1, "a", ["r"], True), (1, "a", ["r"], True), (1, "i", ["r", "a"], False), (1, None, ["r"], True), (2, "r", None, True)], "question_id long, label string, path array<string>, has_context boolean")
    got = sorted((r.question_id, r.label or "", r.contexts) for r in reports.contexts_of(n).collect())
    assert got == [(1, "", []), (1, "a", ["r", "r"]), (1, "a", ["r", "r"]), (1, "i", ["r", "a", "a"]), (1, "r", []), (2, "r", [])]
    t = spark.createDataFrame([(1, "r", None, 1, 0, 9), (1, "r", None, 1, 0, 5), (1, "x", "r", -1, 2, 10), (1, "y", "r", 1, 3, 4)], "question_id long, label string, parent string, marks int, top long, bottom long")
    got = sorted((r.label, r.problem) for r in bounds.tree_problems(t).collect())
    assert got == [("r", "repeated"), ("x", "negative marks"), ("x", "outside its parent"), ("x", "outside its parent"), ("y", "overlaps")]


def test_score_of_all_leaves_is_that_of_the_options(spark):
    leaf = [{"ord": k + 1, "marks": m, "topic": t, "usable": True} for k, (m, t) in enumerate([(3, "A"), (4, None), (2, "B")])]
    df = spark.createDataFrame([(7, leaf, "A"), (8, leaf, "C")], "question_id long, leaf array<struct<ord:int,marks:int,topic:string,usable:boolean>>, topic string")
    got = [r.s for r in df.orderBy("question_id").select(sp._whole_score(42, F.lit(9), F.lit(20), F.lit(2)).alias("s")).collect()]
    want = sp.coverage_option(sp.question_options(leaf, "ALL", 20), leaf, "A", 20, 2, 42, 7)
    assert got[1] is None and abs(got[0] - want[0]) < 1e-9
