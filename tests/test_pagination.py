"""Break pointers and pointer jumping against a plain loop."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmark.operators import layout, pagination


def loop(rows, page_height):
    page, y, out = 1, 0, []
    for h, gap in rows:
        top = y + gap if y else 0
        if y and top + h > page_height:
            page, top = page + 1, 0
        out.append((page, top))
        y = top + h
    return out


def runs(seed):
    rng = random.Random(seed)
    out = {}
    for r in range(14):
        n = rng.choice([1, 2, 7, 8, 9, 40, 120])
        high = rng.choice([6, 30, 130])
        zero = rng.choice([0.0, 0.2, 0.9])
        gap = rng.choice([lambda: 0, lambda: 10, lambda: rng.choice([5, 20])])
        out[r] = [(0 if rng.random() < zero else rng.randint(1, high), gap()) for _ in range(n)]
    out[90] = [(0, 10)] * 30
    out[91] = [(200, 10)] * 20
    out[92] = [(1, 0)] * 350
    out[93] = [(0, 3)] * 17 + [(100, 0)] + [(0, 0)] * 20 + [(1, 0)] + [(0, 0)] * 9 + [(500, 7)] + [(0, 0)] * 25 + [(0, 1)]
    return out


@pytest.mark.parametrize("block, seed", [(4096, 1), (8, 1), (8, 2), (3, 3)])
def test_pages_equal_a_plain_loop(spark, block, seed):
    own = runs(seed)
    df = spark.createDataFrame([(str(r), r, k, h, g) for r, rows in own.items() for k, (h, g) in enumerate(rows)], "name string, run int, grp int, height int, gap int")
    got = {}
    for r in pagination.paged(df, ["name", "run"], 100, block).collect():
        assert r.name == str(r.run) and got.setdefault((r.run, r.grp), (r.page, r.top)) == (r.page, r.top)
    assert got == {(r, k): x for r, rows in own.items() for k, x in enumerate(loop(rows, 100))}


def test_long_runs_are_laid_out_in_blocks(spark):
    """60,000 groups of one run, of which no task gets more than a block."""
    df = spark.range(60_000).selectExpr("'r' as run", "cast(id as int) as grp", "cast(id * id % 97 + 1 as int) as height", "cast(id % 3 * 5 as int) as gap")
    got = [(r.page, r.top) for r in pagination.paged(df, ["run"], 500).orderBy("grp").collect()]
    assert got == loop([(k * k % 97 + 1, k % 3 * 5) for k in range(60_000)], 500)


def test_oversize_groups_are_told(spark):
    df = spark.createDataFrame([("a", 1, 90), ("a", 2, 101), ("b", 1, 300)], "run string, grp int, height int")
    got = {tuple(r) for r in pagination.oversize(df, ["run"], 100).collect()}
    assert got == {("a", 2, 101, 1, "group 2 is 1 higher than a page"), ("b", 1, 300, 200, "group 1 is 200 higher than a page")}


@pytest.fixture
def many_tasks(spark):
    """Small tables take several tasks, as large ones do."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, was)


def test_groups_and_offsets_of_a_run_go_through_many_tasks(spark, many_tasks):
    """Against a plain loop; questions in turns, one of null, runs of null, and no task with more than half of the long run."""
    rng = random.Random(3)
    own = {"long": 6000, "short": 5, None: 300, "one": 1}
    rows = [(r, k * 3, None if rng.random() < 0.02 else k // 7 if rng.random() < 0.8 else -1, rng.randint(1, 90), rng.choice([True, False, True, None])) for r, n in own.items() for k in range(n)]
    df = spark.createDataFrame(rows, "run string, ord int, question_id int, height int, sticky boolean").repartition(3)
    want, offsets, last, grp, n, y = {}, {}, None, 0, 0, 0
    for run, k, q, h, sticky in rows:
        grp, n, y = (grp, n, y) if last and last[0] == run else (0, 0, 0)
        grp += not (last and last[0] == run and last[2] and q is not None and last[1] == q)
        n += 1
        want[run, k], offsets[run, k] = (grp, n), (y, n)
        y, last = y + h, (run, q, sticky)
    got = layout.atomic_groups(df, ["run"], F.col("sticky"), number="n").withColumn("task", F.spark_partition_id()).collect()
    assert {(r.run, r.ord): (r.grp, r.n) for r in got} == want and len(got) == len(rows)
    below = layout.composite_offsets(df, ["run"], "ord", "height", "n").withColumn("task", F.spark_partition_id()).collect()
    assert {(r.run, r.ord): (r.y_offset, r.n) for r in below} == offsets and len(below) == len(rows)
    for out in (got, below):
        assert max(Counter(r.task for r in out if r.run == "long").values()) <= 3000
