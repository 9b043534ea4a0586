"""Writers at once lose nothing, and readers find whole versions."""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import functions as F

from quillmark.operators import search
from quillmark.operators.numbering import numbered
from quillmark.sources import versions

SCHEMA = "question_id string, v int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_two_appends_at_once_add_every_key_once(spark, tmp_path):
    path, failed, seen, done = str(tmp_path / "c"), [], [], threading.Event()
    batches = [[(str(k), w) for k in range(w * 10, w * 10 + 25)] * 2 for w in range(4)]

    def write(rows):
        try:
            versions.append_new(spark, frame(spark, rows), path)
        except Exception as e:
            failed.append(e)

    def watch():
        while not done.is_set():
            try:
                seen.append(versions.Versions(spark, path).read(SCHEMA).count())
            except Exception as e:
                failed.append(e)

    writers = [threading.Thread(target=write, args=(b,)) for b in batches]
    reader = threading.Thread(target=watch)
    for t in [reader, *writers]:
        t.start()
    for t in writers:
        t.join()
    done.set()
    reader.join()
    assert not failed
    got = Counter(r.question_id for r in versions.Versions(spark, path).read(SCHEMA).collect())
    assert got == Counter({str(k): 1 for k in range(55)})
    assert seen == sorted(seen) and set(seen) <= {0, 25, 35, 45, 50, 55}


def test_upserts_and_lost_commits(spark, tmp_path):
    path = str(tmp_path / "u")
    assert versions.Versions(spark, path).read(SCHEMA).count() == 0
    versions.upsert(spark, frame(spark, [("a", 1), ("b", 2)]), path)
    at = versions.Versions(spark, path)
    number, folders = at.current()
    # another writer comes in between reading and committing
    first = []

    def step(own):
        rows = versions.upserted(at.read(SCHEMA, own), frame(spark, [("a", 9)]), "question_id")
        if not first:
            first.append(1)
            versions.append_new(spark, frame(spark, [("c", 3), ("a", 0), (None, 7)]), path)
        return rows, []

    at.change(step)
    assert {tuple(r) for r in at.read(SCHEMA).collect()} == {("a", 9), ("b", 2), ("c", 3)}
    assert not at.commit(number, folders) and at.commit(at.current()[0] + 1, folders)
    assert {tuple(r) for r in at.read(SCHEMA).collect()} == {("a", 1), ("b", 2)}
    assert at.vacuum() and {tuple(r) for r in at.read(SCHEMA).collect()} == {("a", 1), ("b", 2)}


def test_places_over_ranges(spark):
    df = spark.range(5000).selectExpr("id", "id * 7919 % 5003 as x", "id % 3 = 0 as p").repartition(7)
    got = {r.id: r.place for r in numbered(df, [F.desc("p"), F.col("x")]).collect()}
    rows = sorted(df.collect(), key=lambda r: (not r.p, r.x))
    assert got == {r.id: k for k, r in enumerate(rows, 1)}


def test_stratified_sample_equals_a_rank_of_all(spark):
    rows = [(k, "abcd"[min(3, k % 10 // 2)] if k > 3 else "rare") for k in range(900)]
    df = spark.createDataFrame(rows, "k int, s string").repartition(5)
    import hashlib

    for size in (3, 17, 400, 2000):
        order = sorted(rows, key=lambda r: (hashlib.md5(f"5:{r[0]}".encode()).hexdigest(), r[0]))
        quota, taken, late = max(1, size // 5), [], []
        count: Counter = Counter()
        for r in order:
            (taken if count[r[1]] < quota else late).append(r)
            count[r[1]] += 1
        got = {tuple(r) for r in search.stratified_sample(df, "s", "k", size, 5).collect()}
        assert got == set((taken + late)[:size])
