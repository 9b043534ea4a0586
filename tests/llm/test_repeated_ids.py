from __future__ import annotations

from collections import Counter

from quillmark.llm.common import by_weight
from quillmark.llm.components import components
from quillmark.llm.jaccard_join import similarity_components


def shingle_set(text):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def by_hand(rows):
    sets = [shingle_set(t) for _, t in rows]
    link = [[i != j and bool(a) and bool(b) and 100 * len(a & b) >= 85 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    out = []
    for i, (key, _) in enumerate(rows):
        seen, stack = {i}, [i]
        while stack:
            k = stack.pop()
            for j in range(len(rows)):
                if link[k][j] and j not in seen:
                    seen.add(j)
                    stack.append(j)
        out.append((key, len(sets[i]), min(rows[j][0] for j in seen), sum(link[i])))
    return Counter(out)


def test_rows_that_repeat_an_id_with_different_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, a + " x"), (5, c), (2, c), (2, c + " z"), (6, ""), (6, None), (7, "one"), (7, "two words"), (7, "one"), (1, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in similarity_components(df, 4, 85, 100, count_links=True).collect())
    assert got == by_hand(rows)
    plain = Counter((r.doc_id, r.n_shingles, r.component_id) for r in similarity_components(df, 4, 85, 100).collect())
    assert plain == Counter(x[:3] for x in got.elements())


def test_a_large_class_of_copies_is_joined_without_gathering_it(spark):
    """100,000 equal rows: what is known of their class reaches them where they are, in many tasks."""
    left = spark.range(120_000, numPartitions=16).selectExpr("id", "if(id < 100000, -1, id) as k")
    right = left.groupBy("k").count().withColumnRenamed("count", "n")
    out = by_weight(left, right, "k", "n")
    assert out.count() == 120_000 and out.filter("k = -1 and n = 100000").count() == 100_000
    held = [r[0] for r in out.filter("k = -1").selectExpr("spark_partition_id() as p").groupBy("p").count().select("count").collect()]
    assert len(held) >= 8 and max(held) <= 20_000


def test_components_with_a_hot_node(spark):
    star = spark.range(1, 6000).selectExpr("0L as a", "id as b").union(spark.range(6000, 6020).selectExpr("id as a", "id + 1 as b")).union(spark.createDataFrame([(5999, 7000)], "a long, b long"))
    got = {r.node: r.label for r in components(star).collect()}
    assert got == {**{k: 0 for k in range(6000)}, 7000: 0, **{k: 6000 for k in range(6000, 6021)}}
