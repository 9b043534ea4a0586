"""Connected components of a graph of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import by_weight, forget, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node it is connected to.

    Each round a node takes the least label among its neighbours, tells it to the node that its
    own label names, and then takes the label of its label, so the number of rounds is about
    the logarithm of a component's size.  Labels are written to the shared
    folder every round, so lineage stays short and lost executors cost one round.  The labels
    of nodes with very many edges are sent to where the edges are (``by_weight``), and what a
    node hears is reduced to its minimum before it is shuffled.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    nodes = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"), F.count("*").alias("edges")), "nodes")
    heavy = written(nodes.filter(F.col("edges") > 4096).select("node", "edges"), "heavy")
    labels = written(nodes.select("node", F.least("node", "b").alias("label")), "labels")
    forget(nodes)
    many = not heavy.isEmpty()
    before = None
    for _ in range(rounds):
        total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == before:
            break
        before = total
        if many:
            told = labels.join(heavy, "node", "left").select(F.col("node").alias("b"), "label", F.coalesce("edges", F.lit(0)).alias("edges"))
            near = by_weight(both, told, "b", "edges")
        else:
            near = both.join(labels.select(F.col("node").alias("b"), "label"), "b")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label"))
        # a node passes what it hears on to the node that its own label names
        heard = labels.withColumnRenamed("label", "own").join(near, "node").filter("label < own")
        hook = heard.select(F.col("own").alias("node"), "label")
        least = labels.unionByName(heard.select("node", "label")).unionByName(hook).groupBy("node").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = written(least.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        forget(labels)
        labels = new
    else:
        raise RuntimeError("components did not settle")
    forget(both, heavy)
    return labels
