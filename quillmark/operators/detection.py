"""Labels, marks and bounds from text spans, and trees over label paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.cells import by_cells


def section_labels(spans: DataFrame, page_width: float, left: float = 0.35) -> DataFrame:
    """Spans that begin with a bracketed label in the left part of the page; i, v and x are never letters."""
    label = F.regexp_extract("text", r"^\s*\(([a-z]+)\)", 1)
    kind = F.when(label.rlike("^[ivx]+$"), "roman").when(F.length(label) == 1, "letter")
    return spans.filter(F.col("x0") < page_width * left).withColumns({"label": label, "kind": kind}).filter(F.col("kind").isNotNull())


def mark_boxes(spans: DataFrame, key: str, page_width: float, order: str, slack: float = 0.9) -> DataFrame:
    """Spans with a one- or two-digit mark in square brackets, as ``value``.

    The first of them in the right half of the page is the anchor; marks well left of it go.
    """
    value = F.nullif(F.regexp_extract("text", r"\[(\d{1,2})\]", 1), F.lit("")).cast("int")
    found = spans.withColumn("value", value).filter(F.col("value").isNotNull())
    anchor = F.min_by("x0", F.when(F.col("x0") >= page_width / 2, F.col(order))).over(Window.partitionBy(key))
    return found.withColumn("anchor", anchor).filter(F.col("anchor").isNull() | (F.col("x0") >= slack * F.col("anchor"))).drop("anchor")


def right_edges(parts: DataFrame, marks: DataFrame, key: str, width: int, padding: int, slack: int = 50) -> DataFrame:
    """Each part's right edge: that of the first mark from its top to ``slack`` below its bottom, padded; else the width.

    parts: key, ord, top, bottom; marks: key, y, edge, mark_ord.
    """
    p = parts.select(key, "ord", "top", (F.col("bottom") + slack).alias("__low"))
    hit = by_cells(p, marks.select(key, "y", "edge", "mark_ord"), key, "top", "__low", "y", "y").unionByName(p, allowMissingColumns=True)
    return hit.groupBy(key, "ord").agg(F.coalesce(F.least(F.lit(width), F.min_by("edge", "mark_ord") + padding), F.lit(width)).alias("right"))


def ancestors(label: Column) -> Column:
    """Paths of a label's ancestors, root first: '1(a)(ii)' gives '1' and '1(a)'."""
    tokens = F.split(label, r"\(")
    return F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda k: F.array_join(F.slice(tokens, F.lit(1), k), "("))


def proper_ancestors(label: Column) -> Column:
    paths = ancestors(label)
    return F.slice(paths, F.lit(1), F.size(paths) - 1)


def leaves(nodes: DataFrame, key: str, label: str) -> DataFrame:
    """Nodes that no other label continues."""
    parents = nodes.select(F.col(key), F.explode(proper_ancestors(F.col(label))).alias(label)).distinct()
    return nodes.join(parents, [key, label], "left_anti")


def descendants(nodes: DataFrame, picked: DataFrame, key: str, label: str) -> DataFrame:
    """Picked nodes and all nodes below them: an equality on exploded ancestor paths, not a prefix scan."""
    paths = nodes.select(F.col(key), F.col(label), F.explode(ancestors(F.col(label))).alias("__path"))
    return paths.join(picked.select(F.col(key), F.col(label).alias("__path")).distinct(), [key, "__path"], "left_semi").select(key, label).distinct()


def tree_marks(leaf_marks: DataFrame, key: str, label: str) -> DataFrame:
    """Marks of every node: a leaf's own, else the sum of the leaves below; with where they come from."""
    up = leaf_marks.select(F.col(key), F.col(label).alias("leaf"), "marks", F.explode(ancestors(F.col(label))).alias(label))
    return up.groupBy(key, label).agg(F.sum("marks").alias("marks"), F.when(F.max(F.col("leaf") == F.col(label)), "explicit").otherwise("aggregate").alias("source"))


def overlapping_siblings(parts: DataFrame, key: str) -> DataFrame:
    """Pairs (a < b) of a question's parts whose half-open ranges top..bottom overlap."""
    a = parts.select(F.col(key), F.col("ord").alias("a"), F.col("top").alias("t1"), F.col("bottom").alias("b1"))
    b = parts.select(F.col(key), F.col("ord").alias("b"), F.col("top").alias("t2"), F.col("bottom").alias("b2"))
    return a.join(b, key).filter((F.col("a") < F.col("b")) & ~((F.col("b1") <= F.col("t2")) | (F.col("b2") <= F.col("t1")))).select(key, "a", "b")


def page_offsets(labels: DataFrame, key: str, page: str, x: str) -> DataFrame:
    """By page: mean x minus that of the page before, cut to a whole number; 0 for the first."""
    mean = labels.groupBy(key, page).agg(F.avg(x).alias("mean"))
    before = F.lag("mean").over(Window.partitionBy(key).orderBy(page))
    return mean.select(key, page, F.coalesce((F.col("mean") - before).cast("int"), F.lit(0)).alias("offset"))


def discovered_plugins(manifests: DataFrame) -> DataFrame:
    """First manifest of each valid code by path, with ``is_default``: the last flagged one, else the smallest code.

    Codes are one to ten letters or digits, names not blank.
    """
    good = manifests.filter(F.col("code").rlike("^[A-Za-z0-9]{1,10}$") & (F.trim("name") != ""))
    first = good.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("path"))).filter("r = 1").drop("r")
    chosen = first.agg(F.coalesce(F.max_by("code", F.when(F.col("flagged"), F.col("path"))), F.min("code")).alias("chosen"))
    return first.crossJoin(F.broadcast(chosen)).withColumn("is_default", F.col("code") == F.col("chosen")).drop("chosen")


def composed(plans: DataFrame, run: list[str]) -> DataFrame:
    """Sequence number of each question in its run, and which row carries the header and the context slice."""
    number = F.dense_rank().over(Window.partitionBy(*run).orderBy("question_id"))
    nth = F.row_number().over(Window.partitionBy(*run, "question_id").orderBy("ord"))
    return plans.withColumns({"seq": number, "has_header": nth == 1})
