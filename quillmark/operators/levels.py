"""Part trees of any depth, folded level by level.

Nodes are rows (question_id, label, parent, ...), the parent null for a root.  Levels are found
from the roots down; folds go from the deepest level up, one join of neighbouring levels each.
Nodes that no root leads to are in no level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.storage import kept, release

_FIELDS = "label string, kind string, marks int, bounds struct<top:bigint,bottom:bigint>, topic string, children array<string>"


def _level(df: DataFrame) -> DataFrame:
    """A level as a table that is never sent to all tasks: its files are small for their rows, so Spark would pass millions of rows through the driver."""
    table = kept(df)
    out = table.hint("merge")
    out.quillmark_path = table.quillmark_path
    return out


def levels(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of each depth, roots first; a node whose parent's label is repeated is in the first level that has it.

    What has its level is not looked at again, and the last level needs no join to be known as such.
    """
    nodes = _level(nodes)
    path = nodes.quillmark_path
    out, now, rest = [], nodes.filter("parent is null"), nodes.filter("parent is not null")
    while not now.isEmpty():
        now.quillmark_path = path
        out.append(now)
        if rest.isEmpty():
            break
        above = now.select("question_id", F.col("label").alias("parent")).distinct().withColumn("__in", F.lit(True))
        step = _level(rest.join(above, ["question_id", "parent"], "left").select(*nodes.columns, F.col("__in").isNotNull().alias("__in")))
        path, now, rest = step.quillmark_path, step.filter("__in").drop("__in"), step.filter("not __in").drop("__in")
    return out


def fold(nodes: DataFrame, below: Callable[[DataFrame], DataFrame], own: Callable[[DataFrame], DataFrame], empty: dict[str, str], roots: bool = False) -> DataFrame:
    """All nodes after a fold from the deepest level up; with ``roots`` those alone, and no other level stays on disk.

    ``below`` sums up a folded level by parent, as (question_id, label, more ...); ``own`` folds a
    level that has these columns, which are null (types in ``empty``) where there are no children.
    """
    done, out = None, None
    for level in reversed(levels(nodes)):
        source = level
        if done is None:
            level = level.withColumns({name: F.lit(None).cast(kind) for name, kind in empty.items()})
        else:
            level = level.join(below(done), ["question_id", "label"], "left")
        deeper, done = done, _level(own(level))
        # what a level was read from is folded by now
        release(source)
        if roots and deeper is not None:
            release(deeper)
        out = done if out is None or roots else out.unionByName(done)
    return out if out is not None else own(nodes.withColumns({name: F.lit(None).cast(kind) for name, kind in empty.items()})).limit(0)


def built_marks(nodes: DataFrame) -> DataFrame:
    """(question_id, label, marks, source, right): explicit marks, else the sum of the children's, else 0; the least right edge of the leaves below.

    nodes: question_id, label, parent, marks (null: none), right.
    """

    def below(df: DataFrame) -> DataFrame:
        return df.groupBy("question_id", F.col("parent").alias("label")).agg(F.sum("marks").cast("int").alias("__s"), F.min("right").alias("__r"))

    def own(df: DataFrame) -> DataFrame:
        source = F.when(F.col("marks").isNotNull(), "explicit").when(F.col("__s").isNotNull(), "aggregate").otherwise("inferred")
        return df.select("question_id", "label", "parent", F.coalesce("marks", "__s", F.lit(0)).alias("marks"), source.alias("source"), F.coalesce("__r", "right").alias("right"))

    right = nodes.schema["right"].dataType.simpleString()
    return fold(nodes.select("question_id", "label", "parent", "marks", "right"), below, own, {"__s": "int", "__r": right}).drop("parent")


def climbed_topics(nodes: DataFrame, known: Column) -> DataFrame:
    """Adds ``resolved``: a parent without a topic takes the first known one below it in document order; then a child between two that agree takes theirs.

    nodes: question_id, label, parent, topic, top.
    """

    def below(df: DataFrame) -> DataFrame:
        return df.groupBy("question_id", F.col("parent").alias("label")).agg(F.min_by("__t", F.when(F.col("__t").isNotNull(), F.struct("top", "label"))).alias("__c"))

    rows = fold(nodes.withColumn("__t", F.when(known, F.col("topic"))), below, lambda df: df.withColumn("__t", F.coalesce("__t", "__c")).drop("__c"), {"__c": "string"})
    w = Window.partitionBy("question_id", "parent").orderBy("top", "label")
    sides = rows.withColumn("__b", F.lag("__t").over(w)).withColumn("__a", F.lead("__t").over(w))
    return sides.withColumn("resolved", F.coalesce("__t", F.when((F.col("__b") == F.col("__a")) & F.col("parent").isNotNull(), F.col("__b")))).drop("__t", "__b", "__a")


def first_not_inline(nodes: DataFrame) -> DataFrame:
    """(question_id, top): the top of the root's first child, of its first child where it stands in the parent's line, and so on.

    nodes: question_id, label, parent, inline, top.  A child in line that has no children gives
    its own top.  Roots without children are left out.
    """
    first = _level(nodes.filter("parent is not null").groupBy("question_id", "parent").agg(F.min_by(F.struct("label", "inline", "top"), F.struct("top", "label")).alias("x")))
    now = _level(nodes.filter("parent is null").select("question_id", F.col("label").alias("parent")).join(first, ["question_id", "parent"]).select("question_id", "x.*"))
    done = now.filter("not inline").select("question_id", "top")
    now = now.filter("inline")
    while not now.isEmpty():
        step = now.withColumnRenamed("label", "parent").join(first, ["question_id", "parent"], "left")
        step = _level(step.select("question_id", F.col("top").alias("__top"), "x"))
        done = done.unionByName(step.filter("x is null").select("question_id", F.col("__top").alias("top"))).unionByName(step.filter("x is not null and not x.inline").select("question_id", "x.top"))
        now = step.filter("x.inline").select("question_id", "x.*")
    return done


def encoded(nodes: DataFrame) -> DataFrame:
    """(question_id, tree): one JSON document per root, nulls and empty lists of children left out.

    nodes: question_id, label, parent (null: root), kind, marks, top, bottom, topic.  Children
    stand in order of (top, label).
    """

    def below(df: DataFrame) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct("top", "label", "tree")))
        return df.groupBy("question_id", F.col("parent").alias("label")).agg(F.array_join(F.transform(listed, lambda x: x["tree"]), ",").alias("__c"))

    def own(df: DataFrame) -> DataFrame:
        node = F.to_json(F.struct("label", "kind", "marks", F.struct("top", "bottom").alias("bounds"), "topic"))
        with_children = F.concat(F.expr("substring(__n, 1, length(__n) - 1)"), F.lit(',"children":['), F.col("__c"), F.lit("]}"))
        return df.withColumn("__n", node).select("question_id", "label", "parent", "top", F.when(F.col("__c").isNull(), F.col("__n")).otherwise(with_children).alias("tree"))

    return fold(nodes, below, own, {"__c": "string"}, roots=True).filter("parent is null").select("question_id", "tree")


def decoded(trees: DataFrame) -> DataFrame:
    """The nodes of ``encoded``: question_id, label, parent, kind, marks, top, bottom, topic, ``problem``.

    A level at a time: children stay JSON text until their own level is read.  ``problem`` says
    what is wrong with a node: no JSON object, no label, negative marks, or bounds that end before
    they begin; its children are read all the same.
    """
    out, now = None, trees.select("question_id", F.lit(None).cast("string").alias("parent"), F.col("tree").alias("__j"))
    while not now.isEmpty():
        read = kept(now.select("question_id", "parent", F.from_json("__j", _FIELDS).alias("x")))
        problem = (
            F.when(F.col("x").isNull() | F.forall(F.array(*[F.col(f"x.{c}").isNull() for c in ("label", "kind", "marks", "bounds", "topic", "children")]), lambda n: n), "no object")
            .when(F.col("x.label").isNull(), "no label").when(F.col("x.marks") < 0, "negative marks").when(F.col("x.bounds.bottom") < F.col("x.bounds.top"), "bounds")
        )
        rows = read.select("question_id", "x.label", "parent", "x.kind", "x.marks", "x.bounds.top", "x.bounds.bottom", "x.topic", problem.alias("problem"))
        out = rows if out is None else out.unionByName(rows)
        now = read.select("question_id", F.col("x.label").alias("parent"), F.explode("x.children").alias("__j"))
    return out if out is not None else trees.select("question_id", *[F.lit(None).cast(k).alias(n) for n, k in (("label", "string"), ("parent", "string"), ("kind", "string"), ("marks", "int"), ("top", "long"), ("bottom", "long"), ("topic", "string"), ("problem", "string"))]).limit(0)


def tree_checks(trees: DataFrame) -> DataFrame:
    """(question_id, label, problem) of decoded documents: what ``decoded`` finds, repeated labels, and labels that do not continue their parent's."""
    nodes = kept(decoded(trees))
    own = nodes.filter("problem is not null").select("question_id", "label", "problem")
    twice = nodes.filter("label is not null").groupBy("question_id", "label").count().filter("count > 1").select("question_id", "label", F.lit("repeated").alias("problem"))
    strange = nodes.filter("parent is not null and label is not null and not startswith(label, parent)").select("question_id", "label", F.lit("not below its parent").alias("problem"))
    return own.unionByName(twice).unionByName(strange)
