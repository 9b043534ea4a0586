"""Extents of labels, bounds of parts, clusters of values, and what a tree's bounds must satisfy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.geometry import contains, is_above, overlaps
from quillmark.operators.cells import by_cells
from quillmark.operators.detection import right_edges
from quillmark.operators.levels import built_marks, climbed_topics  # noqa: F401
from quillmark.operators.storage import kept


def label_extents(labels: DataFrame, key: str, height: Column) -> DataFrame:
    """Adds ``y_end``: letters end where the next letter begins, romans where the next one of their letter or that letter ends; else the height.

    labels: key, kind (letter, roman), y, ord.  A roman belongs to the last letter at or above it,
    to the first one where none is.
    """
    by_key = Window.partitionBy(key).orderBy("y", F.when(F.col("kind") == "letter", 0).otherwise(1), "ord")
    group = F.greatest(F.lit(1), F.count_if(F.col("kind") == "letter").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    rows = labels.withColumn("__g", group).withColumn("__h", height)
    letters = rows.filter("kind = 'letter'").withColumn("y_end", F.coalesce(F.lead("y").over(Window.partitionBy(key).orderBy("y", "ord")), "__h"))
    ends = letters.groupBy(key, "__g").agg(F.max("y_end").alias("__e"))
    romans = rows.filter("kind = 'roman'").join(ends, [key, "__g"], "left")
    romans = romans.withColumn("y_end", F.coalesce(F.lead("y").over(Window.partitionBy(key, "__g").orderBy("y", "ord")), "__e", "__h"))
    return letters.drop("__g", "__h").unionByName(romans.drop("__g", "__h", "__e"))


def first_marks(parts: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """Adds ``mark_bottom``: the bottom of the first mark in the order of the list from a part's y to before its y_end; null for none.

    parts: key, ord, y, y_end; marks: key, mark_ord, my, bottom.
    """
    m = marks.select(key, "my", F.col("bottom").alias("__b"), F.col("mark_ord").alias("__m"))
    hit = by_cells(parts, m, key, "y", "y_end", "my", "my").filter(F.col("my") < F.col("y_end")).drop("my")
    # parts without a mark stay; of all rows of a part, those of marks say which is first
    return hit.unionByName(parts, allowMissingColumns=True).groupBy(*parts.columns).agg(F.min_by("__b", "__m").alias("mark_bottom"))


def detected_bounds(parts: DataFrame, marks: DataFrame, key: str, height: int, padding: int = 5, marked: bool = False) -> DataFrame:
    """Adds ``bottom`` and ``issue``: a part ends at its mark, but not beyond its extent; the last one without a mark a little below the lowest mark.

    parts: key, ord, y, y_end.  With ``marked`` the mark's own bottom, ``mark_bottom``, is kept.
    """
    parts = kept(parts)
    lowest = marks.groupBy(key).agg(F.max("bottom").alias("__low"))
    # each step's shuffles are gone before the next begins
    own = kept(first_marks(parts, marks, key)).join(lowest, key, "left")
    last = F.when((F.col("y_end") == height) & F.col("__low").isNotNull(), F.least(F.lit(height), F.col("__low") + padding)).otherwise(F.col("y_end"))
    out = own.withColumn("bottom", F.coalesce(F.least("mark_bottom", F.when(F.col("mark_bottom").isNotNull(), F.col("y_end"))), last))
    return out.withColumn("issue", F.when(F.col("bottom") == height, "No mark box detected")).drop("__low", *([] if marked else ["mark_bottom"]))


def inline_bounds(labels: DataFrame, marks: DataFrame, roots: DataFrame, key: str, height: int, near: int = 10) -> DataFrame:
    """(key, ord, kind, y, bottom, inline, issue): ``detected_bounds``, with letters that their first roman or the root stands in line with.

    labels: key, kind (letter, roman), y, ord; marks as there; roots: key, root_top.  Less than
    ``near`` apart is in line.  A letter with romans ends where the first one begins, or with it
    if they are in line; it is in line itself if that leaves it no height, or if it is so
    with the root.  A roman is in line if it is so with its letter.
    """
    by_key = Window.partitionBy(key).orderBy("y", F.when(F.col("kind") == "letter", 0).otherwise(1), "ord").rowsBetween(Window.unboundedPreceding, 0)
    above = labels.select(key, "ord", F.last(F.when(F.col("kind") == "letter", F.struct(F.col("ord").alias("o"), F.col("y").alias("y"))), True).over(by_key).alias("__l"))
    above = kept(above)
    found = detected_bounds(label_extents(labels, key, F.lit(height)).select(key, "ord", "kind", "y", "y_end"), marks, key, height, marked=True).drop("issue")
    rows = kept(found).join(above, [key, "ord"]).join(roots.select(key, "root_top"), key, "left")
    close = lambda a, b: F.coalesce(F.abs(a - b) < near, F.lit(False))
    rows = kept(rows)
    own_end = F.coalesce(F.least("mark_bottom", F.when(F.col("mark_bottom").isNotNull(), F.col("y_end"))), F.col("y_end"))
    first = rows.filter("kind = 'roman' and __l is not null").groupBy(key, F.col("__l.o").alias("ord")).agg(F.min_by(F.struct(F.col("y").alias("y"), own_end.alias("end")), F.struct("y", "ord")).alias("__r"))
    rows = rows.join(first.withColumn("kind", F.lit("letter")), [key, "ord", "kind"], "left")
    bottom = F.when(F.col("__r").isNull(), F.col("bottom")).when(close(F.col("__r.y"), F.col("y")), F.col("__r.end")).otherwise(F.col("__r.y"))
    rows = rows.withColumn("bottom", bottom)
    flat = F.col("__r").isNotNull() & close(F.col("bottom"), F.col("y"))
    inline = F.when(F.col("kind") == "letter", flat | close(F.col("y"), F.col("root_top"))).otherwise(close(F.col("y"), F.col("__l.y")))
    return rows.select(key, "ord", "kind", "y", "bottom", inline.alias("inline"), F.when(F.col("bottom") == height, "No mark box detected").alias("issue"))


def placed_bounds(parts: DataFrame, marks: DataFrame, key: str, width: int, padding: int = 5) -> DataFrame:
    """``final_bounds`` with ``right``: the first mark's edge near the part, but no further than the rightmost mark's; that one's where the part has none, and the width without any.

    parts: key, ord, y, bottom, label_left; marks: key, y, edge, mark_ord.
    """
    content = marks.groupBy(key).agg((F.max("edge") + padding).alias("__content"))
    edges = right_edges(parts.select(key, "ord", F.col("y").alias("top"), "bottom"), marks, key, (1 << 31) - 1, padding)
    limit = F.coalesce("__content", F.lit(width))
    rows = final_bounds(parts, padding).join(edges, [key, "ord"], "left").join(content, key, "left")
    return rows.withColumn("right", F.least(F.coalesce("right", limit), limit)).drop("__content")


def final_bounds(parts: DataFrame, padding: int = 5) -> DataFrame:
    """Left 5 and top 6 before the label, not below 0; at least one high."""
    left, top = F.greatest(F.lit(0), F.col("label_left") - padding), F.greatest(F.lit(0), F.col("y") - padding - 1)
    return parts.withColumn("left", left).withColumn("top", top).withColumn("bottom", F.greatest("bottom", F.col("top") + 1))


def value_clusters(rows: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Adds ``cluster`` from 0: values in order, a new one where the step from the value before is over the tolerance."""
    w = Window.partitionBy(key).orderBy(value)
    fresh = F.when(F.col(value) - F.lag(value).over(w) > tolerance, 1).otherwise(0)
    steps = rows.select(key, value).distinct().withColumn("__f", fresh).withColumn("cluster", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__f")
    return rows.join(steps, [key, value])


def edges_by_height(marks: DataFrame, keys: list[str], spread: int = 100) -> DataFrame:
    """(keys, y, edge): the greatest right edge of a page's marks, for the heights of those within ``spread`` of it; one row a height."""
    top = F.max("right").over(Window.partitionBy(*keys))
    return marks.withColumn("edge", top).filter(F.col("edge") - F.col("right") <= spread).select(*keys, "y", "edge").distinct()


def question_extents(numerals: DataFrame, doc: str, pages: Column, height: int) -> DataFrame:
    """Adds end_page and end_y: where the next numeral of the document stands, else the end of its last page."""
    following = F.lead(F.struct("page", "y")).over(Window.partitionBy(doc).orderBy("page", "y", "n"))
    return numerals.withColumn("__n", following).withColumn("__p", pages).select(*numerals.columns, F.coalesce("__n.page", "__p").alias("end_page"), F.coalesce("__n.y", F.lit(height)).alias("end_y"))


def region_pairs(regions: DataFrame, key: str) -> DataFrame:
    """(key, a, b, overlaps, above, holds_top): of each region and the next, by half-open ranges."""
    w = Window.partitionBy(key).orderBy("ord")
    nxt = lambda c: F.lead(c).over(w)
    rows = regions.withColumns({"b": nxt("ord"), "__t": nxt("top"), "__b": nxt("bottom")}).filter("b is not null")
    args = (F.col("top"), F.col("bottom"), F.col("__t"), F.col("__b"))
    return rows.select(key, F.col("ord").alias("a"), "b", overlaps(*args).alias("overlaps"), is_above(F.col("bottom"), F.col("__t")).alias("above"), contains(F.col("top"), F.col("bottom"), F.col("__t")).alias("holds_top"))


def tree_problems(nodes: DataFrame) -> DataFrame:
    """(question_id, label, problem): repeated labels, negative marks, children outside their parent, siblings that overlap.

    nodes: question_id, label, parent, marks, top, bottom.
    """
    # ranges overlap an earlier sibling if one of those that begin before ends after the start
    before = F.max("bottom").over(Window.partitionBy("question_id", "parent").orderBy("top", "label").rowsBetween(Window.unboundedPreceding, -1))
    rows = nodes.withColumn("__x", before).withColumn("__self", F.explode(F.array(F.lit(True), F.lit(False))))
    # a node stands with those of its label and once more with those of its parent's: no join, all windows are within questions
    rows = rows.withColumn("__key", F.when(F.col("__self"), F.col("label")).otherwise(F.col("parent"))).filter("__self or __key is not null")
    family = Window.partitionBy("question_id", "__key")
    rows = rows.withColumns({"__n": F.count_if("__self").over(family), "__r": F.row_number().over(family.orderBy(F.desc("__self"))), "__up": F.collect_set(F.when(F.col("__self"), F.struct("top", "bottom"))).over(family)})
    own = F.array(
        F.when((F.col("__n") > 1) & (F.col("__r") == 1), "repeated"),
        F.when(F.col("marks") < 0, "negative marks"),
        F.when(F.col("parent").isNotNull() & (F.col("__x") > F.col("top")), "overlaps"),
    )
    # once for each of the parent's bounds that it is outside of
    outside = F.transform(F.filter("__up", lambda u: (F.col("top") < u["top"]) | (F.col("bottom") > u["bottom"])), lambda u: F.lit("outside its parent"))
    return rows.select("question_id", "label", F.explode(F.array_compact(F.when(F.col("__self"), own).otherwise(outside))).alias("problem"))


def context_slices(leaves: DataFrame, contexts: DataFrame, run: list[str]) -> DataFrame:
    """(run, question_id, ord, slice, top, context) of a composition: each context once, before the first leaf below it.

    leaves: run, question_id, ord, label, parent, top; contexts: question_id, label, top.  Of
    contexts with the same top in a question the first stays; a leaf at its parent's context's
    top is left out, as the context shows it.
    """
    c = contexts.select("question_id", F.col("label").alias("parent"), F.col("top").alias("__ct"))
    rows = leaves.join(c, ["question_id", "parent"], "left")
    firsts = rows.filter("__ct is not null").groupBy(*run, "question_id", "parent").agg(F.min("ord").alias("ord"), F.first("__ct").alias("top"))
    alone = F.row_number().over(Window.partitionBy(*run, "question_id", "top").orderBy("ord", "parent")) == 1
    ctx = firsts.withColumn("__a", alone).filter("__a").select(*run, "question_id", "ord", F.col("parent").alias("slice"), "top", F.lit(True).alias("context"))
    own = rows.filter(F.col("__ct").isNull() | (F.col("__ct") != F.col("top"))).select(*run, "question_id", "ord", F.col("label").alias("slice"), "top", F.lit(False).alias("context"))
    return ctx.unionByName(own)
