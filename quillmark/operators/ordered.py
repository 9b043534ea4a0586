"""Interval joins, as-of joins and ordered analytics within questions or documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.cells import by_cells


def with_extent(df: DataFrame, keys: list[str], order: list[str], start: str, end_of_all: Column, name: str = "y_end") -> DataFrame:
    """Adds where each row ends: the next start within the keys, else ``end_of_all``."""
    return df.withColumn(name, F.coalesce(F.lead(start).over(Window.partitionBy(*keys).orderBy(*order)), end_of_all))


def lowest_in_interval(intervals: DataFrame, points: DataFrame, key: str, start: str, end: str, y: str, value: str, order: str) -> DataFrame:
    """Left join of each interval with the value of its lowest point (greatest y, then order) in [start, end).

    Joined by cells of height, so a key with very many rows is many tasks' work.
    """
    p = points.select(key, F.col(y).alias("__y"), F.col(value).alias("__v"), F.col(order).alias("__o"))
    hit = by_cells(intervals, p, key, start, end, "__y", "__y").filter(F.col("__y") < F.col(end))
    names = intervals.columns
    both = hit.unionByName(intervals, allowMissingColumns=True)
    return both.groupBy(*names).agg(F.max_by("__v", F.when(F.col("__y").isNotNull(), F.struct("__y", "__o"))).alias(value + "_found"))


def asof_parent(children: DataFrame, parents: DataFrame, key: str, order: str, ident: str) -> DataFrame:
    """Each child with the last parent at or before it within the key; the last parent of all where none precedes.

    One sort of the union by (key, order): no join between the two sides.
    """
    a = parents.select(key, order, F.col(ident).alias("parent"), F.lit(None).cast("long").alias("child"), F.lit(0).alias("side"))
    b = children.select(key, order, F.lit(None).cast("long").alias("parent"), F.col(ident).alias("child"), F.lit(1).alias("side"))
    by_key = Window.partitionBy(key)
    before = F.last("parent", True).over(by_key.orderBy(order, "side", F.coalesce("parent", "child")).rowsBetween(Window.unboundedPreceding, 0))
    final = F.max_by("parent", F.when(F.col("side") == 0, F.struct(F.col(order), F.col("parent")))).over(by_key)
    return a.unionByName(b).select(key, "child", F.coalesce(before, final).alias("parent"), "side").filter("side = 1").drop("side")


def region_text(spans: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """Text of the spans that strictly overlap each region on both axes, in order of y0, space-joined.

    spans: key, y0, y1, x0, x1, text, ord; regions: key, region, top, bottom, left, right.
    Boxes without extent are one wide.
    """
    s = spans.select(key, "y0", "y1", "x0", "x1", "text", "ord")
    r = regions.withColumn("bottom", F.greatest("bottom", F.col("top") + 1)).withColumn("right", F.greatest("right", F.col("left") + 1)).select(key, "region", "top", "bottom", "left", "right")
    over = (F.col("y1") > F.col("top")) & (F.col("y0") < F.col("bottom")) & (F.col("x1") > F.col("left")) & (F.col("x0") < F.col("right"))
    both = by_cells(r, s, key, "top", "bottom", "y0", "y1").filter(over).unionByName(r, allowMissingColumns=True)
    rows = both.groupBy(key, "region").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("y0", "ord", "text")))).alias("t"))
    return rows.select(key, "region", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))


def islands(df: DataFrame, key: str, order: list[str], gap: Column, name: str = "island") -> DataFrame:
    """Numbers runs from 1 within the key; a row begins a new one where ``gap`` (may use ``previous``) holds."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__new", F.when(gap, 1).otherwise(0)).withColumn(name, 1 + F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def normalised_edges(df: DataFrame, keys: list[str], edge: str, spread: float) -> DataFrame:
    """Rows within ``spread`` of their group's greatest edge, with that edge as ``page_edge``."""
    top = F.max(edge).over(Window.partitionBy(*keys))
    return df.withColumn("page_edge", top).filter(F.col("page_edge") - F.col(edge) <= spread)


def sequence_status(df: DataFrame, key: str, order: list[str], index: str) -> DataFrame:
    """'reset' where the index does not pass the greatest one before, 'gap' where it passes by more than one."""
    before = F.max(index).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("before", before).withColumn("status", F.when(F.col(index) <= F.col("before"), "reset").when(F.col(index) > F.col("before") + 1, "gap").otherwise("ok"))


def missed_letters(df: DataFrame, key: str, index: str, letters: str = "abcdefghijkl") -> DataFrame:
    """Letters that are skipped behind a letter, which makes that letter invalid: key, index, missed."""
    own = df.filter(F.col(index).between(1, len(letters))).select(key, index).distinct()
    following = F.lead(index).over(Window.partitionBy(key).orderBy(index))
    jump = own.withColumn("next", following).filter(F.col("next") > F.col(index) + 1)
    return jump.select(key, index, F.expr(f"array_join(transform(sequence({index} + 1, next - 1), i -> substring('{letters}', i, 1)), ',')").alias("missed"))


def alphabetical_run(df: DataFrame, key: str, order: list[str], index: str) -> DataFrame:
    """Rows before the first whose index is more than one beyond the greatest before it plus one."""
    w = Window.partitionBy(key).orderBy(*order)
    expected = F.coalesce(F.max(index).over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(1))
    broken = F.max(F.when(F.col(index) > F.col("expected") + 1, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("expected", expected).withColumn("broken", broken).filter("broken = 0").drop("expected", "broken")


def carried_forward(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """The last value that is not null, up to and with each row; rows before the first are dropped."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, True).over(w)).filter(F.col(name).isNotNull())


def agreeing_siblings(df: DataFrame, key: str, order: list[str], topic: str, known: Column) -> DataFrame:
    """An unknown topic becomes its neighbours' where both are known and the same."""
    w = Window.partitionBy(key).orderBy(*order)
    t = F.when(known, F.col(topic))
    before, after = F.lag(t).over(w), F.lead(t).over(w)
    return df.withColumn("resolved", F.coalesce(t, F.when(before == after, before)))


def first_known(df: DataFrame, key: str, order: str, topic: str, known: Column) -> DataFrame:
    """Per key the first known topic; null without one."""
    return df.groupBy(key).agg(F.min_by(F.when(known, F.col(topic)), F.when(known, F.col(order))).alias("topic"))
