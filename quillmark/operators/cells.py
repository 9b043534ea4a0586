"""Interval joins by cells of height: no key's rows are held against all others of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators.storage import kept


def by_cells(left: DataFrame, right: DataFrame, key: str, low: str, high: str, low_: str, high_: str) -> DataFrame:
    """Pairs of rows whose closed ranges [low, high] and [low_, high_] meet, each once, with the columns of both sides.

    ``right`` must not share column names with ``left`` but the key.  Both sides are put into
    cells as wide as their key's ranges are on average (at least 1), so the rows in cells are
    no more than three for each row; a pair is made in the first cell that both have.  A cell
    and not a key is what a join brings together.  Rows without a range, or with one that
    ends before it begins, meet nothing.
    """
    sides = [(left, low, high), (right, low_, high_)]
    extent = None
    for df, a, b in sides:
        own = df.filter(F.col(b) >= F.col(a)).groupBy(key).agg(F.sum((F.col(b) - F.col(a)).cast("double")).alias("__s"), F.count("*").alias("__c"))
        extent = own if extent is None else extent.unionByName(own)
    width = extent.groupBy(key).agg(F.greatest(F.lit(1.0), F.sum("__s") / F.sum("__c")).alias("__w"))

    def celled(df: DataFrame, a: str, b: str, first: str) -> DataFrame:
        cell = lambda c: F.floor(F.col(c).cast("double") / F.col("__w"))
        return df.filter(F.col(b) >= F.col(a)).join(width, key).withColumn(first, cell(a)).withColumn("__cell", F.explode(F.sequence(F.col(first), cell(b)))).drop("__w")

    # each side's shuffles are gone before the sides meet
    width = kept(width)
    both = kept(celled(left, low, high, "__first")).join(kept(celled(right, low_, high_, "__first_")), [key, "__cell"])
    meet = (F.col(low_) <= F.col(high)) & (F.col(low) <= F.col(high_))
    return both.filter((F.col("__cell") == F.greatest("__first", "__first_")) & meet).drop("__cell", "__first", "__first_")

