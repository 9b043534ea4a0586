"""Places in an order over all rows, and sums along runs, without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.storage import kept


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds each row's place from 1 in the order; ties go by chance, so the order should have none.

    Ranges of the order are sorted on their own; what stands before a range is a sum over as many
    rows as there are ranges.
    """
    at = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = at.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("__part", before.alias("__before")))
    place = (F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).cast("int")
    return at.withColumn("__part", part).join(offsets, "__part").withColumn(name, place).drop("__part", "__at", "__before")


def ranged(rows: DataFrame, run: list[str], order: list[str | Column]) -> DataFrame:
    """The rows, written in ranges of (run, order) that ``__range`` numbers; a long run takes many ranges. Equal rows share one."""
    return kept(rows.repartitionByRange(*run, *order).withColumn("__range", F.spark_partition_id()))


def with_earlier(rows: DataFrame, ends: DataFrame, run: list[str], earlier: dict[str, Column]) -> DataFrame:
    """Adds to ``ranged`` rows what ``earlier`` says of the ranges before theirs in the run; null in a run's first range.

    ends: a row for each run and range.  ``earlier`` goes over a window of them.  As a range holds the end of one
    earlier run at most, no more rows than there are ranges are sent to all tasks.
    """
    number = F.row_number().over(Window.partitionBy(*run).orderBy("__range"))
    later = ends.withColumns({**earlier, "__number": number}).filter("__number > 1")
    same = {r: f"__run_{k}" for k, r in enumerate(run)}
    later = later.select(*[F.col(r).alias(a) for r, a in same.items()], F.col("__range").alias("__at"), *earlier)
    at = [F.col("__range") == F.col("__at"), *[F.col(r).eqNullSafe(F.col(a)) for r, a in same.items()]]
    return rows.join(F.broadcast(later), at, "left").drop("__at", *same.values())


def before(rows: DataFrame, run: list[str], order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """Adds sums over the rows that stand before each in its run, 0 for the first.

    Windows go over ranges of a run; what earlier ranges sum up to is a row a range.  Ties go by chance.
    """
    hidden = {f"__value_{k}": v for k, v in enumerate(sums.values())}
    at = ranged(rows.withColumns(hidden), run, order)
    w = Window.partitionBy("__range", *run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = at.groupBy(*run, "__range").agg(*[F.sum(v).alias(f"{v}_sum") for v in hidden])
    ahead = Window.partitionBy(*run).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    both = with_earlier(at, ends, run, {f"{v}_ahead": F.sum(f"{v}_sum").over(ahead) for v in hidden})
    zero = F.lit(0)
    out = both.withColumns({name: F.coalesce(F.sum(v).over(w), zero) + F.coalesce(F.col(f"{v}_ahead"), zero) for name, v in zip(sums, hidden)})
    return out.drop("__range", *hidden, *[f"{v}_ahead" for v in hidden])
