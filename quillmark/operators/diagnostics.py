"""Issue, timing and comparison reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def issue_summary(issues: DataFrame) -> DataFrame:
    """Per issue type, and in total (null): issues and distinct documents."""
    return issues.rollup("issue_type").agg(F.count("*").alias("n"), F.countDistinct("pdf_name").alias("n_pdfs"))


def issue_classes(issues: DataFrame, by: str) -> DataFrame:
    """Per group: layout, invalid and other issues."""
    t = F.col("issue_type")
    return issues.groupBy(by).agg(F.count_if(t == "layout").alias("layout"), F.count_if(t == "invalid").alias("invalid"), F.count_if(~t.isin("layout", "invalid")).alias("other"))


def actionable(issues: DataFrame, noise: str) -> DataFrame:
    """Counts by type without messages that hold ``noise``."""
    return issues.filter(~F.coalesce(F.contains("message", F.lit(noise)), F.lit(False))).groupBy("issue_type").agg(F.count("*").alias("n"))


def phase_averages(timings: DataFrame) -> DataFrame:
    return timings.groupBy("phase").agg(F.avg("seconds").alias("mean"), F.min("seconds").alias("least"), F.max("seconds").alias("most"), F.count("*").alias("n"))


def slowest(timings: DataFrame, n: int) -> DataFrame:
    """The n questions with the greatest total, each with its slowest phase."""
    one = timings.groupBy("question_id").agg(F.round(F.sum("seconds"), 6).alias("total"), F.max_by("phase", F.struct("seconds", "phase")).alias("phase"), F.max("seconds").alias("most"))
    return one.orderBy(F.desc("total"), "question_id").limit(n)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of both; where a key is in both, the new value."""
    fresh = new.select(*keys, F.col(value).alias("__new"), F.lit(True).alias("__is"))
    return old.join(fresh, keys, "full").select(*keys, F.when(F.col("__is"), F.col("__new")).otherwise(F.col(value)).alias(value))


def variant_matrix(results: DataFrame, row: str, column: str, names: list, value: str) -> DataFrame:
    """One row per ``row``, one column per name with the mean of ``value``."""
    return results.groupBy(row).pivot(column, names).agg(F.round(F.avg(value), 6))


def winners(results: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """How often each ``column`` is best over rows; ties go to the first in order."""
    best = F.row_number().over(Window.partitionBy(row).orderBy(F.desc(value), column))
    return results.withColumn("r", best).filter("r = 1").groupBy(column).agg(F.count("*").alias("wins"))


def updates(installed: DataFrame, bundled: DataFrame, key: str, version: str) -> DataFrame:
    """Keys in both whose bundled version string is greater; a missing installed one is older than any."""
    i = installed.select(key, F.col(version).alias("installed"))
    b = bundled.filter(F.col(version).isNotNull()).select(key, F.col(version).alias("bundled"))
    return i.join(b, key).filter(F.col("bundled") > F.coalesce("installed", F.lit("")))
