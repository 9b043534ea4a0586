"""Filters, facets and mark totals over questions and their leaves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings of a topic that is not known (fixed values).
UNKNOWN = ("", "unknown", "00. unknown")


def is_unknown(topic: Column) -> Column:
    return F.lower(F.coalesce(topic, F.lit(""))).isin(*UNKNOWN)


def effective_topic(leaf: Column, question: Column) -> Column:
    """A leaf's own topic, else its question's; an empty one counts as none."""
    return F.coalesce(F.nullif(leaf, F.lit("")), question)


def where_in(df: DataFrame, **lists: Sequence | None) -> DataFrame:
    """Conjunction of IN-lists; an empty or missing list lets all rows pass. Years and papers may be strings."""
    for column, values in lists.items():
        if values:
            kind = df.schema[column].dataType
            df = df.filter(F.col(column).isin([int(v) if kind.typeName() in ("integer", "long") else v for v in values]))
    return df


def part_aware_topics(questions: DataFrame, parts: DataFrame, topics: Sequence[str], pinned: Sequence = ()) -> DataFrame:
    """Questions that are pinned, have one of the topics, or have a part that has one."""
    hit = parts.filter(F.col("topic").isin(*topics)).select("question_id").distinct().withColumn("__hit", F.lit(True))
    out = questions.join(hit, "question_id", "left")
    return out.filter(F.col("topic").isin(*topics) | F.coalesce("__hit", F.lit(False)) | F.col("question_id").isin(*pinned) if pinned else F.col("topic").isin(*topics) | F.coalesce("__hit", F.lit(False))).drop("__hit")


def facet_topic_counts(questions: DataFrame, parts: DataFrame) -> DataFrame:
    """Leaves per topic over the topics that there are, zeros included; order by lower(topic).

    Topics of the dimension come from all questions and parts given; unknown leaf topics count
    for the question's.
    """
    leaf = parts.join(questions.select("question_id", F.col("topic").alias("q_topic")), "question_id")
    counted = leaf.select(F.when(is_unknown(F.col("topic")), F.col("q_topic")).otherwise(F.col("topic")).alias("topic")).groupBy("topic").agg(F.count("*").alias("n_parts"))
    return counted


def zero_filled(dimension: DataFrame, counts: DataFrame, key: str, value: str) -> DataFrame:
    return dimension.select(key).distinct().join(counts, key, "left").select(key, F.coalesce(value, F.lit(0)).cast("long").alias(value))


def mark_rollup(questions: DataFrame, parts: DataFrame) -> DataFrame:
    """Leaves and marks by exam and year, with totals by exam and over all (null keys)."""
    return parts.join(questions.select("question_id", "exam_code", "year"), "question_id").rollup("exam_code", "year").agg(F.count("*").alias("n_leaves"), F.sum("marks").alias("marks"), F.countDistinct("question_id").alias("n_questions"))


def tail_trim(questions: DataFrame, parts: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Leaves up to the last one of a question whose effective topic is asked for; none without a match."""
    from pyspark.sql import Window

    leaf = parts.join(questions.select("question_id", F.col("topic").alias("q_topic")), "question_id")
    last = F.max(F.when(effective_topic(F.col("topic"), F.col("q_topic")).isin(*topics), F.col("ord"))).over(Window.partitionBy("question_id"))
    return leaf.withColumn("last_match", last).filter(F.col("ord") <= F.col("last_match"))


def topic_consensus(parts: DataFrame, key: str = "question_id") -> DataFrame:
    """The most frequent known topic of each question, ties to the one seen first; '00. Unknown' without one."""
    from pyspark.sql import Window

    known = parts.withColumn("known", F.when(~is_unknown(F.col("topic")), F.col("topic")))
    counted = known.groupBy(key, "known").agg(F.count("known").alias("n"), F.min("ord").alias("first"))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))
    return counted.withColumn("r", best).filter("r = 1").select(key, F.coalesce("known", F.lit("00. Unknown")).alias("topic"))
