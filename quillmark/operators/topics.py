"""Topic labels, sub-topics and pattern lists: resolution, indexes, weights, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.patterns import pattern_rejects

from quillmark.functions import text as tx

#: The label of what has no sub-topic (fixed value).
FALLBACK = "Subtopic not found"


def resolved_topics(values: DataFrame, topics: DataFrame, value: str) -> DataFrame:
    """Adds ``resolved``: the canonical label where the topics have it, else the topic with the same slug, else the label itself.

    topics: exam_code, topic.  Of topics with the same slug the last by name counts.
    """
    own = values.withColumn("__label", tx.canonical_topic(F.col(value))).withColumn("__slug", tx.topic_slug(F.col("__label")))
    exact = topics.select("exam_code", F.col("topic").alias("__label"), F.lit(True).alias("__known")).distinct()
    by_slug = topics.groupBy("exam_code", tx.topic_slug(F.col("topic")).alias("__slug")).agg(F.max("topic").alias("__match"))
    out = own.join(exact, ["exam_code", "__label"], "left").join(by_slug, ["exam_code", "__slug"], "left")
    return out.withColumn("resolved", F.when(F.col("__known"), F.col("__label")).otherwise(F.coalesce("__match", "__label"))).drop("__label", "__slug", "__known", "__match")


def sub_topic_lists(sub_topics: DataFrame) -> DataFrame:
    """(exam_code, topic, names): a topic's sub-topics in order, the fallback behind them where it is not among them.

    sub_topics: exam_code, topic, ord, name.
    """
    listed = sub_topics.groupBy("exam_code", "topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("names"))
    has = F.exists("names", lambda x: F.lower(x) == FALLBACK.lower())
    return listed.withColumn("names", F.when(has, F.col("names")).otherwise(F.concat("names", F.array(F.lit(FALLBACK)))))


def sub_topic_parents(sub_topics: DataFrame) -> DataFrame:
    """(exam_code, name, parents): the topics that have a sub-topic, names in lower case and trimmed; the fallback has all."""
    rows = sub_topics.select("exam_code", F.lower(F.trim("name")).alias("name"), "topic").union(sub_topics.select("exam_code", F.lit(FALLBACK.lower()), "topic"))
    return rows.groupBy("exam_code", "name").agg(F.sort_array(F.collect_set("topic")).alias("parents"))


def canonical_sub_topics(labels: DataFrame, sub_topics: DataFrame) -> DataFrame:
    """Adds ``canonical``: the topic's sub-topic of that name in any case, else the fallback; null for an empty label.

    labels: exam_code, topic, label.
    """
    known = sub_topics.groupBy("exam_code", "topic", F.lower("name").alias("__name")).agg(F.min_by("name", "ord").alias("__canonical"))
    own = labels.withColumn("__name", F.lower(F.trim("label")))
    out = own.join(known, ["exam_code", "topic", "__name"], "left")
    return out.withColumn("canonical", F.when(F.coalesce("__name", F.lit("")) != "", F.coalesce("__canonical", F.lit(FALLBACK)))).drop("__name", "__canonical")


def partly_checked(checked: DataFrame, by: list[str]) -> DataFrame:
    """(by, names): the checked sub-topics of topics where some but not all are checked."""
    some = checked.groupBy(*by).agg(F.count_if("checked").alias("__n"), F.count("*").alias("__all"), F.sort_array(F.collect_set(F.when(F.col("checked"), F.col("name")))).alias("names"))
    return some.filter("__n > 0 and __n < __all").drop("__n", "__all")


def statistics_weight(precision: Column, hits: Column, tier: Column) -> Column:
    """precision * ln(1 + hits), by 1.2 for tier A, 1 for B and 0.6 for others."""
    return precision * F.log1p(hits) * F.when(tier == "A", 1.2).when(tier == "B", 1.0).otherwise(0.6)


def weighted_patterns(patterns: DataFrame) -> DataFrame:
    """Patterns that compile with their weight: what a weighted one carries (1 where it has none), null for a plain string.

    patterns: topic, ord, pattern, weighted boolean, weight.  ``pattern_rejects`` says why others are left out.
    """
    bad = pattern_rejects(patterns.sparkSession, patterns)
    return patterns.join(F.broadcast(bad.select("pattern")), "pattern", "left_anti").withColumn("weight", F.when(F.col("weighted"), F.coalesce("weight", F.lit(1.0))))


def distinct_patterns(own: DataFrame, of_sub_topics: DataFrame) -> DataFrame:
    """(topic, patterns): a topic's own patterns, then its sub-topics', each where it first stands; topics without any are left out."""
    rows = own.select("topic", F.lit(0).alias("side"), "ord", "pattern").union(of_sub_topics.select("topic", F.lit(1), "ord", "pattern"))
    first = rows.groupBy("topic", "pattern").agg(F.min(F.struct("side", "ord")).alias("at"))
    return first.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "pattern"))), lambda x: x["pattern"]).alias("patterns"))


def merged_patterns(existing: DataFrame, kept: DataFrame) -> DataFrame:
    """(topic, patterns): existing patterns in order, then the kept new ones that are not among them, each once.

    existing, kept: topic, ord, pattern.
    """
    return distinct_patterns(existing, kept)


def example_bundles(examples: DataFrame, patterns: DataFrame, most_examples: int = 20, most_patterns: int = 10) -> DataFrame:
    """(topic, examples, patterns): the first examples of each topic by place, and its first patterns.

    Groups are cut before they are collected, so a topic with a third of all examples is no more than ``most_examples`` rows.
    """

    def first(df, value, n, name):
        place = F.row_number().over(Window.partitionBy("topic").orderBy("ord"))
        cut = df.select("topic", "ord", value, place.alias("__r")).filter(F.col("__r") <= n)
        return cut.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", value))), lambda x: x[value]).alias(name))

    return first(examples, "example", most_examples, "examples").join(first(patterns, "pattern", most_patterns, "patterns"), "topic", "left").withColumn("patterns", F.coalesce("patterns", F.array().cast("array<string>")))
