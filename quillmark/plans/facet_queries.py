"""Registered queries over facets, filters and marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import facets
from quillmark.sources.corpus import PARTS_SQL, QUESTIONS_SQL, parts, questions

YEARS, PAPERS, TOPICS = (1996, 1997, 1998), (1, 2, 3), ("1-URGENT", "PROMO BRASS", "ECONOMY STEEL")


def facet_topic_counts(spark, d):
    q = questions(spark, d)
    p = parts(spark, d)
    topics = q.select("topic").union(p.filter("topic is not null").select("topic")).distinct()
    counts = facets.facet_topic_counts(facets.where_in(q, year=YEARS, paper=PAPERS), p)
    return facets.zero_filled(topics, counts, "topic", "n_parts")


def facet_years(spark, d):
    return questions(spark, d).filter("year is not null").select(F.col("year").cast("string").alias("year")).distinct()


def facet_papers(spark, d):
    return questions(spark, d).filter("paper <> 0").select("paper").distinct()


def leaf_marks_rollup(spark, d):
    return facets.mark_rollup(questions(spark, d), parts(spark, d))


def part_aware_topic_filter(spark, d):
    q, p = questions(spark, d), parts(spark, d)
    return facets.part_aware_topics(q, p, ["1-URGENT", "PROMO"], [7, 9]).select("question_id", "exam_code", "topic")


def tail_trim_filter(spark, d):
    return facets.tail_trim(questions(spark, d), parts(spark, d), ["PROMO", "ECONOMY"]).select("question_id", "ord", "label", "marks")


def topic_consensus(spark, d):
    return facets.topic_consensus(parts(spark, d))


def covered_topic_marks(spark, d):
    p = parts(spark, d).join(questions(spark, d).select("question_id", F.col("topic").alias("q"), "exam_code"), "question_id")
    return p.groupBy("exam_code", facets.effective_topic(F.col("topic"), F.col("q")).alias("topic")).agg(F.sum("marks").alias("marks"), F.count("*").alias("n_parts"))


QUERIES = {f.__name__: f for f in (facet_topic_counts, facet_years, facet_papers, leaf_marks_rollup, part_aware_topic_filter, tail_trim_filter, topic_consensus, covered_topic_marks)}

_BASE = f"WITH {QUESTIONS_SQL}, {PARTS_SQL}"
SQL = {
    "facet_topic_counts": _BASE + """,
dim AS (SELECT topic FROM questions UNION SELECT topic FROM parts WHERE topic IS NOT NULL),
counts AS (
  SELECT CASE WHEN lower(coalesce(p.topic, '')) IN ('', 'unknown', '00. unknown') THEN q.topic ELSE p.topic END AS topic, count(*) AS n
  FROM parts p JOIN questions q USING (question_id)
  WHERE q.year IN (1996, 1997, 1998) AND q.paper IN (1, 2, 3) GROUP BY 1)
SELECT dim.topic, CAST(coalesce(n, 0) AS BIGINT) AS n_parts FROM dim LEFT JOIN counts USING (topic)""",
    "facet_years": f"WITH {QUESTIONS_SQL} SELECT DISTINCT CAST(year AS VARCHAR) AS year FROM questions WHERE year IS NOT NULL",
    "facet_papers": f"WITH {QUESTIONS_SQL} SELECT DISTINCT paper FROM questions WHERE paper <> 0",
    "leaf_marks_rollup": _BASE + """
SELECT exam_code, year, count(*) AS n_leaves, CAST(sum(marks) AS BIGINT) AS marks, count(DISTINCT question_id) AS n_questions
FROM parts JOIN questions q USING (question_id) GROUP BY ROLLUP (exam_code, year)""",
    "part_aware_topic_filter": _BASE + """
SELECT question_id, exam_code, topic FROM questions q
WHERE topic IN ('1-URGENT', 'PROMO') OR question_id IN (7, 9)
   OR EXISTS (SELECT 1 FROM parts p WHERE p.question_id = q.question_id AND p.topic IN ('1-URGENT', 'PROMO'))""",
    "tail_trim_filter": _BASE + """,
l AS (SELECT p.*, max(CASE WHEN coalesce(nullif(p.topic, ''), q.topic) IN ('PROMO', 'ECONOMY') THEN ord END) OVER (PARTITION BY question_id) AS last_match
      FROM parts p JOIN questions q USING (question_id))
SELECT question_id, ord, label, marks FROM l WHERE ord <= last_match""",
    "topic_consensus": _BASE + """,
k AS (SELECT question_id, CASE WHEN lower(coalesce(topic, '')) NOT IN ('', 'unknown', '00. unknown') THEN topic END AS known, ord FROM parts),
c AS (SELECT question_id, known, count(known) AS n, min(ord) AS first FROM k GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, first) AS r FROM c)
SELECT question_id, coalesce(known, '00. Unknown') AS topic FROM r WHERE r = 1""",
    "covered_topic_marks": _BASE + """
SELECT exam_code, coalesce(nullif(p.topic, ''), q.topic) AS topic, CAST(sum(marks) AS BIGINT) AS marks, count(*) AS n_parts
FROM parts p JOIN questions q USING (question_id) GROUP BY 1, 2""",
}
