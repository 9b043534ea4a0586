"""Registered queries over topic labels, sub-topics and pattern lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import patterns, search, topics
from quillmark.sources.corpus import PARTS_SQL, QUESTIONS_SQL, parts, questions, table

def _exam():
    return F.lpad((F.col("p_partkey") % 5).cast("string"), 4, "0")


def _topics(spark, d):
    return table(spark, d, "part").select(_exam().alias("exam_code"), F.concat(F.lpad((F.col("p_size") % 3 + 1).cast("string"), 2, "0"), F.lit(". "), F.initcap("p_type")).alias("topic")).distinct()


def _sub_topics(spark, d):
    """Brands as sub-topics of types."""
    p = table(spark, d, "part")
    return p.groupBy(_exam().alias("exam_code"), F.col("p_type").alias("topic"), F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("ord"))


def topic_resolution(spark, d):
    p = table(spark, d, "part").select("p_partkey", _exam().alias("exam_code"), F.concat((F.col("p_size") % 4 + 1).cast("string"), F.when(F.col("p_size") % 2 == 0, ") ").otherwise(". "), F.when(F.col("p_size") % 5 == 0, F.col("p_brand")).otherwise(F.initcap("p_type"))).alias("raw"))
    return topics.resolved_topics(p, _topics(spark, d), "raw").select("p_partkey", "resolved")


def sub_topic_lists(spark, d):
    return topics.sub_topic_lists(_sub_topics(spark, d)).select("exam_code", "topic", F.array_join("names", "|").alias("names"))


def sub_topic_parents(spark, d):
    return topics.sub_topic_parents(_sub_topics(spark, d)).select("exam_code", "name", F.array_join("parents", "|").alias("parents"))


def sub_topic_canonical(spark, d):
    p = table(spark, d, "part")
    labels = p.select("p_partkey", _exam().alias("exam_code"), F.col("p_type").alias("topic"), F.when(F.col("p_partkey") % 9 == 0, " ").when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" "), F.upper("p_brand"))).otherwise(F.col("p_brand")).alias("label"))
    return topics.canonical_sub_topics(labels, _sub_topics(spark, d)).select("p_partkey", "canonical")


def partly_checked_topics(spark, d):
    p = table(spark, d, "part").select("p_type", F.col("p_brand").alias("name"), F.col("p_size").alias("s"))
    checked = p.groupBy("p_type", "name").agg((F.max("s") % 3 == 0).alias("checked"))
    return topics.partly_checked(checked, ["p_type"]).select("p_type", F.array_join("names", "|").alias("names"))


def statistics_weights(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("precision"), (F.col("p_partkey") % 40).alias("tp"), F.substring(F.lit("ABC"), (F.col("p_partkey") % 3 + 1).cast("int"), F.lit(1)).alias("tier"))
    return p.select("p_partkey", F.round(topics.statistics_weight(F.col("precision"), F.col("tp"), F.col("tier")), 6).alias("weight"))


def _patterns(spark, d, flag):
    p = table(spark, d, "part").filter(f"p_partkey % 3 {flag}")
    return p.select(F.col("p_type").alias("topic"), F.col("p_partkey").alias("ord"), F.concat(F.lower("p_brand"), (F.col("p_size") % 7).cast("string")).alias("pattern"))


def pattern_weights(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("topic"), F.col("p_partkey").alias("ord"), F.concat(F.when(F.col("p_partkey") % 11 == 0, "*").when(F.col("p_partkey") % 13 == 0, "(").otherwise(""), F.col("p_brand")).alias("pattern"), (F.col("p_partkey") % 2 == 0).alias("weighted"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_size") / 10.0).alias("weight"))
    return topics.weighted_patterns(p).select("p_partkey", "pattern", "weight")


def compiled_patterns(spark, d):
    """Patterns of parts, with whether they compile."""
    before = F.element_at(F.array(*map(F.lit, ("", "(a", "[(]", "a{2,1}", "*", "[^]a]", "(?:b|c)"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    after = F.when(F.col("p_partkey") % 5 == 0, ")").otherwise("")
    p = table(spark, d, "part").select("p_partkey", F.concat(before, "p_brand", after).alias("pattern"))
    return p.join(F.broadcast(patterns.pattern_rejects(spark, p)), "pattern", "left").select("p_partkey", "pattern", F.col("reject").isNull().alias("compiles"))


def topic_pattern_lists(spark, d):
    return topics.distinct_patterns(_patterns(spark, d, "= 0"), _patterns(spark, d, "<> 0")).select("topic", F.array_join("patterns", "|").alias("patterns"))


def new_patterns(spark, d):
    return search.new_only(_patterns(spark, d, "= 1"), _patterns(spark, d, "<> 1"), ["topic", "pattern"]).select("topic", "ord", "pattern")


def merged_patterns(spark, d):
    return topics.merged_patterns(_patterns(spark, d, "= 2"), _patterns(spark, d, "= 1")).select("topic", F.array_join("patterns", "|").alias("patterns"))


def example_bundles(spark, d):
    p = parts(spark, d).filter("topic is not null").select("topic", (F.col("question_id") * 100 + F.col("ord")).alias("ord"), F.col("label").alias("example"))
    return topics.example_bundles(p, _patterns(spark, d, "= 0")).select("topic", F.array_join("examples", "|").alias("examples"), F.array_join("patterns", "|").alias("patterns"))


def classify_parts(spark, d):
    """A topic for every part and every question's root, by the text of each; an empty text is unknown."""
    p = parts(spark, d).select("question_id", "label", F.concat_ws(" ", "name", F.col("topic")).alias("text"))
    root = questions(spark, d).select("question_id", F.col("question_id").cast("string").alias("label"), F.when(F.col("question_id") % 3 == 0, " ").otherwise(F.col("topic")).alias("text"))
    rows = p.union(root).withColumn("key", F.struct("question_id", "label"))
    scores = search.rule_scores(rows.filter(F.trim("text") != ""), PART_RULES, "key", "text")
    return search.classify(scores, rows.select("key"), "key").select("key.question_id", "key.label", "topic")


PART_RULES = [search.Rule("01. Metals", "(?i)brass|steel|copper", 1.0), search.Rule("02. Offers", "(?i)promo|economy", 0.8), search.Rule("02. Offers", "(?i)#.*1", 0.4), search.Rule("03. Urgent", "(?i)urgent|high", 0.9)]

QUERIES = {
    f.__name__: f
    for f in (
        topic_resolution, sub_topic_lists, sub_topic_parents, sub_topic_canonical, partly_checked_topics, statistics_weights, pattern_weights, compiled_patterns, topic_pattern_lists,
        new_patterns, merged_patterns, example_bundles, classify_parts,
    )
}

_E = "lpad(CAST(p_partkey % 5 AS VARCHAR), 4, '0')"
_CAP = "upper(substr(split_part(p_type, ' ', 1), 1, 1)) || lower(substr(split_part(p_type, ' ', 1), 2)) || CASE WHEN contains(p_type, ' ') THEN ' ' || upper(substr(split_part(p_type, ' ', 2), 1, 1)) || lower(substr(split_part(p_type, ' ', 2), 2)) ELSE '' END"
_SUB = f"WITH sub AS (SELECT {_E} AS exam_code, p_type AS topic, p_brand AS name, min(p_partkey) AS ord FROM part GROUP BY 1, 2, 3)"
_PAT = "WITH pat AS (SELECT p_type AS topic, p_partkey AS ord, lower(p_brand) || (p_size % 7) AS pattern, p_partkey % 3 AS f FROM part)"


def _merged(first: str, second: str) -> str:
    return f"""{_PAT}, r AS (SELECT topic, 0 AS side, ord, pattern FROM pat WHERE {first} UNION ALL SELECT topic, 1, ord, pattern FROM pat WHERE {second}),
f AS (SELECT topic, pattern, min(side * 1000000000 + ord) AS at_ FROM r GROUP BY 1, 2) SELECT topic, string_agg(pattern, '|' ORDER BY at_) AS patterns FROM f GROUP BY 1"""


SQL = {
    "topic_resolution": f"""WITH t AS (SELECT DISTINCT {_E} AS exam_code, lpad(CAST(p_size % 3 + 1 AS VARCHAR), 2, '0') || '. ' || {_CAP} AS topic FROM part),
v AS (SELECT p_partkey, {_E} AS exam_code, lpad(CAST(p_size % 4 + 1 AS VARCHAR), 2, '0') || '. ' || CASE WHEN p_size % 5 = 0 THEN p_brand ELSE {_CAP} END AS label FROM part),
s AS (SELECT exam_code, lower(regexp_replace(topic, '^[0-9]+[.] ', '')) AS slug, max(topic) AS m FROM t GROUP BY 1, 2)
SELECT p_partkey, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.exam_code = v.exam_code AND t.topic = v.label) THEN label ELSE coalesce(m, label) END AS resolved
FROM v LEFT JOIN s ON s.exam_code = v.exam_code AND s.slug = lower(regexp_replace(v.label, '^[0-9]+[.] ', ''))""",
    "sub_topic_lists": _SUB + " SELECT exam_code, topic, string_agg(name, '|' ORDER BY ord) || '|Subtopic not found' AS names FROM sub GROUP BY 1, 2",
    "sub_topic_parents": _SUB + """, r AS (SELECT DISTINCT exam_code, lower(name) AS name, topic FROM sub UNION SELECT exam_code, 'subtopic not found', topic FROM sub)
SELECT exam_code, name, string_agg(topic, '|' ORDER BY topic) AS parents FROM r GROUP BY 1, 2""",
    "sub_topic_canonical": _SUB + f""" SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN coalesce(name, 'Subtopic not found') END AS canonical
FROM part LEFT JOIN sub ON sub.exam_code = {_E} AND sub.topic = p_type AND lower(sub.name) = lower(p_brand)""",
    "partly_checked_topics": """WITH c AS (SELECT p_type, p_brand AS name, max(p_size) % 3 = 0 AS checked FROM part GROUP BY 1, 2)
SELECT p_type, string_agg(name, '|' ORDER BY name) FILTER (WHERE checked) AS names FROM c GROUP BY 1 HAVING count(*) FILTER (WHERE checked) > 0 AND count(*) FILTER (WHERE checked) < count(*)""",
    "statistics_weights": "SELECT p_partkey, round((p_size / 50.0::DOUBLE) * ln(1.0::DOUBLE + p_partkey % 40) * CASE p_partkey % 3 WHEN 0 THEN 1.2::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END, 6) AS weight FROM part",
    "compiled_patterns": """WITH p AS (SELECT p_partkey, p_partkey % 7 AS k, p_partkey % 5 = 0 AS closes, ['', '(a', '[(]', 'a{2,1}', '*', '[^]a]', '(?:b|c)'][p_partkey % 7 + 1] || p_brand || CASE WHEN p_partkey % 5 = 0 THEN ')' ELSE '' END AS pattern FROM part)
SELECT p_partkey, pattern, CASE WHEN k IN (3, 4) THEN false WHEN k = 1 THEN closes ELSE NOT closes END AS compiles FROM p""",
    "pattern_weights": "SELECT p_partkey, p_brand AS pattern, CASE WHEN p_partkey % 4 = 0 THEN p_size / 10.0::DOUBLE WHEN p_partkey % 2 = 0 THEN 1.0::DOUBLE END AS weight FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0",
    "topic_pattern_lists": _merged("f = 0", "f <> 0"),
    "new_patterns": _PAT + " SELECT topic, ord, pattern FROM pat p WHERE f = 1 AND NOT EXISTS (SELECT 1 FROM pat o WHERE o.f <> 1 AND o.topic = p.topic AND o.pattern = p.pattern)",
    "merged_patterns": _merged("f = 2", "f = 1"),
    "example_bundles": _PAT + f""", {PARTS_SQL}, e AS (SELECT topic, question_id * 100 + ord AS o, label, row_number() OVER (PARTITION BY topic ORDER BY question_id * 100 + ord) AS r FROM parts WHERE topic IS NOT NULL),
b AS (SELECT topic, ord, pattern, row_number() OVER (PARTITION BY topic ORDER BY ord) AS r FROM pat WHERE f = 0),
x AS (SELECT topic, string_agg(label, '|' ORDER BY o) AS examples FROM e WHERE r <= 20 GROUP BY 1), y AS (SELECT topic, string_agg(pattern, '|' ORDER BY ord) AS patterns FROM b WHERE r <= 10 GROUP BY 1)
SELECT topic, examples, coalesce(patterns, '') AS patterns FROM x LEFT JOIN y USING (topic)""",
    "classify_parts": f"""WITH {QUESTIONS_SQL}, {PARTS_SQL}, t AS (SELECT question_id, label, concat_ws(' ', name, topic) AS text FROM parts
 UNION ALL SELECT question_id, CAST(question_id AS VARCHAR), CASE WHEN question_id % 3 = 0 THEN ' ' ELSE topic END FROM questions),
s AS (SELECT question_id, label, CASE WHEN regexp_matches(text, 'brass|steel|copper', 'i') THEN 1.0::DOUBLE ELSE 0 END AS a,
 CASE WHEN regexp_matches(text, 'promo|economy', 'i') THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(text, '#.*1', 'i') THEN 0.4::DOUBLE ELSE 0 END AS b,
 CASE WHEN regexp_matches(text, 'urgent|high', 'i') THEN 0.9::DOUBLE ELSE 0 END AS c FROM t),
m AS (SELECT *, greatest(a, b, c) AS best, a + b + c - greatest(a, b, c) - least(a, b, c) AS second FROM s)
SELECT question_id, label, CASE WHEN best >= 0.7 AND best - second >= 0.3 - 1e-9 THEN CASE WHEN a = best THEN '01. Metals' WHEN b = best THEN '02. Offers' ELSE '03. Urgent' END ELSE '00. Unknown' END AS topic FROM m""",
}
