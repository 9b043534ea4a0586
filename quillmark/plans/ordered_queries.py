"""Registered queries over labels, intervals and ordered data."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import text as tx
from quillmark.operators import ordered
from quillmark.sources.corpus import EVENTS_SQL, PARTS_SQL, events, parts, table

_ROMANS = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii")


def _deep(spark, d):
    return _with_deep(parts(spark, d))


def _with_deep(p):
    roman = F.element_at(F.array(*map(F.lit, _ROMANS)), (F.col("y") % 12 + 1).cast("int"))
    return p.withColumn("deep", F.when(F.col("ord") % 3 != 1, F.concat("label", F.lit("("), roman, F.lit(")"))).otherwise(F.col("label")))


def label_parse_parent_join(spark, d):
    p = _deep(spark, d).select("question_id", "ord", "deep").withColumns({"depth": tx.label_depth(F.col("deep")), "kind": tx.label_kind(F.col("deep")), "parent": tx.parent_label(F.col("deep"))})
    own = parts(spark, d).select(F.col("label").alias("parent"), F.col("ord").alias("parent_ord"), F.col("question_id").alias("parent_question"))
    return p.join(own, "parent", "left").select("question_id", "ord", "deep", "depth", "kind", "parent", "parent_ord")


def label_hierarchical_sort(spark, d):
    from pyspark.sql import Window

    p = _deep(spark, d).withColumn("deep", F.concat(F.lit("1("), F.element_at(F.split("deep", r"\("), 2), F.when(F.size(F.split("deep", r"\(")) > 2, F.concat(F.lit("("), F.element_at(F.split("deep", r"\("), 3))).otherwise("")))
    keyed = p.withColumn("key", tx.label_sort_key(F.col("deep")))
    return keyed.select("question_id", "ord", "deep", F.dense_rank().over(Window.partitionBy("question_id").orderBy("key")).alias("place"))


def label_tokens(spark, d):
    return _deep(spark, d).select("question_id", "ord", F.array_join(tx.label_tokens(F.col("deep")), "/").alias("tokens"))


def mark_to_leaf_interval(spark, d):
    p = parts(spark, d)
    from pyspark.sql import Window

    leaf = ordered.with_extent(p.select("question_id", "ord", "y"), ["question_id"], ["ord"], "y", F.max("y").over(Window.partitionBy("question_id")) + 100)
    marks = p.select("question_id", (F.col("y") + F.col("price").cast("int") % 40).alias("my"), F.col("marks").alias("mark"), F.col("ord").alias("mark_ord"))
    return ordered.lowest_in_interval(leaf, marks, "question_id", "y", "y_end", "my", "mark", "mark_ord")


def roman_parent_asof(spark, d):
    e = events(spark, d)
    return ordered.asof_parent(e.filter("event_type = 'error'"), e.filter("event_type = 'purchase'"), "user_id", "at", "event_id")


def span_region_text(spark, d):
    p = parts(spark, d)
    spans = p.select("question_id", F.col("y").alias("y0"), (F.col("y") + 12).alias("y1"), (F.col("price").cast("int") % 500).alias("x0"), (F.col("price").cast("int") % 500 + 80).alias("x1"), F.concat_ws(" ", "name", F.concat(F.lit("["), F.col("marks").cast("string"), F.lit("]"))).alias("text"), "ord")
    regions = p.select("question_id", F.col("ord").alias("region"), (F.col("y") - 30).alias("top"), (F.col("y") + 30).alias("bottom"), F.lit(0).alias("left"), F.lit(250).alias("right"))
    return ordered.region_text(spans, regions, "question_id")


_GAP = 36000


def _islands(spark, d):
    from pyspark.sql import Window

    gap = F.col("at") - F.lag("at").over(Window.partitionBy("user_id").orderBy("at", "event_id")) > _GAP
    return ordered.islands(events(spark, d), "user_id", ["at", "event_id"], gap)


def gap_islands(spark, d):
    return _islands(spark, d).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def mark_edge_normalise(spark, d):
    rows = _islands(spark, d).withColumn("edge", F.floor("value").cast("int"))
    return ordered.normalised_edges(rows, ["user_id", "island"], "edge", 60).select("event_id", "island", "edge", "page_edge")


def sequence_gap_reset(spark, d):
    rows = parts(spark, d).withColumn("idx", (F.col("y") % 12 + 1).cast("int"))
    return ordered.sequence_status(rows, "question_id", ["ord"], "idx").select("question_id", "ord", "idx", "status")


def letter_gaps(spark, d):
    return ordered.missed_letters(parts(spark, d).withColumn("idx", (F.col("y") % 15 + 1).cast("int")), "question_id", "idx")


def alphabetical_run(spark, d):
    rows = parts(spark, d).withColumn("idx", (F.col("ord") + F.when(F.col("y") % 7 == 0, 3).otherwise(0)).cast("int"))
    return ordered.alphabetical_run(rows, "question_id", ["ord"], "idx").select("question_id", "ord", "idx")


def locf_tokens(spark, d):
    c = table(spark, d, "conversations").withColumn("token", F.when(F.length("text") % 3 == 0, F.concat("role", F.lit(":"), F.col("turn").cast("string"))))
    return ordered.carried_forward(c, "conv_id", ["turn"], "token", "tokens").select("conv_id", "turn", "tokens")


def _turn_topics(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(F.length("text") % 4 == 0, "00. Unknown").otherwise(F.concat(F.lit("t"), (F.length("text") % 2).cast("string"))).alias("topic"))


def topic_propagation(spark, d):
    c = _turn_topics(spark, d)
    return ordered.agreeing_siblings(c, "conv_id", ["turn"], "topic", F.col("topic") != "00. Unknown").select("conv_id", "turn", "resolved")


def root_topic(spark, d):
    return ordered.first_known(_turn_topics(spark, d), "conv_id", "turn", "topic", F.col("topic") != "00. Unknown")


QUERIES = {
    f.__name__: f
    for f in (
        label_parse_parent_join, label_hierarchical_sort, label_tokens, mark_to_leaf_interval, roman_parent_asof, span_region_text, gap_islands,
        mark_edge_normalise, sequence_gap_reset, letter_gaps, alphabetical_run, locf_tokens, topic_propagation, root_topic,
    )
}

_ROMAN_LIST = "[" + ", ".join(f"'{r}'" for r in _ROMANS) + "]"
_DEEP = f"""WITH {PARTS_SQL}, deep AS (
  SELECT *, {_ROMAN_LIST}[CAST(y % 12 + 1 AS INTEGER)] AS roman, CAST(y % 12 + 1 AS INTEGER) AS roman_value,
         CASE WHEN ord % 3 <> 1 THEN label || '(' || {_ROMAN_LIST}[CAST(y % 12 + 1 AS INTEGER)] || ')' ELSE label END AS deep
  FROM parts)
"""
_ISLANDS = f"""WITH {EVENTS_SQL}, g AS (
  SELECT *, CASE WHEN at_ - lag(at_) OVER (PARTITION BY user_id ORDER BY at_, event_id) > {_GAP} THEN 1 ELSE 0 END AS fresh FROM ev
), islands AS (
  SELECT *, CAST(1 + sum(fresh) OVER (PARTITION BY user_id ORDER BY at_, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM g)
"""
SQL = {
    "label_parse_parent_join": _DEEP + r"""
SELECT d.question_id, d.ord, d.deep, CAST(length(d.deep) - length(replace(d.deep, '(', '')) AS INTEGER) AS depth,
       CASE WHEN d.ord % 3 <> 1 THEN 'roman' ELSE 'letter' END AS kind,
       nullif(regexp_extract(d.deep, '^(.*)\([^(]*$', 1), '') AS parent, p.ord AS parent_ord
FROM deep d LEFT JOIN parts p ON p.label = nullif(regexp_extract(d.deep, '^(.*)\([^(]*$', 1), '')""",
    "label_hierarchical_sort": _DEEP + """,
k AS (SELECT question_id, ord, '1(' || substr('abcdefghijklmnopqrstuvwxyz', ord, 1) || ')' || CASE WHEN ord % 3 <> 1 THEN '(' || roman || ')' ELSE '' END AS deep,
             CASE WHEN substr('abcdefghijklmnopqrstuvwxyz', ord, 1) IN ('i', 'v', 'x') THEN 1 ELSE 0 END AS k1,
             CASE substr('abcdefghijklmnopqrstuvwxyz', ord, 1) WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 ELSE 96 + ord END AS v1,
             CASE WHEN ord % 3 <> 1 THEN roman_value ELSE 0 END AS v2 FROM deep)
SELECT question_id, ord, deep, CAST(dense_rank() OVER (PARTITION BY question_id ORDER BY k1, v1, v2) AS INTEGER) AS place FROM k""",
    "label_tokens": _DEEP + """
SELECT question_id, ord, CAST(question_id AS VARCHAR) || '/' || substr('abcdefghijklmnopqrstuvwxyz', ord, 1) || CASE WHEN ord % 3 <> 1 THEN '/' || roman ELSE '' END AS tokens FROM deep""",
    "mark_to_leaf_interval": f"""WITH {PARTS_SQL},
leaf AS (SELECT question_id, ord, y, coalesce(lead(y) OVER (PARTITION BY question_id ORDER BY ord), max(y) OVER (PARTITION BY question_id) + 100) AS y_end FROM parts),
m AS (SELECT question_id, y + trunc(price)::BIGINT % 40 AS my, marks AS mark, ord AS mo FROM parts)
SELECT l.question_id, l.ord, l.y, l.y_end, arg_max(m.mark, m.my * 1000 + m.mo) AS mark_found
FROM leaf l LEFT JOIN m ON m.question_id = l.question_id AND m.my >= l.y AND m.my < l.y_end GROUP BY 1, 2, 3, 4""",
    "roman_parent_asof": f"""WITH {EVENTS_SQL},
a AS (SELECT user_id, at_, max(event_id) AS parent FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2),
f AS (SELECT user_id, arg_max(parent, at_) AS final FROM a GROUP BY 1)
SELECT c.user_id, c.event_id AS child, coalesce(a.parent, f.final) AS parent
FROM (SELECT * FROM ev WHERE event_type = 'error') c ASOF LEFT JOIN a ON a.user_id = c.user_id AND c.at_ >= a.at_ LEFT JOIN f ON f.user_id = c.user_id""",
    "span_region_text": f"""WITH {PARTS_SQL}
SELECT r.question_id, r.ord AS region, coalesce(string_agg(s.name || ' [' || s.marks || ']', ' ' ORDER BY s.y, s.ord), '') AS text
FROM parts r LEFT JOIN parts s ON s.question_id = r.question_id AND s.y + 12 > r.y - 30 AND s.y < r.y + 30
  AND trunc(s.price)::BIGINT % 500 + 80 > 0 AND trunc(s.price)::BIGINT % 500 < 250
GROUP BY 1, 2""",
    "gap_islands": _ISLANDS + "SELECT user_id, island, count(*) AS n, min(at_) AS first_at, max(at_) AS last_at FROM islands GROUP BY 1, 2",
    "mark_edge_normalise": _ISLANDS + """, e AS (SELECT event_id, island, CAST(floor(value) AS INTEGER) AS edge, CAST(floor(max(value) OVER (PARTITION BY user_id, island)) AS INTEGER) AS page_edge FROM islands)
SELECT * FROM e WHERE page_edge - edge <= 60""",
    "sequence_gap_reset": f"""WITH {PARTS_SQL}, i AS (SELECT question_id, ord, CAST(y % 12 + 1 AS INTEGER) AS idx FROM parts),
b AS (SELECT *, max(idx) OVER (PARTITION BY question_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i)
SELECT question_id, ord, idx, CASE WHEN idx <= before THEN 'reset' WHEN idx > before + 1 THEN 'gap' ELSE 'ok' END AS status FROM b""",
    "letter_gaps": f"""WITH {PARTS_SQL}, i AS (SELECT DISTINCT question_id, CAST(y % 15 + 1 AS INTEGER) AS idx FROM parts WHERE y % 15 + 1 <= 12),
n AS (SELECT *, lead(idx) OVER (PARTITION BY question_id ORDER BY idx) AS nxt FROM i)
SELECT question_id, idx, array_to_string(list_transform(range(idx + 1, nxt), lambda k: substr('abcdefghijkl', k, 1)), ',') AS missed FROM n WHERE nxt > idx + 1""",
    "alphabetical_run": f"""WITH {PARTS_SQL}, i AS (SELECT question_id, ord, CAST(ord + CASE WHEN y % 7 = 0 THEN 3 ELSE 0 END AS INTEGER) AS idx FROM parts),
x AS (SELECT *, coalesce(max(idx) OVER (PARTITION BY question_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 1) AS expected FROM i),
b AS (SELECT *, max(CASE WHEN idx > expected + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY question_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS broken FROM x)
SELECT question_id, ord, idx FROM b WHERE broken = 0""",
    "locf_tokens": """WITH c AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN role || ':' || turn END AS token FROM conversations),
l AS (SELECT conv_id, turn, last_value(token IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS tokens FROM c)
SELECT * FROM l WHERE tokens IS NOT NULL""",
    "topic_propagation": """WITH c AS (SELECT conv_id, turn, CASE WHEN length(text) % 4 <> 0 THEN 't' || (length(text) % 2) END AS t FROM conversations),
w AS (SELECT *, lag(t) OVER o AS b, lead(t) OVER o AS a FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, coalesce(t, CASE WHEN a = b THEN b END) AS resolved FROM w""",
    "root_topic": """SELECT conv_id, arg_min('t' || (length(text) % 2), turn) FILTER (WHERE length(text) % 4 <> 0) AS topic FROM conversations GROUP BY 1""",
}
