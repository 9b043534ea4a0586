"""Registered queries over detections, label trees and plug-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import detection as dt
from quillmark.plans.ordered_queries import _DEEP, _deep
from quillmark.sources.corpus import PARTS_SQL, QUESTIONS_SQL, parts, questions, table


def _spans(spark, d):
    p = _deep(spark, d)
    own = F.concat(F.lit("("), F.regexp_extract("deep", r"\(([a-z]+)\)$", 1), F.lit(") "), F.col("name"), F.lit(" ["), F.col("marks").cast("string"), F.lit("]"))
    return p.select("question_id", "ord", (F.col("price").cast("int") % 500).alias("x0"), own.alias("text"))


def section_labels(spark, d):
    return dt.section_labels(_spans(spark, d), 500).select("question_id", "ord", "label", "kind")


def mark_boxes(spark, d):
    return dt.mark_boxes(_spans(spark, d), "question_id", 500, "ord").select("question_id", "ord", "value")


def right_edges(spark, d):
    p = parts(spark, d)
    own = p.select("question_id", "ord", F.col("y").alias("top"), (F.col("y") + 20).alias("bottom"))
    marks = p.filter("ord % 2 = 0").select("question_id", (F.col("y") + 5).alias("y"), (F.col("price").cast("int") % 600).alias("edge"), F.col("ord").alias("mark_ord"))
    return dt.right_edges(own, marks, "question_id", 500, 10)


def label_ancestors(spark, d):
    return _deep(spark, d).select("question_id", "ord", F.array_join(dt.proper_ancestors(F.col("deep")), ">").alias("path"))


def _nodes(spark, d):
    p = _deep(spark, d)
    return p.select("question_id", F.explode(F.array("label", "deep")).alias("label")).distinct()


def leaf_labels(spark, d):
    return dt.leaves(_nodes(spark, d), "question_id", "label")


def pinned_descendants(spark, d):
    picked = parts(spark, d).filter("marks = 6").select("question_id", "label")
    return dt.descendants(_nodes(spark, d), picked, "question_id", "label")


def tree_marks(spark, d):
    return dt.tree_marks(_deep(spark, d).select("question_id", F.col("deep").alias("label"), "marks"), "question_id", "label").select("question_id", "label", "marks", "source")


def overlapping_siblings(spark, d):
    p = parts(spark, d).select("question_id", "ord", F.col("y").alias("top"), (F.col("y") + 25).alias("bottom"))
    return dt.overlapping_siblings(p, "question_id")


def page_offsets(spark, d):
    rows = parts(spark, d).select("question_id", F.floor(F.col("y") / 60).alias("page"), (F.col("price").cast("int") % 500).alias("x"))
    return dt.page_offsets(rows, "question_id", "page", "x")


def plugin_discovery(spark, d):
    s = table(spark, d, "supplier")
    m = s.select(F.col("s_name").alias("path"), F.when(F.col("s_suppkey") % 13 == 0, "bad code").otherwise(F.lpad((F.col("s_suppkey") % 40).cast("string"), 4, "0")).alias("code"), F.when(F.col("s_suppkey") % 17 == 0, " ").otherwise(F.col("s_name")).alias("name"), (F.col("s_acctbal") > 9000).alias("flagged"))
    return dt.discovered_plugins(m).select("code", "path", "is_default")


def composition(spark, d):
    p = parts(spark, d).join(questions(spark, d).select("question_id", "exam_code", "year"), "question_id")
    return dt.composed(p, ["exam_code", "year"]).select("exam_code", "year", "question_id", "ord", "seq", "has_header")


QUERIES = {f.__name__: f for f in (section_labels, mark_boxes, right_edges, label_ancestors, leaf_labels, pinned_descendants, tree_marks, overlapping_siblings, page_offsets, plugin_discovery, composition)}

_SPANS = _DEEP + ", spans AS (SELECT question_id, ord, marks, CAST(trunc(price)::BIGINT % 500 AS INTEGER) AS x0, CASE WHEN ord % 3 <> 1 THEN roman ELSE substr('abcdefghijklmnopqrstuvwxyz', ord, 1) END AS l FROM deep)\n"
_NODES = _DEEP + ", nodes AS (SELECT question_id, label FROM deep UNION SELECT question_id, deep FROM deep)\n"
SQL = {
    "section_labels": _SPANS + "SELECT question_id, ord, l AS label, CASE WHEN regexp_full_match(l, '[ivx]+') THEN 'roman' ELSE 'letter' END AS kind FROM spans WHERE x0 < 175",
    "mark_boxes": _SPANS + ", a AS (SELECT question_id, arg_min(x0, ord) AS anchor FROM spans WHERE x0 >= 250 GROUP BY 1) SELECT question_id, ord, marks AS value FROM spans LEFT JOIN a USING (question_id) WHERE anchor IS NULL OR x0 >= 0.9 * anchor",
    "right_edges": f"""WITH {PARTS_SQL}, m AS (SELECT question_id, y + 5 AS my, trunc(price)::BIGINT % 600 AS edge, ord AS mo FROM parts WHERE ord % 2 = 0)
SELECT p.question_id, p.ord, CAST(coalesce(least(500, arg_min(edge, mo) + 10), 500) AS INTEGER) AS "right" FROM parts p LEFT JOIN m ON m.question_id = p.question_id AND my >= y AND my <= y + 70 GROUP BY 1, 2""",
    "label_ancestors": _DEEP + "SELECT question_id, ord, CASE WHEN ord % 3 <> 1 THEN question_id || '>' || label ELSE CAST(question_id AS VARCHAR) END AS path FROM deep",
    "leaf_labels": _NODES + "SELECT question_id, label FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes o WHERE o.question_id = n.question_id AND starts_with(o.label, n.label || '('))",
    "pinned_descendants": _NODES + "SELECT DISTINCT n.question_id, n.label FROM nodes n JOIN deep p ON p.question_id = n.question_id AND p.marks = 6 AND (n.label = p.label OR starts_with(n.label, p.label || '('))",
    "tree_marks": _DEEP + """, u AS (SELECT question_id, CAST(question_id AS VARCHAR) AS label, marks, false AS own FROM deep UNION ALL SELECT question_id, label, marks, false FROM deep WHERE ord % 3 <> 1 UNION ALL SELECT question_id, deep, marks, true FROM deep)
SELECT question_id, label, CAST(sum(marks) AS BIGINT) AS marks, CASE WHEN bool_or(own) THEN 'explicit' ELSE 'aggregate' END AS source FROM u GROUP BY 1, 2""",
    "overlapping_siblings": f"WITH {PARTS_SQL} SELECT a.question_id, a.ord AS a, b.ord AS b FROM parts a JOIN parts b ON a.question_id = b.question_id AND a.ord < b.ord AND a.y + 25 > b.y AND b.y + 25 > a.y",
    "page_offsets": f"""WITH {PARTS_SQL}, m AS (SELECT question_id, CAST(floor(y / 60) AS BIGINT) AS page, avg(CAST(trunc(price)::BIGINT % 500 AS DOUBLE)) AS mean FROM parts GROUP BY 1, 2)
SELECT question_id, page, CAST(coalesce(trunc(mean - lag(mean) OVER (PARTITION BY question_id ORDER BY page)), 0) AS INTEGER) AS "offset" FROM m""",
    "plugin_discovery": """WITH m AS (SELECT s_name AS path, CASE WHEN s_suppkey % 13 = 0 THEN 'bad code' ELSE lpad(CAST(s_suppkey % 40 AS VARCHAR), 4, '0') END AS code, CASE WHEN s_suppkey % 17 = 0 THEN ' ' ELSE s_name END AS name, s_acctbal > 9000 AS flagged FROM supplier),
f AS (SELECT * FROM m WHERE regexp_full_match(code, '[A-Za-z0-9]{1,10}') AND trim(name) <> '' QUALIFY row_number() OVER (PARTITION BY code ORDER BY path) = 1)
SELECT code, path, code = coalesce((SELECT arg_max(code, path) FROM f WHERE flagged), (SELECT min(code) FROM f)) AS is_default FROM f""",
    "composition": f"""WITH {QUESTIONS_SQL}, {PARTS_SQL} SELECT exam_code, year, question_id, ord, CAST(dense_rank() OVER (PARTITION BY exam_code, year ORDER BY question_id) AS INTEGER) AS seq,
 row_number() OVER (PARTITION BY exam_code, year, question_id ORDER BY ord) = 1 AS has_header FROM parts JOIN (SELECT question_id, exam_code, year FROM questions) USING (question_id)""",
}
