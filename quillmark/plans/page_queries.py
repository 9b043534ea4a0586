"""Registered queries over lines, spans and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import detection_rules as dr
from quillmark.operators import facets
from quillmark.operators.storage import kept
from quillmark.plans.facet_queries import PAPERS, YEARS
from quillmark.sources.corpus import EVENTS_SQL, PARTS_SQL, QUESTIONS_SQL, events, parts, questions, table

_TEXTS = ["IF x > 3 ", "count <- 0 of ", "what is it? ", "12 OUTPUT ", "Total := ", "name ", "ENDED ", "for all of it "]


def _lines(spark, d):
    p = parts(spark, d)
    text = F.concat(F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("y") % 8 + 1).cast("int")), F.when(F.col("marks") == 1, "").otherwise(F.col("name")))
    text = F.when(F.col("ord") % 2 == 0, F.concat(F.col("ord").cast("string"), F.lit(" "), text)).otherwise(text)
    return p.select("question_id", "ord", text.alias("text"), F.when(F.col("marks") % 3 == 0, F.upper("name")).alias("only_span"), "y", "price", "marks", "label")


def pseudo_code_lines(spark, d):
    return _lines(spark, d).select("question_id", "ord", dr.looks_like_code(F.col("text"), F.col("only_span")).alias("code"))


def page_clips(spark, d):
    left, right = dr.page_clip(F.col("s_acctbal") / 100, F.col("s_acctbal") / 100 + 600, 0.05)
    wide_left, wide_right = dr.page_clip(F.col("s_acctbal") / 100, F.col("s_acctbal") / 100 + 600, 0.35)
    return table(spark, d, "supplier").select("s_suppkey", F.round(left, 6).alias("left"), F.round(right, 6).alias("right"), F.round(wide_left, 6).alias("guarded_left"), F.round(wide_right, 6).alias("guarded_right"))


def question_numbers(spark, d):
    lines = _lines(spark, d).select(F.col("question_id").alias("doc"), F.floor(F.col("y") / 60).alias("page"), (F.col("price").cast("int") % 120).alias("x0"), (F.col("y") % 60).alias("y0"), "text", "only_span")
    pages = lines.groupBy("doc", "page").agg(F.concat(F.lit("see Question "), F.max(F.col("y0") % 14).cast("string"), F.lit(", question7")).alias("plain")).withColumn("width", F.lit(500)).withColumn("height", F.lit(60))
    return dr.question_numbers(lines, pages).select("doc", "page", "n", "x", "y", "code")


def _chars(spark, d):
    box = lambda k: F.struct(F.substring("s_name", k, 1).alias("c"), (F.col("s_nationkey") + 5 * k).alias("x0"), (F.lit(10) - F.lit(k) % 3).alias("y0"), (F.col("s_nationkey") + 5 * k + 4).alias("x1"), (F.lit(20) + F.lit(k) % 2).alias("y1"))
    return table(spark, d, "supplier").select("s_suppkey", F.array(*[box(k) for k in range(1, 9)]).alias("chars"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("Supp")).otherwise(F.substring("s_name", 1, 3)).alias("numeral"))


def character_boxes(spark, d):
    c = _chars(spark, d).select("s_suppkey", dr.char_box(F.col("chars")).alias("a"), dr.numeral_box(F.col("chars"), F.col("numeral")).alias("n"))
    return c.select("s_suppkey", F.col("a.x0").alias("x0"), F.col("a.y0").alias("y0"), F.col("a.x1").alias("x1"), F.col("a.y1").alias("y1"), F.col("n.x1").alias("numeral_right"))


def best_candidates(spark, d):
    c = parts(spark, d).select("question_id", (F.col("y") % 3).alias("n"), "ord", F.when(F.col("marks") % 2 == 0, F.col("y")).otherwise(0).alias("y"), (F.col("price").cast("int") % 3 == 0).alias("code"))
    return dr.best_candidates(c, ["question_id", "n"], "ord")


def part_page_groups(spark, d):
    p = parts(spark, d).select("question_id", "ord", F.col("y").alias("top"), (F.col("y") + 8).alias("bottom"))
    return dr.page_groups(p, "question_id", 25).select("question_id", "ord", "page_group")


def _labels(spark, d):
    return parts(spark, d).select("question_id", "ord", "y", (F.col("price").cast("int") % 500).alias("x0"), F.when(F.col("marks") % 3 == 0, "roman").otherwise("letter").alias("kind"), "label")


def label_edges(spark, d):
    return dr.label_edges(_labels(spark, d), "question_id", 40).select("question_id", "ord", "kind", "edge")


def page_shifts(spark, d):
    return dr.page_shift(_labels(spark, d).withColumn("page", F.floor(F.col("y") / 60)), "question_id", "page")


def text_between(spark, d):
    p = kept(parts(spark, d).select("question_id", "ord", "y", "name"))
    spans = p.select("question_id", F.col("y").alias("y0"), (F.col("y") + 12).alias("y1"), F.col("name").alias("text"), "ord")
    return dr.text_between(spans, p.select("question_id", F.col("ord").alias("region"), (F.col("y") - 20).alias("top"), (F.col("y") + 20).alias("bottom")), "question_id")


def labels_on_pages(spark, d):
    pages = parts(spark, d).select("question_id", F.floor(F.col("y") / 60).alias("page")).distinct().select("question_id", "page", (F.col("page") * 60).alias("top"), (F.col("page") * 60 + 60).alias("bottom"))
    return dr.labels_on_pages(pages, _labels(spark, d), "question_id", "roman")


def scheme_pages(spark, d):
    c = table(spark, d, "conversations")
    pages = c.select("conv_id", F.col("turn").alias("page"), F.when(F.length("text") % 3 == 0, F.array((F.length("text") % 7).cast("int"), F.lit(2))).otherwise(F.array().cast("array<int>")).alias("tokens"))
    numbers = c.select("conv_id", (F.length("text") % 5).cast("int").alias("n"))
    return dr.scheme_pages(pages, numbers, "conv_id").select("conv_id", "n", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


def content_edges(spark, d):
    p = parts(spark, d).select("question_id", F.col("topic").alias("sub_topic"), "is_valid", F.col("y").alias("top"), (F.col("y") + 20).alias("bottom"), "ord", (F.col("price").cast("int") % 600).alias("right"))
    return dr.content_edges(p, p.filter("ord % 2 = 0"), "question_id").select("question_id", "content_right", F.array_join("sub_topics", "|").alias("sub_topics"), "is_valid", "top", "bottom")


def span_rows(spark, d):
    p = parts(spark, d)
    line = F.struct((F.col("price") % 500).alias("x0"), F.col("y").cast("double").alias("y0"), (F.col("price") % 500 + F.col("marks") - 1).alias("x1"), (F.col("y") + F.col("ord") % 2).cast("double").alias("y1"), F.when(F.col("marks") == 3, F.array(F.lit(" "))).otherwise(F.array(F.lit(" "), "name")).alias("spans"))
    blocks = p.groupBy(F.col("question_id").alias("doc"), F.lit(1).alias("page")).agg(F.array(F.struct(F.collect_list(line).alias("lines"))).alias("blocks"))
    return dr.span_rows(blocks, 200 / 72, -40).select("doc", "text", "x0", "y0", "x1", "y1")


def build_timing(spark, d):
    """Mean, least and greatest seconds of each kind of run."""
    return events(spark, d).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.count("*").alias("n"))


def facet_string_filters(spark, d):
    """Years and papers as the strings that a picker gives; an empty list lets all pass."""
    q = facets.where_in(questions(spark, d), year=[str(y) for y in YEARS], paper=[str(p) for p in PAPERS], topic=[])
    return q.select("question_id", "year", "paper")


QUERIES = {
    f.__name__: f
    for f in (
        pseudo_code_lines, page_clips, question_numbers, character_boxes, best_candidates, part_page_groups, label_edges, page_shifts, text_between, labels_on_pages,
        scheme_pages, content_edges, span_rows, build_timing, facet_string_filters,
    )
}

_LINES = f"""WITH {PARTS_SQL}, lines AS (SELECT question_id, ord, y, price, marks, CASE WHEN ord % 2 = 0 THEN ord || ' ' ELSE '' END || ['IF x > 3 ', 'count <- 0 of ', 'what is it? ', '12 OUTPUT ', 'Total := ', 'name ', 'ENDED ', 'for all of it '][CAST(y % 8 + 1 AS INTEGER)]
 || CASE WHEN marks = 1 THEN '' ELSE name END AS text, CASE WHEN marks % 3 = 0 THEN upper(name) END AS only_span FROM parts)
, body AS (SELECT *, regexp_replace(trim(text), '^\\d+\\s+', '') AS b FROM lines)
, coded AS (SELECT *, regexp_matches(b, '\\b(?:DECLARE|INPUT|OUTPUT|FOR|NEXT|WHILE|UNTIL|CASE|ELSE|ENDIF|END IF|ELSEIF|THEN)\\b') OR contains(b, ':=') OR regexp_matches(b, '^(?:IF |ELSE|END|REPEAT|UNTIL)', 'i') OR regexp_matches(b, '^[A-Z]\\w*\\s*<-\\s*')
 OR (len(list_filter(regexp_split_to_array(b, '\\s+'), lambda w: w <> '')) <= 2 AND NOT regexp_matches(b, '[.?:;]') AND NOT regexp_matches(b, '\\bquestion\\b', 'i') AND regexp_matches(b, '[a-zA-Z]'))
 OR coalesce(upper(trim(only_span)) = trim(only_span) AND lower(trim(only_span)) <> trim(only_span), false) AS code FROM body)
"""
_LAB = f"WITH {PARTS_SQL}, labels AS (SELECT question_id, ord, y, CAST(trunc(price)::BIGINT % 500 AS INTEGER) AS x0, CASE WHEN marks % 3 = 0 THEN 'roman' ELSE 'letter' END AS kind, label FROM parts)"
SQL = {
    "pseudo_code_lines": _LINES + "SELECT question_id, ord, code FROM coded",
    "page_clips": "SELECT s_suppkey, round(s_acctbal / 100 + 600 * 0.05::DOUBLE, 6) AS \"left\", round(s_acctbal / 100 + 600 - 600 * 0.05::DOUBLE, 6) AS \"right\", round(s_acctbal / 100, 6) AS guarded_left, round(s_acctbal / 100 + 600, 6) AS guarded_right FROM supplier",
    "question_numbers": _LINES + """, own AS (SELECT question_id AS doc, CAST(floor(y / 60) AS BIGINT) AS page, trim(text) AS text, code, CAST(trunc(price)::BIGINT % 120 AS DOUBLE) AS x, CAST(y % 60 AS DOUBLE) AS y FROM coded),
f AS (SELECT doc, page, CAST(regexp_extract(text, '^([1-9]\\d?)(?:\\s|$|\\()', 1) AS INTEGER) AS n, x, y, code FROM own WHERE regexp_extract(text, '^([1-9]\\d?)(?:\\s|$|\\()', 1) <> '' AND length(text) - length(replace(text, '.', '')) < 4 AND x <= 60 AND y <= 55.2),
m AS (SELECT doc, page, unnest([CAST(max(CAST(y AS BIGINT) % 14) AS INTEGER), 7]) AS n FROM own GROUP BY 1, 2)
SELECT * FROM f UNION ALL SELECT doc, page, n, 0.0::DOUBLE, 0.0::DOUBLE, false FROM m WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc = m.doc AND f.page = m.page AND f.n = m.n)""",
    "character_boxes": """SELECT s_suppkey, s_nationkey + 5 AS x0, 8 AS y0, s_nationkey + 44 AS x1, 21 AS y1,
 CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN substr(s_name, 1, 4) = 'Supp' THEN s_nationkey + 24 END ELSE s_nationkey + 19 END AS numeral_right FROM supplier""",
    "best_candidates": f"""WITH {PARTS_SQL}, c AS (SELECT question_id, y % 3 AS n, ord, marks % 2 = 0 AND y > 0 AS is_real, trunc(price)::BIGINT % 3 = 0 AS code FROM parts),
l AS (SELECT question_id, n, list({{'k': ord, 'r': is_real, 'c': code, 'd': is_real AND NOT code}} ORDER BY ord) AS c FROM c GROUP BY 1, 2)
SELECT question_id, n, list_reduce(c, lambda a, x: CASE WHEN a.d THEN a WHEN NOT a.r AND x.r THEN {{'k': x.k, 'r': x.r, 'c': x.c, 'd': NOT x.c}} WHEN a.c AND NOT x.c THEN {{'k': x.k, 'r': x.r, 'c': x.c, 'd': true}} ELSE a END).k AS ord FROM l""",
    "part_page_groups": f"WITH {PARTS_SQL}, f AS (SELECT question_id, ord, y, CASE WHEN y - lag(y + 8) OVER (PARTITION BY question_id ORDER BY y, ord) > 25 THEN 1 ELSE 0 END AS f FROM parts) SELECT question_id, ord, CAST(sum(f) OVER (PARTITION BY question_id ORDER BY y, ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS page_group FROM f",
    "label_edges": _LAB + """, f AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY question_id, kind ORDER BY y, ord) > 40 THEN 1 ELSE 0 END AS f FROM labels),
p AS (SELECT *, sum(f) OVER (PARTITION BY question_id, kind ORDER BY y, ord ROWS UNBOUNDED PRECEDING) AS p FROM f) SELECT question_id, ord, kind, min(x0) OVER (PARTITION BY question_id, kind, p) AS edge FROM p""",
    "page_shifts": _LAB + """, m AS (SELECT question_id, CAST(floor(y / 60) AS BIGINT) AS page, avg(CAST(x0 AS DOUBLE)) FILTER (WHERE kind = 'letter') AS l, avg(CAST(x0 AS DOUBLE)) FILTER (WHERE kind = 'roman') AS r FROM labels GROUP BY 1, 2)
SELECT question_id, page, CAST(coalesce(trunc(l - lag(l) OVER w), trunc(r - lag(r) OVER w), 0) AS INTEGER) AS shift FROM m WINDOW w AS (PARTITION BY question_id ORDER BY page)""",
    "text_between": f"WITH {PARTS_SQL} SELECT r.question_id, r.ord AS region, coalesce(string_agg(s.name, ' ' ORDER BY s.y, s.ord), '') AS text FROM parts r LEFT JOIN parts s ON s.question_id = r.question_id AND s.y + 12 > r.y - 20 AND s.y < r.y + 20 GROUP BY 1, 2",
    "labels_on_pages": _LAB + ", pg AS (SELECT DISTINCT question_id, CAST(floor(y / 60) AS BIGINT) AS page FROM labels) SELECT pg.question_id, page, label FROM pg JOIN labels l ON l.question_id = pg.question_id AND kind = 'roman' AND y BETWEEN page * 60 AND page * 60 + 60",
    "scheme_pages": """WITH c AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN [CAST(length(text) % 7 AS INTEGER), 2] END AS t, CAST(length(text) % 5 AS INTEGER) AS n FROM conversations),
l AS (SELECT conv_id, turn, last_value(t IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS t FROM c), e AS (SELECT DISTINCT conv_id, turn, unnest(t) AS n FROM l)
SELECT conv_id, n, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS pages FROM e WHERE (conv_id, n) IN (SELECT (conv_id, n) FROM c) GROUP BY 1, 2""",
    "content_edges": f"""WITH {PARTS_SQL} SELECT question_id, CAST(max(trunc(price)::BIGINT % 600) FILTER (WHERE ord % 2 = 0) AS INTEGER) AS content_right, coalesce(string_agg(DISTINCT topic, '|' ORDER BY topic), '') AS sub_topics,
 bool_and(is_valid) AS is_valid, min(y) AS top, max(y) + 20 AS bottom FROM parts GROUP BY 1""",
    "span_rows": f"""WITH {PARTS_SQL}, r AS (SELECT question_id AS doc, name AS text, CAST(round_even(price % 500 * (200 / 72), 0) AS INTEGER) AS x0, greatest(0, CAST(round_even(y * (200 / 72), 0) AS INTEGER) - 40) AS y0,
 CAST(round_even((price % 500 + marks - 1) * (200 / 72), 0) AS INTEGER) AS x1, greatest(0, CAST(round_even((y + ord % 2) * (200 / 72), 0) AS INTEGER) - 40) AS y1 FROM parts WHERE marks <> 3)
SELECT doc, text, x0, y0, greatest(x1, x0 + 1) AS x1, greatest(y1, y0 + 1) AS y1 FROM r""",
    "build_timing": f"WITH {EVENTS_SQL} SELECT event_type, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS greatest, count(*) AS n FROM ev GROUP BY 1",
    "facet_string_filters": f"WITH {QUESTIONS_SQL} SELECT question_id, year, paper FROM questions WHERE year IN (1996, 1997, 1998) AND paper IN (1, 2, 3)",
}
