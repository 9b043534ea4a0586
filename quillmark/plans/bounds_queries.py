"""Registered queries over extents, bounds, clusters and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import bounds as bd
from quillmark.operators import pagination
from quillmark.operators.facets import is_unknown
from quillmark.plans.tree_queries import _N, _nodes
from quillmark.sources.corpus import EVENTS_SQL, PARTS_SQL, QUESTIONS_SQL, events, kept_parts, parts, questions

_RUN = ["exam_code", "year"]


def _labels(spark, d, p=None):
    return (p or parts(spark, d)).select("question_id", "ord", F.when((F.col("ord") % 3 == 1), "letter").otherwise("roman").alias("kind"), "y")


def label_extents(spark, d):
    return bd.label_extents(_labels(spark, d), "question_id", F.lit(1000)).select("question_id", "ord", "kind", "y", "y_end")


def _extents(spark, d):
    return bd.label_extents(_labels(spark, d), "question_id", F.lit(1000)).select("question_id", "ord", "y", "y_end")


def _marks(spark, d, p=None):
    return (p or parts(spark, d)).filter("marks <> 3").select("question_id", (100 - F.col("ord")).alias("mark_ord"), (F.col("y") + F.col("price").cast("int") % 60).alias("my"), (F.col("y") + F.col("price").cast("int") % 60 + 15).alias("bottom"))


def part_first_marks(spark, d):
    return bd.first_marks(_extents(spark, d), _marks(spark, d), "question_id").select("question_id", "ord", "mark_bottom")


def detected_bounds(spark, d):
    return bd.detected_bounds(_extents(spark, d), _marks(spark, d), "question_id", 1000).select("question_id", "ord", "bottom", "issue")


def final_bounds(spark, d):
    p = bd.detected_bounds(_extents(spark, d), _marks(spark, d), "question_id", 1000)
    left = parts(spark, d).select("question_id", "ord", (F.col("price").cast("int") % 50).alias("label_left"))
    return bd.final_bounds(p.join(left, ["question_id", "ord"])).select("question_id", "ord", "left", "top", "bottom")


def inline_bounds(spark, d):
    p = kept_parts(spark, d, "question_id", "ord", "y", "marks", "price")
    roots = p.groupBy("question_id").agg((F.min("y") - F.col("question_id") % 20).alias("root_top"))
    return bd.inline_bounds(_labels(spark, d, p), _marks(spark, d, p), roots, "question_id", 1000)


def placed_bounds(spark, d):
    p = parts(spark, d)
    own = p.select("question_id", "ord", "y", (F.col("y") + 20).alias("bottom"), (F.col("price").cast("int") % 50).alias("label_left"))
    marks = p.filter("ord % 2 = 0").select("question_id", (F.col("y") + 5).alias("y"), (F.col("price").cast("int") % 600).alias("edge"), F.col("ord").alias("mark_ord"))
    return bd.placed_bounds(own, marks, "question_id", 700).select("question_id", "ord", "left", "top", "right", "bottom")


def value_clusters(spark, d):
    rows = parts(spark, d).select("question_id", "ord", (F.col("price").cast("int") % 300).alias("v"))
    return bd.value_clusters(rows, "question_id", "v", 20).select("question_id", "ord", "cluster")


def mark_edges(spark, d):
    m = parts(spark, d).select("question_id", (F.col("y") % 40).alias("y"), (F.col("price").cast("int") % 400).alias("right"))
    return bd.edges_by_height(m, ["question_id"])


def question_extents(spark, d):
    n = events(spark, d).select("user_id", (F.col("at") % 9).cast("int").alias("page"), F.col("value").cast("int").alias("y"), F.col("event_id").alias("n"))
    return bd.question_extents(n, "user_id", F.lit(9), 842).select("user_id", "n", "end_page", "end_y")


def region_relations(spark, d):
    return bd.region_pairs(parts(spark, d).select("question_id", "ord", F.col("y").alias("top"), (F.col("y") + F.col("price").cast("int") % 50 + 1).alias("bottom")), "question_id")


def tree_problems(spark, d):
    n = _nodes(spark, d).withColumn("marks", F.when(F.col("top") % 31 == 0, -1).otherwise(F.col("marks"))).withColumn("label", F.when((F.col("kind") == "letter") & (F.col("top") % 13 == 0), F.lit("x")).otherwise(F.col("label")))
    return bd.tree_problems(n.select("question_id", "label", "parent", "marks", "top", "bottom"))


def built_marks(spark, d):
    n = _nodes(spark, d).withColumn("marks", F.when((F.col("kind") == "roman") & (F.col("marks") != 2), F.col("marks")).when((F.col("kind") == "letter") & (F.col("marks") == 5), F.col("marks"))).withColumn("right", F.col("bottom") % 200)
    return bd.built_marks(n)


def climbed_topics(spark, d):
    n = _nodes(spark, d).withColumn("topic", F.when(F.col("kind") == "roman", F.when(F.col("marks") % 2 == 0, F.concat(F.lit("t"), (F.col("marks") % 3).cast("string"))).otherwise("Unknown")).when(F.col("kind") == "letter", F.when(F.col("marks") == 3, F.lit("L"))))
    return bd.climbed_topics(n, ~is_unknown(F.col("topic"))).select("question_id", "label", "resolved")


def root_topics(spark, d):
    """Root topics after climbing; '00. Unknown' where nothing below is known."""
    return climbed_topics(spark, d).filter(F.col("label") == F.col("question_id").cast("string")).select("question_id", F.coalesce("resolved", F.lit("00. Unknown")).alias("topic"))


def paginate_spaced(spark, d):
    """Every leaf a group; 20 before a new question, 10 before others."""
    p = parts(spark, d).join(questions(spark, d).select("question_id", *_RUN), "question_id")
    from pyspark.sql import Window

    w = Window.partitionBy(*_RUN).orderBy("question_id", "ord")
    g = p.select(*_RUN, F.row_number().over(w).alias("grp"), (40 + F.col("y") % 300).alias("height"), F.when(F.col("ord") == 1, 20).otherwise(10).alias("gap"))
    return pagination.paged(g, _RUN, 900)


def context_slices(spark, d):
    p = parts(spark, d).join(questions(spark, d).select("question_id", *_RUN), "question_id")
    up = F.concat(F.col("question_id").cast("string"), F.lit("#"), F.floor(F.col("ord") / 3).cast("string"))
    leaves = p.select(*_RUN, "question_id", "ord", "label", up.alias("parent"), F.floor(F.col("y") / 30).alias("top"))
    contexts = leaves.filter("ord % 3 = 0").select("question_id", F.col("parent").alias("label"), "top")
    return bd.context_slices(leaves, contexts, _RUN)


QUERIES = {
    f.__name__: f
    for f in (
        label_extents, part_first_marks, detected_bounds, final_bounds, inline_bounds, placed_bounds, value_clusters, mark_edges, question_extents, region_relations, tree_problems, built_marks, climbed_topics,
        root_topics, paginate_spaced, context_slices,
    )
}

_EXT = f"""WITH RECURSIVE {PARTS_SQL}, lab AS (SELECT question_id, ord, CASE WHEN ord % 3 = 1 THEN 'letter' ELSE 'roman' END AS kind, y, price, marks FROM parts),
grp AS (SELECT *, greatest(1, count(*) FILTER (WHERE kind = 'letter') OVER (PARTITION BY question_id ORDER BY y, kind, ord ROWS UNBOUNDED PRECEDING)) AS g FROM lab),
let AS (SELECT *, coalesce(lead(y) OVER (PARTITION BY question_id ORDER BY y, ord), 1000) AS y_end FROM grp WHERE kind = 'letter'),
rom AS (SELECT r.*, coalesce(lead(r.y) OVER (PARTITION BY r.question_id, r.g ORDER BY r.y, r.ord), l.y_end, 1000) AS y_end FROM grp r LEFT JOIN let l ON l.question_id = r.question_id AND l.g = r.g WHERE r.kind = 'roman'),
ext AS (SELECT * FROM let UNION ALL SELECT * FROM rom),
m AS (SELECT question_id, 100 - ord AS mo, y + trunc(price)::BIGINT % 60 AS my, y + trunc(price)::BIGINT % 60 + 15 AS mb FROM parts WHERE marks <> 3),
fm AS (SELECT e.question_id, e.ord, any_value(e.price) AS price, e.y, e.y_end, arg_min(m.mb, m.mo) AS mark_bottom FROM ext e LEFT JOIN m ON m.question_id = e.question_id AND my >= y AND my < y_end GROUP BY 1, 2, 4, 5),
low AS (SELECT question_id, max(mb) AS low FROM m GROUP BY 1),
det AS (SELECT fm.*, CASE WHEN mark_bottom IS NOT NULL THEN least(mark_bottom, y_end) WHEN y_end = 1000 AND low IS NOT NULL THEN least(1000, low + 5) ELSE y_end END AS bottom FROM fm LEFT JOIN low USING (question_id))
"""
_P = f"WITH RECURSIVE {QUESTIONS_SQL}, {PARTS_SQL}"
_CLIMB = _N + """, t AS (SELECT question_id, label, parent, kind, top, CASE WHEN kind = 'roman' THEN CASE WHEN marks % 2 = 0 THEN 't' || (marks % 3) END WHEN kind = 'letter' AND marks = 3 THEN 'L' END AS t FROM nodes),
l AS (SELECT a.question_id, a.label, a.parent, a.top, coalesce(a.t, arg_min(b.t, b.top) FILTER (WHERE b.t IS NOT NULL)) AS t FROM t a LEFT JOIN t b ON b.question_id = a.question_id AND b.parent = a.label AND b.kind = 'roman' WHERE a.kind = 'letter' GROUP BY a.question_id, a.label, a.parent, a.top, a.t),
q AS (SELECT a.question_id, a.label, arg_min(l.t, lpad(CAST(l.top AS VARCHAR), 9, '0') || l.label) FILTER (WHERE l.t IS NOT NULL) AS t FROM t a LEFT JOIN l ON l.question_id = a.question_id WHERE a.kind = 'question' GROUP BY 1, 2),
al AS (SELECT question_id, label, parent, top, t FROM l UNION ALL SELECT question_id, label, parent, top, t FROM t WHERE kind = 'roman'),
s AS (SELECT *, lag(t) OVER w AS b, lead(t) OVER w AS a FROM al WINDOW w AS (PARTITION BY question_id, parent ORDER BY top, label)),
climbed AS (SELECT question_id, label, coalesce(t, CASE WHEN a = b THEN a END) AS resolved FROM s UNION ALL SELECT question_id, label, t FROM q)
"""
SQL = {
    "label_extents": _EXT + "SELECT question_id, ord, kind, y, y_end FROM ext",
    "part_first_marks": _EXT + "SELECT question_id, ord, mark_bottom FROM fm",
    "detected_bounds": _EXT + "SELECT question_id, ord, bottom, CASE WHEN bottom = 1000 THEN 'No mark box detected' END AS issue FROM det",
    "final_bounds": _EXT + "SELECT question_id, ord, CAST(greatest(0, trunc(price)::BIGINT % 50 - 5) AS INTEGER) AS \"left\", greatest(0, y - 6) AS top, greatest(bottom, greatest(0, y - 6) + 1) AS bottom FROM det",
    "inline_bounds": _EXT + """, fr AS (SELECT r.question_id, r.g, r.y AS ry, coalesce(least(f.mark_bottom, r.y_end), r.y_end) AS rb FROM (SELECT *, row_number() OVER (PARTITION BY question_id, g ORDER BY y, ord) AS n FROM rom) r JOIN fm f ON f.question_id = r.question_id AND f.ord = r.ord WHERE n = 1),
rt AS (SELECT question_id, min(y) - question_id % 20 AS root_top FROM parts GROUP BY question_id),
x AS (SELECT e.question_id, e.ord, e.kind, e.y, e.g, ry, CASE WHEN ry IS NULL THEN det.bottom WHEN abs(ry - e.y) < 10 THEN rb ELSE ry END AS bottom FROM ext e JOIN det ON det.question_id = e.question_id AND det.ord = e.ord LEFT JOIN fr ON e.kind = 'letter' AND fr.question_id = e.question_id AND fr.g = e.g)
SELECT x.question_id, x.ord, x.kind, x.y, x.bottom, CASE WHEN x.kind = 'letter' THEN (ry IS NOT NULL AND abs(x.bottom - x.y) < 10) OR abs(x.y - root_top) < 10 ELSE abs(x.y - l.y) < 10 END AS inline, CASE WHEN x.bottom = 1000 THEN 'No mark box detected' END AS issue
FROM x JOIN rt USING (question_id) LEFT JOIN let l ON x.kind = 'roman' AND l.question_id = x.question_id AND l.g = x.g""",
    "placed_bounds": f"""WITH {PARTS_SQL}, m AS (SELECT question_id, ord AS mo, y + 5 AS my, CAST(trunc(price)::BIGINT % 600 AS INTEGER) AS e FROM parts WHERE ord % 2 = 0), c AS (SELECT question_id, max(e) + 5 AS c FROM m GROUP BY 1),
h AS (SELECT p.question_id, p.ord, arg_min(e, mo) AS e FROM parts p JOIN m ON m.question_id = p.question_id AND my >= y AND my <= y + 70 GROUP BY 1, 2)
SELECT p.question_id, p.ord, CAST(greatest(0, trunc(price)::BIGINT % 50 - 5) AS INTEGER) AS "left", greatest(0, y - 6) AS top, CAST(least(coalesce(h.e + 5, c, 700), coalesce(c, 700)) AS INTEGER) AS "right", greatest(y + 20, greatest(0, y - 6) + 1) AS bottom
FROM parts p LEFT JOIN c USING (question_id) LEFT JOIN h ON h.question_id = p.question_id AND h.ord = p.ord""",
    "value_clusters": f"""WITH {PARTS_SQL}, v AS (SELECT question_id, ord, trunc(price)::BIGINT % 300 AS v FROM parts), f AS (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY question_id ORDER BY v) > 20 THEN 1 ELSE 0 END AS f FROM (SELECT DISTINCT question_id, v FROM v)),
c AS (SELECT question_id, v, CAST(sum(f) OVER (PARTITION BY question_id ORDER BY v) AS BIGINT) AS cluster FROM f) SELECT question_id, ord, cluster FROM v JOIN c USING (question_id, v)""",
    "mark_edges": f"WITH {PARTS_SQL}, m AS (SELECT question_id, y % 40 AS y, CAST(trunc(price)::BIGINT % 400 AS INTEGER) AS r FROM parts), e AS (SELECT *, max(r) OVER (PARTITION BY question_id) AS edge FROM m) SELECT DISTINCT question_id, y, edge FROM e WHERE edge - r <= 100",
    "question_extents": f"""WITH {EVENTS_SQL}, n AS (SELECT user_id, CAST(at_ % 9 AS INTEGER) AS page, CAST(trunc(value) AS INTEGER) AS y, event_id AS n FROM ev)
SELECT user_id, n, coalesce(lead(page) OVER w, 9) AS end_page, coalesce(lead(y) OVER w, 842) AS end_y FROM n WINDOW w AS (PARTITION BY user_id ORDER BY page, y, n)""",
    "region_relations": f"""WITH {PARTS_SQL}, r AS (SELECT question_id, ord AS a, y AS t, y + trunc(price)::BIGINT % 50 + 1 AS o, lead(ord) OVER w AS b, lead(y) OVER w AS t2, lead(y + trunc(price)::BIGINT % 50 + 1) OVER w AS o2 FROM parts WINDOW w AS (PARTITION BY question_id ORDER BY ord))
SELECT question_id, a, b, o > t2 AND o2 > t AS overlaps, o <= t2 AS above, t2 >= t AND t2 < o AS holds_top FROM r WHERE b IS NOT NULL""",
    "tree_problems": _N + """, n AS (SELECT question_id, CASE WHEN kind = 'letter' AND top % 13 = 0 THEN 'x' ELSE label END AS label, parent, CASE WHEN top % 31 = 0 THEN -1 ELSE marks END AS marks, top, bottom FROM nodes),
u AS (SELECT DISTINCT question_id, label AS parent, top AS t, bottom AS b FROM n),
c AS (SELECT *, max(bottom) OVER (PARTITION BY question_id, parent ORDER BY top, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x FROM n WHERE parent IS NOT NULL)
SELECT question_id, label, 'repeated' AS problem FROM n GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT question_id, label, 'negative marks' FROM n WHERE marks < 0
 UNION ALL SELECT n.question_id, n.label, 'outside its parent' FROM n JOIN u USING (question_id, parent) WHERE top < t OR bottom > b UNION ALL SELECT question_id, label, 'overlaps' FROM c WHERE x > top""",
    "built_marks": _N + """, n AS (SELECT question_id, label, parent, kind, CASE WHEN kind = 'roman' AND marks <> 2 THEN marks WHEN kind = 'letter' AND marks = 5 THEN marks END AS m, bottom % 200 AS r FROM nodes),
rom AS (SELECT question_id, label, parent, coalesce(m, 0) AS marks, CASE WHEN m IS NULL THEN 'inferred' ELSE 'explicit' END AS source, r FROM n WHERE kind = 'roman'),
lt AS (SELECT n.question_id, n.label, coalesce(m, x.marks, 0) AS marks, CASE WHEN m IS NOT NULL THEN 'explicit' WHEN x.marks IS NOT NULL THEN 'aggregate' ELSE 'inferred' END AS source, coalesce(x.r, n.r) AS r FROM n LEFT JOIN rom x ON x.question_id = n.question_id AND x.parent = n.label WHERE kind = 'letter')
SELECT question_id, label, CAST(marks AS INTEGER) AS marks, source, r AS "right" FROM rom UNION ALL SELECT question_id, label, CAST(marks AS INTEGER), source, r FROM lt
 UNION ALL SELECT question_id, CAST(question_id AS VARCHAR), CAST(sum(marks) AS INTEGER), 'aggregate', min(r) FROM lt GROUP BY 1, 2""",
    "climbed_topics": _CLIMB + "SELECT * FROM climbed",
    "root_topics": _CLIMB + "SELECT question_id, coalesce(resolved, '00. Unknown') AS topic FROM climbed WHERE label = CAST(question_id AS VARCHAR)",
    "paginate_spaced": _P + """, g AS (SELECT exam_code, year, CAST(row_number() OVER (PARTITION BY exam_code, year ORDER BY question_id, ord) AS INTEGER) AS grp, CAST(40 + y % 300 AS INTEGER) AS h, CASE WHEN ord = 1 THEN 20 ELSE 10 END AS gap FROM parts JOIN questions USING (question_id)),
pages AS (SELECT exam_code, year, grp, 1 AS page, 0 AS top, h AS y FROM g WHERE grp = 1
  UNION ALL SELECT n.exam_code, n.year, n.grp, CASE WHEN p.y + gap + n.h <= 900 THEN p.page ELSE p.page + 1 END, CASE WHEN p.y + gap + n.h <= 900 THEN p.y + gap ELSE 0 END, CASE WHEN p.y + gap + n.h <= 900 THEN p.y + gap + n.h ELSE n.h END
  FROM pages p JOIN g n ON n.exam_code = p.exam_code AND n.year = p.year AND n.grp = p.grp + 1)
SELECT exam_code, year, grp, page, top FROM pages""",
    "context_slices": _P + """, l AS (SELECT exam_code, year, question_id, ord, label, question_id || '#' || (ord // 3) AS parent, CAST(floor(y / 30) AS BIGINT) AS top FROM parts JOIN questions USING (question_id)),
c AS (SELECT question_id, parent, top AS ct FROM l WHERE ord % 3 = 0), j AS (SELECT l.*, ct FROM l LEFT JOIN c USING (question_id, parent)),
f AS (SELECT exam_code, year, question_id, parent, min(ord) AS ord, any_value(ct) AS top FROM j WHERE ct IS NOT NULL GROUP BY 1, 2, 3, 4),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id, top ORDER BY ord, parent) AS r FROM f)
SELECT exam_code, year, question_id, ord, parent AS slice, top, true AS context FROM k WHERE r = 1 UNION ALL SELECT exam_code, year, question_id, ord, label, top, false FROM j WHERE ct IS NULL OR ct <> top""",
}
