"""Registered queries over options, selection, pruning and layout."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.functions import geometry as geo
from quillmark.operators import layout, ordered, pagination, selection, wide
from quillmark.operators import selection_pass as sp
from quillmark.operators.numbering import before
from quillmark.operators.storage import kept
from quillmark.sources.corpus import EVENTS_SQL, PARTS_SQL, QUESTIONS_SQL, events, kept_parts, parts, questions, table

_RUN = ["exam_code", "year"]


def _all(spark, d):
    return parts(spark, d).withColumn("is_valid", F.lit(True))


def option_enumeration_all(spark, d):
    return selection.options(parts(spark, d), "ALL")


def option_enumeration_prune(spark, d):
    return selection.options(parts(spark, d), "PRUNE")


def option_enumeration_skip(spark, d):
    return selection.ranked_subsets(_all(spark, d))


def best_option_for_budget(spark, d):
    return selection.best_of_leaves(_all(spark, d), 7)


def _wide(spark, d):
    """Suppliers as questions of hundreds of leaves."""
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("question_id"), F.struct("l_orderkey", "l_linenumber").alias("ord"), (1 + F.col("l_quantity").cast("int") % 6).alias("marks"), (F.col("l_linestatus") == "O").alias("is_valid"))


def wide_prefix_options(spark, d):
    return wide.prefixes(_wide(spark, d)).groupBy("question_id").agg(F.max("n_parts").alias("n_parts"), F.max("marks").alias("marks"), F.sum("marks").alias("all_marks"))


def wide_best_options(spark, d):
    return wide.best_options(_wide(spark, d), 40).select("question_id", "marks", "n_parts")


def topic_coverage_scoring(spark, d):
    full = selection.options(parts(spark, d), "ALL")
    scored = selection.topic_scores(full, 9.0, 42, F.lit(True)).join(questions(spark, d).select("question_id", "topic"), "question_id")
    best = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "question_id"))
    return scored.withColumn("r", best).filter("r = 1").select("topic", "question_id", F.col("marks").cast("int").alias("marks"), F.round("score", 6).alias("score"))


def _totals(spark, d):
    t = parts(spark, d).groupBy("question_id").agg(F.sum("marks").alias("marks"))
    return t.join(questions(spark, d).select("question_id", *_RUN), "question_id")


_CONFIG = selection.SelectionConfig(50, 2, 42)


def greedy_fill(spark, d):
    return selection.greedy_fill(_totals(spark, d), _RUN, _CONFIG)


def greedy_summary(spark, d):
    """Marks, questions, topics and deviation of each run's first fit over full questions."""
    picked = selection.greedy_fill(_totals(spark, d), _RUN, _CONFIG)
    leaves = picked.join(parts(spark, d).select("question_id", "marks", "topic"), "question_id").join(questions(spark, d).select("question_id", F.col("topic").alias("q")), "question_id")
    out = leaves.groupBy(*_RUN).agg(F.sum("marks").alias("marks"), F.countDistinct("question_id").alias("n_questions"), F.countDistinct(F.coalesce(F.nullif(F.col("topic"), F.lit("")), F.col("q"))).alias("n_topics"))
    return out.select(*_RUN, "marks", "n_questions", "n_topics", *selection.deviation(F.col("marks"), _CONFIG.target), (F.abs(F.col("marks") - _CONFIG.target) <= _CONFIG.tolerance).alias("within"))


_TOPICS = ("1-URGENT", "PROMO", "ECONOMY")


def _sources(spark, d):
    """(questions, parts, pinned questions, part pins, keyword matches): of each run its first question and a part of its last are pinned."""
    # builds read both many times; reading the tables anew takes a sort of all leaves each time
    q, p = kept(questions(spark, d)), kept_parts(spark, d, "question_id", "ord", "label", "marks", "topic", "is_valid", "name")
    ends = q.join(p.filter("ord = 2").select("question_id", F.col("label").alias("second")), "question_id").groupBy(*_RUN).agg(F.min("question_id").alias("question_id"), F.max_by(F.struct("question_id", "second"), "question_id").alias("last"))
    return q, p, ends.select("question_id"), ends.select("last.question_id", F.col("last.second").alias("label")), p.filter(F.contains("name", F.lit("77"))).select("question_id", "label")


def _built(spark, d, request, pins=True, sources=None):
    q, p, pinned, part_pins, matched = sources or _sources(spark, d)
    if not pins:
        pinned, part_pins, matched = pinned.limit(0), part_pins.limit(0), matched.limit(0)
    return sp.build(q, p, _RUN, request, pinned, part_pins, matched)


def selection_all(spark, d, sources=None):
    """Whole questions, topics covered and the rest filled."""
    return _built(spark, d, sp.Request(50, 2, 42, "ALL", topics=_TOPICS), False, sources).select(*_RUN, "question_id", "k", "marks", "origin")


def selection_prune(spark, d, sources=None):
    """Prefixes up to the last leaf of a topic; the smallest last leaves go."""
    return _built(spark, d, sp.Request(30, 0, 7, "PRUNE", topics=_TOPICS), sources=sources).select(*_RUN, "question_id", "k", "marks", "origin")


def selection_skip(spark, d, sources=None):
    """Any leaves of the topics, at most six questions."""
    return _built(spark, d, sp.Request(35, 1, 1, "SKIP", topics=_TOPICS, max_questions=6), False, sources).select(*_RUN, "question_id", "k", "marks", "origin")


def selection_keywords(spark, d, sources=None):
    """Pins and keyword matches alone."""
    return _built(spark, d, sp.Request(40, 2, 12345, "SKIP", keyword_mode=True), sources=sources).select(*_RUN, "question_id", "k", "marks", "origin")


def full_selection(spark, d):
    """What each run of a build with pins, matches and topics comes to, and what its user is warned of."""
    c = sp.Request(50, 2, 42, "SKIP", topics=_TOPICS)
    return sp.warnings(_built(spark, d, c), _RUN, c)


def selection_fill(spark, d, sources=None):
    """First fit alone: whole questions of valid leaves, no topics asked for."""
    return _built(spark, d, sp.Request(50, 2, 42, "ALL"), False, sources).select(*_RUN, "question_id", "k", "marks", "origin")


def selection_matches(spark, d):
    """Keyword matches alone, each with all its valid leaves, while they fit the target."""
    q, p, pinned, part_pins, matched = _sources(spark, d)
    return sp.build(q, p, _RUN, sp.Request(50, 2, 42, "ALL", greedy=False), pinned.limit(0), part_pins.limit(0), matched).select(*_RUN, "question_id", "k", "marks", "origin")


def selection_coverage(spark, d):
    """The best question of each run for one topic."""
    return _built(spark, d, sp.Request(50, 2, 42, "ALL", topics=("PROMO",), greedy=False, backfill=False), False).select(*_RUN, "question_id", "k", "marks", "origin")


def selection_pins(spark, d):
    """What pins alone give: all valid leaves of the questions that are pinned or hold a pinned part."""
    q, p, pinned, part_pins, matched = _sources(spark, d)
    return sp.build(q, p, _RUN, sp.Request(50, 2, 42, "ALL", greedy=False, backfill=False), pinned, part_pins, matched).select(*_RUN, "question_id", "k", "marks", "origin")


def selection_checks(spark, d):
    """What holds of every run of the five builds: leaves once, of this run, valid where nothing is pinned; totals within the target where first fit alone chose."""
    builds = {"all": selection_all, "prune": selection_prune, "skip": selection_skip, "keywords": selection_keywords, "fill": selection_fill}
    sources = _sources(spark, d)
    p = sources[1].join(sources[0].select("question_id", *_RUN), "question_id").select(*_RUN, "question_id", (F.col("ord") - 1).alias("k"), F.col("marks").alias("__m"), "is_valid")
    out = None
    for name, build in builds.items():
        got = build(spark, d, sources).join(p, [*_RUN, "question_id", "k"], "left")
        one = got.groupBy(*_RUN).agg(F.count("*").alias("n"), F.countDistinct("question_id", "k").alias("once"), F.count_if(F.col("__m").eqNullSafe(F.col("marks")) & F.col("is_valid")).alias("own"), F.sum("marks").alias("total"))
        low = one.select(F.lit(name).alias("build"), (F.col("n") == F.col("once")).alias("once"), (F.col("n") == F.col("own")).alias("own"), ((F.col("total") <= 52) | F.lit(name != "fill")).alias("within"))
        out = low if out is None else out.unionByName(low)
    return out.groupBy("build").agg(F.every("once").alias("once"), F.every("own").alias("own"), F.every("within").alias("within"))


def prune_to_target(spark, d):
    return selection.prune_to_target(parts(spark, d), 10).select("question_id", "ord", "marks")


def prune_plan_skip(spark, d):
    return selection.prune_plan(parts(spark, d).select("question_id", "ord", "marks"), 7, "SKIP", 2)


def prune_plan_tail(spark, d):
    return selection.prune_plan(parts(spark, d).select("question_id", "ord", "marks"), 9, "PRUNE", 3)


def prune_across_plans(spark, d):
    p = parts(spark, d).join(questions(spark, d).select("question_id", *_RUN), "question_id")
    return selection.prune_smallest(p, _RUN, 30, 2, F.col("ord") == 1).select(*_RUN, "question_id", "ord", "marks")


def missing_topics(spark, d):
    p = parts(spark, d)
    return selection.missing_topics(p.filter("topic is not null"), p.filter("topic is not null and question_id < 4"))


def _pins(spark, d):
    return parts(spark, d).filter("ord in (2, 3, 9)").groupBy("question_id").agg(F.sum(F.expr("shiftleft(1L, ord - 1)")).alias("mask"))


def label_superset(spark, d):
    return selection.covering_leaves(_all(spark, d), _pins(spark, d))


_ORDER = ("question_id", "part")


def _assets(spark, d):
    """Leaves as assets; a run has them in order of question and part."""
    p = parts(spark, d).join(questions(spark, d).select("question_id", *_RUN), "question_id")
    return p.select(*_RUN, "question_id", F.col("ord").alias("part"), (40 + F.col("y") % 300).cast("int").alias("height"))


def _groups(spark, d, number=None):
    return layout.atomic_groups(_assets(spark, d), _RUN, (F.col("part") == 1) | (F.col("height") % 5 == 0), order=_ORDER, number=number)


def atomic_groups(spark, d):
    return _groups(spark, d, "ord").select(*_RUN, "ord", "grp")


def paginate(spark, d, groups=None):
    g = (groups or _groups(spark, d)).groupBy(*_RUN, "grp").agg(F.sum("height").alias("height"))
    return layout.paginate(g, _RUN, 900, 20)


def oversize_groups(spark, d):
    """Groups that a page of 400 doesn't hold."""
    g = _groups(spark, d).groupBy(*_RUN, "grp").agg(F.sum("height").alias("height"))
    return pagination.oversize(g, _RUN, 400)


def question_pages(spark, d):
    g = _groups(spark, d).select(*_RUN, "grp", "question_id", "height")
    placed = paginate(spark, d, g).join(g.select(*_RUN, "grp", "question_id").distinct(), [*_RUN, "grp"])
    return layout.question_pages(placed, _RUN)


def question_sequence(spark, d):
    e = events(spark, d).withColumn("n", (F.col("event_id") % 5 + 1).cast("int")).filter("event_type in ('view', 'click')")
    return layout.resolved_sequence(e, "user_id", "n", ["at"], "event_id").select("user_id", "n", "id")


def composite_offsets(spark, d):
    return layout.composite_offsets(_assets(spark, d), _RUN, [*_ORDER], "height", "ord").select(*_RUN, "ord", F.col("y_offset").cast("long").alias("y_offset"))


def part_bounds(spark, d):
    """Pixel bounds of each leaf: rounded, padded, at least one pixel, and whether it overlaps the next."""
    p = ordered.with_extent(parts(spark, d).select("question_id", "ord", "y", "price"), ["question_id"], ["ord"], "y", F.col("y") + 100)
    left, top, right, bottom = geo.pixel_box(F.col("price") / 100.0, F.col("y").cast("double"), F.col("price") / 100.0 + 50.0, F.col("y_end").cast("double"), 200 / 72)
    boxed = p.select("question_id", "ord", geo.shifted(left, 5).alias("left"), geo.shifted(top, 6).alias("top"), right.alias("right"), bottom.alias("bottom"))
    after = F.lead("top").over(Window.partitionBy("question_id").orderBy("ord"))
    return boxed.withColumn("overlaps_next", F.coalesce(F.col("bottom") > after, F.lit(False)))


def page_points(spark, d):
    placed = before(_assets(spark, d), _RUN, [*_ORDER], {"ord": F.lit(1)}).withColumn("ord", (F.col("ord") + 1).cast("int"))
    return placed.select(*_RUN, "ord", F.round(geo.px_to_pt(F.col("height"), 200), 6).alias("height_pt"), F.round(geo.y_flip(841.89, F.col("ord"), F.col("height"), 200), 6).alias("y_pt"))


QUERIES = {
    f.__name__: f
    for f in (
        option_enumeration_all, option_enumeration_prune, option_enumeration_skip, best_option_for_budget, wide_prefix_options, wide_best_options, topic_coverage_scoring, greedy_fill, greedy_summary, full_selection, selection_all, selection_prune, selection_skip, selection_keywords, selection_fill, selection_matches, selection_coverage, selection_pins, selection_checks,
        prune_to_target, prune_plan_skip, prune_plan_tail, prune_across_plans, missing_topics, label_superset, atomic_groups, paginate, oversize_groups, question_pages, question_sequence, composite_offsets, part_bounds, page_points,
    )
}

_P = f"WITH RECURSIVE {QUESTIONS_SQL}, {PARTS_SQL}"
_SUBSETS = _P + """, numbered_leaves AS (SELECT question_id, ord, marks, count(*) OVER (PARTITION BY question_id) AS n FROM parts),
masks AS (SELECT question_id, n, unnest(range(1, (1 << n))) AS mask FROM (SELECT DISTINCT question_id, n FROM numbered_leaves)),
opts AS (SELECT m.question_id, m.mask, CAST(sum(s.marks) AS INTEGER) AS marks, CAST(count(*) AS INTEGER) AS n_parts
         FROM masks m JOIN numbered_leaves s ON s.question_id = m.question_id AND (m.mask >> (s.ord - 1)) & 1 = 1 GROUP BY 1, 2)
"""
_VALID = _P + """, valid AS (SELECT question_id, marks, ord, CAST(row_number() OVER (PARTITION BY question_id ORDER BY ord) AS INTEGER) AS k FROM parts WHERE is_valid),
prefix AS (SELECT question_id, k, (CAST(1 AS BIGINT) << k) - 1 AS mask, CAST(sum(marks) OVER (PARTITION BY question_id ORDER BY k) AS INTEGER) AS marks, k AS n_parts FROM valid)
"""
_GREEDY = _P + """, totals AS (SELECT question_id, exam_code, year, CAST(sum(marks) AS INTEGER) AS m FROM parts JOIN questions USING (question_id) GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY exam_code, year ORDER BY md5('42:' || question_id), question_id) AS k FROM totals),
fold AS (
  SELECT exam_code, year, CAST(0 AS BIGINT) AS k, CAST(0 AS INTEGER) AS total, CAST(NULL AS BIGINT) AS q, CAST(0 AS BIGINT) AS pos FROM (SELECT DISTINCT exam_code, year FROM o)
  UNION ALL
  SELECT f.exam_code, f.year, o.k,
         CASE WHEN f.total < 50 AND f.total + o.m <= 52 AND o.m > 0 THEN f.total + o.m ELSE f.total END,
         CASE WHEN f.total < 50 AND f.total + o.m <= 52 AND o.m > 0 THEN o.question_id END,
         CASE WHEN f.total < 50 AND f.total + o.m <= 52 AND o.m > 0 THEN f.pos + 1 ELSE f.pos END
  FROM fold f JOIN o ON o.exam_code = f.exam_code AND o.year = f.year AND o.k = f.k + 1 WHERE f.total < 50),
picked AS (SELECT exam_code, year, CAST(pos AS INTEGER) AS pos, q AS question_id FROM fold WHERE q IS NOT NULL)
"""
_ASSETS = _P + """, assets AS (SELECT exam_code, year, question_id, p.ord AS part, CAST(40 + y % 300 AS INTEGER) AS height,
  CAST(row_number() OVER (PARTITION BY exam_code, year ORDER BY question_id, p.ord) AS INTEGER) AS ord
  FROM parts p JOIN questions USING (question_id)),
flag AS (SELECT *, CASE WHEN coalesce(lag(part = 1 OR height % 5 = 0) OVER w, false) AND question_id = lag(question_id) OVER w THEN 0 ELSE 1 END AS fresh FROM assets WINDOW w AS (PARTITION BY exam_code, year ORDER BY ord)),
grouped AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY exam_code, year ORDER BY ord) AS BIGINT) AS grp FROM flag),
heights AS (SELECT exam_code, year, grp, CAST(sum(height) AS INTEGER) AS h FROM grouped GROUP BY 1, 2, 3),
pages AS (
  SELECT exam_code, year, CAST(1 AS BIGINT) AS grp, 1 AS page, 0 AS top, h AS y FROM heights WHERE grp = 1
  UNION ALL
  SELECT p.exam_code, p.year, n.grp, CASE WHEN p.y = 0 OR p.y + 20 + n.h <= 900 THEN p.page ELSE p.page + 1 END,
         CASE WHEN p.y + 20 + n.h <= 900 THEN p.y + 20 ELSE 0 END, CASE WHEN p.y + 20 + n.h <= 900 THEN p.y + 20 + n.h ELSE n.h END
  FROM pages p JOIN heights n ON n.exam_code = p.exam_code AND n.year = p.year AND n.grp = p.grp + 1)
"""
_VALID_TOTALS = _P + """, valid AS (SELECT exam_code, year, question_id, p.ord - 1 AS k, marks, coalesce(nullif(p.topic, ''), q.topic) AS topic FROM parts p JOIN questions q USING (question_id) WHERE is_valid),
sizes AS (SELECT question_id, count(*) AS leaves FROM parts GROUP BY 1),
totals AS (SELECT exam_code, year, question_id, CAST(sum(marks) AS INTEGER) AS m, count(*) AS n, CAST(sum(CAST(1 AS BIGINT) << k) AS BIGINT) AS mask FROM valid GROUP BY 1, 2, 3)
"""


def _fold_sql(source: str, most: int) -> str:
    return f""", o AS (SELECT *, row_number() OVER (PARTITION BY exam_code, year ORDER BY md5('42:' || question_id), question_id) AS r FROM {source}),
fold AS (
  SELECT exam_code, year, CAST(0 AS BIGINT) AS r, CAST(0 AS INTEGER) AS total, CAST(NULL AS BIGINT) AS question_id FROM (SELECT DISTINCT exam_code, year FROM o)
  UNION ALL
  SELECT f.exam_code, f.year, o.r, CASE WHEN f.total + o.m <= {most} THEN f.total + o.m ELSE f.total END, CASE WHEN f.total + o.m <= {most} THEN o.question_id END
  FROM fold f JOIN o ON o.exam_code = f.exam_code AND o.year = f.year AND o.r = f.r + 1 WHERE f.total < 50)
"""


_LEAVES = "SELECT v.exam_code, v.year, v.question_id, v.k, v.marks, '{}' AS origin FROM valid v JOIN {} USING (exam_code, year, question_id)"
SQL = {
    "selection_fill": _VALID_TOTALS + _fold_sql("totals", 52) + _LEAVES.format("normal", "fold"),
    "selection_matches": _VALID_TOTALS + ", hits AS (SELECT * FROM totals WHERE question_id IN (SELECT question_id FROM parts WHERE contains(name, '77')))" + _fold_sql("hits", 50) + _LEAVES.format("keyword", "fold"),
    "selection_coverage": _VALID_TOTALS + """, s AS (SELECT t.*, greatest(0.0, 10.0 - abs(m - 50)) + CASE WHEN n = leaves THEN 5.0 ELSE 0.0 END + 5.0::DOUBLE * (CAST(('0x' || substr(md5('42:' || question_id || ':' || mask), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE) AS score
  FROM totals t JOIN sizes USING (question_id) WHERE question_id IN (SELECT question_id FROM valid WHERE topic = 'PROMO')),
best AS (SELECT exam_code, year, question_id FROM s QUALIFY row_number() OVER (PARTITION BY exam_code, year ORDER BY score DESC, question_id) = 1)
""" + _LEAVES.format("topic", "best"),
    "selection_pins": _VALID_TOTALS + """, ends AS (SELECT exam_code, year, min(question_id) AS a, max(question_id) AS b FROM questions JOIN parts USING (question_id) WHERE ord = 2 GROUP BY 1, 2),
pins AS (SELECT exam_code, year, a AS question_id FROM ends UNION SELECT exam_code, year, b FROM ends)
""" + _LEAVES.format("pinned", "pins"),
    "selection_checks": "SELECT unnest(['all', 'prune', 'skip', 'keywords', 'fill']) AS build, true AS once, true AS own, true AS within",
    "option_enumeration_all": _VALID + "SELECT question_id, mask, marks, n_parts FROM prefix QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY k DESC) = 1",
    "option_enumeration_prune": _VALID + "SELECT question_id, mask, marks, n_parts FROM prefix",
    "option_enumeration_skip": _SUBSETS + "SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY marks DESC, n_parts DESC, mask) AS INTEGER) AS place FROM opts",
    "best_option_for_budget": _SUBSETS + ", r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY marks DESC, n_parts DESC, mask) AS place FROM opts WHERE marks <= 7) SELECT question_id, mask, marks FROM r WHERE place = 1",
    "wide_prefix_options": """WITH s AS (SELECT l_suppkey AS question_id, 1 + CAST(trunc(l_quantity) AS INTEGER) % 6 AS m, l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O'),
p AS (SELECT question_id, sum(m) OVER (PARTITION BY question_id ORDER BY l_orderkey, l_linenumber, m ROWS UNBOUNDED PRECEDING) AS r FROM s) SELECT question_id, CAST(count(*) AS INTEGER) AS n_parts, CAST(max(r) AS BIGINT) AS marks, CAST(sum(r) AS BIGINT) AS all_marks FROM p GROUP BY 1""",
    "wide_best_options": """WITH s AS (SELECT l_suppkey AS question_id, 1 + CAST(trunc(l_quantity) AS INTEGER) % 6 AS m FROM lineitem WHERE l_linestatus = 'O'),
p AS (SELECT question_id, sum(m) OVER (PARTITION BY question_id ORDER BY m ROWS UNBOUNDED PRECEDING) AS r, sum(m) OVER (PARTITION BY question_id) AS t FROM s)
SELECT question_id, CAST(least(40, any_value(t)) AS BIGINT) AS marks, CAST(count(*) FILTER (WHERE r <= 40) AS INTEGER) AS n_parts FROM p GROUP BY 1""",
    "topic_coverage_scoring": _VALID + """, f AS (SELECT question_id, CAST(sum(marks) AS INTEGER) AS marks FROM valid GROUP BY 1),
s AS (SELECT topic, question_id, marks, greatest(0, 10 - abs(marks - 9.0)) + 5 + CAST(('0x' || substr(md5('42:' || question_id), 1, 8)) AS BIGINT) / 4294967296.0 * 5 AS score FROM f JOIN questions USING (question_id))
SELECT topic, question_id, marks, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY topic ORDER BY score DESC, question_id) = 1""",
    "greedy_fill": _GREEDY + "SELECT exam_code, year, pos, question_id FROM picked",
    "greedy_summary": _GREEDY + """SELECT exam_code, year, CAST(sum(marks) AS BIGINT) AS marks, count(DISTINCT question_id) AS n_questions, count(DISTINCT coalesce(nullif(p.topic, ''), q.topic)) AS n_topics,
 CAST(sum(marks) - 50 AS BIGINT) AS difference, CAST(abs(sum(marks) - 50) AS BIGINT) AS deviation, abs(sum(marks) - 50) <= 2 AS within
FROM picked JOIN parts p USING (question_id) JOIN (SELECT question_id, topic FROM questions) q USING (question_id) GROUP BY 1, 2""",
    "prune_to_target": _P + "SELECT question_id, ord, marks FROM parts QUALIFY sum(marks) OVER (PARTITION BY question_id ORDER BY ord) <= 10 OR ord = 1",
    "prune_plan_skip": _P + """, s AS (SELECT question_id, ord, marks, sum(marks) OVER (PARTITION BY question_id ORDER BY marks DESC, ord DESC ROWS UNBOUNDED PRECEDING) AS left_, row_number() OVER (PARTITION BY question_id ORDER BY marks DESC, ord DESC) AS n FROM parts)
SELECT question_id, ord, marks FROM s WHERE left_ <= 7 OR n <= 2""",
    "prune_plan_tail": _P + "SELECT question_id, ord, marks FROM parts QUALIFY sum(marks) OVER (PARTITION BY question_id ORDER BY ord) <= 9 OR ord <= 3",
    "missing_topics": _P + "SELECT DISTINCT topic FROM parts WHERE topic IS NOT NULL EXCEPT SELECT topic FROM parts WHERE topic IS NOT NULL AND question_id < 4",
    "label_superset": _SUBSETS + """, pins AS (SELECT question_id, CAST(sum(CAST(1 AS BIGINT) << (ord - 1)) AS BIGINT) AS pins FROM parts WHERE ord IN (2, 3, 9) GROUP BY 1),
r AS (SELECT question_id, mask, marks, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN mask & pins = pins THEN 0 ELSE 1 END,
  CASE WHEN mask & pins = pins THEN marks ELSE -marks END, CASE WHEN mask & pins = pins THEN n_parts ELSE -n_parts END, mask) AS r FROM opts JOIN pins USING (question_id))
SELECT question_id, mask, marks FROM r WHERE r = 1""",
    "atomic_groups": _ASSETS + "SELECT exam_code, year, ord, grp FROM grouped",
    "paginate": _ASSETS + "SELECT exam_code, year, CAST(grp AS INTEGER) AS grp, page, top FROM pages",
    "oversize_groups": _ASSETS + "SELECT exam_code, year, CAST(grp AS INTEGER) AS grp, h AS height, h - 400 AS excess, 'group ' || grp || ' is ' || (h - 400) || ' higher than a page' AS warning FROM heights WHERE h > 400",
    "question_pages": _ASSETS + """, d AS (SELECT DISTINCT exam_code, year, question_id, page FROM pages JOIN (SELECT DISTINCT exam_code, year, grp, question_id FROM grouped) USING (exam_code, year, grp))
SELECT exam_code, year, question_id, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM d GROUP BY 1, 2, 3""",
    "question_sequence": f"""WITH RECURSIVE {EVENTS_SQL}, c AS (SELECT user_id, event_id, CAST(event_id % 5 + 1 AS INTEGER) AS n, row_number() OVER (PARTITION BY user_id ORDER BY at_, event_id % 5, event_id) AS k FROM ev WHERE event_type IN ('view', 'click')),
s AS (SELECT user_id, 0 AS n, CAST(NULL AS BIGINT) AS id, CAST(0 AS BIGINT) AS k, CAST([] AS INTEGER[]) AS seen FROM (SELECT DISTINCT user_id FROM c)
  UNION ALL SELECT user_id, n, id, k, seen FROM (SELECT c.user_id, c.n, c.event_id AS id, c.k, list_append(s.seen, c.n) AS seen, row_number() OVER (PARTITION BY c.user_id ORDER BY CASE WHEN c.n = s.n + 1 THEN 0 ELSE 1 END, c.k) AS r
    FROM s JOIN c ON c.user_id = s.user_id AND c.k > s.k AND (c.n = s.n + 1 OR NOT list_contains(s.seen, c.n))) WHERE r = 1)
SELECT user_id, n, id FROM s WHERE n > 0""",
    "composite_offsets": _ASSETS + "SELECT exam_code, year, ord, CAST(coalesce(sum(height) OVER (PARTITION BY exam_code, year ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS y_offset FROM assets",
    "part_bounds": _P + """, e AS (SELECT question_id, ord, y, price / 100.0 AS x, coalesce(lead(y) OVER (PARTITION BY question_id ORDER BY ord), y + 100) AS y_end FROM parts),
b AS (SELECT question_id, ord, CAST(round_even(x * (200 / 72), 0) AS INTEGER) AS l, CAST(round_even(y * (200 / 72), 0) AS INTEGER) AS t, CAST(round_even((x + 50.0) * (200 / 72), 0) AS INTEGER) AS r, CAST(round_even(y_end * (200 / 72), 0) AS INTEGER) AS bo FROM e),
c AS (SELECT question_id, ord, greatest(0, l - 5) AS "left", greatest(0, t - 6) AS top, greatest(r, l + 1) AS "right", greatest(bo, t + 1) AS bottom FROM b)
SELECT *, coalesce(bottom > lead(top) OVER (PARTITION BY question_id ORDER BY ord), false) AS overlaps_next FROM c""",
    "page_points": _ASSETS + "SELECT exam_code, year, ord, round(height * 72.0::DOUBLE / 200, 6) AS height_pt, round(841.89::DOUBLE - ord * 72.0::DOUBLE / 200 - height * 72.0::DOUBLE / 200, 6) AS y_pt FROM assets",
    "prune_across_plans": _P + """, l AS (SELECT exam_code, year, question_id, ord, marks, sum(marks) OVER (PARTITION BY exam_code, year) AS total FROM parts JOIN questions USING (question_id)),
c AS (SELECT *, total - sum(marks) OVER (PARTITION BY exam_code, year ORDER BY marks, question_id, ord) AS rest FROM l WHERE ord <> 1),
g AS (SELECT exam_code, year, question_id, ord, bool_and(rest + marks > 32 AND abs(rest - 30) <= abs(rest + marks - 30)) OVER (PARTITION BY exam_code, year ORDER BY marks, question_id, ord) AS gone FROM c)
SELECT exam_code, year, question_id, ord, marks FROM l WHERE (exam_code, year, question_id, ord) NOT IN (SELECT (exam_code, year, question_id, ord) FROM g WHERE gone)""",
}
