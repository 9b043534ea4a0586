"""Registered queries over issues, timings, comparisons and plug-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import text as tx
from quillmark.operators import diagnostics as dx
from quillmark.sources.corpus import EVENTS_SQL, events, table

_TYPES = {"view": "layout", "error": "invalid", "click": "letter_gap", "signup": "roman_gap", "purchase": "roman_reset"}
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _issues(spark, d):
    e = events(spark, d)
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _TYPES.items()])
    return e.select(kind.alias("issue_type"), F.col("user_id").alias("pdf_name"), F.concat(F.lit("No mark box "), F.col("props")).alias("message"), F.lpad((F.col("user_id") % 5).cast("string"), 4, "0").alias("exam_code"))


def issue_summary(spark, d):
    return dx.issue_summary(_issues(spark, d))


def issue_classes(spark, d):
    return dx.issue_classes(_issues(spark, d), "exam_code")


def actionable_issues(spark, d):
    return dx.actionable(_issues(spark, d), '"k": 1')


def _timings(spark, d):
    return events(spark, d).groupBy(F.col("user_id").alias("question_id"), F.col("event_type").alias("phase")).agg(F.max("value").alias("seconds"))


def phase_stats(spark, d):
    return dx.phase_averages(_timings(spark, d)).select("phase", F.round("mean", 6).alias("mean"), "least", "most", "n")


def slowest_topk(spark, d):
    return dx.slowest(_timings(spark, d), 5)


def timing_upsert(spark, d):
    t = _timings(spark, d)
    return dx.upserted(t.filter("question_id % 3 <> 0"), t.filter("question_id % 2 = 0").withColumn("seconds", F.col("seconds") * 2), ["question_id", "phase"], "seconds")


def _results(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(F.col("n_name").alias("exam"), F.col("c_mktsegment").alias("variant")).agg(F.round(F.avg("c_acctbal"), 4).alias("accuracy"))


def variant_matrix(spark, d):
    return dx.variant_matrix(_results(spark, d), "exam", "variant", SEGMENTS, "accuracy")


def winner_counts(spark, d):
    return dx.winners(_results(spark, d), "exam", "variant", "accuracy")


def variant_summary(spark, d):
    return _results(spark, d).groupBy("variant").agg(F.round(F.avg("accuracy"), 3).alias("mean"), F.min("accuracy").alias("least"), F.max("accuracy").alias("most"), F.count("*").alias("n"))


def plugin_updates(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("at"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("200"), (F.col("c_custkey") % 3).cast("string"), F.lit("-06-15"))).alias("at"))
    return dx.updates(c, o, "o_custkey", "at")


def folder_sizes(spark, d):
    p = table(spark, d, "pages")
    return p.groupBy(F.regexp_extract("url", r"^https?://([^/]+)/", 1).alias("host")).agg(F.sum(F.octet_length("html").cast("long")).alias("bytes")).select("host", "bytes", tx.human_size(F.col("bytes").cast("double")).alias("shown"))


QUERIES = {f.__name__: f for f in (issue_summary, issue_classes, actionable_issues, phase_stats, slowest_topk, timing_upsert, variant_matrix, winner_counts, variant_summary, plugin_updates, folder_sizes)}

_I = f"""WITH {EVENTS_SQL}, issues AS (SELECT CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items())} END AS issue_type, user_id AS pdf_name,
 'No mark box ' || props AS message, lpad(CAST(user_id % 5 AS VARCHAR), 4, '0') AS exam_code FROM ev)
"""
_T = f"WITH {EVENTS_SQL}, t AS (SELECT user_id AS question_id, event_type AS phase, max(value) AS seconds FROM ev GROUP BY 1, 2)\n"
_R = "WITH res AS (SELECT n_name AS exam, c_mktsegment AS variant, round(avg(c_acctbal), 4) AS accuracy FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)\n"
SQL = {
    "issue_summary": _I + "SELECT issue_type, count(*) AS n, count(DISTINCT pdf_name) AS n_pdfs FROM issues GROUP BY ROLLUP (issue_type)",
    "issue_classes": _I + "SELECT exam_code, count(*) FILTER (WHERE issue_type = 'layout') AS layout, count(*) FILTER (WHERE issue_type = 'invalid') AS invalid, count(*) FILTER (WHERE issue_type NOT IN ('layout', 'invalid')) AS other FROM issues GROUP BY 1",
    "actionable_issues": _I + "SELECT issue_type, count(*) AS n FROM issues WHERE NOT contains(message, '\"k\": 1') GROUP BY 1",
    "phase_stats": _T + "SELECT phase, round(avg(seconds), 6) AS mean, min(seconds) AS least, max(seconds) AS most, count(*) AS n FROM t GROUP BY 1",
    "slowest_topk": _T + "SELECT question_id, round(sum(seconds), 6) AS total, first(phase ORDER BY seconds DESC, phase DESC) AS phase, max(seconds) AS most FROM t GROUP BY 1 ORDER BY total DESC, question_id LIMIT 5",
    "timing_upsert": _T + """, o AS (SELECT * FROM t WHERE question_id % 3 <> 0), n AS (SELECT question_id, phase, seconds * 2 AS s FROM t WHERE question_id % 2 = 0)
SELECT coalesce(o.question_id, n.question_id) AS question_id, coalesce(o.phase, n.phase) AS phase, coalesce(n.s, o.seconds) AS seconds FROM o FULL JOIN n ON o.question_id = n.question_id AND o.phase = n.phase""",
    "variant_matrix": _R + "SELECT exam, " + ", ".join(f"round(avg(accuracy) FILTER (WHERE variant = '{s}'), 6) AS \"{s}\"" for s in SEGMENTS) + " FROM res GROUP BY 1",
    "winner_counts": _R + "SELECT variant, count(*) AS wins FROM (SELECT *, row_number() OVER (PARTITION BY exam ORDER BY accuracy DESC, variant) AS r FROM res) WHERE r = 1 GROUP BY 1",
    "variant_summary": _R + "SELECT variant, round(avg(accuracy), 3) AS mean, min(accuracy) AS least, max(accuracy) AS most, count(*) AS n FROM res GROUP BY 1",
    "plugin_updates": """WITH b AS (SELECT o_custkey, strftime(max(o_orderdate), '%Y-%m-%d') AS bundled FROM orders GROUP BY 1),
i AS (SELECT c_custkey AS o_custkey, CASE WHEN c_custkey % 7 <> 0 THEN '200' || (c_custkey % 3) || '-06-15' END AS installed FROM customer)
SELECT o_custkey, installed, bundled FROM i JOIN b USING (o_custkey) WHERE bundled > coalesce(installed, '')""",
    "folder_sizes": """WITH h AS (SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS host, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes FROM pages GROUP BY 1)
SELECT host, bytes, CASE WHEN bytes < 1024 THEN format('{:.1f} B', bytes::DOUBLE) WHEN bytes < 1048576 THEN format('{:.1f} KB', bytes / 1024.0::DOUBLE) ELSE format('{:.1f} MB', bytes / 1048576.0::DOUBLE) END AS shown FROM h""",
}
