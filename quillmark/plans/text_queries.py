"""Registered queries over texts: sanitising, names, topics, search, rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.functions import text as tx
from quillmark.operators import search
from quillmark.sources.corpus import PARTS_SQL, parts, table

KEYWORDS = ["th ing", '"that"', '"der"', "que la", '"idiot"', " ", '"los"']
RULES = [
    search.Rule("english", r"(^|[^\p{L}])the([^\p{L}]|$)", 0.5),
    search.Rule("english", r"(^|[^\p{L}])that([^\p{L}]|$)", 0.5),
    search.Rule("german", r"(^|[^\p{L}])der([^\p{L}]|$)", 0.6),
    search.Rule("german", r"ung[^\p{L}]", 0.4),
    search.Rule("french", r"(^|[^\p{L}])les([^\p{L}]|$)", 0.6),
    search.Rule("french", r"eau[^\p{L}]", 0.5),
    search.Rule("spanish", r"ción", 0.8),
    search.Rule("spanish", r"(^|[^\p{L}])los([^\p{L}]|$)", 0.4),
    search.Rule("shouting", r"!!", 0.9),
    search.Rule("licence", r"Licen[sc]e", 0.6),
]
PATTERNS = [("!!", 0), (r"\*\*\*", 0), ("idiot", 1), ("the", 1), (" \\| ", 0)]


def _docs(spark, d):
    return table(spark, d, "documents")


def text_sanitise(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(tx.sanitised(F.regexp_replace("text", r"\.", "..."))).alias("sanitised_md5"), F.length(tx.search_form(F.col("text"))).cast("long").alias("n_search"))


def name_parse(spark, d):
    o = table(spark, d, "orders")
    name = F.concat(F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"), F.lit("_"), F.element_at(F.array(F.lit("s"), F.lit("m"), F.lit("w")), (F.col("o_orderkey") % 3 + 1).cast("int")), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.when(F.col("o_orderkey") % 5 == 0, "_ms_").otherwise("_qp_"), (F.col("o_custkey") % 9 + 1).cast("string"), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit(".pdf"))
    n = F.col("name")
    return o.select("o_orderkey", name.alias("name")).select("o_orderkey", tx.year_of(n).alias("year"), tx.paper_of(n).alias("paper"), tx.variant_of(n).alias("variant"), tx.exam_code_of(n).alias("exam_code"), tx.paper_prefix(n).alias("prefix"), F.replace(n, F.lit("_qp_"), F.lit("_ms_")).alias("scheme"))


def topic_canonical(spark, d):
    p = table(spark, d, "part")
    raw = F.concat(F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" "), (F.col("p_size") % 12).cast("string"), F.lit(") "))).when(F.col("p_partkey") % 4 == 1, F.concat((F.col("p_size") % 12).cast("string"), F.lit(". "))).otherwise(""), F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_type")))
    return p.select("p_partkey", tx.canonical_topic(raw).alias("topic"), tx.topic_slug(raw).alias("slug"))


def keyword_search(spark, d):
    return search.keyword_hits(_docs(spark, d), KEYWORDS, "doc_id", "text").select("keyword", "doc_id")


def keyword_counts(spark, d):
    """Documents per keyword and language, a keyword without hits included as 0 over all."""
    hits = search.keyword_hits(_docs(spark, d), KEYWORDS, "doc_id", "text")
    terms = spark.createDataFrame([(k,) for k in KEYWORDS if k.strip()], "keyword string")
    return terms.join(hits.groupBy("keyword").agg(F.countDistinct("doc_id").alias("n")), "keyword", "left").select("keyword", F.coalesce("n", F.lit(0)).alias("n"))


def keyword_filtered_counts(spark, d):
    labels = table(spark, d, "labels").filter("quality = 1").select("doc_id").distinct()
    hits = search.keyword_hits(_docs(spark, d), KEYWORDS, "doc_id", "text").join(labels, "doc_id", "left_semi")
    return hits.groupBy("keyword").agg(F.countDistinct("doc_id").alias("n"))


def keyword_snippets(spark, d):
    return _docs(spark, d).select("doc_id", search.snippet(F.col("text"), "that").alias("snippet"))


def part_keyword_hits(spark, d):
    p = parts(spark, d).select("question_id", "label", F.col("name").alias("text"), F.when(F.col("question_id") % 50 == 0, "general question").alias("root_text"))
    return search.question_hits(p, ["#0000", '"general"', '"Part"']).select("keyword", "question_id", "label")


def rule_classify(spark, d):
    docs = _docs(spark, d)
    return search.classify(search.rule_scores(docs, RULES, "doc_id", "text"), docs.select("doc_id"), "doc_id").select("doc_id", "topic", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"), "reason")


def rule_diagnostics(spark, d):
    docs = _docs(spark, d)
    c = search.classify(search.rule_scores(docs, RULES, "doc_id", "text"), docs.select("doc_id"), "doc_id", 0.8, 0.4)
    return c.groupBy("reason").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 3))


def rule_score_details(spark, d):
    return search.rule_details(_docs(spark, d), RULES, "doc_id", "text").select("doc_id", "topic", F.round("score", 6).alias("score"), "matched", F.round("margin", 6).alias("margin"), "tied")


def pattern_precision(spark, d):
    return search.pattern_precision(_docs(spark, d), table(spark, d, "labels"), PATTERNS, "doc_id", "text", "quality", 5, 0.8)


def capped_candidates(spark, d):
    return search.capped(_docs(spark, d), ["lang"], [F.desc("n_chars"), "doc_id"], 40).select("lang", "doc_id", "place")


def stratified_sample(spark, d):
    return search.stratified_sample(_docs(spark, d).select("doc_id", "lang"), "lang", "doc_id", 50, 42)


def append_dedupe(spark, d):
    """Catalogue append: source ids that are there already are not added; copies among the new ones are."""
    docs = _docs(spark, d)
    return search.new_only(docs.filter("doc_id % 3 <> 0").select(F.col("n_chars"), "doc_id"), docs.filter("doc_id % 3 = 0").select("n_chars"), ["n_chars"]).select("doc_id", "n_chars")


#: More rules than are conditions of one scan.
MANY_RULES = [search.Rule(f"letter {a}", f"(?i){a}{b}[a-z]*{c}", (1 + i % 7) / 10) for i, (a, b, c) in enumerate((a, b, c) for a in "abdefghm" for b in "aeor" for c in "nte")]


def many_rules(spark, d):
    """Scores of 96 rules, by one automaton and the rules that it leaves."""
    return search.rule_scores(_docs(spark, d), MANY_RULES, "doc_id", "text").select("doc_id", "topic", F.round("score", 6).alias("score"))


def sub_topic_match(spark, d):
    """All sub-topics with a matching pattern; a fallback label without one."""
    docs = _docs(spark, d)
    rules = [("lists", r" \| "), ("shout", "!!"), ("mail", r"[a-z0-9.]+@[a-z0-9.]+")]
    found = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in rules]))
    return docs.select("doc_id", F.when(F.size(found) == 0, "00. General").otherwise(F.array_join(found, ",")).alias("sub_topics"))


def checksum(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("sha256"))


def json_decode_validate(spark, d):
    """Decoded props with a reject reason: undecodable, missing key, out of range."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 11 == 0, F.expr("substring(props, 1, 4)")).otherwise(F.col("props")).alias("props"))
    k = F.get_json_object("props", "$.k").cast("int")
    reason = F.when(F.from_json("props", "map<string,string>").isNull() | (F.size(F.from_json("props", "map<string,string>")) == 0), "undecodable").when(k.isNull(), "missing k").when(k > 90, "out of range")
    return e.select("event_id", F.coalesce(k, F.lit(-1)).alias("k"), reason.alias("reject"))


QUERIES = {
    f.__name__: f
    for f in (
        text_sanitise, name_parse, topic_canonical, keyword_search, keyword_counts, keyword_filtered_counts, keyword_snippets, part_keyword_hits, rule_classify,
        rule_diagnostics, rule_score_details, pattern_precision, capped_candidates, stratified_sample, append_dedupe, many_rules, sub_topic_match, checksum, json_decode_validate,
    )
}


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _match_sql(raw: str, column: str) -> str:
    k = search.Keyword.parse(raw)
    if k.exact:
        return f"regexp_matches(coalesce({column}, ''), {_sql_text(f'(?i)(^|{search._EDGE}){search._quoted(k.term)}({search._EDGE}|$)')})"
    return f"contains(replace(lower(coalesce({column}, '')), ' ', ''), {_sql_text(k.term.lower().replace(' ', ''))})"


_HITS = "WITH hits AS (" + " UNION ALL ".join(f"SELECT {_sql_text(k)} AS keyword, doc_id FROM documents WHERE {_match_sql(k, 'text')}" for k in KEYWORDS if k.strip()) + ")\n"
_RULES = "WITH rules(topic, topic_ord, pattern, weight) AS (VALUES " + ", ".join(f"({_sql_text(r.topic)}, {list(dict.fromkeys(x.topic for x in RULES)).index(r.topic)}, {_sql_text(r.pattern)}, {r.weight})" for r in RULES) + """),
scores AS (SELECT doc_id, topic, topic_ord, sum(CAST(weight AS DOUBLE)) AS score FROM documents, rules WHERE regexp_matches(text, pattern) GROUP BY 1, 2, 3),
best AS (SELECT doc_id, topic, score, coalesce(lead(score) OVER w, 0) AS second, row_number() OVER w AS r FROM scores WINDOW w AS (PARTITION BY doc_id ORDER BY round(score, 9) DESC, topic_ord)),
c AS (SELECT d.doc_id, topic, score, score - second AS margin FROM documents d LEFT JOIN (SELECT * FROM best WHERE r = 1) b USING (doc_id))
"""

_DETAILS = "WITH rules(topic, k, pattern, weight) AS (VALUES " + ", ".join(f"({_sql_text(r.topic)}, {k}, {_sql_text(r.pattern)}, {r.weight})" for k, r in enumerate(RULES)) + """),
s AS (SELECT doc_id, topic, sum(CAST(weight AS DOUBLE)) AS score, string_agg(substr(regexp_extract(text, pattern), 1, 50), '|' ORDER BY k) AS matched FROM documents, rules WHERE regexp_matches(text, pattern) GROUP BY 1, 2)
SELECT doc_id, topic, round(score, 6) AS score, matched, round(score - coalesce((SELECT max(o.score) FROM s o WHERE o.doc_id = s.doc_id AND o.topic <> s.topic), 0), 6) AS margin,
 EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.topic <> s.topic AND abs(o.score - s.score) < 1e-9) AS tied FROM s"""


def _reason(least: float, lead: float) -> str:
    return f"CASE WHEN score IS NULL THEN 'no match' WHEN score < {least} THEN 'low score' WHEN margin < {lead} - 1e-9 THEN 'close call' ELSE 'ok' END"


_CANON = "regexp_extract(trim(raw), '^(\\d+)\\s*[.):-]\\s*(.*)$', {})"
SQL = {
    "text_sanitise": """SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(text, '.', '...'), '\\.{3,}', ' ', 'g'), '[\\s\\x{00A0}]+', ' ', 'g'))) AS sanitised_md5,
CAST(length(replace(lower(text), ' ', '')) AS BIGINT) AS n_search FROM documents""",
    "name_parse": """WITH n AS (SELECT o_orderkey, CAST(o_orderkey % 100 AS INTEGER) AS yy, CAST(o_custkey % 9 + 1 AS INTEGER) AS p, CAST(o_orderkey % 9 + 1 AS INTEGER) AS v, lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') AS code,
 ['s', 'm', 'w'][CAST(o_orderkey % 3 + 1 AS INTEGER)] || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS session, o_orderkey % 5 = 0 AS ms FROM orders)
SELECT o_orderkey, CASE WHEN yy >= 50 THEN 1900 + yy ELSE 2000 + yy END AS year, CASE WHEN ms THEN 1 ELSE p END AS paper, CASE WHEN ms THEN 1 ELSE v END AS variant,
 code AS exam_code, code || '_' || session AS prefix, code || '_' || session || '_ms_' || p || v || '.pdf' AS scheme FROM n""",
    "topic_canonical": f"""WITH r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' ' || (p_size % 12) || ') ' WHEN 1 THEN (p_size % 12) || '. ' ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END AS raw FROM part)
SELECT p_partkey, CASE WHEN trim(raw) = '' THEN '00. Unknown' WHEN {_CANON.format(1)} <> '' THEN lpad({_CANON.format(1)}, 2, '0') || '. ' || {_CANON.format(2)} ELSE trim(raw) END AS topic,
 trim(regexp_replace(lower(regexp_replace(raw, '^\\s*\\d+\\s*[.):-]\\s*', '')), '\\s+', ' ', 'g')) AS slug FROM r""",
    "keyword_search": _HITS + "SELECT keyword, doc_id FROM hits",
    "keyword_counts": _HITS + ", terms(keyword) AS (VALUES " + ", ".join(f"({_sql_text(k)})" for k in KEYWORDS if k.strip()) + ") SELECT t.keyword, count(DISTINCT doc_id) AS n FROM terms t LEFT JOIN hits USING (keyword) GROUP BY 1",
    "keyword_filtered_counts": _HITS + "SELECT keyword, count(DISTINCT doc_id) AS n FROM hits WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1",
    "keyword_snippets": """WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM documents),
a AS (SELECT *, instr(lower(t), 'that') AS i, greatest(1, instr(lower(t), 'that') - 60) AS lo FROM t)
SELECT doc_id, CASE WHEN i > 0 THEN substr(t, lo, i - lo) || '[' || substr(t, i, 4) || ']' || substr(t, i + 4, 60) ELSE substr(t, 1, 150) END AS snippet FROM a""",
    "rule_classify": _RULES + f"SELECT doc_id, CASE WHEN {_reason(0.7, 0.3)} = 'ok' THEN topic ELSE '00. Unknown' END AS topic, round(coalesce(score, 0), 6) AS score, round(coalesce(margin, 0), 6) AS margin, {_reason(0.7, 0.3)} AS reason FROM c",
    "rule_score_details": _DETAILS,
    "rule_diagnostics": _RULES + f"SELECT {_reason(0.8, 0.4)} AS reason, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 3) AS share FROM c GROUP BY 1",
    "pattern_precision": "WITH p(pattern, want) AS (VALUES " + ", ".join(f"({_sql_text(p)}, {w})" for p, w in PATTERNS) + """),
x AS (SELECT pattern, want, count(*) FILTER (WHERE regexp_matches(text, pattern) AND quality = want) AS tp, count(*) FILTER (WHERE regexp_matches(text, pattern) AND quality <> want) AS fp,
 count(*) FILTER (WHERE quality = want) AS n FROM p, documents JOIN labels USING (doc_id) GROUP BY 1, 2)
SELECT pattern, CAST(want AS VARCHAR) AS wanted, tp, fp, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 3) AS precision, round(CASE WHEN n = 0 THEN 0 ELSE tp / n END, 3) AS coverage,
 tp >= 5 AND tp + fp > 0 AND tp / (tp + fp) >= 0.8 AS keep FROM x""",
    "capped_candidates": "SELECT lang, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INTEGER) AS place FROM documents QUALIFY place <= 40",
    "stratified_sample": """WITH r AS (SELECT doc_id, lang, md5('42:' || doc_id) AS o, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents)
SELECT doc_id, lang FROM r ORDER BY CASE WHEN r <= greatest(1, 50 // (SELECT count(DISTINCT lang) FROM documents)) THEN 0 ELSE 1 END, o, doc_id LIMIT 50""",
    "append_dedupe": "SELECT doc_id, n_chars FROM documents WHERE doc_id % 3 <> 0 AND n_chars NOT IN (SELECT n_chars FROM documents WHERE doc_id % 3 = 0)",
    "many_rules": "WITH rules(topic, pattern, weight) AS (VALUES " + ", ".join(f"({_sql_text(r.topic)}, {_sql_text(r.pattern)}, {r.weight}::DOUBLE)" for r in MANY_RULES) + ") SELECT doc_id, topic, round(sum(weight), 6) AS score FROM documents JOIN rules ON regexp_matches(text, pattern) GROUP BY 1, 2",
    "sub_topic_match": """WITH f AS (SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, ' \\| ') THEN 'lists' END, CASE WHEN contains(text, '!!') THEN 'shout' END, CASE WHEN regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+') THEN 'mail' END], lambda x: x IS NOT NULL) AS l FROM documents)
SELECT doc_id, CASE WHEN len(l) = 0 THEN '00. General' ELSE array_to_string(l, ',') END AS sub_topics FROM f""",
    "checksum": "SELECT page_id, sha256(html) AS sha256 FROM pages",
    "json_decode_validate": """WITH e AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN substr(props, 1, 4) ELSE props END AS props FROM events),
k AS (SELECT event_id, json_valid(props) AS ok, CASE WHEN json_valid(props) THEN TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM e)
SELECT event_id, coalesce(k, -1) AS k, CASE WHEN NOT ok THEN 'undecodable' WHEN k IS NULL THEN 'missing k' WHEN k > 90 THEN 'out of range' END AS reject FROM k""",
}
SQL["part_keyword_hits"] = (
    "WITH " + PARTS_SQL + ", t AS (SELECT question_id, label, name AS text, CASE WHEN question_id % 50 = 0 THEN 'general question' END AS root_text FROM parts)\n"
    + " UNION ALL ".join(f"SELECT {_sql_text(k)} AS keyword, question_id, label FROM t WHERE {_match_sql(k, 'text')} OR {_match_sql(k, 'root_text')}" for k in ["#0000", '"general"', '"Part"'])
)
