"""Registered queries over catalogue records, facets, hits and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillmark.functions import text as tx
from quillmark.operators import images as im
from quillmark.operators import reports as rp
from quillmark.operators.storage import shared_folder
from quillmark.plans.report_queries import _I, _T, _issues, _timings
from quillmark.plans.selection_queries import _GREEDY, _RUN, greedy_fill
from quillmark.plans.tree_queries import _N, _nodes
from quillmark.sources import archives, versions
from quillmark.sources import catalogue_files as cf
from quillmark.sources.corpus import PARTS_SQL, QUESTIONS_SQL, parts, questions, table


def year_picker(spark, d):
    return rp.picker(questions(spark, d).select(F.col("year").cast("string").alias("year")), "year", True)


def paper_picker(spark, d):
    return rp.picker(questions(spark, d), "paper")


def facet_sub_topics(spark, d):
    p = parts(spark, d).select("question_id", "topic", F.when(F.col("marks") % 4 != 0, F.substring_index("name", "#", -1).substr(1, 1)).alias("sub_topic"))
    out = rp.sub_topic_counts(p, questions(spark, d))
    return out.select("topic", "n", F.array_join(F.transform(F.map_entries("sub_topics"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("sub_topics"))


def checked_topics(spark, d):
    p = table(spark, d, "part")
    subs = p.select(F.concat("p_type", F.lit(" "), "p_brand").alias("topic"), (F.col("p_size") % 2 == 0).alias("checked"), F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 5 == 0).alias("visible"), (F.col("p_partkey") % 2 == 0).alias("sub_checked"))
    return rp.checked_topics(subs)


def _hits(spark, d):
    return parts(spark, d).filter("marks >= 5").select(F.concat(F.lit("k"), F.col("marks").cast("string")).alias("keyword"), "question_id", "label")


def keyword_preview(spark, d):
    words = table(spark, d, "region").select(F.concat(F.lit("k"), (F.col("r_regionkey") + 3).cast("string")).alias("keyword"))
    return rp.previewed(_hits(spark, d), words, questions(spark, d).filter("year in (1996, 1997)"))


def keyword_label_union(spark, d):
    return rp.labels_of_hits(_hits(spark, d)).select("question_id", F.array_join("labels", "|").alias("labels"))


def misclassified_parts(spark, d):
    p = parts(spark, d)
    labelled = p.select("question_id", "label", F.when(F.col("marks") == 4, "PROMO").otherwise(F.coalesce("topic", F.lit("none"))).alias("wanted"))
    found = p.filter("ord % 7 <> 0").select("question_id", "label", F.when(F.col("marks") == 2, "Unknown").otherwise(F.coalesce("topic", F.lit("none"))).alias("topic"), (F.col("y") % 10 / 10.0).alias("score"))
    return rp.misclassified(labelled, found, ["question_id", "label"], 0.3).select("question_id", "label", F.array_join("reasons", ",").alias("reasons"))


def context_lookup(spark, d):
    n = _nodes(spark, d)
    root = F.col("question_id").cast("string")
    path = F.when(F.col("kind") == "question", F.array().cast("array<string>")).when(F.col("kind") == "letter", F.array(root)).otherwise(F.array(root, "parent"))
    rows = n.select("question_id", "label", path.alias("path"), ((F.col("kind") == "question") & (F.col("question_id") % 2 == 0) | (F.col("kind") == "letter") & (F.col("marks") > 3)).alias("has_context"))
    return rp.contexts_of(rows).select("question_id", "label", F.array_join("contexts", ">").alias("contexts"))


def pre_order(spark, d):
    n = _nodes(spark, d)
    up = n.filter("kind = 'letter'").select("question_id", F.col("label").alias("parent"), F.col("top").alias("__t"))
    rows = n.join(up, ["question_id", "parent"], "left")
    at = lambda t, label: F.struct(t.alias("t"), label.alias("l"))
    path = F.when(F.col("kind") == "question", F.array().cast("array<struct<t:bigint,l:string>>")).when(F.col("kind") == "letter", F.array(at(F.col("top"), F.col("label")))).otherwise(F.array(at(F.col("__t"), F.col("parent")), at(F.col("top"), F.col("label"))))
    return rp.pre_order(rows.withColumn("path", path)).select("question_id", "label", "preorder")


def _picked(spark, d):
    p = parts(spark, d).join(questions(spark, d).select("question_id", F.col("topic").alias("q_topic")), "question_id")
    return greedy_fill(spark, d).join(p, "question_id")


def plan_topic_marks(spark, d):
    return rp.plan_rows(_picked(spark, d), [*_RUN, "pos", "question_id"])


def covered_topics(spark, d):
    return rp.covered(_picked(spark, d), _RUN).select(*_RUN, F.array_join("topics", "|").alias("topics"))


def issue_documents(spark, d):
    return rp.issue_names(_issues(spark, d)).select("issue_type", "n", F.array_join(F.transform("names", lambda x: x.cast("string")), ",").alias("names"))


def _merged(spark, d):
    t = _timings(spark, d)
    return rp.merged_timings(t.filter("question_id % 3 <> 0"), t.filter("question_id % 2 = 0").withColumn("seconds", F.col("seconds") * 2))


def timing_merge_phases(spark, d):
    return _merged(spark, d)[0].select("phase", F.round("mean", 6).alias("mean"), "least", "most", "n")


def timing_merge_slowest(spark, d):
    return _merged(spark, d)[1]


def variant_runs(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("variant"), F.when(F.col("c_custkey") % 3 == 0, 0.0).when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("unknown"), (F.col("c_acctbal") / 2).alias("holdout"), (F.col("c_custkey") % 17).alias("runtime"))
    return rp.variant_runs(c)


def uncategorised_reasons(spark, d):
    p = parts(spark, d).filter("topic is null").select("question_id", F.when(F.col("marks") < 3, "low score").when(F.col("marks") < 5, "no match").otherwise("close call").alias("reason"))
    return rp.uncategorised(p)


def uncategorised_listing(spark, d):
    p = parts(spark, d).filter("topic is null").select("question_id", "label", F.when(F.col("marks") < 3, "low score").when(F.col("marks") < 5, "no match").otherwise("close call").alias("reason"))
    return rp.uncategorised_listing(p)


def letter_gap_issues(spark, d):
    p = parts(spark, d).select("question_id", F.substring(F.lit("abcdefghijklmno"), (F.col("y") % 15 + 1).cast("int"), F.lit(1)).alias("letter"))
    return rp.gap_issues(p, "question_id")


def versioned_records(spark, d):
    """Customers appended in two batches that overlap and then changed in part, read from the newest version."""
    path = f"{shared_folder(spark)}/quillmark/versions-{uuid.uuid4().hex[:12]}"
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("question_id"), "c_custkey", F.col("c_name").alias("name"))
    versions.append_new(spark, c.filter("c_custkey % 3 <> 0"), path)
    versions.append_new(spark, c.filter("c_custkey % 2 = 0").withColumn("name", F.lit("second")), path)
    versions.upsert(spark, c.filter("c_custkey % 5 = 0").withColumn("name", F.lit("changed")), path)
    return versions.Versions(spark, path).read(c.schema).select("c_custkey", "name")


def highlighted_snippets(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit(" (a) [12] .. "), "text").alias("text"))
    return docs.select("doc_id", rp.highlighted(F.col("text"), ["that", "ein", "(a)"]).alias("snippet"))


def classifier_entry(spark, d):
    p = parts(spark, d)
    return p.select("question_id", "ord", rp.classifier_entry(F.when(F.col("marks") == 1, " ").otherwise(F.col("name")), F.when(F.col("marks") == 2, "model"), F.col("topic")).alias("topic"))


def manifest_checks(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    doc = F.when(k % 9 == 0, "[1]").when(k % 11 == 0, "{broken").otherwise(
        F.to_json(F.struct(F.when(k % 5 == 0, "no code!").otherwise(F.lpad(k.cast("string"), 4, "0")).alias("code"), F.when(k % 7 == 0, " ").when(k % 13 == 0, F.repeat("s_name", 9)).otherwise(F.col("s_name")).alias("name"), F.when(k % 2 == 0, "3.0").when(k % 3 == 0, "x").alias("schema_version")))
    )
    return rp.manifest_rejects(s.select("s_suppkey", doc.alias("json"))).select("s_suppkey", "reject", "version")


def catalogue_records(spark, d):
    """Lines of a catalogue file, some blank, broken, without a path or invalid."""
    q = questions(spark, d)
    k = F.col("question_id")
    line = F.when(k % 11 == 0, " ").when(k % 13 == 0, '{"question_id": ').otherwise(
        F.to_json(F.struct(F.lit(9).alias("schema_version"), k.cast("string").alias("question_id"), "exam_code", "year", "paper", "variant", "topic", F.when(k % 7 != 0, F.concat(F.lit("q/"), k.cast("string"))).alias("relative_path"), F.when(k % 3 == 0, k % 2 == 0).alias("is_valid")))
    )
    return rp.decoded_catalogue(q.select(line.alias("line"))).select("question_id", "year", "topic", "relative_path")


def region_documents(spark, d):
    """Regions written as documents and read back, absent edges filled in."""
    r = parts(spark, d).select("question_id", F.lit(500).alias("width"), F.lit(900).alias("height"), "label", F.col("y").cast("int").alias("top"), (F.col("y") + 9).cast("int").alias("bottom"), F.when(F.col("marks") > 3, F.col("marks")).alias("left"), F.when(F.col("marks") % 2 == 0, F.col("marks") + 100).alias("right"))
    return rp.decoded_regions(rp.encoded_regions(r)).select(F.col("question_id").cast("long").alias("question_id"), "label", "kind", "top", "bottom", "left", "right", "inline")


def archive_entries(spark, d):
    p = parts(spark, d)
    slices = p.select("question_id", "ord", "label").union(p.select("question_id", F.lit(0), F.col("question_id").cast("string")).distinct())
    return rp.archive_entries(greedy_fill(spark, d), slices)


def build_documents(spark, d):
    leaves = _picked(spark, d).select(*_RUN, "question_id", "marks", F.coalesce("topic", "q_topic").alias("topic"))
    docs = rp.build_documents(leaves, _RUN, 50, 42)
    field = lambda name, kind: F.get_json_object("json", f"$.{name}").cast(kind).alias(name)
    return docs.select(*_RUN, field("target_marks", "int"), field("total_marks", "long"), field("question_count", "long"), F.json_array_length(F.get_json_object("json", "$.topics")).alias("n_topics"))


def cleaned_texts(spark, d):
    p = parts(spark, d)
    text = F.concat(F.lit(" A  part"), F.when(F.col("marks") == 1, " ..... ").when(F.col("marks") == 2, " ____ [Turn over ").otherwise(" + 12 cm * "), "name", F.lit("  "))
    c = rp.cleaned(text)
    return p.select("question_id", "ord", c["diagnostic"].alias("diagnostic"), c["plain"].alias("plain"), c["model"].alias("model"), rp.cleaned(F.col("name"))["pattern"].alias("pattern"))


def token_texts(spark, d):
    """Texts of parts with quantities, signs and command words, as the topic model reads them."""
    p = parts(spark, d)
    said = F.element_at(F.array(*map(F.lit, ("Calculate 12.5 kg per box = ", "State the area in cm\u00b2 \u2265 3 ", "Explain; determine 40% ms ", "5 m/s + 7 V *2 GHz "))), F.col("marks") % 4 + 1)
    return p.select("question_id", "ord", tx.token_text(F.concat(said, "name")).alias("tokens"))


def archive_read_back(spark, d):
    """The entries of archives, one for each run, written as files and read again."""
    path = f"{shared_folder(spark)}/quillmark/archives-{uuid.uuid4().hex[:12]}"
    entries = archive_entries(spark, d).withColumn("content", F.encode("file", "UTF-8"))
    names = entries.groupBy(*_RUN).agg(F.countDistinct("folder").alias("n")).select(*_RUN, F.format_string("%s_%d.zip", *_RUN).alias("name"), F.format_string("%d questions", "n").alias("readme"))
    archives.write_files(archives.archives(entries, names, _RUN, "name"), path)
    return archives.entries_of(spark, path).select("archive", "place", "entry", F.decode("content", "UTF-8").alias("content"))


def loaded_questions_filtered(spark, d):
    q = questions(spark, d).select(
        F.lit(9).alias("schema_version"), "question_id", "exam_code", F.when(F.col("question_id") % 8 != 0, F.col("year") + 20).alias("year"), "paper", "variant", F.col("question_id").alias("question_number"), F.lit(5).alias("total_marks"), F.lit(1).alias("part_count"), "topic"
    )
    return cf.loaded(q, parts(spark, d).filter("marks > 2"), ["1-URGENT", "2-HIGH"], ["2016", "2017"], []).select("question_id", "year", "topic")


def question_checks(spark, d):
    q = questions(spark, d)
    k = F.col("question_id")
    rows = q.select(
        F.when(k % 5 == 0, 8).otherwise(9).alias("schema_version"), k.cast("string").alias("question_id"), F.when(k % 6 == 0, "12").otherwise(F.col("exam_code")).alias("exam_code"), (F.col("year") + F.when(k % 4 == 0, 0).otherwise(20)).alias("year"),
        F.col("paper"), F.when(k % 9 != 0, F.col("variant")).alias("variant"), k.alias("question_number"), F.when(k % 7 == 0, -1).otherwise(4).alias("total_marks"), F.lit(1).alias("part_count"), "topic",
    )
    return cf.rejects(rows).select("question_id", "reject")


def keyword_results(spark, d):
    """Hits with what is shown of their questions."""
    return _hits(spark, d).join(questions(spark, d).select("question_id", "exam_code", "year", "paper", "topic"), "question_id").select("keyword", "question_id", "label", "exam_code", "year", "paper", "topic")


def crop_boxes(spark, d):
    p = parts(spark, d).select("question_id", "ord", (F.col("y") - 10).alias("top"), (F.col("y") + 30).alias("bottom"), (F.col("marks") - 2).alias("left"), F.when(F.col("marks") > 3, F.col("price").cast("int") % 700).alias("right"), (F.col("ord") % 2 == 0).alias("clear"), F.lit(600).alias("width"), F.lit(150).alias("height"))
    return im.crop_boxes(p).select("question_id", "ord", "crop_bottom", "crop_right", "problem")


def trimmed_boxes(spark, d):
    """Questions as images, leaves as pixels."""
    px = parts(spark, d).select("question_id", (F.col("price").cast("int") % 200).alias("x"), (F.col("y") % 100).cast("int").alias("y"), (F.col("price").cast("int") % 256).alias("value"))
    return im.trimmed_boxes(px, px.select("question_id").distinct().withColumn("width", F.lit(200)).withColumn("height", F.lit(100)), "question_id")


QUERIES = {
    f.__name__: f
    for f in (
        year_picker, paper_picker, facet_sub_topics, checked_topics, keyword_preview, keyword_label_union, misclassified_parts, context_lookup, pre_order, plan_topic_marks,
        covered_topics, issue_documents, timing_merge_phases, timing_merge_slowest, variant_runs, uncategorised_reasons, uncategorised_listing, letter_gap_issues, highlighted_snippets, versioned_records, token_texts, archive_read_back, classifier_entry,
        manifest_checks, catalogue_records, region_documents, archive_entries, build_documents, cleaned_texts, loaded_questions_filtered, question_checks, keyword_results, crop_boxes, trimmed_boxes,
    )
}

_B = f"WITH RECURSIVE {QUESTIONS_SQL}, {PARTS_SQL}"
_MERGE = _T + """, o AS (SELECT * FROM t WHERE question_id % 3 <> 0), n AS (SELECT question_id, phase, seconds * 2 AS s FROM t WHERE question_id % 2 = 0),
b AS (SELECT coalesce(o.question_id, n.question_id) AS question_id, coalesce(o.phase, n.phase) AS phase, coalesce(n.s, o.seconds) AS seconds FROM o FULL JOIN n ON o.question_id = n.question_id AND o.phase = n.phase)
"""
SQL = {
    "year_picker": f"WITH {QUESTIONS_SQL} SELECT CAST(year AS VARCHAR) AS year, CAST(row_number() OVER (ORDER BY CAST(year AS VARCHAR) DESC) AS INTEGER) AS place FROM (SELECT DISTINCT year FROM questions)",
    "paper_picker": f"WITH {QUESTIONS_SQL} SELECT paper, CAST(row_number() OVER (ORDER BY paper) AS INTEGER) AS place FROM (SELECT DISTINCT paper FROM questions)",
    "facet_sub_topics": _B + """, r AS (SELECT coalesce(p.topic, q.topic) AS topic, CASE WHEN marks % 4 <> 0 THEN substr(split_part(name, '#', -1), 1, 1) END AS s FROM parts p JOIN questions q USING (question_id)),
c AS (SELECT topic, s, count(*) AS n FROM r GROUP BY 1, 2) SELECT topic, CAST(sum(n) AS BIGINT) AS n, coalesce(string_agg(s || ':' || n, ',' ORDER BY s) FILTER (WHERE s IS NOT NULL), '') AS sub_topics FROM c GROUP BY 1""",
    "checked_topics": """SELECT p_type || ' ' || p_brand AS topic FROM part GROUP BY 1 HAVING bool_or(p_size % 2 = 0)
 AND (count(*) FILTER (WHERE p_size % 3 <> 0 AND p_size % 5 = 0) = 0 OR count(*) FILTER (WHERE p_size % 3 <> 0 AND p_size % 5 = 0 AND p_partkey % 2 = 0) > 0)""",
    "keyword_preview": _B + """, h AS (SELECT 'k' || marks AS keyword, question_id FROM parts JOIN questions USING (question_id) WHERE marks >= 5 AND year IN (1996, 1997))
SELECT w.keyword, count(DISTINCT question_id) AS n_questions, count(question_id) AS n_labels FROM (SELECT 'k' || (r_regionkey + 3) AS keyword FROM region) w LEFT JOIN h USING (keyword) GROUP BY 1""",
    "keyword_label_union": _B + " SELECT question_id, string_agg(DISTINCT label, '|' ORDER BY label) AS labels FROM parts WHERE marks >= 5 GROUP BY 1",
    "misclassified_parts": _B + """, r AS (SELECT question_id, label, CASE WHEN marks = 4 THEN 'PROMO' ELSE coalesce(topic, 'none') END AS wanted, CASE WHEN ord % 7 <> 0 THEN CASE WHEN marks = 2 THEN 'Unknown' ELSE coalesce(topic, 'none') END END AS t, CASE WHEN ord % 7 <> 0 THEN y % 10 / 10.0::DOUBLE END AS s FROM parts),
x AS (SELECT question_id, label, concat_ws(',', CASE WHEN t IS NULL THEN 'not classified' END, CASE WHEN t = 'Unknown' THEN 'unknown' END, CASE WHEN t <> 'Unknown' AND t <> wanted THEN 'other topic' END, CASE WHEN s < 0.3 THEN 'low score' END) AS reasons FROM r) SELECT * FROM x WHERE reasons <> ''""",
    "context_lookup": _N + """, c AS (SELECT question_id, label FROM nodes WHERE kind = 'question' AND question_id % 2 = 0 OR kind = 'letter' AND marks > 3)
SELECT n.question_id, n.label, concat_ws('>', CASE WHEN kind <> 'question' AND n.question_id % 2 = 0 THEN CAST(n.question_id AS VARCHAR) END, CASE WHEN kind = 'roman' THEN c.label END) AS contexts FROM nodes n LEFT JOIN c ON kind = 'roman' AND c.question_id = n.question_id AND c.label = n.parent""",
    "pre_order": _N + """, k AS (SELECT n.question_id, n.label, CASE n.kind WHEN 'question' THEN 0 ELSE 1 END AS a, coalesce(u.top, n.top) AS b, coalesce(u.label, n.label) AS c, CASE n.kind WHEN 'roman' THEN 1 ELSE 0 END AS e FROM nodes n LEFT JOIN nodes u ON n.kind = 'roman' AND u.kind = 'letter' AND u.question_id = n.question_id AND u.label = n.parent)
SELECT question_id, label, CAST(row_number() OVER (PARTITION BY question_id ORDER BY a, b, c, e) - 1 AS INTEGER) AS preorder FROM k""",
    "plan_topic_marks": _GREEDY + "SELECT exam_code, year, pos, question_id, coalesce(nullif(p.topic, ''), q.topic) AS topic, CAST(sum(marks) AS BIGINT) AS marks, count(*) AS n_parts FROM picked JOIN parts p USING (question_id) JOIN (SELECT question_id, topic FROM questions) q USING (question_id) GROUP BY 1, 2, 3, 4, 5",
    "covered_topics": _GREEDY + ", t AS (SELECT DISTINCT exam_code, year, coalesce(nullif(p.topic, ''), q.topic) AS t FROM picked JOIN parts p USING (question_id) JOIN (SELECT question_id, topic FROM questions) q USING (question_id)) SELECT exam_code, year, string_agg(t, '|' ORDER BY t) AS topics FROM t GROUP BY 1, 2",
    "issue_documents": _I + ", p AS (SELECT issue_type, pdf_name, count(*) AS k FROM issues GROUP BY 1, 2) SELECT issue_type, CAST(sum(k) AS BIGINT) AS n, string_agg(CAST(pdf_name AS VARCHAR), ',' ORDER BY pdf_name) AS names FROM p GROUP BY 1",
    "timing_merge_phases": _MERGE + "SELECT phase, round(avg(seconds), 6) AS mean, min(seconds) AS least, max(seconds) AS most, count(*) AS n FROM b GROUP BY 1",
    "timing_merge_slowest": _MERGE + "SELECT question_id, round(sum(seconds), 6) AS total, first(phase ORDER BY seconds DESC, phase DESC) AS phase, max(seconds) AS most FROM b GROUP BY 1 ORDER BY total DESC, question_id LIMIT 5",
    "variant_runs": """WITH r AS (SELECT c_mktsegment AS variant, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AND c_acctbal <> 0 THEN c_acctbal ELSE c_acctbal / 2 END AS a, c_custkey % 17 AS t FROM customer)
SELECT variant, round(avg(a), 6) AS accuracy_mean, min(a) AS accuracy_least, max(a) AS accuracy_most, round(avg(t), 6) AS runtime_mean, min(t) AS runtime_least, max(t) AS runtime_most, count(a) AS n FROM r GROUP BY 1""",
    "uncategorised_reasons": _B + """, k AS (SELECT CASE WHEN marks < 3 THEN 'low score' WHEN marks < 5 THEN 'no match' ELSE 'close call' END AS reason, question_id, count(*) AS k FROM parts WHERE topic IS NULL GROUP BY 1, 2),
r AS (SELECT reason, CAST(sum(k) AS BIGINT) AS n, count(*) AS questions, max(k) AS most FROM k GROUP BY 1) SELECT *, round(n * 100.0::DOUBLE / sum(n) OVER (), 3) AS share, CAST(row_number() OVER (ORDER BY n DESC, reason) AS INTEGER) AS place FROM r""",
    "uncategorised_listing": _B + """, k AS (SELECT CASE WHEN marks < 3 THEN 'low score' WHEN marks < 5 THEN 'no match' ELSE 'close call' END AS reason, question_id, count(*) AS n, string_agg(label, ', ' ORDER BY label) AS labels FROM parts WHERE topic IS NULL GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY reason ORDER BY n DESC, question_id) AS INTEGER) AS place FROM k""",
    "letter_gap_issues": _B + """, i AS (SELECT DISTINCT question_id, 97 + y % 15 AS i FROM parts), n AS (SELECT *, lead(i) OVER (PARTITION BY question_id ORDER BY i) AS n FROM i),
m AS (SELECT question_id, chr(CAST(unnest(range(CAST(i + 1 AS BIGINT), CAST(n AS BIGINT))) AS INTEGER)) AS label FROM n WHERE n > i + 1) SELECT question_id, label, 'Missing letter (' || label || ')' AS message FROM m""",
    "classifier_entry": _B + " SELECT question_id, ord, CASE WHEN marks = 1 THEN '00. Unknown' WHEN marks = 2 THEN 'model' ELSE coalesce(topic, '00. Unknown') END AS topic FROM parts",
    "manifest_checks": """SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 OR s_suppkey % 11 = 0 THEN 'not an object' WHEN s_suppkey % 5 = 0 THEN 'code' WHEN s_suppkey % 7 = 0 THEN 'no name' WHEN s_suppkey % 13 = 0 AND length(s_name) * 9 > 100 THEN 'name' END AS reject,
 CASE WHEN s_suppkey % 9 <> 0 AND s_suppkey % 11 <> 0 AND s_suppkey % 2 = 0 THEN 30 ELSE 1 END AS version FROM supplier""",
    "catalogue_records": f"WITH {QUESTIONS_SQL} SELECT CAST(question_id AS VARCHAR) AS question_id, year, topic, 'q/' || question_id AS relative_path FROM questions WHERE question_id % 11 <> 0 AND question_id % 13 <> 0 AND question_id % 7 <> 0 AND (question_id % 3 <> 0 OR question_id % 2 = 0)",
    "region_documents": _B + " SELECT question_id, label, 'letter' AS kind, CAST(y AS INTEGER) AS top, CAST(y + 9 AS INTEGER) AS bottom, CASE WHEN marks > 3 THEN marks ELSE 0 END AS \"left\", CASE WHEN marks % 2 = 0 THEN marks + 100 ELSE 500 END AS \"right\", false AS inline FROM parts",
    "token_texts": f"WITH {PARTS_SQL}" + r""", s AS (SELECT question_id, ord, ['Calculate 12.5 kg per box = ', 'State the area in cm² ≥ 3 ', 'Explain; determine 40% ms ', '5 m/s + 7 V *2 GHz '][marks % 4 + 1] || name AS t FROM parts),
a AS (SELECT question_id, ord, lower(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS t FROM s),
b AS (SELECT question_id, ord, regexp_replace(t, '\b\d+(?:\.\d+)?\s*(?:m/s|kg|j|v|cm\^3|mb|gb|kb|hz|ghz|bit|byte|ms|s|%)\b', ' UNIT_VALUE ', 'g') AS t FROM a),
c AS (SELECT question_id, ord, regexp_replace(regexp_replace(t, '[+\-*/^=≥≤<>]', ' OPERATOR ', 'g'), '\bper\b', ' RATE ', 'g') AS t FROM b)
SELECT question_id, ord, t || """ + " || ".join(rf"CASE WHEN regexp_matches(t, '\b{c}\b') THEN ' CMD_{c.upper()} ' ELSE '' END" for c in tx.COMMANDS) + " || CASE WHEN regexp_matches(t, '[²³]') THEN ' NOTATION_POWER ' ELSE '' END AS tokens FROM c",
    "archive_read_back": _GREEDY + """, s AS (SELECT question_id, ord, label FROM parts UNION ALL SELECT DISTINCT question_id, 0, CAST(question_id AS VARCHAR) FROM parts),
e AS (SELECT exam_code, year, lpad(CAST(pos AS VARCHAR), 2, '0') || '_' || question_id AS folder, ord, regexp_replace(label, '[()]+', '_', 'g') || '.png' AS file FROM picked JOIN s USING (question_id))
SELECT exam_code || '_' || year || '.zip' AS archive, CAST(row_number() OVER (PARTITION BY exam_code, year ORDER BY folder, ord) AS INTEGER) AS place, folder || '/' || file AS entry, file AS content FROM e
UNION ALL SELECT exam_code || '_' || year || '.zip', 0, 'README.txt', count(DISTINCT folder) || ' questions' FROM e GROUP BY exam_code, year""",
    "archive_entries": _GREEDY + """, s AS (SELECT question_id, ord, label FROM parts UNION ALL SELECT DISTINCT question_id, 0, CAST(question_id AS VARCHAR) FROM parts)
SELECT exam_code, year, lpad(CAST(pos AS VARCHAR), 2, '0') || '_' || question_id AS folder, CAST(row_number() OVER (PARTITION BY exam_code, year, pos ORDER BY ord) AS INTEGER) AS place, regexp_replace(label, '[()]+', '_', 'g') || '.png' AS file FROM picked JOIN s USING (question_id)""",
    "build_documents": _GREEDY + "SELECT exam_code, year, 50 AS target_marks, CAST(sum(marks) AS BIGINT) AS total_marks, count(DISTINCT question_id) AS question_count, CAST(count(DISTINCT coalesce(p.topic, q.topic)) AS INTEGER) AS n_topics FROM picked JOIN parts p USING (question_id) JOIN (SELECT question_id, topic FROM questions) q USING (question_id) GROUP BY 1, 2",
    "versioned_records": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'changed' WHEN c_custkey % 3 <> 0 THEN c_name ELSE 'second' END AS name FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0 OR c_custkey % 5 = 0",
    "highlighted_snippets": r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(' (a) [12] .. ' || text, '[ \t\r\n\f\v]+', ' ', 'g')), '\.{2,}', '', 'g'), '\[\d+\]', '', 'g'), '^\s*\([a-zA-Z0-9]+\)\s*', '') AS t
 FROM documents),
k AS (SELECT *, CASE WHEN contains(lower(t), 'that') THEN 4 WHEN contains(lower(t), 'ein') OR contains(lower(t), '(a)') THEN 3 END AS n,
 CASE WHEN contains(lower(t), 'that') THEN instr(lower(t), 'that') WHEN contains(lower(t), 'ein') THEN instr(lower(t), 'ein') ELSE instr(lower(t), '(a)') END - 1 AS at_ FROM c),
s AS (SELECT *, greatest(0, at_ - 60) AS lo, least(length(t), at_ + n + 60) AS hi FROM k)
SELECT doc_id, CASE WHEN t IS NULL THEN '(No text available)' WHEN at_ < 0 THEN substr(t, 1, 150) || CASE WHEN length(t) > 150 THEN '...' ELSE '' END
 ELSE CASE WHEN lo > 0 THEN '...' ELSE '' END || regexp_replace(regexp_replace(regexp_replace(substr(t, lo + 1, hi - lo), '(that)', '<\1>', 'gi'), '(ein)', '<\1>', 'gi'), '(\(a\))', '<\1>', 'gi') || CASE WHEN hi < length(t) THEN '...' ELSE '' END END AS snippet FROM s""",
    "cleaned_texts": f"WITH {PARTS_SQL}" + r""", t AS (SELECT question_id, ord, name, ' A  part' || CASE marks WHEN 1 THEN ' ..... ' WHEN 2 THEN ' ____ [Turn over ' ELSE ' + 12 cm * ' END || name || '  ' AS t FROM parts)
SELECT question_id, ord, trim(regexp_replace(regexp_replace(regexp_replace(t, '\.{3,}|_{3,}', ' ', 'g'), '\[turn over\]?', ' ', 'gi'), '\s+', ' ', 'g')) AS diagnostic, trim(regexp_replace(t, '\s+', ' ', 'g')) AS plain,
 trim(regexp_replace(regexp_replace(regexp_replace(lower(t), '\b\d+(?:\.\d+)?\s*(?:mm|cm|km|kg|mg|ml|g|m|l|s|n|v|a|w|j)\b', ' unit ', 'g'), '[+*/=<>^]', ' operator ', 'g'), ' +', ' ', 'g')) AS model,
 '\b' || regexp_replace(lower(name), '([\\.^$|?*+()\[\]{}-])', '\\\1', 'g') || 's?\b' AS pattern FROM t""",
    "loaded_questions_filtered": _B + " SELECT question_id, CAST(year + 20 AS INTEGER) AS year, topic FROM questions WHERE question_id % 8 <> 0 AND year + 20 IN (2016, 2017) AND topic IN ('1-URGENT', '2-HIGH') AND question_id IN (SELECT question_id FROM parts WHERE marks > 2)",
    "question_checks": f"""WITH {QUESTIONS_SQL} SELECT CAST(question_id AS VARCHAR) AS question_id, CASE WHEN question_id % 9 = 0 THEN 'missing variant' WHEN question_id % 5 = 0 THEN 'schema version' WHEN question_id % 6 = 0 THEN 'exam code'
 WHEN question_id % 4 = 0 AND year < 2000 THEN 'year' WHEN question_id % 7 = 0 THEN 'marks' END AS reject FROM questions""",
    "keyword_results": _B + " SELECT 'k' || marks AS keyword, question_id, label, exam_code, year, paper, q.topic FROM parts p JOIN questions q USING (question_id) WHERE marks >= 5",
    "crop_boxes": f"""WITH {PARTS_SQL}, c AS (SELECT question_id, ord, y - 10 AS t, marks - 2 AS l, CASE WHEN ord % 2 = 0 THEN least(y + 40, 150) ELSE y + 30 END AS b, coalesce(nullif(CASE WHEN marks > 3 THEN CAST(trunc(price)::BIGINT % 700 AS INTEGER) END, 0), 600) AS r FROM parts)
SELECT question_id, ord, b AS crop_bottom, r AS crop_right, CASE WHEN t < 0 THEN 'top' WHEN b > 150 THEN 'bottom' WHEN l < 0 THEN 'left' WHEN r > 600 THEN 'right' END AS problem FROM c""",
    "trimmed_boxes": f"""WITH {PARTS_SQL}, p AS (SELECT question_id, trunc(price)::BIGINT % 200 AS x, y % 100 AS y, trunc(price)::BIGINT % 256 AS v FROM parts),
w AS (SELECT question_id, greatest(200, CAST(trunc(quantile_cont(CAST(v AS DOUBLE), 0.98)) AS BIGINT)) AS w FROM p GROUP BY 1),
b AS (SELECT w.question_id, greatest(0, min(x) - 4) AS l, least(200, max(x) + 4) AS r, greatest(0, min(y) - 4) AS t, least(100, max(y) + 4) AS o FROM w LEFT JOIN p ON p.question_id = w.question_id AND v < w GROUP BY 1)
SELECT question_id, CAST(CASE WHEN coalesce(r - l >= 120, false) AND has THEN l ELSE 0 END AS INTEGER) AS "left", CAST(CASE WHEN has THEN t ELSE 0 END AS INTEGER) AS top,
 CAST(CASE WHEN coalesce(r - l >= 120, false) AND has THEN r ELSE 200 END AS INTEGER) AS "right", CAST(CASE WHEN has THEN o ELSE 100 END AS INTEGER) AS bottom
FROM b JOIN (SELECT w.question_id, bool_or(v < w) AS has FROM w JOIN p USING (question_id) GROUP BY 1) USING (question_id)""",
}
