"""Lists and summaries that people read: facets, hits, issues, timings, plans; and records of catalogue files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as tx
from quillmark.operators import diagnostics
from quillmark.operators.facets import effective_topic, is_unknown
from quillmark.sources.catalogue_files import QUESTION, REGIONS, REGIONS_VERSION


def picker(values: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """(column, place): the distinct values of a facet in the order of its picker."""
    one = values.filter(F.col(column).isNotNull()).select(column).distinct()
    # a facet has some dozens of values
    return one.withColumn("place", F.row_number().over(Window.orderBy(F.desc(column) if descending else F.asc(column))))


def sub_topic_counts(parts: DataFrame, questions: DataFrame) -> DataFrame:
    """(topic, n, sub_topics): leaves of each topic, unknown ones counted for the question's, with a map of its sub-topics' counts."""
    rows = parts.join(questions.select("question_id", F.col("topic").alias("__q")), "question_id").select(F.when(is_unknown(F.col("topic")), F.col("__q")).otherwise(F.col("topic")).alias("topic"), "sub_topic")
    per = rows.groupBy("topic", "sub_topic").agg(F.count("*").alias("n"))
    return per.groupBy("topic").agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("sub_topic").isNotNull(), F.struct("sub_topic", "n"))))).alias("sub_topics"))


def checked_topics(subs: DataFrame) -> DataFrame:
    """Topics that count as selected: checked, with no visible sub-topic or with one that is checked.

    subs: topic, checked, visible (null: the topic has no such sub-topic), sub_checked.
    """
    per = subs.groupBy("topic").agg(F.bool_or("checked").alias("__c"), F.count_if("visible").alias("__v"), F.count_if(F.col("visible") & F.col("sub_checked")).alias("__s"))
    return per.filter("__c and (__v = 0 or __s > 0)").select("topic")


def previewed(hits: DataFrame, keywords: DataFrame, passing: DataFrame | None) -> DataFrame:
    """(keyword, n_questions, n_labels): hits on passing questions; keywords without any stay with 0. No filter: all pass.

    hits: keyword, question_id, label.
    """
    own = hits if passing is None else hits.join(passing.select("question_id").distinct(), "question_id", "left_semi")
    counts = own.groupBy("keyword").agg(F.countDistinct("question_id").alias("n_questions"), F.count("*").alias("n_labels"))
    return keywords.select("keyword").distinct().join(counts, "keyword", "left").na.fill(0, ["n_questions", "n_labels"])


def labels_of_hits(hits: DataFrame) -> DataFrame:
    """(question_id, labels): over all keywords, each label once."""
    return hits.groupBy("question_id").agg(F.sort_array(F.collect_set("label")).alias("labels"))


def misclassified(labelled: DataFrame, classified: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Adds topic, score, ``reasons``: not classified, unknown, another topic, low score; of rows with any.

    labelled: keys, wanted; classified: keys, topic, score.
    """
    rows = labelled.join(classified, keys, "left")
    seen = F.col("topic").isNotNull()
    reasons = F.array_compact(
        F.array(
            F.when(~seen, "not classified"),
            F.when(seen & is_unknown(F.col("topic")), "unknown"),
            F.when(seen & ~is_unknown(F.col("topic")) & (F.col("topic") != F.col("wanted")), "other topic"),
            F.when(F.col("score") < least, "low score"),
        )
    )
    return rows.withColumn("reasons", reasons).filter(F.size("reasons") > 0)


def contexts_of(nodes: DataFrame) -> DataFrame:
    """(question_id, label, contexts): the ancestors with a context of their own, root first.

    nodes: question_id, label, path array of labels from the root to the parent, has_context.
    """
    kind = nodes.schema["label"].dataType.simpleString()
    own = F.array(F.struct(F.lit(None).cast("int").alias("at"), F.col("label").alias("a")))
    up = F.transform("path", lambda a, i: F.struct(i.alias("at"), a.alias("a")))
    # a node stands with its own label and with each ancestor's: no join, all windows are within questions
    rows = nodes.select("question_id", "label", "has_context", F.explode(F.concat(own, F.coalesce(up, F.array().cast(f"array<struct<at:int,a:{kind}>>")))).alias("x")).select("question_id", "label", "has_context", "x.*")
    held = F.count_if(F.col("at").isNull() & F.col("has_context") & F.col("a").isNotNull() & F.col("question_id").isNotNull()).over(Window.partitionBy("question_id", "a"))
    rows = rows.withColumn("__n", held.cast("int"))
    found = F.collect_list(F.when(F.col("at").isNotNull() & (F.col("__n") > 0) & F.col("label").isNotNull(), F.array_repeat(F.struct("at", "a"), F.col("__n")))).over(Window.partitionBy("question_id", "label"))
    return rows.withColumn("__f", found).filter("at is null").select("question_id", "label", F.transform(F.array_sort(F.flatten("__f")), lambda x: x["a"]).alias("contexts"))


def pre_order(nodes: DataFrame) -> DataFrame:
    """Adds ``preorder`` from 0: a node, then what is below it, in document order; ``path``: (top, label) of each level."""
    w = Window.partitionBy("question_id").orderBy("path")
    return nodes.withColumn("preorder", F.row_number().over(w) - 1)


def plan_rows(leaves: DataFrame, plan: list[str]) -> DataFrame:
    """(plan, topic, marks, n_parts): of each plan's included leaves by effective topic."""
    return leaves.groupBy(*plan, effective_topic(F.col("topic"), F.col("q_topic")).alias("topic")).agg(F.sum("marks").alias("marks"), F.count("*").alias("n_parts"))


def covered(leaves: DataFrame, run: list[str]) -> DataFrame:
    """(run, topics): distinct effective topics of what a run includes, empty ones left out."""
    t = effective_topic(F.col("topic"), F.col("q_topic"))
    return leaves.groupBy(*run).agg(F.sort_array(F.collect_set(F.when(t != "", t))).alias("topics"))


def issue_names(issues: DataFrame) -> DataFrame:
    """(issue_type, n, names): issues and the distinct documents they are in, sorted."""
    return issues.groupBy("issue_type").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("pdf_name")).alias("names"))


def merged_timings(old: DataFrame, new: DataFrame, slowest: int = 5) -> tuple[DataFrame, DataFrame]:
    """(phase averages, slowest questions) over old and new timings, new ones in the place of old."""
    both = diagnostics.upserted(old, new, ["question_id", "phase"], "seconds")
    return diagnostics.phase_averages(both), diagnostics.slowest(both, slowest)


def variant_runs(results: DataFrame) -> DataFrame:
    """Mean, least and greatest accuracy and runtime of each variant; the accuracy on unknown data unless that is 0 or missing, else on held-out data."""
    a = F.coalesce(F.nullif("unknown", F.lit(0.0)), F.col("holdout"))
    agg = lambda c, name: [F.round(F.avg(c), 6).alias(f"{name}_mean"), F.min(c).alias(f"{name}_least"), F.max(c).alias(f"{name}_most")]
    return results.withColumn("__a", a).groupBy("variant").agg(*agg("__a", "accuracy"), *agg("runtime", "runtime"), F.count("__a").alias("n"))


def uncategorised(rows: DataFrame) -> DataFrame:
    """(reason, n, share, questions): of parts without a topic by reason, greatest first by ``place``, with the number of parts by question."""
    per = rows.groupBy("reason", "question_id").agg(F.count("*").alias("k"))
    out = per.groupBy("reason").agg(F.sum("k").alias("n"), F.count("*").alias("questions"), F.max("k").alias("most"))
    return out.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 3)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "reason")))


def uncategorised_listing(rows: DataFrame) -> DataFrame:
    """(reason, place, question_id, n, labels): the parts of each reason by question, questions with most parts first; labels sorted and comma-joined."""
    per = rows.groupBy("reason", "question_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("label")), ", ").alias("labels"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy("reason").orderBy(F.desc("n"), "question_id")))


def gap_issues(labels: DataFrame, key: str) -> DataFrame:
    """(key, label, message): an issue for every letter that is missing between two that are there; nothing is made invalid.

    labels: key, letter.
    """
    own = labels.select(key, F.ascii("letter").alias("__i")).distinct()
    jump = own.withColumn("__n", F.lead("__i").over(Window.partitionBy(key).orderBy("__i"))).filter("__n > __i + 1")
    lost = jump.select(key, F.explode(F.sequence(F.col("__i") + 1, F.col("__n") - 1)).alias("__m"))
    return lost.select(key, F.char("__m").alias("label"), F.concat(F.lit("Missing letter ("), F.char("__m"), F.lit(")")).alias("message"))


def highlighted(text: Column, keywords: list[str], around: int = 60, plain: int = 150) -> Column:
    """A cleaned text around the first hit of the first keyword that has one, hits of all keywords in brackets; else its beginning.

    Runs of dots, [numbers] and a leading label go; dots say where something is left out.
    """
    t = F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0b]+", " "))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\.{2,}", ""), r"\[\d+\]", ""), r"^\s*\([a-zA-Z0-9]+\)\s*", "")
    special = r"\^$.|?*+()[]{}"
    quoted = ["".join("\\" + c if c in special else c for c in k) for k in keywords if k]
    out = F.concat(F.substring(t, F.lit(1), F.lit(plain)), F.when(F.length(t) > plain, "...").otherwise(""))
    for k in reversed([k for k in keywords if k]):
        at = F.locate(k.lower(), F.lower(t)) - 1
        low, high = F.greatest(F.lit(0), at - around), F.least(F.length(t), at + len(k) + around)
        part = F.substring(t, low + 1, high - low)
        for q in quoted:
            part = F.regexp_replace(part, f"(?i)({q})", "<$1>")
        out = F.when(at >= 0, F.concat(F.when(low > 0, "...").otherwise(""), part, F.when(high < F.length(t), "...").otherwise(""))).otherwise(out)
    return F.when(F.coalesce(text, F.lit("")) == "", "(No text available)").otherwise(out)


def classifier_entry(text: Column, model: Column, rules: Column) -> Column:
    """The model's topic, else the rules', else unknown; unknown for a blank text."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "00. Unknown").otherwise(F.coalesce(model, rules, F.lit("00. Unknown")))


def manifest_rejects(manifests: DataFrame) -> DataFrame:
    """Adds version and ``reject`` to plug-in manifests (column json): what is wrong first, null for a good one.

    A version's dots are left out: '3.0' is 30; what is no number is 1.
    """
    m = manifests.withColumn("__m", F.from_json("json", "code string, name string, manifest_schema_version string, schema_version string, supported_years array<string>, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    code, name = F.trim(F.coalesce("__m.code", F.lit(""))), F.trim(F.coalesce("__m.name", F.lit("")))
    raw = F.coalesce(F.nullif("__m.manifest_schema_version", F.lit("")), F.nullif("__m.schema_version", F.lit("")))
    reject = F.when(F.col("__m").isNull() | F.col("__m._bad").isNotNull() | ~F.startswith(F.trim("json"), F.lit("{")), "not an object").when(~code.rlike("^[A-Za-z0-9]{1,10}$"), "code").when(name == "", "no name").when(F.length(name) > 100, "name")
    return m.withColumn("version", F.coalesce(F.replace(raw, F.lit("."), F.lit("")).try_cast("int"), F.lit(1))).withColumn("reject", reject).drop("__m")


def decoded_catalogue(lines: DataFrame) -> DataFrame:
    """The valid records of a catalogue's lines (column line): blank, undecodable, pathless and invalid ones are left out; a missing is_valid counts as true."""
    rows = lines.filter(F.trim("line") != "").select(F.from_json("line", QUESTION + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    return rows.filter("_bad is null and relative_path is not null and coalesce(is_valid, true)").drop("_bad")


def decoded_regions(documents: DataFrame) -> DataFrame:
    """One row per region of regions documents (column json): kind by the label's depth, left 0, right the width, inline false where absent."""
    rows = documents.select(F.from_json("json", REGIONS).alias("d")).select("d.question_id", "d.composite_size", F.explode("d.regions").alias("label", "r"))
    depth = F.regexp_count("label", F.lit(r"\("))
    kind = F.coalesce("r.kind", F.when(depth == 0, "question").when(depth == 1, "letter").otherwise("roman"))
    return rows.select("question_id", "label", kind.alias("kind"), F.col("r.bounds.top").alias("top"), F.col("r.bounds.bottom").alias("bottom"), F.coalesce("r.bounds.left", F.lit(0)).alias("left"), F.coalesce("r.bounds.right", "composite_size.width").alias("right"), F.coalesce("r.child_is_inline", F.lit(False)).alias("inline"))


def encoded_regions(regions: DataFrame) -> DataFrame:
    """(question_id, json): a regions document of each question, labels to bounds, of the current version.

    regions: question_id, width, height, label, top, bottom, left, right (nulls are left out).
    """
    rows = regions.groupBy("question_id", "width", "height").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.struct("top", "bottom", "left", "right").alias("b"))))).alias("__m"))
    doc = F.struct(F.lit(REGIONS_VERSION).alias("schema_version"), "question_id", F.struct("width", "height").alias("composite_size"), F.transform_values("__m", lambda k, b: F.struct(b.alias("bounds"))).alias("regions"))
    return rows.select("question_id", F.to_json(doc).alias("json"))


def archive_entries(plans: DataFrame, slices: DataFrame) -> DataFrame:
    """(folder, place, file) of an export: a numbered folder per plan, the root's slice first, then the included parts in order.

    plans: run columns, pos, question_id; slices: question_id, ord (0: root), label.
    """
    rows = plans.join(slices, "question_id")
    keys = [c for c in plans.columns if c not in ("pos", "question_id")]
    place = F.row_number().over(Window.partitionBy(*keys, "pos").orderBy("ord"))
    return rows.select(*keys, F.concat(F.lpad(F.col("pos").cast("string"), 2, "0"), F.lit("_"), F.col("question_id").cast("string")).alias("folder"), place.alias("place"), F.concat(F.regexp_replace("label", r"[()]+", "_"), F.lit(".png")).alias("file"))


def build_documents(leaves: DataFrame, run: list[str], target: int, seed: int) -> DataFrame:
    """(run, json): one metadata document per build with its settings, totals and topics."""
    totals = leaves.groupBy(*run).agg(F.sum("marks").alias("total_marks"), F.countDistinct("question_id").alias("question_count"), F.sort_array(F.collect_set("topic")).alias("topics"))
    doc = F.struct(F.lit(target).alias("target_marks"), F.lit(seed).alias("seed"), "total_marks", "question_count", "topics")
    return totals.select(*run, F.to_json(doc).alias("json"))


def cleaned(text: Column) -> dict[str, Column]:
    """The texts that the diagnostics, the model and the pattern tools work on."""
    return {"diagnostic": tx.diagnostic_text(text), "model": tx.model_text(text), "plain": tx.squeezed(text), "pattern": tx.phrase_pattern(text)}
