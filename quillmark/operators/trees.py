"""Part trees, pins and plans: lookups, label maps, encoding and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.detection import ancestors
from quillmark.operators.facets import effective_topic
from quillmark.operators.levels import decoded, encoded, first_not_inline  # noqa: F401
from quillmark.operators.numbering import numbered


def label_map(leaves: DataFrame, matched: DataFrame, pinned: DataFrame, part_pins: DataFrame) -> DataFrame:
    """(question_id, labels): keyword matches, all leaves of pinned questions, and pinned parts, each label once and sorted.

    matched: question_id, label; pinned: question_id; part_pins: pin as 'question_id::label',
    others are left out.
    """
    kind = leaves.schema["question_id"].dataType
    at = F.locate("::", "pin")
    parts = part_pins.filter(at > 0).select(F.expr("substring(pin, 1, locate('::', pin) - 1)").try_cast(kind).alias("question_id"), F.expr("substring(pin, locate('::', pin) + 2)").alias("label")).filter("question_id is not null")
    whole = leaves.join(pinned.select("question_id").distinct(), "question_id", "left_semi").select("question_id", "label")
    return matched.select("question_id", "label").union(whole).union(parts).groupBy("question_id").agg(F.sort_array(F.collect_set("label")).alias("labels"))


def intended(*sources: DataFrame) -> DataFrame:
    """Ids that any source has, each once, with their place in order of id."""
    ids = sources[0].select("question_id")
    for more in sources[1:]:
        ids = ids.union(more.select("question_id"))
    return ids.distinct()


def allowed_leaves(leaves: DataFrame, questions: DataFrame, mode: str, topics: list[str], picked: DataFrame | None = None) -> DataFrame:
    """Leaves that options may use: ALL every one, PRUNE up to the last that has a topic, SKIP those that have one, KEYWORD picked labels and all below them.

    leaves: question_id, ord, label, topic; picked: question_id, label.
    """
    if mode == "KEYWORD":
        paths = leaves.select("question_id", "label", F.explode(ancestors(F.col("label"))).alias("__path"))
        hit = paths.join(picked.select("question_id", F.col("label").alias("__path")).distinct(), ["question_id", "__path"], "left_semi")
        return leaves.join(hit.select("question_id", "label").distinct(), ["question_id", "label"], "left_semi")
    if mode == "ALL" or not topics:
        return leaves
    own = leaves.join(questions.select("question_id", F.col("topic").alias("__q")), "question_id")
    fits = effective_topic(F.col("topic"), F.col("__q")).isin(*topics)
    if mode == "PRUNE":
        last = F.max(F.when(fits, F.col("ord"))).over(Window.partitionBy("question_id"))
        return own.withColumn("__last", last).filter(F.col("ord") <= F.col("__last")).drop("__last", "__q")
    return own.filter(fits).drop("__q")


def split_leaves(leaves: DataFrame, plans: DataFrame) -> DataFrame:
    """The leaves of each planned question in document order with ``included``: whether the plan's mask holds them.

    leaves: question_id, ord; plans: question_id, mask over the leaves in order.
    """
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("ord")) - 1
    return leaves.withColumn("__k", place).join(plans.select("question_id", "mask"), "question_id").withColumn("included", F.getbit("mask", F.col("__k").cast("int")) == 1).drop("__k", "mask")


def fullness(split: DataFrame) -> DataFrame:
    """(question_id, n_included, n_excluded, is_full): a plan is full if it leaves out no leaf at all."""
    return split.groupBy("question_id").agg(F.count_if("included").alias("n_included"), F.count_if(~F.col("included")).alias("n_excluded"), F.bool_and("included").alias("is_full"))


def in_range(opts: DataFrame, least: int, most: int) -> DataFrame:
    """Options of least..most marks; their place stays."""
    return opts.filter(F.col("marks").between(least, most))


def refreshed(new: DataFrame, before: DataFrame) -> DataFrame:
    """New results and what was pinned before, each id once; ``counted`` where it is among the new ones."""
    rows = new.select("question_id", F.lit(True).alias("counted"), "pinned").union(before.filter("pinned").select("question_id", F.lit(False), "pinned"))
    return rows.groupBy("question_id").agg(F.bool_or("counted").alias("counted"), F.bool_or("pinned").alias("pinned"))


def match_list(matches: DataFrame) -> DataFrame:
    """Adds ``place``: pinned questions first, then by id; ``labels`` sorted; whether any label is nested (two brackets or more)."""
    listed = matches.groupBy("question_id").agg(F.bool_or("pinned").alias("pinned"), F.sort_array(F.collect_set("label")).alias("labels"))
    return numbered(listed.withColumn("nested", F.exists("labels", lambda x: F.regexp_count(x, F.lit(r"\(")) >= 2)), [F.desc("pinned"), F.col("question_id")])


def first_by(rows: DataFrame, wanted: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Each wanted key with the ``value`` of its first row in order; null where there is none."""
    return wanted.select(*keys).distinct().join(rows.groupBy(*keys).agg(F.min_by(value, order).alias(value)), keys, "left")


def root_label(labels: DataFrame, key: str) -> DataFrame:
    """(key, root): the label with the fewest brackets, the smallest of these."""
    return labels.groupBy(key).agg(F.min_by("label", F.struct(F.regexp_count("label", F.lit(r"\(")), F.col("label"))).alias("root"))


def region_rejects(documents: DataFrame, version: int) -> DataFrame:
    """Adds ``reject``: what is wrong with a regions document first, null for a good one.

    documents: schema_version, question_id, width, height, regions map of structs with bounds.
    """
    bounds = F.transform(F.map_values("regions"), lambda r: r["bounds"])
    return documents.withColumn(
        "reject",
        F.coalesce(
            F.when(F.col("schema_version").isNull() | F.col("question_id").isNull() | F.col("regions").isNull(), "missing fields"),
            F.when(F.col("schema_version") != version, "version"),
            F.when(F.col("width").isNull() | F.col("height").isNull(), "composite size"),
            F.when(F.exists(bounds, lambda b: b.isNull() | b["top"].isNull() | b["bottom"].isNull()), "no bounds"),
            F.when(F.exists(bounds, lambda b: (b["top"] < 0) | (b["bottom"] <= b["top"])), "bounds"),
        ),
    )


def stitched(questions: DataFrame, regions: DataFrame, child_topics: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, parts) as loaded: a region's offset and numeral box win unless they are 0 or empty; a child topic wins over the part's own."""
    r = regions.select("question_id", F.col("horizontal_offset").alias("__o"), F.col("numeral_bbox").alias("__b"))
    q = questions.join(r, "question_id")
    q = q.withColumn("horizontal_offset", F.coalesce(F.nullif("__o", F.lit(0)), "horizontal_offset", F.lit(0))).withColumn("numeral_bbox", F.when(F.size("__b") > 0, F.col("__b")).otherwise(F.col("numeral_bbox")))
    t = child_topics.select("question_id", "label", F.col("topic").alias("__t"))
    return q.drop("__o", "__b"), parts.join(t, ["question_id", "label"], "left").withColumn("topic", F.coalesce("__t", "topic")).drop("__t")


def keyword_index(questions: DataFrame, parts: DataFrame) -> DataFrame:
    """(question_id, root_text, texts): the root's text and a map of the labels' texts, both as they are searched."""
    texts = parts.groupBy("question_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "text")))).alias("texts"))
    return questions.select("question_id", "root_text").join(texts, "question_id", "left")


def upserted(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows with the new ones in the place of those of the same key, and the rest of the new ones."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def config_reject(target: Column, tolerance: Column, exam_code: Column, least: Column, most: Column) -> Column:
    """What is wrong with a build's settings first; null if nothing is."""
    return F.coalesce(
        F.when(target.isNull() | (target <= 0), "target"),
        F.when(tolerance < 0, "tolerance"),
        F.when(~F.coalesce(exam_code.rlike("^[0-9]{4}$"), F.lit(False)), "exam code"),
        F.when(least < 1, "least questions"),
        F.when(most < F.coalesce(least, F.lit(1)), "most questions"),
    )


def folder_name(stamp: Column, target: Column, seed: Column, topics: Column, keyword_mode: Column) -> Column:
    """stamp__m<target>__s<seed>__<topics>: 'keywords', up to three topic slugs in order, or 'all'."""
    slug = F.transform(F.slice(F.sort_array(topics), 1, 3), lambda t: F.translate(F.lower(F.regexp_replace(t, r"^\d+\.\s*", "")), " -", "__"))
    last = F.when(keyword_mode, "keywords").when(F.size(topics) > 0, F.array_join(slug, "+")).otherwise("all")
    return F.concat(stamp, F.lit("__m"), target.cast("string"), F.lit("__s"), seed.cast("string"), F.lit("__"), last)


def default_folder_name(stamp: Column, target: Column, seed: Column, topics: Column, keyword_mode: Column) -> Column:
    """As ``folder_name`` with all topics, other signs than letters and digits as '-', topics before keywords."""
    clean = lambda t: F.trim(F.regexp_replace(F.trim(F.regexp_replace(t, r"^\d+[.)]\s*", "")), "[^A-Za-z0-9]+", "-"), F.lit("-"))
    slug = F.transform(F.sort_array(topics), lambda t: F.coalesce(F.nullif(F.lower(clean(t)), F.lit("")), F.lit("misc")))
    last = F.when(F.size(topics) > 0, F.array_join(slug, "+")).when(keyword_mode, "keywords").otherwise("all")
    return F.concat(stamp, F.lit("__m"), target.cast("string"), F.lit("__s"), seed.cast("string"), F.lit("__"), last)


def scheme_files(papers: DataFrame, files: DataFrame) -> DataFrame:
    """(name, path): the mark scheme of each paper, from the folder with the least priority that has it; null without one.

    papers: name; files: name, path, priority.
    """
    found = files.groupBy(F.col("name").alias("__s")).agg(F.min_by("path", F.struct("priority", "path")).alias("path"))
    return papers.select("name", F.replace("name", F.lit("_qp_"), F.lit("_ms_")).alias("__s")).join(found, "__s", "left").select("name", "path")


def exam_codes(paths: DataFrame, catalogue: str) -> DataFrame:
    """Names of the folders right above a file of that name, hidden ones left out."""
    return paths.filter(F.element_at(F.split("path", "/"), -1) == catalogue).select(F.element_at(F.split("path", "/"), -2).alias("exam_code")).filter(~F.col("exam_code").startswith(".")).distinct()
