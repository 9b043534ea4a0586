"""A build in one call: from catalogue rows to selection, pages, documents and files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.operators import pagination, reports, search, selection_pass
from quillmark.operators.detection import leaves
from quillmark.operators.facets import where_in
from quillmark.operators.numbering import numbered
from quillmark.operators.storage import kept
from quillmark.sources import archives
from quillmark.sources import catalogue_files as files


class BuildError(ValueError):
    """There is nothing to build from."""


@dataclass(frozen=True)
class Settings:
    """What a build asks for: the selection, filters, keywords and pins, and the page."""

    request: selection_pass.Request
    years: tuple = ()
    papers: tuple = ()
    keywords: tuple[str, ...] = ()
    pinned: tuple = ()
    part_pins: tuple[str, ...] = ()
    page_height: int = 3508
    margin_top: int = 50
    margin_bottom: int = 120
    spacing: int = 20
    run: list[str] = field(default_factory=lambda: ["exam_code"])


@dataclass(frozen=True)
class Exam:
    """Tables of a build of every run: leaves, slices in order, their pages, documents and warnings."""

    leaves: DataFrame
    slices: DataFrame
    pages: DataFrame
    documents: DataFrame
    warnings: DataFrame


def build_exam(questions: DataFrame, parts: DataFrame, s: Settings) -> Exam:
    """Filters, keyword matches, selection, composition, pages, documents and warnings.

    questions: run, question_id long, year, paper, topic; parts: question_id, ord, label, marks,
    topic, is_valid, text, top, bottom.  Filters by topic are the request's own.  Raises
    BuildError if no question is left, or if keywords are asked for and nothing matches or is pinned.
    """
    spark, run, r = questions.sparkSession, s.run, s.request
    own = kept(where_in(questions, year=[int(y) for y in s.years] or None, paper=list(s.papers) or None))
    parts = kept(parts.join(own.select("question_id"), "question_id", "left_semi"))
    if own.isEmpty() or parts.isEmpty():
        raise BuildError("no questions match the filters")
    matched = search.question_hits(parts.withColumn("root_text", F.lit("")), list(s.keywords)).select("question_id", "label").distinct() if s.keywords else parts.select("question_id", "label").limit(0)
    pinned = spark.createDataFrame([(int(q),) for q in s.pinned], "question_id long")
    part_pins = selection_pass.part_pins_of(s.part_pins, spark)
    if r.keyword_mode and s.keywords and matched.isEmpty() and not s.pinned and not s.part_pins:
        raise BuildError(f"no questions match the keywords {', '.join(s.keywords)}")
    found = kept(selection_pass.build(own, parts.select("question_id", "ord", "label", "marks", "topic", "is_valid"), run, r, pinned, part_pins, matched))

    place = (F.row_number().over(Window.partitionBy("question_id").orderBy("ord")) - 1).alias("k")
    shown = parts.select("question_id", place, "ord", "label", "top", "bottom")
    picked = kept(found.join(shown, ["question_id", "k"]))
    number = F.dense_rank().over(Window.partitionBy(*run).orderBy("question_id"))
    ordered = picked.withColumns({"pos": number, "place": F.row_number().over(Window.partitionBy(*run).orderBy("question_id", "ord"))})
    slices = kept(ordered.select(*run, "pos", "question_id", "place", "ord", "label", "marks", "top", "bottom"))
    heights = slices.select(*run, F.col("place").alias("grp"), F.greatest(F.lit(1), F.col("bottom") - F.col("top")).alias("height"))
    room = s.page_height - s.margin_top - s.margin_bottom
    pages = pagination.paginate(heights, run, room, s.spacing).withColumn("top", F.col("top") + s.margin_top)
    high = pagination.oversize(heights, run, room).select(*run, "warning")
    told = selection_pass.warnings(found, run, r).select(*run, F.explode(F.array_compact(F.array(
        F.when(F.col("excess").isNotNull(), F.format_string("%d marks over the target", F.col("excess").cast("int"))),
        F.when(F.col("mismatched").isNotNull(), F.concat(F.lit("topics not asked for: "), F.col("mismatched"))),
    ))).alias("warning"))
    topics = found.join(own.select("question_id", F.col("topic").alias("__q")), "question_id").withColumn("topic", F.coalesce("topic", "__q"))
    return Exam(picked, slices, kept(pages), kept(reports.build_documents(topics, run, r.target, r.seed)), kept(told.unionByName(high)))


def readmes(exam: Exam, s: Settings) -> DataFrame:
    """(run, name, readme): the archive's name of each run and a text with its totals, questions and parts."""
    run = s.run
    plans = exam.slices.groupBy(*run, "pos", "question_id").agg(F.sum("marks").alias("marks"), F.array_join(F.sort_array(F.collect_list("label")), ", ").alias("parts"))
    line = F.format_string("%d. %s (%d marks)\n   Parts: %s", F.col("pos"), F.col("question_id").cast("string"), F.col("marks").cast("int"), F.col("parts"))
    listed = plans.groupBy(*run).agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"), F.sum("marks").alias("total"))
    head = F.format_string(f"Total marks: %d\nTarget: {s.request.target} (+-{s.request.tolerance})\nQuestions: %d\n\n", F.col("total").cast("int"), F.size("l"))
    return listed.select(*run, F.concat(F.concat_ws("-", *run), F.lit(".zip")).alias("name"), F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("readme"))


def entries(exam: Exam, s: Settings) -> DataFrame:
    """(run, folder, place, file, content): a numbered folder for each question with a JSON document of each slice."""
    place = F.row_number().over(Window.partitionBy(*s.run, "pos").orderBy("ord"))
    content = F.to_json(F.struct("question_id", "label", "marks", "top", "bottom")).cast("binary")
    return exam.slices.select(*s.run, F.lpad(F.col("pos").cast("string"), 4, "0").alias("folder"), place.alias("place"), F.concat("label", F.lit(".json")).alias("file"), content.alias("content"))


def free_folder(spark: SparkSession, base: str, name: str, mark: str = "({})") -> str:
    """``base/name``, with (1), (2) and so on behind it, written as ``mark``, if there is such a folder."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = lambda p: jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p))
    path, k = f"{base.rstrip('/')}/{name}", 0
    while there(path + mark.format(k) if k else path):
        k += 1
    return path + mark.format(k) if k else path


def write_exam(exam: Exam, s: Settings, base: str, name: str) -> str:
    """Writes a build's tables, documents and archives to a folder of its own; returns the folder."""
    spark = exam.slices.sparkSession
    at = free_folder(spark, base, name)
    for table in ("slices", "pages", "documents", "warnings"):
        getattr(exam, table).write.json(f"{at}/{table}")
    archives.write_files(archives.archives(entries(exam, s), readmes(exam, s), s.run, "name"), f"{at}/archives")
    return at


def exam_from_files(spark: SparkSession, catalogue: str, regions: str, s: Settings, base: str, name: str) -> tuple[str, Exam]:
    """The whole way: catalogue and regions documents in, a build's folder out.

    Question ids are numbered in order for the selection; the slices carry the catalogue's ids
    as ``record``.
    """
    raw = files.rejects(files.read_catalogue(spark, catalogue)).filter("reject is null")
    ids = kept(numbered(raw.select(F.col("question_id").alias("record")).distinct(), [F.col("record")], "question_id").withColumn("question_id", F.col("question_id").cast("long")))
    q = raw.withColumnRenamed("question_id", "record").join(ids, "record")
    documents = spark.read.schema(files.REGIONS).json(regions).withColumnRenamed("question_id", "record")
    boxes = documents.join(ids, "record").select("question_id", F.explode("regions").alias("label", "x")).filter("x.bounds is not null")
    texts = q.select("question_id", F.explode_outer("child_text").alias("label", "text"))
    told = q.select("question_id", F.explode_outer("child_topics").alias("label", "topic"))
    # leaves are labels that no other continues
    own = leaves(boxes.select("question_id", "label"), "question_id", "label")
    marks = boxes.join(own, ["question_id", "label"], "left_semi").select("question_id", "label", F.coalesce("x.marks", F.lit(0)).alias("marks"), F.coalesce("x.is_valid", F.lit(True)).alias("is_valid"), F.col("x.bounds.top").alias("top"), F.col("x.bounds.bottom").alias("bottom"))
    parts = marks.join(texts, ["question_id", "label"], "left").join(told, ["question_id", "label"], "left")
    parts = parts.withColumn("ord", F.row_number().over(Window.partitionBy("question_id").orderBy("top", "label")))
    exam = build_exam(q.select(*s.run, "question_id", *[c for c in ("year", "paper", "topic") if c not in s.run]), parts, s)
    exam = Exam(exam.leaves, kept(exam.slices.join(ids, "question_id")), exam.pages, exam.documents, exam.warnings)
    return write_exam(exam, s, base, name), exam

