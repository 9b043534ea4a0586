"""JSON Lines catalogues and region documents: reading, checking, writing, appending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = (
    "schema_version int, question_id string, exam_code string, year int, paper int, variant int, question_number int, total_marks int, part_count int, "
    "topic string, sub_topics array<string>, child_topics map<string,string>, relative_path string, root_text string, child_text map<string,string>, "
    "content_right int, numeral_bbox array<int>, mark_bboxes array<array<int>>, markscheme_path string, horizontal_offset int, is_valid boolean"
)
REGIONS = (
    "schema_version int, question_id string, composite_size struct<width:int,height:int>, horizontal_offset int, numeral_bbox array<int>, mark_bboxes array<array<int>>, "
    "regions map<string, struct<bounds:struct<top:int,bottom:int,left:int,right:int>, kind:string, marks:int, "
    "label_bbox:struct<top:int,bottom:int,left:int,right:int>, is_valid:boolean, validation_issues:array<string>, child_is_inline:boolean>>"
)
#: Current versions of both documents (fixed values).
QUESTION_VERSION, REGIONS_VERSION = 9, 3
REQUIRED = ["question_id", "exam_code", "year", "paper", "variant", "question_number", "total_marks", "part_count", "topic"]


def read_catalogue(spark: SparkSession, path: str, strict: bool = False, absent: str = "fail") -> DataFrame:
    """Valid records with a relative path; undecodable ones fail if ``strict`` and are skipped if not.

    A missing is_valid counts as true.  A catalogue that is not there fails, or has no records
    if ``absent`` is "none".
    """
    if absent not in ("fail", "none"):
        raise ValueError("absent is one of fail, none")
    if absent == "none":
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at):
            return spark.createDataFrame([], QUESTION)
    reader = spark.read.schema(QUESTION + ", _bad string")
    rows = reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter("_bad is null and relative_path is not null and coalesce(is_valid, true)").drop("_bad")


def rejects(rows: DataFrame) -> DataFrame:
    """Adds ``reject``: what is wrong with a record first, null for a good one."""
    missing = [F.when(F.col(c).isNull(), f"missing {c}") for c in REQUIRED]
    checks = [
        F.when(F.coalesce("schema_version", F.lit(1)) != QUESTION_VERSION, "schema version"),
        F.when(~F.col("exam_code").rlike("^[0-9]{4}$"), "exam code"),
        F.when(~F.col("year").between(2000, 2100), "year"),
        F.when(~F.col("paper").between(1, 9), "paper"),
        F.when(F.col("total_marks") < 0, "marks"),
    ]
    return rows.withColumn("reject", F.coalesce(*missing, *checks))


def exploded_parts(questions: DataFrame) -> DataFrame:
    """(question_id, label, text, topic) of the catalogue's child texts; a child topic wins over the question's."""
    return questions.select("question_id", F.explode("child_text").alias("label", "text"), "child_topics", "topic").select("question_id", "label", "text", F.coalesce(F.try_element_at("child_topics", "label"), "topic").alias("topic"))


def write_catalogue(questions: DataFrame, path: str, mode: str = "overwrite") -> None:
    questions.write.mode(mode).json(path)


def append_new(spark: SparkSession, new: DataFrame, path: str) -> None:
    """Appends the records whose question_id is not there yet.

    For one writer at a time: two appends at once may both add the same id
    (``versions.append_new`` adds it once).  Readers see whole batches.
    """
    from quillmark.operators.search import new_only

    seen = spark.read.schema("question_id string").json(path)
    new_only(new, seen, ["question_id"]).write.mode("append").json(path)


def outdated(spark: SparkSession, path: str) -> DataFrame:
    """(file, version) of catalogues whose first line has a version below the current; 0 for one that can't be read."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at"))
    first = lines.groupBy("file").agg(F.min_by("value", "at").alias("line"))
    decoded = F.from_json("line", "schema_version int, _schema_version int, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    version = F.when(decoded["_bad"].isNotNull(), 0).otherwise(F.coalesce(decoded["schema_version"], decoded["_schema_version"], F.lit(1)))
    return first.select("file", version.alias("version")).filter(F.col("version") < QUESTION_VERSION)


def triaged_papers(spark: SparkSession, root: str, supported: list[str]) -> DataFrame:
    """(path, exam_code, status) of the PDFs under a folder: supported, unsupported or invalid; mark schemes left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(root).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    code = F.nullif(F.regexp_extract(name, r"^(\d{3,5})_", 1), F.lit(""))
    good = name.rlike(r"_\w{3}_qp_\d{2}") & code.isNotNull()
    return files.filter(~name.rlike("_ms_")).select("path", code.alias("exam_code"), F.when(~good, "invalid").when(code.isin(supported), "supported").otherwise("unsupported").alias("status"))


def loaded(questions: DataFrame, parts: DataFrame, topics: list | None = None, years: list | None = None, papers: list | None = None) -> DataFrame:
    """Valid records that pass the filters, by id: an empty or missing list lets all pass; years and papers may be strings."""
    from quillmark.operators.facets import where_in

    good = rejects(questions).filter("reject is null").drop("reject")
    held = parts.select("question_id").distinct()
    return where_in(good, topic=topics, year=years, paper=papers).join(held, "question_id", "left_semi").orderBy("question_id")


def write_questions(questions: DataFrame, parts: DataFrame, path: str) -> None:
    """Question folders: records by exam code with their parts in one document each; Spark renames finished files into place."""
    listed = parts.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct([c for c in parts.columns if c != "question_id"]))).alias("parts"))
    questions.join(listed, "question_id", "left").write.mode("overwrite").partitionBy("exam_code").json(path)


def write_question_folders(questions: DataFrame, regions: DataFrame, path: str, images: DataFrame | None = None) -> None:
    """``topic/question_id/`` with metadata.json, regions.json and, where there is one, the image: all of them or none.

    questions: question_id, topic and what else the records have; regions: question_id, json;
    images: question_id, file, content binary.  Signs that part folders become '_'.
    """
    from quillmark.sources.archives import write_files

    clean = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("unknown")), r"[/\\\\]", "_")
    folder = questions.select("question_id", F.concat(clean("topic"), F.lit("/"), clean("question_id"), F.lit("/")).alias("at"))
    record = F.to_json(F.struct(*questions.columns))
    out = questions.select("question_id", F.lit("metadata.json").alias("file"), F.encode(record, "UTF-8").alias("content")).unionByName(regions.select("question_id", F.lit("regions.json").alias("file"), F.encode("json", "UTF-8").alias("content")))
    if images is not None:
        out = out.unionByName(images.select("question_id", "file", "content"))
    write_files(out.join(folder, "question_id").select(F.concat("at", "file").alias("name"), "content"), path)


def write_document(spark: SparkSession, path: str, document: dict) -> None:
    """One JSON document in one file."""
    import json

    spark.range(1, numPartitions=1).select(F.lit(json.dumps(document, ensure_ascii=False, sort_keys=True)).alias("value")).write.mode("overwrite").text(path)


def upsert_file(spark: SparkSession, new: DataFrame, path: str, key: str) -> None:
    """Replaces a folder's JSON records of the same key and adds the rest: written beside it, then renamed into its place.

    For one writer and no reader at a time: between the two renames the folder is missing, and a
    failure there leaves the old one as ``.old``.  ``versions.upsert`` has neither gap.
    """
    from quillmark.operators.trees import upserted

    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    beside, old = jvm.org.apache.hadoop.fs.Path(path + ".new"), jvm.org.apache.hadoop.fs.Path(path + ".old")
    known = upserted(spark.read.schema(new.schema).json(path), new, key) if fs.exists(to) else new
    known.write.mode("overwrite").json(path + ".new")
    fs.delete(old, True)
    if fs.exists(to) and not fs.rename(to, old):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(beside, to):
        raise OSError(f"{path}.new can't be moved")
    fs.delete(old, True)
