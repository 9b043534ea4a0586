"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of ``documents``.  ``run`` writes each result as Parquet in the shared
folder and reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import forget, free_name, sized, table, written
from quillmark.llm.decontaminate import clean_documents
from quillmark.llm.jaccard_join import similarity_components
from quillmark.llm.line_dedup import line_dedup
from quillmark.llm.packing import pack_documents
from quillmark.llm.quality import resample


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents drawn by importance resampling; the others go."""
    return resample(docs, table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: later copies of three-line windows go from the texts; n_chars follows."""
    out = line_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4 on five-word shingles at 0.8: of each group the smallest doc_id stays."""
    groups = similarity_components(docs, 5, 80, 100)
    name = free_name("gone", docs.columns)
    gone = written(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(sized(gone), F.col("doc_id") == F.col(name), "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a benchmark item go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: pieces of the documents' ids, placed into sequences of 1024."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("line dedup", repeated_lines),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Stages 1, 4 and 5 can't be said in SQL. Tests hold stage 1 against its scores and keys, stages 2 and 3
#: against brute force, stage 4 against exact containment and stage 5 against ids and capacity.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
