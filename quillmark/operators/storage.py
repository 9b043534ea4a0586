"""Intermediate results as tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[tuple[SparkSession, str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder that setCheckpointDir named; a folder of its own where neither is set on a single machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = named.get() if named.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="quillmark-")
        spark.sparkContext.setCheckpointDir(at)
        _OWN.append((spark, at))
    return at.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder or a file wherever the session's file systems have it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clear() -> None:
    for spark, path in _OWN:
        try:
            delete(spark, path)
        except Exception:  # the session may be gone when the interpreter ends
            return


def kept(df: DataFrame) -> DataFrame:
    """Cuts the lineage of an intermediate result: computed once, written, and read again.

    The table is deleted by ``release``, or when the interpreter ends.  Its own shuffles are deleted as
    soon as it is written; Spark would keep them until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillmark/kept-{uuid.uuid4().hex[:12]}"
    _OWN.append((spark, path))
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.quillmark_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes the tables of frames that no plan reads any more."""
    for df in frames:
        if path := getattr(df, "quillmark_path", None):
            delete(df.sparkSession, path)
            _OWN[:] = [x for x in _OWN if x[1] != path]
