"""What the operators of this subpackage share: inputs, shared storage, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import sys
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir where it is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        set_by_call = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = set_by_call.get() if set_by_call.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="quillmark-")
        spark.sparkContext.setCheckpointDir(at)
        _OWN.append((spark, at))
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone when the interpreter ends
        return


@atexit.register
def _clear() -> None:
    for spark, path in _OWN:
        _delete(spark, path)


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/quillmark/{label}-{uuid.uuid4().hex[:12]}"
    _OWN.append((spark, path))
    return path


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """From here on the session's JVM and Python workers exchange Arrow batches of about ``size`` at most, if it doesn't set a bound itself.

    By default they are eight times that, held in both and copied in each.  Plans run after
    an operator has returned, so the setting stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, size)


def written(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """The rows as a table in the shared folder: computed once, safe when executors are lost."""
    path = new_path(df.sparkSession, label)
    w = df.write.option("compression", "zstd")
    small_batches(df.sparkSession)
    (w.partitionBy(*by) if by else w).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.quillmark_path = path
    return out


def sized(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A written table as one side of a join: of more than ``most`` rows it is never sent to all tasks.

    Spark decides by the size of the files, which says little of decoded rows; their number is
    read from the files' footers.
    """
    return df if df.count() <= most else df.hint("merge")


def by_weight(left: DataFrame, right: DataFrame, key: str | list[str], weight: str, heavy: int = 4096, most: int = 100_000) -> DataFrame:
    """Inner join on ``key``, which is one of ``right``: frequent keys are joined without a shuffle.

    ``weight`` of ``right`` says how many rows of ``left`` have the key.  Those of over
    ``heavy`` rows are sent to all tasks if there are ``most`` of them or fewer.
    """
    keys = [key] if isinstance(key, str) else key
    often = right.filter(F.col(weight) > heavy)
    n = often.limit(most + 1).count()
    if not 0 < n <= most:
        return left.join(right.hint("merge"), keys)
    rest = left.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(right.filter(F.col(weight) <= heavy).hint("merge"), keys)
    return left.join(F.broadcast(often), keys).select(rest.columns).unionByName(rest)


def forget(*frames: DataFrame) -> None:
    """Deletes what was written for frames that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "quillmark_path", None):
            _delete(df.sparkSession, path)


def keyed_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the text (null: empty) alone, whatever other columns there are."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def free_name(base: str, *taken: list[str]) -> str:
    """``base``, lengthened until no column of the given lists has that name in any case."""
    used = {c.lower() for names in taken for c in names}
    while base.lower() in used:
        base += "_"
    return base


def local_rows(spark: SparkSession, columns: dict[str, tuple[str, list]]) -> DataFrame:
    """A small table from values of the driver, by name: (type, values); no Python worker has a part in it."""
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    return spark.createDataFrame(pa.table({name: pa.array(values, kinds[kind]) for name, (kind, values) in columns.items()}))


@lru_cache(maxsize=1)
def _return_memory() -> None:
    """Arrays of over 4 MB go back to the system when they are freed; once per worker."""
    tell = getattr(ctypes.CDLL(None), "mallopt", None)
    if tell is not None:
        tell(-3, 1 << 22)  # M_MMAP_THRESHOLD


def _release_automata() -> None:
    """Gives back what tokenizing left in this worker, which lives on from stage to stage."""
    module = sys.modules.get("quillmark.llm.bpe_automaton")
    if module is not None and module.automaton.cache_info().currsize:
        module.automaton.cache_clear()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def in_parts(batches: Iterator[pa.RecordBatch], chars: int = 1_000_000, tokenizes: bool = False) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches whose ``text`` is decoded a bounded amount at a time."""
    _return_memory()
    if not tokenizes:
        _release_automata()
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))
        low = 0
        while low < batch.num_rows:
            base = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, base + chars, "right")))
            yield batch.slice(low, high - low), column.slice(low, high - low).to_pylist()
            low = high
