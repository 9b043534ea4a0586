"""ZIP archives: one a build, made in the task that has its entries, moved into place when the job commits."""

from __future__ import annotations

import io
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: The same entries give the same bytes.
_TIME = (1980, 1, 1, 0, 0, 0)
README = "README.txt"


def zipped(entries: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in entries:
            z.writestr(zipfile.ZipInfo(name, _TIME), content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def archives(entries: DataFrame, readmes: DataFrame, run: list[str], name: str) -> DataFrame:
    """(name, content): one archive for each build, its README first and then its entries by folder and place.

    entries: run, folder, place, file, content binary; readmes: run, the archive's ``name``,
    readme.  A build holds what its marks allow, so an archive is made in one task's memory.
    Builds without a readme have none of the archives.
    """
    rows = entries.select(*run, "folder", "place", "file", F.col("content").alias("__c")).join(readmes.select(*run, F.col(name).alias("__name"), "readme"), run)

    def pack(found: pa.Table) -> pa.Table:
        found = found.sort_by([("folder", "ascending"), ("place", "ascending")])
        own = zip(found["folder"].to_pylist(), found["file"].to_pylist(), found["__c"].to_pylist())
        content = zipped([(README, found["readme"][0].as_py().encode()), *((f"{folder}/{file}", c or b"") for folder, file, c in own)])
        return pa.table({"name": pa.array([found["__name"][0].as_py()], pa.string()), "content": pa.array([content], pa.binary())})

    return rows.groupBy(*run).applyInArrow(pack, "name string, content binary")


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class ArchiveWriter(DataSourceWriter):
    """Writes files beside their places; a commit moves them all, an abort deletes them."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.beside = f".writing-{uuid.uuid4().hex}"

    def _at(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def write(self, iterator: Iterator) -> Written:
        store, base = self._at()
        moves = []
        for row in iterator:
            # a task that runs again writes files of its own
            beside = posixpath.join(base, self.beside, uuid.uuid4().hex)
            store.create_dir(posixpath.dirname(beside), recursive=True)
            with store.open_output_stream(beside) as out:
                out.write(bytes(row["content"]))
            moves.append((beside, posixpath.join(base, row["name"])))
        return Written(moves)

    def commit(self, messages: list[Written]) -> None:
        store, base = self._at()
        for m in messages:
            for beside, to in m.moves if m else ():
                store.create_dir(posixpath.dirname(to), recursive=True)
                if store.get_file_info(to).type != fs.FileType.NotFound:
                    if not self.overwrite:
                        raise FileExistsError(to)
                    store.delete_file(to)
                store.move(beside, to)
        self._clear(store, base)

    def abort(self, messages: list[Written]) -> None:
        self._clear(*self._at())

    def _clear(self, store: fs.FileSystem, base: str) -> None:
        at = posixpath.join(base, self.beside)
        if store.get_file_info(at).type != fs.FileType.NotFound:
            store.delete_dir(at)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillmark_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], overwrite)


def write_files(files: DataFrame, path: str, mode: str = "append") -> None:
    """Writes rows (name, content) as files of a folder: all of them or, if a task fails for good, none.

    Names that are there already fail in ``append`` and are replaced in ``overwrite``.
    """
    files.sparkSession.dataSource.register(ArchiveSource)
    files.select("name", "content").write.format("quillmark_files").option("path", path).mode(mode).save()


def entries_of(spark: SparkSession, path: str) -> DataFrame:
    """(archive, place, entry, content) of the archives in a folder, in the order in which they are stored."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    own = z.namelist()
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(own)), pa.array(range(len(own)), pa.int32()), pa.array(own, pa.string()), pa.array([z.read(n) for n in own], pa.binary())], names=["archive", "place", "entry", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(run, "archive string, place int, entry string, content binary")
