"""Folders of records that several writers change at once: immutable data, and one commit file a version.

A version is a file ``_commits/<number>.json`` that lists the data folders it consists of.  A writer
writes a data folder of its own and then creates the next commit file, which only one of
several can; the others look at what has come in between and try again.  A reader takes the newest
commit, whose data nobody touches, so it finds a whole version at any time.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from quillmark.operators.search import new_only
from quillmark.operators.trees import upserted


class Versions:
    """A folder of JSON records with commits."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def current(self) -> tuple[int, list[str]]:
        """(number, data folders) of the newest version; (0, []) without one."""
        if not self._fs.exists(self._at("_commits")):
            return 0, []
        names = [str(s.getPath().getName()) for s in self._fs.listStatus(self._at("_commits"))]
        number = max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)
        if not number:
            return 0, []
        stream = self._fs.open(self._at(f"_commits/{number:012d}.json"))
        try:
            return number, json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, schema, folders: list[str] | None = None) -> DataFrame:
        """The records of a version, the newest by default."""
        folders = self.current()[1] if folders is None else folders
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json([f"{self.path}/{f}" for f in folders])

    def commit(self, number: int, folders: list[str]) -> bool:
        """Makes a version; False if another writer has made that number."""
        to, beside = f"_commits/{number:012d}.json", f"_commits/.{uuid.uuid4().hex}"
        out = self._fs.create(self._at(beside), True)
        try:
            out.write(bytearray(json.dumps(folders).encode()))
        finally:
            out.close()
        try:
            if self._fs.getScheme() == "file":
                # the local file system's rename replaces; a second link to a name fails
                os.link(urlparse(f"{self.path}/{beside}").path, urlparse(f"{self.path}/{to}").path)
                return True
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self._conf)
            none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(self._at(beside), self._at(to), none)
            return True
        except Exception:
            if self._fs.exists(self._at(to)):
                return False
            raise
        finally:
            self._fs.delete(self._at(beside), False)

    def change(self, step: Callable[[list[str]], tuple[DataFrame, list[str]]], attempts: int = 100) -> int:
        """Commits what ``step`` makes of a version's data folders, (new records, folders that stay), on the newest version that nobody changes meanwhile."""
        for _ in range(attempts):
            number, folders = self.current()
            rows, stay = step(folders)
            name = f"data-{uuid.uuid4().hex}"
            rows.write.json(f"{self.path}/{name}")
            if self.commit(number + 1, [*stay, name]):
                return number + 1
            self._fs.delete(self._at(name), True)
        raise RuntimeError(f"{self.path}: other writers came first {attempts} times")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes data folders that none of the last ``keep`` versions lists; call it when no reader or writer is at work on older ones."""
        number, _ = self.current()
        held = set()
        for n in range(max(1, number - keep + 1), number + 1):
            stream = self._fs.open(self._at(f"_commits/{n:012d}.json"))
            held.update(json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            stream.close()
        gone = [n for s in self._fs.listStatus(self._at("")) if (n := str(s.getPath().getName())).startswith("data-") and n not in held]
        for name in gone:
            self._fs.delete(self._at(name), True)
        return gone


def append_new(spark: SparkSession, new: DataFrame, path: str, key: str = "question_id") -> int:
    """Appends the records whose key is not there yet, of records that share a key any one; two writers at once add every key once.

    Returns the version's number.  Null keys are left out.
    """
    at = Versions(spark, path)
    once = new.filter(new[key].isNotNull()).dropDuplicates([key])
    return at.change(lambda folders: (new_only(once, at.read(new.schema, folders), [key]), folders))


def upsert(spark: SparkSession, new: DataFrame, path: str, key: str = "question_id") -> int:
    """Replaces the records of the same key and adds the rest, as a version of its own; changes of other writers in between stay."""
    at = Versions(spark, path)
    return at.change(lambda folders: (upserted(at.read(new.schema, folders), new, key), []))
