"""A log of versions in a folder: each is one small JSON file that is made whole or not at all.

A writer prepares its data files, takes the last version, and creates the next one's file by a rename that refuses an
existing name. If another writer was first, the edit is made again on what that one wrote. So no change is lost, readers
never see half of one, and a writer that dies leaves only files that no version names. The folder's file system has to refuse
such renames, as HDFS does.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer was first, again and again."""


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, path: str):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The last version; -1 where there is none."""
        fs, p = self._hadoop(self.path)
        if not fs.exists(p):
            return -1
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max((int(n[1:-5]) for n in names if n.startswith("m") and n.endswith(".json")), default=-1)

    def read(self, version: int | None = None) -> dict | None:
        version = self.version() if version is None else version
        if version < 0:
            return None
        fs, p = self._hadoop(f"{self.path}/m{version:09d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put(self, version: int, content: dict) -> bool:
        """Writes a version; False if it is there already."""
        sc = self.spark.sparkContext
        fs, p = self._hadoop(f"{self.path}/.{uuid.uuid4().hex}.tmp")
        stream = fs.create(p, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        _, target = self._hadoop(f"{self.path}/m{version:09d}.json")
        context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
        keep_existing = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(p), fs.makeQualified(target), keep_existing)
            return True
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            fs.delete(p, False)
            return False

    def change(self, edit: Callable[[dict | None], dict | None], tries: int = 50) -> int:
        """Commits what ``edit`` makes of the last version, anew if another writer was first; None leaves it as it is."""
        for _ in range(tries):
            at = self.version()
            new = edit(self.read(at))
            if new is None or self.put(at + 1, new):
                return at if new is None else at + 1
        raise Conflict(f"{tries} other writers were first at {self.path}")

    def delete(self, name: str) -> None:
        fs, p = self._hadoop(f"{self.path}/{name}")
        fs.delete(p, True)

    def folders(self) -> list[str]:
        fs, p = self._hadoop(self.path)
        return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []

    def forget(self, before: int) -> None:
        """Deletes the files of versions before this one."""
        fs, p = self._hadoop(self.path)
        for name in [s.getPath().getName() for s in fs.listStatus(p)]:
            if name.startswith("m") and name.endswith(".json") and int(name[1:-5]) < before:
                self.delete(name)
