"""Shared storage: folders that the driver and all executors see, and small files written once."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a temporary one, on a single machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return posixpath.join(base, f"{kind}-{uuid.uuid4().hex}")


class Store:
    """The file system under a folder, for the few small files that say what the large ones are."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self.root = spark._jvm, root.rstrip("/")
        self._gateway, self._conf = spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        """Names in a folder; a missing one is empty."""
        p = self._path(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def size(self, folder: str) -> int:
        p = self._path(folder)
        return self._fs.getContentSummary(p).getLength() if self._fs.exists(p) else 0

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Write a whole file under a name that nothing has yet; False if another writer took the name first.

        The text is written beside and moved there: a reader sees all of it or none. The move
        does not replace a file, so of two writers one wins.
        """
        jvm, draft = self._jvm, self._path(f"{name}.{uuid.uuid4().hex}.draft")
        stream = self._fs.create(draft, False)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, self._path(name), how)
        except Exception:
            self._fs.delete(draft, False)
            if self._fs.exists(self._path(name)):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
