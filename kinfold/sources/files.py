"""Small files and folders in whatever store the session's Hadoop configuration reaches: local disk, HDFS, an object store."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Paths under a root (a plain path or a URI), through Hadoop's FileSystem."""

    def __init__(self, spark: SparkSession, root: str):
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        path = self._hadoop.Path(str(root))
        self.fs = path.getFileSystem(self._conf)
        self.root = self.fs.makeQualified(path).toString().rstrip("/")
        self._spark = spark

    def uri(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str):
        return self._hadoop.Path(self.uri(name))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def is_folder(self, name: str) -> bool:
        return self.exists(name) and self.fs.getFileStatus(self._path(name)).isDirectory()

    def make(self, name: str) -> None:
        self.fs.mkdirs(self._path(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def read(self, name: str) -> str | None:
        """A file's text, or None where it is absent."""
        if not self.exists(name):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write a file beside and put it in place in one step, so that readers see the old one or the new one."""
        fresh = f"{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(fresh), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        context = self._hadoop.FileContext.getFileContext(self._path(name).toUri(), self._conf)
        kind = getattr(self._hadoop, "Options$Rename")
        options = self._spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        context.rename(self._path(fresh), self._path(name), options)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
