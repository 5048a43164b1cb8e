"""Small files of decisions on whatever file system Spark knows by the path."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder of small files that appear whole or not at all, and once."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self.root = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.root.getFileSystem(self.conf)
        self.no_options = spark._sc._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(self.root).toUri(), self.conf)

    def _of(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def names(self) -> list[str]:
        if not self.fs.exists(self.root):
            return []
        return sorted(n for s in self.fs.listStatus(self.root) if not (n := s.getPath().getName()).startswith((".", "_")))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._of(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether the file is new; one that is there stays as it is. A rename that does not overwrite decides."""
        if self.fs.exists(self._of(name)):
            return False
        part = self._of(f".{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            self.context.rename(self.fs.makeQualified(part), self.fs.makeQualified(self._of(name)), self.no_options)
            return True
        except Exception as e:
            self.fs.delete(part, False)
            if "AlreadyExists" in str(e):
                return False
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self._of(name), True)
