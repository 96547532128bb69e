"""Small metadata files on any file system that Spark reaches (through Hadoop's FileSystem, on the driver)."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a folder of our own where there is but one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or "file:///tmp/checkpoints/tessera").rstrip("/")


class Files:
    def __init__(self, spark: SparkSession):
        self._sc = spark.sparkContext
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        p, fs = self._path(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        p, fs = self._path(path)
        return sorted(n for s in fs.listStatus(p) if not (n := s.getPath().getName()).endswith(".tmp")) if fs.exists(p) else []

    def modified(self, path: str) -> int:
        """When the file was written, in milliseconds."""
        p, fs = self._path(path)
        return fs.getFileStatus(p).getModificationTime()

    def delete(self, path: str) -> bool:
        p, fs = self._path(path)
        return fs.delete(p, True)

    def read(self, path: str) -> str:
        p, fs = self._path(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """A new file with all its content at once; FileExistsError if there is one.

        The content is written beside it first. On local disk a hard link then gives it its name, elsewhere a rename that
        never overwrites: of two writers of one name, one fails, and a crash leaves either the whole file or none.
        """
        p, fs = self._path(path)
        t, _ = self._path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(t, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
            stream.hflush()
        finally:
            stream.close()
        try:
            if fs.getUri().getScheme() == "file":
                of = lambda x: self._jvm.java.nio.file.Paths.get(fs.makeQualified(x).toUri())
                self._jvm.java.nio.file.Files.createLink(of(p), of(t))
            else:
                plain = self._sc._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(t, p, plain)
        except Py4JJavaError as e:
            if fs.exists(p):
                raise FileExistsError(path) from None
            raise OSError(f"could not create {path}") from e
        finally:
            if fs.exists(t):
                fs.delete(t, False)
