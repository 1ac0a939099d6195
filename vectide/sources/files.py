"""Small files on whatever file system Spark uses, and the folder that executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import StorageError


class Files:
    """Reads, writes, renames and lists small files through Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self, name: str):
        return self.path(name).getFileSystem(self.conf)

    def exists(self, name: str) -> bool:
        return self._fs(name).exists(self.path(name))

    def mkdirs(self, name: str) -> None:
        self._fs(name).mkdirs(self.path(name))

    def delete(self, name: str) -> None:
        self._fs(name).delete(self.path(name), True)

    def list(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs(name).listStatus(self.path(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self._fs(name).open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def size(self, name: str) -> int:
        """Bytes of a file, or of all files in a folder."""
        return self._fs(name).getContentSummary(self.path(name)).getLength()

    def age(self, name: str) -> float:
        """Seconds since a file or folder was last changed."""
        return (self.jvm.java.lang.System.currentTimeMillis() - self._fs(name).getFileStatus(self.path(name)).getModificationTime()) / 1000

    def _beside(self, name: str, text: str) -> str:
        beside = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self._fs(beside).create(self.path(beside), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        return beside

    def _rename(self, old: str, new: str, how: str) -> None:
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(new).toUri(), self.conf) if "://" in new else self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), how)
        context.rename(self.path(old), self.path(new), options)

    def write(self, name: str, text: str) -> None:
        """Writes beside the file and renames over it, so that readers see the old text or the new."""
        self._rename(self._beside(name, text), name, "OVERWRITE")

    def create(self, name: str, text: str) -> bool:
        """Writes a file, whole, unless it is there already; whether it did.

        Of several writers one succeeds: a rename that must not overwrite is one
        step of the file system (HDFS; a hard link where files are local).
        """
        beside = self._beside(name, text)
        try:
            if self._fs(name).getUri().getScheme() == "file":
                os.link(self.path(beside).toUri().getPath(), self.path(name).toUri().getPath())
            else:
                self._rename(beside, name, "NONE")
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            self.delete(beside)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where that is unset, a local session, as in tests, gets a new folder, which
    becomes its checkpoint folder; on a cluster that is an error, since
    a folder of one machine isn't shared.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise StorageError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="vectide-shared-"))
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")
