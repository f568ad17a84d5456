"""Small operations on the lake's file system: what must be there once, or not yet.

Creating a file and moving a directory fail where the name is taken, so of several
writers one wins.  On HDFS and its like the name node decides that; on a local (or mounted) file system
the operating system does.  Nothing here reads or writes data.
"""

from __future__ import annotations

import os
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class LakeFiles:
    """The file system of a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)
        self.local = self._fs.getUri().getScheme() == "file"

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _local(self, path: str) -> str:
        return self._fs.makeQualified(self._path(path)).toUri().getPath()

    def whole(self, path: str) -> str:
        """The path as Spark's readers say it."""
        return self._fs.makeQualified(self._path(path)).toString()

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, folder: str) -> list[tuple[str, int]]:
        """Names and modification times (milliseconds) of what a folder holds; of none: nothing."""
        if not self.exists(folder):
            return []
        return [(s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(self._path(folder))]

    def matching(self, pattern: str) -> list[str]:
        """The full paths that a glob matches."""
        return [s.getPath().toString() for s in self._fs.globStatus(self._path(pattern)) or []]

    def make(self, folder: str) -> None:
        self._fs.mkdirs(self._path(folder))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def create(self, path: str) -> bool:
        """Makes an empty file; false if the name is taken."""
        if self.local:
            try:
                open(self._local(path), "x").close()
            except FileExistsError:
                return False
            return True
        try:
            self._fs.create(self._path(path), False).close()
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def move(self, source: str, target: str) -> bool:
        """Gives a file or folder another name in one step; false if that is taken."""
        self.make(os.path.dirname(target))
        if self.local:
            a, b = self._local(source), self._local(target)
            try:
                if os.path.isdir(a):
                    os.rename(a, b)  # never onto a folder that holds anything
                else:
                    os.link(a, b)
                    os.unlink(a)
            except OSError:
                if os.path.exists(b):
                    return False
                raise
            return True
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(self._path(source), self._path(target), self._gateway.new_array(rename, 0))
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True


def value_in_path(folder: str) -> str:
    """The value of the last `name=value` of a path, as it was before it was escaped."""
    return unquote(folder.rstrip("/").rsplit("=", 1)[1])
