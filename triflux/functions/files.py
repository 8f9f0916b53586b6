"""Small files and folders on whatever file system Spark is given."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system of a path, and the path on it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(conf), place


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, so that all processes take it for the same place."""
    store, place = _hadoop(spark, path)
    return store.makeQualified(place).toString()


class Folder:
    """The entries of one folder; it need not exist before something is written."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark = spark
        self._store, self._path = _hadoop(spark, path)

    def _at(self, name: str) -> Any:
        return self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path, name)

    def names(self) -> list[str]:
        """Names of all entries, in order."""
        if not self._store.exists(self._path):
            return []
        return sorted(x.getPath().getName() for x in self._store.listStatus(self._path))

    def read(self, name: str) -> str:
        source = self._store.open(self._at(name))
        try:
            utils = self._spark.sparkContext._jvm.org.apache.commons.io.IOUtils
            return utils.toString(source, "UTF-8")
        finally:
            source.close()

    def write(self, name: str, text: str) -> None:
        """A whole file at once: written under another name, then renamed."""
        part = self._at(f".{name}.part")
        sink = self._store.create(part, True)
        try:
            sink.write(bytearray(text.encode()))
        finally:
            sink.close()
        if not self._store.rename(part, self._at(name)):
            raise OSError(f"cannot write {self._at(name).toString()}")

    def remove(self, name: str) -> None:
        """An entry with all that is in it; none is no error."""
        self._store.delete(self._at(name), True)
