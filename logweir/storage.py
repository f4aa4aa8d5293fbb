"""Small files in a shared folder, on any file system that Spark writes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from urllib.parse import quote, unquote

from pyspark.sql import SparkSession

from logweir.commits import create_once


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is unset, on a local master, a folder of this machine is used."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(shared_dir, "local"):
        folder = tempfile.mkdtemp(prefix="logweir-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        shared_dir.local = "file://" + folder
    return shared_dir.local


def delete(spark: SparkSession, url: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(url)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Versions of a record that stay.
_KEEP = 8


class Versions:
    """Records by name, each a series of numbered versions that are created whole and never changed.

    A version is created only if its number is free, so that of two writers one wins; the other reads
    again and decides anew. Old versions are deleted; a writer that slept while that happened
    may create one of their numbers again, finds far higher ones, and takes that as lost."""

    def __init__(self, spark: SparkSession, url: str):
        self.spark, self.url = spark, url.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.url).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folder(self, name: str):
        return self.path(f"{self.url}/{quote(name, safe='')}")

    def names(self) -> list[str]:
        root = self.path(self.url)
        return sorted(unquote(s.getPath().getName()) for s in self.fs.listStatus(root)) if self.fs.exists(root) else []

    def _number(self, name: str) -> int:
        folder = self._folder(name)
        if not self.fs.exists(folder):
            return 0
        return max((int(s.getPath().getName()) for s in self.fs.listStatus(folder) if s.getPath().getName().isdigit()), default=0)

    def last(self, name: str) -> tuple[int, bytes | None]:
        """The highest number, and its record."""
        while number := self._number(name):
            try:
                stream = self.fs.open(self.path(self._folder(name), f"{number:020d}"))
            except Exception:
                # Between the look and the reading, enough versions came to have this one deleted.
                if self._number(name) == number:
                    raise
                continue
            try:
                return number, bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()
        return 0, None

    def create(self, name: str, number: int, record: bytes) -> bool:
        """Whether this writer got the number."""
        folder = f"{self.url}/{quote(name, safe='')}"
        if not create_once(self.spark, f"{folder}/{number:020d}", record):
            return False
        if self._number(name) >= number + _KEEP:
            self.fs.delete(self.path(f"{folder}/{number:020d}"), False)
            return False
        if number > _KEEP:
            self.fs.delete(self.path(f"{folder}/{number - _KEEP:020d}"), False)
        return True
