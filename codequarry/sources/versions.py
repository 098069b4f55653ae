"""Tables kept by version: each version is a numbered folder that appears as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """Numbered versions in a folder that driver and executors share. A version is written aside and renamed into place, so a reader sees the
    last whole one, also after a writer was lost half way; what such a writer left has no number and is never read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, *parts: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _store(self):  # noqa: ANN202
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Versions from first to last."""
        store, at = self._store(), self._path()
        names = [s.getPath().getName() for s in store.listStatus(at)] if store.exists(at) else []
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def latest(self) -> int:
        """The last version's number, 0 where there is none."""
        return max(self.numbers(), default=0)

    def has(self, number: int, name: str) -> bool:
        return self._store().exists(self._path(f"v{number:08d}", name))

    def read(self, number: int, name: str) -> DataFrame:
        return self.spark.read.parquet(str(self._path(f"v{number:08d}", name)))

    def _moved(self, aside: str, *to: str) -> None:
        if not self._store().rename(self._path(aside), self._path(*to)):
            raise RuntimeError(f"another writer has made {'/'.join(to)} in {self.folder}")

    def write(self, **tables: DataFrame) -> int:
        """A new version of these tables; its number."""
        number, aside = self.latest() + 1, f"writing-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.option("compression", "zstd").parquet(str(self._path(aside, name)))
        self._moved(aside, f"v{number:08d}")
        return number

    def add(self, number: int, name: str, df: DataFrame) -> DataFrame:
        """One more table of a version that is there."""
        aside = f"writing-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(str(self._path(aside)))
        self._moved(aside, f"v{number:08d}", name)
        return self.read(number, name)

    def remove(self, before: int) -> None:
        """Delete the versions before a number."""
        for n in self.numbers():
            if n < before:
                self._store().delete(self._path(f"v{n:08d}"), True)
