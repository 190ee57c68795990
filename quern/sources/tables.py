"""Versioned parquet tables: each write is a new folder, one pointer names the current ones."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


class TableStore:
    """Tables under one folder of any file system that Spark reads, for one writer at a time.

    A write goes to a folder of its own, then the pointer file, which names the version
    of every table, is replaced by a rename; a reader sees the old versions or the new
    ones, and a failed write leaves the old ones. A transaction moves the pointer once
    for all tables it writes. Old versions stay until `vacuum`, so a table can be
    rewritten from itself.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _replace(self, new, old) -> None:
        """Renames over what is there in one step."""
        jvm = self.spark._jvm
        how = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(how, 1)
        options[0] = how.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._fs().makeQualified(new), self._fs().makeQualified(old), options)

    def _versions(self) -> dict[str, int]:
        fs, path = self._fs(), self._path("CURRENT")
        if not fs.exists(path):
            return {}
        stream = fs.open(path)
        try:
            return json.loads(stream.readUTF())
        finally:
            stream.close()

    def _point(self, versions: dict[str, int]) -> None:
        fs, new = self._fs(), self._path("CURRENT.new")
        stream = fs.create(new, True)
        stream.writeUTF(json.dumps({**self._versions(), **versions}))
        stream.close()
        self._replace(new, self._path("CURRENT"))

    def version(self, name: str) -> int:
        """The current version, 0 if the table was never written."""
        return self._versions().get(name, 0)

    def exists(self, name: str) -> bool:
        return self.version(name) > 0

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/v{version or self.version(name)}")

    def write(self, name: str, df: DataFrame, sort_by: list[str] | None = None) -> int:
        """Writes `df` as the next version. sort_by: columns whose order within files lets
        later scans skip row groups."""
        with self.transaction() as t:
            return t.write(name, df, sort_by)

    def transaction(self) -> Transaction:
        return Transaction(self)

    def vacuum(self, name: str, keep: int = 2) -> None:
        """Deletes all versions but the last `keep`."""
        fs, current = self._fs(), self.version(name)
        for version in range(1, current - keep + 1):
            fs.delete(self._path(name, f"v{version}"), True)


class Transaction:
    """Writes to several tables that become current together, when the block ends
    without an error; reads see what it wrote itself."""

    def __init__(self, store: TableStore):
        self.store, self.spark, self.written = store, store.spark, {}

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and self.written:
            self.store._point(self.written)

    def exists(self, name: str) -> bool:
        return name in self.written or self.store.exists(name)

    def read(self, name: str) -> DataFrame:
        return self.store.read(name, self.written.get(name))

    def write(self, name: str, df: DataFrame, sort_by: list[str] | None = None) -> int:
        following = (self.written.get(name) or self.store.version(name)) + 1
        (df.sortWithinPartitions(*sort_by) if sort_by else df).write.mode("overwrite").parquet(f"{self.store.root}/{name}/v{following}")
        self.written[name] = following
        return following
