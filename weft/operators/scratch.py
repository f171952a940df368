"""Tables written on the way to a result, in the checkpoint folder, and deleted when it is there."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting by which a query's shuffle files go when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """A folder of Parquet tables; on leaving, all of them go but the results."""

    def __init__(self, spark: SparkSession):
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not folder.isDefined():
            raise ValueError("a checkpoint folder that all machines share must be set")
        self.spark, self.folder, self.paths, self.names = spark, folder.get().rstrip("/"), [], []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*self.paths)
        for name in self.names:
            self.spark.sql(f"drop table if exists {name}")

    @contextmanager
    def _cleaned(self):
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            yield
        finally:
            self.spark.conf.set(CLEANUP, before)

    def path(self) -> str:
        return f"{self.folder}/weft-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, path: str | None = None) -> DataFrame:
        """df as a table; its shuffle files go at once. With a path df is added to the result there, which stays."""
        if path is None:
            self.paths.append(path := self.path())
        with self._cleaned():
            df.write.mode("append").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, *by: str) -> DataFrame:
        """df as a table in buckets by these columns, so that joins on them shuffle the other side only. It is not shuffled
        for that, and so should come from an aggregation by these columns."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name, path = f"weft_{uuid.uuid4().hex}", self.path()
        self.paths.append(path)
        self.names.append(name)
        with self._cleaned():
            df.write.bucketBy(n, *by).sortBy(*by).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
        return self.spark.table(name)

    def mark(self) -> int:
        return len(self.paths)

    def drop(self, *paths: str) -> None:
        for name in paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        self.paths = [x for x in self.paths if x not in paths]

    def drop_since(self, mark: int) -> None:
        self.drop(*self.paths[mark:])
