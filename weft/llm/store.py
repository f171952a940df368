"""Tables written once and read again, in the folder that a cluster's machines share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's own setting by which a query's shuffle files go when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a batch that travels to a Python worker; Spark's own default counts rows, whatever their length.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 6 << 20
#: The column that numbered() adds.
ROW = "__weft_row"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, local mode gets a folder of its own, which is then set; a
    cluster must name one, as its machines do not see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Bounds that small_batches() has set; all others are the session's own.
_bounds: set[str] = set()


def small_batches(spark: SparkSession, size: int | None = None) -> None:
    """Bounds the batches that workers hold, for a session that leaves Spark's default in place. A size also takes the place
    of a bound set here before."""
    now = spark.conf.get(BATCH)
    if now == f"{64 << 20}b" or size and now in _bounds:  # the default, as Spark spells it
        _bounds.add(bound := str(size or BATCH_BYTES))
        spark.conf.set(BATCH, bound)


#: Scopes that are open: the paths of the tables made within each.
_scopes: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch():
    """Deletes on leaving the tables that written() makes within, but those given to the function that it yields; these
    belong to the scope around it, if there is one."""
    made: list[tuple[SparkSession, str]] = []
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table._weft_path)
        return table

    _scopes.append(made)
    try:
        yield keep
    finally:
        _scopes.remove(made)
        sweep([x for x in made if x[1] not in kept])
        if _scopes:
            _scopes[-1] += [x for x in made if x[1] in kept]


@contextmanager
def collected():
    """Yields the list of the tables that are made within and not deleted by then, for sweep() later."""
    made: list[tuple[SparkSession, str]] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)


def sweep(made: list[tuple[SparkSession, str]]) -> None:
    for spark, name in made:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def _cleaned(spark: SparkSession):
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: read again, it has no lineage, so a lost executor costs no more than a read.

    The shuffle files of the query that wrote it go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/weft-{name}-{uuid.uuid4().hex}"
    small_batches(spark)
    with _cleaned(spark):
        df.write.parquet(path)
    if _scopes:
        _scopes[-1].append((spark, path))
    found = spark.read.schema(df.schema).parquet(path)
    found._weft_path = path
    return found


def drop(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read again."""
    sweep([(table.sparkSession, table._weft_path) for table in tables])


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs as a written table with a number for each row in ROW: however often it is read, a row keeps its number."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), name)


def without_ids(df: DataFrame, ids: DataFrame, key: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """df without the rows whose key is in ids (one column, no nulls). Up to broadcast_rows ids are broadcast, more are
    joined by a shuffle; rows with a null key stay."""
    name = ids.columns[0]
    gone = "__weft_gone"
    found = written(ids.distinct().withColumnRenamed(name, gone), "gone")
    few = found.count() <= broadcast_rows
    return df.join(F.broadcast(found) if few else found, df[key] == F.col(gone), "left_anti")
