"""Tables that cut lineage: written once to the shared folder, then read back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_written: ContextVar[list[tuple[str, str | None]]] = ContextVar("written", default=[])  # folders, with the table's name if it has one


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share. Without one there is an error, not a guess."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that ``durable`` writes inside are removed at the end; others stay. Frames that read them end with it."""
    outer = _written.get()
    mine: list[tuple[str, str | None]] = []
    _written.set(mine)
    try:
        yield
    finally:
        _written.set(outer)
        _remove(spark, mine)


def durable(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    The table outlives lost executors, has known size statistics, and is computed once
    however often it is read. ``release`` removes what was written so, and ``scope`` what was written inside it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ebbtide-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _written.get().append((path, None))
    return spark.read.schema(df.schema).parquet(path)


def durable_buckets(df: DataFrame, column: str, compression: str = "snappy") -> DataFrame:
    """As ``durable``, but bucketed by a column: a later join on it moves no row of this table."""
    spark = df.sparkSession
    name = f"ebbtide_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", compression).option("path", path).bucketBy(buckets, column).saveAsTable(name)
    _written.get().append((path, name))
    return spark.table(name)


def release(spark: SparkSession) -> int:
    """Remove what ``durable`` wrote in this context so far; returns the number of folders removed."""
    mine = _written.get()
    gone = _remove(spark, mine)
    mine.clear()
    return gone


class Folder:
    """A folder of any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self._store = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return bool(self._store.exists(self._path))

    def create(self) -> None:
        self._store.mkdirs(self._path)

    def remove(self) -> bool:
        return bool(self._store.delete(self._path, True))

    def names(self) -> list[str]:
        """What is in it, sorted; nothing if it is not there."""
        return sorted(x.getPath().getName() for x in self._store.listStatus(self._path)) if self.exists() else []


def _remove(spark: SparkSession, written: list[tuple[str, str | None]]) -> int:
    gone = 0
    for place, name in written:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        gone += Folder(spark, place).remove()
    return gone
