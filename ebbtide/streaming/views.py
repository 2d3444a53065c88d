"""Views that follow a stream, and the sinks that normalised payloads go to.

Rollup rows are written as partial aggregates of each micro-batch and merged when read, so late points need no
watermark and nothing is dropped: a point that comes a day late makes one more partial row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.aggregate import rollup_1m
from ..sources.normalise import Spec, facts_of, leftovers_of, letters_of, outcomes
from ..storage import Folder


def with_date(df: DataFrame, t_ms: str = "t_ms") -> DataFrame:
    return df.withColumn("date", F.to_date(F.timestamp_millis(F.col(t_ms))))


def sink_fact(df: DataFrame, path: str, t_ms: str = "t_ms", batch: str | None = None) -> bool:
    """Append rows to a fact table, partitioned by the sender's day. One call is one job: all of it or nothing.

    With the key of a batch it is written once, whoever sends it again: its rows go to folders of their own below each
    day, and a mark in the table's commit folder says that they are all there. A batch without its mark, cut off between the two, is
    written anew over what it left. Returns whether anything was written. Readers take ``committed``.
    """
    rows = with_date(df, t_ms)
    if batch is None:
        rows.write.mode("append").partitionBy("date").parquet(f"{path}/rows")
        return True
    key = quote(batch, safe="")
    mark = Folder(df.sparkSession, f"{path}/commits/{key}")
    if mark.exists():
        return False
    rows.write.mode("overwrite").partitionBy("date").parquet(f"{path}/batches/batch_key={key}")
    mark.create()
    return True


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a fact table: those appended without a batch, and those of every batch with its mark. None before the first."""
    places = [f"{path}/rows"] if Folder(spark, f"{path}/rows").exists() else []
    marks = Folder(spark, f"{path}/commits").names()
    parts = [spark.read.option("basePath", p).parquet(p) for p in places]
    if marks:
        parts.append(spark.read.option("basePath", f"{path}/batches").parquet(*[f"{path}/batches/batch_key={m}" for m in marks]).drop("batch_key"))
    return reduce(DataFrame.unionByName, parts) if parts else None


def follow_rollup(points: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep one-minute rollups of a stream of points below ``path``, a set of partial rows for each micro-batch.

    A batch's rows carry its number; a batch that is run again overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        rollup_1m(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_rollup(partials: DataFrame) -> DataFrame:
    """Partial rollup rows put together: sums add, extremes combine, averages follow from sum and points."""
    keys = ["tenant_id", "t_ms", "metric", "host", "series_id"]
    return partials.groupBy(*keys).agg(
        F.max("metric_type").alias("metric_type"), F.max("interval").alias("interval"), F.first("tags").alias("tags"), F.sum("points").alias("points"),
        F.min("value_min").alias("value_min"), F.max("value_max").alias("value_max"), F.sum("value_sum").alias("value_sum"), F.sum("value_events").alias("value_events"),
    )


def follow_current(versions: DataFrame, keys: list[str], version: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """The newest row of each key of a stream: changed keys go to ``sink`` after each micro-batch."""
    rest = [c for c in versions.columns if c not in keys]
    newest = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("r")).select(*keys, "r.*")
    return newest.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_outcomes(landing: DataFrame, spec: Spec, path: str, beside: tuple[str, ...] = ()) -> None:
    """Facts, dead letters and leftovers of a batch in one pass and one job: a folder for each tag, all of them or none."""
    outcomes(landing, spec, beside).write.mode("overwrite").partitionBy("tag").parquet(path)


def written_outcomes(spark: SparkSession, path: str, spec: Spec) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, dead letters, leftovers) of what ``write_outcomes`` or ``follow_payloads`` wrote; each reads its own folder only."""
    made = spark.read.parquet(path)
    return facts_of(made, spec), letters_of(made), leftovers_of(made)


def follow_payloads(landing: DataFrame, spec: Spec, path: str, checkpoint: str, beside: tuple[str, ...] = ()) -> StreamingQuery:
    """Normalise a stream of payloads: facts, letters and leftovers go out together, each micro-batch to a folder of its
    own that a rerun overwrites, so a failure in between repeats and loses nothing."""

    def write(batch: DataFrame, number: int) -> None:
        write_outcomes(batch, spec, f"{path}/batch={number}", beside)

    return landing.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resent_once(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """A stream without rows that repeat a key within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
