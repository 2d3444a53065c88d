"""Two-level aggregation: first over time within each series, then over the series of a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import SeriesFrame, finite, series_id

SPACE = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


def scan_points(points: DataFrame, tenant: str, metric: str, from_ms: int, to_ms: int, pred: Column | None = None, lookback_ms: int = 0) -> DataFrame:
    """Raw points of one metric in [from - lookback, to). The plain comparisons reach the Parquet scan."""
    rows = points.where((F.col("tenant_id") == tenant) & (F.col("metric") == metric))
    rows = rows.where((F.col("t_ms") >= from_ms - lookback_ms) & (F.col("t_ms") < to_ms))
    return rows if pred is None else rows.where(pred)


def time_bucket(t_ms: str | Column, step_ms: int) -> Column:
    """Start of the epoch-aligned bucket."""
    t = F.col(t_ms) if isinstance(t_ms, str) else t_ms
    return (F.floor(t / step_ms) * step_ms).cast("long")


def time_aggregate(name: str, step_s: float) -> Column:
    """One series' value in one bucket, over raw points. ``as_count`` and ``as_rate`` go by the series' type."""
    value, kind = F.col("value"), F.max("metric_type")
    seconds = F.greatest(F.col("interval"), F.lit(1))
    events = F.sum(value * F.when(F.col("metric_type") == "RATE", seconds).otherwise(1))
    if name == "as_count":
        return F.when(kind.isin("RATE", "COUNT"), events).otherwise(F.avg(value))
    if name == "as_rate":
        rate = events / F.greatest(F.lit(float(step_s)), F.max("interval").cast("double"))
        return F.when(kind == "RATE", rate).when(kind == "COUNT", events / step_s).otherwise(F.avg(value))
    if name == "count":
        return F.count(value).cast("double")
    return SPACE[name](value)


def rollup_aggregate(name: str, step_s: float) -> Column:
    """The same over one-minute rollup rows; an average is sum over points, never an average of averages."""
    mean = F.sum("value_sum") / F.sum("points")
    kind = F.max("metric_type")
    if name == "as_count":
        return F.when(kind.isin("RATE", "COUNT"), F.sum("value_events")).otherwise(mean)
    if name == "as_rate":
        rate = F.sum("value_events") / F.greatest(F.lit(float(step_s)), F.max("interval").cast("double"))
        return F.when(kind == "RATE", rate).when(kind == "COUNT", F.sum("value_events") / step_s).otherwise(mean)
    return {"avg": mean, "sum": F.sum("value_sum"), "min": F.min("value_min"), "max": F.max("value_max"), "count": F.sum("points").cast("double")}[name]


def with_groups(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """A row for each value of each grouping tag; ``host`` is its column. What is missing or empty is null, the N/A group."""
    for key in by:
        if key == "host":
            continue
        rows = rows.withColumn(key, F.explode_outer(F.col("tags")[key])).withColumn(key, F.nullif(F.col(key), F.lit("")))
    if "host" in by:
        rows = rows.withColumn("series_host", F.col("host")).withColumn("host", F.nullif(F.col("host"), F.lit("")))
    return rows


def per_series(
    points: DataFrame, *, metric: str, tenant: str = "default", pred: Column | None = None, by: tuple[str, ...] = (), time_agg: str = "avg", step_s: int, from_ms: int, to_ms: int, lookback: int = 0, rollup: bool = False
) -> DataFrame:
    """(series_id, keys..., bucket_ms, value): every series by itself. The first, partial bucket is dropped."""
    step = step_s * 1000
    rows = scan_points(points, tenant, metric, from_ms, to_ms, pred, lookback * step)
    if not rollup:
        rows = rows.where(finite(F.col("value"))).withColumn("series_id", series_id("tenant_id", "metric", "host"))
    rows = with_groups(rows, by).withColumn("bucket_ms", time_bucket("t_ms", step))
    agg = (rollup_aggregate if rollup else time_aggregate)(time_agg, step_s)
    out = rows.groupBy("series_id", *by, "bucket_ms").agg(agg.alias("value"))
    return out.where(F.col("bucket_ms") >= from_ms - lookback * step)


def space_aggregate(series: DataFrame, by: tuple[str, ...], how: str = "avg") -> DataFrame:
    return series.groupBy(*by, "bucket_ms").agg(SPACE[how]("value").alias("value"))


def aggregate(points: DataFrame, *, by: tuple[str, ...] = (), space_agg: str = "avg", step_s: int, from_ms: int, to_ms: int, **how) -> SeriesFrame:
    """Aligned series of one metric: time first, then space."""
    series = per_series(points, by=by, step_s=step_s, from_ms=from_ms, to_ms=to_ms, **how)
    return SeriesFrame(space_aggregate(series, by, space_agg), by, step_s * 1000, from_ms, to_ms)


def group_tags(keys: tuple[str, ...]) -> Column:
    """``key:value`` texts in the order of the keys; null is N/A."""
    parts = [F.concat(F.lit(f"{k}:"), F.coalesce(F.col(k), F.lit("N/A"))) for k in keys]
    return F.array(*parts) if parts else F.array().cast("array<string>")


def group_key(keys: tuple[str, ...]) -> Column:
    """The sorted ``key:value`` texts, comma-joined; ``*`` without keys."""
    return F.array_join(F.array_sort(group_tags(keys)), ",") if keys else F.lit("*")


def has_missing_group(keys: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys], F.lit(False))


def rollup_1m(points: DataFrame) -> DataFrame:
    """One row for each series and minute: type, interval, tags, and partial aggregates that can be merged."""
    minute = time_bucket("t_ms", 60_000).alias("t_ms")
    seconds = F.when(F.col("metric_type") == "RATE", F.greatest(F.col("interval"), F.lit(1))).otherwise(1)
    return (
        points.where(finite(F.col("value")))
        .withColumn("series_id", series_id("tenant_id", "metric", "host"))
        .groupBy("tenant_id", minute, "metric", "host", "series_id")
        .agg(
            F.max("metric_type").alias("metric_type"),
            F.max("interval").alias("interval"),
            F.first("tags").alias("tags"),
            F.count("*").alias("points"),
            F.min("value").alias("value_min"),
            F.max("value").alias("value_max"),
            F.sum("value").alias("value_sum"),
            F.sum(F.col("value") * seconds).alias("value_events"),
        )
    )


def rollup_with_tail(rollup: DataFrame, points: DataFrame, to_ms: int) -> DataFrame:
    """Whole minutes from the rollup, and the minute that holds ``to_ms`` again from raw points up to it."""
    minute = to_ms // 60_000 * 60_000
    tail = rollup_1m(points.where((F.col("t_ms") >= minute) & (F.col("t_ms") < to_ms)))
    return rollup.where(F.col("t_ms") < minute).unionByName(tail)
