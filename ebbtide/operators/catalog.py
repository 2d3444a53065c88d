"""Catalogues of metrics and tags, and log search. Results are lists with a stated limit: the limit is the feature."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import finite
from .aggregate import time_bucket
from .predicates import filter_search_ci


def tag_keys_hourly(points: DataFrame) -> DataFrame:
    """(tenant_id, metric, hour, key, bare, points): which tag keys a metric had; key '' stands for every point."""
    keys = F.explode(F.array_append(F.coalesce(F.map_keys("tags"), F.array().cast("array<string>")), F.lit("")))
    rows = points.where(finite(F.col("value"))).select("tenant_id", "metric", time_bucket("t_ms", 3_600_000).alias("hour"), keys.alias("key"), "tags")
    bare = F.coalesce(F.array_contains(F.col("tags")[F.col("key")], ""), F.lit(False))
    return rows.groupBy("tenant_id", "metric", "hour", "key").agg(F.max(bare.cast("int")).alias("bare"), F.count("*").alias("points"))


def active_metrics(points: DataFrame, since_ms: int, host: str | None = None) -> DataFrame:
    rows = points.where(F.col("t_ms") >= since_ms)
    return (rows if host is None else rows.where(F.col("host") == host)).select("metric").distinct().orderBy("metric")


def list_metrics(catalog: DataFrame, search: str = "", limit: int = 500) -> DataFrame:
    names = catalog.where(filter_search_ci("metric", search)) if search else catalog
    return names.select("metric").distinct().orderBy("metric").limit(min(limit, 1000))


def list_tag_keys(catalog: DataFrame, metric: str | None = None, limit: int = 1000) -> DataFrame:
    rows = catalog.where("key <> ''")
    return (rows if metric is None else rows.where(F.col("metric") == metric)).select("key").distinct().orderBy("key").limit(limit)


def list_tag_values(points: DataFrame, key: str, search: str = "", limit: int = 200) -> DataFrame:
    values = points.select(F.explode(F.col("tags")[key]).alias("value")).distinct()
    return (values.where(filter_search_ci("value", search)) if search else values).orderBy("value").limit(limit)


def list_checks(runs: DataFrame, limit: int = 500) -> DataFrame:
    return runs.select("check_name").distinct().orderBy("check_name").limit(limit)


def log_search(logs: DataFrame, pred: Column, limit: int = 200) -> DataFrame:
    """The newest matching logs."""
    return logs.where(pred).orderBy(F.col("t_ms").desc(), F.col("log_id").desc()).limit(min(limit, 1000))


def log_count(logs: DataFrame, pred: Column) -> DataFrame:
    return logs.where(pred).agg(F.count("*").alias("n"))


def log_facet(logs: DataFrame, pred: Column, field: str, limit: int = 50) -> DataFrame:
    """The commonest values of a field, ties by value."""
    return logs.where(pred).groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value").limit(limit)


def newest_per(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key by the order given."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("nth", nth).where(F.col("nth") <= n).drop("nth")


def replace_by_version(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The newest row of each key, as an aggregate with map-side combining: no window over a hot key."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*version))
    return rows.groupBy(*keys).agg(best.alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def newest_then_ascending(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The newest n rows, oldest first, and whether there were more."""
    top = rows.orderBy(*[F.col(c).desc() for c in order]).limit(n + 1)
    w = Window.orderBy(*[F.col(c).desc() for c in order])
    seen = top.withColumn("nth", F.row_number().over(w)).withColumn("more", F.max("nth").over(Window.partitionBy()) > n)
    return seen.where(F.col("nth") <= n).drop("nth").orderBy(*order)


def dropped_by_age(rows: DataFrame, now_ms: int, days: int, column: str = "t_ms") -> DataFrame:
    """What a retention of so many days keeps."""
    return rows.where(F.col(column) > now_ms - days * 86_400_000)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
