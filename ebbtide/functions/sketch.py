"""Distributions as logarithmic buckets: parallel arrays of keys and counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_GAMMA = math.log1p(2 / 128)
BIAS = 1338
LEAST = 1e-9


def sketch_key(value: Column) -> Column:
    """0 below 1e-9; else the rounded (half to even) logarithm, mirrored for negative values."""
    key = (F.rint(F.log(F.abs(value)) / F.lit(LOG_GAMMA)) + BIAS).cast("int")
    return F.when(F.abs(value) < LEAST, 0).when(value < 0, -key).otherwise(key)


def sketch_value(key: Column) -> Column:
    """The value that a bucket stands for."""
    size = F.exp((F.abs(key) - BIAS) * F.lit(LOG_GAMMA))
    return F.when(key == 0, 0.0).when(key < 0, -size).otherwise(size)


def sketch_build(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys..., bucket_keys, bucket_counts, count, min, max, avg, sum)."""
    cells = rows.groupBy(*keys, sketch_key(F.col(value)).alias("k")).agg(
        F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum(value).alias("s")
    )
    return _gather(cells, keys)


def _gather(cells: DataFrame, keys: list[str]) -> DataFrame:
    out = cells.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("k", "n"))).alias("c"), F.sum("n").alias("count"), F.min("lo").alias("min"), F.max("hi").alias("max"), F.sum("s").alias("sum")
    )
    return out.select(
        *keys, F.col("c.k").alias("bucket_keys"), F.col("c.n").alias("bucket_counts"), "count", "min", "max", (F.col("sum") / F.col("count")).alias("avg"), "sum"
    )


def sketch_merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of the same key put together: counts of equal buckets add up."""
    cells = sketches.select(*keys, "min", "max", F.explode(F.arrays_zip("bucket_keys", "bucket_counts")).alias("c"))
    cells = cells.groupBy(*keys, F.col("c.bucket_keys").alias("k")).agg(F.sum("c.bucket_counts").alias("n"))
    whole = sketches.groupBy(*keys).agg(F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"), F.sum("count").alias("count"))
    arrays = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("c"))
    return whole.join(arrays, keys).select(*keys, F.col("c.k").alias("bucket_keys"), F.col("c.n").alias("bucket_counts"), "count", "min", "max", (F.col("sum") / F.col("count")).alias("avg"), "sum")


def sketch_summary(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., state, count, sum, min, max) from the buckets alone: absent, empty, ok, or undecodable arrays."""
    pairs = F.arrays_zip(F.transform("bucket_keys", sketch_value).alias("v"), F.col("bucket_counts").alias("n"))
    state = (
        F.when(F.col("bucket_keys").isNull() & F.col("bucket_counts").isNull(), "absent")
        .when(F.coalesce(F.size("bucket_keys"), F.lit(-1)) != F.coalesce(F.size("bucket_counts"), F.lit(-1)), "undecodable")
        .when(F.size("bucket_keys") == 0, "empty")
        .otherwise("ok")
    )
    ok = F.col("state") == "ok"
    total = F.aggregate(F.transform(pairs, lambda x: x["v"] * x["n"]), F.lit(0.0), lambda a, x: a + x)
    n = F.aggregate("bucket_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    values = F.transform("bucket_keys", sketch_value)
    return sketches.withColumn("state", state).select(
        *keys, "state", F.when(ok, n).alias("count"), F.when(ok, total).alias("sum"), F.when(ok, F.array_min(values)).alias("min"), F.when(ok, F.array_max(values)).alias("max")
    )


def sketch_quantile(sketches: DataFrame, keys: list[str], q: float) -> DataFrame:
    """An extension: the value of the bucket that holds the q-th part, by a running sum over sorted buckets."""
    cells = sketches.select(*keys, "count", F.posexplode(F.arrays_zip("bucket_keys", "bucket_counts")).alias("i", "c"))
    from pyspark.sql import Window

    run = F.sum("c.bucket_counts").over(Window.partitionBy(*keys).orderBy("i"))
    cells = cells.withColumn("run", run).where(F.col("run") > F.col("count") * q - (1 if q == 1 else 0))
    return cells.groupBy(*keys).agg(sketch_value(F.min("c.bucket_keys")).alias("value"))
