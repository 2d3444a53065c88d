"""Shapes: metric points with multi-valued tags, and aligned series."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAGS = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
POINT = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("t_ms", T.LongType()),
        T.StructField("metric", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("metric_type", T.StringType()),
        T.StructField("interval", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("tags", TAGS),
    ]
)
#: Most buckets of one series; it bounds every group that goes to a pandas function.
MOST_POINTS = 1500


def series_id(*parts: str) -> Column:
    """Identity of a series: a hash of the given columns and of the tags, sorted by key and by value."""
    tags = F.to_json(F.array_sort(F.map_entries(F.transform_values("tags", lambda _, v: F.array_sort(v)))))
    return F.xxhash64(*parts, tags)


def finite(value: Column) -> Column:
    """True for numbers; null, NaN and the infinities are gaps."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


@dataclass(frozen=True)
class SeriesFrame:
    """Long table (keys..., bucket_ms, value): one series per combination of keys, a gap is a missing row.

    ``keys`` are nullable strings; null is the N/A group.
    """

    df: DataFrame
    keys: tuple[str, ...]
    step_ms: int
    from_ms: int
    to_ms: int

    def with_df(self, df: DataFrame) -> SeriesFrame:
        return replace(self, df=df)

    def values(self, value: Column) -> SeriesFrame:
        """The series with each value replaced; results that are not finite become gaps."""
        changed = self.df.withColumn("value", value.cast("double"))
        return self.with_df(changed.where(finite(F.col("value"))))

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy("bucket_ms")

    def trimmed(self) -> SeriesFrame:
        """Without the buckets that were read only for lookback."""
        return self.with_df(self.df.where(F.col("bucket_ms") >= self.from_ms))

    def grid(self) -> list[int]:
        first = -(-self.from_ms // self.step_ms) * self.step_ms
        return [first, self.to_ms - 1]

    def shown(self, digits: int = 6) -> DataFrame:
        """Keys, bucket and value, rounded for comparison between engines."""
        return self.df.select(*self.keys, "bucket_ms", F.round("value", digits).alias("value"))


def same_keys(keys: tuple[str, ...], left: str = "l", right: str = "r") -> Column:
    """Null-safe equality of the key columns of two aliased frames; true without keys."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out
