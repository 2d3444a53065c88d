"""Gap filling between the series of a group, and zeros on the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import SeriesFrame, same_keys
from .aggregate import SPACE


def fill_series(series: DataFrame, keys: tuple[str, ...], how: str = "linear", limit_s: int = 300) -> DataFrame:
    """(series_id, keys..., bucket_ms, value) with gaps filled at times when another series of the group has a point.

    A filled time lies within ``limit_s`` of the series' previous point. ``linear`` also needs a next point;
    ``last`` repeats, ``zero`` puts 0, ``null`` fills nothing. A series alone in its group has no such times, and a
    leading gap stays.
    """
    if how == "null":
        return series
    axis = series.select(*keys, "bucket_ms").distinct()
    members = series.select("series_id", *keys).distinct()
    slots = (
        axis.alias("l")
        .join(members.alias("r"), same_keys(keys))
        .select("r.series_id", *[F.col(f"l.{k}").alias(k) for k in keys], "l.bucket_ms")
    )
    # a series' slots are bounded by its group's time axis
    own = series.select("series_id", *keys, "bucket_ms", "value")
    joined = slots.alias("l").join(own.alias("r"), same_keys((*keys, "series_id", "bucket_ms")), "left")
    rows = joined.select("l.series_id", *[F.col(f"l.{k}").alias(k) for k in keys], "l.bucket_ms", "r.value")
    point = F.when(F.col("value").isNotNull(), F.struct("bucket_ms", "value"))
    w = Window.partitionBy("series_id", *keys).orderBy("bucket_ms")
    rows = rows.withColumn("before", F.last(point, True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    back = Window.partitionBy("series_id", *keys).orderBy(F.col("bucket_ms").desc())  # a frame that grows is kept up, one that shrinks is read anew for each row
    rows = rows.withColumn("after", F.last(point, True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    share = (F.col("bucket_ms") - F.col("before.bucket_ms")) / (F.col("after.bucket_ms") - F.col("before.bucket_ms"))
    made = {
        "linear": F.col("before.value") + (F.col("after.value") - F.col("before.value")) * share,
        "last": F.col("before.value"),
        "zero": F.when(F.col("before").isNotNull(), F.lit(0.0)),
    }[how]
    near = F.col("bucket_ms") - F.col("before.bucket_ms") <= limit_s * 1000
    filled = F.coalesce(F.col("value"), F.when(near, made))
    return rows.select("series_id", *keys, "bucket_ms", filled.alias("value")).where("value is not null")


def combine_filled(series: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    return series.groupBy(*keys, "bucket_ms").agg(SPACE[how]("value").alias("value"))


def grid_rows(sf: SeriesFrame) -> DataFrame:
    """The grid's bucket starts as one column."""
    first, last = sf.grid()
    return sf.df.sparkSession.range(first, last + 1, sf.step_ms).select(F.col("id").alias("bucket_ms"))


def _on_grid(sf: SeriesFrame) -> DataFrame:
    first, last = sf.grid()
    times = F.sequence(F.lit(first), F.lit(last), F.lit(sf.step_ms)) if first <= last else F.array().cast("array<bigint>")
    members = sf.df.select(*sf.keys, F.lit(1).alias("one")).distinct()
    slots = members.select(*sf.keys, F.explode(times).alias("bucket_ms"))
    joined = slots.alias("l").join(sf.df.alias("r"), same_keys((*sf.keys, "bucket_ms")), "left")
    return joined.select(*[F.col(f"l.{k}").alias(k) for k in sf.keys], "l.bucket_ms", F.coalesce("r.value", F.lit(0.0)).alias("value"))


def zero_align(sf: SeriesFrame) -> SeriesFrame:
    """Every grid bucket without a value becomes 0: for counts and rates."""
    return sf.with_df(_on_grid(sf))


def default_zero(sf: SeriesFrame) -> SeriesFrame:
    """Zero in every grid bucket; where there is no series at all, one all-zero series without tags."""
    rows = _on_grid(sf)
    if not sf.df.isEmpty():
        return sf.with_df(rows)
    zeros = grid_rows(sf).select(*[F.lit(None).cast("string").alias(k) for k in sf.keys], "bucket_ms", F.lit(0.0).alias("value"))
    return sf.with_df(zeros)


def wide_response(sf: SeriesFrame) -> DataFrame:
    """One row per series: keys, and values on the sorted union of all times, null where absent."""
    times = sf.df.select("bucket_ms").distinct().agg(F.array_sort(F.collect_list("bucket_ms")).alias("times"))
    rows = sf.df.groupBy(*sf.keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket_ms", "value"))).alias("at"))
    axis = times.first().times  # one number for each bucket of the window
    return rows.select(*sf.keys, F.transform(F.array(*map(F.lit, axis)), lambda t: F.col("at")[t]).alias("pointlist"))
