"""Sliding windows over series without meeting every tick with every bucket.

Time is cut in blocks as long as the window, so a window is the end of one block and the beginning of the next (or one whole
block). Within a block of a group, running aggregates from the left and from the right are read off where windows end and
begin; two such readings make a window's aggregate. A point is read twice and a window makes two rows for each group,
however many buckets it spans; no sum is a difference of two others, so none loses digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import same_keys

END, POINT, START = 0, 1, 2


def window_reach(periods: DataFrame) -> int | None:
    """The length that all windows (from_ms, to_ms) have; None without any."""
    least, most = periods.agg(F.min(F.col("to_ms") - F.col("from_ms")), F.max(F.col("to_ms") - F.col("from_ms"))).first()
    if least != most or (least is not None and least <= 0):
        raise ValueError("the windows of one evaluation have one length, above zero")
    return least


def sliding(rows: DataFrame, keys: tuple[str, ...], ends: DataFrame, reach_ms: int) -> DataFrame:
    """(keys..., to_ms, n, total, squares, low, high, last, first_ms) of the points in [to_ms - reach_ms, to_ms) of each group.

    rows: (keys..., bucket_ms, value). ends: (to_ms) and, if a window is for some groups only, the keys that say which.
    Windows without a point of a group give no row for it; null values are no points.
    """
    block = lambda t: F.floor(t / reach_ms).cast("long")
    by = [c for c in ends.columns if c in keys]
    points = rows.where("value is not null").select(*keys, block(F.col("bucket_ms")).alias("block"), F.col("bucket_ms").alias("t"), F.col("value").cast("double").alias("v"), F.lit(POINT).alias("side"), F.lit(None).cast("long").alias("to_ms"))
    stops = ends.distinct().select(*by, "to_ms", block(F.col("to_ms") - 1).alias("block"), F.col("to_ms").alias("t"), F.lit(END).alias("side"))
    begins = ends.distinct().select(*by, "to_ms", block(F.col("to_ms") - reach_ms).alias("block"), (F.col("to_ms") - reach_ms).alias("t"), F.lit(START).alias("side"))
    begins = begins.where(F.col("block") < block(F.col("to_ms") - 1))  # else the window is the block, and its end says all
    marks = stops.unionByName(begins)
    groups = points.select(*keys, "block").distinct()
    met = groups.alias("l").join(marks.alias("r"), same_keys(("block", *by))).select(*[F.col(f"l.{c}") for c in (*keys, "block")], "r.t", F.lit(None).cast("double").alias("v"), "r.side", "r.to_ms")
    everything = points.unionByName(met)
    within = Window.partitionBy(*keys, "block")
    left = within.orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    right = within.orderBy(F.col("t").desc(), "side").rowsBetween(Window.unboundedPreceding, 0)
    v, at = F.col("v"), F.when(F.col("v").isNotNull(), F.col("t"))
    parts = {"n": F.count(v), "total": F.sum(v), "squares": F.sum(v * v), "low": F.min(v), "high": F.max(v), "newest": F.max(F.when(v.isNotNull(), F.struct("t", "v"))), "first_ms": F.min(at)}
    read = everything.select(*keys, "to_ms", "side", *[F.when(F.col("side") == END, c.over(left)).when(F.col("side") == START, c.over(right)).alias(n) for n, c in parts.items()])
    both = read.where((F.col("side") != POINT) & (F.col("n") > 0)).groupBy(*keys, "to_ms")
    return both.agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("newest").alias("newest"), F.min("first_ms").alias("first_ms")
    ).withColumn("last", F.col("newest.v")).drop("newest")


def reduced(how: str, step_ms: int) -> Column:
    """One number of a window's row, as ``across.reduction`` has it of the window's points."""
    mean = F.col("total") / F.col("n")
    return {
        "avg": mean, "mean": mean, "sum": F.col("total"), "min": F.col("low"), "max": F.col("high"), "last": F.col("last"), "l2norm": F.sqrt("squares"),
        "area": F.when(F.col("n") == 1, F.col("high")).otherwise(F.col("total") * (step_ms / 1000)),
    }[how]


def on_windows(rows: DataFrame, keys: tuple[str, ...], periods: DataFrame, reach_ms: int | None = None) -> DataFrame:
    """(tick, keys..., n, ..., from_ms, to_ms): each tick with what ``sliding`` says of its window, or of the last ``reach_ms`` of it.

    Ticks that read the same window share its rows.
    """
    whole = window_reach(periods) or 1  # without ticks there are no rows, whatever the reach
    found = sliding(rows, keys, periods.select("to_ms"), min(whole, reach_ms or whole))
    return periods.select("tick", "from_ms", "to_ms").join(found, "to_ms")
