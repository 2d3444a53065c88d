"""Functions along each series' time. LOOKBACK names the buckets to read before the visible window."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import MOST_POINTS, SeriesFrame, same_keys

LOOKBACK = {"diff": 1, "monotonic_diff": 1, "derivative": 1, "per_second": 1, "per_minute": 1, "per_hour": 1, "autosmooth": 40}


def lookback(name: str, n: int = 0) -> int:
    """Buckets before the window: twice the span for ewma, n - 1 for medians and moving averages."""
    return 2 * n if name == "ewma" else n - 1 if name in ("median", "rollingavg") else LOOKBACK.get(name, 0)


def _since(sf: SeriesFrame) -> tuple[Column, Column]:
    w = sf.window()
    return F.col("value") - F.lag("value").over(w), (F.col("bucket_ms") - F.lag("bucket_ms").over(w)) / 1000


def fn_cumsum(sf: SeriesFrame) -> SeriesFrame:
    return sf.values(F.sum("value").over(sf.window().rowsBetween(Window.unboundedPreceding, 0)))


def fn_integral(sf: SeriesFrame) -> SeriesFrame:
    """Running sum of dt times dv, 0 at the first point."""
    dv, dt = _since(sf)
    with_area = sf.df.withColumn("area", F.coalesce(dv * dt, F.lit(0.0)))
    total = F.sum("area").over(sf.window().rowsBetween(Window.unboundedPreceding, 0))
    return sf.with_df(with_area.withColumn("value", total).drop("area"))


def fn_diff(sf: SeriesFrame) -> SeriesFrame:
    return sf.values(_since(sf)[0])


def fn_monotonic_diff(sf: SeriesFrame) -> SeriesFrame:
    """Differences; a fall is a gap, no change is zero."""
    out = fn_diff(sf)
    return out.with_df(out.df.where("value >= 0"))


def fn_derivative(sf: SeriesFrame, seconds: int = 1) -> SeriesFrame:
    dv, dt = _since(sf)
    return sf.values(dv / dt * seconds)


def fn_per_second(sf: SeriesFrame) -> SeriesFrame:
    return fn_derivative(sf)


def fn_per_minute(sf: SeriesFrame) -> SeriesFrame:
    return fn_derivative(sf, 60)


def fn_per_hour(sf: SeriesFrame) -> SeriesFrame:
    return fn_derivative(sf, 3600)


def fn_throughput(sf: SeriesFrame) -> SeriesFrame:
    return sf.values(F.col("value") / (sf.step_ms / 1000))


def fn_ewma(sf: SeriesFrame, span: int = 20) -> SeriesFrame:
    """s0 = v0, then a * v + (1 - a) * s with a = 2 / (span + 1): a fold over each series' sorted points."""
    if span not in (1, 3, 5, 7, 10, 20):
        raise ValueError("span: 1, 3, 5, 7, 10 or 20")
    a = 2 / (span + 1)
    item = F.struct("bucket_ms", "value")
    runs = sf.df.groupBy(*sf.keys, F.lit(1).alias("one")).agg(F.array_sort(F.collect_list(item)).alias("p"))

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)["value"]
        smooth = F.lit(a) * x["value"] + F.lit(1 - a) * last
        return F.array_append(done, F.struct(x["bucket_ms"].alias("bucket_ms"), smooth.alias("value")))

    smooth = F.aggregate(F.slice("p", 2, MOST_POINTS * 2), F.slice("p", 1, 1), step)
    return sf.with_df(runs.select(*sf.keys, F.inline(smooth)))


def fn_median(sf: SeriesFrame, n: int = 3) -> SeriesFrame:
    if n not in (3, 5, 7, 9):
        raise ValueError("n: 3, 5, 7 or 9")
    return sf.values(F.percentile("value", F.lit(0.5)).over(sf.window().rowsBetween(1 - n, 0)))


def fn_rollingavg(sf: SeriesFrame, n: int = 5) -> SeriesFrame:
    return sf.values(F.avg("value").over(sf.window().rowsBetween(1 - n, 0)))


def fn_trend_line(sf: SeriesFrame) -> SeriesFrame:
    """Least squares on the seconds since the first point; a series of one point is its own line."""
    w = Window.partitionBy(*sf.keys)
    rows = sf.df.withColumn("x", (F.col("bucket_ms") - F.min("bucket_ms").over(w)) / 1000)
    lines = rows.groupBy(*sf.keys).agg(
        F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("base"), F.avg("value").alias("mean")
    )
    on = rows.alias("l").join(lines.alias("r"), same_keys(sf.keys))
    line = F.coalesce(F.col("r.base") + F.col("r.slope") * F.col("l.x"), F.col("r.mean"))
    return sf.with_df(on.select(*[F.col(f"l.{k}").alias(k) for k in sf.keys], "l.bucket_ms", line.alias("value")))


def per_group(sf: SeriesFrame, fit: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Apply (times in ms, values) -> values to each series as one bounded group."""
    schema = T.StructType([*[T.StructField(k, T.StringType()) for k in sf.keys], T.StructField("bucket_ms", T.LongType()), T.StructField("value", T.DoubleType())])

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket_ms")
        rows["value"] = fit(rows["bucket_ms"].to_numpy(), rows["value"].to_numpy())
        return rows[[f.name for f in schema.fields]]

    name = F.to_json(F.array(*[F.coalesce(F.col(k), F.lit("\0")) for k in sf.keys])) if sf.keys else F.lit("all")
    rows = sf.df.select(*sf.keys, "bucket_ms", "value", name.alias("group_of_rows"))
    return rows.groupBy("group_of_rows").applyInPandas(lambda _, part: of(part), schema)


def least_squares(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted line (intercept, slope)."""
    total = w.sum()
    mx, my = (w * x).sum() / total, (w * y).sum() / total
    spread = (w * (x - mx) ** 2).sum()
    slope = (w * (x - mx) * (y - my)).sum() / spread if spread > 0 else 0.0
    return my - slope * mx, slope


def huber_line(x: np.ndarray, y: np.ndarray, k: float = 1.345, rounds: int = 50, tol: float = 1e-9) -> tuple[float, float]:
    """Robust line (intercept, slope) under Huber's loss by reweighted least squares; 1.4826 MAD of the residuals is the scale."""
    base, slope = least_squares(x, y, np.ones(len(x)))
    for _ in range(rounds):
        off = y - base - slope * x
        scale = 1.4826 * mad(off)
        if scale == 0:
            break
        new = least_squares(x, y, np.minimum(1.0, k * scale / np.maximum(np.abs(off), 1e-300)))
        settled = max(abs(new[0] - base), abs(new[1] - slope)) < tol
        base, slope = new
        if settled:
            break
    return base, slope


def mad(v: np.ndarray) -> float:
    """Median distance from the median."""
    return float(np.median(np.abs(v - np.median(v))))


def fn_robust_trend(sf: SeriesFrame) -> SeriesFrame:
    def fit(t: np.ndarray, v: np.ndarray) -> np.ndarray:
        x = (t - t[0]) / 1000
        base, slope = huber_line(x, v)
        return base + slope * x

    return sf.with_df(per_group(sf, fit))


def segments(v: np.ndarray, least: int = 2) -> list[tuple[int, int]]:
    """Binary segmentation into constant pieces: a cut must save more than 2 sigma^2 ln n of squared error."""
    n = len(v)
    if n < 4:
        return [(0, n)]
    steps = np.diff(v)
    sigma = (1.4826 * mad(steps) or float(steps.std())) / np.sqrt(2)  # a mostly flat series has no MAD
    penalty = 2 * sigma**2 * np.log(n)
    s1, s2 = np.concatenate([[0], np.cumsum(v)]), np.concatenate([[0], np.cumsum(v * v)])

    def cost(a, b):
        return (s2[b] - s2[a]) - (s1[b] - s1[a]) ** 2 / (b - a)

    todo, done = [(0, n)], []
    while todo:
        a, b = todo.pop()
        if b - a >= 2 * least:
            cuts = np.arange(a + least, b - least + 1)
            gain = cost(a, b) - np.array([cost(a, c) + cost(c, b) for c in cuts])
            at = int(gain.argmax())
            if gain[at] > penalty:
                todo += [(a, int(cuts[at])), (int(cuts[at]), b)]
                continue
        done.append((a, b))
    return sorted(done)


def fn_piecewise_constant(sf: SeriesFrame) -> SeriesFrame:
    def fit(_: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.empty(len(v))
        for a, b in segments(v):
            out[a:b] = v[a:b].mean()
        return out

    return sf.with_df(per_group(sf, fit))


def smoothing_window(v: np.ndarray, most: int = 40) -> int:
    """Of the trailing moving averages that keep at least the series' kurtosis, the width of the smoothest.

    Roughness is the deviation of the differences. Widths go up to a quarter of the points.
    """

    def rough(x: np.ndarray) -> float:
        return float(np.diff(x).std()) if len(x) > 2 else 0.0

    def tails(x: np.ndarray) -> float:
        d = x - x.mean()
        spread = (d * d).mean()
        return float((d**4).mean() / spread**2) if spread > 0 else 0.0

    best, least, kept = 1, rough(v), tails(v)
    sums = np.concatenate([[0.0], np.cumsum(v)])
    ends = np.arange(1, len(v) + 1)
    for n in range(2, max(1, min(most, len(v) // 4)) + 1):
        first = np.maximum(0, ends - n)
        x = (sums[ends] - sums[first]) / (ends - first)
        if tails(x) >= kept and rough(x) < least:
            best, least = n, rough(x)
    return best


def fn_autosmooth(sf: SeriesFrame, most: int = 40) -> SeriesFrame:
    """One moving average for all series: the median of the widths that each would choose."""
    widths = per_group(sf, lambda _, v: np.full(len(v), float(smoothing_window(v, most))))
    one = widths.groupBy(*sf.keys).agg(F.first("value").alias("value")).agg(F.percentile("value", F.lit(0.5))).first()[0]
    n = max(1, min(most, int(one or 1)))
    return sf.values(F.avg("value").over(sf.window().rowsBetween(1 - n, 0)))
