"""Between series: ranking, counting, shifting and arithmetic."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import SeriesFrame, finite, same_keys
from .aggregate import has_missing_group

RANKS = ("max", "mean", "min", "sum", "last", "l2norm", "area")


def reduction(name: str, step_ms: int) -> Column:
    """One number for a series. ``area`` is the sum times the bucket's seconds; for a single point, its value."""
    v = F.col("value")
    if name == "area":
        return F.when(F.count(v) == 1, F.max(v)).otherwise(F.sum(v) * (step_ms / 1000))
    return {
        "max": F.max(v), "mean": F.avg(v), "avg": F.avg(v), "min": F.min(v), "sum": F.sum(v),
        "last": F.max_by(v, F.col("bucket_ms")), "l2norm": F.sqrt(F.sum(v * v)),
    }[name]


def keep_groups(sf: SeriesFrame, groups: DataFrame) -> DataFrame:
    """Rows of the series whose keys are in ``groups``."""
    return sf.df.alias("l").join(groups.alias("r"), same_keys(sf.keys), "left_semi").select("l.*")


def _ranks(sf: SeriesFrame, by: str, descending: bool) -> tuple[DataFrame, list[Column]]:
    """(keys..., rank) and the order of the groups: ties go by group, N/A last."""
    first = F.col("rank").desc_nulls_last() if descending else F.col("rank").asc_nulls_last()
    return sf.df.groupBy(*sf.keys).agg(reduction(by, sf.step_ms).alias("rank")), [first, *[F.col(k).asc_nulls_last() for k in sf.keys]]


def ranked_groups(sf: SeriesFrame, by: str, descending: bool) -> DataFrame:
    """(keys..., rank value, nth) of every group; one window numbers them all. ``first_groups`` does without it."""
    ranks, order = _ranks(sf, by, descending)
    return ranks.withColumn("nth", F.row_number().over(Window.orderBy(*order)).cast("long"))


def first_groups(sf: SeriesFrame, by: str, descending: bool, n: int) -> DataFrame:
    """(keys..., rank value) of the first ``n`` groups: every task keeps its own first ones, and only those are gathered."""
    ranks, order = _ranks(sf, by, descending)
    return ranks.orderBy(*order).limit(n)


def fn_top(sf: SeriesFrame, n: int, by: str = "mean", order: str = "desc") -> SeriesFrame:
    """The n series that rank first."""
    if n not in (5, 10, 15, 20, 25, 50, 100) or by not in RANKS or order not in ("asc", "desc"):
        raise ValueError("n, by or order is not one of the allowed values")
    return sf.with_df(keep_groups(sf, first_groups(sf, by, order == "desc", n)))


def fn_top_shorthand(sf: SeriesFrame, name: str) -> SeriesFrame:
    """``top5_mean``, ``bottom10_min`` and so on; plain ``top5`` ranks by mean."""
    head, _, by = name.partition("_")
    word = head.rstrip("0123456789")
    if word not in ("top", "bottom") or head[len(word) :] not in ("5", "10", "15", "20"):
        raise ValueError(f"no such function: {name}")
    return fn_top(sf, int(head[len(word) :]), by or "mean", "desc" if word == "top" else "asc")


def series_limit(sf: SeriesFrame, count: int | None, order: str = "desc") -> SeriesFrame:
    """The first ``count`` series by mean; without a count, all."""
    if count is None:
        return sf
    return sf.with_df(keep_groups(sf, first_groups(sf, "mean", order == "desc", count)))


def _count_series(sf: SeriesFrame, of: Column) -> SeriesFrame:
    return SeriesFrame(sf.df.groupBy("bucket_ms").agg(of.alias("value")), (), sf.step_ms, sf.from_ms, sf.to_ms)


def fn_count_nonzero(sf: SeriesFrame) -> SeriesFrame:
    """At each time, how many series are not 0."""
    return _count_series(sf, F.sum((F.col("value") != 0).cast("double")))


def fn_count_not_null(sf: SeriesFrame) -> SeriesFrame:
    return _count_series(sf, F.count("value").cast("double"))


def fn_exclude_null(sf: SeriesFrame) -> SeriesFrame:
    """Without series that have an N/A tag."""
    return sf.with_df(sf.df.where(~has_missing_group(sf.keys)))


def fn_timeshift(source: Callable[[int, int], SeriesFrame], from_ms: int, to_ms: int, seconds: int) -> SeriesFrame:
    """``source`` read ``seconds`` away (negative: earlier) and drawn at the present times."""
    shifted = source(from_ms + seconds * 1000, to_ms + seconds * 1000)
    rows = shifted.df.withColumn("bucket_ms", F.col("bucket_ms") - seconds * 1000)
    return SeriesFrame(rows, shifted.keys, shifted.step_ms, from_ms, to_ms)


SHIFTS = {"hour_before": -3600, "day_before": -86400, "week_before": -604800}


def calendar_shift(from_ms: int, spec: str, zone: str = "UTC") -> int:
    """Seconds of a wall-clock shift (``-1d``, ``-2w``, ``-1mo``) at ``from_ms``, by the zone's clock changes."""
    tz = ZoneInfo(zone)
    digits = spec.lstrip("-").rstrip("dwmo")
    unit = spec.lstrip("-")[len(digits) :]
    n = -int(digits) if spec.startswith("-") else int(digits)
    now = datetime.fromtimestamp(from_ms / 1000, UTC).astimezone(tz).replace(tzinfo=None)
    if unit == "mo":
        month = now.month - 1 + n
        year, month = now.year + month // 12, month % 12 + 1
        last = (datetime(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)).day
        then = now.replace(year=year, month=month, day=min(now.day, last))
    else:
        then = now + timedelta(days=n * {"d": 1, "w": 7}[unit])
    # where the clock shows a time twice, the later, standard one
    moved = max((then.replace(tzinfo=tz, fold=f) for f in (0, 1)), key=lambda t: t.timestamp())
    return round(moved.timestamp() - from_ms / 1000)


TIME = object()  # each point's own time in seconds, as an operand


def _operate(op: str, a: Column, b: Column) -> Column:
    out = {
        "add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b,
        "div": lambda: F.try_divide(a, b), "pow": lambda: F.pow(a, b),
        "min": lambda: F.least(a, b), "max": lambda: F.greatest(a, b),
    }[op]()
    return out.cast("double")


def arith(op: str, left: SeriesFrame | float | object, right: SeriesFrame | float | object) -> SeriesFrame:
    """Point by point. A number goes to every series; so does a single untagged series; else groups pair by tag
    set, whatever the order of their keys, and one-sided ones drop. What is not finite is a gap.
    """
    frames = [x for x in (left, right) if isinstance(x, SeriesFrame)]
    if not frames:
        raise ValueError("one operand must be a series")
    if len(frames) == 1:
        side = lambda x: F.col("value") if isinstance(x, SeriesFrame) else F.col("bucket_ms") / 1000 if x is TIME else F.lit(float(x))
        return frames[0].values(_operate(op, side(left), side(right)))
    if left.keys and right.keys and set(left.keys) != set(right.keys):
        raise ValueError(f"groups differ: {left.keys} and {right.keys}")
    keys = left.keys or right.keys
    shared = keys if left.keys and right.keys else ()
    on = same_keys((*shared, "bucket_ms"))
    rows = left.df.alias("l").join(right.df.alias("r"), on)
    side = "l" if left.keys else "r"
    out = rows.select(*[F.col(f"{side}.{k}").alias(k) for k in keys], "l.bucket_ms", _operate(op, F.col("l.value"), F.col("r.value")).alias("value"))
    return SeriesFrame(out.where(finite(F.col("value"))), keys, left.step_ms, left.from_ms, left.to_ms)


def arith_neg(sf: SeriesFrame) -> SeriesFrame:
    return sf.values(-F.col("value"))


def scalar(sf: SeriesFrame, how: str) -> SeriesFrame:
    """Each series reduced to one point, at the window's start."""
    rows = sf.df.groupBy(*sf.keys, F.lit(sf.from_ms).alias("bucket_ms")).agg(reduction(how, sf.step_ms).alias("value"))
    return sf.with_df(rows.where(finite(F.col("value"))))


def scalar_table(columns: dict[str, SeriesFrame], limits: dict[str, tuple[int, str]] | None = None) -> DataFrame:
    """Group keys and a column for each one-point formula: the union of all groups, cut to those that every limited formula keeps."""
    keys = next(iter(columns.values())).keys
    tall = reduce(DataFrame.unionByName, [sf.df.select(*keys, F.lit(name).alias("name"), "value") for name, sf in columns.items()])
    wide = tall.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in columns])
    for name, (count, order) in (limits or {}).items():
        kept = first_groups(columns[name], "mean", order == "desc", count)
        wide = wide.alias("l").join(kept.alias("r"), same_keys(keys), "left_semi").select("l.*")
    return wide
