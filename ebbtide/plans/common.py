"""What the registered series queries share: their window, their base series, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SeriesFrame
from ..operators.aggregate import aggregate, per_series
from ..sources import telemetry
from ..sources.telemetry import POINTS_SQL, table

FROM, TO = 1704067200000, 1706659200000  # 2024-01-01 to 2024-01-31
HOUR, DAY = 3600, 86400
STEP = 6 * HOUR


def points(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.points(table(spark, d, "events"))


def base(spark: SparkSession, d: str, **how) -> SeriesFrame:
    args = {"metric": "events.purchase", "by": ("env",), "step_s": STEP, "from_ms": FROM, "to_ms": TO} | how
    return aggregate(points(spark, d), **args)


def series(spark: SparkSession, d: str, **how) -> DataFrame:
    args = {"metric": "events.purchase", "by": ("env",), "step_s": STEP, "from_ms": FROM, "to_ms": TO} | how
    return per_series(points(spark, d), **args)


LISTS = {"env": "se", "role": "sr", "canary": "sc"}


def series_ctes(
    metric: str = "events.purchase", by: tuple[str, ...] = ("env",), agg: str = "avg(value)", space: str = "avg", step: int = STEP, where: str = "TRUE", frm: int = FROM, to: int = TO, ser: str = "ser", out: str = "base"
) -> str:
    """Common table expressions: one row per series and bucket, then one per group and bucket."""
    rows = f"SELECT host AS sh, env AS se, role AS sr, canary AS sc, metric_type, ival, value, t_ms FROM pts WHERE metric = '{metric}' AND t_ms >= {frm} AND t_ms < {to} AND ({where})"
    for key in by:
        if key == "host":
            rows = f"SELECT *, nullif(sh, '') AS host FROM ({rows})"
        else:
            one = LISTS[key]
            rows = f"SELECT *, nullif(g_{key}, '') AS {key} FROM (SELECT *, unnest(CASE WHEN len({one}) = 0 THEN CAST([NULL] AS VARCHAR[]) ELSE {one} END) AS g_{key} FROM ({rows}))"
    keys = "".join(f"{k}, " for k in by)
    return f"""{ser} AS (SELECT sh, se, sr, sc, {keys}t_ms // {step * 1000} * {step * 1000} AS bucket_ms, {agg} AS value FROM ({rows})
      GROUP BY sh, se, sr, sc, {keys}t_ms // {step * 1000} * {step * 1000} HAVING t_ms // {step * 1000} * {step * 1000} >= {frm}),
    {out} AS (SELECT {keys}bucket_ms, {space}(value) AS value FROM {ser} GROUP BY {keys}bucket_ms)"""


def sql(body: str, **how) -> str:
    return f"WITH {POINTS_SQL},\n{series_ctes(**how)}\n{body}"


def over(value: str, rest: str = "", cond: str = "value IS NOT NULL AND isfinite(value)", **how) -> str:
    """A function of the base series, per env."""
    return sql(f"SELECT env, bucket_ms, round(value, 6) AS value FROM (SELECT env, bucket_ms, {value} AS value FROM base {rest}) WHERE {cond}", **how)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})
