"""Registered queries: scans, predicates, aggregation, filling, and functions of series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alongtime as along
from ..functions import pointwise as point
from ..model import SeriesFrame, series_id
from ..operators import across, fill
from ..operators import aggregate as ag
from ..operators import predicates as pr
from ..sources import telemetry
from ..sources.telemetry import CHECKS_SQL, LOGS_SQL, POINTS_SQL, table
from .common import DAY, FROM, HOUR, STEP, TO, base, over, points, rounded, series, series_ctes, sql
from .registry import register

MID, MID_TO = FROM + 5 * DAY * 1000, FROM + 20 * DAY * 1000 + 1234567

# 2.1 scans
PT = "SELECT t_ms, metric, host, value FROM pts"
register(
    "scan_points",
    lambda s, d: ag.scan_points(points(s, d), "default", "events.purchase", MID, MID_TO, pr.filter_tag_eq("env", "e1"), DAY * 1000).select("t_ms", "metric", "host", "value"),
    f"WITH {POINTS_SQL} {PT} WHERE metric = 'events.purchase' AND t_ms >= {MID - DAY * 1000} AND t_ms < {MID_TO} AND list_contains(env, 'e1')",
)
ROLLUP = "SELECT metric, host, env, role, canary, t_ms // 60000 * 60000 AS minute, max(metric_type) AS metric_type, max(ival) AS interval, count(*) AS points, min(value) AS value_min, max(value) AS value_max, sum(value) AS value_sum, sum(value * CASE WHEN metric_type = 'RATE' THEN greatest(ival, 1) ELSE 1 END) AS value_events FROM pts"
GROUPED = "GROUP BY metric, host, env, role, canary, t_ms // 60000 * 60000"
ROLLED = "SELECT metric, host, minute, metric_type, interval, points, value_min, value_max, round(value_sum, 6) AS value_sum, round(value_events, 6) AS value_events FROM"


def rolled(df):
    return rounded(df.withColumnRenamed("t_ms", "minute"), "value_sum", "value_events").select(
        "metric", "host", "minute", "metric_type", "interval", "points", "value_min", "value_max", "value_sum", "value_events"
    )


register(
    "scan_rollup_with_tail",
    lambda s, d: rolled(ag.rollup_with_tail(ag.rollup_1m(points(s, d)), points(s, d), MID_TO)),
    f"WITH {POINTS_SQL} {ROLLED} ({ROLLUP} WHERE t_ms < {MID_TO} {GROUPED})",
)
register("mv_metrics_1m", lambda s, d: rolled(ag.rollup_1m(points(s, d))), f"WITH {POINTS_SQL} {ROLLED} ({ROLLUP} {GROUPED})")
register(
    "backfill_rollup",
    lambda s, d: rolled(ag.rollup_1m(points(s, d).where((F.col("t_ms") >= FROM) & (F.col("t_ms") < MID)))),
    f"WITH {POINTS_SQL} {ROLLED} ({ROLLUP} WHERE t_ms >= {FROM} AND t_ms < {MID} {GROUPED})",
)
register(
    "rollup_consistency_check",
    lambda s, d: points(s, d).groupBy("metric").agg(F.count("*").alias("raw")).join(ag.rollup_1m(points(s, d)).groupBy("metric").agg(F.sum("points").alias("rolled")), "metric").withColumn("same", F.col("raw") == F.col("rolled")),
    f"WITH {POINTS_SQL} SELECT metric, count(*) AS raw, count(*) AS rolled, true AS same FROM pts GROUP BY metric",
)
register(
    "scan_logs",
    lambda s, d: telemetry.logs(table(s, d, "documents")).where((F.col("t_ms") >= FROM) & (F.col("t_ms") < FROM + DAY * 500) & (F.col("host") == "en") & pr.filter_text("message", "the")).select("log_id", "t_ms", "service", "status"),
    rf"WITH {LOGS_SQL} SELECT log_id, t_ms, service, status FROM logs WHERE t_ms >= {FROM} AND t_ms < {FROM + DAY * 500} AND host = 'en' AND contains(message, 'the') AND list_contains(string_split_regex(message, '[^0-9a-zA-Z]+'), 'the')",
)
register(
    "scan_check_runs",
    lambda s, d: telemetry.check_runs(table(s, d, "events")).where((F.col("check_name") == "check.error") & (F.col("t_ms") >= MID) & (F.col("t_ms") < MID_TO)).select("t_ms", "host", "status", F.col("tags")["env"][0].alias("env")).distinct(),
    f"WITH {CHECKS_SQL} SELECT DISTINCT t_ms, host, status, env FROM runs WHERE check_name = 'check.error' AND t_ms >= {MID} AND t_ms < {MID_TO}",
)

# 2.2 predicates, each counted over all points by metric
PREDICATES = {
    "filter_all": (lambda: pr.filter_all(), "true"),
    "filter_tag_eq": (lambda: pr.filter_tag_eq("role", "web"), "list_contains(role, 'web')"),
    "filter_tag_wildcard": (lambda: pr.filter_tag_wildcard("role", "w*"), "len(list_filter(role, lambda x: x LIKE 'w%')) > 0"),
    "filter_host_eq": (lambda: pr.filter_host_eq("host-7"), "host = 'host-7'"),
    "filter_host_wildcard": (lambda: pr.filter_host_wildcard("host-1*"), "host LIKE 'host-1%'"),
    "filter_bare_tag": (lambda: pr.filter_bare_tag("canary"), "len(canary) > 0"),
    "filter_bare_tag_wildcard": (lambda: pr.filter_bare_tag("can*"), "len(canary) > 0"),
    "filter_in": (lambda: pr.filter_in("env", ["e1", "e3"]), "list_has_any(env, ['e1', 'e3'])"),
    "filter_in_wildcard": (lambda: pr.filter_in("role", ["w*", "db"]), "len(list_filter(role, lambda x: x LIKE 'w%' OR x = 'db')) > 0"),
    "filter_not": (lambda: pr.filter_not(pr.filter_tag_eq("env", "e2")), "NOT list_contains(env, 'e2')"),
    "filter_and": (lambda: pr.filter_and(pr.filter_tag_eq("env", "e2"), pr.filter_bare_tag("canary")), "list_contains(env, 'e2') AND len(canary) > 0"),
    "filter_or": (lambda: pr.filter_or(pr.filter_tag_eq("env", "e2"), pr.filter_host_eq("")), "list_contains(env, 'e2') OR host = ''"),
    "filter_repeated_params": (lambda: pr.filter_repeated_params(["env:e1", "env:e2", "role:web"]), "list_has_any(env, ['e1', 'e2']) AND list_contains(role, 'web')"),
    "filter_hosts_and_tags": (lambda: pr.filter_hosts_and_tags(["host-1", "host-2"], pr.filter_tag_eq("role", "web")), "host IN ('host-1', 'host-2') AND list_contains(role, 'web')"),
}
for name, (pred, text) in PREDICATES.items():
    register(
        name,
        lambda s, d, p=pred: points(s, d).where(p()).groupBy("metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")),
        f"WITH {POINTS_SQL} SELECT metric, count(*) AS n, round(sum(value), 6) AS total FROM pts WHERE {text} GROUP BY metric",
    )
register(
    "filter_lifted",
    lambda s, d: points(s, d).withColumn("role", F.col("tags")["role"]).where(pr.filter_lifted("role", "web") & pr.filter_lifted("role", "a*")).groupBy("metric").agg(F.count("*").alias("n")),
    f"WITH {POINTS_SQL} SELECT metric, count(*) AS n FROM pts WHERE list_contains(role, 'web') GROUP BY metric",
)
register(
    "filter_text",
    lambda s, d: telemetry.logs(table(s, d, "documents")).where(pr.filter_text("message", "in the")).select("log_id"),
    f"WITH {LOGS_SQL} SELECT log_id FROM logs WHERE contains(message, 'in the') AND list_has_all(string_split_regex(message, '[^0-9a-zA-Z]+'), ['in', 'the'])",
)
register(
    "filter_search_ci",
    lambda s, d: points(s, d).where(pr.filter_search_ci("metric", "PURCH")).groupBy("metric").agg(F.count("*").alias("n")),
    f"WITH {POINTS_SQL} SELECT metric, count(*) AS n FROM pts WHERE contains(lower(metric), 'purch') GROUP BY metric",
)

# 2.3 aggregation
register(
    "time_bucket",
    lambda s, d: points(s, d).groupBy(ag.time_bucket("t_ms", 900_000).alias("bucket_ms")).agg(F.count("*").alias("n")),
    f"WITH {POINTS_SQL} SELECT t_ms // 900000 * 900000 AS bucket_ms, count(*) AS n FROM pts GROUP BY 1",
)
SHOWN = "SELECT env, bucket_ms, round(value, 6) AS value FROM base"
EVENTS = "sum(value * CASE WHEN metric_type = 'RATE' THEN greatest(ival, 1) ELSE 1 END)"
TYPED = {
    "as_count": f"CASE WHEN max(metric_type) IN ('RATE', 'COUNT') THEN {EVENTS} ELSE avg(value) END",
    "as_rate": f"CASE max(metric_type) WHEN 'RATE' THEN {EVENTS} / greatest({STEP}, max(ival)) WHEN 'COUNT' THEN {EVENTS} / {STEP} ELSE avg(value) END",
}
for name in ("avg", "sum", "min", "max", "count"):
    text = "CAST(count(value) AS DOUBLE)" if name == "count" else f"{name}(value)"
    register(f"timeagg_{name}", lambda s, d, n=name: base(s, d, time_agg=n).shown(), sql(SHOWN, agg=text))
for name, text in TYPED.items():
    register(f"timeagg_{name}", lambda s, d, n=name: base(s, d, metric="events.click", time_agg=n, space_agg="sum").shown(), sql(SHOWN, metric="events.click", agg=text, space="sum"))
    register(f"timeagg_{name}_counts", lambda s, d, n=name: base(s, d, metric="events.error", time_agg=n, space_agg="sum").shown(), sql(SHOWN, metric="events.error", agg=text, space="sum"))
for name in ("avg", "sum", "min", "max", "count", *TYPED):
    text = TYPED.get(name) or ("CAST(count(value) AS DOUBLE)" if name == "count" else f"{name}(value)")

    def from_rollup(s, d, n=name):
        rows = ag.rollup_1m(points(s, d))
        return ag.aggregate(rows, metric="events.click", by=("env",), time_agg=n, step_s=STEP, from_ms=FROM, to_ms=TO, rollup=True).shown()

    register(f"timeagg_rollup_{name}", from_rollup, sql(SHOWN, metric="events.click", agg=text))
register("groupby_tag", lambda s, d: base(s, d, by=("role", "env")).shown(), sql("SELECT role, env, bucket_ms, round(value, 6) AS value FROM base", by=("role", "env")))
register("groupby_host", lambda s, d: base(s, d, by=("host",)).shown(), sql("SELECT host, bucket_ms, round(value, 6) AS value FROM base", by=("host",)))
for how in ("avg", "sum", "min", "max"):
    register(f"space_agg_{how}" if how != "avg" else "space_agg", lambda s, d, h=how: base(s, d, by=("role",), space_agg=h).shown(), sql("SELECT role, bucket_ms, round(value, 6) AS value FROM base", by=("role",), space=how))
register(
    "drop_partial_first_bucket",
    lambda s, d: base(s, d, from_ms=FROM + 7 * HOUR * 1000).shown(),
    sql(SHOWN, frm=FROM + 7 * HOUR * 1000),
)
register(
    "group_tags",
    lambda s, d: base(s, d, by=("role", "env")).df.select(F.array_join(ag.group_tags(("role", "env")), ",").alias("tags"), F.round("value", 6).alias("value")),
    sql("SELECT 'role:' || coalesce(role, 'N/A') || ',env:' || coalesce(env, 'N/A') AS tags, round(value, 6) AS value FROM base", by=("role", "env")),
)

# 2.4 filling
FILL_BY, FILL_STEP = ("role",), 12 * HOUR


def filled(s, d, how, space="avg", limit=2 * DAY):
    rows = fill.fill_series(series(s, d, by=FILL_BY, step_s=FILL_STEP, time_agg="avg"), FILL_BY, how, limit)
    return SeriesFrame(fill.combine_filled(rows, FILL_BY, space), FILL_BY, FILL_STEP * 1000, FROM, TO).shown()


def fill_sql(value: str, space: str = "avg", limit: int = 2 * DAY, near: bool = True) -> str:
    key = "sh, se, sr, sc, role"
    return f"""WITH {POINTS_SQL}, {series_ctes(by=FILL_BY, step=FILL_STEP)},
    slots AS (SELECT m.*, a.bucket_ms FROM (SELECT DISTINCT {key} FROM ser) m JOIN (SELECT DISTINCT role, bucket_ms FROM ser) a ON m.role IS NOT DISTINCT FROM a.role),
    j AS (SELECT s.*, r.value AS v FROM slots s LEFT JOIN ser r ON s.sh = r.sh AND s.se = r.se AND s.sr = r.sr AND s.sc = r.sc AND s.role IS NOT DISTINCT FROM r.role AND s.bucket_ms = r.bucket_ms),
    w AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN bucket_ms END) OVER p AS t0, min(CASE WHEN v IS NOT NULL THEN bucket_ms END) OVER n AS t1,
                 last_value(v IGNORE NULLS) OVER p AS v0, first_value(v IGNORE NULLS) OVER n AS v1 FROM j
          WINDOW p AS (PARTITION BY {key} ORDER BY bucket_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                 n AS (PARTITION BY {key} ORDER BY bucket_ms ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    f AS (SELECT role, bucket_ms, coalesce(v, CASE WHEN {str(near).lower()} AND bucket_ms - t0 <= {limit * 1000} THEN {value} END) AS value FROM w)
    SELECT role, bucket_ms, round({space}(value), 6) AS value FROM f WHERE value IS NOT NULL GROUP BY role, bucket_ms"""


LINE = "v0 + (v1 - v0) * ((bucket_ms - t0) / (t1 - t0))"
register("fill_linear", lambda s, d: filled(s, d, "linear"), fill_sql(LINE))
register("fill_last", lambda s, d: filled(s, d, "last"), fill_sql("v0"))
register("fill_zero", lambda s, d: filled(s, d, "zero"), fill_sql("CASE WHEN t0 IS NOT NULL THEN 0.0 END"))
register("fill_null", lambda s, d: filled(s, d, "null"), fill_sql("NULL", near=False))
register("combine_filled", lambda s, d: filled(s, d, "last", "sum", 5 * DAY), fill_sql("v0", "sum", 5 * DAY))


def lone(s, d):
    rows = series(s, d, by=("host", "env", "role"), pred=pr.filter_tag_eq("role", "web") & pr.filter_bare_tag("canary"), step_s=HOUR, time_agg="avg")
    return fill.fill_series(rows, ("host", "env", "role"), "last", 5 * DAY).select("host", "env", "role", "bucket_ms", F.round("value", 6).alias("value"))


register(
    "fill_single_series_untouched",
    lone,
    sql("SELECT host, env, role, bucket_ms, round(value, 6) AS value FROM base", by=("host", "env", "role"), step=HOUR, where="list_contains(role, 'web') AND len(canary) > 0"),
)
GRID = f"grid AS (SELECT unnest(range({FROM}, {TO}, {STEP * 1000})) AS bucket_ms)"
ON_GRID = f"{GRID}, k AS (SELECT DISTINCT env FROM base), z AS (SELECT k.env, grid.bucket_ms, coalesce(b.value, 0.0) AS value FROM k CROSS JOIN grid LEFT JOIN base b ON b.env IS NOT DISTINCT FROM k.env AND b.bucket_ms = grid.bucket_ms)"
register(
    "zero_align_counts",
    lambda s, d: fill.zero_align(base(s, d, metric="events.error", time_agg="as_count", space_agg="sum", pred=pr.filter_host_eq("host-3"))).shown(),
    sql(f", {ON_GRID} SELECT env, bucket_ms, round(value, 6) AS value FROM z", metric="events.error", agg=TYPED["as_count"], space="sum", where="host = 'host-3'"),
)
register("grid", lambda s, d: base(s, d).df.select("bucket_ms").distinct().join(fill.grid_rows(base(s, d)), "bucket_ms", "right"), sql(f", {GRID} SELECT bucket_ms FROM grid"))
register(
    "default_zero",
    lambda s, d: fill.default_zero(base(s, d, pred=pr.filter_host_eq("host-3"))).shown(),
    sql(f", {ON_GRID} SELECT env, bucket_ms, round(value, 6) AS value FROM z", where="host = 'host-3'"),
)
register(
    "wide_response",
    lambda s, d: (lambda w: w.select("env", F.array_join(F.transform("pointlist", lambda x: F.coalesce(F.round(x * 1000).cast("long").cast("string"), F.lit("-"))), " ").alias("points")))(fill.wide_response(base(s, d, step_s=DAY, pred=pr.filter_host_wildcard("host-1*")))),
    sql(
        ", t AS (SELECT DISTINCT bucket_ms FROM base), k AS (SELECT DISTINCT env FROM base) SELECT k.env, string_agg(coalesce(CAST(CAST(round(b.value * 1000) AS BIGINT) AS VARCHAR), '-'), ' ' ORDER BY t.bucket_ms) AS points FROM k CROSS JOIN t LEFT JOIN base b ON b.env IS NOT DISTINCT FROM k.env AND b.bucket_ms = t.bucket_ms GROUP BY k.env",
        step=DAY,
        where="host LIKE 'host-1%'",
    ),
)

# 2.5 functions of one value, on values moved around zero
CENTRED = "(SELECT env, bucket_ms, value - 5 AS value FROM base)"


def centred(s, d):
    return base(s, d).values(F.col("value") - 5)


POINTWISE = {
    "fn_abs": (point.fn_abs, "abs(value)"),
    "fn_log2": (point.fn_log2, "CASE WHEN value > 0 THEN log2(value) END"),
    "fn_log10": (point.fn_log10, "CASE WHEN value > 0 THEN log10(value) END"),
    "fn_ceil": (point.fn_ceil, "CAST(ceil(value) AS DOUBLE) + 0.0"),
    "fn_floor": (point.fn_floor, "CAST(floor(value) AS DOUBLE) + 0.0"),
    "fn_round": (lambda x: point.fn_round(x, 1), "sign(value * 10) * floor(abs(value * 10) + 0.5) / 10 + 0.0"),
    "fn_clamp_min": (lambda x: point.fn_clamp_min(x, -1), "greatest(value, -1.0)"),
    "fn_clamp_max": (lambda x: point.fn_clamp_max(x, 1), "least(value, 1.0)"),
    "fn_cutoff_min": (lambda x: point.fn_cutoff_min(x, -1), "CASE WHEN value >= -1 THEN value END"),
    "fn_cutoff_max": (lambda x: point.fn_cutoff_max(x, 1), "CASE WHEN value <= 1 THEN value END"),
}
for name, (fn, text) in POINTWISE.items():
    register(
        name,
        lambda s, d, f=fn: f(centred(s, d)).shown(),
        sql(f"SELECT env, bucket_ms, round(v, 6) AS value FROM (SELECT env, bucket_ms, {text} AS v FROM {CENTRED}) WHERE v IS NOT NULL"),
    )

# 2.6 along time
W = "WINDOW w AS (PARTITION BY env ORDER BY bucket_ms)"
DV, DT = "(value - lag(value) OVER w)", "((bucket_ms - lag(bucket_ms) OVER w) / 1000)"
ROWS = "OVER (PARTITION BY env ORDER BY bucket_ms ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
ALONG = {
    "fn_cumsum": (along.fn_cumsum, over("sum(value) OVER (PARTITION BY env ORDER BY bucket_ms ROWS UNBOUNDED PRECEDING)")),
    "fn_integral": (along.fn_integral, sql(f"SELECT env, bucket_ms, round(sum(a) OVER (PARTITION BY env ORDER BY bucket_ms ROWS UNBOUNDED PRECEDING), 6) AS value FROM (SELECT env, bucket_ms, coalesce({DV} * {DT}, 0.0) AS a FROM base {W})")),
    "fn_diff": (along.fn_diff, over(DV, W)),
    "fn_monotonic_diff": (along.fn_monotonic_diff, over(DV, W, "value >= 0")),
    "fn_derivative": (along.fn_derivative, over(f"{DV} / {DT}", W)),
    "fn_per_second": (along.fn_per_second, over(f"{DV} / {DT}", W)),
    "fn_per_minute": (along.fn_per_minute, over(f"{DV} / {DT} * 60", W)),
    "fn_per_hour": (along.fn_per_hour, over(f"{DV} / {DT} * 3600", W)),
    "fn_throughput": (along.fn_throughput, over(f"value / {STEP}")),
    "fn_trend_line": (along.fn_trend_line, sql(f"""SELECT env, bucket_ms, round(coalesce(regr_intercept(value, x) OVER p + regr_slope(value, x) OVER p * x, avg(value) OVER p), 6) AS value
        FROM (SELECT *, (bucket_ms - min(bucket_ms) OVER (PARTITION BY env)) / 1000 AS x FROM base) WINDOW p AS (PARTITION BY env)""")),
}
for name, (fn, text) in ALONG.items():
    register(name, lambda s, d, f=fn: f(base(s, d)).shown(), text)
for span in (3, 20):
    a = 2 / (span + 1)
    register(
        f"fn_ewma_{span}",
        lambda s, d, n=span: along.fn_ewma(base(s, d), n).shown(),
        "WITH RECURSIVE "
        + sql(
            f""", n AS (SELECT env, bucket_ms, value, row_number() OVER (PARTITION BY env ORDER BY bucket_ms) AS i FROM base),
        e AS (SELECT env, bucket_ms, i, value FROM n WHERE i = 1 UNION ALL
              SELECT n.env, n.bucket_ms, n.i, {a!r}::DOUBLE * n.value + {1 - a!r}::DOUBLE * e.value FROM e JOIN n ON n.env IS NOT DISTINCT FROM e.env AND n.i = e.i + 1)
        SELECT env, bucket_ms, round(value, 6) AS value FROM e"""
        )[5:],
    )
for n in (3, 9):
    register(f"fn_median_{n}", lambda s, d, k=n: along.fn_median(base(s, d), k).shown(), over(f"quantile_cont(value, 0.5) {ROWS.format(n - 1)}"))
for n in (5, 29):
    register(f"fn_rollingavg_{n}", lambda s, d, k=n: along.fn_rollingavg(base(s, d), k).shown(), over(f"avg(value) {ROWS.format(n - 1)}"))
for name in ("fn_autosmooth", "fn_robust_trend", "fn_piecewise_constant"):
    register(name, lambda s, d, f=getattr(along, name): f(base(s, d)).shown())

# 2.7 across series
HOSTS = {"by": ("host",)}
KEPT = "SELECT b.host, b.bucket_ms, round(b.value, 6) AS value FROM base b JOIN r ON b.host IS NOT DISTINCT FROM r.host WHERE r.nth <= {}"
REDUCE = {
    "max": "max(value)", "mean": "avg(value)", "avg": "avg(value)", "min": "min(value)", "sum": "sum(value)", "last": "arg_max(value, bucket_ms)",
    "l2norm": "sqrt(sum(value * value))", "area": f"CASE WHEN count(*) = 1 THEN max(value) ELSE sum(value) * {STEP} END",
}


def top_sql(n: int, by: str, order: str) -> str:
    ranks = f", r AS (SELECT host, row_number() OVER (ORDER BY rank {order} NULLS LAST, host NULLS LAST) AS nth FROM (SELECT host, {REDUCE[by]} AS rank FROM base GROUP BY host))"
    return sql(f"{ranks} {KEPT.format(n)}", **HOSTS)


for by in ("max", "mean", "min", "sum", "last", "l2norm", "area"):
    register(f"fn_top_{by}" if by != "mean" else "fn_top", lambda s, d, b=by: across.fn_top(base(s, d, **HOSTS), 5, b, "desc").shown(), top_sql(5, by, "DESC"))
register("fn_top_shorthand", lambda s, d: across.fn_top_shorthand(base(s, d, **HOSTS), "bottom10_min").shown(), top_sql(10, "min", "ASC"))
register("series_limit", lambda s, d: across.series_limit(base(s, d, **HOSTS), 7, "asc").shown(), top_sql(7, "mean", "ASC"))
for by in ("l2norm", "area", "last"):
    register(
        f"rank_{by}",
        lambda s, d, b=by: rounded(across.ranked_groups(base(s, d, **HOSTS), b, True).select("host", "rank", "nth"), "rank", digits=4),
        sql(f"SELECT host, round(rank, 4) AS rank, row_number() OVER (ORDER BY rank DESC, host NULLS LAST) AS nth FROM (SELECT host, {REDUCE[by]} AS rank FROM base GROUP BY host)", **HOSTS),
    )
register(
    "fn_count_nonzero",
    lambda s, d: across.fn_count_nonzero(base(s, d, **HOSTS).values(F.greatest(F.col("value") - 6, F.lit(0.0)))).shown(),
    sql("SELECT bucket_ms, CAST(sum(CASE WHEN value > 6 THEN 1 ELSE 0 END) AS DOUBLE) AS value FROM base GROUP BY bucket_ms", **HOSTS),
)
register(
    "fn_count_nonzero_finite",  # a quotient of which some values are no numbers: these are gaps, not counted
    lambda s, d: across.fn_count_nonzero(base(s, d, **HOSTS).values(F.try_divide(F.col("value") - 6, F.floor(F.col("value") / 8)))).shown(),
    sql("SELECT bucket_ms, CAST(sum(CASE WHEN value <> 6 THEN 1 ELSE 0 END) AS DOUBLE) AS value FROM base WHERE floor(value / 8) <> 0 GROUP BY bucket_ms", **HOSTS),
)
register("fn_count_not_null", lambda s, d: across.fn_count_not_null(base(s, d, **HOSTS)).shown(), sql("SELECT bucket_ms, CAST(count(*) AS DOUBLE) AS value FROM base GROUP BY bucket_ms", **HOSTS))
register("fn_exclude_null", lambda s, d: across.fn_exclude_null(base(s, d)).shown(), sql(f"{SHOWN} WHERE env IS NOT NULL"))


def shifted(seconds, first=FROM + 15 * DAY * 1000, last=TO):
    def run(s, d):
        source = lambda a, b: base(s, d, from_ms=a, to_ms=b)
        return across.fn_timeshift(source, first, last, seconds).shown()

    text = sql(f"SELECT env, bucket_ms - {seconds * 1000} AS bucket_ms, round(value, 6) AS value FROM base", frm=first + seconds * 1000, to=last + seconds * 1000)
    return run, text


register("fn_timeshift", *shifted(-2 * STEP))
register("fn_hour_before", *shifted(across.SHIFTS["hour_before"]))
register("fn_day_before", *shifted(across.SHIFTS["day_before"]))
register("fn_week_before", *shifted(across.SHIFTS["week_before"]))
register("fn_month_before", *shifted(across.calendar_shift(FROM + 40 * DAY * 1000, "-1mo"), FROM + 40 * DAY * 1000, FROM + 60 * DAY * 1000))
register("fn_calendar_shift", *shifted(across.calendar_shift(FROM + 15 * DAY * 1000, "-1w", "Europe/Berlin")))

# 2.8 arithmetic
A, B = {"metric": "events.purchase"}, {"metric": "events.view"}


def two_sql(body: str, a: dict | None = None, b: dict | None = None) -> str:
    return f"WITH {POINTS_SQL},\n{series_ctes(**(a or A), ser='s1', out='a')},\n{series_ctes(**(b or B), ser='s2', out='b')}\n{body}"


OPS = {"add": "a.value + b.value", "sub": "a.value - b.value", "mul": "a.value * b.value", "div": "CASE WHEN b.value <> 0 THEN a.value / b.value END", "min": "least(a.value, b.value)", "max": "greatest(a.value, b.value)"}
for op, text in OPS.items():
    register(
        f"arith_{op}",
        lambda s, d, o=op: across.arith(o, base(s, d, **A), base(s, d, **B)).shown(),
        two_sql(f"SELECT env, bucket_ms, round(v, 6) AS value FROM (SELECT a.env, a.bucket_ms, {text} AS v FROM a JOIN b ON a.env IS NOT DISTINCT FROM b.env AND a.bucket_ms = b.bucket_ms) WHERE v IS NOT NULL"),
    )
register("arith_pow", lambda s, d: across.arith("pow", base(s, d), 1.5).shown(4), sql("SELECT env, bucket_ms, round(pow(value, 1.5), 4) AS value FROM base"))
register("arith_neg", lambda s, d: across.arith_neg(base(s, d)).shown(), over("-value"))
register("arith_series_scalar", lambda s, d: across.arith("sub", 100.0, base(s, d)).shown(), over("100.0 - value"))
register("arith_time", lambda s, d: across.arith("add", across.TIME, base(s, d)).shown(3), sql("SELECT env, bucket_ms, round(bucket_ms / 1000 + value, 3) AS value FROM base"))
register(
    "arith_ungrouped_broadcast",
    lambda s, d: across.arith("div", base(s, d), base(s, d, by=())).shown(),
    two_sql("SELECT a.env, a.bucket_ms, round(a.value / b.value, 6) AS value FROM a JOIN b ON a.bucket_ms = b.bucket_ms WHERE b.value <> 0", A, {"metric": "events.purchase", "by": ()}),
)
register(
    "arith_group_match",
    lambda s, d: across.arith("sub", base(s, d, by=("env", "role")), base(s, d, by=("role", "env"), **B)).shown(),
    two_sql(
        "SELECT a.env, a.role, a.bucket_ms, round(a.value - b.value, 6) AS value FROM a JOIN b ON a.env IS NOT DISTINCT FROM b.env AND a.role IS NOT DISTINCT FROM b.role AND a.bucket_ms = b.bucket_ms",
        {"metric": "events.purchase", "by": ("env", "role")},
        {"metric": "events.view", "by": ("role", "env")},
    ),
)

# 2.10 one value per group
for how in ("avg", "min", "max", "sum", "last", "l2norm", "area"):
    register(
        f"scalar_{how}",
        lambda s, d, h=how: across.scalar(base(s, d), h).df.select("env", F.round("value", 4).alias("value")),
        sql(f"SELECT env, round({REDUCE[how]}, 4) AS value FROM base GROUP BY env"),
    )
BY_ENV = "SELECT env, {} AS value FROM {} GROUP BY env"
register(
    "scalar_formula",
    lambda s, d: across.arith("div", across.scalar(base(s, d, **A), "avg"), across.scalar(base(s, d, **B), "max")).df.select("env", F.round("value", 6).alias("value")),
    two_sql("SELECT x.env, round(x.value / y.value, 6) AS value FROM (SELECT env, avg(value) AS value FROM a GROUP BY env) x JOIN (SELECT env, max(value) AS value FROM b GROUP BY env) y ON x.env IS NOT DISTINCT FROM y.env"),
)


def table_of(s, d):
    one = {"mean": across.scalar(base(s, d, **A), "avg"), "top": across.scalar(base(s, d, **B, pred=pr.filter_not(pr.filter_tag_eq("env", "e4"))), "max")}
    return rounded(across.scalar_table(one, {"mean": (4, "desc")}), "mean", "top")


register(
    "scalar_table",
    table_of,
    two_sql(
        """, x AS (SELECT env, avg(value) AS mean FROM a GROUP BY env), y AS (SELECT env, max(value) AS top FROM b GROUP BY env),
        k AS (SELECT env FROM x ORDER BY mean DESC, env NULLS LAST LIMIT 4)
        SELECT k.env, round(x.mean, 6) AS mean, round(y.top, 6) AS top FROM k JOIN x ON x.env IS NOT DISTINCT FROM k.env LEFT JOIN y ON y.env IS NOT DISTINCT FROM k.env""",
        A,
        {"metric": "events.view", "where": "NOT list_contains(env, 'e4')"},
    ),
)
register(
    "series_identity",
    lambda s, d: points(s, d).groupBy("metric").agg(F.count_distinct(series_id("tenant_id", "metric", "host")).alias("series")),
    f"WITH {POINTS_SQL} SELECT metric, count(DISTINCT (host, env, role, canary)) AS series FROM pts GROUP BY metric",
)
