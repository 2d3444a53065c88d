"""Registered queries: models with SQL, catalogues, log search, joins and sets, and monitors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sketch
from ..model import same_keys
from ..operators import across, catalog, models
from ..operators import aggregate as ag
from ..operators import monitors as mon
from ..operators import predicates as pr
from ..operators.sliding import on_windows
from ..sources import telemetry
from ..sources.telemetry import CHECKS_SQL, LOGS_SQL, MONITORS_SQL, POINTS_SQL, table
from ..streaming import state
from .common import DAY, FROM, HOUR, STEP, TO, base, points, rounded, series_ctes, sql
from .registry import register

HOSTS = {"by": ("host",)}
NOW = FROM + 25 * DAY * 1000

# 2.9 models
MAD = """, m AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY bucket_ms) AS mid FROM base),
 o AS (SELECT *, abs(value - mid) AS off_by FROM m), v AS (SELECT *, {dev} AS dev FROM (SELECT *, quantile_cont(off_by, 0.5) OVER (PARTITION BY bucket_ms) * 1.4826 AS dev0 FROM o)),
 f AS (SELECT host, avg(CASE WHEN off_by > dev * 1.5 THEN 1.0 ELSE 0.0 END) * 100 AS share FROM v GROUP BY host)"""
OUT = " SELECT host, round(share, 6) AS share, share > 20 AND (SELECT count(*) FROM f) >= 3 AS outlier FROM f"
for name, dev in (("outliers_mad", "dev0"), ("outliers_scaledmad", "greatest(dev0, abs(mid) * 0.01)")):
    register(name, lambda s, d, k=name == "outliers_scaledmad": rounded(models.outliers_mad(base(s, d, **HOSTS), 1.5, 20, k), "share"), sql(MAD.format(dev=dev) + OUT, **HOSTS))
for name in ("outliers_dbscan", "outliers_scaleddbscan"):
    register(name, lambda s, d, k=name == "outliers_scaleddbscan": models.outliers_dbscan(base(s, d, **HOSTS, step_s=DAY), 1.5, k))
FRAME = "OVER (PARTITION BY env ORDER BY bucket_ms ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
BANDS = f", b AS (SELECT env, bucket_ms, value, quantile_cont(value, 0.5) {FRAME} AS mid, stddev_pop(value) {FRAME} AS sd, count(*) {FRAME} AS n FROM base), bands AS (SELECT env, bucket_ms, value, mid - 2 * sd AS lower, mid + 2 * sd AS upper FROM b WHERE n >= 5)"
register(
    "anomalies_basic",
    lambda s, d: rounded(models.anomalies_basic(base(s, d), 2), "value", "lower", "upper"),
    sql(f"{BANDS} SELECT env, bucket_ms, round(value, 6) AS value, round(lower, 6) AS lower, round(upper, 6) AS upper FROM bands"),
)
for name, text in (("both", "value > upper OR value < lower"), ("above", "value > upper"), ("below", "value < lower")):
    register(
        f"band_check_{name}" if name != "both" else "band_check",
        lambda s, d, n=name: models.anomalies_basic(base(s, d), 2).where(models.band_check(n)).groupBy("env").agg(F.count("*").alias("n")),
        sql(f"{BANDS} SELECT env, count(*) AS n FROM bands WHERE {text} GROUP BY env"),
    )
WEEK = {"step_s": HOUR, "by": ()}


def hourly(s, d, **how):
    return base(s, d, **(WEEK | how))


for name in ("robust", "agile"):

    def anomalies(s, d, kind=name):
        whole = hourly(s, d, metric="events.view")
        start = FROM + 24 * DAY * 1000
        fitted = models.model_fit(whole, kind, "weekly", start)
        shown = models.model_apply(whole.__class__(whole.df, whole.keys, whole.step_ms, start, TO), fitted, "weekly")
        return rounded(shown, "value", "lower", "upper")

    register(f"anomalies_{name}", anomalies)
register("model_fit", lambda s, d: models.model_fit(hourly(s, d), "robust", "weekly", FROM + 24 * DAY * 1000).select("kind", "season", "fitted_to", F.round("level", 4).alias("level"), F.round("sigma", 4).alias("sigma"), F.size("profile").alias("steps")))
register("model_apply", lambda s, d: models.model_apply(hourly(s, d), models.model_fit(hourly(s, d), "agile", "weekly", FROM + 24 * DAY * 1000), "weekly").agg(F.count("*").alias("banded")))
SEASON_TO = FROM + 28 * DAY * 1000


def resampled_sql(frm: int = FROM) -> str:
    return f"""WITH {POINTS_SQL}, {series_ctes(by=(), step=HOUR, frm=frm)},
 g AS (SELECT unnest(range((SELECT min(bucket_ms) FROM base), {SEASON_TO}, 3600000)) AS bucket_ms), j AS (SELECT g.bucket_ms, b.value FROM g LEFT JOIN base b ON g.bucket_ms = b.bucket_ms),
 w AS (SELECT *, last_value(value IGNORE NULLS) OVER p AS v0, max(CASE WHEN value IS NOT NULL THEN bucket_ms END) OVER p AS t0, first_value(value IGNORE NULLS) OVER n AS v1, min(CASE WHEN value IS NOT NULL THEN bucket_ms END) OVER n AS t1
  FROM j WINDOW p AS (ORDER BY bucket_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (ORDER BY bucket_ms ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT bucket_ms, round(coalesce(value, v0 + (v1 - v0) * ((bucket_ms - t0) / (t1 - t0)), v0, v1), 6) AS value FROM w WHERE (SELECT count(*) FROM g) >= 504 AND (SELECT count(*) FROM base WHERE bucket_ms < {SEASON_TO}) >= 0.8 * (SELECT count(*) FROM g)"""


register("resample_season", lambda s, d: rounded(models.resample_season(hourly(s, d), "weekly", SEASON_TO), "value"), resampled_sql())
HISTORY = SEASON_TO - 22 * DAY * 1000
register("seasonal_history", lambda s, d: rounded(models.resample_season(hourly(s, d, from_ms=HISTORY), "weekly", SEASON_TO), "value"), resampled_sql(HISTORY))
FUTURE = [TO + k * STEP * 1000 for k in range(8)]
for model in ("default", "simple", "reactive"):
    text = None
    if model == "reactive":
        text = sql(
            f""", n AS (SELECT *, row_number() OVER (PARTITION BY env ORDER BY bucket_ms DESC) AS rn, count(*) OVER (PARTITION BY env) AS c, (bucket_ms - {TO}) / 1000 AS x FROM base),
            u AS (SELECT * FROM n WHERE rn <= greatest(2, c // 5)), l AS (SELECT env, regr_intercept(value, x) AS a, regr_slope(value, x) AS b FROM u GROUP BY env),
            r AS (SELECT u.env, value - a - b * x AS e FROM u JOIN l ON u.env IS NOT DISTINCT FROM l.env),
            h AS (SELECT env, 2 * 1.4826 * quantile_cont(abs(e - m), 0.5) AS half FROM (SELECT *, quantile_cont(e, 0.5) OVER (PARTITION BY env) AS m FROM r) GROUP BY env),
            t AS (SELECT unnest(range(0, 8)) * {STEP * 1000} + {TO} AS bucket_ms)
            SELECT l.env, bucket_ms, round(a + b * ((bucket_ms - {TO}) / 1000), 6) AS value, round(a + b * ((bucket_ms - {TO}) / 1000) - half, 6) AS lower, round(a + b * ((bucket_ms - {TO}) / 1000) + half, 6) AS upper
            FROM l JOIN h ON l.env IS NOT DISTINCT FROM h.env CROSS JOIN t"""
        )
    register(f"forecast_linear_{model}" if model != "default" else "forecast_linear", lambda s, d, m=model: rounded(models.forecast_linear(base(s, d), FUTURE, m), "value", "lower", "upper"), text)
register("forecast_seasonal", lambda s, d: rounded(models.forecast_seasonal(hourly(s, d), [TO + k * 3_600_000 for k in range(24)], "weekly"), "value", "lower", "upper"))
STATS = {"median": "max(mid)", "mean": "avg(value)", "sd": "stddev_pop(value)", "mad": "quantile_cont(abs(value - mid), 0.5)"}
for name, text in STATS.items():
    register(
        f"stat_{name}",
        lambda s, d, n=name: models.stats(base(s, d).df, ("env",)).select("env", F.round(n, 6).alias("value")),
        sql(f", m AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY env) AS mid FROM base) SELECT env, round({text}, 6) AS value FROM m GROUP BY env"),
    )

# 2.11 catalogues and logs
register("active_metrics", lambda s, d: catalog.active_metrics(points(s, d), FROM + 29 * DAY * 1000, "host-3"), f"WITH {POINTS_SQL} SELECT DISTINCT metric FROM pts WHERE t_ms >= {FROM + 29 * DAY * 1000} AND host = 'host-3'")
KEYS = """cat AS (SELECT metric, t_ms // 3600000 * 3600000 AS hour, unnest(list_concat([''], CASE WHEN len(env) > 0 THEN ['env'] ELSE [] END, ['role'], CASE WHEN len(canary) > 0 THEN ['canary'] ELSE [] END)) AS key FROM pts)"""
register(
    "mv_metric_tag_keys",
    lambda s, d: catalog.tag_keys_hourly(points(s, d)).drop("tenant_id"),
    f"WITH {POINTS_SQL}, {KEYS} SELECT metric, hour, key, max(CASE WHEN key = 'canary' THEN 1 ELSE 0 END) AS bare, count(*) AS points FROM cat GROUP BY ALL",
)
register("list_metrics", lambda s, d: catalog.list_metrics(catalog.tag_keys_hourly(points(s, d)), "R"), f"WITH {POINTS_SQL} SELECT DISTINCT metric FROM pts WHERE contains(lower(metric), 'r') ORDER BY metric LIMIT 500")
register("list_tag_keys", lambda s, d: catalog.list_tag_keys(catalog.tag_keys_hourly(points(s, d)), "events.view"), f"WITH {POINTS_SQL}, {KEYS} SELECT DISTINCT key FROM cat WHERE metric = 'events.view' AND key <> ''")
register("list_tag_values", lambda s, d: catalog.list_tag_values(points(s, d), "env", "E"), f"WITH {POINTS_SQL} SELECT DISTINCT unnest(env) AS value FROM pts")
register("list_checks", lambda s, d: catalog.list_checks(telemetry.check_runs(table(s, d, "events"))), f"WITH {CHECKS_SQL} SELECT DISTINCT check_name FROM runs")
register("series_by_host_or_tags", lambda s, d: base(s, d, by=("env", "role"), step_s=DAY).shown(), sql("SELECT env, role, bucket_ms, round(value, 6) AS value FROM base", by=("env", "role"), step=DAY))


def found_logs(s, d):
    return telemetry.logs(table(s, d, "documents"))


def log_pred():
    return (F.col("status") == "warn") & pr.filter_text("message", "the")


LOG_SQL = "status = 'warn' AND contains(message, 'the') AND list_contains(string_split_regex(message, '[^0-9a-zA-Z]+'), 'the')"
register("log_search", lambda s, d: catalog.log_search(found_logs(s, d), log_pred(), 100).select("log_id", "t_ms", "service"), f"WITH {LOGS_SQL} SELECT log_id, t_ms, service FROM logs WHERE {LOG_SQL} ORDER BY t_ms DESC, log_id DESC LIMIT 100")
register("log_count", lambda s, d: catalog.log_count(found_logs(s, d), log_pred()), f"WITH {LOGS_SQL} SELECT count(*) AS n FROM logs WHERE {LOG_SQL}")
for field in ("service", "host", "status"):
    register(
        f"log_facet_{field}",
        lambda s, d, f=field: catalog.log_facet(found_logs(s, d), F.col("t_ms") >= FROM, f, 10),
        f"WITH {LOGS_SQL} SELECT {field} AS value, count(*) AS n FROM logs GROUP BY 1 ORDER BY n DESC, value LIMIT 10",
    )


# 2.12 joins, sets, limits
def trans(s, d):
    return telemetry.transitions(table(s, d, "events"))


def evals(s, d):
    return telemetry.evaluations(table(s, d, "events"))


def notes(s, d):
    return telemetry.notifications(table(s, d, "events"))


def monitors_sql(body: str) -> str:
    return f"WITH {MONITORS_SQL}\n{body}"


PAIR = f"WITH {POINTS_SQL},\n{series_ctes(metric='events.purchase', ser='s1', out='a')},\n{series_ctes(metric='events.view', ser='s2', out='b')}"
register(
    "join_series_on_group",
    lambda s, d: across.arith("max", base(s, d), base(s, d, metric="events.view")).df.groupBy("env").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")),
    f"{PAIR} SELECT a.env, count(*) AS n, round(sum(greatest(a.value, b.value)), 6) AS total FROM a JOIN b ON a.env IS NOT DISTINCT FROM b.env AND a.bucket_ms = b.bucket_ms GROUP BY a.env",
)
ALONE = f"WITH {POINTS_SQL},\n{series_ctes(ser='s1', out='a')},\n{series_ctes(by=(), ser='s2', out='b')}"
register(
    "join_broadcast_single_series",
    lambda s, d: across.arith("sub", base(s, d), base(s, d, by=())).df.groupBy("env").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("most")),
    f"{ALONE} SELECT a.env, count(*) AS n, round(max(a.value - b.value), 6) AS most FROM a JOIN b ON a.bucket_ms = b.bucket_ms GROUP BY a.env",
)
LAST_VALUE = f"SELECT monitor_id, group_key, arg_max(value, (at_ms, event_id)) AS last_value FROM evals WHERE at_ms > {NOW - DAY * 1000} AND at_ms <= {NOW} AND value IS NOT NULL GROUP BY ALL"
GROUP_LIST = f"SELECT l.monitor_id, l.group_key, l.to_state AS state, l.reason, l.at_ms AS since, v.last_value FROM latest l LEFT JOIN ({LAST_VALUE}) v USING (monitor_id, group_key) WHERE l.reason NOT IN ('expired', 'definition_changed', 'deleted')"
for name in ("join_groups_latest_value", "mon_group_list"):
    register(name, lambda s, d: mon.mon_group_list(trans(s, d), evals(s, d), NOW), monitors_sql(GROUP_LIST))
register(
    "antijoin_unnotified",
    lambda s, d: trans(s, d).join(notes(s, d).select("monitor_id", "group_key", F.col("transition_at").alias("at_ms")), ["monitor_id", "group_key", "at_ms"], "left_anti").select("event_id"),
    monitors_sql("SELECT event_id FROM trans t WHERE NOT EXISTS (SELECT 1 FROM notes n WHERE n.monitor_id = t.monitor_id AND n.group_key = t.group_key AND n.transition_at = t.at_ms)"),
)


def extra_series(s, d):
    kept = across.series_limit(base(s, d, **HOSTS), 5)
    bands = models.anomalies_basic(base(s, d, **HOSTS), 2).select("host", "bucket_ms", "lower", "upper")
    return kept.df.alias("l").join(bands.alias("r"), same_keys(("host", "bucket_ms")), "left").select("l.host", "l.bucket_ms", F.round("l.value", 6).alias("value"), F.round("r.lower", 6).alias("lower"), F.round("r.upper", 6).alias("upper"))


HBANDS = BANDS.replace("env", "host")
register(
    "join_extra_series",
    extra_series,
    sql(
        f"{HBANDS}, k AS (SELECT host FROM (SELECT host, avg(value) AS m FROM base GROUP BY host) ORDER BY m DESC, host NULLS LAST LIMIT 5) SELECT b.host, b.bucket_ms, round(b.value, 6) AS value, round(x.lower, 6) AS lower, round(x.upper, 6) AS upper FROM base b JOIN k ON b.host IS NOT DISTINCT FROM k.host LEFT JOIN bands x ON x.host IS NOT DISTINCT FROM b.host AND x.bucket_ms = b.bucket_ms",
        **HOSTS,
    ),
)
SHIFT = DAY * 1000


def changes(s, d):
    now = base(s, d)
    old = now.df.select("env", (F.col("bucket_ms") + SHIFT).alias("bucket_ms"), F.col("value").alias("old"))
    return now.df.alias("l").join(old.alias("r"), same_keys(("env", "bucket_ms"))).select("l.env", "l.bucket_ms", F.round(F.col("l.value") - F.col("r.old"), 6).alias("value"))


register("join_change_shifted", changes, sql(f"SELECT n.env, n.bucket_ms, round(n.value - o.value, 6) AS value FROM base n JOIN base o ON n.env IS NOT DISTINCT FROM o.env AND n.bucket_ms = o.bucket_ms + {SHIFT}"))
register(
    "join_model_to_series",
    lambda s, d: base(s, d).df.alias("l").join(models.stats(base(s, d).df, ("env",)).alias("r"), same_keys(("env",)), "left").select("l.env", "l.bucket_ms", F.round((F.col("l.value") - F.col("r.mean")) / F.col("r.sd"), 6).alias("value")),
    sql("SELECT env, bucket_ms, round((value - avg(value) OVER p) / stddev_pop(value) OVER p, 6) AS value FROM base WINDOW p AS (PARTITION BY env)"),
)
register(
    "set_union_all",
    lambda s, d: ag.rollup_with_tail(ag.rollup_1m(points(s, d)), points(s, d), NOW).groupBy("metric").agg(F.sum("points").alias("points")),
    f"WITH {POINTS_SQL} SELECT metric, CAST(count(*) AS BIGINT) AS points FROM pts WHERE t_ms < {NOW} GROUP BY metric",
)
register("set_distinct", lambda s, d: telemetry.check_runs(table(s, d, "events")).select("check_name", "host", "status").distinct(), f"WITH {CHECKS_SQL} SELECT DISTINCT check_name, host, status FROM runs")
register(
    "set_intersect_groups",
    lambda s, d: base(s, d, **HOSTS).df.select("host").intersect(base(s, d, **HOSTS, metric="events.view", pred=pr.filter_tag_eq("role", "web")).df.select("host")),
    f"WITH {POINTS_SQL} SELECT DISTINCT nullif(host, '') AS host FROM pts WHERE metric = 'events.purchase' INTERSECT SELECT nullif(host, '') FROM pts WHERE metric = 'events.view' AND list_contains(role, 'web')",
)
register("set_except_closed", lambda s, d: mon.open_groups(trans(s, d)).select("monitor_id", "group_key", "reason"), monitors_sql("SELECT monitor_id, group_key, reason FROM latest WHERE reason NOT IN ('expired', 'definition_changed', 'deleted')"))
register(
    "limit_by",
    lambda s, d: catalog.newest_per(telemetry.check_runs(table(s, d, "events")).withColumn("u", F.col("status") == "UNKNOWN"), ["check_name", "host", "u"], [F.col("t_ms").desc(), F.col("event_id")], 3).select("check_name", "host", "u", "event_id"),
    f"WITH {CHECKS_SQL} SELECT check_name, host, u, event_id FROM (SELECT *, status = 'UNKNOWN' AS u, row_number() OVER (PARTITION BY check_name, host, status = 'UNKNOWN' ORDER BY t_ms DESC, event_id) AS rn FROM runs) WHERE rn <= 3",
)
BEFORE = "SELECT monitor_id, group_key, to_state, at_ms FROM (SELECT *, row_number() OVER (PARTITION BY monitor_id, group_key ORDER BY at_ms DESC, inserted_at DESC) AS rn FROM trans WHERE at_ms < {}) WHERE rn = 1"
for name in ("limit_1_by_group", "mon_initial_states"):
    register(name, lambda s, d: mon.latest_states(trans(s, d).where(F.col("at_ms") < NOW)).select("monitor_id", "group_key", "to_state", "at_ms"), monitors_sql(BEFORE.format(NOW)))
register(
    "latest_by_argmax",
    lambda s, d: mon.latest_states(trans(s, d)).select("monitor_id", "group_key", "to_state", "reason", "last_triggered_at"),
    monitors_sql("SELECT monitor_id, group_key, to_state, reason, last_triggered_at FROM latest"),
)
NEWEST = "SELECT monitor_id, group_key, at_ms, event_id, true AS more FROM {} ORDER BY at_ms DESC, event_id DESC LIMIT 300"
register("newest_n_then_ascending", lambda s, d: catalog.newest_then_ascending(trans(s, d).select("monitor_id", "group_key", "at_ms", "event_id"), ["at_ms", "event_id"], 300), monitors_sql(NEWEST.format("trans")))
register("mon_transitions_range", lambda s, d: catalog.newest_then_ascending(trans(s, d).where(F.col("at_ms") < NOW).select("monitor_id", "group_key", "at_ms", "event_id"), ["at_ms", "event_id"], 300), monitors_sql(NEWEST.format(f"trans WHERE at_ms < {NOW}")))
register("mon_evaluations_range", lambda s, d: catalog.newest_then_ascending(evals(s, d).where(F.col("at_ms") < NOW).select("monitor_id", "group_key", "at_ms", "event_id"), ["at_ms", "event_id"], 300), monitors_sql(NEWEST.format(f"evals WHERE at_ms < {NOW}")))
register("sort_groups_nulls_last", lambda s, d: across.ranked_groups(base(s, d), "mean", True).select("env", "nth"), sql("SELECT env, row_number() OVER (ORDER BY avg(value) DESC, env NULLS LAST) AS nth FROM base GROUP BY env"))
register("topk_facets", lambda s, d: catalog.log_facet(trans(s, d), F.lit(True), "group_key", 7), monitors_sql("SELECT group_key AS value, count(*) AS n FROM trans GROUP BY 1 ORDER BY n DESC, value LIMIT 7"))
register(
    "scan_transitions_final",
    lambda s, d: catalog.replace_by_version(trans(s, d).unionAll(trans(s, d)).select("monitor_id", "group_key", "at_ms", "to_state", "inserted_at", "event_id"), ["monitor_id", "group_key", "at_ms"], ["inserted_at", "event_id"]).select("monitor_id", "group_key", "at_ms", "to_state"),
    monitors_sql("SELECT monitor_id, group_key, at_ms, to_state FROM (SELECT *, row_number() OVER (PARTITION BY monitor_id, group_key, at_ms ORDER BY inserted_at DESC, event_id DESC) AS rn FROM trans) WHERE rn = 1"),
)
register("dedup_resend", lambda s, d: notes(s, d).dropDuplicates(["monitor_id", "group_key", "transition_at"]).select("monitor_id", "group_key", "transition_at"), monitors_sql("SELECT monitor_id, group_key, transition_at FROM notes"))

# 2.13 monitors
FIRST, LAST_TICK, EVERY, REACH = FROM + 5 * DAY * 1000, FROM + 12 * DAY * 1000, STEP * 1000, DAY * 1000


def periods(s):
    return mon.mon_period(mon.mon_ticks(s, [1], FIRST, LAST_TICK, EVERY), 3_600_000, REACH)


TICKS = f"t AS (SELECT tick, (tick - 30000) // 3600000 * 3600000 AS to_ms, (tick - 30000) // 3600000 * 3600000 - {REACH} AS from_ms FROM (SELECT unnest(range({FIRST}, {LAST_TICK}, {EVERY})) AS tick))"
ON = "t JOIN {} b ON b.bucket_ms >= t.from_ms AND b.bucket_ms < t.to_ms"


def hourly_env(s, d, **how):
    return base(s, d, step_s=HOUR, **how)


def tick_sql(select: str, source: str = "base", before: str = "", **how) -> str:
    return sql(f", {TICKS}{before} {select} FROM {ON.format(source)} GROUP BY tick, env", **({"step": HOUR} | how))


register(
    "mon_ticks",
    lambda s, d: mon.ticks_between(evals(s, d), "at_ms", EVERY),
    monitors_sql(f"SELECT monitor_id, unnest(range(CAST(ceil(min(at_ms) / {EVERY}) * {EVERY} AS BIGINT), max(at_ms) + 1, {EVERY})) AS tick FROM evals GROUP BY monitor_id"),
)
register(
    "mon_period",
    lambda s, d: on_windows(hourly_env(s, d).df, ("env",), periods(s)).groupBy("tick").agg(F.max("to_ms").alias("to_ms"), F.max("from_ms").alias("from_ms"), F.sum("n").alias("n")),
    sql(f", {TICKS} SELECT tick, max(to_ms) AS to_ms, max(from_ms) AS from_ms, count(*) AS n FROM {ON.format('base')} GROUP BY tick", step=HOUR),
)
for how, text in (("avg", "avg(value)"), ("max", "max(value)")):
    register(f"mon_threshold_{how}" if how != "avg" else "mon_threshold", lambda s, d, h=how: rounded(mon.mon_threshold(hourly_env(s, d), periods(s), h), "value"), tick_sql(f"SELECT tick, env, round({text}, 6) AS value"))
ERRORS = "sum(value * CASE WHEN metric_type = 'RATE' THEN greatest(ival, 1) ELSE 1 END)"


def as_count(s, d):
    both = [mon.mon_threshold(hourly_env(s, d, metric=m, time_agg="as_count", space_agg="sum"), periods(s), "sum").withColumnRenamed("value", n) for m, n in (("events.error", "x"), ("events.click", "y"))]
    joined = both[0].alias("l").join(both[1].alias("r"), (F.col("l.tick") == F.col("r.tick")) & F.col("l.env").eqNullSafe(F.col("r.env")))
    return joined.select("l.tick", "l.env", F.round(F.try_divide(F.col("x"), F.col("y")), 6).alias("value"))


register(
    "mon_as_count",
    as_count,
    f"WITH {POINTS_SQL}, {series_ctes(metric='events.error', step=HOUR, agg=ERRORS, space='sum', ser='s1', out='a')}, {series_ctes(metric='events.click', step=HOUR, agg=ERRORS, space='sum', ser='s2', out='b0')}, {TICKS},"
    f" x AS (SELECT tick, env, sum(value) AS v FROM {ON.format('a')} GROUP BY tick, env), y AS (SELECT tick, env, sum(value) AS v FROM {ON.format('b0')} GROUP BY tick, env)"
    " SELECT x.tick, x.env, round(x.v / y.v, 6) AS value FROM x JOIN y ON x.tick = y.tick AND x.env IS NOT DISTINCT FROM y.env",
)
CHANGE = ", ch AS (SELECT n.env, n.bucket_ms, {} AS value FROM base n JOIN base o ON n.env IS NOT DISTINCT FROM o.env AND n.bucket_ms = o.bucket_ms + 86400000)"
register("mon_change", lambda s, d: rounded(mon.mon_change(hourly_env(s, d), periods(s), DAY * 1000), "value"), tick_sql("SELECT tick, env, round(avg(value), 6) AS value", "ch", CHANGE.format("n.value - o.value")))
register("mon_pct_change", lambda s, d: rounded(mon.mon_change(hourly_env(s, d), periods(s), DAY * 1000, True), "value", digits=4), tick_sql("SELECT tick, env, round(avg(value), 4) AS value", "ch", CHANGE.format("(n.value - o.value) / o.value * 100")))
FLAGS = BANDS + ", fl AS (SELECT env, bucket_ms, CASE WHEN value > upper OR value < lower THEN 1.0 ELSE 0.0 END AS value FROM bands)"
register(
    "mon_anomaly",
    lambda s, d: rounded(mon.mon_anomaly(hourly_env(s, d), periods(s), 2.0, recovery_ms=6 * 3_600_000), "value", "recovery"),
    tick_sql("SELECT tick, env, round(avg(value), 6) AS value, round(avg(CASE WHEN bucket_ms >= to_ms - 21600000 THEN value END), 6) AS recovery", "fl", FLAGS),
)
register("mon_forecast", lambda s, d: models.forecast_linear(base(s, d), FUTURE).groupBy("env").agg(F.round(F.max("upper"), 6).alias("most"), F.round(F.min("lower"), 6).alias("least")))
register(
    "mon_outlier",
    lambda s, d: mon.mon_outlier(base(s, d, **HOSTS), tolerance=1.5),
    sql(MAD.format(dev="dev0") + " SELECT host, CASE WHEN share > 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value, 'judged' AS status FROM f", **HOSTS),
)
register(
    "mon_full_window",
    lambda s, d: mon.mon_full_window(hourly_env(s, d), periods(s), 3_600_000),
    tick_sql("SELECT tick, env, min((bucket_ms - from_ms) // 3600000) = 0 AND ceil((max(to_ms) - max(from_ms)) / 3600000) - count(DISTINCT (bucket_ms - from_ms) // 3600000) <= 3 AS full"),
)
register(
    "mon_groups",
    lambda s, d: mon.mon_groups(mon.mon_threshold(hourly_env(s, d, by=("env", "role")), periods(s)), ("env", "role")).select("tick", "group_key", F.round("value", 6).alias("value")),
    sql(f", {TICKS} SELECT tick, 'env:' || env || ',role:' || role AS group_key, round(avg(value), 6) AS value FROM {ON.format('base')} WHERE env IS NOT NULL AND role IS NOT NULL GROUP BY tick, env, role", step=HOUR, by=("env", "role")),
)
register(
    "mon_skip_causes",
    lambda s, d: mon.mon_full_window(hourly_env(s, d), periods(s), 3_600_000).select("tick", "env", F.when(F.col("full"), "judged").otherwise("incomplete").alias("status")),
    tick_sql("SELECT tick, env, CASE WHEN min((bucket_ms - from_ms) // 3600000) = 0 AND ceil((max(to_ms) - max(from_ms)) / 3600000) - count(DISTINCT (bucket_ms - from_ms) // 3600000) <= 3 THEN 'judged' ELSE 'incomplete' END AS status"),
)


def cached_models(s, d):
    """Models asked for on three days: fitted on the first, used again on the second, too old on the fourth."""
    days = [FROM + k * DAY * 1000 for k in (22, 23, 25)]
    held = models.model_fit(hourly(s, d), "agile", "weekly", days[0])
    asked = [(day, models.model_cached(hourly(s, d), "agile", "weekly", day, held, 2 * DAY * 1000)) for day in days]
    rows = [f.select(F.lit(day).alias("asked_at"), "kind", "fitted_to") for day, f in asked]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


register("mon_model_cache", cached_models)


def runs(s, d):
    return telemetry.check_runs(table(s, d, "events")).withColumn("env", F.col("tags")["env"][0])


SERIES = ["check_name", "host", "env"]
CHECKED = f"""WITH {CHECKS_SQL}, r AS (SELECT check_name, host, env, t_ms, status, row_number() OVER (PARTITION BY check_name, host, env, status = 'UNKNOWN' ORDER BY t_ms DESC) AS nth FROM runs),
 n AS (SELECT *, row_number() OVER w AS rn, lead(t_ms) OVER w AS next_ms, sum(CASE WHEN status <> 'UNKNOWN' THEN 1 ELSE 0 END) OVER w AS kn FROM r WHERE nth <= 4 WINDOW w AS (PARTITION BY check_name, host, env ORDER BY t_ms DESC)),
 s AS (SELECT check_name, host, env, max(CASE WHEN rn = 1 THEN status END) AS latest, max(t_ms) AS newest_ms, max(CASE WHEN rn = 1 THEN t_ms - next_ms END) AS gap_ms,
  {", ".join(f"CAST(coalesce(min(CASE WHEN status <> 'UNKNOWN' AND kn <= 4 AND status <> '{k}' THEN kn END) - 1, sum(CASE WHEN status <> 'UNKNOWN' AND kn <= 4 THEN 1 ELSE 0 END)) AS BIGINT) AS {n}" for k, n in (("CRITICAL", "critical"), ("WARNING", "warning"), ("OK", "ok")))},
  CAST(coalesce(min(CASE WHEN status <> 'UNKNOWN' THEN rn END) - 1, count(*)) AS BIGINT) AS unknown,
  CAST(coalesce(min(CASE WHEN rn <= 4 AND status <> 'OK' THEN rn END) - 1, sum(CASE WHEN rn <= 4 THEN 1 ELSE 0 END)) AS BIGINT) AS ok_since_unknown FROM n GROUP BY check_name, host, env)"""
RANKED = "CASE {} WHEN 'CRITICAL' THEN 3 WHEN 'WARNING' THEN 2 WHEN 'UNKNOWN' THEN 1 ELSE 0 END"


def streaks(s, d):
    return mon.check_streaks(mon.check_newest_runs(runs(s, d), SERIES, 4), SERIES, 4)


LIVE = f"(gap_ms IS NULL OR {TO} - newest_ms <= 2 * gap_ms + 60000)"
register("check_newest_runs", lambda s, d: mon.check_newest_runs(runs(s, d), SERIES, 4), f"{CHECKED} SELECT check_name, host, env, t_ms, status FROM r WHERE nth <= 4")
register("check_streaks", streaks, f"{CHECKED} SELECT * FROM s")
register("check_liveness", lambda s, d: mon.check_live(streaks(s, d), TO).select("check_name", "host", "env", "newest_ms"), f"{CHECKED} SELECT check_name, host, env, newest_ms FROM s WHERE {LIVE}")
register("check_groups", lambda s, d: mon.check_live(streaks(s, d), TO).groupBy("check_name", "env").agg(F.count("*").alias("series"), F.max("newest_ms").alias("last_point")), f"{CHECKED} SELECT check_name, env, count(*) AS series, max(newest_ms) AS last_point FROM s WHERE {LIVE} GROUP BY check_name, env")
register(
    "check_worst",
    lambda s, d: mon.check_worst(streaks(s, d), ["check_name", "env"]),
    f"{CHECKED} SELECT check_name, env, CASE max({RANKED.format('latest')}) WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'WARNING' WHEN 1 THEN 'UNKNOWN' ELSE 'OK' END AS worst, max(newest_ms) AS last_point, count(*) AS series FROM s GROUP BY check_name, env",
)
register(
    "check_recent_runs",
    lambda s, d: telemetry.check_runs(table(s, d, "events")).orderBy(F.col("t_ms").desc(), "event_id").limit(100).select("event_id", "status", F.array_join(mon.tag_list(), ",").alias("tags")),
    f"WITH {CHECKS_SQL} SELECT event_id, status, 'env:' || env AS tags FROM runs ORDER BY t_ms DESC, event_id LIMIT 100",
)
register(
    "judge_threshold",
    lambda s, d: mon.mon_threshold(hourly_env(s, d), periods(s)).select("tick", "env", mon.judge_threshold(F.col("value"), ">", 7.0, 5.5).alias("state")),
    tick_sql("SELECT tick, env, CASE WHEN avg(value) > 7 THEN 'Alert' WHEN avg(value) > 5.5 THEN 'Warn' ELSE 'OK' END AS state"),
)


CHECK = state.Definition(kind="check", critical=2, warning=2, ok=1, unknown=3)


def judged_streaks(s, d):
    columns = ("critical", "warning", "ok", "unknown", "ok_since_unknown")
    lists = streaks(s, d).groupBy("check_name", "env").agg(F.collect_list(F.struct(*columns)).alias("streaks"))
    return lists.select("check_name", "env", state.judge_streaks(CHECK, F.lit(None).cast("string"), F.col("streaks")).alias("state"))


register(
    "judge_streaks",
    judged_streaks,
    f"{CHECKED} SELECT check_name, env, CASE WHEN bool_or(told AND critical >= 2) THEN 'Alert' WHEN bool_or(told AND warning >= 2) THEN 'Warn' WHEN bool_or(unknown >= 3) THEN 'No Data' WHEN bool_or(told) AND bool_and(NOT told OR ok >= 1) THEN 'OK' END AS state"
    " FROM (SELECT *, unknown < 3 AND critical + warning + ok > 0 AS told FROM s) GROUP BY check_name, env",
)


def evaluated(s, d):
    rows = mon.mon_groups(mon.mon_threshold(hourly_env(s, d), periods(s)), ("env",))
    return rows.select(F.lit(1).cast("long").alias("monitor_id"), "tick", "group_key", "value", F.col("tick").alias("last_point"), F.lit("judged").alias("status"))


def states(s, d, **how):
    definition = state.Definition(**({"comparator": ">", "critical": 7.0, "warning": 5.5, "critical_recovery": 6.5, "window": REACH, "notify_no_data": True} | how))
    return state.folded(state.complete_ticks(evaluated(s, d), periods(s)), definition)


def state_sql(select: str, critical: float = 7.0, warning: float | None = 5.5, critical_recovery: float | None = 6.5, new_group_delay: int = 60_000, forget_after: int = DAY * 1000, on_missing_data: str | None = None, notify_no_data: bool = True) -> str:
    """The same as a recursive query, a tick of every group in each round."""
    held = f"base_state = 'Alert' AND v > {critical if critical_recovery is None else critical_recovery}"
    warn = "" if warning is None else f"WHEN v > {warning} THEN 'Warn'"
    quiet = "'No Data'" if on_missing_data == "show" else f"CASE WHEN {notify_no_data} AND st <> 'No Data' AND to_ms - pt >= {2 * REACH} THEN 'No Data' END"
    crossed = f"CASE WHEN v > {critical} OR ({held}) THEN 'critical' " + ("" if warning is None else f"WHEN v > {warning} THEN 'warning' ") + ("" if critical_recovery is None else "WHEN base_state = 'Alert' THEN 'critical_recovery' ") + "END"
    text = sql(
        f""", {TICKS}, ev AS (SELECT tick, 'env:' || env AS k, avg(value) AS v FROM {ON.format("base")} WHERE env IS NOT NULL GROUP BY tick, env), f AS (SELECT k, min(tick) AS f FROM ev GROUP BY k),
 slots AS (SELECT f.k, t.tick, t.from_ms, t.to_ms, ev.v, row_number() OVER (PARTITION BY f.k ORDER BY t.tick) AS rn FROM f JOIN t ON t.tick >= f.f LEFT JOIN ev ON ev.k = f.k AND ev.tick = t.tick),
 m AS (
  SELECT k, 0::BIGINT AS rn, NULL::VARCHAR AS st, NULL::BIGINT AS f1, NULL::BIGINT AS l1, NULL::BIGINT AS seen0, NULL::BIGINT AS seen, NULL::BIGINT AS pt, NULL::VARCHAR AS held, false AS moved, NULL::BIGINT AS at_ms,
   NULL::VARCHAR AS from_state, NULL::VARCHAR AS to_state, NULL::VARCHAR AS reason, NULL::DOUBLE AS value, NULL::VARCHAR AS crossed, NULL::BIGINT AS m_from, NULL::BIGINT AS m_to, NULL::BIGINT AS m_f1, NULL::BIGINT AS m_l1 FROM f
  UNION ALL
  SELECT k, rn, CASE WHEN sit = 'expire' THEN NULL WHEN turns THEN goal ELSE st END, CASE WHEN sit = 'expire' OR (turns AND goal = 'OK') THEN NULL ELSE f2 END, CASE WHEN sit = 'expire' THEN NULL ELSE l2 END,
   CASE WHEN sit = 'expire' THEN NULL ELSE seen0 END, CASE WHEN sit = 'expire' THEN NULL ELSE seen END, CASE WHEN sit = 'expire' THEN NULL ELSE pt END,
   CASE WHEN sit = 'expire' THEN NULL WHEN turns THEN CASE WHEN goal = 'No Data' AND why = 'no_data_shown' THEN st END ELSE held END, turns, tick, st, goal, why, CASE WHEN sit = 'judge' THEN v END, CASE WHEN sit = 'judge' THEN cr END,
   CASE WHEN sit <> 'expire' THEN from_ms END, CASE WHEN sit <> 'expire' THEN to_ms END, f2, l2
  FROM (SELECT *, CASE WHEN turns AND fires AND coalesce(base_state, '') NOT IN ('Alert', 'Warn') THEN tick ELSE f1 END AS f2, CASE WHEN turns AND fires THEN tick ELSE l1 END AS l2
   FROM (SELECT *, goal IN ('Alert', 'Warn') AS fires, goal IS NOT NULL AND (sit = 'expire' OR goal IS DISTINCT FROM st) AS turns,
     CASE WHEN sit = 'expire' THEN 'expired' WHEN sit = 'silence' THEN '{"no_data_shown" if on_missing_data == "show" else "no_data"}' WHEN st IS NULL THEN 'new' WHEN st = 'No Data' AND held = goal THEN 'no_data_shown' WHEN goal = 'OK' THEN 'recovery' ELSE 'threshold' END AS why
    FROM (SELECT *, {crossed} AS cr, CASE sit WHEN 'judge' THEN CASE WHEN v > {critical} OR ({held}) THEN 'Alert' {warn} ELSE 'OK' END WHEN 'silence' THEN {quiet} WHEN 'expire' THEN CASE WHEN st IS NOT NULL THEN 'OK' END END AS goal
     FROM (SELECT *, coalesce(held, st) AS base_state,
       CASE WHEN seen0 IS NULL THEN 'wait' WHEN v IS NULL AND tick - seen >= {forget_after} THEN 'expire' WHEN v IS NULL THEN CASE WHEN st IS NULL THEN 'wait' ELSE 'silence' END WHEN st IS NULL AND tick - seen0 < {new_group_delay} THEN 'wait' ELSE 'judge' END AS sit
      FROM (SELECT m.k, s.rn, m.st, m.f1, m.l1, m.held, s.tick, s.from_ms, s.to_ms, s.v, CASE WHEN s.v IS NULL THEN m.seen0 ELSE coalesce(m.seen0, s.tick) END AS seen0, CASE WHEN s.v IS NULL THEN m.seen ELSE s.tick END AS seen, CASE WHEN s.v IS NULL THEN m.pt ELSE s.tick END AS pt
       FROM m JOIN slots s ON s.k = m.k AND s.rn = m.rn + 1)))))
 ) {select}""",
        step=HOUR,
    )
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


MOVED = "SELECT 1::BIGINT AS monitor_id, k AS group_key, at_ms, from_state, to_state, reason, round(value, 6) AS value, crossed, m_from AS from_ms, m_to AS to_ms, m_f1 AS first_triggered_at, m_l1 AS last_triggered_at FROM m WHERE moved"
for name, how in {
    "state_step": {},
    "state_no_data": {"on_missing_data": "show", "critical": 9.0, "warning": None, "critical_recovery": None},
    "state_new_group_delay": {"new_group_delay": 2 * DAY * 1000},
    "state_expiry": {"forget_after": STEP * 1000},
    "state_step_plain": {"critical_recovery": None, "new_group_delay": 0, "notify_no_data": False, "forget_after": 400 * DAY * 1000},
}.items():
    register(name, lambda s, d, h=how: rounded(state.transitions(states(s, d, **h)), "value"), state_sql(MOVED, **how))
register(
    "state_close",
    lambda s, d: state.close(state.memory(states(s, d)), LAST_TICK, "deleted").select("monitor_id", "group_key", "at_ms", "from_state", "to_state", "reason", "first_triggered_at"),
    state_sql(f"SELECT 1::BIGINT AS monitor_id, k AS group_key, {LAST_TICK}::BIGINT AS at_ms, st AS from_state, 'OK' AS to_state, 'deleted' AS reason, f1 AS first_triggered_at FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rn DESC) AS nth FROM m) WHERE nth = 1 AND st IS NOT NULL"),
)


def redefined(s, d):
    """Monitors whose threshold is their number of evaluations; later definitions round it to an even number, and some monitors are gone."""
    counts = evals(s, d).groupBy("monitor_id").agg(F.count("*").alias("n"))
    stored = counts.select("monitor_id", F.col("n").alias("critical")).select("monitor_id", state.definition_hash(["critical"]).alias("hash"))
    later = counts.where("monitor_id % 3 <> 2").select("monitor_id", F.expr("n div 2 * 2").alias("critical"))
    groups = mon.open_groups(trans(s, d)).select("monitor_id", "group_key", F.col("to_state").alias("state"), "first_triggered_at", "last_triggered_at")
    return state.redefine(groups, stored, later, NOW).select("monitor_id", "group_key", "at_ms", "from_state", "reason")


register(
    "state_redefine",
    redefined,
    monitors_sql(f"SELECT l.monitor_id, group_key, {NOW}::BIGINT AS at_ms, to_state AS from_state, CASE WHEN l.monitor_id % 3 = 2 THEN 'deleted' ELSE 'definition_changed' END AS reason FROM latest l JOIN (SELECT monitor_id, count(*) AS n FROM evals GROUP BY monitor_id) e USING (monitor_id) WHERE l.reason NOT IN ('expired', 'definition_changed', 'deleted') AND (l.monitor_id % 3 = 2 OR n % 2 = 1)"),
)
SEV = "CASE to_state WHEN 'Alert' THEN 3 WHEN 'Warn' THEN 2 WHEN 'No Data' THEN 1 ELSE 0 END"
OF_SEV = "CASE max(" + SEV + ") WHEN 3 THEN 'Alert' WHEN 2 THEN 'Warn' WHEN 1 THEN 'No Data' ELSE 'OK' END"
OPEN = "latest WHERE reason NOT IN ('expired', 'definition_changed', 'deleted')"
register("state_overall", lambda s, d: mon.state_overall(mon.latest_states(trans(s, d)), ["monitor_id"], "to_state"), monitors_sql(f"SELECT monitor_id, {OF_SEV} AS state FROM latest GROUP BY monitor_id"))
register(
    "state_restore",
    lambda s, d: mon.open_groups(trans(s, d)).join(
        evals(s, d).where(F.col("at_ms") > NOW - 2 * DAY * 1000).groupBy("monitor_id", "group_key").agg(F.max("at_ms").alias("last_seen"), F.max(F.when(F.col("value").isNotNull(), F.col("at_ms"))).alias("last_point")), ["monitor_id", "group_key"], "left"
    ).select("monitor_id", "group_key", F.col("to_state").alias("state"), "last_seen", "last_point"),
    monitors_sql(f"SELECT l.monitor_id, l.group_key, l.to_state AS state, e.last_seen, e.last_point FROM (SELECT * FROM {OPEN}) l LEFT JOIN (SELECT monitor_id, group_key, max(at_ms) AS last_seen, max(CASE WHEN value IS NOT NULL THEN at_ms END) AS last_point FROM evals WHERE at_ms > {NOW - 2 * DAY * 1000} GROUP BY ALL) e USING (monitor_id, group_key)"),
)
register("mon_transition_rows", lambda s, d: trans(s, d).select("monitor_id", "group_key", "at_ms", "to_state", "reason", F.when(F.col("to_state") != "No Data", F.col("value")).alias("value"), "inserted_at"), monitors_sql("SELECT monitor_id, group_key, at_ms, to_state, reason, CASE WHEN to_state <> 'No Data' THEN value END AS value, inserted_at FROM trans"))
register("mon_evaluation_rows", lambda s, d: evals(s, d).where("outcome = 'judged'").drop("event_id"), monitors_sql("SELECT monitor_id, group_key, at_ms, value, outcome FROM evals WHERE outcome = 'judged'"))
register("mon_skip_row", lambda s, d: evals(s, d).where("outcome = 'skipped'").groupBy("monitor_id", "at_ms").agg(F.count("*").alias("skipped")), monitors_sql("SELECT monitor_id, at_ms, count(*) AS skipped FROM evals WHERE outcome = 'skipped' GROUP BY ALL"))
COUNTS = ", ".join(f"CAST(sum(CASE WHEN to_state = '{k}' THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for k, n in (("Alert", "alert"), ("Warn", "warn"), ("No Data", "no_data"), ("OK", "ok")))
register("mon_status", lambda s, d: mon.mon_status(trans(s, d)), monitors_sql(f"SELECT monitor_id, {OF_SEV} AS state, {COUNTS}, max(last_triggered_at) AS last_triggered_at FROM {OPEN} GROUP BY monitor_id"))
DUE = f"SELECT t.monitor_id, t.group_key, t.at_ms, t.to_state FROM trans t WHERE inserted_at > {NOW - DAY * 1000} AND inserted_at <= {NOW} AND reason NOT IN ('no_data_shown', 'expired', 'definition_changed', 'deleted') AND NOT (reason = 'new' AND to_state = 'OK') AND NOT EXISTS (SELECT 1 FROM notes n WHERE n.monitor_id = t.monitor_id AND n.group_key = t.group_key AND n.transition_at = t.at_ms) ORDER BY inserted_at, monitor_id, group_key LIMIT 1000"
register("notify_due", lambda s, d: mon.notify_due(trans(s, d), notes(s, d), NOW - 2 * DAY * 1000, NOW).select("monitor_id", "group_key", "at_ms", "to_state"), monitors_sql(DUE))
register(
    "notify_mark",
    lambda s, d: mon.notify_due(trans(s, d), notes(s, d), NOW - 2 * DAY * 1000, NOW).select("monitor_id", "group_key", F.col("at_ms").alias("transition_at"), F.lit("stub").alias("channel")).dropDuplicates(["monitor_id", "group_key", "transition_at"]),
    monitors_sql(f"SELECT monitor_id, group_key, at_ms AS transition_at, 'stub' AS channel FROM ({DUE})"),
)

# 2.17 sketches
GAMMA = repr(sketch.LOG_GAMMA)
KEY = f"CASE WHEN abs({{0}}) < 1e-9 THEN 0 WHEN {{0}} < 0 THEN -CAST(round_even(ln(abs({{0}})) / {GAMMA}, 0) + 1338 AS INT) ELSE CAST(round_even(ln(abs({{0}})) / {GAMMA}, 0) + 1338 AS INT) END"
SIGNED = "CASE WHEN value < 3 THEN -value ELSE value END"


def signed(s, d):
    v = F.col("value")
    return points(s, d).withColumn("value", F.when(v < 3, -v).otherwise(v))


register("sketch_key", lambda s, d: signed(s, d).groupBy(sketch.sketch_key(F.col("value")).alias("k")).agg(F.count("*").alias("n")), f"WITH {POINTS_SQL}, x AS (SELECT {SIGNED} AS v FROM pts) SELECT {KEY.format('v')} AS k, count(*) AS n FROM x GROUP BY 1")
register(
    "sketch_value",
    lambda s, d: signed(s, d).select(sketch.sketch_key(F.col("value")).alias("k")).distinct().select("k", F.round(sketch.sketch_value(F.col("k")), 6).alias("value")),
    f"WITH {POINTS_SQL}, x AS (SELECT {SIGNED} AS v FROM pts), k AS (SELECT DISTINCT {KEY.format('v')} AS k FROM x) SELECT k, round(CASE WHEN k = 0 THEN 0.0 WHEN k < 0 THEN -exp((abs(k) - 1338) * {GAMMA}) ELSE exp((abs(k) - 1338) * {GAMMA}) END, 6) AS value FROM k",
)


def flat(df, *keys):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rounded(df.withColumns({"bucket_keys": text("bucket_keys"), "bucket_counts": text("bucket_counts")}), "min", "max", "avg", "sum").select(*keys, "bucket_keys", "bucket_counts", "count", "min", "max", "avg", "sum")


SKETCHED = f"""WITH {POINTS_SQL}, x AS (SELECT metric, host, {SIGNED} AS v FROM pts), c AS (SELECT {{keys}}, {KEY.format('v')} AS k, count(*) AS n, min(v) AS lo, max(v) AS hi, sum(v) AS s FROM x GROUP BY ALL)
 SELECT {{keys}}, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS bucket_keys, string_agg(CAST(n AS VARCHAR), ',' ORDER BY k) AS bucket_counts, CAST(sum(n) AS BIGINT) AS count, round(min(lo), 6) AS min, round(max(hi), 6) AS max, round(sum(s) / sum(n), 6) AS avg, round(sum(s), 6) AS sum FROM c GROUP BY ALL"""
register("sketch_build", lambda s, d: flat(sketch.sketch_build(signed(s, d), ["metric", "host"]), "metric", "host"), SKETCHED.format(keys="metric, host"))
register("sketch_merge", lambda s, d: flat(sketch.sketch_merge(sketch.sketch_build(signed(s, d), ["metric", "host"]), ["metric"]), "metric"), SKETCHED.format(keys="metric"))
BACK = f"CASE WHEN k = 0 THEN 0.0 WHEN k < 0 THEN -exp((abs(k) - 1338) * {GAMMA}) ELSE exp((abs(k) - 1338) * {GAMMA}) END"
register(
    "sketch_summary",
    lambda s, d: rounded(sketch.sketch_summary(sketch.sketch_build(signed(s, d), ["metric"]), ["metric"]), "sum", "min", "max", digits=4),
    f"WITH {POINTS_SQL}, x AS (SELECT metric, {SIGNED} AS v FROM pts), c AS (SELECT metric, {KEY.format('v')} AS k, count(*) AS n FROM x GROUP BY ALL) SELECT metric, 'ok' AS state, CAST(sum(n) AS BIGINT) AS count, round(sum(n * {BACK}), 4) AS sum, round(min({BACK}), 4) AS min, round(max({BACK}), 4) AS max FROM c GROUP BY metric",
)
register(
    "sketch_quantile",
    lambda s, d: rounded(sketch.sketch_quantile(sketch.sketch_build(signed(s, d), ["metric"]), ["metric"], 0.95), "value"),
    f"WITH {POINTS_SQL}, x AS (SELECT metric, {SIGNED} AS v FROM pts), c AS (SELECT metric, {KEY.format('v')} AS b, count(*) AS n FROM x GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY metric ORDER BY b) AS run, sum(n) OVER (PARTITION BY metric) AS total FROM c), f AS (SELECT metric, min(b) AS k FROM r WHERE run > total * 0.95::DOUBLE GROUP BY metric) SELECT metric, round({BACK}, 6) AS value FROM f",
)
