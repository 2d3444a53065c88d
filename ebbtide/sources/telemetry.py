"""Telemetry tables derived from ordinary event, document and order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import TAGS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(column: str) -> Column:
    """Unix milliseconds of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column}) div 1000")


def points(events: DataFrame) -> DataFrame:
    """Metric points: one metric for each event type; tags env (may be absent), role (one or two values), canary (bare)."""
    user = F.col("user_id")
    none = F.lit(None).cast("array<string>")
    tags = F.map_filter(
        F.create_map(
            F.lit("env"), F.when(user % 5 != 0, F.array(F.concat(F.lit("e"), (user % 5).cast("string")))).otherwise(none),
            F.lit("role"), F.when(user % 2 == 0, F.array(F.lit("api"), F.lit("web"))).otherwise(F.array(F.lit("api"))),
            F.lit("canary"), F.when(user % 7 == 0, F.array(F.lit(""))).otherwise(none),
        ),
        lambda _, v: v.isNotNull(),
    ).cast(TAGS)
    return events.select(
        F.lit("default").alias("tenant_id"),
        epoch_ms("ts").alias("t_ms"),
        F.concat(F.lit("events."), "event_type").alias("metric"),
        F.when(user % 20 == 0, "").otherwise(F.concat(F.lit("host-"), (user % 20).cast("string"))).alias("host"),
        F.when(F.col("event_type") == "error", "COUNT").when(F.col("event_type") == "click", "RATE").otherwise("GAUGE").alias("metric_type"),
        F.when(user % 3 == 0, 0).otherwise(10).cast("long").alias("interval"),
        (F.col("value") / 7.0).alias("value"),  # a week's value for each day; it also keeps means off rounding ties
        tags.alias("tags"),
        "user_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def logs(documents: DataFrame) -> DataFrame:
    """Log rows: message, service, host, status and a minute-spaced timestamp."""
    return documents.select(
        F.lit("default").alias("tenant_id"),
        (F.lit(1704067200000) + F.col("doc_id") * 60000).alias("t_ms"),
        F.col("doc_id").alias("log_id"),
        F.col("lang").alias("host"),
        F.col("source").alias("service"),
        F.element_at(F.array(*map(F.lit, ("ok", "info", "warn", "error"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("status"),
        F.col("text").alias("message"),
    )


def check_runs(events: DataFrame) -> DataFrame:
    """Service-check runs: status by value, one check for each event type."""
    v = F.col("value")
    status = F.when(v < 20, "OK").when(v < 35, "WARNING").when(v < 60, "CRITICAL").otherwise("UNKNOWN")
    user = F.col("user_id")
    return events.select(
        F.lit("default").alias("tenant_id"),
        epoch_ms("ts").alias("t_ms"),
        F.concat(F.lit("check."), "event_type").alias("check_name"),
        F.concat(F.lit("host-"), (user % 20).cast("string")).alias("host"),
        status.alias("status"),
        F.create_map(F.lit("env"), F.array(F.concat(F.lit("e"), (user % 5).cast("string")))).cast(TAGS).alias("tags"),
        "event_id",
    )


#: The same tables for DuckDB, as common table expressions.
POINTS_SQL = """pts AS (
  SELECT 'default' AS tenant_id, epoch_us(ts) // 1000 AS t_ms, 'events.' || event_type AS metric,
         CASE WHEN user_id % 20 = 0 THEN '' ELSE 'host-' || (user_id % 20) END AS host,
         CASE event_type WHEN 'error' THEN 'COUNT' WHEN 'click' THEN 'RATE' ELSE 'GAUGE' END AS metric_type,
         CASE WHEN user_id % 3 = 0 THEN 0::BIGINT ELSE 10::BIGINT END AS ival, value / 7.0::DOUBLE AS value, user_id,
         CASE WHEN user_id % 5 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['e' || (user_id % 5)] END AS env,
         CASE WHEN user_id % 2 = 0 THEN ['api', 'web'] ELSE ['api'] END AS role,
         CASE WHEN user_id % 7 = 0 THEN [''] ELSE CAST([] AS VARCHAR[]) END AS canary,
         CAST(json_extract_string(props, '$.k') AS INT) AS k
  FROM events)"""
LOGS_SQL = """logs AS (
  SELECT 1704067200000 + doc_id * 60000 AS t_ms, doc_id AS log_id, lang AS host, source AS service,
         ['ok', 'info', 'warn', 'error'][doc_id % 4 + 1] AS status, text AS message FROM documents)"""
CHECKS_SQL = """runs AS (
  SELECT epoch_us(ts) // 1000 AS t_ms, 'check.' || event_type AS check_name, 'host-' || (user_id % 20) AS host,
         CASE WHEN value < 20 THEN 'OK' WHEN value < 35 THEN 'WARNING' WHEN value < 60 THEN 'CRITICAL' ELSE 'UNKNOWN' END AS status,
         'e' || (user_id % 5) AS env, event_id FROM events)"""


def transitions(events: DataFrame) -> DataFrame:
    """Monitor transitions: one for each event, keyed by monitor, group and time."""
    user, v = F.col("user_id"), F.col("value")
    reason = F.when(F.col("event_type") == "signup", "new").when(F.col("event_type") == "view", "expired").when(F.col("event_type") == "purchase", "recovery")
    to = F.when(F.col("event_type") == "purchase", "OK").when(v < 20, "OK").when(v < 35, "Warn").when(v < 60, "Alert").otherwise("No Data")
    at = epoch_ms("ts")
    return events.select(
        (user % 5).alias("monitor_id"),
        F.concat(F.lit("host:"), (user % 20).cast("string")).alias("group_key"),
        at.alias("at_ms"),
        to.alias("to_state"),
        reason.otherwise("threshold").alias("reason"),
        F.when(to.isin("Alert", "Warn"), at).alias("first_triggered_at"),
        F.when(to.isin("Alert", "Warn"), at).alias("last_triggered_at"),
        (at + 500).alias("inserted_at"),
        "value",
        "event_id",
    )


def evaluations(events: DataFrame) -> DataFrame:
    """Monitor evaluations: every third has no value."""
    user = F.col("user_id")
    return events.select(
        (user % 5).alias("monitor_id"),
        F.concat(F.lit("host:"), (user % 20).cast("string")).alias("group_key"),
        epoch_ms("ts").alias("at_ms"),
        F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 3 != 0, "judged").otherwise("skipped").alias("outcome"),
        "event_id",
    )


def notifications(events: DataFrame) -> DataFrame:
    """Notifications of every fourth transition, each written twice."""
    rows = transitions(events).where(F.col("event_id") % 4 == 0)
    once = rows.select("monitor_id", "group_key", F.col("at_ms").alias("transition_at"), F.lit("stub").alias("channel"))
    return once.unionAll(once)


MONITORS_SQL = """ev AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events),
trans AS (
  SELECT user_id % 5 AS monitor_id, 'host:' || (user_id % 20) AS group_key, ms AS at_ms,
         CASE WHEN event_type = 'purchase' THEN 'OK' WHEN value < 20 THEN 'OK' WHEN value < 35 THEN 'Warn' WHEN value < 60 THEN 'Alert' ELSE 'No Data' END AS to_state,
         CASE event_type WHEN 'signup' THEN 'new' WHEN 'view' THEN 'expired' WHEN 'purchase' THEN 'recovery' ELSE 'threshold' END AS reason,
         ms + 500 AS inserted_at, value, event_id FROM ev),
evals AS (SELECT user_id % 5 AS monitor_id, 'host:' || (user_id % 20) AS group_key, ms AS at_ms,
          CASE WHEN event_id % 3 <> 0 THEN value END AS value, CASE WHEN event_id % 3 <> 0 THEN 'judged' ELSE 'skipped' END AS outcome, event_id FROM ev),
notes AS (SELECT monitor_id, group_key, at_ms AS transition_at FROM trans WHERE event_id % 4 = 0),
latest AS (SELECT * FROM (SELECT *, CASE WHEN to_state IN ('Alert', 'Warn') THEN at_ms END AS last_triggered_at,
           row_number() OVER (PARTITION BY monitor_id, group_key ORDER BY at_ms DESC, inserted_at DESC) AS rn FROM trans) WHERE rn = 1)"""
