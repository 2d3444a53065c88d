"""Registered queries: payloads to facts. Bodies are built from the events table; every fiftieth is broken on purpose.

Expressions are in the part of SQL that Spark and DuckDB share, so each signal states once what its rows must be.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sketch import LOG_GAMMA
from ..operators import monitors as mon
from ..operators import product
from ..sources import normalise as norm
from ..sources.telemetry import epoch_ms, table
from .registry import register

EV = """ev AS (SELECT *, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000000 AS sec, user_id % 20 AS h, event_id % 4 AS q FROM events)"""
GOOD = f"WITH {EV}, good AS (SELECT * FROM ev WHERE event_id % 50 <> 0)"
HOST = "'host-' || CAST(h AS STRING)"
TAGS = ["'env:e' || CAST(user_id % 5 AS STRING)", "'role:api'", "'url:http://x'", "'canary'"]
#: A bucket's number, as the distributions have it.
KEY = f"CASE WHEN abs({{0}}) < 1e-9 THEN 0 WHEN {{0}} < 0 THEN -CAST(round_even(ln(abs({{0}})) / {LOG_GAMMA!r}, 0) + 1338 AS INT) ELSE CAST(round_even(ln(abs({{0}})) / {LOG_GAMMA!r}, 0) + 1338 AS INT) END"
TAG_TEXT = "'canary,env:e' || CAST(user_id % 5 AS STRING) || ',role:api,url:http://x'"


def made(x) -> Column:
    """A JSON value from nested dicts, lists and expressions."""
    if isinstance(x, dict):
        return F.struct(*[made(v).alias(k) for k, v in x.items()])
    return F.array(*map(made, x)) if isinstance(x, list) else F.expr(x)


def alike(x) -> bool:
    """Whether one struct can say it: no list of several members, which may differ."""
    return all(map(alike, x.values())) if isinstance(x, dict) else len(x) == 1 and alike(x[0]) if isinstance(x, list) else True


def fixed(x: str) -> bool:
    """Whether it is the same in every row."""
    return bool(re.fullmatch(r"'[^'\\\\\"]*'|\d+L", x))


def joined(x) -> Column:
    """JSON text of nested dicts, lists and expressions, of which the members of one list may differ.

    Neighbours that one struct can say are written together."""
    if isinstance(x, dict):
        parts, together = [], {}
        for k, v in [*x.items(), ("", [])]:
            if k and alike(v) and not (isinstance(v, str) and fixed(v)):
                together[k] = v
                continue
            if together:
                text = F.to_json(made(together), {"ignoreNullFields": "false"})
                parts.append(F.substring(text, F.lit(2), F.length(text) - 2))
                together = {}
            if k:
                parts.append(F.concat(F.lit(f'"{k}":'), joined(v)))
        return F.concat(F.lit("{"), *[c for n, part in enumerate(parts) for c in ([F.lit(",")] if n else []) + [part]], F.lit("}"))
    if isinstance(x, list):
        return F.concat(F.lit("["), *[c for n, v in enumerate(x) for c in ([F.lit(",")] if n else []) + [joined(v)]], F.lit("]"))
    if fixed(x):
        return F.lit(f'"{x[1:-1]}"' if x[0] == "'" else x[:-1])
    return F.btrim(F.to_json(F.array(F.expr(x))), F.lit("[]"))


ROWS_A_TASK = 1 << 16
UNLIKE = ("spans", "k8s_objects", "collector_proc")  # bodies with lists of unlike members


def landing(spark, d: str, intake: str, body) -> DataFrame:
    ev = table(spark, d, "events").withColumn("ms", epoch_ms("ts")).withColumns({"sec": F.expr("ms div 1000"), "h": F.expr("user_id % 20"), "q": F.expr("event_id % 4")})
    text = F.expr(body) if isinstance(body, str) else joined(body) if intake in UNLIKE else F.to_json(made(body))
    parts = max(spark.sparkContext.defaultParallelism, -(-table(spark, d, "events").count() // ROWS_A_TASK))
    ev = ev.repartition(parts)  # parsing is worth more than the exchange, and a task's rows stay as few however many there are and however files share them
    broken = F.expr("event_id % 50 = 0")
    return ev.select(
        F.lit("default").alias("tenant_id"),
        (F.col("ms") + 1000).alias("received_ms"),
        F.lit(intake).alias("intake"),
        F.concat(F.lit("/api/"), F.lit(intake), F.lit("?api_key=s3cret&v=1")).alias("path"),
        F.create_map(F.lit("api_key"), F.lit("s3cret"), F.lit("v"), F.lit("1")).alias("query"),
        F.when(broken, F.substring(text, 1, 20)).otherwise(text).alias("body"),
    )


def facts(spark, d: str, intake: str, body) -> DataFrame:
    return norm.normalise(landing(spark, d, intake, body), norm.SPECS[intake])[0]


def signal(name: str, intake: str, body, out: dict[str, str], sql: dict[str, str], change=lambda f: f) -> None:
    """Register ``name``: the facts' columns ``out`` must equal ``sql`` over the unbroken events."""
    columns = ", ".join(f"{v} AS {k}" for k, v in sql.items()).replace(" AS STRING)", " AS VARCHAR)")
    register(name, lambda s, d: change(facts(s, d, intake, body)).selectExpr(*[f"{v} AS {k}" for k, v in out.items()]), f"{GOOD} SELECT {columns} FROM good")


def with_tags(f: DataFrame) -> DataFrame:
    return f.withColumn("tag_text", F.array_join(mon.tag_list(), ","))


SERIES2 = {"series": [{"metric": "'m.' || event_type", "type": "q", "interval": "10", "points": [{"timestamp": "sec", "value": "value"}], "resources": [{"name": HOST, "type": "'host'"}, {"name": "'dev' || CAST(q AS STRING)", "type": "'device'"}], "tags": TAGS, "odd": "event_id"}]}
signal(
    "norm_series_v2", "series_v2", SERIES2,
    {"metric": "metric", "t_ms": "t_ms", "value": "value", "metric_type": "metric_type", "host": "host", "device": "resources['device']", "tag_text": "tag_text"},
    {"metric": "'m.' || event_type", "t_ms": "sec * 1000", "value": "value", "metric_type": "CASE q WHEN 0 THEN 'UNSPECIFIED' WHEN 1 THEN 'COUNT' WHEN 2 THEN 'RATE' ELSE 'GAUGE' END", "host": HOST, "device": "'dev' || CAST(q AS STRING)", "tag_text": TAG_TEXT},
    lambda f: with_tags(norm.metric_rows(f)),
)
signal("norm_tags", "series_v2", SERIES2, {"env": "tags['env'][0]", "url": "tags['url'][0]", "bare": "tags['canary'][0]"}, {"env": "'e' || CAST(user_id % 5 AS STRING)", "url": "'http://x'", "bare": "''"})
signal("norm_extra", "series_v2", SERIES2, {"odd": "extra['odd']", "n": "size(extra)"}, {"odd": "CAST(event_id AS STRING)", "n": "1"})
SERIES1 = """concat('{"series":[{"metric":"m.', event_type, '","type":"', CASE q WHEN 0 THEN 'rate' WHEN 1 THEN 'Count' WHEN 2 THEN 'FOO' ELSE '' END, '","host":"host-', h, '","device":"sda","unit":"byte","odd":{"deep":', h, '},"points":[[', sec, ',', value, '],[', sec, '],["x",1]],"tags":["a:b"]}]}')"""
signal(
    "norm_series_v1", "series_v1",
    SERIES1,
    {"metric": "metric", "t_ms": "t_ms", "value": "value", "metric_type": "metric_type", "host": "host", "device": "resources['device']", "unit": "unit", "odd": "get_json_object(extra['odd'], '$.deep')"},
    {"metric": "'m.' || event_type", "t_ms": "sec * 1000", "value": "value", "metric_type": "CASE q WHEN 0 THEN 'RATE' WHEN 1 THEN 'COUNT' ELSE 'UNSPECIFIED' END", "host": HOST, "device": "'sda'", "unit": "'byte'", "odd": "CAST(h AS STRING)"},
    lambda f: norm.metric_rows(f, 1),
)
signal(
    "norm_series_v1_bad_pairs", "series_v1", SERIES1, {"metric": "metric", "body": "body", "note": "note"},
    {"metric": "'m.' || event_type", "body": "unnest(['[' || CAST(sec AS STRING) || ']', '[\"x\",1]'])", "note": "unnest(['points[1]: expected a [timestamp, value] pair of numbers', 'points[2]: expected a [timestamp, value] pair of numbers'])"}, norm.bad_pairs,
)
signal(
    "norm_sketches", "sketches",
    {"sketches": [{"metric": "'d.' || event_type", "host": HOST, "tags": TAGS, "dogsketches": [{"ts": "sec", "cnt": "2L", "min": "value", "max": "value + 1", "avg": "value", "sum": "value * 2", "k": ["1338"], "n": ["2"]}]}]},
    {"metric": "metric", "t_ms": "p.ts * 1000", "count": "p.cnt", "lo": "p.min", "key": "p.k[0]"},
    {"metric": "'d.' || event_type", "t_ms": "sec * 1000", "count": "2::BIGINT", "lo": "value", "key": "1338"},
    lambda f: f.withColumn("p", F.explode("points")),
)
K0, K1 = KEY.format("value"), KEY.format("(value + 1)")
signal(
    "norm_distribution_points", "distribution_points",
    {"series": [{"metric": "'d.' || event_type", "host": HOST, "points": [{"ts": "sec", "values": ["value", "value + 1", "value"]}]}]},
    {"metric": "metric", "t_ms": "t_ms", "host": "host", "keys": "array_join(transform(bucket_keys, k -> cast(k as string)), ',')", "counts": "array_join(transform(bucket_counts, k -> cast(k as string)), ',')", "n": "count", "lo": "round(min, 6)", "hi": "round(max, 6)", "total": "round(sum, 6)"},
    {"metric": "'d.' || event_type", "t_ms": "sec * 1000", "host": HOST, "keys": f"CASE WHEN {K0} = {K1} THEN CAST({K0} AS STRING) ELSE CAST({K0} AS STRING) || ',' || CAST({K1} AS STRING) END", "counts": f"CASE WHEN {K0} = {K1} THEN '3' ELSE '2,1' END", "n": "3::BIGINT", "lo": "round(value, 6)", "hi": "round(value + 1, 6)", "total": "round(value * 3 + 1, 6)"},
    norm.distribution_rows,
)
signal(
    "norm_check_runs", "check_runs", {"check": "'c.' || event_type", "host_name": HOST, "status": "q + 1", "timestamp": "CASE WHEN q = 0 THEN 0L ELSE sec END", "tags": TAGS, "message": "'m'"},
    {"check_name": "check_name", "host": "host", "status": "status", "t_ms": "t_ms", "timestamp_source": "timestamp_source"},
    {"check_name": "'c.' || event_type", "host": HOST, "status": "CASE q WHEN 0 THEN 'WARNING' WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'UNKNOWN' ELSE '4' END", "t_ms": "CASE WHEN q = 0 THEN ms + 1000 ELSE sec * 1000 END", "timestamp_source": "CASE WHEN q = 0 THEN 'arrival' ELSE 'sender' END"},
    lambda f: f.withColumn("status", norm.named(F.col("status_code"), norm.CHECK_STATUS)),
)
LOG = {"message": "'said ' || event_type", "hostname": "''", "host": HOST, "dd_service": "event_type", "ddsource": "'src'", "level": "'INFO'", "status": "CASE q WHEN 0 THEN 'ERR' WHEN 1 THEN 'warning' END", "ddtags": "'env:e' || CAST(user_id % 5 AS STRING) || ',canary'", "timestamp": "CASE WHEN q = 3 THEN NULL ELSE ms END", "odd": "'x'"}
signal(
    "norm_logs", "logs", LOG,
    {"message": "message", "host": "host", "service": "service", "status": "status", "t_ms": "t_ms", "tag_text": "tag_text", "odd": "extra['odd']", "level": "extra['level']"},
    {"message": "'said ' || event_type", "host": HOST, "service": "event_type", "level": "'INFO'", "status": "CASE q WHEN 0 THEN 'ERR' WHEN 1 THEN 'warning' ELSE '' END", "t_ms": "CASE WHEN q = 3 THEN ms + 1000 ELSE ms END", "tag_text": "'canary,env:e' || CAST(user_id % 5 AS STRING)", "odd": "'x'"},
    with_tags,
)
signal("arrival_time_fallback", "logs", LOG, {"t_ms": "t_ms", "timestamp_source": "timestamp_source"}, {"t_ms": "CASE WHEN q = 3 THEN ms + 1000 ELSE ms END", "timestamp_source": "CASE WHEN q = 3 THEN 'arrival' ELSE 'timestamp_ms' END"})
signal("late_old_event_time", "logs", LOG, {"t_ms": "t_ms", "lag": "received_ms - t_ms", "day": "t_ms div 86400000"}, {"t_ms": "CASE WHEN q = 3 THEN ms + 1000 ELSE ms END", "lag": "CASE WHEN q = 3 THEN 0::BIGINT ELSE 1000::BIGINT END", "day": "CASE WHEN q = 3 THEN ms + 1000 ELSE ms END // 86400000"})
COMPACT = """concat('{"@m":"said ', event_type, '","@l":"Warning","@t":"', date_format(timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), '","timestamp":"soon","dd_service":"', event_type, '","hostname":"","deep":{"a":', q, '}}')"""
signal(
    "norm_logs_compact", "logs", COMPACT,
    {"message": "message", "service": "service", "status": "status", "t_ms": "t_ms", "source": "timestamp_source", "unread": "extra['timestamp']", "deep": "extra['deep']"},
    {"message": "'said ' || event_type", "service": "event_type", "status": "'warn'", "t_ms": "ms", "source": "'compact_string'", "unread": "'soon'", "deep": "'{\"a\":' || CAST(q AS STRING) || '}'"},
)
LINES = """concat('{"message":"one","n":{"a":', q, '}}\\r\\n{"message":"two"}\\r\\n{"message":"three"}\\r\\n')"""
signal("norm_logs_lines", "logs", LINES, {"message": "message", "n": "extra['n']"}, {"message": "unnest(['one', 'two', 'three'])", "n": "unnest(['{\"a\":' || CAST(q AS STRING) || '}', NULL, NULL])"})
FIRST_SPAN = {"trace_id": "9007199254740993L + event_id", "span_id": "event_id", "parent_id": "0L", "service": "event_type", "name": "'web'", "resource": "'GET'", "start": "ms", "duration": "user_id", "error": "q div 3", "meta": {"span.kind": "'server'", "_dd.p.tid": "'00000000000000ff'"}, "metrics": {"rate": "value"}, "attributes": {"route": {"string": "'/x'"}, "size": {"int": "h"}}, "odd": {"a": "q"}, "span_links": [{"trace_id": "event_id", "trace_id_high": "1L", "span_id": "2L", "flags": "3L"}, {"trace_id": "7L", "trace_id_high": "0L", "span_id": "8L", "flags": "0L"}], "span_events": [{"time_unix_nano": "ms", "name": "'exception'"}]}
NEXT_SPAN = {"trace_id": "9007199254740993L + event_id", "span_id": "event_id + 1000000", "parent_id": "event_id", "service": "'db'", "name": "'sql'", "resource": "'q'", "start": "ms", "duration": "1L", "error": "0L", "meta": {"span.kind": "'client'", "_dd.p.tid": "'zz'"}, "metrics": {"rate": "0.0D"}}
#: Chunks of unlike members: each as JSON text, put in where the list stands.
CHUNKS = [{"priority": "1L", "origin": "'lambda'", "spans": [FIRST_SPAN]}, {"priority": "2L", "droppedTrace": "true", "odd": "'c'", "spans": [NEXT_SPAN]}]
SPAN = {"env": "'prod'", "agentVersion": "'7'", "tracerPayloads": [{"languageName": "'py'", "appVersion": "'1.' || CAST(q AS STRING)", "tags": {"t": "'1'"}, "chunks": CHUNKS}]}
signal(
    "norm_spans", "spans", SPAN,
    {"trace_id": "trace_id", "trace_id_high": "trace_id_high", "span_id": "span_id", "parent_id": "nullif(parent_id, 0)", "env": "env", "kind": "kind", "language": "language", "app_version": "app_version", "priority": "priority", "dropped": "coalesce(dropped_trace, false)", "links": "array_join(transform(link_trace_id, x -> cast(x as string)), ',')", "flags": "array_join(transform(link_flags, x -> cast(x as string)), ',')", "events": "array_join(event_name, ',')", "odd": "coalesce(extra['odd'], extra['$1.odd'])"},
    {"trace_id": "9007199254740993 + event_id", "trace_id_high": "unnest([255, 0])::BIGINT", "span_id": "unnest([event_id, event_id + 1000000])", "parent_id": "unnest([NULL, event_id])", "env": "'prod'", "kind": "unnest(['server', 'client'])", "language": "'py'", "app_version": "'1.' || CAST(q AS STRING)", "priority": "unnest([1, 2])::BIGINT", "dropped": "unnest([false, true])", "links": "unnest([CAST(event_id AS STRING) || ',7', ''])", "flags": "unnest(['3,0', ''])", "events": "unnest(['exception', ''])", "odd": "unnest(['{\"a\":' || CAST(q AS STRING) || '}', 'c'])"},
    norm.span_rows,
)
signal("norm_span_attributes", "spans", SPAN, {"span_id": "span_id", "kind": "meta['span.kind']", "rate": "metrics['rate']", "route": "meta['route']", "size": "metrics['size']"}, {"span_id": "unnest([event_id, event_id + 1000000])", "kind": "unnest(['server', 'client'])", "rate": "unnest([value, 0.0])", "route": "unnest(['/x', NULL])", "size": "unnest([CAST(h AS DOUBLE), NULL])"}, norm.span_rows)
SIMPLE: dict[str, tuple] = {
    "norm_events": ("events", {"title": "'t' || event_type", "text": "'x'", "host": HOST, "alert_type": "CASE WHEN q = 0 THEN 'bogus' ELSE 'error' END", "date_happened": "sec"}, {"title": "title", "alert": "CASE WHEN alert_type IN ('error', 'warning', 'info', 'success') THEN alert_type ELSE 'info' END", "t_ms": "t_ms"}, {"title": "'t' || event_type", "alert": "CASE WHEN q = 0 THEN 'info' ELSE 'error' END", "t_ms": "sec * 1000"}),
    "norm_apm_stats": ("apm_stats", {"Start": "ms", "Duration": "10L", "Stats": [{"Service": "event_type", "Resource": "'r'", "Hits": "user_id", "Errors": "q", "Duration": "h"}]}, {"service": "service", "hits": "hits", "errors": "errors", "bucket_start": "bucket_start", "bucket_ns": "bucket_duration_ns"}, {"service": "event_type", "hits": "user_id", "errors": "q", "bucket_start": "ms", "bucket_ns": "10::BIGINT"}),
    "norm_processes": ("processes", {"hostName": HOST, "groupId": "sec", "groupSize": "2L", "processes": [{"pid": "event_id", "command": {"exe": "'/bin/' || event_type"}, "user": {"name": "'u'"}, "cpu": {"totalPct": "value"}, "memory": {"rss": "user_id"}}]}, {"pid": "pid", "command": "command", "host": "host", "cpu": "cpu", "rss": "rss", "group_id": "group_id"}, {"pid": "event_id", "command": "'/bin/' || event_type", "host": HOST, "cpu": "value", "rss": "user_id", "group_id": "sec"}),
    "norm_containers": ("containers", {"hostName": HOST, "containers": [{"id": "'c' || CAST(user_id AS STRING)", "image": "event_type", "cpu": "value", "memRss": "user_id", "state": "'run'", "tags": TAGS}]}, {"container_id": "container_id", "image": "image", "cpu": "cpu", "env": "tags['env'][0]"}, {"container_id": "'c' || CAST(user_id AS STRING)", "image": "event_type", "cpu": "value", "env": "'e' || CAST(user_id % 5 AS STRING)"}),
    "norm_connections": ("connections", {"hostName": HOST, "connections": [{"pid": "event_id", "laddr": {"ip": "'10.0.0.' || CAST(h AS STRING)"}, "raddr": {"ip": "'10.1.0.' || CAST(q AS STRING)", "port": "443L"}, "lastBytesSent": "user_id"}]}, {"pid": "pid", "src": "src", "dst": "dst", "port": "port", "bytes_sent": "bytes_sent"}, {"pid": "event_id", "src": "'10.0.0.' || CAST(h AS STRING)", "dst": "'10.1.0.' || CAST(q AS STRING)", "port": "443::BIGINT", "bytes_sent": "user_id"}),
    "norm_k8s_resources": ("k8s_resources", {"kind": "'Pod'", "clusterId": "'k'", "items": [{"metadata": {"ownerReferences": [{"kind": "'ReplicaSet'", "name": "event_type", "uid": "'o'"}], "namespace": "event_type", "name": "'p' || CAST(user_id AS STRING)", "uid": "'u' || CAST(user_id AS STRING)", "resourceVersion": "CAST(event_id AS STRING)", "labels": {"app": "event_type"}}, "status": {"phase": "CASE WHEN q = 0 THEN 'Failed' ELSE 'Running' END", "conditions": [{"type": "'Ready'", "status": "CASE WHEN q = 0 THEN 'False' ELSE 'True' END"}], "hostIP": "'10.0.0.1'"}, "spec": {"replicas": "q"}}]}, {"kind": "kind", "namespace": "namespace", "name": "name", "version": "resource_version", "phase": "phase", "desired": "desired", "app": "labels['app']", "owner": "owners[0].name", "is_ready": "filter(conditions, c -> c.type = 'Ready')[0].status", "unread": "extra['status.hostIP']"}, {"kind": "'Pod'", "namespace": "event_type", "name": "'p' || CAST(user_id AS STRING)", "version": "CAST(event_id AS STRING)", "phase": "CASE WHEN q = 0 THEN 'Failed' ELSE 'Running' END", "desired": "q", "app": "event_type", "owner": "event_type", "is_ready": "CASE WHEN q = 0 THEN 'False' ELSE 'True' END", "unread": "'10.0.0.1'"}),
    "norm_k8s_manifests": ("k8s_manifests", {"clusterId": "'k'", "manifests": [{"uid": "'u' || CAST(user_id AS STRING)", "kind": "CASE WHEN q = 0 THEN NULL ELSE 'Pod' END", "resourceVersion": "CAST(event_id AS STRING)", "content": {"kind": "'FromContent'"}}]}, {"uid": "uid", "kind": "kind", "version": "version"}, {"uid": "'u' || CAST(user_id AS STRING)", "kind": "CASE WHEN q = 0 THEN 'FromContent' ELSE 'Pod' END", "version": "CAST(event_id AS STRING)"}),
    "norm_container_events": ("container_events", {"host": HOST, "eventType": "'delete'", "events": [{"containerID": "'c' || CAST(user_id AS STRING)", "exitCode": "CASE WHEN q = 0 THEN NULL ELSE q END", "exitTimestamp": "sec"}]}, {"container_id": "container_id", "exit_code": "exit_code", "exited_at": "exited_at", "host": "host"}, {"container_id": "'c' || CAST(user_id AS STRING)", "exit_code": "CASE WHEN q = 0 THEN NULL ELSE q END", "exited_at": "sec", "host": HOST}),
    "norm_container_images": ("container_images", {"images": [{"digest": "CASE WHEN q = 0 THEN NULL ELSE 'sha' || CAST(h AS STRING) END", "id": "'id' || CAST(h AS STRING)", "name": "event_type", "size": "user_id - 100", "layers": [{"size": "user_id"}, {"size": "h"}], "tags": TAGS}]}, {"digest": "digest", "size": "greatest(size, 0)", "clamped": "size < 0", "layers": "aggregate(layers, 0L, (a, l) -> a + l.size)"}, {"digest": "CASE WHEN q = 0 THEN 'id' || CAST(h AS STRING) ELSE 'sha' || CAST(h AS STRING) END", "size": "greatest(user_id - 100, 0)", "clamped": "user_id < 100", "layers": "user_id + h"}),
    "norm_dbm_events": ("dbm_events", {"host": HOST, "ddsource": "'pg'", "ddtags": "'env:x'", "timestamp": "ms", "db": {"statement": "'select ' || event_type", "query_signature": "CAST(q AS STRING)"}}, {"host": "host", "track": "track", "statement": "statement", "signature": "signature", "t_ms": "t_ms", "env": "tags['env'][0]"}, {"host": HOST, "track": "'pg'", "statement": "'select ' || event_type", "signature": "CAST(q AS STRING)", "t_ms": "ms", "env": "'x'"}),
    "norm_ndm_devices": ("ndm_devices", {"namespace": "'n'", "devices": [{"id": "'d' || CAST(h AS STRING)", "ip_address": "'10.0.0.1'", "vendor": "event_type", "status": "q", "tags": TAGS}], "interfaces": [{"device_id": "'d' || CAST(h AS STRING)", "index": "q", "name": "'eth'"}]}, {"device_id": "device_id", "vendor": "vendor", "status": "status", "namespace": "namespace"}, {"device_id": "'d' || CAST(h AS STRING)", "vendor": "event_type", "status": "q", "namespace": "'n'"}),
    "norm_ndm_interfaces": ("ndm_interfaces", {"namespace": "'n'", "devices": [{"id": "'d' || CAST(h AS STRING)"}], "interfaces": [{"device_id": "'d' || CAST(h AS STRING)", "index": "q", "name": "'eth' || CAST(q AS STRING)"}]}, {"device_id": "device_id", "idx": "index", "name": "name"}, {"device_id": "'d' || CAST(h AS STRING)", "idx": "q", "name": "'eth' || CAST(q AS STRING)"}),
    "norm_snmp_traps": ("snmp_traps", {"trap": {"snmpTrapOID": "'1.3.' || CAST(h AS STRING)", "uptime": "user_id", "timestamp": "ms", "ddtags": "'env:x'"}}, {"oid": "oid", "uptime": "uptime", "t_ms": "t_ms"}, {"oid": "'1.3.' || CAST(h AS STRING)", "uptime": "user_id", "t_ms": "ms"}),
    "norm_netflow": ("netflow", {"source": {"ip": "'10.0.0.' || CAST(h AS STRING)"}, "destination": {"ip": "'10.1.0.' || CAST(q AS STRING)"}, "bytes": "user_id", "packets": "q", "ip_protocol": "'TCP'", "flush_timestamp": "ms"}, {"src": "src", "dst": "dst", "bytes": "bytes", "packets": "packets", "t_ms": "t_ms"}, {"src": "'10.0.0.' || CAST(h AS STRING)", "dst": "'10.1.0.' || CAST(q AS STRING)", "bytes": "user_id", "packets": "q", "t_ms": "ms"}),
    "norm_network_paths": ("network_paths", {"source": {"hostname": HOST}, "destination": {"hostname": "event_type"}, "timestamp": "ms", "hops": [{"ttl": "1L", "ip_address": "'10.0.0.1'", "rtt": "value"}, {"ttl": "2L", "ip_address": "'10.0.0.2'", "rtt": "value + 1"}]}, {"origin": "origin", "target": "target", "hops": "size(hops)", "last_rtt": "element_at(hops, -1).rtt"}, {"origin": HOST, "target": "event_type", "hops": "2", "last_rtt": "value + 1"}),
    "norm_security_events": ("security_events", {"agent": {"rule_id": "'r' || CAST(q AS STRING)"}, "evt": {"category": "event_type"}, "process": {"executable": {"path": "'/bin/sh'"}}, "timestamp": "ms", "ddtags": "'env:x'"}, {"rule": "rule", "category": "category", "process": "process", "t_ms": "t_ms"}, {"rule": "'r' || CAST(q AS STRING)", "category": "event_type", "process": "'/bin/sh'", "t_ms": "ms"}),
    "norm_sds": ("sds", {"scanId": "'s' || CAST(h AS STRING)", "results": [{"rule": "event_type", "resource": HOST, "matches": "q", "failed": "q = 0"}]}, {"scan_id": "scan_id", "rule": "rule", "matches": "matches", "failed": "failed"}, {"scan_id": "'s' || CAST(h AS STRING)", "rule": "event_type", "matches": "q", "failed": "q = 0"}),
    "norm_synthetics": ("synthetics", {"results": [{"testId": "'t' || CAST(h AS STRING)", "location": "event_type", "passed": "q > 0", "duration": "value"}]}, {"test_id": "test_id", "location": "location", "passed": "passed", "duration": "duration"}, {"test_id": "'t' || CAST(h AS STRING)", "location": "event_type", "passed": "q > 0", "duration": "value"}),
    "norm_telemetry": ("telemetry", {"request_type": "'app-started'", "application": {"service_name": "event_type"}, "payload": {"configuration": [{"name": "'a'", "value": "'1'", "origin": "'env'"}, {"name": "'b'", "value": "CAST(q AS STRING)", "origin": "'code'"}]}}, {"service": "service", "name": "name", "value": "value"}, {"service": "event_type", "name": "unnest(['a', 'b'])", "value": "unnest(['1', CAST(q AS STRING)])"}),
    "norm_ci_webhooks": ("ci_webhooks", {"delivery": "'d' || CAST(event_id AS STRING)", "action": "event_type", "repository": {"full_name": "'o/r'"}}, {"delivery": "delivery", "action": "action", "repository": "repository"}, {"delivery": "'d' || CAST(event_id AS STRING)", "action": "event_type", "repository": "'o/r'"}),
    "norm_ci_tests": ("ci_tests", {"metadata": {"env": "'ci'", "runtime": "'py'"}, "events": [{"type": "'test'", "content": {"resource": "'t' || CAST(h AS STRING)", "service": "event_type", "start": "ms", "duration": "user_id", "meta": {"status": "CASE WHEN q = 0 THEN 'fail' ELSE 'pass' END"}}}]}, {"test": "test", "suite": "suite", "status": "status", "env": "env", "duration": "duration"}, {"test": "'t' || CAST(h AS STRING)", "suite": "event_type", "status": "CASE WHEN q = 0 THEN 'fail' ELSE 'pass' END", "env": "'ci'", "duration": "user_id"}),
    "norm_git_commits": ("git_commits", {"meta": {"repository_url": "'git@x'"}, "data": [{"id": "'a' || CAST(event_id AS STRING)"}, {"id": "'b' || CAST(event_id AS STRING)"}]}, {"sha": "sha", "repository": "repository"}, {"sha": "unnest(['a' || CAST(event_id AS STRING), 'b' || CAST(event_id AS STRING)])", "repository": "'git@x'"}),
    "norm_hosts": ("hosts", {"internalHostname": HOST, "os": "'linux'", "agentVersion": "'7.' || CAST(q AS STRING)", "systemStats": {"platform": "'x86'", "pythonV": "'3'"}}, {"host": "host", "os": "os", "agent_version": "agent_version", "platform": "platform"}, {"host": HOST, "os": "'linux'", "agent_version": "'7.' || CAST(q AS STRING)", "platform": "'x86'"}),
    "norm_agent_metadata": ("agent_metadata", {"hostname": HOST, "uuid": "CAST(event_id AS STRING)", "agent_metadata": {"flavor": "event_type"}}, {"host": "host", "uuid": "uuid", "flavor": "payload['flavor']"}, {"host": HOST, "uuid": "CAST(event_id AS STRING)", "flavor": "event_type"}),
    "norm_debugger_logs": ("debugger_logs", {"service": "event_type", "message": "'m'", "timestamp": "ms", "ddtags": "'env:x'", "debugger": {"snapshot": {"probe": {"id": "'p' || CAST(q AS STRING)"}}}}, {"service": "service", "probe_id": "probe_id", "t_ms": "t_ms"}, {"service": "event_type", "probe_id": "'p' || CAST(q AS STRING)", "t_ms": "ms"}),
    "norm_profiles_meta": ("profiles_meta", {"family": "event_type", "start": "CAST(ms AS STRING)", "end": "CAST(ms + 60000 AS STRING)", "attachments": ["'cpu.pprof'"], "tags_profiler": "'env:x,canary'"}, {"family": "family", "started": "start", "n": "size(attachments)", "env": "tags['env'][0]"}, {"family": "event_type", "started": "CAST(ms AS STRING)", "n": "1", "env": "'x'"}),
}
SIMPLE |= {
    "norm_agent_checks": ("agent_checks", {"internalHostname": HOST, "agent_checks": [["'chk' || CAST(q AS STRING)", "event_type", "'i'", "'OK'", "''"]]}, {"name": "name", "source": "source", "status": "status", "host": "host"}, {"name": "'chk' || CAST(q AS STRING)", "source": "event_type", "status": "'OK'", "host": HOST}),
    "norm_process_groups": ("process_groups", {"internalHostname": HOST, "processes": [["'u'", "CAST(q AS STRING)", "'1.5'", "'0'", "'0'", "event_type", "CAST(user_id AS STRING)"]]}, {"user": "user", "cpu": "cpu", "name": "name", "pids": "pids"}, {"user": "'u'", "cpu": "CAST(q AS DOUBLE)", "name": "event_type", "pids": "user_id"}),
    "norm_pipeline_stats": ("pipeline_points", {"Service": "event_type", "Env": "'p'", "Stats": [{"Start": "ms", "Stats": [{"Hash": "9007199254740993L + event_id", "ParentHash": "event_id", "EdgeTags": ["'in'"]}, {"Hash": "event_id", "ParentHash": "0L", "EdgeTags": ["'out'"]}]}]}, {"service": "service", "hash": "hash", "parent_hash": "parent_hash", "bucket_start": "bucket_start"}, {"service": "event_type", "hash": "unnest([9007199254740993 + event_id, event_id])", "parent_hash": "unnest([event_id, 0])", "bucket_start": "ms"}),
    "norm_pipeline_stats_backlogs": ("pipeline_backlogs", {"Service": "event_type", "Stats": [{"Start": "ms", "Backlogs": [{"Value": "user_id", "Tags": ["'t'"]}]}]}, {"service": "service", "value": "value", "bucket_start": "bucket_start"}, {"service": "event_type", "value": "user_id", "bucket_start": "ms"}),
    "norm_dsm_messages": ("dsm_messages", {"topic": "event_type", "partition": "q", "offset": "event_id", "message": "'m'", "b": "1", "a": "2"}, {"topic": "topic", "partition": "partition", "pos": "offset", "names": "array_join(array_sort(map_keys(extra)), ',')"}, {"topic": "event_type", "partition": "q", "pos": "event_id", "names": "'a,b'"}),
    "norm_process_stats": ("process_stats", {"hostName": HOST, "stats": [{"pid": "event_id", "cpu": {"totalPct": "value"}, "memory": {"rss": "user_id"}, "threads": "q"}]}, {"pid": "pid", "cpu": "cpu", "rss": "rss", "threads": "threads"}, {"pid": "event_id", "cpu": "value", "rss": "user_id", "threads": "q"}),
    "norm_discoveries": ("discoveries", {"hostName": HOST, "groupSize": "3L", "processDiscoveries": [{"pid": "event_id", "command": {"exe": "event_type"}, "user": {"name": "'u'"}}]}, {"pid": "pid", "command": "command", "host": "host", "group_size": "group_size"}, {"pid": "event_id", "command": "event_type", "host": HOST, "group_size": "3::BIGINT"}),
    "norm_snapshots": ("snapshots", {"hostName": HOST, "kind": "event_type", "groupId": "sec", "groupSize": "q", "agentVersion": "'7'"}, {"host": "host", "kind": "kind", "group_id": "group_id", "group_size": "group_size"}, {"host": HOST, "kind": "event_type", "group_id": "sec", "group_size": "q"}),
    "norm_container_stats": ("container_stats", {"hostName": HOST, "source": "'stats'", "containerStats": [{"id": "'c' || CAST(q AS STRING)", "totalPct": "value", "memRss": "user_id"}]}, {"container_id": "container_id", "cpu": "cpu", "rss": "rss", "lim": "limit", "source": "source"}, {"container_id": "'c' || CAST(q AS STRING)", "cpu": "value", "rss": "user_id", "lim": "NULL::BIGINT", "source": "'stats'"}),
    "norm_connections_payload": ("connections_payload", {"hostName": HOST, "tagsPool": ["'a'", "event_type"], "connections": [{"pid": "event_id", "tags": ["1", "0"]}]}, {"pid": "pid", "tags": "array_join(transform(tag_indexes, i -> pool[i]), ',')"}, {"pid": "event_id", "tags": "event_type || ',a'"}),
    "norm_usm_db": ("usm_db", {"hostName": HOST, "connections": [{"pid": "event_id", "dbAggregations": [{"tableName": "event_type", "operation": "'select'", "count": "q"}]}]}, {"pid": "pid", "table_name": "table_name", "n": "count"}, {"pid": "event_id", "table_name": "event_type", "n": "q"}),
    "norm_k8s_cluster": ("k8s_cluster", {"clusterId": "event_type", "cluster": {"nodeCount": "q", "kubeletVersions": {"v1": "q", "v2": "h"}, "cpuAllocatable": "user_id"}}, {"cluster_id": "cluster_id", "nodes": "nodes", "v2": "versions['v2']", "cpu": "cpu"}, {"cluster_id": "event_type", "nodes": "q", "v2": "h", "cpu": "user_id"}),
    "norm_k8s_actions": ("k8s_actions", {"results": [{"actionId": "CAST(event_id AS STRING)", "resource": {"kind": "'Pod'", "name": "event_type"}, "status": "'ok'"}]}, {"action_id": "action_id", "kind": "kind", "name": "name", "status": "status"}, {"action_id": "CAST(event_id AS STRING)", "kind": "'Pod'", "name": "event_type", "status": "'ok'"}),
    "norm_ecs_tasks": ("ecs_tasks", {"clusterName": "'c'", "tasks": [{"arn": "CAST(event_id AS STRING)", "family": "event_type", "knownStatus": "'RUNNING'", "containers": [{"name": "'a'"}, {"name": "'b'"}], "tags": TAGS}]}, {"arn": "arn", "family": "family", "status": "status", "n": "size(containers)", "cluster": "cluster"}, {"arn": "CAST(event_id AS STRING)", "family": "event_type", "status": "'RUNNING'", "n": "2", "cluster": "'c'"}),
    "norm_ndm_ips": ("ndm_ips", {"namespace": "'n'", "ip_addresses": [{"interface_id": "'d:' || CAST(q AS STRING)", "ip_address": "'10.0.0.' || CAST(h AS STRING)", "prefixlen": "24L"}]}, {"interface": "interface", "ip": "ip", "prefix": "prefix"}, {"interface": "'d:' || CAST(q AS STRING)", "ip": "'10.0.0.' || CAST(h AS STRING)", "prefix": "24::BIGINT"}),
    "norm_ndm_objects": ("ndm_objects", {"namespace": "'n'", "objects": [{"device_id": "'d'", "type": "event_type", "name": "CAST(h AS STRING)"}]}, {"kind": "kind", "name": "name", "namespace": "namespace"}, {"kind": "event_type", "name": "CAST(h AS STRING)", "namespace": "'n'"}),
    "norm_ndm_configs": ("ndm_configs", {"namespace": "'n'", "configs": [{"device_id": "'d' || CAST(h AS STRING)", "config_type": "'running'", "config_content": "event_type", "timestamp": "sec", "tags": TAGS}]}, {"device_id": "device_id", "content": "content", "t_ms": "t_ms"}, {"device_id": "'d' || CAST(h AS STRING)", "content": "event_type", "t_ms": "sec * 1000"}),
    "norm_rum_spans": ("rum_spans", {"env": "'p'", "spans": [{"trace_id": "CAST(event_id AS STRING)", "span_id": "CAST(user_id AS STRING)", "name": "event_type", "meta": {"view_id": "'v'"}, "duration": "h"}]}, {"trace_id": "trace_id", "span_id": "span_id", "name": "name", "view_id": "view_id", "env": "env"}, {"trace_id": "CAST(event_id AS STRING)", "span_id": "CAST(user_id AS STRING)", "name": "event_type", "view_id": "'v'", "env": "'p'"}),
    "norm_rum_replay": ("rum_replay", {"view": {"id": "'v' || CAST(h AS STRING)"}, "session": {"id": "'s'"}, "start": "ms", "end": "ms + 10", "records_count": "q"}, {"view_id": "view_id", "length": "end - start", "records": "records"}, {"view_id": "'v' || CAST(h AS STRING)", "length": "10::BIGINT", "records": "q"}),
    "norm_discovery": ("discovery", {"request_type": "'start'", "payload": {"service_name": "event_type", "host_name": HOST, "pid": "event_id", "ports": ["80L", "h"]}}, {"service": "service", "host": "host", "pid": "pid", "port": "ports[1]"}, {"service": "event_type", "host": HOST, "pid": "event_id", "port": "h"}),
    "norm_health": ("health", {"events": [{"host": HOST, "check": "event_type", "status": "CASE WHEN q = 0 THEN 'bad' ELSE 'ok' END"}]}, {"host": "host", "chk": "check", "state": "state"}, {"host": HOST, "chk": "event_type", "state": "CASE WHEN q = 0 THEN 'bad' ELSE 'ok' END"}),
    "norm_event_mgmt": ("event_mgmt", {"data": [{"attributes": {"title": "event_type", "category": "'change'", "aggregation_key": "CAST(q AS STRING)", "timestamp": "ms", "tags": TAGS}}]}, {"title": "title", "category": "category", "key": "key", "t_ms": "t_ms"}, {"title": "event_type", "category": "'change'", "key": "CAST(q AS STRING)", "t_ms": "ms"}),
    "norm_software": ("software", {"hostname": HOST, "software": [{"name": "event_type", "version": "CAST(q AS STRING)", "publisher": "'p'"}]}, {"name": "name", "version": "version", "host": "host"}, {"name": "event_type", "version": "CAST(q AS STRING)", "host": HOST}),
    "norm_lineage": ("lineage", {"job": {"name": "event_type"}, "run": {"runId": "CAST(event_id AS STRING)"}, "eventType": "'COMPLETE'", "eventTimeMs": "ms", "inputs": [{"name": "'a'"}, {"name": "'b'"}], "outputs": [{"name": "'c'"}]}, {"job": "job", "run": "run", "ins": "size(inputs)", "outs": "size(outputs)", "t_ms": "t_ms"}, {"job": "event_type", "run": "CAST(event_id AS STRING)", "ins": "2", "outs": "1", "t_ms": "ms"}),
    "norm_ci_coverage": ("ci_coverage", {"coverages": [{"test_session_id": "CAST(h AS STRING)", "test_suite_id": "event_type", "files": [{"filename": "'a.py'"}, {"filename": "'b.py'"}]}]}, {"session": "session", "suite": "suite", "files": "size(files)"}, {"session": "CAST(h AS STRING)", "suite": "event_type", "files": "2"}),
    "norm_ci_pipeline": ("ci_pipeline", {"data": [{"attributes": {"resource": {"name": "event_type", "level": "'job'", "status": "'success'", "start": "CAST(ms AS STRING)"}}}]}, {"pipeline": "pipeline", "level": "level", "status": "status", "started": "start"}, {"pipeline": "event_type", "level": "'job'", "status": "'success'", "started": "CAST(ms AS STRING)"}),
    "norm_ci_settings": ("ci_settings", {"request": {"service": "event_type", "repository_url": "'git@x'"}, "response": {"tests_skipping": "q = 0"}}, {"service": "service", "repository": "repository", "skipping": "skipping"}, {"service": "event_type", "repository": "'git@x'", "skipping": "q = 0"}),
    "norm_batch_metadata": ("batch_metadata", {"metadata": {"sender": HOST, "version": "CAST(q AS STRING)"}, "series": ["'a'", "'b'"]}, {"sender": "sender", "version": "version", "n": "size(series)"}, {"sender": HOST, "version": "CAST(q AS STRING)", "n": "2"}),
    "norm_query_actions": ("query_actions", {"action": "event_type", "result": {"z": "1", "a": "q"}}, {"action": "action", "names": "array_join(array_sort(map_keys(result)), ',')", "a": "result['a']"}, {"action": "event_type", "names": "'a,z'", "a": "CAST(q AS STRING)"}),
    "norm_debugger_diagnostics": ("debugger_diagnostics", {"service": "event_type", "timestamp": "ms", "debugger": {"diagnostics": {"probeId": "CAST(h AS STRING)", "status": "'INSTALLED'"}}}, {"service": "service", "probe_id": "probe_id", "status": "status", "t_ms": "t_ms"}, {"service": "event_type", "probe_id": "CAST(h AS STRING)", "status": "'INSTALLED'", "t_ms": "ms"}),
    "norm_symdb": ("symdb", {"service": "event_type", "language": "'python'", "scopes": ["'m'"]}, {"service": "service", "language": "language", "n": "size(scopes)"}, {"service": "event_type", "language": "'python'", "n": "1"}),
    "norm_rum_timeseries": ("rum_timeseries", {"type": "'timeseries'", "date": "ms", "view": {"id": "'v'"}, "timeseries": {"name": "event_type", "data": [{"timestamp": "ms", "value": "value"}]}}, {"name": "name", "n": "size(samples)", "v": "samples[0].value"}, {"name": "event_type", "n": "1", "v": "value"}),
}
for name, (intake, body, out, sql) in SIMPLE.items():
    signal(name, intake, body, out, sql)

K8S = {"kind": "'Pod'", "clusterId": "'k'", "items": [{"metadata": {"namespace": "event_type", "name": "'p' || CAST(user_id AS STRING)"}, "status": {"containers": [{"ready": "q > 0", "restarts": "q"}, {"ready": "true", "restarts": "h"}]}}]}
signal(
    "k8s_pod_counts", "k8s_resources", K8S, {"namespace": "namespace", "name": "name", "ready": "ready_containers", "total": "containers", "restarts": "restarts"},
    {"namespace": "event_type", "name": "'p' || CAST(user_id AS STRING)", "ready": "CASE WHEN q > 0 THEN 2::BIGINT ELSE 1::BIGINT END", "total": "2", "restarts": "q + h"}, norm.pod_counts,
)
SBOM = {"host": HOST, "entities": [{"id": "'i' || CAST(event_id AS STRING)", "type": "'image'", "cyclonedx": {"components": [{"bom-ref": "'r' || CAST(q AS STRING)", "name": "event_type", "version": "'1'", "components": [{"bom-ref": "'z'", "name": "'zlib'", "version": "'2'"}]}], "vulnerabilities": [{"id": "'CVE-' || CAST(h AS STRING)", "ratings": [{"score": "value", "severity": "'high'"}], "affects": [{"ref": "'r' || CAST(q AS STRING)"}, {"ref": "'z'"}]}]}}]}
signal(
    "norm_sbom", "sbom", SBOM, {"entity": "entity", "component": "name", "version": "version", "depth": "depth", "parent": "parent_bom_ref"},
    {"entity": "'i' || CAST(event_id AS STRING)", "component": "unnest([event_type, 'zlib'])", "version": "unnest(['1', '2'])", "depth": "unnest([0, 1])", "parent": "unnest(['', 'r' || CAST(q AS STRING)])"}, norm.sbom_components,
)
signal("norm_sbom_vulnerabilities", "sbom", SBOM, {"entity": "entity", "cve": "id", "severity": "ratings[0].severity", "n": "size(affects)"}, {"entity": "'i' || CAST(event_id AS STRING)", "cve": "'CVE-' || CAST(h AS STRING)", "severity": "'high'", "n": "2"}, norm.sbom_vulnerabilities)


def affected(f: DataFrame) -> DataFrame:
    hits = norm.sbom_vulnerabilities(f).select("entity", F.col("id").alias("cve"), F.explode("affects").alias("bom_ref"))
    return hits.join(norm.sbom_components(f).select("entity", "bom_ref", F.col("name").alias("component")), ["entity", "bom_ref"])


signal("sbom_affected_components", "sbom", SBOM, {"entity": "entity", "cve": "cve", "component": "component"}, {"entity": "'i' || CAST(event_id AS STRING)", "cve": "'CVE-' || CAST(h AS STRING)", "component": "unnest([event_type, 'zlib'])"}, affected)
RUM = {"type": "CASE q WHEN 0 THEN 'view' WHEN 1 THEN 'action' WHEN 2 THEN 'telemetry' ELSE 'else' END", "date": "ms", "view": {"id": "'v' || CAST(user_id AS STRING)", "performance": {"loading_time": "h"}}, "session": {"id": "'s' || CAST(h AS STRING)"}, "_dd": {"document_version": "event_id"}, "action": {"target": {"name": "event_type"}}}
TARGET = "CASE q WHEN 0 THEN 'views' WHEN 1 THEN 'events' WHEN 2 THEN 'telemetry' ELSE 'unknown' END"
signal("norm_rum_classify", "rum", RUM, {"target": "target", "view_id": "view_id"}, {"target": TARGET, "view_id": "'v' || CAST(user_id AS STRING)"}, lambda f: f.withColumn("target", norm.rum_target(F.col("kind"))))


def rum(name: str, q: int, out: dict[str, str], sql: dict[str, str]) -> None:
    text = ", ".join(f"{v} AS {k}" for k, v in sql.items()).replace(" AS STRING)", " AS VARCHAR)")
    register(name, lambda s, d: facts(s, d, "rum", RUM).where(norm.rum_target(F.col("kind")) == ("views", "events", "telemetry")[q]).selectExpr(*[f"{v} AS {k}" for k, v in out.items()]), f"{GOOD} SELECT {text} FROM good WHERE q = {q}")


rum("norm_rum_views", 0, {"view_id": "view_id", "session_id": "session_id", "loading_time": "loading_time", "t_ms": "t_ms"}, {"view_id": "'v' || CAST(user_id AS STRING)", "session_id": "'s' || CAST(h AS STRING)", "loading_time": "h", "t_ms": "ms"})
rum("norm_rum_events", 1, {"view_id": "view_id", "name": "name", "t_ms": "t_ms"}, {"view_id": "'v' || CAST(user_id AS STRING)", "name": "event_type", "t_ms": "ms"})
rum("norm_rum_telemetry", 2, {"session_id": "session_id", "t_ms": "t_ms"}, {"session_id": "'s' || CAST(h AS STRING)", "t_ms": "ms"})


def dead(s, d):
    return norm.normalise(landing(s, d, "series_v2", SERIES2), norm.SPECS["series_v2"])[1]


DEAD = f"WITH {EV} SELECT {{}} FROM ev WHERE event_id % 50 = 0"
register("sink_dead_letter", lambda s, d: dead(s, d).select("received_ms", "reason", "path", F.array_join(F.map_keys("query"), ",").alias("query_keys"), "body_bytes"), DEAD.format("ms + 1000 AS received_ms, 'decode_error' AS reason, '/api/series_v2?api_key=-&v=1' AS path, 'v' AS query_keys, 20 AS body_bytes"))
register("dead_letter_summary", lambda s, d: dead(s, d).groupBy("intake", "reason").agg(F.count("*").alias("n"), F.avg("body_bytes").alias("bytes")), DEAD.format("'series_v2' AS intake, 'decode_error' AS reason, count(*) AS n, 20.0::DOUBLE AS bytes"))
WRONG = {"check": "'c'", "host_name": HOST, "status": "CASE WHEN q = 0 THEN 'bad' ELSE CAST(q AS STRING) END", "timestamp": "sec"}


signal("norm_type_notes", "check_runs", WRONG, {"received_ms": "received_ms", "note": "note", "status": "status_code", "kept": "extra['status']"}, {"received_ms": "ms + 1000", "note": "CASE WHEN q = 0 THEN 'status' ELSE '' END", "status": "CASE WHEN q <> 0 THEN q END", "kept": "CASE WHEN q = 0 THEN 'bad' END"})
NESTED = {"type": "'view'", "date": "ms", "view": {"id": "'v'", "url": "'/' || event_type", "time_spent": "user_id", "performance": {"loading_time": "h", "cls": {"score": "value"}}}, "session": {"id": "'s'", "plan": "q"}, "usr": {"id": "h"}}
signal(
    "norm_extra_nested", "rum", NESTED, {"names": "array_join(array_sort(map_keys(extra)), ',')", "url": "extra['view.url']", "spent": "extra['view.time_spent']", "plan": "extra['session.plan']", "cls": "get_json_object(extra['view.performance.cls'], '$.score') is not null"},
    {"names": "'session.plan,usr,view.performance.cls,view.time_spent,view.url'", "url": "'/' || event_type", "spent": "CAST(user_id AS STRING)", "plan": "CAST(q AS STRING)", "cls": "true"},
)
BESIDE = {"series": [{"metric": "'m'", "points": []}], "sender": {"version": "q"}, "sent_at": "ms"}
register("norm_batch_keys", lambda s, d: norm.leftovers(landing(s, d, "series_v2", BESIDE), norm.SPECS["series_v2"]).selectExpr("received_ms", "get_json_object(extra['sender'], '$.version') AS version", "extra['sent_at'] AS sent_at", "size(extra) AS n"), f"{GOOD} SELECT ms + 1000 AS received_ms, CAST(q AS VARCHAR) AS version, CAST(ms AS VARCHAR) AS sent_at, 2 AS n FROM good")


def tagged(s, d, intake, body):
    """The outcomes of a landing in one pass: facts, whose columns begin with ``fact_``, letters and leftovers by tag."""
    rows, names = norm.told(landing(s, d, intake, body), norm.SPECS[intake])
    kept = rows.where("coalesce(letter.reason, '') <> 'decode_error'")
    return kept.select("received_ms", "tag", "letter", norm.last_of(F.col("rest")).alias("rest"), *[F.when(F.col("tag") == "fact", F.col(f"x_{n}")).alias(f"fact_{n}") for n in names])


#: Items that are no objects, declared fields that are no strings, and one of two spellings of the host.
MIXED = """concat('[', q, ',"plain ', event_type, '",null,{"message":"m', h, '","host":7},{"message":', h, '},{"ddtags":{"a":', q, '},"message":"x"},{"status":3,"host":"h","date":', ms, '}]')"""
register(
    "norm_outcomes_of_logs",
    lambda s, d: tagged(s, d, "logs", MIXED).selectExpr("received_ms", "tag", "coalesce(letter.body, fact_message, fact_host) AS text", "coalesce(letter.note, fact_note) AS note", "array_join(array_sort(map_keys(fact_extra)), ',') AS kept", "fact_t_ms AS t_ms"),
    f"""{GOOD}, i AS (SELECT ms + 1000 AS received_ms, ms, unnest(['letter', 'letter', 'letter', 'fact', 'letter', 'letter', 'fact']) AS tag,
    unnest([CAST(q AS VARCHAR), '"plain ' || event_type || '"', 'null', 'm' || CAST(h AS VARCHAR), '{{"message":' || CAST(h AS VARCHAR) || '}}', '{{"ddtags":{{"a":' || CAST(q AS VARCHAR) || '}},"message":"x"}}', 'h']) AS text,
    unnest(['', '', '', 'hostname', 'message', 'ddtags', 'status']) AS note, unnest([NULL, NULL, NULL, 'host', NULL, NULL, 'status']) AS kept, unnest([false, false, false, false, false, false, true]) AS dated FROM good)
    SELECT received_ms, tag, text, note, kept, CASE WHEN dated THEN ms WHEN tag = 'fact' THEN received_ms END AS t_ms FROM i""",
)
#: Members of a wrong type inside lists, tags that are no texts, and keys beside the list.
MEMBERS = """concat('{"series":[{"metric":"m","points":[{"timestamp":"x","value":', h, '},{"timestamp":', sec, ',"value":2}],"tags":["a:1",{"b":', q, '}],"resources":[{"name":"h","type":"host"},5]},{"metric":"n","points":[{"timestamp":', sec, ',"value":1}],"tags":{"c":1}}],"sent":', h, '}')"""
register(
    "norm_outcomes_of_series",
    lambda s, d: tagged(s, d, "series_v2", MEMBERS).selectExpr("received_ms", "tag", "fact_metric AS metric", "fact_note AS note", "get_json_object(fact_extra['points'], '$[0].timestamp') AS bad_time", "fact_points[0].timestamp AS time", "fact_points[0].value AS value", "get_json_object(coalesce(fact_extra['tags'], '[]'), '$[1].b') AS bad_tag", "fact_tags['a'][0] AS tag_a", "rest['sent'] AS sent"),
    f"""{GOOD} SELECT ms + 1000 AS received_ms, unnest(['fact', 'fact', 'rest']) AS tag, unnest(['m', 'n', NULL]) AS metric, unnest(['points,resources,tags', 'tags', NULL]) AS note, unnest(['x', NULL, NULL]) AS bad_time,
    unnest([NULL, sec, NULL]) AS time, unnest([CAST(h AS DOUBLE), 1.0, NULL]) AS value, unnest([CAST(q AS VARCHAR), NULL, NULL]) AS bad_tag, unnest(['1', NULL, NULL]) AS tag_a, unnest([NULL, NULL, CAST(h AS VARCHAR)]) AS sent FROM good""",
)

signal(
    "norm_intake_events", "intake_events",
    {"internalHostname": HOST, "events": {"api": [{"msg_title": "'t' || event_type", "msg_text": "'x'", "timestamp": "sec", "host": "CASE WHEN q = 0 THEN NULL ELSE 'own' END", "tags": TAGS}], "nagios": [{"msg_title": "'n'", "msg_text": "'y'", "timestamp": "sec", "host": "'own'", "tags": TAGS}]}},
    {"source": "source", "title": "title", "host": "coalesce(host, agent_host)", "t_ms": "t_ms"},
    {"source": "unnest(['api', 'nagios'])", "title": "unnest(['t' || event_type, 'n'])", "host": f"unnest([CASE WHEN q = 0 THEN {HOST} ELSE 'own' END, 'own'])", "t_ms": "sec * 1000"},
)
signal(
    "norm_external_host_tags", "external_host_tags", """concat('{"external_host_tags":[["host-', h, '",{"vs":["a:', q, '","b"]}]]}')""",
    {"host": "host", "source": "source", "tags": "array_join(pairs, ',')"},
    {"host": HOST, "source": "'vs'", "tags": "'a:' || CAST(q AS STRING) || ',b'"},
    lambda f: f.select("*", F.explode("by_source").alias("source", "pairs")),
)
for kind, (listed, field, code) in {"norm_usm_http": ("httpAggregations", "statsByStatusCode", "by_status"), "norm_usm_kafka": ("kafkaAggregations", "statsByErrorCode", "by_error")}.items():
    named = {"path": "event_type", "method": "'GET'"} if "http" in kind else {"topic": "event_type"}
    signal(
        kind, kind.removeprefix("norm_"), {"hostName": HOST, "connections": [{"pid": "event_id", listed: [named | {field: {"200": {"count": "q"}, "500": {"count": "h"}}}]}]},
        {"pid": "pid", "what": next(iter(named)), "code": "code", "n": "stat.count"}, {"pid": "event_id", "what": "event_type", "code": "unnest(['200', '500'])", "n": "unnest([q, h])"},
        lambda f, c=code: f.select("*", F.explode(c).alias("code", "stat")),
    )
signal(
    "norm_symbol_queries", "symbol_queries", {"data": {"arch": "'arm'", "buildIds": ["'b' || CAST(q AS STRING)", "'c' || CAST(h AS STRING)"]}},
    {"build_id": "item_text", "arch": "arch"}, {"build_id": "unnest(['b' || CAST(q AS STRING), 'c' || CAST(h AS STRING)])", "arch": "'arm'"},
    lambda f: f.withColumnRenamed("build_id", "item_text"),
)
TREE = """concat('{"metadata":{"container_id":"', event_id, '"},"tree":{"exe":"init","children":[{"exe":"', event_type, '","children":[{"exe":"leaf"}]},{"exe":"b"}]}}')"""
signal(
    "norm_cws_dump", "cws_dump", TREE, {"container": "container", "path": "array_join(path, '.')", "exe": "get_json_object(node, '$.exe')"},
    {"container": "CAST(event_id AS STRING)", "path": "unnest(['0', '0.0', '0.0.0', '0.1'])", "exe": "unnest(['init', event_type, 'leaf', 'b'])"},
    lambda f: norm.flatten_tree(f, "tree", ["container"]),
)


def read(name: str, signal_name: str, of, sql: str) -> None:
    """Register a read of a signal's facts."""
    intake, body = SIMPLE[signal_name][:2]
    register(name, lambda s, d: of(facts(s, d, intake, body)), f"{GOOD} {sql}")


read("fleet_versions", "norm_hosts", product.fleet_versions, f"SELECT agent_version, count(*) AS hosts FROM (SELECT {HOST.replace('STRING', 'VARCHAR')} AS host, arg_max('7.' || CAST(q AS VARCHAR), (ms, '7.' || CAST(q AS VARCHAR))) AS agent_version FROM good GROUP BY 1) GROUP BY 1")
read("images_without_digest", "norm_container_images", product.without_digest, "SELECT DISTINCT 'id' || CAST(h AS VARCHAR) AS image, event_type AS name FROM good WHERE q = 0")
KINDS = {"clusterId": "'k'", "manifests": [{"uid": "'u' || CAST(user_id AS STRING)", "kind": "CASE WHEN q < 2 THEN NULL ELSE event_type END", "resourceVersion": "CAST(event_id AS STRING)", "content": "'{}'"}]}
register(
    "manifest_kind_repair",
    lambda s, d: product.repaired_kinds(facts(s, d, "k8s_manifests", KINDS)).select("uid", "version", "kind"),
    f"{GOOD}, k AS (SELECT user_id, arg_max(event_type, (ms + 1000, CAST(event_id AS VARCHAR))) AS known FROM good WHERE q >= 2 GROUP BY user_id) SELECT 'u' || CAST(user_id AS VARCHAR) AS uid, CAST(event_id AS VARCHAR) AS version, CASE WHEN q < 2 THEN known ELSE event_type END AS kind FROM good LEFT JOIN k USING (user_id)",
)
read("ci_run", "norm_ci_tests", product.test_run, "SELECT event_type AS suite, count(DISTINCT h) AS tests, CAST(count(*) FILTER (q = 0) AS BIGINT) AS failed, max(user_id) AS slowest, CAST(sum(user_id) AS BIGINT) AS total FROM good GROUP BY 1")
read("sds_rule_hits", "norm_sds", product.rule_hits, "SELECT event_type AS rule, count(DISTINCT h) AS resources, CAST(coalesce(sum(q) FILTER (q <> 0), 0) AS BIGINT) AS matches, count(*) FILTER (q = 0) AS failed FROM good GROUP BY 1")
read("dbm_volume", "norm_dbm_events", lambda f: product.statement_volume(f, 3_600_000), "SELECT 'pg' AS track, ms // 3600000 * 3600000 AS bucket_ms, count(*) AS events, count(DISTINCT q) AS signatures, CAST(sum(strlen('select ' || event_type)) AS BIGINT) AS bytes FROM good GROUP BY 2")
read("container_exit_lateness", "norm_container_events", lambda f: product.exit_lateness(f).withColumn("late_ms", F.round("late_ms", 4)), "SELECT CASE WHEN q <> 0 THEN q END AS exit_code, count(*) AS exits, round(avg(ms + 1000 - sec * 1000), 4) AS late_ms, max(ms + 1000 - sec * 1000) AS latest_ms FROM good GROUP BY 1")

META = {"namespace": "event_type", "name": "'o' || CAST(user_id AS STRING)", "uid": "'u' || CAST(event_id AS STRING)", "resourceVersion": "CAST(event_id AS STRING)", "labels": ["'app:' || event_type", "'tier:a:b'"]}
STATUS = {"name": "'main'", "containerID": "'c' || CAST(event_id AS STRING)", "ready": "q > 0", "restartCount": "h", "state": "'running'", "image": "'i'"}


def cluster_object(name: str, kind: str, own: dict, out: dict[str, str], sql: dict[str, str]) -> None:
    """Register the rows of one kind of cluster object."""
    frame = {"kind": f"'{kind}'", "clusterId": "'k'", "clusterName": "'main'", "groupId": "1", "groupSize": "2", "tags": ["'cluster:main'"], "objects": [{"metadata": META, "tags": ["'own:' || CAST(q AS STRING)"]} | own]}
    signal(name, "k8s_objects", frame, {"uid": "uid", "app": "labels['app']", "cluster": "tags['cluster'][0]", "own": "tags['own'][0]"} | out, {"uid": "'u' || CAST(event_id AS STRING)", "app": "event_type", "cluster": "'main'", "own": "CAST(q AS STRING)"} | sql, norm.object_rows)


cluster_object(
    "norm_k8s_pods", "Pod",
    {"phase": "'Running'", "nodeName": "'n' || CAST(h AS STRING)", "restartCount": "user_id", "containerStatuses": [STATUS, STATUS | {"name": "'side'", "ready": "true", "restartCount": "1L"}], "initContainerStatuses": [STATUS | {"name": "'init'", "ready": "false"}], "conditions": [{"type": "'Ready'", "status": "CASE WHEN q > 0 THEN 'True' ELSE 'False' END", "lastTransitionTime": "sec"}, {"type": "'Scheduled'", "status": "'True'", "reason": "'r'"}]},
    {"ready": "ready", "desired": "desired", "restarts": "counts['restarts']", "init": "counts['total_init_containers']", "agent_restarts": "counts['pod_restart_count']", "names": "array_join(container_names, ',')", "is_init": "array_join(transform(container_is_init, x -> string(x)), ',')", "types": "array_join(condition_types, ',')", "changed": "condition_last_transition_s[0]", "node_name": "node_name", "tier": "labels['tier']"},
    {"ready": "1 + CASE WHEN q > 0 THEN 1 ELSE 0 END", "desired": "2", "restarts": "h + 1", "init": "1", "agent_restarts": "user_id", "names": "'main,side,init'", "is_init": "'0,0,1'", "types": "'Ready,Scheduled'", "changed": "sec", "node_name": "'n' || CAST(h AS STRING)", "tier": "'a:b'"},
)
cluster_object(
    "norm_k8s_deployments", "Deployment", {"readyReplicas": "q", "replicasDesired": "h", "updatedReplicas": "1L", "replicas": "user_id"},
    {"ready": "ready", "desired": "desired", "available": "available", "all": "counts['replicas']", "unavailable": "counts['unavailable']", "n": "size(counts)"}, {"ready": "q", "desired": "h", "available": "0", "all": "user_id", "unavailable": "0", "n": "6"},
)
cluster_object(
    "norm_k8s_daemon_sets", "DaemonSet", {"status": {"numberReady": "q", "desiredNumberScheduled": "h", "numberAvailable": "1L", "numberMisscheduled": "2L"}},
    {"ready": "ready", "desired": "desired", "available": "available", "misscheduled": "counts['misscheduled']"}, {"ready": "q", "desired": "h", "available": "1", "misscheduled": "2"},
)
cluster_object(
    "norm_k8s_nodes", "Node", {"roles": ["'worker'"], "unschedulable": "q = 0", "taints": [{"key": "'a'"}, {"key": "'b'"}], "status": {"status": "'Ready'", "kubeletVersion": "'v1.' || CAST(q AS STRING)", "capacity": {"cpu": "h"}, "images": [{"x": "1L"}]}},
    {"status": "status", "kubelet": "kubelet_version", "cpu": "capacity['cpu']", "taints": "counts['taints']", "images": "counts['images']", "closed": "unschedulable", "role": "roles[0]", "ready": "ready"},
    {"status": "'Ready'", "kubelet": "'v1.' || CAST(q AS STRING)", "cpu": "h", "taints": "2", "images": "1", "closed": "q = 0", "role": "'worker'", "ready": "NULL::BIGINT"},
)
cluster_object("norm_k8s_jobs", "Job", {"status": {"succeeded": "q", "failed": "h"}, "spec": {"completions": "5L", "activeDeadlineSeconds": "600L"}}, {"succeeded": "counts['succeeded']", "failed": "counts['failed']", "completions": "counts['completions']", "active": "counts['active']", "deadline": "counts['active_deadline_seconds']"}, {"succeeded": "q", "failed": "h", "completions": "5", "active": "0", "deadline": "600"})
cluster_object("norm_k8s_autoscalers", "HorizontalPodAutoscaler", {"spec": {"minReplicas": "1L", "maxReplicas": "h"}, "status": {"currentReplicas": "q", "desiredReplicas": "q + 1"}}, {"ready": "ready", "desired": "desired", "most": "counts['max_replicas']"}, {"ready": "q", "desired": "q + 1", "most": "h"})
cluster_object("norm_k8s_other_kinds", "Widget", {"spec": {"odd": "q"}}, {"n": "size(counts)", "ready": "ready", "odd": "get_json_object(object, '$.spec.odd')"}, {"n": "0", "ready": "NULL::BIGINT", "odd": "CAST(q AS STRING)"})

INSIDE = {"id": "'c' || CAST(event_id AS STRING)", "image": "event_type", "totalPct": "value", "memRss": "user_id", "addresses": [{"ip": "'10.0.0.1'", "port": "80L"}, {"ip": "'10.0.0.2'", "port": "80L"}]}


def messages(s, d, bodies: dict[str, dict], stats: bool = False) -> DataFrame:
    """Containers, or statistics, of all kinds of messages of the events."""
    parts = [landing(s, d, intake, body) for intake, body in bodies.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return norm.container_rows(whole, stats)


register(
    "norm_container_messages",
    lambda s, d: messages(s, d, {
        "collector_container": {"hostName": HOST, "containers": [INSIDE | {"tags": TAGS}]},
        "collector_proc": {"hostName": HOST, "containers": [INSIDE], "processes": [{"pid": "user_id", "container": INSIDE}, {"pid": "1L"}]},
    }).selectExpr("source", "container_id", "host", "pid", "cpu", "rss", "tags['env'][0] AS env", "array_join(addresses.ip, ',') AS ips"),
    f"""{GOOD} SELECT s.source, 'c' || CAST(event_id AS VARCHAR) AS container_id, 'host-' || CAST(h AS VARCHAR) AS host, CASE WHEN s.source = 'process' THEN user_id END AS pid, value AS cpu, user_id AS rss,
    CASE WHEN s.source = 'collector_container' THEN 'e' || CAST(user_id % 5 AS VARCHAR) END AS env, '10.0.0.1,10.0.0.2' AS ips FROM good, (SELECT unnest(['collector_container', 'collector_proc', 'process']) AS source) s""",
)
register(
    "norm_container_stat_messages",
    lambda s, d: messages(s, d, {"collector_realtime": {"hostName": HOST, "orgId": "q", "numCpus": "8L", "containerStats": [INSIDE]}, "collector_container_realtime": {"hostName": HOST, "numCpus": "4L", "stats": [INSIDE]}}, True).selectExpr("source", "container_id", "cpus", "org_id", "cpu"),
    f"""{GOOD} SELECT s.source, 'c' || CAST(event_id AS VARCHAR) AS container_id, CAST(CASE WHEN s.source = 'collector_realtime' THEN 8 ELSE 4 END AS BIGINT) AS cpus, CASE WHEN s.source = 'collector_realtime' THEN q END AS org_id, value AS cpu
    FROM good, (SELECT unnest(['collector_realtime', 'collector_container_realtime']) AS source) s""",
)
#: Trace statistics: payload, client, bucket, group; summaries with sparse and dense bins, an empty and a broken one.
TRACE_STATS = """concat('{"AgentHostname":"a', h, '","ClientComputed":true,"Stats":[{"Hostname":"c', q, '","Lang":"py","Tags":["t:1","t:2"],"Stats":[{"Start":', ms, ',"Duration":10,"Stats":[{"Service":"', event_type, '","Name":"web","Resource":"GET","Hits":', user_id, ',"Errors":', q,
 ',"OkSummary":{"mapping":{"gamma":1.02},"positiveValues":{"binCounts":{"', h, '":1.0},"contiguousBinCounts":[2.0,0.0,1.0],"contiguousBinIndexOffset":', user_id, '},"zeroCount":', q, '},"ErrorSummary":', CASE q WHEN 0 THEN 'null' WHEN 1 THEN '{"mapping":{"gamma":1.02}}' ELSE '{"mapping":7}' END, '}]}]}]}')"""
signal(
    "norm_trace_stats", "trace_stats", TRACE_STATS,
    {"service": "service", "agent": "agent_hostname", "client": "client_hostname", "tags": "array_join(client_tags['t'], ',')", "start": "bucket_start", "hits": "hits", "ok_state": "ok_state", "ok_count": "ok_count", "ok_bins": "size(ok_keys)", "error_state": "error_state"},
    {"service": "event_type", "agent": "'a' || CAST(h AS STRING)", "client": "'c' || CAST(q AS STRING)", "tags": "'1,2'", "start": "ms", "hits": "user_id", "ok_state": "'ok'", "ok_count": "4.0::DOUBLE + q", "ok_bins": "3 + CASE WHEN q > 0 THEN 1 ELSE 0 END", "error_state": "CASE q WHEN 0 THEN 'absent' WHEN 1 THEN 'empty' ELSE 'undecodable' END"},
    norm.stat_rows,
)
register(
    "trace_latency_quantiles",
    lambda s, d: norm.latency_quantiles(norm.stat_rows(facts(s, d, "trace_stats", TRACE_STATS)), ["service"], 0.95).selectExpr("service", "count", "round(value, 6) AS value"),
    f"""{GOOD}, b AS (SELECT event_type AS service, unnest([h, user_id, user_id + 2, -1000000000]) AS k, unnest([1, 2, 1, q]) AS n FROM good), c AS (SELECT service, k, sum(n) AS n FROM b WHERE n > 0 GROUP BY ALL),
    r AS (SELECT service, k, sum(n) OVER (PARTITION BY service ORDER BY k) AS run, sum(n) OVER (PARTITION BY service) AS total FROM c)
    SELECT service, CAST(max(total) AS DOUBLE) AS count, round(CASE WHEN min(k) < 0 THEN 0.0 ELSE pow(1.02, min(k)) * 2.04 / 2.02 END, 6) AS value FROM r WHERE run > 0.95 * (total - 1) GROUP BY service""",
)
ORIGIN = {"series": [SERIES2["series"][0] | {"source_type_name": "'System'", "metadata": {"origin": {"origin_product": "q", "origin_service": "h", "odd": "1"}}}]}
signal(
    "norm_series_v2_origin", "series_v2", ORIGIN, {"metric": "metric", "source_type": "source_type", "product": "origin_product", "category": "origin_category", "service": "origin_service", "odd": "extra['metadata.origin.odd']"},
    {"metric": "'m.' || event_type", "source_type": "'System'", "product": "q", "category": "NULL::BIGINT", "service": "h", "odd": "'1'"}, norm.metric_rows,
)
FOUND = {"scanId": "'s' || CAST(event_id AS STRING)", "results": [{"rule": "event_type", "resource": "'r'", "matches": "2L", "failed": "false", "matchDetails": [{"path": "'a.b'", "start": "q", "end": "h + 10", "confidence": "'high'"}, {"path": "'c'", "start": "1L", "end": "2L", "confidence": "'low'"}]}]}
signal(
    "norm_sds_matches", "sds", FOUND, {"scan_id": "scan_id", "rule": "rule", "nth": "nth", "path": "path", "begin": "start", "stop": "end", "confidence": "confidence"},
    {"scan_id": "'s' || CAST(event_id AS STRING)", "rule": "event_type", "nth": "unnest([0, 1])", "path": "unnest(['a.b', 'c'])", "begin": "unnest([q, 1])", "stop": "unnest([h + 10, 2])", "confidence": "unnest(['high', 'low'])"}, norm.scan_matches,
)
#: Spans of references: table entries 1 to 8; zero and 99 are none.
INDEXED = """concat('{"env":"prod","idxTracerPayloads":[{"strings":["never","', event_type, '","web","GET \\\\"x\\\\"","route","size","c', h, '","inner","py"],"languageNameRef":8,"containerIDRef":6,"attributes":{"4":{"stringValueRef":2},"5":{"intValue":', q, '}},"chunks":[{"traceID":"AAAAAAAAAP8AAAAAAAAACQ==","priority":1,"originRef":99,"spans":[{"serviceRef":1,"nameRef":2,"resourceRef":3,"typeRef":0,"spanID":', event_id, ',"parentID":0,"start":', ms, ',"duration":', user_id, ',"error":', CASE WHEN q = 0 THEN 'true' ELSE 'false' END, ',"kind":2,
 "attributes":{"4":{"stringValueRef":3},"5":{"intValue":9007199254740993},"7":{"keyValueList":{"keyValues":[{"key":4,"value":{"arrayValue":{"values":[{"stringValueRef":1},{"boolValue":true}]}}},{"key":0,"value":{"doubleValue":1.5}}]}},"6":{"bytesValue":"AQI="}},"links":[{"traceID":"AAAAAAAAAAEAAAAAAAAAAg==","spanID":7,"tracestateRef":2,"attributes":{"5":{"boolValue":false}}}],"events":[{"time":', ms, ',"nameRef":7}]}]}]}]}')"""
signal(
    "norm_indexed_spans", "indexed_spans", INDEXED,
    {"service": "service", "name": "name", "resource": "resource", "span_type": "type", "trace_id": "trace_id", "high": "trace_id_high", "span_id": "span_id", "kind": "kind", "error": "error", "origin": "origin", "language": "language", "container": "container_id", "route": "meta['route']", "size": "metrics['size']", "bytes": "hex(meta_struct[concat('c', split(container_id, 'c')[1])])",
     "json": "attributes_json", "tags": "concat(tracer_tags['route'], ',', tracer_tags['size'])", "link": "link_trace_id[0] * 10 + link_trace_id_high[0]", "state": "link_tracestate[0]", "link_json": "link_attributes[0]", "event": "event_name[0]", "event_json": "event_attributes[0]"},
    {"service": "event_type", "name": "'web'", "resource": "'GET \"x\"'", "span_type": "''", "trace_id": "9", "high": "255", "span_id": "event_id", "kind": "'server'", "error": "CASE WHEN q = 0 THEN 1 ELSE 0 END", "origin": "''", "language": "'py'", "container": "'c' || CAST(h AS STRING)", "route": "'GET \"x\"'", "size": "9007199254740992.0::DOUBLE", "bytes": "'0102'",
     "json": """'{"route":{"string":"GET \\"x\\""},"size":{"int":9007199254740993},"c' || CAST(h AS STRING) || '":{"bytes":"AQI="},"inner":{"kvlist":[{"key":"route","value":{"array":[{"string":"' || event_type || '"},{"bool":true}]}},{"key":"","value":{"double":1.5}}]}}'""",
     "tags": "'web,' || CAST(q AS STRING)", "link": "21", "state": "'web'", "link_json": """'{"size":{"bool":false}}'""", "event": "'inner'", "event_json": "''"},
    norm.indexed_span_rows,
)
TESTED = """concat('{"version":1,"metadata":{"*":{"env":"all","language":"py","git.branch":"main"},"test":{"env":"own"},"other":{"language":"no"}},"events":[{"type":"test","version":2,"content":{"test_session_id":', event_id, ',"service":"s","start":', ms, ',"meta":{"test.name":"t', h, '","test.status":"pass","test.is_new":"True","git.branch":""},"metrics":{"test.source.start":', q, '}}},{"type":"test_session_end","content":{"meta":{"env":"mine","test.source.start":" 7 "}}}]}')"""
signal(
    "norm_ci_test_metadata", "ci_test_events", TESTED,
    {"event_type": "event_type", "env": "env", "language": "language", "branch": "branch", "test_name": "test_name", "session": "session_id", "line": "source_start", "is_new": "is_new"},
    {"event_type": "unnest(['test', 'test_session_end'])", "env": "unnest(['own', 'mine'])", "language": "unnest(['py', 'py'])", "branch": "unnest(['main', 'main'])", "test_name": "unnest(['t' || CAST(h AS STRING), ''])", "session": "unnest([event_id, NULL])", "line": "unnest([q, 7])", "is_new": "unnest([true, NULL])"}, norm.test_event_rows,
)
BATCH = """concat('{"request_type":"', CASE WHEN q = 0 THEN 'app-started' ELSE 'message-batch' END, '","seq_id":', event_id, ',"runtime_id":"r', h, '","application":{"service_name":"', event_type, '"},"payload":', CASE q WHEN 0 THEN '{"a":1}' WHEN 1 THEN '[1]' ELSE '[{"request_type":"logs","payload":{"n":2}},null]' END, '}')"""
signal(
    "norm_telemetry_batches", "telemetry_requests", BATCH,
    {"seq_id": "seq_id", "service": "service_name", "request_type": "request_type", "payload": "payload", "nth": "batch_index", "parent": "parent_request_type"},
    {"seq_id": "event_id", "service": "event_type", "request_type": "unnest(CASE WHEN q = 0 THEN ['app-started'] WHEN q = 1 THEN ['message-batch'] ELSE ['message-batch', 'logs', ''] END)", "payload": """unnest(CASE q WHEN 0 THEN ['{"a":1}'] WHEN 1 THEN ['[1]'] ELSE ['[{"payload":{"n":2},"request_type":"logs"},null]', '{"n":2}', NULL] END)""",
     "nth": "unnest(CASE WHEN q < 2 THEN [NULL] ELSE [NULL, 0, 1] END)", "parent": "unnest(CASE WHEN q < 2 THEN [''] ELSE ['', 'message-batch', 'message-batch'] END)"}, norm.telemetry_rows,
)
