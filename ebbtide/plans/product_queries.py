"""Registered queries: incremental views, retention, and reads of the product tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import catalog, product
from ..operators.aggregate import rollup_1m
from ..sources import telemetry
from ..sources.telemetry import CHECKS_SQL, LOGS_SQL, MONITORS_SQL, POINTS_SQL, epoch_ms, table
from ..functions.sketch import LOG_GAMMA
from ..storage import shared_dir
from ..streaming import views
from .common import DAY, FROM, points
from .registry import register

NOW = FROM + 25 * DAY * 1000
#: Spans: a line of an order is a span, its parent the line before it in a full order of the lines.
ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag"
SPANS_SQL = f"""spans AS (SELECT l_orderkey AS trace_id, l_orderkey * 7 AS trace_id_high, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS span_id,
 'supplier-' || (l_suppkey % 20) AS service, l_returnflag || l_linestatus AS resource, l_extendedprice AS duration, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS error, epoch_us(l_shipdate) // 1000 AS start_ms FROM lineitem),
 edges AS (SELECT *, CASE WHEN span_id > 1 THEN span_id - 1 END AS parent_id FROM spans)"""


def spans(s, d):
    rows = table(s, d, "lineitem").selectExpr(
        "l_orderkey AS trace_id", "l_orderkey * 7 AS trace_id_high", f"CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS BIGINT) AS span_id", "concat('supplier-', l_suppkey % 20) AS service",
        "concat(l_returnflag, l_linestatus) AS resource", "l_extendedprice AS duration", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS error", "l_shipdate",
    )
    return rows.withColumn("start_ms", epoch_ms("l_shipdate")).withColumn("parent_id", F.when(F.col("span_id") > 1, F.col("span_id") - 1))


register("trace_by_id", lambda s, d: product.trace_by_id(spans(s, d), 7 * 4, 4).unionAll(product.trace_by_id(spans(s, d), 7 * 100, 100)).select("trace_id", "span_id", "service"), f"WITH {SPANS_SQL} SELECT trace_id, span_id, service FROM spans WHERE (trace_id = 4 AND trace_id_high = 28) OR (trace_id = 100 AND trace_id_high = 700)")
register("service_latest_spans", lambda s, d: product.service_latest_spans(spans(s, d), "supplier-3", 50).select("trace_id", "span_id", "start_ms"), f"WITH {SPANS_SQL} SELECT trace_id, span_id, start_ms FROM spans WHERE service = 'supplier-3' ORDER BY start_ms DESC, trace_id, span_id LIMIT 50")
register("errors_by_resource", lambda s, d: product.errors_by_resource(spans(s, d)), f"WITH {SPANS_SQL} SELECT service, resource, count(*) AS errors FROM spans WHERE error = 1 GROUP BY ALL")
register("p95_by_resource", lambda s, d: product.quantile_by_resource(spans(s, d), 0.95).withColumn("duration", F.round("duration", 4)), f"WITH {SPANS_SQL} SELECT service, resource, round(quantile_cont(duration, 0.95), 4) AS duration FROM spans GROUP BY ALL")
register(
    "p95_by_resource_sketch",  # the same from buckets
    lambda s, d: product.sketched_quantile(spans(s, d), ["service", "resource"], "duration", 0.95).withColumn("duration", F.round("duration", 4)),
    f"""WITH {SPANS_SQL}, c AS (SELECT service, resource, CAST(round_even(ln(duration) / {LOG_GAMMA!r}, 0) AS INT) AS k, count(*) AS n FROM spans GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER (PARTITION BY service, resource ORDER BY k) AS run, sum(n) OVER (PARTITION BY service, resource) AS total FROM c)
    SELECT service, resource, round(exp(min(k) * {LOG_GAMMA!r}), 4) AS duration, CAST(max(total) AS BIGINT) AS count FROM r WHERE run > 0.95 * (total - 1) GROUP BY ALL""",
)
register("service_overview", lambda s, d: product.service_overview(spans(s, d)).withColumn("latency", F.round("latency", 4)), f"WITH {SPANS_SQL} SELECT service, count(*) AS hits, CAST(sum(error) AS BIGINT) AS errors, round(avg(duration), 4) AS latency FROM spans GROUP BY service")
register("pathway_graph", lambda s, d: product.pathway_graph(spans(s, d)), f"WITH {SPANS_SQL} SELECT p.service AS from_node, c.service AS to_node, count(*) AS n FROM edges c JOIN edges p ON c.trace_id = p.trace_id AND c.parent_id = p.span_id GROUP BY ALL")
register("process_tree", lambda s, d: product.span_depths(spans(s, d), paths=False).select("trace_id", "span_id", "depth", (F.col("depth") + 1).alias("length")), f"WITH {SPANS_SQL} SELECT trace_id, span_id, CAST(span_id - 1 AS INT) AS depth, CAST(span_id AS INT) AS length FROM spans")


def frames(s, d):
    """Snapshots: the lines of an order are the frames; the last frame of every seventh order is missing."""
    rows = spans(s, d).withColumn("group_size", F.count("*").over(Window.partitionBy("trace_id")))
    rows = rows.where("NOT (trace_id % 7 = 0 AND span_id = group_size)")
    return rows.select(F.col("trace_id").alias("group_id"), F.concat(F.lit("host-"), (F.col("trace_id") % 50).cast("string")).alias("host"), "span_id", "group_size", "start_ms").withColumn("t_ms", F.max("start_ms").over(Window.partitionBy("group_id")))


FRAMES = f"""{SPANS_SQL}, f0 AS (SELECT trace_id AS group_id, 'host-' || (trace_id % 50) AS host, span_id, count(*) OVER (PARTITION BY trace_id) AS group_size, start_ms FROM spans),
 frames AS (SELECT *, max(start_ms) OVER (PARTITION BY group_id) AS t_ms FROM f0 WHERE NOT (group_id % 7 = 0 AND span_id = group_size))"""
AT = 900_000_000_000
register("snapshot_complete", lambda s, d: product.snapshot_complete(frames(s, d)), f"WITH {FRAMES} SELECT group_id, count(*) AS frames, max(group_size) AS group_size FROM frames GROUP BY group_id HAVING count(*) = max(group_size)")
register("processes_at", lambda s, d: product.processes_at(frames(s, d), AT).select("host", "group_id", "span_id"), f"WITH {FRAMES}, n AS (SELECT host, arg_max(group_id, (t_ms, group_id)) AS group_id FROM frames WHERE t_ms <= {AT} GROUP BY host) SELECT host, group_id, span_id FROM frames JOIN n USING (host, group_id)")
register("host_stopped_sending", lambda s, d: product.silent_hosts(points(s, d), FROM + 30 * DAY * 1000, 2 * 3_600_000), f"WITH {POINTS_SQL} SELECT host, max(t_ms) AS last_ms FROM pts GROUP BY host HAVING {FROM + 30 * DAY * 1000} - max(t_ms) > {2 * 3_600_000}")
register(
    "latest_check_status",
    lambda s, d: catalog.replace_by_version(telemetry.check_runs(table(s, d, "events")).select("check_name", "host", "t_ms", "event_id", "status"), ["check_name", "host"], ["t_ms", "event_id"]).select("check_name", "host", "status"),
    f"WITH {CHECKS_SQL} SELECT check_name, host, arg_max(status, (t_ms, event_id)) AS status FROM runs GROUP BY ALL",
)

# current state: customers' orders are versions of an object
OBJECTS_SQL = "obj AS (SELECT o_custkey AS id, o_orderkey AS version, o_orderstatus AS phase, o_orderpriority AS kind, epoch_us(o_orderdate) // 1000 AS t_ms, CAST(o_orderkey % 5 AS BIGINT) AS ready, CAST(o_custkey % 4 AS BIGINT) AS desired FROM orders), cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t_ms DESC, version DESC) AS rn FROM obj) WHERE rn = 1)"


def objects(s, d):
    rows = table(s, d, "orders").withColumn("t_ms", epoch_ms("o_orderdate"))
    return rows.selectExpr("o_custkey AS id", "o_orderkey AS version", "o_orderstatus AS phase", "o_orderpriority AS kind", "t_ms", "o_orderkey % 5 AS ready", "o_custkey % 4 AS desired")


def current(s, d):
    return catalog.replace_by_version(objects(s, d), ["id"], ["t_ms", "version"])


CUR = "SELECT id, version, phase, t_ms FROM cur"
LATE = 950_000_000_000
for name in ("mv_k8s_current", "replace_by_version"):
    register(name, lambda s, d: current(s, d).select("id", "version", "phase", "t_ms"), f"WITH {OBJECTS_SQL} {CUR}")
register("current_fresh_only", lambda s, d: current(s, d).where(F.col("t_ms") > LATE).select("id", "version", "phase", "t_ms"), f"WITH {OBJECTS_SQL} {CUR} WHERE t_ms > {LATE}")
register("k8s_inventory", lambda s, d: current(s, d).where((F.col("t_ms") > LATE) & (F.col("phase") != "P")).groupBy("kind", "phase").agg(F.count("*").alias("n")), f"WITH {OBJECTS_SQL} SELECT kind, phase, count(*) AS n FROM cur WHERE t_ms > {LATE} AND phase <> 'P' GROUP BY ALL")
register("k8s_ready_vs_desired", lambda s, d: current(s, d).where("ready < desired").select("id", "ready", "desired"), f"WITH {OBJECTS_SQL} SELECT id, ready, desired FROM cur WHERE ready < desired")
register(
    "k8s_capacity_over_time",
    lambda s, d: objects(s, d).select((F.floor(F.col("t_ms") / (30 * DAY * 1000)) * (30 * DAY * 1000)).cast("long").alias("bucket_ms"), F.explode(F.create_map(F.lit("ready"), F.col("ready"), F.lit("desired"), F.col("desired"))).alias("what", "n")).groupBy("bucket_ms", "what").agg(F.sum("n").alias("n")),
    f"WITH {OBJECTS_SQL} SELECT t_ms // {30 * DAY * 1000} * {30 * DAY * 1000} AS bucket_ms, what, CAST(sum(n) AS BIGINT) AS n FROM (SELECT t_ms, unnest(['ready', 'desired']) AS what, unnest([ready, desired]) AS n FROM obj) GROUP BY ALL",
)
register("k8s_manifest_versions", lambda s, d: objects(s, d).groupBy("kind").agg(F.count_distinct("id", "version").alias("versions"), F.round(F.count_distinct("id") / F.count("*"), 6).alias("share")), f"WITH {OBJECTS_SQL} SELECT kind, count(DISTINCT (id, version)) AS versions, round(count(DISTINCT id) / count(*), 6) AS share FROM obj GROUP BY kind")
register("metric_namespaces", lambda s, d: points(s, d).groupBy(F.split("metric", r"\.")[0].alias("namespace")).agg(F.count("*").alias("points"), F.count_distinct("metric", "host").alias("series"), F.count_distinct("metric").alias("metrics")), f"WITH {POINTS_SQL} SELECT split_part(metric, '.', 1) AS namespace, count(*) AS points, count(DISTINCT (metric, host)) AS series, count(DISTINCT metric) AS metrics FROM pts GROUP BY 1")
register("log_noisiest", lambda s, d: telemetry.logs(table(s, d, "documents")).groupBy("service", "host").agg(F.count("*").alias("n"), F.round(F.avg(F.length("message")), 4).alias("length")).orderBy(F.col("n").desc(), "service", "host").limit(40), f"WITH {LOGS_SQL} SELECT service, host, count(*) AS n, round(avg(length(message)), 4) AS length FROM logs GROUP BY ALL ORDER BY n DESC, service, host LIMIT 40")
register("dbm_event_shape", lambda s, d: product.event_shape(table(s, d, "events"), "props"), "SELECT key, 'number' AS kind, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
register("rum_view_final", lambda s, d: catalog.replace_by_version(table(s, d, "conversations"), ["conv_id"], ["turn", "role"]).select("conv_id", "turn", "role"), "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS rn FROM conversations) WHERE rn = 1")
register("rum_event_lag", lambda s, d: points(s, d).groupBy("metric").agg(F.round(F.percentile(F.col("t_ms") % 10000, F.lit(0.9)), 4).alias("lag")), f"WITH {POINTS_SQL} SELECT metric, round(quantile_cont(t_ms % 10000, 0.9), 4) AS lag FROM pts GROUP BY metric")
register(
    "ci_test_history",
    lambda s, d: product.test_history(telemetry.check_runs(table(s, d, "events")), ["check_name", "host"]),
    f"WITH {CHECKS_SQL}, f AS (SELECT *, CASE WHEN status <> lag(status) OVER (PARTITION BY check_name, host ORDER BY t_ms, event_id) THEN 1 ELSE 0 END AS flip FROM runs) SELECT check_name, host, count(*) AS runs, CAST(sum(CASE WHEN status <> 'OK' THEN 1 ELSE 0 END) AS BIGINT) AS failed, CAST(sum(flip) AS BIGINT) AS flips FROM f GROUP BY ALL",
)
register("webhook_dedup", lambda s, d: (lambda e: e.unionAll(e).dropDuplicates(["event_id"]).select("event_id", "event_type"))(table(s, d, "events")), "SELECT event_id, event_type FROM events")
register(
    "flow_top_talkers",
    lambda s, d: product.top_talkers(table(s, d, "lineitem").selectExpr("concat('s', l_suppkey) AS src", "concat('p', l_partkey % 50) AS dst", "CAST(l_quantity AS BIGINT) AS bytes", "CAST(l_linenumber AS BIGINT) AS packets"), 25),
    "SELECT 's' || l_suppkey AS src, 'p' || (l_partkey % 50) AS dst, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes, CAST(sum(l_linenumber) AS BIGINT) AS packets FROM lineitem GROUP BY ALL ORDER BY bytes DESC, src, dst LIMIT 25",
)
register("ttl_by_table", lambda s, d: catalog.dropped_by_age(points(s, d), NOW, 7).groupBy("metric").agg(F.count("*").alias("n")), f"WITH {POINTS_SQL} SELECT metric, count(*) AS n FROM pts WHERE t_ms > {NOW - 7 * DAY * 1000} GROUP BY metric")
register(
    "late_by_evaluation_delay",
    lambda s, d: product.late_points(points(s, d).withColumn("arrived", F.col("t_ms") + F.col("k") * 1000), "arrived", 60_000, 30_000),
    f"WITH {POINTS_SQL} SELECT metric, count(*) FILTER (t_ms + k * 1000 > (t_ms // 60000 + 1) * 60000 + 30000) AS late, count(*) AS points FROM pts GROUP BY metric",
)
register(
    "incremental_cursor",
    lambda s, d: product.past_cursor(telemetry.transitions(table(s, d, "events")), telemetry.notifications(table(s, d, "events")).groupBy("monitor_id").agg((F.max("transition_at") - 6 * DAY * 1000).alias("cursor_ms")), "monitor_id", "inserted_at", NOW).select("event_id", "inserted_at"),
    f"WITH {MONITORS_SQL} SELECT event_id, inserted_at FROM trans LEFT JOIN (SELECT monitor_id, max(transition_at) - {6 * DAY * 1000} AS c FROM notes GROUP BY monitor_id) USING (monitor_id) WHERE inserted_at > greatest(coalesce(c, 0) - 30000, {NOW - DAY * 1000}) AND inserted_at <= {NOW}",
)
#: The bench's large series: order lines as points.
register(
    "lineitem_weekly",
    lambda s, d: table(s, d, "lineitem").withColumn("t_ms", epoch_ms("l_shipdate")).groupBy("l_returnflag", "l_linestatus", (F.floor(F.col("t_ms") / (7 * DAY * 1000)) * (7 * DAY * 1000)).cast("long").alias("bucket_ms"), "l_suppkey").agg(F.sum("l_quantity").alias("value")).groupBy("l_returnflag", "l_linestatus", "bucket_ms").agg(F.round(F.avg("value"), 6).alias("value")),
    f"SELECT l_returnflag, l_linestatus, bucket_ms, round(avg(value), 6) AS value FROM (SELECT l_returnflag, l_linestatus, epoch_us(l_shipdate) // 1000 // {7 * DAY * 1000} * {7 * DAY * 1000} AS bucket_ms, l_suppkey, sum(l_quantity) AS value FROM lineitem GROUP BY ALL) GROUP BY ALL",
)


def written(s, d):
    path = f"{shared_dir(s)}/ebbtide-facts-{uuid.uuid4().hex}"
    rows = points(s, d).select("t_ms", "metric", "host", "value")
    for batch, some in (("1/old", F.col("t_ms") < NOW), ("2/new", F.col("t_ms") >= NOW), ("1/old", F.col("t_ms") < NOW)):  # the first comes again
        views.sink_fact(rows.where(some), path, batch=batch)
    return views.committed(s, path).groupBy("metric", F.col("date").cast("string").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


register("sink_fact", written, f"WITH {POINTS_SQL} SELECT metric, CAST(CAST(epoch_ms(t_ms) AS DATE) AS VARCHAR) AS day, count(*) AS n, round(sum(value), 6) AS total FROM pts GROUP BY ALL")
register(
    "merged_rollup",
    lambda s, d: views.merged_rollup(rollup_1m(points(s, d).where("k < 50")).unionByName(rollup_1m(points(s, d).where("k >= 50")))).groupBy("metric").agg(F.sum("points").alias("points"), F.count("*").alias("rows"), F.round(F.sum("value_sum"), 6).alias("total")),
    f"WITH {POINTS_SQL} SELECT metric, CAST(sum(points) AS BIGINT) AS points, count(*) AS rows, round(sum(s), 6) AS total FROM (SELECT metric, host, env, role, canary, t_ms // 60000, count(*) AS points, sum(value) AS s FROM pts GROUP BY ALL) GROUP BY metric",
)
