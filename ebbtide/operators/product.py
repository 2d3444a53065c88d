"""Reads that telemetry tables exist for: traces, pathways, snapshots, current state, failures and flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sketch import sketch_key, sketch_value
from ..storage import durable


def trace_by_id(spans: DataFrame, high: int, low: int) -> DataFrame:
    """All spans of a 128-bit trace id, kept as two longs so that no bit passes through a double."""
    return spans.where((F.col("trace_id_high") == high) & (F.col("trace_id") == low))


def service_latest_spans(spans: DataFrame, service: str, n: int) -> DataFrame:
    return spans.where(F.col("service") == service).orderBy(F.col("start_ms").desc(), "trace_id", "span_id").limit(n)


def errors_by_resource(spans: DataFrame) -> DataFrame:
    return spans.where("error = 1").groupBy("service", "resource").agg(F.count("*").alias("errors"))


def quantile_by_resource(spans: DataFrame, q: float) -> DataFrame:
    return spans.groupBy("service", "resource").agg(F.percentile("duration", F.lit(q)).alias("duration"))


def sketched_quantile(rows: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """(keys..., value, count): a quantile of each group within the sketch's relative error, about 0.8 %.

    Values are counted by bucket map-side, so a hot group sends as many rows as it has buckets, not as it has values."""
    cells = rows.where(F.col(value).isNotNull()).groupBy(*keys, sketch_key(F.col(value)).alias("_bucket")).agg(F.count("*").alias("_n"))
    run = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket"))
    cells = cells.withColumn("_run", run).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    return cells.where(F.col("_run") > q * (F.col("_all") - 1)).groupBy(*keys).agg(sketch_value(F.min("_bucket")).alias(value), F.max("_all").alias("count"))


def service_overview(spans: DataFrame) -> DataFrame:
    return spans.groupBy("service").agg(F.count("*").alias("hits"), F.sum("error").alias("errors"), F.avg("duration").alias("latency"))


def pathway_graph(edges: DataFrame) -> DataFrame:
    """(from_node, to_node, n): edges by a self-join of each row's parent to its parent's row."""
    parent = edges.select("trace_id", F.col("span_id").alias("parent_id"), F.col("service").alias("from_node"))
    child = edges.where("parent_id is not null").select("trace_id", "parent_id", F.col("service").alias("to_node"))
    return child.join(parent, ["trace_id", "parent_id"]).groupBy("from_node", "to_node").agg(F.count("*").alias("n"))


def span_depths(spans: DataFrame, paths: bool = True) -> DataFrame:
    """(trace_id, span_id, depth, path): each span's place in its tree, at any depth; the path only if asked for.

    Each round doubles how far up a span has looked, so rounds grow with the logarithm of the depth. Spans that
    reach no root are left out: below a missing parent, or in a cycle, where they look further than there are spans.
    """
    columns = ["trace_id", "span_id", "up", "depth"] + ["path"] * paths
    now = spans.select("trace_id", "span_id", F.col("parent_id").alias("up"), F.col("parent_id").isNotNull().cast("int").alias("depth"), F.array("span_id").alias("path"))
    now = durable(now.select(*columns))
    for _ in range(now.count().bit_length() + 1):
        if now.where("up is not null").isEmpty():
            break
        met = now.where("up is not null").alias("c").join(now.alias("p"), (F.col("c.trace_id") == F.col("p.trace_id")) & (F.col("c.up") == F.col("p.span_id")))
        further = met.select("c.trace_id", "c.span_id", "p.up", (F.col("c.depth") + F.col("p.depth")).alias("depth"), *[F.concat("p.path", "c.path").alias("path")] * paths)
        now = durable(now.where("up is null").unionAll(further))
    return now.where("up is null").drop("up")


def snapshot_complete(frames: DataFrame) -> DataFrame:
    """Snapshots of which as many frames arrived as they say they have."""
    return frames.groupBy("group_id").agg(F.count("*").alias("frames"), F.max("group_size").alias("group_size")).where("frames = group_size")


def processes_at(frames: DataFrame, at_ms: int) -> DataFrame:
    """Rows of each host's newest snapshot at or before a time."""
    newest = frames.where(F.col("t_ms") <= at_ms).groupBy("host").agg(F.max_by("group_id", F.struct("t_ms", "group_id")).alias("group_id"))
    return frames.join(newest, ["host", "group_id"], "left_semi")


def silent_hosts(rows: DataFrame, now_ms: int, after_ms: int) -> DataFrame:
    return rows.groupBy("host").agg(F.max("t_ms").alias("last_ms")).where(F.lit(now_ms) - F.col("last_ms") > after_ms)


def test_history(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., runs, failed, flips): how often a test failed, and how often it changed from one run to the next."""
    w = Window.partitionBy(*keys).orderBy("t_ms", "event_id")
    rows = runs.withColumn("flip", (F.col("status") != F.lag("status").over(w)).cast("int"))
    return rows.groupBy(*keys).agg(F.count("*").alias("runs"), F.sum((F.col("status") != "OK").cast("int")).alias("failed"), F.coalesce(F.sum("flip"), F.lit(0)).alias("flips"))


def top_talkers(flows: DataFrame, n: int) -> DataFrame:
    sums = flows.groupBy("src", "dst").agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"))
    return sums.orderBy(F.col("bytes").desc(), "src", "dst").limit(n)


def event_shape(docs: DataFrame, column: str) -> DataFrame:
    """(key, kind, n): keys one level down in JSON texts, and the JSON type of their values."""
    pairs = docs.select(F.explode(F.from_json(column, "map<string,string>")).alias("key", "raw"))
    kind = (
        F.when(F.col("raw").isNull(), "null")
        .when(F.col("raw").rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), "number")
        .when(F.col("raw").isin("true", "false"), "boolean")
        .when(F.col("raw").startswith("{"), "object")
        .when(F.col("raw").startswith("["), "array")
        .otherwise("string")
    )
    return pairs.groupBy("key", kind.alias("kind")).agg(F.count("*").alias("n"))


def without_digest(images: DataFrame) -> DataFrame:
    """(image, name): images known only by a local id, since no registry has given them a content digest."""
    return images.where(~F.coalesce(F.col("digest").startswith("sha"), F.lit(False))).select(F.col("digest").alias("image"), "name").distinct()


def repaired_kinds(manifests: DataFrame) -> DataFrame:
    """Manifests with a kind on each: its own, else the newest that the object was ever sent with."""
    known = manifests.where(F.coalesce("kind", F.lit("")) != "").groupBy("uid").agg(F.max_by("kind", F.struct("received_ms", "version")).alias("known"))
    return manifests.join(known, "uid", "left").withColumn("kind", F.coalesce(F.nullif("kind", F.lit("")), "known")).drop("known")


def fleet_versions(hosts: DataFrame) -> DataFrame:
    """(agent_version, hosts): how many hosts run each version, by the newest report of each."""
    newest = hosts.groupBy("host").agg(F.max_by("agent_version", F.struct("received_ms", "agent_version")).alias("agent_version"))
    return newest.groupBy("agent_version").agg(F.count("*").alias("hosts"))


def test_run(tests: DataFrame) -> DataFrame:
    """(suite, tests, failed, slowest, total): a run's suites, failures first in the reader's order."""
    failed = F.sum((F.col("status") == "fail").cast("long"))
    return tests.groupBy("suite").agg(F.count_distinct("test").alias("tests"), failed.alias("failed"), F.max("duration").alias("slowest"), F.sum("duration").alias("total"))


def rule_hits(results: DataFrame) -> DataFrame:
    """(rule, resources, matches, failed): what each scanning rule found, and how many scans of it failed."""
    good = F.when(~F.coalesce("failed", F.lit(False)), F.col("matches"))
    return results.groupBy("rule").agg(F.count_distinct("resource").alias("resources"), F.coalesce(F.sum(good), F.lit(0)).alias("matches"), F.count_if("failed").alias("failed"))


def statement_volume(events: DataFrame, every_ms: int) -> DataFrame:
    """(track, bucket_ms, events, signatures, bytes): how much each database track sends."""
    bucket = (F.floor(F.col("t_ms") / every_ms) * every_ms).cast("long")
    return events.groupBy("track", bucket.alias("bucket_ms")).agg(F.count("*").alias("events"), F.count_distinct("signature").alias("signatures"), F.sum(F.octet_length("statement")).alias("bytes"))


def exit_lateness(exits: DataFrame) -> DataFrame:
    """(exit_code, exits, late_ms, latest_ms): how long after a container's end its event arrives."""
    late = F.col("received_ms") - F.col("exited_at") * 1000
    return exits.groupBy("exit_code").agg(F.count("*").alias("exits"), F.avg(late).alias("late_ms"), F.max(late).alias("latest_ms"))


def late_points(points: DataFrame, arrived: str, every_ms: int, delay_ms: int) -> DataFrame:
    """(metric, late, points): points that arrive after their bucket was evaluated, ``delay_ms`` after its end."""
    read_at = (F.floor(F.col("t_ms") / every_ms) + 1) * every_ms + delay_ms
    return points.groupBy("metric").agg(F.count_if(F.col(arrived) > read_at).alias("late"), F.count("*").alias("points"))


def past_cursor(rows: DataFrame, cursors: DataFrame, key: str, at: str, now_ms: int, overlap_ms: int = 30_000, floor_ms: int = 86_400_000) -> DataFrame:
    """Rows past each key's cursor (key, cursor_ms), read again ``overlap_ms`` back, and never further back than ``floor_ms``."""
    joined = rows.join(cursors, key, "left")
    since = F.greatest(F.coalesce("cursor_ms", F.lit(0).cast("long")) - overlap_ms, F.lit(now_ms - floor_ms))
    return joined.where((F.col(at) > since) & (F.col(at) <= now_ms)).drop("cursor_ms")
