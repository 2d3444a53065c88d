"""Monitors: ticks, detections, service checks, stateless judgement, and reads of their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import SeriesFrame, same_keys
from .aggregate import group_key, has_missing_group
from .models import anomalies_basic, band_check, outliers_mad
from .sliding import on_windows, reduced, sliding, window_reach

LEAST_DELAY_MS = 30_000
SEVERITY = {"Alert": 3, "Warn": 2, "No Data": 1, "OK": 0}
CHECK_SEVERITY = {"CRITICAL": 3, "WARNING": 2, "UNKNOWN": 1, "OK": 0}
CLOSES = ("expired", "definition_changed", "deleted")
NEVER_NOTIFIED = ("no_data_shown", *CLOSES)


def ranked(name: str | Column, table: dict[str, int]) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    out = F.lit(None).cast("int")
    for text, n in table.items():
        out = F.when(c == text, n).otherwise(out)
    return out


def mon_ticks(spark: SparkSession, monitors: list[int], from_ms: int, to_ms: int, every_ms: int) -> DataFrame:
    """(monitor_id, tick): a monitor's aligned ticks in [from, to)."""
    first = -(-from_ms // every_ms) * every_ms
    rows = spark.range(first, to_ms, every_ms).select(F.col("id").alias("tick"))
    return rows.select(F.explode(F.array(*map(F.lit, monitors)).cast("array<bigint>")).alias("monitor_id"), "tick")


def ticks_between(rows: DataFrame, at: str, every_ms: int) -> DataFrame:
    """(monitor_id, tick): each monitor's aligned ticks from its first row to its last."""
    first = (F.ceil(F.min(at) / every_ms) * every_ms).cast("long")
    spans = rows.groupBy("monitor_id").agg(first.alias("first"), F.max(at).alias("last")).where("first <= last")
    return spans.select("monitor_id", F.explode(F.sequence("first", "last", F.lit(every_ms))).alias("tick"))


def tick_every_ms(reach_ms: int) -> int:
    """A minute for windows under a day, ten up to two days, thirty beyond."""
    return 60_000 * (1 if reach_ms < 86_400_000 else 10 if reach_ms <= 172_800_000 else 30)


def mon_period(ticks: DataFrame, step_ms: int, reach_ms: int, delay_ms: int = 0) -> DataFrame:
    """Ticks with what they read: ``to`` lies the delay (half a minute at least) back, on the step."""
    to = (F.floor((F.col("tick") - max(delay_ms, LEAST_DELAY_MS)) / step_ms) * step_ms).cast("long")
    return ticks.withColumn("to_ms", to).withColumn("from_ms", F.col("to_ms") - reach_ms)


def mon_threshold(sf: SeriesFrame, periods: DataFrame, how: str = "avg") -> DataFrame:
    """(tick, keys..., value): each group's window reduced to one value."""
    return on_windows(sf.df, sf.keys, periods).select("tick", *sf.keys, reduced(how, sf.step_ms).alias("value"))


def mon_change(sf: SeriesFrame, periods: DataFrame, shift_ms: int, percent: bool = False, how: str = "avg") -> DataFrame:
    """The same over each bucket's change from the bucket ``shift_ms`` before; buckets without that partner drop."""
    old = sf.df.select(*sf.keys, (F.col("bucket_ms") + shift_ms).alias("bucket_ms"), F.col("value").alias("old"))
    rows = sf.df.alias("l").join(old.alias("r"), same_keys((*sf.keys, "bucket_ms"))).select("l.*", "r.old")
    diff = F.col("value") - F.col("old")
    value = F.try_divide(diff, F.col("old")) * 100 if percent else diff
    return mon_threshold(sf.with_df(rows.select(*sf.keys, "bucket_ms", value.alias("value")).where("value is not null")), periods, how)


def mon_anomaly(sf: SeriesFrame, periods: DataFrame, bounds: float = 3.0, direction: str = "both", recovery_ms: int | None = None) -> DataFrame:
    """(tick, keys..., value, recovery): share of banded buckets outside, in the window and in its last ``recovery_ms``."""
    flags = anomalies_basic(sf, bounds).select(*sf.keys, "bucket_ms", band_check(direction).cast("double").alias("value"))
    share = reduced("avg", sf.step_ms)
    whole = on_windows(flags, sf.keys, periods).select("tick", *sf.keys, share.alias("value"))
    if not recovery_ms:
        return whole.withColumn("recovery", F.lit(None).cast("double"))
    late = on_windows(flags, sf.keys, periods, recovery_ms).select("tick", *sf.keys, share.alias("recovery"))
    return whole.alias("l").join(late.alias("r"), same_keys(("tick", *sf.keys)), "left").select("l.*", "r.recovery")


def mon_outlier(sf: SeriesFrame, **how) -> DataFrame:
    """(keys..., value, status): 1 for outlying groups, 0 for others; under three groups all are skipped."""
    flags = outliers_mad(sf, **how)
    few = F.count("*").over(Window.partitionBy()) < 3
    return flags.select(*sf.keys, F.col("outlier").cast("double").alias("value"), F.when(few, "few_groups").otherwise("judged").alias("status"))


def mon_full_window(sf: SeriesFrame, periods: DataFrame, bucket_ms: int) -> DataFrame:
    """(tick, keys..., full): the window's first bucket is filled and at most three are empty."""
    phase = F.pmod("from_ms", F.lit(bucket_ms))
    phases = sorted(r.phase for r in periods.select(phase.alias("phase")).distinct().collect())  # at most buckets over steps
    begin = F.floor((F.col("bucket_ms") - F.col("phase")) / bucket_ms) * bucket_ms + F.col("phase")
    slots = sf.df.withColumn("phase", F.explode(F.array(*map(F.lit, phases)).cast("array<bigint>"))).select(*sf.keys, "phase", begin.cast("long").alias("bucket_ms")).distinct()
    asked = periods.withColumn("phase", phase)
    reach = window_reach(periods) or bucket_ms
    found = sliding(slots.withColumn("value", F.lit(1.0)), (*sf.keys, "phase"), asked.select("to_ms", "phase"), reach)
    full = (F.col("first_ms") == F.col("from_ms")) & (F.lit(-(-reach // bucket_ms)) - F.col("n") <= 3)
    return asked.select("tick", "from_ms", "to_ms", "phase").join(found, ["to_ms", "phase"]).select("tick", *sf.keys, full.alias("full"))


def mon_groups(evaluated: DataFrame, keys: tuple[str, ...], most: int = 1000) -> DataFrame:
    """With ``group_key``; N/A groups drop. More than ``most`` groups in a tick is an error, raised when the rows are read."""
    rows = evaluated.where(~has_missing_group(keys)).withColumn("group_key", group_key(keys))
    n = F.count("*").over(Window.partitionBy("tick"))
    return rows.withColumn("n", n).withColumn("group_key", F.when(F.col("n") > most, F.raise_error(F.lit(f"more than {most} groups"))).otherwise(F.col("group_key"))).drop("n")


def holds(comparator: str, value: Column, bound: float | Column) -> Column:
    return {">": value > bound, ">=": value >= bound, "<": value < bound, "<=": value <= bound, "==": value == bound, "!=": value != bound}[comparator]


def judge_threshold(value: Column, comparator: str, critical: float, warning: float | None = None) -> Column:
    """A value's state by thresholds alone; what depends on the state before is in the stateful step."""
    out = F.when(holds(comparator, value, critical), "Alert")
    if warning is not None:
        out = out.when(holds(comparator, value, warning), "Warn")
    return out.otherwise("OK")


def check_newest_runs(runs: DataFrame, series: list[str], last: int) -> DataFrame:
    """The newest max(last, 2) known and UNKNOWN runs of each series; runs of one time count once, the worst stays."""
    one = runs.groupBy(*series, "t_ms").agg(F.max_by("status", ranked("status", CHECK_SEVERITY)).alias("status"))
    unknown = F.col("status") == "UNKNOWN"
    w = Window.partitionBy(*series, unknown).orderBy(F.col("t_ms").desc())
    return one.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= max(last, 2)).drop("nth")


def check_streaks(newest: DataFrame, series: list[str], last: int) -> DataFrame:
    """(series..., latest, newest_ms, gap_ms, critical, warning, ok, unknown, ok_since_unknown): lengths of leading runs."""
    order = F.col("t_ms").desc()
    all_w = Window.partitionBy(*series).orderBy(order)
    rows = newest.withColumn("rn", F.row_number().over(all_w)).withColumn("next_ms", F.lead("t_ms").over(all_w))
    known = F.col("status") != "UNKNOWN"
    rows = rows.withColumn("kn", F.when(known, F.sum(known.cast("int")).over(all_w)))
    within = known & (F.col("kn") <= last)
    n_known = F.sum(within.cast("int"))

    def leading(status: str) -> Column:
        return F.coalesce(F.min(F.when(within & (F.col("status") != status), F.col("kn"))) - 1, n_known).cast("long")

    unknown = F.coalesce(F.min(F.when(known, F.col("rn"))) - 1, F.count("*")).cast("long")
    head = F.col("rn") <= last
    ok_since = F.coalesce(F.min(F.when(head & (F.col("status") != "OK"), F.col("rn"))) - 1, F.sum(head.cast("int"))).cast("long")
    first = F.col("rn") == 1
    return rows.groupBy(*series).agg(
        F.max(F.when(first, F.col("status"))).alias("latest"),
        F.max("t_ms").alias("newest_ms"),
        F.max(F.when(first, F.col("t_ms") - F.col("next_ms"))).alias("gap_ms"),
        leading("CRITICAL").alias("critical"),
        leading("WARNING").alias("warning"),
        leading("OK").alias("ok"),
        unknown.alias("unknown"),
        ok_since.alias("ok_since_unknown"),
    )


def check_live(streaks: DataFrame, to_ms: int) -> DataFrame:
    """Series that still report: their silence is at most twice their last gap and a minute; a single run counts."""
    return streaks.where(F.col("gap_ms").isNull() | (F.lit(to_ms) - F.col("newest_ms") <= F.col("gap_ms") * 2 + 60_000))


def check_worst(streaks: DataFrame, by: list[str]) -> DataFrame:
    worst = F.max_by("latest", ranked("latest", CHECK_SEVERITY))
    return streaks.groupBy(*by).agg(worst.alias("worst"), F.max("newest_ms").alias("last_point"), F.count("*").alias("series"))


def tag_list(column: str = "tags") -> Column:
    """Tags as sorted ``key:value`` texts; a bare tag is its key."""
    entry = lambda e: F.transform(e["value"], lambda v: F.when(v == "", e["key"]).otherwise(F.concat(e["key"], F.lit(":"), v)))
    return F.array_sort(F.flatten(F.transform(F.map_entries(F.col(column)), entry)))


def state_overall(groups: DataFrame, by: list[str], state: str = "state") -> DataFrame:
    """The most severe group's state."""
    return groups.groupBy(*by).agg(F.max_by(state, ranked(state, SEVERITY)).alias("state"))


def latest_states(transitions: DataFrame) -> DataFrame:
    """Each group's newest transition; a struct keeps its nulls."""
    rest = ["to_state", "reason", "at_ms", "first_triggered_at", "last_triggered_at"]
    out = transitions.groupBy("monitor_id", "group_key").agg(F.max_by(F.struct(*rest), F.struct("at_ms", "inserted_at")).alias("r"))
    return out.select("monitor_id", "group_key", *[F.col(f"r.{c}").alias(c) for c in rest])


def open_groups(transitions: DataFrame) -> DataFrame:
    """Groups whose newest transition does not close them."""
    return latest_states(transitions).where(~F.col("reason").isin(*CLOSES))


def mon_status(transitions: DataFrame) -> DataFrame:
    """(monitor_id, state, alert, warn, no_data, ok, last_triggered_at) over open groups."""
    groups = open_groups(transitions)
    counts = [F.sum((F.col("to_state") == s).cast("int")).alias(n) for s, n in (("Alert", "alert"), ("Warn", "warn"), ("No Data", "no_data"), ("OK", "ok"))]
    return groups.groupBy("monitor_id").agg(F.max_by("to_state", ranked("to_state", SEVERITY)).alias("state"), *counts, F.max("last_triggered_at").alias("last_triggered_at"))


def mon_group_list(transitions: DataFrame, evaluations: DataFrame, now_ms: int) -> DataFrame:
    """Open groups with their state, since when, and the last value of the past day, null if there is none."""
    recent = evaluations.where((F.col("at_ms") > now_ms - 86_400_000) & (F.col("at_ms") <= now_ms) & F.col("value").isNotNull())
    last = recent.groupBy("monitor_id", "group_key").agg(F.max_by("value", F.struct("at_ms", "event_id")).alias("last_value"))
    return open_groups(transitions).join(last, ["monitor_id", "group_key"], "left").select("monitor_id", "group_key", F.col("to_state").alias("state"), "reason", F.col("at_ms").alias("since"), "last_value")


def notify_due(transitions: DataFrame, notifications: DataFrame, cursor_ms: int, now_ms: int, batch: int = 1000) -> DataFrame:
    """Transitions to notify: past the cursor (half a minute of overlap, at most a day back), not silent, not done yet."""
    since = max(cursor_ms - 30_000, now_ms - 86_400_000)
    silent = F.col("reason").isin(*NEVER_NOTIFIED) | ((F.col("reason") == "new") & (F.col("to_state") == "OK"))
    rows = transitions.where((F.col("inserted_at") > since) & (F.col("inserted_at") <= now_ms) & ~silent)
    done = notifications.select("monitor_id", "group_key", F.col("transition_at").alias("at_ms"))
    return rows.join(done, ["monitor_id", "group_key", "at_ms"], "left_anti").orderBy("inserted_at", "monitor_id", "group_key").limit(batch)
