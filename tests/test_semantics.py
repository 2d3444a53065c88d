"""Hand fixtures: gaps, ties, missing tags, filling, models and the state of groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.functions import alongtime as along
from ebbtide.functions import pointwise as point
from ebbtide.functions import sketch
from ebbtide.model import SeriesFrame
from ebbtide.operators import across, fill, models, product
from ebbtide.operators import predicates as pr
from ebbtide.sources import normalise as norm
from ebbtide.storage import Folder
from ebbtide.streaming import state


def frame(spark, rows, keys=(), step=10_000, end=1_000_000):
    schema = "".join(f"{k} string, " for k in keys) + "bucket_ms long, value double"
    return SeriesFrame(spark.createDataFrame(rows, schema), tuple(keys), step, 0, end)


def values(sf):
    return [r.value for r in sf.df.orderBy(*sf.keys, "bucket_ms").collect()]


def test_differences_span_gaps(spark):
    sf = frame(spark, [(0, 1.0), (10_000, 4.0), (40_000, 10.0)])
    assert values(along.fn_diff(sf)) == [3.0, 6.0]
    assert values(along.fn_per_second(sf)) == [0.3, 0.2]
    assert values(along.fn_integral(sf)) == [0.0, 30.0, 210.0]


def test_counter_reset_is_a_gap_and_no_change_is_zero(spark):
    assert values(along.fn_monotonic_diff(frame(spark, [(0, 5.0), (1, 5.0), (2, 1.0), (3, 4.0)]))) == [0.0, 3.0]


def test_rounding_goes_away_from_zero(spark):
    assert values(point.fn_round(frame(spark, [(0, 2.5), (1, -2.5), (2, 0.4)]))) == [3.0, -3.0, 0.0]


def test_logarithms_of_nothing_are_gaps(spark):
    assert values(point.fn_log2(frame(spark, [(0, 8.0), (1, 0.0), (2, -1.0)]))) == [3.0]


def test_moving_average_starts_short(spark):
    w = frame(spark, [(i, v) for i, v in enumerate((1.0, 3.0, 5.0, 9.0))])
    smooth = w.values(F.avg("value").over(w.window().rowsBetween(-1, 0)))
    assert values(smooth) == [1.0, 2.0, 4.0, 7.0]


def test_not_keeps_rows_without_the_key(spark):
    rows = spark.createDataFrame([(1, {"env": ["a"]}), (2, {"x": ["y"]}), (3, None)], "i int, tags map<string,array<string>>")
    assert sorted(r.i for r in rows.where(pr.filter_not(pr.filter_tag_eq("env", "a"))).collect()) == [2, 3]
    assert pr.like_pattern("a_%*") == "a\\_\\%%"


def test_linear_fill_needs_a_peer_and_both_ends(spark):
    rows = [(1, "g", 0, 0.0), (1, "g", 40_000, 4.0), (2, "g", 10_000, 7.0), (2, "g", 50_000, 7.0), (3, "lone", 0, 1.0), (3, "lone", 40_000, 1.0)]
    df = spark.createDataFrame(rows, "series_id long, k string, bucket_ms long, value double")
    got = {(r.series_id, r.bucket_ms): r.value for r in fill.fill_series(df, ("k",), "linear", 300).collect()}
    assert got[(1, 10_000)] == 1.0
    assert (2, 0) not in got and (1, 50_000) not in got  # a leading gap and an end stay
    assert (3, 10_000) not in got
    assert (1, 10_000) not in {(r.series_id, r.bucket_ms) for r in fill.fill_series(df, ("k",), "linear", 5).collect()}


def test_default_zero_without_series_is_one_line_of_zeros(spark):
    sf = frame(spark, [], ("k",), 10_000, 30_000)
    assert values(fill.default_zero(sf)) == [0.0, 0.0, 0.0]


def test_groups_pair_by_tag_set(spark):
    a = frame(spark, [("x", "y", 0, 6.0), ("x", None, 0, 1.0)], ("a", "b"))
    b = frame(spark, [("y", "x", 0, 2.0)], ("b", "a"))
    assert values(across.arith("div", a, b)) == [3.0]
    assert values(across.arith("div", a, 0.0)) == []
    with pytest.raises(ValueError):
        across.arith("add", a, frame(spark, [], ("c",)))


def test_top_ties_go_by_group_with_missing_last(spark):
    sf = frame(spark, [(k, 0, 1.0) for k in ("b", "a", None, "c", "d", "e")], ("k",))
    assert {r.k for r in across.fn_top(sf, 5).df.collect()} == {"a", "b", "c", "d", "e"}


def test_calendar_shift_follows_the_clock():
    spring = 1711893600000  # 2024-03-31 14:00 UTC, the day Berlin's clocks went forward
    assert across.calendar_shift(spring, "-1d", "Europe/Berlin") == -23 * 3600
    assert across.calendar_shift(spring, "-1d") == -86400


def test_basic_band(spark):
    sf = frame(spark, [(i, 20.5 if i % 3 else 17.5) for i in range(13)], step=1, end=13)
    last = models.anomalies_basic(sf, 3).orderBy(F.col("bucket_ms").desc()).first()
    assert (last.lower, last.upper) == pytest.approx((20.5 - 3 * 2**0.5, 20.5 + 3 * 2**0.5))  # a third of the twelve before lie 3 lower


def test_mad_flags_by_share(spark):
    rows = [(k, t, 1.0 + i * 0.01) for i, k in enumerate("abcd") for t in range(4)]
    rows = [(k, t, 50.0 if (k, t) == ("a", 0) else v) for k, t, v in rows]
    sf = frame(spark, rows, ("k",))
    flagged = lambda pct: {r.k for r in models.outliers_mad(sf, 3.0, pct).where("outlier").collect()}
    assert flagged(20) == {"a"} and flagged(30) == set()


def test_dbscan_flags_the_far_series(spark):
    rows = [(k, t, float(v)) for k, v in (("a", 1), ("b", 1.1), ("c", 1.2), ("far", 90)) for t in range(3)]
    assert {r.k for r in models.outliers_dbscan(frame(spark, rows, ("k",)), 3.0).where("outlier").collect()} == {"far"}
    two = frame(spark, [r for r in rows if r[0] in ("a", "far")], ("k",))
    assert models.outliers_dbscan(two, 3.0).where("outlier").count() == 0


def test_huber_ignores_a_spike():
    x = np.arange(20.0)
    y = 2 * x + 1 + np.where(x == 7, 100, 0) + np.sin(x) * 1e-3
    base, slope = along.huber_line(x, y)
    assert abs(slope - 2) < 0.01 and abs(base - 1) < 0.05


def test_segments_find_a_level_shift():
    v = np.array([10, 10.13, 9.9, 10.02, 10.11, 20, 20.17, 19.93, 20.05, 20.1])
    assert along.segments(v) == [(0, 5), (5, 10)]
    assert along.segments(np.array([1.0, 1, 1, 1, 1, 1, 9, 1])) == [(0, 8)]  # a flat series' blip is no segment


def test_decomposition_of_an_exact_wave():
    t = np.arange(24 * 8)
    wave = np.sin(2 * np.pi * t / 24) * 5
    seasonal, trend = models.decompose(wave + 0.1 * t, 24, outer=1)
    assert np.abs(seasonal - wave)[24:-24].max() < 0.2 and np.abs(trend - 0.1 * t)[24:-24].max() < 0.2


def test_airline_repeats_a_season():
    t = np.arange(7 * 12)
    y = np.tile(np.arange(12.0), 7) + 0.5 * t
    said, _ = models.airline_forecast(y, 12, *models.airline_fit(y, 12), 12)
    assert np.allclose(said, np.arange(12.0) + 0.5 * np.arange(84, 96), atol=1e-6)


def test_sketch_keys(spark):
    got = spark.createDataFrame([(1.0,), (0.0,), (-1.0,)], "v double").select(sketch.sketch_key(F.col("v")).alias("k")).collect()
    assert [r.k for r in got] == [1338, 0, -1338]


def test_tag_texts(spark):
    row = spark.createDataFrame([(["url:http://x", "a:1", "a:2", "bare"],)], "t array<string>").select(norm.multimap(F.col("t")).alias("m")).first()
    assert row.m == {"url": ["http://x"], "a": ["1", "2"], "bare": [""]}


def test_dead_letters_keep_no_probe_and_no_secret(spark):
    rows = [("t", 1, "series_v2", "/x?api_key=abc", {"api_key": "abc"}, body) for body in ("", "{}", '{"series": "no', '{"series":[{"type":1}]}')]
    landing = spark.createDataFrame(rows, "tenant_id string, received_ms long, intake string, path string, query map<string,string>, body string")
    facts, dead = norm.normalise(landing, norm.SPECS["series_v2"])
    assert facts.count() == 0
    got = dead.collect()
    assert sorted(r.reason for r in got) == ["decode_error", "unexpected_shape"]
    assert all("abc" not in r.path and r.query == {} for r in got)


D = state.Definition(critical=10, warning=5, critical_recovery=8, new_group_delay=0, window=3600_000, notify_no_data=True)
TICKS = "monitor_id long, group_key string, tick long, status string, value double, last_point long, from_ms long, to_ms long, recovery double, streaks " + state.STREAKS


def moves(spark, d, ticks):
    """(tick, to, reason, crossed) of one group's ticks (at, status, value[, recovery or streaks])."""
    rows = []
    for at, status, value, *more in ticks:
        recovery, streaks = (more[0], None) if more and not isinstance(more[0], list) else (None, more[0] if more else None)
        rows.append((1, "g", at, status, value, at if value is not None or streaks else None, at - 3600_000, at, recovery, streaks))
    after = state.folded(spark.createDataFrame(rows, TICKS), d)
    got = [(r.at_ms, r.to_state, r.reason, r.crossed) for r in state.transitions(after).collect()]
    return got, state.memory(after).collect()


def test_state_has_hysteresis_and_one_transition_a_tick(spark):
    got, _ = moves(spark, D, [(0, "judged", 1.0), (1, "judged", 11.0), (2, "judged", 9.0), (3, "judged", 8.0), (4, "judged", 1.0)])
    assert got == [(0, "OK", "new", None), (1, "Alert", "threshold", "critical"), (3, "Warn", "threshold", "warning"), (4, "OK", "recovery", None)]


def test_warning_recovery_and_shares(spark):
    d = state.Definition(critical=0.5, warning=0.25, warning_recovery=0.1, new_group_delay=0)
    got, _ = moves(spark, d, [(0, "judged", 0.3), (1, "judged", 0.2), (2, "judged", 0.1)])
    assert got == [(0, "Warn", "new", "warning"), (2, "OK", "recovery", "warning_recovery")]
    got, _ = moves(spark, state.Definition(critical=0.5, critical_recovery=0.0, new_group_delay=0), [(0, "judged", 0.9, 0.9), (1, "judged", 0.1, 0.2), (2, "judged", 0.1, 0.0)])
    assert got == [(0, "Alert", "new", "critical"), (2, "OK", "recovery", "critical_recovery")]


def test_silence_becomes_no_data_and_then_expires(spark):
    hour = state.HOUR
    got, left = moves(spark, D, [(0, "judged", 1.0), (hour, "absent", None), (2 * hour, "absent", None), (24 * hour, "absent", None)])
    assert not left and got == [(0, "OK", "new", None), (2 * hour, "No Data", "no_data", None), (24 * hour, "OK", "expired", None)]


def test_shown_no_data_resumes_without_a_notice(spark):
    d = state.Definition(critical=10, on_missing_data="show", new_group_delay=0)
    got, left = moves(spark, d, [(0, "judged", 11.0), (1, "absent", None), (2, "judged", 12.0)])
    assert got == [(0, "Alert", "new", "critical"), (1, "No Data", "no_data_shown", None), (2, "Alert", "no_data_shown", "critical")]
    assert (left[0].first_triggered_at, left[0].last_triggered_at, left[0].interrupted) == (0, 2, None)


@pytest.mark.parametrize("how, want", [("resolve", [(2, "OK", "no_data", None)]), ("show_and_notify", [(2, "No Data", "no_data", None)]), ("default", []), (None, [])])
def test_missing_data(spark, how, want):
    got, _ = moves(spark, state.Definition(critical=10, on_missing_data=how, new_group_delay=0), [(0, "judged", 11.0), (1, "skipped", None, 0.0), (2, "absent", None)])
    assert got[1:] == [(1, *w[1:]) for w in want]


def test_timeout_and_sums_of_nothing(spark):
    got, _ = moves(spark, state.Definition(critical=10, timeout=5, new_group_delay=0), [(0, "judged", 11.0), (4, "absent", None), (5, "absent", None)])
    assert got[1:] == [(5, "OK", "timeout", None)]
    got, _ = moves(spark, state.Definition(critical=10, on_missing_data="default", sum_threshold=True, new_group_delay=0), [(0, "judged", 11.0), (4, "absent", None)])
    assert got[1:] == [(4, "OK", "recovery", None)]


def test_streaks_of_checks(spark):
    s = lambda c=0, w=0, o=0, u=0, k=0: [(c, w, o, u, k)]
    d = state.Definition(kind="check", critical=2, warning=2, ok=2, unknown=3, new_group_delay=0)
    ticks = [(0, s(o=2)), (1, s(c=1)), (2, s(c=2)), (3, s(o=1)), (4, s(o=2)), (5, s(w=2)), (6, s(u=3)), (7, s(o=5, k=1)), (8, s(o=6, k=2)), (9, [])]
    got, _ = moves(spark, d, [(at, "judged", None, x) for at, x in ticks])
    assert got == [(0, "OK", "new", None), (2, "Alert", "threshold", "critical"), (4, "OK", "recovery", "critical_recovery"), (5, "Warn", "threshold", "warning"), (6, "No Data", "unknown_runs", None), (8, "OK", "recovery", None)]


def test_new_groups_wait(spark):
    d = state.Definition(critical=10, new_group_delay=60_000)
    assert moves(spark, d, [(0, "judged", 11.0), (59_999, "judged", 11.0), (60_000, "judged", 11.0)])[0] == [(60_000, "Alert", "new", "critical")]


def test_definition_lists_all_problems():
    assert len(state.Definition(critical=1, warning=2, critical_recovery=3, on_missing_data="?").problems()) == 3


def test_changed_and_deleted_monitors_close_their_groups(spark):
    groups = spark.createDataFrame([(m, "g", "Alert", 5, 1, 2, 0, 5, 5, None) for m in (1, 2, 3)] + [(1, "new", None, 5, None, None, 5, 5, 5, None)], "monitor_id long, group_key string, " + ", ".join(f"{n} {t}" for n, t in state.MEMORY.items()))
    old = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0)], "monitor_id long, critical double")
    stored = old.select("monitor_id", state.definition_hash(["critical"]).alias("hash"))
    got = state.redefine(groups, stored, spark.createDataFrame([(1, 6.0), (2, 5.0)], "monitor_id long, critical double"), 9).collect()
    assert sorted((r.monitor_id, r.group_key, r.at_ms, r.to_state, r.reason, r.first_triggered_at) for r in got) == [(1, "g", 9, "OK", "definition_changed", 1), (3, "g", 9, "OK", "deleted", 1)]


def test_stream_and_replay_agree(spark, tmp_path):
    """A group that falls silent halfway goes to No Data with no row of its own."""
    rng = np.random.default_rng(1)
    minute = 60_000
    rows = [(1, f"g{g}", t * minute, "judged", float(rng.uniform(0, 14)), t * minute, t * minute - 3600_000, t * minute) for g in range(3) for t in range(300) if g or t < 40]
    rows.append((1, None, 300 * minute, None, None, None, 299 * minute, 300 * minute))
    whole = spark.createDataFrame(rows, TICKS.split(", recovery")[0])
    for k in range(3):
        whole.where((F.col("tick") >= k * 110 * minute) & (F.col("tick") < (k + 1) * 110 * minute)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state.follow(stream, D, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "transitions")).drop("batch").collect())
    periods = whole.select("monitor_id", "tick", "from_ms", "to_ms").distinct()
    want = sorted(tuple(r) for r in state.replay(state.complete_ticks(whole.where("group_key is not null"), periods), D).collect())
    assert got == want and len(got) > 100 and any(r[1] == "g0" and r[4] == "No Data" for r in got)


def test_stream_memory_is_snapshots_and_changes(spark, tmp_path):
    minute = 60_000
    groups = lambda k: ["g0"] + [f"g{i}" for i in range(1, 30)] * (k == 0)
    rows = [(1, k * minute, g, "judged", 20.0 if g == "g0" and k % 2 else 1.0, k * minute, (k - 5) * minute, k * minute) for k in range(7) for g in groups(k)]
    whole = spark.createDataFrame(rows, "monitor_id long, tick long, group_key string, status string, value double, last_point long, from_ms long, to_ms long")
    for k in range(7):
        whole.where(F.col("tick") == k * minute).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    calm = state.Definition(critical=10, new_group_delay=0, window=3600_000)
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state.follow(stream, calm, out, str(tmp_path / "cp"), snapshot_every=3).awaitTermination()
    periods = whole.select("monitor_id", "tick", "from_ms", "to_ms").distinct()
    whole_memory = state.memory(state.folded(state.complete_ticks(whole, periods), calm))
    key = lambda df: sorted(str(r.asDict()) for r in df.collect())
    assert key(state.remembered(spark, out, 6)) == key(whole_memory) and whole_memory.count() == 30
    assert Folder(spark, f"{out}/snapshots").names() == ["batch=2", "batch=5"] and Folder(spark, f"{out}/changes").names() == [f"batch={n}" for n in range(3, 7)]
    assert spark.read.parquet(f"{out}/changes/batch=6").count() == 1 and Folder(spark, f"{out}/after").names() == []
    assert key(spark.read.parquet(f"{out}/transitions").drop("batch")) == key(state.replay(state.complete_ticks(whole, periods), calm))


@pytest.mark.parametrize("paths", [True, False])
def test_trees_of_any_depth(spark, paths):
    rows = [(1, i, i - 1 if i > 1 else None) for i in range(1, 101)] + [(1, 200, 50), (2, 5, None), (2, 6, 99), (2, 7, 6), (3, 1, 2), (3, 2, 1), (3, 3, 1)]
    got = product.span_depths(spark.createDataFrame(rows[::-1], "trace_id long, span_id long, parent_id long"), paths).collect()
    want = {(1, i): i - 1 for i in range(1, 101)} | {(1, 200): 50, (2, 5): 0}
    assert len(got) == len(want) and {(r.trace_id, r.span_id): r.depth for r in got} == want
    if paths:
        chain = {i: list(range(1, i + 1)) for i in range(1, 101)} | {200: list(range(1, 51)) + [200]}
        assert {r.span_id: list(r.path) for r in got if r.trace_id == 1} == chain


LANDING = "tenant_id string, received_ms long, intake string, path string, query map<string,string>, body string"


def landed(spark, intake, *bodies, query=None):
    return spark.createDataFrame([("t", 7, intake, "/x", query or {}, b) for b in bodies], LANDING)


def test_trees_of_any_depth_are_taken_apart(spark):
    tree = '{"n":0}'
    for k in range(1, 41):
        tree = f'{{"n":{k},"children":[{tree}]}}'
    rows = spark.createDataFrame([("c", tree), ("d", None)], "id string, tree string")
    got = norm.flatten_tree(rows, "tree", ["id"], label="$.n").selectExpr("id", "size(path) - 1 as depth", "parent", "get_json_object(node, '$.n') as n").collect()
    assert sorted((r.depth, int(r.n), r.parent) for r in got) == [(d, 40 - d, str(41 - d) if d else None) for d in range(41)]


def test_lines_of_either_ending_and_one_bad_line(spark):
    facts, dead = norm.normalise(landed(spark, "logs", '{"message":"a"}\r\n{"message":"b"}\n{"mess\r\n{"message":"c"}'), norm.SPECS["logs"])
    assert sorted(r.message for r in facts.collect()) == ["a", "b", "c"]
    assert [(r.reason, r.body) for r in dead.collect()] == [("decode_error", '{"mess')]


def test_query_parameters_stand_in(spark):
    row = norm.normalise(landed(spark, "logs", '{"message":"a","ddtags":"x:1"}', query={"service": "s", "ddsource": "src", "ddtags": "env:e"}), norm.SPECS["logs"])[0].first()
    assert (row.service, row.source, row.host, row.tags) == ("s", "src", None, {"env": ["e"], "x": ["1"]})


def test_nothing_undeclared_is_lost(spark):
    body = '{"series":[{"metric":"m","type":"x","tags":["a"],"odd":null,"new":{"k":[1,2]},"points":[]},7,{"type":1}],"by":{"who":1},"at":5}'
    landing = landed(spark, "series_v2", body, '{"series":{}}', '{"other":1}', '{"series":[]}')
    facts, dead = norm.normalise(landing, norm.SPECS["series_v2"])
    row = facts.first()
    assert facts.count() == 1 and row.note == "type" and row.extra == {"new": '{"k":[1,2]}', "type": "x"}
    assert sorted((r.reason, r.body) for r in dead.collect()) == [("unexpected_shape", '7'), ("unexpected_shape", '{"other":1}'), ("unexpected_shape", '{"series":{}}'), ("unexpected_shape", '{"type":1}')]
    assert {tuple(sorted(r.extra.items())) for r in norm.leftovers(landing, norm.SPECS["series_v2"]).collect()} == {(("at", "5"), ("by", '{"who":1}')), (("other", "1"),)}


def test_unsigned_ids_keep_their_bits(spark):
    span = '{"traceID":18446744073709551615,"spanID":9223372036854775808,"parentID":-1,"meta":{"_dd.p.tid":"ffffffffffffffff"}}'
    facts, _ = norm.normalise(landed(spark, "spans", f'{{"tracerPayloads":[{{"chunks":[{{"spans":[{span}]}}]}}]}}'), norm.SPECS["spans"])
    row = norm.span_rows(facts).first()
    assert (row.trace_id, row.trace_id_high, row.span_id, row.parent_id, row.note) == (-1, -1, -(1 << 63), None, "parent_id")


def test_sketched_quantiles_lie_within_their_error(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(v)) for k in "ab" for v in rng.lognormal(3, 2, 500)] + [("c", 7.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r.k: (r.v, r["count"]) for r in product.sketched_quantile(df, ["k"], "v", q).collect()}
        for k in "abc":
            own = sorted(v for g, v in rows if g == k)
            assert got[k] == (pytest.approx(own[int(np.floor(q * (len(own) - 1)))], rel=0.009), len(own))
        assert "d" not in got


def test_the_last_of_members_with_one_name_counts(spark):
    facts, dead = norm.normalise(landed(spark, "logs", '{"message":"a","x":1,"message":"b","x":2}', '{"message":"c"} trailing', "7"), norm.SPECS["logs"])
    assert [(r.message, r.extra) for r in facts.collect()] == [("b", {"x": "2"})]
    assert sorted((r.reason, r.body) for r in dead.collect()) == [("decode_error", '{"message":"c"} trailing'), ("unexpected_shape", "7")]


def test_objects_without_items_leave_their_keys(spark):
    body = '{"env":"e","odd":1,"tracerPayloads":[{"languageName":"py","new":2,"chunks":[{"priority":1,"more":3,"spans":[]},{"spans":[{"trace_id":1,"span_id":2}]},{"spans":7},null]}]}'
    spec = norm.SPECS["spans"]
    made = norm.outcomes(landed(spark, "spans", body), spec)
    assert norm.facts_of(made, spec).select("span_id", "language", "extra").collect() == [(2, "py", {"$2.new": "2"})]
    assert sorted(r.body for r in norm.letters_of(made).collect()) == ["null", '{"spans":7}']
    assert sorted((sorted(r.extra.items()) for r in norm.leftovers_of(made).collect())) == [[("$1.more", "3")], [("odd", "1")]]
