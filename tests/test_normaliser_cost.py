"""What a row of the normaliser costs: things taken apart once, tasks of bounded size; and duplicate keys with a rule."""

from conftest import same_rows

from ebbtide.plans import ORACLES, QUERIES, ingest_queries


def test_variants_are_opened_once(spark):
    plan = QUERIES["norm_extra"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("variant_get(") < 60  # 183 when every use of a member looked it up again


def test_tasks_stay_small_as_rows_grow(spark, monkeypatch):
    monkeypatch.setattr(ingest_queries, "ROWS_A_TASK", 50)
    landed = ingest_queries.landing(spark, "/root/testdata/sf0.001", "logs", ingest_queries.LOG)
    assert landed.rdd.getNumPartitions() >= 20


def test_transitions_of_one_key_take_the_newest(spark, duck, tmp_path):
    import duckdb

    duckdb.sql(f"COPY (SELECT * REPLACE (TIMESTAMP '2024-01-02' AS ts, 40 AS user_id) FROM '/root/testdata/sf0.001/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
        rows = QUERIES["scan_transitions_final"](spark, str(tmp_path))
        assert rows.count() == 1
        same_rows(rows, c.execute(ORACLES["scan_transitions_final"]))


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_facts_cost_what_is_asked_of_them(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = _plan(QUERIES["norm_container_messages"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("parseJson") == 3  # a parse a message, none repeated in a filter that was moved down
    assert "map_entries" not in plan  # neither what is left over
    assert "concat_ws" not in plan  # nor notes


def test_outcomes_are_not_written_on_the_way(spark):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    QUERIES["norm_outcomes_of_logs"](spark, "/root/testdata/sf0.001")
    assert set(folder.iterdir()) == before


def test_what_is_left_over_is_told_by_numbers_only_where_that_is_sure(spark):
    from test_semantics import landed

    from ebbtide.sources import normalise as norm

    def extras(intake, *bodies):
        return [dict(r.extra) for b in bodies for r in norm.normalise(landed(spark, intake, b), norm.SPECS[intake])[0].select("extra").collect()]

    assert extras(
        "logs", '{"message":"a","date":5}', '{"message":"a","date":5,"timestamp":7}', '{"message":"a","x":null}', '{"x":1,"host":null}', '{"message":"a","host":3}', '{"message":"a","host":"h","hostname":"g"}'
    ) == [{}, {"date": "5"}, {}, {"x": "1"}, {"host": "3"}, {"host": "h"}]
    assert extras("rum", '{"type":"view","view":7}', '{"type":"view","view":{"id":"v","y":2}}', '{"type":"view","view":{"id":"v"}}', '{"type":"view","view":null}') == [{"view": "7"}, {"view.y": "2"}, {}, {}]


def test_bodies_of_unlike_members_are_the_same_text(spark):
    body = {"a": "'x' || CAST(id AS STRING)", "n": "CASE WHEN id > 5 THEN 1 END", "list": [{"b": "id"}, {"c": "1L", "d": {"e": "id / 2", "f": ["id"]}}], "z": "'q\"' || id"}
    rows = spark.range(1).select(ingest_queries.joined(body).alias("text"))
    assert rows.first().text == '{"a":"x0","n":null,"list":[{"b":0},{"c":1,"d":{"e":0.0,"f":[0]}}],"z":"q\\"0"}'


def test_nothing_is_copied_on_the_way_to_what_is_asked_for(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plans = {name: _plan(QUERIES[name](spark, "/root/testdata/sf0.001")) for name in ("norm_rum_events", "norm_rum_telemetry", "norm_batch_keys")}
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    for name in set(plans) - {"norm_batch_keys"}:
        assert "MapType(StringType,VariantType" not in plans[name], name  # an object's members are not all taken out for a few of them
    assert "ArrayType(VariantType" not in plans["norm_batch_keys"]  # neither are items, where only what stands beside them is


def test_what_is_left_over_keeps_its_rules_by_paths(spark):
    from test_semantics import landed

    from ebbtide.sources import normalise as norm

    def extras(intake, body):
        return [dict(r.extra) for r in norm.normalise(landed(spark, intake, body), norm.SPECS[intake])[0].select("extra").collect()]

    series = '{"series":[%s]}'
    assert extras("series_v2", series % '{"metric":"m","metadata":{"origin":7,"b":1}},{"metric":"n","metadata":[1]},{"metric":"o","metadata":{"origin":{"origin_product":3,"x":"y"}},"it\'s":1,"a?":null,"":2}') == [
        {"metadata.origin": "7", "metadata.b": "1"}, {"metadata": "[1]"}, {"metadata.origin.x": "y", "it's": "1", "": "2"},
    ]
    assert extras("series_v2", series % '{"metric":"m","type":"x","unit":4,"source_type_name":null,"sourceTypeName":"s"}') == [{"type": "x", "unit": "4"}]
    spans = '{"tracerPayloads":[{"odd":1,"chunks":[{"spans":[{"trace_id":1,"span_id":"2","meta":{"a":"b"},"q":{"r":1}}]}]}]}'
    assert extras("spans", spans) == [{"q": '{"r":1}', "$2.odd": "1"}]


def test_a_tasks_rows_are_few_however_files_share_them(spark, monkeypatch, tmp_path):
    import duckdb

    (tmp_path / "events.parquet").mkdir()
    for n in range(24):
        span = "event_id >= 100" if n == 23 else f"event_id BETWEEN {n * 4} AND {n * 4 + 3}"
        duckdb.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.001/events.parquet' WHERE {span}) TO '{tmp_path}/events.parquet/{n}.parquet' (FORMAT parquet)")
    monkeypatch.setattr(ingest_queries, "ROWS_A_TASK", 50)
    landed = ingest_queries.landing(spark.newSession(), str(tmp_path), "logs", ingest_queries.LOG).select("path")
    assert landed.count() > 800
    assert max(landed.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) < 120  # all of the large file's before


def test_members_are_asked_for_together_and_none_by_a_path_of_names(spark):
    names = ("norm_logs_lines", "norm_k8s_other_kinds", "norm_k8s_jobs", "norm_k8s_resources", "norm_k8s_daemon_sets", "norm_rum_events")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plans = {name: _plan(QUERIES[name](spark, "/root/testdata/sf0.001")) for name in names}
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    most = {"norm_logs_lines": 16, "norm_k8s_other_kinds": 60, "norm_k8s_jobs": 60, "norm_k8s_resources": 60, "norm_k8s_daemon_sets": 60, "norm_rum_events": 8}
    for name, plan in plans.items():
        assert "$['" not in plan and "]['" not in plan, name  # where such a path ends nowhere, an exception is thrown for the row
        assert plan.count("variant_get(") <= most[name], (name, plan.count("variant_get("))


def test_one_walk_finds_what_paths_find(spark):
    from pyspark.sql import functions as F

    from ebbtide.sources import normalise as norm

    body = '{"a":{"b":1,"c":null},"A":"u","x`y":{"it\'s":[1,"2"]},"q.r":true,"n":null,"l":[{"k":5}],"s":7}'
    wanted = [(("a", "b"), "variant"), (("a", "b"), "string"), (("a",), "variant"), (("A",), "string"), (("a", "c"), "variant"), (("x`y", "it's"), "array<string>"), (("q.r",), "string"), (("n",), "variant"), (("l", 0, "k"), "string"), (("s", "t"), "string"), (("gone", "too"), "variant"), ((), "variant")]
    rows = spark.range(1).select(F.parse_json(F.lit(body)).alias("v"))
    made, value = norm.walked(norm.Opened("v"), wanted, "s_")
    assert len(made) == 4  # of one path two types, above another, and by another case
    found = rows.withColumns(made).select(*[value(keys, kind).cast("string").alias(str(n)) for n, (keys, kind) in enumerate(wanted)]).first()
    assert list(found)[:-1] == ["1", "1", '{"b":1,"c":null}', "u", None, "[1, 2]", "true", None, "5", None, None]
    assert rows.withColumns(made).select(F.is_variant_null(value(("n",), "variant")).alias("n")).first().n


def test_tags_of_a_wrong_type_are_kept_whole(spark):
    from test_semantics import landed

    from ebbtide.sources import normalise as norm

    bodies = ['{"message":"a","ddtags":["x:1",7]}', '{"message":"a","ddtags":["x:1",null]}', '{"message":"a","ddtags":"x:1"}', '{"message":"a","ddtags":null}', '{"message":"a"}']
    rows = [norm.normalise(landed(spark, "events", b.replace("message", "title").replace("ddtags", "tags")), norm.SPECS["events"])[0].select("note", "extra", "tags").first() for b in bodies]
    assert [(r.note, dict(r.extra), dict(r.tags)) for r in rows] == [("tags", {"tags": '["x:1",7]'}, {"x": ["1"]}), ("", {}, {"x": ["1"]}), ("", {}, {"x": ["1"]}), ("", {}, {}), ("", {}, {})]
