"""Streams against the batch results of the same rows."""

from conftest import SMALL
from pyspark.sql import functions as F

from ebbtide.operators.aggregate import rollup_1m
from ebbtide.operators.catalog import replace_by_version
from ebbtide.plans.common import points
from ebbtide.plans.ingest_queries import BESIDE, SERIES2, SPAN, landing
from ebbtide.sources import normalise as norm
from ebbtide.streaming import views


def rows(df):
    return sorted(str(r) for r in df.collect())


def test_rollup_stream_equals_batch(spark, tmp_path):
    whole = points(spark, SMALL).drop("user_id", "k")
    whole.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    views.follow_rollup(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    merged = views.merged_rollup(spark.read.parquet(str(tmp_path / "out")))
    show = lambda df: rows(df.select("t_ms", "metric", "host", "series_id", "points", F.round("value_sum", 6), "value_min"))
    assert show(merged) == show(rollup_1m(whole))


def test_current_stream_keeps_the_newest(spark, tmp_path):
    df = spark.createDataFrame([(i % 5, i, f"v{i}") for i in range(40)], "id long, version long, what string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    held = {}
    sink = lambda batch, _: held.update({r.id: (r.version, r.what) for r in batch.collect()})
    views.follow_current(stream, ["id"], ["version"], sink, str(tmp_path / "cp")).awaitTermination()
    assert held == {r.id: (r.version, r.what) for r in replace_by_version(df, ["id"], ["version"]).collect()}


def test_payload_stream_splits_facts_from_dead_letters(spark, tmp_path):
    whole = landing(spark, SMALL, "series_v2", SERIES2)
    whole.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spec = norm.SPECS["series_v2"]
    views.follow_payloads(stream, spec, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    facts, dead = norm.normalise(whole, spec)
    got = views.written_outcomes(spark, str(tmp_path / "out"), spec)
    assert rows(got[0].select("metric", "extra", "tags")) == rows(facts.select("metric", "extra", "tags")) and rows(got[1]) == rows(dead) != []


def test_leftovers_reach_the_stream(spark, tmp_path):
    whole = landing(spark, SMALL, "series_v2", BESIDE)
    whole.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(whole.schema).parquet(str(tmp_path / "in"))
    views.follow_payloads(stream, norm.SPECS["series_v2"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = views.written_outcomes(spark, str(tmp_path / "out"), norm.SPECS["series_v2"])[2]
    assert rows(got) == rows(norm.leftovers(whole, norm.SPECS["series_v2"])) != []


def test_outcomes_are_one_scan_and_one_parse(spark, tmp_path):
    landing(spark, SMALL, "spans", SPAN).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    plan = norm.outcomes(spark.read.parquet(str(tmp_path / "in")), norm.SPECS["spans"])._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("Relation ") == 1 and plan.count("parse_json(") + plan.count("parseJson") == 1 and "from_json" not in plan


def test_a_batch_sent_again_writes_nothing(spark, tmp_path):
    path = str(tmp_path / "facts")
    first, second = spark.createDataFrame([(1, 0), (2, 86_400_000)], "id long, t_ms long"), spark.createDataFrame([(3, 5)], "id long, t_ms long")
    assert views.committed(spark, path) is None
    assert views.sink_fact(first, path, batch="a/1") and views.sink_fact(second, path, batch="a/2") and not views.sink_fact(first, path, batch="a/1")
    ids = lambda: sorted(r.id for r in views.committed(spark, path).collect())
    assert ids() == [1, 2, 3]
    spark.createDataFrame([(9, 5)], "id long, t_ms long").write.parquet(f"{path}/batches/batch_key=cut/date=1970-01-01")  # a batch that failed before its mark
    assert ids() == [1, 2, 3]
    assert views.sink_fact(second.withColumn("id", F.lit(4)), path, batch="cut") and ids() == [1, 2, 3, 4]
    views.sink_fact(second, path)
    assert ids() == [1, 2, 3, 3, 4]
