"""Each stage of the pipeline against a brute-force version of what it may keep."""

import re

import pytest
from conftest import SMALL
from test_nearcopies import all_pairs

import corpus_pipeline as pipeline


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before each stage, and the last stage's rows, each written and reread."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = docs.limit(1).selectExpr("cast(900 as bigint) doc_id", "'12 !!' text", "'en' lang", "source", "n_chars")
    extra = extra.unionAll(docs.where("doc_id = 0").selectExpr("cast(901 as bigint) doc_id", "concat(text, ' ') text", "lang", "source", "n_chars"))
    docs = docs.unionByName(extra)
    out = {"start": docs}
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SMALL).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_language_stage(stages):
    assert set(ids(stages["start"])) - set(ids(stages["language"])) == {900}
    assert stages["language"].columns == stages["start"].columns


def test_near_duplicate_stage(stages):
    """One document, that of the smallest id, of each group linked by five-word shingles at 0.8 or more."""
    rows = sorted((r.doc_id, re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) for r in stages["language"].collect())
    first = {}
    for (i, _), root in zip(rows, all_pairs([t for _, t in rows]), strict=True):
        first.setdefault(root, i)
    assert ids(stages["near_duplicates"]) == sorted(first.values())
    assert 901 not in ids(stages["near_duplicates"])


def test_benchmark_stage(spark, stages):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    clean = []
    for r in stages["near_duplicates"].collect():
        w = words(r.text)
        if not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1)):
            clean.append(r.doc_id)
    assert ids(stages["benchmark_passages"]) == sorted(clean) and len(clean) < stages["near_duplicates"].count()


def test_mixture_and_shards(stages):
    before, after = ids(stages["benchmark_passages"]), ids(stages["mixture"])
    assert set(after) <= set(before) and max(after.count(i) for i in set(after)) <= 2
    assert stages["mixture"].columns == stages["start"].columns
    assert ids(stages["shards"]) == after


def test_run_is_the_stages(spark):
    assert pipeline.run(spark, SMALL).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_near_copies_go_row_by_row(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "ac")
    rows = [(0, two), (1, two), (1, one), (2, one), (5, "same id"), (5, "same id"), (None, "no id"), (None, "no id"), (None, "some"), (9, "some")]
    left = pipeline.near_duplicates(spark, rows_of(spark, [(i, t, "en", "s", 1) for i, t in rows]), SMALL)
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=key) == sorted([(0, two), (1, one), (5, "same id"), (None, "no id"), (9, "some")], key=key)


def test_contaminated_rows_go_row_by_row(spark):
    passage = next(r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if len((r.text or "").split()) >= 10)
    rows = [(1, "a clean text"), (1, f"before {passage} after"), (None, passage), (None, "another clean text")]
    left = pipeline.benchmark_passages(spark, rows_of(spark, [(i, t, "en", "s", 1) for i, t in rows]), SMALL)
    assert {(r.doc_id, r.text) for r in left.collect()} == {(1, "a clean text"), (None, "another clean text")}


def test_every_column_comes_through_whatever_its_name(spark):
    names = ["row", "block", "score", "lang_pred", "rest", "keep", "size", "node", "c0", "a.b", "path"]
    texts = [" ".join(f"word{c}{i} number" for i in range(40)) for c in "xyz"]
    rows = [(f"id-{k}", t, "en", "s", len(t), *[f"{n}{k}" for n in names]) for k, t in enumerate([*texts, texts[1]])]
    fields = ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, f"doc_id string, text string, lang string, source string, n_chars long, {fields}")
    want = {tuple(r) for r in rows}
    for stage, left in ((pipeline.by_language, want), (pipeline.near_duplicates, want - {rows[3]}), (pipeline.benchmark_passages, want)):
        got = stage(spark, docs, SMALL)
        assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == sorted(left)
    mixed = pipeline.mixture(spark, docs.drop("a.b"), SMALL)
    assert mixed.columns == docs.drop("a.b").columns and {tuple(r) for r in mixed.collect()} <= {tuple(r[k] for k, c in enumerate(docs.columns) if c != "a.b") for r in rows}
