"""Trigram queries of classes and choices, and training samples with odd texts."""

import re

from conftest import SMALL
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ebbtide.llm import pii, quality, secrets, sharding


def meets(query, grams):
    if query is True or isinstance(query, str):
        return query is True or secrets.numbered(query) in grams
    return (all if query[0] == "and" else any)(meets(q, grams) for q in query[1:])


PIECES = ["a", "B", "[ab]", "[a-d]", "[^a]", "(?:ab|cd)", "b{2,3}", "(?:a[bc]){2}", "c?", "d+", "_", "[kK]", "[Kk]", "é", ".", "(?i:ab)", "[a-z]"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), min_size=1, max_size=7), st.text(alphabet="abcdABkKé_zK", max_size=14))
def test_a_match_meets_its_query(pieces, around):
    pattern = "".join(pieces)
    text = around + "".join({"[ab]": "b", "[a-d]": "D".lower(), "[^a]": "é", "(?:ab|cd)": "cd", "b{2,3}": "bbb", "(?:a[bc]){2}": "abac", "c?": "", "d+": "dd", "[kK]": "K", "[Kk]": "K", ".": "Z", "(?i:ab)": "aB", "[a-z]": "q"}.get(p, p) for p in pieces) + around
    assert re.search(pattern, text)
    assert meets(secrets.trigram_query(pattern), set(secrets.grams_of(text).tolist()))


def test_small_classes_give_trigrams():
    known = {r.kind: secrets.trigram_query(r.pattern) for r in (*secrets.BASE_RULES, *secrets.MORE_RULES)}
    assert [k for k, q in known.items() if q is True] == ["hex"]
    assert secrets.trigram_query("gh[pousr]_")[0] == "or" and secrets.trigram_query("(?i)risk") is True and secrets.trigram_query("Key") is True


def test_a_long_text_does_not_empty_the_sample(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("cast(doc_id as string) doc_id", "concat(text, case when doc_id % 3 = 0 then repeat('x', 200000) else '' end) text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").selectExpr("doc_id label_id", "quality label")
    texts, marks = quality.training_rows(docs, labels, "doc_id", "text", 1000, 64 * 100_000)
    assert len(texts) > 30 and max(map(len, texts)) <= 100_000 and set(marks.tolist()) == {0, 1}


def test_shards_do_not_depend_on_their_ranges(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = lambda **how: sorted(map(tuple, sharding.shard_by_bytes(docs, **how).drop("grown_shard").collect()))
    assert rows(shards=3, rows_per_range=2) == rows(shards=3) == rows(shards=3, rows_per_range=50)


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.integers(1, 5)), max_size=12), st.tuples(st.integers(0, 2), st.integers(0, 30), st.integers(1, 9)))
def test_covered_spans(spark, found, asked):
    base, end = [], {}
    for kind, start, n in sorted(found):
        if start >= end.get(kind, 0):
            base.append((kind, start, start + n))
            end[kind] = start + n
    kind, start, n = asked
    span = "struct<kind:int,start:int,end:int>"
    row = spark.createDataFrame([(base, (kind, start, start + n))], f"base array<{span}>, x {span}").select(pii._covered(F.col("base"), F.col("x")).alias("c")).first()
    assert row.c == any(b[0] == kind and b[1] < start + n and start < b[2] for b in base)
