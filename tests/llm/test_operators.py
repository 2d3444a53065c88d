"""The ten operators against brute force, exact round trips or held-out accuracy, and on awkward tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import SMALL, same_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ebbtide.operators import components
from ebbtide.llm import decontaminate, exact, language, mixing, pii, quality, secrets, sharding, simhash, warc
from ebbtide.llm.queries import ORACLES, QUERIES

MEDIUM = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row long, size long, fp long, term string, score double"


def doc(i, text, lang="en", source="s0"):
    return (i, text, lang, source, None, "k", 1, 2, 3, "t", 0.5)


LONG = " ".join(f"word{i % 977} and{i}" for i in range(30_000))
AWKWARD = [
    doc(1, None, None, None), doc(2, "", None, "s1"), doc(3, " \t\n"), doc(4, LONG, None), doc(5, "the same text here again"), doc(6, "the same text here again"),
    doc(6, "the same text here again"), doc(None, "The same  text here again"), doc(7, "ÄÖ é ß 中文   x@y.zz +1 (555) 123-4567 token = 'abcdefgh'"), doc(8, "!!! 123 ---", "fr"), doc(-9, "a b", "fr", ""),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, most=4):
    """item -> smallest item reachable over links of at most ``most`` bits."""
    items = sorted(prints)
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(items):
        for b in items[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in items}


def test_golay_keys_meet_at_distance_two():
    tables = simhash.golay_tables()
    assert set(tables[2].tolist()) == {1, 6}
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 300)
    keys = lambda w: {frozenset(k[:n]) for k, n in zip(*simhash.golay_keys(np.array([w]), tables), strict=True)}.pop()
    for w in words.tolist():
        a, b = rng.choice(23, 2, replace=False).tolist()
        assert keys(w) & keys(w ^ 1 << a ^ 1 << b)


def test_links_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    prints = set(base.tolist())
    for p in base.tolist():
        for bits in (1, 2, 3, 4, 5):
            prints.add(p ^ sum(1 << int(b) for b in rng.choice(64, bits, replace=False)))
    centre = int(base[0])  # one dense ball, larger than a run that is linked member by member
    prints |= {centre ^ 1 << int(a) ^ 1 << int(b) for a, b in rng.integers(0, 64, (300, 2))}
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    got = {r.node: r.root for r in components.connected_components(simhash.fingerprint_links(df)).collect()}
    want = brute_groups({int(np.uint64(p).astype(np.int64)): p for p in prints})
    assert {k: v for k, v in want.items() if k in got} == got
    alone = set(want) - set(got)
    sizes = Counter(want.values())
    assert all(sizes[want[k]] == 1 for k in alone)


def test_simhash_groups(spark, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](spark, SMALL).collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    groups = brute_groups(prints)
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in texts}


def test_simhash_awkward(awkward, empty):
    rows = simhash.simhash_groups(awkward).collect()
    assert len(rows) == len(AWKWARD) and simhash.simhash_groups(empty).count() == 0
    zero = {r.doc_id for r in rows if r.fingerprint == "0" * 16}
    assert zero == {1, 2, 3} and {r.component_id for r in rows if r.doc_id in zero} == {1}
    assert {r.component_id for r in rows if r.doc_id in (5, 6, None)} == {5}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7), (5, None)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
    assert components.connected_components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, duck):
    same_rows(QUERIES[name](spark, SMALL), duck.execute(ORACLES[name]))


def test_mix_keeps_its_promises(spark):
    rows = mixing.mix(spark.read.parquet(f"{MEDIUM}/documents.parquet")).collect()
    by = defaultdict(list)
    for r in rows:
        assert r.taken <= 2 * r["size"]
        by[r.source].append(r)
    total = sum(r["size"] for r in rows)
    assert sum(v[0].target for v in by.values()) == pytest.approx(1.5 * total)
    for v in by.values():
        assert v[0].target <= 2 * v[0].source_size + 1e-6
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r["size"] for r in v)


def test_mix_awkward(awkward, empty):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == len(AWKWARD) and mixing.mix(empty).count() == 0
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    assert {r.source for r in rows} == {None, "", "s0", "s1"}
    again = mixing.mix(awkward.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    copies = mixing.mixed_documents(awkward)
    assert copies.columns == awkward.columns and copies.count() == sum(r.copies for r in rows)


def test_mix_reruns_agree_without_ids(spark):
    rows = [(None, " ".join(f"w{k}" for k in range(i % 7 + 1)) + f" u{i}", "s") for i in range(60)] + [(5, f"one two {i}", "s") for i in range(40)]
    rows += [(i, "some words here", "t") for i in range(100, 130)]
    seen = set()
    for turn in range(3):
        order = np.random.default_rng(turn).permutation(len(rows))
        docs = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string, source string").repartition(turn + 1)
        seen.add(tuple(sorted((str(r.doc_id), r.text, r.source) for r in mixing.mixed_documents(docs).collect())))
    assert len(seen) == 1


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(
        [(1, "http://a\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "v", ""), (5, "w", "\r\n\r\nWARC/1.0\r\n" * 9), (None, "n", "<p>é</p>"), (2, None, "<p>é</p>"), (7, "big", "x" * 300_000)],
        "page_id long, url string, html string",
    )
    rows = warc.page_archive_rows(pages).collect()
    html = {1: "<p>é</p>", 2: "<p>é</p>", 3: "", 4: "", 5: "\r\n\r\nWARC/1.0\r\n" * 9, None: "<p>é</p>", 7: "x" * 300_000}
    assert len(rows) == 8
    for r in rows:
        body = html[r.page_id].encode()
        assert r.payload_bytes == len(body)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
    got = {(r.page_id, r.record_type, r.refers_to) for r in rows}
    assert got == {(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (None, "revisit", 2), (7, "response", None)}
    assert warc.page_archive_rows(pages.limit(0)).count() == 0


def test_warc_payloads_come_back(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    archives, index, broken = warc.normalise_archives(warc.write_archives(warc.page_records(pages)))
    got = {r.headers["WARC-Record-ID"]: bytes(r.payload).decode() for r in warc.read_records(archives, index).where("headers['WARC-Type'] = 'response'").collect()}
    html = {r.page_id: r.html or "" for r in pages.collect()}
    newest = {x: max(i for i in html if html[i] == x) for x in html.values()}
    assert got == {f"<urn:page:{i}>": x for x, i in newest.items()} and broken.count() == 0
    want = {(i, len(x.encode()), base64.b32encode(hashlib.sha1(x.encode()).digest()).decode(), "response" if newest[x] == i else "revisit", None if newest[x] == i else newest[x]) for i, x in html.items()}
    rows = QUERIES["op3_warc"](spark, SMALL).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert len(rows) == len(html) and {tuple(r) for r in rows} == want


def test_broken_archives_give_what_they_have(spark):
    record = lambda k: f"warc/1.0\r\n".upper().encode() + f"WARC-Type:response\r\nwarc-record-id: <urn:page:{k}>\r\ncontent-length:{k}\r\n\r\n".encode() + b"x" * k + b"\r\n\r\n"
    pack = lambda raw: (lambda z: z.compress(raw) + z.flush())(zlib.compressobj(6, zlib.DEFLATED, 31))
    rows = [("good", pack(record(3) + record(5))), ("short", pack(record(7) + record(9)[:-30])), ("cut", pack(record(4))[:-6]), ("other", b"not gzip"), ("empty", b""), ("none", None), ("odd", pack(b"hello\r\n\r\n"))]
    archives, index, broken = warc.normalise_archives(spark.createDataFrame(rows, "archive string, content binary"))
    got = {(r.archive, r.headers["WARC-Record-ID"], len(r.payload)) for r in warc.read_records(archives, index).collect()}
    assert got == {("good", "<urn:page:3>", 3), ("good", "<urn:page:5>", 5), ("short", "<urn:page:7>", 7), ("cut", "<urn:page:4>", 4)}
    assert {r.archive for r in broken.collect()} == {"short", "cut", "other", "odd"}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=200), max_size=8), st.integers(1, 50))
def test_normaliser_members_stand_alone(payloads, piece):
    raw = b"".join(warc.record({"WARC-Type": "response", "n": str(i)}, p) for i, p in enumerate(payloads))
    half = len(raw) // 2
    whole = warc.zlib.compressobj(6, zlib.DEFLATED, 31)
    stream = whole.compress(raw) + whole.flush()
    two = b"".join(c.compress(x) + c.flush() for c, x in ((zlib.compressobj(6, zlib.DEFLATED, 31), raw[:half]), (zlib.compressobj(6, zlib.DEFLATED, 31), raw[half:])))
    for source in (stream, two):
        out = bytearray()
        index = list(warc.normalise((source[i : i + piece] for i in range(0, len(source), piece)), out.extend))
        got = [warc.payload_of(zlib.decompress(bytes(out[at : at + n]), 31)) for at, n, _ in index]
        assert got == payloads and sum(n for _, n, _ in index) == len(out)


def test_broken_gzip_raises():
    stream = zlib.compress(b"WARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n", 6, 31)
    with pytest.raises((ValueError, zlib.error)):
        list(warc.normalise(iter([stream[:-12]]), lambda _: None))


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in language.identify(docs).collect())


def test_language_filter_forgets_nothing():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    for n in (3, 226):
        owner = rng.integers(0, n, 5000)
        f = language.LanguageFilter.build([f"l{k:03d}" for k in range(n)], np.concatenate([h, h]), np.concatenate([owner, (owner + 1) % n]), 16)
        has = lambda x, k: f.languages_of(x)[k // 8, np.arange(len(x))] >> (k % 8) & 1  # noqa: B023, E731
        assert has(h, owner).all() and has(h, (owner + 1) % n).all()
        other = rng.integers(0, 1 << 63, 20000, dtype=np.uint64)
        extra = np.array([has(other, np.full(len(other), k)).mean() for k in range(n)])
        assert np.abs(extra - f.false_rate).max() < 0.01


def test_language_of_many_labels(spark):
    rng = np.random.default_rng(1)
    words = {f"l{k:03d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)] for k in range(226)}
    rows = [(i, " ".join(rng.choice(w, 40)), lang) for i, (lang, w) in enumerate(list(words.items()) * 4)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {i: lang for i, _, lang in rows}
    assert np.mean([r.lang_pred == want[r.doc_id] for r in got]) > 0.98


def test_language_needs_letters(spark):
    rows = [(i, t, "en") for i, t in enumerate(["the cat sat on the mat"] * 8)] + [(100, "\u00bd \u00b2", "de"), (101, "\u2460\u2461 \u2167", "de"), (102, "12 _ 3", None), (103, "the\u00bdcat", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[103][0] == "en"


def test_language_sample_counts_copies_once(spark):
    rows = [(None, "a hot text of many copies", "en")] * 3000 + [(i, f"text number {'xyz'[i % 3] * (i % 50 + 1)}", "en") for i in range(150)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", per_language=50, least=2)
    hot = np.concatenate(list(language.grams("hot")))
    assert not model.languages_of(hot)[0].all()  # the copies count once, below the least of two


def test_language_awkward(awkward, empty):
    rows = language.identify(awkward).collect()
    assert len(rows) == len(AWKWARD) and language.identify(empty).count() == 0
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 3, 8}
    unlabelled = language.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def check_shards(rows, texts, shards=40):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    most = max(r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    for k, v in by.items():
        assert 0 <= k < shards and sorted(r.slot for r in v) == list(range(len(v)))
        assert abs(sum(r["size"] for r in v) - total / shards) <= 2 * most
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_shards(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    rows = sharding.shard_by_bytes(docs).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert len(rows) == len(texts)
    assert all(r["size"] == len(texts[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in rows)
    check_shards(rows, texts)
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in sharding.shard_by_bytes(docs.repartition(7)).collect()}


def test_shards_against_sort_and_cut(spark, texts):
    order = sorted(texts, key=lambda i: (hashlib.md5((texts[i] or "").encode()).hexdigest(), i))
    sizes = {i: len((texts[i] or "").encode()) + 16 for i in texts}
    total, run, want, slots = sum(sizes.values()), 0, {}, Counter()
    for i in order:
        run += sizes[i]
        shard = min(39, (run - sizes[i] // 2) * 40 // total)
        want[i] = (shard, slots[shard])
        slots[shard] += 1
    got = {r.doc_id: (r.shard, r.slot) for r in QUERIES["op5_shards"](spark, SMALL).collect()}
    assert got == want


def test_shards_split_a_hot_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, "hot text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = sharding.shard_by_bytes(docs).collect()
    check_shards(rows, None)
    assert len({r.shard for r in rows if r.doc_id < 1500}) >= 15


def test_shards_awkward(awkward, empty):
    rows = sharding.shard_by_bytes(awkward, shards=3).collect()
    assert len(rows) == len(AWKWARD) and sharding.shard_by_bytes(empty).count() == 0
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id in (1, 2)} == {(16, 0)}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def brute_pii(text):
    def card(s):
        d = re.sub("[^0-9]", "", s)
        return 13 <= len(d) <= 19 and luhn(d)

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", card),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text or "") if ok(m[0])]


PII = [
    "mail a.b@c.de.f_x@y.zz and @no a@b", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.4 99999999999.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112 79927398713", "+1 (555) 123-4567 +12 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6-7",
    "éé 中 x@y.zz 中 4111111111111111 \U0001f600 10.0.0.1", "call 555-123-4567 now; jane [at] mail [dot] com", "1" * 5000 + " " + "1 " * 3000, "a" * 5000, "+" + "1" * 4000,
]


def test_pii_base_spans(spark, texts):
    docs = list(texts.items()) + [(10_000 + i, t) for i, t in enumerate(PII)] + [(20_000, None)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        spans = brute_pii(text)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (i, line, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r.spans.split(",")) | {""}


def test_pii_learns_to_add(spark):
    rows = [(i, f"phone: +1 (555) 123-{i:04d} and mail to user{i}@mail.com") for i in range(60)]
    rows += [(200 + i, f"host 10.1.2.{i} paid by card 4111-1111-1111-1111 in full") for i in range(40)]
    rows += [(110, "the host 10[.]20[.]30[.]40 fell"), (111, "paid by card 4111.1111.1111.1111 now"), (112, "ratio 4111.1111.1111.1112 and 900[.]1[.]1[.]1")]
    rows += [(100, "phone: 415-555-1234 please"), (101, "write to jane [at] mail [dot] com today"), (102, "clean text about 12 things")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert got[100].spans == "phone:7:19" and got[100].n_phone == 0
    assert got[101].spans == "email:9:33" and got[102].spans == ""
    assert got[110].spans == "ip:9:26" and got[111].spans == "card:13:32" and got[112].spans == "" and got[110].n_ip == got[111].n_card == 0
    fitted = pii.fit(pii.candidates(docs, "doc_id", "text")).collect()
    assert all(0.5 <= r <= 0.99 for x in fitted for r in x.reliability)


def test_pii_awkward(awkward, empty):
    rows = pii.personal_data(awkward).collect()
    assert len(rows) == len(AWKWARD) and pii.personal_data(empty).count() == 0
    assert next(r for r in rows if r.doc_id == 7).n_email == 1


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    order = sorted(held, key=lambda r: r.score)
    good = sum(r.quality for r in held)
    wins = sum(i for i, r in enumerate(order) if r.quality) - good * (good - 1) / 2
    assert wins / (good * (len(held) - good)) >= 0.9


def test_quality_reads_the_whole_text():
    net = quality.ByteNet.fresh(1)
    net.out[:] = 0.1
    text = bytes(range(32, 120)) * 400
    whole = net.score(text)
    codes = quality.padded(text)
    made = np.maximum(net.windows(codes) @ net.weight + net.bias, 0)
    pooled = made.max(axis=0)
    assert whole == pytest.approx(float(1 / (1 + np.exp(-np.clip(pooled @ net.out, -30, 30)))), rel=1e-4)
    assert 0 <= net.score(b"") <= 1 and 0 <= net.score(b"x") <= 1


def test_quality_trains_on_whole_texts_and_agreed_labels(spark):
    tail = "x " * 5000
    docs = spark.createDataFrame([(i, tail + ("zebra zone" if i % 2 else "apple area")) for i in range(120)] + [(3, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(0, 0), (4, 1), (None, 1), (5, None)], "doc_id long, quality int")
    texts, marks = quality.training_rows(docs, labels.selectExpr("doc_id label_id", "quality label"), "doc_id", "text", 1000, 1 << 30)
    assert len(texts) == 119 and sorted(set(marks.tolist())) == [0, 1] and sum(len(t) > 10_000 for t in texts) >= 118
    assert sum(map(len, quality.training_rows(docs, labels.selectExpr("doc_id label_id", "quality label"), "doc_id", "text", 1000, 50_000)[0])) <= 50_000
    rows = quality.quality_scores(docs, labels).where("doc_id <> 3 and doc_id <> 4").collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in rows if r.held_out]) == 1.0  # what tells is in the last words


def test_quality_awkward(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.quality_scores(awkward, none).collect()
    assert len(rows) == len(AWKWARD) and {r.score for r in rows} == {0.5}
    assert quality.quality_scores(empty, none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, (1 << 60) - 1), min_size=1, max_size=300))
def test_rice_code_round_trip(values):
    v = np.sort(np.array(list(values), dtype=np.uint64))
    k, coded = exact.rice_encode(v)
    assert (exact.rice_decode(k, len(v), coded) == v).all()


def test_rice_code_is_small():
    v = np.sort(np.random.default_rng(0).integers(0, 1 << 60, 4000, dtype=np.uint64))
    assert len(exact.rice_encode(v)[1]) * 8 / len(v) < 60 - 12 + 2.2


def test_exact_copies_cost_one_entry(spark):
    docs = spark.range(40_000, numPartitions=4).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("a hot  text")).otherwise(F.col("id").cast("string")).alias("text"))
    rows = exact.durable_buckets(exact._hashed(docs), "sender")
    sent = exact._messages(rows, 4).agg(F.sum("n"), F.sum(F.octet_length("bits")) * 8 / F.sum("n")).first()
    assert sent[0] == 20_000 + 4 and sent[1] < 64 - 4 - 8 + 2.2  # bits a hash, some 313 to a message
    got = exact.exact_groups(docs)
    assert got.where("kept").count() == 20_001 and got.where("group_size = 20000 and keep_id = 0").count() == 20_000


def test_exact_ids_of_any_type(spark):
    docs = spark.createDataFrame([("x", "a b"), ("y", "ab "), (None, "ab  "), ("z", None)], "doc_id string, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(docs).collect()}
    assert got == {("x", None, 3, False), ("y", None, 3, False), (None, None, 3, True), ("z", "z", 1, True)}


def test_exact_awkward(awkward, empty):
    rows = exact.exact_groups(awkward).collect()
    assert len(rows) == len(AWKWARD) and exact.exact_groups(empty).count() == 0
    blank = [r for r in rows if r.doc_id in (1, 2, 3)]
    assert {(r.keep_id, r.group_size) for r in blank} == {(3, 3)} and [r.doc_id for r in blank if r.kept] == [3]
    same = [r for r in rows if r.doc_id in (5, 6)]
    assert {(r.keep_id, r.group_size) for r in same} == {(5, 3)} and [r.doc_id for r in same if r.kept] == [5]
    assert [(r.keep_id, r.group_size, r.kept) for r in rows if r.doc_id is None] == [(None, 1, True)]  # case counts


def test_decontamination_awkward(spark, awkward, empty):
    bench = spark.createDataFrame([("b1", "the SAME text"), ("b2", None), (None, "here again"), ("b3", "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11"), ("b1b", "the same text")], "item_id string, text string")
    rows = decontaminate.contamination(awkward, bench).collect()
    assert len(rows) == len(AWKWARD) and decontaminate.contamination(empty, bench).count() == 0
    hit = [r for r in rows if r.contaminated]
    assert {(r.n_words, r.n_hit, r.n_items) for r in hit} == {(5, 5, 2)} and len(hit) == 4
    assert {r.items_sha256 for r in hit} == {hashlib.sha256(b"b1,b1b").hexdigest()}
    assert decontaminate.contamination(awkward, bench.limit(0)).where("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i rare"), (2, "a b zz c d e f g h i rare"), (3, "rare i h g f"), (4, "nothing")], "doc_id long, text string")
    tests = decontaminate.test_windows(spark.createDataFrame([("t", "a b c d e f g h i rare")], "item_id string, text string"))
    index = decontaminate.positional_index(docs, tests.terms)
    ids = lambda df: {r.doc_id for r in index.where("term = ''").join(df, "row", "left_semi").collect()}
    assert ids(decontaminate.phrase_matches(index, tests)) == {1}
    assert ids(decontaminate.proximity_matches(index, tests, 2, 0.8)) == {1, 2}


def brute_secrets(text):
    rules = {
        "assign": (r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 6),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    }
    return sorted((m.start(), n, k, m.end()) for n, (k, (p, ok)) in enumerate(rules.items()) for m in re.finditer(p, text or "") if ok(m))


SECRETS = ["PassWord: 'hunter2hunter2' api_key=abc apikey = ABCDEFG", "AKIA" + "Z9" * 10 + " AKIASHORT", "x" + "0a" * 12 + "g" + "f" * 23, "-----BEGIN RSA PRIVATE KEY-----", "toKen = short token=\"longenough\"", "aKey", "secret" * 3000]


def test_secret_base_spans(spark, texts):
    docs = list(texts.items()) + [(10_000 + i, t) for i, t in enumerate(SECRETS)] + [(20_000, None)]
    got = {r.doc_id: r for r in secrets.secret_rows(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        spans = brute_secrets(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")]
    assert "pem:0:" in got[10_003].spans


def test_trigram_queries_miss_no_match(spark, texts):
    rules = secrets.BASE_RULES + secrets.MORE_RULES
    asked = [secrets.trigram_query(r.pattern) for r in rules]
    kinds = [r.kind for r in rules]
    assert asked[kinds.index("hex")] is True and asked[kinds.index("access")] == ("and", "aki", "kia")
    batch = list(texts.values()) + SECRETS
    kept = secrets.kept_texts(spark.createDataFrame(list(enumerate(batch)), "doc_id long, text string").repartition(3))
    index = secrets.trigram_index(kept)
    masks = kept.join(secrets.candidates(index, asked), "block", "left").selectExpr("doc_id", f"coalesce(masks[cast(row % {secrets.BLOCK} as int)], 0L) as mask")
    masks = {r.doc_id: r.mask for r in masks.collect()}
    for k, r in enumerate(rules):
        if asked[k] is not True:
            assert all(masks[n] >> k & 1 for n, t in enumerate(batch) if re.search(r.pattern, t))
    assert sum(m >> kinds.index("access") & 1 for m in masks.values()) < len(batch) / 2
    # a rule that comes later is answered from the same index
    late = secrets.scan(kept, index, (secrets.Rule("word", r"the [a-z]+"),), ()).collect()
    assert {r.doc_id: r.n_word for r in late} == {n: len(re.findall(r"the [a-z]+", t)) for n, t in enumerate(batch)}
    assert sum(r.n_candidates for r in late) < len(batch)


def test_postings_are_all_trigrams_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(secrets, "POSTINGS", 50)
    monkeypatch.setattr(secrets, "BLOCK", 16)
    rows = [(i, t) for i, t in enumerate(["ab", "abc", "ABCd", None, "x" * 40, "caf\u00e9 caf\u00e9", "abcabc " * 9] * 8)]
    kept = secrets.kept_texts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    numbers = {r.row: r.text for r in kept.collect()}
    got = {(r.gram, r.block * 16 + int(x)) for r in secrets.trigram_index(kept).collect() for x in np.frombuffer(r.rows, dtype="<u2")}
    want = {(int.from_bytes(b[i : i + 3], "big"), row) for row, t in numbers.items() for b in [(t or "").encode().lower()] for i in range(len(b) - 2)}
    assert got == want


def test_secrets_awkward(awkward, empty):
    rows = secrets.secret_rows(awkward).collect()
    assert len(rows) == len(AWKWARD) and secrets.secret_rows(empty).count() == 0
    assert next(r for r in rows if r.doc_id == 7).n_assign == 1
