"""Benchmark decontamination over a distributed positional inverted index, in DataFrame functions only.

The index holds one posting (row, term, position) for each training token that some test item uses. A
test window is looked up from its rarest terms: the lists of the two rarest, shifted by their
offsets in the window, are intersected first; the lists of the other terms are then read for the
rows that are left. No training text is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import durable, durable_buckets
from .text import LOWER, UPPER

TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK = 32768  # rows that one bitmap covers
SLICES = 32  # a term's places in the tables of test terms
LONG_LISTS = 1000  # a list of more than this share of all postings is dealt in slices
EARLY = 4  # terms met before a near match's other terms are looked up
REACH = 13  # words around a posting whose bits it carries: the other places of a window of ten, each two words off
END = ""  # the term that marks a row's end; its position is the row's number of words


def words_of(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A-Z lowered and other capitals kept; null has none.

    The quick form serves texts that are all ASCII."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    lowered = F.when(F.length(whole) == F.octet_length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))
    return F.regexp_extract_all(lowered, F.lit(TOKEN), F.lit(0))


def term_bit(term: Column) -> Column:
    """One of 64 bits for each term."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(term), F.lit(64)).cast("int"))


def with_surroundings(rows: DataFrame, reach: int) -> DataFrame:
    """Adds ``bits``: for each of ``words`` the bits of all words up to ``reach`` away, a sliding OR by spans that double.

    Each span is a column of its own, so that none is worked out twice."""
    none = F.array_repeat(F.lit(0).cast("long"), reach)
    rows = rows.withColumn("bits", F.concat(none, F.transform("words", term_bit), none))
    both = lambda a, b: a.bitwiseOR(F.coalesce(b, F.lit(0).cast("long")))
    ahead = lambda n: F.slice("bits", n + 1, F.greatest(F.lit(0), F.size("bits") - n))
    span, whole = 1, 2 * reach + 1
    while span < whole:
        n = min(span, whole - span)
        rows, span = rows.withColumn("bits", F.zip_with("bits", ahead(n), both)), span + n
    return rows.withColumn("bits", F.slice("bits", F.lit(1), F.size("words")))


@dataclass
class TestWindows:
    """windows (win, size, words); terms (win, at, term); items (win, item_id)."""

    windows: DataFrame
    terms: DataFrame
    items: DataFrame


def test_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = 10) -> TestWindows:
    """Every run of ``width`` words of an item; a shorter item is one window, a wordless or null one has none."""
    found = durable(
        benchmark.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("words"))
        .where(F.size("words") > 0)
        .select("item_id", "words", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - width + 1))).alias("at"))
        .select("item_id", F.slice("words", F.col("at"), F.lit(width)).alias("words"))
        .distinct()
    )
    windows = durable(found.select("words").distinct().select(F.monotonically_increasing_id().alias("win"), F.size("words").alias("size"), "words"))
    terms = durable(windows.select("win", "size", F.posexplode("words").alias("at", "term")))
    items = durable(found.join(windows, "words").select("win", "item_id").where(F.col("item_id").isNotNull()))
    return TestWindows(windows, terms, items)


def positional_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """Postings (row, doc_id, term, pos, around) of the terms given, and one END posting per row that has its length.

    A row number keeps apart rows that repeat an id. ``around`` has the bits of the words up to ``reach`` away, all of the
    text's; with a reach of 0 it is null. Other terms need another index. Spark sends the term list to every task only if its measured size allows.
    """
    spark = docs.sparkSession
    known = durable(terms.select("term").distinct().unionAll(spark.createDataFrame([(END,)], "term string")))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.concat(words_of(F.col(text_col)), F.array(F.lit(END))).alias("words"),
    )
    if reach:
        each = F.posexplode(F.arrays_zip("words", "bits")).alias("pos", "x")
        tokens = with_surroundings(rows, reach).select("row", "doc_id", each).select("row", "doc_id", "pos", F.col("x.words").alias("term"), F.col("x.bits").alias("around"))
    else:
        tokens = rows.select("row", "doc_id", F.posexplode("words").alias("pos", "term"), F.lit(None).cast("long").alias("around"))
    postings = tokens.join(known, "term").select("row", "doc_id", "term", "pos", "around")
    # a task's rows make few blocks, so bucketing by block writes few files and moves nothing
    return durable_buckets(postings.withColumn("block", F.expr(f"row div {BLOCK}")), "block")


def marked(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (block, row, ...) of a table bucketed by block whose row is among those given. These go to the table as a
    bitmap for each block; the table stays where it is."""
    words = rows.groupBy(F.expr(f"row div {BLOCK}").alias("block"), F.expr(f"cast(row % {BLOCK} div 64 as int)").alias("word"))
    words = words.agg(F.expr("bit_or(shiftleft(1L, cast(row % 64 as int)))").alias("bits"))
    marks = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    marks = marks.select("block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK // 64 - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(0).cast("long"))).alias("bits"))
    there = table.join(durable(marks).hint("shuffle_hash"), "block")
    return there.where(F.expr(f"shiftright(bits[cast(row % {BLOCK} div 64 as int)], cast(row % 64 as int)) & 1L = 1L"))


def _postings_of(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Postings of the rows given."""
    return marked(index.where(F.col("term") != END), rows).select("row", "pos", "term")


def _meet(index: DataFrame, starts: DataFrame, terms: DataFrame, slop: int) -> DataFrame:
    """Candidates (row, win, begin) -> with ``met``, how many of the window's terms stand within ``slop`` of their places.

    Places are looked up by stretches as long as the slop spans, of which a place can be in two at most.
    """
    postings = _postings_of(index, starts.select("row").distinct())
    wanted = starts.join(terms.select("win", "at", "term"), "win").withColumn("place", F.col("begin") + F.col("at"))
    if not slop:
        met = wanted.withColumnRenamed("place", "pos").join(postings, ["row", "pos", "term"])
        return met.groupBy("row", "win", "begin").agg(F.count("*").alias("met"))
    stretch = lambda c: F.floor(c / (2 * slop + 1)).cast("long")
    wanted = wanted.withColumn("stretch", F.explode(F.array_distinct(F.array(stretch(F.col("place") - slop), stretch(F.col("place") + slop)))))
    met = wanted.join(postings.withColumn("stretch", stretch(F.col("pos"))), ["row", "stretch", "term"]).where(F.abs(F.col("pos") - F.col("place")) <= slop)
    return met.groupBy("row", "win", "begin").agg(F.count_distinct("at").alias("met"))


def _ranked(index: DataFrame, tests: TestWindows) -> DataFrame:
    """The windows' terms (win, at, term, nth, n): the rarest is the first; n is null for a term that no row has.

    A term that very many windows hold is dealt to as many tasks as it has slices.
    """
    lengths = index.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("n"))
    dealt = durable(lengths).select("term", "n", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    terms = tests.terms.withColumn("slice", F.pmod("win", F.lit(SLICES)).cast("int"))
    rank = Window.partitionBy("win").orderBy(F.col("n").asc_nulls_first(), "at")
    return durable(terms.join(dealt, ["term", "slice"], "left").withColumn("nth", F.row_number().over(rank)).select("win", "at", "term", "nth", "n"))


def _listed(index: DataFrame, keys: DataFrame) -> DataFrame:
    """The postings of each key's term: index rows joined with keys (win, at, term, n).

    A list of more than a 1000th of all postings is cut in slices of that size by row, and its keys go to each
    slice; such lists are at most 1000, whatever the corpus, so every task is told of them.
    """
    lists = keys.groupBy("term").agg(F.max("n").alias("n"))
    share = F.greatest(F.lit(1.0), index.agg((F.count("*") / LONG_LISTS).alias("share")).first()["share"] * F.lit(1.0))
    long = F.broadcast(durable(lists.where(F.col("n") > share).select("term", F.ceil(F.col("n") / share).cast("int").alias("slices"))))
    dealt = keys.join(long, "term", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))).drop("slices", "n")
    places = index.join(long, "term", "left").withColumn("slice", F.pmod(F.xxhash64("row"), F.coalesce("slices", F.lit(1))).cast("int"))
    return places.join(dealt, ["term", "slice"])


def _starts(index: DataFrame, tests: TestWindows, ranked: DataFrame, lists: int) -> DataFrame:
    """Where windows may begin: the shifted lists of their ``lists`` rarest terms, intersected."""
    keys = ranked.where("nth = 1 and n is not null")  # a term that no row has: no match
    found = _listed(index, keys.drop("nth")).select("row", "win", (F.col("pos") - F.col("at")).alias("begin")).where("begin >= 0")
    for nth in range(2, lists + 1):
        keys = ranked.where(F.col("nth") == nth)
        more = found.join(keys.select("win", "at", "term"), "win").select("row", "win", "begin", (F.col("begin") + F.col("at")).alias("pos"), "term")
        listed = index.join(keys.select("term").distinct(), "term", "left_semi").select("row", "pos", "term")
        single = found.join(tests.windows.where(F.col("size") < nth).select("win"), "win", "left_semi")
        found = more.join(listed, ["row", "pos", "term"]).select("row", "win", "begin").unionAll(single.select("row", "win", "begin"))
    return durable(found)


def phrase_matches(index: DataFrame, tests: TestWindows, ranked: DataFrame | None = None) -> DataFrame:
    """(row, win, begin, size): every exact occurrence of a test window."""
    met = _meet(index, _starts(index, tests, ranked or _ranked(index, tests), 2), tests.terms, 0)
    return met.join(tests.windows.select("win", "size"), "win").where("met = size").select("row", "win", "begin", "size")


def proximity_matches(index: DataFrame, tests: TestWindows, slop: int = 2, share: float = 0.8, ranked: DataFrame | None = None, reach: int = REACH) -> DataFrame:
    """(row, win, begin, size, met): every begin from which at least ``share`` of a window's terms stand within ``slop``
    words of their places. Exact occurrences are among them, as are begins beside them. A begin is negative
    where a text lacks the window's first words.

    At most size - need terms are missing, so that of one more rarest ones one is met: their postings are listed. Each missing
    term leaves at most one of the window's bits unset among those ``around`` a posting, so a posting with more
    unset bits than terms may be missing is no candidate; ``reach`` is what the index was made with. Of the rarest terms, three
    more than are listed, four must then stand within twice the slop of where the posting has them; what is left is looked up in full.
    """
    bits = tests.terms.groupBy("win").agg(F.bit_or(term_bit(F.col("term"))).alias("bits"))
    sizes = tests.windows.select("win", "size", F.greatest(F.lit(1), F.ceil(F.col("size") * share).cast("int")).alias("need"))
    keys = durable((ranked or _ranked(index, tests)).join(sizes.join(bits, "win"), "win"))
    spare = F.col("size") - F.col("need")
    unset = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("around"))))
    seen = F.col("around").isNull() | (F.col("size") - 1 + 2 * slop > reach) | (unset <= spare)
    rare = keys.where((F.col("nth") <= spare + 1) & F.col("n").isNotNull()).select("win", "at", "term", "n", "size", "need", "bits")
    listed = durable(_listed(index, rare).where(seen).select("row", "win", (F.col("pos") - F.col("at")).alias("begin")).distinct())
    early = _meet(index, listed, keys.where(F.col("nth") <= spare + EARLY), 2 * slop)
    likely = early.join(sizes, "win").where(F.col("met") >= F.least(F.lit(EARLY), F.col("need")))
    starts = durable(likely.select("row", "win", F.explode(F.sequence(F.col("begin") - slop, F.col("begin") + slop)).alias("begin")).distinct())
    met = _meet(index, starts, tests.terms, slop)
    return met.join(sizes, "win").where(F.col("met") >= F.col("need")).select("row", "win", "begin", "size", "met")


def near_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slop: int = 2, share: float = 0.8, width: int = 10) -> DataFrame:
    """(doc_id, n_near, near_items): one row per training row.

    ``n_near`` counts the different windows of test items that stand in the row exactly or nearly, with ``share`` of their words within
    ``slop`` words of their places; ``near_items`` names their items, sorted and comma-joined. Nulls and repeated rows as in ``contamination``.
    """
    tests = test_windows(benchmark, item_col, item_text, width)
    reach = width - 1 + 2 * slop
    index = positional_index(docs, tests.terms, id_col, text_col, reach)
    close = durable(proximity_matches(index, tests, slop, share, reach=reach).select("row", "win").distinct())
    of = close.join(tests.items, "win", "left").groupBy("row").agg(F.count_distinct("win").alias("n_near"), F.array_sort(F.collect_set("item_id")).alias("items"))
    rows = index.where(F.col("term") == END).select("row", "doc_id").join(durable(of), "row", "left")
    return rows.select("doc_id", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce(F.array_join("items", ","), F.lit("")).alias("near_items"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 10
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): one row per training row.

    A word inside any occurrence of a test window is hit. Null or empty texts have no words and
    null-text items no windows; items without id count for hits but not as items. Repeated rows are judged
    each; repeated items share their windows. With no items every row is clean.
    """
    tests = test_windows(benchmark, item_col, item_text, width)
    index = positional_index(docs, tests.terms, id_col, text_col, 0)
    found = durable(phrase_matches(index, tests))
    order = Window.partitionBy("row").orderBy("begin", F.col("size").desc(), "win")
    reach = F.max(F.col("begin") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("begin") + F.col("size") - F.greatest(F.col("begin"), F.coalesce("reach", F.lit(0))))
    hits = found.withColumn("reach", reach).groupBy("row").agg(F.sum(new).cast("long").alias("n_hit"))
    named = found.select("row", "win").distinct().join(tests.items, "win").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    marks = durable(hits.join(named, "row", "left"))
    rows = index.where(F.col("term") == END).select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(marks, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


CONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(w[i:i + 9]) AS n, array_to_string(w[i:i + 9], ' ') AS phrase
       FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.phrase = bw.phrase AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

NEAR_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(w[i:i + 9]) AS n, array_to_string(w[i:i + 9], ' ') AS phrase
       FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
tok AS (SELECT doc_id, w[p] AS term, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
wins AS (SELECT DISTINCT n, phrase FROM bw),
wt AS (SELECT phrase, n, i AS place, x[i] AS term FROM (SELECT phrase, n, string_split(phrase, ' ') AS x, unnest(range(1, n + 1)) AS i FROM wins)),
often AS (SELECT term, count(*) AS k FROM tok GROUP BY term),
rare AS (SELECT phrase, n, place, term FROM (SELECT wt.*, row_number() OVER (PARTITION BY phrase ORDER BY coalesce(k, 0), place) AS nth FROM wt LEFT JOIN often ON wt.term = often.term)
         WHERE nth <= n - greatest(1, ceil(n * 0.8)) + 1),
cand AS (SELECT DISTINCT doc_id, phrase, n, p - place + shift AS b FROM tok JOIN rare ON tok.term = rare.term, range(-2, 3) AS s(shift)),
around AS (SELECT doc_id, cand.phrase, cand.n, b, place, wt.term, b + place + shift AS p FROM cand JOIN wt ON cand.phrase = wt.phrase, range(-2, 3) AS s(shift)),
closeby AS (SELECT DISTINCT doc_id, phrase FROM (SELECT around.doc_id, phrase, n, b FROM around JOIN tok ON around.doc_id = tok.doc_id AND around.p = tok.p AND around.term = tok.term
          GROUP BY around.doc_id, phrase, n, b HAVING count(DISTINCT place) >= greatest(1, ceil(n * 0.8)))),
ni AS (SELECT doc_id, count(DISTINCT closeby.phrase) AS n_near, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS near_items FROM closeby JOIN bw ON closeby.phrase = bw.phrase GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, coalesce(near_items, '') AS near_items FROM d LEFT JOIN ni ON d.doc_id = ni.doc_id
"""
