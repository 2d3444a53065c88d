"""Language ID by language-bitmask n-gram filters.

One Bloom filter serves all languages: each of its slots holds a mask with a bit for each language. An n-gram
sets its languages' bits in k slots; a lookup ANDs the k masks and so returns, in one step, every language
that contains the n-gram. A text's n-grams give a count for each language; each count is corrected for
the false positives that the language's fill leads one to expect, and the largest decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import durable
from .text import bounded

NOT_LETTERS = re.compile(r"[\W\d_]+")  # leaves letters, and numbers like one half
UNKNOWN = "und"
PIECE = 1 << 17
SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
SIZES = (2, 4)  # n-gram lengths, in letters, word ends included


def letters(text: str) -> str:
    """The words of letters of a text, lowered and joined by one blank."""
    line = NOT_LETTERS.sub(" ", text.lower())
    if not line.isascii() and not line.replace(" ", "").isalpha():
        line = " ".join("".join(c if c.isalpha() else " " for c in line).split())
    return line.strip()


def grams(text: str, sizes: tuple[int, ...] = SIZES) -> Iterator[np.ndarray]:
    """Hashes of a text's letter n-grams, in pieces of bounded size."""
    for at in range(0, len(text), PIECE):
        line = f" {letters(text[max(0, at - max(sizes)) : at + PIECE])} "
        if line == "  ":
            continue
        c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        for n in sizes:
            h = np.full(max(0, len(c) - n + 1), n, dtype=np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) ^ c[k : len(c) - n + 1 + k]
            yield h * SALTS[0] ^ (h >> np.uint64(29))


def slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((h * s) >> np.uint64(64 - bits)).astype(np.int64) for s in SALTS]


BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)  # bits of each byte


@dataclass
class LanguageFilter:
    """The learned filter: ``masks`` has a slice of 2 ** bits bytes for every eight languages."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def of_slots(cls, languages: list[str], at: np.ndarray, part: np.ndarray, mask: np.ndarray, bits: int) -> LanguageFilter:
        """From (slot, which byte, bits of the byte)."""
        masks = np.zeros((max(1, -(-len(languages) // 8)), 1 << bits), dtype=np.uint8)
        np.bitwise_or.at(masks, (part, at), mask)
        made = cls(languages, masks)
        made.false_rate = (made.popcounts(masks) / (1 << bits)) ** len(SALTS)
        return made

    @classmethod
    def build(cls, languages: list[str], hashes: np.ndarray, owner: np.ndarray, bits: int) -> LanguageFilter:
        """From n-gram hashes and the number of a language that has each; an n-gram of several comes several times."""
        at = np.concatenate(slots(hashes, bits))
        owner = np.tile(owner.astype(np.int64), len(SALTS))
        return cls.of_slots(languages, at, owner // 8, (1 << owner % 8).astype(np.uint8), bits)

    def languages_of(self, h: np.ndarray) -> np.ndarray:
        """The mask of languages that contain each n-gram, a slice of bytes for every eight."""
        a, b, c = slots(h, int(self.masks.shape[1]).bit_length() - 1)
        return np.stack([x[a] & x[b] & x[c] for x in self.masks])

    def popcounts(self, masks: np.ndarray) -> np.ndarray:
        """How many of the masks have each language's bit."""
        return np.concatenate([np.bincount(x, minlength=256) @ BITS for x in masks])[: len(self.languages)]

    def predict(self, text: str | None) -> tuple[str, float]:
        counts, total = np.zeros(len(self.languages)), 0
        for h in grams(text or ""):
            total += len(h)
            counts += self.popcounts(self.languages_of(h))
        if not total or not self.languages:
            return UNKNOWN, 0.0
        true = np.maximum(0, counts - total * self.false_rate) / (1 - np.minimum(self.false_rate, 0.999))
        best = int(true.argmax())
        # how clearly it leads, as a share of what the languages' own n-grams say
        power = (true / max(1.0, true.max())) ** 4
        return self.languages[best], float(power[best] / power.sum()) if true[best] else 0.0


def fit(
    docs: DataFrame, text_col: str, lang_col: str, per_language: int = 1500, keep_share: float = 0.4, least: int = 3, bits: int = 21
) -> LanguageFilter:
    """Learn a filter from labelled rows (rows without label or text are left out).

    ``per_language`` bounds the sample: about so many different texts of each language, by a hash of the text, and
    all of a language that has fewer; copies count once. An n-gram belongs to a language if the language's rate
    of it is at least ``keep_share`` of its highest rate among all, and it came ``least`` times. Any number of
    languages has its bits. What reaches the driver is the filter, 2 ** ``bits`` slots at most; how full
    it is, is measured and corrected for.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("name")).where("text is not null and lang is not null")
    count = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count_distinct("name").alias("n")).collect()}
    languages = sorted(count)
    if not languages:
        return LanguageFilter([], np.zeros((1, 1 << bits), dtype=np.uint8))
    limit = F.create_map(*[F.lit(x) for k, n in count.items() for x in (k, min(1.0, per_language / n))])
    rank = F.col("name").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    sample = rows.where(rank < limit[F.col("lang")]).groupBy("lang", "name").agg(F.any_value("text").alias("text")).select("lang", "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for h in grams(text):
                    value, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value)), pa.array(value.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    sums = durable(bounded(sample).mapInArrow(of, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    total = {r.lang: r.n for r in sums.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    whole = F.create_map(*[F.lit(x) for k, n in total.items() for x in (k, float(n))]) if total else F.create_map()
    rated = sums.withColumn("rate", F.col("n") / whole[F.col("lang")]) if total else sums.withColumn("rate", F.lit(0.0))
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate", "n")).alias("of"))  # a list of languages
    kept = top.selectExpr("gram", "explode(filter(of, x -> x.n >= %d and x.rate >= top * %s)) as x" % (least, keep_share)).select("gram", "x.lang")
    number = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, k = (np.asarray(c).astype(np.int64) for c in batch.columns)
            at = np.concatenate(slots(h.view(np.uint64), bits))
            k = np.tile(k, len(SALTS))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(k // 8), pa.array(1 << k % 8)], ["slot", "part", "mask"])

    filled = kept.select("gram", number.cast("long").alias("k")).mapInArrow(placed, "slot long, part long, mask long")
    filled = filled.groupBy("slot", "part").agg(F.bit_or("mask").alias("mask")).toArrow()
    at, part, mask = (np.asarray(filled.column(c)).astype(np.int64) for c in ("slot", "part", "mask"))
    return LanguageFilter.of_slots(languages, at, part, mask.astype(np.uint8), bits)


def predict(docs: DataFrame, text_col: str, model: LanguageFilter, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default), with lang_pred and score added; a column of that name is replaced."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # 2 ** bits slots, whatever the corpus
    held = docs.drop("lang_pred", "score")
    kept = held.columns if keep is None else keep
    places = [held.columns.index(c) for c in kept]
    schema = held.select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    column = held.columns.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [sent.value.predict(x.as_py()) for x in batch.column(column)]
            columns = [*(batch.column(k) for k in places), pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return bounded(held).mapInArrow(of, schema)


def held_out(id_col: Column, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves ``part``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % parts == part


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, part: int = 2, **fitting) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per input row.

    Learns from labelled rows that are not held out; predicts from the whole text alone. ``und`` with score 0
    for null texts, texts without letters, and where no row is labelled; a text none of whose n-grams is known has
    score 0. Repeated rows are predicted alike.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col), parts, part).alias("held_out"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = fit(rows.where("not held_out"), "text", "lang", **fitting)
    return predict(rows.drop("lang"), "text", model, ["doc_id", "held_out"])
