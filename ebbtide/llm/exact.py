"""Exact duplicates by a Golomb-coded fingerprint exchange.

Each partition of rows is a sender. It hashes its normalised texts to 64 bits, takes each hash once with a flag
that says whether the sender itself has it more than once, deals the hashes to owners by their leading bits, and
sends each owner its sorted share as Golomb-Rice coded differences: about log2(gap) + 1.5 bits a hash, and no
text. An owner decodes what it received and answers each sender with a bitmap: bit i is set if the sender's
i-th hash came from others too or bore the flag. Only the rows so marked, the suspects, are shuffled with their texts,
and grouped by the bytes themselves. A text of any number of copies costs an owner one entry a sender.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import durable, durable_buckets
from .text import bounded

BLANKS = dict.fromkeys(map(ord, " \t\n\v\f\r"))
SENDER_BITS = 20  # a partition of more than 2 ** 20 rows is several senders


def rice_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Ascending distinct values -> Rice parameter and coded differences: all unary quotients, then all low parts of k bits.

    k is fitted to the mean of the differences themselves.
    """
    gaps = np.diff(values, prepend=values.dtype.type(0)).astype(np.uint64)
    k = max(0, int(np.log2(max(1.0, float(gaps.astype(np.float64).mean()) * 0.69))))
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1)
    unary = np.ones(int(ends[-1]), dtype=np.uint8)
    unary[ends - 1] = 0
    low = (gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)
    return k, np.packbits(np.concatenate([unary, low.astype(np.uint8).ravel()])).tobytes()


def rice_decode(k: int, n: int, coded: bytes) -> np.ndarray:
    """The values back: the first n zeros end the quotients, and n low parts follow."""
    bits = np.unpackbits(np.frombuffer(coded, dtype=np.uint8))
    stops = np.flatnonzero(bits == 0)[:n]
    quotient = np.diff(stops, prepend=-1).astype(np.uint64) - np.uint64(1)
    low = bits[stops[-1] + 1 : stops[-1] + 1 + n * k].reshape(n, k).astype(np.uint64)
    parts = (low << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotient << np.uint64(k)) | parts, dtype=np.uint64)


def _hashed(docs: DataFrame) -> DataFrame:
    """Every row with its normalised text, its sender, its place among the sender's rows, and its hash."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            plain = [x.translate(BLANKS).encode("utf-8", "surrogatepass") for x in texts]
            row = np.arange(first, first + len(texts))
            first += len(texts)
            h = np.array([xxhash.xxh64_intdigest(x) for x in plain], dtype=np.uint64).view(np.int64)
            sizes, shas = pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in plain], pa.string())
            columns = [batch.column(0), sizes, pa.array(plain, pa.binary()), shas, pa.array(row >> SENDER_BITS), pa.array(row), pa.array(h)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "chars", "plain", "text_sha256", "sender", "row", "h"])

    names = "chars long, plain binary, text_sha256 string, sender long, row long, h long"
    kind = docs.select("doc_id").schema
    for x in names.split(", "):
        kind = kind.add(*x.split())
    return bounded(docs).mapInArrow(of, kind)


def _dealt(h: np.ndarray, owner_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Iterator[tuple[int, slice]]]:
    """A sender's distinct hashes in order, each row's place among them, how often each comes, and each owner's part."""
    values, place, times = np.unique(h.view(np.uint64), return_inverse=True, return_counts=True)
    owner = (values >> np.uint64(64 - owner_bits)).astype(np.int64)
    cut = np.flatnonzero(np.diff(owner, prepend=-1, append=1 << 62))
    return values, place, times, ((int(owner[a]), slice(int(a), int(b))) for a, b in zip(cut[:-1], cut[1:], strict=True))


def _messages(rows: DataFrame, owner_bits: int) -> DataFrame:
    """Senders: (sender, owner, k, n, bits, again): coded distinct hashes, and a bit for each that the sender has more than once."""

    def of(table: pa.Table) -> pa.Table:
        values, _, times, parts = _dealt(np.asarray(table.column("h")).astype(np.int64), owner_bits)
        rest, out = np.uint64((1 << (64 - owner_bits)) - 1), []
        for owner, at in parts:
            k, blob = rice_encode(values[at] & rest)
            out.append((owner, k, at.stop - at.start, blob, np.packbits(times[at] > 1).tobytes()))
        names, kinds = ("owner", "k", "n", "bits", "again"), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        columns = {n: pa.array(x, t) for n, x, t in zip(names, zip(*out, strict=True), kinds, strict=True)}
        return pa.table({"sender": pa.array(np.full(len(out), table.column("sender")[0].as_py())), **columns})

    return rows.select("sender", "h").groupBy("sender").applyInArrow(of, "sender long, owner long, k int, n int, bits binary, again binary")


def _answers(messages: DataFrame) -> DataFrame:
    """Owners: (sender, owner, marks), a bit for each hash of a message."""

    def of(table: pa.Table) -> pa.Table:
        sent = table.select(["k", "n", "bits", "again"]).to_pylist()
        ends = np.cumsum([x["n"] for x in sent])
        values = np.concatenate([rice_decode(x["k"], x["n"], x["bits"]) for x in sent])
        twice = np.concatenate([np.unpackbits(np.frombuffer(x["again"], dtype=np.uint8), count=x["n"]) for x in sent]).astype(bool)
        order = np.argsort(values, kind="stable")
        same = np.concatenate([[False], values[order][1:] == values[order][:-1], [False]])
        twice[order] |= same[1:] | same[:-1]
        marks = [np.packbits(x).tobytes() for x in np.split(twice, ends[:-1])]
        return pa.table({"sender": table.column("sender"), "owner": table.column("owner"), "marks": pa.array(marks, pa.binary())})

    return messages.groupBy("owner").applyInArrow(of, "sender long, owner long, marks binary")


def _told(rows: DataFrame, answers: DataFrame, owner_bits: int) -> DataFrame:
    """Senders again: (sender, marks), a bit for each of the sender's rows."""

    def of(mine: pa.Table, got: pa.Table) -> pa.Table:
        row, h = (np.asarray(mine.column(c)).astype(np.int64) for c in ("row", "h"))
        values, place, _, parts = _dealt(h, owner_bits)
        marks = dict(zip(got.column("owner").to_pylist(), got.column("marks").to_pylist(), strict=True))
        twice = np.zeros(len(values), dtype=np.uint8)
        for owner, at in parts:
            twice[at] = np.unpackbits(np.frombuffer(marks[owner], dtype=np.uint8), count=at.stop - at.start)
        at = row & ((1 << SENDER_BITS) - 1)
        out = np.zeros(int(at.max()) + 1, dtype=np.uint8)
        out[at] = twice[place]
        return pa.table({"sender": mine.column("sender").slice(0, 1), "marks": pa.array([np.packbits(out).tobytes()], pa.binary())})

    return rows.select("sender", "row", "h").groupBy("sender").cogroup(answers.groupBy("sender")).applyInArrow(of, "sender long, marks binary")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_rows: int = 50_000) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per input row.

    Texts are equal if they are so without blanks; null counts as empty. The longest original text, in code
    points, stays, then the smallest id (null ids last), then the first in the table. So just one of fully
    repeated rows is kept. Ids may be of any type. ``owner_rows`` sets about how many hashes an owner holds,
    8 bytes each.
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = durable_buckets(_hashed(picked), "sender", "zstd")
    owner_bits = min(16, max(4, (rows.count() // owner_rows).bit_length()))
    answers = durable(_answers(durable(_messages(rows, owner_bits))))
    # the marks go to the buckets of their senders; the texts stay where they are
    place = f"cast(row & {(1 << SENDER_BITS) - 1} as int)"
    told = rows.join(durable(_told(rows, answers, owner_bits)).hint("shuffle_hash"), "sender").withColumn("byte", F.expr(f"hex(substring(marks, {place} div 8 + 1, 1))"))
    told = told.withColumn("suspect", F.expr(f"shiftright(cast(conv(byte, 16, 10) as int), 7 - {place} % 8) % 2 = 1"))
    suspects = told.where("suspect")
    verified = suspects.groupBy("plain").agg(F.count("*").alias("group_size")).select(F.sha2("plain", 256).alias("text_sha256"), "group_size")
    first = F.min(F.struct(-F.col("chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))
    groups = durable(
        suspects.groupBy("text_sha256").agg(first.alias("first")).join(verified, "text_sha256").selectExpr("text_sha256", "first.doc_id as keep_id", "first.row as keep_row", "group_size")
    )
    alone = told.where("not suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    ids = suspects.select("doc_id", "text_sha256", "row").join(groups, "text_sha256")
    return alone.unionAll(ids.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"))


EXACT_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
