"""Shards of near-equal size by sampled splitters, in DataFrame functions only.

Rows are ordered by (MD5 of the text, id, row), so equal texts are neighbours and any group can
still be cut. A size-weighted sample of keys gives the quantile boundaries of many more ranges than shards; a
range that holds more than twice its share gets splitters of its own, until none does. Range
totals then place each range, and a window inside each range places each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import durable
from .mixing import uniform

RANGES_PER_SHARD = 16  # at least
ROWS_PER_RANGE = 1 << 20  # about: a window sorts one range
SAMPLES_PER_RANGE = 12
MOST_ROUNDS = 8


def range_of(key: Column, bounds: list[str]) -> Column:
    """Number of boundaries at or below the key: a binary search as a fold over the powers of two."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    table = F.split(F.lit(",".join(bounds)), ",")  # one constant, of however many boundaries
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.get(table, at + step - 1) <= key), at + step).otherwise(at),
    )


def _splitters(rows: DataFrame, total: int, ranges: int, salt: str) -> list[str]:
    """At most ranges - 1 boundaries from about ``SAMPLES_PER_RANGE`` keys a range, drawn in proportion to size."""
    wanted = ranges * SAMPLES_PER_RANGE
    drawn = rows.where(uniform(F.col("key"), salt) * total < F.col("size") * F.lit(float(wanted)))
    ranked = drawn.select("key", F.ntile(ranges).over(Window.orderBy("key")).alias("part"))
    return sorted({r.key for r in ranked.groupBy("part").agg(F.min("key").alias("key")).where("part > 1").collect()})


def shard_by_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, overhead: int = 16, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): one row per input row.

    A row's size is its text's UTF-8 bytes plus ``overhead``. Shards get equal bytes to within one row;
    slots count from 0 without gaps. Null text is empty (size 16, checksum 0); null ids sort first, ids that are no numbers last; repeated rows
    are told apart by a row number. An empty table gives no rows. What reaches the driver is splitters and
    range totals: one for about every ``rows_per_range`` rows, and 16 a shard at least.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    number = F.col(id_col).cast("string").try_cast("long")
    base = durable(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.concat(
                F.md5(text),
                F.when(F.col(id_col).isNull(), "-").when(number.isNull(), "2").when(number < 0, "0").otherwise("1"),
                F.coalesce(F.lpad(F.hex(number), 16, "0"), F.md5(F.col(id_col).cast("string")), F.lit("")),
                F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"),
            ).alias("key"),
        )
    )
    rows, total = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bounds: list[str] = []
    ranges = max(shards * RANGES_PER_SHARD, -(-rows // rows_per_range))
    if rows:
        bounds = _splitters(base, total, ranges, "split")
    share = max(1, total // ranges)
    sums: list = []
    for turn in range(MOST_ROUNDS):
        placed = base.withColumn("part", range_of(F.col("key"), bounds))
        sums = placed.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()
        over = [r for r in sums if r.bytes > 2 * share and r.n > 2]
        if not over:
            break
        extra = sum(r.bytes for r in over)
        more = _splitters(placed.where(F.col("part").isin([r.part for r in over])), extra, max(2, 2 * extra // share), f"split{turn}")
        if not set(more) - set(bounds):
            break
        bounds = sorted({*bounds, *more})
    # first row and first byte of each range
    at_row = at_byte = 0
    first: dict[int, tuple[int, int]] = {}
    for r in sorted(sums, key=lambda r: r.part):
        first[r.part] = (at_row, at_byte)
        at_row, at_byte = at_row + r.n, at_byte + r.bytes
    spark = docs.sparkSession
    starts = spark.createDataFrame([(k, *v) for k, v in first.items()] or [(0, 0, 0)], "part int, row0 long, byte0 long")
    inside = Window.partitionBy("part").orderBy("key")
    run = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    middle = F.col("byte0") + F.col("run") - F.expr("size div 2")
    ordered = durable(
        base.withColumn("part", range_of(F.col("key"), bounds))
        .withColumn("run", run)
        .withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(starts), "part")  # as many rows as ranges, a multiple of the shards
        .withColumn("shard", F.least(F.floor(middle * shards / F.lit(max(1, total))), F.lit(shards - 1)).cast("int"))
        .withColumn("place", F.col("row0") + F.col("nth") - 1)
        .select("doc_id", "size", "text_crc32", "shard", "place")
    )
    heads = ordered.groupBy("shard").agg(F.min("place").alias("head"))
    return ordered.join(F.broadcast(heads), "shard").select(  # at most one row per shard
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("head")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
