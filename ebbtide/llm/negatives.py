"""Hard negatives from candidate blocks in Hilbert order, read as their zone maps ask.

Candidates are written along a Hilbert curve through the first principal axes, so that near vectors share a block, and
every block of some hundred rows keeps the least and greatest value of each dimension (and of the label). For an anchor, interval
arithmetic over these gives the range in which a block's scores lie. A search has windows of scores to fill with their best
rows; a block is read for a window only if its range meets the window and can still beat what the window holds.
A first pass over the shelf in which an anchor stands fills the windows; a second one meets all other shelves whose ranges
the anchors' common ranges leave open. Anchors go in flocks, those of one shelf, and candidates in shelves, so a task
sees one flock and one shelf at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import durable
from .codes import EXACT, whole_numbers
from .text import bounded

AXES, BITS = 8, 7  # of the curve
SAMPLE = 4096  # rows that the axes are fitted on, about
SHELF, BLOCK = 16384, 256
NO_ID = np.iinfo(np.int64).max  # stands for a null id, so that it comes last
LOW, HIGH = -(1 << 62), 1 << 62
WANT = "at int, low long, high long, first_row long, first_id long, first_score long"
FOUND = f"{WANT}, score long, id long, row long"


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of points (n, axes) of whole numbers below 2 ** bits along a Hilbert curve, as numbers of axes * bits bits."""
    x = points.T.astype(np.int64).copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):  # undo the curve's turns, from the largest cells down
        q = 1 << level
        for k in range(axes):
            turned = (x[k] & q) > 0
            swap = np.where(turned, 0, (x[0] ^ x[k]) & (q - 1))
            x[0] ^= np.where(turned, q - 1, swap)
            x[k] ^= swap
    for k in range(1, axes):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for k in range(axes):
            key = key << 1 | (x[k] >> level & 1)
    return key


@dataclass
class Curve:
    """Centre and principal axes of a sample, and the range along each that the curve divides."""

    centre: np.ndarray
    axes: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray) -> Curve:
        if not sample.size:
            return cls(np.zeros(sample.shape[1]), np.zeros((sample.shape[1], 1)), np.zeros(1), np.ones(1))
        centre = sample.mean(axis=0)
        _, axes = np.linalg.eigh((sample - centre).T @ (sample - centre))
        axes = axes[:, ::-1][:, :AXES]
        along = (sample - centre) @ axes
        return cls(centre, axes, along.min(axis=0), np.maximum(along.max(axis=0), along.min(axis=0) + 1e-9))

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        share = ((vectors - self.centre) @ self.axes - self.low) / (self.high - self.low)
        return hilbert_keys(np.clip(share * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)


def score_ranges(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, blocks): bounds of the scores with any vector between ``low`` and ``high``, by interval arithmetic.

    A dimension adds its anchor's value times the block's greatest value if the former is positive, else times the least.
    """
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def matrix(column, at: int, dims: int, kind) -> np.ndarray:
    return np.frombuffer(column[at].as_buffer(), dtype="<i4").reshape(-1, dims).astype(kind)


def long_list(column, at: int) -> np.ndarray:
    return np.asarray(column[at].values).astype(np.int64)


def asked_blocks(scores_low: np.ndarray, scores_high: np.ndarray, at: np.ndarray, floor: np.ndarray, high: np.ndarray, may: np.ndarray) -> np.ndarray:
    """(wants, blocks): which blocks each want must read; ``may``: where the label zones leave a row to find."""
    return (scores_high[at] >= floor[:, None]) & (scores_low[at] <= high[:, None]) & may


def best_of(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores, ties by smaller id, then by row."""
    picked = np.arange(len(scores))
    if len(scores) > most:
        picked = np.flatnonzero(scores >= np.partition(scores, -most)[-most])
    return picked[np.lexsort((rows[picked], ids[picked], -scores[picked]))][:most]


def _packed(of: dict[str, list]) -> dict[str, np.ndarray]:
    return {k: np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for k, v in of.items()}


def _search(row: dict, columns: dict, k: int, dims: int, kind, same: bool, most: int, first: bool, block: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Fills one flock's windows from one shelf: (found, floors)."""
    anchors, shelf = matrix(columns["f_codes"], k, dims, kind), matrix(columns["codes"], k, dims, kind)
    own_rows, own_labels = (long_list(columns[f"f_{c}"], k) for c in ("rows", "labels"))
    rows, ids, labels = (long_list(columns[c], k) for c in ("rows", "ids", "labels"))
    wants = {f: np.asarray(columns["wants"][k].values.field(f)).astype(np.int64) for f in row}
    floor = np.maximum(wants["low"], long_list(columns["floors"], k)) if not first else wants["low"].copy()
    blocks = -(-len(rows) // block)
    low, high = score_ranges(anchors, matrix(columns["zone_low"], k, dims, kind), matrix(columns["zone_high"], k, dims, kind))
    zone = np.stack([np.minimum.reduceat(labels, np.arange(blocks) * block), np.maximum.reduceat(labels, np.arange(blocks) * block)]) if blocks else np.zeros((2, 0))
    mine = own_labels[wants["at"]][:, None]
    may = (zone[0] <= mine) & (mine <= zone[1]) if same else (zone[0] != mine) | (zone[1] != mine)
    asked = asked_blocks(low, high, wants["at"], floor, wants["high"], may)
    out: dict[str, list] = {f: [] for f in (*row, "score", "id", "row")}
    order = np.argsort(wants["at"], kind="stable")
    for at in np.unique(wants["at"]).tolist():
        here = order[np.searchsorted(wants["at"][order], at) : np.searchsorted(wants["at"][order], at, "right")]
        read = asked[here].any(axis=0)
        if not read.any():
            continue
        cols = np.flatnonzero(np.repeat(read, block)[: len(rows)])
        cols = cols[(labels[cols] == own_labels[at]) & (rows[cols] != own_rows[at])] if same else cols[labels[cols] != own_labels[at]]
        scores = (shelf[cols] @ anchors[at]).astype(np.int64)
        for w in here.tolist():
            fit = np.flatnonzero((scores >= floor[w]) & (scores <= wants["high"][w]))
            best = fit[best_of(scores[fit], ids[cols[fit]], rows[cols[fit]], most)]
            if first and len(best) == most:
                floor[w] = scores[best[-1]]
            for f in row:
                out[f].append(np.full(len(best), wants[f][w]))
            for f, v in (("score", scores[best]), ("id", ids[cols[best]]), ("row", rows[cols[best]])):
                out[f].append(v)
    return _packed(out), floor


def _mapper(dims: int, kind: str, same: bool, most: int, first: bool, block: int):
    """Rows of a flock met with a shelf -> first: (flock, floors, found); else: a row for each row found."""
    fields = [w.split()[0] for w in WANT.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for k in range(batch.num_rows):
                found, floors = _search(dict.fromkeys(fields), columns, k, dims, np.dtype(kind), same, most, first, block)
                arrays = [pa.array(v.astype(np.int32) if f == "at" else v) for f, v in found.items()]
                if not first:
                    flock = pa.array(np.full(len(arrays[0]), columns["flock"][k].as_py(), dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([flock, *arrays], ["flock", *found])
                    continue
                listed = pa.ListArray.from_arrays(pa.array([0, len(arrays[0])], pa.int32()), pa.StructArray.from_arrays(arrays, list(found)))
                ends = pa.ListArray.from_arrays(pa.array([0, len(floors)], pa.int32()), pa.array(floors))
                yield pa.RecordBatch.from_arrays([columns["flock"].slice(k, 1), ends, listed], ["flock", "floors", "found"])

    return of


def shelved(rows: DataFrame, dims: int, count: int, curve: Curve, shelf: int = SHELF, block: int = BLOCK) -> DataFrame:
    """(row, id, label, n) in Hilbert order, written once as (shelf, rows, ids, labels, codes, zone_low, zone_high, box_low, box_high).

    Rows at one place of the curve go by row number, so no number of equal vectors overfills a shelf.
    """
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(curve)  # some axes of one vector's size

    def dense(column) -> np.ndarray:
        sizes = np.asarray(pa.compute.list_value_length(column)).astype(np.int64)
        made = np.zeros((len(sizes), dims), dtype=np.int64)
        made[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(column.flatten())
        return made

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = dense(batch.column(3))
            listed = pa.array([x.astype("<i4").tobytes() for x in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(sent.value.keys(codes)), *batch.columns[:3], listed], ["key", "row", "id", "label", "codes"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, shelf - size)
                batch = batch.slice(part.num_rows)
                held.append(part)
                size += part.num_rows
                if size == shelf:
                    yield one(held)
                    held, size = [], 0
        if size:
            yield one(held)

    def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        n = table.num_rows
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), dtype="<i4").reshape(n, dims)
        cuts = np.arange(0, n, block)
        low, high = np.minimum.reduceat(codes, cuts, axis=0), np.maximum.reduceat(codes, cuts, axis=0)
        longs = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(np.asarray(v).astype(np.int64)))
        blob = lambda v: pa.array([v.astype("<i4").tobytes()], pa.binary())
        rows, ids, labels = (np.asarray(table.column(c)) for c in ("row", "id", "label"))
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[:1]), longs(rows), longs(ids), longs(labels), blob(codes), blob(low), blob(high), longs(low.min(axis=0)), longs(high.max(axis=0))],
            ["shelf", "rows", "ids", "labels", "codes", "zone_low", "zone_high", "box_low", "box_high"],
        )

    lists = "rows array<long>, ids array<long>, labels array<long>, codes binary"
    with_keys = rows.select("row", "id", "label", "n").mapInArrow(keyed, "key long, row long, id long, label long, codes binary")
    ranged = with_keys.repartitionByRange(max(1, -(-count * 5 // (shelf * 4))), "key", "row").sortWithinPartitions("key", "row")
    return durable(ranged.mapInArrow(packed, f"shelf long, {lists}, zone_low binary, zone_high binary, box_low array<long>, box_high array<long>"))


def flocks_of(shelves: DataFrame, dims: int, every: int) -> DataFrame:
    """The rows of each shelf whose id is divisible by ``every``: (flock, f_rows, f_ids, f_labels, f_codes, f_low, f_high, wants), one open window each."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for k in range(batch.num_rows):
                ids = long_list(columns["ids"], k)
                mine = np.flatnonzero((ids % every == 0) & (ids != NO_ID))
                if not len(mine):
                    continue
                codes = matrix(columns["codes"], k, dims, "<i4")[mine]
                longs = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(np.asarray(v).astype(np.int64)))
                zero = pa.array(np.zeros(len(mine), dtype=np.int64))
                ends = [pa.array(np.full(len(mine), v, dtype=np.int64)) for v in (LOW, HIGH)]
                wants = pa.StructArray.from_arrays([pa.array(np.arange(len(mine), dtype=np.int32)), *ends, zero, zero, zero], [w.split()[0] for w in WANT.split(", ")])
                yield pa.RecordBatch.from_arrays(
                    [columns["shelf"].slice(k, 1), *(longs(long_list(columns[c], k)[mine]) for c in ("rows", "ids", "labels")), pa.array([codes.tobytes()], pa.binary()), longs(codes.min(axis=0)), longs(codes.max(axis=0)), pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), wants)],
                    ["flock", "f_rows", "f_ids", "f_labels", "f_codes", "f_low", "f_high", "wants"],
                )

    schema = f"flock long, f_rows array<long>, f_ids array<long>, f_labels array<long>, f_codes binary, f_low array<long>, f_high array<long>, wants array<struct<{WANT.replace(' ', ': ').replace(',:', ',')}>>"
    return durable(bounded(shelves.select("shelf", "rows", "ids", "labels", "codes")).mapInArrow(of, schema))


def _box_bound(least: bool) -> Column:
    """The least or greatest score of any vector of the flock's box with any of the shelf's."""
    flock = F.zip_with("f_low", "f_high", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    shelf = F.zip_with("box_low", "box_high", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pick = F.least if least else F.greatest
    ends = F.zip_with(flock, shelf, lambda x, y: pick(x["a"] * y["a"], x["a"] * y["b"], x["b"] * y["a"], x["b"] * y["b"]))
    return F.aggregate(ends, F.lit(0).cast("long"), lambda s, x: s + x)


def best_in_windows(flocks: DataFrame, shelves: DataFrame, dims: int, kind: str, same: bool, most: int, block: int = BLOCK) -> DataFrame:
    """(flock, at, ..., score, id, row, rank): for each want of a flock the ``most`` best rows of its window, of the anchor's label or of others."""
    shelf_columns = ["shelf", "rows", "ids", "labels", "codes", "zone_low", "zone_high"]
    own = flocks.join(shelves.select(*shelf_columns), F.col("flock") == F.col("shelf"))
    of_flock = "flock long, floors array<long>, found array<struct<" + FOUND.replace(" ", ": ").replace(",:", ",") + ">>"
    filled = durable(bounded(own).mapInArrow(_mapper(dims, kind, same, most, True, block), of_flock))
    asked = durable(flocks.join(filled.select("flock", "floors"), "flock"))
    light = asked.select("flock", "f_low", "f_high", F.array_min("floors").alias("least"), F.array_max(F.transform("wants", lambda w: w["high"])).alias("greatest"))
    # every flock is told of every shelf by its range alone; what is left is met in full
    slots = max(1, shelves.count())
    dealt = light.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    boxes = shelves.select("shelf", F.pmod(F.xxhash64("shelf"), F.lit(slots)).cast("int").alias("slot"), "box_low", "box_high")
    open_pairs = dealt.join(boxes, "slot").where((F.col("flock") != F.col("shelf")) & (_box_bound(False) >= F.col("least")) & (_box_bound(True) <= F.col("greatest")))
    met = open_pairs.select("flock", "shelf").join(asked.drop("f_low", "f_high"), "flock").join(shelves.select(*shelf_columns), "shelf")
    rest = bounded(met).mapInArrow(_mapper(dims, kind, same, most, False, block), f"flock long, {FOUND}")
    all_found = filled.select("flock", F.inline("found")).unionAll(rest)
    order = Window.partitionBy("flock", "at", "first_row").orderBy(F.col("score").desc(), "id", "row")
    return all_found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, every: int = 100, positives: int = 5, most: int = 10, shares: tuple[int, int] = (30, 90), shelf: int = SHELF, block: int = BLOCK
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows with a null label or vector, or with a null or non-finite component, take no part. Labels are whole numbers; of ids divisible by
    7 the label is moved on by one among ten. Ids are numbers; a row without one is no anchor and the last of its ties,
    and comes as null. Rows that repeat an id are rows of their own, as anchors, positives and negatives. Shorter vectors are
    filled up with zeros. Windows are in hundredths of the positive's score, both ends included; without any row in it a
    window gives none. An empty table gives no rows. Scores must fit 64 bits and components 32, or there is an error.
    """
    spark = vectors.sparkSession
    number, label = F.col(id_col).try_cast("long"), F.col(label_col).try_cast("long")
    base = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(number, F.lit(NO_ID)).alias("id"),
        F.when(number % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        whole_numbers(F.col(vector_col), scale).alias("n"),
    )
    rows = durable(base.where("label is not null and n is not null"))
    count, dims, greatest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("n")), F.lit(0)), F.coalesce(F.max(F.greatest(F.array_max("n"), -F.array_min("n"))), F.lit(0))).first()
    dims = max(1, dims)
    if greatest >= 1 << 31 or dims * greatest * greatest >= HIGH // 100:
        raise ValueError("scores of these vectors do not fit 64 bits; take a smaller scale")
    kind = "float64" if dims * greatest * greatest < EXACT else "int64"
    share = F.lit(min(1.0, SAMPLE / max(1, count)) * 2.0**40)
    sample = [r.n for r in rows.where(F.xxhash64("row").bitwiseAND(F.lit((1 << 40) - 1)) < share).select("n").collect()]  # about SAMPLE rows, whatever the corpus
    drawn = np.zeros((len(sample), dims))
    for k, n in enumerate(sample):
        drawn[k, : len(n)] = n
    shelves = shelved(rows, dims, count, Curve.fit(drawn), shelf, block)
    flocks = flocks_of(shelves, dims, every)
    near = durable(best_in_windows(flocks, shelves, dims, kind, True, positives, block))
    low, high = F.expr(f"(score * {shares[0]}L + 99L) div 100L"), F.expr(f"(score * {shares[1]}L) div 100L")
    window = F.struct("at", low.alias("low"), high.alias("high"), F.col("row").alias("first_row"), F.col("id").alias("first_id"), F.col("score").alias("first_score"))
    wants = near.where("score >= 0").groupBy("flock").agg(F.collect_list(window).alias("wants"))  # of one flock: at most a shelf's rows
    far = best_in_windows(flocks.drop("wants").join(wants, "flock"), shelves, dims, kind, False, most, block)
    named = flocks.select("flock", F.posexplode("f_ids").alias("at", "anchor_id"))
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return far.join(named, ["flock", "at"]).select(
        "anchor_id", known("first_id").alias("positive_id"), "rank", known("id").alias("negative_id"), F.col("first_score").alias("positive_score"), F.col("score").alias("negative_score")
    )


NEGATIVES_SQL = """
WITH q AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE alike) WHERE nth <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
