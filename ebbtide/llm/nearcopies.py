"""Groups of near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts with one shingle set are one node with a 64-bit SimHash. Nodes meet in two ways:

* by the Golay keys of their SimHashes, as in ``simhash``: all that differ in four or fewer bits;
* by the least hashes of a band, since at a similarity of 0.8 two SimHashes differ in about ten bits, more than
  Golay keys can reach at a bounded number of keys: 32 bands of 4 leave such a pair apart with a chance of
  (1 - 0.8^4)^32, about 5 in 10^8.

Meetings whose set sizes rule the similarity out are dropped, and so are those of long texts whose SimHashes
differ in more than 26 bits; the rest are compared by their whole sets. In a bucket of more than 32 members not all
pairs are formed: its sets are brought together, in blocks, and a prefix filter leads to those to compare.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import durable, durable_buckets
from ..operators.components import connected_components
from .decontaminate import BLOCK, marked
from .simhash import fingerprint_links
from .text import bounded, packed

BANDS, WIDTH = 32, 4
LARGE_RUN = 32
FAR_BITS, LONG_SET = 26, 64  # SimHashes speak only for sets of LONG_SET shingles or more
AT_ONCE = 1 << 12
BLOCK_BYTES = 4 << 20  # of the sets of a large bucket that are compared with one another or with as many
_rng = np.random.default_rng(7)
FLIPS = _rng.integers(0, 1 << 64, BANDS * WIDTH, dtype=np.uint64)
ODDS = _rng.integers(0, 1 << 64, BANDS * WIDTH, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word runs; a shorter text is one run, a wordless or null one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: max(1, len(words) - shingle + 1)].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends, strict=True)), dtype="<u8", count=len(starts)))


def sketch(hashes: np.ndarray) -> tuple[int, int, list[int]]:
    """A set's name, SimHash and band keys; an empty set has no keys."""
    node = xxhash.xxh64_intdigest(hashes.tobytes(), 1)
    if not hashes.size:
        return node, 0, []
    ones = np.zeros(64, dtype=np.int64)
    least = np.full(BANDS * WIDTH, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, hashes.size, AT_ONCE):
        part = hashes[at : at + AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        least = np.minimum(least, ((part[:, None] ^ FLIPS) * ODDS).min(axis=0))
    fp = int(np.packbits(ones * 2 > hashes.size, bitorder="little").view("<u8")[0])
    return node, fp, [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, WIDTH))]


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(row, doc_id, node, fp, n, keys): one row per input row. Ids are of any type that can be ordered."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda v: pa.array(np.array(v, dtype=np.uint64).view(np.int64))
        for batch in batches:
            sets = [shingle_set(x.as_py(), shingle) for x in batch.column(2)]
            made = [sketch(x) for x in sets]
            keys = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(m[2]) for m in made]), pa.int32()), signed([k for m in made for k in m[2]]))
            columns = [batch.column(0), batch.column(1), signed([m[0] for m in made]), signed([m[1] for m in made]), pa.array([x.size for x in sets], pa.int64()), keys]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "node", "fp", "n", "keys"])

    picked = docs.select("row", "doc_id", F.col("text").cast("string").alias("text"))
    kind = picked.select("row", "doc_id").schema
    for name in ("node", "fp", "n"):
        kind = kind.add(name, "long")
    return bounded(picked).mapInArrow(of, kind.add("keys", T.ArrayType(T.LongType())))


def _near(fp: np.ndarray, n: np.ndarray, one, others, share: float) -> np.ndarray:
    """Which of the others may have the similarity asked for."""
    small, large = np.minimum(n[one], n[others]), np.maximum(n[one], n[others])
    return (small >= share * large - 1e-9) & ((small < LONG_SET) | (np.bitwise_count(fp[one] ^ fp[others]) <= FAR_BITS))


def _by_bucket(rows: DataFrame, of: Callable, schema: str) -> DataFrame:
    """Calls ``of`` with the columns of whole buckets, sorted by key, the key first."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            columns = [np.asarray(c).astype(np.int64) for c in batch.columns]
            if not len(columns[0]):
                continue
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            if last or (held and held[-1][0][-1] != columns[0][0]):
                held.append([c[:last] for c in columns])
                yield from of(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            held.append([c[last:] for c in columns])
        if held:
            yield from of(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(met, schema)


def _cuts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))


def _candidates(share: float) -> Callable:
    """(a, b, large): pairs of nodes of small buckets, or a large bucket's key with each of its members."""

    def of(keys, node, fp, n) -> Iterator[pa.RecordBatch]:
        fp = fp.view(np.uint64)
        length = np.diff(_cuts(keys))
        size = np.repeat(length, length)
        few = np.flatnonzero((size > 1) & (size <= LARGE_RUN))
        pairs = [np.zeros((0, 2), dtype=np.int64)]
        for step in range(1, LARGE_RUN):
            one, other = few[step:], few[:-step]
            same = keys[one] == keys[other]
            if not same.any():
                break
            one, other = one[same], other[same]
            near = _near(fp, n, one, other, share)
            pairs.append(np.stack([node[one[near]], node[other[near]]], axis=1))
        many = size > LARGE_RUN
        found, large = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0), np.stack([keys[many], node[many]], axis=1)
        for x, flag in ((found, False), (large, True)):
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(np.full(len(x), flag))], ["a", "b", "large"])

    return of


def spanning_links(sets: list[np.ndarray], share: float) -> list[tuple[int, int]]:
    """Links (i, j) of similar sets that join the sets as all such links would: a prefix-filtered search.

    Elements are ordered from the rarest among these sets. Two similar sets share one of their first
    n - ceil(share * n) + 1 elements, so only sets that do are compared, and only where no link joins them yet.
    """
    sizes = np.array([x.size for x in sets])
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    rank = np.empty(names.size, dtype=np.int64)
    rank[np.argsort(np.bincount(codes), kind="stable")] = np.arange(names.size)
    coded = [np.sort(x) for x in np.split(rank[codes], np.cumsum(sizes)[:-1])]
    group, links = np.arange(len(sets)), []
    seen: dict[int, list[int]] = {}
    flag = np.zeros(names.size, dtype=np.int64)
    for i in np.argsort(sizes, kind="stable").tolist():
        prefix = coded[i][: sizes[i] - int(np.ceil(share * sizes[i] - 1e-9)) + 1].tolist()
        lists = [seen[x] for x in prefix if x in seen]
        rest = np.unique(np.concatenate(lists)) if lists else np.zeros(0, dtype=np.int64)
        rest = rest[sizes[rest] >= share * sizes[i] - 1e-9]
        flag[coded[i]] = 1
        while rest.size:
            part, rest = rest[:AT_ONCE], rest[AT_ONCE:]
            both = np.add.reduceat(flag[np.concatenate([coded[k] for k in part])], np.cumsum(sizes[part]) - sizes[part])
            near = part[both >= share * (sizes[part] + sizes[i] - both) - 1e-9]
            while near.size:
                j = int(near[0])
                links.append((i, j))
                group[group == group[j]] = group[i]
                near = near[group[near] != group[i]]
            rest = rest[group[rest] != group[i]]
        flag[coded[i]] = 0
        for x in prefix:
            seen.setdefault(x, []).append(i)
    return links


def _large(large: DataFrame, nodes: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """(a, b): verified links that join the members (key, node) of large buckets.

    A bucket is cut in blocks of about ``BLOCK_BYTES`` of sets; a task sees two blocks, whatever the bucket.
    """
    sized = large.join(nodes.select("node", "n"), "node")
    blocks = sized.groupBy("key").agg(F.ceil(F.sum("n") * 8 / BLOCK_BYTES).alias("blocks"))
    cut = sized.join(blocks, "key").select("key", "node", "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("block"))
    pairs = cut.select("key", "node", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    members = pairs.select("key", "node", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")).join(sets, "node")

    def of(table: pa.Table) -> pa.Table:
        node = np.asarray(table.column("node")).astype(np.int64)
        found = spanning_links([np.frombuffer(x.as_buffer(), dtype="<u8") for x in table.column("hashes")], share)
        links = np.sort(node[np.array(found, dtype=np.int64).reshape(-1, 2)], axis=1)
        return pa.table({"a": pa.array(links[:, 0]), "b": pa.array(links[:, 1])})

    return members.groupBy("key", "one", "two").applyInArrow(of, "a long, b long")


def _similar(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """The pairs whose whole sets have the similarity asked for."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype="<u8") for v in (x, y))
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(both >= share * (x.size + y.size - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return durable(met.select("a", "b", "x", "y").mapInArrow(of, "a long, b long"))


def _sets(docs: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of the rows given. Their texts are read where they stand."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), shingle) for x in batch.column(0)]
            nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), 1) for x in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "hashes"])

    there = marked(docs, rows).select(F.col("text").cast("string").alias("text"))
    return durable(bounded(there).mapInArrow(of, "node long, hashes binary"))


def _printed(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes whose SimHashes meet by the Golay keys, four or fewer bits apart: the first node of each fingerprint
    with the others of it, and with the first nodes of those it links to."""
    first = durable(nodes.where("n > 0").groupBy("fp").agg(F.min("node").alias("head")))
    alike = nodes.where("n > 0").join(first, "fp").where("node <> head").select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b"))
    links = fingerprint_links(first)
    ends = links.join(first.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    return alike.unionAll(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents ``packed`` under a key for each row, written once; ``block`` is what the table is bucketed by."""
    # a task's rows make few blocks, so bucketing by block writes few files and moves nothing
    return durable_buckets(packed(docs, id_col, text_col).withColumn("block", F.expr(f"row div {BLOCK}")), "block")


def near_copies(docs: DataFrame, shingle: int = 5, share: float = 0.8) -> DataFrame:
    """Rows of ``keyed`` -> (row, doc_id, keep): for each row the row of its group that stays.

    A group is a linked set: each member has a similarity of ``share`` or more to some other. The row with the
    smallest id stays, of rows with one id the first; a row without id stays only if no member has one.
    Wordless and null texts are one group.
    """
    prints = durable(sketches(docs, shingle))
    first = durable(prints.groupBy("node").agg(F.min("row").alias("row"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("row").alias("at"))).alias("best")))
    nodes = durable(prints.join(first.select("row"), "row", "left_semi").select("node", "fp", "n", "keys"))
    met = durable(_by_bucket(nodes.select(F.explode("keys").alias("key"), "node", "fp", "n"), _candidates(share), "a long, b long, large boolean"))
    large = met.where("large").select(F.col("a").alias("key"), F.col("b").alias("node"))
    pairs = durable(met.where("not large").select("a", "b").unionAll(_printed(nodes)).distinct())
    asked = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).unionAll(large.select("node")).distinct()
    sets = _sets(docs, durable(first.join(asked, "node").select("row")), shingle)
    roots = durable(connected_components(_similar(pairs, sets, share).unionAll(_large(large, nodes, sets, share))))
    own = durable(first.join(roots, "node", "left").select("node", "best", F.coalesce("root", "node").alias("root")))
    named = durable(own.join(own.groupBy("root").agg(F.min("best").alias("best")).select("root", F.col("best.at").alias("keep")), "root").select("node", "keep"))
    return prints.join(named, "node").select("row", "doc_id", "keep")
