"""Product codes for vectors, their codebooks learned by Lloyd rounds over cover trees.

Vectors become integers and are cut into equal parts; each part position has a codebook. A task builds cover trees over its
own rows, one a part position and some thousand rows: a node has a centre, the radius of its points about it, and a run of
the tree's point order, so cumulative sums give the count and the sum of any subtree. In a Lloyd round a node
goes down only as far as it must: if its centre is nearer to one entry than to any other by more than twice the radius, the
triangle inequality gives that entry the whole subtree at once; else its children are asked, and an ambiguous leaf's points are
compared exactly. All sums are integers, so neither trees nor partitions change any result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import durable
from .text import bounded

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
TREE_ROWS = 2048
LEAF = 8  # points that are not divided further
SHRINK = 1.5  # a node's radius over that of the balls that cover its points
EXACT = 1 << 52  # doubles hold integers below this


@dataclass
class CoverTree:
    """Nodes in order of depth. Node i holds points order[start[i]:end[i]]; its children are first[i] .. first[i] + children[i] - 1."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    children: np.ndarray


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(points, entries): exact squared distances of integer vectors."""
    most = max((int(np.abs(x).max()) for x in (points, entries) if x.size), default=0)
    small = 4 * points.shape[1] * most * most < EXACT
    x, y = (points.astype(np.float64), entries.astype(np.float64)) if small else (points.astype(np.int64), entries.astype(np.int64))
    made = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)
    return made.astype(np.int64)


def cover_tree(points: np.ndarray, leaf: int = LEAF, shrink: float = SHRINK) -> CoverTree:
    """Each node's points are covered by balls of its radius / ``shrink`` about children's centres, the node's own centre first;
    no child's centre lies in the ball of a child before it."""
    order = np.arange(len(points))
    nodes = [(0, len(points), 0, int(squared(points, points[:1]).max(initial=0)))]  # start, end, centre, squared radius
    first, children = [], []
    k = 0
    while k < len(nodes):
        start, end, centre, far = nodes[k]
        k += 1
        first.append(len(nodes))
        if end - start <= leaf or far == 0:
            children.append(0)
            continue
        rest, near = order[start:end].copy(), far / (shrink * shrink)
        at, made, next_centre = start, 0, centre
        while rest.size:
            d = squared(points[rest], points[next_centre : next_centre + 1])[:, 0]
            mine = d <= near
            n = int(mine.sum())
            order[at : at + n] = rest[mine]
            nodes.append((at, at + n, next_centre, int(d[mine].max())))
            at, made, rest = at + n, made + 1, rest[~mine]
            next_centre = int(rest[0]) if rest.size else 0
        children.append(made)
    start, end, centre, far = (np.array(x, dtype=np.int64) for x in zip(*nodes, strict=True))
    return CoverTree(order, start, end, centre, np.sqrt(far.astype(np.float64)), np.array(first, dtype=np.int64), np.array(children, dtype=np.int64))


def assign(tree: CoverTree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest entry of each point, the lower of equals, in the tree's order; and how many points went with a whole subtree."""
    owner = np.zeros(len(points), dtype=np.int64)
    asked, whole = np.zeros(1, dtype=np.int64), 0
    while asked.size:
        d = squared(points[tree.centre[asked]], entries)
        best = d.argmin(axis=1)
        nearest = np.sqrt(d[np.arange(len(asked)), best].astype(np.float64))
        d[np.arange(len(asked)), best] = np.iinfo(np.int64).max
        second = np.sqrt(d.min(axis=1).astype(np.float64))
        radius = tree.radius[asked]
        sure = (radius == 0) | (nearest + 2 * radius < second * (1 - 1e-9))
        for node, entry in zip(asked[sure], best[sure], strict=True):
            owner[tree.start[node] : tree.end[node]] = entry
            whole += int(tree.end[node] - tree.start[node])
        asked = asked[~sure]
        leaves = asked[tree.children[asked] == 0]
        if leaves.size:
            places = np.concatenate([np.arange(tree.start[x], tree.end[x]) for x in leaves])
            owner[places] = squared(points[tree.order[places]], entries).argmin(axis=1)
        inner = asked[tree.children[asked] > 0]
        asked = np.concatenate([np.arange(tree.first[x], tree.first[x] + tree.children[x]) for x in inner]) if inner.size else inner
    return owner, whole


def totals(owner: np.ndarray, cumulative: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """(count, sum) for each entry from runs of equal owners in the tree's order: a run is a difference of cumulative sums."""
    cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]])) if owner.size else np.zeros(1, dtype=np.int64)
    count, added = np.zeros(entries, dtype=np.int64), np.zeros((entries, cumulative.shape[1]), dtype=np.int64)
    np.add.at(count, owner[cuts[:-1]], np.diff(cuts))
    np.add.at(added, owner[cuts[:-1]], cumulative[cuts[1:]] - cumulative[cuts[:-1]])
    return count, added


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as a double; null if the vector or a component is null or a component is not finite."""
    numbers = vector.cast("array<double>")
    fit = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & fit, F.transform(numbers, lambda x: F.floor(x * F.lit(float(scale)))))


WIDE = {f: "<f8" if f == "radius" else "<i4" for f in CoverTree.__annotations__}


def grown_trees(kept: DataFrame, width: int, parts: int, tree_rows: int, kind: str) -> DataFrame:
    """(vec_id, n, label) rows as trees, written once: (ids, labels, points, trees), some ``tree_rows`` rows of a task in each."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, tree_rows):
                some = batch.slice(at, tree_rows)
                n = some.num_rows
                listed = some.column(2)
                points = np.zeros((n, parts * width), dtype=np.int64)
                sizes = np.asarray(pa.compute.list_value_length(listed)).astype(np.int64)
                rows = np.repeat(np.arange(n), sizes)
                points[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(listed.flatten())
                trees = [cover_tree(points[:, p * width : (p + 1) * width]) for p in range(parts)]
                packed = [{f: getattr(t, f).astype(w).tobytes() for f, w in WIDE.items()} for t in trees]
                whole = lambda c: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c)
                yield pa.RecordBatch.from_arrays(
                    [whole(some.column(0)), whole(some.column(1)), pa.array([points.astype(kind).tobytes()], pa.binary()), pa.array([packed], pa.list_(pa.struct([(f, pa.binary()) for f in WIDE])))],
                    ["ids", "labels", "points", "trees"],
                )

    tree = T.ArrayType(T.StructType([T.StructField(f, T.BinaryType()) for f in WIDE]))
    schema = T.StructType([T.StructField("ids", T.ArrayType(kept.schema["vec_id"].dataType)), T.StructField("labels", T.ArrayType(kept.schema["label"].dataType)), T.StructField("points", T.BinaryType()), T.StructField("trees", tree)])
    return durable(bounded(kept.select("vec_id", "label", "n")).mapInArrow(of, schema), "zstd")


def _unpacked(points, trees, rows: int, width: int, parts: int) -> Iterator[tuple[np.ndarray, CoverTree]]:
    """(points of the part, tree) of each part position of a row of ``grown_trees``."""
    held = points.as_buffer()
    x = np.frombuffer(held, dtype=f"<i{held.size // max(1, rows * parts * width)}" if held.size else "<i4").astype(np.int64).reshape(rows, parts * width)
    for p, t in enumerate(trees.as_py()):
        grown = {f: np.frombuffer(v, dtype=WIDE[f]) for f, v in t.items()}
        yield x[:, p * width : (p + 1) * width], CoverTree(**{f: v if f == "radius" else v.astype(np.int64) for f, v in grown.items()})


def lloyd_round(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (parts, entries, width) after one round: componentwise floors of the means; unused entries stay.

    A task sends one sum for each entry; the driver gets as many rows as there are entries.
    """
    spark = trees.sparkSession
    parts, entries, width = books.shape
    sent = spark.sparkContext.broadcast(books)  # the codebooks, whatever the corpus

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, added = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
        for batch in batches:
            for labels, points, grown in zip(*batch.columns, strict=True):
                for p, (x, tree) in enumerate(_unpacked(points, grown, len(labels), width, parts)):
                    owner, _ = assign(tree, x, sent.value[p])
                    cumulative = np.concatenate([np.zeros((1, width), dtype=np.int64), np.cumsum(x[tree.order], axis=0)])
                    n, s = totals(owner, cumulative, entries)
                    count[p] += n
                    added[p] += s
        used = np.argwhere(count > 0)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(added[count > 0].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(used[:, 0]), pa.array(used[:, 1]), pa.array(count[count > 0]), sums], ["part", "entry", "n", "sums"])

    said = bounded(trees.select("labels", "points", "trees")).mapInArrow(of, "part long, entry long, n long, sums array<long>")
    each = said.select("part", "entry", "n", F.posexplode_outer("sums").alias("at", "sum")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
    new = books.copy()
    for r in each.collect():
        if r.at is not None:
            new[r.part, r.entry, r.at] = r.sum // r.n
    return new


def first_books(kept: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """The parts of the rows with the smallest ids, null ids last, ties by vector; fewer rows make fewer entries."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "n").select("n").limit(entries).collect()
    whole = np.zeros((len(rows), parts * width), dtype=np.int64)
    for k, r in enumerate(rows):
        whole[k, : len(r.n)] = r.n
    return whole.reshape(len(rows), parts, width).transpose(1, 0, 2).copy()


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, tree_rows: int = TREE_ROWS
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): one row per row with a whole vector.

    Rows whose vector is null or has null or non-finite components are left out. Vectors of other lengths than the longest, or than a
    multiple of ``parts``, are filled up with zeros. Null ids come last among the first entries; null and repeated ids and
    labels, of any type, pass through, null labels as one. Fewer rows than entries make smaller codebooks; without rows
    there are none. Distances must fit 64 bits, or there is an error. Equal rows get equal codes.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits a part, so at most 256 entries")
    spark = vectors.sparkSession
    numbers = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), whole_numbers(F.col(vector_col), scale).alias("n"))
    kept = durable(numbers.where("n is not null"))
    dims, most = kept.agg(F.max(F.size("n")), F.max(F.greatest(F.array_max("n"), -F.array_min("n")))).first()
    width = -(-(dims or 0) // parts)
    if 4 * (most or 0) ** 2 * parts * width >= 1 << 63:
        raise ValueError("squared distances of these vectors do not fit 64 bits; take a smaller scale")
    books = first_books(kept, width, parts, entries)
    trees = grown_trees(kept, width, parts, tree_rows, "<i4" if (most or 0) < 1 << 31 else "<i8")
    for _ in range(rounds if books.size else 0):
        books = lloyd_round(trees, books)
    sent = spark.sparkContext.broadcast(books)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, points, grown in zip(*batch.columns, strict=True):
                n = len(ids)
                error, code = np.zeros(n, dtype=np.int64), np.zeros((n, parts), dtype=np.uint8)
                for p, (x, tree) in enumerate(_unpacked(points, grown, n, width, parts)):
                    owner, _ = assign(tree, x, sent.value[p])
                    code[tree.order, p] = owner
                    gap = x[tree.order] - sent.value[p][owner]
                    error[tree.order] += (gap * gap).sum(axis=1)
                codes = [c.tobytes().hex() for c in code]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(codes, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    kind = kept.select("vec_id", "label").schema.add("code", T.StringType()).add("error", T.LongType())
    coded = durable(bounded(trees).mapInArrow(of, kind))
    of_label = durable(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return coded.join(of_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


CODES_SQL = """
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rn, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT rn, part, q[part * (len(q) // 4) + 1 : (part + 1) * (len(q) // 4)] AS x FROM v, range(4) AS t(part)),
c0 AS (SELECT part, rn AS entry, x AS c FROM p WHERE rn < 256),
{rounds}
e AS (SELECT p.rn, p.part, min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)) * 256 + entry) AS best FROM p JOIN c4 ON p.part = c4.part GROUP BY p.rn, p.part),
r AS (SELECT rn, string_agg(printf('%02x', CAST(best % 256 AS INT)), '' ORDER BY part) AS code, CAST(sum(floor(best / 256)) AS BIGINT) AS error FROM e GROUP BY rn),
b AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS books FROM c4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, books AS codebooks_sha256 FROM r JOIN v ON r.rn = v.rn, b
"""
_ROUND = """
a{k} AS (SELECT p.rn, p.part, any_value(x) AS x, CAST(min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)) * 256 + entry) % 256 AS BIGINT) AS entry
       FROM p JOIN c{j} ON p.part = c{j}.part GROUP BY p.rn, p.part),
m{k} AS (SELECT part, entry, list(m ORDER BY i) AS c FROM (SELECT part, entry, i, floor(sum(x[i]) / count(*)) AS m FROM a{k}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY part, entry, i) GROUP BY part, entry),
c{k} AS (SELECT c{j}.part, c{j}.entry, coalesce(m{k}.c, c{j}.c) AS c FROM c{j} LEFT JOIN m{k} ON c{j}.part = m{k}.part AND c{j}.entry = m{k}.entry),"""
CODES_SQL = CODES_SQL.format(rounds="".join(_ROUND.format(k=k, j=k - 1) for k in range(1, ROUNDS + 1)))
