"""Quality scores by a byte-level convolutional network in numpy.

A text is read as UTF-8 bytes in chunks that overlap by the filter width, so every position of the whole
text is seen. Learned filters run over embedded bytes; each filter keeps its largest response over all
chunks (max pooling), and one layer combines these into a probability. Training reads whole texts as scoring does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import durable
from .language import held_out
from .text import bounded

WIDTH = 6  # bytes that a filter sees
STRIDE = 2
EMBED = 4
FILTERS = 16
CHUNK = 4096  # positions of a chunk
BATCH = 32  # texts of a training step
TEXTS_AT_LEAST = 64  # that fit into the sample's bytes, whatever their lengths


@dataclass
class ByteNet:
    """table: byte 256 (padding) included -> EMBED numbers; weight: window -> filters; out: pooled -> logit."""

    table: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float

    @classmethod
    def fresh(cls, seed: int) -> ByteNet:
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.5, (257, EMBED)).astype(np.float32)
        table[256] = 0
        weight = rng.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        return cls(table, weight, np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, FILTERS).astype(np.float32), 0.0)

    def windows(self, codes: np.ndarray) -> np.ndarray:
        """(positions, WIDTH * EMBED): a window at every STRIDE-th byte."""
        flat = self.table[codes].reshape(-1)
        n = (len(codes) - WIDTH) // STRIDE + 1
        return np.lib.stride_tricks.as_strided(flat, (n, WIDTH * EMBED), (STRIDE * EMBED * 4, 4))

    def pooled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest response over the whole text, and the byte at which its window begins; in bounded memory."""
        best, where = np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.int64)
        step = CHUNK * STRIDE
        for at in range(0, len(codes) - WIDTH + 1, step):
            made = self.windows(codes[at : at + step + WIDTH - STRIDE]) @ self.weight
            top = made.argmax(axis=0)
            value = made[top, np.arange(FILTERS)] + self.bias
            better = value > best
            best, where = np.where(better, value, best), np.where(better, at + top * STRIDE, where)
        return best.astype(np.float32), where

    def chance(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.shift, -30, 30)))

    def score(self, text: bytes) -> float:
        """Probability of label 1 from the whole text; any length."""
        return float(self.chance(self.pooled(padded(text))[0]))


def padded(text: bytes) -> np.ndarray:
    """Bytes as codes, with padding so that every byte lies in some window."""
    codes = np.frombuffer(text, dtype=np.uint8).astype(np.int64)
    size = max(WIDTH, len(codes))
    size += (size - WIDTH) % STRIDE
    return np.concatenate([codes, np.full(size - len(codes), 256)]) if size > len(codes) else codes


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 14, rate: float = 0.01, seed: int = 7) -> ByteNet:
    """Adam on the logistic loss, classes weighed evenly. Without both labels present the net stays at the base rate.

    Max pooling sends a text's gradient through one window a filter, so a step costs a forward pass and little more.
    """
    net = ByteNet.fresh(seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    if len(set(labels.tolist())) < 2:
        net.out[:] = 0
        net.shift = float(np.log(share / (1 - share)))
        return net
    rng = np.random.default_rng(seed)
    codes = [padded(x) for x in texts]
    weigh = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    names = ("table", "weight", "bias", "out", "shift")
    slow, fast = {p: 0.0 for p in names}, {p: 0.0 for p in names}
    steps = epochs * -(-len(texts) // BATCH)
    turn = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for first in range(0, len(order), BATCH):
            rows = order[first : first + BATCH]
            pooled, where = (np.stack(x) for x in zip(*(net.pooled(codes[i]) for i in rows), strict=True))
            err = (net.chance(pooled) - labels[rows]) * weigh[rows] / len(rows)
            back = err[:, None] * net.out * (pooled > 0)  # (texts, filters)
            seen = np.stack([codes[i][w[:, None] + np.arange(WIDTH)] for i, w in zip(rows, where, strict=True)])  # (texts, filters, bytes)
            x = net.table[seen].reshape(len(rows), FILTERS, WIDTH * EMBED)
            table = np.zeros_like(net.table)
            np.add.at(table, seen.ravel(), (back[:, :, None] * net.weight.T).reshape(-1, EMBED))
            grad = {"table": table, "weight": np.einsum("tf,tfx->xf", back, x), "bias": back.sum(axis=0), "out": err @ pooled, "shift": err.sum()}
            lr = rate * max(0.1, 1 - 0.9 * turn / steps)
            turn += 1
            for p in names:
                slow[p] = 0.9 * slow[p] + 0.1 * grad[p]
                fast[p] = 0.99 * fast[p] + 0.01 * grad[p] ** 2
                step = lr * (slow[p] / (1 - 0.9**turn)) / (np.sqrt(fast[p] / (1 - 0.99**turn)) + 1e-6)
                setattr(net, p, (getattr(net, p) - step).astype(np.float32) if p != "shift" else float(net.shift - step))
            net.table[256] = 0
    return net


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, per_label: int, most_bytes: int) -> tuple[list[bytes], np.ndarray]:
    """About ``per_label`` labelled rows of each label, by a hash of the id, with their whole texts, up to ``most_bytes`` in all.

    No single text takes more than a 64th of these bytes: longer ones are passed over, so they never crowd out the sample.
    An id with both labels, or with another label than 0 and 1, is left out; of rows that repeat an id one is taken. Ids meet as text.
    """
    known = labels.select(F.col("label_id").cast("string").alias("label_id"), F.col("label").cast("int").alias("label")).where("label is not null and label_id is not null")
    known = known.groupBy("label_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most and label in (0, 1)").drop("most")
    count = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not count:
        return [], np.zeros(0, np.int64)
    share = F.create_map(*[F.lit(x) for k, n in count.items() for x in (k, min(1.0, per_label / n))])
    rank = F.xxhash64("label_id").bitwiseAND(F.lit((1 << 40) - 1))
    drawn = durable(known.where(rank / F.lit(float(1 << 40)) < share[F.col("label")]))
    if drawn.count() <= 8 * per_label:  # about two samples' size; then no text is shuffled to find them
        drawn = F.broadcast(drawn)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    found = docs.join(drawn, docs[id_col].cast("string") == drawn["label_id"]).select("label_id", "label", text.alias("text"), F.xxhash64(text).alias("name"))
    found = durable(found.groupBy("label_id", "label").agg(F.min_by("text", "name").alias("text")).withColumn("bytes", F.octet_length("text")).where(F.col("bytes") <= most_bytes // TEXTS_AT_LEAST))
    run = Window.orderBy(F.xxhash64("label_id"), "label_id").rowsBetween(Window.unboundedPreceding, 0)  # over the sample's ids and sizes
    within = found.select("label_id", F.sum("bytes").over(run).alias("run")).where(F.col("run") <= most_bytes).select("label_id")
    rows = found.join(F.broadcast(within), "label_id").select("label_id", "label", "text").toArrow().sort_by([("label_id", "ascending")])
    return [bytes(x) for x in rows.column("text").to_pylist()], np.asarray(rows.column("label")).astype(np.int64)


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", parts: int = 3, part: int = 1, per_label: int = 1200,
    most_bytes: int = 64 << 20,
) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per input row.

    The training sample is bounded by about ``per_label`` rows of each label, with whole texts of up to ``most_bytes``
    in all, whatever the corpus; held-out rows are not in it. Scores read the whole text and nothing else.
    Null text is empty. Without labels every score is the even chance of 0.5; rows that repeat are scored alike.
    """
    seen = labels.select(F.col(label_id).alias("label_id"), F.col(label_col).alias("label")).where(~held_out(F.col("label_id"), parts, part))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    net = train(*training_rows(rows, seen, "doc_id", "text", per_label, most_bytes))
    sent = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [sent.value.score((x.as_py() or "").encode("utf-8", "surrogatepass")) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names)

    marked = rows.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "text")
    names = ["doc_id", "held_out", "score"]
    scored = bounded(marked).mapInArrow(of, marked.select("doc_id", "held_out", F.lit(0.0).alias("score")).schema)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
