"""Near-duplicate groups by SimHash fingerprints, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The perfect binary Golay code
(23, 12, 7) puts every 23-bit word within three bits of exactly one codeword. A segment's keys are the
12-bit indices of all codewords within FOUR bits of it: one key where its own codeword is
within two bits, six where it is three away. Two words that differ in at most two bits always share a key.

Four differing bits fall on three segments so that one of these holds:

* some segment is untouched, and of the other two the better one has at most two errors:
  key = the whole untouched segment and a Golay index of the other (six tables);
* no segment is untouched, so each has at most two errors: key = a Golay index of all three (one table).

So equal keys miss no pair. Every meeting is verified on the whole fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import durable
from ..operators.components import connected_components
from .text import bounded

GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit, bits
LARGE_RUN = 32  # buckets of more members are linked by a search instead of member by member
HASHES_AT_ONCE = 1 << 16


def _parity(message: int) -> int:
    rest = message << 11
    for bit in range(22, 10, -1):
        if rest >> bit & 1:
            rest ^= GENERATOR << (bit - 11)
    return rest


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parity of each 12-bit message; for each 11-bit syndrome the error patterns of up to four bits, and how many."""
    parity = np.array([_parity(m) for m in range(1 << 12)], dtype=np.int64)
    near: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            near[int(parity[error >> 11]) ^ (error & 0x7FF)].append(error)
    patterns = np.array([(x + [x[0]] * 6)[:6] for x in near], dtype=np.int64)
    return parity, patterns, np.array([len(x) for x in near], dtype=np.int64)


def golay_keys(words: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: six codeword indices each, and how many of them count."""
    parity, patterns, counts = tables
    syndrome = parity[words >> 11] ^ (words & 0x7FF)
    return (words[:, None] ^ patterns[syndrome]) >> 11, counts[syndrome]


def fingerprint_keys(prints: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """uint64 fingerprints -> (position of the fingerprint, key), all tables, no key twice for one fingerprint."""
    raw = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    keys, counts = zip(*(golay_keys(x, tables) for x in raw), strict=True)
    slot = np.arange(6)
    ok = [slot[None, :] < c[:, None] for c in counts]
    who, out = [], []
    table = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                table += 1
                at, k = np.nonzero(ok[j])
                who.append(at)
                out.append((table << 36) | (raw[i][at] << 12) | keys[j][at, k])
    at, x, y, z = np.nonzero(ok[0][:, :, None, None] & ok[1][:, None, :, None] & ok[2][:, None, None, :])
    who.append(at)
    out.append((keys[0][at, x] << 24) | (keys[1][at, y] << 12) | keys[2][at, z])
    return np.concatenate(who), np.concatenate(out)


def simhash(text: str | None, shingle: int, seed: int = 42) -> int:
    """Fingerprint of a whole text. Bounded memory: hashes are counted in pieces."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, HASHES_AT_ONCE):
        part = np.array(
            [digest(line[a:b], seed) for a, b in zip(starts[at : at + HASHES_AT_ONCE], ends[at : at + HASHES_AT_ONCE], strict=True)],
            dtype="<u8",
        )
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, fp): one row per input row, duplicates and null ids included; fp holds the 64 bits as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [simhash(x.as_py(), shingle) for x in batch.column(1)]
            fp = np.array(values, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bounded(picked).mapInArrow(of, picked.select("doc_id").schema.add("fp", "long"))


def _search(members: np.ndarray, most: int) -> list[np.ndarray]:
    """Links that join each linked set of one bucket: a breadth-first search that drops what it has reached."""
    links = []
    rest = np.unique(members)
    while rest.size > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and rest.size:
            here = todo.pop()
            near = np.bitwise_count(rest ^ here) <= most
            found = rest[near]
            if found.size:
                links.append(np.stack([np.full(found.size, here), found], axis=1))
                todo.extend(found)
                rest = rest[~near]
    return links


def _links(keys: np.ndarray, prints: np.ndarray, most: int) -> np.ndarray:
    """Verified links of whole buckets; rows are sorted by key."""
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    length = np.diff(cut)
    links = [np.zeros((0, 2), dtype=np.uint64)]
    for k in np.flatnonzero(length > LARGE_RUN):
        links += _search(prints[cut[k] : cut[k + 1]], most)
    few = np.repeat((length > 1) & (length <= LARGE_RUN), length)
    keys, prints = keys[few], prints[few]
    for step in range(1, LARGE_RUN):
        same = keys[step:] == keys[:-step]
        if not same.any():
            break
        a, b = prints[step:][same], prints[:-step][same]
        near = (np.bitwise_count(a ^ b) <= most) & (a != b)
        links.append(np.stack([a[near], b[near]], axis=1))
    out = np.concatenate(links)
    return np.unique(np.sort(out, axis=1), axis=0)


def fingerprint_links(prints: DataFrame, most: int = 4) -> DataFrame:
    """Distinct fingerprints (fp) -> (a, b), links of at most ``most`` (four or fewer) bits.

    The links span every linked set: in a bucket of more than 32 members those that a search
    crosses, in others all. A bucket holds distinct fingerprints of eight bytes, read as a sorted stream.
    """
    if not 0 <= most <= 4:
        raise ValueError("the Golay keys cover up to 4 differing bits")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = golay_tables()
        for batch in batches:
            values = np.asarray(batch.column(0)).astype(np.int64)
            for at in range(0, len(values), 2048):
                fp = values[at : at + 2048]
                who, key = fingerprint_keys(fp.view(np.uint64), tables)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[who])], ["key", "fp"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            links = _links(keys, values.view(np.uint64), most).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

        for batch in batches:
            keys, values = (np.asarray(c).astype(np.int64) for c in batch.columns)
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            if last or (held and held[-1][0][-1] != keys[0]):
                held.append((keys[:last], values[:last]))
                yield done(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            held.append((keys[last:], values[last:]))
        if held:
            yield done(*(np.concatenate(x) for x in zip(*held, strict=True)))

    keys = prints.select("fp").mapInArrow(keyed, "key long, fp long")
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(met, "a long, b long").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    Copies share a fingerprint and are one node, so no pairs of copies arise. A null or wordless
    text has fingerprint zero and links like any other; a shorter text is one shingle. Rows that repeat an id
    stay as they are, and ids may be of any type. A null id never names a group unless all its members are null. Other columns are not read.
    """
    prints = durable(fingerprints(docs, id_col, text_col, shingle))
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(fingerprint_links(nodes, most))
    own = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = durable(own.join(own.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id"))
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
