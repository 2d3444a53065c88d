"""Secret scans over a trigram inverted index.

The index holds all trigrams of all texts: a posting list for each trigram and block of documents, written to a table
once and asked by any rule thereafter. Each rule is a regular expression. From its syntax tree comes a Boolean query
over trigrams that every match must contain: a run of letters gives the AND of its trigrams, a class of few letters or
a choice the OR of its alternatives. A query intersects and unites the lists of a block; the regular expression then runs over
the candidates only. A rule without mandatory trigrams runs over every text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import durable, durable_buckets
from .text import bounded

BLOCK = 32768  # rows of a posting list's block
POSTINGS = 2_000_000  # that a task holds before it writes their lists
PIECE = 1 << 20
WIDEST, MOST_RUNS = 8, 64  # letters of a class that are told apart, and runs of letters held at once
Query = bool | str | tuple  # True: every document; a trigram; ("and" | "or", query, ...)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    accept: Callable[[re.Match], bool] | None = None  # a match that it refuses is dropped, without another try


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join([*map(any_case, ("password", "passwd", "secret", "token")), f"{any_case('api')}_?{any_case('key')}"])
BASE_RULES = (
    Rule("assign", rf"(?:{KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # maximal runs, so the same as a run of any length that is then measured
)
#: What the method adds: published prefixes of credential formats.
MORE_RULES = (
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}=*"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@"),
)


def _join(kind: str, parts: list[Query]) -> Query:
    """and: parts that hold always fall away; or: one of them makes all hold."""
    if kind == "or":
        if any(p is True for p in parts):
            return True
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else (kind, *parts)


def _letters(op, arg, any_case: bool) -> list[str] | None:
    """The characters that this item can be, A-Z as a-z, if they are at most ``WIDEST``. Beyond ASCII nothing is folded, as in the index."""
    if op is sre.LITERAL:
        found = {arg}
    elif op is sre.IN and all(o in (sre.LITERAL, sre.RANGE) for o, _ in arg):
        spans = [(v, v) if o is sre.LITERAL else v for o, v in arg]
        if sum(b - a + 1 for a, b in spans) > 2 * WIDEST:
            return None
        found = {c for a, b in spans for c in range(a, b + 1)}
    else:
        return None
    chars = {c.lower() if c.isascii() else c for c in map(chr, found)}
    if any_case and not chars <= set("abcdefghijlmnopqrtuvwxyz0123456789_-./:=+ \"'"):
        return None  # k and s, and letters beyond ASCII, have partners of other codes
    return sorted(chars) if len(chars) <= WIDEST else None


def _trigrams(runs: list[str]) -> Query:
    """What holds of a text with one of the runs."""
    each = []
    for run in runs:
        grams = [run[i : i + 3] for i in range(len(run) - 2)]
        each.append(_join("and", [g for g in grams if len(g.encode("utf-8", "surrogatepass")) == 3]))
    return _join("or", each)


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every text with a match of the pattern meets; True if there is none.

    Runs of letters are held with all alternatives of small classes, up to ``MOST_RUNS`` at once.
    """

    def longer(runs: list[str], letters: list[str]) -> list[str]:
        return [r + c for r in runs for c in letters]

    def of(items, any_case: bool) -> Query:
        parts, runs = [], [""]

        def cut() -> None:
            nonlocal runs
            parts.append(_trigrams(runs))
            runs = [""]

        def add(letters: list[str]) -> None:
            nonlocal runs
            if len(runs) * len(letters) > MOST_RUNS:
                ends = sorted({r[-2:] for r in runs})
                parts.append(_trigrams(runs))  # what follows still meets the last two letters
                runs = ends if len(ends) * len(letters) <= MOST_RUNS else [""]
            runs = longer(runs, letters)

        for op, arg in items:
            if (letters := _letters(op, arg, any_case)) is not None:
                add(letters)
                continue
            if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and 1 <= arg[0] <= 64 and None not in (inner := [_letters(*x, any_case) for x in arg[2]]):
                for letters in inner * arg[0]:
                    add(letters)
                if arg[0] != arg[1]:
                    cut()
                continue
            cut()
            if op is sre.SUBPATTERN:
                parts.append(of(arg[3], (any_case or bool(arg[1] & re.IGNORECASE)) and not arg[2] & re.IGNORECASE))
            elif op is sre.BRANCH:
                parts.append(_join("or", [of(x, any_case) for x in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                parts.append(of(arg[2], any_case))
        cut()
        return _join("and", parts)

    parsed = sre_parser.parse(pattern)
    return of(parsed, bool(parsed.state.flags & re.IGNORECASE))


def trigrams_in(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_in, query[1:]))


def grams_of(text: str) -> np.ndarray:
    """The distinct trigrams of a whole text, as numbers of 24 bits; letters A-Z count as a-z."""
    codes = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    found = [np.zeros(0, dtype=np.int32)]
    for at in range(0, max(0, len(codes) - 2), PIECE):
        c = codes[at : at + PIECE + 2].astype(np.int32)
        found.append(np.unique((c[:-2] << 16) | (c[1:-1] << 8) | c[2:]))
    return found[1] if len(found) == 2 else np.unique(np.concatenate(found))


def numbered(gram: str) -> int:
    return int.from_bytes(gram.encode(), "big")


def kept_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, block, doc_id, text): every row under a number of its own, written once, bucketed by block."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return durable_buckets(rows.withColumn("block", F.expr(f"row div {BLOCK}")), "block", "zstd")


def trigram_index(texts: DataFrame) -> DataFrame:
    """(gram, block, rows): the rows of a block, two bytes each, that hold a trigram; a block may have several lists of one.

    Lists are made from about two million postings at a time, so a task's memory does not grow with its texts.
    """

    def lists(grams: list[np.ndarray], rows: list[int]) -> Iterator[pa.RecordBatch]:
        gram = np.concatenate(grams)
        row = np.repeat(np.array(rows, dtype=np.int64), [len(g) for g in grams])
        for block in np.unique(row // BLOCK):
            here = row // BLOCK == block
            order = np.argsort(gram[here], kind="stable")
            ordered, places = gram[here][order], (row[here] % BLOCK)[order].astype("<u2")
            cut = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            ends = np.append(cut, len(ordered)).astype(np.int32) * 2
            blob = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(places.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(ordered[cut]), pa.array(np.full(len(cut), block)), blob], ["gram", "block", "rows"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, rows, size = [], [], 0
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grams.append(grams_of(text.as_py() or ""))
                rows.append(row)
                size += len(grams[-1])
                if size >= POSTINGS:
                    yield from lists(grams, rows)
                    grams, rows, size = [], [], 0
        if size:
            yield from lists(grams, rows)

    # in order of the trigram, so the few lists that a rule asks for lie in few pages of a file
    return durable(bounded(texts.select("row", "text")).mapInArrow(of, "gram int, block long, rows binary").sortWithinPartitions("gram"), "zstd")


def candidates(index: DataFrame, asked: list[Query]) -> DataFrame:
    """(block, masks): for each row of a block a mask of the queries that it meets; blocks in which none is met may be absent.

    The lists of the queries' trigrams are asked for one by one, so that each test of theirs reaches the files' statistics.
    """
    wanted = sorted(set().union(*map(trigrams_in, asked)))

    def answer(query: Query, held: dict[int, np.ndarray]) -> np.ndarray:
        if isinstance(query, str):
            return held.get(numbered(query), np.zeros(BLOCK, dtype=bool))
        unite = np.logical_and if query[0] == "and" else np.logical_or
        return unite.reduce([answer(q, held) for q in query[1:]])

    def of(table: pa.Table) -> pa.Table:
        held: dict[int, np.ndarray] = {}
        for gram, rows in zip(table.column("gram").to_pylist(), table.column("rows"), strict=True):
            held.setdefault(gram, np.zeros(BLOCK, dtype=bool))[np.frombuffer(rows.as_buffer(), dtype="<u2")] = True
        masks = np.zeros(BLOCK, dtype=np.int64)
        for k, query in enumerate(asked):
            if query is not True:
                masks |= answer(query, held).astype(np.int64) << k
        return pa.table({"block": table.column("block").slice(0, 1), "masks": pa.array([masks], pa.list_(pa.int64()))})

    lists = index.where(reduce(or_, [F.col("gram") == numbered(g) for g in wanted], F.lit(False)))
    return lists.groupBy("block").applyInArrow(of, "block long, masks array<long>")


def matches(rule: Rule, compiled: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    for m in compiled.finditer(text):
        if rule.accept is None or rule.accept(m):
            yield m.start(), m.end()


def scan(texts: DataFrame, index: DataFrame, base: tuple[Rule, ...], more: tuple[Rule, ...]) -> DataFrame:
    """The rules' matches in ``kept_texts``, found through their ``trigram_index``; up to 63 rules at once. Columns as of ``secret_rows``."""
    rules = (*base, *more)
    if len(rules) > 63:
        raise ValueError("scan 63 rules at a time")
    asked = [trigram_query(r.pattern) for r in rules]
    always = sum(1 << k for k, q in enumerate(asked) if q is True)
    # masks go to the blocks of their texts; the texts stay where they are
    met = texts.join(durable(candidates(index, asked)).hint("shuffle_hash"), "block", "left")
    picked = met.select("doc_id", "text", F.coalesce(F.expr(f"masks[cast(row % {BLOCK} as int)]"), F.lit(0).cast("long")).alias("mask"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern) for r in rules]
        for batch in batches:
            out: dict[str, list] = {f"n_{r.kind}": [] for r in base}
            digests, spans, tried = [], [], []
            for text, mask in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                text, found = text.as_py() or "", []
                for k, rule in enumerate(rules):
                    if (mask | always) >> k & 1:
                        found += [(a, k, b) for a, b in matches(rule, compiled[k], text)]
                found.sort()
                tried.append(mask.bit_count())
                for k, r in enumerate(base):
                    out[f"n_{r.kind}"].append(sum(y[1] == k for y in found))
                line = [(f"{rules[k].kind}:{a}:{b}", k < len(base)) for a, k, b in found]
                digests.append(hashlib.sha256(",".join(s for s, own in line if own).encode()).hexdigest())
                spans.append(",".join(s for s, _ in line))
            columns = [batch.column(0), *(pa.array(v, pa.int64()) for v in out.values()), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(tried, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *out, "base_sha256", "spans", "n_candidates"])

    kind = picked.select("doc_id").schema
    for name in (f"n_{r.kind}" for r in base):
        kind = kind.add(name, "long")
    return bounded(picked).mapInArrow(of, kind.add("base_sha256", "string").add("spans", "string").add("n_candidates", "long"))


def secret_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Rule, ...] = BASE_RULES, more: tuple[Rule, ...] = MORE_RULES
) -> DataFrame:
    """(doc_id, n_<base kind>..., base_sha256, spans, n_candidates): one row per input row.

    Spans are kind:start:end in code points, end exclusive, by start, then kind as listed. Null text is empty;
    null and repeated ids, of any type, pass through. To ask more rules later, keep the texts and the index.
    """
    texts = kept_texts(docs, id_col, text_col)
    return scan(texts, trigram_index(texts), base, more)
