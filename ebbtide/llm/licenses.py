"""License scans: Aho-Corasick finds notice phrases and identifier tags; a shunting-yard parser evaluates tagged expressions.

A text's words are lower-cased and joined by single blanks, and one automaton of all phrases, blanks at their ends included,
runs over that line, so a match stands on whole words. Where a phrase is an identifier tag, what follows it on its line
is read as a licence expression: ``with`` binds more than ``and``, ``and`` more than ``or``; parentheses group.
The expression's value is the set of its licences and the least obligation with which it can be met: an ``or`` leaves
the choice, so the smaller counts; under an ``and`` both hold, so the greater does; an exception takes one step off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import bounded

#: The base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: What the method adds, words of notices as their licences print them.
MORE_PHRASES = {
    "affero general public license": "agpl", "all rights reserved": "all-rights-reserved", "apache software license": "apache", "artistic license": "artistic", "boost software license": "boost",
    "bsd license": "bsd", "cc by": "cc-by", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by sa": "cc-by-sa", "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution sharealike": "cc-by-sa", "eclipse public license": "epl", "isc license": "isc",
    "lesser general public license": "lgpl", "mozilla public license": "mpl", "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd", "this is free and unencumbered software released into the public domain": "unlicense", "zlib license": "zlib",
}
TAGS = ("spdx license identifier", "license expression")
#: Identifiers by how they begin, with their label and obligation: 0 notice only, 1 changed files, 2 whole works, 3 closed or unknown.
FAMILIES = {
    "0bsd": ("bsd", 0), "agpl": ("agpl", 2), "apache": ("apache", 0), "artistic": ("artistic", 0), "bsd": ("bsd", 0), "bsl": ("boost", 0), "cc0": ("cc0", 0), "cc-by": ("cc-by", 0), "cc-by-nc": ("cc-by-nc", 3),
    "cc-by-nd": ("cc-by-nd", 3), "cc-by-sa": ("cc-by-sa", 2), "cddl": ("cddl", 1), "epl": ("epl", 1), "eupl": ("eupl", 2), "gpl": ("gpl", 2), "isc": ("isc", 0), "lgpl": ("lgpl", 1), "mit": ("mit", 0),
    "mpl": ("mpl", 1), "unlicense": ("unlicense", 0), "zlib": ("zlib", 0),
}
UNKNOWN_OBLIGATION = 3
BINDS = {"or": 1, "and": 2, "with": 3}
#: Digits and letters stay, A-Z lowered; all bytes beyond ASCII are parts of words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LEAD = re.compile(rb"[\x20\t:=\"'`>]*")
TOKEN = re.compile(rb"[\x20\t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:_-]*)")


@dataclass(frozen=True)
class Expression:
    """A licence expression: its tokens in postfix order, its labels, and the least obligation that meets it."""

    postfix: tuple[str, ...]
    labels: tuple[str, ...]
    obligation: int


def family(identifier: str) -> tuple[str, int]:
    """Label and obligation of a lower-case identifier: those of the longest beginning that is known, else itself and the greatest."""
    parts = re.split(r"[-+]", identifier)
    for n in range(len(parts), 0, -1):
        if (found := FAMILIES.get("-".join(parts[:n]))) is not None:
            return found
    return identifier.rstrip("+"), UNKNOWN_OBLIGATION


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard over lower-case tokens. None if they are no whole expression."""
    out: list[str] = []
    held: list[str] = []
    operand = True  # what may come next
    for t in tokens:
        if t == "(" and operand:
            held.append(t)
        elif t == ")" and not operand:
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif t in BINDS and not operand:
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[t]:
                out.append(held.pop())
            held.append(t)
            operand = True
        elif t not in BINDS and t not in "()" and operand:
            out.append(t)
            operand = False
        else:
            return None
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(order: list[str]) -> Expression | None:
    """The value of a postfix expression. None if ``with`` stands between other things than a licence and an exception."""
    stack: list[tuple[frozenset[str], int, bool]] = []  # labels, obligation, whether one identifier
    for t in order:
        if t not in BINDS:
            label, obligation = family(t)
            stack.append((frozenset([label]), obligation, True))
            continue
        right, left = stack.pop(), stack.pop()
        if t == "with":
            if not (left[2] and right[2]):
                return None
            stack.append((left[0], max(0, left[1] - 1), False))
        else:
            stack.append((left[0] | right[0], (max if t == "and" else min)(left[1], right[1]), False))
    labels, obligation, _ = stack.pop()
    return Expression(tuple(order), tuple(sorted(labels)), obligation)


def expression_at(raw: bytes, at: int) -> Expression | None:
    """The longest whole expression that begins after byte ``at`` on its line, if there is one.

    Identifiers and operators count in either case; the first thing that is neither ends it. An operator at its end falls away."""
    at = LEAD.match(raw, at).end()
    tokens: list[str] = []
    opened = 0
    operand = True
    while found := TOKEN.match(raw, at):
        t = found[1].decode().lower().rstrip(".:_-")
        if t == "(":
            if not operand:
                break
            opened += 1
        elif t == ")":
            if operand or not opened:
                break
            opened -= 1
        elif (t in BINDS) == operand:
            break
        else:
            operand = t in BINDS
        tokens.append(t)
        at = found.end()
    while tokens and tokens[-1] in BINDS:
        tokens.pop()
    order = postfix(tokens)
    return evaluate(order) if order else None


def automaton(phrases: dict[str, list[tuple[bool, str]]]) -> ahocorasick.Automaton:
    """phrase -> what it stands for. Blanks at both ends keep matches to whole words."""
    made = ahocorasick.Automaton()
    for phrase, means in phrases.items():
        made.add_word(f" {phrase} ", (len(phrase), len(phrase.split()), means))
    made.make_automaton()
    return made


def scan(text: str | None, finder: ahocorasick.Automaton) -> tuple[int, list[tuple[bool, str, int]], list[tuple[int, Expression | None]]]:
    """(number of words, [(base, label, word)], [(word, expression)]) of a whole text; words from 0, None for what is no expression."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(FOLD).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    met = list(finder.iter(line))
    blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), dtype=np.uint8) == 32) if met else None
    places, tagged = [], []
    for end, (length, n, means) in met:
        word = int(np.searchsorted(blanks, end - length - 1))
        for base, label in means:
            if label:
                places.append((base, label, word))
            else:
                tagged.append((word, word + n - 1))
    read = []
    if tagged:
        ends = {}
        last = {b for _, b in tagged}
        for k, m in enumerate(WORD.finditer(raw)):
            if k in last:
                ends[k] = m.end()
        read = [(a, expression_at(raw, ends[b])) for a, b in tagged]
    return len(words), sorted(places, key=lambda p: (p[2], not p[0], p[1])), sorted(read, key=lambda r: r[0])


PLACE = T.StructType([T.StructField("base", T.BooleanType()), T.StructField("label", T.StringType()), T.StructField("word", T.LongType())])
READ = T.StructType(
    [T.StructField("word", T.LongType()), T.StructField("postfix", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("obligation", T.IntegerType())]
)


def license_places(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE_PHRASES, more: dict[str, str] = MORE_PHRASES, tags: tuple[str, ...] = TAGS
) -> DataFrame:
    """(doc_id, n_words, places, expressions): one row per input row.

    places: (base, label, word) of every phrase, by word; phrases may overlap. expressions: (word, postfix, labels, obligation)
    of every tag, by word; of one that no whole expression follows the last three are null. Phrases are words in
    lower case with single blanks. Null text is empty; null and repeated ids, of any type, pass through.
    """
    phrases: dict[str, list[tuple[bool, str]]] = {}
    for known, own in ((base, True), (more, False)):
        for phrase, label in known.items():
            phrases.setdefault(phrase, []).append((own, label))
    for tag in tags:
        phrases.setdefault(tag, []).append((False, ""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = automaton(phrases)
        place_type = pa.list_(pa.struct([("base", pa.bool_()), ("label", pa.string()), ("word", pa.int64())]))
        strings = pa.list_(pa.string())
        read_type = pa.list_(pa.struct([("word", pa.int64()), ("postfix", strings), ("labels", strings), ("obligation", pa.int32())]))
        for batch in batches:
            sizes, places, reads = [], [], []
            for text in batch.column(1):
                n, found, read = scan(text.as_py(), finder)
                sizes.append(n)
                places.append([{"base": b, "label": x, "word": w} for b, x, w in found])
                reads.append([{"word": w, "postfix": e and list(e.postfix), "labels": e and list(e.labels), "obligation": None if e is None else e.obligation} for w, e in read])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(places, place_type), pa.array(reads, read_type)], ["doc_id", "n_words", "places", "expressions"])

    kind = rows.select("doc_id").schema.add("n_words", T.LongType()).add("places", T.ArrayType(PLACE)).add("expressions", T.ArrayType(READ))
    return bounded(rows).mapInArrow(of, kind)


def license_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **phrases) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, obligation): one row per input row.

    Labels are distinct, sorted and comma-joined; empty without any. The score is the chance that the text states a licence: each
    phrase leaves half of the doubt, each whole tagged expression a tenth. ``obligation`` is the greatest that any
    expression asks for, null without one. Null and empty texts have no words, no labels and score 0.
    """
    own = F.filter("places", lambda p: p["base"])
    label = lambda places: F.transform(places, lambda p: p["label"])
    whole = F.filter("expressions", lambda e: e["labels"].isNotNull())
    tagged = F.flatten(F.transform(whole, lambda e: e["labels"]))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    word = F.transform(own, lambda p: p["word"])
    return license_places(docs, id_col, text_col, **phrases).select(
        "doc_id",
        "n_words",
        F.size(own).cast("long").alias("n_base"),
        F.array_min(word).alias("first_word"),
        F.array_max(word).alias("last_word"),
        joined(label(own)).alias("base_labels"),
        joined(F.concat(label(F.col("places")), tagged)).alias("labels"),
        (1 - F.pow(F.lit(0.5), F.size("places")) * F.pow(F.lit(0.1), F.size(whole))).alias("score"),
        F.array_max(F.transform(whole, lambda e: e["obligation"])).alias("obligation"),
    )
