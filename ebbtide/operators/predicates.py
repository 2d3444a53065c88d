"""Predicates on hosts and multi-valued tags. A missing key is an empty list, so every leaf is true or false, never null."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def like_pattern(text: str) -> str:
    r"""``*`` matches anything; the characters that LIKE treats specially stand for themselves."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")


def filter_all() -> Column:
    return F.lit(True)


def tag_values(key: str, tags: str = "tags") -> Column:
    return F.col(tags)[key]


def filter_tag_eq(key: str, value: str, values: Column | None = None) -> Column:
    return sure(F.array_contains(tag_values(key) if values is None else values, value))


def filter_tag_wildcard(key: str, text: str, values: Column | None = None) -> Column:
    pattern = like_pattern(text)
    return sure(F.exists(tag_values(key) if values is None else values, lambda x: x.like(pattern)))


def filter_lifted(column: str, text: str) -> Column:
    """The same on a column that holds one key's values."""
    return filter_tag_wildcard("", text, F.col(column)) if "*" in text else filter_tag_eq("", text, F.col(column))


def filter_host_eq(host: str) -> Column:
    return sure(F.col("host") == host)


def filter_host_wildcard(text: str) -> Column:
    return sure(F.col("host").like(like_pattern(text)))


def filter_bare_tag(key: str, tags: str = "tags") -> Column:
    """A tag without a key: the key exists, or with ``*`` any key matches."""
    if "*" not in key:
        return sure(F.map_contains_key(F.col(tags), key))
    pattern = like_pattern(key)
    return sure(F.exists(F.map_keys(F.col(tags)), lambda x: x.like(pattern)))


def filter_in(key: str, values: Iterable[str]) -> Column:
    values = list(values)
    if any("*" in v for v in values):
        return filter_or(*[filter_tag_wildcard(key, v) if "*" in v else filter_tag_eq(key, v) for v in values])
    return sure(F.arrays_overlap(tag_values(key), F.array(*map(F.lit, values)).cast("array<string>")))


def filter_not(condition: Column) -> Column:
    return ~sure(condition)


def filter_and(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def filter_or(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def filter_repeated_params(params: Iterable[str]) -> Column:
    """``key:value`` texts: one key's values are alternatives, keys must all hold; only the first colon splits."""
    by_key: dict[str, list[str]] = {}
    for text in params:
        key, _, value = text.partition(":")
        by_key.setdefault(key, []).append(value)
    return filter_and(*[filter_or(*[filter_tag_eq(k, v) if v else filter_bare_tag(k) for v in vs]) for k, vs in by_key.items()])


def filter_hosts_and_tags(hosts: Iterable[str], tags: Column) -> Column:
    hosts = list(hosts)
    return (sure(F.col("host").isin(hosts)) if hosts else F.lit(True)) & tags


def filter_text(column: str, phrase: str) -> Column:
    """Every token of the phrase is a token of the text, and the phrase stands in it; case counts."""
    split = "[^0-9a-zA-Z]+"
    import re

    tokens = [t for t in re.split(split, phrase) if t]
    words = F.split(F.col(column), split)
    return filter_and(sure(F.contains(F.col(column), F.lit(phrase))), *[sure(F.array_contains(words, t)) for t in tokens])


def filter_search_ci(column: str, text: str) -> Column:
    return sure(F.contains(F.lower(F.col(column)), F.lit(text.lower())))
