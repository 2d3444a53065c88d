"""Hard negatives, vector codes and licence scans against brute force and on awkward tables."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from test_operators import AWKWARD, SCHEMA

from ebbtide.llm import codes, licenses, negatives
from ebbtide.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int, row long, key string, shelf long, code string, of int"


def vec(i, v, label):
    return (i, v, label, 1, "k", 2, "c", 3)


def awkward_vectors(seed, n=260, dims=6):
    """Clusters, copies, ties, nulls of every kind, short vectors, repeated ids."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = (rng.normal(0, 0.2, dims) + np.eye(dims)[i % 3]).astype(np.float32).tolist()
        rows.append(vec(i * 4, v, int(rng.integers(0, 3)) + 10 * (i % 50 == 0)))
    rows += [vec(2000 + i, [0.5] * dims, i % 2) for i in range(40)]  # one vector many times
    rows += [vec(0, [0.5] * dims, 1), vec(100, [0.25] * dims, 0), vec(100, [0.25] * dims, 0), vec(300, [0.5, 0.5], 1), vec(None, [0.5] * dims, 0), vec(None, [0.6] * dims, 1), vec(500, [], 1)]
    bad = [vec(700, None, 1), vec(700, [0.1, None, 0.2], 1), vec(800, [NAN] * dims, 1), vec(900, [INF] * dims, 1), vec(900, [-INF, 0.1], 1)]
    return rows + bad, bad + [vec(1100, [0.5] * dims, None)]


def whole(rows, scale, dims):
    for r in rows:
        if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]):
            yield r[0], r[2], [math.floor(scale * x) for x in r[1]] + [0] * (dims - len(r[1]))


def brute_negatives(rows, dims):
    kept = [(i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, v) for i, label, v in whole(rows, 256, dims) if label is not None]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a, (i, label, v) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, other) for b, (j, other, w) in enumerate(kept) if b != a]
        for ps, j, _ in sorted((s for s in scored if s[2] == label), key=order)[:5]:
            fit = sorted((s for s in scored if s[2] != label and 30 * ps <= 100 * s[0] <= 90 * ps), key=order)[:10]
            out += [(i, j, k + 1, s[1], ps, s[0]) for k, s in enumerate(fit)]
    return out


def known(rows):
    return sorted(tuple(-1 if x is None else x for x in r) for r in rows)


@pytest.mark.parametrize("shelf", [16384, 70])
def test_negatives_against_brute_force(spark, shelf):
    rows, odd = awkward_vectors(3)
    got = negatives.hard_negatives(spark.createDataFrame(rows + odd, VECTORS), shelf=shelf, block=16).collect()
    want = brute_negatives(rows + odd, 6)
    assert known(got) == known(want) and len(want) > 300


def test_negatives_of_nothing(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([vec(100, None, 1), vec(0, [], 1), vec(200, [0.5], None)], VECTORS)).collect() == []
    with pytest.raises(ValueError, match="64 bits"):
        negatives.hard_negatives(spark.createDataFrame([vec(0, [1e30], 1)], VECTORS))


def test_bounds_hold_and_clusters_leave_blocks_unread():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 60, (12, 16))
    points = np.floor(np.repeat(centres, 256, axis=0) + rng.normal(0, 4, (12 * 256, 16)))
    order = np.argsort(negatives.Curve.fit(points).keys(points), kind="stable")
    blocks = points[order].reshape(-1, 256, 16)
    anchors = points[::100]
    low, high = negatives.score_ranges(anchors, blocks.min(axis=1), blocks.max(axis=1))
    scores = np.einsum("ad,bnd->abn", anchors, blocks)
    assert (low[:, :, None] <= scores).all() and (scores <= high[:, :, None]).all()
    fifth = np.sort(scores.reshape(len(anchors), -1), axis=1)[:, -5]
    every = np.arange(len(anchors))
    asked = negatives.asked_blocks(low, high, every, fifth, np.full(len(anchors), 1 << 40), np.ones((len(anchors), 12), dtype=bool))
    assert asked.any(axis=1).all() and asked.mean() < 0.3


def test_hilbert_keys_walk_through_neighbours():
    side = np.arange(8)
    points = np.stack(np.meshgrid(side, side, side, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = negatives.hilbert_keys(points, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def brute_codes(rows, dims, parts=4, entries=256, rounds=4):
    kept = list(whole(rows, 1024, dims))
    width = -(-dims // parts)
    x = np.array([v + [0] * (parts * width - dims) for _, _, v in kept]).reshape(len(kept), parts, width)
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][2][: len(kept[k][2])]))[:entries]
    books = x[first].transpose(1, 0, 2).copy()
    nearest = lambda p: ((x[:, p, None, :] - books[p][None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        new = books.copy()
        for p in range(parts):
            own = nearest(p).argmin(axis=1)
            for e in set(own.tolist()):
                new[p, e] = x[own == e, p].sum(axis=0) // (own == e).sum()
        books = new
    own = np.stack([nearest(p).argmin(axis=1) for p in range(parts)], axis=1)
    error = sum(nearest(p).min(axis=1) for p in range(parts))
    by_label = defaultdict(int)
    for (_, label, _), e in zip(kept, error.tolist()):
        by_label[label] += e
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return [(i, "".join(f"{c:02x}" for c in own[k]), int(error[k]), by_label[label], digest) for k, (i, label, _) in enumerate(kept)]


@pytest.mark.parametrize("tree_rows,entries", [(2048, 256), (37, 256), (64, 20)])
def test_codes_against_brute_force(spark, tree_rows, entries):
    rows, odd = awkward_vectors(4)
    rows = [r for r in rows if r[0] is not None and r[1] is not None and len(r[1]) == 6] + odd
    got = codes.vector_codes(spark.createDataFrame(rows, VECTORS), tree_rows=tree_rows, entries=entries).collect()
    assert known(got) == known(brute_codes(rows, 6, entries=entries))


def test_codes_of_short_and_strange_vectors(spark):
    rows = [vec(3, [0.5, 0.25, -0.5, 1.0, 2.0], None), vec(None, [0.5], 2), vec(1, [], None), vec(3, [0.5, 0.25, -0.5, 1.0, 2.0], 2), vec(9, None, 2), vec(9, [NAN], None)]
    got = codes.vector_codes(spark.createDataFrame(rows, VECTORS)).collect()
    assert known(got) == known(brute_codes(rows, 5)) and len(got) == 4
    assert codes.vector_codes(spark.createDataFrame([], VECTORS)).collect() == []
    assert [r.code for r in codes.vector_codes(spark.createDataFrame([vec(1, [], 1)], VECTORS)).collect()] == ["00000000"]
    named = spark.createDataFrame([("b", [0.5, 1.0]), ("a", [0.5, 2.0])], "vec_id string, embedding array<double>").selectExpr("vec_id", "embedding", "vec_id label")
    assert sorted((r.vec_id, r.code, r.error) for r in codes.vector_codes(named).collect()) == [("a", "00000000", 0), ("b", "00010000", 0)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-3, 3)] * 3), min_size=1, max_size=60), st.integers(1, 9))
def test_trees_assign_as_all_comparisons_do(points, entries):
    x = np.array(points, dtype=np.int64)
    tree = codes.cover_tree(x, leaf=2)
    assert sorted(tree.order.tolist()) == list(range(len(x)))
    for k in range(len(tree.start)):
        own = x[tree.order[tree.start[k] : tree.end[k]]]
        assert np.sqrt(((own - x[tree.centre[k]]) ** 2).sum(axis=1)).max() <= tree.radius[k] + 1e-9
    book = x[:entries] * 2 - 1
    owner, settled = codes.assign(tree, x, book)
    assert owner.tolist() == codes.squared(x[tree.order], book).argmin(axis=1).tolist() and 0 <= settled <= len(x)
    n, s = codes.totals(owner, np.concatenate([np.zeros((1, 3), dtype=np.int64), np.cumsum(x[tree.order], axis=0)]), len(book))
    assert n.sum() == len(x) and (s == np.stack([x[tree.order][owner == e].sum(axis=0) for e in range(len(book))])).all()


def test_far_clusters_go_by_subtrees():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-5, 5, (300, 4)) + 1000 * k for k in range(4)])
    _, settled = codes.assign(codes.cover_tree(x), x, np.array([[1000 * k] * 4 for k in range(4)]))
    assert settled == len(x)


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute_license(text):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = lambda phrase: [i for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    base = {label: at(phrase) for phrase, label in licenses.BASE_PHRASES.items()}
    more = {phrase: at(phrase) for phrase in licenses.MORE_PHRASES}
    labels = {k for k, v in base.items() if v} | {licenses.MORE_PHRASES[k] for k, v in more.items() if v}
    places = sum(base.values(), [])
    n = len(places) + sum(map(len, more.values()))
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(k for k, v in base.items() if v)), ",".join(sorted(labels)), 1 - 0.5**n


def test_licenses_of_all_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:8] for r in QUERIES["op13_licenses"](spark, SMALL).collect()}
    assert got == {i: brute_license(t) for i, t in texts.items()} and any(r[1] for r in got.values())


def test_licenses_of_awkward_texts(spark):
    rows = list(AWKWARD)
    texts = [
        "MIT License", "mit licenses", "the Mit-LICENSE!mit\tlicense", "İmit license", "GNU Affero General Public License general public license", "MİT license", "mit \x1f license. apache license " * 2000, "cc by-nc 4.0", "\x7fapache\x00license\x85 mit license",
    ]
    rows += [(100 + k, t, *AWKWARD[0][2:]) for k, t in enumerate(texts)]
    got = licenses.license_rows(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted((tuple(r)[:8] for r in got), key=key) == sorted(((r[0], *brute_license(r[1])) for r in rows), key=key)
    assert licenses.license_rows(spark.createDataFrame([], SCHEMA)).collect() == []


EXPRESSIONS = {
    "MIT": ("mit", 0), "MIT OR GPL-2.0-only": ("gpl,mit", 0), "mit and gpl-2.0+": ("gpl,mit", 2), "(MIT OR Apache-2.0) AND LGPL-2.1": ("apache,lgpl,mit", 1), "MIT OR Apache-2.0 AND GPL-3.0": ("apache,gpl,mit", 0),
    "GPL-2.0 WITH Classpath-exception-2.0": ("gpl", 1), "GPL-2.0 WITH Classpath-exception-2.0 AND AGPL-3.0": ("agpl,gpl", 2), "Unheard-1.0": ("unheard-1.0", 3), "MIT. This file": ("mit", 0), "MIT or": ("mit", 0), "MIT */": ("mit", 0),
    "\"(MIT)\" more": ("mit", 0), "((MIT": None, "AND MIT": None, "": None, "(MIT) WITH x": ("mit", 0), "(MIT OR ISC) WITH x": None, "MIT\n OR GPL-2.0": ("mit", 0), "LicenseRef-Own": ("licenseref-own", 3),
}


def test_expressions(spark):
    rows = [(k, f"// SPDX-License-Identifier: {e}", *AWKWARD[0][2:]) for k, e in enumerate(EXPRESSIONS)]
    got = {r.doc_id: r for r in licenses.license_rows(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, want in enumerate(EXPRESSIONS.values()):
        assert (got[k].labels, got[k].obligation) == (want or ("", None)) and got[k].score == (pytest.approx(0.9) if want else 0)
    places = licenses.license_places(spark.createDataFrame(rows[1:2], SCHEMA)).first()
    assert places.expressions[0].postfix == ["mit", "gpl-2.0-only", "or"] and places.expressions[0].word == 0 and places.places == []


def formulas():
    one = st.sampled_from(["mit", "gpl-2.0", "isc", "lgpl-3.0", "mpl-2.0"])
    return st.recursive(one, lambda f: st.tuples(st.sampled_from(["and", "or"]), f, f), max_leaves=8)


@settings(max_examples=80, deadline=None)
@given(formulas())
def test_shunting_yard_keeps_the_tree(tree):
    def written(t):
        return t if isinstance(t, str) else f"({written(t[1])} {t[0].upper()} {written(t[2])})"

    def value(t):
        return licenses.family(t)[1] if isinstance(t, str) else (max if t[0] == "and" else min)(value(t[1]), value(t[2]))

    assert licenses.expression_at(written(tree).encode(), 0).obligation == value(tree)


def test_one_batch_of_many_rows_keeps_its_order():
    finder = licenses.automaton({"mit license": [(True, "mit")]})
    assert licenses.scan("a mit license mit license", finder) == (5, [(True, "mit", 1), (True, "mit", 3)], [])
