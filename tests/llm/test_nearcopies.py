"""Near copies by the Jaccard similarity of five-word shingles, against all pairs."""

import numpy as np
from conftest import SMALL
from test_operators import doc

import corpus_pipeline as pipeline
from ebbtide.llm import nearcopies, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, row long, size long, fp long, term string, score double"


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return 1.0 if x == y else len(x & y) / len(x | y)


def varied(rng, words, changes):
    """The words with some of them replaced, at most one in any five."""
    out = list(words)
    for at in rng.choice(len(words) // 6, changes, replace=False):
        out[at * 6 + 3] = f"new{rng.integers(1 << 40)}"
    return " ".join(out)


def all_pairs(texts):
    root = list(range(len(texts)))
    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return root


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = nearcopies.keyed(docs)
    found = nearcopies.near_copies(rows).collect()
    assert len(found) == len(texts)
    of = {r.row: r.doc_id for r in found}
    return [of[r.keep] for r in sorted(found, key=lambda r: r.doc_id)]


def test_pairs_around_the_threshold(spark):
    rng = np.random.default_rng(5)
    texts = []
    for k in range(40):
        words = [f"w{rng.integers(1 << 40)}" for _ in range(6 * (k % 10 + 4) * 3)]
        texts += [" ".join(words), varied(rng, words, max(1, len(words) * (k % 4 + 1) // 100))]
    got, want = kept(spark, texts), all_pairs(texts)
    assert got == want and 40 < len(set(want)) < 80


def test_a_large_family_in_one_bucket(spark):
    rng = np.random.default_rng(6)
    base, other = ([f"{c}{i}" for i in range(300)] for c in "ab")
    near = base[:260] + other[:30]  # similar to base, below the threshold
    texts = [varied(rng, base, 3) for _ in range(70)] + [varied(rng, near, 3) for _ in range(50)] + [varied(rng, base, 5) for _ in range(60)]
    assert kept(spark, texts) == all_pairs(texts)


def test_a_large_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK_BYTES", 40_000)  # some twenty sets
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(250)]
    texts = [varied(rng, base, k % 9) for k in range(160)]
    want = all_pairs(texts)
    assert kept(spark, texts) == want and 1 < len(set(want)) < 160


def test_spanning_links_join_what_all_pairs_join():
    rng = np.random.default_rng(4)
    for size in (1, 2, 9, 60):
        base = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(base, 50 - k, replace=False), rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in rng.integers(0, 12, size)]
        root = np.arange(size)
        for i in range(size):
            for j in range(i):
                both = np.intersect1d(sets[i], sets[j]).size
                if both >= 0.8 * (sets[i].size + sets[j].size - both):
                    root[root == root[i]] = root[j]
        mine = np.arange(size)
        for i, j in nearcopies.spanning_links(sets, 0.8):
            assert mine[i] != mine[j]  # no link too many
            mine[mine == mine[i]] = mine[j]
        assert len(set(zip(root, mine))) == len(set(root)) == len(set(mine))


def test_wordless_texts_are_one_group(spark):
    assert kept(spark, ["", " \t", "a b", "A  b", "a b c d e f"]) == [0, 0, 2, 2, 4]


def test_stage_drops_copies_that_differ_in_many_bits(spark):
    rng = np.random.default_rng(9)
    rows, far = [], 0
    for k in range(20):
        words = [f"w{rng.integers(1 << 40)}" for _ in range(300)]
        one, two = " ".join(words), varied(rng, words, 6)
        assert 0.8 <= jaccard(one, two) < 0.95
        far += (simhash.simhash(one, 4) ^ simhash.simhash(two, 4)).bit_count() > 4
        rows += [doc(2 * k, one), doc(2 * k + 1, two)]
    assert far >= 10
    left = pipeline.near_duplicates(spark, spark.createDataFrame(rows, COLUMNS), SMALL)
    assert sorted(r.doc_id for r in left.collect()) == list(range(0, 40, 2))
