"""Proximity matches of benchmark windows, against every begin."""

import numpy as np

from ebbtide.llm import decontaminate


def found(spark, texts, passages, slop=2, share=0.8):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tests = decontaminate.test_windows(spark.createDataFrame([(str(i), p) for i, p in enumerate(passages)], "item_id string, text string"))
    index = decontaminate.positional_index(docs, tests.terms)
    ids = index.where("term = ''").select("row", "doc_id")
    rows = decontaminate.proximity_matches(index, tests, slop, share).join(ids, "row").join(tests.windows.select("win", "words"), "win")
    return {(r.doc_id, tuple(r.words), r.begin, r.met) for r in rows.collect()}


def brute(texts, passages, slop=2, share=0.8):
    out = set()
    for i, text in enumerate(texts):
        words = text.split()
        for passage in passages:
            terms = passage.split()
            for begin in range(-len(terms) - slop, len(words) + slop):
                met = sum(t in words[max(0, begin + at - slop) : max(0, begin + at + slop + 1)] for at, t in enumerate(terms))
                if met and met >= len(terms) * share:
                    out.add((i, tuple(terms), begin, met))
    return out


def test_rarest_words_replaced_and_first_words_missing(spark):
    passage = "a b c d e f g h i rare"
    texts = ["a b c d e f g h i other", "b c d e f g h i rare", "c d e f g h i rare", "x a b c d e y z f g h i", "a b c d e f g", "rare", "a b c d e f g h i " * 3]
    got = found(spark, texts, [passage, "a b c d e f g h i absent"])
    assert got == brute(texts, [passage, "a b c d e f g h i absent"])
    assert {0, 1, 2} <= {i for i, w, _, _ in got if w[-1] == "rare"}


def test_random_texts(spark):
    rng = np.random.default_rng(2)
    passages = [" ".join(f"t{k}" for k in rng.integers(0, 14, n)) for n in (10, 10, 7, 3, 1)]
    texts = [" ".join(f"t{k}" for k in rng.integers(0, 16, 30)) for _ in range(40)] + [p + " t1 t2" for p in passages]
    assert found(spark, texts, passages) == brute(texts, passages)
