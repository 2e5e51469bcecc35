import re
from itertools import combinations

import numpy as np
import pytest

from tempestry.llm import ngram_join
from tests.llm import corpus


def brute(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    own = list(range(len(texts)))

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            own[y] = x
    return {(i, len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("least", [3, 10**6])
def test_equals_brute_force(spark, monkeypatch, seed, least):
    monkeypatch.setattr(ngram_join, "LEAST_FREQUENT", least)
    monkeypatch.setattr(ngram_join, "PART", 7)
    texts = corpus.texts(seed)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, node string, shingle string").repartition(3)
    rows = ngram_join.grouped(docs).collect()
    assert {tuple(r) for r in rows} == brute(texts) and len(rows) == len(texts)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g"), (5, "a b c d e f g"), (5, "a b c d e f g"), (7, "A b  c d e F g\n"), (8, None), (None, None)], "doc_id long, text string")
    found = sorted((tuple(r) for r in ngram_join.grouped(docs).collect()), key=str)
    assert found == sorted([(None, 3, 5), (5, 3, 5), (5, 3, 5), (7, 3, 5), (8, 0, 8), (None, 0, None)], key=str)
    kept = ngram_join.one_of_each(docs, ngram_join.grouped(docs)).collect()
    assert sorted((tuple(r) for r in kept), key=str) == sorted([(None, "a b c d e f g"), (5, "a b c d e f g"), (5, "a b c d e f g"), (8, None), (None, None)], key=str)
    assert ngram_join.grouped(docs.limit(0)).count() == 0


def test_shingles_are_words_not_bytes():
    s = ngram_join.Shingler()
    assert (s("a b c d e f") == s(" A\tb \n c d e F ")).all()
    assert len(np.intersect1d(s("ab c d e f"), s("a bc d e f"))) == 0
    assert len(s("same same same same same same same")) == 1
    assert len(s("x y")) == 1 and len(s("")) == 0 and (s("x y") != s("x z")).all()
