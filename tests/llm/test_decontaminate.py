import random
import re
from collections import Counter

import pytest

from tempestry.llm import decontaminate
from tests.llm import corpus


def split(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]


def grams(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(docs, items):
    best = {}
    for d, t in docs:
        w = split(t)
        for i, x in items:
            v = split(x)
            if len(v) < 5:
                continue
            b = grams(v)
            at = {}
            for k in range(len(v) - 4):
                at.setdefault(tuple(v[k : k + 5]), []).append(k)
            aligned = {max(0, s - k) for s in range(len(w) - 4) for k in at.get(tuple(w[s : s + 5]), ())}
            full = {s for s in range(len(w) - len(v) + 1)}
            for s in aligned | full:
                a = grams(w[s : s + len(v)])
                if a:
                    j = sum((a & b).values()) / sum((a | b).values())
                    if j >= 0.75:
                        best[d, i] = max(best.get((d, i), 0), round(j, 6))
    return best


@pytest.fixture(scope="module")
def case():
    rng = random.Random(3)
    items = [(i, " ".join(corpus.words(rng, rng.randint(12, 60)))) for i in range(20)] + [(90, "too short"), (91, None), (92, " ".join(["same"] * 9 + corpus.words(rng, 9))), (3, "a b")]
    docs = [(0, None), (1, ""), (2, "too short"), (3, " ".join(corpus.words(rng, 300)))]
    for i, text in items[:20]:
        w = text.split()
        pre, post = corpus.words(rng, rng.randint(0, 40)), corpus.words(rng, rng.randint(0, 40))
        docs.append((100 + i, " ".join(pre) + "\n" + text.upper() + " " + " ".join(post)))
        v = list(w)
        v[rng.randrange(len(v))] = "changed"
        docs.append((200 + i, " ".join(pre + v + post)))
        docs.append((300 + i, " ".join(pre + w[: -len(w) // 8] + post)))
        docs.append((400 + i, " ".join(pre + w[: len(w) // 2] + post)))
        docs.append((500 + i, " ".join(pre + w[:-2])))
    docs.append((600, "x y " + items[22][1] + " z"))
    return docs, items


def test_equals_brute_force(spark, case):
    docs, items = case
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id int, length int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.report(decontaminate.leaks(d, b)).collect()}
    truth = brute(docs, items)
    assert truth and found == truth
    gone = {i for i, _ in truth}
    assert sorted(r.doc_id for r in decontaminate.clean(d, b).collect()) == sorted(i for i, _ in docs if i not in gone)


def test_odd_rows(spark, case):
    _, items = case
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(None, items[0][1]), (7, items[0][1]), (7, items[0][1])], "doc_id long, text string")
    assert sorted(map(str, (r.doc_id for r in decontaminate.report(decontaminate.leaks(d, b)).collect()))) == ["7", "None"]
    assert decontaminate.clean(d, b).count() == 0 and decontaminate.clean(d, b.limit(0)).count() == 3
    assert decontaminate.leaks(d.limit(0), b).count() == 0
