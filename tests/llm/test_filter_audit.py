"""Filter audit against the rules applied document by document, and against its SQL."""

import random
import re
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from tempestry.llm import filter_audit

SPACE = " \t\n\x0b\f\r"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    smallest = {}
    for d, t, _ in docs:
        if d is not None:
            smallest[t or ""] = min(smallest.get(t or "", d), d)
    rows = []
    for d, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = set()
        failed |= {"A"} if len(words) < 50 else set()
        failed |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        failed |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else set()
        failed |= {"D"} if set(t) & set("#$%&*|") else set()
        failed |= {"E"} if d is not None and smallest[t] < d else set()
        rows.append((s or "", failed, d in good, d in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine, shapley, lines = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), []
        for p in permutations("ABCDE"):
            left = mine
            for k, x in enumerate(p):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                shapley[x] += len(gone)
                failing = sum(x in r[1] for r in mine)
                lines.append((part, "".join(p), k + 1, len(left), len(gone), failing - len(gone), sum(r[1] == {x} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), x))
        out += [(*line[:-1], shapley[line[-1]]) for line in lines]
    return sorted(out)


def corpus():
    rng = random.Random(4)
    docs = []
    for i in range(150):
        n = rng.choice([0, 3, 49, 50, 51, 80])
        vocabulary = [f"w{k}" for k in range(rng.choice([n * 65 // 100 or 1, n or 1, 10]))]
        words = [vocabulary[k % len(vocabulary)] for k in range(n)]
        if rng.random() < 0.3:
            words = [w.upper() for w in words]
        text = rng.choice([" ", "\n", " \t"]).join(words) + rng.choice(["", "", "#", " | ", "É"])
        docs.append((rng.randrange(120) if rng.random() < 0.9 else None, rng.choice([text, text, None, ""]), rng.choice(["a", "b", None, ""])))
    docs += rng.choices(docs, k=60) + [(500 + i, docs[0][1], "c") for i in range(40)] + [(600, "x " * 100_000, "long")]
    docs += [(700, "A" + "b" * 19, "edge"), (701, "A" + "b" * 18, "edge")]
    labels = [(rng.choice([*range(120), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)]
    return docs, labels


def frames(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("part", "mask", "n", "digest", "words", "good", "step")})
    return d.repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(2)


def test_equals_brute_force_with_nulls_ties_and_repeats(spark):
    docs, labels = corpus()
    found = filter_audit.audited(*frames(spark, docs, labels))
    assert found.columns == COLUMNS
    assert sorted(tuple(r) for r in found.collect()) == brute(docs, labels)


def test_sql_is_the_same(spark):
    docs, labels = corpus()
    firsts = list({d[0]: d for d in docs if d[0] is not None}.values())
    d, l = frames(spark, firsts, labels)
    con = duckdb.connect()
    con.register("documents", d.select("doc_id", "text", "source").toPandas())
    con.register("labels", l.toPandas())
    cur = con.execute(filter_audit.oracle_sql())
    assert [c[0] for c in cur.description] == COLUMNS
    assert sorted(cur.fetchall()) == sorted(tuple(r) for r in filter_audit.audited(d, l).collect())


@pytest.mark.parametrize("n", [1, 2, 3])
def test_transform_of_any_filters(spark, n):
    """Every set's survivors are the masks outside it, for other numbers of filters too."""
    counts = [("p", m, m + 1, m % 3, 1) for m in range(1 << n) if m != 2]
    found = filter_audit.survivors(spark.createDataFrame(counts, "part string, mask int, n long, good long, toxic long"), n).first()
    for s in range(1 << n):
        assert found["n"][s] == sum(c[2] for c in counts if not c[1] & s)
        assert found["good"][s] == sum(c[3] for c in counts if not c[1] & s)


def test_empty_tables(spark):
    docs, labels = frames(spark, corpus()[0], [])
    assert filter_audit.audited(docs.limit(0), labels).count() == 0
    assert sum(r.good_lost + r.toxic_lost for r in filter_audit.audited(docs, labels).collect()) == 0
