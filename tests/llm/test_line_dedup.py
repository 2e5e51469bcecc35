import hashlib
from collections import Counter

import duckdb
import pytest

from tempestry.llm import line_dedup

SPACE = " \t\n\x0b\f\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, least):
    docs = [(i, (t or "").split("\n")) for i, t in rows]
    seen = Counter(k for _, lines in docs for k in {key(x) for x in lines} if k)
    out = []
    for i, lines in docs:
        kept = [x for x in lines if not key(x) or seen[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


ROWS = [(i, f"own {i}\nShared line \n\n  \t\nÉtat\n{'rare' if i < 2 else 'x' + str(i)}\nshared LINE\n" + "\n".join(f"l{i}-{j}" if j != 70 else "deep" for j in range(i * 10))) for i in range(14)] + [(20, None), (21, ""), (22, "shared line"), (23, "\n\n"), (24, "étaT")]


@pytest.mark.parametrize("hot", [3, 10_000])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    docs = spark.createDataFrame([(i, t, "a", 5) for i, t in ROWS], "doc_id long, text string, key string, n_lines int").repartition(3)
    for least in (2, 3, 10):
        found = line_dedup.digest(line_dedup.deduplicated(docs, least))
        assert sorted(tuple(r) for r in found.collect()) == brute(ROWS, least)


def test_sql_is_the_same(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    documents = docs.toPandas()  # noqa: F841
    sql = duckdb.sql(line_dedup.oracle_sql(3)).fetchall()
    assert sorted(sql) == sorted(tuple(r) for r in line_dedup.digest(line_dedup.deduplicated(docs, 3)).collect())


def test_hashes_are_dealt_by_range_and_streamed(spark):
    lines = line_dedup.line_table(spark.createDataFrame(ROWS, "doc_id long, text string"))
    plan = line_dedup.hits_in_order(lines, 3, False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan


@pytest.mark.parametrize("hot", [2, 10_000])
def test_keep_first_and_odd_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    docs = spark.createDataFrame([(2, "b\na"), (1, "a\nc\na"), (None, "a"), (2, "b\na")], "doc_id long, text string")
    found = line_dedup.deduplicated(docs, 2, keep_first=True).select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in found), key=str) == sorted([(2, "b"), (2, "b"), (1, "c"), (None, "a")], key=str)
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0
