import numpy as np
import pytest
from pyspark.sql import functions as F

from tempestry.llm import ann


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    out = {}
    for i, v in queries:
        s = x @ np.array(v, dtype=np.float32).astype(float)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


@pytest.mark.parametrize(("scale", "growth"), [(0, 16), (1, 1)])
def test_recall(spark, monkeypatch, scale, growth):
    monkeypatch.setattr(ann, "GROWTH", growth)
    monkeypatch.setattr(ann, "SAMPLE", 300)
    monkeypatch.setattr(ann, "BLOCK", 700)
    monkeypatch.setattr(ann, "QUERIES", 40)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 24))
    x = centres[rng.integers(0, 30, 2000)] * 0.4 + rng.standard_normal((2000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= 1 + scale * rng.random((2000, 1))
    x[50:80] = x[20]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    queries = [r for r in rows if r[0] % 20 == 0]
    odd = [(2001, None), (2002, [0.0] * 24), (2003, [float("nan")] * 24), (2004, [None, *[1.0] * 23]), (2005, [float("inf")] * 24), (2020, []), (None, rows[3][1]), (2040, [1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(3)
    found = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    truth = brute(rows, queries, 20)
    assert found.keys() == truth.keys()
    hits = 0
    for q, got in found.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21))
        assert [(-g[2], g[1]) for g in got] == sorted((-g[2], g[1]) for g in got)
        exact = dict(truth[q])
        hits += len({g[1] for g in got} & exact.keys())
        assert all(abs(g[2] - exact[g[1]]) < 1e-9 for g in got if g[1] in exact)
    assert hits / (20 * len(truth)) >= 0.93


def test_few_and_none(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "vec_id long, embedding array<float>")
    rows = sorted(tuple(r) for r in ann.nearest(df, df.where("vec_id = 0")).collect())
    assert rows == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 1.0)]
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0


def test_repeated_ids_and_ties(spark):
    """Rows of the query's own vec_id take no place of others; equal vectors tie exactly, smaller ids first."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(0, (x[0] * 1.01).tolist()) for _ in range(10)] + [(0, x[0].tolist())] * 2
    rows += [(1000 + i, x[7].tolist()) for i in range(60)] + [(1003, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("query_id", F.lit(1)).withColumn("rank", F.lit("x"))
    found = {}
    for r in ann.nearest(df, df.where("vec_id in (0, 7)")).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(len(v) for v in found.values()) == [20, 20]
    assert 0 not in {v for _, v, _ in found[0]}
    assert [v for _, v, _ in sorted(found[7])] == [1000, 1001, 1002, 1003, 1003, *range(1004, 1019)]
    assert len({s for _, _, s in found[7]}) == 1


def test_hot_group_and_far_clusters(spark, monkeypatch):
    """A third of all rows are one vector; clusters far from a query are left out without a loss."""
    monkeypatch.setattr(ann, "BLOCK", 200)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((8, 32)) * 6
    x = centres[rng.integers(0, 8, 1600)] + 0.3 * rng.standard_normal((1600, 32))
    x[:530] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    truth = brute([(i, v) for i, v in rows], [r for r in rows if r[0] % 100 == 0], 20)
    hits = 0
    for r in ann.nearest(df, df.where("vec_id % 100 = 0")).collect():
        hits += r.score >= truth[r.query_id][-1][1] - 1e-3
    assert hits >= 0.93 * 20 * 16
