"""Bounded fits from moments: against all ways to bind the unknowns, and moments that merge."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempestry.operators import fits

LEVERS = {"a": (-1.0, 3.0), "b": (-1.0, 1.0), "c": (-20.0, 20.0)}


def by_walls(a, b, low, high):
    """The best of all 3^n ways to put each unknown at a bound or leave it free."""
    best, at = np.inf, None
    for ways in product((0, 1, 2), repeat=len(b)):
        free = [j for j, w in enumerate(ways) if w == 0]
        g = np.array([0 if w == 0 else low[j] if w == 1 else high[j] for j, w in enumerate(ways)], float)
        bound = [j for j in range(len(b)) if j not in free]
        if free:
            g[free] = np.linalg.lstsq(a[np.ix_(free, free)], b[free] - a[np.ix_(free, bound)] @ g[bound], rcond=None)[0]
        if (g >= low - 1e-9).all() and (g <= high + 1e-9).all() and (cost := g @ a @ g - 2 * b @ g) < best:
            best, at = cost, g
    return best, at


@pytest.mark.parametrize("n", [1, 2, 4, 6])
def test_solver_against_all_walls(n):
    rng = np.random.default_rng(n)
    for trial in range(60):
        k = rng.normal(size=(30, n))
        if trial % 5 == 0 and n > 1:
            k[:, 1] = k[:, 0]  # singular
        a, b = k.T @ k, k.T @ (k @ rng.normal(scale=3, size=n) + rng.normal(size=30))
        low, high = -rng.uniform(0, 2, n), rng.uniform(0, 2, n)
        if trial % 7 == 0:
            low[0] = high[0] = 0.5
        g = fits.box_least_squares(a, b, low, high)
        assert (g >= low).all() and (g <= high).all()
        assert g @ a @ g - 2 * b @ g == pytest.approx(by_walls(a, b, low, high)[0], rel=1e-7, abs=1e-7)
    assert fits.box_least_squares(np.zeros((0, 0)), np.zeros(0), np.zeros(0), np.zeros(0)).size == 0


def pixels(spark, seed=3, n=4000):
    rng = np.random.default_rng(seed)
    k = rng.normal(size=(n, 2))
    zone = rng.choice(["core", "bands"], n, p=[0.1, 0.9])
    r = 5 * k[:, 0] + 0.5 * k[:, 1] - 2 + rng.normal(size=n)
    rows = [(i % 12, i % 4, str(z), float(x), float(y), None if i % 97 == 0 else float(w)) for i, (z, (x, y), w) in enumerate(zip(zone, k, r, strict=True))]
    return spark.createDataFrame(rows, "example_id int, storm_id int, zone string, ka double, kb double, r double").repartition(4)


def stats(df):
    return fits.moments(df, ["example_id", "storm_id", "zone"], F.col("r"), [F.col("ka"), F.col("kb"), F.lit(1.0)]).withColumn("channel", F.lit("x"))


def solved(spark, rows, **options):
    zones = fits.summed(rows, ["channel", "zone"], 3)
    found = fits.fitted(zones, ["channel"], LEVERS, ["core", "bands"], **{"least_pixels": 10, "least_storms": 2} | options)
    return zones, found


def test_fit_guard_and_errors(spark):
    df = pixels(spark)
    zones, found = solved(spark, stats(df))
    (row,) = found.collect()
    p = df.toPandas().dropna()
    w = p.groupby("zone").r.transform("count").to_numpy() ** -1.0
    k = np.column_stack([p.ka, p.kb, np.ones(len(p))])
    g = by_walls(k.T @ (k * w[:, None]), k.T @ (w * p.r), *np.array(list(LEVERS.values())).T)[1]
    assert np.allclose(row.gains, g) and row.at_bound == [True, False, False] and row.gains[0] == 3.0
    for e in fits.errors(zones, found, ["channel"]).collect():
        q = p[p.zone == e.zone]
        left = q.r - np.column_stack([q.ka, q.kb, np.ones(len(q))]) @ g
        assert (e.n, e.before, e.after) == (len(q), pytest.approx(np.sqrt((q.r**2).mean())), pytest.approx(np.sqrt((left**2).mean())))
    assert solved(spark, stats(df), least_storms=5)[1].first().gains == [None, None, None]
    affected = sum(abs(p.kb) > fits.AFFECTED_K)
    assert solved(spark, stats(df), least_pixels=int(affected) + 1)[1].first().gains[1] is None


def test_merged_halves_equal_the_whole_and_versions_stay(spark, tmp_path):
    df, path = pixels(spark), str(tmp_path / "sweep")
    keys = ["example_id", "storm_id", "zone", "channel"]
    order = lambda rows: {(r.example_id, r.zone): (r.n, *np.round([r.r2, *r.b, *r.a, *r.affected], 6)) for r in rows.collect()}
    assert fits.store(stats(df.where("example_id < 5")), path) == 1
    assert fits.store(stats(df.where("example_id >= 5")), path) == 2
    whole = order(stats(df))
    assert order(fits.stored(spark, path, keys)) == whole
    assert fits.store(stats(df.where("example_id = 7").withColumn("r", F.col("r") + 1)), path) == 3  # measured again
    after = order(fits.stored(spark, path, keys))
    assert {k for k in whole if after[k] != whole[k]} == {k for k in whole if k[0] == 7} and after.keys() == whole.keys()
    assert order(fits.stored(spark, path, keys, as_of=2)) == whole
    (tmp_path / "sweep" / "version=4").mkdir()  # a job that was lost
    assert fits.versions(spark, path) == [1, 2, 3]
