"""Least squares within bounds from sums that merge: moments per example and zone, kept as a table of versions.

A residual r is explained by gains g of levers K: r = sum of g_j K_j. All that a fit or a score needs of a set of pixels
are n, sum r^2, b_j = sum K_j r and A_jk = sum K_j K_k, so pixels are read once, new examples are added to the table,
and any grouping of examples is a sum over their rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kelvin by which a lever must move a pixel for it to count as affected.
AFFECTED_K = 0.5
MOMENTS = "n long, r2 double, b array<double>, a array<double>, affected array<long>"


def moments(pixels: DataFrame, keys: Sequence[str], residual: Column, levers: Sequence[Column]) -> DataFrame:
    """keys, n, r2, b, a (rows of the matrix one after the other), affected, over pixels whose residual and levers are all
    there; a group without any has no row. Tasks sum before anything is shuffled."""
    terms = {"r": residual, **{f"k{j}": k for j, k in enumerate(levers)}}
    rows = pixels.select(*keys, *(c.cast("double").alias(f"_{name}") for name, c in terms.items())).dropna(subset=[f"_{x}" for x in terms])
    r, k = F.col("_r"), [F.col(f"_k{j}") for j in range(len(levers))]
    sums = {f"_a{i}_{j}": F.sum(k[i] * k[j]) for i in range(len(k)) for j in range(i, len(k))}
    sums |= {f"_b{j}": F.sum(k[j] * r) for j in range(len(k))} | {f"_f{j}": F.count_if(F.abs(k[j]) > AFFECTED_K) for j in range(len(k))}
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(r * r).alias("r2"), *(c.alias(x) for x, c in sums.items()))
    every = range(len(k))
    return found.select(
        *keys, "n", "r2", F.array(*(f"_b{j}" for j in every)).alias("b"), F.array(*(f"_a{min(i, j)}_{max(i, j)}" for i in every for j in every)).alias("a"), F.array(*(f"_f{j}" for j in every)).alias("affected")
    )


def versions(spark: SparkSession, path: str) -> list[int]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
    done = [m[1] for m in map(re.compile(r"version=(\d+)$").match, names) if m and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{m[0]}/_SUCCESS"))]
    return sorted(map(int, done))


def store(stats: DataFrame, path: str) -> int:
    """Adds rows as a new version, which is there once it is written whole; two writers of one version: one fails."""
    version = max(versions(stats.sparkSession, path), default=0) + 1
    stats.write.mode("errorifexists").parquet(f"{path}/version={version}")
    return version


def stored(spark: SparkSession, path: str, keys: Sequence[str], as_of: int | None = None) -> DataFrame:
    """The latest rows of each value of keys up to a version: an example that was measured again replaces itself."""
    paths = [f"{path}/version={v}" for v in versions(spark, path) if as_of is None or v <= as_of]
    rows = spark.read.option("basePath", path).parquet(*paths)
    values = [c for c in rows.columns if c not in (*keys, "version")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "version").alias("x")).select(*keys, "x.*")


def summed(stats: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Moments of groups of rows, and in how many storms each lever affects a pixel."""
    square = range(size * size)
    at = lambda c, i: F.get(c, F.lit(i))
    found = stats.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("r2").alias("r2"), F.array(*(F.sum(at("b", j)) for j in range(size))).alias("b"), F.array(*(F.sum(at("a", j)) for j in square)).alias("a"),
        F.array(*(F.sum(at("affected", j)) for j in range(size))).alias("affected"), F.array(*(F.count_distinct(F.when(at("affected", j) > 0, F.col("storm_id"))) for j in range(size))).alias("storms"),
    )
    return found


def box_least_squares(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The g within [low, high] that makes g A g - 2 b g least, by an active set; A is positive semidefinite.

    Starts at the bound nearest 0 of each unknown. The unknown whose bound the gradient pulls away from most is freed, the
    free ones are solved for, and a step that would leave the box stops at its wall and binds what met it. Each round
    lowers the sum or ends, so it ends after finitely many; of equally good g (a singular A) any may come out.
    """
    g = np.clip(np.zeros(len(b)), low, high)
    if not len(b):
        return g
    free = (low < g) & (g < high)
    scale = 1e-12 * max(1.0, float(np.abs(a).max(initial=0)), float(np.abs(b).max(initial=0)))
    for _ in range(20 * 2 ** len(b)):
        while free.any():
            f = np.flatnonzero(free)
            target = g.copy()
            target[f] = np.linalg.lstsq(a[np.ix_(f, f)], b[f] - a[np.ix_(f, ~free)] @ g[~free], rcond=None)[0]
            if ((target >= low) & (target <= high)).all():
                g = target
                break
            step = target - g
            with np.errstate(divide="ignore", invalid="ignore"):
                room = np.where(step > 0, (high - g) / step, np.where(step < 0, (low - g) / step, np.inf))
            share = room[f].min()
            met = f[room[f] <= share]
            g = g + share * np.where(free, step, 0)
            g[met] = np.where(step[met] > 0, high[met], low[met])
            free[met] = False
        pull = b - a @ g
        outward = np.where(free, 0, np.where(g <= low, pull, np.where(g >= high, -pull, 0)))
        outward[low >= high] = 0
        best = int(outward.argmax())
        if outward[best] <= scale:
            break
        free[best] = True
    return g


def fitted(zones: DataFrame, keys: Sequence[str], bounds: Mapping[str, tuple[float, float]], fit_zones: Sequence[str], least_pixels: int, least_storms: int, balanced: bool = True) -> DataFrame:
    """keys, gains, at_bound: arrays over the levers of bounds, from summed() rows of keys and zone.

    With `balanced`, each zone counts as one pixel's mean, so a small core weighs as much as what lies around it. A lever
    that affects fewer than least_pixels pixels or least_storms storms in all, or none of the residual, has no gain (null)
    and takes no part. A group without a row in fit_zones has no row here. One row a group goes through Python.
    """
    size, order = len(bounds), list(bounds)
    low, high = (np.array([bounds[k][i] for k in order], float) for i in (0, 1))
    weight = 1 / F.col("n") if balanced else F.lit(1.0)
    at = lambda c, i: F.get(c, F.lit(i))
    pooled = zones.where(F.col("zone").isin(*fit_zones)).groupBy(*keys).agg(
        F.array(*(F.sum(weight * at("b", j)) for j in range(size))).alias("b"), F.array(*(F.sum(weight * at("a", j)) for j in range(size * size))).alias("a"),
        F.array(*(F.sum(at("affected", j)) for j in range(size))).alias("affected"), F.array(*(F.max(at("storms", j)) for j in range(size))).alias("storms"),
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gains, bound = [], []
            for b, a, affected, storms in zip(*(batch.column(c).to_pylist() for c in ("b", "a", "affected", "storms")), strict=True):
                square, b = np.array(a, float).reshape(size, size), np.array(b, float)
                use = [j for j in range(size) if affected[j] >= least_pixels and storms[j] >= least_storms and square[j, j] > 0]
                g = box_least_squares(square[np.ix_(use, use)], b[use], low[use], high[use])
                found = dict(zip(use, g.tolist(), strict=True))
                gains.append([found.get(j) for j in range(size)])
                bound.append([j in found and found[j] in (low[j], high[j]) for j in range(size)])
            out = [*(batch.column(k) for k in keys), pa.array(gains, pa.list_(pa.float64())), pa.array(bound, pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays(out, [*keys, "gains", "at_bound"])

    types = ", ".join(f"{k} {t}" for k, t in pooled.dtypes if k in keys)
    return pooled.mapInArrow(task, f"{types}, gains array<double>, at_bound array<boolean>")


def errors(zones: DataFrame, fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, zone, n, before, after: root mean squares of the residual without gains and with those of fits; a gain that
    is null is 0, and a group without a fit keeps its error."""
    both = zones.join(fits.select(*keys, "gains"), list(keys), "left")
    g = F.transform(F.coalesce("gains", F.transform("b", lambda _: F.lit(0.0))), lambda x: F.coalesce(x, F.lit(0.0)))
    both = both.withColumn("g", g)
    size = F.size("b")
    linear = F.aggregate(F.zip_with("g", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    square = F.aggregate(F.transform("a", lambda x, i: x * F.get("g", F.floor(i / size).cast("int")) * F.get("g", i % size)), F.lit(0.0), lambda s, x: s + x)
    after = F.greatest(F.lit(0.0), F.col("r2") - 2 * linear + square)
    return both.select(*keys, "zone", "n", F.sqrt(F.col("r2") / F.col("n")).alias("before"), F.sqrt(after / F.col("n")).alias("after"))
