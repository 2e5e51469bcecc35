"""Neighbourhood operators over pixel tables (frame, row, column): each pixel is sent to the cells that need it.

A stencil is an explode over its offsets and one grouping by (frame, row, column), so a frame's size is never a
task's size. Separable kernels go over rows, then columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["frame_id", "pr", "pc"]


def spread(pixels: DataFrame, offsets: Sequence[tuple[int, int, float]], value: str) -> DataFrame:
    """frame_id, pr, pc, v, w: each pixel's value at the cells (row + dr, column + dc) that look at it with weight w."""
    near = F.explode(F.array(*(F.struct(F.lit(-dr).alias("dr"), F.lit(-dc).alias("dc"), F.lit(float(w)).alias("w")) for dr, dc, w in offsets)))
    x = pixels.where(F.col(value).isNotNull()).select("frame_id", "pr", "pc", F.col(value).alias("v"), near.alias("o"))
    return x.select("frame_id", (F.col("pr") + F.col("o.dr")).alias("pr"), (F.col("pc") + F.col("o.dc")).alias("pc"), "v", F.col("o.w").alias("w"))


def stencil(pixels: DataFrame, offsets: Sequence[tuple[int, int, float]], value: str, **outputs: Column) -> DataFrame:
    """The pixels' cells with aggregates over v and w of their neighbourhood; missing neighbours are left out."""
    found = spread(pixels, offsets, value).groupBy(*CELL).agg(*(c.alias(name) for name, c in outputs.items()))
    return pixels.select(*CELL, value).join(found, CELL, "left")


def square(reach: int) -> list[tuple[int, int, float]]:
    return [(i, j, 1.0) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]


def weighted_mean() -> Column:
    return F.sum(F.col("v") * F.col("w")) / F.sum("w")


def gaussian(pixels: DataFrame, value: str, sigma_rows: float, sigma_cols: float, rim: str = "open", shape: tuple[int, int] | None = None) -> DataFrame:
    """frame_id, pr, pc, smooth: an anisotropic Gaussian over rows, then over columns, cut at four deviations.

    Weights are those of the pixels with a value, so holes don't pull values down. Every pixel gets what its neighbours
    give, missing ones too. Beyond the rim there is nothing (open), the grid mirrored at its edge (mirror), or its last
    row and column again and again (repeat); the last two need the grid's shape.
    """
    cells = pixels.select(*CELL)
    rows = _axis(pixels, value, sigma_rows, "pr", rim, shape and shape[0]).groupBy(*CELL)
    sums = rows.agg(F.struct(F.sum(F.col("v") * F.col("w")).alias("sv"), F.sum("w").alias("sw")).alias("x")).join(cells, CELL)
    cols = _axis(sums, "x", sigma_cols, "pc", rim, shape and shape[1]).groupBy(*CELL)
    out = cols.agg((F.sum(F.col("v.sv") * F.col("w")) / F.sum(F.col("v.sw") * F.col("w"))).alias("smooth"))
    return cells.join(out, CELL, "left")


def images(at: Column, n: int, reach: int, rim: str) -> Column:
    """Where a row (or column) stands as seen from the grid: its own place and those that it stands for beyond the rim."""
    if rim == "mirror":
        return F.array(at, -1 - at, 2 * n - 1 - at)
    before = F.when(at == 0, F.sequence(F.lit(-reach), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    after = F.when(at == n - 1, F.sequence(F.lit(n), F.lit(n + reach - 1))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(at.cast("int")), before, after)


def _axis(pixels: DataFrame, value: str, sigma: float, axis: str, rim: str, n: int | None) -> DataFrame:
    """As spread(), with a Gaussian's weights along one axis."""
    reach = int(4 * sigma + 0.5)
    if not reach or rim == "open":
        return spread(pixels, _kernel(sigma, (lambda k: (k, 0)) if axis == "pr" else (lambda k: (0, k))), value)
    weights = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(math.exp(-0.5 * (k / sigma) ** 2)).alias("w")) for k in range(-reach, reach + 1)))
    seen = pixels.where(F.col(value).isNotNull()).select(*CELL, F.col(value).alias("v"), F.explode(images(F.col(axis), n, reach, rim)).alias("at"))
    sent = seen.where((F.col("at") >= -reach) & (F.col("at") < n + reach)).select("*", F.explode(weights).alias("o")).withColumn(axis, F.col("at") + F.col("o.k"))
    return sent.where(F.col(axis).between(0, n - 1)).select(*CELL, "v", F.col("o.w").alias("w"))


def gather(pixels: DataFrame, value: str, row: str, column: str) -> DataFrame:
    """frame_id, pr, pc, gathered: what each pixel finds at its own fractional place (row, column) of its frame.

    A place beyond the frame is moved to its rim. Of the four pixels around a place those with a value count, by their
    bilinear weights; without any, or without a place, there is none. Pixels ask the cells they need, so a frame may be
    larger than a task and a displacement as long as the frame.
    """
    bounds = pixels.groupBy("frame_id").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("pr", "pc") for f in (F.min, F.max)))
    inside = lambda x, c: F.round(F.greatest(F.col(f"min_{c}").cast("double"), F.least(F.col(f"max_{c}").cast("double"), F.col(x))), 9)
    placed = pixels.where(F.col(row).isNotNull() & F.col(column).isNotNull()).join(bounds, "frame_id").select(*CELL, inside(row, "pr").alias("y"), inside(column, "pc").alias("x"))
    y0, x0 = F.floor("y"), F.floor("x")
    share = lambda at, base, step: F.col(at) - base if step else 1 - (F.col(at) - base)
    corners = F.array(*(F.struct((y0 + i).alias("sr"), (x0 + j).alias("sc"), (share("y", y0, i) * share("x", x0, j)).alias("w")) for i in (0, 1) for j in (0, 1)))
    asked = placed.select(*CELL, F.explode(corners).alias("q")).select(*CELL, "q.*").where("w > 0")
    sources = pixels.where(F.col(value).isNotNull()).select("frame_id", F.col("pr").cast("long").alias("sr"), F.col("pc").cast("long").alias("sc"), F.col(value).alias("v"))
    found = asked.join(sources, ["frame_id", "sr", "sc"]).groupBy(*CELL).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("v")).alias("wv"))
    return pixels.select(*CELL).join(found.where("w > 1e-6").select(*CELL, (F.col("wv") / F.col("w")).alias("gathered")), CELL, "left")


def gradient(pixels: DataFrame, value: str, axis: str, name: str, difference: Callable[[Column, Column], Column]) -> DataFrame:
    """pixels with the change of value per row (or column): central, or one-sided where one neighbour is missing; NULL
    where both are."""
    ways = [(1, 0, 1.0), (-1, 0, -1.0)] if axis == "pr" else [(0, 1, 1.0), (0, -1, -1.0)]
    sides = spread(pixels, ways, value).groupBy(*CELL).agg(F.max(F.when(F.col("w") > 0, F.col("v"))).alias("_next"), F.max(F.when(F.col("w") < 0, F.col("v"))).alias("_last"))
    own = F.col(value)
    steps = F.col("_next").isNotNull().cast("int") + F.col("_last").isNotNull().cast("int")
    change = difference(F.coalesce("_last", own), F.coalesce("_next", own)) / F.nullif(steps, F.lit(0))
    return pixels.join(sides, CELL, "left").withColumn(name, change).drop("_next", "_last")


def _kernel(sigma: float, place: Callable[[int], tuple[int, int]]) -> list[tuple[int, int, float]]:
    reach = int(4 * sigma + 0.5)
    return [(*place(k), math.exp(-0.5 * (k / sigma) ** 2) if k else 1.0) for k in range(-reach, reach + 1)]
