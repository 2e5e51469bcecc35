"""Missing pixels by linear interpolation between the valid ones around them: the Delaunay interpolant, piece by piece.

The triangle that holds a pixel q is the one whose corners, weighted so that their mean is q, have the least mean squared
distance from q. Where all valid pixels within a reach of q are known and the circle through the corners lies within
that reach, no other valid pixel is in it, so the triangle is one of the whole frame's. Pixels whose circle is too large
for their cell go on to cells of twice the side; most holes are small, and so is what a task holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempestry.operators.neighbours import nearest_valid
from tempestry.operators.stencils import CELL, square, spread
from tempestry.operators.tables import kept

#: Side of the first cells, and what a hole's points are first looked for within, in pixels.
SIDE, NEAR = 16, 4
#: Pixels are looked for a hair off their own place, so that none lies on a line between two others: towards the middle
#: of the points, so that one on their rim stays inside, and a little to the side.
HAIR, ASIDE = 1e-6, 0.01


def _weights(corners: np.ndarray, at: np.ndarray) -> np.ndarray | None:
    """The weights of three points (rows of corners) whose mean is `at`; None if they lie on a line."""
    m = np.vstack([corners.T, np.ones(3)])
    return None if abs(np.linalg.det(m)) < 1e-9 else np.linalg.solve(m, [*at, 1.0])


def interpolated(points: np.ndarray, values: np.ndarray, at: np.ndarray, reach: float) -> float | None:
    """The value at a place by the Delaunay triangle of the points; None if the points within `reach` don't prove it.

    Where more than three points lie on one empty circle the triangles aren't unique; then it is the mean over all
    triangles of these points that hold the place.
    """
    d = (points - at).astype(float)
    if len(d) < 3:
        return None
    h = (d * d).sum(axis=1)
    middle = d.mean(axis=0)
    off = HAIR * (middle + ASIDE * np.array([-middle[1], middle[0]])) / max(np.hypot(*middle), 1e-3) if middle.any() else np.array([HAIR, ASIDE * HAIR])
    turn = np.arctan2(d[:, 1] - off[1], d[:, 0] - off[0])
    first = int(h.argmin())
    from_first = np.mod(turn - turn[first], 2 * np.pi)
    left, right = (from_first > 1e-12) & (from_first < np.pi), from_first > np.pi
    if not left.any() or not right.any():
        return None
    three = [first, int(np.flatnonzero(left)[from_first[left].argmax()]), int(np.flatnonzero(right)[from_first[right].argmin()])]
    if from_first[three[2]] - from_first[three[1]] >= np.pi:
        return None
    lifted = np.column_stack([np.ones(len(d)), d])
    for _ in range(10 * len(d) + 100):
        plane = np.linalg.solve(lifted[three], h[three])
        below = h - lifted @ plane
        worst = int(below.argmin())
        if below[worst] >= -1e-9:
            break
        for k in range(3):
            new = [*three[:k], worst, *three[k + 1 :]]
            w = _weights(d[new], off)
            if w is not None and (w >= 0).all():
                three = new
                break
        else:
            return None
    centre = plane[1:] / 2
    if np.hypot(*centre) + np.sqrt(max(plane[0] + centre @ centre, 0)) > reach + 1e-9:
        return None
    found = [w @ values[list(t)] for t in combinations(np.flatnonzero(below < 1e-7).tolist(), 3) if (w := _weights(d[list(t)], np.zeros(2))) is not None and (w >= -1e-9).all()]
    return float(np.mean(found))


def _nearby(points: np.ndarray, values: np.ndarray, at: np.ndarray, reach: float) -> float | None:
    """As interpolated(), from the points within NEAR and twice that again and again first: who is proven there is the same."""
    apart, near = np.abs(points - at).max(axis=1, initial=0), NEAR
    while near < reach and near < apart.max(initial=0):
        some = apart <= near
        if (x := interpolated(points[some], values[some], at, near)) is not None:
            return x
        near *= 2
    return interpolated(points, values, at, reach)


def _hull(rows: pd.DataFrame) -> pd.DataFrame:
    """Corners of a frame's valid pixels, in order, from the first and last of each row."""
    points = sorted({(int(r), int(c)) for r, a, b in zip(rows["pr"], rows["first"], rows["last"], strict=True) for c in (a, b)})
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    chains = []
    for order in (points, points[::-1]):
        chain: list[tuple[int, int]] = []
        for p in order:
            while len(chain) > 1 and turn(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        chains.append(chain[:-1])
    corners = chains[0] + chains[1] or points
    return pd.DataFrame({"frame_id": [rows["frame_id"].iloc[0]], "hr": [[r for r, _ in corners]], "hc": [[c for _, c in corners]]})


def _inside(pixels: DataFrame, good: DataFrame) -> DataFrame:
    """pixels with `inside`: whether they lie in the hull of their frame's valid pixels; a hull without area holds none."""
    extremes = good.groupBy("frame_id", "pr").agg(F.min("pc").alias("first"), F.max("pc").alias("last"))
    hulls = extremes.groupBy("frame_id").applyInPandas(_hull, "frame_id long, hr array<long>, hc array<long>")  # two numbers a row
    n = F.size("hr")
    nxt = lambda a, i: F.get(a, (i + 1) % n)
    side = lambda i: (nxt("hr", i) - F.get("hr", i)) * (F.col("pc") - F.get("hc", i)) - (nxt("hc", i) - F.get("hc", i)) * (F.col("pr") - F.get("hr", i))
    within = (n > 2) & F.forall(F.sequence(F.lit(0), n - 1), lambda i: side(i) >= 0)
    return pixels.join(hulls, "frame_id").select(*CELL, within.alias("inside"))


def _solver(reach: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A cell's holes from the valid pixels of it and the eight cells around, so of all within the reach."""

    def solve(holes: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        places, values = points[["pr", "pc"]].to_numpy(), points["v"].to_numpy()
        found = [_nearby(places, values, np.array(q), reach) for q in zip(holes["pr"], holes["pc"], strict=True)]
        return holes[["frame_id", "pr", "pc"]].assign(filled=np.array(found, float))

    return solve


def fill(pixels: DataFrame, value: str, side: int = SIDE) -> DataFrame:
    """frame_id, pr, pc, filled, how of each pixel whose value is NULL: 'linear', or 'nearest' beyond the hull of its
    frame's valid pixels; a frame without any valid pixel has none, and no `how`. Rows that aren't there aren't filled.
    The result doesn't depend on the side of the first cells."""
    cells = pixels.select(F.col("frame_id").cast("long").alias("frame_id"), F.col("pr").cast("long").alias("pr"), F.col("pc").cast("long").alias("pc"), F.col(value).cast("double").alias("v"))
    good, bad = cells.where("v is not null"), cells.where("v is null").select(*CELL)
    # a valid pixel with eight valid neighbours is a corner of unit squares only, which hold no hole
    around = spread(good, [o for o in square(1) if o[:2] != (0, 0)], "v").groupBy(*CELL).agg(F.count("*").alias("k"))
    edge = kept(good.join(around, CELL, "left").where("coalesce(k, 0) < 8").select(*CELL, "v"), "edge")
    placed = kept(_inside(bad, good), "holes")
    left, done = placed.where("inside").select(*CELL), []
    span = cells.agg(F.greatest(F.max("pr") - F.min("pr"), F.max("pc") - F.min("pc"))).first()[0] or 0
    nine = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))

    whole = False
    while not whole and not left.isEmpty():
        whole = side > span  # then a cell and those around it have all of the frame's pixels
        key = lambda d=side: (F.floor(F.col("pr") / d).alias("row"), F.floor(F.col("pc") / d).alias("column"))
        asked = left.select(*CELL, *key()).groupBy("frame_id", "row", "column")
        near = edge.select(*CELL, "v", *key(), nine.alias("o")).withColumn("row", F.col("row") + F.col("o.i")).withColumn("column", F.col("column") + F.col("o.j")).drop("o").groupBy("frame_id", "row", "column")
        found = kept(asked.cogroup(near).applyInPandas(_solver(math.inf if whole else side), "frame_id long, pr long, pc long, filled double").withColumn("filled", F.nanvl("filled", F.lit(None).cast("double"))), "filled")
        done.append(found.where("filled is not null"))
        left, side = found.where("filled is null").select(*CELL), 2 * side
    solved = placed.where("inside").select(*CELL).join(left, CELL, "left_anti")
    outer = nearest_valid(cells.join(solved, CELL, "left_anti"), "v")
    out = outer.select(*CELL, "filled", F.when(F.col("filled").isNotNull(), "nearest").alias("how"))
    for x in done:
        out = out.unionByName(x.withColumn("how", F.lit("linear")))
    return out
