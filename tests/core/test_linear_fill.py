"""The linear fill against all triangles with an empty circle, whatever the side of its cells."""

from itertools import combinations

import numpy as np
import pytest

from tempestry.operators import linear_fill


def brute(grid):
    """The mean over all triangles of valid pixels with an empty circle that hold a hole; the nearest where there is none."""
    good = [tuple(x) for x in np.argwhere(~np.isnan(grid)).tolist()]
    p = np.array(good, float).reshape(-1, 2)
    v = np.array([grid[x] for x in good])
    empty = []
    for t in combinations(range(len(p)), 3):
        a, b, c = p[list(t)]
        m = 2 * np.array([b - a, c - a])
        if abs(np.linalg.det(m)) < 1e-9:
            continue
        centre = np.linalg.solve(m, [b @ b - a @ a, c @ c - a @ a])
        if (((p - centre) ** 2).sum(axis=1) > ((a - centre) ** 2).sum() - 1e-9).all():
            empty.append((list(t), np.linalg.inv(np.vstack([p[list(t)].T, np.ones(3)]))))
    out = {}
    for q in np.argwhere(np.isnan(grid)).tolist():
        found = [w @ v[t] for t, inverse in empty if ((w := inverse @ [*q, 1.0]) >= -1e-9).all()]
        if found:
            out[tuple(q)] = (np.mean(found), "linear")
        elif good:
            d = ((p - q) ** 2).sum(axis=1)
            out[tuple(q)] = (v[d.argmin()], "nearest")  # the first in order of row and column
        else:
            out[tuple(q)] = (None, None)
    return out


def grids():
    rng = np.random.default_rng(6)
    for share in (0.2, 0.5, 0.8):
        grid = rng.normal(size=(7, 8))
        grid[rng.random(grid.shape) < share] = np.nan
        yield grid
    hole = rng.normal(size=(8, 8))
    hole[2:6, 1:6] = np.nan  # a wide hole
    yield hole
    stripe = np.tile(np.arange(8.0), (8, 1))
    stripe[:, 3:6] = np.nan  # a plane stays one
    yield stripe
    rim = rng.normal(size=(6, 7))
    rim[:, :3] = np.nan
    rim[0] = np.nan
    yield rim
    line = np.full((5, 5), np.nan)
    line[2, 1:4] = [1.0, 2.0, 3.0]  # no area
    yield line
    yield np.full((3, 3), np.nan)
    yield np.ones((3, 3))


@pytest.fixture(scope="module")
def expected():
    return {(f, *q): x for f, grid in enumerate(grids()) for q, x in brute(grid).items()}


@pytest.mark.parametrize("side", [1, 4, 64])
def test_equals_brute_force_for_every_side(spark, expected, side):
    rows = [(f, r, c, None if np.isnan(grid[r, c]) else float(grid[r, c])) for f, grid in enumerate(grids()) for r, c in np.ndindex(*grid.shape)]
    df = spark.createDataFrame(rows, "frame_id int, pr int, pc int, v double").repartition(3)
    got = {(r.frame_id, r.pr, r.pc): (r.filled, r.how) for r in linear_fill.fill(df, "v", side).collect()}
    assert got.keys() == expected.keys()
    for q, (value, how) in expected.items():
        assert got[q][1] == how, q
        assert got[q][0] == (value if value is None else pytest.approx(value, abs=1e-6)), q
    assert [got[4, 2, c][0] for c in (3, 4, 5)] == pytest.approx([3, 4, 5])


def test_one_large_hole_needs_larger_cells():
    """Within a short reach nothing is proven, and what is proven is the same as with all points."""
    points = np.array([(r, c) for r in range(20) for c in range(20) if not (4 <= r < 15 and 4 <= c < 15)])
    values = points @ [2.0, -1.0] + 5
    assert linear_fill.interpolated(points, values, np.array([9, 9]), 4) is None
    assert linear_fill.interpolated(points, values, np.array([9, 9]), 40) == pytest.approx(2 * 9 - 9 + 5)
    assert linear_fill.interpolated(points[:0], values[:0], np.array([9, 9]), 40) is None


def test_a_hole_is_filled_from_what_is_near_first(monkeypatch):
    """In a wide cell a small hole asks the points around it only, with the same result as all of them give."""
    rng = np.random.default_rng(3)
    points = np.array([(r, c) for r in range(40) for c in range(40) if (r, c) != (20, 20)])
    values, seen, full = rng.normal(size=len(points)), [], linear_fill.interpolated
    want = full(points, values, np.array([20, 20]), 16)
    monkeypatch.setattr(linear_fill, "interpolated", lambda p, *a: seen.append(len(p)) or full(p, *a))
    assert linear_fill._nearby(points, values, np.array([20, 20]), 16) == pytest.approx(want) and seen == [80]
