"""Displaced gathers, rims and percentiles against numpy."""

import numpy as np
import pytest

from tempestry.operators import stencils, tables
from tempestry.plans import corrections


def frame(spark, grid, name="v", frame_id=1):
    rows = [(frame_id, r, c, None if np.isnan(grid[r, c]) else float(grid[r, c])) for r in range(grid.shape[0]) for c in range(grid.shape[1])]
    return spark.createDataFrame(rows, f"frame_id long, pr int, pc int, {name} double").repartition(3)


def array(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.pr, r.pc] = np.nan if r[name] is None else r[name]
    return out


def test_gather_of_own_places(spark):
    rng = np.random.default_rng(0)
    grid = rng.normal(size=(7, 9))
    grid[2, 3] = grid[2, 4] = grid[3, 3] = grid[3, 4] = np.nan
    y, x = rng.uniform(-3, 9, grid.shape), rng.uniform(-3, 11, grid.shape)
    y[0, 0], x[0, 0], y[1, 1] = 2.5, 3.5, np.nan  # four missing pixels around; no place
    y[4, 4], x[4, 4] = 2.0, 5.0  # exactly on a pixel
    want = np.full(grid.shape, np.nan)
    for r, c in np.ndindex(*grid.shape):
        if np.isnan(y[r, c]):
            continue
        a, b = np.clip(y[r, c], 0, 6), np.clip(x[r, c], 0, 8)
        w = {(int(a) + i, int(b) + j): (a % 1 if i else 1 - a % 1) * (b % 1 if j else 1 - b % 1) for i in (0, 1) for j in (0, 1)}
        w = {k: v for k, v in w.items() if v > 0 and k[0] < 7 and k[1] < 9 and not np.isnan(grid[k])}
        if sum(w.values()) > 1e-6:
            want[r, c] = sum(v * grid[k] for k, v in w.items()) / sum(w.values())
    df = frame(spark, grid).join(frame(spark, y, "y"), stencils.CELL).join(frame(spark, x, "x"), stencils.CELL)
    assert np.allclose(array(stencils.gather(df, "v", "y", "x"), "gathered", grid.shape), want, equal_nan=True, atol=1e-7)
    assert stencils.gather(df.limit(0), "v", "y", "x").count() == 0


@pytest.mark.parametrize(("rim", "mode"), [("mirror", "symmetric"), ("repeat", "edge")])
def test_rims(spark, rim, mode):
    """A dense frame against the padded convolution; with sigma 2 the reach is longer than the frame's rows."""
    grid = np.random.default_rng(1).normal(size=(10, 12))
    out = grid
    for axis, sigma in ((0, 2.0), (1, 1.3)):
        reach = int(4 * sigma + 0.5)
        kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        padded = np.pad(out, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode=mode)
        out = np.apply_along_axis(np.convolve, axis, padded, kernel / kernel.sum(), mode="valid")
    got = array(stencils.gaussian(frame(spark, grid), "v", 2.0, 1.3, rim, grid.shape), "smooth", grid.shape)
    assert np.allclose(got, out)


@pytest.mark.parametrize("limit", [5, 10_000])
def test_percentiles(spark, monkeypatch, limit):
    monkeypatch.setattr(tables, "SORTED_ROWS", limit)
    monkeypatch.setattr(tables, "BINS", 8)
    rng = np.random.default_rng(2)
    groups = {0: rng.normal(size=301), 1: np.full(50, 3.0), 2: rng.choice([1.0, 2.0], 77), 3: np.array([4.0]), 4: 10 ** rng.uniform(-9, 9, 120), 5: np.array([1.0, 9.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [(0, None), (9, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(3)
    for share in (0.0, 0.5, 0.95, 1.0):
        got = {r.g: r.p for r in tables.percentiles(df, "g", "v", share, "p").collect()}
        assert got == {g: pytest.approx(np.percentile(v, 100 * share)) for g, v in groups.items()}


def test_replay_by_hand(spark):
    """The amplitude of a frame is found, a wrong pixel stays visible, and an exact frame isn't solved for."""
    p = np.arange(-4.0, 5.0)
    rows = [(1, 200 + 0.03 * (x > 0), 200.0, x, 1.0) for x in p]
    rows += [(2, 200 + 2.5 * (x + 0.4) - (1.5 * x + 0.8), 200.0, x, 1.0) for x in p]
    rows += [(3, 200 + 2.5 * (x + 0.4) - (1.5 * x + 0.8) + 5 * (x == 0), 200.0, x, 1.0) for x in p] + [(3, None, 200.0, 0.0, 1.0)]
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in r) for r in rows], "frame_id double, stored double, replay double, p double, q double")
    got = {int(r.frame_id): r for r in corrections.replayed(df).collect()}
    assert (got[1].amplitude, got[1].worst, got[1].exact) == (None, 0.03, True)
    assert (got[2].amplitude, got[2].worst, got[2].exact) == (2.5, 0.0, True)
    assert got[3].mismatched == 1 and not got[3].exact and got[3].worst > 4


def test_low_cloud_stays_and_high_cloud_moves(spark):
    """At 137 W the sub-satellite point is south-east of these pixels, so a top is seen to the north-west of its place."""
    rows = [(f, r, c, 25.0 - r / 10, -150.0 + c / 10, 295.0 if f == 1 else 220.0, float(r * 10 + c)) for f in (1, 2) for r in range(6) for c in range(6)]
    p = corrections.displaced(spark.createDataFrame(rows, "frame_id int, pr int, pc int, lat double, lon double, ir double, v37 double"))
    got = p.where("frame_id = 2 and pr = 3 and pc = 3").first()
    assert got.src_r < 3 and got.src_c < 3
    km = (300 - 220) / 6.5
    assert np.hypot((got.src_r - 3) * 11.132, (got.src_c - 3) * 11.132 * np.cos(np.radians(24.7))) == pytest.approx(km * np.tan(np.radians(32.6)), rel=0.05)
