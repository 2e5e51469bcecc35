"""Connected cells, fills, folds and regrids against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tempestry.operators import graph, neighbours, profiles
from tempestry.plans import analyses, catalogue, records


def flood(cells):
    left, groups = set(cells), []
    while left:
        stack, group = [left.pop()], []
        while stack:
            f, r, c = stack.pop()
            group.append((f, r, c))
            for n in ((f, r + 1, c), (f, r - 1, c), (f, r, c + 1), (f, r, c - 1)):
                if n in left:
                    left.remove(n)
                    stack.append(n)
        groups.append(group)
    return groups


def test_labels(spark):
    rng = random.Random(4)
    cells = {(f, rng.randrange(14), rng.randrange(14)) for f in range(3) for _ in range(110)} | {(5, i, 0) for i in range(20)}
    df = spark.createDataFrame(sorted(cells), "frame_id long, pr long, pc long")
    found = {(r.frame_id, r.pr, r.pc): r.label for r in graph.label(df).collect()}
    for group in flood(cells):
        assert {found[x] for x in group} == {min(r * 100_000 + c for _, r, c in group)}


def spiral(n):
    """Cells of a path of one cell's width that winds inwards over n x n cells, with one cell between its turns."""
    path, at, way, free = [(0, 0)], (0, 0), (0, 1), lambda x: all(0 <= k < n for k in x)
    seen = set(path)
    while True:
        for _ in range(2):
            one, two = ((at[0] + k * way[0], at[1] + k * way[1]) for k in (1, 2))
            if free(one) and two not in seen:
                break
            way = (way[1], -way[0])
        else:
            return path
        at = one
        seen.add(at)
        path.append(at)


@pytest.mark.parametrize("side", [4, 64])
def test_labels_in_tiles(spark, side, monkeypatch):
    """Groups that wind through many tiles, or through one: few rounds, and other columns stay as they are."""
    writes, write = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df, *a: writes.append(a) or write(df, *a))
    rng = random.Random(7)
    turns = spiral(25)
    assert len(turns) > 300
    cells = {(1, r - 1, c - 1) for r, c in turns} | {(2, rng.randrange(-1, 25), rng.randrange(-1, 25)) for _ in range(600)} | {(3, 7, c) for c in range(60)}
    rows = [(*x, None if i % 3 else i, f"{x[1]}") for i, x in enumerate(sorted(cells))]
    df = spark.createDataFrame(rows, "frame_id int, pr int, pc int, n int, t string")
    found = graph.label(df, side).collect()
    assert sorted(tuple(r)[:5] for r in found) == sorted(rows, key=lambda x: x[:3])
    labels = {tuple(r)[:3]: r.label for r in found}
    for group in flood(cells):
        assert {labels[x] for x in group} == {min(r * 100_000 + c for _, r, c in group)}
    assert len(writes) == 2 if side == 64 else len(writes) <= 12


def test_missing_pixels_are_filled_at_any_distance(spark):
    rng = random.Random(9)
    cells = [(f, r, c, float(rng.randrange(100)) if (f < 2 and rng.random() < (0.3, 0.004)[f]) or (f, r, c) == (1, 39, 39) else None) for f in range(3) for r in range(40) for c in range(40)]
    good = {f: [x for x in cells if x[0] == f and x[3] is not None] for f in range(3)}
    expected = {}
    for f, r, c, v in cells:
        if v is None:
            d, _, _, w = min((((r - y) ** 2 + (c - x) ** 2, y, x, w) for _, y, x, w in good[f]), default=(None, None, None, None))
            expected[f, r, c] = (w, d)
    df = spark.createDataFrame(cells, "frame_id long, pr long, pc long, v double")
    found = neighbours.nearest_valid(df, "v").collect()
    assert len(found) == len(expected) and {(r.frame_id, r.pr, r.pc): (r.filled, r.d2) for r in found} == expected
    assert max(d for _, d in expected.values() if d) > 64


def test_regrid_takes_every_frame(spark):
    folder = "/root/testdata/sf0.01"
    frames = {r.frame_id for r in analyses.Tables(spark, folder).pixel.select("frame_id").distinct().collect()}
    assert {r.frame_id for r in catalogue.queries()["knn_regrid_frames"](spark, folder).select("frame_id").distinct().collect()} == frames and len(frames) > 1


def test_clamped_fold_in_runs(spark):
    rng = random.Random(12)
    rows = [(u, rng.randrange(300), i, rng.choice((None, -9000.0, 9000.0)) if rng.random() < 0.02 else float(rng.randrange(-400, 500))) for u, n in ((1, 6000), (2, 70), (3, 1)) for i in range(n)]
    expected = {}
    for u, _, _, v in sorted(rows, key=lambda x: x[:3]):
        n, a = expected.get(u, (0, 0.0))
        expected[u] = (n + 1, 40.0 if v is None else max(-40.0, min(40.0, 0.85 * a + 0.15 * (v - 50))))
    df = spark.createDataFrame(rows, "user_id long, ts long, event_id long, v double").repartition(5)
    for run in (4, 1024):
        found = {r.user_id: (r.n, max(r.low, min(r.high, r["shift"]))) for r in records.clamped_fold(df, run).collect()}
        assert found == {u: (n, pytest.approx(a, abs=1e-9)) for u, (n, a) in expected.items()}


def test_ema_offset_splits_a_key(spark):
    plan = catalogue.queries()["ema_offset"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 3 and "RepartitionByExpression" in plan


def test_sector_that_equals_the_threshold_is_open(spark):
    """A mean of 0.25 may come out a hair above it, by the order in which its values are added."""
    above = math.nextafter(0.25, 1)
    rows = [(1, 10.0, -math.pi + (k + 0.5) * math.pi / 4, s) for k, s in enumerate([above, 0.25] * 4)]
    p = spark.createDataFrame(rows, "frame_id long, r double, t double, s double")
    got = profiles.ring_scores(p, F.col("r"), F.col("t"), F.col("s"), ["frame_id"], 10.0, 1, F.lit(8), 1, 0.5).first()
    assert got.score == pytest.approx(0.25) and got.closure == 0


def test_differences_in_words_round_as_c_does(spark):
    """2.15 is a little less in binary, 2.25 lies halfway and 2.35 is a little more; a frame without a channel has none."""
    rows = [(f, 200.0 + d, 200.0) for f, d in enumerate((2.15, 2.25, 2.35, 2.75))] + [(4, None, 200.0), (5, 201.0, 200.0)]
    p = spark.createDataFrame(rows, "frame_id long, v37 double, h37 double")
    got = {r.frame_id: r.summary for r in analyses.compared(p).collect()}
    assert got == {0: "difference 2.1->2.2 K, core 1->1", 1: "difference 2.2->2.4 K, core 1->1", 2: "difference 2.4->2.8 K, core 1->1", 3: None, 4: None}


def test_small_files_of_many_cells_are_not_broadcast(spark, monkeypatch):
    """A kept table is small as a file and large in memory; no round of labels sends one through the driver."""
    plans, write = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *a))
    graph.label(spark.createDataFrame([(1, 0, c) for c in range(3)], "frame_id long, pr int, pc int"))
    assert len(plans) > 1 and not any("Broadcast" in p for p in plans)
