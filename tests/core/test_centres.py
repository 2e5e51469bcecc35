"""Centre fixes against plain loops over each frame."""

import itertools
import math
import random
from collections import deque

import numpy as np
import pytest

from tempestry.plans import centres

LAT, LON, SIDE = 20.0, 179.5, 26


def km(lat, lon):
    dx = ((lon - LON + 180) % 360 - 180) * 111.32 * math.cos(math.radians(LAT))
    return math.hypot((lat - LAT) * 111.32, dx)


def components(cells):
    left, out = set(cells), []
    while left:
        group, todo = set(), deque([min(left)])
        while todo:
            c = todo.popleft()
            if c in left:
                left.discard(c)
                group.add(c)
                todo.extend((c[0] + i, c[1] + j) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        out.append(group)
    return out


def place(r, c):
    return LAT + (SIDE / 2 - r) * 0.09, (LON + (c - SIDE / 2) * 0.1 + 180) % 360 - 180


def brute(ir):
    """ir: (row, column) to kelvin, missing pixels left out."""
    near = {x: km(*place(*x)) for x in ir}
    clouds = [(sum(near[x] <= 150 for x in g), -min(r * 100_000 + c for r, c in g), g) for g in components(x for x in ir if ir[x] < 235)]
    clouds = [x for x in clouds if x[0]]
    if not clouds:
        return None
    cloud = max(clouds)[2]
    box = [(r, c) for r in range(-1, SIDE + 1) for c in range(-1, SIDE + 1)]
    px = 0.09 * 111.32 * 0.1 * 111.32 * math.cos(math.radians(np.mean([place(*x)[0] for x in ir])))
    best = None
    for hole in components(x for x in box if x not in cloud):
        if (-1, -1) in hole or any(x not in ir for x in hole) or not 30 <= len(hole) * px <= 20000:
            continue
        at = round(np.mean([r for r, _ in hole])), round(np.mean([c for _, c in hole]))
        if at not in ir or near[at] > 150:
            continue
        ring = {x for x in cloud if any(abs(x[0] - r) + abs(x[1] - c) <= 3 for r, c in hole)}
        contrast = np.mean([ir[x] for x in hole]) - np.mean([ir[x] for x in ring])
        if contrast < 8:
            continue
        across = max(max(x[i] for x in hole) - min(x[i] for x in hole) for i in (0, 1)) + 1
        compact, close = min(2 * math.sqrt(len(hole) / math.pi) / across, 1), 1 - near[at] / 150
        score = min(contrast / 20, 1.5) + compact + 1.5 * close
        if best is None or score > best[0]:
            best = (score, ("eye", *place(*at), 0.35 * min(contrast / 20, 1) + 0.35 * compact + 0.3 * close, near[at], len(hole) * px, contrast))
    if best:
        return best[1]
    inner = [x for x in cloud if near[x] <= 150]
    cut = np.percentile([ir[x] for x in inner], 20)
    core = [x for x in inner if ir[x] < cut]
    if not core:
        return None
    at = round(np.mean([r for r, _ in core])), round(np.mean([c for _, c in core]))
    return ("cdo_centroid", *place(*at), 0.25, near[at], None, None) if at in ir else None


def frames():
    """With an eye, without one, with an open one, with a missing pixel in it, two holes, no cloud, flat cloud."""
    rng = random.Random(8)
    out = []
    for kind in ("eye", "none", "open", "missing", "two", "clear", "flat", "rim", "thin"):
        ir = {}
        for r in range(SIDE):
            for c in range(SIDE):
                d = km(*place(r, c))
                v = 205 + rng.random() * 10 if d < 115 else 270 + rng.random()
                if kind != "none" and d < 25:
                    v = 250 + rng.random() * 5
                if kind == "open" and r == SIDE // 2 and c > SIDE // 2:
                    v = 255.0
                if kind == "two" and (r - 7) ** 2 + (c - 14) ** 2 <= 2:
                    v = 280.0
                if kind == "thin" and d < 100 and abs(r - SIDE // 2) < 1:
                    v = 245.0
                if kind in ("clear", "flat"):
                    v = 300.0 if kind == "clear" else 210.0
                if kind == "rim" and d > 60:
                    v = 300.0
                ir[r, c] = v
        if kind == "missing":
            del ir[SIDE // 2 + 1, SIDE // 2 + 1]
        if kind == "rim":
            ir = {(r - 6, c): v for (r, c), v in ir.items() if r >= 6}
        out.append(ir)
    for _ in range(1):  # random clouds with holes
        out.append({(r, c): rng.choice([220, 225, 230, 250, 260]) + rng.random() for r in range(SIDE) for c in range(SIDE) if rng.random() < 0.97})
    return out


def test_equals_brute_force(spark):
    every = frames()
    rows = [(f, r, c, *place(r, c), v) for f, ir in enumerate(every) for (r, c), v in ir.items()]
    df = spark.createDataFrame(rows, "frame_id int, pr int, pc int, lat double, lon double, ir double").repartition(4)
    got = {r.frame_id: (r.method, r.lat, r.lon, r.confidence, r.offset_km, r.eye_km2, r.contrast_k) for r in centres.fixes(df, LAT, LON, 150.0).collect()}
    want = {f: b for f, ir in enumerate(every) if (b := brute(ir))}
    assert got.keys() == want.keys()
    for f, b in want.items():
        assert got[f][0] == b[0]
        assert got[f][1:] == tuple(x if x is None else pytest.approx(x, abs=1e-6) for x in b[1:])
    assert {b[0] for b in want.values()} == {"eye", "cdo_centroid"} and want[0][0] == "eye" and want[2][0] == want[3][0] == "cdo_centroid"
    assert centres.fixes(df.limit(0), LAT, LON, 150.0).count() == 0
    texts = {r.frame_id: r.summary for r in centres.described(centres.fixes(df.where("frame_id < 2"), LAT, LON, 150.0)).collect()}
    assert texts[0].startswith("eye ") and texts[1].startswith("no eye; coldest cloud ")


def test_pixels_are_made_once(spark):
    """However many steps read the pixels, what they are made from is read once."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rows = [(f, r, c, *place(r, c), v) for f, ir in enumerate(frames()[:2]) for (r, c), v in ir.items()]
    df = spark.createDataFrame(rows, "frame_id int, pr int, pc int, lat double, lon double, ir double")
    assert centres.fixes(df.mapInPandas(counted, df.schema), LAT, LON, 150.0).count() == 2
    assert made.value == len(rows)


def test_cells_are_not_broadcast(spark, monkeypatch):
    """Written pixels are a small file and large in memory: only what is one row a frame or hole goes through the driver."""
    plans, write = [], centres.kept
    monkeypatch.setattr(centres, "kept", lambda df, *a: plans.append(df) or write(df, *a))
    rows = [(f, r, c, *place(r, c), v) for f, ir in enumerate(frames()[:2]) for (r, c), v in ir.items()]
    plans.append(centres.fixes(spark.createDataFrame(rows, "frame_id int, pr int, pc int, lat double, lon double, ir double"), LAT, LON, 150.0))
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    sent = 0
    for lines in (p._jdf.queryExecution().executedPlan().toString().split("\n") for p in plans):
        for i, line in enumerate(lines):
            if "BroadcastExchange" in line:
                tree = list(itertools.takewhile(lambda x: depth(x) > depth(line), lines[i + 1 :]))
                assert any("Aggregate" in x for x in tree) or not any("pr#" in x for x in tree)
                sent += 1
    assert sent
