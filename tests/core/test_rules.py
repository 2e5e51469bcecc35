"""Rules of splits, weights, gates and bins on cases worked out by hand, and as-of joins of one long storm."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tempestry.operators import asof, tables
from tempestry.plans import observations, selection, tracks

START = dt.datetime(2024, 6, 1)


@pytest.mark.parametrize(("storms", "held"), [(1, 0), (2, 1), (3, 1), (9, 1), (10, 2), (11, 2), (30, 4), (37, 6)])
def test_storms_held_out(spark, storms, held):
    """0.15 of a band, halves to even (1.5 gives 2, 4.5 gives 4), one at least, none of a band of one."""
    peaks = spark.createDataFrame([(i, 50.0) for i in range(storms)] + [(1000, 120.0)], "storm_id long, peak double")
    got = selection.split(peaks).collect()
    assert Counter((r.band, r.split) for r in got) == Counter({k: v for k, v in {("TS", "val"): held, ("TS", "train"): storms - held, ("C3-5", "train"): 1}.items() if v})


def test_bands(spark):
    peaks = spark.createDataFrame([(i, float(v)) for i, v in enumerate((33, 34, 63, 64, 95, 96))], "storm_id long, peak double")
    assert [r.band for r in selection.split(peaks).orderBy("storm_id").collect()] == ["TD", "TS", "TS", "C1-2", "C1-2", "C3-5"]


def test_strong_gates_need_three_of_any_strength_within_3_km(spark):
    km = 1 / 111.0
    near = [(0.0, 0.0, 50.0), (km, 0.0, 5.0), (2 * km, 0.0, 5.0), (2.9 * km, 0.0, 5.0)]  # the strong one has three weak neighbours
    alone = [(1.0, 1.0, 50.0), (1.0 + km, 1.0, 5.0), (1.0, 1.0 + 2 * km, 50.0), (1.0 + 3.1 * km, 1.0, 5.0)]  # 50 has two, and so has the other 50
    rows = [(1, i, 0, *g) for i, g in enumerate(near + alone)]
    df = spark.createDataFrame(rows, "frame_id int, pr int, pc int, lat double, lon double, dbz double")
    assert {r.pr for r in observations.supported(df).collect()} == {0, 1, 2, 3, 5, 7}


def test_speckle_fills_holes_and_repeats_the_rim(spark):
    grid = [[200.0] * 6 for _ in range(6)]
    grid[0][0], grid[3][3], grid[5][5] = 230.0, 216.0, None
    df = spark.createDataFrame([(1, r, c, grid[r][c]) for r in range(6) for c in range(6)], "frame_id int, pr int, pc int, v double")
    got = {(r.pr, r.pc): (r.median, r.kept) for r in observations.despeckled(df, "v", (6, 6)).collect()}
    # the corner's window holds it nine times of 25, so the median is 200: it goes, and so does 216, 16 K off
    assert got[0, 0] == (200.0, None) and got[3, 3] == (200.0, None) and got[1, 1] == (200.0, 200.0) and (5, 5) not in got


def test_kernel_of_flashes():
    for w in (observations._ROWS, observations._COLS):
        assert sum(x for _, x in w) == pytest.approx(1) and [k for k, _ in w] == list(range(-len(w) // 2 + 1, len(w) // 2 + 1))


def test_as_of_over_buckets_and_one_long_storm(spark):
    """A third of all rows are one storm's; no task of the last windows holds more than its buckets."""
    fix = [(1, START + dt.timedelta(minutes=30 * i), float(i)) for i in range(400)] + [(s, START + dt.timedelta(hours=9 * i), float(s)) for s in range(2, 40) for i in range(12)] + [(None, START, 7.0)]
    passes = [(1, START + dt.timedelta(minutes=7 * i), i) for i in range(1700)] + [(s, START + dt.timedelta(hours=5 * i, minutes=s), 10_000 * s + i) for s in range(2, 50) for i in range(30)] + [(None, START, -1), (3, START - dt.timedelta(days=9), -2), (3, START + dt.timedelta(days=90), -3)]
    series = spark.createDataFrame(fix, "storm_id long, valid_time timestamp, v double")
    points = spark.createDataFrame(passes, "storm_id long, valid_time timestamp, pass_id long")
    want = {}
    for s, t, p in passes:
        mine = [(x, v) for k, x, v in fix if k == s]
        want[p] = (max((m for m in mine if m[0] <= t), default=None), min((m for m in mine if m[0] >= t), default=None))
    for bucket in (3600, 86_400, 10**9):
        found = asof.bracket(points, series, ["storm_id"], "valid_time", ["pass_id"], ["v"], bucket)
        got = {r.pass_id: (r.f0 and tuple(r.f0), r.f1 and tuple(r.f1)) for r in found.collect()}
        assert got == want
    parts = asof.bracket(points, series, ["storm_id"], "valid_time", ["pass_id"], ["v"], 3600).where("storm_id = 1").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 1000


def test_ranks_and_runs_within_groups(spark):
    """Windows over runs see what windows over whole groups see; one group has a third of all rows."""
    rows = [(g, (i * 37) % n, float(i)) for g, n in ((1, 900), (2, 7), (3, 1), (None, 20), *((k, 60) for k in range(4, 34))) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, t int, v double").repartition(5)
    whole = Window.partitionBy("g").orderBy("t")
    want = {(r.g, r.t, r.v): (r.k, r.n, r.s) for r in df.select("*", F.row_number().over(whole).alias("k"), F.count("*").over(Window.partitionBy("g")).alias("n"), F.sum("v").over(whole.rowsBetween(-3, 0)).alias("s")).collect()}
    assert {(r.g, r.t, r.v): (r.k, r.n) for r in tables.ranked_within(df, "g", "t").collect()} == {x: w[:2] for x, w in want.items()}
    for run in (3, 50, 4096):
        cut = tables.in_runs(df, "g", "t", before=3, run=run)
        got = cut.select("*", F.sum("v").over(Window.partitionBy("g", "run").orderBy("k").rowsBetween(-3, 0)).alias("s")).where("own")
        assert {(r.g, r.t, r.v): (r.k, r.n, r.s) for r in got.collect()} == want
        assert cut.groupBy("g", "run").count().agg(F.max("count")).first()[0] <= run + 3
    with pytest.raises(ValueError):
        tables.in_runs(df, "g", "t", before=5, run=4)


def test_all_pairs_of_a_scan(spark):
    """Every pair within ten minutes to the microsecond counts, not the last pass alone; equal times too."""
    at = [0, 0, 599_999_999, 600_000_000, 600_000_001, 1_150_000_000, 1_199_999_999, 2_000_000_000]
    rows = [(i, s, START + dt.timedelta(microseconds=us)) for k, s in enumerate(("GMI", "SSMIS")) for i, us in zip(range(8 * k, 8 * k + 8), at if k else at[::-1], strict=True)] + [(99, None, START)]
    df = spark.createDataFrame(rows, "pass_id long, sensor string, scene_time timestamp")
    want = sorted((a, b) for a, s, x in rows for b, r, y in rows if s and s == r and a < b and abs(x - y) <= dt.timedelta(minutes=10))
    assert sorted(tuple(r) for r in tracks.scan_pairs(df).collect()) == want and len(want) > 16


def test_stations_at_one_place_meet_a_fix_once(spark):
    """Copies of a station at its place don't multiply the pairs; the smallest id of the nearest place is the answer."""
    fixes = spark.createDataFrame([(1, 10.0, 179.9), (2, -40.0, 0.0)], "fix_id long, lat double, lon double")
    stations = spark.createDataFrame([(i, 10.0, -179.9 if i % 2 else 179.0) for i in range(100, 0, -1)], "station_id long, lat double, lon double")
    found = tracks.stations_in_range(fixes, stations)
    assert [(r.fix_id, r.station_id) for r in found.collect()] == [(1, 1)]
    assert "min(station_id" in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]
