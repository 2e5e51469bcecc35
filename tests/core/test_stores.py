"""Chunked grids and the example store: what a scan opens, and what a job leaves behind."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempestry.sources import commits, examples, grids

GRID = {"rows": 40, "cols": 50, "chunk": 16, "fill": 0, "x0": -0.05, "dx": 0.002, "y0": 0.06, "dy": -0.002, "scale": 0.5, "offset": 100.0}


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("grids"))
    cells = spark.range(3 * 40 * 50).selectExpr("id div 2000 as frame", "id % 2000 div 50 as pr", "id % 50 as pc").withColumn("raw", F.when((F.col("pr") < 16) & (F.col("pc") >= 48), 0).otherwise(F.col("frame") * 1000 + F.col("pr") * 10 + F.col("pc") % 7))
    grids.write(cells, path, **GRID)
    return path, cells.toPandas()


def test_round_trip(spark, stored):
    path, cells = stored
    got = grids.read(spark, path).where("value is not null").toPandas().sort_values(["frame", "pr", "pc"])
    want = cells[cells.raw > 0].sort_values(["frame", "pr", "pc"])
    assert np.array_equal(got[["frame", "pr", "pc"]], want[["frame", "pr", "pc"]]) and np.allclose(got.value, want.raw * 0.5 + 100)
    assert np.allclose(got.scan_y, 0.06 - 0.002 * got.pr) and np.allclose(got.scan_x, -0.05 + 0.002 * got.pc)


@pytest.mark.parametrize(
    ("condition", "opened"),
    [
        ("true", 3 * 11),  # of twelve chunks a frame's last one of the first strip was never written
        ("frame = 1", 11),
        ("frame in (0, 2) and pr < 16", 2 * 3),
        ("pr >= 20 and pr <= 30 and pc = 33", 3),
        ("scan_y > 0.0301 and scan_x < -0.0181", 3),  # rows 0 to 14: y descends
        ("scan_y <= -0.0039", 3 * 4),  # rows 32 to 39 only
        ("scan_x > 1", 0),
        ("frame > 5", 0),
    ],
)
def test_a_scan_opens_the_chunks_it_needs(spark, stored, condition, opened):
    path, _ = stored
    full = grids.read(spark, path)
    listed = grids.GridReader({"path": path, "list": "chunks"})
    whole = full.toPandas()
    want = whole if condition == "true" else whole.query(condition.replace(" = ", " == "))
    got = full.where(condition).toPandas()
    order = ["frame", "pr", "pc"]
    assert np.array_equal(got.sort_values(order)[order], want.sort_values(order)[order])
    list(listed.pushFilters(spark_filters(condition)))
    assert sum(b.num_rows for p in listed.partitions() for b in listed.read(p)) == opened


def spark_filters(condition):
    from pyspark.sql import datasource as D

    table = {
        "true": [], "frame = 1": [D.EqualTo(("frame",), 1)], "frame in (0, 2) and pr < 16": [D.In(("frame",), (0, 2)), D.LessThan(("pr",), 16)],
        "pr >= 20 and pr <= 30 and pc = 33": [D.GreaterThanOrEqual(("pr",), 20), D.LessThanOrEqual(("pr",), 30), D.EqualTo(("pc",), 33)],
        "scan_y > 0.0301 and scan_x < -0.0181": [D.GreaterThan(("scan_y",), 0.0301), D.LessThan(("scan_x",), -0.0181)], "scan_y <= -0.0039": [D.LessThanOrEqual(("scan_y",), -0.0039)],
        "scan_x > 1": [D.GreaterThan(("scan_x",), 1)], "frame > 5": [D.GreaterThan(("frame",), 5)],
    }
    return table[condition]


def test_filters_are_handed_over_by_spark(spark, stored, monkeypatch):
    """The chunks' own table tells what Spark pushed: a filter on frame reaches the planner."""
    path, _ = stored
    entries = commits.Folder(path).entries()
    assert len({e["path"] for e in entries}) <= 4 and len(entries) == 9  # a file for each task, not for each strip
    chunks = grids.read(spark, path, list="chunks")
    assert chunks.count() == 33 and chunks.where("frame = 2").count() == 11
    reader = grids.GridReader({"path": path})
    list(reader.pushFilters(spark_filters("frame = 1")))
    assert [[e["frame"] for e in p.entries] for p in reader.partitions()] == [[1, 1, 1]]
    monkeypatch.setattr(grids, "READ_TOGETHER", 2)
    assert [len(p.entries) for p in grids.GridReader({"path": path}).partitions()] == [2, 2, 2, 2, 1]


def test_crop_edges_and_unseen_points(spark, stored):
    path, _ = stored
    x, y = grids.scan_point(5.0, -137.5, -137.0)
    half = 200 * 1000 / 42164160.0
    got = grids.crop(grids.read(spark, path), 5.0, -137.5, -137.0, 200).where("frame = 0").collect()
    rows = [r for r in range(40) if y - half <= 0.06 - 0.002 * r < y + half]
    cols = [c for c in range(50) if x - half <= -0.05 + 0.002 * c < x + half]
    assert {(r.pr, r.pc) for r in got} == {(r, c) for r in rows for c in cols} and rows and cols
    assert grids.crop(grids.read(spark, path), 5.0, 43.0, -137.0).count() == 0
    assert grids.crop(grids.read(spark, path), 5.0, -80.0, -137.0, 100).count() == 0  # on the disk, off the grid
    (corner,) = grids.located(spark.createDataFrame([(1.0, 1.0)], "scan_x double, scan_y double"), -137.0).collect()
    assert corner.lat is None and corner.lon is None


def test_a_pixel_off_the_grid_adds_nothing(spark, tmp_path):
    cells = spark.createDataFrame([(1, 0, 0, 5), (1, 40, 0, 5)], "frame long, pr int, pc int, raw int")
    with pytest.raises(Exception, match="off the grid"):
        grids.write(cells, str(tmp_path), **GRID)
    assert files(tmp_path) == [] and grids.read(spark, str(tmp_path)).count() == 0


def example_rows(spark, names, physics, fail=()):
    rows = [(storm, sensor, physics, i, list(range(4)), storm in fail) for i, (storm, sensor) in enumerate(names)]
    df = spark.createDataFrame(rows, "storm_id string, sensor string, physics_id string, i int, v37 array<int>, fail boolean").repartition(4, "i")
    bad = F.when(F.col("fail"), F.raise_error(F.lit("lost"))).otherwise(F.col("v37"))
    arrays = {c: F.col("v37") for c in ("pr", "pc", "h37", "v89", "h89")}
    return df.withColumns(arrays | {"scene_time": F.lit("2024-06-01 12:00:00").cast("timestamp"), "v37": bad})


NAMES = [("AL01", "GMI"), ("AL02", "AMSR2"), ("AL03", "SSMIS"), ("AL04", "GMI")]


def listed(spark, path):
    return {(r.name, r.physics_id, r.version, r.n_valid) for r in examples.listing(spark, path).collect()}


def test_exports_fail_as_a_whole_and_skip_what_is_there(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(Exception, match="lost"):
        examples.export(example_rows(spark, NAMES, "p1", fail={"AL04"}), path)
    assert files(path) == [] and listed(spark, path) == set()

    examples.export(example_rows(spark, NAMES, "p1"), path)
    first = {(f"{s}_202406011200_{k}.npz", "p1", 1, 3) for s, k in NAMES if k != "SSMIS"}
    assert listed(spark, path) == first
    before = files(path)
    examples.export(example_rows(spark, NAMES, "p1"), path)
    assert files(path) == before  # nothing was written again

    with pytest.raises(Exception, match="lost"):
        examples.export(example_rows(spark, NAMES, "p2", fail={"AL01"}), path)
    assert files(path) == before and listed(spark, path) == first

    examples.export(example_rows(spark, NAMES[:1] * 3, "p2"), path)
    assert listed(spark, path) == {x if not x[0].startswith("AL01") else (x[0], "p2", 2, 3) for x in first}
    back = spark.read.format("examples").load(path)
    assert {(r.name, r.physics_id, tuple(r.h89)) for r in back.collect()} == {(n, p, (0, 1, 2, 3)) for n, p, _, _ in listed(spark, path)}
    assert back.where("storm_id = 'AL02' and sensor in ('AMSR2', 'x')").count() == 1


def test_lost_attempts_leave_nothing(tmp_path):
    writer = examples.ExampleWriter({"path": str(tmp_path)})
    folder = commits.Folder(str(tmp_path))
    for attempt in ("0-1", "0-2"):
        folder.put(f"data/{writer.job}/{attempt}/a.npz", b"x")
        folder.put(f"entries/{writer.job}/{attempt}.json", b'{"name": "a.npz", "path": "p"}')
    writer.commit([commits.AttemptMessage("0-2"), commits.AttemptMessage(""), None])
    assert [f for f in files(tmp_path) if "/data/" in f] == [f"{tmp_path}/data/{writer.job}/0-2/a.npz"]
    assert [e["name"] for e in folder.entries()] == ["a.npz"]
    other = examples.ExampleWriter({"path": str(tmp_path)})
    folder.put(f"data/{other.job}/0-1/b.npz", b"x")
    other.abort([])
    assert not any(other.job in f for f in files(tmp_path)) and len(folder.entries()) == 1


def test_schemes(tmp_path):
    assert commits.file_system(f"file:{tmp_path}")[1] == str(tmp_path)
    with pytest.raises(Exception, match="(?i)scheme|filesystem"):
        commits.Folder("wasbs://store/x")
