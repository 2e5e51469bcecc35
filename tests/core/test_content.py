"""Frames known by content, geometry built once, examples completed in place."""

import os

from pyspark.sql import functions as F

from tempestry.operators import backfill, fingerprints, fits


def test_fingerprints(spark):
    rows = [(f, i % 5, i // 5, float(i * 7 % 11)) for f in (1, 2, 3, 4, 5) for i in range(20)]
    df = spark.createDataFrame(rows, "f int, pr int, pc int, v double")
    df = df.where("f <> 3 or pr <> 2 or pc <> 1").withColumn("v", F.when((F.col("f") == 4) & (F.col("pr") == 0) & (F.col("pc") == 0), F.col("v") + 1e-9).otherwise(F.col("v")))
    df = df.union(df.where("f = 5 and pr = 0 and pc = 0"))
    got = {r.f: r.print for r in fingerprints.fingerprint(df.orderBy(F.desc("v")).repartition(3), "f", ["pr", "pc", "v"]).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 4  # a row less, a value changed, a row twice
    null = df.where("f = 1").withColumn("v", F.when(F.col("pc") > 0, F.col("v")))
    assert fingerprints.fingerprint(null, "f", ["pr", "pc", "v"]).first().print not in got.values()
    stored, fetched = df.where("f <= 3"), df.withColumn("g", F.col("f") + 10).drop("f")
    assert {(r.f, r.g) for r in fingerprints.reproduced(stored, fetched, "f", "g", ["pr", "pc", "v"]).collect()} == {(1, 11), (2, 11), (3, 13)}
    assert fingerprints.fingerprint(df.limit(0), "f", ["v"]).count() == 0


def test_geometry_is_built_once_for_equal_coordinates(spark, tmp_path):
    df = spark.createDataFrame([(f, i, float(i + (f == 3))) for f in (1, 2, 3) for i in range(4)], "f int, pr int, lat double")
    calls = []

    def build(pixels):
        calls.append({r.f for r in pixels.select("f").distinct().collect()})
        return pixels.select("f", "pr", (F.col("lat") * 2).alias("twice"))

    path = str(tmp_path / "geometry")
    found, built = fingerprints.neighbours_by_content(df, "f", ["pr", "lat"], path, build)
    assert built == 2 and calls == [{1, 3}] and found.count() == 12
    found, built = fingerprints.neighbours_by_content(df.where("f = 2"), "f", ["pr", "lat"], path, build)
    assert built == 0 and len(calls) == 1 and {(r.f, r.pr, r.twice) for r in found.collect()} == {(2, i, 2.0 * i) for i in range(4)}
    moved = df.where("f = 1").withColumn("lat", F.col("lat") + 0.5)
    assert fingerprints.neighbours_by_content(moved, "f", ["pr", "lat"], path, build)[1] == 1


def test_backfill_statuses_and_second_runs(spark, tmp_path):
    path = str(tmp_path / "examples")
    schema = "name string, a double, b double, other string"
    fits.store(spark.createDataFrame([("whole", 1.0, 2.0, "x"), ("both", None, None, "x"), ("half", None, None, "x"), ("none", 1.0, None, None), ("one", None, 5.0, "x")], schema), path)
    found = spark.createDataFrame([("whole", 9.0, 9.0), ("both", 3.0, 4.0), ("both", 3.0, 5.0), ("half", 6.0, None), ("one", 7.0, 9.0), ("unknown", 1.0, 1.0)], "name string, a double, b double")
    tell = lambda df: {r.name: r.status for r in df.collect()}
    rows = lambda: {r.name: (r.a, r.b, r.other) for r in fits.stored(spark, path, ["name"]).collect()}
    before = rows()
    assert tell(backfill.run(spark, path, found, "name", ["a", "b"], dry_run=True)) == {k: "complete" if k == "whole" else "would-update" for k in before}
    assert rows() == before and os.listdir(path) == ["version=1"]
    assert tell(backfill.run(spark, path, found, "name", ["a", "b"])) == {"whole": "complete", "both": "updated", "half": "partial", "none": "failed", "one": "updated"}
    after = {"whole": (1.0, 2.0, "x"), "both": (3.0, 4.0, "x"), "half": (6.0, None, "x"), "none": (1.0, None, None), "one": (7.0, 5.0, "x")}
    assert rows() == after
    assert {r.name for r in spark.read.parquet(f"{path}/version=2").collect()} == {"both", "half", "one"}  # only what changed
    again = backfill.run(spark, path, found, "name", ["a", "b"])
    assert tell(again) == {"whole": "complete", "both": "complete", "half": "failed", "none": "failed", "one": "complete"} and sorted(os.listdir(path)) == ["version=1", "version=2"]
    forced = backfill.run(spark, path, found, "name", ["a", "b"], force=True)
    assert tell(forced)["whole"] == "updated" and rows()["whole"] == (9.0, 9.0, "x") and rows()["half"] == (6.0, None, "x")
