"""Parsers and readers on small inputs."""

from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from tempestry.operators import tables
from tempestry.sources import besttrack, datasource, listings


def test_best_track_text(spark):
    line = "AL, 06, {t}, , {tech}, {tau}, {lat}, {lon}, {v}, 990, HU, 34, NEQ, 1, 2, 3, 4, 1010, {roci}, {rmw}, 0"
    make = lambda **k: line.format(**{"t": "2018091200", "tech": "BEST", "tau": 0, "lat": "281N", "lon": "0801W", "v": 90, "roci": 200, "rmw": 20} | k)
    texts = [make(), make(v=95, roci=0, rmw=30), make(tech="OFCL", v=1), make(tau=12, v=1), make(t="2018091206", lat="105S", lon="1795E", roci="", rmw=0), "AL, 06, 2018091212, , BEST, 0, 1N", make(t="bad")]
    df = spark.createDataFrame([("AL062018", i, x) for i, x in enumerate(texts)], "storm string, n int, text string")
    rows = sorted(besttrack.parse(df, "storm", "n", "text").collect(), key=lambda r: r.valid_time)
    assert [(r.valid_time, r.lat, r.lon, r.vmax_kt, r.roci_nm, r.rmw_nm) for r in rows] == [(datetime(2018, 9, 12), 28.1, -80.1, 95, 200, 30), (datetime(2018, 9, 12, 6), -10.5, 179.5, 90, None, None)]


def test_archive_csv(spark, tmp_path):
    head = "USA_ATCF_ID,ISO_TIME,USA_LAT,USA_LON,USA_WIND,USA_PRES,USA_RMW,USA_ROCI,USA_STATUS\n"
    body = " ,,degrees_north,degrees_east,kts,mb,nmile,nmile, \nAL012020,2020-06-01 00:00:00,10,-60,35,1000,0,,TS\nAL012020,2020-06-01 00:00:00,10.5,-60,40,1000,20,,TS\n,2020-06-01 00:00:00,1,1,1,1,1,1,TS\nAL012020,nonsense,1,1,1,1,1,1,TS\n"
    (tmp_path / "a.csv").write_text(head + body)
    (row,) = besttrack.read_archive(spark, str(tmp_path / "a.csv")).collect()
    assert (row.storm_id, row.lat, row.vmax_kt, row.rmw_nm, row.roci_nm) == ("AL012020", 10.5, 40, 20, None)


def test_names(spark):
    names = ["OR_ABI-L1b-RadM1-M6C13_G18_s20242451230123_e.nc", "x", "TCPRIMED_v01r01-final_AL062018_GMI_GPM_025795_20180912184512.nc", "TCPRIMED_v01r01-final_AL062018_era5_GPM_025795_20180912184512.nc", "1C.GPM.20240101-S235000-E011000.V.HDF5"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(listings.scene(F.col("n")).alias("s"), listings.overpass_file(F.col("n")).alias("o"), listings.granule(F.col("n")).alias("g"))
    a, b, c, d, e = df.collect()
    assert (a.s.sector, a.s.band, a.s.satellite, a.s.start) == ("M1", 13, "G18", datetime(2024, 9, 1, 12, 30, 12))
    assert b.s is None and b.o is None and b.g is None and d.o is None
    assert (c.o.basin, c.o.storm_num, c.o.season, c.o.instrument) == ("AL", 6, 2018, "GMI") and c.o.start == datetime(2018, 9, 12, 18, 45, 12)
    assert e.g.end == datetime(2024, 1, 2, 1, 10)
    sizes = spark.createDataFrame([(10,), (2048,), (3 * 1024**2,)], "n long").select(listings.human_bytes(F.col("n")).alias("x"))
    assert [r.x for r in sizes.collect()] == ["10 B", "2.0 KB", "3.0 MB"]


def test_listing_links(spark):
    df = spark.createDataFrame([('<a href="bal012024.dat">x</a> <a href="?C=N">y</a> <a href="bal012024.dat">',)], "value string")
    assert [r.href for r in listings.links(df).collect()] == ["bal012024.dat"]


def test_frames(spark, tmp_path):
    lat, lon = np.meshgrid([1.0, 2.0], [3.0, 4.0], indexing="ij")
    np.savez(tmp_path / "f1.npz", lat=lat, lon=lon, v37=np.array([[20000, 0], [1, 2]], np.uint16))
    spark.dataSource.register(datasource.FrameSource)
    rows = sorted(spark.read.format("frames").load(str(tmp_path)).collect())
    assert len(rows) == 4 and (rows[0].v37, rows[1].v37, rows[0].h37) == (200.0, None, None)


def test_more_names(spark):
    names = ["a/OR_GLM-L2-LCFA_G16_s20242451230123_e.nc", "a/KTBW20240901_123456_V06", "OR_ABI-L1b-RadF-M6C02_G16_sbad", "KTBW2024_1", "", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    rows = df.select(listings.lightning(F.col("n")).alias("l"), listings.radar_scan(F.col("n")).alias("r"), listings.scene(F.col("n")).alias("s")).collect()
    assert (rows[0].l.satellite, rows[0].l.start) == ("G16", datetime(2024, 9, 1, 12, 30, 12)) and rows[0].s is None
    assert (rows[1].r.station, rows[1].r.time) == ("KTBW", datetime(2024, 9, 1, 12, 34, 56)) and rows[1].l is None
    assert (rows[2].s.sector, rows[2].s.band, rows[2].s.start) == ("F", 2, None)
    assert all(x is None for r in rows[3:] for x in r)
    (row,) = spark.sql("select '1) 10.65 GHz V-Pol 2) 89.0 GHz HPol' as n").select(listings.channels(F.col("n")).alias("c")).collect()
    assert {k: tuple(v) for k, v in row.c.items()} == {1: (10.65, "V"), 2: (89.0, "H")}


def test_ranks_over_the_whole_table(spark):
    df = spark.createDataFrame([((i * 37) % 101, "x" if i % 3 else "y") for i in range(101)], "a int, b string").repartition(5)
    rows = sorted((r.b, r.a, r.k, r.n) for r in tables.ranked(df, "b", "a").collect())
    assert [r[2] for r in rows] == list(range(1, 102)) and {r[3] for r in rows} == {101}
    assert tables.ranked(df.limit(0), "a").count() == 0


def test_a_line_is_rendered_and_split_once(spark):
    """Filters and fields above the split don't write the line's expression out again."""
    from tempestry.plans import catalogue

    plan = catalogue.queries()["bdeck_parse_dedup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("concat_ws(") == 1 and plan.count("split(") == 1


def test_hour_prefixes(spark):
    df = spark.sql("select timestamp '2023-12-31 22:59:59' as a, timestamp '2024-01-01 01:00:00' as b")
    (row,) = df.select(listings.hour_prefixes(F.col("a"), F.col("b"), "ABI-L1b-RadF").alias("x"), listings.hour_prefixes(F.col("b"), F.col("b"), "P").alias("y")).collect()
    assert row.x == ["ABI-L1b-RadF/2023/365/22", "ABI-L1b-RadF/2023/365/23", "ABI-L1b-RadF/2024/001/00", "ABI-L1b-RadF/2024/001/01"] and row.y == ["P/2024/001/01"]


def test_sizes_in_words(spark):
    """Beyond the largest unit the figure grows; halves go to the even digit, as printf does it."""
    sizes = [1023, 1024 + 256, 1024 + 768, 3 * 1024**4 // 2, None]
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    say = lambda *a: [r.x for r in df.select(listings.human_bytes(F.col("n"), *a).alias("x")).collect()]
    assert say("GB") == ["1023 B", "1.2 KB", "1.8 KB", "1536.0 GB", None]
    assert say() == ["1023 B", "1.2 KB", "1.8 KB", "1.5 TB", None]
