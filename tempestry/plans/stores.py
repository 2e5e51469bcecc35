"""Queries that go through the library's own files: crops read by chunk, and the store of training examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempestry.functions import columns as C
from tempestry.functions import constants as K
from tempestry.operators import backfill, fingerprints, fits, stencils
from tempestry.operators.tables import kept, shared_path
from tempestry.plans.registry import Tables, query
from tempestry.sources import examples, grids

#: Grid of the query's frames: y descends with the row. The satellite stands at 137 W.
GRID = {"rows": 24, "cols": 24, "chunk": 8, "fill": 65535, "x0": -0.0069, "dx": 0.0006, "y0": 0.0711, "dy": -0.0006, "scale": 0.01, "offset": 180.0}
SUB_LON = -137.0
#: Fixes and half widths (km) of the crops: well on the grid, at its corner, and beyond the limb.
CROPS = [("middle", 22.0, -137.3, 150.0), ("corner", 24.6, -139.2, 120.0), ("unseen", 20.0, 40.0, 512.0)]

_RATIO, _ECC = f"({K.R_EQ_M}::DOUBLE ** 2 / {K.R_POL_M}::DOUBLE ** 2)", f"(1 - {K.R_POL_M}::DOUBLE ** 2 / {K.R_EQ_M}::DOUBLE ** 2)"


def _forward_sql(source: str) -> str:
    """SQL of columns.scan_angles over source's lat and lon: vectors sx, sy, sz, then x, y and whether it is seen."""
    return f"""(SELECT *, asin(-sy / sqrt(sx * sx + sy * sy + sz * sz)) AS x, atan(sz / sx) AS y, {K.ORBIT_M} * ({K.ORBIT_M} - sx) > sy * sy + {_RATIO} * sz * sz AS seen
  FROM (SELECT *, {K.ORBIT_M} - r * cos(c) * cos(radians(lon - ({SUB_LON}))) AS sx, -r * cos(c) * sin(radians(lon - ({SUB_LON}))) AS sy, r * sin(c) AS sz
    FROM (SELECT *, {K.R_POL_M} / sqrt(1 - {_ECC} * cos(c) * cos(c)) AS r FROM (SELECT *, atan(tan(radians(lat)) / {_RATIO}) AS c FROM {source}) a0) a1) a2)"""


def _inverse_sql(source: str) -> str:
    """SQL of columns.scan_to_geodetic over source's scan_x and scan_y."""
    return f"""(SELECT *, degrees(atan({_RATIO} * rs * cos(scan_x) * sin(scan_y) / sqrt(({K.ORBIT_M} - rs * cos(scan_x) * cos(scan_y)) ** 2 + (rs * sin(scan_x)) ** 2))) AS lat,
      {SUB_LON} - degrees(atan(-rs * sin(scan_x) / ({K.ORBIT_M} - rs * cos(scan_x) * cos(scan_y)))) AS lon
    FROM (SELECT *, CASE WHEN b * b - 4 * a * cc >= 0 THEN (-b - sqrt(b * b - 4 * a * cc)) / (2 * a) END AS rs
      FROM (SELECT *, sin(scan_x) ** 2 + cos(scan_x) ** 2 * (cos(scan_y) ** 2 + {_RATIO} * sin(scan_y) ** 2) AS a, -2 * {K.ORBIT_M} * cos(scan_x) * cos(scan_y) AS b, {K.ORBIT_M}::DOUBLE ** 2 - {K.R_EQ_M}::DOUBLE ** 2 AS cc FROM {source}) i0) i1)"""


@query(f"SELECT fix_id, seen, CASE WHEN seen THEN round(x, 9) END AS scan_x, CASE WHEN seen THEN round(y, 9) END AS scan_y FROM {_forward_sql('track')}")
def scan_angles_of_fixes(t: Tables) -> DataFrame:
    """Fixed-grid angles of each fix; missing where the satellite doesn't see it."""
    x, y, seen = C.scan_angles(F.col("lat"), F.col("lon"), SUB_LON)
    return t.track.select("fix_id", seen.alias("seen"), F.when(seen, F.round(x, 9)).alias("scan_x"), F.when(seen, F.round(y, 9)).alias("scan_y"))


_DISK = "(SELECT o_orderkey, (o_custkey % 400 - 200) / 1250.0::DOUBLE AS scan_x, (o_orderkey % 400 - 200) / 1250.0::DOUBLE AS scan_y FROM orders)"


@query(f"SELECT o_orderkey AS ray_id, round(lat, 7) AS lat, round((((lon + 180) % 360) + 360) % 360 - 180, 7) AS lon FROM {_inverse_sql(_DISK)}")
def places_of_scan_angles(t: Tables) -> DataFrame:
    """Latitude and longitude of rays over and beside the disk; missing where a ray misses the Earth."""
    ray = lambda c: (F.col(c) % 400 - 200) / 1250.0
    lat, lon = C.scan_to_geodetic(ray("o_custkey"), ray("o_orderkey"), SUB_LON)
    return t.orders.select(F.col("o_orderkey").alias("ray_id"), F.round(lat, 7).alias("lat"), F.round(C.wrap180(lon), 7).alias("lon"))


_AXES = f"{GRID['x0']}::DOUBLE + {GRID['dx']}::DOUBLE * pc AS scan_x, {GRID['y0']}::DOUBLE + {GRID['dy']}::DOUBLE * pr AS scan_y"
_FIXES = ", ".join(f"('{n}', {lat}::DOUBLE, {lon}::DOUBLE, {km * 1000 / K.ORBIT_M!r}::DOUBLE)" for n, lat, lon, km in CROPS)


@query(f"""WITH fix(crop, lat, lon, half) AS (VALUES {_FIXES}), f AS {_forward_sql('fix')},
p AS (SELECT frame_id, pr, pc, ir, {_AXES} FROM pixel_many WHERE (pr * 7 + pc) % 31 <> 0),
c AS (SELECT crop, frame_id, pr, pc, ir, scan_x, scan_y FROM p, f WHERE f.seen AND scan_x >= f.x - half AND scan_x < f.x + half AND scan_y >= f.y - half AND scan_y < f.y + half)
SELECT crop, frame_id, pr, pc, round(ir, 2) AS radiance, round(lat, 6) AS lat, round(lon, 6) AS lon FROM {_inverse_sql('c')}""")
def crop_at_read(t: Tables) -> DataFrame:
    """Crops about three fixes from stored frames: strips and chunks off a crop aren't opened. Missing pixels stay out."""
    path = shared_path(t.spark, "grids")
    stored = t.pixel_many.where("(pr * 7 + pc) % 31 <> 0")
    grids.write(stored.select(F.col("frame_id").alias("frame"), "pr", "pc", F.rint((F.col("ir") - GRID["offset"]) / GRID["scale"]).alias("raw")), path, **GRID)
    out = None
    for name, lat, lon, km in CROPS:
        found = grids.located(grids.crop(grids.read(t.spark, path), lat, lon, SUB_LON, km), SUB_LON).where("value is not null")
        rows = found.select(F.lit(name).alias("crop"), F.col("frame").alias("frame_id"), "pr", "pc", F.round("value", 2).alias("radiance"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))
        out = rows if out is None else out.union(rows)
    return out


def _examples(pixels: DataFrame, physics: str) -> DataFrame:
    f = F.col("frame_id")
    sensor = F.element_at(F.array(*map(F.lit, ("GMI", "AMSR2", "SSMIS", "WSFM"))), (f % 4 + 1).cast("int"))
    storm = F.concat(F.lit("AL"), F.lpad((f % 30 + 1).cast("string"), 2, "0"), F.lit("2024"))
    return examples.packed(pixels, ["frame_id"]).select(storm.alias("storm_id"), F.timestamp_seconds(1_717_200_000 + f * 600).alias("scene_time"), sensor.alias("sensor"), F.lit(physics).alias("physics_id"), "pr", "pc", *examples.CHANNELS)


@query("""WITH e AS (SELECT frame_id, count(v37) AS n_valid, sum(round(h89 * 100))::BIGINT AS h89_sum FROM pixel_many WHERE frame_id % 4 < 2 AND (frame_id % 5 <> 0 OR pr > 3) GROUP BY 1)
SELECT 'AL' || lpad((frame_id % 30 + 1)::VARCHAR, 2, '0') || '2024_' || strftime(make_timestamp((1717200000 + frame_id * 600) * 1000000), '%Y%m%d%H%M') || '_' || CASE frame_id % 4 WHEN 0 THEN 'GMI' ELSE 'AMSR2' END || '.npz' AS name,
  CASE WHEN frame_id % 3 = 0 THEN 'new' ELSE 'old' END AS physics_id, CASE WHEN frame_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS version, n_valid, h89_sum FROM e WHERE n_valid > 0""")
def example_store(t: Tables) -> DataFrame:
    """Examples of two exports: the second leaves those of the same physics alone and replaces those of another."""
    path = shared_path(t.spark, "examples")
    pixels = t.pixel_many.where("frame_id % 5 <> 0 or pr > 3")
    examples.export(_examples(pixels, "old"), path)
    second = _examples(pixels.where("frame_id % 3 = 0"), "new").union(_examples(pixels.where("frame_id % 3 = 1"), "old"))
    examples.export(second, path)
    sums = t.spark.read.format("examples").load(path).select("name", F.aggregate("h89", F.lit(0).cast("long"), lambda a, v: a + v).alias("h89_sum"))
    return examples.listing(t.spark, path).join(sums, "name").select("name", "physics_id", "version", "n_valid", "h89_sum")




_BF = "o_orderkey AS example, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 70)::DOUBLE END AS ir_band8, CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey % 50)::DOUBLE END AS ir_band10, CASE WHEN o_orderkey % 5 < 3 THEN (o_custkey % 30)::DOUBLE END AS env_shear"
_FOUND = "l_orderkey AS example, max(l_quantity) FILTER (l_linenumber <= 2) AS ir_band8, max(l_quantity) FILTER (l_linenumber BETWEEN 2 AND 4) AS ir_band10, min(l_discount) FILTER (l_linenumber >= 3) AS env_shear"
_FILLED = ("ir_band8", "ir_band10", "env_shear")


@query(f"""WITH e AS (SELECT {_BF} FROM orders), f AS (SELECT {_FOUND} FROM lineitem GROUP BY 1),
x AS (SELECT e.*, {", ".join(f"f.{c} AS f_{c}" for c in _FILLED)} FROM e LEFT JOIN f USING (example)),
n AS (SELECT *, {" + ".join(f"({c} IS NULL)::INT" for c in _FILLED)} AS asked, {" + ".join(f"({c} IS NULL AND f_{c} IS NOT NULL)::INT" for c in _FILLED)} AS got FROM x)
SELECT example, CASE WHEN asked = 0 THEN 'complete' ELSE 'would-update' END AS dry, CASE WHEN asked = 0 THEN 'complete' WHEN got = asked THEN 'updated' WHEN got > 0 THEN 'partial' ELSE 'failed' END AS status,
  CASE WHEN asked - got = 0 THEN 'complete' ELSE 'failed' END AS again, {", ".join(f"coalesce({c}, f_{c}) AS {c}" for c in _FILLED)} FROM n""")
def example_backfill(t: Tables) -> DataFrame:
    """Stored examples completed from what was found: what a dry run, a run and a second run say, and the values then."""
    path = shared_path(t.spark, "backfill")
    band = lambda when, c, m, name: F.when(F.expr(when), (F.col(c) % m).cast("double")).alias(name)
    fits.store(t.orders.select(F.col("o_orderkey").alias("example"), band("o_orderkey % 2 = 0", "o_custkey", 70, "ir_band8"), band("o_orderkey % 3 = 0", "o_custkey", 50, "ir_band10"), band("o_orderkey % 5 < 3", "o_custkey", 30, "env_shear")), path)
    line = F.col("l_linenumber")
    found = t.lineitem.groupBy(F.col("l_orderkey").alias("example")).agg(
        F.max(F.when(line <= 2, F.col("l_quantity"))).alias("ir_band8"), F.max(F.when(line.between(2, 4), F.col("l_quantity"))).alias("ir_band10"), F.min(F.when(line >= 3, F.col("l_discount"))).alias("env_shear")
    )
    dry = kept(backfill.run(t.spark, path, found, "example", _FILLED, dry_run=True).withColumnRenamed("status", "dry"))
    ran = backfill.run(t.spark, path, found, "example", _FILLED)
    again = backfill.run(t.spark, path, found, "example", _FILLED).withColumnRenamed("status", "again")
    return dry.join(ran, "example").join(again, "example").join(fits.stored(t.spark, path, ["example"]), "example")


_COPY = "SELECT frame_id + 100000 AS candidate_id, pr, pc, CASE WHEN frame_id % 3 = 1 AND pr = 5 AND pc = 7 THEN ir + 0.01 ELSE ir END AS ir FROM pixel_many WHERE frame_id % 4 <> 0 UNION ALL SELECT frame_id + 200000, pr, pc, ir FROM pixel_many WHERE frame_id % 8 = 0"


@query(f"""WITH c AS ({_COPY}), n AS (SELECT frame_id, count(*) AS n FROM pixel_many GROUP BY 1), m AS (SELECT candidate_id, count(*) AS n FROM c GROUP BY 1),
k AS (SELECT p.frame_id, c.candidate_id, count(*) AS k FROM pixel_many p JOIN c ON c.pr = p.pr AND c.pc = p.pc AND c.ir = p.ir AND c.candidate_id IN (p.frame_id + 100000, p.frame_id + 200000) GROUP BY 1, 2)
SELECT k.frame_id, min(k.candidate_id) AS candidate_id FROM k JOIN n ON n.frame_id = k.frame_id JOIN m ON m.candidate_id = k.candidate_id WHERE k = n.n AND k = m.n GROUP BY 1""")
def frame_reproduced(t: Tables) -> DataFrame:
    """Stored frames and the fetched ones that are the same pixel for pixel, found by fingerprints of their content."""
    p = t.pixel_many
    touched = F.when((F.col("frame_id") % 3 == 1) & (F.col("pr") == 5) & (F.col("pc") == 7), F.col("ir") + 0.01).otherwise(F.col("ir"))
    fetched = p.where("frame_id % 4 <> 0").select((F.col("frame_id") + 100_000).alias("candidate_id"), "pr", "pc", touched.alias("ir"))
    fetched = fetched.union(p.where("frame_id % 8 = 0").select(F.col("frame_id") + 200_000, "pr", "pc", "ir"))
    return fingerprints.reproduced(p, fetched, "frame_id", "candidate_id", ["pr", "pc", "ir"])


@query("""WITH n AS (SELECT a.frame_id, a.pr, a.pc, min({'r': b.pr, 'c': b.pc}) AS s FROM pixel_many a JOIN pixel_many b ON a.frame_id = b.frame_id AND abs(b.pr - a.pr) + abs(b.pc - a.pc) = 1 GROUP BY 1, 2, 3)
SELECT n.frame_id, round(avg(b.v37), 5) AS mean, count(*) AS n, 0::BIGINT AS built FROM n JOIN pixel_many b ON b.frame_id = n.frame_id AND b.pr = s.r AND b.pc = s.c GROUP BY 1""")
def geometry_reused(t: Tables) -> DataFrame:
    """Frames regridded by neighbours that are kept under their coordinates' fingerprint: the second time none is built."""
    path, p = shared_path(t.spark, "geometry"), t.pixel_many
    _, first = fingerprints.neighbours_by_content(p, "frame_id", ["pr", "pc"], path, _beside)
    near, built = fingerprints.neighbours_by_content(p, "frame_id", ["pr", "pc"], path, _beside)
    values = p.select("frame_id", F.col("pr").alias("sr"), F.col("pc").alias("sc"), "v37")
    taken = near.join(values, ["frame_id", "sr", "sc"])
    return taken.groupBy("frame_id").agg(F.round(F.avg("v37"), 5).alias("mean"), F.count("*").alias("n")).withColumn("built", F.lit(built if first else -1).cast("long"))


def _beside(pixels: DataFrame) -> DataFrame:
    """frame_id, pr, pc and the place (sr, sc) of the first pixel that touches it by an edge."""
    sides = [(i, j, 1.0) for i, j in ((-1, 0), (0, -1), (0, 1), (1, 0))]
    sent = stencils.spread(pixels.withColumn("at", F.struct("pr", "pc")), sides, "at")
    return sent.groupBy("frame_id", "pr", "pc").agg(F.min("v").alias("s")).join(pixels.select(*stencils.CELL), stencils.CELL).select(*stencils.CELL, F.col("s.pr").alias("sr"), F.col("s.pc").alias("sc"))
