"""Radar gates, lightning and passes made ready: echo tops, isolated gates, flash density, speckle, ice coupling."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempestry.functions import columns as C
from tempestry.functions import constants as K
from tempestry.operators import stencils, tiles
from tempestry.operators.tables import kept, percentiles
from tempestry.plans.registry import Tables, query

# Echo tops (dBZ, km from the storm, degrees of a bin), strong gates (dBZ) and the neighbours they need.
TOP_DBZ, TOP_KM, TOP_BIN, STRONG_DBZ, NEAR_KM, NEIGHBOURS = 18.0, 150.0, 0.02, 35.0, 3.0, 3
# Minutes around a time and smoothing (km) of flashes, and the scale of their logarithm.
ACCUMULATE_MIN, SMOOTH_KM, LOG_SCALE = 5.0, 15.0, 3.0
# Bins (K at 89 GHz) of the ice coupling; window (pixels) and limit (K) of speckle.
ICE_BINS, WINDOW, SPECKLE_K = (150, 180, 200, 212, 228, 254, 275, 300), 2, 15.0

#: A radar's gates: two in five pixels of a frame, a kilometre and a half apart, about 25 N 179 E.
_GATES = """SELECT frame_id, pr, pc, 25.0 + (pr - 24) * 0.013 AS lat, 179.0 + (pc - 24) * 0.015 AS lon, wv - 185 AS dbz, (300 - ir) / 6.5 AS alt_km FROM pixel WHERE (pr * 31 + pc * 17) % 5 < 2"""


def gates(t: Tables) -> DataFrame:
    g = t.pixel.where("(pr * 31 + pc * 17) % 5 < 2")
    return g.select(*stencils.CELL, (25.0 + (F.col("pr") - 24) * 0.013).alias("lat"), (179.0 + (F.col("pc") - 24) * 0.015).alias("lon"), (F.col("wv") - 185).alias("dbz"), ((300 - F.col("ir")) / 6.5).alias("alt_km"))


_HAV = f"2 * {K.EARTH_KM} * asin(sqrt(pow(sin(radians(26.3 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(26.3)) * pow(sin(radians(179.1 - lon) / 2), 2)))"


@query(f"""SELECT frame_id, CAST(round_even(lat / {TOP_BIN}, 0) AS INT) AS rlat, CAST(round_even(lon / {TOP_BIN}, 0) AS INT) AS rlon, round(max(alt_km), 5) AS top_km, count(*) AS n
FROM ({_GATES}) WHERE {_HAV} <= {TOP_KM} AND dbz >= {TOP_DBZ} GROUP BY 1, 2, 3""")
def echo_top_max(t: Tables) -> DataFrame:
    """Highest echo of 18 dBZ or more in each fiftieth of a degree within 150 km of the storm."""
    g = gates(t).where((F.col("dbz") >= TOP_DBZ) & (C.haversine(F.col("lat"), F.col("lon"), F.lit(26.3), F.lit(179.1)) <= TOP_KM))
    cell = lambda c: F.rint(F.col(c) / TOP_BIN).cast("int")
    return g.groupBy("frame_id", cell("lat").alias("rlat"), cell("lon").alias("rlon")).agg(F.round(F.max("alt_km"), 5).alias("top_km"), F.count("*").alias("n"))


def supported(points: DataFrame, strong: float = STRONG_DBZ, radius_km: float = NEAR_KM, neighbours: int = NEIGHBOURS) -> DataFrame:
    """points without strong ones that have fewer than so many others, of any strength, within the radius.

    Points: frame_id, pr, pc, lat, lon, dbz. Kilometres are of the plane about the frame's mean latitude. Strong points go
    to the nine cells of a radius' side around their own, so only neighbours meet, and counts leave the join.
    """
    plane = points.join(points.groupBy("frame_id").agg(F.avg("lat").alias("lat0")), "frame_id")
    plane = plane.select(*stencils.CELL, "dbz", F.round(F.col("lat") * K.KM_DEG_WEIGHT, 9).alias("y"), F.round(F.col("lon") * K.KM_DEG_WEIGHT * F.cos(F.radians("lat0")), 9).alias("x"))
    plane = plane.withColumn("row", F.floor(F.col("y") / radius_km)).withColumn("column", F.floor(F.col("x") / radius_km))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    asked = plane.where(F.col("dbz") >= strong).select(*stencils.CELL, F.col("y").alias("y0"), F.col("x").alias("x0"), "row", "column", around.alias("o"))
    asked = asked.withColumn("row", F.col("row") + F.col("o.i")).withColumn("column", F.col("column") + F.col("o.j")).drop("o")
    met = asked.join(plane.select("frame_id", "row", "column", "y", "x"), ["frame_id", "row", "column"])
    near = F.pow(F.col("y") - F.col("y0"), 2) + F.pow(F.col("x") - F.col("x0"), 2) <= radius_km**2
    counts = met.groupBy(*stencils.CELL).agg((F.count_if(near) - 1).alias("others"))
    return points.join(counts, stencils.CELL, "left").where((F.col("dbz") < strong) | (F.col("others") >= neighbours)).drop("others")


@query(f"""WITH g AS ({_GATES}), m AS (SELECT g.*, round(lat * {K.KM_DEG_WEIGHT}, 9) AS y, round(lon * {K.KM_DEG_WEIGHT} * cos(radians(avg(lat) OVER (PARTITION BY frame_id))), 9) AS x FROM g),
k AS (SELECT a.frame_id, a.pr, a.pc, count(*) - 1 AS others FROM m a JOIN m b ON a.frame_id = b.frame_id AND abs(a.pr - b.pr) <= 3 AND abs(a.pc - b.pc) <= 3 WHERE a.dbz >= {STRONG_DBZ} AND pow(a.y - b.y, 2) + pow(a.x - b.x, 2) <= {NEAR_KM ** 2} GROUP BY 1, 2, 3)
SELECT m.frame_id, m.pr, m.pc, m.dbz FROM m LEFT JOIN k USING (frame_id, pr, pc) WHERE dbz < {STRONG_DBZ} OR others >= {NEIGHBOURS}""")
def gate_despeckle(t: Tables) -> DataFrame:
    """Gates without strong ones that stand alone: fewer than three others, of any strength, within 3 km."""
    return supported(gates(t)).select(*stencils.CELL, "dbz")


#: Grid of the flashes: rows run south, 12 degrees a side.
_SIDE, _NORTH, _WEST, _SPAN = 48, 31.0, 174.0, 12.0
_CELL_KM = (_SPAN / (_SIDE - 1) * K.KM_DEG_DISTANCE, _SPAN / (_SIDE - 1) * K.KM_DEG_DISTANCE * math.cos(math.radians(25.0)))


def _weights(sigma: float) -> list[tuple[int, float]]:
    """A Gaussian cut at four deviations whose weights add up to one."""
    reach = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    return [(k - reach, x / sum(w)) for k, x in enumerate(w)]


_ROWS, _COLS = (_weights(SMOOTH_KM / km) for km in _CELL_KM)


@query(f"""WITH h AS (SELECT CAST(round(epoch(ts) / 3600.0) AS BIGINT) AS hour, lat, lon, abs(epoch_us(ts) / 1e6 - round(epoch(ts) / 3600.0) * 3600) AS off FROM flash),
b AS (SELECT hour, CAST(trunc(({_NORTH} - lat) / {_SPAN} * {_SIDE - 1}) AS INT) AS ri, CAST(trunc((lon - {_WEST}) / {_SPAN} * {_SIDE - 1}) AS INT) AS ci, count(*) AS n FROM h WHERE off <= {ACCUMULATE_MIN * 60} AND lat BETWEEN {_NORTH - _SPAN} AND {_NORTH} AND lon BETWEEN {_WEST} AND {_WEST + _SPAN} GROUP BY 1, 2, 3),
d AS (SELECT hour, ri + i AS ri, ci + j AS ci, sum(n * u * v) AS density FROM b, (VALUES {", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in _ROWS)}) r(i, u), (VALUES {", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in _COLS)}) c(j, v) GROUP BY 1, 2, 3)
SELECT hour, ri, ci, round(density, 6) AS density, round(ln(1 + density) / {LOG_SCALE}, 6) AS scaled FROM d WHERE ri BETWEEN 0 AND {_SIDE - 1} AND ci BETWEEN 0 AND {_SIDE - 1}""")
def flash_density_grid(t: Tables) -> DataFrame:
    """Flashes within five minutes of each hour on a grid, smoothed over 15 km with nothing beyond the rim, and damped."""
    s = C.seconds(F.col("ts"))
    hour = F.round(F.floor(s) / 3600.0)
    inside = F.col("lat").between(_NORTH - _SPAN, _NORTH) & F.col("lon").between(_WEST, _WEST + _SPAN)
    near = t.flash.withColumn("hour", hour.cast("long")).where(inside & (F.abs(s - F.col("hour") * 3600) <= ACCUMULATE_MIN * 60))
    binned = near.groupBy("hour", ((_NORTH - F.col("lat")) / _SPAN * (_SIDE - 1)).cast("int").alias("ri"), ((F.col("lon") - _WEST) / _SPAN * (_SIDE - 1)).cast("int").alias("ci")).agg(F.count("*").alias("n"))
    kernel = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(u * v).alias("w")) for i, u in _ROWS for j, v in _COLS)))
    sent = binned.select("hour", "ri", "ci", "n", kernel.alias("k")).select("hour", (F.col("ri") + F.col("k.i")).alias("ri"), (F.col("ci") + F.col("k.j")).alias("ci"), (F.col("n") * F.col("k.w")).alias("w"))
    d = sent.where(F.col("ri").between(0, _SIDE - 1) & F.col("ci").between(0, _SIDE - 1)).groupBy("hour", "ri", "ci").agg(F.sum("w").alias("density"))
    return d.select("hour", "ri", "ci", F.round("density", 6).alias("density"), F.round(F.log1p("density") / LOG_SCALE, 6).alias("scaled"))


_BIN = "CASE " + " ".join(f"WHEN h89 >= {a} AND h89 < {b} THEN {a}" for a, b in zip(ICE_BINS, ICE_BINS[1:], strict=False)) + " END"


@query(f"SELECT {_BIN} AS h89_from, count(*) AS n, round(quantile_cont(h37, 0.5), 4) AS median, round(quantile_cont(h37, 0.25), 4) AS p25, round(quantile_cont(h37, 0.75), 4) AS p75 FROM pixel WHERE h89 >= {ICE_BINS[0]} AND h89 < {ICE_BINS[-1]} AND h37 IS NOT NULL GROUP BY 1")
def ice_coupling(t: Tables) -> DataFrame:
    """37 GHz quartiles by the seven bins of 89 GHz, from all pixels."""
    # written once: the percentiles' rounds read it again and again
    p = kept(t.pixel.where(f"h89 >= {ICE_BINS[0]} and h89 < {ICE_BINS[-1]} and h37 is not null").select(F.expr(_BIN).alias("h89_from"), "h37"), "coupling")
    out = p.groupBy("h89_from").agg(F.count("*").alias("n"))
    for share, name in ((0.5, "median"), (0.25, "p25"), (0.75, "p75")):
        out = out.join(percentiles(p, "h89_from", "h37", share, name), "h89_from")
    return out.select("h89_from", "n", *(F.round(c, 4).alias(c) for c in ("median", "p25", "p75")))


_GRID = (48, 48)


@query(f"""WITH f AS (SELECT frame_id, quantile_cont(v89, 0.5) AS med FROM pixel WHERE v89 IS NOT NULL GROUP BY 1),
g AS (SELECT f.frame_id, r.pr, c.pc, coalesce(p.v89, f.med) AS v, p.v89 FROM f CROSS JOIN (SELECT unnest(range(0, {_GRID[0]})) AS pr) r CROSS JOIN (SELECT unnest(range(0, {_GRID[1]})) AS pc) c LEFT JOIN pixel p ON p.frame_id = f.frame_id AND p.pr = r.pr AND p.pc = c.pc),
m AS (SELECT a.frame_id, a.pr, a.pc, any_value(a.v89) AS v, quantile_cont(b.v, 0.5) AS med FROM g a, (SELECT unnest(range(-{WINDOW}, {WINDOW + 1})) AS i) i, (SELECT unnest(range(-{WINDOW}, {WINDOW + 1})) AS j) j, g b
  WHERE a.v89 IS NOT NULL AND b.frame_id = a.frame_id AND b.pr = greatest(0, least({_GRID[0] - 1}, a.pr + i)) AND b.pc = greatest(0, least({_GRID[1] - 1}, a.pc + j)) GROUP BY 1, 2, 3)
SELECT frame_id, pr, pc, round(med, 4) AS median, CASE WHEN abs(v - med) <= {SPECKLE_K} THEN round(v, 4) END AS kept FROM m""")
def median_despeckle(t: Tables) -> DataFrame:
    """Median of 5 x 5 pixels, holes filled by the frame's own median and the rim repeated; a pixel 15 K off it goes."""
    return despeckled(t.pixel, "v89", _GRID).select(*stencils.CELL, F.round("median", 4).alias("median"), F.round("kept", 4).alias("kept"))


def despeckled(pixels: DataFrame, value: str, shape: tuple[int, int]) -> DataFrame:
    """frame_id, pr, pc, median, kept of the pixels that have a value; frames without any have no row."""
    there = kept(pixels.where(F.col(value).isNotNull()).select(*stencils.CELL, F.col(value).cast("double").alias("v")), "observed")
    middle = percentiles(there, "frame_id", "v", 0.5, "middle")

    def work(w: tiles.Window) -> dict[str, np.ndarray]:
        v = w.field("v")
        return {"v": v, "median": w.median(v, WINDOW, w.field("middle")[w.at][0])}

    found = tiles.typed(tiles.apply(there.join(middle, "frame_id"), ["v", "middle"], tiles.SIDE, WINDOW, shape, work, ["v", "median"]), there)
    return found.select(*stencils.CELL, "median", F.when(F.abs(F.col("v") - F.col("median")) <= SPECKLE_K, F.col("v")).alias("kept"))
