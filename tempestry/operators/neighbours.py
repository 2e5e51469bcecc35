"""Nearest-neighbour joins: bounded on a latitude-longitude grid of cells, unbounded for missing pixels of a frame."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempestry.operators.tables import kept
from tempestry.operators.stencils import CELL


def nearest(targets: DataFrame, sources: DataFrame, keys: Sequence[str], target_id: Sequence[str], source_id: Sequence[str], distance: Column, limit: float, cell: float, values: Sequence[str]) -> DataFrame:
    """keys, target_id, values of the nearest source and its distance, for targets with one within limit degrees.

    Both have lat and lon; distance is a column over lat, lon, slat, slon. Sources go to their cell of ``cell``
    degrees, targets to all cells that reach within the limit, so only neighbours meet. Ties go to the smaller source_id.
    """
    reach = math.ceil(limit / cell)
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))
    columns = int(360 / cell)
    row, column = F.floor(F.col("lat") / cell), F.pmod(F.floor(F.col("lon") / cell), F.lit(columns))
    s = sources.select(*keys, *(F.col(c).alias(f"s_{c}") for c in source_id), F.col("lat").alias("slat"), F.col("lon").alias("slon"), *values, row.alias("row"), column.alias("column"))
    t = targets.select(*keys, *target_id, "lat", "lon", row.alias("r0"), column.alias("c0"), F.explode(offsets).alias("o"))
    t = t.select(*keys, *target_id, "lat", "lon", (F.col("r0") + F.col("o.i")).alias("row"), F.pmod(F.col("c0") + F.col("o.j"), F.lit(columns)).alias("column"))
    met = t.join(s, [*keys, "row", "column"]).withColumn("d", distance).where(F.col("d") <= limit)
    best = F.min_by(F.struct(*values, "d"), F.struct("d", *(f"s_{c}" for c in source_id))).alias("x")
    return met.groupBy(*keys, *target_id).agg(best).select(*keys, *target_id, "x.*")


def nearest_valid(pixels: DataFrame, value: str) -> DataFrame:
    """frame_id, pr, pc, filled, d2 of each pixel without a value: that of the nearest one of its frame, however far.

    Pixels meet those of their own and the eight cells around, of 2, 4, 8... pixels a side; who finds none within a side
    goes on to the next size. Ties go to the smaller row, then column. In a frame without any value both are NULL.
    """
    good = pixels.where(F.col(value).isNotNull()).select("frame_id", F.col("pr").alias("r"), F.col("pc").alias("c"), value)
    bad, frames = pixels.where(F.col(value).isNull()).select(*CELL), good.select("frame_id").distinct()
    left, done, side = bad.join(frames, "frame_id", "left_semi"), [], 2
    empty = bad.join(frames, "frame_id", "left_anti")
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    while True:
        g = good.select("*", F.floor(F.col("r") / side).alias("row"), F.floor(F.col("c") / side).alias("column"))
        b = left.select(*CELL, around.alias("o")).select(*CELL, (F.floor(F.col("pr") / side) + F.col("o.i")).alias("row"), (F.floor(F.col("pc") / side) + F.col("o.j")).alias("column"))
        d = (F.pow(F.col("pr") - F.col("r"), 2) + F.pow(F.col("pc") - F.col("c"), 2)).cast("long")
        met = b.join(g, ["frame_id", "row", "column"], "left").withColumn("d", d)
        found = kept(met.groupBy(*CELL).agg(F.min(F.when(F.col("d") <= side * side, F.struct("d", "r", "c", value))).alias("x")))
        done.append(found.where("x is not null").select(*CELL, F.col(f"x.{value}").alias("filled"), F.col("x.d").alias("d2")))
        left, side = found.where("x is null").select(*CELL), 2 * side
        if left.isEmpty():
            out = empty.join(good.limit(0).select(F.col(value).alias("filled"), F.col("r").alias("d2")), F.lit(False), "left")
            for x in done:
                out = out.unionByName(x)
            return out
