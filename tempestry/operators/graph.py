"""Connected cells of a grid: those of a tile in one task, then what touches across the borders of tiles as a graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tempestry.operators.stencils import CELL
from tempestry.operators.tables import kept

#: Side of label()'s tiles. They begin one pixel before a grid's first, so that a rim around it is in its first tile.
SIDE = 64


def label(cells: DataFrame, side: int = SIDE) -> DataFrame:
    """cells with label, for cells that touch by an edge the smallest 100000 pr + pc of their group, as a written table.

    A task labels a tile, never a frame. Only the parts of different tiles that touch meet in rounds, whose number grows
    with the logarithm of the tiles that a group runs through; where no group leaves its tile there are none.
    A kept table of millions of cells may be a few MB of file, by which Spark would send it whole through the driver to
    all executors; the hints have it shuffled.
    """
    columns, schema = cells.columns, StructType([*cells.schema, StructField("label", LongType())])

    def task(rows: pa.Table) -> pa.Table:
        top, left = (side * rows[c][0].as_py() - 1 for c in ("tr", "tc"))
        at = rows["pr"].to_numpy() - top, rows["pc"].to_numpy() - left
        on = np.zeros((side, side), bool)
        on[at] = True
        first = connected(on)[at]
        return rows.select(columns).append_column("label", pa.array(100_000 * (first // side + top) + first % side + left, pa.int64()))

    tile = lambda c: F.floor((F.col(c) + 1) / side).cast("long")
    tiled = cells.withColumns({"tr": tile("pr"), "tc": tile("pc")}).groupBy("frame_id", "tr", "tc")
    parts = kept(tiled.applyInArrow(task, schema), "parts")
    edges = kept(_touching(parts, side), "edges")
    if edges.isEmpty():
        return parts
    whole = parts.join(_roots(edges).hint("merge"), ["frame_id", "label"], "left")
    return kept(whole.select(*columns, F.coalesce("root", "label").alias("label")), "labels")


def connected(on: np.ndarray) -> np.ndarray:
    """For each cell that is on, the place in row order of the first cell of its group."""
    n = on.size
    first = np.append(np.where(on.ravel(), np.arange(n), n), n)
    while True:
        own = first[:n].reshape(on.shape)
        seen = own.copy()
        for here, there in ((np.s_[1:], np.s_[:-1]), (np.s_[:-1], np.s_[1:]), (np.s_[:, 1:], np.s_[:, :-1]), (np.s_[:, :-1], np.s_[:, 1:])):
            seen[here] = np.minimum(seen[here], own[there])
        new = first.copy()
        np.minimum.at(new, own[on], seen[on])  # what a group's cells saw is the group's own next name
        while (new != (named := new[new])).any():
            new = named
        if (new == first).all():
            return own
        first = new


def _touching(parts: DataFrame, side: int) -> DataFrame:
    """frame_id, u, v: labels, the larger one first, of parts that touch across a border of tiles."""
    out = None
    for axis in ("pr", "pc"):
        place = F.pmod(F.col(axis) + 1, F.lit(side))
        before = parts.where(place == side - 1).select(*((F.col(c) + 1).alias(c) if c == axis else c for c in CELL), F.col("label").alias("a"))
        after = parts.where(place == 0).select(*CELL, F.col("label").alias("b"))
        met = before.join(after.hint("merge"), CELL).select("frame_id", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        out = out.unionByName(met) if out else met
    return out.distinct()


def _roots(stars: DataFrame) -> DataFrame:
    """frame_id, label, root: the smallest label that each label of the edges is connected with.

    Large and small stars in turn: a label's larger neighbours are tied to its smallest one, then its smaller ones, until
    all are tied to their root and nothing else.
    """
    least = F.min("v").over(Window.partitionBy("frame_id", "u"))
    while True:
        both = stars.unionByName(stars.select("frame_id", F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", least)).where("v > u").select("frame_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        ties = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        small = large.withColumn("m", least).select("frame_id", ties.alias("t")).select("frame_id", "t.*").where("u > v").distinct()
        new = kept(small, "stars")
        if new.count() == stars.count() and new.join(stars.hint("merge"), new.columns, "left_anti").isEmpty():
            return new.select("frame_id", F.col("u").alias("label"), F.col("v").alias("root"))
        stars = new
