"""Operator 7: shards along a Hilbert curve through the metadata, so that files can be pruned by several columns.

Each dimension is cut at its own quantiles (numbers) or numbered by frequency (names), the cells' places on the curve
are sorted by range over the cluster, and the order is cut into runs of equal row counts. Only keys travel: no text
is shuffled. Rows of a group (equal texts) take the cell of the group's first row and stand side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.llm import common


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows; one column a dimension, bits each), for all rows at once."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):  # undo the curve's turns, from the coarsest cells to the finest
        q, low = 1 << level, (1 << level) - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> level) & 1)
    return place


def _cell(rows: DataFrame, name: str, bits: int) -> Column:
    """A dimension's cell, 0 to 2^bits - 1. Numbers: by approximate quantiles, nulls first. Names: by frequency,
    spread over the cells, the last one for all beyond the most frequent ones and for null."""
    cells = 1 << bits
    if dict(rows.dtypes)[name] == "string":
        top = [r[0] for r in rows.where(F.col(name).isNotNull()).groupBy(name).count().orderBy(F.desc("count"), name).limit(cells - 1).collect()]
        numbers = F.create_map(*(F.lit(v) for k, x in enumerate(top) for v in (x, k * cells // (len(top) + 1)))) if top else F.create_map().cast("map<string,int>")
        return F.coalesce(F.try_element_at(numbers, F.coalesce(F.col(name), F.lit(""))), F.lit(cells - 1)).cast("int")
    cuts = sorted(set(rows.select(F.percentile_approx(name, [k / cells for k in range(1, cells)], 10_000)).first()[0] or []))
    return sum((F.when(F.col(name) > cut, 1).otherwise(0) for cut in cuts), F.lit(0)).cast("int")


def shards(docs: DataFrame, n_shards: int, dimensions: Sequence[str] = ("lang", "source", "size"), bits: int = 4) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard (0 to n_shards - 1), slot (gapless from 0): law "rows".

    docs: doc_id, text and the dimensions (text or numbers), of which size is computed: UTF-8 bytes of the text and 8
    more. Row counts of two shards differ by one at most. A null text has size 8 and the checksum of no bytes. Ties
    on the curve go by text, then doc_id; fully repeated rows are interchangeable. More shards than rows leave some
    empty; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), *(F.col(c) for c in dimensions if c not in ("doc_id", "size")))
    rows = common.written(rows, "shard-keys")
    names = [*dimensions]
    first = rows.groupBy("text_hash", "text_crc32").agg(F.min_by(F.struct(*(_cell(rows, c, bits).alias(f"cell{k}") for k, c in enumerate(names))), F.struct("doc_id", *names)).alias("cells"))

    @F.pandas_udf("long")
    def place(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(curve_index(cells.to_numpy(), bits))

    curve = first.select("text_hash", "text_crc32", place("cells").alias("curve"))
    keyed = rows.select("doc_id", "size", "text_crc32", "text_hash").join(curve, ["text_hash", "text_crc32"])
    by = ["curve", "text_hash", "doc_id"]
    ordered = keyed.repartitionByRange(common.partitions(docs.sparkSession), *by).sortWithinPartitions(*by)
    # a partition's number and a row's place in it, from the id that Spark makes of the two
    ordered = common.written(ordered.withColumn("at", F.monotonically_increasing_id()).select("doc_id", "size", "text_crc32", "curve", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place")), "shard-order")
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    ranked = ordered.join(parts, "part").withColumn("rank", F.col("before") + F.col("place"))
    # shard s has the ranks from ceil(s total / n) on
    ranked = ranked.withColumn("shard", F.expr(f"rank * {n_shards} div total").cast("int"))
    return ranked.select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("rank") - F.expr(f"(shard * total + {n_shards} - 1) div {n_shards}")).alias("slot"))


def digest(sharded: DataFrame) -> DataFrame:
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, sharded: DataFrame, path: str) -> None:
    """docs (distinct doc_ids) as one folder of Parquet files for each shard, in slot order."""
    n = sharded.agg(F.coalesce(F.max("shard"), F.lit(0)) + 1).first()[0]
    docs.drop("shard", "slot").join(sharded.select("doc_id", "shard", "slot"), "doc_id").repartitionByRange(n, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
