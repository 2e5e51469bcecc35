"""Frames known by their content: fingerprints that don't depend on the order of rows, and geometry kept by them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempestry.operators.fits import store, versions


def fingerprint(pixels: DataFrame, frame: str, columns: Sequence[str], name: str = "print") -> DataFrame:
    """frame and name: a text of the count of the frame's rows and of sums of two hashes of each.

    Rows in another order have the same one, a changed value, a missing or a repeated row another one: sums, unlike an
    exclusive or, don't cancel equal rows. NULL is a value. Tasks sum before anything is shuffled.
    """
    # sums of 128 bits in halves of 32, so that nothing overflows
    hashes = [F.xxhash64(F.lit(seed), *(F.struct(F.col(c)).alias(c) for c in columns)) for seed in (1, 2)]
    halves = [h for x in hashes for h in (F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit((1 << 32) - 1)))]
    sums = pixels.groupBy(frame).agg(F.count("*").alias("n"), *(F.sum(h.cast("decimal(20,0)")).alias(f"s{i}") for i, h in enumerate(halves)))
    return sums.select(frame, F.concat_ws("-", *(F.col(c).cast("string") for c in ("n", "s0", "s1", "s2", "s3"))).alias(name))


def reproduced(stored: DataFrame, candidates: DataFrame, frame: str, candidate: str, columns: Sequence[str]) -> DataFrame:
    """frame, candidate: of each stored frame the first candidate (by its order) of exactly the same content, if any."""
    a, b = fingerprint(stored, frame, columns), fingerprint(candidates, candidate, columns)
    return a.join(b, "print").groupBy(frame).agg(F.min(candidate).alias(candidate))


def geometry(spark: SparkSession, path: str) -> DataFrame | None:
    """The geometry rows kept at a path, with the fingerprint (print) they belong to; None if there are none."""
    paths = [f"{path}/version={v}" for v in versions(spark, path)]
    return spark.read.parquet(*paths) if paths else None


def neighbours_by_content(pixels: DataFrame, frame: str, columns: Sequence[str], path: str, build: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """The geometry of each frame (frame and build()'s columns but its own frame), and how many frames were built anew.

    Frames of equal coordinates share one geometry: it is built for the first of them and kept under their fingerprint.
    What a path keeps is found again by later calls, which build nothing for it. build() gets the pixels of the frames
    that are new, one for each fingerprint, and returns rows with their frame.
    """
    spark = pixels.sparkSession
    prints = fingerprint(pixels, frame, columns)
    known = geometry(spark, path)
    new = prints if known is None else prints.join(known.select("print").distinct(), "print", "left_anti")
    first = new.groupBy("print").agg(F.min(frame).alias(frame))
    built = first.count()
    if built:
        rows = build(pixels.join(first.select(frame), frame, "left_semi"))
        store(rows.join(first, frame).drop(frame), path)
    kept: DataFrame = geometry(spark, path)  # type: ignore[assignment]
    return prints.join(kept, "print").drop("print"), built

