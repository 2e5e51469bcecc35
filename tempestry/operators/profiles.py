"""Radial and azimuthal profiles of frames, ring scores, and what is read off an ordered profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def radial_mean(pixels: DataFrame, r: Column, value: Column, keys: Sequence[str], width: float, n_bins: int) -> DataFrame:
    """keys, bin, centre, mean, n for bins [k width, (k + 1) width), empty ones included with a NULL mean."""
    binned = pixels.where(value.isNotNull()).withColumn("bin", F.floor(r / width)).where(F.col("bin").between(0, n_bins - 1))
    sums = binned.groupBy(*keys, "bin").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    frames = pixels.select(*keys).distinct().select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))).alias("bin"))
    full = frames.join(sums, [*keys, "bin"], "left")
    return full.select(*keys, "bin", ((F.col("bin") + 0.5) * width).alias("centre"), "mean", F.coalesce("n", F.lit(0)).alias("n"))


def ring_scores(pixels: DataFrame, r: Column, theta: Column, strength: Column, keys: Sequence[str], step: float, n_radii: int, sectors: Column, least_pixels: int, least_share: float) -> DataFrame:
    """keys, radius, score, closure: sectors of each annulus first, then their mean, evenness and closure.

    sectors: how many an annulus has, from column radius. Annuli with too few pixels or sectors score 0. A sector that
    equals what a closed one must exceed isn't closed, whatever the last digit of its mean, which the order of a sum sets.
    """
    p = pixels.where(strength.isNotNull()).select(*keys, r.alias("_r"), theta.alias("_t"), strength.alias("_s"))
    p = p.withColumn("radius", F.floor(F.col("_r") / step + 0.5) * step).where(F.col("radius").between(step, n_radii * step))
    p = p.withColumn("sectors", sectors).withColumn("sector", F.least(F.floor((F.col("_t") + F.pi()) / (2 * F.pi()) * F.col("sectors")), F.col("sectors") - 1))
    by_sector = p.groupBy(*keys, "radius", "sectors", "sector").agg(F.avg("_s").alias("m"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys, "radius")
    by_sector = by_sector.withColumn("mean", F.avg("m").over(w))
    rings = by_sector.groupBy(*keys, "radius", "sectors").agg(
        F.avg("m").alias("mean"), F.stddev_pop("m").alias("spread"), F.sum("n").alias("n"), F.count("*").alias("filled"),
        F.avg((F.col("m") - F.greatest(F.lit(0.25), 0.5 * F.col("mean")) > 1e-9).cast("double")).alias("closed"),
    )
    usable = (F.col("n") >= least_pixels) & (F.col("filled") >= least_share * F.col("sectors"))
    even = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("spread") / F.greatest("mean", F.lit(1e-6))))
    frames = pixels.select(*keys).distinct().select("*", F.explode(F.transform(F.sequence(F.lit(1), F.lit(n_radii)), lambda k: k * step)).alias("radius"))
    scored = rings.select(*keys, "radius", F.when(usable, F.greatest(F.lit(0.0), F.col("mean") * even)).alias("score"), F.when(usable, F.col("closed")).alias("closure"))
    return frames.join(scored, [*keys, "radius"], "left").select(*keys, "radius", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("closure", F.lit(0.0)).alias("closure"))


def median3(x: str, w) -> Column:
    """Median of a row and its neighbours; the ends stay as they are."""
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    return F.when(before.isNull() | after.isNull(), F.col(x)).otherwise(F.array_sort(F.array(before, F.col(x), after))[1])


def mean3(x: str, w) -> Column:
    """Mean of a row and its neighbours; a missing neighbour counts as 0."""
    return (F.coalesce(F.lag(x).over(w), F.lit(0.0)) + F.col(x) + F.coalesce(F.lead(x).over(w), F.lit(0.0))) / 3
