"""Centre fixes from a frame's cold cloud: the eye that it encloses or, without one, its coldest part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.functions import columns as C
from tempestry.functions import constants as K
from tempestry.operators import graph, stencils
from tempestry.operators.tables import kept, percentiles
from tempestry.plans.registry import Tables, query

# Cold cloud (K), search about the prior centre (km), area (km2) and contrast (K) of an eye, how far around
# it the cloud is measured (pixels), the share of a cloud that is its core, and the confidence of a fix without an eye.
COLD_K, SEARCH_KM, LEAST_EYE_KM2, MOST_EYE_KM2, CONTRAST_K, RING, CORE_SHARE, NO_EYE = 235.0, 200.0, 30.0, 20000.0, 8.0, 3, 0.2, 0.25


def _pixel_km2(pixels: DataFrame) -> DataFrame:
    """frame_id, km2: medians of the steps between neighbours, at the frame's mean latitude."""
    out = pixels.groupBy("frame_id").agg(F.avg("lat").alias("lat0"))
    for axis, across, value in (("pr", "pc", "lat"), ("pc", "pr", "lon")):
        line = Window.partitionBy("frame_id", across).orderBy(axis)
        last = F.when(F.lag(axis).over(line) == F.col(axis) - 1, F.lag(value).over(line))
        steps = kept(pixels.select("frame_id", C.lon_delta(last, F.col(value)).alias("step")).where("step is not null"))
        out = out.join(percentiles(steps, "frame_id", "step", 0.5, f"d_{value}"), "frame_id")
    km = lambda c: F.abs(c) * K.KM_DEG_DISTANCE
    return out.select("frame_id", F.greatest(km("d_lat") * km("d_lon") * F.cos(F.radians("lat0")), F.lit(1e-6)).alias("km2"))


def _main_cloud(pixels: DataFrame, search_km: float) -> DataFrame:
    """The cold pixels of each frame's component that has most of them near the prior centre; the first of equals."""
    x = graph.label(pixels.where(F.col("ir") < COLD_K).select(*stencils.CELL, "ir", "r"))
    near = x.groupBy("frame_id", "label").agg(F.count_if(F.col("r") <= search_km).alias("near")).where("near > 0")
    best = near.groupBy("frame_id").agg(F.max_by("label", F.struct("near", -F.col("label"))).alias("label"))
    return kept(x.join(best, ["frame_id", "label"]).drop("label"), "cloud")


def _holes(cloud: DataFrame, pixels: DataFrame) -> DataFrame:
    """frame_id, pr, pc, label, ir of the cells that a cloud encloses; ir is NULL where there is no pixel.

    The cells of its bounding box and of one more around it that aren't cloud fall into components; the one that holds
    the box's first cell is the outside, all others are holes.
    """
    box = cloud.groupBy("frame_id").agg(*((f(c) + d).alias(f"{c}{d}") for c in ("pr", "pc") for f, d in ((F.min, -1), (F.max, 1))))
    box = box.withColumn("outside", (100_000 * F.col("pr-1") + F.col("pc-1")).cast("long"))
    rows = box.select("*", F.explode(F.sequence("pr-1", "pr1")).alias("pr")).repartition("frame_id", "pr")
    cells = rows.select("frame_id", "pr", F.explode(F.sequence("pc-1", "pc1")).alias("pc"), "outside")
    # met by one grouping: cells of the box, pixels, and the cloud's among them
    met = cells.unionByName(pixels.select(*stencils.CELL, "ir"), True).unionByName(cloud.select(*stencils.CELL, F.lit(True).alias("cloud")), True)
    met = met.groupBy(*stencils.CELL).agg(F.max("outside").alias("outside"), F.max("ir").alias("ir"), F.max("cloud").alias("cloud"))
    return graph.label(met.where("outside is not null and cloud is null").drop("cloud")).where("label != outside").drop("outside")


def _at(found: DataFrame, pixels: DataFrame) -> DataFrame:
    """found (frame_id, cy, cx) with lat and lon of the pixel at that place, halves to even; gone where none is.

    The places found are hashed in shuffled parts: pixels are a small file at first, and large in memory."""
    places = pixels.select(F.col("frame_id"), F.col("pr").cast("long").alias("y"), F.col("pc").cast("long").alias("x"), "lat", "lon")
    found = found.withColumn("y", F.rint("cy").cast("long")).withColumn("x", F.rint("cx").cast("long"))
    return found.hint("shuffle_hash").join(places, ["frame_id", "y", "x"]).drop("y", "x")


def fixes(pixels: DataFrame, lat: float, lon: float, search_km: float = SEARCH_KM) -> DataFrame:
    """frame_id, method, lat, lon, confidence, offset_km, bearing, eye_km2, contrast_k of each frame with cold cloud near
    the prior centre. pixels: frame_id, pr, pc, lat, lon, ir.

    An eye is a hole of the cloud without a missing pixel, of plausible size, near the prior centre and warmer than the
    cloud within three pixels around it; of several the best by contrast, roundness and nearness. Without one, the middle
    of the cloud's coldest fifth is the fix, with little confidence; a frame whose cloud has no colder part has none.
    """
    # written once: all steps read it
    p = kept(pixels.withColumn("r", C.distance_km(F.col("lat"), F.col("lon"), lat, lon)), "pixels")
    cloud = _main_cloud(p, search_km)
    holes = _holes(cloud, p)
    shape = holes.groupBy("frame_id", "label").agg(
        F.count("*").alias("n"), F.count("ir").alias("seen"), F.avg("ir").alias("warm"), F.avg("pr").alias("cy"), F.avg("pc").alias("cx"), F.greatest(F.max("pr") - F.min("pr"), F.max("pc") - F.min("pc")).alias("across")
    ).where("n = seen")
    sized = shape.join(_pixel_km2(p), "frame_id").withColumn("area", F.col("n") * F.col("km2")).where(F.col("area").between(LEAST_EYE_KM2, MOST_EYE_KM2))
    near = kept(_at(sized, p).withColumn("dist", C.distance_km(F.col("lat"), F.col("lon"), lat, lon)).where(F.col("dist") <= search_km), "near")

    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-RING, RING + 1) for j in range(-RING, RING + 1) if abs(i) + abs(j) <= RING))
    ring = holes.join(near.select("frame_id", "label"), ["frame_id", "label"]).select("frame_id", "label", "pr", "pc", F.explode(around).alias("o"))
    ring = ring.select("frame_id", "label", (F.col("pr") + F.col("o.i")).alias("pr"), (F.col("pc") + F.col("o.j")).alias("pc")).distinct()
    edge = ring.join(cloud.select(*stencils.CELL, "ir").hint("merge"), stencils.CELL).groupBy("frame_id", "label").agg(F.avg("ir").alias("cool"))
    eyes = near.join(edge, ["frame_id", "label"]).withColumn("contrast", F.col("warm") - F.col("cool")).where(F.col("contrast") >= CONTRAST_K)
    round_ = C.clip(2 * F.sqrt(F.col("n") / F.pi()) / F.greatest(F.col("across") + 1, F.lit(1)), 0, 1)
    close, strong = 1 - F.least(F.col("dist") / search_km, F.lit(1.0)), F.col("contrast") / 20.0
    eyes = eyes.withColumn("score", F.round(F.least(strong, F.lit(1.5)) + round_ + 1.5 * close, 9)).withColumn("sure", C.clip(0.35 * F.least(strong, F.lit(1.0)) + 0.35 * round_ + 0.3 * close, 0, 1))
    best = eyes.groupBy("frame_id").agg(F.max_by(F.struct("lat", "lon", "sure", "dist", "area", "contrast"), F.struct("score", -F.col("label"))).alias("b"))
    best = kept(best.select("frame_id", F.lit("eye").alias("method"), "b.*"), "eyes")

    blind = cloud.where(F.col("r") <= search_km).join(best.select("frame_id"), "frame_id", "left_anti")
    core = blind.join(percentiles(blind, "frame_id", "ir", CORE_SHARE, "cut").hint("shuffle_hash"), "frame_id").where("ir < cut").groupBy("frame_id").agg(F.avg("pr").alias("cy"), F.avg("pc").alias("cx"))
    middle = _at(core, p).select("frame_id", F.lit("cdo_centroid").alias("method"), "lat", "lon", F.lit(NO_EYE).alias("sure"), C.distance_km(F.col("lat"), F.col("lon"), lat, lon).alias("dist"), *(F.lit(None).cast("double").alias(c) for c in ("area", "contrast")))
    every = best.unionByName(middle)
    heading = C.bearing(F.col("lat") - lat, C.lon_delta(F.lit(float(lon)), F.col("lon")) * F.cos(F.radians(F.lit(float(lat)))))
    return every.select("frame_id", "method", "lat", "lon", F.col("sure").alias("confidence"), F.col("dist").alias("offset_km"), heading.alias("bearing"), F.col("area").alias("eye_km2"), F.col("contrast").alias("contrast_k"))


def described(found: DataFrame) -> DataFrame:
    """frame_id, summary: a fix in words."""
    km = F.format_string("%.0f", F.round("offset_km", 0))
    eye = F.concat(F.lit("eye "), km, F.lit(" km from the fix at bearing "), F.format_string("%.0f", F.round("bearing", 0)), F.lit(" (contrast "), F.format_string("%.0f", F.round("contrast_k", 0)), F.lit(" K, confidence "), F.format_string("%.2f", F.round("confidence", 2)), F.lit(")"))
    return found.select("frame_id", F.when(F.col("method") == "eye", eye).otherwise(F.concat(F.lit("no eye; coldest cloud "), km, F.lit(" km from the fix"))).alias("summary"))


def storms(t: Tables) -> DataFrame:
    """Frames with a cold disk of the pixels' own texture; some have an eye, some an open one, some none."""
    f, r = F.col("frame_id"), C.distance_km(F.col("lat"), F.col("lon"), 25.0, 179.0)
    eye = (f % 3 != 2) & (r <= 18 + 7 * (f % 4))
    gap = (f % 4 == 3) & (F.col("pr") == 24) & (F.col("pc") > 24)
    ir: Column = F.when(eye | gap, 262 + (F.col("ir") - 190) / 10).when(r <= 140, 196 + (F.col("ir") - 190) / 4).otherwise(F.col("ir") + 46)
    return t.pixel.select(*stencils.CELL, "lat", "lon", ir.alias("ir"))


@query()
def center_fix(t: Tables) -> DataFrame:
    """Storm centre of each frame from its cold cloud.

    No SQL: connected cells are found by rounds of labels. tests/core/test_centres.py has a brute-force version.
    """
    found = fixes(storms(t), 25.1, 179.1)
    return found.select("frame_id", "method", *(F.round(c, 4).alias(c) for c in ("lat", "lon", "confidence", "offset_km", "bearing", "eye_km2", "contrast_k")))
