"""Stages of the eyewall cycle from a storm's vapour rings and those of its frame before, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.operators.tables import shared_path
from tempestry.plans.analyses import _RINGS2, wvir, wvir_ring_list
from tempestry.plans.registry import Tables, query
from tempestry.streaming import flows, history

# Deep convection (K), weak peak (K), fading of the inner ring, clear radius and far ring (km), contraction
# (km), and the share of its extent that an eroding storm loses.
DEEP_K, WEAK_K, FADING, CLEAR_KM, FAR_KM, CONTRACTION_KM, EROSION = 1.0, 2.5, 0.8, 36.0, 70.0, 8.0, 0.25
#: Names of the stages.
NAMES = {1: "single eyewall", 2: "outer erosion", 3: "concentric eyewalls", 4: "decaying inner eyewall", 5: "inner eyewall gone", 6: "outer eyewall contracting"}
#: What a frame's stage needs, of itself and of the frame before.
VALUES = ["peak", "extent", "inner_clear", "rings", "inner_km", "inner_peak", "outer_km"]
#: Hours after which a frame before counts no longer, and how late frames may come.
MEMORY_HOURS, DELAY = 12.0, "90 minutes"
STORMS = 3


def scenes(t: Tables) -> DataFrame:
    """storm_id, frame_id, valid_time and VALUES of each frame; a storm's frames are three hours apart."""
    deep = lambda c: F.when(F.col("v") > DEEP_K, F.col(c))
    f = wvir(t).groupBy("frame_id").agg(
        F.max("v").alias("peak"), F.coalesce(F.max(deep("radius")), F.lit(0.0)).alias("extent"), (F.max(F.when(F.col("radius") <= CLEAR_KM, F.col("v"))) <= DEEP_K).alias("inner_clear")
    )
    k = wvir_ring_list(t).groupBy("frame_id").agg(F.count("*").cast("int").alias("rings"), F.min("radius").alias("inner_km"), F.min_by("v", "radius").alias("inner_peak"), F.max("radius").alias("outer_km"))
    f = f.join(k, "frame_id", "left").withColumn("rings", F.coalesce("rings", F.lit(0)))
    return f.select((F.col("frame_id") % STORMS).alias("storm_id"), F.col("frame_id").cast("long").alias("frame_id"), F.timestamp_seconds(1_717_200_000 + F.col("frame_id") * 3600).alias("valid_time"), *VALUES)


def _km(c: Column) -> Column:
    return F.format_string("%.0f", c)


def staged(f: DataFrame) -> DataFrame:
    """f with stage, confidence and evidence. f: VALUES and prev_*, all null for a frame without one before."""
    c = F.col
    far = F.coalesce("outer_km", "extent")
    shrink = 1 - c("extent") / c("prev_extent")
    none, concentric, alone = c("peak") <= DEEP_K, c("rings") >= 2, (far >= FAR_KM) & c("inner_clear")
    fading = (c("prev_rings") >= 2) & (c("inner_peak") < FADING * c("prev_inner_peak"))
    contracted = (c("prev_rings") > 0) & (far < c("prev_outer_km") - CONTRACTION_KM)
    eroded = (c("prev_extent") > 0) & (shrink > EROSION)
    weak = c("peak") < WEAK_K
    stage = F.when(none, None).when(concentric & fading, 4).when(concentric, 3).when(alone & contracted, 6).when(alone, 5).when(eroded, 2).otherwise(1)
    sure = F.when(none, 0.0).when(concentric & fading, 0.75).when(concentric, F.when(weak, 0.7).otherwise(0.55)).when(alone & contracted, 0.7).when(alone, 0.65)
    sure = sure.when(eroded, F.greatest(F.lit(0.0), F.least(F.lit(0.85), 0.4 + shrink))).otherwise(F.when(weak, 0.45).otherwise(0.6))
    peak = F.format_string("%.1f", F.round("peak", 1))
    lines = [
        (none, F.concat(F.lit("peak of "), peak, F.lit(" K isn't deep"))),
        (~none & concentric, F.concat(F.lit("rings at "), _km(c("inner_km")), F.lit(" and "), _km(c("outer_km")), F.lit(" km"))),
        (~none & concentric & weak, F.concat(F.lit("peak of "), peak, F.lit(" K, as between two eyewalls"))),
        (concentric & fading, F.lit("inner ring weaker than in the frame before")),
        (~none & ~concentric, F.concat(F.lit("one ring near "), _km(far), F.lit(" km"))),
        (~none & ~concentric & alone & ~F.coalesce(contracted, F.lit(False)), F.lit("nothing deep within 40 km")),
        (~none & ~concentric & alone & contracted, F.concat(F.lit("ring moved in from "), _km(c("prev_outer_km")), F.lit(" to "), _km(far), F.lit(" km"))),
        ((stage == 2), F.concat(F.lit("extent fell from "), _km(c("prev_extent")), F.lit(" to "), _km(c("extent")), F.lit(" km"))),
        ((stage == 1) & ~weak, F.concat(F.lit("peak of "), peak, F.lit(" K, as in a single eyewall"))),
        ((stage == 1) & c("prev_extent").isNull(), F.lit("no frame before")),
    ]
    evidence = F.array_compact(F.array(*(F.when(when, text) for when, text in lines)))
    return f.select("*", stage.alias("stage"), F.round(sure, 6).alias("confidence"), F.array_join(evidence, "; ").alias("evidence"))


OUT = ["storm_id", "frame_id", "rings", "extent", "stage", "confidence", "evidence"]

_SCENES = f"""{_RINGS2}, sc AS (SELECT frame_id % {STORMS} AS storm_id, frame_id, max(v) AS peak, coalesce(max(radius) FILTER (v > 1), 0) AS extent, max(v) FILTER (radius <= {CLEAR_KM}) <= 1 AS inner_clear FROM r9 GROUP BY frame_id),
rg AS (SELECT frame_id, count(*) AS rings, min(radius) AS inner_km, arg_min(v, radius) AS inner_peak, max(radius) AS outer_km FROM kept GROUP BY 1),
fr AS (SELECT sc.*, coalesce(rings, 0) AS rings, inner_km, inner_peak, outer_km, coalesce(outer_km, extent) AS far FROM sc LEFT JOIN rg USING (frame_id)),
hs AS (SELECT *, lag(extent) OVER w AS p_extent, lag(rings) OVER w AS p_rings, lag(inner_peak) OVER w AS p_inner, lag(outer_km) OVER w AS p_outer FROM fr WINDOW w AS (PARTITION BY storm_id ORDER BY frame_id)),
st AS (SELECT *, CASE WHEN peak <= 1 THEN NULL WHEN rings >= 2 THEN CASE WHEN p_rings >= 2 AND inner_peak < 0.8 * p_inner THEN 4 ELSE 3 END
    WHEN far >= 70 AND inner_clear THEN CASE WHEN p_rings > 0 AND far < p_outer - 8 THEN 6 ELSE 5 END
    WHEN p_extent > 0 AND 1 - extent / p_extent > 0.25 THEN 2 ELSE 1 END AS stage FROM hs),
ev AS (SELECT *, CASE WHEN stage IS NULL THEN 0.0 WHEN stage = 4 THEN 0.75 WHEN stage = 3 THEN CASE WHEN peak < 2.5 THEN 0.7 ELSE 0.55 END WHEN stage = 6 THEN 0.7 WHEN stage = 5 THEN 0.65
    WHEN stage = 2 THEN least(0.85, 0.4 + 1 - extent / p_extent) WHEN peak < 2.5 THEN 0.45 ELSE 0.6 END::DOUBLE AS confidence,
  concat_ws('; ', CASE WHEN stage IS NULL THEN printf('peak of %.1f K isn''t deep', round(peak, 1)) END, CASE WHEN stage IN (3, 4) THEN printf('rings at %.0f and %.0f km', inner_km, outer_km) END,
    CASE WHEN stage IN (3, 4) AND peak < 2.5 THEN printf('peak of %.1f K, as between two eyewalls', round(peak, 1)) END, CASE WHEN stage = 4 THEN 'inner ring weaker than in the frame before' END,
    CASE WHEN stage IN (1, 2, 5, 6) THEN printf('one ring near %.0f km', far::DOUBLE) END, CASE WHEN stage = 5 THEN 'nothing deep within 40 km' END, CASE WHEN stage = 6 THEN printf('ring moved in from %.0f to %.0f km', p_outer, far::DOUBLE) END,
    CASE WHEN stage = 2 THEN printf('extent fell from %.0f to %.0f km', p_extent::DOUBLE, extent::DOUBLE) END, CASE WHEN stage = 1 AND peak >= 2.5 THEN printf('peak of %.1f K, as in a single eyewall', round(peak, 1)) END,
    CASE WHEN stage = 1 AND p_extent IS NULL THEN 'no frame before' END) AS evidence FROM st)"""
_OUT = "SELECT storm_id, frame_id, rings, extent, stage, round(confidence, 6) AS confidence, evidence FROM ev"


@query(f"WITH {_SCENES} {_OUT}")
def wvir_stage(t: Tables) -> DataFrame:
    """Eyewall-cycle stage of each frame, how sure it is and why, from its rings and those of the storm's frame before."""
    w = Window.partitionBy("storm_id").orderBy("valid_time")
    return staged(scenes(t).select("*", *(F.lag(c).over(w).alias(f"prev_{c}") for c in VALUES))).select(*OUT)


@query(f"WITH {_SCENES} {_OUT} WHERE frame_id < (SELECT max(frame_id) FROM ev) - 1.5")
def stream_wvir_stage(t: Tables) -> DataFrame:
    """wvir_stage as a stream that keeps a storm's frame before as state, up to the watermark."""
    folder = shared_path(t.spark, "streams")
    scenes(t).write.parquet(f"{folder}/in")
    stream = t.spark.readStream.schema(t.spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    flows.to_parquet(staged(stages(stream)), f"{folder}/out", f"{folder}/state")
    return t.spark.read.parquet(f"{folder}/out").select(*OUT)


def stages(stream: DataFrame) -> DataFrame:
    """The stream of scenes with each storm's frame before."""
    return history.with_previous(stream, "storm_id", "frame_id", "valid_time", VALUES, DELAY, MEMORY_HOURS)
