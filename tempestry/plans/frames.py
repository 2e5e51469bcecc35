"""The whole frame: from pixels, track and sources to both frequencies' fields, with what each step adds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempestry.functions import columns as C
from tempestry.operators import stencils
from tempestry.plans.pixels import _GOES, _S, _WEIGHT, _backbone_sql, BACKBONE, storm
from tempestry.plans.registry import Tables, query


def fields(pixels: DataFrame) -> DataFrame:
    """Pixels of storm() with the backbone, the observed channels within bounds, and their blend.

    Weights: backbone 0.1 and observation 0.3 times its age's confidence; a missing observation leaves the backbone.
    Then the frame's own bias is taken out, at most 5 K.
    """
    p = pixels
    r, rmw, vmax = F.col("r"), F.col("rmw"), F.col("vmax")
    p = p.withColumn("resp", C.scattering(F.col("ir")) * C.radial_weight(r, rmw, vmax, F.col("roci"))).withColumn("age", F.col("frame_id") % 8)
    w = Window.partitionBy("frame_id")
    for c, (bg, e, d, warm) in BACKBONE.items():
        sat, scat = C.saturate(F.col("resp")), C.scattering(F.col("ir"), warm)
        ice = C.ice_depth(F.col("lat")) if c.endswith("89") else F.lit(1.0)
        dg = 1 + C.gain("dep", c, vmax) + C.gain("out", c, vmax) * C.ramp(r / rmw, 1.5, 2.5) + C.gain("far", c, vmax) * C.ramp(r / rmw, 3.5, 5.0)
        p = p.withColumn(f"b_{c}", F.round(bg + e * (1 + C.gain("em", c, vmax)) * sat * (1 - scat) - d * dg * sat * scat * ice, 5))
    weight = F.round(0.3 * C.age_confidence(F.col("age").cast("double")), 9)
    for c in BACKBONE:
        observed = F.when(F.col(c).isNotNull(), weight).otherwise(0.0)
        p = p.withColumn(f"f_{c}", (0.1 * F.col(f"b_{c}") + observed * F.coalesce(c, F.lit(0.0))) / (0.1 + observed))
    return p.select("*", *(F.round(F.col(f"f_{c}") - C.clip(F.avg(F.col(f"f_{c}") - F.col(c)).over(w), -5, 5), 3).alias(f"out_{c}") for c in BACKBONE))


_CHANNELS = list(BACKBONE)
_AGE = "(CASE WHEN frame_id % 8 <= 1.5 THEN 1.0 WHEN frame_id % 8 >= 6 THEN 0.15 ELSE 1 - (frame_id % 8 - 1.5) / 4.5 * 0.85 END)"


@query(f"""WITH {_S}, f AS (SELECT *, {_GOES} * {_WEIGHT} AS resp FROM s),
b AS (SELECT frame_id, pr, pc, round(0.3 * {_AGE}, 9) AS w, v37 AS o_v37, h37 AS o_h37, v89 AS o_v89, h89 AS o_h89, {", ".join(_backbone_sql(c, *v) for c, v in BACKBONE.items())} FROM f),
m AS (SELECT frame_id, pr, pc, {", ".join(f"o_{c}, (0.1 * {c} + CASE WHEN o_{c} IS NULL THEN 0 ELSE w * o_{c} END) / (0.1 + CASE WHEN o_{c} IS NULL THEN 0 ELSE w END) AS f_{c}" for c in _CHANNELS)} FROM b)
SELECT frame_id, pr, pc, {", ".join(f"round(f_{c} - greatest(-5, least(5, avg(f_{c} - o_{c}) OVER (PARTITION BY frame_id))), 3) AS {c}" for c in _CHANNELS)} FROM m""")
def frame_pipeline(t: Tables) -> DataFrame:
    """Both polarisations of both frequencies for every frame: physics, observation by age, and bias."""
    return fields(storm(t.pixel)).select(*stencils.CELL, *(F.col(f"out_{c}").alias(c) for c in BACKBONE))


@query(f"""WITH {_S}, f AS (SELECT *, {_GOES} AS g, {_WEIGHT} AS w FROM (SELECT * FROM s))
SELECT frame_id, count(*) AS pixels, round(avg(g), 6) AS mean_signal, round(max(g * w), 6) AS peak, round(avg((g * w > 0.3)::INT), 6) AS active, count(v37) AS observed FROM f GROUP BY frame_id""")
def frame_diagnostics(t: Tables) -> DataFrame:
    """Figures of each frame for its record."""
    p = storm(t.pixel)
    g, w = C.scattering(F.col("ir")), C.radial_weight(F.col("r"), F.col("rmw"), F.col("vmax"), F.col("roci"))
    return p.groupBy("frame_id").agg(F.count("*").alias("pixels"), F.round(F.avg(g), 6).alias("mean_signal"), F.round(F.max(g * w), 6).alias("peak"), F.round(F.avg((g * w > 0.3).cast("int")), 6).alias("active"), F.count("v37").alias("observed"))


