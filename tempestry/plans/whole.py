"""The whole frame in one query: observation made ready, physics, texture, blend, bias, footprint and bounds.

Stencils run in tiles: one exchange for all that look at the inputs, one for the sensor's footprint, which looks at the
blended field. Between them stand only figures of a frame: medians, the texture's scale, the bias.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempestry.functions import columns as C
from tempestry.functions import constants as K
from tempestry.operators import stencils, tiles
from tempestry.operators.tables import kept, once, percentiles
from tempestry.plans.corrections import BANDS, HIGH_PASS, TEXTURE_CLIP, gaussian_sql
from tempestry.plans.fields import SHAPE, _FWHM, COL_KM, ROW_KM
from tempestry.plans.frames import _AGE
from tempestry.plans.observations import SPECKLE_K, WINDOW
from tempestry.plans.pixels import _GOES, _S, _WEIGHT, BACKBONE, _backbone_sql, storm
from tempestry.plans.registry import Tables, query, wrap

#: Channels of the query; the steps are the same for the others.
CHANNELS = ("v37", "v89")
# Texture (K) by channel, smoothing of the backbone (pixels), weights of backbone and observation, bias (K).
TEXTURE_K, BLUR, W_BACK, W_SEEN, BIAS_K = {"v37": 4.0, "v89": 7.0}, 1.2, 0.1, 0.3, 5.0
#: Where the pass's pixels lie beside the frame's (degrees), how far one may be taken from, and a pixel's side.
SHIFT, FAR, STEP = (0.03, 0.04), 0.25, 0.1
#: Footprint (pixels) of the sensor by channel.
FOOTPRINT = {c: tuple(km / _FWHM / step for km, step in zip(K.FOOTPRINT_KM["SSMIS"][int(c[1:])], (ROW_KM, COL_KM), strict=True)) for c in CHANNELS}


def _offsets() -> list[tuple[int, int]]:
    """Rows and columns to a pixel of the pass, the nearest first, as far as FAR."""
    reach = math.ceil((FAR + max(SHIFT)) / STEP)
    far = {(i, j): round(math.hypot(-STEP * i - SHIFT[0], STEP * j - SHIFT[1]), 9) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)}
    return [ij for ij in sorted(far, key=lambda ij: (far[ij], ij)) if far[ij] <= FAR]


OFFSETS = _offsets()
#: Speckle looks WINDOW pixels far before the regrid does; the high pass looks furthest.
HALO = max(tiles.reach_of(HIGH_PASS), tiles.reach_of(BLUR), WINDOW + max(abs(x) for ij in OFFSETS for x in ij))


def seen_and_smooth(w: tiles.Window) -> dict[str, np.ndarray]:
    """What looks at the inputs: speckle out, the pass on the frame's grid, the smooth backbone, the bands' fine part."""
    out = {}
    for c in CHANNELS:
        a = w.field(f"o_{c}")
        middle = w.field(f"med_{c}")[w.at][0]
        clean = np.where(np.abs(a - w.median(a, WINDOW, middle)) <= SPECKLE_K, a, np.nan)
        on_grid = np.full_like(a, np.nan)
        for i, j in reversed(OFFSETS):  # the nearest comes last and stays
            moved = np.full_like(a, np.nan)
            rows, cols = (slice(max(0, -k), w.size - max(0, k)) for k in (i, j))
            moved[rows, cols] = clean[max(0, i) : w.size + min(0, i), max(0, j) : w.size + min(0, j)]
            on_grid = np.where(np.isfinite(moved), moved, on_grid)
        out[f"s_{c}"], out[f"g_{c}"] = on_grid, w.gaussian(w.field(f"b_{c}"), BLUR, BLUR, "mirror")
    out["fine"] = sum(k * (w.field(b) - w.gaussian(w.field(b), HIGH_PASS, HIGH_PASS, "mirror")) for b, k in BANDS.items())
    return out


def through_footprint(w: tiles.Window) -> dict[str, np.ndarray]:
    return {f"p_{c}": w.gaussian(w.field(f"u_{c}"), *FOOTPRINT[c], "repeat") for c in CHANNELS}


def inputs(pixels: DataFrame) -> DataFrame:
    """frame_id, pr, pc, bands, age and, by channel, the observation within bounds (o), its frame's median (med) and the
    backbone (b), for pixels of storm()."""
    r, rmw, vmax = F.col("r"), F.col("rmw"), F.col("vmax")
    # step by step: as one expression it makes a method that the JVM doesn't compile
    p = pixels.select("*", once(F.struct(C.ring_width(rmw, vmax).alias("width"), C.envelope_km(vmax, F.col("roci")).alias("scale"))).alias("ring"))
    p = p.select("*", once(C.scattering(F.col("ir")) * C.radial_weight(r, rmw, vmax, F.col("roci"), F.col("ring.width"), F.col("ring.scale"))).alias("resp"))
    p = p.select("*", once(C.saturate(F.col("resp"))).alias("sat"))
    out = []
    for c in CHANNELS:
        bg, e, d, warm = BACKBONE[c]
        dg = 1 + C.gain("dep", c, vmax) + C.gain("out", c, vmax) * C.ramp(r / rmw, 1.5, 2.5) + C.gain("far", c, vmax) * C.ramp(r / rmw, 3.5, 5.0)
        p = p.select("*", once(F.struct(C.gain("em", c, vmax).alias("em"), C.scattering(F.col("ir"), warm).alias("scat"))).alias(f"t_{c}")).select("*", once(dg).alias(f"dg_{c}"))
        ice = C.ice_depth(F.col("lat")) if c.endswith("89") else F.lit(1.0)
        em, scat, sat = F.col(f"t_{c}.em"), F.col(f"t_{c}.scat"), F.col("sat")
        out.append(F.round(bg + e * (1 + em) * sat * (1 - scat) - d * F.col(f"dg_{c}") * sat * scat * ice, 5).alias(f"b_{c}"))
        out.append(F.when(F.col(c).between(*K.BOUNDS[c]), F.col(c)).alias(f"o_{c}"))
    p = kept(p.select(*stencils.CELL, *BANDS, *out), "inputs")
    for c in CHANNELS:
        p = p.join(percentiles(p, "frame_id", f"o_{c}", 0.5, f"med_{c}"), "frame_id", "left")
    return p


def whole(pixels: DataFrame) -> DataFrame:
    """frame_id, pr, pc and the channels of each frame, for pixels of storm(). A frame without an observation keeps the
    backbone with its texture; a pixel without one is blended from the backbone alone."""
    names = [*BANDS, *(f"{x}_{c}" for c in CHANNELS for x in ("o", "med", "b"))]
    first = kept(tiles.apply(inputs(pixels), names, tiles.SIDE, HALO, SHAPE, seen_and_smooth, ["fine", *(f"{x}_{c}" for c in CHANNELS for x in ("s", "g"))]), "first")
    first = first.withColumn("fine", F.round("fine", 9))
    scale = percentiles(first.withColumn("size", F.abs("fine")), "frame_id", "size", 0.95, "scale")
    p = first.join(scale, "frame_id", "left").withColumn("texture", F.when(F.coalesce("scale", F.lit(0.0)) < 1e-6, 0.0).otherwise(C.clip(F.col("fine") / F.col("scale"), -TEXTURE_CLIP, TEXTURE_CLIP)))
    weight = F.round(W_SEEN * C.age_confidence((F.col("frame_id") % 8).cast("double")), 9)
    for c in CHANNELS:
        w = F.when(F.col(f"s_{c}").isNotNull(), weight).otherwise(0.0)
        p = p.withColumn(f"u_{c}", (W_BACK * (F.col(f"g_{c}") + TEXTURE_K[c] * F.col("texture")) + w * F.coalesce(f"s_{c}", F.lit(0.0))) / (W_BACK + w))
    p = kept(p.select(*stencils.CELL, *(x for c in CHANNELS for x in (f"u_{c}", f"s_{c}"))), "blend")
    bias = p.groupBy("frame_id").agg(*(C.clip(F.coalesce(F.avg(F.col(f"u_{c}") - F.col(f"s_{c}")), F.lit(0.0)), -BIAS_K, BIAS_K).alias(f"bias_{c}") for c in CHANNELS))
    p = p.join(bias, "frame_id").select(*stencils.CELL, *((F.col(f"u_{c}") - F.col(f"bias_{c}")).alias(f"u_{c}") for c in CHANNELS))
    halo = max(tiles.reach_of(s) for c in CHANNELS for s in FOOTPRINT[c])
    out = tiles.apply(p, [f"u_{c}" for c in CHANNELS], tiles.SIDE, halo, SHAPE, through_footprint, [f"p_{c}" for c in CHANNELS])
    return out.select(*stencils.CELL, *(C.clip(F.col(f"p_{c}"), *K.BOUNDS[c]).alias(c) for c in CHANNELS))


def _clean_sql(c: str) -> str:
    n, m = SHAPE
    return f"""md_{c} AS (SELECT frame_id, quantile_cont(o_{c}, 0.5) AS med FROM ob WHERE o_{c} IS NOT NULL GROUP BY 1),
gd_{c} AS (SELECT f.frame_id, r.pr, k.pc, coalesce(o_{c}, med) AS v, o_{c} AS o FROM md_{c} f CROSS JOIN (SELECT unnest(range(0, {n})) AS pr) r CROSS JOIN (SELECT unnest(range(0, {m})) AS pc) k LEFT JOIN ob ON ob.frame_id = f.frame_id AND ob.pr = r.pr AND ob.pc = k.pc),
cl_{c} AS (SELECT a.frame_id, a.pr, a.pc, any_value(a.o) AS v, quantile_cont(b.v, 0.5) AS med FROM gd_{c} a, (SELECT unnest(range(-{WINDOW}, {WINDOW + 1})) AS i) i, (SELECT unnest(range(-{WINDOW}, {WINDOW + 1})) AS j) j, gd_{c} b
  WHERE a.o IS NOT NULL AND b.frame_id = a.frame_id AND b.pr = greatest(0, least({n - 1}, a.pr + i)) AND b.pc = greatest(0, least({m - 1}, a.pc + j)) GROUP BY 1, 2, 3),
sn_{c} AS (SELECT x.frame_id, x.pr, x.pc, arg_min(s.v, (round(sqrt(pow(p.lat - x.lat - {SHIFT[0]}, 2) + pow({wrap(f'p.lon - x.lon - {SHIFT[1]}')}, 2)), 9), s.pr, s.pc)) AS s_{c} FROM pixel x JOIN cl_{c} s ON s.frame_id = x.frame_id AND abs(s.pr - x.pr) <= 4 AND abs(s.pc - x.pc) <= 4 AND abs(s.v - s.med) <= {SPECKLE_K}
  JOIN pixel p ON p.frame_id = s.frame_id AND p.pr = s.pr AND p.pc = s.pc WHERE round(sqrt(pow(p.lat - x.lat - {SHIFT[0]}, 2) + pow({wrap(f'p.lon - x.lon - {SHIFT[1]}')}, 2)), 9) <= {FAR} GROUP BY 1, 2, 3)"""


def _sql() -> str:
    smooth = ", ".join(gaussian_sql("pixel", b, (HIGH_PASS, HIGH_PASS), SHAPE, "mirror", f"h_{b}") for b in BANDS)
    blur = ", ".join(gaussian_sql("bb", c, (BLUR, BLUR), SHAPE, "mirror", f"l_{c}") for c in CHANNELS)
    fine = " + ".join(f"{k} * ({b} - h_{b}.smooth)" for b, k in BANDS.items())
    blend = lambda c: f"({W_BACK} * (l_{c}.smooth + {TEXTURE_K[c]} * tx.texture) + CASE WHEN s_{c} IS NULL THEN 0 ELSE wt * s_{c} END) / ({W_BACK} + CASE WHEN s_{c} IS NULL THEN 0 ELSE wt END)"
    return f"""WITH {_S}, fr AS (SELECT *, {_GOES} * {_WEIGHT} AS resp FROM s), bb AS (SELECT frame_id, pr, pc, {", ".join(_backbone_sql(c, *BACKBONE[c]) for c in CHANNELS)} FROM fr),
ob AS (SELECT frame_id, pr, pc, {", ".join(f"CASE WHEN {c} BETWEEN {K.BOUNDS[c][0]} AND {K.BOUNDS[c][1]} THEN {c} END AS o_{c}" for c in CHANNELS)} FROM pixel),
{", ".join(_clean_sql(c) for c in CHANNELS)}, {smooth}, {blur},
hp AS (SELECT frame_id, pr, pc, round({fine}, 9) AS x FROM pixel {" ".join(f"JOIN h_{b} USING (frame_id, pr, pc)" for b in BANDS)}),
sc AS (SELECT frame_id, quantile_cont(abs(x), 0.95) AS scale FROM hp GROUP BY 1),
tx AS (SELECT frame_id, pr, pc, CASE WHEN scale < 1e-6 THEN 0 ELSE greatest(-{TEXTURE_CLIP}, least({TEXTURE_CLIP}, x / scale)) END AS texture, round({W_SEEN} * {_AGE}, 9) AS wt FROM hp JOIN sc USING (frame_id)),
un AS (SELECT frame_id, pr, pc, {", ".join(f"s_{c}, {blend(c)} AS u_{c}" for c in CHANNELS)} FROM tx {" ".join(f"JOIN l_{c} USING (frame_id, pr, pc) LEFT JOIN sn_{c} USING (frame_id, pr, pc)" for c in CHANNELS)}),
nb AS (SELECT frame_id, pr, pc, {", ".join(f"u_{c} - greatest(-{BIAS_K}, least({BIAS_K}, coalesce(avg(u_{c} - s_{c}) OVER (PARTITION BY frame_id), 0))) AS {c}" for c in CHANNELS)} FROM un),
{", ".join(gaussian_sql("nb", c, FOOTPRINT[c], SHAPE, "repeat", f"f_{c}") for c in CHANNELS)}
SELECT frame_id, pr, pc, {", ".join(f"round(greatest({K.BOUNDS[c][0]}, least({K.BOUNDS[c][1]}, f_{c}.smooth)), 3) AS {c}" for c in CHANNELS)} FROM nb {" ".join(f"JOIN f_{c} USING (frame_id, pr, pc)" for c in CHANNELS)}"""


@query(_sql())
def frame_whole(t: Tables) -> DataFrame:
    """Both frequencies of each frame with every step, its stencils in tiles."""
    return whole(storm(t.pixel)).select(*stencils.CELL, *(F.round(c, 3).alias(c) for c in CHANNELS))
