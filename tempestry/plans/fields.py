"""Fields of a frame: footprints, responses, texture, bounds and weights, each with the SQL of the same result."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempestry.functions import columns as C
from tempestry.functions import constants as K
from tempestry.operators import stencils, tiles
from tempestry.plans.corrections import gaussian_sql
from tempestry.plans.pixels import _DX, _DY, BACKBONE
from tempestry.plans.registry import Tables, clip, query

#: Kilometres between the rows and the columns of the pixel view.
ROW_KM, COL_KM = 0.1 * K.KM_DEG_DISTANCE, 0.1 * K.KM_DEG_DISTANCE * math.cos(math.radians(25.0))
_FWHM = 2 * math.sqrt(2 * math.log(2))
#: Rows and columns of the pixel view.
SHAPE = (48, 48)


_FOOTPRINTS = [(s, f, *km) for s, by in K.FOOTPRINT_KM.items() for f, km in by.items()]


@query(f"""WITH d AS (SELECT a.frame_id, median(b.lat - a.lat) AS d FROM pixel_many a JOIN pixel_many b ON a.frame_id = b.frame_id AND b.pr = a.pr + 1 AND b.pc = a.pc GROUP BY 1),
g AS (SELECT p.frame_id, coalesce(greatest(abs(any_value(d.d)) * {K.KM_DEG_DISTANCE}, 1e-6), 2.0) AS km, avg(p.lat) AS lat FROM pixel_many p LEFT JOIN d ON p.frame_id = d.frame_id GROUP BY 1),
f(sensor, frequency, across, along) AS (VALUES {", ".join(f"('{s}', {f}, {a}, {b})" for s, f, a, b in _FOOTPRINTS)}),
x AS (SELECT frame_id, sensor, frequency, across / {_FWHM} / km AS r, along / {_FWHM} / (km * cos(radians(lat))) AS c FROM g, f)
SELECT frame_id, sensor, frequency, round(CASE WHEN r > 0.5 THEN r ELSE 0 END, 6) AS sigma_rows, round(CASE WHEN c > 0.5 THEN c ELSE 0 END, 6) AS sigma_cols FROM x""")
def footprint_sigmas(t: Tables) -> DataFrame:
    """Deviations in pixels of each sensor's footprint on each frame's grid; the sensors are a fixed table."""
    p = t.pixel_many
    above = p.select("frame_id", (F.col("pr") - 1).alias("pr"), "pc", F.col("lat").alias("next"))
    step = p.join(above, stencils.CELL).groupBy("frame_id").agg(F.median(F.col("next") - F.col("lat")).alias("d"))
    grid = p.groupBy("frame_id").agg(F.avg("lat").alias("lat")).join(step, "frame_id", "left")
    spacing = F.when(F.col("d").isNull(), 2.0).otherwise(F.greatest(F.abs("d") * K.KM_DEG_DISTANCE, F.lit(1e-6)))
    sensors = F.array(*(F.struct(F.lit(s).alias("sensor"), F.lit(f).alias("frequency"), F.lit(a).alias("across"), F.lit(b).alias("along")) for s, f, a, b in _FOOTPRINTS))
    x = grid.select("frame_id", "lat", spacing.alias("km"), F.inline(sensors))
    return x.select(
        "frame_id", "sensor", "frequency",
        F.round(C.footprint_sigma(F.col("across"), F.col("km")), 6).alias("sigma_rows"),
        F.round(C.footprint_sigma(F.col("along"), F.col("km") * F.cos(F.radians("lat"))), 6).alias("sigma_cols"),
    )


_PSF = tuple(km / _FWHM / step for km, step in zip(K.FOOTPRINT_KM["SSMIS"][37], (ROW_KM, COL_KM), strict=True))


@query(f"WITH {gaussian_sql('pixel', 'v37', _PSF, SHAPE, 'repeat', 'smoothed')} SELECT frame_id, pr, pc, CASE WHEN v37 IS NOT NULL THEN round(smooth, 4) END AS v37 FROM pixel JOIN smoothed USING (frame_id, pr, pc)")
def sensor_psf(t: Tables) -> DataFrame:
    """A 37 GHz field as a coarse sensor sees it, its rim repeated; missing pixels stay missing and give no weight."""
    seen = tiles.gaussian(t.pixel, ["v37"], *_PSF, "repeat", SHAPE)
    return seen.select(*stencils.CELL, F.when(F.col("v37").isNotNull(), F.round("smooth_v37", 4)).alias("v37"))


_RESPONSE = clip("(270.0 - ir) / 80.0", 0, 1)
_LIQUID = (K.LIQUID_KM / ROW_KM, K.LIQUID_KM / COL_KM)


@query(f"""WITH z AS (SELECT frame_id, pr, pc, pow({_RESPONSE}, {K.RESPONSE_POWER[37]}) AS a, pow({_RESPONSE}, {K.RESPONSE_POWER[89]}) AS ice FROM pixel), {gaussian_sql('z', 'a', _LIQUID, SHAPE, 'repeat', 'smoothed')}
SELECT frame_id, pr, pc, round(greatest(0, least(1, smooth)), 5) AS response37, round(ice, 5) AS response89 FROM z JOIN smoothed USING (frame_id, pr, pc)""")
def frequency_response(t: Tables) -> DataFrame:
    """The convective response shaped for each frequency: broad and smooth at 37 GHz, concentrated at 89."""
    a = C.clip((270.0 - F.col("ir")) / 80.0, 0, 1)
    z = t.pixel.select(*stencils.CELL, F.pow(a, F.lit(K.RESPONSE_POWER[37])).alias("a"), F.pow(a, F.lit(K.RESPONSE_POWER[89])).alias("ice"))
    both = tiles.gaussian(z, ["a"], *_LIQUID, "repeat", SHAPE, ["ice"])
    return both.select(*stencils.CELL, F.round(C.clip(F.col("smooth_a"), 0, 1), 5).alias("response37"), F.round("ice", 5).alias("response89"))


@query(f"""WITH m AS (SELECT frame_id, avg(v37) AS mean FROM pixel GROUP BY 1), z AS (SELECT p.frame_id, pr, pc, v37, coalesce(v37, mean) AS a FROM pixel p JOIN m ON p.frame_id = m.frame_id), {gaussian_sql('z', 'a', (2.0, 2.0), SHAPE, 'mirror', 'smoothed')}
SELECT frame_id, round(stddev_pop(a - smooth) FILTER (v37 IS NOT NULL), 4) AS amplitude, count(v37) AS n FROM z JOIN smoothed USING (frame_id, pr, pc) GROUP BY 1""")
def texture_amplitude(t: Tables) -> DataFrame:
    """Deviation of the fine structure of an observed field: what is left of it without its Gaussian of two pixels."""
    mean = t.pixel.groupBy("frame_id").agg(F.avg("v37").alias("mean"))
    z = t.pixel.join(mean, "frame_id").select(*stencils.CELL, "v37", F.coalesce("v37", "mean").alias("a"))
    fine = F.when(F.col("v37").isNotNull(), F.col("a") - F.col("smooth_a"))
    found = tiles.gaussian(z, ["a"], 2.0, 2.0, "mirror", SHAPE, ["v37"])
    return found.groupBy("frame_id").agg(F.round(F.stddev_pop(fine), 4).alias("amplitude"), F.count("v37").alias("n"))


@query("""WITH s AS (SELECT frame_id, stddev_pop(wv - ir) AS sd FROM pixel_many GROUP BY 1)
SELECT p.frame_id, pr, pc, round(CASE WHEN sd > 1e-6 THEN (wv - ir) / sd ELSE wv - ir END, 4) AS texture FROM pixel_many p JOIN s ON p.frame_id = s.frame_id""")
def normalised_texture(t: Tables) -> DataFrame:
    """A pattern in units of its frame's deviation; a flat one stays as it is."""
    p = t.pixel_many.select(*stencils.CELL, (F.col("wv") - F.col("ir")).alias("x"))
    sd = p.groupBy("frame_id").agg(F.stddev_pop("x").alias("sd"))
    unit = F.when(F.col("sd") > 1e-6, F.col("x") / F.col("sd")).otherwise(F.col("x"))
    return p.join(sd, "frame_id").select(*stencils.CELL, F.round(unit, 4).alias("texture"))


_HEADING = "CASE WHEN frame_id % 5 = 0 THEN NULL ELSE 40.0 * (frame_id % 9) END"
_SOUTH = "CASE WHEN frame_id % 7 = 3 THEN -25.0 ELSE 25.0 END"


@query(f"""SELECT frame_id, pr, pc, round(CASE WHEN ({_HEADING}) IS NULL OR ({_SOUTH}) < 0 THEN 0 ELSE cos(radians(degrees(atan2({_DX}, {_DY})) - ({_HEADING}) - {K.ASYMMETRY_DEG})) END, 6) AS weight FROM pixel_many""")
def shear_asymmetry(t: Tables) -> DataFrame:
    """Weight of each pixel by its bearing from the deep-layer shear."""
    lat, cos = F.col("lat"), math.cos(math.radians(25.0))
    dx, dy = C.lon_delta(F.lit(179.0), F.col("lon")) * K.KM_DEG_DISTANCE * cos, (lat - 25.0) * K.KM_DEG_DISTANCE
    weight = C.shear_asymmetry(dx, dy, F.expr(_SOUTH), F.expr(_HEADING).cast("double"))
    return t.pixel_many.select(*stencils.CELL, F.round(weight, 6).alias("weight"))


_B = {c: BACKBONE[c] for c in ("v89", "h89")}
(_BV, _EV, _DV, _), (_BH, _EH, _DH, _) = _B["v89"], _B["h89"]
_DET = _EH * _DV - _EV * _DH


@query(f"""SELECT frame_id, pr, pc, CASE WHEN frame_id % 2 = 1 THEN CASE WHEN v89 IS NOT NULL THEN 0 END ELSE round({clip(f'-((v89 - {_BV}) * {_DH} - (h89 - {_BH}) * {_DV}) / {_DET}', 0, 4)}, 6) END AS emission,
CASE WHEN frame_id % 2 = 1 THEN round(({_BV} - v89) / {_DV}, 6) ELSE round({clip(f'-((v89 - {_BV}) * {_EH} - (h89 - {_BH}) * {_EV}) / {_DET}', 0, 4)}, 6) END AS scattering FROM pixel_many""")
def recover_weights_89(t: Tables) -> DataFrame:
    """Emission and scattering weights at 89 GHz; where the two channels can't be told apart (odd frames), scattering alone."""
    dv, dh, same = F.col("v89") - _BV, F.col("h89") - _BH, F.col("frame_id") % 2 == 1
    emission, scattering = (C.clip(-(dv * y - dh * x) / _DET, 0, 4) for x, y in ((_DV, _DH), (_EV, _EH)))
    return t.pixel_many.select(
        *stencils.CELL,
        F.when(same, F.when(F.col("v89").isNotNull(), 0.0)).otherwise(F.round(emission, 6)).alias("emission"),
        F.round(F.when(same, -dv / _DV).otherwise(scattering), 6).alias("scattering"),
    )


@query("SELECT frame_id, pr, pc, " + ", ".join(f"CASE WHEN {c} BETWEEN {a} AND {b} THEN {c} END AS {c}" for c, (a, b) in K.BOUNDS.items()) + " FROM pixel_many")
def bounded_fields(t: Tables) -> DataFrame:
    """The channels without the values that no scene has."""
    return t.pixel_many.select(*stencils.CELL, *(F.when(F.col(c).between(a, b), F.col(c)).alias(c) for c, (a, b) in K.BOUNDS.items()))


@query("""WITH x AS (SELECT frame_id, (pr * 3 + pc) % 11 = 0 OR v89 IS NULL OR NOT isfinite(v89) OR ir >= 285 AS bad FROM pixel_many)
SELECT frame_id, count(*) AS pixels, round(avg(bad::INT), 6) AS bad_fraction, bool_and(bad) AS nothing_left FROM x GROUP BY 1""")
def quality_mask(t: Tables) -> DataFrame:
    """Share of each frame's pixels that a flag, a missing value or another channel rules out."""
    x = F.col("v89")
    bad = ((F.col("pr") * 3 + F.col("pc")) % 11 == 0) | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (F.col("ir") >= 285)
    flagged = t.pixel_many.select("frame_id", bad.alias("bad"))
    return flagged.groupBy("frame_id").agg(
        F.count("*").alias("pixels"), F.round(F.avg(F.col("bad").cast("int")), 6).alias("bad_fraction"), F.bool_and("bad").alias("nothing_left")
    )


@query("""WITH b AS (SELECT frame_id, pr, pc, CASE WHEN frame_id % 2 = 0 THEN lat + 0.05 END AS lat37, lat, CASE WHEN frame_id % 2 = 0 THEN lon - 0.05 END AS lon37, lon FROM pixel_many)
SELECT frame_id, pr, pc, round(coalesce(lat37, lat), 6) AS lat37, round(coalesce(lon37, lon), 6) AS lon37, round(lat, 6) AS lat89, round(lon, 6) AS lon89 FROM b""")
def frequency_grid(t: Tables) -> DataFrame:
    """Positions by frequency: a channel's own grid where it has one, else the shared one."""
    own = F.col("frame_id") % 2 == 0
    lat, lon = F.when(own, F.col("lat") + 0.05), F.when(own, F.col("lon") - 0.05)
    return t.pixel_many.select(
        *stencils.CELL, F.round(F.coalesce(lat, "lat"), 6).alias("lat37"), F.round(F.coalesce(lon, "lon"), 6).alias("lon37"),
        F.round("lat", 6).alias("lat89"), F.round("lon", 6).alias("lon89"),
    )
