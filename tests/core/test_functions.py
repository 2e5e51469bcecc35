"""Hand-computed values of the formulas, and NULL rules."""

import pytest
from pyspark.sql import functions as F

from tempestry.functions import columns as C
from tempestry.functions import constants as K


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


D = lambda x: F.lit(None if x is None else float(x)).cast("double")

CASES = {
    "wrap": (lambda: C.wrap180(D(540)), -180), "delta over the date line": (lambda: C.lon_delta(D(179.5), D(-179.5)), 1), "pct 37": (lambda: C.pct(D(250), D(200), K.PCT_THETA[37]), 307.5),
    "pct 37 in the composite": (lambda: C.pct(D(250), D(200), K.RED_THETA[37]), 309.05), "pct 89": (lambda: C.pct(D(250), D(240), K.PCT_THETA[89]), 257.0), "pct 89 in the composite": (lambda: C.pct(D(250), D(240), K.RED_THETA[89]), 258.18),
    "no scattering": (lambda: C.scattering(D(273)), 0), "half": (lambda: C.scattering(D(229)), 0.5), "full": (lambda: C.scattering(D(185)), 1), "clip of null": (lambda: C.clip(D(None), 0, 1), None),
    "age 1.5": (lambda: C.age_confidence(D(1.5)), 1), "age 3.75": (lambda: C.age_confidence(D(3.75)), 0.575), "age 6": (lambda: C.age_confidence(D(6)), 0.15),
    "crossfade 0": (lambda: C.crossfade_confidence(D(0)), 1), "crossfade 15": (lambda: C.crossfade_confidence(D(15)), 0.75), "crossfade 60": (lambda: C.crossfade_confidence(D(60)), 0),
    "pack": (lambda: C.pack(D(200.005)), 20000), "pack null": (lambda: C.pack(D(None)), 0), "unpack 0": (lambda: C.unpack(F.lit(0)), None),
    "novelty 1": (lambda: C.novelty_scale(D(1)), 1), "novelty 1.75": (lambda: C.novelty_scale(D(1.75)), 0.625), "novelty 2.5": (lambda: C.novelty_scale(D(2.5)), 0.25),
    "tilt 20": (lambda: C.tilted_radius(D(20)), 27), "tilt 40": (lambda: C.tilted_radius(D(40)), 50), "saturated": (lambda: C.saturate(D(1)), 1), "knots clamp": (lambda: C.gain("out", "v89", D(10)), 3.0),
    "ice at the equator": (lambda: C.ice_depth(D(0)), 1), "wind at the radius": (lambda: C.surface_wind(D(40), D(100), D(40)), 51.4444), "ambient wind": (lambda: C.surface_wind(D(0), D(100), D(40)), 7.0),
}


@pytest.mark.parametrize("name", CASES)
def test_value(spark, name):
    column, expected = CASES[name]
    assert value(spark, column()) == (None if expected is None else pytest.approx(expected))


def test_segments_have_gaps(spark):
    assert value(spark, C.segment_colour(D(228.05), "h89")) == [0, 0, 0]
    assert value(spark, C.segment_colour(D(105), "h89")) == pytest.approx([1, 1, 1])
    assert value(spark, C.segment_colour(D(None), "h89")) == [0, 0, 0]
