"""What the whole frame's steps cost: methods that the JVM compiles, and each pixel in one tile of a frame of this size."""

import pytest

from tempestry.operators import tiles
from tempestry.plans import catalogue, fields, observations, whole
from tempestry.plans.pixels import storm
from tempestry.plans.views import view


class Stop(Exception):
    pass


def stopped_at(monkeypatch, module, name):
    """What the first call of module.name is asked for."""
    asked = []

    def stop(*args):
        asked.extend(args)
        raise Stop

    monkeypatch.setattr(module, name, stop)
    return asked


def test_formulas_are_methods_that_the_jvm_compiles(spark, monkeypatch):
    """It leaves methods of 8000 bytes and more to its interpreter."""
    asked = stopped_at(monkeypatch, whole, "kept")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with pytest.raises(Stop):
            whole.inputs(storm(view(spark, "/root/testdata/sf0.001", "pixel")))
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        found = debug.codegenStringSeq(asked[0]._jdf.queryExecution().executedPlan())
        sizes = [found.apply(i)._3().maxMethodCodeSize() for i in range(found.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and 0 < max(sizes) < 8000


def test_a_frame_of_this_size_is_one_tile(spark, monkeypatch):
    asked = stopped_at(monkeypatch, tiles, "apply")
    with pytest.raises(Stop):
        whole.whole(storm(view(spark, "/root/testdata/sf0.001", "pixel")))
    assert asked[2] >= max(fields.SHAPE)


def test_ice_coupling_makes_its_pixels_once(spark, monkeypatch):
    """The percentiles' rounds read a table of them, not the view again and again."""
    asked = stopped_at(monkeypatch, observations, "percentiles")
    with pytest.raises(Stop):
        catalogue.queries()["ice_coupling"](spark, "/root/testdata/sf0.001")
    assert "Aggregate" not in asked[0]._jdf.queryExecution().optimizedPlan().toString()
