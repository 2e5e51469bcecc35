"""Which storms, passes and examples count, and how much: splits, subsets, weights, pairs of passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.functions import columns as C
from tempestry.operators import asof
from tempestry.operators.tables import ranked
from tempestry.plans.registry import Tables, distance, query
from tempestry.plans.tracks import _BRACKET, _LON

# Share of a band's storms held out, and the shares of a learning curve.
HELD_OUT, CURVE = 0.15, (0.25, 0.5, 0.75, 1.0)
# Past intensification (kt in 24 h) and shear (m/s) that count more, by how much, the cap, and the share of
# examples that must know their environment.
RI_KT, RI_WEIGHT, SHEAR_MS, SHEAR_WEIGHT, WEIGHT_CAP, LEAST_KNOWN = 30.0, 3.0, 10.0, 2.0, 4.0, 0.5
# A pass hits within so many km of the centre, and counts so many hours before and after a time.
CORE_KM, BACK_H, AHEAD_H = 75.0, 12.0, 3.0

_BAND = "CASE WHEN peak < 34 THEN 'TD' WHEN peak < 64 THEN 'TS' WHEN peak < 96 THEN 'C1-2' ELSE 'C3-5' END"
_SPLIT = f"""pk AS (SELECT storm_id, max(vmax_kt) - 60 - storm_id % 60 AS peak FROM track GROUP BY 1), bd AS (SELECT storm_id, {_BAND} AS band FROM pk),
rk AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5('42-' || storm_id), storm_id) AS k, count(*) OVER (PARTITION BY band) AS n FROM bd),
sp AS (SELECT storm_id, band, CASE WHEN n > 1 AND k <= greatest(1, round_even({HELD_OUT}::DOUBLE * n, 0)) THEN 'val' ELSE 'train' END AS split FROM rk)"""


def seeded(seed: str, key: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))


def split(peaks: DataFrame, seed: str = "42-") -> DataFrame:
    """storm_id, band, split from storm_id and peak (kt): of each intensity band 0.15 of the storms, rounded to even and
    one at least, are held out; a band of one storm isn't. Ranks within the four bands come from one range sort."""
    banded = peaks.select("storm_id", C.intensity_band(F.col("peak")).alias("band"), seeded(seed, "storm_id").alias("h"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("m"))  # four rows
    sizes = sizes.withColumn("before", F.sum("m").over(Window.orderBy("band")) - F.col("m"))
    r = ranked(banded, "band", "h", "storm_id").join(F.broadcast(sizes), "band")
    held = F.when(F.col("m") > 1, F.greatest(F.lit(1.0), F.rint(HELD_OUT * F.col("m")))).otherwise(0.0)
    return r.select("storm_id", "band", F.when(F.col("k") - F.col("before") <= held, "val").otherwise("train").alias("split"))


def _peaks(t: Tables) -> DataFrame:
    return t.track.groupBy("storm_id").agg(F.max("vmax_kt").alias("peak")).select("storm_id", (F.col("peak") - 60 - F.col("storm_id") % 60).alias("peak"))


@query(f"WITH {_SPLIT} SELECT * FROM sp")
def storm_split(t: Tables) -> DataFrame:
    """Whole storms to training or validation, from each intensity band in a seeded order."""
    return split(_peaks(t))


@query(f"""WITH {_SPLIT}, tr AS (SELECT storm_id, row_number() OVER (ORDER BY md5('42c' || storm_id), storm_id) AS k, row_number() OVER (ORDER BY storm_id) AS o, count(*) OVER () AS n FROM sp WHERE split = 'train')
SELECT storm_id, CASE {" ".join(f"WHEN k <= greatest(1, round_even({x}::DOUBLE * n, 0)) THEN {x}" for x in CURVE)} END::DOUBLE AS first_fraction, ((o - 1) % 2)::INT AS half FROM tr""")
def nested_subsets(t: Tables) -> DataFrame:
    """The smallest subset of the learning curve that holds each training storm, and its half by order of storms."""
    storms = split(_peaks(t)).where("split = 'train'").select("storm_id")
    order = ranked(storms.withColumn("h", seeded("42c", "storm_id")), "h", "storm_id")
    part = F.when(F.lit(False), None)
    for x in CURVE:
        part = part.when(F.col("k") <= F.greatest(F.lit(1.0), F.rint(x * F.col("n"))), x)
    halves = ranked(storms, "storm_id").select("storm_id", ((F.col("k") - 1) % 2).cast("int").alias("half"))
    return order.select("storm_id", part.alias("first_fraction")).join(halves, "storm_id")


_KNOWN = "(basin <> 'AL' OR fix_id % 3 = 0)"


@query(f"""WITH w AS (SELECT t.fix_id, t.basin, {_KNOWN.replace('basin', 't.basin').replace('fix_id', 't.fix_id')} AS known, t.vmax_kt - p.vmax_kt AS dv, t.fix_id % 25 AS shear FROM track t ASOF LEFT JOIN track p ON p.storm_id = t.storm_id AND p.valid_time <= t.valid_time - INTERVAL 24 HOUR)
SELECT fix_id, CASE WHEN avg(known::INT) OVER (PARTITION BY basin) >= {LEAST_KNOWN} THEN CASE WHEN known THEN least({WEIGHT_CAP}, CASE WHEN dv >= {RI_KT} THEN {RI_WEIGHT} ELSE 1 END * CASE WHEN shear >= {SHEAR_MS} THEN {SHEAR_WEIGHT} ELSE 1 END) ELSE 1 END END::DOUBLE AS weight FROM w""")
def regime_weights(t: Tables) -> DataFrame:
    """Sampling weights within each basin: more for past intensification and for shear. None at all for a basin where
    fewer than half of the fixes know their environment: it would only tell which these are."""
    ago = t.track.select("storm_id", (F.col("valid_time") - F.expr("interval 24 hours")).alias("valid_time"), "fix_id", "basin", F.col("vmax_kt").alias("now"))
    x = asof.bracket(ago, t.track, ["storm_id"], "valid_time", ["fix_id", "basin", "now"], ["vmax_kt"]).withColumn("known", F.expr(_KNOWN))
    times = lambda when, w: F.when(F.coalesce(when, F.lit(False)), w).otherwise(1.0)
    weight = F.least(F.lit(WEIGHT_CAP), times(F.col("now") - F.col("f0.vmax_kt") >= RI_KT, RI_WEIGHT) * times(F.col("fix_id") % 25 >= SHEAR_MS, SHEAR_WEIGHT))
    share = t.track.groupBy("basin").agg(F.avg(F.expr(_KNOWN).cast("int")).alias("share"))  # a row for each basin
    return x.join(F.broadcast(share), "basin").select("fix_id", F.when(F.col("share") >= LEAST_KNOWN, F.when(F.col("known"), weight).otherwise(1.0)).alias("weight"))


def hits(t: Tables) -> DataFrame:
    """storm_id, valid_time, pass_id of the passes whose nearest pixel is within CORE_KM of the storm then."""
    at = asof.interpolated(t.overpass, t.track, ["pass_id", "sensor"])
    d = C.distance_km(F.col("lat") + ((F.col("pass_id") % 21) - 10) / 10.0, F.col("lon") + ((F.col("pass_id") % 13) - 6) / 10.0, F.col("lat"), F.col("lon"))
    return at.where(d <= CORE_KM).select("storm_id", F.col("t").alias("valid_time"), "pass_id")


@query(f"""WITH {_BRACKET}, pos AS (SELECT pass_id, storm_id, scene_time, lat0 + (lat1 - lat0) * r AS lat, {_LON} AS lon FROM x),
hit AS (SELECT * FROM pos WHERE {distance('lat + ((pass_id % 21) - 10) / 10.0', 'lon + ((pass_id % 13) - 6) / 10.0', 'lat', 'lon')} <= {CORE_KM})
SELECT t.fix_id, CASE WHEN epoch_us(t.valid_time) - epoch_us(b.scene_time) <= {int(BACK_H * 3.6e9)} THEN b.pass_id END AS before_id, CASE WHEN epoch_us(a.scene_time) - epoch_us(t.valid_time) <= {int(AHEAD_H * 3.6e9)} THEN a.pass_id END AS after_id FROM track t
ASOF LEFT JOIN hit b ON b.storm_id = t.storm_id AND b.scene_time <= t.valid_time
ASOF LEFT JOIN hit a ON a.storm_id = t.storm_id AND a.scene_time >= t.valid_time""")
def crossfade_pair(t: Tables) -> DataFrame:
    """For each fix, the last pass of any sensor that hit the storm in the 12 hours before, the first in the 3 after."""
    found = asof.bracket(t.track, hits(t), ["storm_id"], "valid_time", ["fix_id"], ["pass_id"])
    near = lambda f, gap, limit: F.when(gap <= limit, F.col(f"{f}.pass_id"))
    return found.select(
        "fix_id", near("f0", C.hours_between(F.col("f0.t"), F.col("t")), BACK_H).alias("before_id"), near("f1", C.hours_between(F.col("t"), F.col("f1.t")), AHEAD_H).alias("after_id")
    )
