"""Gains of a backbone's levers: bounded fits by intensity band, scored by zone and out of sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempestry.operators import fits
from tempestry.operators.tables import kept, ranked, shared_path
from tempestry.plans.pixels import _S, storm
from tempestry.plans.registry import Tables, query

# Levers and their bounds (gain, kelvin), radial zones in eyewall radii, and the zones that are fitted.
BOUNDS = {"dep": (-1.0, 3.0), "bg": (-20.0, 20.0)}
ZONES = (("core", 0.0, 2.0), ("bands", 2.0, 4.0), ("outer", 4.0, 8.0), ("env", 8.0, float("inf")))
FIT_ZONES = ("core", "bands", "outer")
#: Intensity bands (kt) of separate gains.
BANDS = (0, 34, 50, 64, 83, 96, 113, 999)
#: The guard on signal: pixels that a lever must move, and storms they are in; the query's frames are small.
LEAST_PIXELS, LEAST_STORMS = 40, 1
KEYS = ["channel", "band"]
EXAMPLE = ["example_id", "storm_id", "band", "channel", "zone"]

_ZONE = "CASE " + " ".join(f"WHEN r / rmw < {hi} THEN '{z}'" for z, _, hi in ZONES[:-1]) + " ELSE 'env' END"
_BAND = "CASE " + " ".join(f"WHEN vmax < {hi} THEN {lo}" for lo, hi in zip(BANDS, BANDS[1:], strict=False)) + " END"


def _rows(t: Tables) -> DataFrame:
    """example_id, storm_id, band, channel, zone, target, backbone, ice of each pixel: v37 and v89, one row each."""
    p = storm(t.pixel).withColumn("zone", F.expr(_ZONE)).withColumn("band", F.expr(_BAND))
    channels = F.explode(F.array(F.struct(F.lit("v37").alias("channel"), F.col("v37").alias("target"), F.lit(230.0).alias("backbone")), F.struct(F.lit("v89").alias("channel"), F.col("v89").alias("target"), F.lit(222.0).alias("backbone"))))
    return p.select(F.col("frame_id").alias("example_id"), (F.col("frame_id") % 5).alias("storm_id"), "band", "zone", channels.alias("c"), ((F.col("ir") - 220) / 4).alias("ice")).select("*", "c.*").drop("c")


def _moments(rows: DataFrame) -> DataFrame:
    return fits.moments(rows, EXAMPLE, F.col("target") - F.col("backbone"), [F.col("ice"), F.lit(1.0)])


_SUMS = f"""{_S}, px AS (SELECT frame_id AS example_id, frame_id % 5 AS storm_id, {_BAND} AS band, {_ZONE} AS zone, unnest([{{'channel': 'v37', 'r': v37 - 230}}, {{'channel': 'v89', 'r': v89 - 222}}], recursive := true), (ir - 220) / 4.0 AS k FROM s),
ex AS (SELECT example_id, storm_id, band, channel, zone, count(*) AS n, sum(r * r) AS r2, sum(k * r) AS b1, sum(r) AS b2, sum(k * k) AS a11, sum(k) AS a12, count(*) FILTER (abs(k) > {fits.AFFECTED_K}) AS f1 FROM px WHERE r IS NOT NULL AND k IS NOT NULL GROUP BY ALL)"""


def _solved(source: str) -> str:
    """SQL of the two gains within their bounds, zones balanced: the free optimum, or else the best of the four walls."""
    (l1, h1), (l2, h2) = BOUNDS.values()
    guard = f"f1 >= {LEAST_PIXELS} AND st1 >= {LEAST_STORMS} AND a11 > 0", f"n2 >= {LEAST_PIXELS} AND st2 >= {LEAST_STORMS}"
    wall1 = lambda g: f"{{'g1': {g}::DOUBLE, 'g2': greatest({l2}, least({h2}, (b2 - a12 * {g}) / a22))}}"
    wall2 = lambda g: f"{{'g1': greatest({l1}, least({h1}, (b1 - a12 * {g}) / a11)), 'g2': {g}::DOUBLE}}"
    cost = "a11 * w.g1 * w.g1 + 2 * a12 * w.g1 * w.g2 + a22 * w.g2 * w.g2 - 2 * b1 * w.g1 - 2 * b2 * w.g2"
    return f"""zn AS (SELECT channel, band, zone, sum(n) AS n, sum(b1) AS b1, sum(b2) AS b2, sum(a11) AS a11, sum(a12) AS a12, sum(f1) AS f1, count(DISTINCT storm_id) FILTER (f1 > 0) AS st1, count(DISTINCT storm_id) AS st2 FROM {source} GROUP BY ALL),
pl AS (SELECT channel, band, sum(b1 / n) AS b1, sum(b2 / n) AS b2, sum(a11 / n) AS a11, sum(a12 / n) AS a12, count(*)::DOUBLE AS a22, sum(f1) AS f1, sum(n) AS n2, max(st1) AS st1, max(st2) AS st2 FROM zn WHERE zone <> 'env' GROUP BY ALL),
gd AS (SELECT *, {guard[0]} AS use1, {guard[1]} AS use2, a11 * a22 - a12 * a12 AS det FROM pl),
fr AS (SELECT *, (b1 * a22 - b2 * a12) / det AS x1, (b2 * a11 - b1 * a12) / det AS x2 FROM gd),
wl AS (SELECT channel, band, arg_min(w, {cost}) AS w FROM (SELECT *, unnest([{wall1(l1)}, {wall1(h1)}, {wall2(l2)}, {wall2(h2)}]) AS w FROM fr WHERE use1 AND use2) GROUP BY ALL),
ft AS (SELECT fr.channel, fr.band, CASE WHEN use1 AND use2 THEN CASE WHEN x1 BETWEEN {l1} AND {h1} AND x2 BETWEEN {l2} AND {h2} THEN x1 ELSE w.g1 END WHEN use1 THEN greatest({l1}, least({h1}, b1 / a11)) END AS dep,
  CASE WHEN use1 AND use2 THEN CASE WHEN x1 BETWEEN {l1} AND {h1} AND x2 BETWEEN {l2} AND {h2} THEN x2 ELSE w.g2 END WHEN use2 THEN greatest({l2}, least({h2}, b2 / a22)) END AS bg FROM fr LEFT JOIN wl ON fr.channel = wl.channel AND fr.band = wl.band)"""


_ERROR = "sqrt(greatest(0, sum(r2) - 2 * coalesce(dep, 0) * sum(b1) - 2 * coalesce(bg, 0) * sum(b2) + coalesce(dep, 0) ** 2 * sum(a11) + 2 * coalesce(dep, 0) * coalesce(bg, 0) * sum(a12) + coalesce(bg, 0) ** 2 * sum(n)) / sum(n))"


def _at(j: int) -> str:
    low, high = list(BOUNDS.values())[j]
    name = list(BOUNDS)[j]
    return f"coalesce(abs({name} - ({low})) < 1e-9 OR abs({name} - ({high})) < 1e-9, FALSE)"


@query(f"""WITH {_SUMS}, {_solved('ex')}
SELECT channel, band, zone, sum(n)::BIGINT AS n, round(dep, 4) AS dep, round(bg, 4) AS bg, {_at(0)} AS dep_clipped, {_at(1)} AS bg_clipped, round(sqrt(sum(r2) / sum(n)), 4) AS before, round({_ERROR}, 4) AS after
FROM ex LEFT JOIN ft USING (channel, band) GROUP BY channel, band, zone, dep, bg""")
def lever_fit(t: Tables) -> DataFrame:
    """Gains of each intensity band and channel, which are at a bound, and each zone's error before and after.

    The examples' moments are stored in two versions, then read back and summed: the pixels aren't seen again.
    """
    path, rows = shared_path(t.spark, "sweep"), _rows(t)
    fits.store(_moments(rows.where("example_id % 2 = 0")), path)
    fits.store(_moments(rows.where("example_id % 2 = 1")), path)
    zones = fits.summed(fits.stored(t.spark, path, EXAMPLE), [*KEYS, "zone"], len(BOUNDS))
    found = kept(fits.fitted(zones, KEYS, BOUNDS, FIT_ZONES, LEAST_PIXELS, LEAST_STORMS), "fits")
    e = fits.errors(zones, found, KEYS).join(found, KEYS, "left")
    gain = lambda j: F.round(F.get("gains", F.lit(j)), 4)
    clipped = lambda j: F.coalesce(F.get("at_bound", F.lit(j)), F.lit(False))
    return e.select(*KEYS, "zone", "n", gain(0).alias("dep"), gain(1).alias("bg"), clipped(0).alias("dep_clipped"), clipped(1).alias("bg_clipped"), F.round("before", 4).alias("before"), F.round("after", 4).alias("after"))


_HALF = "(dense_rank() OVER (ORDER BY storm_id) - 1) % 2"


@query(f"""WITH {_SUMS}, hv AS (SELECT *, {_HALF} AS half FROM ex), h0 AS (SELECT * FROM hv WHERE half = 0), h1 AS (SELECT * FROM hv WHERE half = 1),
f0 AS (WITH {_solved('h0')} SELECT 1 AS half, * FROM ft), f1 AS (WITH {_solved('h1')} SELECT 0 AS half, * FROM ft), ff AS (SELECT * FROM f0 UNION ALL SELECT * FROM f1),
sc AS (SELECT half, channel, zone, sum(n) AS n, sum(r2) AS r2, sum(r2 - 2 * coalesce(dep, 0) * b1 - 2 * coalesce(bg, 0) * b2 + coalesce(dep, 0) ** 2 * a11 + 2 * coalesce(dep, 0) * coalesce(bg, 0) * a12 + coalesce(bg, 0) ** 2 * n) AS s2
  FROM hv LEFT JOIN ff USING (half, channel, band) WHERE zone <> 'env' GROUP BY ALL)
SELECT half::INT AS half, channel, zone, n::BIGINT AS n, round(sqrt(r2 / n), 4) AS before, round(sqrt(greatest(0, s2) / n), 4) AS after FROM sc""")
def lever_sweep(t: Tables) -> DataFrame:
    """Errors by zone of each half of the storms with the gains that the other half gave, each band its own."""
    stats = kept(_moments(_rows(t)), "sweep")
    storms = ranked(stats.select("storm_id").distinct(), "storm_id").select("storm_id", ((F.col("k") - 1) % 2).cast("int").alias("half"))
    halves = stats.join(storms, "storm_id")
    zones = fits.summed(halves, ["half", *KEYS, "zone"], len(BOUNDS))
    found = fits.fitted(zones, ["half", *KEYS], BOUNDS, FIT_ZONES, LEAST_PIXELS, LEAST_STORMS)
    other = found.withColumn("half", 1 - F.col("half"))
    e = fits.errors(zones.where(F.col("zone").isin(*FIT_ZONES)), other, ["half", *KEYS])
    square = lambda c: F.round(F.sqrt(F.sum(F.col(c) * F.col(c) * F.col("n")) / F.sum("n")), 4)
    return e.groupBy("half", "channel", "zone").agg(F.sum("n").alias("n"), square("before").alias("before"), square("after").alias("after"))
