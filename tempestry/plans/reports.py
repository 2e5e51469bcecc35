"""Figures and texts for records and logs, and checks of stored examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempestry.functions import columns as C
from tempestry.functions import constants as K
from tempestry.operators import asof
from tempestry.plans import analyses, guards, pixels, stages  # noqa: F401  (their queries are read here)
from tempestry.plans.registry import QUERIES, SQL, Tables, query, wrap
from tempestry.plans.tracks import _BRACKET, _LON


def _of(t: Tables, name: str) -> DataFrame:
    return QUERIES[name](t.spark, t.sf_dir)


def _number(x: str, places: int = 1, sign: str = "") -> str:
    return f"printf('%{sign}.{places}f', round({x}, {places}))"


def _text(x: str, places: int = 1, sign: str = "") -> F.Column:
    return F.format_string(f"%{sign}.{places}f", F.round(F.col(x).cast("double"), places))


_STATE = f"""SELECT 37 + 52 * (event_id % 2) AS frequency, greatest(-{K.OFFSET_BOUND_K}, least({K.OFFSET_BOUND_K}, round(avg(value) - 14, 6))) AS offset_k, count(*) AS n
FROM events WHERE event_type = 'purchase' GROUP BY 1"""


def _state(t: Tables) -> DataFrame:
    """Calibration offsets: one row a frequency, two at most."""
    rows = t.events.where("event_type = 'purchase'").groupBy((37 + 52 * (F.col("event_id") % 2)).alias("frequency"))
    return rows.agg(C.clip(F.round(F.avg("value") - 14, 6), -K.OFFSET_BOUND_K, K.OFFSET_BOUND_K).alias("offset_k"), F.count("*").alias("n"))


@query(f"""WITH s AS ({_STATE}), o AS (SELECT max(offset_k) FILTER (frequency = 37) AS o37, max(offset_k) FILTER (frequency = 89) AS o89 FROM s)
SELECT frame_id, pr, pc, round(v37 - coalesce(o37, 0), 4) AS v37, round(v89 - coalesce(o89, 0), 4) AS v89 FROM pixel_many, o""")
def offset_applied(t: Tables) -> DataFrame:
    """Fields without the offsets that calibration has found; the state is one row, so it's broadcast."""
    one = _state(t).agg(*(F.coalesce(F.max(F.when(F.col("frequency") == f, F.col("offset_k"))), F.lit(0.0)).alias(f"o{f}") for f in (37, 89)))
    p = t.pixel_many.crossJoin(F.broadcast(one))
    return p.select("frame_id", "pr", "pc", *(F.round(F.col(f"v{f}") - F.col(f"o{f}"), 4).alias(f"v{f}") for f in (37, 89)))


@query(f"""WITH s AS ({_STATE}) SELECT frequency, frequency || ' GHz: offset=' || {_number('offset_k', 1, '+')} || 'K over ' || n || ' update(s)' ||
CASE WHEN abs(offset_k) >= {0.9 * K.OFFSET_BOUND_K} THEN ' at the bound' ELSE '' END AS summary FROM s""")
def calibration_status(t: Tables) -> DataFrame:
    """The offsets in words, with a warning from nine tenths of the bound on."""
    at_bound = F.when(F.abs("offset_k") >= 0.9 * K.OFFSET_BOUND_K, " at the bound").otherwise("")
    parts = (F.col("frequency").cast("string"), F.lit(" GHz: offset="), _text("offset_k", 1, "+"), F.lit("K over "), F.col("n").cast("string"), F.lit(" update(s)"), at_bound)
    return _state(t).select("frequency", F.concat(*parts).alias("summary"))


@query(f"""WITH d AS (SELECT frame_id, v37 - ir AS d FROM pixel_many), s AS (SELECT frame_id, avg(d) AS b, sqrt(avg(d * d)) AS e, count(d) AS n FROM d GROUP BY 1)
SELECT frame_id, CASE WHEN n = 0 THEN 'no overlapping finite pixels' ELSE 'bias=' || {_number('b', 1, '+')} || 'K, RMSE=' || {_number('e')} || 'K, n=' || n END AS summary FROM s""")
def comparison_text(t: Tables) -> DataFrame:
    """Bias and error of each frame in words."""
    d = t.pixel_many.select("frame_id", (F.col("v37") - F.col("ir")).cast("double").alias("d"))
    s = d.groupBy("frame_id").agg(F.avg("d").alias("b"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("e"), F.count("d").alias("n"))
    words = F.concat(F.lit("bias="), _text("b", 1, "+"), F.lit("K, RMSE="), _text("e"), F.lit("K, n="), F.col("n").cast("string"))
    return s.select("frame_id", F.when(F.col("n") == 0, "no overlapping finite pixels").otherwise(words).alias("summary"))


@query(f"""SELECT frame_id, CASE WHEN secondary_km IS NULL THEN 'no secondary eyewall' ELSE 'confidence ' || {_number('confidence', 2)} || ', primary ' || {_number('primary_km', 0)} || ' km, secondary ' ||
{_number('secondary_km', 0)} || ' km, moat ' || {_number('moat_depth', 2)} END AS summary FROM ({SQL['ewrc_confidence']})""")
def eyewall_cycle_text(t: Tables) -> DataFrame:
    """What ewrc_confidence found, in words."""
    words = F.concat(
        F.lit("confidence "), _text("confidence", 2), F.lit(", primary "), _text("primary_km", 0), F.lit(" km, secondary "),
        _text("secondary_km", 0), F.lit(" km, moat "), _text("moat_depth", 2),
    )
    found = _of(t, "ewrc_confidence")
    return found.select("frame_id", F.when(F.col("secondary_km").isNull(), "no secondary eyewall").otherwise(words).alias("summary"))


_NAMED = "CASE stage " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in stages.NAMES.items()) + " END"


@query(f"""SELECT frame_id, CASE WHEN stage IS NULL THEN 'no stage: ' || evidence ELSE 'stage ' || stage || ' (' || {_NAMED} || '), confidence ' || {_number('confidence', 2)} || ', deep convection out to ' || {_number('extent', 0)} || ' km: ' || evidence END AS summary
FROM ({SQL['wvir_stage']})""")
def vapour_ring_text(t: Tables) -> DataFrame:
    """What wvir_stage found and its evidence, in words."""
    names = F.create_map(*(F.lit(x) for item in stages.NAMES.items() for x in item))
    parts = (F.lit("stage "), F.col("stage").cast("string"), F.lit(" ("), F.try_element_at(names, F.col("stage")), F.lit("), confidence "), _text("confidence", 2), F.lit(", deep convection out to "), _text("extent", 0), F.lit(" km: "), F.col("evidence"))
    return _of(t, "wvir_stage").select("frame_id", F.when(F.col("stage").isNull(), F.concat(F.lit("no stage: "), "evidence")).otherwise(F.concat(*parts)).alias("summary"))


@query(f"""SELECT fix_id, round(CASE WHEN x > 0 THEN greatest(1.0, least(6.0, x)) ELSE {K.SPREAD_DEFAULT} END, 6) AS widening,
round(CASE WHEN sigma <= 1 THEN 1 WHEN sigma >= 2.5 THEN 0.25 ELSE 1 - (sigma - 1) / 1.5 * 0.75 END, 6) AS scale
FROM (SELECT t.fix_id, rmw_nm / 8 - 2 AS x, sigma FROM track t JOIN ({SQL['novelty_sigma']}) n ON n.fix_id = t.fix_id)""")
def spread_scales(t: Tables) -> DataFrame:
    """How far an ensemble's spread is widened, and a correction's scale by the storm's novelty."""
    x = t.track.select("fix_id", (F.col("rmw_nm") / 8 - 2).alias("x")).join(_of(t, "novelty_sigma"), "fix_id")
    return x.select("fix_id", F.round(C.spread_widening(F.col("x")), 6).alias("widening"), F.round(C.novelty_scale(F.col("sigma")), 6).alias("scale"))


@query("""WITH c AS (SELECT 8 + event_id % 4 AS band, (ts >= (SELECT min(ts) FROM events) + INTERVAL 5 DAY) AS later, (event_type <> 'view' AND value IS NOT NULL)::INT AS real FROM events)
SELECT band, count(*) AS examples, CAST(sum(real) AS BIGINT) AS real, CAST(sum(real) FILTER (later) AS BIGINT) AS added, round(avg(real), 6) AS fraction, avg(real) >= 0.5 AS trained FROM c GROUP BY 1""")
def extra_band_counts(t: Tables) -> DataFrame:
    """Examples with each extra band real: in all, since a time, their share, and whether a model may rely on it."""
    start = t.events.agg((F.min("ts") + F.expr("interval 5 days")).alias("start"))  # one row
    real = ((F.col("event_type") != "view") & F.col("value").isNotNull()).cast("int")
    c = t.events.crossJoin(F.broadcast(start)).select((8 + F.col("event_id") % 4).alias("band"), (F.col("ts") >= F.col("start")).alias("later"), real.alias("real"))
    return c.groupBy("band").agg(
        F.count("*").alias("examples"), F.sum("real").alias("real"), F.sum(F.when(F.col("later"), F.col("real"))).alias("added"),
        F.round(F.avg("real"), 6).alias("fraction"), (F.avg("real") >= 0.5).alias("trained"),
    )


_PARTS = ("ir_band8", "ir_band9", "ir_band10", "env_shear", "env_sst")
_DIVISORS = (2, 3, 5, 7, 4)
_HAS = [f"CASE WHEN o_orderkey % {d} = 0 THEN '{x}' END" for x, d in zip(_PARTS, _DIVISORS, strict=True)]


@query(f"SELECT o_orderkey AS example, concat_ws(',', {', '.join(f'''CASE WHEN o_orderkey % {d} <> 0 THEN '{x}' END''' for x, d in zip(_PARTS, _DIVISORS, strict=True))}) AS missing FROM orders WHERE NOT ({' AND '.join(f'o_orderkey % {d} = 0' for d in _DIVISORS)})")
def missing_parts(t: Tables) -> DataFrame:
    """What stored examples lack of the parts a model asks for; whole ones aren't listed."""
    names = F.array(F.lit("ir"), *(F.expr(x) for x in _HAS))
    lacking = F.array_except(F.array(*map(F.lit, _PARTS)), F.array_compact(names))
    found = t.orders.select(F.col("o_orderkey").alias("example"), lacking.alias("x")).where(F.size("x") > 0)
    return found.select("example", F.array_join("x", ",").alias("missing"))


@query("""SELECT 'layer ' || l AS label, count(*) AS n FROM (SELECT CASE WHEN s_suppkey % 9 = 0 THEN '850-200' ELSE '200-800 km' END AS l FROM supplier) WHERE l NOT IN ('200-800 km', '0-500 km') GROUP BY 1""")
def unknown_labels(t: Tables) -> DataFrame:
    """Layer labels that a file's reader doesn't know, and how often they come: none of them may be used."""
    label = F.when(F.col("s_suppkey") % 9 == 0, "850-200").otherwise("200-800 km")
    rows = t.supplier.select(label.alias("l")).where(~F.col("l").isin("200-800 km", "0-500 km"))
    return rows.groupBy(F.concat(F.lit("layer "), "l").alias("label")).agg(F.count("*").alias("n"))


@query("""SELECT vb AS band, count(*) AS n, round(avg(e), 5) AS mean, round(regr_slope(e, vmax), 6) AS slope FROM
(SELECT CASE WHEN 40.0 + frame_id % 120 < 64 THEN 'TS' WHEN 40.0 + frame_id % 120 < 96 THEN 'C1-2' ELSE 'C3-5' END AS vb, 40.0 + frame_id % 120 AS vmax, v37 - h37 - 20 AS e FROM pixel_many WHERE v37 IS NOT NULL AND h37 IS NOT NULL) GROUP BY 1""")
def residual_slope(t: Tables) -> DataFrame:
    """Mean residual of each intensity band and its slope over the intensity."""
    vmax = (40.0 + F.col("frame_id") % 120).cast("double")
    e = (F.col("v37") - F.col("h37") - 20).cast("double")
    p = t.pixel_many.where("v37 is not null and h37 is not null").select(C.intensity_band(vmax).alias("band"), vmax.alias("vmax"), e.alias("e"))
    return p.groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("e"), 5).alias("mean"), F.round(F.regr_slope("e", "vmax"), 6).alias("slope"))


@query("SELECT storm_id, arg_max(sensor, (scene_time, pass_id)) AS sensor, CAST(epoch(max(date_trunc('second', scene_time))) AS BIGINT) AS scene_s FROM overpass GROUP BY 1")
def latest_sensor(t: Tables) -> DataFrame:
    """The sensor that saw each storm last."""
    rows = t.overpass.groupBy("storm_id").agg(F.max(F.struct("scene_time", "pass_id", "sensor")).alias("x"))
    return rows.select("storm_id", "x.sensor", F.unix_seconds(F.col("x.scene_time").cast("timestamp")).alias("scene_s"))


_NEAR_DEG = 60.0  # the test storms and flashes are far apart


@query(f"""WITH {_BRACKET}, p AS (SELECT pass_id, scene_time, round(lat0 + (lat1 - lat0) * r, 9) AS lat, round({_LON}, 9) AS lon FROM x)
SELECT p.pass_id, count(f.flash_id) AS flashes, round(coalesce(sum(f.energy), 0), 4) AS energy FROM p LEFT JOIN flash f ON f.ts BETWEEN p.scene_time - INTERVAL 5 MINUTE AND p.scene_time + INTERVAL 5 MINUTE AND abs(f.lat - p.lat) <= {_NEAR_DEG} AND abs({wrap('f.lon - p.lon')}) <= {_NEAR_DEG} GROUP BY 1""")
def flashes_near_pass(t: Tables) -> DataFrame:
    """Lightning within five minutes of each pass and near the storm then: both sides meet in slots of five minutes and
    cells of the reach's side, of which a pass asks three by three by three."""
    slot = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / 300)
    row, columns = F.floor(F.col("lat") / _NEAR_DEG), int(360 / _NEAR_DEG)
    column = F.pmod(F.floor(F.col("lon") / _NEAR_DEG), F.lit(columns))
    flash = t.flash.select("ts", "energy", F.col("lat").alias("flat"), F.col("lon").alias("flon"), slot("ts").alias("slot"), row.alias("row"), column.alias("column"))
    at = asof.interpolated(t.overpass, t.track, ["pass_id"]).select("pass_id", F.col("t"), F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))
    near = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k in (-1, 0, 1) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    asked = at.select("pass_id", "t", "lat", "lon", near.alias("o")).select("pass_id", "t", "lat", "lon", (slot("t") + F.col("o.k")).alias("slot"), (row + F.col("o.i")).alias("row"), F.pmod(column + F.col("o.j"), F.lit(columns)).alias("column"))
    met = asked.join(flash, ["slot", "row", "column"]).where(
        F.expr("ts between t - interval 5 minutes and t + interval 5 minutes") & (F.abs(F.col("flat") - F.col("lat")) <= _NEAR_DEG) & (F.abs(C.lon_delta(F.col("lon"), F.col("flon"))) <= _NEAR_DEG)
    )
    sums = met.groupBy("pass_id").agg(F.count("*").alias("n"), F.sum("energy").alias("e"))
    every = at.select("pass_id").join(sums, "pass_id", "left")
    return every.select("pass_id", F.coalesce("n", F.lit(0)).alias("flashes"), F.round(F.coalesce("e", F.lit(0.0)), 4).alias("energy"))


@query("""SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 3600 * CAST(event_id % 5 AS BIGINT) AS utc_s, event_id % 5 = 0 AS same,
CASE WHEN h < 1 THEN CAST(round(h * 60) AS BIGINT) || ' min' ELSE printf('%.1f h', round(h, 1)) END AS took FROM (SELECT *, (event_id % 97) / 16.0 AS h FROM events)""")
def instants(t: Tables) -> DataFrame:
    """Instants from texts with a zone, whether they're the same as those without, and spans in words."""
    zone = F.col("event_id") % 5
    local = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    utc = F.to_timestamp(F.concat(local, F.lit("+0"), zone.cast("string"), F.lit(":00")))
    plain = F.to_timestamp(F.concat(local, F.lit("Z")))
    return t.events.select("event_id", F.unix_seconds(utc).alias("utc_s"), (utc == plain).alias("same"), C.hours_text((F.col("event_id") % 97) / 16.0).alias("took"))
