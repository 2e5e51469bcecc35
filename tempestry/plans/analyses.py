"""Further analyses: stages and comparisons over profiles, centre fixes, coverage, grids, patches, schedules and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempestry.functions import columns as C
from tempestry.functions import constants as K
from tempestry.operators import asof, neighbours, profiles, stencils
from tempestry.operators.tables import ranked_within
from tempestry.plans.pixels import _WVIR, storm
from tempestry.plans.registry import Tables, clip, distance, query, wrap
from tempestry.plans.tracks import _BRACKET, _LON


def wvir(t: Tables) -> DataFrame:
    """frame_id, radius, v, s: vapour above cloud top by annulus and its median of three."""
    p = storm(t.pixel).withColumn("k", F.floor(F.col("r") / 6.0 + 0.5))
    m = p.groupBy("frame_id", "k").agg(F.avg(F.greatest(F.col("wv") - F.col("ir"), F.lit(0.0))).alias("m"), F.count("*").alias("n"))
    full = t.pixel.select("frame_id").distinct().select("frame_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(34).cast("long"))).alias("k")).join(m, ["frame_id", "k"], "left")
    full = full.select("frame_id", (F.col("k") * 6).cast("double").alias("radius"), F.round(F.when(F.col("n") >= 8, F.col("m")).otherwise(0.0), 9).alias("v"))
    return full.withColumn("s", profiles.median3("v", Window.partitionBy("frame_id").orderBy("radius")))


_RINGS2 = f"""{_WVIR}, r9 AS (SELECT frame_id, radius, round(v, 9) AS v, round(s, 9) AS s FROM sm),
pk AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY v DESC, radius) AS n FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM r9 WINDOW w AS (PARTITION BY frame_id ORDER BY radius)) WHERE v >= a AND v >= b AND v > 1),
best AS (SELECT frame_id, radius AS r1, v AS v1 FROM pk WHERE n = 1),
other AS (SELECT p.frame_id, p.radius, p.v, min(q.s) AS moat, any_value(b.v1) AS v1 FROM pk p JOIN best b ON p.frame_id = b.frame_id JOIN r9 q ON q.frame_id = p.frame_id AND q.radius BETWEEN least(p.radius, b.r1) AND greatest(p.radius, b.r1) WHERE abs(p.radius - b.r1) >= 40 GROUP BY 1, 2, 3),
kept AS (SELECT frame_id, r1 AS radius, v1 AS v FROM best UNION ALL SELECT frame_id, radius, v FROM other WHERE moat < 0.55 * least(v, v1))"""


def wvir_ring_list(t: Tables) -> DataFrame:
    """frame_id, radius, v of the kept rings: the strongest, and others 40 km off behind a moat."""
    w = Window.partitionBy("frame_id").orderBy("radius")
    r = wvir(t)
    peaks = r.withColumn("a", F.lag("v").over(w)).withColumn("b", F.lead("v").over(w)).where("v >= a and v >= b and v > 1").select("frame_id", "radius", "v")
    best = peaks.groupBy("frame_id").agg(F.max_by(F.struct("radius", "v"), F.struct("v", -F.col("radius"))).alias("x")).select("frame_id", F.col("x.radius").alias("r1"), F.col("x.v").alias("v1"))
    far = peaks.join(best, "frame_id").where(F.abs(F.col("radius") - F.col("r1")) >= 40)
    between = far.join(r.select("frame_id", F.col("radius").alias("rr"), "s"), "frame_id").where(F.col("rr").between(F.least("radius", "r1"), F.greatest("radius", "r1")))
    other = between.groupBy("frame_id", "radius", "v", "v1").agg(F.min("s").alias("moat")).where(F.col("moat") < 0.55 * F.least("v", "v1"))
    return best.select("frame_id", F.col("r1").alias("radius"), F.col("v1").alias("v")).union(other.select("frame_id", "radius", "v"))


@query(f"WITH {_RINGS2} SELECT frame_id, radius, round(v, 5) AS peak_k FROM kept")
def wvir_rings(t: Tables) -> DataFrame:
    """Convective rings of each frame's vapour profile."""
    return wvir_ring_list(t).select("frame_id", "radius", F.round("v", 5).alias("peak_k"))


@query("""WITH m AS (SELECT frame_id, round(avg(v37 - h37), 3) AS d, count(*) FILTER (v37 < 225) AS core FROM pixel GROUP BY frame_id)
SELECT a.frame_id, b.frame_id AS other_id, printf('difference %.1f->%.1f K, core %d->%d', a.d, b.d, a.core, b.core) || CASE WHEN b.core > 1.2 * a.core THEN '; core grew' ELSE '' END AS summary FROM m a JOIN m b ON b.frame_id = a.frame_id + 1""")
def structure_compare(t: Tables) -> DataFrame:
    """Each frame against the next, in words."""
    return compared(t.pixel)


def compared(pixels: DataFrame) -> DataFrame:
    """frame_id, other_id, summary of frames whose next one is there; no summary where one of both has no difference."""
    # the mean is rounded as DuckDB does it, as a whole number of thousandths
    m = pixels.groupBy("frame_id").agg((F.round(F.avg(F.col("v37") - F.col("h37")) * 1000) / 1000).alias("d"), F.count_if(F.col("v37") < 225).alias("core"))
    b = m.select(F.col("frame_id").alias("other_id"), F.col("d").alias("d2"), F.col("core").alias("core2"), (F.col("frame_id") - 1).alias("frame_id"))
    x = m.join(b, "frame_id")
    return x.select("frame_id", "other_id", F.concat(F.lit("difference "), C.one_decimal(F.col("d")), F.lit("->"), C.one_decimal(F.col("d2")), F.format_string(" K, core %d->%d", "core", "core2"), F.when(F.col("core2") > 1.2 * F.col("core"), "; core grew").otherwise("")).alias("summary"))


_EV, _DV, _EH, _DH = 62.0, 30.0, 110.0, 25.0
_DET = _EH * _DV - _EV * _DH


@query(f"SELECT frame_id, pr, pc, round((-{_DH} * (v37 - 205) + {_DV} * (h37 - 145)) / {_DET}, 6) AS emission, round((-{_EH} * (v37 - 205) + {_EV} * (h37 - 145)) / {_DET}, 6) AS scattering FROM pixel")
def recover_weights(t: Tables) -> DataFrame:
    """Emission and scattering weights that give a pixel's two polarisations."""
    dv, dh = F.col("v37") - 205, F.col("h37") - 145
    return t.pixel.select(*stencils.CELL, F.round((-_DH * dv + _DV * dh) / _DET, 6).alias("emission"), F.round((-_EH * dv + _EV * dh) / _DET, 6).alias("scattering"))


_CA = f"acos({clip('cos(radians(lat)) * cos(radians(lon + 137.0))', -1, 1)})"
_SHIFT = f"({clip('(300 - ir) / 6.5', 0, 17)} * tan(atan2(42164.0 * sin({_CA}), 42164.0 * cos({_CA}) - 6371.0)) / 111.32)"
_NORM = f"sqrt(lat * lat + pow({wrap('lon + 137.0')} * cos(radians(lat)), 2))"


@query(f"SELECT frame_id, pr, pc, round({_SHIFT} * lat / {_NORM}, 6) AS dlat, round({_SHIFT} * {wrap('lon + 137.0')} / {_NORM}, 6) AS dlon FROM pixel")
def parallax_offset(t: Tables) -> DataFrame:
    """How far cloud tops seem displaced, in degrees, for a satellite at 137 W."""
    lat, dlon, cos = F.col("lat"), C.lon_delta(F.lit(-137.0), F.col("lon")), F.cos(F.radians("lat"))
    shift = C.cloud_top_km(F.col("ir")) * F.tan(F.radians(C.zenith_angle(lat, F.col("lon"), -137.0))) / K.KM_DEG_DISTANCE
    norm = F.sqrt(lat * lat + F.pow(dlon * cos, 2))
    return t.pixel.select(*stencils.CELL, F.round(shift * lat / norm, 6).alias("dlat"), F.round(shift * dlon / norm, 6).alias("dlon"))


@query(f"""WITH b AS (SELECT frame_id, min(lat) AS a, max(lat) AS b, min({wrap('lon - 179')}) AS c, max({wrap('lon - 179')}) AS d FROM pixel GROUP BY 1)
SELECT t.fix_id, count(*) AS covering FROM track t JOIN b ON t.lat BETWEEN b.a + 1 AND b.b - 1 AND {wrap('t.lon - 179')} BETWEEN b.c + 1 AND b.d - 1 GROUP BY 1""")
def image_covers_storm(t: Tables) -> DataFrame:
    """Frames whose bounding box, less a degree, holds a fix; both meet in cells of five degrees."""
    rel = C.lon_delta(F.lit(179.0), F.col("lon"))
    boxes = t.pixel.groupBy("frame_id").agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min(rel).alias("c"), F.max(rel).alias("d"))
    near = t.track.withColumn("rel", rel).where("lat between -90 and 90")
    inside = boxes.where("a + 1 <= b - 1 and c + 1 <= d - 1")
    cells = lambda low, high: F.explode(F.sequence(F.floor((F.col(low) + 1) / 5), F.floor((F.col(high) - 1) / 5)))
    inside = inside.select("*", cells("a", "b").alias("y")).select("*", cells("c", "d").alias("x"))
    near = near.select("fix_id", "lat", "rel", F.floor(F.col("lat") / 5).alias("y"), F.floor(F.col("rel") / 5).alias("x"))
    met = near.join(inside, ["y", "x"]).where("lat between a + 1 and b - 1 and rel between c + 1 and d - 1")
    return met.groupBy("fix_id").agg(F.count("*").alias("covering"))


@query("""WITH d AS (SELECT frame_id, abs(lat - lag(lat) OVER (PARTITION BY frame_id, pc ORDER BY pr)) AS dy, pr - lag(pr) OVER (PARTITION BY frame_id, pc ORDER BY pr) AS k FROM pixel)
SELECT frame_id, round(median(dy) * 111.32, 5) AS spacing_km, round(pow(median(dy) * 111.32, 2) * cos(radians(25)), 4) AS pixel_km2 FROM d WHERE k = 1 GROUP BY 1""")
def grid_spacing(t: Tables) -> DataFrame:
    """Median distance of neighbouring rows and the area of a pixel."""
    w = Window.partitionBy("frame_id", "pc").orderBy("pr")
    d = t.pixel.select("frame_id", F.abs(F.col("lat") - F.lag("lat").over(w)).alias("dy"), (F.col("pr") - F.lag("pr").over(w)).alias("k")).where("k = 1")
    m = d.groupBy("frame_id").agg((F.median("dy") * K.KM_DEG_DISTANCE).alias("km"))
    return m.select("frame_id", F.round("km", 5).alias("spacing_km"), F.round(F.col("km") * F.col("km") * F.cos(F.radians(F.lit(25.0))), 4).alias("pixel_km2"))


@query("SELECT frame_id, min(pr) AS r0, max(pr) AS r1, min(pc) AS c0, max(pc) AS c1, count(*) AS n, round(count(*) / 2304.0, 6) AS fraction FROM pixel WHERE abs(pr - 24) <= 10 AND abs(pc - 24) <= 12 GROUP BY 1")
def crop_bounds(t: Tables) -> DataFrame:
    """Index bounds of a window about the storm and its share of the grid; the filter reaches the grouped rows only."""
    x = t.pixel.where((F.abs(F.col("pr") - 24) <= 10) & (F.abs(F.col("pc") - 24) <= 12))
    return x.groupBy("frame_id").agg(F.min("pr").alias("r0"), F.max("pr").alias("r1"), F.min("pc").alias("c0"), F.max("pc").alias("c1"), F.count("*").alias("n"), F.round(F.count("*") / 2304.0, 6).alias("fraction"))


@query("""WITH g AS (SELECT f.frame_id, r.pr, c.pc FROM (SELECT DISTINCT frame_id FROM pixel) f, (SELECT unnest(generate_series(-4, 11)) AS pr) r, (SELECT unnest(generate_series(-4, 11)) AS pc) c)
SELECT g.frame_id, g.pr + 4 AS row, g.pc + 4 AS col, round(p.ir, 4) AS ir FROM g LEFT JOIN pixel p ON p.frame_id = g.frame_id AND p.pr = g.pr AND p.pc = g.pc""")
def centred_patch(t: Tables) -> DataFrame:
    """A 16 x 16 patch at each frame's corner; cells outside the frame are missing."""
    side = F.sequence(F.lit(-4).cast("long"), F.lit(11).cast("long"))
    g = t.pixel.select("frame_id").distinct().select("frame_id", F.explode(side).alias("pr")).select("frame_id", "pr", F.explode(side).alias("pc"))
    return g.join(t.pixel.select(*stencils.CELL, "ir"), stencils.CELL, "left").select("frame_id", (F.col("pr") + 4).alias("row"), (F.col("pc") + 4).alias("col"), F.round("ir", 4).alias("ir"))


@query("SELECT frame_id, pr, pc, round(least(1, (least(pr, 47 - pr) + 1) / 8.0) * least(1, (least(pc, 47 - pc) + 1) / 8.0), 6) AS taper FROM pixel")
def edge_taper(t: Tables) -> DataFrame:
    """Linear ramps from the grid's edges, multiplied."""
    ramp = lambda x: F.least(F.lit(1.0), (F.least(F.col(x), 47 - F.col(x)) + 1) / 8.0)
    return t.pixel.select(*stencils.CELL, F.round(ramp("pr") * ramp("pc"), 6).alias("taper"))


@query("""WITH k AS (SELECT frame_id, pr, pc, row_number() OVER (PARTITION BY frame_id ORDER BY md5(frame_id || '-' || pr || '-' || pc), pr, pc) AS n FROM pixel)
SELECT frame_id, pr, pc FROM k WHERE n <= 200""")
def pixel_subsample(t: Tables) -> DataFrame:
    """Two hundred pixels of each frame in a seeded order (a sampling operator)."""
    h = F.md5(F.concat_ws("-", *(F.col(c).cast("string") for c in stencils.CELL)).cast("binary"))
    k = ranked_within(t.pixel.select(*stencils.CELL, h.alias("h")), "frame_id", "h", "pr", "pc")
    return k.where("k <= 200").select(*stencils.CELL)


@query("""WITH x AS (SELECT frame_id, pr, pc, v37, lat, lon FROM pixel), bad AS (SELECT * FROM x WHERE v37 IS NULL),
m AS (SELECT b.frame_id, b.pr, b.pc, g.v37, (b.pr - g.pr) * (b.pr - g.pr) + (b.pc - g.pc) * (b.pc - g.pc) AS d, g.pr AS r, g.pc AS c FROM bad b JOIN x g ON g.frame_id = b.frame_id AND g.v37 IS NOT NULL AND abs(b.pr - g.pr) <= 2 AND abs(b.pc - g.pc) <= 2)
SELECT frame_id, pr, pc, arg_min(v37, (d, r, c)) AS filled, CAST(min(d) AS BIGINT) AS d2 FROM m GROUP BY 1, 2, 3""")
def fill_invalid_nearest(t: Tables) -> DataFrame:
    """Missing pixels from the nearest valid one within two pixels."""
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3))))
    good = t.pixel.where("v37 is not null").select("frame_id", "pr", "pc", "v37", near.alias("o"))
    good = good.select("frame_id", (F.col("pr") + F.col("o.i")).alias("pr"), (F.col("pc") + F.col("o.j")).alias("pc"), F.col("pr").alias("r"), F.col("pc").alias("c"), "v37", (F.col("o.i") * F.col("o.i") + F.col("o.j") * F.col("o.j")).cast("long").alias("d"))
    bad = t.pixel.where("v37 is null").select(*stencils.CELL)
    return bad.join(good, stencils.CELL).groupBy(*stencils.CELL).agg(F.min_by("v37", F.struct("d", "r", "c")).alias("filled"), F.min("d").alias("d2"))


@query("""WITH x AS (SELECT frame_id, pr, pc, v37 FROM pixel),
m AS (SELECT b.frame_id, b.pr, b.pc, g.v37, (b.pr - g.pr) * (b.pr - g.pr) + (b.pc - g.pc) * (b.pc - g.pc) AS d, g.pr AS r, g.pc AS c FROM x b LEFT JOIN x g ON g.frame_id = b.frame_id AND g.v37 IS NOT NULL WHERE b.v37 IS NULL)
SELECT frame_id, pr, pc, arg_min(v37, (d, r, c)) AS filled, CAST(min(d) AS BIGINT) AS d2 FROM m GROUP BY 1, 2, 3""")
def fill_invalid_whole(t: Tables) -> DataFrame:
    """All missing pixels from the nearest valid one of their frame, at any distance; missing still where it has none."""
    return neighbours.nearest_valid(t.pixel, "v37")


@query("""WITH r AS (SELECT frame_id, ir, row_number() OVER (PARTITION BY frame_id ORDER BY ir DESC, pr, pc) AS n, count(*) OVER (PARTITION BY frame_id) AS k FROM pixel)
SELECT frame_id, round(sum(ir) FILTER (n <= greatest(1, CAST(floor(0.1 * k) AS BIGINT))) / sum(ir), 6) AS concentration FROM r GROUP BY 1""")
def concentration(t: Tables) -> DataFrame:
    """Share of a frame's total in its largest tenth."""
    r = ranked_within(t.pixel.select(*stencils.CELL, "ir"), "frame_id", F.desc("ir"), "pr", "pc").select("frame_id", "ir", F.col("k").alias("n"), F.col("n").alias("k"))
    top = F.sum(F.when(F.col("n") <= F.greatest(F.lit(1), F.floor(0.1 * F.col("k"))), F.col("ir")))
    return r.groupBy("frame_id").agg(F.round(top / F.sum("ir"), 6).alias("concentration"))


@query(f"""WITH {_BRACKET}, g AS (SELECT pass_id, sensor, scene_time, lat0 + (lat1 - lat0) * r AS lat, {_LON} AS lon FROM x),
sub AS (SELECT pass_id, sensor, lat, lon, k, -60 + (k * 7 + pass_id) % 120 AS slat, {wrap('k * 24.0 + pass_id')} AS slon FROM g, (SELECT unnest(generate_series(0, 14)) AS k) s)
SELECT sensor, count(DISTINCT pass_id) AS hits, arg_max(pass_id, (k, pass_id)) AS latest FROM sub WHERE {distance('slat', 'slon', 'lat', 'lon')} <= 850 GROUP BY sensor""")
def predict_overpasses(t: Tables) -> DataFrame:
    """Steps of each sensor's sub-point that come within half a swath of the storm."""
    at = asof.interpolated(t.overpass, t.track, ["pass_id", "sensor"])
    s = at.select("pass_id", "sensor", "lat", "lon", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("k"))
    s = s.withColumn("slat", -60 + (F.col("k") * 7 + F.col("pass_id")) % 120).withColumn("slon", C.wrap180(F.col("k") * 24.0 + F.col("pass_id")))
    hit = s.where(C.distance_km(F.col("slat"), F.col("slon"), F.col("lat"), F.col("lon")) <= 850)
    return hit.groupBy("sensor").agg(F.count_distinct("pass_id").alias("hits"), F.max_by("pass_id", F.struct("k", "pass_id")).alias("latest"))


@query("""WITH k AS (SELECT storm_id, fix_id, row_number() OVER (PARTITION BY storm_id ORDER BY valid_time) - 1 AS i, count(*) OVER (PARTITION BY storm_id) AS n FROM track),
p AS (SELECT DISTINCT storm_id, CAST(floor(j * greatest(n, 6) / 6.0) AS BIGINT) AS i FROM (SELECT DISTINCT storm_id, n FROM k), LATERAL (SELECT unnest(generate_series(0, 5)) AS j) g)
SELECT k.storm_id, k.fix_id FROM k JOIN p ON k.storm_id = p.storm_id AND k.i = p.i""")
def thin_per_storm(t: Tables) -> DataFrame:
    """At most six evenly spaced fixes of each storm (a sampling operator)."""
    k = ranked_within(t.track.select("storm_id", "fix_id", "valid_time"), "storm_id", "valid_time").withColumn("i", (F.col("k") - 1).cast("long"))
    picks = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: F.floor(j * F.greatest("n", F.lit(6)) / 6.0))
    return k.where(F.array_contains(picks, F.col("i"))).select("storm_id", "fix_id")


@query("SELECT strftime(ts, '%Y%m%d%H') AS hour, count(*) AS n, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us FROM events WHERE event_type = 'view' GROUP BY 1")
def hour_strings(t: Tables) -> DataFrame:
    """Hours that have a pass, with the first of each."""
    return t.events.where("event_type = 'view'").groupBy(F.date_format("ts", "yyyyMMddHH").alias("hour")).agg(F.count("*").alias("n"), F.unix_micros(F.min("ts").cast("timestamp")).alias("first_us"))


@query("""WITH s AS (SELECT user_id AS storm_id, event_type AS sensor, min(event_id) AS p FROM events GROUP BY 1, 2)
SELECT storm_id, string_agg(sensor, '>' ORDER BY p) AS order_seen FROM s GROUP BY 1""")
def ordered_union(t: Tables) -> DataFrame:
    """Distinct values in the order in which they were first seen."""
    s = t.events.groupBy(F.col("user_id").alias("storm_id"), "event_type").agg(F.min("event_id").alias("p"))
    return s.groupBy("storm_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "event_type"))), lambda x: x["event_type"]), ">").alias("order_seen"))


@query("""WITH q AS (SELECT sensor, count(*) AS n FROM overpass GROUP BY 1), s(scenario, per_storm, seconds) AS (VALUES ('one worker', 6, 12.0), ('eight workers', 6, 1.5), ('all', 1000, 1.5))
SELECT scenario, sensor, CAST(least(n, per_storm * 100) AS BIGINT) AS examples, round(least(n, per_storm * 100) * seconds / 3600, 6) AS hours FROM q, s""")
def mining_scenarios(t: Tables) -> DataFrame:
    """Examples and hours by sensor under three fixed plans."""
    q = t.overpass.groupBy("sensor").agg(F.count("*").alias("n"))
    s = F.explode(F.array(*(F.struct(F.lit(a).alias("scenario"), F.lit(b).alias("per_storm"), F.lit(c).alias("seconds")) for a, b, c in (("one worker", 6, 12.0), ("eight workers", 6, 1.5), ("all", 1000, 1.5)))))
    x = q.select("sensor", "n", s.alias("s")).withColumn("examples", F.least(F.col("n"), F.col("s.per_storm") * 100))
    return x.select("s.scenario", "sensor", "examples", F.round(F.col("examples") * F.col("s.seconds") / 3600, 6).alias("hours"))


@query("""SELECT frame_id, round(avg((v37 IS NOT NULL)::INT), 6) AS share_37, round(avg((v89 IS NOT NULL)::INT), 6) AS share_89, CASE WHEN avg((v37 IS NOT NULL AND v89 IS NOT NULL)::INT) >= 0.9 THEN 'good' WHEN avg((v37 IS NOT NULL AND v89 IS NOT NULL)::INT) >= 0.5 THEN 'partial' ELSE 'poor' END AS health FROM pixel GROUP BY 1""")
def dataset_health(t: Tables) -> DataFrame:
    """Coverage of each frame's targets and what that makes it."""
    have = lambda *c: F.avg(sum((F.col(x).isNull().cast("int") for x in c), F.lit(0)).eqNullSafe(0).cast("int"))
    both = have("v37", "v89")
    return t.pixel.groupBy("frame_id").agg(F.round(have("v37"), 6).alias("share_37"), F.round(have("v89"), 6).alias("share_89"), F.when(both >= 0.9, "good").when(both >= 0.5, "partial").otherwise("poor").alias("health"))


@query(f"""WITH x AS (SELECT frame_id, pr, pc, 2.15 * v37 - 1.15 * h37 AS p, {clip('2.15 * v37 - 1.15 * h37 - 285', -12, 12)} AS d FROM pixel)
SELECT frame_id, pr, pc, round(d, 5) AS correction, round(CASE WHEN abs(p - 285) > 12 THEN 12 / abs(p - 285) WHEN p IS NOT NULL THEN 1 END, 6) AS scale FROM x""")
def clamp_correction(t: Tables) -> DataFrame:
    """Corrections of the corrected temperature within 12 K, and by how much both channels are scaled for it."""
    d = C.pct(F.col("v37"), F.col("h37"), 1.15) - 285
    return t.pixel.select(*stencils.CELL, F.round(C.clip(d, -12, 12), 5).alias("correction"), F.round(F.when(F.abs(d) > 12, 12 / F.abs(d)).when(d.isNotNull(), 1.0), 6).alias("scale"))


@query("SELECT p.frame_id, p.pr, p.pc, round((p.ir - n.m) / n.s, 6) AS z, round((p.ir - n.m) / n.s * n.s + n.m, 4) AS back FROM pixel p, (VALUES (255.0::DOUBLE, 30.0::DOUBLE)) n(m, s)")
def normalize_channel(t: Tables) -> DataFrame:
    """A channel in its fixed mean and deviation, and back."""
    z = (F.col("ir") - 255.0) / 30.0
    return t.pixel.select(*stencils.CELL, F.round(z, 6).alias("z"), F.round(z * 30.0 + 255.0, 4).alias("back"))


@query("""WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), b AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'),
e AS (SELECT a.event_id, max(b.event_id) FILTER (b.ts = a.ts) AS exact, arg_min(b.event_id, (abs(epoch_us(a.ts) - epoch_us(b.ts)), b.ts)) AS near, min(abs(epoch_us(a.ts) - epoch_us(b.ts))) AS d FROM a LEFT JOIN b ON a.user_id = b.user_id GROUP BY 1)
SELECT event_id, coalesce(exact, CASE WHEN d <= 1800000000 THEN near END) AS env_id FROM e""")
def env_at_overpass(t: Tables) -> DataFrame:
    """The row of the same time, else the nearest within half an hour."""
    rows = t.events.where("event_type = 'click'").select(F.col("user_id").alias("storm_id"), F.col("ts").alias("valid_time"), F.col("event_id").alias("env_id"))
    points = t.events.where("event_type = 'view'").select(F.col("user_id").alias("storm_id"), F.col("ts").alias("valid_time"), "event_id")
    x = asof.bracket(points, rows, ["storm_id"], "valid_time", ["event_id"], ["env_id"])
    back, ahead = C.hours_between(F.col("f0.t"), F.col("t")), C.hours_between(F.col("t"), F.col("f1.t"))
    first = F.col("f1").isNull() | (back <= ahead)
    return x.select("event_id", F.when(F.least(back, ahead) <= 0.5, F.when(first, F.col("f0.env_id")).otherwise(F.col("f1.env_id"))).alias("env_id"))
