"""Queries over tracks and overpasses: as-of joins, extrapolation, pairs, checkpoints, eras and stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempestry.functions import columns as C
from tempestry.functions import constants as K
from tempestry.operators import asof
from tempestry.operators.tables import in_runs
from tempestry.plans.registry import Tables, clip, distance, query, wrap

_BRACKET = """b AS (SELECT o.pass_id, o.storm_id, o.sensor, o.scene_time, t.valid_time AS t0, t.lat AS lat0, t.lon AS lon0, t.vmax_kt AS v0, t.rmw_nm AS m0
           FROM overpass o ASOF JOIN track t ON o.storm_id = t.storm_id AND o.scene_time >= t.valid_time),
c AS (SELECT b.*, t.valid_time AS t1, t.lat AS lat1, t.lon AS lon1, t.vmax_kt AS v1, t.rmw_nm AS m1
      FROM b ASOF JOIN track t ON b.storm_id = t.storm_id AND b.scene_time <= t.valid_time),
x AS (SELECT *, CASE WHEN t0 = t1 THEN 0 ELSE CAST(epoch_us(scene_time) - epoch_us(t0) AS DOUBLE) / (epoch_us(t1) - epoch_us(t0)) END AS r FROM c)"""
_LON = wrap(f"lon0 + {wrap('lon1 - lon0')} * r")


@query(f"""WITH {_BRACKET}
SELECT pass_id, round(lat0 + (lat1 - lat0) * r, 6) AS lat, round({_LON}, 6) AS lon, round(v0 + (v1 - v0) * r, 6) AS vmax_kt,
       round(CASE WHEN m0 IS NULL OR m1 IS NULL THEN m0 ELSE m0 + (m1 - m0) * r END, 6) AS rmw_nm FROM x""")
def track_interp_at_overpass(t: Tables) -> DataFrame:
    """Two-sided as-of join and linear interpolation of the track at each overpass."""
    found = asof.interpolated(t.overpass, t.track, ["pass_id"], ["vmax_kt", "rmw_nm"])
    return found.select("pass_id", *(F.round(c, 6).alias(c) for c in ("lat", "lon", "vmax_kt", "rmw_nm")))


@query("""SELECT pass_id, fix_id, round(gap, 6) AS gap_h FROM (
  SELECT o.pass_id, t.fix_id, abs(epoch_us(o.scene_time) - epoch_us(t.valid_time)) / 3.6e9 AS gap,
         row_number() OVER (PARTITION BY o.pass_id ORDER BY abs(epoch_us(o.scene_time) - epoch_us(t.valid_time)), t.valid_time) AS n
  FROM overpass o JOIN track t ON o.storm_id = t.storm_id) WHERE n = 1""")
def track_nearest_fix(t: Tables) -> DataFrame:
    """Fix nearest in time; the earlier of two equally near ones."""
    found = asof.bracket(t.overpass.withColumnRenamed("scene_time", "valid_time"), t.track, ["storm_id"], "valid_time", ["pass_id"], ["fix_id"])
    back, ahead = C.hours_between(F.col("f0.t"), F.col("t")), C.hours_between(F.col("t"), F.col("f1.t"))
    first = F.col("f1").isNull() | (back <= ahead)
    return found.where("f0 is not null or f1 is not null").select("pass_id", F.when(first, F.col("f0.fix_id")).otherwise(F.col("f1.fix_id")).alias("fix_id"), F.round(F.when(first, back).otherwise(ahead), 6).alias("gap_h"))


@query(f"""WITH last AS (SELECT o.pass_id, o.storm_id, o.scene_time, t.valid_time AS t0, t.lat, t.lon
  FROM overpass o ASOF JOIN track t ON o.storm_id = t.storm_id AND o.scene_time >= t.valid_time),
alone AS (SELECT l.* FROM last l WHERE NOT EXISTS (SELECT 1 FROM track t WHERE t.storm_id = l.storm_id AND t.valid_time >= l.scene_time)),
p AS (SELECT a.*, q.valid_time AS t1, q.lat AS lat1, q.lon AS lon1, (epoch_us(a.t0) - epoch_us(q.valid_time)) / 3.6e9 AS h
      FROM alone a LEFT JOIN LATERAL (SELECT * FROM track t WHERE t.storm_id = a.storm_id AND t.valid_time < a.t0 AND t.valid_time >= a.t0 - INTERVAL 12 HOUR ORDER BY t.valid_time DESC LIMIT 1) q ON true),
m AS (SELECT *, (lat - lat1) / h AS dlat, {wrap('lon - lon1')} / h AS dlon, (epoch_us(scene_time) - epoch_us(t0)) / 3.6e9 AS gap FROM p),
s AS (SELECT *, CASE WHEN h IS NULL OR sqrt(pow(dlat * 60, 2) + pow(dlon * 60 * cos(radians(lat)), 2)) > 50 THEN 0 ELSE 1 END AS moves FROM m)
SELECT pass_id, round(gap, 6) AS gap_h, round(CASE WHEN gap <= 12 AND moves = 1 THEN lat + dlat * gap ELSE lat END, 6) AS lat,
       round(CASE WHEN gap <= 12 AND moves = 1 THEN {wrap('lon + dlon * gap')} ELSE lon END, 6) AS lon FROM s""")
def track_extrapolate(t: Tables) -> DataFrame:
    """Passes after the last fix: moved on at the last motion up to 12 h, else frozen; over 50 kt is no motion."""
    w = Window.partitionBy("storm_id").orderBy("valid_time")
    prior = F.lag(F.struct("valid_time", "lat", "lon")).over(w)
    fixes = t.track.withColumn("p", prior)
    found = asof.bracket(t.overpass.withColumnRenamed("scene_time", "valid_time"), fixes, ["storm_id"], "valid_time", ["pass_id"], ["lat", "lon", "p"]).where("f0 is not null and f1 is null")
    h, gap = C.hours_between(F.col("f0.p.valid_time"), F.col("f0.t")), C.hours_between(F.col("f0.t"), F.col("t"))
    dlat, dlon = (F.col("f0.lat") - F.col("f0.p.lat")) / h, C.lon_delta(F.col("f0.p.lon"), F.col("f0.lon")) / h
    knots = F.sqrt(F.pow(dlat * 60, 2) + F.pow(dlon * 60 * F.cos(F.radians("f0.lat")), 2))
    moves = F.coalesce((h <= 12) & (knots <= 50), F.lit(False)) & (gap <= 12)
    return found.select("pass_id", F.round(gap, 6).alias("gap_h"), F.round(F.when(moves, F.col("f0.lat") + dlat * gap).otherwise(F.col("f0.lat")), 6).alias("lat"), F.round(F.when(moves, C.wrap180(F.col("f0.lon") + dlon * gap)).otherwise(F.col("f0.lon")), 6).alias("lon"))


@query(f"""SELECT fix_id, round({wrap('lon')}, 6) AS lon, round({wrap('lon - p')}, 6) AS delta FROM (SELECT *, lag(lon) OVER (PARTITION BY storm_id ORDER BY valid_time) AS p FROM track)""")
def track_wrap_delta(t: Tables) -> DataFrame:
    """Longitudes in range and the shortest step from the fix before."""
    before = F.lag("lon").over(Window.partitionBy("storm_id", "run").orderBy("k"))
    fixes = in_runs(t.track.select("storm_id", "fix_id", "valid_time", "lon"), "storm_id", "valid_time", before=1)
    return fixes.select("own", "fix_id", F.round(C.wrap180(F.col("lon")), 6).alias("lon"), F.round(C.lon_delta(before, F.col("lon")), 6).alias("delta")).where("own").drop("own")


@query(f"""WITH {_BRACKET}, pos AS (SELECT pass_id, lat0 + (lat1 - lat0) * r AS lat, {_LON} AS lon FROM x),
moved AS (SELECT x.pass_id, x.storm_id, a.lat AS lat_p, a.lon AS lon_p, x.lat1, x.lon1 FROM x JOIN pos a ON x.pass_id = a.pass_id)
SELECT m.pass_id, count(*) AS n, round(min(p.lat + (m.lat1 - m.lat_p)), 6) AS lat_min, round(max({wrap(f"p.lon + {wrap('m.lon1 - m.lon_p')}")}), 6) AS lon_max
FROM moved m JOIN pixel p ON p.frame_id = m.pass_id % 8 AND p.pr = m.pass_id % 48 GROUP BY m.pass_id""")
def swath_morph(t: Tables) -> DataFrame:
    """A swath row moved with the storm, from its own time to the next fix."""
    found = asof.bracket(t.overpass.withColumnRenamed("scene_time", "valid_time"), t.track, ["storm_id"], "valid_time", ["pass_id"], ["lat", "lon"]).where("f0 is not null and f1 is not null")
    r = asof.share(F.col("t"), F.col("f0.t"), F.col("f1.t"))
    moved = found.select("pass_id", (F.col("f1.lat") - asof.lerp(F.col("f0.lat"), F.col("f1.lat"), r)).alias("dlat"), C.lon_delta(asof.lerp_lon(F.col("f0.lon"), F.col("f1.lon"), r), F.col("f1.lon")).alias("dlon"), (F.col("pass_id") % 8).alias("frame_id"), (F.col("pass_id") % 48).alias("pr"))
    return moved.join(t.pixel.select("frame_id", "pr", "lat", "lon"), ["frame_id", "pr"]).groupBy("pass_id").agg(F.count("*").alias("n"), F.round(F.min(F.col("lat") + F.col("dlat")), 6).alias("lat_min"), F.round(F.max(C.wrap180(F.col("lon") + F.col("dlon"))), 6).alias("lon_max"))


@query("""WITH b AS (SELECT t.fix_id, t.valid_time, b.scene_time AS s, (epoch_us(t.valid_time) - epoch_us(b.scene_time)) / 3.6e9 AS age
  FROM track t ASOF LEFT JOIN overpass b ON b.storm_id = t.storm_id AND b.scene_time <= t.valid_time),
c AS (SELECT t.fix_id, (epoch_us(a.scene_time) - epoch_us(t.valid_time)) / 6e7 AS minutes FROM track t ASOF LEFT JOIN overpass a ON a.storm_id = t.storm_id AND a.scene_time >= t.valid_time)
SELECT b.fix_id, round(CASE WHEN age <= 1.5 THEN 1.0 WHEN age >= 6 THEN 0.15 WHEN age IS NULL THEN NULL ELSE 1 - (age - 1.5) / 4.5 * 0.85 END, 6) AS age_confidence,
  round(CASE WHEN minutes <= 0 THEN 1.0 WHEN minutes >= 60 THEN 0.0 WHEN minutes IS NULL THEN NULL ELSE 1 - minutes / 60 END, 6) AS crossfade_confidence
FROM b JOIN c ON b.fix_id = c.fix_id""")
def age_confidence(t: Tables) -> DataFrame:
    """Confidence in the last pass by its age, and in the next one by how soon it comes."""
    passes = t.overpass.withColumnRenamed("scene_time", "valid_time")
    found = asof.bracket(t.track, passes, ["storm_id"], "valid_time", ["fix_id"], ["pass_id"])
    return found.select("fix_id", F.round(C.age_confidence(C.hours_between(F.col("f0.t"), F.col("t"))), 6).alias("age_confidence"), F.round(C.crossfade_confidence(C.hours_between(F.col("t"), F.col("f1.t")) * 60), 6).alias("crossfade_confidence"))


@query(f"""WITH {_BRACKET}, pos AS (SELECT pass_id, storm_id, sensor, scene_time, lat0 + (lat1 - lat0) * r AS lat, {_LON} AS lon FROM x),
hit AS (SELECT *, {distance('lat + ((pass_id % 21) - 10) / 10.0', 'lon + ((pass_id % 13) - 6) / 10.0', 'lat', 'lon')} AS d FROM pos)
SELECT storm_id, sensor, max(scene_time) AS scene_time, arg_max(pass_id, scene_time) AS pass_id, count(*) AS hits FROM hit WHERE d <= 75 GROUP BY storm_id, sensor""")
def swath_hit_storm(t: Tables) -> DataFrame:
    """Latest pass per storm and sensor whose nearest pixel is within 75 km of the storm then."""
    at = asof.interpolated(t.overpass, t.track, ["pass_id", "sensor"])
    d = C.distance_km(F.col("lat") + ((F.col("pass_id") % 21) - 10) / 10.0, F.col("lon") + ((F.col("pass_id") % 13) - 6) / 10.0, F.col("lat"), F.col("lon"))
    return at.where(d <= 75).groupBy("storm_id", "sensor").agg(F.max("t").cast("timestamp_ntz").alias("scene_time"), F.max_by("pass_id", "t").alias("pass_id"), F.count("*").alias("hits"))


@query("""WITH f AS (SELECT storm_id, fix_id, row_number() OVER (PARTITION BY storm_id ORDER BY valid_time) - 1 AS i, count(*) OVER (PARTITION BY storm_id) AS n FROM track),
k AS (SELECT *, greatest(2, CAST(ceil(n / 5.0) AS BIGINT) + 1) AS m FROM f),
p AS (SELECT DISTINCT storm_id, CAST(round_even((n - 1) * j / (m - 1.0), 0) AS BIGINT) AS i FROM (SELECT DISTINCT storm_id, n, m FROM k) s, LATERAL (SELECT unnest(generate_series(0, m - 1)) AS j) g)
SELECT k.fix_id, CASE WHEN p.i IS NULL THEN 0 ELSE 1 END AS is_checkpoint, max(p.i) OVER (PARTITION BY k.storm_id ORDER BY k.i) AS checkpoint FROM k LEFT JOIN p ON k.storm_id = p.storm_id AND k.i = p.i""")
def checkpoint_assign(t: Tables) -> DataFrame:
    """Evenly spaced checkpoint frames of each storm, and the checkpoint before or at each frame."""
    w = Window.partitionBy("storm_id")
    frames = t.track.select("storm_id", "fix_id", (F.row_number().over(w.orderBy("valid_time")) - 1).cast("long").alias("i"), F.count("*").over(w).alias("n"))
    m = F.greatest(F.lit(2), F.ceil(F.col("n") / 5) + 1)
    picks = F.transform(F.sequence(F.lit(0).cast("long"), m - 1), lambda j: F.rint((F.col("n") - 1) * j / (m - 1)).cast("long"))
    chosen = F.array_contains(picks, F.col("i"))
    return frames.select("fix_id", chosen.cast("int").alias("is_checkpoint"), F.last(F.when(chosen, F.col("i")), ignorenulls=True).over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).alias("checkpoint"))


_ERAS = ", ".join(f"({k}, '{n}', {lon}, TIMESTAMP '{a}', TIMESTAMP '{b}')" for k, (n, lon, a, b) in enumerate(K.SATELLITES))
_ANGLE = f"degrees(acos({clip('cos(radians(t.lat)) * cos(radians(t.lon - e.sub_lon))', -1, 1)}))"


@query(f"""WITH e(k, satellite, sub_lon, a, b) AS (VALUES {_ERAS}),
m AS (SELECT t.fix_id, e.satellite, e.k, {_ANGLE} AS angle FROM track t JOIN e ON t.valid_time >= e.a AND t.valid_time < e.b)
SELECT fix_id, arg_min(satellite, (angle, k)) AS satellite, round(min(angle), 6) AS angle FROM m WHERE angle <= 65 GROUP BY fix_id""")
def satellite_era_select(t: Tables) -> DataFrame:
    """Operational satellite that sees the storm best, within 65 degrees of its sub-point; a table of four rows is broadcast."""
    eras = t.spark.createDataFrame([(k, *e) for k, e in enumerate(K.SATELLITES)], "k int, satellite string, sub_lon double, a string, b string")
    x = t.track.join(F.broadcast(eras), (F.col("valid_time") >= F.col("a").cast("timestamp_ntz")) & (F.col("valid_time") < F.col("b").cast("timestamp_ntz")))
    x = x.withColumn("angle", C.central_angle(F.col("lat"), F.col("lon"), F.col("sub_lon"))).where("angle <= 65")
    return x.groupBy("fix_id").agg(F.min_by("satellite", F.struct("angle", "k")).alias("satellite"), F.round(F.min("angle"), 6).alias("angle"))


_MILES = "2 * 3958.8 * asin(sqrt(least(1, pow(sin(radians(s.lat - t.lat) / 2), 2) + cos(radians(t.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - t.lon) / 2), 2))))"


@query(f"""WITH m AS (SELECT t.fix_id, s.station_id, {_MILES} AS d FROM track t, station s)
SELECT fix_id, arg_min(station_id, (d, station_id)) AS station_id, round(min(d), 4) AS miles FROM m WHERE d <= 200 GROUP BY fix_id""")
def station_nearest_in_range(t: Tables) -> DataFrame:
    """Nearest radar station within 200 miles, through cells of four degrees that both sides share."""
    return stations_in_range(t.track, t.station)


def stations_in_range(track: DataFrame, station: DataFrame) -> DataFrame:
    """fix_id, station_id, miles of each fix with a station in range. Of stations at one place the smallest id stands for
    all, since it wins at any distance: so a fix meets places, however many stations they have."""
    station = station.groupBy("lat", "lon").agg(F.min("station_id").alias("station_id"))
    cell = 4.0  # degrees of latitude: 200 miles are 2.9
    span = 180 / 3.14159 * 2 * F.asin(F.least(F.lit(1.0), F.sin(F.lit(200 / K.EARTH_MI / 2)) / F.cos(F.radians(F.least(F.abs("lat") + 3, F.lit(89.0))))))
    rows = F.sequence(F.floor((F.col("lat") - 3) / cell), F.floor((F.col("lat") + 3) / cell))
    columns = F.transform(F.sequence(F.floor((F.col("lon") - span) / cell), F.floor((F.col("lon") + span) / cell)), lambda c: F.pmod(c, F.lit(int(360 / cell))))
    fixes = track.select("fix_id", "lat", "lon", F.explode(rows).alias("row"), columns.alias("cs")).select("fix_id", "lat", "lon", "row", F.explode(F.array_distinct("cs")).alias("column"))
    stations = station.select("station_id", F.col("lat").alias("slat"), F.col("lon").alias("slon"), F.floor(F.col("lat") / cell).alias("row"), F.pmod(F.floor(F.col("lon") / cell), F.lit(int(360 / cell))).alias("column"))
    met = fixes.join(stations, ["row", "column"]).withColumn("d", C.haversine(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon"), K.EARTH_MI)).where("d <= 200")
    return met.groupBy("fix_id").agg(F.min_by("station_id", F.struct("d", "station_id")).alias("station_id"), F.round(F.min("d"), 4).alias("miles"))


@query("""WITH s AS (SELECT pass_id, sensor, scene_time FROM overpass)
SELECT a.pass_id, b.pass_id AS other_id FROM s a JOIN s b ON a.sensor = b.sensor AND a.pass_id < b.pass_id AND abs(epoch_us(a.scene_time) - epoch_us(b.scene_time)) <= 600000000""")
def same_scan_match(t: Tables) -> DataFrame:
    """Pairs of the same sensor at most ten minutes apart."""
    return scan_pairs(t.overpass)


def scan_pairs(passes: DataFrame, apart_s: int = 600) -> DataFrame:
    """pass_id, other_id of all passes of a sensor that are so many seconds apart at most, the smaller id first.

    Passes meet those of their own bucket of that width and of the next one, so a task holds the passes of one bucket,
    and each pair comes up once. The pairs grow with the square of the passes of a bucket, as the result does.
    """
    s = passes.select("pass_id", "sensor", F.unix_micros(F.col("scene_time").cast("timestamp")).alias("us")).withColumn("bucket", F.floor(F.col("us") / (apart_s * 1_000_000)))
    other = s.select(F.col("pass_id").alias("id2"), "sensor", F.col("us").alias("us2"), F.col("bucket").alias("b2"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"))).alias("bucket"))
    once = (F.col("bucket") < F.col("b2")) | (F.col("pass_id") < F.col("id2"))
    met = s.join(other, ["sensor", "bucket"]).where(once & (F.col("pass_id") != F.col("id2")) & (F.abs(F.col("us") - F.col("us2")) <= apart_s * 1_000_000))
    return met.select(F.least("pass_id", "id2").alias("pass_id"), F.greatest("pass_id", "id2").alias("other_id"))


@query(f"""SELECT fix_id, round({distance('lat', 'lon', '20.0', '179.5')}, 4) AS km, round(2 * 6371 * asin(sqrt(pow(sin(radians(20 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(20)) * pow(sin(radians(179.5 - lon) / 2), 2))), 4) AS great_circle_km,
round((degrees(atan2({wrap('179.5 - lon')}, 20 - lat)) + 360) % 360, 6) AS bearing,
round(46.29 * exp(-0.0153 * vmax_kt + 0.0166 * abs(lat)), 6) AS rmw_fallback_km,
CASE WHEN vmax_kt < 34 THEN 'TD' WHEN vmax_kt < 64 THEN 'TS' WHEN vmax_kt < 96 THEN 'C1-2' ELSE 'C3-5' END AS band FROM track""")
def geometry_terms(t: Tables) -> DataFrame:
    """Distances, bearing, the radius that stands in for a missing one, and the intensity band."""
    lat, lon = F.col("lat"), F.col("lon")
    return t.track.select(
        "fix_id", F.round(C.distance_km(lat, lon, 20.0, 179.5), 4).alias("km"), F.round(C.haversine(lat, lon, F.lit(20.0), F.lit(179.5)), 4).alias("great_circle_km"),
        F.round(C.bearing(20 - lat, C.lon_delta(lon, F.lit(179.5))), 6).alias("bearing"), F.round(C.rmw_km(F.lit(None).cast("double"), F.col("vmax_kt"), lat), 6).alias("rmw_fallback_km"), C.intensity_band(F.col("vmax_kt")).alias("band"),
    )


_H = "(hour(valid_time) + minute(valid_time) / 60.0 + second(valid_time) / 3600.0)"
_G = f"(2 * pi() / 365 * (dayofyear(valid_time) - 1 + ({_H} - 12) / 24))"


@query(f"""WITH a AS (SELECT fix_id, lat, lon, {_H} AS h, {_G} AS g FROM track),
b AS (SELECT *, 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS e,
  0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS d FROM a),
c AS (SELECT fix_id, degrees(asin(sin(radians(lat)) * sin(d) + cos(radians(lat)) * cos(d) * cos(radians((h * 60 + e + 4 * lon) / 4 - 180)))) AS el FROM b)
SELECT fix_id, round(el, 4) AS elevation, el >= 5 AS is_day FROM c""")
def solar_elevation(t: Tables) -> DataFrame:
    """Solar elevation at each fix; day from five degrees up."""
    el = C.solar_elevation(F.col("lat"), F.col("lon"), F.col("valid_time").cast("timestamp"))
    return t.track.select("fix_id", F.round(el, 4).alias("elevation"), (el >= 5).alias("is_day"))
