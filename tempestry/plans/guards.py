"""Names of files, checks of sensors and values, and small figures about single examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempestry.functions import columns as C
from tempestry.plans.registry import Tables, query, wrap
from tempestry.sources import listings

_STAMP = "strftime(ts, '%Y%j%H%M%S')"


@query(f"""SELECT event_id, 'G' || (16 + event_id % 3) AS satellite, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS start_s
FROM events WHERE event_type = 'click' AND {_STAMP} IS NOT NULL""")
def lightning_key_time(t: Tables) -> DataFrame:
    """Satellite and start of lightning files, from their names."""
    stamp = F.date_format("ts", "yyyyDDDHHmmss")
    name = F.concat(
        F.lit("GLM-L2-LCFA/2024/OR_GLM-L2-LCFA_G"), (16 + F.col("event_id") % 3).cast("string"), F.lit("_s"), stamp, F.lit("0_e0_c0.nc")
    )
    found = t.events.where("event_type = 'click'").select("event_id", listings.lightning(name).alias("x")).where("x is not null")
    return found.select("event_id", "x.satellite", F.unix_seconds("x.start").alias("start_s"))


@query("""WITH s AS (SELECT user_id % 20 AS station, date_trunc('second', ts) AS at FROM events WHERE event_type = 'click'),
p AS (SELECT event_id, user_id % 20 AS station, ts FROM events WHERE event_type = 'view')
SELECT p.event_id, 'K' || lpad(CAST(p.station AS VARCHAR), 3, '0') AS station, CAST(epoch(max(s.at)) AS BIGINT) AS scan_s
FROM p JOIN s ON s.station = p.station AND s.at <= p.ts AND s.at >= p.ts - INTERVAL 3 HOUR GROUP BY 1, 2""")
def radar_nearest_scan(t: Tables) -> DataFrame:
    """The newest radar volume of a station in the three hours before each pass, by an as-of pass over names."""
    station = F.concat(F.lit("K"), F.lpad((F.col("user_id") % 20).cast("string"), 3, "0"))
    name = F.concat(station, F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_V06"))
    scans = t.events.where("event_type = 'click'").select(listings.radar_scan(name).alias("x"))
    scans = scans.select("x.station", F.col("x.time").alias("ts"), F.lit(0).alias("order"), F.lit(None).cast("long").alias("event_id"))
    passes = t.events.where("event_type = 'view'").select(station.alias("station"), F.col("ts").cast("timestamp"), F.lit(1).alias("order"), F.col("event_id").cast("long"))
    back = Window.partitionBy("station").orderBy("ts", "order").rowsBetween(Window.unboundedPreceding, 0)
    newest = F.max(F.when(F.col("order") == 0, F.col("ts"))).over(back)
    found = scans.union(passes).withColumn("scan", newest).where("order = 1 and scan >= ts - interval 3 hours")
    return found.select("event_id", "station", F.unix_seconds("scan").alias("scan_s"))


@query("""WITH n AS (SELECT file_id, filename, CASE file_id % 7 WHEN 0 THEN 'x_wsfm_' WHEN 1 THEN 'mwi-' WHEN 2 THEN 'ssmis_gmi' WHEN 3 THEN '1C.gmi.' ELSE '' END || filename AS name FROM overpass_file)
SELECT file_id, CASE WHEN upper(name) LIKE '%SSMIS%' THEN 'SSMIS' WHEN upper(name) LIKE '%WSFM%' OR upper(name) LIKE '%MWI%' THEN 'WSFM' WHEN upper(name) LIKE '%GMI%' THEN 'GMI' END AS sensor,
(upper(split_part(filename, '_', 4)) LIKE 'GMI%' OR upper(split_part(filename, '_', 4)) LIKE 'AMSR2%') AS allowed,
CAST(epoch(try_strptime(split_part(replace(filename, '.nc', ''), '_', 7), '%Y%m%d%H%M%S')) AS BIGINT) AS scene_s FROM n""")
def sensor_of_filename(t: Tables) -> DataFrame:
    """Sensor and scene time by a file's name, and whether its instrument may be trained on."""
    k = F.col("file_id") % 7
    prefix = F.when(k == 0, "x_wsfm_").when(k == 1, "mwi-").when(k == 2, "ssmis_gmi").when(k == 3, "1C.gmi.").otherwise("")
    instrument = F.upper(F.get(F.split("filename", "_"), F.lit(3)))
    stamp = F.get(F.split(F.regexp_replace("filename", r"\.nc$", ""), "_"), F.lit(6))
    return t.overpass_file.select(
        "file_id",
        listings.sensor_of(F.concat(prefix, F.col("filename"))).alias("sensor"),
        (instrument.startswith("GMI") | instrument.startswith("AMSR2")).alias("allowed"),
        F.unix_seconds(F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss"))).alias("scene_s"),
    )


@query("""WITH x AS (SELECT s_suppkey AS id, unnest([(1, 10.65, 'V'), (2, 10.65, 'H'), (s_suppkey % 9 + 3, 18.5 + s_suppkey % 4, 'V')]) AS c FROM supplier)
SELECT id, c[1] AS channel, CAST(c[2] AS DOUBLE) AS ghz, c[3] AS polarisation FROM x""")
def channel_order(t: Tables) -> DataFrame:
    """Channels by number, from the long name of a packed variable."""
    k, f = F.col("s_suppkey") % 9 + 3, F.round(18.5 + F.col("s_suppkey") % 4, 1)
    long_name = F.concat(F.lit("1) 10.65 GHz V-Pol 2) 10.65 GHz H-Pol "), k.cast("string"), F.lit(")  "), f.cast("string"), F.lit(" GHz VPol"))
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), F.explode(listings.channels(long_name)).alias("channel", "x"))
    return rows.select("id", "channel", "x.ghz", "x.polarisation")


@query(f"""WITH b AS (SELECT frame_id, min(pr) AS r0, max(pr) AS r1, min(pc) AS c0, max(pc) AS c1 FROM pixel_many
WHERE abs(lat - 25) <= 1.5 AND abs({wrap('lon - 180')}) <= 1.3 GROUP BY 1)
SELECT p.frame_id, p.pr, p.pc, round(p.ir, 4) AS ir FROM pixel_many p JOIN b ON p.frame_id = b.frame_id AND p.pr BETWEEN b.r0 AND b.r1 AND p.pc BETWEEN b.c0 AND b.c1""")
def crop_to_box(t: Tables) -> DataFrame:
    """The smallest rectangle of rows and columns that holds every pixel of a box across the date line, of each frame."""
    p = t.pixel_many
    near = p.where((F.abs(F.col("lat") - 25) <= 1.5) & (F.abs(C.lon_delta(F.lit(180.0), F.col("lon"))) <= 1.3))
    ends = [f(x).alias(f"{x[1]}{k}") for x in ("pr", "pc") for k, f in enumerate((F.min, F.max))]
    box = near.groupBy("frame_id").agg(*ends)
    met = p.join(box, "frame_id").where("pr between r0 and r1 and pc between c0 and c1")
    return met.select("frame_id", "pr", "pc", F.round("ir", 4).alias("ir"))


@query("""SELECT frame_id, count(*) FILTER (v37 IS NULL) AS missing, count(*) FILTER (NOT isfinite(ir)) AS broken, round(median(v89), 5) AS baseline, min(ir) = max(ir) AS flat
FROM pixel_many GROUP BY 1""")
def finite_check(t: Tables) -> DataFrame:
    """Missing and broken values of each frame, and the median of a field as its baseline."""
    broken = F.count_if(F.isnan("ir") | (F.abs("ir") == float("inf")))
    return t.pixel_many.groupBy("frame_id").agg(
        F.count_if(F.col("v37").isNull()).alias("missing"),
        broken.alias("broken"),
        F.round(F.median("v89"), 5).alias("baseline"),
        (F.min("ir") == F.max("ir")).alias("flat"),
    )


@query("""WITH s AS (SELECT avg(vmax_kt) AS vm, stddev_pop(vmax_kt) AS vs, avg(rmw_nm) AS rm, stddev_pop(rmw_nm) AS rs FROM track)
SELECT fix_id, round(sqrt(pow((vmax_kt - vm) / vs, 2) + pow((coalesce(rmw_nm, rm) - rm) / rs, 2)), 6) AS sigma FROM track, s""")
def novelty_sigma(t: Tables) -> DataFrame:
    """How far a storm's intensity and size are from those trained on, in deviations; one row of statistics."""
    pairs = (("vmax_kt", "v"), ("rmw_nm", "r"))
    s = t.track.agg(*(f(c).alias(f"{n}{k}") for c, n in pairs for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = [(F.coalesce(F.col(c), F.col(f"{n}m")) - F.col(f"{n}m")) / F.col(f"{n}s") for c, n in pairs]
    return t.track.crossJoin(F.broadcast(s)).select("fix_id", F.round(F.hypot(*z), 6).alias("sigma"))


@query("""SELECT frame_id, round(avg(abs(v37 - 230)) + 0.5 * avg(abs(2.15 * (v37 - 230) - 1.15 * (h37 - 220))), 5) AS loss FROM pixel_many WHERE v37 IS NOT NULL AND h37 IS NOT NULL GROUP BY 1""")
def combined_loss(t: Tables) -> DataFrame:
    """Mean absolute error plus half of that of the corrected temperature, over the pixels that are there."""
    v, h = F.col("v37") - 230, F.col("h37") - 220
    both = t.pixel_many.where("v37 is not null and h37 is not null")
    loss = F.avg(F.abs(v)) + 0.5 * F.avg(F.abs(C.pct(v, h, 1.15)))
    return both.groupBy("frame_id").agg(F.round(loss, 5).alias("loss"))


@query("""WITH d AS (SELECT f.frame_id, f.pr, f.pc, pow(f.lat - 24.93, 2) + pow(f.lon - 179.04, 2) AS d2 FROM pixel_many f)
SELECT frame_id, arg_min(pr, (round(d2, 9), pr, pc)) AS pr, arg_min(pc, (round(d2, 9), pr, pc)) AS pc FROM d GROUP BY 1""")
def nearest_pixel(t: Tables) -> DataFrame:
    """The pixel nearest to a point in each frame, by squared degrees; the first of equals."""
    d2 = F.round(F.pow(F.col("lat") - 24.93, 2) + F.pow(F.col("lon") - 179.04, 2), 9)
    best = t.pixel_many.groupBy("frame_id").agg(F.min(F.struct(d2.alias("d2"), "pr", "pc")).alias("x"))
    return best.select("frame_id", "x.pr", "x.pc")


@query("""SELECT l_suppkey % 4 AS physics, count(DISTINCT l_suppkey) AS examples, count(DISTINCT l_suppkey % 4) OVER () > 1 AS mixed FROM lineitem GROUP BY 1""")
def physics_match(t: Tables) -> DataFrame:
    """Examples by the version of the physics they were made with, and whether there is more than one."""
    rows = t.lineitem.select((F.col("l_suppkey") % 4).alias("physics"), "l_suppkey")
    found = rows.groupBy("physics").agg(F.count_distinct("l_suppkey").alias("examples"))
    every = found.agg((F.count("*") > 1).alias("mixed"))  # one row of a group a version
    return found.crossJoin(F.broadcast(every)).select("physics", "examples", "mixed")
