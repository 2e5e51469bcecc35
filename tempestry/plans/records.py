"""Queries over listings, ledgers, environment series, calibration state and training splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.functions import columns as C
from tempestry.operators import asof, neighbours
from tempestry.operators.tables import in_runs, once, ranked
from tempestry.plans.registry import Tables, clip, query, wrap
from tempestry.sources import besttrack, listings


@query("""WITH n AS (SELECT o_orderkey AS id, 'OR_ABI-L1b-Rad' || CASE o_orderkey % 3 WHEN 0 THEN 'M1' WHEN 1 THEN 'C' ELSE 'F' END || '-M6C' || lpad(CAST(o_orderkey % 16 + 1 AS VARCHAR), 2, '0') || '_G' || CAST(16 + o_orderkey % 4 AS VARCHAR)
  || '_s' || CAST(year(o_orderdate) AS VARCHAR) || lpad(CAST(dayofyear(o_orderdate) AS VARCHAR), 3, '0') || '1230123_e' || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE '0' END AS name, o_orderdate FROM orders)
SELECT id, CASE id % 3 WHEN 0 THEN 'M1' WHEN 1 THEN 'C' ELSE 'F' END AS sector, CAST(id % 16 + 1 AS INT) AS band, 'G' || CAST(16 + id % 4 AS VARCHAR) AS satellite, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) + 45012 AS start_s FROM n""")
def listing_parse_goes(t: Tables) -> DataFrame:
    """Sector, band, satellite and start of scene names made from orders."""
    key = F.col("o_orderkey")
    name = F.concat(F.lit("OR_ABI-L1b-Rad"), F.when(key % 3 == 0, "M1").when(key % 3 == 1, "C").otherwise("F"), F.lit("-M6C"), F.lpad((key % 16 + 1).cast("string"), 2, "0"), F.lit("_G"), (16 + key % 4).cast("string"), F.lit("_s"), F.date_format("o_orderdate", "yyyyDDD"), F.lit("1230123_e"))
    return t.orders.select(key.alias("id"), listings.scene(name).alias("x")).select("id", "x.sector", "x.band", "x.satellite", F.unix_seconds(F.col("x.start").cast("timestamp")).alias("start_s"))


@query("""SELECT file_id, filename[23:24] AS basin, CAST(filename[25:26] AS INT) AS storm_num, CAST(filename[27:30] AS INT) AS season, split_part(filename, '_', 4) AS instrument, split_part(filename, '_', 6) AS granule,
  CAST(epoch(strptime(regexp_extract(filename, '(\\d{14})\\.nc', 1), '%Y%m%d%H%M%S')) AS BIGINT) AS start_s FROM overpass_file WHERE split_part(filename, '_', 4) <> 'era5'""")
def listing_parse_tc(t: Tables) -> DataFrame:
    """Fields of overpass file names; environment files are refused."""
    x = t.overpass_file.select("file_id", once(listings.overpass_file(F.col("filename"))).alias("x")).where("x is not null")
    return x.select("file_id", "x.basin", "x.storm_num", "x.season", "x.instrument", "x.granule", F.unix_seconds(F.col("x.start").cast("timestamp")).alias("start_s"))


@query("""SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS start_s, CAST(epoch(date_trunc('second', ts)) AS BIGINT) + 5400 AS end_s FROM events WHERE event_type = 'view'""")
def listing_parse_pps(t: Tables) -> DataFrame:
    """Start and end of granule names, over midnight too."""
    stamp = lambda x, f: F.date_format(x, f)
    end = F.col("ts") + F.expr("INTERVAL 90 MINUTES")
    name = F.concat(F.lit("1C.GMI."), stamp("ts", "yyyyMMdd"), F.lit("-S"), stamp("ts", "HHmmss"), F.lit("-E"), stamp(end, "HHmmss"), F.lit(".V07B.HDF5"))
    return t.events.where("event_type = 'view'").select("event_id", listings.granule(name).alias("x")).select("event_id", F.unix_seconds(F.col("x.start").cast("timestamp")).alias("start_s"), F.unix_seconds(F.col("x.end").cast("timestamp")).alias("end_s"))


@query("""WITH r AS (SELECT storm_id, date_trunc('hour', valid_time) AS h, fix_id, CAST(round(abs(lat) * 10) AS INT) AS la, CAST(round(abs(lon) * 10) AS INT) AS lo, lat, lon, vmax_kt, coalesce(roci_nm, 0) AS roci, coalesce(rmw_nm, 0) AS rmw FROM track)
SELECT storm_id, CAST(epoch(h) AS BIGINT) AS time_s, round(arg_max(CASE WHEN lat < 0 THEN -la ELSE la END, fix_id) / 10.0, 1) AS lat, round(arg_max(CASE WHEN lon < 0 THEN -lo ELSE lo END, fix_id) / 10.0, 1) AS lon,
  CAST(arg_max(vmax_kt, fix_id) AS DOUBLE) AS vmax_kt, CAST(nullif(max(roci), 0) AS DOUBLE) AS roci_nm, CAST(nullif(max(rmw), 0) AS DOUBLE) AS rmw_nm FROM r GROUP BY storm_id, h""")
def bdeck_parse_dedup(t: Tables) -> DataFrame:
    """Best-track lines rendered from the track and parsed back: the last line of a time, the largest radii."""
    side = lambda x, plus, minus: F.concat(F.round(F.abs(x) * 10).cast("int").cast("string"), F.when(F.col(x) < 0, minus).otherwise(plus))
    text = F.concat_ws(", ", F.lit("AL"), F.lit("01"), F.date_format("valid_time", "yyyyMMddHH"), F.lit(""), F.lit("BEST"), F.lit("0"), side("lat", "N", "S"), side("lon", "E", "W"), F.col("vmax_kt").cast("int"), F.lit("1000"), F.lit("TS"), *(F.lit(x) for x in "1234567"), F.coalesce(F.col("roci_nm"), F.lit(0.0)).cast("int"), F.coalesce(F.col("rmw_nm"), F.lit(0.0)).cast("int"))
    found = besttrack.parse(t.track.select("storm_id", "fix_id", text.alias("text")), "storm_id", "fix_id", "text")
    return found.select("storm_id", F.unix_seconds(F.col("valid_time").cast("timestamp")).alias("time_s"), F.round("lat", 1).alias("lat"), F.round("lon", 1).alias("lon"), "vmax_kt", "roci_nm", "rmw_nm")


@query("SELECT fix_id, round(CAST(round(lat * 10) AS INT) / 10.0, 1) AS lat FROM track")
def latlon_parse(t: Tables) -> DataFrame:
    """Tenths with a hemisphere letter as signed degrees."""
    text = F.concat(F.round(F.abs("lat") * 10).cast("int").cast("string"), F.when(F.col("lat") < 0, "S").otherwise("N"))
    return t.track.select("fix_id", F.round(besttrack.degrees(text), 1).alias("lat"))


@query("SELECT f.file_id FROM overpass_file f WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = f.file_id AND l.l_quantity > 25)")
def resume_antijoin(t: Tables) -> DataFrame:
    """Files that the ledger doesn't have as done."""
    return t.overpass_file.join(t.lineitem.where("l_quantity > 25").select(F.col("l_orderkey").alias("file_id")), "file_id", "left_anti").select("file_id")


@query("SELECT o.pass_id FROM overpass o WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'purchase' AND e.user_id = o.storm_id AND abs(epoch_us(e.ts) - epoch_us(o.scene_time)) <= 36000000000)")
def resume_interval_antijoin(t: Tables) -> DataFrame:
    """Passes without a done one of the same storm within ten hours, by one window over both."""
    done = t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("storm_id"), F.col("ts").alias("valid_time"))
    found = asof.bracket(t.overpass.withColumnRenamed("scene_time", "valid_time"), done.withColumn("one", F.lit(1)), ["storm_id"], "valid_time", ["pass_id"], ["one"])
    near = lambda x: F.coalesce(F.abs(C.hours_between(F.col("t"), F.col(x))) <= 10, F.lit(False))
    return found.where(~near("f0.t") & ~near("f1.t")).select("pass_id")


@query("""SELECT event_type AS reason, count(*) AS n, count(DISTINCT user_id) AS storms, event_type LIKE 'err%' AS infrastructural, round(count(*) * 1.0 / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type""")
def skip_reason_hist(t: Tables) -> DataFrame:
    """How often each reason occurs, and its share of all."""
    h = t.events.groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("storms"))
    return h.select("reason", "n", "storms", F.col("reason").startswith("err").alias("infrastructural"), F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query("""WITH h AS (SELECT user_id % 10 AS run, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT run, CAST(sum(n) FILTER (event_type <> 'signup') AS BIGINT) AS skips, CAST(coalesce(sum(n) FILTER (event_type = 'signup'), 0) AS BIGINT) AS saves, coalesce(sum(n) FILTER (event_type = 'signup'), 0) = 0 AND sum(n) >= 150 AND max(n) >= 0.95 * sum(n) AS abort FROM h GROUP BY run""")
def abort_rule(t: Tables) -> DataFrame:
    """Runs that save nothing and skip for one reason."""
    h = t.events.groupBy((F.col("user_id") % 10).alias("run"), "event_type").agg(F.count("*").alias("n"))
    saved = F.coalesce(F.sum(F.when(F.col("event_type") == "signup", F.col("n"))), F.lit(0))
    return h.groupBy("run").agg(F.sum(F.when(F.col("event_type") != "signup", F.col("n"))).alias("skips"), saved.alias("saves"), ((saved == 0) & (F.sum("n") >= 150) & (F.max("n") >= 0.95 * F.sum("n"))).alias("abort"))


@query("""SELECT filename[23:24] AS basin, split_part(filename, '_', 4) AS instrument, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes,
CASE WHEN sum(size_bytes) < 1024 THEN sum(size_bytes)::VARCHAR || ' B' WHEN sum(size_bytes) < 1048576 THEN printf('%.1f KB', sum(size_bytes) / 1024.0) WHEN sum(size_bytes) < 1073741824 THEN printf('%.1f MB', sum(size_bytes) / 1048576.0) ELSE printf('%.1f GB', sum(size_bytes) / 1073741824.0) END AS size
FROM overpass_file WHERE split_part(filename, '_', 4) <> 'era5' GROUP BY ROLLUP (filename[23:24], split_part(filename, '_', 4))""")
def estimate_sizes_rollup(t: Tables) -> DataFrame:
    """Files and bytes by basin and instrument with subtotals, the bytes in words up to GB."""
    x = t.overpass_file.select("size_bytes", listings.overpass_file(F.col("filename")).alias("x")).where("x is not null").select("size_bytes", "x.basin", "x.instrument")
    return x.rollup("basin", "instrument").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes")).withColumn("size", listings.human_bytes(F.col("bytes"), "GB"))


def env(t: Tables) -> DataFrame:
    """Environment series: a value at each purchase, some of them missing."""
    return t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("storm_id"), F.col("ts").alias("valid_time"), F.when(F.col("event_id") % 6 != 0, (F.col("event_id") % 30).cast("double")).alias("shear"), ((F.col("event_id") * 37) % 360).cast("double").alias("heading"))


_ENV = """e AS (SELECT user_id AS storm_id, ts AS valid_time, CAST(event_id % 30 AS DOUBLE) AS shear, CAST((event_id * 37) % 360 AS DOUBLE) AS heading FROM events WHERE event_type = 'purchase' AND event_id % 6 <> 0),
b AS (SELECT o.pass_id, o.storm_id, o.scene_time, e.valid_time AS t0, e.shear AS s0, e.heading AS h0 FROM overpass o ASOF LEFT JOIN e ON o.storm_id = e.storm_id AND o.scene_time >= e.valid_time),
c AS (SELECT b.*, e.valid_time AS t1, e.shear AS s1, e.heading AS h1 FROM b ASOF LEFT JOIN e ON b.storm_id = e.storm_id AND b.scene_time <= e.valid_time),
x AS (SELECT *, CASE WHEN t0 = t1 THEN 0 ELSE CAST(epoch_us(scene_time) - epoch_us(t0) AS DOUBLE) / (epoch_us(t1) - epoch_us(t0)) END AS r, (epoch_us(scene_time) - epoch_us(t0)) / 3.6e9 AS back, (epoch_us(t1) - epoch_us(scene_time)) / 3.6e9 AS ahead FROM c)"""


@query(f"WITH {_ENV} SELECT pass_id, round(CASE WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN s0 + (s1 - s0) * r WHEN t0 IS NOT NULL AND back <= 6 THEN s0 WHEN t1 IS NOT NULL AND ahead <= 6 THEN s1 END, 6) AS shear FROM x")
def env_interp(t: Tables) -> DataFrame:
    """Environment at each pass: between its neighbours, or the nearest one within six hours past the ends; missing values are no neighbours."""
    found = asof.bracket(t.overpass.withColumnRenamed("scene_time", "valid_time"), env(t).where("shear is not null"), ["storm_id"], "valid_time", ["pass_id"], ["shear"])
    r = asof.share(F.col("t"), F.col("f0.t"), F.col("f1.t"))
    both = F.col("f0").isNotNull() & F.col("f1").isNotNull()
    value = F.when(both, asof.lerp(F.col("f0.shear"), F.col("f1.shear"), r)).when(C.hours_between(F.col("f0.t"), F.col("t")) <= 6, F.col("f0.shear")).when(C.hours_between(F.col("t"), F.col("f1.t")) <= 6, F.col("f1.shear"))
    return found.select("pass_id", F.round(value, 6).alias("shear"))


@query(f"""WITH {_ENV}, v AS (SELECT pass_id, s0 * sin(radians(h0)) + (s1 * sin(radians(h1)) - s0 * sin(radians(h0))) * r AS u, s0 * cos(radians(h0)) + (s1 * cos(radians(h1)) - s0 * cos(radians(h0))) * r AS w FROM x WHERE t0 IS NOT NULL AND t1 IS NOT NULL)
SELECT pass_id, round(sqrt(u * u + w * w), 5) AS shear, round(CASE WHEN sqrt(u * u + w * w) > 1e-6 THEN (degrees(atan2(u, w)) + 360) % 360 END, 4) AS heading FROM v""")
def env_vector_interp(t: Tables) -> DataFrame:
    """Shear interpolated by its components."""
    found = asof.bracket(t.overpass.withColumnRenamed("scene_time", "valid_time"), env(t).where("shear is not null"), ["storm_id"], "valid_time", ["pass_id"], ["shear", "heading"]).where("f0 is not null and f1 is not null")
    r = asof.share(F.col("t"), F.col("f0.t"), F.col("f1.t"))
    part = lambda f: asof.lerp(F.col("f0.shear") * f(F.radians("f0.heading")), F.col("f1.shear") * f(F.radians("f1.heading")), r)
    v = found.select("pass_id", part(F.sin).alias("u"), part(F.cos).alias("w")).withColumn("s", F.sqrt(F.col("u") * F.col("u") + F.col("w") * F.col("w")))
    return v.select("pass_id", F.round("s", 5).alias("shear"), F.round(F.when(F.col("s") > 1e-6, (F.degrees(F.atan2("u", "w")) + 360) % 360), 4).alias("heading"))


@query("""SELECT event_id, round(coalesce(CASE WHEN event_id % 6 <> 0 THEN (event_id % 30 - 10) / 5.0::DOUBLE END, 0), 6) AS shear, round(coalesce(CASE WHEN event_id % 4 <> 0 THEN (event_id % 100 - 50) / 20.0::DOUBLE END, 0), 6) AS humidity, (event_id % 6 <> 0 OR event_id % 4 <> 0)::INT AS present FROM events""")
def env_encode(t: Tables) -> DataFrame:
    """Normalised features, 0 where missing, and a flag that any is there."""
    i = F.col("event_id")
    shear, humidity = F.when(i % 6 != 0, (i % 30 - 10) / 5.0), F.when(i % 4 != 0, (i % 100 - 50) / 20.0)
    return t.events.select("event_id", F.round(F.coalesce(shear, F.lit(0.0)), 6).alias("shear"), F.round(F.coalesce(humidity, F.lit(0.0)), 6).alias("humidity"), (shear.isNotNull() | humidity.isNotNull()).cast("int").alias("present"))


@query("""WITH s AS (SELECT user_id, list(CAST(round(value) AS DOUBLE) ORDER BY ts, event_id) AS v FROM events GROUP BY user_id)
SELECT user_id, len(v) AS n, round(list_reduce(list_prepend(0.0::DOUBLE, v), lambda a, x: greatest(-40, least(40, 0.85 * a + 0.15 * (x - 50)))), 5) AS offset_k FROM s""")
def ema_offset(t: Tables) -> DataFrame:
    """Calibration offset of each key: an ordered fold, clamped to 40 K."""
    s = clamped_fold(t.events.select("user_id", "ts", "event_id", F.round("value").cast("double").alias("v")))
    return s.select("user_id", "n", F.round(F.greatest("low", F.least("high", "shift")), 5).alias("offset_k"))


def clamped_fold(events: DataFrame, run: int = 1024) -> DataFrame:
    """user_id, n, scale, shift, low, high: a -> clamp(scale a + shift, low, high), all of a user's steps in order.

    Steps compose to such a map again. They are sorted by ranges over all users, and folded in runs of so many rows, then
    runs of runs, so a key's rows are in many tasks and no row holds more than a run, or run ** -2 of a key's rows.
    """
    order = ["user_id", "ts", "event_id", "v"]
    step = lambda x, null: F.when(F.col("v").isNull(), F.lit(null)).otherwise(x)  # noqa: E731  greatest and least pass over a missing value: it gives 40
    maps = events.repartitionByRange(*order).sortWithinPartitions(*order)
    maps = maps.select("user_id", F.monotonically_increasing_id().alias("at"), F.lit(1).cast("long").alias("n"), step(F.lit(0.85), 0.0).alias("scale"), step(0.15 * (F.col("v") - 50), 40.0).alias("shift"), F.lit(-40.0).alias("low"), F.lit(40.0).alias("high"))
    fields = ["scale", "shift", "low", "high"]
    start = F.struct(*(F.lit(x).alias(f) for f, x in zip(fields, (1.0, 0.0, -40.0, 40.0), strict=True)))

    def then(a: Column, b: Column) -> Column:
        held = lambda x: F.greatest(b["low"], F.least(b["high"], b["scale"] * x + b["shift"]))
        return F.struct((b["scale"] * a["scale"]).alias("scale"), (b["scale"] * a["shift"] + b["shift"]).alias("shift"), held(a["low"]).alias("low"), held(a["high"]).alias("high"))

    for keys in (["user_id", F.floor(F.col("at") / run)], ["user_id", F.floor(F.col("at") / run**2)], ["user_id"]):
        runs = maps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", *fields))).alias("s"), F.min("at").alias("at"), F.sum("n").alias("n"))
        maps = runs.select("user_id", "at", "n", F.aggregate("s", start, then).alias("m")).select("user_id", "at", "n", "m.*")
    return maps.drop("at")


@query("SELECT storm_id, max(vmax_kt) AS peak, CASE WHEN max(vmax_kt) < 34 THEN 'TD' WHEN max(vmax_kt) < 64 THEN 'TS' WHEN max(vmax_kt) < 96 THEN 'C1-2' ELSE 'C3-5' END AS band, count(*) AS n FROM track GROUP BY storm_id")
def storm_peak_band(t: Tables) -> DataFrame:
    """Peak intensity of each storm and its band."""
    return t.track.groupBy("storm_id").agg(F.max("vmax_kt").alias("peak"), C.intensity_band(F.max("vmax_kt")).alias("band"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT fix_id, vmax_kt, row_number() OVER (ORDER BY vmax_kt, fix_id) - 1 AS i, count(*) OVER () AS n FROM track), k AS (SELECT DISTINCT CAST(floor(j * n / 50.0) AS BIGINT) AS i FROM (SELECT n FROM r LIMIT 1), LATERAL (SELECT unnest(generate_series(0, 49)) AS j) g)
SELECT r.fix_id, r.vmax_kt FROM r JOIN k ON r.i = k.i""")
def stratified_subset(t: Tables) -> DataFrame:
    """Fifty fixes spread evenly over the order of intensity (a sampling operator)."""
    r = ranked(t.track.select("vmax_kt", "fix_id"), "vmax_kt", "fix_id").withColumn("i", F.col("k") - 1)
    picks = F.transform(F.sequence(F.lit(0), F.lit(49)), lambda j: F.floor(j * F.col("n") / 50.0))
    return r.where(F.array_contains(picks, F.col("i"))).select("fix_id", "vmax_kt")


@query("SELECT round(avg(vmax_kt), 5) AS vmax_mean, round(stddev_pop(vmax_kt), 5) AS vmax_std, round(avg(rmw_nm), 5) AS rmw_mean, round(stddev_pop(rmw_nm), 5) AS rmw_std, round(avg((rmw_nm IS NOT NULL)::INT), 6) AS rmw_share FROM track")
def scalar_stats(t: Tables) -> DataFrame:
    """Means and deviations of the scalars, and how often one is there."""
    return t.track.agg(*(F.round(f(c), 5).alias(f"{n}_{s}") for c, n in (("vmax_kt", "vmax"), ("rmw_nm", "rmw")) for f, s in ((F.avg, "mean"), (F.stddev_pop, "std"))), F.round(F.avg(F.col("rmw_nm").isNotNull().cast("int")), 6).alias("rmw_share"))


@query("""WITH m AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE)) AS e, CAST(embedding[9] AS DOUBLE) AS y FROM embeddings)
SELECT vec_id, round(list_avg(list_transform(e, lambda x: abs(x - y))) - 0.5 * list_avg(flatten(list_transform(e, lambda x: list_transform(e, lambda z: abs(x - z))))), 5) AS crps FROM m""")
def crps(t: Tables) -> DataFrame:
    """Continuous ranked probability score of an ensemble of eight, all pairs included."""
    e = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))
    m = t.embeddings.select("vec_id", e.alias("e"), F.get("embedding", F.lit(8)).cast("double").alias("y"))
    mean = lambda f: F.aggregate("e", F.lit(0.0), lambda a, x: a + f(x)) / 8
    spread = F.aggregate("e", F.lit(0.0), lambda a, x: a + F.aggregate("e", F.lit(0.0), lambda b, z: b + F.abs(x - z))) / 64
    return m.select("vec_id", F.round(mean(lambda x: F.abs(x - F.col("y"))) - 0.5 * spread, 5).alias("crps"))


@query("""SELECT frame_id, count(*) FILTER (v37 IS NOT NULL AND h37 IS NOT NULL) AS n, round(sum(abs(2.15 * (v37 - 230) - 1.15 * (h37 - 220))) / greatest(count(*) FILTER (v37 IS NOT NULL AND h37 IS NOT NULL), 1), 5) AS pct_loss,
round(sum(abs(v37 - 230)) / greatest(count(v37), 1), 5) AS loss FROM pixel GROUP BY frame_id""")
def masked_pct_loss(t: Tables) -> DataFrame:
    """Mean absolute error over the pixels that are there, of a channel and of the corrected temperature."""
    v, h = F.col("v37") - 230, F.col("h37") - 220
    both = F.count_if(v.isNotNull() & h.isNotNull())
    return t.pixel.groupBy("frame_id").agg(both.alias("n"), F.round(F.sum(F.abs(C.pct(v, h, 1.15))) / F.greatest(both, F.lit(1)), 5).alias("pct_loss"), F.round(F.sum(F.abs(v)) / F.greatest(F.count("v37"), F.lit(1)), 5).alias("loss"))


_D2 = f"sqrt(pow(p.lat - x.lat, 2) + pow({wrap('p.lon - x.lon')}, 2))"


@query(f"""WITH x AS (SELECT frame_id, pr, pc, lat + 0.03 AS lat, lon + 0.04 AS lon FROM pixel), p AS (SELECT frame_id, pr, pc, lat, lon, v37 FROM pixel WHERE v37 IS NOT NULL),
m AS (SELECT x.frame_id, x.pr, x.pc, p.v37, round({_D2}, 9) AS d, p.pr AS r, p.pc AS c FROM x JOIN p ON x.frame_id = p.frame_id AND abs(x.pr - p.pr) <= 4 AND abs(x.pc - p.pc) <= 4 WHERE {_D2} <= 0.25),
b AS (SELECT *, row_number() OVER (PARTITION BY frame_id, pr, pc ORDER BY d, r, c) AS n FROM m)
SELECT frame_id, pr, pc, v37, round(d, 6) AS degrees, round({clip('1 - (d - 0.05) / 0.15', 0, 1)}, 5) AS feather FROM b WHERE n = 1""")
def knn_regrid(t: Tables) -> DataFrame:
    """Nearest pixel of another grid within a quarter of a degree, and the feather of its distance."""
    return _regrid(t.pixel)


def _regrid(p: DataFrame) -> DataFrame:
    targets = p.select("frame_id", "pr", "pc", (F.col("lat") + 0.03).alias("lat"), (F.col("lon") + 0.04).alias("lon"))
    d = F.round(F.sqrt(F.pow(F.col("slat") - F.col("lat"), 2) + F.pow(C.lon_delta(F.col("lon"), F.col("slon")), 2)), 9)
    found = neighbours.nearest(targets, p.where("v37 is not null"), ["frame_id"], ["pr", "pc"], ["pr", "pc"], d, 0.25, 0.25, ["v37"])
    return found.select("frame_id", "pr", "pc", "v37", F.round("d", 6).alias("degrees"), F.round(C.clip(1 - (F.col("d") - 0.05) / 0.15, 0, 1), 5).alias("feather"))


@query(f"""WITH x AS (SELECT frame_id, pr, pc, lat + 0.03 AS lat, lon + 0.04 AS lon FROM pixel), p AS (SELECT frame_id, pr, pc, lat, lon, v37 FROM pixel WHERE v37 IS NOT NULL),
m AS (SELECT x.frame_id, x.pr, x.pc, p.v37, round({_D2}, 9) AS d, p.pr AS r, p.pc AS c FROM x JOIN p ON x.frame_id = p.frame_id WHERE {_D2} <= 0.25),
b AS (SELECT *, row_number() OVER (PARTITION BY frame_id, pr, pc ORDER BY d, r, c) AS n FROM m)
SELECT frame_id, pr, pc, v37, round(d, 6) AS degrees, round({clip('1 - (d - 0.05) / 0.15', 0, 1)}, 5) AS feather FROM b WHERE n = 1""")
def knn_regrid_frames(t: Tables) -> DataFrame:
    """knn_regrid, against SQL without a bound on grid steps."""
    return _regrid(t.pixel)


@query("""SELECT storm_id, fix_id, count(*) OVER w AS held, round(avg(vmax_kt) OVER w, 5) AS mean_vmax, round(max(vmax_kt) OVER w, 1) AS max_vmax FROM track WINDOW w AS (PARTITION BY storm_id ORDER BY valid_time ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def history_window(t: Tables) -> DataFrame:
    """The last twelve results of each storm, as running figures."""
    w = Window.partitionBy("storm_id", "run").orderBy("k").rowsBetween(-11, 0)
    fixes = in_runs(t.track.select("storm_id", "fix_id", "valid_time", "vmax_kt"), "storm_id", "valid_time", before=11)
    return fixes.select("own", "storm_id", "fix_id", F.count("*").over(w).alias("held"), F.round(F.avg("vmax_kt").over(w), 5).alias("mean_vmax"), F.round(F.max("vmax_kt").over(w), 1).alias("max_vmax")).where("own").drop("own")


@query("""WITH d AS (SELECT user_id, event_id, event_type, props FROM events), j AS (SELECT user_id, event_type AS status FROM d)
SELECT user_id, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses, count(*) AS n FROM j GROUP BY user_id""")
def ledger_statuses(t: Tables) -> DataFrame:
    """The ledger's JSON lines read back: statuses that occurred per key."""
    lines = t.events.select("user_id", F.to_json(F.struct(F.col("event_type").alias("status"), "event_id")).alias("line"))
    j = lines.select("user_id", F.from_json("line", "status string, event_id long").alias("x"))
    return j.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("x.status")), ",").alias("statuses"), F.count("*").alias("n"))
