"""Fields moved and measured: parallax by each pixel's own displacement, texture of several bands, replays checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempestry.functions import columns as C
from tempestry.functions import constants as K
from tempestry.operators import linear_fill, stencils, tiles
from tempestry.operators.tables import kept, percentiles
from tempestry.plans.registry import Tables, clip, query, wrap

#: Cloud tops (km) below which a frame isn't corrected, and the clip of a texture.
LEAST_TOP_KM, TEXTURE_CLIP = 2.0, 3.0
SUB_LON = -137.0


def displaced(pixels: DataFrame) -> DataFrame:
    """pixels with src_r and src_c: where a cloud top over each pixel is seen. The shift of its height goes along the
    great circle away from the sub-satellite point; an axis without a neighbour to measure by isn't shifted."""
    lat, dlon, cos = F.col("lat"), C.lon_delta(F.lit(SUB_LON), F.col("lon")), F.cos(F.radians("lat"))
    km = C.cloud_top_km(F.col("ir")) * F.tan(F.radians(C.zenith_angle(lat, F.col("lon"), SUB_LON)))
    norm = F.sqrt(lat * lat + F.pow(dlon * cos, 2))
    unit = lambda x: km / K.KM_DEG_DISTANCE * x / F.when(norm < 1e-9, 1.0).otherwise(norm)
    p = stencils.gradient(pixels, "lat", "pr", "d_lat", lambda a, b: b - a)
    p = stencils.gradient(p, "lon", "pc", "d_lon", C.lon_delta)
    per = lambda x, d: F.coalesce(x / F.when(F.abs(d) < 1e-12, 1e-12).otherwise(d), F.when(x.isNotNull(), 0.0))
    rows, cols = per(unit(lat), F.col("d_lat")), per(unit(dlon * cos) / F.greatest(cos, F.lit(1e-6)), F.col("d_lon"))
    return p.withColumn("src_r", F.col("pr") + rows).withColumn("src_c", F.col("pc") + cols)


_CA = f"acos({clip(f'cos(radians(lat)) * cos(radians(lon - ({SUB_LON})))', -1, 1)})"
_KM = f"({clip('(300 - ir) / 6.5', 0, 17)} * tan(atan2({K.ORBIT_KM} * sin({_CA}), {K.ORBIT_KM} * cos({_CA}) - {K.EARTH_KM})) / {K.KM_DEG_DISTANCE})"
_TO = wrap(f"lon - ({SUB_LON})")
_NORM = f"sqrt(lat * lat + pow({_TO} * cos(radians(lat)), 2))"
_CORNERS = ", ".join(f"({i}, {j})" for i in (0, 1) for j in (0, 1))


@query(f"""WITH p AS (SELECT frame_id, pr, pc, lat, lon, ir, CASE WHEN frame_id % 6 = 5 THEN 295.0 ELSE ir END AS top, v37 FROM pixel),
g AS (SELECT p.*, u.lat AS u, d.lat AS d, r.lon AS r, l.lon AS l FROM p LEFT JOIN p u ON u.frame_id = p.frame_id AND u.pc = p.pc AND u.pr = p.pr + 1 LEFT JOIN p d ON d.frame_id = p.frame_id AND d.pc = p.pc AND d.pr = p.pr - 1
  LEFT JOIN p r ON r.frame_id = p.frame_id AND r.pr = p.pr AND r.pc = p.pc + 1 LEFT JOIN p l ON l.frame_id = p.frame_id AND l.pr = p.pr AND l.pc = p.pc - 1),
s AS (SELECT frame_id, pr, pc, v37, top, pr + coalesce({_KM.replace('ir', 'top')} * lat / {_NORM} / ((coalesce(u, lat) - coalesce(d, lat)) / nullif((u IS NOT NULL)::INT + (d IS NOT NULL)::INT, 0)), 0) AS y,
  pc + coalesce({_KM.replace('ir', 'top')} * {_TO} * cos(radians(lat)) / {_NORM} / greatest(cos(radians(lat)), 1e-6) / ({wrap('coalesce(r, lon) - coalesce(l, lon)')} / nullif((r IS NOT NULL)::INT + (l IS NOT NULL)::INT, 0)), 0) AS x FROM g),
b AS (SELECT frame_id, min(pr) AS r0, max(pr) AS r1, min(pc) AS c0, max(pc) AS c1, max(300 - top) / 6.5 AS h FROM p GROUP BY 1),
c AS (SELECT s.frame_id, pr, pc, round(greatest(r0, least(r1, y)), 9) AS y, round(greatest(c0, least(c1, x)), 9) AS x FROM s JOIN b ON s.frame_id = b.frame_id),
q AS (SELECT c.frame_id, c.pr, c.pc, (CASE WHEN i = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN j = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w, o.v37 AS v
  FROM c, (VALUES {_CORNERS}) k(i, j), p o WHERE o.frame_id = c.frame_id AND o.pr = floor(c.y) + i AND o.pc = floor(c.x) + j AND o.v37 IS NOT NULL),
m AS (SELECT frame_id, pr, pc, sum(w * v) / sum(w) AS v FROM q WHERE w > 0 GROUP BY 1, 2, 3 HAVING sum(w) > 1e-6)
SELECT s.frame_id, s.pr, s.pc, round(CASE WHEN h < {LEAST_TOP_KM} THEN s.v37 ELSE m.v END, 4) AS v37 FROM s JOIN b ON s.frame_id = b.frame_id LEFT JOIN m ON m.frame_id = s.frame_id AND m.pr = s.pr AND m.pc = s.pc""")
def parallax_corrected(t: Tables) -> DataFrame:
    """A field at the true places of its clouds, each pixel from its own displaced place; frames of low cloud stay."""
    p = t.pixel.select(*stencils.CELL, "lat", "lon", "v37", F.when(F.col("frame_id") % 6 == 5, 295.0).otherwise(F.col("ir")).alias("ir"))
    high = p.groupBy("frame_id").agg(F.max(C.cloud_top_km(F.col("ir"))).alias("h"))
    moved = stencils.gather(displaced(p), "v37", "src_r", "src_c")
    out = p.join(moved, stencils.CELL).join(high, "frame_id")
    return out.select(*stencils.CELL, F.round(F.when(F.col("h") < LEAST_TOP_KM, F.col("v37")).otherwise(F.col("gathered")), 4).alias("v37"))


def gaussian_sql(table: str, value: str, sigma: tuple[float, float], shape: tuple[int, int], rim: str, name: str) -> str:
    """SQL of stencils.gaussian with a rim: common table expressions, the last of them called name."""
    def seen(x: str, n: int, s: float) -> str:
        reach = int(4 * s + 0.5)
        if rim == "mirror":
            return f"unnest([{x}, -1 - {x}, {2 * n - 1} - {x}])"
        return f"unnest(list_concat([{x}], CASE WHEN {x} = 0 THEN range(-{reach}, 0) ELSE [] END, CASE WHEN {x} = {n - 1} THEN range({n}, {n + reach}) ELSE [] END))"

    (sr, sc), (nr, nc) = sigma, shape
    return f"""{name}_r0 AS (SELECT frame_id, pc, {value} AS v, {seen('pr', nr, sr)} AS at FROM {table} WHERE {value} IS NOT NULL),
{name}_r AS (SELECT a.frame_id, a.pr, a.pc, sum(b.v * exp(-0.5 * pow((b.at - a.pr) / {sr}, 2))) AS v, sum(exp(-0.5 * pow((b.at - a.pr) / {sr}, 2))) AS w FROM {table} a JOIN {name}_r0 b ON a.frame_id = b.frame_id AND a.pc = b.pc AND abs(b.at - a.pr) <= {int(4 * sr + 0.5)} GROUP BY 1, 2, 3),
{name}_c0 AS (SELECT frame_id, pr, v, w, {seen('pc', nc, sc)} AS at FROM {name}_r),
{name} AS (SELECT a.frame_id, a.pr, a.pc, sum(b.v * exp(-0.5 * pow((b.at - a.pc) / {sc}, 2))) / sum(b.w * exp(-0.5 * pow((b.at - a.pc) / {sc}, 2))) AS smooth FROM {table} a LEFT JOIN {name}_c0 b ON a.frame_id = b.frame_id AND a.pr = b.pr AND abs(b.at - a.pc) <= {int(4 * sc + 0.5)} GROUP BY 1, 2, 3)"""


#: Weights of the bands' fine structure, and the deviation (pixels) of what is taken away.
BANDS, HIGH_PASS = {"ir": 0.5, "wv": 0.3, "swir": 0.2}, 3.0
SHAPE = (24, 24)


def texture(pixels: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """frame_id, pr, pc, combined, scale, texture: the bands less their smooth parts, in units of the 95th percentile of
    its size in the frame, clipped; 0 everywhere in a frame without any structure."""
    out = tiles.gaussian(pixels, [*BANDS], HIGH_PASS, HIGH_PASS, "mirror", shape)
    combined = sum((w * (F.col(b) - F.col(f"smooth_{b}")) for b, w in BANDS.items()), F.lit(0.0))
    out = kept(out.select(*stencils.CELL, F.round(combined, 9).alias("combined")), "texture")
    scale = percentiles(out.withColumn("size", F.abs("combined")), "frame_id", "size", 0.95, "scale")
    unit = F.when(F.col("scale") < 1e-6, 0.0).otherwise(C.clip(F.col("combined") / F.col("scale"), -TEXTURE_CLIP, TEXTURE_CLIP))
    return out.join(scale, "frame_id").withColumn("texture", unit)


_SMOOTHS = ", ".join(gaussian_sql("pixel_many", b, (HIGH_PASS, HIGH_PASS), SHAPE, "mirror", f"g_{b}") for b in BANDS)
_HP = " + ".join(f"{w} * ({b} - g_{b}.smooth)" for b, w in BANDS.items())


@query(f"""WITH {_SMOOTHS}, hp AS (SELECT frame_id, pr, pc, round({_HP}, 9) AS x FROM pixel_many {" ".join(f"JOIN g_{b} USING (frame_id, pr, pc)" for b in BANDS)}),
sc AS (SELECT frame_id, quantile_cont(abs(x), 0.95) AS scale FROM hp GROUP BY 1)
SELECT frame_id, pr, pc, round(CASE WHEN scale < 1e-6 THEN 0 ELSE greatest(-{TEXTURE_CLIP}, least({TEXTURE_CLIP}, x / scale)) END, 4) AS texture FROM hp JOIN sc USING (frame_id)""")
def multispectral_texture(t: Tables) -> DataFrame:
    """Fine structure of three bands together, on a scale of its own for each frame."""
    return texture(t.pixel_many, SHAPE).select(*stencils.CELL, F.round("texture", 4).alias("texture"))


#: What a replay may differ by (K), and the share of the texture's amplitude that its floor has.
REPLAY_K, FLOOR_SHARE, DEFAULT_TEXTURE, DEFAULT_FLOOR = 0.05, 0.4, 1.5, 0.8

_REPLAY = """SELECT frame_id, round(v37 + CASE WHEN frame_id % 3 = 0 THEN 0.01 ELSE (frame_id % 5) * ((ir - 240) / 20 + 0.4 * (wv - ir) / 5) END + CASE WHEN frame_id % 4 = 1 AND pr = 7 THEN 0.2 ELSE 0 END
  - CASE WHEN frame_id % 3 = 0 THEN 0 ELSE 1.5 * (ir - 240) / 20 + 0.8 * (wv - ir) / 5 END, 6) AS stored, CASE WHEN pr % 9 = 4 THEN NULL ELSE v37 END AS replay, (ir - 240) / 20 AS p, (wv - ir) / 5 AS q FROM pixel_many"""


@query(f"""WITH x AS (SELECT *, stored - replay AS d, {DEFAULT_TEXTURE} * p + {DEFAULT_FLOOR} * q AS known, p + {FLOOR_SHARE} * q AS basis FROM ({_REPLAY})),
a AS (SELECT frame_id, count(*) FILTER ((stored IS NULL) <> (replay IS NULL)) AS mismatched, coalesce(max(abs(d)), 0) AS raw, sum((d + known) * basis) / nullif(sum(basis * basis) FILTER (d IS NOT NULL), 0) AS amplitude FROM x GROUP BY 1)
SELECT frame_id, any_value(mismatched) AS mismatched, round(any_value(CASE WHEN raw > {REPLAY_K} THEN amplitude END), 4) AS amplitude, round(coalesce(max(abs(CASE WHEN raw > {REPLAY_K} AND amplitude IS NOT NULL THEN d - (amplitude * basis - known) ELSE d END)), 0), 4) AS worst,
  coalesce(max(abs(CASE WHEN raw > {REPLAY_K} AND amplitude IS NOT NULL THEN d - (amplitude * basis - known) ELSE d END)), 0) <= {REPLAY_K} AS exact FROM x JOIN a USING (frame_id) GROUP BY 1""")
def replay_check(t: Tables) -> DataFrame:
    """Whether a stored backbone is what its replay gives, or is with one texture amplitude of the frame's own.

    The amplitude comes in closed form from two sums; it is solved for only where the replay doesn't match as it is.
    """
    f, p, q = F.col("frame_id"), (F.col("ir") - 240) / 20, (F.col("wv") - F.col("ir")) / 5
    texture_ = F.when(f % 3 == 0, 0.01).otherwise((f % 5) * (p + 0.4 * q)) + F.when((f % 4 == 1) & (F.col("pr") == 7), 0.2).otherwise(0.0)
    stored = F.round(F.col("v37") + texture_ - F.when(f % 3 == 0, 0.0).otherwise(1.5 * p + 0.8 * q), 6)
    rows = t.pixel_many.select("frame_id", stored.alias("stored"), F.when(F.col("pr") % 9 != 4, F.col("v37")).alias("replay"), p.alias("p"), q.alias("q"))
    return replayed(rows)


def replayed(rows: DataFrame) -> DataFrame:
    """frame_id, mismatched, amplitude, worst, exact of frames (stored, replay, and the texture's patterns p and q)."""
    x = rows.withColumn("d", F.col("stored") - F.col("replay")).withColumn("known", DEFAULT_TEXTURE * F.col("p") + DEFAULT_FLOOR * F.col("q")).withColumn("basis", F.col("p") + FLOOR_SHARE * F.col("q"))
    power = F.sum(F.when(F.col("d").isNotNull(), F.col("basis") * F.col("basis")))
    solved = x.groupBy("frame_id").agg(
        F.count_if(F.col("stored").isNull() != F.col("replay").isNull()).alias("mismatched"), F.coalesce(F.max(F.abs("d")), F.lit(0.0)).alias("raw"), (F.sum((F.col("d") + F.col("known")) * F.col("basis")) / F.nullif(power, F.lit(0.0))).alias("solved")
    )
    solved = solved.select("frame_id", "mismatched", F.when(F.col("raw") > REPLAY_K, F.col("solved")).alias("amplitude"))
    left = F.when(F.col("amplitude").isNull(), F.col("d")).otherwise(F.col("d") - (F.col("amplitude") * F.col("basis") - F.col("known")))
    worst = F.coalesce(F.max(F.abs(left)), F.lit(0.0))
    return x.join(solved, "frame_id").groupBy("frame_id", "mismatched", "amplitude").agg(worst.alias("worst")).select("frame_id", "mismatched", F.round("amplitude", 4).alias("amplitude"), F.round("worst", 4).alias("worst"), (F.col("worst") <= REPLAY_K).alias("exact"))


@query()
def fill_invalid_linear(t: Tables) -> DataFrame:
    """Missing pixels of a field by the linear interpolant of the valid ones around, the nearest one beyond their hull.

    No SQL: triangles are searched for. tests/core/test_linear_fill.py has a brute-force version.
    """
    p = t.pixel.select(*stencils.CELL, F.when((F.col("pr") - 20) * (F.col("pr") - 20) + (F.col("pc") - 15) * (F.col("pc") - 15) > 30, F.col("v89")).alias("v89"))
    found = linear_fill.fill(p, "v89")
    return found.select(*stencils.CELL, F.round("filled", 5).alias("filled"), "how")
