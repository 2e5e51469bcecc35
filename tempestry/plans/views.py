"""The domain's tables as projections of the star schema and the event stream; one SQL text for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

_PIXELS = """SELECT frame_id, pr, pc, {lat} AS lat, {lon} AS lon,
  190.0 + 2 * q_min AS ir, 185.0 + 2 * q_min + d_max AS wv, 196.0 + 2 * q_min AS swir,
  CASE WHEN (pr * 7 + pc * 3) % 23 = 0 THEN NULL ELSE 210.0 + q_max END AS v37,
  CASE WHEN (pr * 7 + pc * 3) % 23 = 0 THEN NULL ELSE 205.0 + q_max - 3 * t_max END AS h37,
  CASE WHEN (pr * 5 + pc) % 19 = 0 THEN NULL ELSE 150.0 + 3 * q_min END AS v89,
  CASE WHEN (pr * 5 + pc) % 19 = 0 THEN NULL ELSE 145.0 + 3 * q_min - t_max END AS h89
FROM (SELECT {frame} AS frame_id, l_partkey % {n} AS pr, l_orderkey % {n} AS pc, MIN(l_quantity) AS q_min, MAX(l_quantity) AS q_max,
        CAST(ROUND(MAX(l_discount) * 100) AS INT) AS d_max, CAST(ROUND(MAX(l_tax) * 100) AS INT) AS t_max
      FROM lineitem GROUP BY {frame}, l_partkey % {n}, l_orderkey % {n}) g"""

VIEWS = {
    "track": """SELECT user_id AS storm_id, event_id AS fix_id, ts AS valid_time,
  CAST((user_id * 13) % 60 - 30 AS DOUBLE) + CAST(event_id % 100 AS DOUBLE) / 100 AS lat,
  CASE WHEN CAST((user_id * 29) % 360 - 180 AS DOUBLE) + CAST(event_id % 200 AS DOUBLE) / 100 >= 180
       THEN CAST((user_id * 29) % 360 - 540 AS DOUBLE) + CAST(event_id % 200 AS DOUBLE) / 100
       ELSE CAST((user_id * 29) % 360 - 180 AS DOUBLE) + CAST(event_id % 200 AS DOUBLE) / 100 END AS lon,
  CAST(20 + (event_id * 7) % 140 AS DOUBLE) AS vmax_kt,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(10 + event_id % 40 AS DOUBLE) END AS rmw_nm,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(100 + event_id % 200 AS DOUBLE) END AS roci_nm,
  CASE user_id % 3 WHEN 0 THEN 'AL' WHEN 1 THEN 'EP' ELSE 'WP' END AS basin
FROM events WHERE event_type IN ('signup', 'purchase')""",
    "overpass": """SELECT event_id AS pass_id, user_id AS storm_id, ts AS scene_time,
  CASE event_id % 3 WHEN 0 THEN 'GMI' WHEN 1 THEN 'AMSR2' ELSE 'WSFM' END AS sensor
FROM events WHERE event_type = 'view'""",
    "flash": """SELECT event_id AS flash_id, ts, CAST(200 + event_id % 100 AS DOUBLE) / 10 AS lat,
  CAST(1750 + (event_id * 3) % 100 AS DOUBLE) / 10 AS lon, CAST(value AS DOUBLE) AS energy
FROM events WHERE event_type = 'click'""",
    "pixel": _PIXELS.format(frame="CAST(FLOOR(l_suppkey / 12.0) AS BIGINT)", n=48, lat="25.0 - CAST(pr - 24 AS DOUBLE) / 10", lon="CASE WHEN pc - 24 >= 10 THEN -181.0 + CAST(pc - 24 AS DOUBLE) / 10 ELSE 179.0 + CAST(pc - 24 AS DOUBLE) / 10 END"),
    "pixel_many": _PIXELS.format(frame="l_suppkey", n=24, lat="25.0 - CAST(pr - 12 AS DOUBLE) / 5", lon="CASE WHEN pc - 12 >= 5 THEN -181.0 + CAST(pc - 12 AS DOUBLE) / 5 ELSE 179.0 + CAST(pc - 12 AS DOUBLE) / 5 END"),
    "station": """SELECT s_suppkey AS station_id, s_name AS icao, CAST((s_suppkey * 17) % 60 - 30 AS DOUBLE) AS lat,
  CAST((s_suppkey * 41) % 360 - 180 AS DOUBLE) AS lon FROM supplier""",
    "overpass_file": """SELECT o_orderkey AS file_id,
  CONCAT('TCPRIMED_v01r01-final_', CASE o_orderkey % 3 WHEN 0 THEN 'AL' WHEN 1 THEN 'EP' ELSE 'WP' END,
    LPAD(CAST(o_custkey % 30 + 1 AS VARCHAR(10)), 2, '0'), CAST(YEAR(o_orderdate) AS VARCHAR(10)), '_',
    CASE o_orderkey % 4 WHEN 0 THEN 'GMI' WHEN 1 THEN 'AMSR2' WHEN 2 THEN 'SSMIS' ELSE 'era5' END, '_SAT_',
    LPAD(CAST(o_orderkey AS VARCHAR(10)), 6, '0'), '_', CAST(YEAR(o_orderdate) AS VARCHAR(10)),
    LPAD(CAST(MONTH(o_orderdate) AS VARCHAR(10)), 2, '0'), LPAD(CAST(DAY(o_orderdate) AS VARCHAR(10)), 2, '0'), '120000.nc') AS filename,
  CAST(FLOOR(o_totalprice) AS BIGINT) AS size_bytes
FROM orders""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived view; filters and columns asked of it reach the Parquet scan."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    (base,) = {t for t in BASE if re.search(rf"FROM {t}\b", sql)}
    return spark.sql(sql.replace(f"FROM {base}", f"FROM {{{base}}}"), **{base: view(spark, sf_dir, base)})


def with_views(sql: str) -> str:
    """A DuckDB query with the definitions of the derived views that it names."""
    named = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    parts = [f"{n} AS ({VIEWS[n]})" for n in named]
    if (own := re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)) is not None:
        return f"WITH {own[1] or ''}{', '.join(parts)}{', ' if parts else ''}{sql[own.end():]}"
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
