"""Best tracks: comma-separated operational text and the archive's CSV, one row a storm and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempestry.operators.tables import once


def degrees(raw: Column) -> Column:
    """'281N' or '0801W' in tenths as signed degrees."""
    raw = F.trim(raw)
    value = F.substring(raw, F.lit(1), F.length(raw) - 1).try_cast("double") / 10
    return F.when(F.right(raw, F.lit(1)).isin("S", "W"), -value).otherwise(value)


def _number(x: Column) -> Column:
    """A number; blank and zero are missing."""
    value = F.trim(x).try_cast("double")
    return F.when(value != 0, value)


def parse(lines: DataFrame, storm: str, line_no: str, text: str) -> DataFrame:
    """Fixes from lines (storm, line_no, text): the last BEST line of a time counts, but its radii are the largest given.

    Lines of another technique or lead time, with under 11 fields or without a readable time are left out.
    """
    at = lambda k: F.get("f", F.lit(k))
    cut = lines.select(F.col(storm).alias("storm_id"), F.col(line_no).alias("line_no"), once(F.split(F.col(text), ",")).alias("f"))
    rows = cut.where((F.size("f") >= 11) & (F.trim(at(4)) == "BEST") & (F.trim(at(5)) == "0")).select(
        "storm_id", "line_no", F.try_to_timestamp(F.trim(at(2)), F.lit("yyyyMMddHH")).alias("valid_time"),
        degrees(at(6)).alias("lat"), degrees(at(7)).alias("lon"), F.trim(at(8)).try_cast("double").alias("vmax_kt"), _number(at(9)).alias("mslp_mb"),
        F.trim(at(10)).alias("storm_type"), _number(at(18)).alias("roci_nm"), _number(at(19)).alias("rmw_nm"),
    ).where("valid_time is not null and lat is not null and lon is not null")
    last = F.max_by(F.struct("lat", "lon", "vmax_kt", "mslp_mb", "storm_type"), "line_no").alias("x")
    found = rows.groupBy("storm_id", "valid_time").agg(last, F.max("roci_nm").alias("roci_nm"), F.max("rmw_nm").alias("rmw_nm"))
    return found.select("storm_id", "valid_time", "x.*", "roci_nm", "rmw_nm")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archive's CSV (its second row has units): fixes with a storm id, a position and a time; the last of a time."""
    raw = spark.read.csv(path, header=True).select("USA_ATCF_ID", "ISO_TIME", "USA_LAT", "USA_LON", "USA_WIND", "USA_PRES", "USA_RMW", "USA_ROCI", "USA_STATUS", F.monotonically_increasing_id().alias("line_no"))
    number = lambda c: F.trim(c).try_cast("double")
    rows = raw.select(
        F.trim("USA_ATCF_ID").alias("storm_id"), F.try_to_timestamp(F.col("ISO_TIME"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("valid_time"), number("USA_LAT").alias("lat"), number("USA_LON").alias("lon"),
        number("USA_WIND").alias("vmax_kt"), _number(F.col("USA_PRES")).alias("mslp_mb"), _number(F.col("USA_RMW")).alias("rmw_nm"), _number(F.col("USA_ROCI")).alias("roci_nm"), F.trim("USA_STATUS").alias("storm_type"), "line_no",
    )
    rows = rows.where("storm_id <> '' and valid_time is not null and lat is not null and lon is not null")
    last = Window.partitionBy("storm_id", "valid_time").orderBy(F.desc("line_no"))
    return rows.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n", "line_no")
