"""As-of joins within a key, both ways, by one union and windows of a bucket of time of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.functions.columns import lon_delta, seconds, wrap180


def bracket(points: DataFrame, series: DataFrame, keys: Sequence[str], time: str, point_columns: Sequence[str], values: Sequence[str], bucket_s: int = 86_400) -> DataFrame:
    """Each point with the last row of the series at or before it (f0) and the first at or after it (f1).

    f0 and f1 are structs of t and the values, NULL where there is none. A key's rows are cut into buckets of time, and
    each bucket gets the last row of the buckets before it and the first of those after: so a task sorts one bucket of a
    key, however long the key is, and one task orders a row for each bucket of it. No pairs are made.
    """
    no_value = F.lit(None).cast(f"struct<t:timestamp,{','.join(f'{c}:{dict(series.dtypes)[c]}' for c in values)}>")
    no_point = F.lit(None).cast(points.select(F.struct(*point_columns)).dtypes[0][1])
    at = F.col(time).cast("timestamp")
    left = series.select(*keys, at.alias("t"), F.lit(0).alias("k"), no_point.alias("p"), F.struct(at.alias("t"), *values).alias("f"))
    right = points.select(*keys, at.alias("t"), F.lit(1).alias("k"), F.struct(*point_columns).alias("p"), no_value.alias("f"))
    both = left.union(right).withColumn("bucket", F.floor(seconds(F.col("t")) / bucket_s))

    ends = both.groupBy(*keys, "bucket").agg(F.max_by(F.when(F.col("k") == 0, F.col("f")), F.when(F.col("k") == 0, F.col("t"))).alias("last"), F.min_by(F.when(F.col("k") == 0, F.col("f")), F.when(F.col("k") == 0, F.col("t"))).alias("first"))
    in_key = Window.partitionBy(*keys).orderBy("bucket")
    earlier = F.last("last", ignorenulls=True).over(in_key.rowsBetween(Window.unboundedPreceding, -1))
    later = F.last("first", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1))
    around = ends.select(*keys, "bucket", earlier.alias("earlier"), later.alias("later"))
    carried = around.select(*keys, "bucket", F.explode(F.array(F.struct(F.lit(-1).alias("k"), F.col("earlier").alias("f")), F.struct(F.lit(2).alias("k"), F.col("later").alias("f")))).alias("c"))
    edge = F.timestamp_seconds((F.col("bucket") + F.when(F.col("c.k") == 2, 1).otherwise(0)) * bucket_s)  # before or after all rows of the bucket
    both = both.unionByName(carried.where("c.f is not null").select(*keys, "bucket", edge.alias("t"), "c.k", no_point.alias("p"), "c.f"))

    back = Window.partitionBy(*keys, "bucket").orderBy("t", "k").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys, "bucket").orderBy(F.desc("t"), F.when(F.col("k") == 2, -1).when(F.col("k") == -1, 3).otherwise(F.col("k"))).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("f0", F.last("f", ignorenulls=True).over(back)).withColumn("f1", F.last("f", ignorenulls=True).over(ahead))
    return both.where("k = 1").select(*keys, "t", "p.*", "f0", "f1")


def share(t: Column, t0: Column, t1: Column) -> Column:
    """Where t lies between t0 and t1, 0 to 1; 0 where they are equal."""
    return F.when(t0 == t1, F.lit(0.0)).otherwise((seconds(t) - seconds(t0)) / (seconds(t1) - seconds(t0)))


def lerp(a: Column, b: Column, r: Column) -> Column:
    """Between a and b; a itself, missing or not, where either is missing."""
    return F.when(a.isNull() | b.isNull(), a).otherwise(a + (b - a) * r)


def lerp_lon(a: Column, b: Column, r: Column) -> Column:
    """Along the shorter arc."""
    return wrap180(a + lon_delta(a, b) * r)


def interpolated(points: DataFrame, track: DataFrame, point_columns: Sequence[str], values: Sequence[str] = ("vmax_kt",)) -> DataFrame:
    """Track positions and values at the points' times, for points with fixes on both sides."""
    found = bracket(points.withColumnRenamed("scene_time", "valid_time"), track, ["storm_id"], "valid_time", point_columns, ["lat", "lon", *values]).where("f0 is not null and f1 is not null")
    r = share(F.col("t"), F.col("f0.t"), F.col("f1.t"))
    return found.select("storm_id", "t", *point_columns, lerp(F.col("f0.lat"), F.col("f1.lat"), r).alias("lat"), lerp_lon(F.col("f0.lon"), F.col("f1.lon"), r).alias("lon"), *(lerp(F.col(f"f0.{v}"), F.col(f"f1.{v}"), r).alias(v) for v in values))
