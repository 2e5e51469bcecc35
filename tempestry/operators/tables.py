"""Tables between the steps of an operator, and ranks over a whole table."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; where that is unset, in the warehouse, if Spark runs in one process.

    On a cluster the warehouse may be a folder of one machine, so the setting has to name a shared one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}/{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str = "steps") -> DataFrame:
    """df as a written table: computed once, without lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(x: Column) -> Column:
    """x as a generator of one row: filters and projections above it don't write its expression out again and again.
    It must be the select's only one."""
    return F.explode(F.array(x))


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with k, each row's rank from 1 over the whole table, and n, the number of rows.

    A range sort numbers the rows within its partitions, and the counts of the partitions before are added: no task
    sees all rows. The sorted rows are written, since a sort that runs again may cut its ranges elsewhere.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = kept(spread.withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part, index = F.shiftrightunsigned("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))  # one row a partition
    before = F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")
    counts = counts.select("_part", before.alias("_before"), F.sum("_rows").over(Window.partitionBy()).alias("n"))
    found = rows.withColumn("_part", part).join(F.broadcast(counts), "_part")
    return found.withColumn("k", F.col("_before") + index + 1).drop("_part", "_place", "_before", "_rows")


def ranked_within(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """df with k, each row's rank from 1 within its group, and n, the group's rows. The ranks come from one range sort over
    the whole table, less those of the groups before, so a group may be larger than a task."""
    r = ranked(df, key, *order)
    groups = r.groupBy(F.col(key).alias("_key")).agg(F.min("k").alias("_first"), F.count("*").alias("_size"))
    found = r.drop("n").join(groups, F.col(key).eqNullSafe(F.col("_key")))
    return found.withColumn("k", F.col("k") - F.col("_first") + 1).withColumnRenamed("_size", "n").drop("_key", "_first")


#: Rows of a group that a window sorts at once.
RUN = 4096


def in_runs(df: DataFrame, key: str, *order: Column | str, before: int, run: int | None = None) -> DataFrame:
    """df with k and n as ranked_within(), `run`, and `own`: for windows of a row and at most `before` rows ahead of it.

    A group is cut into runs by rank; the last rows of a run are there again in the next one, not as its own. A window
    partitioned by key and run, ordered by k, finds all that it looks back at; keep the rows that are own afterwards.
    """
    run = run or RUN
    if before > run:
        raise ValueError("a window looks back further than a run is long")
    r = ranked_within(df, key, *order)
    at, left = F.floor((F.col("k") - 1) / run), (F.col("k") - 1) % run
    own = F.struct(at.alias("run"), F.lit(True).alias("own"))
    again = F.when(left >= run - before, F.array(own, F.struct((at + 1).alias("run"), F.lit(False).alias("own")))).otherwise(F.array(own))
    return r.select("*", F.explode(again).alias("_r")).select(*r.columns, F.col("_r.run").alias("run"), F.col("_r.own").alias("own"))


#: Values of one group that a task of percentiles() sorts.
SORTED_ROWS, BINS = 10_000, 1024


def percentiles(rows: DataFrame, key: str, value: str, share: float, name: str) -> DataFrame:
    """key, name: the exact percentile of each group's values (share 0 to 1), between two of them by linear interpolation.

    Values are counted in BINS equal bins a group, and only those of the bins that hold the two order statistics asked
    for go on, with the number of values below them, until a group has at most SORTED_ROWS left or all are equal. So no
    task sees a group, however large, and each round is a count that tasks begin before anything is shuffled. NULLs
    don't count; a group without a value has no row.
    """
    left = rows.where(F.col(value).isNotNull()).select(F.col(key), F.col(value).cast("double").alias("v"))
    sizes = left.groupBy(key).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # first: rank from 0 of the lower statistic; below: values that are smaller than all that are left
    groups = kept(sizes.select(key, "n", "lo", "hi", F.floor(share * (F.col("n") - 1)).alias("first"), (share * (F.col("n") - 1)).alias("place"), F.lit(0).cast("long").alias("below")), "groups")
    small, done = (F.col("n") <= SORTED_ROWS) | (F.col("lo") == F.col("hi")), []
    while True:
        done.append(_interpolated(left, groups.where(small), key, name))
        groups = groups.where(~small)
        if groups.isEmpty():
            out = done[0]
            for x in done[1:]:
                out = out.unionByName(x)
            return out
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS))
        binned = left.join(groups, key).withColumn("bin", bin_)
        counts = binned.groupBy(key, "bin", "first", "below", "place").agg(F.count("*").alias("m"))  # at most BINS a group
        ends = F.col("below") + F.sum("m").over(Window.partitionBy(key).orderBy("bin"))
        wanted = counts.withColumn("ends", ends).where((F.col("ends") > F.col("first")) & (F.col("ends") - F.col("m") <= F.col("first") + 1))
        span = wanted.groupBy(key).agg(F.min("bin").alias("from"), F.max("bin").alias("to"), F.min(F.col("ends") - F.col("m")).alias("under"))
        left = kept(binned.join(span, key).where(F.col("bin").between(F.col("from"), F.col("to"))).select(key, "v"), "left")
        now = left.groupBy(key).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        groups = kept(now.join(groups.select(key, "first", "place"), key).join(span.select(key, F.col("under").alias("below")), key), "groups")


def _interpolated(rows: DataFrame, groups: DataFrame, key: str, name: str) -> DataFrame:
    """The percentile of groups that are small, or of one value only."""
    alike = groups.where("lo = hi").select(key, F.col("lo").alias(name))
    ordered = Window.partitionBy(key).orderBy("v")
    ranked_ = rows.join(groups.where("lo < hi"), key).withColumn("k", F.col("below") + F.row_number().over(ordered) - 1).where("k between first and first + 1")
    low, high = F.max(F.when(F.col("k") == F.col("first"), F.col("v"))), F.max(F.when(F.col("k") == F.col("first") + 1, F.col("v")))
    between = ranked_.groupBy(key).agg(low.alias("a"), F.coalesce(high, low).alias("b"), F.max(F.col("place") - F.col("first")).alias("r"))
    return alike.unionByName(between.select(key, (F.col("a") + (F.col("b") - F.col("a")) * F.col("r")).alias(name)))
