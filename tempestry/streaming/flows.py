"""Streams of events: lightning density, sessions, passes against fixes, duplicates, and calibration state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOOKBACK = "12 hours"


def events(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_trigger: int = 1) -> DataFrame:
    """The event files of a folder as a stream; ts with a zone, as watermarks ask for."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def flash_density(stream: DataFrame, window: str = "10 minutes", late: str = LOOKBACK) -> DataFrame:
    """Flashes and energy per tumbling window; events later than the watermark are dropped."""
    flashes = stream.where("event_type = 'click'").withWatermark("ts", late)
    return flashes.groupBy(F.window("ts", window)).agg(F.count("*").alias("n"), F.sum("value").alias("energy")).select(F.col("window.start").alias("start"), "n", "energy")


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = LOOKBACK) -> DataFrame:
    """Runs of a key's events without a longer gap."""
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy("user_id", w).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def passes_near_fixes(stream: DataFrame, within: str = LOOKBACK) -> DataFrame:
    """Passes with each fix of the same storm in the time before them; both sides keep no more than that in state."""
    passes = stream.where("event_type = 'view'").select(F.col("event_id").alias("pass_id"), F.col("user_id").alias("storm_id"), F.col("ts").alias("pass_ts")).withWatermark("pass_ts", within)
    fixes = stream.where("event_type in ('signup', 'purchase')").select(F.col("event_id").alias("fix_id"), F.col("user_id").alias("fix_storm"), F.col("ts").alias("fix_ts")).withWatermark("fix_ts", within)
    near = F.expr(f"storm_id = fix_storm AND fix_ts <= pass_ts AND fix_ts >= pass_ts - INTERVAL {within}")
    return passes.join(fixes, near).select("pass_id", "fix_id", "storm_id")


def deduplicated(stream: DataFrame, late: str = LOOKBACK) -> DataFrame:
    """The first of each event_id within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def calibration(stream: DataFrame, rate: float = 0.15, bound: float = 40.0) -> DataFrame:
    """user_id, n, offset_k after each batch: an exponential mean of value - 50 in order of time, kept as state."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, offset = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for x in rows["value"].round():
            offset = max(-bound, min(bound, (1 - rate) * offset + rate * (x - 50)))
        n += len(rows)
        state.update((n, offset))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "offset_k": [offset]})

    keyed = stream.select("user_id", "event_id", "ts", "value").groupBy("user_id")
    return keyed.applyInPandasWithState(update, "user_id long, n long, offset_k double", "n long, offset double", "update", GroupStateTimeout.NoTimeout)


def to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there and returns its rows, by an in-memory table (tests and smoke runs)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Exactly-once files: each batch's rows under its own number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
