"""Each row of a stream with the one before it of its key, in order of time, however late and mixed they come."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

#: A key's time is cut into spans of so many memories, each with state of its own.
SPAN = 20
#: Rows of a key are in order of time, then of number.
ORDER = StructType([StructField("t", LongType()), StructField("n", LongType())])


class PreviousRow(StatefulProcessor):
    """Rows wait in state until the watermark has passed them; the timer of the earliest then sends out all that it has
    passed in one reading, each with the one before it.

    State per key: the rows that wait and the last one that has gone. Another timer forgets that one once no row to come
    can be within `memory_ms` of it, so keys that end leave nothing behind. A row from before the watermark is too late
    and left out. Rows that aren't `own` are only there to come before others.
    """

    def __init__(self, key: str, number: str, values: StructType, memory_ms: int):
        self.key, self.number, self.values, self.memory_ms = key, number, values, memory_ms
        self.output = Row(key, number, "t", *values.names, *(f"prev_{c}" for c in values.names))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", ORDER, StructType([StructField("own", BooleanType()), *self.values.fields]))
        self.gone = handle.getValueState("gone", StructType([*ORDER.fields, *self.values.fields]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803, ANN001
        watermark, first = timerValues.getCurrentWatermarkInMs(), None
        for row in rows:
            if row["t"] >= watermark:
                self.waiting.updateValue((row["t"], row[self.number]), (row["own"], *(row[c] for c in self.values.names)))
                first = row["t"] if first is None else min(first, row["t"])
        if first is not None:
            self.handle.registerTimer(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803, ANN001
        watermark = timerValues.getCurrentWatermarkInMs()
        last = tuple(self.gone.get()) if self.gone.exists() else None
        known = last is not None
        ready, first = [], None
        for k, v in self.waiting.iterator():
            if k[0] < watermark:
                ready.append((tuple(k), tuple(v)))
            else:
                first = k[0] if first is None else min(first, k[0])
        out = []
        for (t, n), (own, *value) in sorted(ready):
            if last is not None and last[0] + self.memory_ms <= t:
                last = None
            if own:
                out.append(self.output(key[0], n, t, *value, *(last[2:] if last else (None,) * len(value))))
            last = (t, n, *value)
        if first is None and ready:
            self.waiting.clear()
        elif first is not None:
            for k, _ in ready:
                self.waiting.removeKey(k)
            self.handle.registerTimer(first)
        if last is not None and last[0] + self.memory_ms > watermark:
            if ready:
                self.gone.update(last)
                self.handle.registerTimer(last[0] + self.memory_ms)
        elif known:
            self.gone.clear()
        return iter(out)

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """State of several variables needs the store that keeps it on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def with_previous(stream: DataFrame, key: str, number: str, time: str, values: list[str], delay: str, memory_hours: float) -> DataFrame:
    """key, number, t (ms), the values, and those of the row before as prev_*: null for a first row, or after a gap of
    memory_hours or longer. Rows come out once the watermark (delay behind the latest) has passed them; those of the
    last `delay` stay in state. A number that comes again at its time before it has gone out replaces itself.

    State is by key and span of time, and the rows of a span's last memory_hours are there again for the next one, so a
    task's work and memory go by a key's rows in SPAN memories, however long the key lasts."""
    use_state_store(stream.sparkSession)
    memory = int(memory_hours * 3_600_000)
    length = max(1, SPAN * memory)
    timed = stream.withWatermark(time, delay).select(key, number, time, F.unix_millis(F.col(time)).alias("t"), *values)
    into = F.pmod("t", F.lit(length))
    span = ((F.col("t") - into) / length).cast("long")
    own, again = F.struct(span.alias("span"), F.lit(True).alias("own")), F.struct((span + 1).alias("span"), F.lit(False).alias("own"))
    spans = timed.select("*", F.explode(F.when(into >= length - memory, F.array(own, again)).otherwise(F.array(own))).alias("_s")).select(*timed.columns, "_s.*")
    types = StructType([timed.schema[c] for c in values])
    fields = [timed.schema[key], timed.schema[number], StructField("t", LongType()), *types.fields, *(StructField(f"prev_{f.name}", f.dataType) for f in types.fields)]
    return spans.groupBy(key, "span").transformWithState(PreviousRow(key, number, types, memory), StructType(fields), "Append", "EventTime")
