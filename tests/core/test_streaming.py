"""Streams against the same figures in batch, and state over a restart."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import LongType, StructField, StructType

from tempestry.plans import stages
from tempestry.streaming import flows, history

START = dt.datetime(2024, 1, 1)


def write(spark, folder, name, rows):
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1)
    df.write.parquet(str(folder / name))
    return df


def row(i, minutes, kind="click", user=1, value=60.0):
    return (i, START + dt.timedelta(minutes=minutes), user, kind, value, "{}")


def run(spark, flow, folder, mode="append"):
    """Rows of the batches that this run adds."""
    before = {p.name for p in (folder / "out").glob("batch=*")} if (folder / "out").exists() else set()
    flows.to_parquet(flow, str(folder / "out"), str(folder / "state"), mode)
    new = [str(p) for p in (folder / "out").glob("batch=*") if p.name not in before]
    return [r for p in new for r in spark.read.parquet(p).collect()]


def test_late_rows_are_dropped_and_windows_close(spark, tmp_path):
    flow = lambda: flows.flash_density(flows.events(spark, f"{tmp_path}/in/*", "*.parquet"))
    write(spark, tmp_path / "in", "a.parquet", [row(1, 0), row(2, 5), row(3, 60 * 30)])
    assert [(r.start, r.n) for r in run(spark, flow(), tmp_path)] == [(START, 2)]
    write(spark, tmp_path / "in", "b.parquet", [row(4, 1), row(5, 60 * 60)])
    assert [(r.start, r.n) for r in run(spark, flow(), tmp_path)] == [(START + dt.timedelta(hours=30), 1)]  # row 4 came after its window had closed


def test_calibration_state_outlives_a_restart(spark, tmp_path):
    flow = lambda: flows.calibration(flows.events(spark, f"{tmp_path}/in/*", "*.parquet"))
    write(spark, tmp_path / "in", "a.parquet", [row(1, 0, value=60.0), row(2, 1, value=60.0, user=2)])
    assert {r.user_id: r.offset_k for r in run(spark, flow(), tmp_path, "update")} == {1: 1.5, 2: 1.5}
    write(spark, tmp_path / "in", "b.parquet", [row(3, 2, value=60.0)])
    assert {r.user_id: (r.n, r.offset_k) for r in run(spark, flow(), tmp_path, "update")} == {1: (2, 0.85 * 1.5 + 1.5)}


def test_sessions_and_duplicates(spark, tmp_path):
    write(spark, tmp_path, "a.parquet", [row(1, 0), row(1, 0), row(2, 100), row(3, 60 * 10), row(9, 60 * 90)])
    stream = lambda: flows.events(spark, f"{tmp_path}/*", "*.parquet")
    assert flows.to_table(flows.deduplicated(stream()), "dup", str(tmp_path / "d")).count() == 4
    assert sorted(r.n for r in flows.to_table(flows.sessions(stream()), "ses", str(tmp_path / "s")).collect()) == [1, 3]


def scene(storm, hour, extent, rings=(), peak=3.0, clear=True):
    """A frame of a storm, numbered by its hour."""
    inner, outer = (rings[0], rings[-1]) if rings else ((None, None), (None, None))
    return (storm, hour, START + dt.timedelta(hours=hour), peak, float(extent), clear, len(rings), inner[0], inner[1], outer[0])


SCENES = [
    scene(1, 0, 150, [(36.0, 3.0)], clear=False), scene(1, 3, 150, [(30.0, 2.0), (120.0, 1.8)], 2.0), scene(1, 6, 140, [(30.0, 1.5), (114.0, 2.0)], 2.0), scene(1, 9, 130, [(108.0, 2.0)], 2.0),
    scene(1, 12, 120, [(90.0, 3.0)]), scene(1, 15, 60, [(36.0, 3.0)], clear=False), scene(1, 18, 0, (), 0.5), scene(2, 1, 150, [(30.0, 3.0)], clear=False), scene(2, 14, 90, [(30.0, 3.0)], clear=False), scene(2, 16, 150, (), 3.0),
]


def scene_frame(spark, rows):
    return spark.createDataFrame(rows, "storm_id long, frame_id long, valid_time timestamp, peak double, extent double, inner_clear boolean, rings int, inner_km double, inner_peak double, outer_km double")


def stage_rows(df):
    return sorted((r.storm_id, r.frame_id, r.stage, r.confidence, r.evidence) for r in df.collect())


def in_batch(spark, rows):
    """lag per storm, a frame before of twelve hours or longer ago left out."""
    w = Window.partitionBy("storm_id").orderBy("valid_time")
    f = scene_frame(spark, rows)
    recent = F.col("frame_id") - F.lag("frame_id").over(w) < 12
    return stage_rows(stages.staged(f.select("*", *(F.when(recent, F.lag(c).over(w)).alias(f"prev_{c}") for c in stages.VALUES))))


def test_stages_by_hand(spark):
    got = {(r[0], r[1]): (r[2], r[3]) for r in in_batch(spark, SCENES)}
    assert got == {
        (1, 0): (1, 0.6), (1, 3): (3, 0.7), (1, 6): (4, 0.75), (1, 9): (5, 0.65), (1, 12): (6, 0.7), (1, 15): (2, 0.85), (1, 18): (None, 0.0),
        (2, 1): (1, 0.6), (2, 14): (1, 0.6), (2, 16): (5, 0.65),
    }


def test_history_as_a_stream_with_a_restart_and_late_frames(spark, tmp_path):
    """Batches that mix the order of frames give what lag gives; a frame from before the watermark is left out."""
    flow = lambda: stages.staged(stages.stages(spark.readStream.schema(scene_frame(spark, SCENES).schema).parquet(f"{tmp_path}/in/*")))
    put = lambda name, rows: scene_frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    out = []
    put("a", [SCENES[2], SCENES[0], SCENES[7]])
    out += run(spark, flow(), tmp_path)
    assert {(r.storm_id, r.frame_id) for r in out} == {(1, 0), (2, 1)}  # hour 6 is the latest: 4.5 has been passed
    put("b", [SCENES[4], scene(1, 2, 10), SCENES[1], SCENES[3]])  # hours 2 and 3 come after the watermark
    out += run(spark, flow(), tmp_path)
    put("c", [*SCENES[5:7], *SCENES[8:], scene(3, 40, 100)])
    out += run(spark, flow(), tmp_path)
    got = sorted((r.storm_id, r.frame_id, r.stage, r.confidence, r.evidence) for r in out)
    assert got == in_batch(spark, [s for s in SCENES if s is not SCENES[1]])


class Store:
    """State of one key in memory, with its timers; counts the rows read from the map."""

    def __init__(self):
        self.rows, self.value, self.timers, self.read = {}, None, set(), 0

    getMapState = getValueState = lambda self, *_: self
    registerTimer = lambda self, t: self.timers.add(t)
    exists = lambda self: self.value is not None
    get = lambda self: self.value

    def update(self, value):
        self.value = value

    def updateValue(self, k, v):  # noqa: N802
        self.rows[k] = v

    def removeKey(self, k):  # noqa: N802
        del self.rows[k]

    def iterator(self):
        for item in list(self.rows.items()):
            self.read += 1
            yield item

    def clear(self):
        if self.rows:
            self.rows = {}
        else:
            self.value = None


def test_a_backlog_is_read_once_not_once_for_each_of_its_rows():
    n, hour = 300, 3_600_000
    values = StructType([StructField("v", LongType())])
    store, processor = Store(), history.PreviousRow("storm_id", "frame_id", values, 12 * hour)
    processor.init(store)
    rows = [{"storm_id": 1, "frame_id": i, "t": (i + 1) * hour, "v": i, "own": True} for i in range(n)]
    list(processor.handleInputRows((1, 0), iter(rows), TimerValues(0, 0)))
    watermark, out = (n + 1) * hour, []
    for t in sorted(store.timers):
        out += processor.handleExpiredTimer((1, 0), TimerValues(0, watermark), ExpiredTimerInfo(t))
    assert [(r.frame_id, r.prev_v) for r in out] == [(0, None), *((i, i - 1) for i in range(1, n))]
    assert store.read <= 2 * n


def test_history_over_the_ends_of_its_spans(spark, tmp_path):
    """A storm of many days, its frames 3 to 13 hours apart and mixed over two batches, gives what lag gives."""
    hours, at = [], 0
    for i in range(150):
        hours.append(at)
        at += (3, 11, 12, 5, 13)[i % 5]
    rows = [scene(1, h, 60 + h % 97, [(30.0 + h % 7, 2.0)]) for h in hours]
    schema = scene_frame(spark, rows).schema
    seen = []
    for name, part in (("a", rows[:80][::-1]), ("b", [*rows[80:], scene(2, at + 10, 100)])):
        scene_frame(spark, part).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        flow = stages.staged(stages.stages(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")))
        seen += [(r.storm_id, r.frame_id, r.stage, r.confidence, r.evidence) for r in run(spark, flow, tmp_path)]
    assert sorted(seen) == in_batch(spark, rows)
