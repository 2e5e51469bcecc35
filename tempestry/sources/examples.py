"""Training examples as packed files: one .npz each, added as a whole job, and not again where the same physics made it."""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from tempestry.functions import columns as C
from tempestry.sources.commits import CommittingWriter, Folder, manifest

CHANNELS = ("v37", "h37", "v89", "h89")
#: The sensors whose passes make an example.
SENSORS = ("GMI", "AMSR2")
KEYS = ("storm_id", "scene_time", "sensor", "physics_id")
#: Examples that a task of a scan reads.
READ_TOGETHER = 64


class ExampleWriter(CommittingWriter):
    """A row is an example; its arrays go into a file, its keys and the number of its valid pixels into the entry."""

    def __init__(self, options: dict):
        super().__init__(options["path"])

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, list[dict]]]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                keys = {k: row[k] for k in KEYS}
                arrays = {k: np.array(row[k] or [], np.int32 if k in ("pr", "pc") else np.uint16) for k in ("pr", "pc", *CHANNELS)}
                out = io.BytesIO()
                np.savez_compressed(out, **arrays, **{k: np.str_(v or "") for k, v in keys.items()})
                yield row["name"], out.getvalue(), [keys | {"name": row["name"], "n_valid": int((arrays["v37"] > 0).sum())}]


class Some(D.InputPartition):
    def __init__(self, entries: list[dict]):
        self.entries = entries


class ExampleReader(D.DataSourceReader):
    """Equalities of name, storm, sensor and physics choose the files before any is opened."""

    def __init__(self, options: dict):
        self.uri, self.asked = options["path"], []

    def pushFilters(self, filters: list) -> Iterable:  # noqa: N802
        for f in filters:
            if isinstance(f, (D.EqualTo, D.In)) and f.attribute[0] in ("name", *KEYS):
                self.asked.append((f.attribute[0], set(f.value) if isinstance(f, D.In) else {f.value}))
            else:
                yield f

    def partitions(self) -> list[D.InputPartition]:
        found = [e for e in Folder(self.uri).entries() if all(e[k] in values for k, values in self.asked)]
        return [Some(found[i : i + READ_TOGETHER]) for i in range(0, len(found), READ_TOGETHER)]

    def read(self, partition: Some | None) -> Iterator[pa.RecordBatch]:
        folder = Folder(self.uri)
        for e in partition.entries if partition else []:
            with np.load(io.BytesIO(folder.get(e["path"]))) as z:
                arrays = {k: pa.array([z[k].tolist()], pa.list_(pa.int32())) for k in ("pr", "pc", *CHANNELS)}
            yield pa.RecordBatch.from_pydict({"name": pa.array([e["name"]]), **{k: pa.array([e[k]], pa.string()) for k in KEYS}, **arrays})


class ExampleSource(D.DataSource):
    """format("examples")"""

    @classmethod
    def name(cls) -> str:
        return "examples"

    def schema(self) -> str:
        return ", ".join([*(f"{k} string" for k in ("name", *KEYS)), *(f"{k} array<int>" for k in ("pr", "pc", *CHANNELS))])

    def reader(self, schema: object) -> D.DataSourceReader:
        return ExampleReader(dict(self.options))

    def writer(self, schema: object, overwrite: bool) -> D.DataSourceWriter:
        return ExampleWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ExampleSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """name, path, bytes, storm_id, scene_time, sensor, physics_id, n_valid, version of the examples that are there."""
    return manifest(spark, path, f"{', '.join(f'{k} string' for k in KEYS)}, n_valid long")


def packed(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each value of keys, with its pixels' places and packed channels in order of place."""
    cells = F.array_sort(F.collect_list(F.struct("pr", "pc", *(C.pack(F.col(c)).alias(c) for c in CHANNELS))))
    return pixels.groupBy(*keys).agg(cells.alias("x")).select(*keys, *(F.col(f"x.{c}").alias(c) for c in ("pr", "pc", *CHANNELS)))


def export(examples: DataFrame, path: str) -> None:
    """Adds examples (storm_id, scene_time, sensor, physics_id and the arrays of packed()) to the folder.

    Those of other sensors than SENSORS, or without a valid pixel, are left out. A name is storm, time and sensor; an
    example that is there under the same physics stays as it is and isn't written, one of other physics is replaced. Of
    rows of one name the smallest is written. Either all are there afterwards or, if the job fails, none.
    """
    spark = examples.sparkSession
    register(spark)
    name = F.concat("storm_id", F.lit("_"), F.date_format("scene_time", "yyyyMMddHHmm"), F.lit("_"), F.regexp_replace("sensor", "-", ""), F.lit(".npz"))
    wanted = examples.where(F.col("sensor").isin(*SENSORS) & F.exists("v37", lambda v: v > 0))
    rows = wanted.select(name.alias("name"), "storm_id", F.date_format("scene_time", "yyyy-MM-dd'T'HH:mm:ss").alias("scene_time"), "sensor", "physics_id", "pr", "pc", *CHANNELS)
    new = rows.join(listing(spark, path).select("name", "physics_id"), ["name", "physics_id"], "left_anti")
    one = new.groupBy("name").agg(F.min(F.struct(*(c for c in new.columns if c != "name"))).alias("x")).select("name", "x.*")
    one.write.format("examples").mode("append").save(path)
