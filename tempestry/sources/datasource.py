"""A Python data source for packed frames: .npz files of 2-D arrays as pixel rows, one file a task."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tempestry.sources.commits import file_system


class FrameFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]

    def partitions(self) -> list[InputPartition]:
        files, folder = file_system(self.folder)
        found = files.get_file_info(fs.FileSelector(folder))
        return [FrameFile(p.path) for p in sorted(found, key=lambda p: p.path) if p.path.endswith(".npz")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """A frame as one batch of columns."""
        files, _ = file_system(self.folder)
        with files.open_input_file(partition.path) as file:
            frames = np.load(io.BytesIO(file.read()))
        lat, lon = frames["lat"], frames["lon"]
        packed = {c: frames[c] if c in frames.files else np.zeros(lat.shape, np.uint16) for c in ("v37", "h37", "v89", "h89")}
        name = partition.path.rpartition("/")[2].removesuffix(".npz")
        rows, columns = (x.ravel().astype(np.int32) for x in np.indices(lat.shape))
        values = {c: packed[c].ravel() for c in packed}
        yield pa.RecordBatch.from_pydict(
            {
                "frame": pa.array([name] * lat.size, pa.string()),
                "pr": pa.array(rows),
                "pc": pa.array(columns),
                "lat": pa.array(lat.ravel().astype(np.float64)),
                "lon": pa.array(lon.ravel().astype(np.float64)),
            }
            | {c: pa.array(v * 0.01, pa.float64(), mask=v == 0) for c, v in values.items()}
        )


class FrameSource(DataSource):
    """format("frames"): path is a folder that all executors reach. Packed 0 is missing."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "frame string, pr int, pc int, lat double, lon double, v37 double, h37 double, v89 double, h89 double"

    def reader(self, schema: object) -> DataSourceReader:
        return FrameReader(self.options)
