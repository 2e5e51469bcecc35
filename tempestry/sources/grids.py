"""Images on a fixed grid of scan angles, in strips of compressed chunks; a scan reads the chunks that its filters need.

A strip is a line of JSON and the chunks that hold anything, each a zlib stream of unsigned 16-bit numbers. The line says
where each chunk begins; a file holds strips one after the other. Axes are linear in the row and the column; y usually
descends with the row.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from tempestry.functions import columns as C
from tempestry.functions import constants as K
from tempestry.sources.commits import CommittingWriter, Folder

#: Numbers of a grid's definition: its size, the side of a chunk, axes, and how stored numbers become values.
INTS, FLOATS = ("rows", "cols", "chunk", "fill"), ("x0", "dx", "y0", "dy", "scale", "offset")
#: Bytes at which a file of strips is full, and strips that one task of a scan opens.
FILE_BYTES, READ_TOGETHER = 1 << 26, 256
SCHEMA = "frame long, pr int, pc int, scan_x double, scan_y double, value double"
CHUNKS = "frame long, strip int, chunk int, bytes long"


class GridWriter(CommittingWriter):
    """Rows in order of frame, strip and chunk; a task holds a chunk and the compressed strips of a file."""

    def __init__(self, options: dict):
        super().__init__(options["path"])
        self.grid = {k: int(options[k]) for k in INTS} | {k: float(options[k]) for k in FLOATS}

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, list[dict]]]:
        data, entries, number = bytearray(), [], 0
        for strip, chunks in self.strips(batches):
            spans, at = {}, 0
            for chunk, packed in chunks:
                spans[str(chunk)] = [at, len(packed)]
                at += len(packed)
            head = json.dumps({"frame": strip[0], "strip": strip[1], "chunks": spans}).encode() + b"\n"
            entries.append({"name": f"{strip[0]}-{strip[1]}", "frame": strip[0], "strip": strip[1], "begin": len(data), "head": len(head), "bytes": len(head) + at, "grid": self.grid})
            data += head
            for _, packed in chunks:
                data += packed
            if len(data) >= FILE_BYTES:
                yield f"{number}.grid", bytes(data), entries
                data, entries, number = bytearray(), [], number + 1
        if entries:
            yield f"{number}.grid", bytes(data), entries

    def strips(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[tuple[int, bytes]]]]:
        """Each strip's chunks that hold anything, compressed."""
        side, fill = self.grid["chunk"], self.grid["fill"]
        strip, at, cells, chunks = None, None, None, []

        def closed() -> None:
            if at is not None and (cells != fill).any():
                chunks.append((at, zlib.compress(cells.tobytes())))

        for batch in batches:
            frame, pr, pc = (batch.column(c).to_numpy() for c in ("frame", "pr", "pc"))
            raw = batch.column("raw").fill_null(fill).to_numpy().astype(np.uint16)
            keys = np.stack([frame, pr // side, pc // side])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(raw)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                key = tuple(keys[:, lo].tolist())
                if key != (*(strip or ()), at):
                    closed()
                    if key[:2] != strip and strip is not None:
                        yield strip, chunks
                        chunks = []
                    strip, at, cells = key[:2], key[2], np.full((side, side), fill, np.uint16)
                cells[pr[lo:hi] % side, pc[lo:hi] % side] = raw[lo:hi]
        closed()
        if strip is not None:
            yield strip, chunks


class Strips(D.InputPartition):
    """Strips of one grid."""

    def __init__(self, grid: dict, entries: list[dict]):
        self.grid, self.entries = grid, entries


class GridReader(D.DataSourceReader):
    """Comparisons of frame, row, column and scan angles choose strips when the scan is planned and chunks in its tasks."""

    def __init__(self, options: dict):
        self.uri, self.listing = options["path"], options.get("list") == "chunks"
        self.low: dict[str, float] = {}
        self.high: dict[str, float] = {}
        self.frames: set | None = None

    def pushFilters(self, filters: list) -> Iterable:  # noqa: N802
        """All filters are returned too: chunks are coarser than rows."""
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if name in ("frame", "pr", "pc", "scan_x", "scan_y") and isinstance(f, (D.GreaterThan, D.GreaterThanOrEqual, D.EqualTo)):
                edge = np.nextafter(f.value, math.inf) if isinstance(f, D.GreaterThan) else f.value
                self.low[name] = max(edge, self.low.get(name, -math.inf))
            if name in ("frame", "pr", "pc", "scan_x", "scan_y") and isinstance(f, (D.LessThan, D.LessThanOrEqual, D.EqualTo)):
                edge = np.nextafter(f.value, -math.inf) if isinstance(f, D.LessThan) else f.value
                self.high[name] = min(edge, self.high.get(name, math.inf))
            if isinstance(f, D.In) and name == "frame":
                self.frames = set(f.value) if self.frames is None else self.frames & set(f.value)
            yield f

    def within(self, name: str, values: np.ndarray) -> np.ndarray:
        return (values >= self.low.get(name, -math.inf)) & (values <= self.high.get(name, math.inf))

    def wanted(self, grid: dict, index: str, size: str, axis: str, first: str, step: str) -> np.ndarray:
        """The numbers of the chunks, along one axis, that hold a row (or a column) that the filters ask for."""
        at = np.arange(grid[size])
        return np.unique(at[self.within(index, at) & self.within(axis, grid[first] + grid[step] * at)] // grid["chunk"])

    def partitions(self) -> list[D.InputPartition]:
        asked: dict[str, list[dict]] = {}
        wanted: dict[str, set[int]] = {}
        for e in Folder(self.uri).entries():
            key = json.dumps(e.pop("grid"), sort_keys=True)
            if key not in wanted:
                wanted[key] = set(self.wanted(json.loads(key), "pr", "rows", "scan_y", "y0", "dy").tolist())
            if e["strip"] in wanted[key] and bool(self.within("frame", np.array([e["frame"]]))[0]) and (self.frames is None or e["frame"] in self.frames):
                asked.setdefault(key, []).append(e)
        out = []
        for key, entries in asked.items():
            entries.sort(key=lambda e: (e["path"], e["begin"]))
            out += [Strips(json.loads(key), entries[i : i + READ_TOGETHER]) for i in range(0, len(entries), READ_TOGETHER)]
        return out

    def read(self, partition: Strips | None) -> Iterator[pa.RecordBatch]:
        """Each file is opened once, and the wanted chunks of its strips are read from it."""
        if partition is None:  # no strip was asked for
            return
        grid, folder = partition.grid, Folder(self.uri)
        columns = self.wanted(grid, "pc", "cols", "scan_x", "x0", "dx").tolist()
        for path, entries in groupby(partition.entries if columns else [], key=lambda e: e["path"]):
            with folder.files.open_input_file(f"{folder.path}/{path}") as file:
                for entry in entries:
                    file.seek(entry["begin"])
                    spans = json.loads(file.read(entry["head"]))["chunks"]
                    for at in columns:
                        if str(at) in spans:
                            begin, size = spans[str(at)]
                            file.seek(entry["begin"] + entry["head"] + begin)
                            data = file.read(size)
                            yield self.listed(entry, at, size) if self.listing else self.pixels(entry, grid, at, zlib.decompress(data))

    def listed(self, entry: dict, at: int, size: int) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((entry["frame"], entry["strip"], at, size), kinds, strict=True)], ["frame", "strip", "chunk", "bytes"])

    def pixels(self, entry: dict, grid: dict, at: int, data: bytes) -> pa.RecordBatch:
        """Cells of a chunk that lie on the grid; the fill number is a missing value."""
        side = grid["chunk"]
        raw = np.frombuffer(data, np.uint16)
        pr, pc = (i.ravel() + base * side for i, base in zip(np.indices((side, side)), (entry["strip"], at), strict=True))
        on = (pr < grid["rows"]) & (pc < grid["cols"])
        raw, pr, pc = raw[on], pr[on], pc[on]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(raw), entry["frame"]), pa.int64()), pa.array(pr, pa.int32()), pa.array(pc, pa.int32()), pa.array(grid["x0"] + grid["dx"] * pc), pa.array(grid["y0"] + grid["dy"] * pr),
             pa.array(raw * grid["scale"] + grid["offset"], pa.float64(), mask=raw == grid["fill"])],
            ["frame", "pr", "pc", "scan_x", "scan_y", "value"],
        )


class GridSource(D.DataSource):
    """format("grids"): rows of frame, pr, pc, raw are written; pixels, or with list=chunks the chunks opened, are read."""

    @classmethod
    def name(cls) -> str:
        return "grids"

    def schema(self) -> str:
        return CHUNKS if self.options.get("list") == "chunks" else SCHEMA

    def reader(self, schema: object) -> D.DataSourceReader:
        return GridReader(dict(self.options))

    def writer(self, schema: object, overwrite: bool) -> D.DataSourceWriter:
        return GridWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """The format, and the setting by which Spark hands filters to sources in Python."""
    spark.dataSource.register(GridSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write(pixels: DataFrame, path: str, **grid: float) -> None:
    """Adds frames (frame, pr, pc, raw; raw null or fill is missing) to the folder; a frame's strips may be in several
    tasks, so no task holds a frame. Rows off the grid are an error; of a strip that is there already the new one counts."""
    register(pixels.sparkSession)
    side = int(grid["chunk"])
    off = (F.col("pr") < 0) | (F.col("pr") >= int(grid["rows"])) | (F.col("pc") < 0) | (F.col("pc") >= int(grid["cols"]))
    checked = pixels.select("frame", F.when(off, F.raise_error(F.lit("a pixel lies off the grid"))).otherwise(F.col("pr")).cast("int").alias("pr"), F.col("pc").cast("int").alias("pc"), F.col("raw").cast("int").alias("raw"))
    strip, chunk = F.expr(f"pr div {side}"), F.expr(f"pc div {side}")
    placed = checked.repartition("frame", strip).sortWithinPartitions("frame", strip, chunk)
    placed.write.format("grids").mode("append").options(**{k: str(v) for k, v in grid.items()}).save(path)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("grids").options(**options).load(path)


def scan_point(lat: float, lon: float, sub_lon: float) -> tuple[float, float] | None:
    """Scan angles (x, y) of one point, None if the satellite doesn't see it."""
    ratio = K.R_EQ_M**2 / K.R_POL_M**2
    c = math.atan(math.tan(math.radians(lat)) / ratio)
    r = K.R_POL_M / math.sqrt(1 - (1 - 1 / ratio) * math.cos(c) ** 2)
    d = math.radians(lon - sub_lon)
    x, y, z = K.ORBIT_M - r * math.cos(c) * math.cos(d), r * math.cos(c) * math.sin(d), r * math.sin(c)
    if K.ORBIT_M * (K.ORBIT_M - x) <= y * y + ratio * z * z:
        return None
    return math.asin(y / math.sqrt(x * x + y * y + z * z)), math.atan(z / x)


def crop(pixels: DataFrame, lat: float, lon: float, sub_lon: float, half_width_km: float = 512.0) -> DataFrame:
    """Pixels within the half width of a point, by scan angle: from the lower edge, below the upper one, whichever way
    an axis runs; none if the point is off the disk or off the grid. A radian is as wide as the orbit's radius, as at
    the sub-satellite point, so the crop holds more ground elsewhere. The filters choose the chunks that are read."""
    centre = scan_point(lat, lon, sub_lon)
    if centre is None:
        return pixels.where(F.lit(False))
    half = half_width_km * 1000 / K.ORBIT_M
    for axis, at in zip(("scan_x", "scan_y"), centre, strict=True):
        pixels = pixels.where((F.col(axis) >= at - half) & (F.col(axis) < at + half))
    return pixels


def located(pixels: DataFrame, sub_lon: float) -> DataFrame:
    """pixels with lat and lon, NULL where the ray misses the Earth."""
    lat, lon = C.scan_to_geodetic(F.col("scan_x"), F.col("scan_y"), sub_lon)
    return pixels.withColumns({"lat": lat, "lon": lon})
