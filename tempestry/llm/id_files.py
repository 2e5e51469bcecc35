"""Operator 4: token ids in files, as frequency ranks in a byte-aligned variable-length code.

A file holds a range of documents in ascending doc_id order: blocks of at most BLOCK ids, then a footer. A block has
a table of its ids by descending frequency, one control byte for four ids (two bits each: bytes of the rank, less
one), and the ranks' bytes. The footer has the documents' ids and lengths and the places of the blocks. A file needs
no other file to be read, and only one block of it is held at a time. All integers are little-endian.

A task starts a new file once one has FILE ids (a run of texts more at most), so the size of a file doesn't grow with the table. The manifest names
the files that belong together; what a lost attempt has left behind isn't in it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempestry.llm import common
from tempestry.llm.tokens import encoder

MAGIC = b"TIDS0001"
BLOCK, FILE = 1 << 20, 1 << 26
#: Bytes of each of the four ranks that a control byte stands for.
WIDTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
#: 1 where a doc_id is null.
NULL_ID = -(1 << 63)
MANIFEST = "part long, file long, name string, n_docs long, n_ids long"


def encode_block(ids: np.ndarray) -> bytes:
    """A block: counts of ids, table entries and data bytes (uint32 each), table, control bytes, data bytes."""
    counts = np.bincount(ids)  # ids are below the vocabulary's size
    known = np.flatnonzero(counts)
    known = known[np.argsort(-counts[known], kind="stable")]
    rank_of = np.empty(len(counts), dtype=np.uint32)
    rank_of[known] = np.arange(len(known), dtype=np.uint32)
    ranks = rank_of[ids]
    wider = [np.flatnonzero(ranks >> np.uint32(8 * k)) for k in (1, 2, 3) if len(known) >> 8 * k]
    padded = np.zeros(-(-len(ids) // 4) * 4, dtype=np.uint8)
    for more in wider:
        padded[more] += 1
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    width = padded[: len(ids)] + np.uint8(1)
    place = np.cumsum(width, dtype=np.int32) - width
    data = np.empty(int(width.sum(dtype=np.int64)), dtype=np.uint8)
    data[place] = ranks.astype(np.uint8)
    for k, more in enumerate(wider, 1):
        data[place[more] + k] = (ranks[more] >> np.uint32(8 * k)).astype(np.uint8)
    head = struct.pack("<III", len(ids), len(known), len(data))
    return head + known.astype("<u4").tobytes() + control.tobytes() + data.tobytes()


def decode_block(block: bytes | memoryview) -> np.ndarray:
    """Ids of a block: widths come from WIDTHS by control byte, ids from the block's table by rank."""
    n, known, size = struct.unpack_from("<III", block)
    at = 12 + 4 * known
    table = np.frombuffer(block, "<u4", known, 12)
    control = np.frombuffer(block, np.uint8, -(-n // 4), at)
    data = np.frombuffer(block, np.uint8, size, at + len(control))
    width = WIDTHS[control].ravel()[:n]
    place = np.cumsum(width, dtype=np.int32) - width
    ranks = data[place].astype(np.uint32)
    for k in (1, 2, 3):
        if known >> 8 * k and len(more := np.flatnonzero(width > k)):
            ranks[more] |= data[place[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return table[ranks]


class FileWriter:
    """Writes documents to an open file."""

    def __init__(self, out: BinaryIO):
        self.out, self.at = out, len(MAGIC)
        self.names: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.places: list[int] = []
        self.held: list[np.ndarray] = [np.array([], dtype="<u4")]
        self.waiting = self.ids = self.docs = 0
        out.write(MAGIC)

    def add(self, names: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Documents by their ids (NULL_ID for null) and lengths, and the token ids of all of them."""
        self.names.append(names)
        self.lengths.append(lengths)
        self.held.append(ids)
        self.docs += len(names)
        self.waiting += len(ids)
        self.ids += len(ids)
        if self.waiting >= BLOCK:
            self.blocks(False)

    def blocks(self, last: bool) -> None:
        joined = np.concatenate(self.held)
        whole = len(joined) if last else len(joined) // BLOCK * BLOCK
        for start in range(0, whole, BLOCK):
            block = encode_block(joined[start : min(whole, start + BLOCK)])
            self.places.append(self.at)
            self.at += len(block)
            self.out.write(block)
        self.held, self.waiting = [joined[whole:].copy()], len(joined) - whole

    def finish(self) -> None:
        self.blocks(True)
        for numbers in (*self.names, *self.lengths, np.array(self.places)):
            self.out.write(numbers.astype("<i8").tobytes())
        self.out.write(struct.pack("<qqq", self.docs, len(self.places), self.at) + MAGIC)


def read_file(source: BinaryIO, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, lengths, their ids) of runs of whole documents, a block or a longer document at a time."""
    tail = b""
    if size >= 40:
        source.seek(size - 32)
        tail = source.read(32)
    if tail[-8:] != MAGIC:
        raise ValueError("not a file of token ids, or cut short")
    n_docs, n_blocks, footer = struct.unpack("<qqq", tail[:24])
    source.seek(footer)
    numbers = np.frombuffer(source.read(8 * (2 * n_docs + n_blocks)), "<i8")
    names, lengths = numbers[:n_docs], numbers[n_docs : 2 * n_docs]
    places = [*numbers[2 * n_docs :].tolist(), footer]
    ends = np.cumsum(lengths)
    held, read, given, done = [np.array([], "<u4")], 0, 0, 0
    source.seek(len(MAGIC))
    for at, end in zip(places, places[1:], strict=False):
        ids = decode_block(source.read(end - at))
        held.append(ids)
        read += len(ids)
        whole = int(np.searchsorted(ends, read, side="right"))
        if whole > done:
            joined = np.concatenate(held)
            cut = int(ends[whole - 1]) - given
            yield names[done:whole], lengths[done:whole], joined[:cut]
            held, given, done = [joined[cut:]], given + cut, whole
    if done < n_docs:  # documents without ids at the end
        yield names[done:], lengths[done:], np.concatenate(held)


def write_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, file_ids: int = FILE) -> DataFrame:
    """Encodes docs (doc_id, text) into files below path, a folder that all executors reach; returns the manifest.

    Null texts are empty; each document gets end_id at its end, so that none is without ids. Rows are in ascending
    doc_id order, nulls first, within and over the files; repeated rows are written again, rows of one doc_id by text.
    Other columns are ignored. A text of any length is encoded whole. A file is named by its task's attempt, so
    attempts never write over each other. The manifest (MANIFEST) has a row for each file of the attempts that count;
    an empty table gives none.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        encode = encoder(tokenizer)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        files, folder = fs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)
        out = writer = None
        rows: list[tuple] = []

        def close() -> None:
            writer.finish()
            out.close()
            rows.append((part, len(rows), f"{part:06d}-{len(rows):06d}-{attempt}.ids", writer.docs, writer.ids))

        for batch in batches:
            names, at = pc.fill_null(batch.column(0), NULL_ID).to_numpy(), 0
            for lengths, ids in encode.encode(batch.column(1), end=[end_id]):
                if writer is None:
                    out = files.open_output_stream(f"{folder}/{part:06d}-{len(rows):06d}-{attempt}.ids")
                    writer = FileWriter(out)
                writer.add(names[at : at + len(lengths)], lengths, ids)
                at += len(lengths)
                if writer.ids >= file_ids:
                    close()
                    writer = None
        if writer is not None:
            close()
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
            names=["part", "file", "name", "n_docs", "n_ids"],
        )

    common.short_batches(docs.sparkSession)
    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(common.partitions(docs.sparkSession), order[0])
        .sortWithinPartitions(*order)
    )
    return common.written(ordered.mapInArrow(task, MANIFEST), "id-manifest")


def read_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Documents from the files: doc_id, start (ids of all documents before it), n_tokens, ids (binary, as pack()).

    Files are dealt to tasks by the manifest and read block by block. A damaged file is an error.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input_file(f"{folder}/{name}") as source:
                    for names, lengths, ids in read_file(source, source.size()):
                        starts = before + np.cumsum(lengths) - lengths
                        before += int(lengths.sum())
                        edges = np.concatenate([[0], 4 * np.cumsum(lengths)]).astype("<i8")
                        values = pa.py_buffer(np.ascontiguousarray(ids, "<u4"))
                        binary = pa.Array.from_buffers(pa.large_binary(), len(names), [None, pa.py_buffer(edges), values])
                        step = 2000
                        for at in range(0, len(names), step):
                            n = names[at : at + step]
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array(n, pa.int64(), mask=n == NULL_ID),
                                    pa.array(starts[at : at + step], pa.int64()),
                                    pa.array(lengths[at : at + step], pa.int64()),
                                    binary[at : at + step].cast(pa.binary()),
                                ],
                                names=["doc_id", "start", "n_tokens", "ids"],
                            )

    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = parts.select("part", F.coalesce(F.sum("ids").over(earlier.orderBy("part")), F.lit(0)).alias("parts_before"))
    within = F.coalesce(F.sum("n_ids").over(earlier.partitionBy("part").orderBy("file")), F.lit(0))
    placed = manifest.withColumn("files_before", within).join(parts, "part")
    placed = placed.select("name", (F.col("parts_before") + F.col("files_before")).alias("before"))
    dealt = placed.repartition(common.partitions(spark))
    return dealt.mapInArrow(task, "doc_id long, start long, n_tokens long, ids binary")
