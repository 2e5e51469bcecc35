"""Operator 1: sum-of-squares online packing of token ids into training windows.

A document's ids are cut into whole windows; what is left is a piece shorter than a window. Pieces are placed as
they come. ``levels[h]`` counts the open windows that are filled to h, and a piece of size s goes where the sum of
the squared counts grows least: into a window at some level h, which lowers levels[h] and raises levels[h + s], or
into a new one. Each task packs its own documents, so nothing is shuffled and a lost task is simply packed again.
When a task ends, its open windows are closed: the emptiest are cut to fill the fullest, so that at most one window
a task needs padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempestry.llm import common
from tempestry.llm.tokens import encoder

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(c, pa.binary() if c == "ids" else pa.int64()) for c in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")])
#: Sequence ids of a task start at its partition number times this.
TASK_IDS = 1 << 36


class Windows:
    """Open windows of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int):
        self.window, self.levels = window, np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]
        self.closed: list[list[tuple]] = []

    def level_for(self, size: int) -> int:
        """The level that costs least, 0 for a new window; ties go to the fuller window."""
        n = self.levels
        cost = np.where(n[1 : self.window - size + 1] > 0, 2 * (n[size + 1 :] - n[1 : self.window - size + 1]) + 2, np.iinfo(np.int64).max)
        if len(cost) and n[self.window - size]:
            cost[-1] = 1 - 2 * n[self.window - size]
        new = 2 * n[size] + 1
        best = len(cost) - 1 - int(cost[::-1].argmin()) if len(cost) else -1
        return best + 1 if len(cost) and cost[best] <= new else 0

    def place(self, piece: tuple) -> None:
        size = len(piece[2]) // 4
        level = self.level_for(size) if size < self.window else 0
        held = self.open[level].pop() if level else []
        self.levels[level] -= level > 0
        held.append(piece)
        if level + size == self.window:
            self.closed.append(held)
        else:
            self.levels[level + size] += 1
            self.open[level + size].append(held)

    def finish(self) -> None:
        """Closes the open windows: pieces of the emptiest are cut to fill the fullest."""
        left = [(level, held) for level, windows in enumerate(self.open) for held in windows]
        low, high = 0, len(left) - 1
        spare: list[tuple] = []
        while low <= high:
            level, held = left[high]
            high -= 1
            while level < self.window and (spare or low <= high):
                if not spare:
                    spare = left[low][1][::-1]
                    low += 1
                doc, start, ids, total = spare.pop()
                cut = min(len(ids) // 4, self.window - level)
                held.append((doc, start, ids[: 4 * cut], total))
                level += cut
                if cut < len(ids) // 4:
                    spare.append((doc, start + cut, ids[4 * cut :], total))
            self.closed.append(held)
        while spare:  # the last window was full before its source was used up
            held, level = [], 0
            while spare and level < self.window:
                piece = spare.pop()
                level += len(piece[2]) // 4
                held.append(piece)
            self.closed.append(held)
        self.open, self.levels = [[] for _ in range(self.window + 1)], np.zeros(self.window + 1, dtype=np.int64)


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` ids: PIECES, ids as little-endian uint32.

    docs: doc_id, text; other columns are ignored, whatever their names. tokenizer: a byte-level tokenizers file.
    A null or empty text is the end id alone. A null doc_id stays null. Repeated rows are documents of their own.
    A text of any length is encoded whole; an empty table gives no pieces.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, windows = encoder(tokenizer), Windows(window)
        sequence = TaskContext.get().partitionId() * TASK_IDS

        def closed() -> pa.RecordBatch:
            nonlocal sequence
            columns: list[list] = [[] for _ in ARROW]
            for held in windows.closed:
                offset = 0
                for doc, start, ids, total in held:
                    for column, value in zip(columns, (doc, start, len(ids) // 4, ids, total, sequence, offset), strict=True):
                        column.append(value)
                    offset += len(ids) // 4
                sequence += 1
            windows.closed = []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)

        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            for lengths, ids in encode.encode(batch.column(1), end=[end_id]):
                joined, at = ids.tobytes(), 0
                for total in lengths.tolist():
                    doc = next(names)
                    for start in range(0, total, window):
                        place = 4 * (at + start)
                        windows.place((doc, start, joined[place : place + 4 * min(window, total - start)], total))
                    at += total
                if len(windows.closed) > 2000:
                    yield closed()
        windows.finish()
        yield closed()

    common.short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, PIECES)


def packed_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
