"""Operator 5: approximate nearest neighbours by collision counting.

Vectors lie in blocks of at most BLOCK rows; a block keeps PROJECTIONS random projections of its rows, each as a sorted
array. A query opens a window around its own projection in each array, as wide as WIDTH times a radius. A vector that
collides with it in SHARE of the arrays or more is verified by its exact inner product. The radius starts at START of
the distance of the k-th best vector known so far and grows by GROW (virtual rehashing: nothing is hashed again, the
same arrays are read by wider windows) until it has passed that distance, which falls with each vector verified.

The first radius comes from the 2 k-th best of a bounded sample of all vectors, so more than k lie within it; where
there are fewer, windows are whole, and so they are for a query that has found fewer than k in the end. Blocks are then searched in rounds, each GROWTH times
as many as all before, so that most blocks meet queries whose radius is nearly final. Rows of one block agree in the
signs of their first projections, as far as there are rows enough, and a query leaves out a block whose ball, or too
many of whose projections' ranges, its widest windows don't reach: no vector of it could collide often enough.

Largest inner product becomes nearest distance by one more component, sqrt(M^2 - |v|^2), M the largest norm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.llm import common

BLOCK, QUERIES = 8192, 512
PROJECTIONS, SHARE, WIDTH = 192, 0.72, 1.2  # counts of collisions fit a byte
START, GROW = 1 / 1.2, 1.2
#: Vectors whose SLACK k-th best starts the radius; blocks of a round for each block before it.
SAMPLE, SLACK, GROWTH = 8192, 2, 16
#: Share of a score that rounding may take.
ROUNDING = 1e-9
#: Projections whose signs order the rows.
SIGNS = 20
FOUND = "query_id long, vec_id long, score double"
BLOCKS = "block long, ids binary, vectors binary, bounds binary"


def projection_lines(d: int, seed: int = 7) -> np.ndarray:
    """(d + 1, PROJECTIONS) normal components; the last row belongs to the added component."""
    return np.random.default_rng(seed).standard_normal((d + 1, PROJECTIONS))


def unit(queries: np.ndarray) -> np.ndarray:
    return queries / np.linalg.norm(queries, axis=1, keepdims=True)


class Index:
    """Sorted projections of one block: vectors as rows of float64, largest the largest norm of all blocks."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float):
        self.ids, self.vectors, self.largest = ids, vectors, largest
        rest = np.sqrt(np.maximum(0, largest**2 - (vectors**2).sum(axis=1)))
        points = np.hstack([vectors, rest[:, None]]) / largest
        self.lines = projection_lines(vectors.shape[1])
        places = (points @ self.lines).T
        order = np.argsort(places, axis=1)
        self.sorted = np.take_along_axis(places, order, axis=1)
        self.rank = np.empty(order.shape, dtype=np.uint16)  # of each vector in each sorted array
        np.put_along_axis(self.rank, order, np.arange(len(ids), dtype=np.uint16)[None, :], axis=1)
        self.centre = points.mean(axis=0)
        self.radius = float(np.sqrt(((points - self.centre) ** 2).sum(axis=1).max()))
        self.needed = int(np.ceil(SHARE * PROJECTIONS))

    def reached(self, units: np.ndarray, at: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Whether a vector within far of the query can be here and collide often enough."""
        apart = np.sqrt(np.maximum(0, 1 + self.centre @ self.centre - 2 * units @ self.centre[:-1]))
        half = WIDTH * far[:, None]
        meet = (at + half >= self.sorted[:, 0]) & (at - half <= self.sorted[:, -1])
        return (apart - self.radius <= far + 1e-9) & (meet.sum(axis=1) >= self.needed)

    def search(
        self, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(query, ids, scores, vectors verified) of its up to k best here that aren't below its bound.

        A query's own id is left out before anything is counted as found; ties go to the smaller id.
        """
        units = unit(queries)
        norms = np.linalg.norm(queries, axis=1)
        at = units @ self.lines[:-1]
        bounds = bounds - ROUNDING * np.abs(bounds, where=np.isfinite(bounds), out=np.zeros(len(bounds)))
        far = self.distance(bounds, norms)
        asked = np.flatnonzero(self.reached(units, at, far))
        if not len(asked):
            return
        levels = START * GROW ** np.arange(int(np.ceil(np.log(1 / START) / np.log(GROW) - 1e-9)) + 1)
        half = np.where(np.isfinite(bounds[asked, None]), WIDTH * far[asked, None] * levels, np.inf)
        low = np.empty((len(levels), PROJECTIONS, len(asked)), dtype=np.int64)
        high = np.empty_like(low)
        for j in range(PROJECTIONS):
            low[:, j] = np.searchsorted(self.sorted[j], at[asked, j] - half.T)
            high[:, j] = np.searchsorted(self.sorted[j], at[asked, j] + half.T, side="right")
        span, low = (high - low).astype(np.uint16), low.astype(np.uint16)
        for n, q in enumerate(asked.tolist()):
            other = self.ids != query_ids[q]
            scores = np.full(len(self.ids), -np.inf)
            seen, bound, radius = np.zeros(len(self.ids), dtype=bool), bounds[q], far[q]
            for level, share in enumerate(levels):
                inside = (self.rank - low[level, :, n, None]) < span[level, :, n, None]
                collided = inside.view(np.uint8).sum(axis=0, dtype=np.uint8) >= self.needed
                fresh = np.flatnonzero(collided & other & ~seen)
                seen[fresh] = True
                scores[fresh] = self.vectors[fresh] @ queries[q]
                if seen.sum() >= k:
                    best = np.partition(scores, -k)[-k]
                    bound = max(bound, best - ROUNDING * abs(best))
                    radius = self.distance(np.array([bound]), norms[q : q + 1])[0]
                if share * far[q] >= radius:
                    break
            found = np.flatnonzero(seen & (scores >= bound))
            exact = (self.vectors[found] * queries[q]).sum(axis=1)  # in one order for all, so that equal ones tie
            best = np.lexsort((self.ids[found], -exact))[:k]
            yield int(query_ids[q]), self.ids[found[best]], exact[best], int(seen.sum())

    def distance(self, scores: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Distance to a vector of that inner product; that of the farthest for a bound that isn't known."""
        cosine = np.maximum(scores / (norms * self.largest), -1.0)
        return np.sqrt(np.maximum(2 - 2 * cosine, 1e-12))


def valid(vector: Column) -> Column:
    """Not null or empty, every component finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def floats(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("<f8")


def packed(rows: DataFrame, of_block: int, d: int) -> DataFrame:
    """Rows (id, v, bound) as BLOCKS, cut from rows that follow each other in their partition."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def made(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal block, held
            ids, vectors, bounds = (np.concatenate([h[i] for h in held]) for i in range(3))
            whole = len(ids) if last else len(ids) // of_block * of_block
            for at in range(0, whole, of_block):
                cut = slice(at, min(whole, at + of_block))
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([block], pa.int64()),
                        "ids": pa.array([ids[cut].tobytes()], pa.binary()),
                        "vectors": pa.array([vectors[cut].tobytes()], pa.binary()),
                        "bounds": pa.array([bounds[cut].tobytes()], pa.binary()),
                    }
                )
                block += 1
            held = [(ids[whole:], vectors[whole:], bounds[whole:])]

        n = 0
        for batch in batches:
            ids = batch.column(0).to_numpy().astype("<i8")
            held.append((ids, floats(batch.column(1)).reshape(-1, d), batch.column(2).to_numpy().astype("<f8")))
            n += len(ids)
            if n >= of_block:
                yield from made(False)
                n = len(held[0][0])
        if n:
            yield from made(True)

    return rows.select("id", "v", "bound").mapInArrow(task, BLOCKS)


def arrays(block: dict, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, bounds = np.frombuffer(block["ids"], "<i8"), np.frombuffer(block.get("bounds", b""), "<f8")
    return ids, np.frombuffer(block["vectors"], "<f8").reshape(-1, d), bounds


def side_by_side(rows: DataFrame, d: int, largest: float) -> DataFrame:
    """Rows with the signs of their first projections as a number to be sorted by: near vectors share its first bits."""
    lines = projection_lines(d)[:, :SIGNS]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = floats(batch.column(1)).reshape(-1, d)
            rest = np.sqrt(np.maximum(0, largest**2 - (v**2).sum(axis=1)))
            signs = np.hstack([v, rest[:, None]]) @ lines > 0
            number = signs @ (1 << np.arange(SIGNS - 1, -1, -1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number, pa.int64())], names=["id", "v", "signs"])

    return rows.mapInArrow(task, "id long, v array<double>, signs long")


def searched(data: DataFrame, wanted: DataFrame, d: int, largest: float, k: int) -> DataFrame:
    """FOUND of each data block for each query block. Every query block is sent to every data block, not to each row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if held != row["block"]:
                    held, index = row["block"], Index(*arrays(row, d)[:2], largest)
                asked = {name: row[f"query_{name}"] for name in ("ids", "vectors", "bounds")}
                parts: list[list] = [[np.array([], "<i8")], [np.array([], "<i8")], [np.array([], "<f8")]]
                for name, ids, scores, _ in index.search(*arrays(asked, d), k):
                    for part, x in zip(parts, (np.full(len(ids), name, "<i8"), ids, scores), strict=True):
                        part.append(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(p)) for p in parts], names=["query_id", "vec_id", "score"]
                )

    spark = data.sparkSession
    numbers = data.select("block").distinct()
    renamed = wanted.select(*(F.col(c).alias(f"query_{c}") for c in ("ids", "vectors", "bounds")))
    pairs = numbers.crossJoin(renamed)  # blocks by blocks: a stated query set against all rows
    met = data.drop("bounds").join(pairs, "block").repartition(common.partitions(spark), "block", F.xxhash64("query_ids"))
    return met.sortWithinPartitions("block").mapInArrow(task, FOUND)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank; repeated vec_ids stay as often as they occur."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k vectors of largest inner product found for each query.

    Both have vec_id and embedding; other columns are ignored. Rows with a null vec_id or an embedding that is null,
    empty, zero or has a null or non-finite component take no part, nor do those whose number of components isn't
    the most frequent one. A query doesn't find rows of its own vec_id. Repeated rows are found as often as they
    occur; repeated queries are answered once. No vectors or no queries: no rows. SAMPLE bounds only what the radius
    starts from: every row is indexed, and every query meets every block.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        kept = df.where(F.col("vec_id").isNotNull() & valid(v))
        return kept.select(F.col("vec_id").cast("long").alias("id"), v.alias("v"))

    rows = usable(vectors)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("largest"))
    sizes = sizes.orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n, largest = sizes["d"], sizes["n"], sizes["largest"]
    rows = rows.where(F.size("v") == d)
    asked = usable(queries).where(F.size("v") == d).dropDuplicates(["id"])
    blocks = max(1, -(-n // BLOCK))
    signed = side_by_side(rows, d, largest)
    dealt = signed.repartitionByRange(min(blocks, common.partitions(spark)), "signs", F.xxhash64("id"))
    data = common.written(packed(dealt.sortWithinPartitions("signs").withColumn("bound", F.lit(0.0)), BLOCK, d), "vectors")

    drawn = rows.orderBy(F.xxhash64("id", "v")).limit(SAMPLE)  # the least hashes of tasks, then of all
    sample = [(r["id"], r["v"]) for r in drawn.collect()]
    sample_ids = np.array([i for i, _ in sample], "<i8")
    sample_vectors = np.array([v for _, v in sample], "<f8").reshape(-1, d)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = batch.column(0).to_numpy(), floats(batch.column(1)).reshape(-1, d)
            scores = v @ sample_vectors.T
            scores[ids[:, None] == sample_ids] = -np.inf
            place = SLACK * k
            known = np.full(len(ids), -np.inf)
            if len(sample_ids) >= place:
                known = np.partition(scores, -place, axis=1)[:, -place]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known)], names=["id", "v", "bound"])

    asked = common.written(asked.mapInArrow(bound, "id long, v array<double>, bound double"), "queries")
    best, since, until = None, 0, GROWTH * max(1, SAMPLE // BLOCK)
    order = F.pmod(F.xxhash64("block"), F.lit(1 << 40)) / F.lit(float(1 << 40))  # in [0, 1): which round a block is in
    while True:
        part = data.where((order >= since / blocks) & (order < until / blocks)) if blocks > until or since else data
        wanted = common.written(packed(asked, QUERIES, d), "query-blocks")
        found = searched(part, wanted, d, largest, k)
        best = best_of(found if best is None else best.select("query_id", "vec_id", "score").unionByName(found), k)
        best = common.written(best.select("query_id", "rank", "vec_id", "score"), "nearest")
        if until >= blocks:
            break
        known = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("known"))
        asked = asked.join(known, "id", "left").select("id", "v", F.greatest("bound", "known").alias("bound"))
        since, until = until, until * (1 + GROWTH)
    full = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    few = common.written(asked.where(F.col("bound") > float("-inf")).join(full, "id", "left_anti"), "queries-of-few")
    if few.isEmpty():
        return best
    every = packed(few.withColumn("bound", F.lit(float("-inf"))), QUERIES, d)
    again = best_of(searched(data, common.written(every, "query-blocks"), d, largest, k), k)
    others = best.join(few.select(F.col("id").alias("query_id")), "query_id", "left_anti")
    return others.unionByName(again.select("query_id", "rank", "vec_id", "score"))
