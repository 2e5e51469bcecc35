"""Operator 2: Jaccard self-join of word n-grams by vertical partitioning, and the groups that its links make.

Texts with equal shingle sets are one node. The global order puts shingles that many documents share last, else
it follows their hashes. Two sets of similarity t or more share a shingle among the first n - ceil(t n) + 1 of each
(the prefix), so lists of nodes by prefix shingle hold every linked pair. The sets are cut into FRAGMENTS ranges of
shingles; a pair's overlap is counted in each fragment by itself and summed over the fragments.

Pairs are never listed within a group of copies. First every node of a list is compared with the list's best
connected node only, if the two meet often; what links is a component. Then the pairs of a list whose ends are still
in different components are compared, all of them, less those that their sizes or the number of prefix shingles they
share rule out (what isn't in both prefixes is at most the rest of one of the sets), or the parities of their
shingles. Links within a component can't change the groups any more, so the groups are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempestry.llm import common

WORDS, FRAGMENTS = 5, 4
#: Shingles broadcast as frequent ones: those counted most often, so many at most (16 bytes each). Any order is right;
#: a shingle that isn't among them keeps its place by hash.
FREQUENT, LEAST_FREQUENT = 400_000, 8
#: Documents that a task turns into rows at a time.
SLICE = 512
#: Shingles counted at a time in a task, and documents of a salted part of a frequent shingle's list.
HELD, PART = 1_000_000, 1000
#: Documents to look up again are broadcast up to so many ids (8 bytes each), and joined by a shuffle beyond.
BROADCAST_IDS = 2_000_000
NO_ID = -(1 << 63)

FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
_random = np.random.default_rng(20)
BYTE = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Shingler:
    """Sets of 64-bit hashes of the shingles of whole texts: polynomial hashes of their bytes from running sums."""

    def __init__(self, words: int = WORDS):
        self.words, self.up, self.down = words, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted and distinct; with fewer words their whole sequence is the only shingle, without any there is none."""
        folded = b" ".join((text or "").encode("utf-8", "ignore").translate(FOLD).split())
        if not folded:
            return np.array([], np.uint64)
        a = np.frombuffer(folded, np.uint8)
        if len(self.up) <= len(a):
            for name, base in (("up", BASE), ("down", UNBASE)):
                powers = np.full(2 * len(a) + 2, base)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(BYTE[a] * self.up[: len(a)], out=sums[1:])
        spaces = np.flatnonzero(a == 32)
        starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(a)]])
        k = min(self.words, len(starts))
        starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
        h = (sums[ends] - sums[starts]) * self.down[starts]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return np.unique(h)


def node_of(shingles: np.ndarray) -> int:
    """The node of a set: a 64-bit hash of it."""
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


PARITIES = ("p0", "p1", "p2", "p3")


def parities(shingles: np.ndarray) -> np.ndarray:
    """256 bits as four integers: whether the set has an odd number of shingles of each of 256 classes. Two sets differ
    in at least as many shingles as their parities differ in bits."""
    odd = (np.bincount((shingles & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    common.short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.column(1)[at : at + SLICE]


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def signatures(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, node, its parities) of each row; and (shingle, df): shingles that tasks met in several nodes,
    with counts that may be too low where a task met one only once."""
    schema = "doc_id long, n_shingles long, node long, p0 long, p1 long, p2 long, p3 long, shingle long, df long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, held, n, seen = Shingler(), [], 0, set()

        def counted() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.array([], np.uint64), np.array([], int))
            found, counts = found[counts > 1].view(np.int64), counts[counts > 1]
            held.clear()
            none = [None] * len(found)
            return _batch(schema, [*[none] * 7, found, counts])

        for batch in batches:
            sizes, nodes, odd = [], [], []
            for text in batch.column(1):
                s = shingle(text.as_py())
                node = node_of(s)
                odd.append(parities(s))
                sizes.append(len(s))
                nodes.append(node)
                if node not in seen:
                    seen.add(node)
                    held.append(s)
                    n += len(s)
                if n > HELD:
                    yield counted()
                    n = 0
                    seen.clear()
            none = [None] * len(nodes)
            words = np.array(odd, dtype=np.int64).reshape(-1, 4)
            yield _batch(schema, [batch.column(0), sizes, nodes, *(words[:, i] for i in range(4)), none, none])
        yield counted()

    table = common.written(_texts(docs).mapInArrow(task, schema), "signatures")
    counts = table.where("shingle is not null").groupBy("shingle").agg(F.sum("df").alias("df"))
    return table.where("node is not null").select("doc_id", "n_shingles", "node", *PARITIES), counts


def frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) and their counts: the most frequent classes of powers of two that fit into FREQUENT."""
    counts = common.written(counts.where(F.col("df") >= LEAST_FREQUENT).withColumn("class", F.floor(F.log2("df")).cast("int")), "frequent")
    least, total = 64, 0
    for row in sorted(counts.groupBy("class").count().collect(), key=lambda r: -r["class"]):  # 64 rows at most
        total += row["count"]
        if total > FREQUENT:
            break
        least = row["class"]
    table = counts.where(F.col("class") >= least).select("shingle", "df").toArrow()
    shingles, df = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()
    order = np.argsort(shingles)
    return shingles[order], df[order]


def in_order(shingles: np.ndarray, often: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorted set in the global order, and the counts of its frequent shingles (0 for others)."""
    if not len(often):
        return shingles, np.zeros(len(shingles), np.int64)
    at = np.searchsorted(often, shingles).clip(0, len(often) - 1)
    counts = np.where(often[at] == shingles, df[at], 0)
    order = np.argsort(counts, kind="stable")
    return shingles[order], counts[order]


def prefixes(docs: DataFrame, often: np.ndarray, df: np.ndarray, threshold: Fraction) -> DataFrame:
    """shingle, node, n, at (its place in the node's order), salt, parts: a row for each prefix shingle, once a task for
    copies. A frequent shingle's list is dealt over parts by salt."""
    schema = "shingle long, node long, n long, at long, salt long, parts long"
    known = docs.sparkSession.sparkContext.broadcast((often, df))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen, (often, df) = Shingler(), set(), known.value
        for texts in _slices(batches):
            rows: list[list[np.ndarray]] = [[] for _ in range(6)]
            for text in texts:
                s = shingle(text.as_py())
                node, n = node_of(s), len(s)
                if not n or node in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(node)
                first = n - int(-(-threshold * n // 1)) + 1
                s, counts = in_order(s, often, df)
                parts = counts[:first] // PART + 1
                for column, x in zip(rows, (s[:first].view(np.int64), np.full(first, node), np.full(first, n), np.arange(first), node % parts, parts), strict=True):
                    column.append(x)
            yield _batch(schema, [np.concatenate(c) if c else [] for c in rows])

    return _texts(docs).mapInArrow(task, schema)


def fragments(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, fragment, shingles (binary) of the documents whose doc_id is in wanted (doc_id)."""
    schema = "node long, fragment long, shingles binary"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        edges = (np.arange(1, FRAGMENTS, dtype=np.float64) / FRAGMENTS * 2.0**64).astype(np.uint64)
        for texts in _slices(batches):
            rows: list[list] = [[], [], []]
            for text in texts:
                s = shingle(text.as_py())
                cuts = [0, *np.searchsorted(s, edges).tolist(), len(s)]
                rows[0] += [node_of(s)] * FRAGMENTS
                rows[1] += range(FRAGMENTS)
                rows[2] += [s[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            yield _batch(schema, rows)

    texts = _texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    return texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "doc_id", "left_semi").mapInArrow(task, schema).dropDuplicates(["node", "fragment"])


def links(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """a, b of the pairs (a, b, na, nb) of similarity >= threshold: overlaps counted by fragment, then summed."""
    schema = "a long, b long, na long, nb long, overlap long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                found.append(int((y[np.searchsorted(y, x).clip(0, len(y) - 1)] == x).sum()) if len(x) else 0)
            yield _batch(schema, [*(batch.column(i) for i in range(4)), found])

    left = sets.select(F.col("node").alias("a"), "fragment", F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), "fragment", F.col("shingles").alias("y"))
    met = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", "x", "y").mapInArrow(task, schema)
    summed = met.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("o"))
    p, q = threshold.numerator, threshold.denominator
    return summed.where(q * F.col("o") >= p * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all ends of edges (a, b): smallest label of the neighbours, then the
    label's own label, until nothing changes."""
    both = common.written(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = common.written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "m").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("above"))
        step = common.written(step.join(jump, "new").select("node", F.col("component").alias("old"), F.least("new", "above").alias("component")), "labels")
        labels = step.select("node", "component")
        if step.where("old != component").isEmpty():
            return labels


def grouped(docs: DataFrame, threshold: float | str = "0.75") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text; others are ignored).

    A text's words are what stands between ASCII white space, A-Z in lower case; its set the distinct runs of five of
    them, or all of them if there are fewer. Texts of equal sets are linked, and texts whose intersection is at least
    threshold times their union; component_id is the smallest doc_id that links lead to. A row without words (null or
    empty text) is its own component. A null doc_id is in its group, but never names one unless all are null. Repeated
    rows get the same result. Long texts count whole; an empty table gives no rows.
    """
    t = Fraction(threshold)
    p, q = t.numerator, t.denominator
    rows, counts = signatures(docs)
    alike = lambda na, nb: (q * F.col(na) >= p * F.col(nb)) & (q * F.col(nb) >= p * F.col(na))
    after = lambda n: F.ceil(F.lit(p) * F.col(n) / F.lit(q)) - 1  # noqa: E731  shingles after the prefix
    # shingles that linked sets of these sizes have in both prefixes: of their overlap, what the rest can't hold
    overlap = lambda na, nb: F.ceil(F.lit(p) * (F.col(na) + F.col(nb)) / F.lit(p + q))  # noqa: E731  least of linked sets
    in_prefixes = lambda na, nb: overlap(na, nb) - F.greatest(after(na), after(nb))
    as_pair = lambda df, x, nx, y, ny: df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.when(F.col(x) < F.col(y), F.col(nx)).otherwise(F.col(ny)).alias("na"), F.when(F.col(x) < F.col(y), F.col(ny)).otherwise(F.col(nx)).alias("nb")).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("met"))

    lists = Window.partitionBy("shingle", "salt")
    prefix = prefixes(docs, *frequent(counts), t).select("*", F.min("node").over(lists).alias("low"), F.max("node").over(lists).alias("high"), F.count("*").over(lists).alias("among"))
    shared = common.written(prefix.where((F.col("low") != F.col("high")) | (F.col("parts") > 1)).groupBy("shingle", "node", "n", "at").agg(F.max("among").alias("among")), "lists")
    weight = shared.groupBy("node").agg(F.sum("among").alias("weight"))
    heads = shared.join(weight, "node").groupBy("shingle").agg(F.max(F.struct("weight", "node", "n")).alias("head"))
    stars = shared.join(heads, "shingle").select("node", "n", F.col("head.node").alias("head"), F.col("head.n").alias("head_n")).where((F.col("node") != F.col("head")) & alike("n", "head_n"))
    stars = common.written(as_pair(stars, "node", "n", "head", "head_n").where(2 * F.col("met") >= in_prefixes("na", "nb")), "stars")

    named = common.written(rows.where("n_shingles > 0").groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("doc_id"), *(F.min(x).alias(x) for x in PARITIES)), "nodes")
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = common.written(fragments(docs, named.join(ends(stars), "node", "left_semi").select("doc_id")), "fragments")
    first = common.written(links(stars, sets, t), "links")
    labels = components(first)

    placed = shared.join(labels, "node", "left").select("shingle", "node", "n", "at", F.coalesce("component", "node").alias("component"))
    apart = placed.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("shingle")
    open_lists = common.written(placed.join(apart, "shingle"), "open-lists")
    # Linked nodes meet in m = in_prefixes lists or more whose shingle is so early in both sets that an overlap is left
    # for it. In one order of the lists, longest first, the m-th of those is the m-th or a later list of either node:
    # only there are pairs made.
    order = Window.partitionBy("node").orderBy(F.desc("size"), "shingle")
    ranked = open_lists.join(open_lists.groupBy("shingle").agg(F.count("*").alias("size")), "shingle").withColumn("k", F.row_number().over(order))
    ranked = ranked.join(named.select("node", *PARITIES), "node")
    x, y = (ranked.select("shingle", *(F.col(c).alias(f"{c}_{v}") for c in ("node", "n", "at", "component", "k", *PARITIES))) for v in "xy")
    m = in_prefixes("n_x", "n_y")
    early = F.greatest(F.col("at_x") - F.col("n_x"), F.col("at_y") - F.col("n_y")) < m - overlap("n_x", "n_y")
    late = F.least("k_x", "k_y") >= m
    differ = sum((F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y"))) for c in PARITIES), F.lit(0))
    close = differ <= F.col("n_x") + F.col("n_y") - 2 * overlap("n_x", "n_y")
    rest = x.join(y, "shingle").where((F.col("node_x") < F.col("node_y")) & (F.col("component_x") != F.col("component_y")) & alike("n_x", "n_y") & early & late & close)
    rest = common.written(as_pair(rest, "node_x", "n_x", "node_y", "n_y").join(stars.select("a", "b"), ["a", "b"], "left_anti"), "rest")
    new = ends(rest).join(sets.select("node"), "node", "left_anti")
    more = common.written(fragments(docs, named.join(new, "node", "left_semi").select("doc_id")), "fragments")
    labels = components(first.union(links(rest, sets.union(more), t)))

    members = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(labels, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    names = members.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = members.join(names, "component").select("node", "component_id")
    return rows.join(named, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs without those whose component_id is another document; all columns stay. Rows of a doc_id stay together; rows
    with a null doc_id stay."""
    gone = groups.where("doc_id != component_id").select(F.col("doc_id").alias("key")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("key"))
    return rows.join(gone, "key", "left_anti").select("row.*")
