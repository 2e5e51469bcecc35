"""Operator 8: benchmark decontamination by SimHash of item-sized windows, with DataFrame functions only.

1. A window can only be similar to an item if they share a shingle, so documents' shingles first meet the items'
   shingles. A hit says where the item would start, which gives a window of the item's length; it holds every shingle
   that the document shares with the item at this alignment, so no other window of that length shares more.
2. Windows and items get 64-bit SimHash fingerprints of their words, each word weighted by its count. Fingerprints
   are cut into RADIUS + 1 blocks: two within RADIUS bits agree in one block at least, so joining on (length, block,
   bits of the block) finds all of them.
3. Of the pairs within the radius, the exact weighted similarity of their shingles decides: shared over united
   counts.
Which steps are broadcast is left to Spark, but for the items' shingles, which are broadcast up to BROADCAST_ROWS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempestry.llm import common
from tempestry.llm.line_dedup import ROW, identified

WORDS = 5
#: Two word sequences whose shingles are similar by 0.75 or more differ by 11 bits on average where an end was changed
#: and by 5 where a word within was; 20 is three standard deviations above the former.
RADIUS = 20
#: Rows of 8 bytes; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Lower-case words between ASCII white space, as 64-bit hashes."""
    split = F.split(F.btrim(F.lower(text), F.lit(common.ASCII_SPACE)), r"[\x20\x09-\x0D]+")
    return F.transform(F.filter(split, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(hashes: Column) -> Column:
    """Hashes of each WORDS consecutive words; none if there are fewer words. hashes: a column that is there already."""
    last = F.size(hashes) - WORDS
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WORDS))))


def fingerprint(hashes: Column) -> Column:
    """SimHash: bit b is set where more words have it than not; repeated words count each time."""
    bit = lambda b: F.aggregate(hashes, F.lit(0), lambda n, h: n + (F.call_function("shiftright", h, b).bitwiseAND(F.lit(1)).cast("int") * 2 - 1)) > 0
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda bits, b: bits.bitwiseOR(F.when(bit(b), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(0)))


def blocks(bits: Column) -> Column:
    """The RADIUS + 1 blocks of a fingerprint: number and bits."""
    edges = [k * 64 // (RADIUS + 1) for k in range(RADIUS + 2)]
    return F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(bits, lo).bitwiseAND((1 << (hi - lo)) - 1).alias("bits")) for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays of shingles: sum of the smaller counts over sum of the larger."""
    count = lambda x, h: F.size(F.filter(x, lambda y: y == h))
    plain = F.size(F.array_intersect(a, b))
    counted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, h: n + F.least(count(a, h), count(b, h)))
    shared = F.when((F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b)), plain).otherwise(counted)
    return F.when(a == b, F.lit(1.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.75) -> DataFrame:
    """row_id, row_text, item_id, similarity, start for each document and item with a window of similarity >= threshold.

    docs: doc_id, text; items: item_id, text; others are ignored. start is the window's first word (0-based) of the
    most similar one, the earliest of equals. Texts are whole; null texts are empty. Items of fewer than five words
    have no shingle and match nothing, and so do such documents. Windows end with the document: an item that is cut
    off there is compared with what is left. Repeated items are found under each of their ids, rows that repeat a
    document once.
    """
    bench = items.select(F.col("item_id").alias("item_id"), words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("item_words"))
    bench = bench.where(F.size("item_words") >= WORDS).withColumn("item_shingles", shingles(F.col("item_words")))
    bench = common.written(bench.withColumn("length", F.size("item_words")).withColumn("item_bits", fingerprint(F.col("item_words"))), "bench")
    starts = bench.select(F.posexplode("item_shingles").alias("item_at", "h"), "length").distinct()
    known = starts.select("h").distinct()
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known

    texts = identified(docs)
    # the words are a column of their own: as part of a lambda they would be made anew for each shingle
    found = texts.select(*ROW, words(F.col("text")).alias("w")).select(*ROW, F.posexplode(shingles(F.col("w"))).alias("at", "h")).join(known, "h", "left_semi")
    hits = found.join(starts, "h").select(*ROW, F.greatest(F.col("at") - F.col("item_at"), F.lit(0)).alias("start"), "length")
    wanted = common.written(hits.groupBy(*ROW).agg(F.collect_set(F.struct("start", "length")).alias("windows")), "windows")
    windows = texts.join(wanted, ROW).dropDuplicates(ROW).select(*ROW, words(F.col("text")).alias("w"), "windows").select(*ROW, "w", F.explode("windows").alias("x"))
    windows = windows.select(*ROW, F.col("x.start").alias("start"), F.col("x.length").alias("length"), F.slice("w", F.col("x.start") + 1, F.col("x.length")).alias("window_words"))
    windows = windows.withColumn("window_bits", fingerprint(F.col("window_words"))).withColumn("window_shingles", shingles(F.col("window_words"))).drop("window_words")

    side = lambda df, bits: df.select("*", F.explode(blocks(F.col(bits))).alias("b")).select("*", "b.*").drop("b")
    pairs = side(windows, "window_bits").join(side(bench.drop("item_words"), "item_bits"), ["length", "block", "bits"])
    apart = F.col("window_bits").bitwiseXOR(F.col("item_bits"))
    earlier = F.exists(blocks(apart), lambda b: (b["bits"] == 0) & (b["block"] < F.col("block")))  # each pair once: at its first equal block
    near = pairs.where((F.bit_count(apart) <= RADIUS) & ~earlier)
    scored = near.select(*ROW, "item_id", "start", similarity(F.col("window_shingles"), F.col("item_shingles")).alias("similarity")).where(F.col("similarity") >= threshold)
    best = scored.groupBy(*ROW, "item_id").agg(F.max_by(F.struct("similarity", "start"), F.struct("similarity", -F.col("start"))).alias("best"))
    return best.select(*ROW, "item_id", "best.similarity", "best.start")


def report(found: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start."""
    return found.select(F.when(F.col("row_id") != -(1 << 63), F.col("row_id")).alias("doc_id"), "item_id", F.round("similarity", 6).alias("similarity"), "start")


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.75) -> DataFrame:
    """docs without those that hold a window of an item; all columns and repeated rows stay."""
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("row_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row_text")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *key)
    return rows.join(leaks(docs, items, threshold).select(*ROW).distinct(), ROW, "left_anti").select("row.*")
