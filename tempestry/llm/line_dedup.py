"""Operator 10: line deduplication, with DataFrame functions only.

Each line's key is hashed to 128 bits. The lines (hashes, document, position) are written once, without texts, and
range-partitioned by their hashes, each partition sorted by hash, document and position; one pass over it numbers the
documents of each hash and knows its first occurrence. Hashes of HOT lines or more would fill a task; they are found by
a count that tasks begin before anything is shuffled, and theirs are counted and dropped by sums and a join with the
few of them. What a document loses is returned as its keep bitmap: 64-line words, of which only those with a dropped
line are stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.llm import common

#: A row's identity: its doc_id and its text. Rows that agree in both are one document and get the same bitmap.
ROW = ["row_id", "row_text"]
KEY = ["h1", "h2"]
#: Lines of one key that a task may hold; keys of more are broadcast up to so many, and joined beyond.
HOT, BROADCAST_KEYS = 10_000, 100_000


def identified(docs: DataFrame) -> DataFrame:
    """row_id, row_text and text of each row; a null text is empty, a null doc_id a value of its own."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("row_id"), F.xxhash64(text).alias("row_text"), text.alias("text"))


def line_table(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """row_id, row_text, position, h1, h2 of each line whose key has min_chars code points or more.

    The key is the line without ASCII white space at its ends, A-Z in lower case.
    """
    lines = identified(docs).select(*ROW, F.posexplode(F.split("text", "\n")).alias("position", "line"))
    keys = lines.select(*ROW, "position", common.ascii_lower(F.btrim("line", F.lit(common.ASCII_SPACE))).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select(*ROW, "position", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def hits_in_order(lines: DataFrame, min_docs: int, keep_first: bool) -> DataFrame:
    """Lines to be dropped: hashes by range, then one pass in order of hash, document and position."""
    spread = lines.repartitionByRange(common.partitions(lines.sparkSession), *KEY)
    ordered = Window.partitionBy(*KEY).orderBy(*ROW, "position")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.lag(F.struct(*ROW)).over(ordered)
    marked = spread.select("*", (before.isNull() | (before != F.struct(*ROW))).cast("int").alias("fresh"))
    marked = marked.select("*", F.sum("fresh").over(whole).alias("n_docs"), F.row_number().over(ordered).alias("nth"))
    return marked.where((F.col("n_docs") >= min_docs) & (F.col("nth") > int(keep_first))).select(*ROW, "position")


def hits_of_hot(lines: DataFrame, min_docs: int, keep_first: bool) -> DataFrame:
    """Lines to be dropped, by sums: a document counts once however often it has a key."""
    once = lines.groupBy(*KEY, *ROW).agg(F.min("position").alias("position"))
    keys = once.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.min(F.struct(*ROW, "position")).alias("first"))
    keys = common.written(keys.where(F.col("n_docs") >= min_docs), "hot-keys")
    hits = lines.join(bounded(keys), KEY)
    if keep_first:
        hits = hits.where(F.struct(*ROW, "position") != F.col("first"))
    return hits.select(*ROW, "position")


def bounded(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """row_id, row_text, drops for each document that loses a line.

    drops: map from a word's number to its 64 bits; bit i of word w is set where line 64 w + i goes, and words
    without such a line are left out. Lines go if their key is in at least min_docs documents; with keep_first, the
    first of them in order of document and position stays. Repeated rows are one document.
    """
    lines = common.written(line_table(docs, min_chars), "lines")
    counts = lines.groupBy(*KEY).agg(F.count("*").alias("n"))
    hot = common.written(counts.where(F.col("n") >= HOT).select(*KEY), "hot")
    if hot.isEmpty():
        hits = hits_in_order(lines, min_docs, keep_first)
    else:
        hits = hits_in_order(lines.join(bounded(hot), KEY, "left_anti"), min_docs, keep_first)
        hits = hits.unionByName(hits_of_hot(lines.join(bounded(hot), KEY, "left_semi"), min_docs, keep_first))
    words = hits.groupBy(*ROW, F.expr("position div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, position % 64)")).alias("bits"))
    return words.groupBy(*ROW).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drops"))


def marked_rows(docs: DataFrame, min_docs: int, min_chars: int, keep_first: bool) -> DataFrame:
    """row (all columns of docs), kept (its text), n_lines, n_dropped."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("row_id"),
        F.xxhash64(text).alias("row_text"),
    )
    marked = rows.join(keep_bitmaps(docs, min_docs, min_chars, keep_first), ROW, "left")
    lines = F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n")
    word = lambda i: F.coalesce(F.try_element_at("drops", F.floor(i / 64).cast("long")), F.lit(0).cast("long"))
    kept = F.filter(lines, lambda _, i: F.call_function("shiftright", word(i), i % 64).bitwiseAND(F.lit(1)) == 0)
    words = F.coalesce(F.map_values("drops"), F.array().cast("array<bigint>"))
    return marked.select(
        "row",
        F.when(F.col("drops").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n")).alias("kept"),
        F.size(lines).cast("long").alias("n_lines"),
        F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w)).alias("n_dropped"),
    )


def deduplicated(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """docs with the kept lines of each text, joined by \\n; plus n_lines and n_dropped.

    docs: doc_id, text and any others, which pass unchanged (columns named n_lines or n_dropped are replaced). A null
    or empty text is one empty line, whose key is too short to be dropped, and stays null or empty. A text without
    any kept line becomes empty. Repeated rows stay repeated. Texts of any length count whole; an empty table stays.
    """
    marked = marked_rows(docs, min_docs, min_chars, keep_first)
    others = [with_kept(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return marked.select(*others, "n_lines", "n_dropped")


def cleaned(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """As deduplicated(), with docs' own columns alone, whatever their names."""
    return marked_rows(docs, min_docs, min_chars, keep_first).select(*map(with_kept, docs.columns))


def with_kept(column: str) -> Column:
    return F.col("kept").alias("text") if column == "text" else F.col(f"row.`{column}`").alias(column)


def digest(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def oracle_sql(min_docs: int = 10) -> str:
    """The digest in DuckDB's SQL; rows have distinct doc_ids."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    upper = f"'{common.UPPER}', '{common.UPPER.lower()}'"
    return f"""
    WITH lines AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line
                   FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
    keyed AS (SELECT *, translate(trim(line, {space}), {upper}) AS k FROM lines),
    often AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= {min_docs}),
    marked AS (SELECT keyed.*, often.k IS NOT NULL AS gone FROM keyed LEFT JOIN often ON keyed.k = often.k)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id"""
