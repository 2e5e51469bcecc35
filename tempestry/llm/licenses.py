"""Operator 12: license scans, by an exact set-similarity join of text blocks with license templates.

1. The templates' words are counted over the whole corpus and ranked, the rarest first: the global order. Other words
   can be in no intersection, so texts are reduced to these.
2. A text is cut into blocks of BLOCK words and as many more as the longest template but one, so that each run of words
   of a template's length lies in a block whole. Blocks without a word of any template's prefix go no further.
3. A block and a template that share `need` words share one among the template's first size - need + 1 words of the
   order (prefix filter), at most size - need words into either (length filter), with enough words left after it on both
   sides (positional filter). Pairs that pass, each at its first shared word, are joined on that word.
4. The exact intersection decides. A template that is a phrase asks for all its words, and then for the places in the
   block where they stand consecutively.
Templates are a list of the caller's; what is broadcast or collected grows with it, not with the corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempestry.llm import common

#: Words whose places a block owns.
BLOCK = 32
#: Bytes of a text whose words are held at once.
CHUNK = 1 << 20
#: The words of the contract in UTF-8, once A-Z are in lower case: all but ASCII characters that aren't letters or digits.
WORD, BREAK = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")


class Template(NamedTuple):
    label: str
    text: str
    phrase: bool = False

    def words(self) -> list[str]:
        return [w.decode() for w in WORD.findall(self.text.encode().lower())]


# The phrases and labels of the contract, then statements of public licenses.
PHRASES = [
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
]
STATEMENTS = [
    Template("agpl", "GNU Affero General Public License"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    Template("cc0", "CC0 1.0 Universal Public Domain Dedication"),
    Template("epl-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    Template("gpl-2.0", "GNU General Public License version 2"),
    Template("gpl-3.0", "GNU General Public License version 3"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("lgpl", "GNU Lesser General Public License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("mit", "Released under the MIT License"),
    Template("mit", "Licensed under the MIT License"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
]
TEMPLATES = PHRASES + STATEMENTS


def need(template: Template, threshold: float) -> int:
    """Distinct words that a block must share: all of a phrase, the threshold's share of another template."""
    size = len(set(template.words()))
    return size if template.phrase else math.ceil(round(threshold * size, 9))


def overlap(templates: Sequence[Template]) -> int:
    """Words that a block shares with the next: the longest template's but one."""
    return max(len(t.words()) for t in templates) - 1


def word_ids(data: bytes, ids: dict[bytes, int]) -> Iterator[list[int | None]]:
    """The ids of the words of a text in lower case, None for others, for about CHUNK bytes at a time."""
    at = 0
    while at < len(data):
        cut = BREAK.search(data, at + CHUNK)
        end = cut.start() if cut else len(data)
        yield list(map(ids.get, WORD.findall(data, at, end)))
        at = end


def word_counts(docs: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """How often each word of the vocabulary stands in the corpus; tasks count before anything is shuffled."""
    ids = {w.encode(): i for i, w in enumerate(vocabulary)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for text in batch.column(0):
                for found in word_ids((text.as_py() or b"").lower(), ids):
                    counts.update(found)
        counts.pop(None, None)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    common.short_batches(docs.sparkSession)
    counted = docs.select(F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(task, "word int, n long")
    return dict.fromkeys(vocabulary, 0) | {vocabulary[r.word]: r.n for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def blocks_of(at: np.ndarray, rank: np.ndarray, wanted: np.ndarray, shared: int) -> list[dict]:
    """The blocks that hold a wanted word: first word owned, places and ranks of the vocabulary's words in them."""
    spots = at[wanted[rank]]
    back = (shared + BLOCK - 1) // BLOCK  # blocks before the owner that reach a spot too
    near = np.unique(np.concatenate([(own := spots // BLOCK), *(own[spots - (own - k) * BLOCK < BLOCK + shared] - k for k in range(1, back + 1))]))
    out = []
    for k in near[near >= 0].tolist():
        lo, hi = np.searchsorted(at, [k * BLOCK, (k + 1) * BLOCK + shared])
        out.append({"start": k * BLOCK, "at": at[lo:hi], "word": rank[lo:hi]})
    return out


def block_table(docs: DataFrame, ranks: dict[str, int], prefix: set[int], shared: int) -> DataFrame:
    """row, doc_id, n_words and the blocks with a word of a prefix, for each row of docs; a written table."""
    ids, wanted = {w.encode(): r for w, r in ranks.items()}, np.isin(np.arange(len(ranks)), list(prefix))
    block = pa.struct([("start", pa.int64()), ("at", pa.list_(pa.int64())), ("word", pa.list_(pa.int32()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for text in batch.column(1):
                n, at, rank = 0, [], []
                for words in word_ids((text.as_py() or b"").lower(), ids):
                    known = [(n + i, w) for i, w in enumerate(words) if w is not None]
                    if known:
                        places, of = zip(*known, strict=True)
                        at.append(np.array(places, np.int64))
                        rank.append(np.array(of, np.int32))
                    n += len(words)
                sizes.append(n)
                found.append(blocks_of(np.concatenate(at), np.concatenate(rank), wanted, shared) if at else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(block))], ["doc_id", "n_words", "blocks"])

    common.short_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = texts.mapInArrow(task, "doc_id long, n_words long, blocks array<struct<start:long,at:array<long>,word:array<int>>>")
    return common.written(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "license-blocks")


def prefix_index(templates: Sequence[Template], ranks: dict[str, int], threshold: float) -> list[tuple]:
    """token, place, of, label, phrase, words, tokens, need: a row for each word of each template's prefix."""
    out = []
    for number, t in enumerate(templates):
        words = [ranks[w] for w in t.words()]
        tokens = sorted(set(words))
        least = need(t, threshold)
        out += [(token, place, number, t.label, t.phrase, words, tokens, least) for place, token in enumerate(tokens[: len(tokens) - least + 1])]
    return out


def matches(rows: DataFrame, index: list[tuple]) -> DataFrame:
    """row, doc_id, label, phrase, score, start, places for each block and template that it meets.

    score is the share of the template's words that are in the block; start the first word that the block owns; places
    the words at which a phrase begins in the block's own part, null for other templates.
    """
    fields = "token int, place int, of int, label string, phrase boolean, words array<int>, tokens array<int>, need int"
    index = F.broadcast(rows.sparkSession.createDataFrame(index, fields))
    blocks = rows.select("row", "doc_id", F.explode("blocks").alias("b")).select("row", "doc_id", "b.start", "b.at", "b.word", F.array_sort(F.array_distinct("b.word")).alias("held"))
    pairs = blocks.select("*", F.posexplode("held").alias("j", "token")).join(index, "token")
    after = F.least(F.size("tokens") - F.col("place"), F.size("held") - F.col("j"))  # this word and what may follow on both sides
    pairs = pairs.where((F.size("held") >= F.col("need")) & (F.col("j") <= F.size("held") - F.col("need")) & (after >= F.col("need")))
    met = pairs.withColumn("both", F.array_intersect("held", "tokens")).where((F.size("both") >= F.col("need")) & (F.get("both", F.lit(0)) == F.col("token")))
    n = F.size("words")
    own = F.filter(F.sequence(F.lit(0), F.size("at") - 1), lambda i: (F.get("at", i) < F.col("start") + BLOCK) & (F.slice("word", i + 1, n) == F.col("words")) & (F.get("at", i + n - 1) == F.get("at", i) + n - 1))
    places = F.when(F.col("phrase"), F.transform(own, lambda i: F.get("at", i)))
    found = met.select("row", "doc_id", "label", "phrase", (F.size("both") / F.size("tokens")).alias("score"), "start", places.alias("places"))
    return found.where(~F.col("phrase") | (F.size("places") > 0))


def scan(docs: DataFrame, templates: Sequence[Template] = tuple(TEMPLATES), threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """The rows of docs (row, doc_id, n_words) and the matches in them, as matches() returns them.

    docs: doc_id, text and any others, which are ignored. A null text is empty and has no words; every row counts for
    itself, repeated ones and those without a doc_id too. Texts count whole, however long. Words of equal frequency go
    by their letters, so the order is the same each time; it decides the work, not the result. A template must have a
    word. A block meets a template if it holds `threshold` of its distinct words, in any order.
    """
    if not all(t.words() for t in templates):
        raise ValueError("a template has no word")
    vocabulary = sorted({w for t in templates for w in t.words()})
    counts = word_counts(docs, vocabulary)
    ranks = {w: r for r, w in enumerate(sorted(vocabulary, key=lambda w: (counts[w], w)))}
    index = prefix_index(templates, ranks, threshold)
    rows = block_table(docs, ranks, {t[0] for t in index}, overlap(templates))
    return rows, matches(rows.where(F.size("blocks") > 0), index)


def digest(rows: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row."""
    named = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    each = found.groupBy("row").agg(
        F.sum(F.when(F.col("phrase"), F.size("places"))).alias("n_base"), F.min(F.array_min("places")).alias("first_word"), F.max(F.array_max("places")).alias("last_word"),
        named(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"), named(F.col("label")).alias("labels"), F.max("score").alias("score"),
    )
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    every = rows.select("row", "doc_id", "n_words").join(each, "row", "left")
    return every.select("doc_id", "n_words", *(F.coalesce(c, none[c]).alias(c) if c in none else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")))


def oracle_sql(templates: Sequence[Template] = tuple(TEMPLATES), threshold: float = 0.9) -> str:
    """The digest in DuckDB's SQL, from all words and templates without filters; rows have distinct doc_ids."""
    values = ", ".join(f"({k}, '{t.label}', {t.phrase}, {len(set(t.words()))}, {need(t, threshold)}, {t.words()!r})" for k, t in enumerate(templates))
    shared = overlap(templates)
    back = (shared + BLOCK - 1) // BLOCK
    return rf"""
    WITH texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    t(id, label, phrase, size, need, words) AS (VALUES {values}),
    tw AS (SELECT DISTINCT id, unnest(words) AS word FROM t),
    spots AS (SELECT * FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM texts) WHERE word IN (SELECT word FROM tw)),
    held AS (SELECT DISTINCT doc_id, word, i // {BLOCK} - k AS block FROM spots, range(0, {back + 1}) b(k) WHERE i // {BLOCK} >= k AND i - (i // {BLOCK} - k) * {BLOCK} < {BLOCK + shared}),
    met AS (SELECT doc_id, block, id, count(*) AS n FROM held JOIN tw USING (word) GROUP BY ALL),
    stated AS (SELECT doc_id, label, n / size AS score FROM met JOIN t USING (id) WHERE NOT phrase AND n >= need),
    places AS (SELECT s.doc_id, t.label, s.i FROM spots s JOIN texts USING (doc_id) JOIN t ON t.words[1] = s.word AND w[s.i + 1:s.i + len(t.words)] = t.words WHERE phrase),
    base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY 1),
    every AS (SELECT doc_id, label, score FROM stated UNION ALL SELECT doc_id, label, 1.0 FROM places),
    named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM every GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
      coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
    FROM texts LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id)"""
