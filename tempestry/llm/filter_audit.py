"""Operator 13: audit of how filters interact, by the subset-zeta transform of mask counts.

1. Each document gets a mask, one bit a filter that it fails. Copies are known by the hash of their text: of a text's
   rows, those of the smallest doc_id pass the copy filter. That is counted on rows that are summed per text, so a text
   that a third of all rows hold is a few rows in its task.
2. Documents are counted per part and mask: at most 32 rows a part.
3. The transform sums each mask's counts over its subsets, a pass a filter. Who survives a set of filters is the sum of
   the masks outside it, so every order's step is the difference of two neighbouring sets.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.llm import common

WORD_BREAK = r"[\x20\x09-\x0D]+"
COPY = "E"
MEASURES = ("n", "good", "toxic")


def text_failures(words: Column, text: Column) -> dict[str, Column]:
    """The failure conditions that need a document's text alone, by letter. words: the text's words as an array."""
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
        "C": upper.cast("long") * 100 > F.char_length(text).cast("long") * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def bit(letter: str, letters: Sequence[str]) -> int:
    return 1 << letters.index(letter)


def masked(docs: DataFrame, part: str = "source") -> DataFrame:
    """part, doc_id, digest, mask of each row: the failures of its text, without the copy filter.

    A null text is empty, a null part the empty string. Texts count whole; other columns are ignored.
    """
    texts = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = texts.withColumn("words", F.array_remove(F.split("text", WORD_BREAK), ""))
    failures = text_failures(F.col("words"), F.col("text"))
    letters = [*failures, COPY]
    mask = sum((F.when(fails, bit(x, letters)).otherwise(0) for x, fails in failures.items()), F.lit(0))
    return split.select("part", "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows, equal ones counted in n, with good and toxic: whether any label of the doc_id says so.

    Documents without a label, or without a doc_id, are neither. Rows without a doc_id keep apart in the join.
    """
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    counted = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    keyed = counted.withColumn("key", F.coalesce("doc_id", F.xxhash64("digest"))).withColumn("named", F.col("doc_id").isNotNull())
    found = keyed.join(known.withColumn("named", F.lit(True)), ["key", "named"], "left").drop("key", "named")
    return found.withColumn("good", F.coalesce("good", F.lit(False))).withColumn("toxic", F.coalesce("toxic", F.lit(False)))


def mask_counts(rows: DataFrame, copy_bit: int) -> DataFrame:
    """part, mask, n, good, toxic from labelled rows; rows of a text with a larger doc_id than its smallest fail as copies.

    A row without a doc_id is neither a copy nor makes another one. Repeated rows of the smallest doc_id all pass.
    """
    group = ["digest", "part", "mask", "good", "toxic"]
    named = F.col("doc_id").isNotNull()
    texts = rows.groupBy(*group).agg(F.sum("n").alias("n"), F.sum(F.when(named, 0).otherwise(F.col("n"))).alias("n_unnamed"), F.min(F.when(named, F.struct("doc_id", "n"))).alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    passing = F.col("n_unnamed") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    split = texts.select("part", "mask", "good", "toxic", "n", passing.alias("passing"))
    both = F.explode(F.array(F.struct(F.col("mask"), F.col("passing").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(copy_bit)).alias("mask"), (F.col("n") - F.col("passing")).alias("n"))))
    counts = split.select("part", "good", "toxic", both.alias("x"))
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("x.n")).otherwise(0))
    return counts.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))


def survivors(counts: DataFrame, n_filters: int) -> DataFrame:
    """part and, for each of MEASURES, an array over sets of filters: what passes all filters of the set.

    The subset-zeta transform: after the pass of bit b, entry i has the sum over all masks that agree with i but for
    bits up to b that i holds. Entry ~S is then the sum of the masks without any filter of S.
    """
    sets = F.sequence(F.lit(0), F.lit((1 << n_filters) - 1))
    placed = lambda m: F.transform(sets, lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0).cast("long")))
    passed = lambda m, b: F.transform(m, lambda x, i: x + F.when(i.bitwiseAND(F.lit(b)) != 0, F.get(m, i.bitwiseXOR(F.lit(b)))).otherwise(0))
    wide = counts.groupBy("part").agg(*(F.map_from_entries(F.collect_list(F.struct("mask", m))).alias(m) for m in MEASURES))
    sums = wide.select("part", *(placed(F.col(m)).alias(m) for m in MEASURES))
    for k in range(n_filters):
        sums = sums.select("part", *(passed(F.col(m), 1 << k).alias(m) for m in MEASURES))
    return sums.select("part", *(F.reverse(m).alias(m) for m in MEASURES))  # entry S of the reversed array is entry ~S


def shapley(alive: Column, own: int, n_filters: int) -> Column:
    """What the filter removes, summed over all orders: each set before it counts for the orders that begin with it."""
    rest = [s for s in range(1 << n_filters) if not s & own]
    weight = lambda s: factorial(s.bit_count()) * factorial(n_filters - 1 - s.bit_count())
    return sum((F.lit(weight(s)).cast("long") * (alive[s] - alive[s | own]) for s in rest), F.lit(0).cast("long"))


def audit(counts: DataFrame, letters: Sequence[str]) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each
    part, order of the filters and step of it. counts: part, mask, n, good, toxic; bit i of a mask is letters[i].

    A part is there if it has a document. An empty table gives no row. Orders grow as the factorial of the letters, the
    arrays as 2 to their power: a handful of filters is meant.
    """
    every = (1 << len(letters)) - 1
    alive = survivors(counts, len(letters))
    n = F.col("n")
    own = F.array(*(F.struct(
        (n[0] - n[bit(x, letters)]).alias("failing"), (n[every ^ bit(x, letters)] - n[every]).alias("unique_fails"), shapley(n, bit(x, letters), len(letters)).alias("shapley"),
    ) for x in letters))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(letters)))
    steps = alive.withColumn("own", own).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    place = lambda x: F.instr(F.col("filter_order"), x)
    upto = lambda last: sum((F.when(place(x) <= last, bit(x, letters)).otherwise(0) for x in letters), F.lit(0))
    steps = steps.withColumn("before", upto(F.col("step") - 1)).withColumn("after", upto(F.col("step")))
    steps = steps.withColumn("own", F.get("own", F.instr(F.lit("".join(letters)), F.substring("filter_order", F.col("step"), F.lit(1))) - 1))
    lost = lambda m: F.get(m, F.col("before")) - F.get(m, F.col("after"))
    return steps.select(
        "part", "filter_order", "step", F.get("n", F.col("after")).alias("kept"), lost("n").alias("removed"), (F.col("own.failing") - lost("n")).alias("redundant"),
        F.col("own.unique_fails").alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.col("own.shapley").alias("shapley"),
    )


LETTERS = ("A", "B", "C", "D", COPY)


def audited(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The audit of the five filters over docs (doc_id, text, part) and labels (doc_id, quality, toxic)."""
    counts = mask_counts(labelled(masked(docs, part), labels), bit(COPY, LETTERS))
    return audit(common.written(counts, "mask-counts"), LETTERS)


def oracle_sql() -> str:
    """The audit in DuckDB's SQL, by applying each order's steps to the documents' failures, without the transform."""
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(LETTERS))
    place = lambda x: f"instr(filter_order, '{x}')"
    earlier = " OR ".join(f"(f{x} AND {place(x)} < step)" for x in LETTERS)
    own = "CASE substr(filter_order, step, 1) " + " ".join(f"WHEN '{x}' THEN f{x}" for x in LETTERS) + " END"
    count = " + ".join(f"f{x}::INT" for x in LETTERS)
    return rf"""
    WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
    words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
    lab AS (SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS toxic FROM labels GROUP BY doc_id),
    fails AS (SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, len(w) < 50 AS fA, 100 * len(list_distinct(w)) < 65 * len(w) AS fB,
        100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS fC, regexp_matches(t, '[#$%&*|]') AS fD,
        coalesce(words.doc_id > min(words.doc_id) OVER (PARTITION BY t), FALSE) AS fE
      FROM words LEFT JOIN lab ON words.doc_id = lab.doc_id),
    kinds AS (SELECT part, fA, fB, fC, fD, fE, {count} AS n_fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY ALL),
    steps AS (SELECT filter_order, step FROM (VALUES {orders}) o(filter_order), range(1, 6) s(step)),
    each AS (SELECT part, filter_order, step::INT AS step, n, good, toxic, n_fails, {earlier} AS gone, {own} AS own FROM kinds, steps),
    done AS (SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT gone AND NOT own), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND own), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (gone AND own), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (own AND n_fails = 1), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (NOT gone AND own), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND own), 0)::BIGINT AS toxic_lost
      FROM each GROUP BY ALL)
    SELECT *, sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1))::BIGINT AS shapley FROM done"""
