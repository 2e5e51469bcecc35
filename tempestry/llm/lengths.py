"""Operator 9: exact histogram of encoded lengths, whose suffix sums answer every context limit."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempestry.llm import common
from tempestry.llm.tokens import encoder

#: Lengths of one run; suffix sums go over the runs first, then within each, so no task sees all lengths.
RUN = 4096


def length_counts(docs: DataFrame, tokenizer: str, end_ids: int = 1) -> DataFrame:
    """length, n_docs. A document's length counts its ids and end_ids; a null or empty text has end_ids alone.

    docs needs a text column; others are ignored. Every row is a document. Tasks count before anything is shuffled.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, counts = encoder(tokenizer), Counter()
        for batch in batches:
            for lengths, _ in encode.encode(batch.column(0), ids=False):
                counts.update((lengths + end_ids).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["length", "n"])

    common.short_batches(docs.sparkSession)
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(task, "length long, n long")
    return counted.groupBy("length").agg(F.sum("n").alias("n_docs"))


def length_table(counts: DataFrame) -> DataFrame:
    """A row for each length L that occurs; an empty table gives none.

    n_docs have it; docs_at_least and tokens_at_least are longer or as long; docs_below and tokens_below are shorter;
    truncated_total is the sum of min(length, L); quantile is the share of documents of length L or less.
    For a limit X that doesn't occur, take the row of the next longer L: the truncated total is its tokens_below plus
    X times its docs_at_least; past the longest it is all tokens. A quantile q is the first row with quantile >= q.
    """
    lengths = counts.withColumn("run", F.expr(f"length div {RUN}")).withColumn("tokens", F.col("length") * F.col("n_docs"))
    runs = lengths.groupBy("run").agg(F.sum("n_docs").alias("run_docs"), F.sum("tokens").alias("run_tokens"))
    up = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    runs = runs.select("run", *(F.coalesce(F.sum(c).over(up), F.lit(0)).alias(f"{c}_before") for c in ("run_docs", "run_tokens")), F.sum("run_docs").over(every).alias("all_docs"), F.sum("run_tokens").over(every).alias("all_tokens"))
    within = Window.partitionBy("run").orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    rows = lengths.join(runs, "run")
    below = [F.col(f"run_{c}_before") + F.coalesce(F.sum(x).over(within), F.lit(0)) for c, x in (("docs", "n_docs"), ("tokens", "tokens"))]
    rows = rows.withColumn("docs_below", below[0]).withColumn("tokens_below", below[1])
    at_least = F.col("all_docs") - F.col("docs_below")
    return rows.select(
        "length", "n_docs", "docs_below", "tokens_below", at_least.alias("docs_at_least"), (F.col("all_tokens") - F.col("tokens_below")).alias("tokens_at_least"),
        (F.col("tokens_below") + F.col("length") * at_least).alias("truncated_total"), ((F.col("docs_below") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def totals_for(table: DataFrame, limits: list[int]) -> DataFrame:
    """limit, n_longer, truncated_total for each limit, from length_table(): a driver's short list, one pass."""
    rows = table.crossJoin(F.broadcast(table.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")))
    return rows.groupBy("limit").agg(F.sum(F.when(F.col("length") > F.col("limit"), F.col("n_docs")).otherwise(0)).alias("n_longer"), F.sum(F.least("length", "limit") * F.col("n_docs")).alias("truncated_total"))
