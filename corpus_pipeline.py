"""Pipeline of the training-data operators: from documents to packed sequences, a table written between stages.

language ID, line deduplication, near-duplicate removal, benchmark decontamination, packing.

Every stage takes documents of any columns besides doc_id and text, whatever their names, and all but the last return
the same columns. Texts of any length count whole; rows that repeat a document share its fate; an empty table stays
empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tempestry.llm import common, decontaminate, langid, line_dedup, ngram_join, packing, queries


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; a text that no learned language is near to, or that is null, empty or without
    a letter, goes. Equal texts get the same answer, and of centroids at equal distance the first counts."""
    return langid.accepted(docs, langid.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more have go; documents keep the rest, which may be empty. A null text stays null."""
    return line_dedup.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest doc_id; repeated rows of it stay repeated.
    Null, empty and wordless texts and rows without a doc_id stay."""
    return ngram_join.one_of_each(docs, ngram_join.grouped(docs))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item; null and short texts hold none. Null items match nothing."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark", ("item_id", "text")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, as op1 returns them; a null or empty text is its end id alone."""
    return packing.packed_digest(packing.pack(docs, queries.tokenizer_path()))


STAGES = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", contamination),
    ("packing", packed),
]
#: Tokenizer ids, clusters and groups aren't expressible in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is written before the next starts; what it needed is then deleted."""
    docs, own, spent = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        with common.below(f"{own}/{name}-work"):
            out = stage(spark, docs, sf_dir)
        with common.below(f"{own}/{name}"):
            docs = common.written(out, "documents")
        for folder in (f"{name}-work", spent):
            if folder:
                common.clear(spark, f"{own}/{folder}")
        spent = name
    return STAGES[-1][1](spark, docs, sf_dir)
