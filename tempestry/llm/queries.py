"""Queries of the training-data operators, by name; SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempestry.llm import ann, common, conversations, decontaminate, filter_audit, hilbert, html_text, id_files, langid, lengths, licenses, line_dedup, ngram_join, packing

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return common.table(spark, sf_dir, "documents", columns or ("doc_id", "text"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digest(packing.pack(documents(spark, sf_dir), tokenizer_path()))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.grouped(documents(spark, sf_dir))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.main_text(common.table(spark, sf_dir, "pages", ("page_id", "url", "html")))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "token-ids")
    manifest = id_files.write_files(documents(spark, sf_dir), tokenizer_path(), path)
    return id_files.read_files(spark, path, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings", ("vec_id", "embedding"))
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.digest(hilbert.shards(documents(spark, sf_dir, "doc_id", "text", "lang", "source"), 24))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.leaks(documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark", ("item_id", "text"))))


def op9_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = lengths.length_counts(documents(spark, sf_dir, "text"), tokenizer_path())
    return lengths.length_table(common.written(counts, "length-counts"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.deduplicated(documents(spark, sf_dir)))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations", ("conv_id", "turn", "role", "text"))
    rows = conversations.damage(turns)
    return conversations.digest(rows, conversations.plans(rows, turns.select("conv_id")))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(*licenses.scan(documents(spark, sf_dir)))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir, "doc_id", "text", "source"), common.table(spark, sf_dir, "labels", ("doc_id", "quality", "toxic"))
    return filter_audit.audited(docs, labels)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_ngram_join": op2_ngram_join,
        "op3_html_text": op3_html_text,
        "op4_token_ids": op4_token_ids,
        "op5_nearest": op5_nearest,
        "op6_language": op6_language,
        "op7_hilbert_shards": op7_hilbert_shards,
        "op8_decontamination": op8_decontamination,
        "op9_length_histogram": op9_length_histogram,
        "op10_line_dedup": op10_line_dedup,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_license_scan": op12_license_scan,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_line_dedup": line_dedup.oracle_sql(), "op11_conversation_repair": conversations.oracle_sql(), "op12_license_scan": licenses.oracle_sql(), "op13_filter_audit": filter_audit.oracle_sql()}
