"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidspark.llm import chat, decontam, langid, minhash, mixing, quality, suffixdedup, tokenstore, topk, urlfilter
from braidspark.llm.common import held_out, learned_from, read_table, scratch_path

END_ID = 1


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, pieces = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixing.taken_by_document(documents, pieces).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    features = quality.extract(docs, ["doc_id", "held_out"])
    labels = read_table(spark, sf_dir, "labels").where(learned_from(F.col("doc_id")))
    model = quality.fit(features.where(learned_from(F.col("doc_id"))), labels)
    return quality.score_features(features, model, ["doc_id", "held_out"])


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    model = langid.train(docs.where(learned_from(F.col("doc_id"))))
    return langid.predict(docs, model, ["doc_id", "held_out"])


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.document_classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read_table(spark, sf_dir, "conversations"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digest(suffixdedup.remove_repeats(read_table(spark, sf_dir, "documents")))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokenstore.write_tokens(read_table(spark, sf_dir, "documents"), path, tokenizer_file(), END_ID)
    return tokenstore.digest_tokens(spark, path)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mixing,
        op2_quality_classifier,
        op3_url_filters,
        op4_language_id,
        op5_minhash_near_dedup,
        op6_exact_top_k,
        op7_chat_formatting,
        op8_suffix_array_dedup,
        op9_token_store,
        op10_benchmark_decontamination,
    )
}
