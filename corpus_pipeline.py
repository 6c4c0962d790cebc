"""A training corpus from `documents`, in five stages.

Language ID drops what has no letters or no sure language, near-dedup keeps one document of each group,
decontamination drops documents that hold benchmark items, mixing repeats and cuts documents to the sources'
target weights, and the last stage gives every mixed document its place in a token store, in the mix's order.

Edge cases: a null or empty text, or one without a letter, is of no language and goes in the first stage; null lang, source, n_chars
and doc_id stay what they are (a null source is a source of its own). Documents are told apart by (doc_id, text), nulls
included, so that rows that share a doc_id but not a text are documents of their own; equal rows are one from the second
stage on. Texts are read whole, of any length. Ties go to the smaller doc_id, then to the smaller hash. An empty
table of documents gives no rows, one of benchmark items drops nothing. Columns other than COLUMNS go in the first stage, so
that none can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidspark.llm import decontam, langid, minhash, mixing, queries, tokenstore
from braidspark.llm.common import materialize, read_table, scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A language's score below this is no decision.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a language; the model learns from all rows with a lang. Their lang becomes the predicted one."""
    model = langid.train(docs)
    kept = langid.predict(docs, model, list(COLUMNS)).where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each class, null last; a document is a distinct (doc_id, text).

    Rows that share a doc_id but hold different texts are classed apart, as are rows without a doc_id. Of rows equal in both, one stays.
    """
    classes = minhash.document_classes(docs)
    kept = classes.where("kept").select("own_id")
    return minhash.with_own_id(docs).join(kept, "own_id", "left_semi").dropDuplicates(["own_id"]).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents, told apart by (doc_id, text), that hold at least 0.8 of a benchmark item's shingles."""
    keyed = minhash.with_own_id(docs)
    pairs = decontam.contaminated(keyed.select(F.col("own_id").alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    found = materialize(pairs.select(F.col("doc_id").alias("own_id")).distinct(), "contaminated")
    return keyed.join(found, "own_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each reading of a document that the mix takes, in whole or up to the words it takes, in the mix's order."""
    return mixing.mixed_documents(docs, list(COLUMNS))


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every mixed document, from a token store in the mix's order.

    That is the order of the rows in the files that `docs` is read from: by their names, then by row.
    """
    path = scratch_path(spark, "tokens")
    placed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    tokenstore.write_tokens(placed, path, queries.tokenizer_file(), queries.END_ID, order=("file", "row"))
    return tokenstore.digest_tokens(spark, path)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", store_tokens),
]

#: SQL can express neither the language model nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
