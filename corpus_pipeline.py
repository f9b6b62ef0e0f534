"""Raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before it
kept, and returns a DataFrame; all but the last return the columns of ``documents``. What a
stage returns is written once as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smudgelab.llm import bpe, langid, mixing, resemblance, secret_scan
from smudgelab.llm.common import fold, sha256_hex, stored, table
from smudgelab.llm.queries import VOCABULARY

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; it fills in where ``lang`` is null."""
    model = langid.fit(docs, where=fold(F.col("doc_id")) != 0)
    kept = langid.identify(docs, model).where(~F.col("rejected"))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (SimHash at 4 or fewer of 64 bits, or five-word
    shingles at a resemblance of 0.8 or more): the one with the smallest id."""
    return resemblance.first_of_groups(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced by a mark."""
    found = secret_scan.find(docs, secret_scan.train(docs))
    marked = secret_scan.redact(found)
    n_chars = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return marked.withColumn("n_chars", n_chars).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.repeated(docs.select(*COLUMNS), mixing.mix(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digest of the bytes they decode to."""
    ranks = bpe.load_ranks(public_tokenizers.path(VOCABULARY))
    return bpe.encode_and_decode(docs, ranks, public_tokenizers.PATTERN).select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        sha256_hex(F.col("bytes")).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secrets),
    ("mixture", mixture),
    ("byte_bpe", token_ids),
]

#: The stages train models and link near-duplicates, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
