"""The operators' queries, over whole tables with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import ann, exact_dedup, hard_negatives, jaccard, line_dedup, mixing, pii, sentencepiece_codec, sharding, token_counts, token_files, toxicity, vector_codes
from quillmill.llm.common import shared_folder, table

SHARDS = 24
#: For op6, whose results are to be the same in every run and are nobody's data. Real keys are secrets.
QUERY_KEY = "op6"
#: A SentencePiece model file.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: A file of the tokenizers library, and the id that ends each document.
BYTE_TOKENIZER, END_ID = "/opt/tokenizers/byte_bpe_50k.json", 2


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER).select("doc_id", "n_tokens", "score")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), grade_col="toxic", split_flag=True)
    return toxicity.predict(docs.select("doc_id", "text"), model).select("doc_id", "severity", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(docs, path, BYTE_TOKENIZER, END_ID)
    return token_files.lookup(docs, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 50 = 0"), noisy)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_token_counts, op3_ngram_jaccard, op4_exact_dedup, op5_source_mixing, op6_pii, op7_toxicity, op8_sharding, op9_line_dedup, op10_nearest_neighbours, op11_token_files, op12_vector_codes, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
        "op5_source_mixing": mixing.ORACLE_SQL,
        "op9_line_dedup": line_dedup.ORACLE_SQL,
        "op12_vector_codes": vector_codes.oracle_sql(),
        "op13_hard_negatives": hard_negatives.ORACLE_SQL,
    }
