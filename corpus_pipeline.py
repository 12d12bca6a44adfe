"""From raw documents to token ids: five stages, each a Parquet table that the next one reads.

Toxic documents go, of equal texts one row stays, of linked near copies one document stays, sources are
mixed to their target weights, and what is left is encoded.

Defined cases, for every stage: null texts count as empty ones, which are not toxic, equal each other, link with nothing,
have no words (so mixing takes none of their source but as the rate says) and no tokens; rows with a null id are kept by
their text alone (a row with an id is preferred among equal texts) and link with nothing; rows that repeat id and text become
one; ties go to the largest id among equal texts and to the smallest among near copies; an empty table stays empty;
other columns pass through, whatever their names. The stages' tables are left in the shared folder, for inspection.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import exact_dedup, jaccard, mixing, sentencepiece_codec, toxicity
from quillmill.llm.common import fresh, shared_folder, table
from quillmill.llm.queries import TOKENIZER
from quillmill.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose chance of any toxic grade is below a half."""
    ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), grade_col="toxic", split_flag=True)
    prefix = fresh(docs, "__toxicity")
    return toxicity.predict(docs, model, prefix=prefix).where(F.col(f"{prefix}p_toxic") < 0.5).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return exact_dedup.drop(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard.drop_linked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text; lossless says whether decoding them gives the text again. The columns token_ids, n_tokens
    and lossless get another name if the documents have such columns."""
    ship(spark)
    ids, count, same = (fresh(docs, c) for c in ("token_ids", "n_tokens", "lossless"))
    return sentencepiece_codec.encode(docs, TOKENIZER, ids_col=ids, count_col=count, lossless_col=same).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode),
]

#: SQL expresses neither the classifier nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{root}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
