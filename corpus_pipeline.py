"""Cleaning of ``documents`` for training, stage by stage.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as
Parquet and read again as the next one's docs. All but the last keep the columns
of ``documents``, and any other column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readloom.llm import byte_bpe, decontaminate, jaccard, secrets, toxicity
from readloom.llm.text import table
from readloom.session import Workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. The classifier is fitted on the labelled rows among ``docs``."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest doc_id stays."""
    return jaccard.one_of_each(docs, Workspace(spark))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth or more go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; all documents stay."""
    return secrets.without_secrets(docs, Workspace(spark))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, its number of tokens, and the digest of ids and of the text that they decode to."""
    return byte_bpe.round_trip(docs.select("doc_id", "text"), keep=["doc_id"], with_ids=True).select(
        "row.doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("byte_bpe", encode),
]

#: Learned scores have no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each stored in the shared folder."""
    work, docs = Workspace(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.keep(name, stage(spark, docs, sf_dir))
    return docs
