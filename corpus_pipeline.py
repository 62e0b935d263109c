"""The corpus pipeline: the stages that turn ``documents`` into token sequences, in order.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of ``documents``. Rows that a stage can't read (null or empty texts) follow
the rules of the operator that it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxframe.llm.bpe_codec import encode_documents
from voxframe.llm.common import cut, table
from voxframe.llm.language_id import keep_identified
from voxframe.llm.mixing import mixture
from voxframe.llm.queries import tokenizer_path
from voxframe.llm.near_copies import keep_one
from voxframe.llm.secrets_scan import mask_secrets


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is not identified."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group."""
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; every document stays."""
    return mask_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, once or again, so that the sources meet their targets."""
    return mixture(docs, labels=table(spark, sf_dir, "labels")).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decodes of every document of the mix."""
    return encode_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("simhash_near_dedup", near_dedup), ("secret_scan", secrets), ("mixing", mixing), ("bpe_encoding", encoding)]

#: SQL can express neither compression nor token merging.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each result kept in the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs if name == STAGES[-1][0] else cut(docs)
    return docs
