"""From raw documents to token files: each stage works on all rows that the one before it kept.

``run`` writes every stage as Parquet under the session's shared folder and reads it again, as the check tool does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import Workspace, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents above a perplexity threshold of their language and length go."""
    from tidemark.llm.perplexity import keep_good

    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 or more of five-word shingles the one with the smallest doc_id stays."""
    from tidemark.llm.similar import keep_similar

    return keep_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that hold a benchmark item go."""
    from tidemark.llm.leaks import drop_leaks

    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents as often as the mix takes them (twice at most)."""
    from tidemark.llm.mixing import mix

    return mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the token files, and from them each document's place and checksum."""
    import public_tokenizers

    from tidemark.llm.token_ids import encode_documents

    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: SQL cannot express fingerprints, byte n-gram models or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = work.table(docs, f"{i}-{name}")
    return docs
