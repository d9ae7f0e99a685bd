"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept.
Columns of any names are carried, but for the last stage. Null and empty texts
are rejected by the first. A row without a doc_id is judged by the rules, holds
no line first, is no duplicate and no leak. Rows that repeat a doc_id and its
text go the same way. Texts are read whole. Without documents there are no
rows; without benchmark items no document is a leak.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import _common, byte_bpe, decontamination, line_dedup, near_dedup, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and lines over the limit from the others."""
    return quality.keep_documents(docs)


def line_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go."""
    return line_dedup.keep_first_lines(docs)


def near_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian u32), and the hashes of the ids and of the decoded bytes."""
    import public_tokenizers as P

    coded = byte_bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep_ids=True)
    return coded.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_),
    ("near_dedup", near_dedup_),
    ("decontamination", decontaminate),
    ("byte_bpe", encode),
]

#: BagMinHash groups and BPE merges have no SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    space = _common.Workspace(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = space.table(docs, name)
    return docs
