"""From raw documents to packed sequences: quality rules, line dedup, near duplicates, packing.

Each stage takes all that the one before it kept; between stages the documents are a
written table. Rows without a doc_id and repeated rows are carried as the stages'
operators define. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memvault.llm import jaccard_join, line_dedup, packing, quality_rules
from memvault.llm.common import table, tokenizer, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the standard policy."""
    return quality_rules.kept_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that three or more of them share, but for the last one that has them; n_chars follows."""
    names = ("_lines_before", "_lines_dropped")
    rewritten = line_dedup.dedup_lines(docs, names=names).drop(*names)
    if "n_chars" in docs.columns:
        rewritten = rewritten.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rewritten.select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates."""
    return jaccard_join.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("packing", pack)]

#: SQL can't tokenize; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
