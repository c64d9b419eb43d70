"""A training-corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame for the next one.

1. quality_rules: documents that the rules and the line labelling reject go.
2. line_dedup: lines held by many documents stay in one of them; ``n_chars`` follows the text.
3. ngram_join: of each group of near duplicates the document with the smallest doc_id stays.
4. decontamination: documents with a benchmark passage go.
5. sentencepiece: the rest becomes token ids.

All stages but the last return the columns of documents, extra ones included. Rows with a null doc_id are judged by stage 1 and pass
the others unchanged; rows that repeat a doc_id stay or go together; a null text fails stage 1. An empty table passes through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltledger.llm.decontaminate import contamination
from voltledger.llm.line_crf import kept_rows
from voltledger.llm.line_dedup import without_lines
from voltledger.llm.ngram_join import near_duplicates
from voltledger.llm.piece_bpe import encode_decode
from voltledger.llm.shared import saved


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the doc_ids of gone, a table of decisions without texts."""
    name = f"__{uuid.uuid4().hex}"  # no column of docs
    gone = saved(gone.select(F.col("doc_id").alias(name)).distinct())
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = without_lines(docs)
    return done.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else done


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, near_duplicates(docs).where("doc_id <> component_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded_sha256 of the text that the ids give back."""
    return encode_decode(docs).select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: The line labelling of stage 1, the edit distances of stage 4 and the merges of stage 5 have no SQL: tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
