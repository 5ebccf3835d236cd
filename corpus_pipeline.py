"""The corpus pipeline: quality classifier, line dedup, near-duplicate groups, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its Parquet is the next one's docs.
All but the last return the columns of documents, extra columns of any name included.

In every stage null text counts as empty and an empty table gives an empty result. Texts of any
length are judged and kept whole. Rows that repeat an id and a text share their fate, so they stay or go together;
texts that share an id are judged each by itself. Rows with a null id are judged by the classifier alone
and else stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, packing, quality, simhash
from tessera.llm.common import bounded, shared_dir, text_of, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go: those that score less than 0.7. An empty text is scored like any other; without labels of both kinds all rows get the same score."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; a text that is nothing else becomes empty. n_chars follows the text (null stays null). Of equal texts the one with the smallest id counts as the first."""
    cleaned = line_dedup.line_dedup(docs, counts=False)
    return cleaned.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else cleaned


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    groups = simhash.similar_groups(docs).where("doc_id <> component_id")
    gone = bounded(written(groups.select(F.col("doc_id").alias("id"), "twin").distinct()))
    same = (docs.doc_id.cast("long") == gone["id"]) & (F.xxhash64(text_of("text")) == gone["twin"])
    return docs.join(gone, same, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces and their places in sequences of 1024 ids. Repeated rows are packed as often as they occur."""
    return packing.packed(docs)


STAGES = [("quality", good_documents), ("line_dedup", fresh_lines), ("near_dedup", unlike_documents), ("packing", sequences)]

#: A learnt filter, a suffix array, fingerprints and a tokenizer: SQL expresses none of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_dir(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
