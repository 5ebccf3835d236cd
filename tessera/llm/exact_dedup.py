"""Exact dedup by two-pass Bloom filtering. DataFrame operations only.

A text's digest picks one 64-bit word of a blocked Bloom filter and three of the
word's bits; that choice is its cell, a number of 18 bits more than words need. The first pass counts
cells, combined map-side, and keeps those that more than one row sets as the second filter: words of
possibly repeated cells. What it shuffles is a number a row at most, neither ids nor digests.
In the second pass a row whose bits aren't all set is certainly alone and passes straight through;
only the others shuffle, by digest, to be counted exactly, and rows of large groups not even
then. The filter has a word per ``rows_per_word`` rows and at most ``MAX_WORDS``; beyond that it lets
more rows through to the exact count, never fewer. It is broadcast up to ``FILTER`` words
that hold a bit (24 MB), and else joined by word, which shuffles the digests.

Null text counts as empty; texts are equal when identical after each run of ASCII
white space is replaced by one space. Repeated rows count as often as they occur,
and all rows that carry the smallest id of their group are kept; null ids come after all others. An empty table
gives an empty result. Texts of any length are digested whole and never shuffle; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, bounded, met, text_of, written

MAX_WORDS = 1 << 30
#: Words of the second filter that are broadcast at most.
FILTER = 1_500_000


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256) of the normalised texts."""
    text = F.regexp_replace(text_of(text_col), SPACE, " ")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256"))


def cell(words: int) -> Column:
    """The cell of a digest: three bit numbers, above them the word."""
    return F.expr(f"xxhash64(text_sha256) & {(words << 18) - 1}L")


def word_and_bits(of: Column) -> tuple[Column, Column]:
    """A cell's word, and its bits in it."""
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(of, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return F.shiftrightunsigned(of, 18), bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))


def repeated(found: DataFrame, rows_per_word: int = 2) -> tuple[DataFrame, DataFrame]:
    """The rows of found (doc_id, text_sha256; a written table) that pass the filter, and those that certainly are alone."""
    n = found.count()
    words = min(MAX_WORDS, 1 << max(6, (n // rows_per_word).bit_length()))
    word, bits = word_and_bits(F.col("cell"))
    twice = found.select(cell(words).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    second = written(twice.groupBy(word.alias("word")).agg(F.bit_or(bits).alias("held")))
    tested = found.withColumn("cell", cell(words)).withColumn("word", word).withColumn("bits", bits).join(bounded(second, FILTER), "word", "left")
    maybe = tested.withColumn("maybe", F.coalesce(F.col("held").bitwiseAND(F.col("bits")) == F.col("bits"), F.lit(False)))
    return maybe.where("maybe").select("doc_id", "text_sha256"), maybe.where("not maybe").select("doc_id", "text_sha256")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_word: int = 2) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    found = written(digests(df, id_col, text_col))
    maybe, alone = repeated(found, rows_per_word)
    groups = written(maybe.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    counted = met(maybe, groups, ["text_sha256"], "group_size").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    through = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return counted.select(*through.columns).unionByName(through)


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""
