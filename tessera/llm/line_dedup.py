"""Line dedup: repeated runs of lines by a suffix array over line ids.

Every line gets an id; lines that occur once can't be part of a repeated run and end
the runs beside them. Prefix doubling ranks what remains: the rank of the 2k lines
from a place is the place of its pair (rank of the first k, rank of the next k)
among the distinct pairs, sorted by range partitions. Pairs that occur once
drop out. Equal ranks at a depth are a longest-common-prefix interval of at least that
depth: the places whose next lines are the same. Doubling goes on to the depth that
the data's windows need, and no further.

A maximal repeated run counts if it has ``min_words`` words or more. Any line
of such a run lies in the shortest window from the run's start on, or in the shortest
window up to that line, that has so many words; and a window inside a later copy
is itself a later copy. So: for each place the shortest window forward and the shortest
backward with min_words words is looked up in its interval by two overlapping ranks,
and if the interval's first place (by document, then line) is another one, the window's
lines are deleted. The first copy of every run stays.

Lines are what "\\n" separates; their ids have 128 bits. Null text counts as empty and becomes the
empty text. Rows that repeat an id and its text are one document: they aren't copies of each other
and all come out alike. Texts that share an id are documents of their own, in the order of a hash.
Rows with a null id are left as they are and compared with nothing. Documents without a repeated run
keep their text as it is. Very long texts are a row for each line, so they are cut like others. An empty table gives an empty result. Extra columns of any name are
carried through; those named n_lines or n_removed give way to the counts where counts are wanted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.llm.common import fits, met, split, text_of, written
from tessera.shared import BROADCAST_ROWS

#: Words that make a repeated run worth deleting.
MIN_WORDS = 50
#: Texts that a task holds at once besides those Spark hands over together.
ROWS = 500
#: What tells documents apart: the id, and a hash of the text.
OWN = ["doc", "twin"]


def windows(counts: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the lines in the shortest window from it on, and up to it, with min_words words (0: there is none)."""
    n = len(counts)
    total = np.r_[0, np.cumsum(counts)]
    at = np.arange(n)
    end = np.searchsorted(total, total[:-1] + min_words, "left")  # smallest end with enough words
    start = np.searchsorted(total, total[1:] - min_words, "right") - 1  # largest start with enough
    forward = np.where(end <= n, np.maximum(end - at, 1), 0)
    backward = np.where(total[1:] >= min_words, np.maximum(at + 1 - start, 1), 0)
    return forward, backward


def lines(df: DataFrame, min_words: int) -> DataFrame:
    """(doc, twin, pos, line, check, forward, backward): a row for each line of df (doc, text), with its id in two halves."""
    import xxhash

    schema = pa.schema([("doc", pa.int64()), ("twin", pa.int64()), ("pos", pa.int32()), ("line", pa.int64()), ("check", pa.int64()), ("forward", pa.int32()), ("backward", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh3_128_digest
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                held: list[list[np.ndarray]] = [[] for _ in schema]
                for doc, twin, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    found = text.as_py().encode().split(b"\n")
                    n = len(found)
                    ids = np.frombuffer(b"".join([h(x) for x in found]), np.int64).reshape(n, 2)
                    for column, value in zip(held, (np.full(n, doc), np.full(n, twin), np.arange(n), ids[:, 0], ids[:, 1], *windows(np.array([len(x.split()) for x in found]), min_words)), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t.type.to_pandas_dtype())) for x, t in zip(held, schema, strict=True)], schema=schema)

    return df.select("doc", "twin", "text").mapInArrow(run, "doc long, twin long, pos int, line long, check long, forward int, backward int")


def ranked(pairs: DataFrame, *by: str) -> DataFrame:
    """The distinct pairs that occur more than once, how often, and an order-preserving rank."""
    often = pairs.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
    return written(often.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()))


def suffix_ranks(rows: DataFrame, depth: int) -> list[DataFrame]:
    """Prefix doubling. For each level k with 2^k <= depth a written table (doc, twin, pos, rank) of the places whose next 2^k lines occur elsewhere too; ranks sort as these lines do by their ids."""
    line = ["line", "check"]
    levels = [written(met(rows.select(*OWN, "pos", *line), ranked(rows, *line), line, "n").select(*OWN, "pos", "rank"))]
    k = 0
    while 2 << k <= depth:
        reach = 1 << k
        after = Window.partitionBy(*OWN).orderBy("pos").rangeBetween(reach, reach)
        pairs = written(levels[-1].withColumn("next", F.max("rank").over(after)).where("next is not null").withColumnRenamed("rank", "first"))
        pair = ["first", "next"]
        levels.append(written(met(pairs, ranked(pairs, *pair), pair, "n").select(*OWN, "pos", "rank")))
        k += 1
    return levels


def later_copies(rows: DataFrame, min_words: int) -> DataFrame:
    """(doc, twin, start, length) windows of lines that repeat an earlier run. rows: the written table of lines."""
    deepest = rows.agg(F.greatest(F.max("forward"), F.max("backward"))).first()[0] or 0
    found = None
    levels = suffix_ranks(rows, deepest)
    # places whose own line repeats, with a window forward (from pos) or backward (up to pos)
    repeated = rows.join(levels[0].select(*OWN, "pos"), [*OWN, "pos"], "left_semi")
    spans = repeated.where("forward > 0").select(*OWN, F.col("pos").alias("start"), F.col("forward").alias("length"))
    spans = spans.unionByName(repeated.where("backward > 0").select(*OWN, (F.col("pos") - F.col("backward") + 1).alias("start"), F.col("backward").alias("length"))).distinct()
    spans = written(spans)
    for k, level in enumerate(levels):
        here = spans.where((F.col("length") >= 1 << k) & (F.col("length") < 2 << k))
        head = level.select(*OWN, F.col("pos").alias("start"), F.col("rank").alias("head"))
        tail = level.select(*OWN, F.col("pos").alias("end"), F.col("rank").alias("tail"))
        # the window's interval: its first 2^k lines and its last 2^k lines
        keyed = here.join(head, [*OWN, "start"]).withColumn("end", (F.col("start") + F.col("length") - (1 << k)).cast("int")).join(tail, [*OWN, "end"])
        keyed = written(keyed.select(*OWN, "start", "length", "head", "tail"))
        interval = ["length", "head", "tail"]
        firsts = written(keyed.groupBy(*interval).agg(F.min(F.struct(*OWN, "start")).alias("first"), F.count("*").alias("n")).where("n > 1"))
        later = met(keyed, firsts, interval, "n").where(F.struct(*OWN, "start") != F.col("first")).select(*OWN, "start", "length")
        found = later if found is None else found.unionByName(later)
    return written(found)


def line_dedup(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", counts: bool = True, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with its text cleaned; with counts also n_lines, n_removed (long). Cuts are broadcast if at most `most` documents have some."""
    added = ["n_lines", "n_removed"] if counts else []
    names = [c for c in df.columns if c not in added]
    kept = F.struct(*(F.col(f"`{n}`") for n in names)).alias("row")
    rows = df.select(kept, F.col(f"`{id_col}`").cast("long").alias("doc"), text_of(f"`{text_col}`").alias("text")).withColumn("twin", F.xxhash64("text"))
    cuts = later_copies(written(lines(rows.where("doc is not null"), min_words).distinct()), min_words)
    # spans of a document that touch or overlap become one, so the list stays as short as its runs
    by = Window.partitionBy(*OWN).orderBy("start", "length")
    reach = F.max(F.col("start") + F.col("length")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    merged = cuts.withColumn("fresh", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("island", F.sum("fresh").over(by))
    merged = merged.groupBy(*OWN, "island").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"))
    gone = written(merged.groupBy(*OWN).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts")))
    if fits(gone, most):
        joined = rows.join(F.broadcast(gone), OWN, "left").select("row", "text", "cuts")
    else:  # only texts that may have cuts shuffle
        maybe, whole = split(rows, gone, OWN)
        joined = maybe.join(gone, OWN, "left").select("row", "text", "cuts").unionByName(whole.select("row", "text", F.lit(None).cast(gone.schema["cuts"].dataType).alias("cuts")))
    fields = [f for f in df.schema.fields if f.name in names]
    out = StructType([StructField(f.name, StringType()) if f.name == text_col else f for f in fields])
    for name in added:
        out = out.add(name, LongType())
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts, total, removed = [], [], []
                for text, cuts in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                    text = text.as_py()
                    found = text.split("\n")
                    total.append(len(found))
                    keep = np.ones(len(found), bool)
                    for c in cuts or ():
                        keep[c["start"] : c["end"]] = False
                    removed.append(int(len(found) - keep.sum()))
                    texts.append("\n".join([x for x, k in zip(found, keep, strict=True) if k]) if cuts else text)
                columns = part.column(0).flatten()
                columns[place] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (total, removed)[: len(added)])], [*names, *added])

    return joined.mapInArrow(run, out)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"), "text")
