"""Files, frames and saved state: Spark readers and writers, with what they lack."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The largest frame.
MAX_FRAME = 2 << 20


def file_chunks(spark: SparkSession, path: str, size: int = 128_000) -> DataFrame:
    """(path, no, data): whole files in chunks."""
    files = spark.read.format("binaryFile").load(path)
    n = F.ceil(F.col("length") / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(F.col("content"), i * size + 1, F.lit(size)))
    return files.where("length > 0").select("path", F.posexplode(cut).alias("no", "data"))


def read_at(files: DataFrame, offset: int, size: int) -> DataFrame:
    """size bytes from offset on, fewer at the end."""
    return files.withColumn("data", F.substr(F.col("content"), F.lit(offset + 1), F.lit(size)))


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def append_log(records: DataFrame, path: str, payload: str = "payload") -> None:
    """Appends log records (seq, kind, payload) with their check numbers."""
    records.withColumn("check", F.crc32(payload)).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, payload: str = "payload") -> DataFrame:
    """Log records up to the first damaged one, in order of seq."""
    log = spark.read.parquet(path)
    bad = log.where(F.crc32(payload) != F.col("check")).agg(F.min("seq").alias("bad"))
    return log.join(F.broadcast(bad)).where(F.col("bad").isNull() | (F.col("seq") < F.col("bad"))).drop("bad", "check")


def write_snapshot(df: DataFrame, base: str, number: int) -> None:
    """A numbered snapshot with a manifest (rows, checksum) that is written last."""
    path = f"{base}/snapshot={number}"
    df.write.mode("overwrite").parquet(f"{path}/data")
    saved = df.sparkSession.read.parquet(f"{path}/data")
    saved.agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*saved.columns)).alias("checksum")).write.mode("overwrite").json(f"{path}/manifest")


def read_snapshot(spark: SparkSession, base: str, numbers: list[int], schema: StructType) -> tuple[int | None, DataFrame]:
    """The newest snapshot whose rows and checksum agree with its manifest; (None, no rows) without one."""
    from pyspark.errors import AnalysisException

    for number in sorted(numbers, reverse=True):
        try:
            df = spark.read.schema(schema).parquet(f"{base}/snapshot={number}/data")
            want = spark.read.schema("rows long, checksum long").json(f"{base}/snapshot={number}/manifest").first()
        except AnalysisException:
            continue
        if want and tuple(want) == tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*df.columns))).first()):
            return number, df
    return None, spark.createDataFrame([], schema)


def save_peers(peers: DataFrame, base: str, number: int) -> None:
    """A node's peers (id, address, weight, whatever else they have) as a numbered snapshot with a checksum."""
    write_snapshot(peers, base, number)


def load_peers(spark: SparkSession, base: str, numbers: list[int], schema: StructType) -> DataFrame:
    """The peers of the newest snapshot that isn't damaged; none without one."""
    return read_snapshot(spark, base, numbers, schema)[1]


def overlay(base: DataFrame, pending: DataFrame) -> DataFrame:
    """Configuration (field, value) with pending changes; a change to null removes the field."""
    changed = pending.withColumn("changed", F.lit(True))
    both = base.join(changed.withColumnRenamed("value", "new"), "field", "full_outer")
    return both.select("field", F.when(F.col("changed"), F.col("new")).otherwise(F.col("value")).alias("value")).where("value is not null")


def frames(rows: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """(id, no, frame): byte strings split into frames of a 4-byte big-endian length and so many bytes. An unfinished or oversized frame ends a string."""
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, data in zip(batch[id_col], batch[data_col], strict=True):
                data, at, no = bytes(data or b""), 0, 0
                while at + 4 <= len(data):
                    n = int.from_bytes(data[at : at + 4], "big")
                    if n > MAX_FRAME or at + 4 + n > len(data):
                        break
                    out.append((key, no, data[at + 4 : at + 4 + n]))
                    at, no = at + 4 + n, no + 1
            yield pd.DataFrame(out, columns=[id_col, "no", "frame"])

    return rows.select(id_col, data_col).mapInPandas(run, f"{id_col} {kind}, no int, frame binary")


def framed(frame):
    """A byte string as a frame."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(frame)), 8, "0")), frame)


def directory_files(entries: DataFrame, roots: DataFrame, deepest: int = 16) -> DataFrame:
    """(root, dir, name, child) of all file entries below each root; entries without a child are left out. entries: dir, name, child, is_dir."""
    whole = entries.where("child is not null")
    now = roots.select("root", F.col("root").alias("dir"))
    found = None
    for _ in range(deepest):
        step = now.join(whole, "dir")
        files = step.where(~F.col("is_dir")).select("root", "dir", "name", "child")
        found = files if found is None else found.unionByName(files)
        now = step.where("is_dir").select("root", F.col("child").alias("dir")).distinct()
        if now.isEmpty():
            break
    return found
