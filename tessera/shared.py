"""The shared folder, tables written to it, and joins that choose their side by counted sizes."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it has been counted and has at most so many rows.
BROADCAST_ROWS = 200_000
#: Rows from which a key counts as heavy, and the parts that a heavy key is dealt out over where the heavy keys are too many to broadcast.
HEAVY, SALTS = 100, 32
_roots: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the session's checkpoint folder, deleted by forget() or when Python ends.

    A folder of its own is set only where none is, and only for a local master: on a cluster a machine's own folder would lose tables.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/tessera/{uuid.uuid4().hex}"
    _roots[path] = spark
    return path


def forget(spark: SparkSession | None = None) -> None:
    """Deletes the folders that shared_dir() gave out: results that still read from them are lost."""
    for path, owner in list(_roots.items()):
        if spark is None or owner is spark:
            _roots.pop(path)
            try:
                where = owner._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(owner._jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)
            except Exception:  # noqa: BLE001  the session is over, or its folder went before
                continue


atexit.register(forget)


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a written table that nothing reads any more."""
    folders = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for f in df.inputFiles()}
    for path in [p for p in _roots if p.rsplit("/", 1)[1] in folders]:
        jvm = _roots.pop(path)._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)


def fits(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most limit rows. Counts df, so give it a written table."""
    return df.limit(limit + 1).count() <= limit


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows, else as it is (Spark then shuffles). Counts df, so give it a written table."""
    return F.broadcast(df) if fits(df, limit) else df


def met(rows: DataFrame, table: DataFrame, keys: list[str], count: str, outer: bool = False) -> DataFrame:
    """rows joined with table (written; one row a key, whose column count says how many of the rows have it); outer keeps rows without a key in it.

    No key's rows end in one task: rows of heavy keys meet a broadcast of these keys, or, where they
    are too many, a salted copy of them. All other rows meet their keys by a shuffle.
    """
    names = [c for c in table.columns if c not in keys]
    heavy = table.where(F.col(count) > HEAVY)
    if fits(heavy):
        hot = rows.join(F.broadcast(heavy), keys)
        rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    else:
        salted = heavy.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
        hot = dealt.join(salted, [*keys, "__salt"])
        rest = dealt.join(salted.select(*keys, "__salt"), [*keys, "__salt"], "left_anti").select(*rows.columns)
    light = rest.join(table.where(F.col(count) <= HEAVY), keys, "left" if outer else "inner")
    return hot.select(*rows.columns, *names).unionByName(light.select(*rows.columns, *names))


#: Words of a filter that are broadcast at most.
FILTER = 1_500_000


def split(rows: DataFrame, table: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be in table (written), and those whose key certainly isn't: by a blocked Bloom filter of the table's keys, a word to two keys and three bits a key.

    Neither shuffles while the filter has FILTER words at most; beyond that all rows may be in it. Rows with a null key aren't in it.
    """
    words = 1 << max(6, (table.count() // 2).bit_length())
    if words > FILTER:
        return rows, rows.limit(0)
    h = F.xxhash64(*keys)
    word = F.shiftrightunsigned(h, 18).bitwiseAND(F.lit(words - 1))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    bits = bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))
    held = written(table.groupBy(word.alias("__word")).agg(F.bit_or(bits).alias("__held")))  # at most words rows
    tested = rows.withColumn("__word", word).join(F.broadcast(held), "__word", "left")
    fits = F.coalesce(F.col("__held").bitwiseAND(bits) == bits, F.lit(False))
    return tested.where(fits).select(*rows.columns), tested.where(~fits).select(*rows.columns)
