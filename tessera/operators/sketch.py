"""Sketches as relations: Bloom filters, elastic Bloom filters with removal and resizing, attenuated (per-hop) filters.

A Bloom filter is (position); an elastic one (bucket, fingerprint); an attenuated one has a level too. Membership is a join
on positions, so a filter may be larger than any task's memory.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Occupancy above which an elastic filter grows; below a quarter of it it shrinks, but not under 16 buckets.
GROW, LEAST = 0.75, 16


def best_size(n: int, p: float) -> tuple[int, int]:
    """Bits and hash functions for n keys and a false positive rate p."""
    if n < 1 or not 0 < p < 1:
        raise ValueError("n must be positive and p between 0 and 1")
    m = ceil(-n * log(p) / log(2) ** 2)
    return m, max(1, round(log(2) * m / n))


def md5_hash(key: Column, seed: int) -> Column:
    """A hash of 60 bits that other engines can take too."""
    return F.conv(F.substr(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), F.lit(1), F.lit(15)), 16, 10).cast("long")


def positions(key: Column, bits: int, k: int) -> Column:
    """The k probe positions of a key: a + i b + i^2."""
    a, b = F.pmod(md5_hash(key, 1), F.lit(bits)), F.pmod(md5_hash(key, 2), F.lit(bits))
    return F.array(*(F.pmod(a + b * i + i * i, F.lit(bits)) for i in range(k)))


def bloom(keys: DataFrame, key: str, bits: int, k: int) -> DataFrame:
    """The filter's set positions."""
    return keys.select(F.explode(positions(F.col(key), bits, k)).alias("position")).distinct()


def bloom_contains(keys: DataFrame, key: str, filter_: DataFrame, bits: int, k: int) -> DataFrame:
    """keys with maybe: whether all its positions are set."""
    probes = keys.select(key, F.explode(F.array_distinct(positions(F.col(key), bits, k))).alias("position"))
    hits = probes.join(filter_.withColumn("hit", F.lit(1)), "position", "left")
    return hits.groupBy(key).agg((F.count("hit") == F.count("*")).alias("maybe"))


def elastic(keys: DataFrame, key: str, buckets: int, bits: int, k: int) -> DataFrame:
    """(bucket, fingerprint) of an elastic filter; the fingerprint 0 is written 1, as 0 means empty."""
    return keys.select(F.explode(entries(F.col(key), buckets, bits, k)).alias("e")).select("e.bucket", "e.fingerprint").distinct()


def entries(key: Column, buckets: int, bits: int, k: int) -> Column:
    def one(i: int) -> Column:
        h = md5_hash(key, 1 + 2 * i)
        return F.struct(F.pmod(h, F.lit(buckets)).alias("bucket"), F.greatest(F.pmod(F.call_function("div", h, F.lit(buckets).cast("long")), F.lit(1 << bits)), F.lit(1)).cast("int").alias("fingerprint"))

    return F.array(*(one(i) for i in range(k)))


def remove(filter_: DataFrame, keys: DataFrame, key: str, buckets: int, bits: int, k: int) -> DataFrame:
    return filter_.join(elastic(keys, key, buckets, bits, k), ["bucket", "fingerprint"], "left_anti")


def expand(filter_: DataFrame) -> DataFrame:
    """Twice the buckets, fingerprints one bit shorter."""
    return filter_.select((F.col("bucket") * 2 + F.col("fingerprint") % 2).alias("bucket"), F.greatest(F.shiftright("fingerprint", 1), F.lit(1)).alias("fingerprint")).distinct()


def compress(filter_: DataFrame, buckets: int) -> DataFrame:
    """Half the buckets, fingerprints one bit longer: the half that a bucket lay in."""
    half = buckets // 2
    upper = (F.col("bucket") >= half).cast("int")
    return filter_.select(F.pmod("bucket", F.lit(half)).alias("bucket"), (F.col("fingerprint") * 2 + upper).alias("fingerprint")).distinct()


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def ratio(filter_: DataFrame, buckets: int) -> DataFrame:
    """(ratio, next): the share of buckets in use, and what the filter should do."""
    share = F.countDistinct("bucket") / F.lit(buckets)
    return filter_.agg(share.alias("ratio")).withColumn("next", F.when(F.col("ratio") > GROW, "expand").when((F.col("ratio") < GROW / 4) & F.lit(buckets > LEAST), "compress").otherwise("keep"))


def attenuated_merge(own: DataFrame, neighbour: DataFrame, levels: int) -> DataFrame:
    """own with the neighbour's levels, each one hop further away. Rows: (level, bucket, fingerprint)."""
    moved = neighbour.withColumn("level", F.col("level") + 1).where(F.col("level") < levels)
    return own.unionByName(moved).distinct()


def nearest_level(keys: DataFrame, key: str, filter_: DataFrame, buckets: int, bits: int, k: int) -> DataFrame:
    """(key, level): the lowest level that holds all of a key's entries, null if none does."""
    wanted = keys.select(key, F.explode(F.array_distinct(entries(F.col(key), buckets, bits, k))).alias("e")).select(key, "e.bucket", "e.fingerprint")
    n = wanted.groupBy(key).agg(F.count("*").alias("wanted"))
    hits = wanted.join(filter_, ["bucket", "fingerprint"]).groupBy(key, "level").agg(F.count("*").alias("n"))
    full = hits.join(n, key).where("n = wanted").groupBy(key).agg(F.min("level").alias("level"))
    return n.select(key).join(full, key, "left")
