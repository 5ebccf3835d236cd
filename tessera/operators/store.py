"""The store: index with hit counters, write-ahead log and snapshots, slots, caches, capacity."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.folds import folded
from tessera.shared import written


def _levels() -> list[tuple[int, int]]:
    """(level, hits at which it begins): level L begins at F(L + 1) - 1 + L hits."""
    a, b, out = 1, 1, [(0, 0)]  # F(1), F(2)
    for level in range(1, 45):
        out.append((level, b - 1 + level))
        a, b = b, a + b
    return out


def hit_level(hits: Column) -> Column:
    """Struct (fib, count) of a Fibonacci hit counter after so many hits."""
    steps = F.array(*(F.struct(F.lit(n).cast("long").alias("start"), F.lit(level).alias("fib")) for level, n in _levels()))
    top = F.array_max(F.filter(steps, lambda s: s["start"] <= hits))
    return F.struct(top["fib"].alias("fib"), (hits - top["start"]).cast("long").alias("count"))


def hit_counters(accesses: DataFrame, key: str) -> DataFrame:
    """(key, hits, fib, count) from a log of accesses."""
    return accesses.groupBy(key).agg(F.count("*").alias("hits")).withColumn("level", hit_level(F.col("hits"))).select(key, "hits", "level.fib", "level.count")


def one_hit_less(hits: Column) -> Column:
    return hit_level(F.greatest(hits - 1, F.lit(0)))


def rank_groups(counters: DataFrame) -> DataFrame:
    """Entries by level: (fib, entries, hits)."""
    return counters.groupBy("fib").agg(F.count("*").alias("entries"), F.sum("hits").alias("hits"))


def by_ejection(index: DataFrame, key: str, n: int) -> DataFrame:
    """The n entries ejected longest ago; those never ejected come last, ties by key."""
    return index.orderBy(F.col("ejected").asc_nulls_last(), key).limit(n)


def index_checksum(index: DataFrame, *columns: str) -> DataFrame:
    """A checksum of the rows that doesn't depend on their order."""
    return index.agg(F.bit_xor(F.xxhash64(*columns)).alias("checksum"), F.count("*").alias("entries"))


def newest(snapshots: DataFrame, keep: int, by: list[str], order: str) -> DataFrame:
    """The newest keep snapshots of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return snapshots.withColumn("age", F.row_number().over(w)).where(F.col("age") <= keep)


def replay(log: DataFrame, key: str, order: str, kinds: dict[str, str]) -> DataFrame:
    """The state after a log: for each key the last record; removed keys are gone. kinds: column `kind` values for "remove". One aggregation, combined map-side."""
    last = log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), F.col(order)).alias("last"), F.count("*").alias("records"))
    return last.where(F.col("last.kind") != kinds["remove"]).select(key, "records", "last.*")


def log_check(payload: Column) -> Column:
    """The check number that is written with a log record."""
    return F.crc32(payload)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with turn: their place in the order, from 0. Rows are numbered by counted range parts, so no task ranks all rows."""
    parts = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before, at = [], 0
    for part, count in sorted(map(tuple, parts.groupBy("part").count().collect())):  # a row for each part
        before.append((part, at))
        at += count
    offsets = rows.sparkSession.createDataFrame(before, "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return parts.withColumn("turn", place).join(F.broadcast(offsets), "part").withColumn("turn", F.col("turn") + F.col("before")).drop("part", "before")


def sections(rows: DataFrame, order: list[str], n: int, slots: int, used: int = 0) -> DataFrame:
    """Places rows into n sections in turn: section_id, slot, after used places that are taken. Sections that are full make room for new ones with the next ids, so every row has a slot."""
    placed = numbered(rows, order).withColumn("turn", F.col("turn") + used)
    section = F.floor(F.col("turn") / (n * slots)) * n + F.pmod("turn", F.lit(n))  # n sections that begin together are full together
    return placed.withColumn("section_id", section.cast("int")).withColumn("slot", F.floor(F.pmod("turn", F.lit(n * slots)) / n).cast("int")).drop("turn")


def occupancy(slots: DataFrame) -> DataFrame:
    """Per section: used, free, the highest used slot, the ratio of used ones. slots: section_id, slot, is_free."""
    used = F.when(F.col("is_free"), 0).otherwise(1)
    return slots.groupBy("section_id").agg(F.sum(used).alias("used"), F.sum(1 - used).alias("free"), F.max(F.when(~F.col("is_free"), F.col("slot"))).alias("highest"), F.avg(used.cast("double")).alias("occupancy"))


def defragment(slots: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(section_id, slot, new_slot) of the used slots of sections below the threshold with more than one used slot."""
    sparse = occupancy(slots).where((F.col("occupancy") < threshold) & (F.col("used") > 1)).select("section_id")
    w = Window.partitionBy("section_id").orderBy("slot")
    return slots.where(~F.col("is_free")).join(sparse, "section_id").select("section_id", "slot", (F.row_number().over(w) - 1).cast("int").alias("new_slot"))


def relocate(index: DataFrame, moves: DataFrame) -> DataFrame:
    """index (section_id, slot, ...) after moves."""
    return index.join(moves, ["section_id", "slot"], "left").withColumn("slot", F.coalesce("new_slot", "slot")).drop("new_slot")


def lookup(index: DataFrame, wanted: DataFrame, slots: DataFrame) -> DataFrame:
    """hash -> index entry -> slot -> data."""
    return wanted.join(index, "hash").join(slots, ["section_id", "slot"])


def capacity(count: Column, size: int, limit: int) -> Column:
    """The used share of a store's capacity, 1 at most."""
    return F.least(count * size / F.lit(float(limit)), F.lit(1.0))


def lru_hits(accesses: DataFrame, by: str, key: str, order: str, room: int) -> DataFrame:
    """(by, key, order, hit): whether the key was in its cache of room entries, which drops the least recently used one. A task holds one cache, not its log."""
    kinds = dict(accesses.dtypes)

    def start(_):
        return OrderedDict()

    def step(cache, row):
        hit = row[key] in cache
        cache[row[key]] = True
        cache.move_to_end(row[key])
        if len(cache) > room:
            cache.popitem(last=False)
        return cache, (row[by], row[key], row[order], hit)

    return folded(accesses.select(by, key, order), [by], [order, key], start, step, f"{by} {kinds[by]}, {key} {kinds[key]}, {order} {kinds[order]}, hit boolean")


def compared(a: Column, b: Column) -> Column:
    """-1, 0 or 1: two hit counters (struct of fib, count) by level, then by count."""
    key = lambda x: F.struct(x["fib"], x["count"])
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def ordered_checksum(index: DataFrame, order: list[str], *columns: str) -> DataFrame:
    """A checksum of the rows in their order. Each row's hash is weighted by its place, and places are counted by range parts, so no task sees all rows."""
    placed = numbered(index.select(*order, *(c for c in columns if c not in order)), order)
    mixed = F.xxhash64(F.xxhash64(*columns), F.col("turn"))
    return placed.agg(F.bit_xor(mixed).alias("checksum"), F.count("*").alias("entries"))


def slots_after(slots: DataFrame, writes: DataFrame, freed: DataFrame) -> DataFrame:
    """slots (section_id, slot, is_free, data) after writes (section_id, slot, data) and after freed ones (section_id, slot)."""
    key = ["section_id", "slot"]
    both = slots.join(writes.select(*key, F.col("data").alias("new"), F.lit(True).alias("put")), key, "full_outer").join(freed.select(*key, F.lit(True).alias("gone")), key, "left")
    data = F.when(F.col("gone"), None).when(F.col("put"), F.col("new")).otherwise(F.col("data"))
    free = F.when(F.col("gone"), True).when(F.col("put"), False).otherwise(F.col("is_free"))
    return both.select(*key, free.alias("is_free"), data.alias("data"))


def cache_put(index: DataFrame, slots: DataFrame, blocks: DataFrame, n: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(index, slots) after blocks (hash, data) were put: a hash that's there gets a hit, a new one the next free slot, in turn over n sections of size slots.

    index: hash, section_id, slot, hits. New blocks take places after the highest used ones.
    """
    fresh = written(blocks.join(index, "hash", "left_anti").dropDuplicates(["hash"]))
    hits = blocks.groupBy("hash").agg(F.count("*").alias("more"))
    known = index.join(hits, "hash", "left").select("hash", "section_id", "slot", (F.col("hits") + F.coalesce("more", F.lit(0))).alias("hits"))
    used = index.agg(F.coalesce(F.max(F.floor(F.col("section_id") / n) * size + F.col("slot") + 1), F.lit(0))).first()[0]
    placed = sections(fresh.select("hash"), ["hash"], n, size, int(used) * n)
    entries = placed.join(hits, "hash").select("hash", "section_id", "slot", F.col("more").alias("hits"))
    data = fresh.join(entries, "hash").select("section_id", "slot", F.lit(False).alias("is_free"), "data")
    return known.unionByName(entries.select(*known.columns)), slots.unionByName(data)


def cache_get(index: DataFrame, slots: DataFrame, wanted: DataFrame) -> DataFrame:
    """(hash, data) of the wanted hashes; null data where a hash or its slot isn't there."""
    held = slots.where(~F.col("is_free")).select("section_id", "slot", "data")
    return wanted.select("hash").distinct().join(index, "hash", "left").join(held, ["section_id", "slot"], "left").select("hash", "data")


def cache_remove(index: DataFrame, slots: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, slots) without the hashes in gone; their slots are free."""
    freed = index.join(gone.select("hash").distinct(), "hash", "left_semi").select("section_id", "slot")
    left = index.join(gone.select("hash"), "hash", "left_anti")
    return left, slots_after(slots, slots.limit(0).select("section_id", "slot", "data"), freed)
