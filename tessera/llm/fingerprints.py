"""Document fingerprints by winnowing. DataFrame operations only.

The grams are runs of ``k`` words; a gram's rolling hash is the cyclic polynomial of its
words' hashes, and the hashes at all positions come from those of half the length.
Of every ``window`` consecutive gram hashes the smallest is selected,
of equal ones the rightmost, and kept with its position. So two texts that share
``window + k - 1`` words in a row share a selected gram, and runs of fewer than k words
give none. The window minima come from doubling: minima over 2, 4, 8 grams.

A text with fewer than k words has one gram, all its words; one without words has
none. The likeness of two fingerprints is the Jaccard index of their gram hashes, and
1 if both are empty. Null text counts as empty. Repeated ids are ordered by text,
so that each row has one next row; null ids come after all others. The last row's next is the first
one; a table of one row has itself next. Texts of any length are fingerprinted whole. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import text_of

#: Rows to a part of the table in which a row finds the next one, on average; parts at most (beyond that they grow); bytes of text to a task.
PART, PARTS, TASK = 256, 16_384, 32 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by % 64 else x


def rolling(h: Column, k: int) -> Column:
    """The cyclic polynomial hash (rotate, then xor) of every k consecutive entries of h, which has k entries at least."""

    def joined(left: Column, right: Column, reach: int, more: int) -> Column:
        """Of reach + more entries: left hashes reach of them, right more of them."""
        n = F.size(right) - reach
        return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(reach + 1), n), lambda a, b: _rotated(a, more).bitwiseXOR(b))

    def doubled(power: Column, size: int, got: Column | None, reach: int) -> Column:
        """power hashes size entries, got the reach entries that k's lower bits ask for."""
        if k & size:
            got, reach = (power, size) if got is None else (joined(power, got, size, reach), reach + size)
        if size * 2 > k:
            return got
        if got is None or not k & size:
            return let(joined(power, power, size, size), lambda p: doubled(p, size * 2, got, reach))
        return let(got, lambda g: let(joined(power, power, size, size), lambda p: doubled(p, size * 2, g, reach)))

    return doubled(h, 1, None, 0)


def selected(text: Column, k: int = 5, window: int = 8) -> Column:
    """Array of longs: for each selected gram its 31-bit hash, shifted left by 32, plus its position counted from 2^32 - 1 down."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def grams(h: Column) -> Column:
        short = F.transform(F.slice(h, F.lit(1), F.least(F.size(h), F.lit(1))), lambda _: F.aggregate(h, F.lit(0).cast("long"), lambda got, x: _rotated(got, 1).bitwiseXOR(x)))
        rolled = F.when(F.size(h) >= k, rolling(h, k)).otherwise(short)
        return F.transform(rolled, lambda g, i: F.shiftleft(F.shiftrightunsigned(g, 33), 32) + (F.lit(0xFFFFFFFF) - i))

    def minima(m: Column, reach: int, left: int) -> Column:
        """Minima over `reach` entries already stand in m; left more are wanted."""
        if not left:
            return m
        step = min(reach, left)
        shifted = lambda a: F.slice(a, F.lit(step + 1), F.greatest(F.size(a) - step, F.lit(0)))
        # where the shifted array ends the entry is null, and least() leaves nulls out
        return let(F.zip_with(m, shifted(m), lambda a, b: F.least(a, b)), lambda x: minima(x, reach + step, left - step))

    def windows(g: Column) -> Column:
        # entries past the last whole window are minima over fewer grams: only a text shorter than one window needs the first of them
        full = let(minima(g, 1, window - 1), lambda m: F.slice(m, F.lit(1), F.greatest(F.size(m) - (window - 1), F.least(F.size(m), F.lit(1)))))
        return F.array_distinct(full)

    return let(hashes, lambda h: let(grams(h), windows))


def gram_hashes(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftrightunsigned(x, 32).cast("int")))


def positions(chosen: Column) -> Column:
    """The positions (in words, from 0) of the selected grams."""
    return F.transform(chosen, lambda x: (F.lit(0xFFFFFFFF) - x.bitwiseAND(F.lit(0xFFFFFFFF))).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    return let(both.cast("double"), lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))


def digest(chosen: Column) -> Column:
    """A fingerprint as a string: the MD5 of the selected grams and positions."""
    return F.md5(F.array_join(chosen.cast("array<string>"), ","))


def winnowed(df: DataFrame, k: int = 5, window: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, grams (array of struct hash int, position int: the selected grams in order) of every row: what two texts share they share here."""
    entry = lambda x: F.struct(F.shiftrightunsigned(x, 32).cast("int").alias("hash"), (F.lit(0xFFFFFFFF) - x.bitwiseAND(F.lit(0xFFFFFFFF))).cast("int").alias("position"))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.transform(selected(text_of(text_col), k, window), entry).alias("grams"))


def part_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds don't exceed value, by binary search; -1 for null."""
    if not bounds:
        return F.when(value.isNull(), -1).otherwise(0)
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]

    def search(table: Column, at: Column, left: list[int]) -> Column:
        if not left:
            return at
        to = at + left[0]
        return let(F.when((to <= len(bounds)) & (F.get(table, to - 1) <= value), to).otherwise(at), lambda x: search(table, x, left[1:]))

    found = let(F.from_json(F.lit(json.dumps(bounds)), "array<bigint>"), lambda table: search(table, F.lit(0), steps))
    return F.when(value.isNull(), -1).otherwise(found)


def fingerprint_pairs(df: DataFrame, k: int = 5, window: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = min(PARTS, max(1, n // PART))
    shares = ", ".join(f"{i / parts}D" for i in range(1, parts))
    cuts = f"percentile_approx(doc_id, array({shares}), {20 * parts})" if parts > 1 else "array()"
    bounds = sorted(set(rows.agg(F.expr(cuts)).first()[0] or []))
    keyed = rows.withColumn("part", part_of(F.col("doc_id"), bounds))
    # The first row of each part (largest id, then smallest text) goes also to the part that comes before it by descending id. PARTS + 1 rows at most.
    heads = sorted(((r["part"], r["head"]) for r in keyed.groupBy("part").agg(F.max("doc_id").alias("head")).collect()), reverse=True)
    sent = [{"before": part, "head": heads[(i + 1) % len(heads)][1]} for i, (part, _) in enumerate(heads)]
    sent = df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(sent)), "array<struct<before:int,head:bigint>>")))
    own = keyed.withColumn("guest", F.lit(False))
    guests = rows.join(F.broadcast(sent), rows.doc_id.eqNullSafe(sent["head"])).select("doc_id", "text", F.col("before").alias("part"), F.lit(True).alias("guest"))
    w = Window.partitionBy("part").orderBy(F.asc("guest"), F.desc("doc_id"), F.asc("text"))
    chosen = own.unionByName(guests).withColumn("chosen", selected(F.col("text"), k, window))
    chosen = chosen.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(parts, size // TASK)), "part")
    led = chosen.select("doc_id", "text", "guest", "chosen", F.lead("text").over(w).alias("next_text"), F.lead("chosen").over(w).alias("next_chosen")).where("not guest")
    n_chars = F.length("text")
    moved = F.floor(n_chars / 3).cast("int")
    led = led.withColumn("edited", F.concat(F.substr("text", F.lit(1), n_chars - moved), F.substr("next_text", F.lit(1), moved)))
    led = led.withColumn("edited_chosen", selected(F.col("edited"), k, window))
    sets = led.withColumn("own_set", gram_hashes(F.col("chosen")))
    return sets.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        digest(F.col("chosen")).alias("fingerprint"),
        digest(F.col("edited_chosen")).alias("edited_fingerprint"),
        likeness(F.col("own_set"), gram_hashes(F.col("edited_chosen"))).alias("near_edited"),
        likeness(F.col("own_set"), gram_hashes(F.col("next_chosen"))).alias("near_next"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
