"""Bytes: slices, bits, boolean operations, hashes. Columns in, columns out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType


def byte_slice(data: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end); null if the range is not within the data or is reversed."""
    fits = (start >= 0) & (start <= end) & (end <= F.octet_length(data))
    return F.when(fits, F.substr(data, (start + 1).cast("int"), (end - start).cast("int")))


def byte_at(data: Column, index: Column) -> Column:
    """The unsigned byte at index, null beyond the data."""
    return F.conv(F.hex(F.substr(data, (index + 1).cast("int"), F.lit(1))), 16, 10).cast("int")


def bit_at(data: Column, index: Column) -> Column:
    """Bit index of data, lowest bit of a byte first."""
    shift = F.pmod(index, F.lit(8)).cast("int")
    return F.floor(byte_at(data, F.floor(index / 8)) / F.pow(F.lit(2), shift)).cast("int") % 2


def byte_set(data: Column, index: Column, value: Column) -> Column:
    """data with the byte at index replaced by value (0 to 255); data beyond its end."""
    put = F.unhex(F.concat(F.substr(F.hex(data), F.lit(1), index * 2), F.lpad(F.hex(value.cast("long")), 2, "0"), F.substr(F.hex(data), index * 2 + 3, F.octet_length(data) * 2)))
    return F.when((index >= 0) & (index < F.octet_length(data)), put).otherwise(data)


def set_bits(positions: Column, size: int) -> Column:
    """The bitset (as '0'/'1' text, position 0 first) of size bits with the array's positions set; it grows to the largest one."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(size - 1), F.coalesce(F.array_max(positions), F.lit(0)))), lambda i: F.when(F.array_contains(positions, i), "1").otherwise("0")), "")


def _padded(parts: list[bytes]) -> np.ndarray:
    wide = max(map(len, parts), default=0)
    return np.stack([np.frombuffer(p.ljust(wide, b"\0"), np.uint8) for p in parts])


def xored(parts: list[bytes]) -> bytes:
    return np.bitwise_xor.reduce(_padded(parts)).tobytes()


@F.pandas_udf(BinaryType())
def xor_array(data: pd.Series) -> pd.Series:
    """Exclusive or of an array's byte strings; shorter ones count as filled up with zeros. Null for an empty or null array, or one that holds a null."""
    return data.map(lambda x: None if x is None or not len(x) or any(d is None for d in x) else xored([bytes(d) for d in x]))


def xor_all(data: Column) -> Column:
    """xor_array over a group's rows, null if one is null. Order doesn't matter."""
    return F.when(F.count("*") == F.count(data), xor_array(F.collect_list(data)))


def _pairwise(name: str, how):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else how(_padded([bytes(x), bytes(y)])).tobytes() for x, y in zip(a, b, strict=True)])

    run.__name__ = name
    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, BinaryType())


xor = _pairwise("xor", lambda m: m[0] ^ m[1])
bit_or = _pairwise("bit_or", lambda m: m[0] | m[1])
bit_and = _pairwise("bit_and", lambda m: m[0] & m[1])


@F.pandas_udf(BinaryType())
def bit_not(a: pd.Series) -> pd.Series:
    return a.map(lambda x: None if x is None else (~np.frombuffer(bytes(x), np.uint8)).tobytes())


@F.pandas_udf(LongType())
def xxh3(data: pd.Series, seed: pd.Series) -> pd.Series:
    """XXH3 of 64 bits, as a signed long."""
    import xxhash

    return pd.Series([None if d is None else np.uint64(xxhash.xxh3_64_intdigest(bytes(d), int(s))).astype(np.int64) for d, s in zip(data, seed, strict=True)], dtype="Int64")


def content_hash(data: Column) -> Column:
    """The 32-byte identity of a block: SHA-256 (BLAKE3 has the same width but no Spark expression)."""
    return F.unhex(F.sha2(data, 256))


@F.pandas_udf(LongType())
def xxh32(data: pd.Series, seed: pd.Series) -> pd.Series:
    """XXH32, as a long."""
    import xxhash

    return pd.Series([None if d is None else xxhash.xxh32_intdigest(bytes(d), int(s)) for d, s in zip(data, seed, strict=True)], dtype="Int64")


@F.pandas_udf(LongType())
def tuple_hash(hashes: pd.Series) -> pd.Series:
    """The times-33 hash, from 5381 on, over the bytes of an array of hashes, null ones left out; 64 bits, as a signed long."""

    def one(x) -> int | None:
        if x is None:
            return None
        h = 5381
        for byte in b"".join(bytes(d) for d in x if d is not None):
            h = h * 33 + byte & 0xFFFFFFFFFFFFFFFF
        return h - (1 << 64) if h >> 63 else h

    return pd.Series([one(x) for x in hashes], dtype="Int64")


def node_hash(node_id: Column) -> Column:
    """The first eight bytes of a node id as a number (high half, low half kept within a long)."""
    return F.conv(F.hex(F.substr(node_id, F.lit(1), F.lit(8))), 16, -10).cast("long")
