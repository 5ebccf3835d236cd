"""CBOR (RFC 8949) values, and the directory document: entries of files and directories as one byte string."""

from __future__ import annotations

import struct
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType, StructField, StructType

#: A directory's entries: files have all but dir_hash, directories a name and dir_hash.
_KINDS = {"name": StringType(), "is_dir": BooleanType()} | {f"{n}_hash": BinaryType() for n in ("dir", "file", "descriptor")} | {n: LongType() for n in ("final_byte", "block_type", "tuple_size", "file_offset")}
FIELDS = tuple(_KINDS)
ENTRY = StructType([StructField(n, t) for n, t in _KINDS.items()])
#: The keys of a document and its entries, by our names, in their order; the version.
VERSION_KEY, ENTRIES_KEY, VERSION = "v", "entries", 1
FILE_KEYS = {"name": "n", "is_dir": "t", "file_hash": "f", "descriptor_hash": "D", "final_byte": "s", "block_type": "B", "tuple_size": "T", "file_offset": "o"}
DIRECTORY_KEYS = {"name": "n", "is_dir": "t", "dir_hash": "d"}


class Wide(int):
    """A number that takes eight bytes however small it is."""


class Open(list):
    """An array whose length isn't written before it."""


def _head(kind: int, n: int) -> bytes:
    if n < 24:
        return bytes([kind << 5 | n])
    for code, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << 8 * size:
            return bytes([kind << 5 | code]) + n.to_bytes(size, "big")
    raise ValueError(f"{n} doesn't fit into eight bytes")


def dumps(value: Any) -> bytes:
    if value is None:
        return b"\xf6"
    if isinstance(value, bool):
        return b"\xf5" if value else b"\xf4"
    if isinstance(value, Wide):
        return b"\x1b" + int(value).to_bytes(8, "big")
    if isinstance(value, int):
        return _head(0, value) if value >= 0 else _head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, bytes | bytearray):
        return _head(2, len(value)) + bytes(value)
    if isinstance(value, str):
        return _head(3, len(b := value.encode())) + b
    if isinstance(value, Open):
        return b"\x9f" + b"".join(map(dumps, value)) + b"\xff"
    if isinstance(value, list | tuple):
        return _head(4, len(value)) + b"".join(map(dumps, value))
    if isinstance(value, dict):
        return _head(5, len(value)) + b"".join(dumps(k) + dumps(v) for k, v in value.items())
    raise TypeError(f"no CBOR for {type(value).__name__}")


_END = object()


def _load(data: bytes, at: int) -> tuple[Any, int]:
    first = data[at]
    kind, low = first >> 5, first & 31
    at += 1
    if first == 0xFF:
        return _END, at
    if kind == 7:
        if low in (20, 21, 22, 23):
            return {20: False, 21: True}.get(low), at
        size = {25: 2, 26: 4, 27: 8}[low]
        return struct.unpack({2: ">e", 4: ">f", 8: ">d"}[size], data[at : at + size])[0], at + size
    if low < 24:
        n: int | None = low
    elif low < 28:
        size = 1 << low - 24
        if at + size > len(data):
            raise ValueError("cut off")
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
    elif low == 31 and kind in (2, 3, 4, 5):
        n = None
    else:
        raise ValueError("no such length")
    if kind < 2:
        return (n if kind == 0 else -1 - n), at
    if kind in (2, 3) and n is not None:
        if at + n > len(data):
            raise ValueError("cut off")
        raw = bytes(data[at : at + n])
        return (raw if kind == 2 else raw.decode()), at + n
    if kind == 6:
        return _load(data, at)
    items: list[Any] = []
    while n is None or len(items) < n * (2 if kind == 5 else 1):
        item, at = _load(data, at)
        if item is _END:
            break
        items.append(item)
    if kind in (2, 3):
        return (b"" if kind == 2 else "").join(items), at
    return (items if kind == 4 else dict(zip(items[::2], items[1::2], strict=True))), at


def loads(data: bytes) -> Any:
    """The value; ValueError where data is no CBOR, or has more than one value."""
    try:
        value, at = _load(bytes(data), 0)
    except (IndexError, KeyError, UnicodeDecodeError, struct.error, TypeError) as x:
        raise ValueError("no CBOR") from x
    if at != len(data) or value is _END:
        raise ValueError("no CBOR")
    return value


def _written(entry: Any) -> dict[str, Any]:
    keys = DIRECTORY_KEYS if entry["is_dir"] else FILE_KEYS
    out: dict[str, Any] = {}
    for name, key in keys.items():
        value = entry[name]
        if name == "is_dir":
            value = int(bool(value))
        elif name in ("final_byte", "block_type", "tuple_size", "file_offset"):
            value = Wide(value)
        elif name.endswith("hash"):
            if value is None and name == "descriptor_hash":
                continue
            value = bytes(value)
        out[key] = value
    return out


def _read(entry: dict[str, Any]) -> dict[str, Any]:
    is_dir = bool(entry["t"])
    out = {name: entry.get(key) for name, key in (DIRECTORY_KEYS if is_dir else FILE_KEYS).items()}
    return out | {"is_dir": is_dir}


def directory(entries: list[Any]) -> bytes:
    return dumps({VERSION_KEY: VERSION, ENTRIES_KEY: Open(map(_written, entries))})


def entries(data: bytes | None) -> list[dict[str, Any]] | None:
    """A directory's entries; None where data is no map (an older JSON document, say) or no CBOR."""
    if not data or bytes(data[:1])[0] >> 5 != 5:
        return None
    try:
        return [_read(e) for e in loads(bytes(data))[ENTRIES_KEY]]
    except (ValueError, KeyError, TypeError):
        return None


@F.pandas_udf(BinaryType())
def directory_document(entries: pd.Series) -> pd.Series:
    """A column of arrays of ENTRY as directory documents."""
    return entries.map(lambda x: None if x is None else directory(list(x)))


@F.pandas_udf(ArrayType(ENTRY))
def directory_entries(data: pd.Series) -> pd.Series:
    """The entries of directory documents, null where a document can't be read."""
    read = lambda d: None if d is None else entries(bytes(d))
    return data.map(lambda d: None if (found := read(d)) is None else [{f: e.get(f) for f in FIELDS} for e in found])
