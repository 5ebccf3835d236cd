"""Blocks and tuples: cutting files into blocks, encoding them with pads, descriptors, decoding, range reads, estimates, donors.

A file of tuple size k is kept as, for each of its blocks, k - 1 pads and the exclusive or of them all with the block. All
names of blocks are hashes of their contents. Encoding makes a file's blocks where the file lies: nothing but hashes shuffles.
Reading asks for the tuples that a range needs and no others, and fetches their blocks by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tessera.functions.bytes_ import content_hash, xor_array
from tessera.shared import split, written

#: Block sizes in bytes, the width of a hash.
SIZES = {"mega": 1_000_000, "standard": 128_000, "mini": 64_000, "nano": 136}
HASH = 32
ZERO = "00" * HASH


def blockify(files: DataFrame, size: int, id_col: str = "file_id", data_col: str = "content") -> DataFrame:
    """(file_id, no, data) of every block; the last one may be short. An empty file has none."""
    n = F.ceil(F.octet_length(data_col) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(F.col(data_col), i * size + 1, F.lit(size)))
    return files.where(F.octet_length(data_col) > 0).select(F.col(id_col).alias("file_id"), F.posexplode(cut).alias("no", "data"))


def pad(seed: int, key: str, size: int) -> bytes:
    """size bytes that look random and depend on seed and key alone, so that a task that runs again makes them again."""
    return hashlib.shake_128(f"{seed}/{key}".encode()).digest(size)


def pads(key: Column, seed: int, size: int) -> Column:
    """pad() of every row."""

    @F.pandas_udf(BinaryType())
    def made(k: pd.Series) -> pd.Series:
        return k.map(lambda x: pad(seed, x, size))

    return made(key.cast("string"))


def padded(data: Column, key: Column, size: int, seed: int = 1) -> Column:
    """data filled up to size with pad bytes."""
    return F.substr(F.concat(data, pads(key, seed, size)), F.lit(1), F.lit(size))


def deduplicated(blocks: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row (hash, data) per content, without those whose hash is stored already."""
    fresh = blocks.select(content_hash(F.col("data")).alias("hash"), "data").dropDuplicates(["hash"])
    return fresh.join(stored.select("hash"), "hash", "left_anti") if stored is not None else fresh


def damaged(blocks: DataFrame) -> DataFrame:
    """Blocks whose data isn't what their hash says."""
    return blocks.where(content_hash(F.col("data")) != F.col("hash"))


def rotated(*sources: DataFrame) -> DataFrame:
    """Blocks of several sources in the order in which they are drawn: all of the first, then of the next. Sources: (no, hash, data)."""
    ranked = [s.select(F.lit(i).alias("source"), "no", "hash", "data") for i, s in enumerate(sources)]
    out = ranked[0]
    for r in ranked[1:]:
        out = out.unionByName(r)
    return out.where(F.hex("hash") != ZERO)


def recycled(descriptor: DataFrame) -> DataFrame:
    """The order in which a donor's blocks are reused: pads of every tuple first, then the last hashes of the tuples but the final one. descriptor: (file_id, tuple_no, pos, hash)."""
    of_tuple = Window.partitionBy("file_id", "tuple_no")
    of_file = Window.partitionBy("file_id")
    seen = descriptor.withColumn("back", F.col("pos") == F.max("pos").over(of_tuple)).withColumn("end", F.max("tuple_no").over(of_file))
    seen = seen.where((F.hex("hash") != ZERO) & ~(F.col("back") & (F.col("tuple_no") == F.col("end"))))
    return seen.withColumn("draw", F.row_number().over(of_file.orderBy("back", "tuple_no", "pos"))).select("file_id", "draw", "hash")


def filled(head: bytes, fill: list[dict] | None, size: int) -> bytes:
    """The block that is kept as head and fill: head, then the exclusive or of the pads named in fill, each from its byte skip on."""
    n = size - len(head)
    tails = [np.frombuffer(hashlib.shake_128(f["name"].encode()).digest(f["skip"] + n)[f["skip"] :], np.uint8) for f in fill or []]
    return head + np.bitwise_xor.reduce(tails).tobytes() if tails and n > 0 else head


def opened(blocks: DataFrame, size: int) -> DataFrame:
    """(hash, data) of packed blocks (hash, head, fill)."""

    @F.arrow_udf(BinaryType())
    def made(head: pa.Array, fill: pa.Array) -> pa.Array:
        return pa.array([filled(h, f, size) for h, f in zip(head.to_pylist(), fill.to_pylist(), strict=True)], pa.binary())

    return blocks.select("hash", made("head", "fill").alias("data"))


FILL = pa.list_(pa.struct([("name", pa.string()), ("skip", pa.int32())]))


def stored_blocks(files: DataFrame, size: int, tuple_size: int = 3, seed: int = 7) -> DataFrame:
    """(file_id, tuple_no, pos, hash, head, fill): every block that stands for files (file_id, content), packed. A row makes its own: no shuffle. Null and empty files have none.

    A pad is kept as what it is made from; a tuple's last block as its bytes up to the file's end, those beyond it are pads too. Hashes are those of whole blocks.
    """
    kind = dict(files.dtypes)["file_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file_id", "tuple_no", "pos", "hash", "head", "fill"]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), FILL)
        for batch in batches:
            for i in range(batch.num_rows):
                key, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer()
                content = content.to_pybytes() if content else b""
                rows: list[tuple] = []
                for no, at in enumerate(range(0, len(content), size)):
                    block = content[at : at + size]
                    own = len(block)
                    block += pad(1, f"{key}/{no}", size)[: size - own]
                    others = [pad(seed, f"{key}/{no}/{k}", size) for k in range(tuple_size - 1)]
                    last = np.bitwise_xor.reduce([np.frombuffer(x, np.uint8) for x in (*others, block)]).tobytes()
                    named = [f"{seed}/{key}/{no}/{k}" for k in range(tuple_size - 1)]
                    rows += [(no, k, hashlib.sha256(x).digest(), b"", [{"name": n, "skip": 0}]) for k, (x, n) in enumerate(zip(others, named, strict=True))]
                    tail = [{"name": f"1/{key}/{no}", "skip": 0}, *({"name": n, "skip": own} for n in named)] if own < size else []
                    rows.append((no, tuple_size - 1, hashlib.sha256(last).digest(), last[:own], tail))
                    if len(rows) * size >= 16 << 20 or at + size >= len(content):
                        first = pa.array([key] * len(rows), batch.column(0).type)
                        yield pa.RecordBatch.from_arrays([first, *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)
                        rows = []

    return files.select("file_id", F.col("content").cast("binary")).mapInArrow(run, f"file_id {kind}, tuple_no int, pos int, hash binary, head binary, fill array<struct<name:string,skip:int>>")


def named(rows: DataFrame, id_col: str, data_col: str) -> tuple[DataFrame, bool]:
    """(rows with a file_id that is never null and stands for one content only, whether rows may share it).

    It is id_col itself where no two rows share one and none is null. Else it is a text of id_col and the content's hash: rows that share both are copies of one file.
    """
    ids = rows.groupBy(id_col).agg(F.count("*").alias("n"))
    if ids.where((F.col("n") > 1) | F.col(id_col).isNull()).isEmpty():
        return rows.withColumn("file_id", F.col(id_col)), False
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("/"), F.coalesce(F.sha2(data_col, 256), F.lit("")))
    return rows.withColumn("file_id", name), True


def encode(files: DataFrame, size: int, tuple_size: int = 3, seed: int = 7, packed: bool = False, kept: bool = True, copies: bool = False) -> tuple[DataFrame, DataFrame]:
    """(blocks: hash, data, or hash, head, fill if packed; tuples: file_id, tuple_no, pos, hash) of files (file_id, content). blocks may hold a block as often as it was made.

    Not kept: blocks are no written table; whoever reads them makes them again out of files, always the same. Copies: files may hold a
    file more than once, with the same content; its tuples are given once.
    """
    made = stored_blocks(files, size, tuple_size, seed)
    if kept:
        made = written(made)
    tuples = made.select("file_id", "tuple_no", "pos", "hash")
    if copies:
        tuples = tuples.dropDuplicates(["file_id", "tuple_no", "pos"])
    return made.select("hash", "head", "fill") if packed else opened(made, size), tuples if kept else written(tuples)


def decode(tuples: DataFrame, blocks: DataFrame, by: tuple[str, ...] = ("file_id",), size: int = 0) -> DataFrame:
    """(by, tuple_no, data): the origin blocks; null data where a block of the tuple is missing. tuples: by, tuple_no, pos, hash. blocks: hash, data, or packed ones of the given size."""
    if "fill" in blocks.columns:
        return _decode_packed(tuples, blocks, by, size)
    got = tuples.join(blocks.select("hash", "data"), "hash", "left").repartition(*by, "tuple_no").groupBy(*by, "tuple_no", "pos").agg(F.first("data").alias("data"))  # a block may be stored twice
    got = got.groupBy(*by, "tuple_no").agg(F.collect_list("data").alias("parts"), F.count("*").alias("n"))
    return got.select(*by, "tuple_no", F.when(F.size("parts") == F.col("n"), xor_array(F.col("parts"))).alias("data"))


def _decode_packed(tuples: DataFrame, blocks: DataFrame, by: tuple[str, ...], size: int) -> DataFrame:
    """decode() of packed blocks. Blocks without a head (all pad) are small, so they go to their tuples first; a tuple with one other block is decoded where that one lies, so its bytes shuffle once."""

    @F.arrow_udf(BinaryType())  # lists of lists of unequal lengths don't become pandas' values
    def made(heads: pa.Array, fills: pa.Array, small: pa.Array) -> pa.Array:
        out = []
        for hs, fs, more in zip(heads.to_pylist(), fills.to_pylist(), small.to_pylist(), strict=True):
            parts = [filled(h, f, size) for h, f in zip(hs, fs, strict=True)] + [filled(b"", f, size) for f in more]
            out.append(np.bitwise_xor.reduce([np.frombuffer(x, np.uint8) for x in parts]).tobytes() if parts else None)
        return pa.array(out, pa.binary())

    is_small = F.octet_length("head") == 0
    light = blocks.where(is_small).groupBy("hash").agg(F.first("fill").alias("fill"))
    large = blocks.where(~is_small).groupBy("hash").agg(F.first("head").alias("head"), F.first("fill").alias("fill"))
    met = tuples.join(light, "hash", "left").groupBy(*by, "tuple_no").agg(F.collect_list("fill").alias("small"), F.collect_list(F.when(F.col("fill").isNull(), F.col("hash"))).alias("rest"))
    met = written(met)
    data = lambda heads, fills, there: F.when(there, made(heads, fills, F.col("small"))).alias("data")
    no_fills = F.lit(None).cast("array<array<struct<name:string,skip:int>>>")
    none = met.where(F.size("rest") == 0).select(*by, "tuple_no", data(F.array().cast("array<binary>"), F.coalesce(no_fills, F.array()), F.lit(True)))
    one = met.where(F.size("rest") == 1).withColumn("hash", F.get("rest", F.lit(0))).join(large, "hash", "left")
    there = F.col("head").isNotNull()
    one = one.select(*by, "tuple_no", data(F.when(there, F.array("head")).otherwise(F.array().cast("array<binary>")), F.when(there, F.array("fill")).otherwise(F.array()), there))
    out = none.unionByName(one)
    several = met.where(F.size("rest") > 1)
    if several.isEmpty():
        return out
    parts = several.select(*by, "tuple_no", "small", F.posexplode("rest").alias("at", "hash")).join(large, "hash", "left").groupBy(*by, "tuple_no").agg(F.first("small").alias("small"), F.collect_list("head").alias("heads"), F.collect_list(F.when(F.col("head").isNotNull(), F.col("fill"))).alias("fills"), F.count("*").alias("n"))
    return out.unionByName(parts.select(*by, "tuple_no", data(F.col("heads"), F.col("fills"), F.size("heads") == F.col("n"))))


def wanted(tuples: DataFrame, ranges: DataFrame, size: int, by: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """The tuples that hold some of the bytes [start, end) of ranges (by, start, end), with these two."""
    near = (F.col("tuple_no") >= F.floor(F.col("start") / size)) & (F.col("tuple_no") * size < F.col("end"))
    return tuples.join(ranges, list(by)).where(near)


def joined(decoded: DataFrame, size: int, by: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """(by, content): bytes [start, end) out of decoded tuples (by, start, end, tuple_no, data); null content where a tuple's data is missing."""
    begin = F.greatest(F.col("start") - F.col("tuple_no") * size, F.lit(0))
    stop = F.least(F.col("end") - F.col("tuple_no") * size, F.lit(size))
    cut = decoded.withColumn("part", F.substr("data", (begin + 1).cast("int"), (stop - begin).cast("int")))
    parts = cut.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("tuple_no", "part"))).alias("parts"), F.count_if(F.col("data").isNull()).alias("lost"))
    whole = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["part"])), ""))
    return parts.select(*by, F.when(F.col("lost") == 0, whole).alias("content"))


def read_range(tuples: DataFrame, blocks: DataFrame, ranges: DataFrame, size: int) -> DataFrame:
    """(file_id, content): bytes [start, end) of each file. ranges: file_id, start, end. Blocks of tuples outside the range are never fetched; an empty range has no row."""
    by = ("file_id", "start", "end")
    return joined(decode(wanted(tuples, ranges, size).select(*by, "tuple_no", "pos", "hash"), blocks, by, size), size, by).select("file_id", "content")


def cut_point(size: int) -> int:
    """Bytes of whole hashes in a descriptor block."""
    return size // HASH * HASH


def described(tuples: DataFrame, size: int, seed: int = 7, packed: bool = False) -> DataFrame:
    """(file_id, chunk_no, hash, data; head, fill in its place if packed): each file's descriptor as blocks. A block holds hashes of the file's tuples in order and, if others follow, the next block's hash at its end; it is filled up with pad.

    A chain is made from its end, so one task makes a file's chain; it holds the file's hashes, not its blocks.
    """
    kind = dict(tuples.dtypes)["file_id"]
    room = cut_point(size) // HASH
    names, kinds = (["head", "fill"], (pa.binary(), FILL)) if packed else (["data"], (pa.binary(),))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("tuple_no", "ascending"), ("pos", "ascending")])
        hashes = rows["hash"].to_pylist()
        starts = [0]
        while len(hashes) - starts[-1] > room:  # a block that isn't the last gives one place to the next one's hash
            starts.append(starts[-1] + room - 1)
        out, after = [], None
        for no in range(len(starts) - 1, -1, -1):
            end = starts[no + 1] if no + 1 < len(starts) else len(hashes)
            held = b"".join(hashes[starts[no] : end]) + (after or b"")
            data = held + pad(seed, f"{key[0]}/descriptor/{no}", size)[: size - len(held)]
            after = hashlib.sha256(data).digest()
            out.append((no, after, held, [{"name": f"{seed}/{key[0]}/descriptor/{no}", "skip": 0}]) if packed else (no, after, data))
        return pa.table([pa.array([key[0].as_py() if hasattr(key[0], "as_py") else key[0]] * len(out), rows.schema.field("file_id").type), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), *kinds), strict=True))], ["file_id", "chunk_no", "hash", *names])

    return tuples.groupBy("file_id").applyInArrow(run, f"file_id {kind}, chunk_no int, hash binary, {'head binary, fill array<struct<name:string,skip:int>>' if packed else 'data binary'}")


def followed(heads: DataFrame, blocks: DataFrame, size: int, tuple_size: int = 3, by: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """(by, tuple_no, pos, hash) out of descriptor chains. heads: by, hash (of the first descriptor block), tuples (how many the file has), first, last (tuples wanted).

    A round fetches one block of every chain and is a written table; a chain ends at the last tuple wanted, and hashes before the first are dropped.
    A chain whose next block isn't there ends there.
    """
    room = cut_point(size) // HASH
    names = [*by, "tuples", "first", "last"]
    now = written(heads.where(F.col("last") >= F.col("first")).select(*names, "hash", F.lit(0).cast("long").alias("at")))
    found = None
    while not now.isEmpty():
        left = F.col("tuples") * tuple_size - F.col("at")  # hashes from here on
        held = F.when(left > room, room - 1).otherwise(left).cast("int")
        hash_at = lambda i: F.substr(F.col("data"), i * HASH + 1, F.lit(HASH))
        near = split(blocks.select("hash", F.col("head").alias("data")), now, ["hash"])[0] if "fill" in blocks.columns else blocks.select("hash", "data")  # a head holds all hashes of a descriptor block
        got = written(now.join(near, "hash").dropDuplicates([*by]).withColumn("n", held).select(*names, "at", "n", F.transform(F.sequence(F.lit(0), held - 1), hash_at).alias("hashes"), F.when(left > room, hash_at(F.lit(room - 1))).alias("after")))
        flat = got.select(*names, "at", F.posexplode("hashes").alias("i", "hash")).withColumn("place", F.col("at") + F.col("i"))
        flat = flat.withColumn("tuple_no", F.floor(F.col("place") / tuple_size)).where(F.col("tuple_no").between(F.col("first"), F.col("last")))
        flat = flat.select(*by, F.col("tuple_no").cast("int").alias("tuple_no"), (F.col("place") % tuple_size).cast("int").alias("pos"), "hash")
        found = flat if found is None else found.unionByName(flat)
        more = F.col("after").isNotNull() & ((F.col("at") + F.col("n")) <= F.col("last") * tuple_size + tuple_size - 1)
        now = written(got.where(more).select(*names, F.col("after").alias("hash"), (F.col("at") + F.col("n")).alias("at")))
    return found if found is not None else now.select(*by, F.lit(0).alias("tuple_no"), F.lit(0).alias("pos"), "hash")


def put(files: DataFrame, size: int = SIZES["standard"], tuple_size: int = 3, free: int | None = None, seed: int = 7, packed: bool = False, kept: bool = True, copies: bool = False) -> tuple[DataFrame, DataFrame]:
    """Stores files (file_id, content): (blocks: as encode() gives them; resources: file_id, outcome, length, file_hash, descriptor_hash, a row for each of files).

    A file whose blocks would take more than free bytes is refused ("full"), the others are "stored"; each is judged by itself.
    An empty or null file has no blocks and no descriptor.
    """
    sized = files.select("file_id", F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content")).withColumn("length", F.octet_length("content").cast("long"))
    fits = F.lit(True) if free is None else put_bytes(F.col("length"), tuple_size, size) <= free
    stored, tuples = encode(sized.where(fits).select("file_id", "content"), size, tuple_size, seed, packed, kept, copies)
    chain = written(described(tuples, size, seed, packed))
    names = sized.select("file_id", F.when(fits, "stored").otherwise("full").alias("outcome"), "length", F.when(fits, content_hash(F.col("content"))).alias("file_hash"))
    heads = chain.where("chunk_no = 0").select("file_id", F.col("hash").alias("descriptor_hash"))
    return stored.unionByName(chain.select(*stored.columns)), names.join(heads, "file_id", "left")


def get(requests: DataFrame, blocks: DataFrame, size: int = SIZES["standard"], tuple_size: int = 3) -> DataFrame:
    """(request, content, intact) of requests (request, length, file_hash, descriptor_hash, start, end): bytes [start, end), end cut to the length.

    Descriptors are followed to the last tuple needed, and only blocks of tuples in the range are fetched. content is null where a block is
    missing. intact: for whole files, whether the content has the file's hash; null for parts.
    """
    asked = requests.select("request", "length", "file_hash", "descriptor_hash", F.greatest(F.col("start"), F.lit(0)).cast("long").alias("start"), F.least(F.col("end"), F.col("length")).cast("long").alias("end"))
    asked = written(asked)
    some = asked.where(F.col("start") < F.col("end"))
    by = ("request", "start", "end")
    heads = some.select(*by, F.col("descriptor_hash").alias("hash"), F.ceil(F.col("length") / size).alias("tuples"), F.floor(F.col("start") / size).alias("first"), F.floor((F.col("end") - 1) / size).alias("last"))
    content = joined(decode(followed(heads, blocks, size, tuple_size, by), blocks, by, size), size, by)
    back = asked.join(content.select("request", "content", F.octet_length("content").alias("n")), "request", "left")
    content = F.when(F.col("start") >= F.col("end"), F.lit(b"")).when(F.col("n") == F.col("end") - F.col("start"), F.col("content"))
    whole = (F.col("start") == 0) & (F.col("end") == F.col("length"))
    return back.select("request", content.alias("content"), "file_hash", whole.alias("whole")).select("request", "content", F.when(F.col("whole"), F.coalesce(content_hash(F.col("content")) == F.col("file_hash"), F.lit(False))).alias("intact"))


def put_bytes(length: Column, tuple_size: int = 3, size: int = SIZES["standard"]) -> Column:
    """Bytes that storing a file takes: whole blocks for its tuples and its descriptor."""
    data = F.ceil(length / size)
    described = F.ceil(data * tuple_size * HASH / (cut_point(size) - HASH))
    return F.when(length > 0, (data * tuple_size + described) * size).otherwise(0).cast("long")


def donor_blocks(length: Column, tuple_size: int = 3, size: int = SIZES["standard"]) -> Column:
    """Blocks that a file offers for reuse: its data and descriptor blocks."""
    data = F.ceil(length / size)
    return F.when(length > 0, data + F.ceil(data * HASH * tuple_size / (cut_point(size) - HASH))).otherwise(0).cast("long")


def donor_cover(donors: DataFrame, by: list[str]) -> DataFrame:
    """The donors (id, blocks, needed, matched) to take within each group: a matched file first, then the largest, until those before cover what is needed."""
    order = Window.partitionBy(*by).orderBy(F.desc("matched"), F.desc("blocks"), "id")
    before = F.coalesce(F.sum("blocks").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return donors.withColumn("covered_before", before).where(F.col("covered_before") < F.col("needed"))


def xor_lanes(a: Column, b: Column) -> Column:
    """Exclusive or of equally long byte strings through 32-bit lanes, without Python: hex text in, hex text out."""
    lane = lambda h, i: F.conv(F.substr(h, i * 8 + 1, F.lit(8)), 16, 10).cast("long")
    n = F.floor(F.length(a) / 8).cast("int")
    mixed = lambda i: F.lower(F.lpad(F.hex(lane(a, i).bitwiseXOR(lane(b, i))), 8, "0"))
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), mixed), "")).otherwise("")
