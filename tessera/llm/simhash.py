"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has 64 bits; the 64 bits are eight bytes. Two fingerprints that
differ in at most ``radius`` bits differ in at most ``radius`` bytes, so they
agree once some ``radius`` bytes are left out. Every distinct fingerprint is
therefore dealt out under each choice of left-out bytes (28 choices for radius
2), keyed by the rest. A bucket can't grow with the data beyond the values
of the left-out bytes (65,536 for radius 2). Inside a bucket the left-out bits
stand as vertical bit planes, 64 rows to a machine word; carry-save counters
add up the differing planes for 64 pairs at once, and words in which every pair
is beyond the radius are abandoned. Only a spanning forest of a bucket's
links leaves it, never all pairs.

Null text counts as empty; a text without words has fingerprint 0 and is linked
like any other. Repeated rows and equal texts share a fingerprint. An empty
table gives an empty result. A text of any length is hashed whole, HASHES shingles at
a time. A null id is never the smallest id of its group; texts that only null ids have link with
no other text and have a null component.
Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded, components, met, text_of, written

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Hashes whose bits are counted at once, and pair words compared at once.
HASHES, WORDS = 65_536, 32_768
#: Rows gathered before their buckets are compared.
ROWS = 131_072


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a UTF-8 text: bit b is 1 if it is set in over half the shingles' hashes."""
    import xxhash

    h = xxhash.xxh64_intdigest
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return h(b" ".join(words), seed)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, HASHES):
        to = min(n, at + HASHES)
        pairs = zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist(), strict=True)
        hashes = np.fromiter((h(joined[a:b], seed) for a, b in pairs), np.uint64, to - at)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_buffer() and t.as_buffer().to_pybytes() or b"", shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i] in label, where every entry ends as its set's smallest index."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label[label] != label).any():
            label[:] = label[label]


def _planes(bits: np.ndarray, planes: int) -> np.ndarray:
    """Bit planes of rows of 64-bit words: plane k holds bit k of 64 rows in each word."""
    n, columns = bits.shape
    out = []
    for c in range(columns):
        grid = np.zeros((-(-n // 64) * 64, 64), np.uint8)
        grid[:n] = np.unpackbits(np.ascontiguousarray(bits[:, c]).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        packed = np.packbits(np.ascontiguousarray(grid.T[: min(64, planes - 64 * c)]), axis=1, bitorder="little")
        out.append(np.ascontiguousarray(packed).view(np.uint64))
    return np.concatenate(out)


def linked(bucket: np.ndarray, bits: np.ndarray, planes: int, radius: int) -> np.ndarray:
    """For rows sorted by bucket: the index of the smallest row reachable inside the bucket by links of at most radius differing bits.

    bits: a row of 64-bit words for each row. Every row is compared with the earlier rows of its bucket, 64 to a word.
    A word whose rows already are in the row's own set is skipped, so a large group of near copies costs no square.
    """
    n = len(bucket)
    label = np.arange(n)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size = np.diff(np.r_[first, n])
    many = size > 1
    first, size = first[many], size[many]
    if not len(first):
        return label
    begin = np.cumsum(size) - size
    start = np.repeat(begin, size)
    m = len(start)
    at_row = np.repeat(first, size) + np.arange(m) - start  # rows of larger buckets, without the others
    value = bits[at_row]
    plane = _planes(value, planes)
    own = np.arange(m)
    sets = np.arange(plane.shape[1] * 64)
    word0 = start // 64
    each = np.where(own > start, (own - 1) // 64 - word0 + 1, 0)
    upto = np.cumsum(each)
    large = int(size.max()) > 1024
    every, one = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1)
    at = 0
    while at < m:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + WORDS, "right")))
        reps = each[at:to]
        q = np.repeat(own[at:to], reps)
        w = np.repeat(word0[at:to] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))
        if large:
            held = sets.reshape(-1, 64)
            low = held.min(1)
            apart = (low != held.max(1))[w] | (low[w] != sets[q])
            q, w = q[apart], w[apart]
        low = np.maximum(start[q] - w * 64, 0).astype(np.uint64)
        high = np.minimum(q - w * 64, 64).astype(np.uint64)
        dead = ~((every << low) & (every >> (np.uint64(64) - high)))
        counters = [np.zeros(len(q), np.uint64) for _ in range(radius.bit_length())]
        for k in range(planes):
            carry = plane[k][w] ^ (np.uint64(0) - ((value[q, k // 64] >> np.uint64(k % 64)) & one))
            for c, count in enumerate(counters):
                counters[c], carry = count ^ carry, count & carry
            dead |= carry
            if k >= radius and (k % 16 == 15 or planes <= 16 and k % 4 == 3):
                dead |= _over(counters, radius)
                alive = dead != every
                if alive.sum() < 0.7 * len(alive):
                    q, w, dead = q[alive], w[alive], dead[alive]
                    counters = [c[alive] for c in counters]
                    if not len(q):
                        break
        if len(q):
            dead |= _over(counters, radius)
            hit = np.unpackbits((~dead).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, bit = np.nonzero(hit)
            _roots(sets, q[i], w[i] * 64 + bit)
        at = to
    label[at_row] = at_row[sets[:m]]
    return label


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose carry-save count is above radius."""
    over = np.zeros_like(counters[0])
    same = ~over
    for c in range(len(counters) - 1, -1, -1):
        if radius >> c & 1:
            same = same & counters[c]
        else:
            over = over | (same & counters[c])
            same = same & ~counters[c]
    return over


def _by_bucket(compare: Callable[..., pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Feeds compare with the columns of whole buckets (equal in the first two columns), some ROWS at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            n += batch.num_rows
            if n >= ROWS:
                cols = [np.concatenate(x) for x in zip(*held, strict=True)]
                change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
                cut = int(change[-1]) + 1 if len(change) else 0  # the last bucket may go on
                if cut:
                    yield compare(*(c[:cut] for c in cols))
                held = [tuple(c[cut:] for c in cols)]
                n -= cut
        if held:
            yield compare(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _edges(low: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
    far = low != np.arange(len(low))
    return pa.RecordBatch.from_arrays([pa.array(rep[far]), pa.array(rep[low[far]])], ["a", "b"])


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) links that connect whatever radius connects, between the reps of distinct fingerprints (fp, rep)."""
    choices = list(combinations(range(8), radius))
    free = [sum(0xFF << 8 * i for i in c) for c in choices]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keyed = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(~m & (1 << 64) - 1))).alias("rest")) for i, m in enumerate(free)))
    dealt = distinct.where("rep is not null").select("fp", "rep", F.explode(keyed).alias("k")).select("k.choice", "k.rest", "fp", "rep")
    dealt = dealt.repartition("choice", "rest").sortWithinPartitions("choice", "rest", "rep")
    shifts = np.array([[8 * i for i in c] for c in choices], np.uint64)

    def compare(choice: np.ndarray, rest: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        bucket = np.cumsum(np.r_[0, (choice[1:] != choice[:-1]) | (rest[1:] != rest[:-1])])
        bits = np.zeros(len(fp), np.uint64)
        for i in range(radius):
            bits |= ((fp.view(np.uint64) >> shifts[choice, i]) & np.uint64(0xFF)) << np.uint64(8 * i)
        return _edges(linked(bucket, bits[:, None], 8 * radius, radius), rep)

    return dealt.mapInArrow(_by_bucket(compare), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp long, component_id) for every row: component_id is the smallest id reachable over links of at most radius differing bits."""
    fps = written(fingerprints(df, id_col, text_col, shingle))
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    found = components(links(distinct, radius))
    classes = written(distinct.join(found, distinct.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "n"))
    return met(fps, classes, ["fp"], "n").select("doc_id", "fp", "component_id")


#: Words of a wide fingerprint; hashes of sets that a task holds; sets of a large group that begin stars in a round.
WIDE, HELD, STARS = 4, 4_000_000, 16
#: Of so many fingerprints one is looked at to find large buckets; fingerprints of those, in a bucket, from which it counts as large.
SAMPLE, LARGE = 64, 256


def wide_hashes(text: bytes, shingle: int = 5) -> np.ndarray:
    """8 * WIDE bytes of hash for each different shingle of a text, a row each, in the order of the first 8."""
    import xxhash

    h = xxhash.xxh3_128_digest
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros((0, WIDE), np.uint64)
    kinds = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}
    hashes = np.frombuffer(b"".join([h(k, i) for k in kinds for i in range(WIDE // 2)]), np.uint64).reshape(-1, WIDE)
    return hashes[np.argsort(hashes[:, 0], kind="stable")]


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """A SimHash of 64 * WIDE bits: the wider, the closer its distance follows the likeness of the sets of shingles."""
    counts = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(hashes), HASHES // 4):
        part = np.ascontiguousarray(hashes[at : at + HASHES // 4]).view(np.uint8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)


class Held:
    """Sets of hashes side by side, to hold one set against all at once."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(s) for s in sets])
        order = np.argsort(flat := np.concatenate(sets), kind="stable")
        self.owner, self.flat = np.repeat(np.arange(len(sets)), self.size)[order], flat[order]

    def like(self, one: np.ndarray, similarity: float) -> np.ndarray:
        """The sets whose Jaccard index with one is similarity or more (two empty sets are equal)."""
        low, high = np.searchsorted(self.flat, one, "left"), np.searchsorted(self.flat, one, "right")
        n = high - low
        shared = np.bincount(self.owner[np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)], minlength=len(self.size))
        return np.flatnonzero(shared >= similarity * (self.size + len(one) - shared) - 1e-9)


def alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set of hashes: the index of the smallest set reachable by pairs whose Jaccard index is similarity or more.

    One set at a time is held against all others by the sets that each hash lies in. First those that start a star, which
    takes the sets that are like it; then all others outside the largest group, as one end of every other pair lies there.
    """
    m = len(sets)
    label = np.arange(m)
    held = Held(sets)

    def meet(i: int) -> None:
        like = held.like(sets[i], similarity)
        _roots(label, np.full(len(like), i), like)

    done = np.zeros(m, bool)
    for i in range(m):
        if label[i] == i:
            done[i] = True
            meet(i)
    largest = np.bincount(label).argmax()
    for i in np.flatnonzero((label != largest) & ~done):
        meet(i)
    return label


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for chunk in column.chunks for x in chunk]


def met_sets(members: DataFrame, askers: DataFrame, similarity: float, most: int) -> DataFrame:
    """(a, b): the links of askers (a table of near, node, size, held) with members of their group (near, node, part, parts, held). A task holds a block of askers, about most hashes, and a part of the members."""
    weight = written(askers.groupBy("near").agg((F.floor(F.sum("size") / most) + 1).alias("n")))
    block = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    asks = written(askers.join(bounded(weight), "near").select("near", block.alias("block"), F.col("node").alias("asker"), F.col("held").alias("asked")))
    blocks = written(asks.select("near", "block").distinct())
    parts = members.groupBy("near").agg(F.max("parts").alias("parts"))
    asked = asks.join(parts, "near").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("near", "block", "part", "asker", "asked")
    dealt = members.join(bounded(blocks), "near").select("near", "block", "part", "node", "held")

    def judge(own: pa.Table, asked: pa.Table) -> pa.Table:
        a, b = [], []
        if own.num_rows and asked.num_rows:
            held, node = Held(_sets(own["held"])), own["node"].to_numpy()
            for asker, one in zip(asked["asker"].to_pylist(), _sets(asked["asked"]), strict=True):
                like = node[held.like(one, similarity)]
                b.append(like[like != asker])
                a.append(np.full(len(b[-1]), asker))
        return pa.table([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (a, b)], ["a", "b"])

    key = ["near", "block", "part"]
    return dealt.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(judge, "a long, b long")


def large_groups(held: DataFrame, similarity: float, most: int, rounds: int = 4) -> DataFrame:
    """(a, b) links whose components are those of all pairs of like sets in groups that no task should hold. held: a written table (near, node, size, held).

    As in alike(): some rounds of stars, a few of each group that have no link yet; then whatever lies outside
    the largest component of its group, in blocks. Both are held against the whole group, which is dealt out in parts.
    """
    weight = held.groupBy("near").agg(F.sum("size").alias("total"))
    parts = (F.floor(F.col("total") / most) + 1).cast("int")
    members = held.join(bounded(written(weight)), "near").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    members = written(members.select("near", "node", "size", "held", "parts", "part"))
    found, asked = None, None
    names = members.select("near", "node")
    for _ in range(rounds):
        free = names if found is None else names.join(found.select(F.col("b").alias("node")).unionByName(asked).distinct(), "node", "left_anti")
        stars = written(free.groupBy("near", F.pmod(F.xxhash64("node"), F.lit(STARS)).alias("slot")).agg(F.min("node").alias("node")).select("node"))
        if stars.isEmpty():
            break
        links = met_sets(members, members.join(bounded(stars), "node", "left_semi"), similarity, most // 4)
        found = written(links if found is None else found.unionByName(links))
        asked = written(stars if asked is None else asked.unionByName(stars))
    label = names.join(components(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    label = written(label)
    counts = label.groupBy("near", "component").agg(F.count("*").alias("n"))
    largest = counts.groupBy("near").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    left = label.join(largest, "near").where("component <> largest").select("node").join(asked, "node", "left_anti")
    left = written(left)
    if left.isEmpty():
        return found
    return found.unionByName(met_sets(members, members.join(left, "node", "left_semi"), similarity, most // 4))


def _tables(size: int, share: float, width: int, recall: float) -> int:
    """How many tables of width sampled bits find a pair with the probability recall, if each of its size bits differs with the probability share."""
    odds = np.array([comb(size, d) * share**d * (1 - share) ** (size - d) for d in range(size + 1)])
    missed = 1 - (1 - np.arange(size + 1) / size) ** width
    tables = 1
    while (odds * missed**tables).sum() > 1 - recall:
        tables += 1
    return tables


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.999) -> DataFrame:
    """(doc_id, twin, component_id) for every row, twin the xxhash64 of its text: groups of texts over pairs whose sets of word shingles have a Jaccard index of similarity or more.

    Wide fingerprints only say which texts to compare. A pair at that similarity differs in a known
    share of bits on average; the radius lies 3.5 standard deviations above it. Such a pair falls into one bucket
    in at least one of several tables, each keyed by some sampled bits, with the wanted probability
    over all distances that it may have (1 where sets are equal). Bits per key grow with the logarithm of the number of texts, so buckets of
    unlike texts stay small; large buckets are candidates as they stand. Inside the groups so found the sets themselves decide: a task holds the
    sets of one group of up to HELD hashes, and larger groups are dealt out over tasks (large_groups). Sets of equal texts, whatever their number, count once.
    Groups have the smallest id in them; texts that only null ids have form groups with no other and a null component.
    """
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    size = 64 * WIDE
    radius = int(size * share + 3.5 * (size * share * (1 - share)) ** 0.5)
    names = [f"f{i}" for i in range(WIDE)]
    marks_of = ["s0", "s1"]  # a digest of the set

    def hashed(text: pa.Scalar) -> tuple[np.ndarray, bytes]:
        import xxhash

        hashes = wide_hashes((b := text.as_buffer()) and b.to_pybytes() or b"", shingle)
        return hashes, xxhash.xxh3_128_digest(hashes[:, :2].tobytes())

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = []
                for text in batch.column(2):
                    hashes, digest = hashed(text)
                    found.append(np.r_[wide_fingerprint(hashes), np.frombuffer(digest, np.uint64)])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in np.stack(found).view(np.int64).T)], ["doc_id", "twin", *names, *marks_of])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("twin"), text_of(text_col).alias("text"))
    kinds = ", ".join(f"{f} long" for f in names)
    fps = written(rows.mapInArrow(marks, f"doc_id long, twin long, {kinds}, s0 long, s1 long"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "twin"))).alias("first")
    distinct = fps.groupBy(*names, *marks_of).agg(first, F.count("*").alias("n"))
    distinct = written(distinct.select(*names, *marks_of, F.col("first.doc_id").alias("rep"), F.col("first.twin").alias("twin"), "n"))
    n = distinct.count()
    width = max(8, (n // 64).bit_length())
    tables = _tables(size, share, width, recall)
    rng = np.random.default_rng(7)
    sampled = [rng.permutation(size)[:width] for _ in range(tables)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.stack([c.to_numpy() for c in batch.columns[:WIDE]], 1).view(np.uint64)
            for t, bits in enumerate(sampled):
                key = np.zeros(len(f), np.uint64)
                for i, b in enumerate(bits):
                    key |= ((f[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)) << np.uint64(i)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), t, np.int32)), pa.array(key.view(np.int64)), *batch.columns], ["choice", "rest", *names, "node"])

    def tabled(some: DataFrame) -> DataFrame:
        return some.select(*names, F.col("s0").alias("node")).mapInArrow(deal, f"choice int, rest long, {kinds}, node long")

    # What lies in a large bucket is a candidate without a look at distances: links to the bucket's smallest, map-side combined.
    # The sample only says which buckets these are, so it changes what is compared, not what is found alike.
    known = distinct.where("rep is not null")
    bucket = ["choice", "rest"]
    hot = written(tabled(known.where(F.pmod(F.xxhash64("s0"), F.lit(SAMPLE)) == 0)).groupBy(*bucket).count().where(F.col("count") >= LARGE).select(*bucket))
    dealt = tabled(known)
    stars = None
    if not hot.isEmpty():
        packed = dealt.join(bounded(hot), bucket, "left_semi").select(*bucket, "node")
        lowest = written(packed.groupBy(*bucket).agg(F.min("node").alias("low")))
        stars = packed.join(bounded(lowest), bucket).select(F.col("node").alias("a"), F.col("low").alias("b")).where("a <> b")
        dealt = dealt.join(bounded(hot), bucket, "left_anti")
    dealt = dealt.repartition(*bucket).sortWithinPartitions(*bucket, "node")

    def compare(choice: np.ndarray, rest: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
        bucket = np.cumsum(np.r_[0, (choice[1:] != choice[:-1]) | (rest[1:] != rest[:-1])])
        return _edges(linked(bucket, np.stack(more[:-1], 1).view(np.uint64), size, radius), more[-1])

    found = dealt.mapInArrow(_by_bucket(compare), "a long, b long")
    near = written(components(found if stars is None else found.unionByName(stars)))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [wide_hashes((b := text.as_buffer()) and b.to_pybytes() or b"", shingle)[:, 0] for text in batch.column(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(h) for h in found], pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())], ["near", "node", "size", "held"])

    def judge(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        node = group["node"].to_numpy()
        label = alike(_sets(group["held"]), similarity)
        far = label != np.arange(len(node))
        return pa.table([pa.array(node[far]), pa.array(node[label[far]])], ["a", "b"])

    wanted = near.join(known, near.node == known.s0).select("node", F.col("component").alias("near"), F.col("rep").alias("doc_id"), "twin")
    texts = rows.join(wanted, ["doc_id", "twin"])
    held = written(texts.select("near", "node", "text").mapInArrow(sets, "near long, node long, size long, held binary"))
    large = written(held.groupBy("near").agg(F.sum("size").alias("total")).where(F.col("total") > HELD).select("near"))
    links = held.join(bounded(large), "near", "left_anti").groupBy("near").applyInArrow(judge, "a long, b long")
    if not large.isEmpty():
        links = links.unionByName(large_groups(written(held.join(bounded(large), "near", "left_semi")), similarity, HELD))
    same = components(links).select(F.col("node").alias("s0"), "component")
    same = written(distinct.select("s0", "rep").join(same, "s0").select("s0", "rep", "component"))
    lowest = same.groupBy("component").agg(F.min("rep").alias("low"), F.count("*").alias("n"))
    same = met(same.select("s0", "component"), written(lowest), ["component"], "n").select("s0", "low")
    classes = written(distinct.join(same, "s0", "left").select(*marks_of, F.coalesce("low", "rep").alias("component_id"), "n"))
    return met(fps.select("doc_id", "twin", *marks_of), classes, marks_of, "n").select("doc_id", "twin", "component_id")


def hexadecimal(fp: str = "fp"):
    """The fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", hexadecimal().alias("fingerprint"), "component_id")
