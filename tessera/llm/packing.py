"""Best-fit packing of tokenised documents by linear grouping.

Lengths are whole numbers up to the capacity, so the planner needs the histogram
of lengths alone: at most ``capacity`` numbers, whatever the data's size.
Full pieces stand alone. Large lengths are sorted, cut into groups of equal
cardinality and rounded up to their group's largest; over these few sizes a
configuration programme is solved by column generation; its slots are then given
actual lengths, and all that is left (small pieces, large ones that the solution leaves over, and those of sequences
that rounding left too empty) goes best-fit, longest first, into
the tightest sequence with room. The plan is a bounded list of (lengths in a
sequence, how many such sequences). Rows find their place by their rank among the
pieces of equal length, which is counted in salted parts, as many as the length has pieces for, so that a length that
holds a third of all pieces is ranked by many tasks.

Null text counts as empty: one piece with the end id alone. Repeated rows are
packed as often as they occur. A null id is packed like any other. Texts of any length are cut whole into pieces. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded, text_of, written

#: Pieces of one length that are ranked together, on average.
RANKED = 50_000
#: Characters on which the two tokenizer libraries split words alike; other texts take the slower library.
PLAIN = re.compile("[^\\t\\n\\r\\x20-\\x7e\\u00a1-\\u00ac\\u00ae-\\u017f]")
#: Characters of white space in a row from which the fast library's pattern may run out of stack (it does somewhere above 300,000).
RUN = 1 << 16
SPACES = re.compile(r"\s*")
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def long_space(text: str, run: int = RUN) -> bool:
    """Whether text has a run of white space that long. Such a run covers every half of it: only there it's looked for."""
    half = run // 2
    return len(text) >= run and any(text[i].isspace() and SPACES.match(text, i).end() - i >= half for i in range(0, len(text), half))


class Ids:
    """Text to the ids that the tokenizers library gives for a vocabulary file."""

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None) -> None:
        import base64

        import tokenizers

        self.exact = tokenizers.Tokenizer.from_file(path)
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast and "<|" not in text and not PLAIN.search(text) and not long_space(text):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def ids_of(path: str, ranks_path: str | None, pattern: str | None) -> Ids:
    """Ids that a worker process keeps for its next tasks."""
    return Ids(path, ranks_path, pattern)


def pieces(df: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece. A document longer than capacity is cut so that all pieces but the first are full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = ids_of(tokenizer_path, ranks_path, pattern)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*to_ids(text.as_py()), end_id], "<u4")
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for held, value in zip(out, (doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=False):
                        held.append(value)
                    if with_ids:
                        out[5].append(ids[a:b].astype(np.int32))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 6 if with_ids else 5]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)


def _configurations(sizes: np.ndarray, need: np.ndarray, capacity: int) -> list[tuple[float, np.ndarray]]:
    """The cutting-stock programme over few sizes, by column generation: (how often, how many of each size)."""
    n = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    basis = np.diag(1 / np.diag(columns))
    x = basis @ need
    for _ in range(40 * n):
        price = np.ones(n) @ basis
        # the most valuable filling of one sequence, by dynamic programming over its room
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        order = np.argsort(sizes)
        for room in range(int(sizes.min()), capacity + 1):
            fits = order[: np.searchsorted(sizes[order], room, "right")]
            worth = best[room - sizes[fits]] + price[fits]
            top = int(worth.argmax())
            if worth[top] > best[room - 1] + 1e-12:
                best[room], last[room] = worth[top], fits[top]
            else:
                best[room] = best[room - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(n), capacity
        while room > 0:
            if best[room] == best[room - 1]:
                room -= 1
            else:
                column[last[room]] += 1
                room -= int(sizes[last[room]])
        step = basis @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * step
        x[out] = ratio[out]
        x = np.maximum(x, 0)
        columns[:, out] = column
        turn = basis[out] / step[out]
        basis = basis - np.outer(step, turn)
        basis[out] = turn
    return [(x[i], columns[:, i].astype(int)) for i in range(n)]


def configured(large: list[tuple[int, int]], capacity: int, groups: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how many sequences, their lengths) by linear grouping of large lengths ((length, how many), longest first). Pieces may be left over."""
    total = sum(n for _, n in large)
    if not total:
        return []
    groups = min(groups, total)
    by_size: Counter = Counter()  # the rounded lengths
    at, top = 0, [0] * groups
    for s, n in large:  # equal cardinality: group g holds the items ranked from total * g / groups on
        while n:
            g = at * groups // total
            took = min(n, -(-total * (g + 1) // groups) - at)
            top[g] = top[g] or s
            by_size[top[g]] += took
            at, n = at + took, n - took
    sizes = np.array(sorted(by_size), int)
    left = dict(large)
    order = sorted(left)
    bins: list[tuple[int, tuple[int, ...]]] = []

    def take(n: int, most: int) -> tuple[int, int]:
        """Up to n pieces of the largest length that is left and isn't above most: (length, how many)."""
        k = bisect_right(order, most) - 1
        if k < 0:
            return 0, n
        s = order[k]
        took = min(n, left[s])
        left[s] -= took
        if not left[s]:
            order.pop(k)
        return s, took

    for often, column in sorted(_configurations(sizes, np.array([by_size[s] for s in sizes], float), capacity), key=lambda c: -c[0]):
        slots = [int(sizes[i]) for i in np.argsort(-sizes) for _ in range(column[i])]
        open_ = [(int(often + 1e-6), ())]
        if not open_[0][0]:
            continue
        for k, slot in enumerate(slots):
            filled = []
            for n, got in open_:  # substitute actual lengths; the last slot takes all the room that rounding left
                while n:
                    s, took = take(n, capacity - sum(got) if k == len(slots) - 1 else slot)
                    filled.append((took, (*got, s) if s else got))
                    n -= took
            open_ = filled
        bins += [(n, got) for n, got in open_ if got]
    return bins


def best_fit(bins: list[tuple[int, tuple[int, ...]]], loose: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """bins with the loose pieces (length: how many) put in best-fit, longest first, into the tightest sequence with room or a new one."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    rooms: list[int] = []

    def put(n: int, got: tuple[int, ...]) -> None:
        r = capacity - sum(got)
        if not room[r]:
            insort(rooms, r)
        room[r].append((n, got))

    for n, got in bins:
        put(n, got)
    for s, n in sorted(loose.items(), reverse=True):
        while n:
            k = bisect_left(rooms, s)
            if k == len(rooms):
                fill = min(capacity // s, n)
                put(n // fill, (s,) * fill)
                n -= n // fill * fill
                continue
            r = rooms[k]
            have, got = room[r].pop()
            if not room[r]:
                rooms.pop(k)
            took = min(have, n)
            if have > took:
                put(have - took, got)
            put(took, (*got, s))
            n -= took
    return [x for r in rooms for x in room[r]]


def plan(histogram: dict[int, int], capacity: int = 1024, groups: int = 48, small: int = 64) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, how many such sequences), for how many pieces there are of each length below capacity.

    Rounding leaves room in many of the configured sequences. So those with more room than some threshold are opened
    again and their pieces join the best fit; the threshold that needs the fewest sequences is taken. At the
    lowest all are opened, so there are never more sequences than best fit alone would need.
    """
    every = Counter({s: n for s, n in histogram.items() if 0 < s < capacity and n})
    bins = configured(sorted(((s, n) for s, n in every.items() if s > small), reverse=True), capacity, groups)
    best: list[tuple[int, tuple[int, ...]]] | None = None
    for most in (capacity, 64, 16, 4, 0, -1):
        kept = [(n, got) for n, got in bins if capacity - sum(got) <= most]
        loose = Counter(every)
        for n, got in kept:
            for s in got:
                loose[s] -= n
        found = best_fit(kept, {s: n for s, n in loose.items() if n}, capacity)
        if best is None or sum(n for n, _ in found) < sum(n for n, _ in best):
            best = found
    done: Counter = Counter()
    for n, got in best or []:
        done[tuple(sorted(got, reverse=True))] += n
    return sorted(done.items(), reverse=True)


def assign(found: DataFrame, capacity: int = 1024, groups: int = 48) -> DataFrame:
    """found (a written table of pieces) with sequence_id and offset. Full pieces are sequences of their own and get numbers from 0 on without a shuffle; planned sequences have numbers below 0."""
    full = found.where(F.col("length") == capacity).select(*found.columns, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = found.where(F.col("length") < capacity)
    histogram = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    if not histogram:
        return full
    salts = [histogram.get(s, 0) // RANKED + 1 for s in range(capacity)]
    salted = rest.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(F.from_json(F.lit(json.dumps(salts)), "array<bigint>"), F.col("length").cast("int"))))
    counts = written(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    places: dict[int, list[list[int]]] = defaultdict(lambda: [[], [], []])  # by length: first rank, sequence of it, offset
    reached: Counter = Counter()
    sequence = 1
    for lengths, n in plan(histogram, capacity, groups):
        offset = 0
        for s in lengths:
            for held, value in zip(places[s], (reached[s], sequence, offset), strict=True):
                held.append(value)
            reached[s] += n
            offset += s
        sequence += n
    if dict(reached) != histogram:
        raise AssertionError("the plan must hold every piece once")
    table = {s: np.array(p, np.int64) for s, p in places.items()}
    sent = found.sparkSession.sparkContext.broadcast(table)  # bounded by capacity and groups, not by the data
    before = written(counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before")))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    names = [c for c in found.columns]
    ranked = salted.withColumn("own", own).join(bounded(before), ["length", "salt"]).select(*names, (F.col("before") + F.col("own") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(len(names)).to_numpy(zero_copy_only=False)
            at, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length):
                first, begins, offsets = sent.value[int(s)]
                mine = length == s
                k = np.searchsorted(first, rank[mine], "right") - 1
                at[mine], offset[mine] = -(begins[k] + rank[mine] - first[k]), offsets[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(at), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{n} {t}" for n, t in found.dtypes)
    return full.unionByName(ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long"))


def pack(df: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, end_id: int = 2, capacity: int = 1024, groups: int = 48, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of df's documents with its place: sequence_id and offset. with_ids adds the ids themselves."""
    return assign(written(pieces(df, tokenizer_path, ranks_path, pattern, end_id, capacity, id_col, text_col, with_ids)), capacity, groups)


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers as p

    return pack(docs, p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


def query(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
