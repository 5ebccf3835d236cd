"""SentencePiece encoding and decoding over a distinct-chunk table.

Marked text is the text with every space written as the marker U+2581 and one
marker before it. No piece of the vocabulary holds a marker after another
character, so no merge crosses the place where a run of markers begins: the text
falls into chunks there, and each chunk can be segmented by itself. A vocabulary for
which that doesn't hold is refused.

The chunks of all texts are counted (map-side combined, then by a shuffle of distinct chunks); the ``TABLE`` most
frequent ones are segmented once, in parallel, and their table goes to all tasks, which
join ids back by position. Its size is bounded. Chunks beyond it, rarer than all that are in it, and chunks of more than
``LONGEST`` characters are segmented where they stand: to send each of their places through a shuffle and
back would move more bytes than the texts have. A task keeps those that it has met (emptied at a fixed size, which
changes nothing but the time).

Null text counts as empty: no ids, empty decoding. Texts of any length are
encoded whole, chunk by chunk. Null ids stay null. An empty table gives an empty result. Other columns are not read; repeated rows
give repeated results.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import frequent, text_of, written

MARK = "▁"
#: Chunks in the table; chunks that a task keeps besides; the longest chunk in either; distinct chunks that a task counts before it hands them on.
TABLE, KEPT, LONGEST, FLUSH = 500_000, 200_000, 64, 400_000


class Chunks:
    """Segments chunks of one model: chunk to (number of ids, ids as decimals, decoded text). known: the table of all tasks; own: what this one met besides."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        if self.model.encode("") or any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces of this vocabulary cross white space markers")
        probe = "  a  b\nc  "
        if self.model.decode(self.model.encode(probe)) != probe:
            raise ValueError("this model normalises texts, so chunks can't stand alone")
        self.mark = self.model.piece_to_id(MARK)
        self.known: dict[str, tuple[int, str, str]] = {}
        self.own: dict[str, tuple[int, str, str]] = {}
        self.loaded: str | None = None
        self.split = re.compile(f"{MARK}+[^{MARK}]*").findall

    def segment(self, chunk: str) -> tuple[int, str, str]:
        marks = len(chunk) - len(chunk.lstrip(MARK))
        # the model puts one marker before a text, but none before an empty one
        ids = self.model.encode(" " * (marks - 1) + chunk[marks:]) if chunk != MARK else [self.mark]
        # decode() drops the first marker of a text only, so here it's put back
        known = len(ids), ",".join(map(str, ids)), " " + self.model.decode(ids) if chunk != MARK else " "
        if len(self.own) >= KEPT:
            self.own.clear()
        if len(chunk) <= LONGEST:
            self.own[chunk] = known
        return known

    def load(self, name: str, table: pa.Table) -> None:
        """Takes a table of segmented chunks, once for a name."""
        if self.loaded != name:
            columns = (table[c].to_pylist() for c in ("n_ids", "ids", "decoded"))
            self.known, self.loaded = dict(zip(table["chunk"].to_pylist(), zip(*columns, strict=True), strict=True)), name

    def chunks(self, text: str) -> list[str]:
        return self.split(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, ids in decimal joined by commas, decoded text."""
        if not text:
            return 0, "", ""
        get, own, segment = self.known.get, self.own.get, self.segment
        parts = [get(c) or own(c) or segment(c) for c in self.chunks(text)]
        return sum(p[0] for p in parts), ",".join([p[1] for p in parts]), "".join([p[2] for p in parts])[1:]


@lru_cache(maxsize=2)
def chunks_of(path: str) -> Chunks:
    """A table that a worker process keeps for its next tasks."""
    return Chunks(path)


def chunk_counts(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """(chunk, n) of all chunks of up to LONGEST characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunks_of(model_path)
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(chunks.chunks(text.as_py()))
                if len(counts) >= FLUSH:
                    yield _counted(counts)
                    counts.clear()
        if counts:
            yield _counted(counts)

    found = df.select(text_of(text_col).alias("text")).mapInArrow(run, "chunk string, n long")
    return found.repartition("chunk").groupBy("chunk").agg(F.sum("n").alias("n"))


def _counted(counts: Counter[str]) -> pa.RecordBatch:
    kept = [(c, n) for c, n in counts.items() if len(c) <= LONGEST]
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["chunk", "n"])


def segmented(chunks: DataFrame, model_path: str) -> DataFrame:
    """(chunk, n_ids, ids, decoded) of distinct chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = chunks_of(model_path).segment
        for batch in batches:
            found = [segment(c) for c in batch.column(0).to_pylist()]
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))], ["chunk", "n_ids", "ids", "decoded"])

    return chunks.select("chunk").mapInArrow(run, "chunk string, n_ids long, ids string, decoded string")


def encoded(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """One row per row of df: doc_id, n_tokens, ids_sha256, decoded_sha256; with full also ids (array of int) and decoded."""
    counts = written(chunk_counts(df, model_path, text_col))
    sent = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, segmented(frequent(counts, TABLE), model_path).toArrow()))  # TABLE rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunks_of(model_path)
        chunks.load(*sent.value)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text in batch.column(1):
                n, ids, decoded = chunks.encode(text.as_py())
                out[0].append(n)
                out[1].append(hashlib.sha256(ids.encode()).hexdigest())
                out[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                if full:
                    out[3].append([int(i) for i in ids.split(",")] if ids else [])
                    out[4].append(decoded)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][: 5 if full else 3]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(kinds) + 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=False))], names)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
