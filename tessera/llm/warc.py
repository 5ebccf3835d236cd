"""WARC archives with an external index merge.

Pages are written as WARC/1.1 records into gzipped archives in the shared folder, by
Spark's own writer: a record is a string, and the two line ends that close it are the
line separator. (So an archive is one gzip member, and offsets count unpacked bytes.) Payloads of at least ``least`` bytes that occur again are written once, for
the largest page id; the others are revisit records that refer to it.

Reading back, an archive passes as a stream, cut at blank lines by Spark's reader and put together record by record: a
task holds a batch and a record, never an archive. Each payload is checked
against its digest. The index entries of an archive, sorted by URL key and
timestamp, are a run. Entries are dealt out by ranges of (key, timestamp, page) of about ``RANGE`` entries, and each
range merges its pieces of all runs with a loser tree, so that the result's partitions
in order are one globally ordered capture history, also where one key has a third of all captures.

Null html counts as an empty payload, null URLs have no target and the key "-"; control
characters in a URL are percent-encoded. Repeated rows are written as often as they
occur, with the same record id (of one page id with the largest id of its payload, all are responses). A null page id is
written as an empty one, and comes after all others. Payloads of any length are written whole. An empty table gives
no archives and an empty result. Pages carry no capture time: page n counts as
captured n seconds after the start of 2024 (n modulo 10^9; null as 0). Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fits, met, shared_dir, written

END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLANK = b"\r\n\r\n"
#: Records in an archive; entries in a range of the index and in a run; digests of repeated payloads that are broadcast at most.
RECORDS, RANGE, COPIES = 1000, 100_000, 1_000_000
ENTRY = "urlkey string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_offset long, record_length long"


class LoserTree:
    """Merges sorted iterators: inner nodes hold the loser of their match, so the next item costs one match a level."""

    def __init__(self, runs: Iterable[Iterable[Any]], key: Callable[[Any], Any]) -> None:
        self.runs = [iter(r) for r in runs]
        self.key = key
        self.k = max(1, len(self.runs))
        self.heads: list[tuple | None] = [self._pull(i) for i in range(len(self.runs))] or [None]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _pull(self, run: int) -> tuple | None:
        for item in self.runs[run]:
            return self.key(item), run, item
        return None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] < y[:2])

    def _play(self, leaf: int) -> None:
        """Carries the run at leaf upwards; the overall winner ends in losers[0]."""
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            held = self.losers[node]
            if held < 0:  # its opponent hasn't come yet
                self.losers[node] = winner
                return
            if self._beats(held, winner):
                self.losers[node], winner = winner, held
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[Any]:
        while (head := self.heads[self.losers[0]]) is not None:
            yield head[2]
            run = head[1]
            self.heads[run] = self._pull(run)
            self._play(run)


def url_key(url: str | None) -> str:
    """Host labels in reverse order, then path and query, lower case: the key captures are sorted by."""
    if not url:
        return "-"
    rest = url.partition("://")[2] or url
    rest = rest.partition("#")[0].lower()
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].split("."))) + ")" + (rest[cut:] or "/")


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000) -> None:
    """Writes a record per row of df into archives under path."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    copies = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    copies = written(copies.where("n > 1 and original is not null"))
    known = rows.join(F.broadcast(copies), "digest", "left") if fits(copies, COPIES) else met(rows, copies, ["digest"], "n", outer=True)
    rows = known.withColumn("revisit", F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page_id")))
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    optional = lambda name, value: F.when(value.isNotNull(), line(name, value)).otherwise(F.lit(""))
    control = r"[\x00-\x20\x7F]"
    encoded = F.transform(F.split("url", ""), lambda c: F.when(c.rlike(control), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    uri = F.when(F.col("url").rlike(control), F.array_join(encoded, "")).otherwise(F.col("url"))
    date = F.date_format(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, pmod(coalesce(page_id, 0L), 1000000000L))"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END * 2))
    body = F.when(F.col("revisit"), F.col("http")).otherwise(F.concat("http", "payload"))
    record = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), number, F.lit(">"))),
        line("WARC-Date", date),
        optional("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("original").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("body").cast("string")),
        F.lit(END),
        F.col("body"),
    )
    records = rows.withColumn("http", http).withColumn("body", body).select(record.alias("value"))
    records.write.option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


class Records:
    """Puts records together from the pieces that blank lines cut an archive into: (offset, length, headers, block); offsets count unpacked bytes."""

    def __init__(self) -> None:
        self.held, self.at = bytearray(), 0
        self.head: tuple[int, int, dict[str, str]] | None = None  # where the block begins and ends, headers

    def feed(self, piece: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
        self.held += piece + BLANK
        while True:
            if self.head is None:
                cut = self.held.find(BLANK)
                if cut <= 0:  # nothing, or what follows a block that ends in a line end
                    return
                version, *fields = self.held[:cut].decode().split(END)
                if not version.startswith("WARC/"):
                    raise ValueError(f"no record at {self.at}")
                headers = {k.lower(): v for k, _, v in (f.partition(": ") for f in fields)}
                self.head = cut + 4, cut + 4 + int(headers["content-length"]), headers
            start, end, headers = self.head
            if len(self.held) < end + 4:
                return
            if self.held[end : end + 4] != BLANK:
                raise ValueError(f"the record at {self.at} doesn't end as it should")
            yield self.at, end + 4, headers, bytes(self.held[start:end])
            del self.held[: end + 4]
            self.at += end + 4
            self.head = None

    def close(self) -> None:
        if self.head is not None or self.held.strip(b"\r\n"):
            raise ValueError(f"the record at {self.at} is cut off")


def entry(archive: str, offset: int, length: int, headers: dict[str, str], block: bytes) -> tuple:
    """The index entry of a record; its payload is checked against its digest."""
    head, _, payload = block.partition(b"\r\n\r\n")
    http = dict(x.lower().split(": ", 1) for x in head.decode().split(END)[1:])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    number = lambda uri: int(n) if (n := uri.strip("<>").rpartition(":")[2]) else None
    kind = headers["warc-type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(http["content-length"])):
        raise ValueError(f"{archive}, {offset}: the payload isn't what its digest says")
    refers = number(headers["warc-refers-to"]) if kind == "revisit" else None
    return url_key(headers.get("warc-target-uri")), headers["warc-date"], number(headers["warc-record-id"]), int(http["content-length"]), digest, kind, refers, archive, offset, length


def _batch(entries: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*entries, strict=True), schema, strict=True)], schema=schema)


_KINDS = {"string": pa.string(), "long": pa.int64()}
_SCHEMA = pa.schema([(n, _KINDS[t]) for n, t in (x.split() for x in ENTRY.split(", "))])


def order(e: tuple) -> tuple:
    """What entries are sorted by: URL key, timestamp, page (null last)."""
    return e[0], e[1], e[2] is None, e[2] or 0


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """An index entry for each record of the archives under path, in sorted runs of an archive, RANGE entries at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, found = None, Records(), []

        def out() -> pa.RecordBatch:
            found.sort(key=order)
            batch = _batch(found, _SCHEMA)
            found.clear()
            return batch

        for batch in batches:
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name != now:
                    reader.close()
                    if found:
                        yield out()
                    now, reader = name, Records()
                for r in reader.feed((b := piece.as_buffer()) and b.to_pybytes() or b""):
                    found.append(entry(name, *r))
                    if len(found) == RANGE:
                        yield out()
        reader.close()
        if found:
            yield out()

    # a gzipped file isn't split, so a task gets its pieces in order
    files = spark.read.option("lineSep", END * 2).option("pathGlobFilter", "part-*").text(path).select("_metadata.file_name", "value")
    return files.mapInArrow(run, ENTRY)


def merged(index: DataFrame) -> DataFrame:
    """index (a written table of sorted runs, told apart by archive) in one global order of URL key, timestamp and page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        for batch in batches:
            for e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs.setdefault(e[7], []).append(e)
        for piece in runs.values():
            piece.sort(key=order)  # linear where the shuffle kept the run's order, as it does
        out: list[tuple] = []
        for e in LoserTree(runs.values(), order):
            out.append(e)
            if len(out) == 5000:
                yield _batch(out, _SCHEMA)
                out = []
        if out:
            yield _batch(out, _SCHEMA)

    ranges = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // RANGE))
    return index.repartitionByRange(ranges, F.col("urlkey"), F.col("timestamp"), F.col("page_id").asc_nulls_last()).mapInArrow(run, ENTRY)


def capture_histories(df: DataFrame, path: str | None = None, **names) -> DataFrame:
    """Writes df's pages to archives under path (a new shared folder, if none) and gives their merged index."""
    path = path or shared_dir(df.sparkSession) + "/warc"
    write_archives(df, path, **names)
    return merged(written(read_index(df.sparkSession, path)))


def query(spark, sf_dir: str) -> DataFrame:
    found = capture_histories(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp")


ORACLE = r"""
WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS original FROM p),
u AS (SELECT *, lower(regexp_extract(url, '^[^:]*://([^#]*)', 1)) AS rest FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN original <> page_id THEN original END AS refers_to,
       array_to_string(list_reverse(string_split(regexp_extract(rest, '^[^/?]*'), '.')), ',') || ')' || CASE WHEN regexp_matches(rest, '^[^/?]*$') THEN '/' ELSE regexp_extract(rest, '^[^/?]*(.*)$', 1) END AS urlkey,
       strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS timestamp
FROM u
"""
