"""URL filter: a blocked Bloom filter before an exact hash join. DataFrame operations only.

Listed keys are a host and the beginning of a path, each with a verdict. A
URL yields a candidate key for every suffix of its host (by whole
labels) and every listed path length; each row tests its candidates against a blocked
Bloom filter of the listed keys (64-bit words, four bits a key), which travels in the plan as an array. Rows
without a possible hit pass straight through. The candidates of the others go to an exact hash
join with the list, which removes false positives, and the longest fitting key wins; only these rows
shuffle, evenly, by a number of their own. A URL without a key gets ``default``. The filter has at most ``WORDS``
words (1 MB); from about four keys a word on it lets more candidates through, never fewer. The list
is broadcast only when its counted rows are below the bound, and else shuffled.

The host is what lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end,
A-Z lower-cased; the path goes from there to ``?``, ``#`` or the end. Null and URLs
without ``://`` have an empty host and path, which no key fits. Repeated rows and
repeated or null ids get a row each. Keys with a null part are left out; of fitting keys of equal length (which differ in where host and path
meet) the one with the longer host wins. URLs of any length are read whole. An empty table or list gives an empty result or only ``default``; only the id
and the URL are read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded, written

RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Words of the filter at most.
WORDS = 1 << 17


def listed(spark: SparkSession, rules=RULES) -> DataFrame:
    """(host, path, verdict) of a list given in code."""
    rows = json.dumps([dict(zip(("host", "path", "verdict"), r, strict=True)) for r in rules])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<host:string,path:string,verdict:string>>")))


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), AZ, az), F.coalesce(path, F.lit(""))


def _word(h: Column, words: int) -> Column:
    return F.shiftrightunsigned(h, 24).bitwiseAND(F.lit(words - 1)).cast("int")


def _bits(h: Column) -> Column:
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))


def url_filter(df: DataFrame, keys: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every row. keys: host, path, verdict; of a key listed twice the smaller verdict holds."""
    list_ = keys.where("host is not null and path is not null").groupBy(F.translate("host", AZ, az).alias("key_host"), F.col("path").alias("key_path"))
    list_ = written(list_.agg(F.min("verdict").alias("verdict")))
    n, lengths = list_.agg(F.count("*"), F.collect_set(F.length("key_path"))).first()  # as many lengths as paths can have, not as many as rows
    words = min(WORDS, 1 << max(4, (n // 4).bit_length()))
    h = F.xxhash64("key_host", "key_path")
    held = [0] * words
    for row in list_.groupBy(_word(h, words).alias("word")).agg(F.bit_or(_bits(h)).alias("held")).collect():  # WORDS rows at most
        held[row["word"]] = row["held"]
    host, path = parts(F.col(url_col))
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefix = F.array_distinct(F.array(*(F.substring("path", 1, k) for k in sorted(lengths)))) if lengths else F.array().cast("array<string>")
    keyed = F.flatten(F.transform(suffix, lambda a: F.transform(prefix, lambda b: F.struct(a.alias("key_host"), b.alias("key_path")))))
    bloom = F.from_json(F.lit(json.dumps(held)), "array<bigint>")
    fits = lambda x: F.get(bloom, _word(x, words)).bitwiseAND(_bits(x)) == _bits(x)
    possible = F.filter(keyed, lambda c: fits(F.xxhash64(c["key_host"], c["key_path"])))
    tested = rows.withColumn("possible", F.when(F.col("host") != "", possible).otherwise(F.array().cast("array<struct<key_host:string,key_path:string>>")))
    passed = tested.where(F.size("possible") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    hits = tested.where(F.size("possible") > 0).withColumn("row", F.monotonically_increasing_id()).select("row", "page_id", "host", "path", F.explode("possible").alias("c"))
    hits = hits.select("row", "page_id", "host", "path", "c.*").join(bounded(list_), ["key_host", "key_path"], "left")
    rank = F.struct((F.length("key_host") + F.length("key_path")).alias("length"), F.length("key_host").alias("own"))
    best = F.max_by(F.struct(F.concat("key_host", "key_path").alias("rule"), "verdict"), F.when(F.col("verdict").isNotNull(), rank)).alias("best")
    judged = hits.groupBy("row").agg(*(F.first(c).alias(c) for c in ("page_id", "host", "path")), best)
    return passed.unionByName(judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")))


def query(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), listed(spark))


ORACLE = r"""
WITH r(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
SELECT b.page_id, b.host, b.path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM b LEFT JOIN (SELECT u.host, u.path, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
  FROM (SELECT DISTINCT host, path FROM b) u JOIN r ON (u.host = h OR u.host LIKE '%.' || h) AND starts_with(u.path, p) GROUP BY 1, 2) m
ON b.host = m.host AND b.path = m.path
"""
