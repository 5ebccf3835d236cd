"""Text codecs: base58, percent encoding, resource URLs, ranges, MIME types, versions, validation, multipart bodies."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: The base58 alphabet, the longest content type, file name and resource URL, the longest base58 input.
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
MAX_TYPE, MAX_NAME, MAX_URL, MAX_BASE58 = 256, 1024, 2048, 512
#: MIME type by file extension.
MIME = {
    "html": "text/html", "htm": "text/html", "css": "text/css", "js": "application/javascript", "json": "application/json",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "ico": "image/x-icon",
    "webp": "image/webp", "bmp": "image/bmp", "tiff": "image/tiff", "tif": "image/tiff",
    "mp4": "video/mp4", "webm": "video/webm", "mkv": "video/x-matroska", "avi": "video/x-msvideo", "mov": "video/quicktime", "wmv": "video/x-ms-wmv", "flv": "video/x-flv",
    "mp3": "audio/mpeg", "ogg": "audio/ogg", "wav": "audio/wav", "flac": "audio/flac", "aac": "audio/aac", "m4a": "audio/mp4",
    "woff": "font/woff", "woff2": "font/woff2", "ttf": "font/ttf", "otf": "font/otf",
    "pdf": "application/pdf", "zip": "application/zip", "gz": "application/gzip", "tar": "application/x-tar", "rar": "application/vnd.rar", "7z": "application/x-7z-compressed",
    "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xls": "application/vnd.ms-excel", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "ppt": "application/vnd.ms-powerpoint", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "txt": "text/plain", "csv": "text/csv", "xml": "application/xml", "md": "text/markdown", "ofd": "application/cbor",
}
OTHER = "application/octet-stream"


def _base58(data: bytes) -> str:
    if len(data) > MAX_BASE58:
        raise ValueError("too long for base58")
    n, out = int.from_bytes(data, "big"), []
    while n:
        n, r = divmod(n, 58)
        out.append(ALPHABET[r])
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + "".join(reversed(out))


def _unbase58(text: str) -> bytes | None:
    n = 0
    for c in text:
        if (digit := ALPHABET.find(c)) < 0:
            return None
        n = n * 58 + digit
    return b"\0" * (len(text) - len(text.lstrip("1"))) + n.to_bytes((n.bit_length() + 7) // 8, "big")


@F.pandas_udf(StringType())
def base58_encode(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else _base58(bytes(d)))


@F.pandas_udf(BinaryType())
def base58_decode(text: pd.Series) -> pd.Series:
    """Null where a character isn't in the alphabet."""
    return text.map(lambda t: None if t is None else _unbase58(t))


def percent_encode(text: Column, keep: str = "") -> Column:
    """Percent-encodes all but letters, digits and -_.~ (and the characters in keep)."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    for c in keep:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


@F.pandas_udf(StringType())
def percent_decode(text: pd.Series) -> pd.Series:
    """Decodes %XX; a % that two hex digits don't follow stays as it is."""
    from urllib.parse import unquote

    return text.map(lambda t: None if t is None else unquote(t))


def resource_url(server: Column, content_type: Column, length: Column, file_hash: Column, descriptor_hash: Column, name: Column, prefix: str) -> Column:
    """Prints a resource URL; null unless both hashes are there. prefix: the path between server and type, such as "/v3/"."""
    parts = F.concat(server, F.lit(prefix), percent_encode(content_type, "/"), F.lit("/"), length.cast("string"), F.lit("/"), base58_encode(file_hash), F.lit("/"), base58_encode(descriptor_hash), F.lit("/"), percent_encode(name))
    return F.when(file_hash.isNotNull() & descriptor_hash.isNotNull(), parts)


def parse_resource_url(url: Column, prefix: str) -> Column:
    """Struct (server, content_type, length, file_hash, descriptor_hash, name); its fields are null where url isn't one. The type ends at the first /number/base58."""
    pattern = rf"^(.*?){re.escape(prefix)}(.+?)/([0-9]+)/([1-9A-HJ-NP-Za-km-z]+)/([1-9A-HJ-NP-Za-km-z]+)/([^/]*)$"
    part = lambda i: F.nullif(F.regexp_extract(url, pattern, i), F.lit(""))
    fits = (F.length(part(2)) <= MAX_TYPE) & (F.length(part(6)) <= MAX_NAME)
    got = lambda i, f=lambda c: c: F.when(fits, f(part(i)))
    return F.struct(got(1).alias("server"), got(2, percent_decode).alias("content_type"), got(3).cast("long").alias("length"), got(4, base58_decode).alias("file_hash"), got(5, base58_decode).alias("descriptor_hash"), got(6, percent_decode).alias("name"))


def url_from_headers(content_type: Column, length: Column, name: Column) -> Column:
    """Struct of an upload's headers; null for a length of zero."""
    return F.when(length > 0, F.struct(content_type.alias("content_type"), length.alias("length"), name.alias("name")))


def mime_type(name: Column) -> Column:
    """By extension, whatever its case. Names without one, and names that begin with their only dot, are octet streams."""
    table = F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))
    extension = F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))
    return F.coalesce(F.try_element_at(table, extension), F.lit(OTHER))


def byte_range(header: Column, size: Column) -> Column:
    """Struct (start, end) of a single range a-b, a- or -n, within size; null if it isn't one or can't be met. end is exclusive."""
    pattern = r"^bytes=([0-9]*)-([0-9]*)$"
    a, b = (F.nullif(F.regexp_extract(header, pattern, i), F.lit("")).cast("long") for i in (1, 2))
    start = F.when(a.isNotNull(), a).otherwise(F.greatest(size - b, F.lit(0)))
    end = F.when(a.isNull() | b.isNull(), size).otherwise(F.least(b + 1, size))
    fits = (a.isNotNull() | (b > 0)) & (start < size) & (start < end)
    return F.when(fits, F.struct(start.alias("start"), end.alias("end")))


def quoted_urls(header: Column) -> Column:
    """The quoted URLs of a header that lists donors."""
    return F.regexp_extract_all(header, F.lit('"([^"]+)"'), 1)


def version(text: Column) -> Column:
    """Struct (major, minor, patch, stable, prerelease) that orders as versions do: a prerelease before its release."""
    pattern = r"^v?([0-9]+)\.([0-9]+)\.([0-9]+)(?:-(.+))?$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    made = F.struct(*(part(i).cast("int").alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))), (part(4) == "").alias("stable"), part(4).alias("prerelease"))
    return F.when(text.rlike(pattern), made)


def version_text(v: Column) -> Column:
    plain = F.concat_ws(".", v["major"].cast("string"), v["minor"].cast("string"), v["patch"].cast("string"))
    return F.when(v["stable"], plain).otherwise(F.concat_ws("-", plain, v["prerelease"]))


def channel(v: Column) -> Column:
    return F.when(v["stable"], "stable").when(F.contains(v["prerelease"], F.lit("rc")), "rc").otherwise("dev")


def first_release(releases, by: list[str], order: str, tag: str, wanted: str):
    """(by, tag): the first release in the list's order that fits a channel: stable has no prerelease, an rc has "rc" in it, dev has any."""
    v = version(F.col(tag))
    fits = {"stable": v["stable"], "rc": F.contains(v["prerelease"], F.lit("rc")), "dev": ~v["stable"]}[wanted]
    return releases.where(v.isNotNull() & fits).groupBy(*by).agg(F.min_by(tag, order).alias(tag))


def node_id(key: Column) -> Column:
    """Struct (hash, text): a node's id from its public key, as bytes and in base58. Compare the bytes; a null key has no id."""
    name = F.unhex(F.sha2(key, 256))
    return F.when(key.isNotNull(), F.struct(name.alias("hash"), base58_encode(name).alias("text")))


def path_join(*parts: Column) -> Column:
    return F.regexp_replace(F.concat_ws("/", *parts), "/{2,}", "/")


def valid_content_type(text: Column) -> Column:
    return F.coalesce(text.rlike(rf"^[\x20-\x7E]{{1,{MAX_TYPE}}}$"), F.lit(False))


def valid_file_name(text: Column) -> Column:
    return F.coalesce(text.rlike(rf"^[\x20-\x7E]{{1,{MAX_NAME}}}$") & ~F.contains(text, F.lit("..")) & ~F.contains(text, F.lit("/")), F.lit(False))


def valid_resource_url(text: Column, prefix: str) -> Column:
    return F.coalesce((F.octet_length(text).between(1, MAX_URL)) & text.rlike("^https?://") & F.contains(text, F.lit(prefix)), F.lit(False))


@F.pandas_udf(BinaryType())
def multipart_file(body: pd.Series, content_type: pd.Series) -> pd.Series:
    """The first part of a multipart body that has a file name; null if there is none."""

    def one(data, kind):
        found = re.search(r'boundary="?([^";]+)"?', kind or "")
        if data is None or not found:
            return None
        for part in bytes(data).split(b"--" + found[1].encode())[1:]:
            head, gap, rest = part.partition(b"\r\n\r\n")
            if gap and b"filename=" in head:
                return rest.removesuffix(b"\r\n")
        return None

    return pd.Series([one(d, k) for d, k in zip(body, content_type, strict=True)])
