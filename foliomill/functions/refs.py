"""References to points: labels, URIs, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _nonempty(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def label(page_range: Column, line_range: Column) -> Column:
    """``pages a–b``, ``page a``, ``lines a–b`` or ``line a``; pages go first, nothing gives null."""

    def one(values: Column, name: str) -> Column:
        last = F.element_at(values, -1).cast("string")
        first = F.element_at(values, 1).cast("string")
        return F.when(F.size(values) == 1, F.concat(F.lit(f"{name} "), first)).when(F.size(values) > 1, F.concat(F.lit(f"{name}s "), first, F.lit("–"), last))

    return F.coalesce(one(page_range, "page"), one(line_range, "line"))


def file_uri(path: Column) -> Column:
    """``file://`` and the percent-encoded path, slashes kept."""
    coded = F.url_encode(path)
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(a), F.lit(b))
    return F.concat(F.lit("file://"), coded)


def markdown_links(text: Column) -> Column:
    """Each ``file://`` address of a text as Markdown link: ``[decoded](address)``; an address ends before white space, ``]`` or ``)``."""
    parts = F.regexp_extract_all(text, F.lit(r"(file://[^\s\])]+|(?:(?!file://[^\s\])])[\s\S])+)"), 1)
    link = lambda x: F.concat(F.lit("["), F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x), F.lit("]("), x, F.lit(")"))
    return F.array_join(F.transform(parts, lambda x: F.when(x.startswith("file://") & (F.length(x) > 7), link(x)).otherwise(x)), "")


def utc_time(seconds: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` in UTC (the session's time zone is UTC)."""
    return F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyy-MM-dd HH:mm:ss")


def python_float(value: Column) -> Column:
    """A double as Python prints it, for 1e-4 <= |x| < 1e16; other magnitudes as Spark prints them."""
    text = value.cast("string")
    number = F.regexp_extract(text, r"^(-?)(\d)\.(\d+)E(\d+)$", 0) != ""
    sign, one, rest = (F.regexp_extract(text, r"^(-?)(\d)\.(\d+)E(\d+)$", i) for i in (1, 2, 3))
    exponent = F.regexp_extract(text, r"^(-?)(\d)\.(\d+)E(\d+)$", 4).try_cast("int")
    rest = F.regexp_replace(rest, "0+$", "")
    digits = F.concat(one, F.rpad(rest, F.greatest(exponent, F.length(rest)), F.lit("0")))
    whole, part = F.substring(digits, F.lit(1), exponent + 1), F.substring(digits, exponent + 2, F.lit(40))
    plain = F.concat(sign, whole, F.lit("."), F.when(part == "", F.lit("0")).otherwise(part))
    return F.when(number & (exponent < 16), plain).otherwise(text)


def point_hash(chunk_index: Column, chunks_total: Column, path: Column, mtime: Column, line_range: Column, page_range: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the point's identity; empty ranges count as none."""
    text = lambda r: F.coalesce(_nonempty(r).cast("string"), F.lit(""))
    whole = F.concat(
        F.coalesce(chunk_index.cast("string"), F.lit("")), F.coalesce(chunks_total.cast("string"), F.lit("")), F.coalesce(path, F.lit("")),
        F.coalesce(python_float(mtime), F.lit("")), text(line_range), text(page_range),
    )
    return F.substring(F.sha1(whole), 1, 16)


def reference(path: Column, page_range: Column, line_range: Column, chunk_index: Column, chunks_total: Column, mtime: Column | None = None) -> Column:
    """``<uri> · <label or chunk i/n>``; with ``mtime`` also chunk and UTC time behind a label."""
    chunk = F.concat(F.lit("chunk "), (chunk_index + 1).cast("string"), F.lit("/"), chunks_total.cast("string"))
    named = label(page_range, line_range)
    parts = [file_uri(path), F.coalesce(named, chunk)]
    if mtime is not None:
        parts += [F.when(named.isNotNull(), chunk), utc_time(mtime)]
    return F.concat_ws(" · ", *parts)


def hamming(a: Column, b: Column) -> Column:
    """Positions in which two strings of equal length differ; null for different lengths."""
    differ = F.transform(F.split(a, ""), lambda x, i: F.when(x == F.substring(b, i + 1, F.lit(1)), 0).otherwise(1))
    return F.when(F.length(a) == F.length(b), F.aggregate(differ, F.lit(0), lambda s, x: s + x))
