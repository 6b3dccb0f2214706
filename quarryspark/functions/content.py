"""Content types, charsets and extraction.

Routing is column expressions. What Spark has no expression for (pretty JSON, lenient XML,
unusual charsets, decompression, readable text of HTML) runs in Arrow functions, a batch at
a time. What the readable text of a page is, ``functions.readable`` says.
"""

from __future__ import annotations

import codecs
import html
import json
import re
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryspark.functions.readable import readable
from quarryspark.functions.text import WS, _col, js_trim

#: fixed value: types that are never text
BINARY_PREFIXES = (
    "image/", "video/", "audio/", "font/", "application/octet-stream", "application/pdf", "application/zip", "application/gzip", "application/x-tar", "application/x-gzip", "application/x-bzip2", "application/x-7z-compressed", "application/x-rar-compressed",
    "application/msword", "application/vnd.ms-excel", "application/vnd.ms-powerpoint", "application/vnd.openxmlformats", "application/x-binary", "application/x-shockwave-flash",
)
SNIFFED_CHARS = META_BYTES = 512
MIN_READABLE_CHARS = 200
#: fixed value: types by what they are treated as; other ones are sniffed
KNOWN_TYPES = {"json": ("application/json",), "xml": ("application/xml", "text/xml", "application/rss+xml", "application/atom+xml"), "text": ("text/plain", "text/markdown"), "html": ("text/html", "application/xhtml+xml")}
METHODS = {"json": "json", "xml": "xml", "text": "raw-text"}


def primary_type(c: Column | str) -> Column:
    """``text/html`` of ``Text/HTML; charset=...``; '' for null."""
    return F.coalesce(F.lower(js_trim(F.substring_index(_col(c), ";", 1))), F.lit(""))


def is_binary_type(c: Column | str) -> Column:
    return _col(c).rlike(r"\A(?:" + "|".join(p.replace("+", r"\+").replace(".", r"\.") for p in BINARY_PREFIXES) + ")")


def sniff_type(body: Column | str) -> Column:
    """html, xml, json or text, from the first 512 characters."""
    head = F.lower(F.left(_col(body), F.lit(SNIFFED_CHARS)))
    start = F.regexp_replace(head, f"\\A[{WS}]+", "")
    return F.when(head.rlike("<html|<!doctype|<body"), "html").when(start.startswith("<?xml"), "xml").when(start.rlike(r"\A[{\[]"), "json").otherwise("text")


def content_kind(content_type: Column | str, body: Column | str) -> Column:
    """binary, json, xml, text or html; by the header where it says something we know, else sniffed."""
    p = primary_type(content_type)
    out = F.when(is_binary_type(p), "binary")
    for kind, names in KNOWN_TYPES.items():
        out = out.when(p.isin(*names), kind)
    return out.otherwise(sniff_type(body))


def _pretty(text: str) -> str:
    def refuse(_: str) -> None:
        raise ValueError("not a JSON number")

    def number(x: float | int) -> float | int:
        return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 1e21 else x

    def walk(v: object) -> object:
        if isinstance(v, dict):
            return {k: walk(x) for k, x in v.items()}
        if isinstance(v, list):
            return [walk(x) for x in v]
        return number(v) if isinstance(v, float) else v

    return re.sub(r"\[\s+\]|\{\s+\}", lambda m: m[0][0] + m[0][-1], json.dumps(walk(json.loads(text, parse_constant=refuse)), indent=2, ensure_ascii=False))


@F.pandas_udf(T.StringType())
def format_json(texts: pd.Series) -> pd.Series:
    """Indented by two spaces; null where the text is no JSON."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else _pretty(t)
        except (ValueError, RecursionError):
            return None

    return texts.map(one)


def xml_text(t: str) -> str:
    """All character data of a document that need not be well-formed."""
    t = re.sub(r"<!--.*?(?:-->|\Z)|<\?.*?(?:\?>|\Z)|<!DOCTYPE(?:[^\[>]|\[.*?\])*>", "", t, flags=re.S | re.I)
    parts = re.split(r"<!\[CDATA\[(.*?)(?:\]\]>|\Z)", t, flags=re.S)
    return "".join(p if k % 2 else html.unescape(re.sub(r"<[^>]*>", "", p)) for k, p in enumerate(parts)).strip()


@F.pandas_udf(T.StringType())
def strip_xml(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else xml_text(t))


def header_charset(content_type: Column | str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(_col(content_type), r"(?i)charset\s*=\s*[\"']?([^\s\"';,]+)", 1)), F.lit(""))


def meta_charset(body: Column | str) -> Column:
    head = F.decode(F.substring(_col(body), 1, META_BYTES), "ISO-8859-1")
    return F.nullif(F.lower(F.regexp_extract(head, r"(?i)<meta[^>]+charset\s*=\s*[\"']?\s*([^\s\"'/>;]+)", 1)), F.lit(""))


def detect_charset(content_type: Column | str, body: Column | str) -> Column:
    return F.coalesce(header_charset(content_type), meta_charset(body), F.lit("utf-8"))


@F.pandas_udf(T.StringType())
def decode_bytes(bodies: pd.Series, charsets: pd.Series) -> pd.Series:
    """Text of the bytes; unknown charsets as UTF-8, with replacement characters for what is broken."""

    def one(b: bytes | None, name: str | None) -> str | None:
        if b is None:
            return None
        try:
            codecs.lookup(name or "utf-8")
        except LookupError:
            name = "utf-8"
        return bytes(b).decode(name or "utf-8", "replace").removeprefix("﻿")

    return pd.Series([one(b, n) for b, n in zip(bodies, charsets, strict=True)])


def replacement_share(c: Column | str) -> Column:
    n = F.length(_col(c))
    return F.when(n > 0, (n - F.length(F.replace(_col(c), F.lit("�"), F.lit("")))) / n).otherwise(F.lit(0.0))


MOST_INFLATED_BYTES = 256 * 1024 * 1024


def _bounded(body: bytes, window: int) -> bytes:
    """Decompressed up to MOST_INFLATED_BYTES, zlib.error beyond; gzip members one after another."""
    out, left = [], body
    while left:
        d = zlib.decompressobj(window)
        out.append(d.decompress(left, MOST_INFLATED_BYTES - sum(map(len, out))))
        if d.unconsumed_tail or not d.eof:
            raise zlib.error("too large or cut off")
        left = d.unused_data.lstrip(b"\0") if window == 31 else b""
    return b"".join(out)


def inflate(body: bytes, encoding: str | None) -> bytes:
    """As the content encoding says; unchanged where that fails, as where it would be over MOST_INFLATED_BYTES."""
    try:
        kind = (encoding or "").strip().lower()
        if kind in ("gzip", "x-gzip"):
            return _bounded(body, 31)
        if kind == "deflate":
            try:
                return _bounded(body, 15)
            except zlib.error:
                return _bounded(body, -15)
        if kind == "br":
            import brotli  # where it is installed

            return brotli.decompress(body)
    except Exception:  # noqa: BLE001  whatever is wrong with the body, it stays as it is
        return body
    return body


@F.pandas_udf(T.BinaryType())
def decompress(bodies: pd.Series, encodings: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else inflate(bytes(b), e) for b, e in zip(bodies, encodings, strict=True)])


_READ = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("method", T.StringType()), T.StructField("error", T.StringType())])


def _extracted(pages: pd.Series, open_references: bool) -> pd.DataFrame:
    rows = [readable(p, open_references) for p in pages]
    short = [len(t) < MIN_READABLE_CHARS for _, t in rows]
    return pd.DataFrame({"title": [a for a, _ in rows], "text": [t for _, t in rows], "method": ["readability-failed" if s else "readability" for s in short], "error": ["content too short" if s else None for s in short]})


@F.pandas_udf(_READ)
def _extract(pages: pd.Series) -> pd.DataFrame:
    return _extracted(pages, True)


@F.pandas_udf(_READ)
def _extract_closed(pages: pd.Series) -> pd.DataFrame:
    return _extracted(pages, False)


def extract_readable(c: Column | str, open_references: bool = True) -> Column:
    """struct(title, text, method, error); under 200 characters the extraction counts as failed.

    ``open_references``: whether character references without a semicolon are decoded, as in browsers.
    """
    return (_extract if open_references else _extract_closed)(_col(c))


def route_content(content_type: Column | str, body: Column | str) -> Column:
    """struct(kind, text, method, error); the text of HTML comes from ``extract_readable``."""
    b = _col(body)
    kind = content_kind(content_type, b)
    text = F.when(kind == "json", F.coalesce(format_json(b), b)).when(kind == "xml", strip_xml(b)).when(kind == "text", b)
    method = F.when(kind == "json", METHODS["json"]).when(kind == "xml", METHODS["xml"]).when(kind == "text", METHODS["text"])
    error = F.when(kind == "binary", F.concat(F.lit("Unsupported content type: "), primary_type(content_type)))
    return F.struct(kind.alias("kind"), text.alias("text"), method.alias("method"), error.alias("error"))
