"""Text functions as column expressions; only ``fnv1a32`` and what is built on it runs in an Arrow function.

Lengths and positions count characters (code points). ``fnv1a32`` hashes UTF-16 code units.
White space is the set that web scripts mean by it, spelled out in ``WS``, as Spark's own
``\\s`` and ``trim`` know ASCII or plain spaces only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

#: fixed value: white space, as the inside of a character class
WS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: the same characters one by one
WHITE = WS.replace("\u2000-\u200a", "".join(map(chr, range(0x2000, 0x200B))))
#: fixed values: ranges of characters that count as 1.5 to a token
CJK_RANGES = (
    (0x3000, 0x303F),
    (0x3040, 0x309F),
    (0x30A0, 0x30FF),
    (0x3400, 0x4DBF),
    (0x4E00, 0x9FFF),
    (0x1100, 0x11FF),
    (0xAC00, 0xD7AF),
    (0xF900, 0xFAFF),
    (0xFF00, 0xFFEF),
    (0x20000, 0x2FFFF),
)
#: the same as the inside of a character class
CJK = "".join(f"{chr(lo)}-{chr(hi)}" for lo, hi in CJK_RANGES)
#: fixed values: FNV-1a, 32 bits
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619

MIN_PARAGRAPH_CHARS = 20
TITLE_CHARS, SNIPPET_CHARS = 500, 1000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c: Column | str) -> Column:
    """Without white space at both ends; by a set of characters, as a pattern is tried at each white space of a text."""
    return F.trim(_col(c), F.lit(WHITE))


def trim_end(c: Column | str) -> Column:
    return F.rtrim(_col(c), F.lit(WHITE))


def collapse_white(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"[{WS}]+", " ")


def is_blank(c: Column | str) -> Column:
    """True for null, empty and white-space-only text."""
    return ~F.coalesce(_col(c).rlike(f"[^{WS}]"), F.lit(False))


def segment_paragraphs(c: Column | str, min_chars: int = MIN_PARAGRAPH_CHARS) -> Column:
    """Paragraphs of at least ``min_chars``: break tags are one newline, two newlines part paragraphs."""
    least = min_chars if min_chars >= 1 else MIN_PARAGRAPH_CHARS
    lines = F.regexp_replace(F.regexp_replace(_col(c), r"(?i)<(?:br\s*/?|/p|/div)>", "\n"), "\r\n?", "\n")
    # collapsed white space is plain spaces, so a plain trim does
    cleaned = F.transform(F.split(lines, "\n{2,}"), lambda p: F.trim(collapse_white(p)))
    return F.when(is_blank(c), F.array().cast("array<string>")).otherwise(F.filter(cleaned, lambda p: F.length(p) >= least))


def normalize_paragraph(c: Column | str) -> Column:
    return F.lower(F.trim(collapse_white(c)))


def fnv_hashes(texts: pa.StringArray) -> np.ndarray:
    """FNV-1a, 32 bits, over the UTF-16 code units of every text: all texts step together, the last few long ones alone."""
    units = [np.frombuffer((t or "").encode("utf-16-le", "surrogatepass"), "<u2") for t in texts.to_pylist()]
    lengths = np.fromiter(map(len, units), "int64", len(units))
    order = np.argsort(-lengths, kind="stable")
    flat = np.concatenate([units[k] for k in order]).astype("uint32") if len(units) else np.empty(0, "uint32")
    begin = np.concatenate([[0], np.cumsum(lengths[order])])
    h, prime = np.full(len(units), FNV_OFFSET, "uint32"), np.uint32(FNV_PRIME)
    upto = int(lengths[order[15]]) if len(units) > 16 else 0
    alive = np.searchsorted(-lengths[order], -np.arange(1, upto + 1), "right")  # texts of at least so many units
    for at in range(upto):
        n = alive[at]
        h[:n] = (h[:n] ^ flat[begin[:n] + at]) * prime
    for k in range(int(np.count_nonzero(lengths > upto))):
        x = int(h[k])
        for u in flat[begin[k] + upto : begin[k + 1]].tolist():
            x = (x ^ u) * FNV_PRIME & 0xFFFFFFFF
        h[k] = x
    out = np.empty(len(units), "int64")
    out[order] = h
    return out


@F.arrow_udf(LongType())
def _fnv(texts: pa.Array) -> pa.Array:
    return pa.array(fnv_hashes(texts), mask=texts.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(ArrayType(LongType()))
def _fnv_of_lists(lists: pa.Array) -> pa.Array:
    sizes = pa.compute.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
    hashes = pa.array(fnv_hashes(lists.flatten()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("int32"), mask=np.append(lists.is_null().to_numpy(zero_copy_only=False), False)), hashes)


def fnv1a32(c: Column | str) -> Column:
    """FNV-1a over UTF-16 code units, 0..2**32-1."""
    return _fnv(_col(c))


def fingerprint_set(c: Column | str, min_chars: int = MIN_PARAGRAPH_CHARS) -> Column:
    """Sorted distinct hashes of the normalized paragraphs.

    Paragraphs come trimmed and collapsed, so lower case is all that is left to do; it is done
    in a step of its own, as a lambda's argument is computed once and an expression each time.
    """
    return F.array_sort(F.array_distinct(_fnv_of_lists(F.transform(segment_paragraphs(c, min_chars), F.lower))))


def truncate_field(c: Column | str, most: int) -> Column:
    """At most ``most`` characters, the last three dots where something is cut."""
    return F.when(F.length(_col(c)) > most, F.concat(F.left(_col(c), F.lit(most - 3)), F.lit("..."))).otherwise(_col(c))


def truncate_at_word(c: Column | str, most: int, marker: str = "…[truncated]") -> Column:
    """Cut at the last white space at or before position ``most``, or there; ``most`` <= 0 keeps all."""
    if most <= 0:
        return _col(c)
    head = F.left(_col(c), F.lit(most + 1))
    cut = F.when(head.rlike(f"[{WS}]"), F.regexp_extract(head, f"(?s)\\A(.*)[{WS}]", 1)).otherwise(F.left(_col(c), F.lit(most)))
    return F.when(F.length(_col(c)) > most, F.concat(trim_end(cut), F.lit(marker))).otherwise(_col(c))


def hard_cut(c: Column | str, most: Column | int) -> Column:
    """The first ``most`` characters, without trailing white space, and an ellipsis."""
    most = most if isinstance(most, Column) else F.lit(most)
    return F.when(F.length(_col(c)) > most, F.concat(trim_end(F.left(_col(c), most)), F.lit("…"))).otherwise(_col(c))


def _to_first_period(c: Column | str) -> Column:
    """Up to the first period if white space or the end follows it, else ''."""

    def cut(t: Column, at: Column) -> Column:
        return F.when((at > 0) & F.substr(t, at + 1, F.lit(1)).rlike(f"\\A[{WS}]?\\z"), F.left(t, at)).otherwise(F.lit(""))

    # a lambda's argument is computed once, an expression each time it stands
    return F.transform(F.array(js_trim(c)), lambda t: F.transform(F.array(F.instr(t, ".")), lambda at: cut(t, at))[0])[0]


def first_sentence(c: Column | str) -> Column:
    return F.coalesce(F.nullif(js_trim(_to_first_period(c)), F.lit("")), js_trim(c))


def key_point_sentence(c: Column | str, most: int = 200) -> Column:
    return F.coalesce(F.nullif(js_trim(_to_first_period(c)), F.lit("")), F.left(js_trim(c), F.lit(most)))


def cjk_count(c: Column | str) -> Column:
    """How many characters are in CJK_RANGES: what lies below all ranges goes in runs, the rest one by one."""
    t = _col(c)
    below = chr(min(lo for lo, _ in CJK_RANGES) - 1)
    return F.when(F.octet_length(t) == F.length(t), F.lit(0)).otherwise(F.length(F.regexp_replace(F.regexp_replace(t, f"[\\x00-{below}]++", ""), f"[^{CJK}]", "")))


def estimate_tokens(c: Column | str) -> Column:
    """ceil(cjk / 1.5 + other / 4); 0 for blank text."""
    length = F.length(_col(c))
    # a lambda's argument is computed once, an expression each time it stands
    tokens = F.transform(F.array(cjk_count(c)), lambda cjk: F.ceil(cjk / F.lit(1.5) + (length - cjk) / F.lit(4.0)))[0]
    return F.when(is_blank(c), F.lit(0).cast("long")).otherwise(tokens)


def token_threshold(context: int, ratio: float) -> int:
    return int(context * ratio // 1)


def within_budget(c: Column | str, context: int = 128_000, ratio: float = 0.8) -> Column:
    return estimate_tokens(c) <= token_threshold(context, ratio)


def clean_title(c: Column | str) -> Column:
    """Without one bullet, one number, bold marks and trailing separators."""
    t = F.regexp_replace(js_trim(c), f"\\A[-*•][{WS}]*", "")
    t = F.regexp_replace(t, f"\\A[0-9]+[.)][{WS}]*", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\A\*{1,2}", ""), r"\*{1,2}\z", "")
    return js_trim(F.regexp_replace(t, r"[:\-–—,;]+\z", ""))


def query_for_log(c: Column | str, most: int = 80) -> Column:
    return F.left(_col(c), F.lit(most))
