"""Error categories and messages as column expressions, and the exceptions of the Python surface."""

from __future__ import annotations

import re
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryspark.functions.text import _col, js_trim

#: fixed values: categories
CATEGORIES = ("config", "http_error", "timeout", "network", "parse_error", "validation", "unknown")
RETRYABLE = ("timeout", "network", "http_error", "parse_error")
#: fixed value: system error codes that mean the network
NETWORK_CODES = ("ECONNRESET", "ECONNREFUSED", "EPIPE", "ETIMEDOUT", "EAI_AGAIN", "ENOTFOUND", "EHOSTUNREACH", "ENETUNREACH", "EHOSTDOWN", "EACCES", "EADDRINUSE", "EADDRNOTAVAIL")
TRANSIENT_FETCH_CODES = ("ECONNRESET", "ETIMEDOUT", "ECONNREFUSED", "EAI_AGAIN")
#: fixed values: tool results
RESPONSE_CHARS, RESPONSE_SUFFIX = 25_000, "\n\n[Response truncated due to length]"
TIMED_OUT = "Research timed out. Please try reducing max_results or try again later."

#: fixed values: words by category; the first that matches names it, as messages such as
#: "connection timed out" or "HTTP 500: parse error" fit several
_CLASSES = (
    ("timeout", "timeout|timed out"),
    ("network", "dns|econnrefused|enotfound|network|unreachable|connection"),
    ("http_error", r"\Ahttp |\bhttp [0-9]{3}\b"),
    ("parse_error", "parse|extract"),
    ("validation", "validation|invalid url|url is required|ssrf|loopback|private"),
)


def error_category(c: Column | str) -> Column:
    text, out = F.lower(_col(c)), None
    for name, pattern in _CLASSES:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise("unknown")


def fetch_error_message(url: Column | str, error: Column | str, timeout_ms: int = 15_000) -> Column:
    """What a user reads when a single page can't be fetched."""
    u, e = _col(url), _col(error)
    kind, status = error_category(e), F.coalesce(F.regexp_extract(e, r"\bHTTP ([0-9]{3})\b", 1).try_cast("int"), F.lit(0))
    code = status.cast("string")
    by_status = (
        F.when(status == 404, F.concat(F.lit("The page returned 404 — verify the URL is correct ("), u, F.lit(")")))
        .when(status.isin(401, 403), F.concat(F.lit("The page returned "), code, F.lit(" — the page requires authentication or blocks automated access ("), u, F.lit(")")))
        .when(status == 429, F.concat(F.lit("The page returned 429 (Too Many Requests) — the site is rate-limiting requests ("), u, F.lit(")")))
        .otherwise(F.concat(F.lit("The page returned HTTP "), code, F.lit(" — the server returned an error ("), u, F.lit(")")))
    )
    return (
        F.when((kind == "http_error") & (status > 0), by_status)
        .when(kind == "timeout", F.concat(F.lit("The request to "), u, F.lit(f" timed out after {timeout_ms}ms. Check connectivity or increase SCRAPE_TIMEOUT_MS.")))
        .when(kind == "network", F.concat(F.lit("The URL "), u, F.lit(" could not be reached. Verify network connectivity and that the URL is correct.")))
        .when(kind == "validation", e)
        .otherwise(F.concat(F.lit("Failed to scrape "), u, F.lit(": "), e))
    )


def http_error_text(status: Column | str, status_text: Column | str, url: Column | str) -> Column:
    s = _col(status)
    said = F.when(s.isin(401, 403), "Page requires authentication or blocks bots").when(s == 404, "Page not found").when(s == 429, "Too Many Requests").otherwise(_col(status_text))
    return F.concat(F.lit("HTTP "), s.cast("string"), F.lit(": "), said, F.lit(" ("), _col(url), F.lit(")"))


def is_retryable(category: Column | str) -> Column:
    return _col(category).isin(*RETRYABLE)


def is_timeout(message: Column | str, name: Column | None = None) -> Column:
    found = F.lower(_col(message)).rlike("timeout|timed out|timedout|aborted")
    return F.coalesce(found if name is None else found | F.lower(name).rlike("timeout|timedout|timed_out"), F.lit(False))


def tool_error(message: Column | str) -> Column:
    return F.when(is_timeout(message), F.lit(TIMED_OUT)).otherwise(F.concat(F.lit("Internal error: "), F.coalesce(_col(message), F.lit("Unknown error")), F.lit(". See server logs for details.")))


def tool_success(digest: Column | str) -> Column:
    d = _col(digest)
    return F.when(F.length(d) > RESPONSE_CHARS, F.concat(F.left(d, F.lit(RESPONSE_CHARS)), F.lit(RESPONSE_SUFFIX))).otherwise(d)


def retry_after_ms(header: Column | str, now: Column | None = None, *, most: int | None = 10_000, default: int | None = None) -> Column:
    """Milliseconds to wait from seconds or an HTTP date; ``default`` for nothing or nonsense, at most ``most``."""
    t = js_trim(header)
    then = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(t, r"\A[A-Za-z]{3}, ", ""), r" GMT\z", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    until = F.when(then.isNotNull(), F.greatest(F.lit(0).cast("long"), F.unix_millis(then) - F.unix_millis(now if now is not None else F.current_timestamp())))
    wait = F.when(t.rlike(r"\A[0-9]+\z"), t.try_cast("long") * 1000).otherwise(until)
    return F.coalesce(wait if most is None else F.when(wait > most, F.lit(most).cast("long")).otherwise(wait), F.lit(default).cast("long"))


def seconds_to_wait(header: str | None, now: datetime | None = None) -> float | None:
    """The same for a client: seconds from a number or an HTTP date, None for nothing or nonsense."""
    text = (header or "").strip()
    if re.fullmatch("[0-9]+", text):
        return float(text)
    try:
        until = parsedate_to_datetime(text)
    except (TypeError, ValueError):
        return None
    until = until if until.tzinfo else until.replace(tzinfo=UTC)
    return max(0.0, (until - (now or datetime.now(UTC))).total_seconds())


def backoff_ms(attempt: Column | str, base: int = 500, retry_after: Column | None = None, jitter: Column | float = 0.0, most: int = 10_000) -> Column:
    """base * 2**attempt, with a jitter share in [-0.2, 0.2]; a server's own wish comes first."""
    j = jitter if isinstance(jitter, Column) else F.lit(jitter)
    own = F.greatest(F.lit(0).cast("long"), F.round(base * F.pow(F.lit(2.0), _col(attempt)) * (1 + j)).cast("long"))
    return own if retry_after is None else F.coalesce(F.least(F.greatest(retry_after, F.lit(0)), F.lit(most)).cast("long"), own)


class CorpusError(Exception):
    """Base of what this library raises; ``category`` is one of CATEGORIES."""

    category = "unknown"

    def __init__(self, message: str, *, status: int | None = None, excerpt: str = ""):
        super().__init__(message)
        self.status, self.excerpt = status, excerpt


class ConfigError(CorpusError):
    category = "config"


class HttpError(CorpusError):
    category = "http_error"


class FetchTimeout(CorpusError):
    category = "timeout"


class NetworkError(CorpusError):
    category = "network"


class ParseError(CorpusError):
    category = "parse_error"


class ValidationError(CorpusError):
    category = "validation"


class AuthError(HttpError):
    """A model endpoint refused the key."""


class PipelineError(CorpusError):
    """A stage left nothing to go on with."""


class PipelineTimeout(PipelineError):
    category = "timeout"


def retryable(error: BaseException) -> bool:
    return isinstance(error, CorpusError) and error.category in RETRYABLE
