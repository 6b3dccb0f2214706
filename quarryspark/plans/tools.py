"""The two tools as a host calls them: parameter checks, dispatch, results."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from urllib.parse import urlsplit

from quarryspark.functions.failures import RESPONSE_CHARS, RESPONSE_SUFFIX, TIMED_OUT, ValidationError

TOOLS = ("web_search", "web_fetch")


@dataclass(frozen=True)
class SearchParams:
    query: str
    max_results: int = 5
    focus: str | None = None


@dataclass(frozen=True)
class FetchParams:
    url: str
    focus: str | None = None


@dataclass(frozen=True)
class ToolResult:
    text: str
    is_error: bool = False


def _known(args: object, names: tuple[str, ...]) -> Mapping[str, object]:
    if not isinstance(args, Mapping):
        raise ValidationError("arguments must be an object")
    extra = [k for k in args if k not in names]
    if extra:
        raise ValidationError(f"unknown parameter: {extra[0]}")
    if args.get("focus") is not None and not isinstance(args["focus"], str):
        raise ValidationError("focus must be a string")
    return args


def search_params(args: object) -> SearchParams:
    a = _known(args, ("query", "max_results", "focus"))
    q, n = a.get("query"), a.get("max_results", 5)
    if not isinstance(q, str) or not q:
        raise ValidationError("query must be a non-empty string")
    if isinstance(n, bool) or not isinstance(n, int) or n <= 0:
        raise ValidationError("max_results must be a positive integer")
    return SearchParams(q, n, a.get("focus"))


def fetch_params(args: object) -> FetchParams:
    a = _known(args, ("url", "focus"))
    u = a.get("url")
    if not isinstance(u, str) or not u:
        raise ValidationError("url must be a non-empty string")
    if not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", u) or not (urlsplit(u).netloc or urlsplit(u).path):
        raise ValidationError(f"Invalid URL format: {u}")
    return FetchParams(u, a.get("focus"))


def success(text: str) -> ToolResult:
    return ToolResult(text if len(text) <= RESPONSE_CHARS else text[:RESPONSE_CHARS] + RESPONSE_SUFFIX)


def failure(error: BaseException) -> ToolResult:
    seen = f"{type(error).__name__} {error}".lower()
    if any(w in seen for w in ("timeout", "timed out", "timedout", "timed_out", "aborted")):
        return ToolResult(TIMED_OUT, True)
    return ToolResult(f"Internal error: {error}. See server logs for details.", True)


def dispatcher(run_search: Callable[[SearchParams], str], run_fetch: Callable[[FetchParams], str]) -> Callable[[str, object], ToolResult]:
    """``call(name, arguments)`` that never raises."""

    def call(name: str, args: object) -> ToolResult:
        if name not in TOOLS:
            return ToolResult(f"Unknown tool: {name}. Available tools: {', '.join(TOOLS)}", True)
        try:
            return success(run_search(search_params(args)) if name == "web_search" else run_fetch(fetch_params(args)))
        except ValidationError as e:
            return ToolResult(str(e), True)
        except Exception as e:  # noqa: BLE001  a tool reports, it doesn't raise
            return failure(e)

    return call
