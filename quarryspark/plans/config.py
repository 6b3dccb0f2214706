"""Settings: defaults, environment, overrides, in rising order. Bad values in the environment give the default."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from quarryspark.functions.failures import ConfigError

#: fixed value: nodes that are asked where no own one is named
PUBLIC_NODES = ("https://searx.be", "https://search.bus-hit.me", "https://searx.tiekoetter.com")


def positive_int(raw: str | None, default: int, most: int | None = None) -> int:
    """Digits above 0 (and at most ``most``), else the default."""
    text = (raw or "").strip()
    if re.fullmatch(r"\d+", text) and 0 < int(text) and (most is None or int(text) <= most):
        return int(text)
    return default


def any_int(raw: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d+)", raw or "")
    return int(m[1]) if m else default


def ratio(raw: str | None, default: float, zero: bool) -> float:
    try:
        x = float(raw or "")
    except ValueError:
        return default
    return x if (0 <= x if zero else 0 < x) and x <= 1 else default


@dataclass(frozen=True)
class DedupConfig:
    similarity_threshold: float = 0.85
    min_paragraph_chars: int = 20
    extra_tracking_params: tuple[str, ...] = ()

    @classmethod
    def load(cls, env: Mapping[str, str] = os.environ, **overrides) -> DedupConfig:
        names = tuple(p for p in (x.strip() for x in env.get("DEDUP_EXTRA_TRACKING_PARAMS", "").split(",")) if p)
        return cls(**{"similarity_threshold": ratio(env.get("DEDUP_SIMILARITY_THRESHOLD"), 0.85, True), "min_paragraph_chars": positive_int(env.get("MIN_PARAGRAPH_CHARS"), 20), "extra_tracking_params": names} | overrides)


@dataclass(frozen=True)
class SearchConfig:
    timeout_ms: int = 10_000
    max_retries: int = 2
    retry_base_ms: int = 500
    max_results: int = 10
    ceiling_ms: int = 30_000
    categories: str | None = None

    @classmethod
    def load(cls, env: Mapping[str, str] = os.environ, **overrides) -> SearchConfig:
        return cls(**{"timeout_ms": positive_int(env.get("SEARXNG_TIMEOUT_MS"), 10_000), "max_retries": positive_int(env.get("SEARXNG_MAX_RETRIES"), 2), "retry_base_ms": positive_int(env.get("SEARXNG_RETRY_BASE_MS"), 500)} | overrides)


@dataclass(frozen=True)
class ScrapeConfig:
    timeout_ms: int = 15_000
    max_content_chars: int = 8_000
    max_redirects: int = 5
    min_content_chars: int = 200
    #: whether character references of HTML that lack their semicolon are decoded, as in browsers
    open_references: bool = True

    @classmethod
    def load(cls, env: Mapping[str, str] = os.environ, **overrides) -> ScrapeConfig:
        return cls(**{"timeout_ms": positive_int(env.get("SCRAPE_TIMEOUT_MS"), 15_000), "max_content_chars": any_int(env.get("MAX_CONTENT_CHARS"), 8_000)} | overrides)


@dataclass(frozen=True)
class PipelineConfig:
    concurrency: int = 3
    scrape_timeout_ms: int = 15_000
    max_content_chars: int = 8_000
    pipeline_timeout_ms: int = 30_000

    @classmethod
    def load(cls, env: Mapping[str, str] = os.environ, **overrides) -> PipelineConfig:
        s = ScrapeConfig.load(env)
        return cls(**{"concurrency": positive_int(env.get("MAX_CONCURRENCY"), 3, 100), "scrape_timeout_ms": s.timeout_ms, "max_content_chars": s.max_content_chars, "pipeline_timeout_ms": positive_int(env.get("PIPELINE_TIMEOUT_MS"), 30_000)} | overrides)


@dataclass(frozen=True)
class ModelConfig:
    api_key: str = ""
    base_url: str = ""
    model: str = ""
    timeout_ms: int = 60_000
    context_tokens: int = 128_000
    safe_ratio: float = 0.8
    batch_concurrency: int = 2
    temperature: float = 0.3
    answer_tokens: int = 4096

    @classmethod
    def load(cls, env: Mapping[str, str] = os.environ, **overrides) -> ModelConfig:
        return cls(**{"api_key": env.get("LLM_API_KEY", ""), "base_url": env.get("LLM_BASE_URL", ""), "model": env.get("LLM_MODEL", ""), "timeout_ms": positive_int(env.get("LLM_TIMEOUT_MS"), 60_000), "context_tokens": positive_int(env.get("LLM_MAX_CONTEXT_TOKENS"), 128_000), "safe_ratio": ratio(env.get("LLM_SAFE_THRESHOLD_RATIO"), 0.8, False), "batch_concurrency": positive_int(env.get("LLM_MAX_BATCH_CONCURRENCY"), 2)} | overrides)

    def require_key(self) -> ModelConfig:
        if not self.api_key.strip():
            raise ConfigError("LLM_API_KEY is required")
        return self


@dataclass
class NodePool:
    """Search nodes in the order they are tried: one own node without failover, or the public ones."""

    nodes: list[str] = field(default_factory=lambda: list(PUBLIC_NODES))
    own: bool = False
    cursor: int = 0

    @classmethod
    def load(cls, env: Mapping[str, str] = os.environ) -> NodePool:
        url = env.get("SEARXNG_URL", "").strip()
        if not url:
            return cls()
        if not re.match(r"(?i)https?://[^\s/?#]+", url):
            raise ConfigError("SEARXNG_URL must be a valid HTTP(S) URL")
        return cls([url], True)

    @property
    def current(self) -> str:
        return self.nodes[self.cursor]

    @property
    def has_more(self) -> bool:
        return self.cursor + 1 < len(self.nodes)

    def advance(self) -> bool:
        self.cursor += self.has_more
        return self.cursor > 0 and self.nodes[self.cursor] != self.nodes[self.cursor - 1]

    def promote(self, node: str) -> None:
        """Move a node that answered to the front."""
        if node in self.nodes:
            self.nodes.remove(node)
            self.nodes.insert(0, node)
            self.cursor = 0

    def reset(self) -> None:
        self.cursor = 0


def as_dict(config) -> dict[str, object]:
    return {f.name: getattr(config, f.name) for f in fields(config)}
