"""Calls of a language model, with retries, behind a protocol; Spark maps them over prompts."""

from __future__ import annotations

import json
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from quarryspark.functions.failures import NETWORK_CODES, AuthError, ConfigError, CorpusError, FetchTimeout, HttpError, NetworkError, ParseError
from quarryspark.plans.config import ModelConfig
from quarryspark.runtime import extended


class Model(Protocol):
    """What a client must offer; it raises CorpusError kinds or errors with ``status`` or ``code``."""

    def complete(self, system: str, user: str, *, temperature: float, max_tokens: int, timeout_s: float) -> str: ...


MOST_ANSWER_BYTES = 16 * 1024 * 1024


class _NoRedirects(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_: object) -> None:
        return None


_OPENER = urllib.request.build_opener(_NoRedirects)


@dataclass(frozen=True)
class ChatModel:
    """A client of an endpoint that speaks the chat completions protocol; it neither retries nor shows its key.

    Redirects are not followed, as they would carry the key to where it does not belong: they
    are errors with their status. Answers over MOST_ANSWER_BYTES are errors too.
    """

    base_url: str
    name: str
    key: str = field(repr=False)

    @classmethod
    def of(cls, config: ModelConfig) -> ChatModel:
        """ConfigError without a key or an HTTP(S) address."""
        config.require_key()
        if not re.match(r"(?i)https?://[^\s/?#]+", config.base_url):
            raise ConfigError("LLM_BASE_URL must be a valid HTTP(S) URL")
        return cls(config.base_url, config.model, config.api_key)

    def complete(self, system: str, user: str, *, temperature: float, max_tokens: int, timeout_s: float) -> str:
        said = {"model": self.name, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "temperature": temperature, "max_tokens": max_tokens}
        asked = urllib.request.Request(self.base_url.rstrip("/") + "/chat/completions", json.dumps(said).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        try:
            with _OPENER.open(asked, timeout=timeout_s) as r:
                body = r.read(MOST_ANSWER_BYTES + 1)
            if len(body) > MOST_ANSWER_BYTES:
                raise ParseError(f"the endpoint's answer has over {MOST_ANSWER_BYTES} bytes")
            answer = json.loads(body)
            return answer["choices"][0]["message"]["content"] or ""
        except urllib.error.HTTPError as e:
            raise (AuthError if e.code in (401, 403) else HttpError)(f"HTTP {e.code}: {e.reason}", status=e.code) from e
        except (ValueError, LookupError, TypeError) as e:
            raise ParseError("the endpoint's answer holds no message") from e
        except TimeoutError as e:
            raise FetchTimeout("the model timed out") from e
        except OSError as e:
            if isinstance(getattr(e, "reason", None), TimeoutError):
                raise FetchTimeout("the model timed out") from e
            raise NetworkError(f"model endpoint not reached: {getattr(e, 'reason', e)}") from e


@dataclass(frozen=True)
class RetryPolicy:
    transient: int = 3
    timeouts: int = 2
    first_ms: int = 1000
    factor: float = 2.0
    most_ms: int = 10_000

    def wait_s(self, attempt: int, roll: Callable[[], float] = random.random) -> float:
        """Capped first, then 20 % either way."""
        return int(min(self.first_ms * self.factor**attempt, self.most_ms) * (0.8 + 0.4 * roll())) / 1000


def as_corpus_error(e: BaseException) -> CorpusError:
    """Any client's error as one of ours."""
    if isinstance(e, CorpusError):
        return e
    status = getattr(e, "status", None) or getattr(getattr(e, "error", None), "status", None)
    if isinstance(status, int):
        return (AuthError if status in (401, 403) else HttpError)(f"HTTP {status}: {e}", status=status)
    if isinstance(e, TimeoutError) or type(e).__name__ in ("AbortError", "Timeout"):
        return FetchTimeout(str(e) or "timed out")
    if isinstance(e, ConnectionError) or getattr(e, "code", None) in NETWORK_CODES:
        return NetworkError(str(e))
    return CorpusError(str(e))


def call_model(model: Model, system: str, user: str, config: ModelConfig, policy: RetryPolicy = RetryPolicy(), sleep: Callable[[float], None] = time.sleep) -> str:
    """The answer; retries rate limits, server and network errors, and timeouts, each up to its own count."""
    transient = timeouts = 0
    while True:
        try:
            answer = model.complete(system, user, temperature=config.temperature, max_tokens=config.answer_tokens, timeout_s=config.timeout_ms / 1000)
            if not (answer or "").strip():
                raise ParseError("the model gave an empty answer")
            return answer
        except Exception as e:  # noqa: BLE001  told apart below
            error = as_corpus_error(e)
            if isinstance(error, FetchTimeout) and timeouts < policy.timeouts:
                timeouts += 1
                sleep(policy.wait_s(timeouts - 1))
            elif (isinstance(error, NetworkError) or (error.status is not None and (error.status == 429 or error.status >= 500))) and transient < policy.transient:
                transient += 1
                sleep(policy.wait_s(transient - 1))
            else:
                raise error from e


def verify_model(model: Model, config: ModelConfig) -> bool:
    """Whether the endpoint answers at all."""
    try:
        call_model(model, "ping", "ping", config, RetryPolicy(transient=0, timeouts=0))
    except CorpusError:
        return False
    return True


def answer_prompts(prompts: DataFrame, make_model: Callable[[], Model], config: ModelConfig, *, system: str = "system", user: str = "user") -> DataFrame:
    """``prompts`` with answer and error; each worker makes one client and keeps ``batch_concurrency`` calls open.

    A row's failure is a row's: it is reported in ``error``, and the others go on.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()

        def one(pair: tuple[str, str]) -> tuple[str | None, str | None]:
            try:
                return call_model(model, *pair, config), None
            except CorpusError as e:
                return None, f"{e.category}: {e}"

        with ThreadPoolExecutor(config.batch_concurrency) as pool:
            for f in frames:
                answers = list(pool.map(one, zip(f[system], f[user], strict=True)))
                yield f.assign(answer=[a for a, _ in answers], error=[e for _, e in answers])

    return prompts.mapInPandas(run, extended(prompts.schema, "answer string, error string"))
