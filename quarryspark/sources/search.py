"""The search source: metasearch nodes, asked for a table of queries or through a Python data source.

``ask_nodes(queries, ...)`` takes queries (query_id, query) of any number, dealt to tasks that
each walk their own, and gives (query_id, query, status, body, content_type, retry_after,
node, error) for ``parse_answers``; ``recorded_answers`` stands in for it with a table. A
task keeps its pool of nodes, so the node that answered one query is asked first for the next.

For short lists there is a data source: ``spark.dataSource.register(SearchSource)``, then
``spark.read.format("metasearch").option("queries", json list).load()`` gives
(query_id, status, body, content_type, retry_after_ms, node, error) for ``parse_answers``.
Each query is one partition; retries and failover happen inside its reader. Recorded
answers are read with ``spark.read.json`` in the same shape.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarryspark.functions.failures import CorpusError, FetchTimeout, HttpError, NetworkError, ValidationError, retryable, seconds_to_wait
from quarryspark.plans.config import NodePool, SearchConfig
from quarryspark.runtime import extended

MAX_QUERY_CHARS = 500
MAX_RETRY_AFTER_MS = 10_000


def check_query(query: str) -> str:
    """The query, or ValidationError for a blank or overlong one."""
    if not query or not query.strip():
        raise ValidationError("query must not be empty")
    if len(query) > MAX_QUERY_CHARS:
        raise ValidationError(f"query must have at most {MAX_QUERY_CHARS} characters")
    return query


def request_url(node: str, query: str, categories: str | None = None) -> str:
    u = urllib.parse.urlsplit(node)
    asked = {"q": query, "format": "json", "safesearch": "1"} | ({"categories": categories} if categories is not None else {})
    return urllib.parse.urlunsplit((u.scheme, u.netloc, u.path.rstrip("/") + "/search", urllib.parse.urlencode(asked), ""))


@dataclass
class Answer:
    status: int
    body: str
    content_type: str | None = None
    retry_after: str | None = None


def http_get(url: str, timeout_s: float) -> Answer:
    """One GET; any status is an answer, no answer is an error."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/json"}), timeout=timeout_s) as r:  # noqa: S310
            return Answer(r.status, r.read().decode("utf-8", "replace"), r.headers.get("Content-Type"), r.headers.get("Retry-After"))
    except urllib.error.HTTPError as e:
        return Answer(e.code, e.read().decode("utf-8", "replace"), e.headers.get("Content-Type"), e.headers.get("Retry-After"))
    except TimeoutError as e:
        raise FetchTimeout(f"search timed out: {e}") from e
    except OSError as e:
        raise NetworkError(f"search node not reached: {e}") from e


def wait_ms(attempt: int, base_ms: int, retry_after: str | None = None, roll: Callable[[], float] = random.random) -> int:
    """The server's wish, in seconds or as a date, capped, else base * 2**attempt within 20 %."""
    wish = seconds_to_wait(retry_after)
    if wish is not None:
        return min(int(wish * 1000), MAX_RETRY_AFTER_MS)
    base = base_ms * 2**attempt
    return max(0, round(base + base * 0.2 * (roll() * 2 - 1)))


def search(query: str, pool: NodePool, config: SearchConfig, get: Callable[[str, float], Answer] = http_get, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> tuple[str, Answer]:
    """(node, answer) of the first node that gives a good one, within the ceiling."""
    check_query(query)
    deadline, said = clock() + config.ceiling_ms / 1000, []
    while True:
        node = pool.current
        for attempt in range(config.max_retries + 1):
            left = deadline - clock()
            if left <= 0:
                raise FetchTimeout("search timed out: " + "; ".join(said))
            answer = None
            try:
                answer = get(request_url(node, query, config.categories), min(left, config.timeout_ms / 1000))
                if answer.status < 400:
                    pool.promote(node)
                    return node, answer
                raise HttpError(f"HTTP {answer.status} from {node}", status=answer.status)
            except CorpusError as e:
                said.append(f"{node}: {e}")
                if not retryable(e) or attempt == config.max_retries:
                    break
                sleep(min(max(0.0, deadline - clock()), wait_ms(attempt, config.retry_base_ms, answer.retry_after if answer else None) / 1000))
        if pool.own or not pool.advance():
            pool.reset()
            raise NetworkError("all search nodes failed: " + "; ".join(said))


ANSWER = "status int, body string, content_type string, retry_after string, node string, error string"


def ask_nodes(config: SearchConfig | None = None, *, pool: NodePool | None = None, get: Callable[[str, float], Answer] = http_get, tasks: int | None = None, sleep: Callable[[float], None] = time.sleep) -> Callable[[DataFrame], DataFrame]:
    """A stage that asks nodes for queries (query_id, query); a query's failure is a row's ``error``.

    ``tasks``: into how many the queries are dealt, which is how many requests are open at
    once at most; as many as there are shuffle partitions where it is not given. Settings
    that are not given come from the driver's environment.
    """
    config, pool = config or SearchConfig.load(), pool or NodePool.load()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = NodePool(list(pool.nodes), pool.own)

        def one(query: str) -> tuple:
            try:
                node, a = search(query, own, config, get, sleep)
                return a.status, a.body, a.content_type, a.retry_after, node, None
            except CorpusError as e:
                return None, None, None, None, None, f"{e.category}: {e}"

        for f in frames:
            rows = [one(q) for q in f["query"]]
            names = [x.split()[0] for x in ANSWER.split(", ")]
            yield f.assign(**{n: pd.Series([r[k] for r in rows], index=f.index, dtype="Int32" if n == "status" else object) for k, n in enumerate(names)})

    def stage(queries: DataFrame) -> DataFrame:
        n = tasks or int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # dealt by query and id: repeated queries don't meet in one task
        dealt = queries.select("query_id", "query").repartition(n, F.xxhash64("query_id", "query"))
        return dealt.mapInPandas(run, extended(dealt.schema, ANSWER))

    return stage


def recorded_answers(answers: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A stage that looks answers up in a table (query_id, status, body, content_type); queries without one fail."""
    known = answers.select(F.col("query_id").alias("_q"), F.col("status").cast("int").alias("status"), "body", "content_type")

    def stage(queries: DataFrame) -> DataFrame:
        both = queries.join(known, F.col("query_id") == F.col("_q"), "left")
        missing = F.when(F.col("_q").isNull(), F.lit("network: no recorded answer"))
        return both.select("query_id", "query", "status", "body", "content_type", missing.alias("error"))

    return stage


class SearchSource(DataSource):
    """Options: queries (JSON list of strings), nodes (JSON list, optional), timeout_ms, max_retries, categories."""

    @classmethod
    def name(cls) -> str:
        return "metasearch"

    def schema(self) -> str:
        return "query_id long, query string, status int, body string, content_type string, retry_after string, node string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _SearchReader(dict(self.options))


class _Query(InputPartition):
    def __init__(self, number: int, query: str):
        super().__init__(number)
        self.number, self.query = number, query


class _SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        lower = {k.lower(): v for k, v in options.items()}
        self.queries = json.loads(lower.get("queries", "[]"))
        self.nodes = json.loads(lower["nodes"]) if "nodes" in lower else None
        self.config = SearchConfig.load(timeout_ms=int(lower.get("timeout_ms", 10_000)), max_retries=int(lower.get("max_retries", 2)), categories=lower.get("categories"))

    def partitions(self) -> list[InputPartition]:
        return [_Query(k, q) for k, q in enumerate(self.queries)]

    def read(self, partition: _Query) -> Iterator[tuple]:
        pool = NodePool(list(self.nodes), len(self.nodes) == 1) if self.nodes else NodePool.load()
        try:
            node, a = search(partition.query, pool, self.config)
            yield partition.number, partition.query, a.status, a.body, a.content_type, a.retry_after, node, None
        except CorpusError as e:
            yield partition.number, partition.query, None, None, None, None, None, f"{e.category}: {e}"
