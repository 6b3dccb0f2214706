"""The page source: fetching URLs inside ``mapInPandas``, one failure one row.

Transport, resolver and renderer are injected, so tests and offline runs use recorded pages.
Redirects are followed by hand; every hop must be HTTP(S) and its host must not be private,
by its name or by any address it resolves to, and the connection goes to an address that
was checked. Without a resolver, the own transport looks names up and a recorded one doesn't.
"""

from __future__ import annotations

import http.client
import ipaddress
import random
import re
import socket
import ssl
import time
import unicodedata
import urllib.parse
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryspark.functions.content import MIN_READABLE_CHARS, decode_bytes, detect_charset, extract_readable, inflate, route_content
from quarryspark.functions.failures import TRANSIENT_FETCH_CODES, error_category, http_error_text, seconds_to_wait
from quarryspark.functions.text import truncate_at_word
from quarryspark.functions.urls import ONLY_HTTP, PRIVATE_ADDRESS, canonical_host, fetch_error
from quarryspark.plans.config import PipelineConfig, ScrapeConfig
from quarryspark.runtime import extended

#: fixed value: statuses whose Location is followed
REDIRECTS = (301, 302, 307, 308)
#: bytes of a body, as sent and as decompressed, beyond which a page is refused
MOST_BODY_BYTES = 32 * 1024 * 1024
TOO_LARGE = f"Response body has over {MOST_BODY_BYTES} bytes"
#: addresses of one host that one task fetches, about, while the host's tasks last
URLS_A_TASK, TASKS_A_HOST = 1000, 4
#: fixed value: seconds before the second and third try
TRANSIENT_WAITS = (1.0, 3.0)


@dataclass
class Fetched:
    status: int | None = None
    status_text: str = ""
    content_type: str | None = None
    encoding: str | None = None
    body: bytes | None = None
    final_url: str | None = None
    redirects: int = 0
    error: str | None = None
    headers: dict[str, str] = field(default_factory=dict)


Transport = Callable[[str, float], Fetched]


def http_transport(url: str, timeout_s: float, address: str | None = None) -> Fetched:
    """One GET without redirects, to ``address`` if one is given; raises OSError when there is no answer."""
    u = urllib.parse.urlsplit(url)
    if u.scheme not in ("http", "https") or not u.hostname:
        raise ValueError(ONLY_HTTP)
    secure = u.scheme == "https"
    port = u.port or (443 if secure else 80)
    c = http.client.HTTPConnection(u.hostname, port, timeout=timeout_s)
    try:
        c.sock = socket.create_connection((address or u.hostname, port), timeout_s)
        if secure:
            c.sock = ssl.create_default_context().wrap_socket(c.sock, server_hostname=u.hostname)
        c.request("GET", urllib.parse.quote(u.path or "/", safe="/%:@!$&'()*+,;=~-._") + (f"?{urllib.parse.quote(u.query, safe='/%:@!$&()*+,;=~-._?')}" if u.query else ""), headers={"Host": u.netloc.rpartition("@")[2], "User-Agent": "quarryspark", "Accept-Encoding": "gzip, deflate"})
        r = c.getresponse()
        h = {k.lower(): v for k, v in r.headers.items()}
        body = r.read(MOST_BODY_BYTES + 1)
        if len(body) > MOST_BODY_BYTES:
            return Fetched(r.status, r.reason or "", h.get("content-type"), None, None, url, error=TOO_LARGE, headers=h)
        return Fetched(r.status, r.reason or "", h.get("content-type"), h.get("content-encoding"), body, url, headers=h)
    except http.client.HTTPException as e:
        raise OSError(f"{type(e).__name__}: {e}") from e
    finally:
        c.close()


def plain_host(host: str) -> str:
    """A host as it is connected to: decoded, in lower case, numbers in dotted decimal whatever their spelling."""
    name = unicodedata.normalize("NFKC", urllib.parse.unquote(host)).replace("。", ".").lower()
    bare = name.removesuffix(".")
    if ":" not in bare and re.search(r"(?:\A|\.)(?:[0-9]+|0x[0-9a-f]*)\Z", bare):
        try:
            return socket.inet_ntoa(socket.inet_aton(re.sub(r"(\A|\.)0x(?=\.|\Z)", r"\g<1>0", bare)))
        except OSError:
            raise ValueError(f"not an address: {host}") from None
    return name


def private_address(name: str) -> bool:
    """Whether the text is an address that is not a public one, or a name for this machine."""
    if re.search(r"(?:\A|\.)localhost\.?\Z", name):
        return True
    try:
        ip = ipaddress.ip_address(name.strip("[]").partition("%")[0])
    except ValueError:
        return False
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_unspecified or ip.is_reserved or ip.is_multicast


Resolver = Callable[[str], list[str]]


def resolve_host(host: str) -> list[str]:
    return [a[4][0] for a in socket.getaddrinfo(host, None)]


def _checked(url: str, resolve: Resolver | None) -> tuple[str | None, str | None]:
    """(why the URL must not be fetched or None, an address of its host or None)."""
    u = urllib.parse.urlsplit(url)
    if u.scheme.lower() not in ("http", "https"):
        return ONLY_HTTP, None
    host = plain_host(u.hostname or "")
    found = [] if resolve is None or not host else resolve(host)
    if any(map(private_address, [host, *found])):
        return PRIVATE_ADDRESS, None
    return None, next(iter(found), None)


def fetch(url: str, config: ScrapeConfig, transport: Transport = http_transport, resolve: Resolver | None = None, sleep: Callable[[float], None] = time.sleep) -> Fetched:
    """Follow redirects, retry: twice on transient network errors, once each on 429 and on 5xx."""
    own = transport is http_transport
    if own and resolve is None:
        resolve = resolve_host
    here, hops, transient, limited, server = url, 0, 0, False, False
    while True:
        try:
            why, address = _checked(here, resolve)
            if why:
                return Fetched(error=why, final_url=here, redirects=hops)
            f = transport(here, config.timeout_ms / 1000, address) if own else transport(here, config.timeout_ms / 1000)
        except TimeoutError:
            return Fetched(error=f"Request timed out after {config.timeout_ms}ms", final_url=here, redirects=hops)
        except OSError as e:
            code = getattr(e, "code", None) or {104: "ECONNRESET", 110: "ETIMEDOUT", 111: "ECONNREFUSED"}.get(e.errno or 0, "EAI_AGAIN" if isinstance(e, socket.gaierror) else "")
            if code in TRANSIENT_FETCH_CODES and transient < len(TRANSIENT_WAITS):
                sleep(TRANSIENT_WAITS[transient])
                transient += 1
                continue
            return Fetched(error=f"Network error: {e}", final_url=here, redirects=hops)
        except ValueError as e:
            return Fetched(error=f"Invalid URL: {e}", final_url=here, redirects=hops)
        f.final_url, f.redirects = here, hops
        if f.status in REDIRECTS and f.headers.get("location"):
            if hops >= config.max_redirects:
                f.error = f"Too many redirects (more than {config.max_redirects})"
                return f
            here, hops = urllib.parse.urljoin(here, f.headers["location"]), hops + 1
        elif f.status == 429 and not limited:
            wish = seconds_to_wait(f.headers.get("retry-after"))
            sleep(3.0 if wish is None else wish)
            limited = True
        elif f.status is not None and f.status >= 500 and not server:
            sleep(1.0 + random.random() * 0.4)
            server = True
        else:
            if f.body is not None:
                f.body = inflate(f.body, f.encoding)
            return f


def fetch_pages(urls: DataFrame, config: ScrapeConfig = ScrapeConfig(), *, transport: Transport = http_transport, resolve: Resolver | None = None, at_once: int | None = None) -> DataFrame:
    """``urls`` (url) with status, status_text, content_type, body, final_url, redirects, error; a task has ``at_once`` requests open at most."""
    at_once = at_once or PipelineConfig.load().concurrency

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(u: str) -> Fetched:
            try:
                return fetch(u, config, transport, resolve)
            except Exception as e:  # noqa: BLE001  a row's failure is a row's
                return Fetched(error=f"{type(e).__name__}: {e}")

        with ThreadPoolExecutor(at_once) as pool:
            for f in frames:
                got = list(pool.map(one, f["url"]))
                yield f.assign(**{name: [getattr(g, name) for g in got] for name in ("status", "status_text", "content_type", "body", "final_url", "redirects", "error")})

    return urls.mapInPandas(run, extended(urls.schema, "status int, status_text string, content_type string, body binary, final_url string, redirects int, error string"))


Renderer = Callable[[str], str | None]


def render_pages(pages: DataFrame, renderer: Renderer | None) -> DataFrame:
    """``pages`` (url, ...) with ``rendered`` HTML; null where there is no renderer or it fails."""
    if renderer is None:
        return pages.withColumn("rendered", F.lit(None).cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(u: str) -> str | None:
            try:
                return renderer(u)
            except Exception:  # noqa: BLE001  rendering is a fallback
                return None

        for f in frames:
            yield f.assign(rendered=[one(u) for u in f["url"]])

    return pages.mapInPandas(run, extended(pages.schema, "rendered string"))


SCRAPED = ("url", "success", "title", "content", "method", "truncated", "content_length", "error", "category")


def scraped(fetched: DataFrame, config: ScrapeConfig = ScrapeConfig(), renderer: Renderer | None = None, *, keys: tuple[str, ...] = ()) -> DataFrame:
    """From fetched bytes to text: decode, route, extract, render short pages, truncate. Failures are rows.

    ``keys``: columns of ``fetched`` that go along, such as the query a page was fetched for.
    """
    text = decode_bytes("body", detect_charset("content_type", "body"))
    good = F.col("error").isNull() & F.col("status").between(200, 299) & F.col("body").isNotNull()
    routed = fetched.withColumn("_ok", F.coalesce(good, F.lit(False))).withColumn("_text", F.when(F.col("_ok"), text)).withColumn("_r", route_content("content_type", "_text"))
    read = routed.withColumn("_x", extract_readable(F.when(F.col("_r.kind") == "html", F.col("_text")), config.open_references))
    short = F.col("_ok") & (F.col("_r.kind") == "html") & (F.length("_x.text") < config.min_content_chars)
    if renderer is not None:
        again = render_pages(read.filter(short), renderer).withColumn("_y", extract_readable("rendered", config.open_references))
        better = F.length("_y.text") >= F.length("_x.text")
        again = again.withColumn("_x", F.when(better, F.struct(F.col("_y.title").alias("title"), F.col("_y.text").alias("text"), F.lit("rendered").alias("method"), F.col("_y.error").alias("error"))).otherwise(F.col("_x"))).drop("rendered", "_y")
        read = read.filter(~short).unionByName(again)
    html = F.col("_r.kind") == "html"
    content = F.when(html, F.col("_x.text")).otherwise(F.col("_r.text"))
    failed = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.col("status").between(200, 299), http_error_text("status", "status_text", "url"))
        .when(F.col("_r.error").isNotNull(), F.col("_r.error"))
        .when(F.coalesce(F.length(content), F.lit(0)) == 0, F.lit("Failed to extract content"))
    )
    cut = truncate_at_word(content, config.max_content_chars)
    ok = failed.isNull()
    return read.select(
        *(k for k in keys if k != "url"), "url", ok.alias("success"), F.when(ok, F.when(html, F.col("_x.title")).otherwise(F.lit(""))).alias("title"), F.when(ok, cut).alias("content"), F.when(ok, F.when(html, F.col("_x.method")).otherwise(F.col("_r.method"))).alias("method"),
        F.when(ok, F.lit(config.max_content_chars > 0) & (F.length(content) > config.max_content_chars)).alias("truncated"), F.when(ok, F.length(cut)).alias("content_length"), failed.alias("error"), F.when(~ok, error_category(failed)).alias("category"),
    )


def deal_by_host(urls: DataFrame, *, tasks: int | None = None, urls_a_task: int = URLS_A_TASK, tasks_a_host: int = TASKS_A_HOST) -> DataFrame:
    """``urls`` (url), each once, dealt so that a host's addresses are in few tasks, and small hosts share tasks.

    A host has a task for each ``urls_a_task`` addresses, ``tasks_a_host`` at most, so that
    times ``at_once`` requests are open to it at any time, however many executors there are;
    a hot host takes longer and is never asked more. Tasks stream, so their size is no matter.
    """
    n = tasks or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host = F.coalesce(canonical_host(F.regexp_extract("url", r"\A\s*[A-Za-z]+://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)), F.lit(""))
    each = urls.select("url").distinct().withColumn("_host", host)
    sizes = each.groupBy("_host").agg(F.least(F.ceil(F.count(F.lit(1)) / urls_a_task), F.lit(tasks_a_host)).cast("int").alias("_tasks")).filter("_tasks > 1").withColumnRenamed("_host", "_h")
    parted = each.join(sizes, F.col("_host") == F.col("_h"), "left").withColumn("_part", F.pmod(F.xxhash64("url"), F.coalesce("_tasks", F.lit(1))))
    return parted.repartition(n, "_host", "_part").select("url")


def scrape(urls: DataFrame, config: ScrapeConfig | None = None, *, transport: Transport = http_transport, resolve: Resolver | None = None, renderer: Renderer | None = None, at_once: int | None = None) -> DataFrame:
    """One row an URL with the columns SCRAPED; never raises for a page."""
    config = config or ScrapeConfig.load()
    checked = urls.select("url").withColumn("_why", fetch_error("url"))
    fetched = fetch_pages(checked.filter("_why IS NULL").select("url"), config, transport=transport, resolve=resolve, at_once=at_once)
    return scraped(fetched, config, renderer).unionByName(_refused(checked.filter("_why IS NOT NULL"), "_why"))


def _refused(urls: DataFrame, why: str, keys: tuple[str, ...] = ()) -> DataFrame:
    none = [F.lit(None).cast(t).alias(n) for n, t in (("title", "string"), ("content", "string"), ("method", "string"), ("truncated", "boolean"), ("content_length", "int"))]
    return urls.select(*(k for k in keys if k != "url"), "url", F.lit(False).alias("success"), *none, F.col(why).alias("error"), error_category(why).alias("category"))


def fetcher(config: ScrapeConfig | None = None, *, tasks: int | None = None, urls_a_task: int = URLS_A_TASK, tasks_a_host: int = TASKS_A_HOST, transport: Transport = http_transport, resolve: Resolver | None = None, renderer: Renderer | None = None, at_once: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """A stage that scrapes addresses (url), dealt by host."""
    return lambda urls: scrape(deal_by_host(urls, tasks=tasks, urls_a_task=urls_a_task, tasks_a_host=tasks_a_host), config, transport=transport, resolve=resolve, renderer=renderer, at_once=at_once)


def recorded_pages(fetched: DataFrame, config: ScrapeConfig | None = None, *, keys: tuple[str, ...] = ("url",)) -> Callable[[DataFrame], DataFrame]:
    """A stage that looks pages up in a table (url, status, status_text, content_type, body, error), with the checks of a fetch.

    ``keys``: what a page is found by, ``url`` among it; with ``query_id`` each query has pages of its own.
    """

    def stage(urls: DataFrame) -> DataFrame:
        checked = urls.select(*keys).distinct().withColumn("_why", fetch_error("url"))
        known = fetched.select(*keys, "status", "status_text", "content_type", "body", "error", F.lit(True).alias("_known"))
        both = checked.filter("_why IS NULL").join(known, list(keys), "left")
        found = both.withColumn("error", F.coalesce("error", F.when(F.col("_known").isNull(), F.lit("Network error: no recorded page")))).drop("_why", "_known")
        return scraped(found, config or ScrapeConfig.load(), keys=keys).unionByName(_refused(checked.filter("_why IS NOT NULL"), "_why", keys))

    return stage


assert MIN_READABLE_CHARS == ScrapeConfig.min_content_chars
