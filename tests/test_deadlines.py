"""Deadlines, partial results, whole flows from a table of queries, the chat client and the tool server."""

import http.server
import io
import json
import os
import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F

from quarryspark.functions.failures import TIMED_OUT, AuthError, ConfigError, HttpError, ParseError, PipelineTimeout
from quarryspark.operators.digest import PIPELINE_NOTICE
from quarryspark.plans import config, deadline, model, serve, web
from quarryspark.queries import EchoModel
from quarryspark.runtime import shared_folder
from quarryspark.sources import pages, search

TEXT = "A sentence that is long enough to count. " * 8
HITS = "query_id int, query string, rank int, title string, url string, snippet string, score double"
PAGES = "url string, success boolean, title string, content string, error string, category string"


def _slow(spark, seconds, slow_urls, urls):
    """Scraped pages, a partition each, those of ``slow_urls`` late."""

    def run(frames):
        for f in frames:
            if f["url"].isin(slow_urls).any():
                time.sleep(seconds)
            yield f.assign(success=True, title="T", content=TEXT, error=None, category=None)

    return spark.createDataFrame([(u,) for u in urls], "url string").repartitionById(len(urls), F.array_position(F.lit(urls), F.col("url")).cast("int")).mapInPandas(run, PAGES)


def test_limits_cancel_their_own_jobs_only(spark):
    nap = F.udf(lambda x: time.sleep(5) or x, "long")
    got = {}

    def long() -> None:
        with deadline.time_limit(spark, 60):
            got["long"] = spark.range(0, 2, 1, 2).select(nap("id")).count()
            got["rows"] = len(spark.range(0, 2, 1, 2).select(nap("id")).collect())

    def short() -> None:
        try:
            with deadline.time_limit(spark, 1):
                spark.range(0, 2, 1, 2).select(nap("id")).collect()
        except PipelineTimeout:
            got["short"] = True

    both = [threading.Thread(target=t) for t in (long, short)]
    [t.start() for t in both]
    [t.join() for t in both]
    assert got == {"long": 2, "rows": 2, "short": True}


def test_nested_limits(spark):
    nap = F.udf(lambda x: time.sleep(20) or x, "long")
    with deadline.time_limit(spark, 120):
        with pytest.raises(PipelineTimeout), deadline.time_limit(spark, 1):
            spark.range(2).select(nap("id")).collect()
        assert spark.range(5).count() == 5
    with pytest.raises(ZeroDivisionError), deadline.time_limit(spark, 50):
        1 / 0  # noqa: B018


def test_rows_that_were_finished_stay(spark):
    d = _slow(spark, 60, ["b"], ["a", "b", "c"])
    rows, late = deadline.rows_in_time(d, time.monotonic() + 12)
    assert late and {r.url for r in rows.collect()} == {"a", "c"} and rows.columns == d.columns
    rows, late = deadline.rows_in_time(d.filter("url <> 'b'").limit(0), time.monotonic() + 60)
    assert not late and rows.count() == 0
    rows, late = deadline.rows_in_time(d, time.monotonic() - 1)
    assert late and rows.count() == 0
    rows, late = deadline.rows_in_time(spark.range(3), None)
    assert not late and rows.count() == 3


def test_search_with_one_slow_page_gives_excerpts_of_the_other(spark):
    h = spark.createDataFrame([(1, "q", 0, "hit", "a", "", 1.0), (1, "q", 1, "hit", "b", "", 0.5), (2, "p", 0, "hit", "b", "", 1.0)], HITS)
    got = {r.query_id: r for r in web.web_search(h, _slow(spark, 90, ["b"], ["a", "b"]), EchoModel, seconds=12).collect()}
    assert got[1].outcome == "degraded" and got[1].digest.degraded and got[1].scraped == 1 and "A sentence" in got[1].digest.answer and got[1].text.startswith(PIPELINE_NOTICE)
    assert (got[2].outcome, got[2].digest, got[2].text) == ("failed", None, TIMED_OUT)
    with pytest.raises(PipelineTimeout):
        web.web_search(h, _slow(spark, 90, ["a", "b"], ["a", "b"]), EchoModel, seconds=4)


def test_fetch_with_one_slow_page(spark):
    urls = spark.createDataFrame([("a",), ("b",), ("a",)], "url string")
    got = {r.url: r for r in web.run_fetch(urls, lambda _: _slow(spark, 90, ["b"], ["a", "b"]), EchoModel, seconds=12).collect()}
    assert got["a"].outcome == "degraded" and got["a"].text.startswith(PIPELINE_NOTICE) and (got["b"].outcome, got["b"].text) == ("failed", TIMED_OUT)
    whole = {r.url: r.outcome for r in web.run_fetch(urls, lambda _: _slow(spark, 0, [], ["a", "b"]), EchoModel, seconds=300).collect()}
    assert whole == {"a": "success", "b": "success"}


# --- flows from queries


def _node(url, timeout):
    if "one.org" in url:
        return search.Answer(503, "busy")
    q = url.split("q=")[1].split("&")[0]
    hits = {"cats": ["https://a.com/", "https://b.com/", "http://0x7f.1/"], "dogs": ["https://b.com/"], "none": [], "odd": ["no url"]}
    if q == "html":
        return search.Answer(200, "<html>", "text/html")
    return search.Answer(200, json.dumps({"results": [{"url": u, "title": q, "content": "", "score": 1} for u in hits[q]]}), "application/json")


def _web(url, timeout):
    if url == "https://a.com/":
        return pages.Fetched(200, "OK", "text/html", None, f"<html><title>A</title><article><p>{TEXT}</p></article></html>".encode())
    if url == "https://b.com/":
        return pages.Fetched(404, "Not Found", "text/html", None, b"x")
    raise TimeoutError


POOL = config.NodePool(["https://one.org", "https://two.org"])


def _ask():
    return search.ask_nodes(config.SearchConfig(max_retries=0), pool=POOL, get=_node, sleep=lambda s: None)


def test_run_search_from_queries(spark):
    asked = [(1, "cats"), (2, "dogs"), (3, "none"), (4, "odd"), (5, "html"), (6, "  "), (7, "x" * 501), (8, None)]
    got = {r.query_id: r for r in web.run_search(spark.createDataFrame(asked, "query_id long, query string"), _ask(), pages.fetcher(transport=_web), EchoModel).collect()}
    assert len(got) == len(asked)
    assert (got[1].outcome, got[1].scraped, got[1].failed, got[1].items) == ("partial", 1, 2, 1) and "https://a.com/" in got[1].text
    assert got[2].outcome == "failed" and got[2].text == "All 1 URL(s) failed to scrape:\n  - https://b.com/: HTTP 404: Page not found (https://b.com/)"
    assert web.NO_RESULTS in got[3].text and web.NO_USABLE in got[4].text and "non-JSON" in got[5].text
    assert got[6].text == got[8].text == "query must not be empty" and "at most 500" in got[7].text


def test_run_search_with_dead_nodes_and_without_queries(spark):
    dead = search.ask_nodes(config.SearchConfig(max_retries=0), pool=config.NodePool(["https://one.org"], True), get=_node, sleep=lambda s: None)
    r = web.run_search(spark.createDataFrame([(1, "cats")], "query_id long, query string"), dead, pages.fetcher(transport=_web), EchoModel, seconds=300).collect()
    assert [x.outcome for x in r] == ["failed"] and "all search nodes failed" in r[0].text
    assert web.run_search(spark.createDataFrame([], "query_id long, query string"), dead, pages.fetcher(transport=_web), EchoModel).count() == 0


def test_a_task_asks_the_node_that_answered_first(spark):
    queries = spark.createDataFrame([(k, "dogs") for k in range(6)], "query_id long, query string")
    log = shared_folder(spark, "asked").removeprefix("file:")
    os.makedirs(log)

    def get(url, timeout):
        open(f"{log}/{'one' if 'one.org' in url else 'two'}-{uuid.uuid4().hex}", "w").close()
        return _node(url, timeout)

    rows = search.ask_nodes(config.SearchConfig(max_retries=0), pool=POOL, get=get, tasks=1, sleep=lambda s: None)(queries).collect()
    assert {r.node for r in rows} == {"https://two.org"} and sorted(x.split("-")[0] for x in os.listdir(log)) == ["one"] + ["two"] * 6


def test_open_requests_of_a_host_are_bounded(spark):
    urls = [f"https://{'hot' if k % 4 else f'h{k}'}.com/{k}" for k in range(80)]
    log = shared_folder(spark, "open").removeprefix("file:")
    os.makedirs(log)

    def transport(url, timeout):
        name = f"{log}/{url.split('/')[2]}-{uuid.uuid4().hex}"
        open(name, "w").close()
        n = sum(x.startswith(url.split("/")[2] + "-") for x in os.listdir(log))
        time.sleep(0.02)
        os.remove(name)
        return pages.Fetched(200, "OK", "text/plain", None, str(n).encode())

    d = spark.createDataFrame([(u,) for u in urls + urls[:9]], "url string")
    got = pages.fetcher(transport=transport, at_once=2, tasks_a_host=1, tasks=8)(d).collect()
    assert len(got) == 80 and max(int(r.content) for r in got) <= 2
    dealt = pages.deal_by_host(d, tasks=16, urls_a_task=10, tasks_a_host=4).withColumn("p", F.spark_partition_id()).filter("url LIKE '%hot%'")
    assert 1 < dealt.select("p").distinct().count() <= 4 and dealt.count() == 60


def test_hops_to_this_machine_in_any_spelling(spark):
    to = {f"https://h{k}.com/": f"http://{host}/" for k, host in enumerate(["2130706433", "0x7f.1", "127.1", "localhost", "127.0.0.1.", "[::ffff:7f00:1]", "%31%32%37.1", "999.1"])}
    seen = []

    def transport(url, timeout):
        seen.append(url)
        return pages.Fetched(302, headers={"location": to[url]}, body=b"")

    for url in to:
        assert pages.fetch(url, config.ScrapeConfig(), transport).error in (pages.PRIVATE_ADDRESS, "Invalid URL: not an address: 999.1")
    assert seen == list(to)
    looked = pages.fetch("https://name.com/", config.ScrapeConfig(), transport, resolve=lambda h: ["8.8.8.8", "10.0.0.1"])
    assert looked.error == pages.PRIVATE_ADDRESS


# --- over real connections on this machine


@pytest.fixture
def server():
    """A server on this machine: what it was asked, and its address."""
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def _answer(self):
            n = int(self.headers.get("Content-Length") or 0)
            seen.append((self.command, self.path, self.headers.get("Authorization"), self.rfile.read(n)))
            if self.path.startswith("/moved"):
                self.send_response(302)
                self.send_header("Location", "/elsewhere")
                self.end_headers()
                return
            status = {"/denied/chat/completions": 401, "/busy/chat/completions": 503}.get(self.path, 200)
            body = b"x" * 100_000 if "large" in self.path else b"{}" if "odd" in self.path else json.dumps({"choices": [{"message": {"content": "said"}}]}).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        do_GET = do_POST = _answer

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield seen, f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_the_key_stays_with_its_endpoint(server, monkeypatch):
    seen, base = server
    ask = lambda path: model.ChatModel(base + path, "m", "SECRET").complete("s", "u", temperature=0.1, max_tokens=5, timeout_s=5)
    assert ask("/v1") == "said" and seen[-1][:3] == ("POST", "/v1/chat/completions", "Bearer SECRET") and json.loads(seen[-1][3])["messages"][1]["content"] == "u"
    with pytest.raises(HttpError) as moved:
        ask("/moved")
    assert moved.value.status == 302 and len(seen) == 2
    with pytest.raises(AuthError):
        ask("/denied")
    with pytest.raises(HttpError):
        ask("/busy")
    with pytest.raises(ParseError):
        ask("/odd")
    monkeypatch.setattr(model, "MOST_ANSWER_BYTES", 1000)
    with pytest.raises(ParseError, match="over 1000 bytes"):
        ask("/large")
    assert "SECRET" not in repr(model.ChatModel(base, "m", "SECRET"))


def test_chat_model_needs_key_and_address():
    for c in (config.ModelConfig(), config.ModelConfig(api_key="k"), config.ModelConfig(api_key="k", base_url="ftp://x"), config.ModelConfig(base_url="https://x")):
        with pytest.raises(ConfigError):
            model.ChatModel.of(c)
    assert model.ChatModel.of(config.ModelConfig(api_key="k", base_url="https://x/v1", model="m")).name == "m"


def test_own_transport_reads_up_to_a_limit_from_the_checked_address(server, monkeypatch):
    seen, base = server
    port = base.rpartition(":")[2]
    got = pages.http_transport(f"http://example.org:{port}/a b?q=ü#f", 5, "127.0.0.1")
    assert got.status == 200 and json.loads(got.body) and seen[-1][1] == "/a%20b?q=%C3%BC"
    monkeypatch.setattr(pages, "MOST_BODY_BYTES", 1000)
    assert pages.http_transport(f"http://example.org:{port}/large", 5, "127.0.0.1").error == pages.TOO_LARGE
    n = len(seen)
    assert pages.fetch(f"{base}/", config.ScrapeConfig()).error == pages.PRIVATE_ADDRESS and pages.fetch(f"http://name.test:{port}/", config.ScrapeConfig(), resolve=lambda h: ["127.0.0.1"]).error == pages.PRIVATE_ADDRESS and len(seen) == n
    with pytest.raises(ValueError):
        pages.http_transport("ftp://x/", 1)


def test_inflating_is_bounded(monkeypatch):
    import gzip
    import zlib

    from quarryspark.functions import content

    raw = b"text " * 1000
    assert content.inflate(gzip.compress(raw) + gzip.compress(b"more"), "gzip") == raw + b"more" and content.inflate(zlib.compress(raw), "deflate") == raw == content.inflate(zlib.compress(raw)[2:-4], "deflate")
    bomb = gzip.compress(b"\0" * 10_000)
    monkeypatch.setattr(content, "MOST_INFLATED_BYTES", 9_999)
    assert content.inflate(bomb, "gzip") == bomb and content.inflate(b"no gzip", "gzip") == b"no gzip" and content.inflate(raw, None) == raw


# --- the server


def test_tool_server(spark):
    s = serve.tool_server(spark, _ask(), pages.fetcher(transport=_web), EchoModel, config.PipelineConfig(pipeline_timeout_ms=300_000))
    call = lambda n, name, **args: json.dumps({"jsonrpc": "2.0", "id": n, "method": "tools/call", "params": {"name": name, "arguments": args}})
    lines = [json.dumps({"jsonrpc": "2.0", "id": 0, "method": "initialize", "params": {}}), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), "", "{bad", "[]", json.dumps({"id": 5, "method": "tools/list"}), call(6, "web_search", query="cats", focus="tails"), call(7, "web_search", query="dogs"), call(8, "web_fetch", url="https://a.com/"), call(9, "web_fetch", url="http://127.1/"), call(10, "web_search"), json.dumps({"id": 11, "method": "other"})]
    out = io.StringIO()
    s.serve(io.StringIO("\n".join(lines)), out)
    said = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["id"] for x in said] == [0, None, None, 5, 6, 7, 8, 9, 10, 11]
    assert said[0]["result"]["serverInfo"]["name"] == "quarryspark" and [t["name"] for t in said[3]["result"]["tools"]] == ["web_search", "web_fetch"] and said[1]["error"]["code"] == -32700 and said[-1]["error"]["code"] == -32601
    results = {x["id"]: x["result"] for x in said if x["id"] and 6 <= x["id"] <= 10}
    assert [results[k]["isError"] for k in range(6, 11)] == [False, True, False, True, True]
    assert "https://a.com/" in results[6]["content"][0]["text"] and "404" in results[7]["content"][0]["text"] and "https://a.com/" in results[8]["content"][0]["text"] and "private" in results[9]["content"][0]["text"]
