"""Digests, batching, sources, the model, tools and the composite flows."""

import json

import pytest
from pyspark.sql import functions as F

from quarryspark.functions.failures import ConfigError, CorpusError, FetchTimeout, HttpError, NetworkError, ValidationError
from quarryspark.functions.text import estimate_tokens
from quarryspark.operators import batching, digest, hits
from quarryspark.plans import config, deadline, model, synthesis, tools, web
from quarryspark.queries import EchoModel
from quarryspark.sources import pages, search


def test_digest_parsing(values):
    md = "## Answer\nIt is so.\n\n## Key Points\n- one\n2) two\nplain\n* three\n## Sources\n- **My Title**\nhttps://a.com/x.\nOther\nhttps://b.com (https://a.com/x)\n"
    got = values(digest.parse_digest, [md, "**Answer:** yes\nmore\nKey Points: \n- p\nSources:\nhttps://c.com", " just text ", "", "Answering this\nx"])
    assert got[0].answer == "It is so." and got[0].key_points == ["one", "two", "three"]
    assert [(s.url, s.title) for s in got[0].sources] == [("https://a.com/x", "My Title"), ("https://b.com", "Other")]
    assert got[1].key_points == ["p"] and got[1].sources[0].title == "https://c.com" and got[1].answer.endswith("yes\nmore")
    assert got[2].answer == "just text" and got[2].sources == [] and got[3].answer == "" and got[4].answer == "ing this\nx"


def _list(spark, rows):
    d = spark.createDataFrame(rows, "q string, pos int, title string, url string, score double, content string")
    return digest.items_of(d, "q", "pos")


def test_excerpts(spark):
    rows = [("q", k, f"t{k}", f"https://u{k}.com", float(k % 3), f"word{k} " * n + ". Tail") for k, n in enumerate([10, 300, 40, 5])]
    d = _list(spark, rows).select(digest.excerpt_digest("items").alias("e"), digest.pipeline_excerpts("items", 500).alias("p")).first()
    assert d.e.answer.startswith(digest.EXCERPT_NOTICE + "\n\nword2") and 1980 < len(d.e.answer) <= 2000
    assert [s.url for s in d.e.sources] == [f"https://u{k}.com" for k in range(4)]
    assert d.p.answer.endswith("…") and len(d.p.answer) == 501
    none = spark.createDataFrame([([],)], "items array<struct<pos:long,title:string,url:string,score:double,content:string>>")
    assert none.select(digest.excerpt_digest("items").alias("e")).first().e.answer.endswith("No content available.")


def test_batches(spark):
    d = spark.createDataFrame([("q", 0, 50, 10), ("q", 1, 500, 10), ("q", 2, 60, 10), ("q", 3, 30, 10), ("q", 4, 1, 10)], "q string, rank int, tokens int, overhead int")
    got = {r["rank"]: r.batch_no for r in batching.assign_batches(d, key="q", rank="rank", threshold=100).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2, 4: 3}
    assert d.select(batching.route(F.lit(102_400)), batching.route(F.lit(102_401))).first()[:] == ("single", "batch")


def test_hits(spark):
    body = json.dumps({"results": [{"url": "https://a.com/#x", "title": "A", "content": "c", "score": 2}, {"url": "https://a.com/", "title": "", "score": "0.5"}, {"title": "no url"}, 5, {"url": "https://b.com", "title": 7, "score": 1.5}]})
    d = spark.createDataFrame([(1, body, None), (2, "<html>", "text/html"), (3, "{bad", None), (4, '{"results":{}}', None)], "query_id int, body string, content_type string")
    rows = sorted(hits.parse_answers(d).collect(), key=lambda r: (r.query_id, -1 if r.pos is None else r.pos))
    assert [(r.query_id, r.pos, r.url, r.score, r.malformed) for r in rows if r.error is None] == [(1, 0, "https://a.com/#x", 2.0, False), (1, 1, "https://a.com/", None, False), (1, 2, None, None, True), (1, 3, None, None, True), (1, 4, "https://b.com", 1.5, False)]
    assert [r.query_id for r in rows if r.error] == [2, 3]
    good = hits.parse_answers(d).filter("NOT malformed AND error IS NULL")
    top = sorted(hits.top_hits(good, 5).collect(), key=lambda r: r["rank"])
    assert [(r.url, r.score, r.title) for r in top] == [("https://a.com/#x", 1.0, "A"), ("https://b.com", 0.75, "(untitled)")]


def test_config():
    e = {"DEDUP_SIMILARITY_THRESHOLD": "2", "MIN_PARAGRAPH_CHARS": "0", "DEDUP_EXTRA_TRACKING_PARAMS": " a, ,b", "LLM_SAFE_THRESHOLD_RATIO": "0", "MAX_CONTENT_CHARS": "-5", "MAX_CONCURRENCY": "101", "SEARXNG_URL": "ftp://x"}
    assert config.DedupConfig.load(e) == config.DedupConfig(0.85, 20, ("a", "b")) and config.DedupConfig.load(e, similarity_threshold=3).similarity_threshold == 3
    assert config.ModelConfig.load(e).safe_ratio == 0.8 and config.ScrapeConfig.load(e).max_content_chars == -5 and config.PipelineConfig.load(e).concurrency == 3
    with pytest.raises(ConfigError):
        config.NodePool.load(e)
    with pytest.raises(ConfigError):
        config.ModelConfig().require_key()
    p = config.NodePool(["a", "b", "c"])
    assert p.advance() and p.current == "b"
    p.promote("b")
    assert p.nodes == ["b", "a", "c"] and p.cursor == 0 and p.has_more
    p.advance(), p.advance()
    assert not p.has_more
    p.reset()
    assert p.current == "b"


def test_search_retries_and_fails_over():
    calls, waits = [], []

    def get(url, timeout):
        calls.append(url)
        if "one" in url:
            return search.Answer(503, "busy", retry_after="2")
        return search.Answer(200, "{}")

    node, a = search.search("q", config.NodePool(["https://one.org", "https://two.org"]), config.SearchConfig(max_retries=1), get, waits.append)
    assert node == "https://two.org" and a.status == 200 and len(calls) == 3 and waits == [2.0]
    with pytest.raises(NetworkError):
        search.search("q", config.NodePool(["https://one.org"], True), config.SearchConfig(max_retries=0), get, waits.append)
    for bad in ("", "  ", "x" * 501):
        with pytest.raises(ValidationError):
            search.check_query(bad)
    assert search.wait_ms(2, 500, roll=lambda: 0.5) == 2000 and search.wait_ms(0, 500, "99") == 10_000


def test_search_source_reports_failures(spark):
    spark.dataSource.register(search.SearchSource)
    d = spark.read.format("metasearch").option("queries", json.dumps(["a", ""])).option("nodes", json.dumps(["http://127.0.0.1:9"])).option("max_retries", "0").load()
    assert [r.error.split(":")[0] for r in sorted(d.collect(), key=lambda r: r.query_id)] == ["network", "validation"]


def _transport(url, timeout):
    page = "<html><title>T</title><article><p>" + "long text " * 40 + "</p></article></html>"
    made = {
        "https://a.com/": pages.Fetched(301, headers={"location": "https://b.com/"}, body=b""), "https://b.com/": pages.Fetched(200, "OK", "text/html", None, page.encode()), "https://gone.com/": pages.Fetched(404, "Not Found", "text/html", None, b"x"),
        "https://in.com/": pages.Fetched(302, headers={"location": "http://10.0.0.1/"}, body=b""), "https://json.com/": pages.Fetched(200, "OK", "application/json", None, b'{"a":1}'), "https://loop.com/": pages.Fetched(302, headers={"location": "https://loop.com/"}, body=b""), "https://bin.com/": pages.Fetched(200, "OK", "image/png", None, b"x"),
    }
    if url not in made:
        raise TimeoutError
    return made[url]


def test_scrape(spark):
    urls = ["https://a.com/", "https://gone.com/", "https://in.com/", "https://json.com/", "https://loop.com/", "https://bin.com/", "https://slow.com/", "ftp://x", "http://127.0.0.1/"]
    got = {r.url: r for r in pages.scrape(spark.createDataFrame([(u,) for u in urls], "url string"), config.ScrapeConfig(max_content_chars=100), transport=_transport).collect()}
    assert len(got) == len(urls)
    a = got["https://a.com/"]
    assert a.success and a.title == "T" and a.truncated and a.content.endswith("…[truncated]") and a.method == "readability"
    assert got["https://json.com/"].content == '{\n  "a": 1\n}' and got["https://json.com/"].title == ""
    assert got["https://gone.com/"].error == "HTTP 404: Page not found (https://gone.com/)" and got["https://gone.com/"].category == "http_error"
    assert got["https://in.com/"].category == got["http://127.0.0.1/"].category == "validation" and got["https://slow.com/"].category == "timeout"
    assert "redirects" in got["https://loop.com/"].error and got["https://bin.com/"].error == "Unsupported content type: image/png" and got["ftp://x"].error.startswith("Only HTTP")


def test_fetch_retries():
    tries = []

    def flaky(url, timeout):
        tries.append(url)
        if len(tries) < 3:
            raise ConnectionResetError(104, "reset")
        return pages.Fetched(200, body=b"ok")

    assert pages.fetch("https://a.com/", config.ScrapeConfig(), flaky, sleep=lambda s: None).body == b"ok" and len(tries) == 3
    limited = [pages.Fetched(429, headers={"retry-after": "1"}, body=b""), pages.Fetched(200, body=b"x")]
    waits = []
    assert pages.fetch("https://a.com/", config.ScrapeConfig(), lambda u, t: limited.pop(0), sleep=waits.append).status == 200 and waits == [1.0]


class Flaky:
    def __init__(self, *said):
        self.said = list(said)

    def complete(self, system, user, *, temperature, max_tokens, timeout_s):
        x = self.said.pop(0)
        if isinstance(x, Exception):
            raise x
        return x


def test_model_retries():
    c = config.ModelConfig()
    assert model.call_model(Flaky(HttpError("HTTP 500", status=500), NetworkError("x"), FetchTimeout("t"), "ok"), "s", "u", c, sleep=lambda s: None) == "ok"
    for bad in (HttpError("HTTP 401", status=401), HttpError("HTTP 400", status=400)):
        with pytest.raises(CorpusError):
            model.call_model(Flaky(bad, "never"), "s", "u", c, sleep=lambda s: None)
    with pytest.raises(FetchTimeout):
        model.call_model(Flaky(*[FetchTimeout("t")] * 3), "s", "u", c, sleep=lambda s: None)
    assert model.verify_model(Flaky("pong"), c) and not model.verify_model(Flaky(ValueError("x")), c)
    assert model.RetryPolicy().wait_s(10, lambda: 0.5) == 10.0


class Broken:
    def complete(self, *a, **k):
        raise RuntimeError("no model")


def test_synthesis_routes(spark):
    rows = [("a", "query a", k, f"t{k}", f"https://u{k}.com/", 1.0 - k / 10, "some words here. " * 30) for k in range(5)] + [("b", "query b", 0, "t", "https://v.com/", 1.0, "short text. more")]
    items = spark.createDataFrame(rows, "query_id string, query string, rank int, title string, url string, score double, content string")
    got = {r.query_id: r for r in synthesis.synthesize(items, EchoModel, config.ModelConfig(context_tokens=400)).collect()}
    assert got["a"].route == "batch" and got["a"].batches > 1 and not got["a"].digest.degraded and len(got["a"].digest.sources) == 5
    assert got["b"].route == "single" and got["b"].digest.answer.startswith("Query: query b")
    down = {r.query_id: r for r in synthesis.synthesize(items, Broken, config.ModelConfig(context_tokens=400)).collect()}
    assert all(r.digest.degraded and r.digest.answer.startswith(digest.EXCERPT_NOTICE) for r in down.values())
    one = synthesis.synthesize_single(items.select("url", "title", "content"), EchoModel).collect()
    assert {r.url for r in one if r.digest.degraded} == {"https://v.com/"} and all(len(r.digest.sources) == 1 for r in one)


def test_web_flows(spark):
    text = "A sentence that is long enough to count. " * 8
    h = spark.createDataFrame([(1, "q", 0, "hit", "https://a.com/", "", 1.0), (1, "q", 1, "hit", "https://b.com/", "", 0.5), (1, "q", 2, "hit", "https://gone.com/", "", 0.4), (2, "p", 0, "hit", "https://gone.com/", "", 1.0)], "query_id int, query string, rank int, title string, url string, snippet string, score double")
    p = spark.createDataFrame([("https://a.com/", True, "A", text, None, None), ("https://b.com/", True, "", text, None, None), ("https://gone.com/", False, None, None, "HTTP 404: Page not found (x)", "http_error")], "url string, success boolean, title string, content string, error string, category string")
    got = {r.query_id: r for r in web.web_search(h, p, EchoModel).collect()}
    assert (got[1].outcome, got[1].scraped, got[1].failed, got[1].items) == ("partial", 2, 1, 1) and got[1].text.count("https://a.com/") >= 1
    assert got[2].outcome == "failed" and got[2].digest is None
    f = {r.url: r for r in web.web_fetch(p, EchoModel).collect()}
    assert f["https://a.com/"].outcome == "success" and f["https://gone.com/"].text == "The page returned 404 — verify the URL is correct (https://gone.com/)"


def test_fallbacks(spark):
    from quarryspark.functions.failures import PipelineTimeout

    items = spark.createDataFrame([(1, "q", 0, "t", "no url", "", 1.0, "text. more")], "query_id int, query string, rank int, title string, url string, snippet string, score double, content string")
    kept = web.dedup_or_all(items).collect()
    assert [(r.normalized_url, r.merged_sources, r.fingerprint_count) for r in kept] == [("no url", [], 0)]
    assert web.excerpts_after_timeout(items).first().digest.key_points == ["text."]
    with pytest.raises(PipelineTimeout):
        web.excerpts_after_timeout(items.limit(0))


def test_time_limit(spark):
    from quarryspark.functions.failures import PipelineTimeout

    slow = F.udf(lambda x: __import__("time").sleep(20) or x, "long")
    with pytest.raises(PipelineTimeout), deadline.time_limit(spark, 1.0):
        spark.range(4).select(slow("id")).collect()


def test_tools():
    call = tools.dispatcher(lambda p: f"{p.query}/{p.max_results}", lambda p: "x" * 30_000)
    assert call("web_search", {"query": "a"}) == tools.ToolResult("a/5") and call("web_fetch", {"url": "https://a"}).text.endswith("[Response truncated due to length]")
    for name, args in (("web_search", {}), ("web_search", {"query": ""}), ("web_search", {"query": "a", "max_results": 0}), ("web_search", {"query": "a", "x": 1}), ("web_fetch", {"url": "zzz"}), ("web_fetch", None), ("other", {})):
        assert call(name, args).is_error
    late = tools.dispatcher(lambda p: (_ for _ in ()).throw(TimeoutError("timed out")), lambda p: "")
    assert late("web_search", {"query": "a"}).text == tools.TIMED_OUT


def test_stream(spark, tmp_path):
    from quarryspark.streaming.url_dedup import first_of_address

    rows = [("http://a.com/?ref=x", "2024-01-01 00:00:00"), ("https://a.com/", "2024-01-01 00:01:00"), ("https://b.com/", "2024-01-01 00:02:00"), ("bad", "2024-01-01 00:03:00")]
    spark.createDataFrame(rows, "url string, t string").selectExpr("url", "cast(t as timestamp) ts").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("url string, ts timestamp").parquet(str(tmp_path / "in"))
    q = first_of_address(s).writeStream.format("memory").queryName("addresses").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r.normalized_url for r in spark.table("addresses").collect()} == {"https://a.com/", "https://b.com/"}


def test_prompts(spark):
    d = spark.range(1).select(batching.user_prompt(F.lit("q"), F.array(F.struct(F.lit("u").alias("url"), F.lit("t").alias("title"), F.lit("c").alias("content"))), F.lit(" ")).alias("p"), batching.prompt_overhead(F.lit("q")).alias("o"), estimate_tokens(F.lit(batching.SYSTEM_PROMPT)).alias("s")).first()
    assert "focus" not in d.p and d.p.startswith("Query: q\n\n---\nSource: u") and d.o > d.s


def test_shown_items_are_all_that_an_excerpt_needs(spark):
    import random

    r = random.Random(6)
    words = ["word", "a.", "v1.2", " ", "\n", "  ", "Sentence.", "x" * 300, " "]
    rows = [(q, k, f"t{k}", f"https://u{k}.com", r.choice([0.1, 0.5, 0.9, None]), "".join(r.choice(words) + r.choice(["", " "]) for _ in range(r.choice([0, 1, 3, 40, 400])))) for q in range(25) for k in range(r.randrange(1, 25))]
    d = spark.createDataFrame(rows, "q int, pos int, title string, url string, score double, content string")
    for most in (2000, 8000):
        whole = digest.items_of(d, "q", "pos").select("q", digest.excerpt_digest("items").alias("e"), digest.pipeline_excerpts("items", most).alias("p"))
        short = digest.shown_items(d, "q", "pos").select("q", digest.excerpt_digest("items", shown=True).alias("e"))
        titled = digest.shown_items(d, "q", "pos", most, titled=True).select("q", digest.pipeline_excerpts("items", most, shown=True).alias("p"))
        want = {x.q: x for x in whole.collect()}
        assert {x.q: x.e for x in short.collect()} == {q: x.e for q, x in want.items()}
        assert {x.q: x.p for x in titled.collect()} == {q: x.p for q, x in want.items()}
    held = digest.shown_items(spark.createDataFrame([("q", k, "t", "u", float(k), "long text. " * 10_000) for k in range(40)], "q string, pos int, title string, url string, score double, content string"), "q", "pos").first()
    assert sum(len(i.content) for i in held["items"]) <= 2001 and len(held["items"]) == 40


class Counting:
    """Answers of the same length, whatever it is asked; notes each prompt's size below the folder."""

    def __init__(self, folder):
        self.folder = folder

    def complete(self, system, user, *, temperature, max_tokens, timeout_s):
        import uuid

        open(f"{self.folder}/{len(user)}-{'digest' if '--- Digest' in user else 'batch' if 'digest://' in user else 'first'}-{uuid.uuid4().hex}", "w").close()
        return "## Answer\n" + "An answer. " * 12 + "\n## Key Points\n- p\n## Sources\n"


def test_merging_takes_rounds_and_no_prompt_is_over_the_limit(spark, tmp_path):
    import functools
    import os

    rows = [("a", "query a", k, f"t{k}", f"https://u{k}.com/", 1.0 - k / 100, "some words here. " * 30) for k in range(40)]
    items = spark.createDataFrame(rows, "query_id string, query string, rank int, title string, url string, score double, content string")
    c = config.ModelConfig(context_tokens=700)
    got = synthesis.synthesize(items, functools.partial(Counting, str(tmp_path)), c).first()
    sent = [x.split("-")[:2] for x in os.listdir(tmp_path)]
    assert got.route == "batch" and not got.digest.degraded and len(got.digest.sources) == 40
    rounds = {kind: sum(k == kind for _, k in sent) for kind in ("first", "batch", "digest")}
    assert rounds["first"] == got.batches > 5 and rounds["batch"] >= 2 and rounds["digest"] == 1
    assert max(int(n) for n, _ in sent) <= c.context_tokens * c.safe_ratio * 4
