"""Tables in which several pages have one address: every page counts for its own hit."""

import json
import os

import duckdb
import pytest

from quarryspark.operators.hits import join_pages
from quarryspark.plans import web
from quarryspark.queries import ORACLE_SQL, QUERIES, EchoModel
from quarryspark.sources import pages as P

TEXT = "A sentence that is long enough to count. "


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Thirty pages with five addresses, their titles ending in the middle of a reference."""
    folder = str(tmp_path_factory.mktemp("repeated"))
    rows = [(k, f"https://example.com/{k % 5}/p", f"<html><head><title>T{k} &amp;&amp</title></head><body><article><h1>T{k} &amp;&amp</h1><p>{(TEXT + str(k) + ' ') * (6 + k)}</p></article></body></html>") for k in range(30)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", ["html_extract", "scrape_failures", "scrape_join", "scrape_pages", "web_fetch", "web_search"])
def test_repeated_addresses(spark, repeated, name):
    got = QUERIES[name](spark, repeated)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{os.path.join(repeated, 'pages.parquet')}/*.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted(cur.fetchall(), key=key)


def test_join_pages_by_hit(spark):
    h = spark.createDataFrame([(1, 0, "hit", "u"), (2, 0, "hit", "u")], "query_id int, rank int, title string, url string")
    p = spark.createDataFrame([(1, "u", True, "one", "c1", None, None), (2, "u", False, None, None, "HTTP 404", "http_error")], "query_id int, url string, success boolean, title string, content string, error string, category string")
    items, failures = join_pages(h, p, ("query_id", "url"))
    assert [(r.query_id, r.title) for r in items.collect()] == [(1, "one")] and [(r.query_id, r.error) for r in failures.collect()] == [(2, "HTTP 404")]
    assert {r.title for r in join_pages(h, p)[0].collect()} == {"one"} and join_pages(h, p)[1].isEmpty()


def test_run_search_with_pages_of_each_query(spark):
    answers = spark.createDataFrame([(q, 200, json.dumps({"results": [{"url": "https://a.com/", "title": "t", "score": 1.0}]}), "application/json") for q in (1, 2)], "query_id long, status int, body string, content_type string")
    known = [(q, "https://a.com/", 200, "OK", "text/html", f"<title>Title {q}</title><p>{TEXT * 8}</p>".encode(), None) for q in (1, 2)]
    fetched = spark.createDataFrame(known, "query_id long, url string, status int, status_text string, content_type string, body binary, error string")
    asked = spark.createDataFrame([(1, "one"), (2, "two")], "query_id long, query string")
    from quarryspark.sources.search import recorded_answers

    keys = ("query_id", "url")
    got = {r.query_id: r for r in web.run_search(asked, recorded_answers(answers), P.recorded_pages(fetched, keys=keys), EchoModel, page_keys=keys).collect()}
    assert {q: (r.outcome, r.scraped, r.digest.sources[0].title) for q, r in got.items()} == {1: ("success", 1, "Title 1"), 2: ("success", 1, "Title 2")}
