"""Odd tables against the SQL: pages whose article is shorter than their footer or empty, documents without text."""

import html

import duckdb
import pytest

from quarryspark.functions.readable import readable
from quarryspark.queries import ORACLE_SQL, QUERIES

FOOTER = "<footer>Copyright of the site, and a text that is longer than the article above it.</footer>"
SHORT = ["", " ", "A.", "De la.", "No & yes", "Es is of are.", "1. x", "A text of a middling length, as long as a line."]


def assert_as_sql(spark, folder, table, name):
    got = QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted(cur.fetchall(), key=key)


@pytest.fixture(scope="module")
def short_articles(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("short"))
    said = [html.escape(SHORT[k // 5 % len(SHORT)]) for k in range(80)]
    page = "<html><head><title>{0}</title></head><body><nav><ul><li><a href=a>Home</a></li></ul></nav><div class=\"ad\">An advert of the day.</div><article><h1>{0}</h1><p><b>{0}<br></article>" + FOOTER
    rows = [(k, f"https://example.com/{k}", page.format(x)) for k, x in enumerate(said)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", ["html_extract", "scrape_pages", "web_fetch", "web_search", "search_flow"])
def test_short_articles(spark, short_articles, name):
    assert_as_sql(spark, short_articles, "pages", name)


def test_no_aside_stands_for_a_named_part():
    assert readable(f"<article></article>{FOOTER}") == ("", "") and readable(f"<main><p>Hi</p></main>{FOOTER}")[1] == "Hi"
    assert readable(f"<article><a href=x>one</a></article><article><a href=y>two</a></article>{FOOTER}")[1] == "one\ntwo"
    assert readable(FOOTER)[1].startswith("Copyright")


@pytest.fixture(scope="module")
def blank_documents(spark, tmp_path_factory):
    """Sixty documents of twelve texts, most of them blank or null."""
    folder = str(tmp_path_factory.mktemp("blank"))
    texts = ["A. B.\nc", "", "One more document.", None, " ", "\n", "Long enough. " * 9, "\t\r\n", "　", "x", "", "De la."]
    rows = [(k, texts[k // 3 % 12], f"src{k % 4}") for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["digest_parse", "reconcile_sources", "digest_format", "batch_assign", "prompt_build", "route_flag"])
def test_blank_documents(spark, blank_documents, name):
    assert_as_sql(spark, blank_documents, "documents", name)


def test_blank_answers(values):
    from quarryspark.operators.digest import parse_digest

    said = "## Answer\n\n## Key Points\n- p\n## Sources\nhttps://a.com"
    assert [(r.answer, r.key_points) for r in values(lambda c: parse_digest(c, blank_answer=True), [said, "Answer:\nKey points:\n- p", ""])] == [("", ["p"]), ("", ["p"]), ("", [])]
    assert values(parse_digest, [said])[0].answer == said
