"""Search hits: parsing of JSON answers, scores, duplicates by address, top k per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryspark.functions.text import SNIPPET_CHARS, TITLE_CHARS, WS, truncate_field
from quarryspark.functions.urls import strip_fragment, valid_hit_url

UNTITLED = "(untitled)"
EXCERPT_CHARS = 200


def parse_answers(answers: DataFrame, *, key: str = "query_id", body: str = "body", content_type: str = "content_type") -> DataFrame:
    """One row a hit: key, pos, title, url, content, score, malformed; answers that are no JSON give one row with ``error``.

    A hit that is no object or has no valid address is kept with ``malformed`` true, so it
    can be counted; ``pos`` numbers the array's entries from 0.
    """
    text = F.col(body)
    looks = F.coalesce(F.lower(F.col(content_type)).contains("application/json"), F.lit(False)) | F.regexp_replace(text, f"\\A[{WS}]+", "").rlike(r"\A[{\[]")
    v = F.try_parse_json(text)
    error = F.when(~looks, F.concat(F.lit("Search node returned non-JSON response (Content-Type: "), F.coalesce(F.col(content_type), F.lit("null")), F.lit("). Ensure the instance supports format=json."))).when(v.isNull(), F.lit("Failed to parse search response as JSON"))
    hits = F.try_variant_get(v, "$.results", "array<variant>")
    parsed = answers.select(F.col(key), error.alias("error"), F.when(error.isNotNull(), F.left(text, F.lit(EXCERPT_CHARS))).alias("excerpt"), F.posexplode_outer(hits).alias("pos", "hit")).filter("pos IS NOT NULL OR error IS NOT NULL")
    typed = lambda name, kind: F.schema_of_variant(F.variant_get("hit", f"$.{name}", "variant")).rlike(kind)
    string = lambda name: F.when(typed(name, r"\ASTRING"), F.try_variant_get("hit", f"$.{name}", "string"))
    url = valid_hit_url(string("url"))
    score = F.when(typed("score", r"\A(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"), F.try_variant_get("hit", "$.score", "double"))
    return parsed.select(key, "pos", F.coalesce(string("title"), F.lit("")).alias("title"), url.alias("url"), F.coalesce(string("content"), F.lit("")).alias("content"), score.alias("score"), (F.col("error").isNull() & url.isNull()).alias("malformed"), "error", "excerpt")


def normalize_scores(hits: DataFrame, *, key: str = "query_id", pos: str = "pos") -> DataFrame:
    """``score`` as a share of the query's best; by position where there is none; 1 for a single hit."""
    per = Window.partitionBy(key)
    n, top = F.count(F.lit(1)).over(per), F.max(F.coalesce("score", F.lit(0.0))).over(per)
    some = F.count("score").over(per) > 0
    i = F.row_number().over(per.orderBy(pos)) - 1
    return hits.withColumn("score", F.when(n == 1, F.lit(1.0)).when(some & (top > 0), F.coalesce("score", F.lit(0.0)) / top).otherwise(1.0 - i / n))


def drop_duplicate_hits(hits: DataFrame, *, key: str = "query_id", pos: str = "pos") -> DataFrame:
    """Per query and address without fragment the best hit, the first of equals; ``first_pos`` is where the address came first."""
    same = Window.partitionBy(key, F.col("_address"))
    marked = hits.withColumn("_address", strip_fragment("url"))
    return marked.withColumn("first_pos", F.min(pos).over(same)).withColumn("_n", F.row_number().over(same.orderBy(F.col("score").desc(), pos))).filter("_n = 1").drop("_n", "_address")


def top_hits(hits: DataFrame, k: int, *, key: str = "query_id", pos: str = "pos") -> DataFrame:
    """Scores, default titles, cut fields, one hit an address, the k best: key, rank, title, url, snippet, score."""
    scored = normalize_scores(hits, key=key, pos=pos)
    title = F.when(F.col("title") != "", F.col("title")).otherwise(UNTITLED)
    shown = scored.select(key, pos, truncate_field(title, TITLE_CHARS).alias("title"), "url", truncate_field("content", SNIPPET_CHARS).alias("snippet"), "score")
    best = Window.partitionBy(key).orderBy(F.col("score").desc(), "first_pos")
    return drop_duplicate_hits(shown, key=key, pos=pos).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(key, "rank", "title", "url", "snippet", "score")


def join_pages(hits: DataFrame, pages: DataFrame, on: tuple[str, ...] = ("url",)) -> tuple[DataFrame, DataFrame]:
    """(content items, failures): hits with what was fetched for their address, or why it wasn't.

    ``pages``: url, success, title, content, error, category; of several rows an address, a
    fetched one is used, the first by title and content. ``on``: what a page belongs to a hit
    by; where an address was fetched for several hits apart, their key too.
    """
    first = F.min(F.struct((~F.col("success")).alias("lost"), "title", "content", "error", "category")).alias("p")
    one = pages.groupBy(*on).agg(first).select(*on, (~F.col("p.lost")).alias("success"), F.col("p.title").alias("_title"), "p.content", "p.error", "p.category")
    both = hits.join(one, list(on))
    items = both.filter("success").select(*[c for c in hits.columns if c != "title"], F.coalesce(F.nullif("_title", F.lit("")), "title").alias("title"), "content")
    failures = both.filter("NOT success").select(*hits.columns, "category", "error")
    return items, failures
