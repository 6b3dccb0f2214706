"""The two composite flows over DataFrames: many queries or pages at once.

``web_search``: hits with scraped pages, deduplicated, digested, one row a query.
``web_fetch``: one digest a page. Every row says how it went.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryspark.functions.failures import TIMED_OUT, PipelineTimeout, fetch_error_message, tool_error, tool_success
from quarryspark.functions.text import is_blank
from quarryspark.operators.dedup import deduplicate
from quarryspark.operators.digest import format_digest, page_excerpt, pipeline_excerpts, shown_items
from quarryspark.operators.hits import join_pages, parse_answers, top_hits
from quarryspark.plans.config import DedupConfig, ModelConfig, PipelineConfig
from quarryspark.plans.deadline import rows_in_time, within
from quarryspark.plans.model import Model
from quarryspark.plans.synthesis import synthesize
from quarryspark.runtime import materialize, materialize_counted

log = logging.getLogger(__name__)
#: queries to answers, addresses to scraped pages: what a flow gets its data from
Stage = Callable[[DataFrame], DataFrame]


def dedup_hits(items: DataFrame, config: DedupConfig = DedupConfig(), *, key: str = "query_id", rank: str = "rank") -> DataFrame:
    """Content items deduplicated within each query: addresses and contents of different queries never meet.

    One plan serves all queries: the query is part of every stage's key. Items are numbered
    in the order of their rank, which decides ties and where a merged item stands.
    """
    numbered = materialize(items.repartition(key).sortWithinPartitions(key, rank).withColumn("item_id", F.monotonically_increasing_id()))
    return deduplicate(numbered, threshold=config.similarity_threshold, min_chars=config.min_paragraph_chars, extra_tracking=config.extra_tracking_params, scope=key)


def dedup_or_all(items: DataFrame, config: DedupConfig = DedupConfig(), *, key: str = "query_id") -> DataFrame:
    """``dedup_hits``; where that fails or leaves nothing, all items as they are, each its own address."""
    try:
        kept, n = materialize_counted(dedup_hits(items, config, key=key))
        log.info("stage=deduplicate items=%d", n)
        if n:
            return kept
    except PySparkException as e:
        log.warning("deduplication failed, going on with all items: %s", e)
    return items.select(
        F.monotonically_increasing_id().alias("item_id"), "title", "url", "snippet", "score", "content", F.col("url").alias("normalized_url"),
        F.array().cast("array<string>").alias("merged_sources"), F.lit(0).alias("fingerprint_count"), F.col("rank").cast("long").alias("first_pos"), key,
    )


def excerpts_after_timeout(items: DataFrame, *, key: str = "query_id", rank: str = "rank", most: int = 8000) -> DataFrame:
    """(key, digest) of what was fetched before the time ran out; PipelineTimeout where that is nothing."""
    if items.isEmpty():
        raise PipelineTimeout("timed out before any page was fetched")
    return shown_items(items, key, rank, most, titled=True).select(key, pipeline_excerpts("items", most, shown=True).alias("digest"))


#: fixed values: why a search has no digest
NO_USABLE = "No usable search results found (all results had invalid or empty URLs)."
NO_RESULTS = "Search returned zero results."
#: fixed value: characters of a query
MAX_QUERY_CHARS = 500


def _focus(focus: str | None) -> Column | None:
    return None if focus is None else F.lit(focus)


def web_search(
    hits: DataFrame,
    pages: DataFrame,
    make_model: Callable[[], Model],
    *,
    model: ModelConfig | None = None,
    dedup: DedupConfig | None = None,
    config: PipelineConfig | None = None,
    max_results: int | None = 5,
    focus: str | None = None,
    seconds: float | None = None,
    page_keys: tuple[str, ...] = ("url",),
) -> DataFrame:
    """(query_id, query, outcome, digest, text, scraped, failed, items): hits are (query_id, query, rank, title, url, snippet, score), pages as ``scrape`` gives them.

    Of each query the best ``max_results`` hits with an address count. Outcomes: success;
    partial, where some pages were not to be had; degraded, where the digest is of excerpts
    because ``seconds`` ran out; failed, where ``text`` says why there is no digest. Pages
    count by partitions: when the time runs out, excerpts are made of the partitions that
    were finished, and PipelineTimeout is raised only where that is no page at all. A page is a
    hit's by its address, or by ``page_keys``, columns of both. Settings that are not given
    come from the environment.
    """
    model, dedup, config = model or ModelConfig.load(), dedup or DedupConfig.load(), config or PipelineConfig.load()
    spark, began = hits.sparkSession, time.monotonic()
    deadline = None if seconds is None else began + seconds
    best = Window.partitionBy("query_id").orderBy("rank", "url")
    usable = hits.filter(~is_blank("url"))
    if max_results is not None:
        usable = usable.withColumn("_nth", F.row_number().over(best)).filter(F.col("_nth") <= max_results).drop("_nth")
    pages, late = rows_in_time(pages, deadline)
    items, failures = join_pages(usable, pages, page_keys)
    items, n = materialize_counted(items)
    log.info("stage=scrape items=%d ms=%d", n, (time.monotonic() - began) * 1000)

    def condensed() -> tuple[DataFrame, DataFrame]:
        kept = dedup_or_all(items, dedup)
        asked = items.select(F.col("query_id").alias("_q"), "query").distinct()
        kept = kept.join(asked, F.col("query_id") == F.col("_q")).drop("_q").withColumnRenamed("first_pos", "rank")
        return kept, materialize(synthesize(kept, make_model, model, focus=_focus(focus)).select("query_id", "digest").withColumn("late", F.lit(False)))

    try:
        if late:
            raise PipelineTimeout("the time ran out before all pages were there")
        kept, digests = within(spark, deadline, condensed)
    except PipelineTimeout as e:
        log.warning("%s, going on with excerpts", e)
        cut_off = excerpts_after_timeout(items, most=config.max_content_chars)
        digest = F.struct("digest.answer", "digest.key_points", "digest.sources", F.lit(True).alias("degraded"))
        late, kept, digests = True, items, cut_off.select("query_id", digest.alias("digest"), F.lit(True).alias("late"))
    line = F.struct("rank", F.concat(F.lit("  - "), F.col("url"), F.lit(": "), F.col("error")).alias("line"))
    one = lambda name: F.lit(1).cast("long").alias(name)
    # all that is known of a query, in one aggregation
    told = hits.select("query_id", "query")
    for part in (items.select("query_id", one("scraped")), failures.select("query_id", one("failed"), line.alias("line")), kept.select("query_id", one("items")), digests):
        told = told.unionByName(part, allowMissingColumns=True)
    summed = [F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("scraped", "failed", "items")]
    out = told.groupBy("query_id").agg(F.max("query").alias("query"), *summed, F.first("digest", ignorenulls=True).alias("digest"), F.first("late", ignorenulls=True).alias("late"), F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["line"]), "\n").alias("why"))
    none = F.when(F.col("failed") > 0, F.concat(F.lit("All "), F.col("failed").cast("string"), F.lit(" URL(s) failed to scrape:\n"), F.col("why"))).otherwise(F.lit(TIMED_OUT if late else NO_USABLE))
    text = F.when(F.col("digest").isNull(), none).otherwise(tool_success(format_digest("digest.answer", "digest.key_points", "digest.sources")))
    outcome = F.when(F.col("digest").isNull(), "failed").when(F.col("late"), "degraded").when(F.col("failed") > 0, "partial").otherwise("success")
    return out.select("query_id", "query", outcome.alias("outcome"), "digest", text.alias("text"), "scraped", "failed", "items")


def run_search(
    queries: DataFrame,
    ask: Stage,
    fetch: Stage,
    make_model: Callable[[], Model],
    *,
    model: ModelConfig | None = None,
    dedup: DedupConfig | None = None,
    config: PipelineConfig | None = None,
    max_results: int = 5,
    focus: str | None = None,
    seconds: float | None = None,
    page_keys: tuple[str, ...] = ("url",),
) -> DataFrame:
    """``web_search`` for a table of queries (query_id, query), from the text of each to its digest, in one row each.

    ``ask`` gives each query its node's answer (``sources.search.ask_nodes`` or
    ``recorded_answers``), ``fetch`` each address its page (``sources.pages.fetcher`` or
    ``recorded_pages``). An address that several queries hit is fetched once, or for each
    query where ``page_keys``, which ``fetch`` is given and gives back, name it too. Blank and
    overlong queries, those whose node failed or had no hit, and those that were not reached
    in ``seconds`` are failed, and ``text`` says why. Ids are distinct.
    """
    spark, began = queries.sparkSession, time.monotonic()
    deadline = None if seconds is None else began + seconds
    wrong = F.when(is_blank("query"), F.lit("query must not be empty")).when(F.length("query") > MAX_QUERY_CHARS, F.lit(f"query must have at most {MAX_QUERY_CHARS} characters"))
    asked = queries.select("query_id", "query", wrong.alias("why"))
    answers, _ = rows_in_time(ask(asked.filter("why IS NULL").select("query_id", "query")), deadline)
    refused = F.coalesce(F.col("error"), F.when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string"))))
    said = answers.withColumn("refused", refused)
    parsed = materialize(parse_answers(said.filter("refused IS NULL")))
    best = top_hits(parsed.filter("NOT malformed AND error IS NULL"), max_results)
    hits, n = materialize_counted(best.join(asked.select(F.col("query_id").alias("_q"), "query"), F.col("query_id") == F.col("_q")).drop("_q"))
    log.info("stage=search hits=%d ms=%d", n, (time.monotonic() - began) * 1000)
    left = None if deadline is None else max(0.0, deadline - time.monotonic())
    try:
        found = web_search(hits, fetch(hits.select(*page_keys).distinct()), make_model, model=model, dedup=dedup, config=config, max_results=max_results, focus=focus, seconds=left, page_keys=page_keys)
    except PipelineTimeout:
        if not n:
            raise
        nothing = hits.groupBy("query_id").agg(F.max("query").alias("query"))
        found = nothing.select("query_id", "query", F.lit("failed").alias("outcome"), F.lit(None).cast(_DIGEST).alias("digest"), F.lit(TIMED_OUT).alias("text"), *[F.lit(0).cast("long").alias(c) for c in ("scraped", "failed", "items")])
    # queries without a hit: what their answer said, one row each
    words = F.concat(F.lit("Search failed: "), F.coalesce("refused", "error"))
    told = said.select("query_id", "refused").join(parsed.filter("error IS NOT NULL").select("query_id", "error"), "query_id", "left").join(parsed.filter("malformed").select("query_id").distinct().withColumn("bad", F.lit(True)), "query_id", "left")
    reason = told.select(F.col("query_id").alias("_q"), F.coalesce(words, F.when(F.col("bad"), F.lit(NO_USABLE)), F.lit(NO_RESULTS)).alias("said"))
    rest = asked.join(hits.select("query_id").distinct(), "query_id", "left_anti").join(reason, F.col("query_id") == F.col("_q"), "left")
    why = F.coalesce("why", tool_error(F.col("said")), F.lit(TIMED_OUT))
    empty = rest.select("query_id", "query", F.lit("failed").alias("outcome"), F.lit(None).cast(found.schema["digest"].dataType).alias("digest"), why.alias("text"), *[F.lit(0).cast("long").alias(c) for c in ("scraped", "failed", "items")])
    return found.unionByName(empty)


_DIGEST = "struct<answer:string,key_points:array<string>,sources:array<struct<url:string,title:string>>,degraded:boolean>"


def web_fetch(pages: DataFrame, make_model: Callable[[], Model], *, config: PipelineConfig | None = None, model: ModelConfig | None = None, focus: str | None = None, seconds: float | None = None) -> DataFrame:
    """(url, outcome, digest, text): a digest a page, or why there is none; an excerpt where ``seconds`` run out.

    A row of ``pages`` is a page, also where several have one address. Pages of partitions that were not finished in time are not among the rows; ``run_fetch``
    says so of each.
    """
    config, model = config or PipelineConfig.load(), model or ModelConfig.load()
    spark = pages.sparkSession
    deadline = None if seconds is None else time.monotonic() + seconds
    pages, late = rows_in_time(pages.withColumn("_page", F.monotonically_increasing_id()), deadline)
    good = F.col("success") & (F.length("content") >= 1)
    items = pages.filter(good).select(F.col("_page").alias("query_id"), F.col("url").alias("query"), F.lit(0).cast("long").alias("rank"), "title", "url", F.lit(1.0).alias("score"), "content")
    try:
        if late:
            raise PipelineTimeout("the time ran out before all pages were there")
        digests = within(spark, deadline, lambda: materialize(synthesize(items, make_model, model, focus=_focus(focus))))
        done = digests.select(F.col("query").alias("url"), F.lit("success").alias("outcome"), "digest", tool_success(format_digest("digest.answer", "digest.key_points", "digest.sources")).alias("text"))
    except PipelineTimeout as e:
        log.warning("%s, going on with excerpts", e)
        shown = page_excerpt("url", "title", "content", config.max_content_chars)
        digest = F.struct(shown.alias("answer"), F.array().cast("array<string>").alias("key_points"), F.array(F.struct("url", "title")).alias("sources"), F.lit(True).alias("degraded"))
        done = items.select("url", F.lit("degraded").alias("outcome"), digest.alias("digest"), tool_success(shown).alias("text"))
    why = F.when(F.col("success"), F.concat(F.lit("The page at "), F.col("url"), F.lit(" has no readable content"))).otherwise(fetch_error_message("url", "error", config.scrape_timeout_ms))
    lost = pages.filter(~F.coalesce(good, F.lit(False))).select("url", F.lit("failed").alias("outcome"), F.lit(None).cast(done.schema["digest"].dataType).alias("digest"), why.alias("text"))
    return done.unionByName(lost)


def run_fetch(urls: DataFrame, fetch: Stage, make_model: Callable[[], Model], *, config: PipelineConfig | None = None, model: ModelConfig | None = None, focus: str | None = None, seconds: float | None = None) -> DataFrame:
    """``web_fetch`` for a table of addresses (url), one row for each distinct one; those not reached in ``seconds`` are failed."""
    asked = urls.select("url").distinct()
    found = materialize(web_fetch(fetch(asked), make_model, config=config, model=model, focus=focus, seconds=seconds))
    rest = asked.join(found.select("url"), "url", "left_anti").select("url", F.lit("failed").alias("outcome"), F.lit(None).cast(found.schema["digest"].dataType).alias("digest"), F.lit(TIMED_OUT).alias("text"))
    return found.unionByName(rest)
