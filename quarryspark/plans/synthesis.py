"""From content items to one digest per query: a single call or batches that are merged, with excerpts as the fallback."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryspark.functions.text import estimate_tokens, is_blank
from quarryspark.operators.batching import SYSTEM_PROMPT, assign_batches, item_segment, merge_prompt, prompt_overhead, single_prompt, user_prompt
from quarryspark.operators.digest import SOURCES, batch_as_item, excerpt_digest, first_by_url, parse_digest, reconcile_sources, shown_items
from quarryspark.plans.config import ModelConfig
from quarryspark.plans.model import Model, answer_prompts
from quarryspark.runtime import materialize

log = logging.getLogger(__name__)
MIN_SINGLE_CHARS = 200


def _digest(answer: Column, error: Column, items: Column) -> Column:
    """The parsed answer with the items' sources, or excerpts where there is none."""
    parsed, fallback = parse_digest(answer), excerpt_digest(items)
    good = error.isNull() & ~is_blank(answer)
    known = F.transform(items, lambda x: F.struct(x["url"].alias("url"), x["title"].alias("title")))
    pick = lambda name, other: F.when(good, other).otherwise(fallback[name])
    return F.struct(pick("answer", parsed["answer"]).alias("answer"), pick("key_points", parsed["key_points"]).alias("key_points"), pick("sources", reconcile_sources(parsed["sources"], known)).alias("sources"), (~good).alias("degraded"))


def synthesize(items: DataFrame, make_model: Callable[[], Model], config: ModelConfig = ModelConfig(), *, key: str = "query_id", rank: str = "rank", query: str = "query", focus: Column | None = None) -> DataFrame:
    """(key, query, digest, route, batches); items are (key, query, rank, title, url, score, content)."""
    sized = items.withColumn("tokens", estimate_tokens(item_segment("url", "title", "content"))).withColumn("overhead", prompt_overhead(query, focus))
    batches = assign_batches(sized, key=key, rank=rank, context=config.context_tokens, ratio=config.safe_ratio)
    dealt = items.join(batches.select(F.col(key).alias("_k"), F.col(rank).alias("_r"), "batch_no"), (F.col(key) == F.col("_k")) & (F.col(rank) == F.col("_r")))
    prompts = dealt.groupBy(key, query, "batch_no").agg(F.array_sort(F.collect_list(F.struct(F.col(rank).cast("long").alias("pos"), "title", "url", F.col("score").cast("double").alias("score"), "content"))).alias("items"))
    asked = prompts.withColumn("system", F.lit(SYSTEM_PROMPT)).withColumn("user", user_prompt(query, "items", focus))
    answered = materialize(answer_prompts(asked, make_model, config))
    digests = answered.select(key, query, "batch_no", _digest(F.col("answer"), F.col("error"), F.col("items")).alias("d"))
    every = materialize(digests.groupBy(key, query).agg(F.array_sort(F.collect_list(F.struct("batch_no", F.col("d.answer").alias("answer"), F.col("d.key_points").alias("key_points"), F.col("d.sources").alias("sources"), F.col("d.degraded").alias("degraded")))).alias("parts")))
    whole = shown_items(items, key, rank)
    done = every.filter(F.size("parts") == 1).select(key, query, F.col("parts")[0].alias("p"), F.lit(1).alias("batches"))
    many = merge_digests(every.filter(F.size("parts") > 1), make_model, config, key=key, query=query, focus=focus)
    merged = done.select(key, query, F.struct("p.answer", "p.key_points", "p.sources", "p.degraded").alias("digest"), "batches").unionByName(many)
    # one failed batch fails the merge: excerpts of all items then
    final = merged.join(whole.withColumnRenamed(key, "_k"), F.col(key) == F.col("_k"))
    fallback = excerpt_digest("items", shown=True)
    shown = F.when(F.col("digest.degraded"), F.struct(fallback["answer"].alias("answer"), fallback["key_points"].alias("key_points"), fallback["sources"].alias("sources"), F.lit(True).alias("degraded"))).otherwise(F.col("digest"))
    return final.select(key, query, shown.alias("digest"), F.when(F.col("batches") == 1, "single").otherwise("batch").alias("route"), "batches")


def merge_digests(parts: DataFrame, make_model: Callable[[], Model], config: ModelConfig, *, key: str, query: str, focus: Column | None = None) -> DataFrame:
    """(key, query, digest, batches) from several digests a query.

    Digests too many for one prompt become items, are batched and digested again, until a
    prompt fits. A round that makes no prompt shorter could go on for ever; its query is
    marked degraded instead, and no prompt over the limit is sent.
    """
    most = int(config.context_tokens * config.safe_ratio)
    now = parts.withColumn("batches", F.size("parts"))
    union_sources = lambda ps: first_by_url(F.flatten(F.transform(ps, lambda p: p["sources"])).cast(SOURCES))
    of = lambda d: d.withColumn("user", merge_prompt(query, "parts")).withColumn("tokens", estimate_tokens("user"))
    now, fitting = materialize(of(now).withColumn("before", F.lit(None).cast("long"))), None
    while True:
        large = (F.col("tokens") > most) & (F.size("parts") > 1)
        shorter = F.col("before").isNull() | (F.col("tokens") < F.col("before"))
        done = now.filter(~large | ~shorter).select(key, query, "batches", "parts", "user", (large & ~shorter).alias("stuck"))
        fitting = done if fitting is None else fitting.unionByName(done)
        now = now.filter(large & shorter)
        if now.isEmpty():
            break
        log.info("merge re-batching: queries=%d threshold=%d", now.count(), most)
        items = materialize(now.select(key, query, "batches", "tokens", F.posexplode("parts").alias("rank", "part")).select(key, query, "batches", F.col("tokens").alias("before"), "rank", "part", batch_as_item(F.col("rank"), F.col("part")).alias("item")))
        sized = items.withColumn("tokens", estimate_tokens(item_segment("item.url", "item.title", "item.content"))).withColumn("overhead", prompt_overhead(query, focus))
        dealt = assign_batches(sized, key=key, rank="rank", context=config.context_tokens, ratio=config.safe_ratio).select(F.col(key).alias("_k"), F.col("rank").alias("_r"), "batch_no")
        grouped = items.join(dealt, (F.col(key) == F.col("_k")) & (F.col("rank") == F.col("_r"))).groupBy(key, query, "batches", "before", "batch_no").agg(F.array_sort(F.collect_list(F.struct("rank", "item", "part"))).alias("own"))
        asked = grouped.withColumn("system", F.lit(SYSTEM_PROMPT)).withColumn("user", user_prompt(query, F.transform("own", lambda x: x["item"]), focus))
        one, was = parse_digest("answer"), F.transform("own", lambda x: x["part"])
        bad = F.col("error").isNotNull() | F.exists(was, lambda p: p["degraded"])
        smaller = answer_prompts(asked, make_model, config).select(key, query, "batches", "before", F.struct("batch_no", F.coalesce(one["answer"], F.lit("")).alias("answer"), one["key_points"].alias("key_points"), union_sources(was).alias("sources"), bad.alias("degraded")).alias("p"))
        now = materialize(of(smaller.groupBy(key, query, "batches", "before").agg(F.array_sort(F.collect_list("p")).alias("parts"))))
    asked = fitting.filter("NOT stuck").withColumn("system", F.lit(SYSTEM_PROMPT))
    answered = materialize(answer_prompts(asked, make_model, config))
    parsed = parse_digest("answer")
    bad = F.col("error").isNotNull() | is_blank("answer") | F.exists("parts", lambda p: p["degraded"])
    digest = F.struct(F.coalesce(parsed["answer"], F.lit("")).alias("answer"), parsed["key_points"].alias("key_points"), reconcile_sources(parsed["sources"], union_sources(F.col("parts"))).alias("sources"), bad.alias("degraded"))
    given_up = F.struct(F.lit("").alias("answer"), F.array().cast("array<string>").alias("key_points"), union_sources(F.col("parts")).alias("sources"), F.lit(True).alias("degraded"))
    return answered.select(key, query, digest.alias("digest"), "batches").unionByName(fitting.filter("stuck").select(key, query, given_up.alias("digest"), "batches"))


def synthesize_single(pages: DataFrame, make_model: Callable[[], Model], config: ModelConfig = ModelConfig(), *, focus: Column | None = None) -> DataFrame:
    """(url, digest) a page: a call each, excerpts under MIN_SINGLE_CHARS; the page is its only source."""
    item = F.array(F.struct(F.lit(0).cast("long").alias("pos"), "title", "url", F.lit(1.0).alias("score"), "content"))
    asked = pages.select("url", "title", "content", item.alias("items")).withColumn("system", F.lit(SYSTEM_PROMPT)).withColumn("user", single_prompt("url", "title", "content", focus))
    enough = F.length("content") >= MIN_SINGLE_CHARS
    answered = answer_prompts(asked.filter(enough), make_model, config)
    d = _digest(F.col("answer"), F.col("error"), F.col("items"))
    only = F.array(F.struct("url", "title"))
    called = answered.select("url", F.struct(d["answer"].alias("answer"), d["key_points"].alias("key_points"), only.alias("sources"), d["degraded"].alias("degraded")).alias("digest"))
    x = excerpt_digest("items")
    short = asked.filter(~F.coalesce(enough, F.lit(False))).select("url", F.struct(x["answer"].alias("answer"), x["key_points"].alias("key_points"), only.alias("sources"), F.lit(True).alias("degraded")).alias("digest"))
    return called.unionByName(short)
