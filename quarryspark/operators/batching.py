"""Prompts and how items are dealt to them: token estimates, greedy batches, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryspark.functions.text import _col, estimate_tokens, is_blank, js_trim, token_threshold

SYSTEM_PROMPT = "You condense web pages into a cited digest.\nWrite three sections: ## Answer, ## Key Points (a list), ## Sources (a list of title and URL).\nUse only what the sources say."
CITATION_RULE = "Cite only URLs that are listed above."


def item_segment(url: Column | str, title: Column | str, content: Column | str) -> Column:
    """An item's part of a prompt."""
    return F.concat(F.lit("---\nSource: "), _col(url), F.lit("\nTitle: "), _col(title), F.lit("\nContent:\n"), _col(content), F.lit("\n\n"))


def user_prompt(query: Column | str, items: Column | str, focus: Column | None = None) -> Column:
    """Query, items (array of struct with url, title, content) in order, focus if any, citation rule."""
    parts = F.array_join(F.transform(_col(items), lambda x: item_segment(x["url"], x["title"], x["content"])), "")
    wish = F.lit("") if focus is None else F.when(is_blank(focus), F.lit("")).otherwise(F.concat(F.lit("Please focus on: "), js_trim(focus), F.lit("\n\n")))
    return F.concat(F.lit("Query: "), _col(query), F.lit("\n\n"), parts, wish, F.lit(CITATION_RULE))


def single_prompt(url: Column | str, title: Column | str, content: Column | str, focus: Column | None = None) -> Column:
    item = F.array(F.struct(_col(url).alias("url"), _col(title).alias("title"), _col(content).alias("content")))
    return user_prompt(_col(url), item, focus)


def merge_prompt(query: Column | str, digests: Column | str) -> Column:
    """Query and the answers and sources of several digests (array of struct with answer, sources)."""
    block = lambda d, i: F.concat(F.lit("--- Digest "), (i + 1).cast("string"), F.lit("\n"), d["answer"], F.lit("\n"), F.array_join(F.transform(d["sources"], lambda s: F.concat(F.lit("- "), s["title"], F.lit(": "), s["url"])), "\n"), F.lit("\n\n"))
    return F.concat(F.lit("Query: "), _col(query), F.lit("\n\n"), F.array_join(F.transform(_col(digests), block), ""), F.lit(CITATION_RULE))


def prompt_overhead(query: Column | str, focus: Column | None = None) -> Column:
    """Estimated tokens of what every batch's prompt holds besides items; parts are rounded up on their own."""
    tokens = estimate_tokens(F.lit(SYSTEM_PROMPT)) + estimate_tokens(F.concat(F.lit("Query: "), _col(query), F.lit("\n\n"))) + estimate_tokens(F.lit(CITATION_RULE))
    return tokens if focus is None else tokens + F.when(is_blank(focus), F.lit(0)).otherwise(estimate_tokens(F.concat(F.lit("Please focus on: "), js_trim(focus), F.lit("\n\n"))))


def assign_batches(items: DataFrame, *, key: str, rank: str, tokens: str = "tokens", overhead: str = "overhead", threshold: int | None = None, context: int = 128_000, ratio: float = 0.8) -> DataFrame:
    """(key, rank, tokens, batch_no): greedy in rank order; an item too large on its own is a batch of its own.

    One fold over a query's items, which are a search's hits, a short list.
    """
    most = token_threshold(context, ratio) if threshold is None else threshold
    listed = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), F.col(tokens).cast("long").alias("tokens")))).alias("list"), F.max(overhead).cast("long").alias("_base"))
    base = F.col("_base")

    def step(acc: Column, x: Column) -> Column:
        full = (acc["n"] > 0) & (acc["used"] + x["tokens"] > most)
        batch = F.when(full, acc["batch"] + 1).otherwise(acc["batch"])
        used = F.when(full, base + x["tokens"]).otherwise(acc["used"] + x["tokens"])
        return F.struct(batch.alias("batch"), used.alias("used"), F.when(full, F.lit(1)).otherwise(acc["n"] + 1).alias("n"), F.concat(acc["out"], F.array(batch)).alias("out"))

    start = F.struct(F.lit(0).alias("batch"), base.alias("used"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))
    numbers = F.aggregate("list", start, step, lambda acc: acc["out"])
    return listed.select(key, F.explode(F.arrays_zip(F.col("list"), numbers.alias("batch_no"))).alias("z")).select(key, F.col("z.list.rank").alias(rank), F.col("z.list.tokens").alias("tokens"), F.col("z.batch_no").alias("batch_no"))


def route(tokens: Column | str, context: int = 128_000, ratio: float = 0.8) -> Column:
    """``single`` call or ``batch``."""
    return F.when(_col(tokens) <= token_threshold(context, ratio), "single").otherwise("batch")
