"""Three-stage deduplication of content items: by address, by exact content, by similarity.

Items are (item_id, title, url, snippet, score, content). Stages run one after another on
the winners of the one before. The best score wins, then the least item_id; the addresses
of the others are the winner's ``merged_sources``. Items whose paragraphs are all too short
have an empty fingerprint set and count as equal content (``collapse_empty``). A threshold
of 0 merges everything. With ``scope``, a column of the items, all stages work within its
values.

What a stage shuffles is an id, a score and a 128-bit digest of the key for each item; the
winner of a key is an aggregate, so a key that many items share is combined before it is
shuffled. Who was merged into whom is kept as rows, (item_id, winner_id), which a stage
composes with those before it; lists of addresses are made of them once, at the end, for
winners that have any, and cut to ``most_sources`` addresses each where that is given.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quarryspark.functions.text import MIN_PARAGRAPH_CHARS, fingerprint_set, is_blank
from quarryspark.functions.urls import normalize_url
from quarryspark.operators.components import connected_components
from quarryspark.operators.simjoin import similar_pairs, warn_high_pairwise_cost
from quarryspark.runtime import materialize, materialize_counted, spread

log = logging.getLogger(__name__)
#: what the stages leave aside
HEAVY = ("title", "snippet", "content")


def prepare_items(items: DataFrame, *, min_chars: int = MIN_PARAGRAPH_CHARS, extra_tracking: tuple[str, ...] = ()) -> DataFrame:
    """``items`` with normalized_url and fingerprints, and ``state``: ok, empty or bad_url."""
    url = normalize_url("url", extra_tracking)
    marked = spread(items).withColumn("normalized_url", url)
    state = F.when(is_blank("content"), "empty").when(F.col("normalized_url").isNull(), "bad_url").otherwise("ok")
    return marked.withColumn("state", state).withColumn("fingerprints", F.when(F.col("state") == "ok", fingerprint_set("content", min_chars)))


@dataclass(frozen=True)
class Deduped:
    """What stages have left; otherwise used like its ``items``.

    ``items``: the winners, with ``first_pos``, the least id merged into each. ``lineage``:
    (item_id, winner_id) for each item that there was, winners included, after a first stage.
    ``urls``: (item_id, url) of each. Stages read their input several times, so what is costly
    to compute is materialized before them.
    """

    items: DataFrame
    lineage: DataFrame | None
    urls: DataFrame

    def __getattr__(self, name: str):
        return getattr(self.items, name)


def _started(items: DataFrame | Deduped) -> Deduped:
    if isinstance(items, Deduped):
        return items
    return Deduped(items.withColumn("first_pos", F.col("item_id")), None, items.select("item_id", "url"))


def keep_best(items: DataFrame | Deduped, by: list[Column], scope: str | None = None) -> Deduped:
    """One item a group of equal ``by``."""
    now = _started(items)
    by = by if scope is None else [*by, F.col(scope)]
    digest = [F.xxhash64(F.lit(1), *by).alias("_k1"), F.xxhash64(*by, F.lit(2)).alias("_k2")]
    keyed = now.items.select("item_id", "score", "first_pos", *digest)
    order = F.struct("score", -F.col("item_id"))
    best = keyed.groupBy(F.col("_k1").alias("_b1"), F.col("_k2").alias("_b2")).agg(F.max_by("item_id", order).alias("_best"), F.min("first_pos").alias("_first"))
    step = materialize(keyed.join(best, (F.col("_k1") == F.col("_b1")) & (F.col("_k2") == F.col("_b2"))).select(F.col("item_id").alias("_was"), "_best", "_first"))
    winners = step.filter("_was = _best").select("_best", F.col("_first").alias("first_pos"))
    kept = now.items.drop("first_pos").join(winners, F.col("item_id") == F.col("_best")).drop("_best")
    merged = step.select(F.col("_was").alias("item_id"), F.col("_best").alias("winner_id"))
    if now.lineage is not None:
        merged = now.lineage.join(step.select("_was", "_best"), F.col("winner_id") == F.col("_was")).select("item_id", F.col("_best").alias("winner_id"))
    return Deduped(kept, merged, now.urls)


def dedup_by_url(items: DataFrame | Deduped, *, scope: str | None = None) -> Deduped:
    return keep_best(items, [F.col("normalized_url")], scope)


def dedup_by_content(items: DataFrame | Deduped, *, collapse_empty: bool = True, scope: str | None = None) -> Deduped:
    own = F.lit(0) if collapse_empty else F.when(F.size("fingerprints") == 0, F.col("item_id")).otherwise(F.lit(-1))
    return keep_best(items, [F.col("fingerprints"), own], scope)


def dedup_by_similarity(items: DataFrame | Deduped, threshold: float = 0.85, *, scope: str | None = None) -> Deduped:
    now = _started(items)
    if threshold <= 0:
        return keep_best(now, [F.lit(0)], scope)
    sets, n = materialize_counted(now.items)
    now = Deduped(sets, now.lineage, now.urls)
    if scope is not None:
        sets = sets.withColumn("fingerprints", F.transform("fingerprints", lambda f: F.xxhash64(F.col(scope), f)))
    pairs = materialize(similar_pairs(sets, threshold, warn=lambda met: warn_high_pairwise_cost(n, met)))
    component = connected_components(pairs).select(F.col("id").alias("_id"), "component")
    labelled = now.items.join(component, F.col("item_id") == F.col("_id"), "left").withColumn("_group", F.coalesce("component", "item_id")).drop("_id", "component")
    best = keep_best(Deduped(labelled, now.lineage, now.urls), [F.col("_group")], scope)
    return Deduped(best.items.drop("_group"), best.lineage, best.urls)


def lineage_of(items: Deduped) -> DataFrame:
    """(winner_id, item_id, url) of each item that was merged into another."""
    lost = items.lineage.filter("item_id <> winner_id")
    return lost.join(items.urls.select(F.col("item_id").alias("_i"), "url"), F.col("item_id") == F.col("_i")).select("winner_id", "item_id", "url")


def merged_sources(items: Deduped, most: int | None = None) -> DataFrame:
    """(winner_id, merged_sources, n_merged): sorted distinct addresses other than the winner's own, the first ``most``; and how many items."""
    lost = lineage_of(items).groupBy("winner_id", "url").agg(F.count(F.lit(1)).alias("n"))
    if most is not None:
        lost = lost.withColumn("_nth", F.row_number().over(Window.partitionBy("winner_id").orderBy("url"))).withColumn("url", F.when(F.col("_nth") <= most + 1, F.col("url")))
    listed = lost.groupBy("winner_id").agg(F.collect_set("url").alias("_urls"), F.sum("n").alias("n_merged"))
    own = items.urls.select(F.col("item_id").alias("_i"), F.col("url").alias("_own"))
    others = F.array_sort(F.array_except("_urls", F.array("_own")))
    return listed.join(own, F.col("winner_id") == F.col("_i")).select("winner_id", (others if most is None else F.slice(others, 1, most)).alias("merged_sources"), "n_merged")


def finish(items: Deduped, *, scope: str | None = None, most_sources: int | None = None) -> DataFrame:
    """The result's columns, lineage sorted and at most ``most_sources`` addresses long."""
    merged = merged_sources(items, most_sources).select(F.col("winner_id").alias("_w"), "merged_sources")
    none = F.array().cast("array<string>")
    out = items.items.join(merged, F.col("item_id") == F.col("_w"), "left")
    return out.select("item_id", "title", "url", "snippet", "score", "content", "normalized_url", F.coalesce("merged_sources", none).alias("merged_sources"), F.size("fingerprints").alias("fingerprint_count"), "first_pos", *([] if scope is None else [scope]))


def _with_heavy(best: Deduped, items: DataFrame) -> Deduped:
    """``best`` with the columns of ``items`` that the stages left aside."""
    heavy = items.select(F.col("item_id").alias("_of"), *HEAVY)
    return Deduped(best.items.join(heavy, F.col("item_id") == F.col("_of")).drop("_of"), best.lineage, best.urls)


def deduplicate(items: DataFrame, *, threshold: float = 0.85, min_chars: int = MIN_PARAGRAPH_CHARS, extra_tracking: tuple[str, ...] = (), collapse_empty: bool = True, scope: str | None = None, most_sources: int | None = None) -> DataFrame:
    good = materialize(prepare_items(items, min_chars=min_chars, extra_tracking=extra_tracking).filter("state = 'ok'").drop("state", *HEAVY))
    best = dedup_by_similarity(dedup_by_content(dedup_by_url(good, scope=scope), collapse_empty=collapse_empty, scope=scope), threshold, scope=scope)
    return finish(_with_heavy(best, items), scope=scope, most_sources=most_sources)


def deduplicate_with_stats(items: DataFrame, *, threshold: float = 0.85, min_chars: int = MIN_PARAGRAPH_CHARS, extra_tracking: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(result, one row of counts by stage); the counts are observed as the stages run, without jobs of their own."""
    seen, counts = Observation(), {}
    prepared = materialize(prepare_items(items, min_chars=min_chars, extra_tracking=extra_tracking).drop(*HEAVY).observe(seen, F.count(F.lit(1)).alias("input"), F.count_if(F.col("state") == "empty").alias("empty"), F.count_if(F.col("state") == "bad_url").alias("bad")))

    def stage(name: str, after: Deduped) -> Deduped:
        kept, counts[name] = materialize_counted(after.items)
        log.info("stage=%s out=%d", name, counts[name])
        return Deduped(kept, after.lineage, after.urls)

    good = prepared.filter("state = 'ok'").drop("state")
    by_url = stage("url", dedup_by_url(good))
    by_content = stage("content", dedup_by_content(by_url))
    best = stage("similarity", dedup_by_similarity(by_content, threshold))
    n = seen.get
    ok = n["input"] - n["empty"] - n["bad"]
    row = (n["input"], n["empty"], n["bad"], ok - counts["url"], counts["url"] - counts["content"], counts["content"] - counts["similarity"], counts["similarity"])
    names = ("input_items", "empty_removed", "error_removed", "url_duplicates", "content_duplicates", "near_duplicates", "output_items")
    return finish(_with_heavy(best, items)), items.sparkSession.createDataFrame([row], ", ".join(f"{x} long" for x in names))
