"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

1. Every source gets a weight (1, 2, 3, repeating, over the sources in code point order,
   null last) and with it a target, a share of all words. A target stops at three times
   the source's size; what is left over is shared again by weight. The fixed point of
   that is one water level ``L``: a source gets ``min(3 * size, L * weight)``; the sources
   that are capped are those with the smallest ``3 * size / weight``, so two running sums
   over the sources give the level for each number of capped ones, and the highest is ``L``.
2. Every document gets a hash-random key (md5 of seed and id). Within a source, documents
   are range-partitioned by that key into buckets of about ``bucket_rows`` rows; keys are
   uniform, so buckets are even however large the source is.
3. Prefix sums: bucket totals (pre-aggregated before the shuffle), running sums over them in
   two levels (runs of ``RUN`` buckets, then the runs of a source), and a running sum inside
   each bucket.
4. The budget is the rounded target. Whole epochs come first; the remainder is cut exactly
   where the running sum reaches it, inside a document if need be.

Cases: a null text has size 0; a null source is a source of its own, the last; a source
of size 0 has target 0 and nothing is taken from it; a null id is keyed by its text, so that
rows without ids spread; rows with equal ids are ordered by size, then by text, and equal
ones may stand for each other; an empty table gives no rows. Only the id, text and source
columns are read; ``apply_mix`` carries all others, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryspark.runtime import materialize, quoted

#: fixed value: a word is a run of anything but ASCII white space
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target); one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    weighted = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    fill = Window.orderBy(F.col("_ratio"), F.col("source").asc_nulls_last())
    before, onward = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    levels = (
        weighted.withColumn("_ratio", F.col("source_size") * cap / F.col("weight"))
        .withColumn("_left", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)))
        .withColumn("_level", F.col("_left") / F.sum("weight").over(onward))
        .withColumn("_level", F.max("_level").over(Window.partitionBy()))
    )
    full = (F.col("source_size") * cap).cast("double")
    return levels.select("source", "source_size", "weight", F.when(F.col("_ratio") < F.col("_level"), full).otherwise(F.least(full, F.col("_level") * F.col("weight"))).alias("target"))


#: buckets in a run of the two-level running sum
RUN = 1024


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, *more: Column) -> DataFrame:
    """(id, source, size, key) and ``more``."""
    named = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.md5(F.concat_ws(":", F.lit(seed), named)).alias("key"), *more)


def _bucketed(rows: DataFrame, targets: DataFrame) -> DataFrame:
    spot = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") / F.lit(4294967296)
    t = targets.withColumnRenamed("source", "of")
    return rows.join(t, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("bucket", F.floor(spot * F.col("buckets")))


def _plan(rows: DataFrame, weights: tuple[int, ...], cap: int, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """(targets, words ahead of each bucket) from (source, size, key)."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    buckets = totals.select(F.col("source").alias("of"), F.greatest(F.lit(1), F.ceil(F.col("rows") / bucket_rows)).alias("buckets"))
    targets = materialize(source_targets(totals.select("source", "source_size"), weights, cap).join(buckets, F.col("source").eqNullSafe(F.col("of"))).drop("of", "weight"))
    sums = materialize(_bucketed(rows, targets).groupBy("source", "bucket").agg(F.sum("size").alias("words")).withColumn("run", F.floor(F.col("bucket") / RUN)))
    before = lambda by, order: F.coalesce(F.sum("words").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = sums.groupBy("source", "run").agg(F.sum("words").alias("words")).select(F.col("source").alias("of"), F.col("run").alias("in_run"), before(["source"], "run").alias("run_ahead"))
    ahead = sums.withColumn("own_ahead", before(["source", "run"], "bucket")).join(runs, F.col("source").eqNullSafe(F.col("of")) & (F.col("run") == F.col("in_run")))
    return targets, ahead.select(F.col("source").alias("of"), F.col("bucket").alias("in_bucket"), (F.col("own_ahead") + F.col("run_ahead")).alias("ahead"))


def _cut(rows: DataFrame, targets: DataFrame, ahead: DataFrame, *ties: str) -> DataFrame:
    """``rows`` with source_size, target, epochs and the words of the partial epoch."""
    within = Window.partitionBy("source", "bucket").orderBy("key", "id", "size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    running = _bucketed(rows, targets).withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = running.join(ahead, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in_bucket")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    return joined.withColumns({"epochs": epochs, "partial": F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("ahead") - F.col("within")))})


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix", bucket_rows: int = 2_000
) -> DataFrame:
    """One row a document: id, source, size, source_size, target, taken, and epochs/partial that make up taken."""
    rows = materialize(_keyed(docs, id_col, text_col, source_col, seed))
    cut = _cut(rows, *_plan(rows, weights, cap, bucket_rows))
    return cut.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("partial")).alias("taken"), "epochs", "partial")


def apply_mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix", bucket_rows: int = 2_000
) -> DataFrame:
    """The mixed rows: a document once per whole epoch, and the one at the cut with its words up to the cut.

    Same columns as ``docs``; ``n_chars``, if there, is that of the text.
    """
    plan = _plan(materialize(_keyed(docs, id_col, text_col, source_col, seed)), weights, cap, bucket_rows)
    rows = _keyed(docs, id_col, text_col, source_col, seed, F.md5(F.col(text_col)).alias("tie"), F.struct(*quoted(docs.columns)).alias("row"))
    cut = _cut(rows, *plan, "tie")
    pieces = F.concat(F.transform(F.sequence(F.lit(0), F.col("epochs")), lambda _: F.col("size")), F.array("partial"))
    out = cut.withColumn("words", F.explode(F.filter(F.slice(pieces, F.lit(2), F.size(pieces)), lambda n: n > 0)))
    own = F.col("row").getField(text_col)
    first = F.array_join(F.slice(F.regexp_extract_all(own, F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    text = F.when(F.col("words") == F.col("size"), own).otherwise(first)
    new = {text_col: text, "n_chars": F.length(text).cast("long")}
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
