"""Exact set-similarity self-join with prefix, length and position filters.

For a threshold t > 0, two sets x and y with Jaccard >= t share at least
t / (1 + t) * (|x| + |y|) elements. So with all elements in one global order, the smaller set
has one of those that both hold among its first |x| - ceil(2t / (1 + t) |x|) + 1, and the
larger one has it among its first |y| - ceil(t |y|) + 1 (Bayardo et al. 2007, Xiao et al.
2008). Elements are ordered by rising document frequency, so very common ones are hardly
ever in a prefix, least of all in the smaller set's. A shared element also bounds what can
follow it in both sets (position filter).

Sets of one element meet by length only: lengths are parted in classes whose bounds grow by
1 / t, and a set meets those of its own class and of the one above, as others cannot be
similar. Where very many meet, both sides are dealt in blocks, and each block of the one meets
each of the other, blocks being dealt to tasks by a hash. How many pairs meet is counted first,
and there are as many tasks as that takes, so none compares more because the input is larger.

A pair meets at every element that both prefixes hold and counts at the first of them, which is
in both prefixes if the pair is similar. Sets of up to CARRIED elements travel with their
prefixes, so their pairs are verified where they meet, and no list of pairs is held or shuffled.
Pairs with a longer set are listed, and verified by looking the sets up.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryspark.runtime import materialize

log = logging.getLogger(__name__)
#: sets of one element that a block holds, about, where more pairs meet than two blocks make
SPLIT = 1_500
#: pairs that a task compares, about
PAIRS_A_TASK = 2_000_000
#: elements of a set that travels with its prefix
CARRIED = 64
#: fixed value: items to compare with each other from which on a warning is due
MANY_ITEMS = 50


def warn_high_pairwise_cost(items: int, candidates: int) -> bool:
    """Log that many items are compared, with the pairs of all that meet in the join; True if it did."""
    if items > MANY_ITEMS:
        log.warning("high pairwise cost: items=%d max=%d pairs=%d candidates=%d", items, MANY_ITEMS, items * (items - 1) // 2, candidates)
    return items > MANY_ITEMS


def jaccard(a: Column | str, b: Column | str) -> Column:
    """|a n b| / |a u b| of arrays of distinct values; 0 for two empty ones."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(0.0)).otherwise(F.try_divide(common, union))


def similar_pairs(sets: DataFrame, threshold: float, *, id_col: str = "item_id", set_col: str = "fingerprints", warn: Callable[[int], object] | None = None) -> DataFrame:
    """(src, dst, similarity) of all pairs with Jaccard >= threshold > 0, src < dst.

    ``warn`` is called, before any pair is made, with the number of pairs that will meet.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    base = sets.select(F.col(id_col).alias("id"), F.col(set_col).alias("s")).filter(F.size("s") > 0)
    elements = base.select("id", F.explode("s").alias("e"), F.size("s").alias("n"))
    frequency = elements.groupBy("e").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select(F.col("e").alias("_e"), "df")
    # elements of one set only can't be shared, yet they take their place in the order
    ordered = elements.join(frequency, F.col("e") == F.col("_e"), "left").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "e"))).alias("o"))
    both = 2 * threshold / (1 + threshold)
    length = lambda share: F.col("n") - F.ceil(F.col("n") * F.lit(share) - 1e-9).cast("int") + 1
    placed = F.filter(F.transform(F.slice("o", F.lit(1), length(threshold)), lambda x, at: F.struct(x["df"].alias("df"), x["e"].alias("e"), at.alias("at"))), lambda x: x["df"] > 1)
    carried = F.when(F.col("n") <= CARRIED, F.transform("o", lambda x: x["e"]))
    prefix = ordered.select("id", "n", carried.alias("s"), length(both).alias("short"), F.explode(placed).alias("x")).select("id", "n", "s", "short", "x.*")
    # lengths of one class differ by less than 1 / threshold
    growth = math.log(1 / threshold) if threshold < 1 else None
    level = F.col("n") if growth is None else F.floor(F.log(F.col("n").cast("double")) / growth + 1e-9).cast("int")
    prefix = materialize(prefix.withColumn("level", level))
    above = 0 if growth is None else 1
    small = prefix.filter("at < short").select("id", "n", "s", "e", "at", F.explode(F.sequence("level", F.col("level") + above)).alias("level"))
    large = prefix.select("id", "n", "s", "e", "at", "level")
    counts = lambda d, name: d.groupBy("e", "level").agg(F.count(F.lit(1)).alias(name))
    crowds = materialize(counts(small, "few").join(counts(large, "many"), ["e", "level"]))
    met = crowds.agg(F.coalesce(F.sum(F.col("few") * F.col("many")), F.lit(0))).first()[0]
    if warn is not None:
        warn(met)
    tasks = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(met / PAIRS_A_TASK))
    blocks = crowds.filter(F.col("few") * F.col("many") > SPLIT**2).select("e", "level", F.ceil(F.col("few") / SPLIT).cast("int").alias("rows"), F.ceil(F.col("many") / SPLIT).cast("int").alias("cols"))

    def dealt(d: DataFrame, own: str, other: str) -> DataFrame:
        """``d`` with the block of its side that a row is in, and once for each block of the other side."""
        size = lambda side: F.coalesce(side, F.lit(1))
        d = d.join(blocks, ["e", "level"], "left").withColumn(f"_{own}", F.pmod(F.xxhash64("id"), size(own)).cast("int")).withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), size(other) - 1)))
        return d.drop("rows", "cols").repartition(tasks, "e", "level", "_rows", "_cols")

    def meeting(small: DataFrame, large: DataFrame, possible: Column) -> DataFrame:
        same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("e", "level", "_rows", "_cols")]
        smaller = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.id") < F.col("b.id")))
        needed = F.ceil((F.col("a.n") + F.col("b.n")) * F.lit(threshold / (1 + threshold)) - 1e-9)
        near = smaller & (F.col("a.n") >= F.col("b.n") * threshold - 1e-9) & (possible >= needed)
        pairs = dealt(small, "rows", "cols").alias("a").join(dealt(large, "cols", "rows").alias("b"), same[0] & same[1] & same[2] & same[3] & near)
        return pairs.withColumns({"src": F.least("a.id", "b.id"), "dst": F.greatest("a.id", "b.id")})

    left = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    short = F.col("n") <= CARRIED
    # what both hold, in the order of the elements: it begins with the one that the pair counts at
    seen = meeting(small.filter(short), large.filter(short), left).select("src", "dst", "a.e", (F.col("a.n") + F.col("b.n")).alias("n"), F.array_intersect("a.s", "b.s").alias("common"))
    counted = seen.filter(F.try_element_at("common", F.lit(1)) == F.col("e")).select("src", "dst", F.try_divide(F.size("common"), F.col("n") - F.size("common")).alias("similarity"))
    # sets that meet longer ones are not much shorter themselves
    listed = meeting(small.filter(F.col("n") >= CARRIED * threshold).drop("s"), large.filter(~short).drop("s"), left + F.least("a.at", "b.at")).select("src", "dst").distinct()
    x, y = base.select(F.col("id").alias("src"), F.col("s").alias("_x")), base.select(F.col("id").alias("dst"), F.col("s").alias("_y"))
    looked_up = listed.join(x, "src").join(y, "dst").select("src", "dst", jaccard("_x", "_y").alias("similarity"))
    return counted.unionByName(looked_up).filter(F.col("similarity") >= threshold)
