"""Hard negatives for anchors by a full score sort, shard by shard.

Anchors, a stated share of the rows, are scored against all rows: integer inner products of
the floored components. Rows are dealt to shards and anchors to blocks; a task takes one
block and one shard, and holds the block and a tile of rows at a time. For each anchor it
computes the tile's scores and sorts them by falling score, ties by rising id (the tile
stands in the order of its ids and the sort is stable). There are two passes, since what is
a negative depends on the anchor's positives:

1. the best rows of the anchor's own label, one more than positives are wanted, as the
   anchor itself may be among them; merged over the shards, without the anchor;
2. in the sorted scores without those of the anchor's label, the upper limit of each positive
   is found by binary search, and the entries from there down to the lower limit are read, as
   many as negatives are wanted; merged over the shards.

The best k of all rows are among the best k of each shard, so nothing is lost. A shard gives
at most k rows for an anchor (and positive), no group or label is gathered anywhere, and how
rows are dealt depends on their place in the input, so equal rows spread. The work is the
anchors times the rows, as a full score sort is; rows travel once for each ``block_anchors``
anchors.

Scores are exact: products are summed as doubles where their size allows it, else as
integers of any size, and what is beyond 64 bits counts as the nearest 64-bit value.

Cases: rows without label, or without a whole vector, take no part. A null id is no anchor
and comes after all others among ties. Vectors of different lengths are multiplied as far as
both go. Rows with an anchor's id are anchors each, and positives of each other where their
labels agree. An anchor without positives, or whose positives score below zero, gives no
rows; an empty table neither. Only the id, label and vector columns are read, so others may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryspark.llm.vectors import doubles, matrix, whole_vector
from quarryspark.runtime import materialize, quoted

#: rows that a task scores at a time, and anchors it scores them for at a time
TILE_ROWS, TILE_ANCHORS = 8192, 256
#: candidates that a task gathers before it keeps the best of each anchor only
PRUNE_AT = 1_000_000
EXACT = 2.0**53
LEAST, MOST = -(2**63), 2**63 - 1
FOUND = pa.schema([("anchor_no", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])


def floored(v: np.ndarray, factor: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(v * factor), -np.finfo(float).max, np.finfo(float).max)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact, within 64 bits."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(d, 1) < EXACT:
        return (a @ b.T).astype(np.int64)
    wide = np.vectorize(int, otypes=[object])
    return np.array([[min(max(x, LEAST), MOST) for x in row] for row in wide(a).dot(wide(b).T)], dtype=np.int64).reshape(len(a), len(b))


def best(found: np.ndarray, k: int) -> np.ndarray:
    """Of records (anchor, slot, score, null, id) the first ``k`` an anchor and slot, by falling score, then id, null last."""
    order = np.lexsort((found["id"], found["null"], ~found["score"], found["slot"], found["anchor"]))
    f = found[order]
    new = np.concatenate([[True], (f["anchor"][1:] != f["anchor"][:-1]) | (f["slot"][1:] != f["slot"][:-1])])[: len(f)]
    starts = np.flatnonzero(new)
    return f[np.arange(len(f)) - starts[np.cumsum(new) - 1] < k] if len(f) else f


RECORD = np.dtype([("anchor", np.int64), ("slot", np.int32), ("score", np.int64), ("null", np.bool_), ("id", np.int64)])


def _limits(positive: int, low: int, high: int) -> tuple[int, int]:
    """The least and the greatest score n with low * p <= 100 n <= high * p."""
    return -((-low * positive) // 100), (high * positive) // 100


class _Block:
    """A block's anchors against the tiles of one shard."""

    def __init__(self, numbers: np.ndarray, labels: np.ndarray, vectors: np.ndarray, positives: list[list[int]] | None, k: int, low: int, high: int):
        self.numbers, self.labels, self.vectors, self.positives, self.k, self.low, self.high = numbers, labels, vectors, positives, k, low, high
        self.found = [np.empty(0, RECORD)]

    def score(self, ids: np.ndarray, null: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        order = np.lexsort((ids, null))
        ids, null, labels, vectors = ids[order], null[order], labels[order], vectors[order]
        for at in range(0, len(self.numbers), TILE_ANCHORS):
            s = products(self.vectors[at : at + TILE_ANCHORS], vectors)
            by_score = np.argsort(~s, axis=1, kind="stable")  # ~s falls as s rises, without overflow
            for j in range(len(s)):
                own = labels[by_score[j]] == self.labels[at + j]
                if self.positives is None:
                    self._keep(at + j, 0, by_score[j][own][: self.k], s[j], ids, null)
                    continue
                others = by_score[j][~own]
                falling = ~s[j][others]
                for slot, p in enumerate(self.positives[at + j]):
                    least, greatest = (min(max(x, LEAST), MOST) for x in _limits(p, self.low, self.high))
                    if least <= greatest:
                        first, end = np.searchsorted(falling, ~np.int64(greatest), "left"), np.searchsorted(falling, ~np.int64(least), "right")
                        self._keep(at + j, slot, others[first : min(end, first + self.k)], s[j], ids, null)
        if sum(map(len, self.found)) > PRUNE_AT:
            self.found = [best(np.concatenate(self.found), self.k)]

    def _keep(self, anchor: int, slot: int, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        if len(rows):
            out = np.empty(len(rows), RECORD)
            out["anchor"], out["slot"], out["score"], out["null"], out["id"] = anchor, slot, scores[rows], null[rows], ids[rows]
            self.found.append(out)

    def rows(self) -> Iterator[pa.RecordBatch]:
        f = best(np.concatenate(self.found), self.k)
        for at in range(0, len(f), 100_000):
            g = f[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(self.numbers[g["anchor"]]), pa.array(g["slot"]), pa.array(g["score"]), pa.array(g["id"], mask=g["null"])], schema=FOUND)


def _scored(anchors: DataFrame, rows: DataFrame, blocks: int, shards: int, k: int, low: int = 0, high: int = 0) -> DataFrame:
    """(anchor_no, slot, score, id): the best of each shard; of the anchor's own label, or between the limits of its positives."""
    second = "positives" in anchors.columns
    wanted = F.transform("positives", lambda p: p["score"]) if second else F.lit(None).cast("array<bigint>")
    a = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block", F.lit(0).alias("kind"), F.col("anchor_no").alias("id"), "label", "vec", wanted.alias("positives"))
    r = rows.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "label", "vec", F.lit(None).cast("array<bigint>").alias("positives"))
    both = a.unionByName(r).withColumn("task", F.col("block") * shards + F.col("shard"))
    dealt = both.repartitionById(blocks * shards, "task").sortWithinPartitions("task", "kind").select("task", "kind", "id", "label", "vec", "positives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block, waiting, tile, held = None, None, [], [], 0

        def scored() -> None:
            nonlocal block, tile, held
            if block is None and waiting:
                w = pa.Table.from_batches(waiting).combine_chunks()
                wishes = w.column("positives").to_pylist() if second else None
                block = _Block(w.column("id").to_numpy(), w.column("label").to_numpy(), floored(matrix(w.column("vec").chunk(0)), 256), wishes, k, low, high)
            if block is not None and tile:
                t = pa.Table.from_batches(tile).combine_chunks()
                ids = t.column("id")
                block.score(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), t.column("label").to_numpy(), floored(matrix(t.column("vec").chunk(0)), 256))
            tile, held = [], 0

        for b in batches:
            key, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]), [True]]))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if key[lo] != task:
                    scored()
                    if block is not None:
                        yield from block.rows()
                    task, block, waiting = key[lo], None, []
                if kind[lo] == 0:
                    waiting.append(b.slice(lo, hi - lo))
                else:
                    tile.append(b.slice(lo, hi - lo))
                    held += hi - lo
                    if held >= TILE_ROWS:
                        scored()
        scored()
        if block is not None:
            yield from block.rows()

    return dealt.mapInArrow(run, "anchor_no long, slot int, score long, id long")


def mine_hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    *,
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    block_anchors: int = 65_536,
    shard_rows: int = 1_000_000,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Of each row that meets ``is_anchor`` the first ``positives`` other rows of its label; for
    each of them the first ``negatives`` rows of other labels with a score of ``low`` to
    ``high`` percent of the positive's. ``label``, if given, stands for the label column of
    rows that have one. Ids are whole numbers.
    """
    i, own = (F.col(c) for c in quoted([id_col, label_col]))
    good = vectors.filter(own.isNotNull() & whole_vector(vec_col))
    rows = good.select(i.cast("long").alias("id"), (own if label is None else label).cast("long").alias("label"), doubles(vectors, vec_col).alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("asked"), F.monotonically_increasing_id().alias("place")).filter("label IS NOT NULL")
    anchors = materialize(rows.filter("asked AND id IS NOT NULL").select("id", "label", "vec").withColumn("anchor_no", F.monotonically_increasing_id()))
    n, total = anchors.count(), rows.count()
    blocks = max(1, -(-n // block_anchors))
    # enough shards for all cores, however small the table
    shards = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_rows))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("anchor_no"), F.lit(blocks)).cast("int"))
    rows = rows.select("id", "label", "vec", F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int").alias("shard"))
    order = (F.col("score").desc(), F.col("id").asc_nulls_last())

    same = _scored(anchors, rows, blocks, shards, positives + 1)
    ranked = same.withColumn("nth", F.row_number().over(Window.partitionBy("anchor_no").orderBy(*order))).filter(F.col("nth") <= positives + 1)
    # at most positives + 1 rows an anchor
    listed = ranked.groupBy("anchor_no").agg(F.array_sort(F.collect_list(F.struct("nth", "score", "id"))).alias("near"))
    square = F.col("own")
    itself = lambda p: (p["score"] == square) & (p["id"] == F.col("anchor_id"))
    without = lambda near: F.filter(near, lambda p, at: at != F.coalesce(F.array_position(F.transform(near, lambda q: F.coalesce(itself(q), F.lit(False))), True) - 1, F.lit(-1)))
    me = anchors.select(F.col("anchor_no").alias("_no"), F.col("id").alias("anchor_id"), "block", "label", "vec", _square("vec").alias("own"))
    chosen = listed.join(me, F.col("anchor_no") == F.col("_no")).select("anchor_no", "anchor_id", "block", "label", "vec", F.slice(without(F.col("near")), 1, positives).alias("positives"))
    chosen = materialize(chosen.filter(F.size("positives") > 0))

    found = _scored(chosen, rows, blocks, shards, negatives, low, high)
    nth = F.row_number().over(Window.partitionBy("anchor_no", "slot").orderBy(*order))
    kept = found.withColumn("rank", nth).filter(F.col("rank") <= negatives)
    asked = chosen.select(F.col("anchor_no").alias("_no"), "anchor_id", F.posexplode("positives").alias("_slot", "p"))
    out = kept.join(asked, (F.col("anchor_no") == F.col("_no")) & (F.col("slot") == F.col("_slot")))
    return out.select("anchor_id", F.col("p.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


def _square(vec: str) -> Column:
    """The anchor's score with itself, as ``products`` gives it."""

    @F.pandas_udf("long")
    def run(vs):
        return vs.map(lambda v: int(products(f := floored(np.asarray(v, dtype=np.float64)[None, :], 256), f)[0, 0]))

    return run(F.col(vec))
