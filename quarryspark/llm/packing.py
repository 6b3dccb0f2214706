"""Best-fit-decreasing packing with certified bin counts and exchange between partitions.

Documents are encoded once into pieces of at most ``capacity`` ids; from then on only
(id, piece, start, length, check) travel. A round deals the open pieces by a salted hash
to partitions of about ``part_rows`` pieces; each partition packs its own by best-fit
decreasing and computes a lower bound of its bin count from dual-feasible functions. A
partition that meets its bound is certified: its sequences are final. In one with a gap,
the pieces of sequences with room left, and of as many full ones of the smallest pieces, go
into the next round, where they are dealt anew among fewer partitions, so partitions with
gaps exchange documents; its other sequences are final.
Rounds end when nothing is open, when one partition has packed all that was left, when the
total meets the bound over all pieces, or after ``rounds`` rounds.

Dual-feasible functions used, on sizes s of capacity C: the identity (total size); for
every threshold t <= C/2, s > C-t counts C, s < t counts 0, others s; and for k = 1..20,
s(k+1)/C kept where whole, else floor(s(k+1)/C)/k of C.

Cases: null and empty texts are one piece holding the end id; rows with equal ids are
packed one by one; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryspark.llm.tokens import KNOWN_UNITS, encoder, text_groups
from quarryspark.runtime import give_back, materialize

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECE + ", sequence_id long, offset long, open boolean, part long, bins long, bound long"


def token_pieces(docs: DataFrame, tokenizer: str, *, blanks: str | None = None, end_id: int = 0, capacity: int = 2048, known_units: int = KNOWN_UNITS, forget: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece of each document's ids, end id included. ``forget``: workers drop the encoder after each task."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, blanks, known_units), np.array([end_id], dtype="<u4")
        for b in batches:
            docs_, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in text_groups(texts):
                rows = []
                for doc, e in zip(docs_[lo:hi], enc.encode([t or "" for t in texts[lo:hi]]), strict=True):
                    ids = np.concatenate([e, end])
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        rows.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if forget:
            encoder.cache_clear()
            del enc
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECE)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item, and the free space of each bin."""
    bin_of, offset = np.zeros(len(sizes), "int64"), np.zeros(len(sizes), "int64")
    free: list[int] = []
    with_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    present = 0  # bit r is set if some bin has r free
    for k in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[k])
        fitting = present >> s
        if fitting:
            r = s + (fitting & -fitting).bit_length() - 1
            b = with_free[r].pop()
            if not with_free[r]:
                present &= ~(1 << r)
        else:
            r, b = capacity, len(free)
            free.append(capacity)
        bin_of[k], offset[k], free[b] = b, capacity - r, r - s
        if r > s:
            with_free[r - s].append(b)
            present |= 1 << (r - s)
    return bin_of, offset, np.array(free, "int64")


def bound_of_counts(counts: np.ndarray, capacity: int) -> int:
    """Lower bound of the bins for counts[s] items of size s, s = 0..capacity."""
    c, s = counts.astype("int64"), np.arange(capacity + 1, dtype="int64")
    best = -(-int((c * s).sum()) // capacity)
    number, volume = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * s)])
    t = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - t + 1]
    middle = volume[capacity - t + 1] - volume[t]
    best = max(best, int((large - (-middle // capacity)).max(initial=0)))
    for k in range(1, 21):
        x = s * (k + 1)
        # in units of 1 / (capacity * k)
        value = np.where(x % capacity == 0, s * k, (x // capacity) * capacity)
        best = max(best, -(-int((c * value).sum()) // (capacity * k)))
    return best


def _round(capacity: int, turn: int, last: bool):
    """What one partition does in a round; in the last one nothing stays open."""
    names = [f.split(" ")[0] for f in PIECE.split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        sizes = frame["length"].to_numpy()
        bin_of, offset, free = best_fit_decreasing(sizes, capacity)
        bound = bound_of_counts(np.bincount(sizes, minlength=capacity + 1), capacity)
        part = int(frame["_part"].iloc[0])
        gap = len(free) > bound and not last
        # with the bins that have room go as many full ones, those of the most and so the smallest pieces: they fill gaps
        room = free > 0
        pieces = np.where(room, 0, np.bincount(bin_of, minlength=len(free)))
        helpers = np.argsort(-pieces, kind="stable")[: max(8, int(room.sum()))]
        room[helpers[pieces[helpers] > 1]] = True
        return frame[names].assign(sequence_id=(turn << 58) + (part << 26) + bin_of, offset=offset, open=room[bin_of] & gap, part=part, bins=len(free), bound=bound)

    return run


def pack_pieces(pieces: DataFrame, *, capacity: int = 2048, part_rows: int = 16_384, rounds: int = 5) -> DataFrame:
    """``pieces`` with sequence_id and offset; also open, part, bins, bound of the partition that placed them."""
    pieces = materialize(pieces)
    lengths = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, "int64")
    for r in lengths:
        counts[r["length"]] = r["count"]
    overall, left, settled, used = bound_of_counts(counts, capacity), int(counts.sum()), [], 0
    names, todo = [f.split(" ")[0] for f in PIECE.split(", ")], pieces
    for turn in range(rounds):
        if not left:
            break
        parts = max(1, round(left / part_rows))
        last = turn == rounds - 1 or parts == 1

        dealt = todo.withColumn("_part", F.pmod(F.xxhash64(F.lit(turn), "doc_id", "piece", "start"), F.lit(parts)))
        packed = materialize(dealt.groupBy("_part").applyInPandas(_round(capacity, turn, last), PACKED))
        total, left = packed.agg(F.countDistinct("sequence_id"), F.count_if("open")).first()
        if left and used + total <= overall:  # as good as it gets: what is open stays where it is
            settled.append(packed)
            break
        settled.append(packed.filter(~F.col("open")))
        used += settled[-1].agg(F.countDistinct("sequence_id")).first()[0]
        todo = packed.filter("open").select(*names)
    out = settled[0] if settled else pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "open": F.lit(False), "part": F.lit(0).cast("long"), "bins": F.lit(0).cast("long"), "bound": F.lit(0).cast("long")})
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.withColumn("overall_bound", F.lit(overall).cast("long"))


def pack_documents(docs: DataFrame, tokenizer: str, *, blanks: str | None = None, end_id: int = 0, capacity: int = 2048, part_rows: int = 16_384, **options) -> DataFrame:
    """Encode, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset and the certificate columns."""
    packed = pack_pieces(token_pieces(docs, tokenizer, blanks=blanks, end_id=end_id, capacity=capacity, **options), capacity=capacity, part_rows=part_rows)
    return packed.select(*[f.split(" ")[0] for f in PIECE.split(", ")], "sequence_id", "offset", "bins", "bound", "overall_bound")
