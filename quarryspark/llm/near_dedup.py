"""Near-duplicates by fast similarity sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen, Thorup: Fast Similarity Sketching, FOCS 2017): in round i < t
each shingle is thrown into one of t bins with a value; bins still empty keep their least
value of the round; in round t + j everything goes to bin j. So every coordinate fills, in
one or two rounds for most documents, and matches concentrate as for t independent
MinHashes.

1. Equal shingle sets form a class, stood for by its least id; only representatives go on.
2. ``bands`` of ``rows`` coordinates each: two sets of similarity J share a band unless all
   differ, a chance of (1 - J**rows)**bands, 6e-10 at 0.85 and 6e-7 at 0.8.
3. Shingles that a single candidate has can't be common to two. A document whose other
   shingles are too few to reach the similarity with anything is done with (an exact bound).
4. Pairs of a bucket are not listed. In each of ``turns`` rounds a bucket names one pivot,
   one with few shingles of its own, and every document is compared with one pivot of its
   buckets, on full sets; what links becomes one component, and a bucket within one
   component is done with.
5. What is left are pairs of different components that share a bucket. The documents of
   such buckets, and no others, get a longer sketch of one bit a coordinate. Pairs are
   joined under three conditions: the bound of step 3, for the two sets; their bits differ
   in no more places than a linked pair's do up to 5.5 standard deviations; and the bucket
   is the first that they share. These pairs are compared on full sets too.
6. Components of the links; a document's component is the least id it reaches.

A shingle stands as one 64-bit hash of its words (see ``words``), so two different shingles
of a compared pair are taken for one with a chance of 2**-64; no candidate is dropped but by
the chances named in 2 and 5.

Cases: texts without words, null ones included, have no shingles and stay on their own;
with fewer words than a shingle the whole sequence is the one shingle; rows that share an
id share a component; a null id is never linked and stays; an empty table gives no rows.
Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryspark.llm.words import grouped, mix, window_hashes, word_hashes
from quarryspark.operators.components import connected_components
from quarryspark.runtime import give_back, materialize, quoted

#: coordinates of the longer sketch of what pivots leave, one bit of each, in 64-bit words
FINE = 4096
BIT_WORDS = FINE // 64


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``size`` words, A-Z lower-cased."""
    out: list[np.ndarray] = []
    for lo, hi in grouped(texts):
        words, at = word_hashes(texts[lo:hi], lower=True)
        every = window_hashes(words, size)
        for k in range(hi - lo):
            n = int(at[k + 1] - at[k])
            if n >= size:
                h = np.sort(every[at[k] : at[k + 1] - size + 1])
                out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
            elif n:
                out.append(window_hashes(words[at[k] : at[k + 1]], n) ^ np.uint64(n))
            else:
                out.append(np.empty(0, "uint64"))
    return out


def fast_similarity_sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A row of t 32-bit coordinates a set; empty sets get zeros."""
    n = len(sets)
    out, filled = np.zeros((n, t), "uint32"), np.zeros((n, t), bool)
    active = np.array([k for k in range(n) if len(sets[k])], "int64")
    values, owner = None, None
    for i in range(2 * t):
        if not len(active):
            break
        if values is None or len(active) < members * 0.8:
            members = len(active)
            values = np.concatenate([sets[k] for k in active])
            owner = np.repeat(active, [len(sets[k]) for k in active])
        h = mix(values ^ np.uint64((i + 1) * 0x9FB21C651E98DF25 & (2**64 - 1)))
        bins = (h % np.uint64(t)).astype("int64") if i < t else np.full(len(h), i - t)
        spot = owner * t + bins
        open_ = ~filled.ravel()[spot]
        spot, h = spot[open_], h[open_] >> np.uint64(16)
        least = np.full(n * t, 2**64 - 1, "uint64") if n * t < 4 * len(spot) else None
        if least is None:
            order = np.lexsort((h, spot))
            s = spot[order]
            first = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.empty(0, bool)
            got, value = s[first], h[order][first]
        else:
            np.minimum.at(least, spot, h)
            got = np.flatnonzero(least != 2**64 - 1)
            value = least[got]
        out.ravel()[got] = (mix(value ^ np.uint64(i << 50)) >> np.uint64(32)).astype("uint32")
        filled.ravel()[got] = True
        active = active[~filled[active].all(1)]
    return out


def sketched(docs: DataFrame, *, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, digest, keys): set size, 128-bit digest of the set, a key a band."""
    t = bands * rows
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                sets = shingle_sets([(x or "").encode() for x in b.column(1).to_pylist()], shingle)
                sketch = fast_similarity_sketch(sets, t)
                keys = np.zeros((len(sets), bands), "uint64")
                for r in range(rows):
                    keys = mix(keys ^ sketch[:, r::rows].astype("uint64"))
                keys = mix(keys ^ np.arange(bands, dtype="uint64"))
                has = [bool(len(s)) for s in sets]
                keys = [list(map(int, r)) if ok else [] for r, ok in zip(keys.view("int64"), has, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array(keys, schema[3].type)], schema=schema)
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>")


def with_sets(docs: DataFrame, *, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(rep, set): every document's full shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                sets = shingle_sets([(x or "").encode() for x in b.column(1).to_pylist()], shingle)
                flat = np.concatenate(sets).view("int64") if sets else np.empty(0, "int64")
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype("int32")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["rep", "set"])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).mapInArrow(run, "rep long, set array<long>")


def with_bits(sets: DataFrame) -> DataFrame:
    """(rep, bits): a bit of each coordinate of a longer sketch of the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                flat, cuts = b.column(1).flatten().to_numpy().view("uint64"), b.column(1).value_lengths().to_numpy().cumsum()[:-1]
                sketch = fast_similarity_sketch(np.split(flat, cuts), FINE)
                bits = np.packbits((sketch & 1).astype("uint8"), axis=1).view("<i8")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits.tolist(), pa.list_(pa.int64()))], names=["rep", "bits"])
        give_back()

    return sets.select("rep", "set").mapInArrow(run, "rep long, bits array<long>")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (src, dst) whose full sets are similar enough."""
    a, b = sets.select(F.col("rep").alias("_a"), F.col("set").alias("_sa")), sets.select(F.col("rep").alias("_b"), F.col("set").alias("_sb"))
    both = pairs.join(a, F.col("src") == F.col("_a")).join(b, F.col("dst") == F.col("_b"))
    common = F.size(F.array_intersect("_sa", "_sb"))
    return both.filter(100 * common >= percent * (F.size("_sa") + F.size("_sb") - common)).select("src", "dst")


def _reach(sets: DataFrame, percent: int) -> DataFrame:
    """(rep, size, able): set size and how many of its shingles another candidate has; only those that can link at all."""
    own = sets.select("rep", F.explode("set").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("_o")).filter("n = 1").groupBy("_o").agg(F.count(F.lit(1)).alias("_own"))
    sized = sets.select("rep", F.size("set").alias("size")).dropDuplicates(["rep"]).join(own, F.col("rep") == F.col("_o"), "left")
    return sized.select("rep", "size", (F.col("size") - F.coalesce("_own", F.lit(0))).alias("able")).filter(100 * F.col("able") >= percent * F.col("size"))


def _labelled(member: DataFrame, links: DataFrame | None) -> DataFrame:
    """``member`` (key, rep, own) with the component of rep."""
    if links is None:
        return member.withColumn("comp", F.col("rep"))
    label = connected_components(links).select(F.col("id").alias("_id"), "component")
    return member.join(label, F.col("rep") == F.col("_id"), "left").select("key", "rep", "own", F.coalesce("component", "rep").alias("comp"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = 36, rows: int = 5, turns: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``."""
    every = materialize(sketched(docs, id_col=id_col, text_col=text_col, shingle=shingle, bands=bands, rows=rows))
    some = every.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = some.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = some.groupBy("digest").agg(F.min_by("keys", "doc_id").alias("keys"), F.min("doc_id").alias("rep")).select("rep", "keys")
    reps = materialize(reps)
    banded = reps.select("rep", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").count().filter("count > 1").select(F.col("key").alias("_key"))
    member = materialize(banded.join(shared, F.col("key") == F.col("_key"), "left_semi"))
    wanted = member.select(F.col("rep").alias("_rep")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(wanted, F.col("_id") == F.col("_rep"), "left_semi")
    sets = materialize(with_sets(texts, id_col="_id", text_col="_text", shingle=shingle))
    reach = materialize(_reach(sets, percent))
    central = reach.select(F.col("rep").alias("_r"), (1 - F.col("able") / F.col("size")).alias("own"))
    member = materialize(member.join(central, F.col("rep") == F.col("_r")).drop("_r"))

    links: DataFrame | None = None
    for turn in range(turns):
        labelled = materialize(_labelled(member, links))
        first = lambda rep, own: F.struct(F.round(own, 1 if turn else 3), F.xxhash64(F.lit(turn), rep))  # noqa: B023, E731
        pivots = labelled.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.min_by(F.struct("rep", "comp", "own"), first("rep", F.col("own"))).alias("_p")).filter("_lo < _hi").select(F.col("key").alias("_k"), F.col("_p.rep").alias("dst"), F.col("_p.comp").alias("_pc"), F.col("_p.own").alias("_po"))
        chosen = labelled.join(pivots, F.col("key") == F.col("_k")).filter(F.col("comp") != F.col("_pc")).groupBy("rep").agg(F.min_by("dst", first("dst", F.col("_po"))).alias("dst"))
        found = materialize(_linked(chosen.select(F.col("rep").alias("src"), "dst"), sets, percent))
        links = found if links is None else materialize(links.union(found))

    labelled = materialize(_labelled(member, links))
    undone = labelled.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo < _hi").select(F.col("key").alias("_k"))
    open_ = materialize(labelled.join(undone, F.col("key") == F.col("_k"), "left_semi"))
    finer = with_bits(sets.dropDuplicates(["rep"]).join(open_.select(F.col("rep").alias("_r")).distinct(), F.col("rep") == F.col("_r"), "left_semi"))
    of_open = finer.select("rep", *[F.col("bits")[k].alias(f"b{k}") for k in range(BIT_WORDS)]).join(reach.select(F.col("rep").alias("_r"), "size", "able"), F.col("rep") == F.col("_r")).drop("_r").join(reps.select(F.col("rep").alias("_r"), "keys"), F.col("rep") == F.col("_r")).drop("rep")
    left = materialize(open_.select("key", "rep", "comp").join(of_open, F.col("rep") == F.col("_r")).drop("_r"))
    j, t = percent / 100, FINE
    differ = t * (1 - j) / 2 + 5.5 * (t * (1 - j) / 2 * (1 + j) / 2) ** 0.5
    x, y = left.alias("x"), left.alias("y")
    distance: Column = sum((F.bit_count(F.col(f"x.b{k}").bitwiseXOR(F.col(f"y.b{k}"))) for k in range(1, BIT_WORDS)), F.bit_count(F.col("x.b0").bitwiseXOR(F.col("y.b0"))))
    most = F.least("x.able", "y.able")  # of common shingles
    able = 100 * most >= percent * (F.col("x.size") + F.col("y.size") - most)
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.comp") != F.col("y.comp")) & able & (distance <= differ) & (F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")))
    last = materialize(_linked(pairs.select(F.col("x.rep").alias("src"), F.col("y.rep").alias("dst")), sets, percent))
    component = connected_components(links.union(last)).select(F.col("id").alias("_id"), "component")
    of_class = classes.join(component, F.col("rep") == F.col("_id"), "left").select(F.col("digest").alias("_digest"), F.coalesce("component", "rep").alias("_component"))
    out = every.select("doc_id", "n_shingles", "digest").join(of_class, (F.col("digest") == F.col("_digest")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    component_id = F.coalesce("_component", "doc_id")
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group the ones with the least id."""
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).filter(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.struct(*quoted(docs.columns)).alias("row"))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")
