"""Removing passages that repeat: a count-min prefilter, then exact grouping of what it lets through.

A window is ``window`` consecutive words; every word is removed that lies in a window whose
word sequence starts anywhere else too. Whole corpora have about as many windows as words,
so windows themselves are never shuffled one by one:

1. *Units.* Each task puts its documents into the shared folder as compressed Arrow files of
   about ``unit_bytes`` of text (a thousandth of all text, between 4 and 256 MB), made of
   record batches of about ``batch_bytes``, which is what later passes hold at a time.
2. *Sketch.* A unit hashes its windows into ``depth`` rows of a count-min sketch whose width
   is a multiple of the number of all windows, so its error is the same at every size. A
   unit's sketch is sparse: its occupied cells, sorted, with a bit for those hit twice,
   delta-coded and compressed (about 1.4 bytes each), cut by cell range into shards.
3. *Merge.* A shard adds the units' sketches up in a table of counters that saturate at two,
   the only threshold there is, and tells each unit which of its cells reach two. The sketch
   overestimates only, so a window with a lower estimate occurs once.
4. *Exact pass.* Windows estimated to repeat (all of those that do, and a percent or two
   that don't) are grouped by two independent 64-bit lanes, each unit sending its distinct
   ones, cut by range; a unit is told which of its windows repeat.
5. *Removal.* Each unit marks the words covered by repeated windows and writes its rows.

Shuffled rows are one for each unit and shard that meet, as in any shuffle of ranges; units
and shards grow with the corpus, so at 100 TB a row still carries many windows. A window
that a third of all documents share is one entry a unit in steps 2 and 4.

Cases: null and empty texts have no words; texts shorter than a window lose nothing;
repeated rows are each other's copies; an empty table gives no rows. All input columns are
carried, except those that clash, case aside, with the results n_words, n_removed,
kept_sha256 and kept_text (words left, one space between them).
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryspark import sharedfs
from quarryspark.llm.words import distinct_sorted, grouped, mix, window_hashes, word_hashes, word_lanes
from quarryspark.runtime import extended, give_back, materialize, other_columns, quoted, shared_folder

RESULTS = ["n_words", "n_removed", "kept_sha256", "kept_text"]
#: ranges of cells that a unit merges one after another, to hold one at a time unpacked
RANGES = 16
#: most partitions of a shuffle
MOST_PARTS = 20_000


def text_windows(texts: list[bytes], size: int, both: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """(first lane, second lane or None, places, offsets) of the windows that lie within a text.

    A window's place is that of its first word among all words; ``offsets`` says where each
    text's words begin, and the end.
    """
    first, second, places, offsets, total = [], [], [], [np.zeros(1, "int64")], 0
    for lo, hi in grouped(texts):
        if both:
            a, b, at = word_lanes(texts[lo:hi])
        else:
            (a, at), b = word_hashes(texts[lo:hi]), None
        spot = np.flatnonzero(np.repeat(at[1:], np.diff(at)) - np.arange(len(a)) >= size)
        first.append(window_hashes(a, size)[spot])
        if both:
            second.append(window_hashes(b, size)[spot])
        places.append(spot + total)
        offsets.append(at[1:] + total)
        total += len(a)
    flat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    return flat(first, "uint64"), flat(second, "uint64") if both else None, flat(places, "int64"), np.concatenate(offsets)


# --- units


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def count_words(text: bytes) -> int:
    """How many runs of other bytes than blanks, tabs and line ends there are."""
    a = np.frombuffer(text, "uint8")
    word = (a != 32) & ((a < 9) | (a > 13))
    return int(np.count_nonzero(word[1:] & ~word[:-1])) + int(len(a) > 0 and word[0])


def write_units(docs: DataFrame, folder: str, text_col: str, window: int, unit_bytes: int, batch_bytes: int) -> DataFrame:
    """(unit, windows): one row for each file written, with its number of windows of words, whatever parts these."""
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, out = TaskContext.get().partitionId() << 20, []
        held, size, written, windows, sink, file = [], 0, 0, 0, None, None

        def flush():
            """Put what is held into the file as one record batch."""
            nonlocal held, size, written, windows, sink, file
            if held:
                part = pa.Table.from_batches(held).combine_chunks()
                if file is None:
                    sink = pa.BufferOutputStream()
                    file = pa.ipc.new_file(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                file.write_table(part)
                windows += sum(max(0, count_words(t) + 1 - window) for t in as_bytes(part.column(at_text)))
                held, written, size = [], written + size, 0

        def close():
            nonlocal unit, written, windows, sink, file
            flush()
            if file is not None:
                file.close()
                sharedfs.put(f"{folder}/unit-{unit}.arrow", sink.getvalue())
                out.append((unit, windows))
                unit, written, windows, sink, file = unit + 1, 0, 0, None, None

        for b in batches:
            lengths = pa.compute.fill_null(pa.compute.binary_length(b.column(at_text)), 0).to_numpy(zero_copy_only=False)
            begin = 0
            for k, n in enumerate(lengths.tolist()):
                size += n + 8
                if size >= batch_bytes:
                    held.append(b.slice(begin, k + 1 - begin))
                    begin = k + 1
                    flush()
                    if written >= unit_bytes:
                        close()
            if begin < b.num_rows:
                held.append(b.slice(begin))
        close()
        give_back()
        yield pa.RecordBatch.from_pydict({"unit": [u for u, _ in out], "windows": [n for _, n in out]}, schema=pa.schema([("unit", pa.int64()), ("windows", pa.int64())]))

    return docs.mapInArrow(run, "unit long, windows long")


def unit_batches(folder: str, unit: int, at_text: int, all_columns: bool = False) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """A unit's record batches with their texts as bytes."""
    reader = pa.ipc.open_file(pa.BufferReader(sharedfs.get(f"{folder}/unit-{unit}.arrow")), options=pa.ipc.IpcReadOptions(included_fields=None if all_columns else [at_text]))
    for k in range(reader.num_record_batches):
        b = reader.get_batch(k)
        yield b, as_bytes(b.column(at_text if all_columns else 0))


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(key, rows without it) of rows that come sorted by their first column."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, found in itertools.groupby(rows, key=lambda r: r[0]):
        yield key, [r[1:] for r in found]


# --- sets of numbers, coded


def encode_sorted(values: np.ndarray) -> bytes:
    """Distinct sorted uint64 as compressed differences, split into planes of bytes."""
    import zstandard

    if not len(values):
        return b""
    d = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(d.max()).bit_length() + 7) // 8)
    planes = d.astype("<u8").view("uint8").reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def decode_sorted(blob: bytes) -> np.ndarray:
    import zstandard

    if not blob:
        return np.empty(0, "uint64")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), "uint8").reshape(blob[0], -1)
    d = np.zeros((planes.shape[1], 8), "uint8")
    d[:, : blob[0]] = planes.T
    return np.cumsum(d.view("<u8").ravel(), dtype="uint64")


def with_counts(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, whether each occurs more than once) of all parts together."""
    s = np.sort(np.concatenate(parts)) if parts else np.empty(0, "uint64")
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, "int64")
    return s[first], np.diff(first, append=len(s)) > 1


# --- the passes


def _cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    """Cells of a sketch row."""
    return mix(hashes ^ np.uint64((row + 1) * 0x632BE59BD9B4E019 & (2**64 - 1))) % np.uint64(width)


BLOBS = pa.schema([("key", pa.int64()), ("unit", pa.int64()), ("entries", pa.binary()), ("twice", pa.binary())])
BLOBS_SQL = "key long, unit long, entries binary, twice binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), BLOBS, strict=True)] if rows else [pa.array([], t.type) for t in BLOBS], schema=BLOBS)


def _sketch(folder: str, at_text: int, window: int, width: int, depth: int, shards: int):
    """From units to their cells by shard; a shard's key is row * shards + its number."""
    across = -(-width // shards)  # cells a shard
    per_range = -(-shards // RANGES)  # shards a range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in (u for b in batches for u in b.column(0).to_pylist()):
            packed: list[list[list[tuple[bytes, bytes]]]] = [[[] for _ in range(RANGES)] for _ in range(depth)]
            for _, texts in unit_batches(folder, unit, at_text):
                h = text_windows(texts, window, False)[0]
                for row in range(depth):
                    cells, twice = with_counts([_cells(h, row, width)])
                    cuts = np.searchsorted(cells, np.arange(1, RANGES, dtype="uint64") * np.uint64(per_range * across))
                    for kept, c, t in zip(packed[row], np.split(cells, cuts), np.split(twice, cuts), strict=True):
                        kept.append((encode_sorted(c), encode_sorted(c[t])))
            for row in range(depth):
                for r in range(RANGES):
                    # a cell hit twice in a batch comes in both lists
                    cells, twice = with_counts([decode_sorted(x) for pair in packed[row][r] for x in pair])
                    low = r * per_range
                    cuts = np.searchsorted(cells, np.arange(low + 1, low + per_range, dtype="uint64") * np.uint64(across))
                    found = zip(range(low, low + per_range), np.split(cells, cuts), np.split(twice, cuts), strict=True)
                    yield _rows([(row * shards + k, unit, encode_sorted(c - np.uint64(k * across)), np.packbits(t).tobytes()) for k, c, t in found if len(c)])
        give_back()

    return run


def _answer_sketch(width: int, shards: int):
    """Adds up a shard's cells; what goes back to a unit are those of its cells that reach two."""
    across = -(-width // shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in groups(batches):
            count = np.zeros(across, "uint8")
            for _, entries, twice in rows:
                cells = decode_sorted(entries)
                count[cells] = np.minimum(count[cells] + 1 + np.unpackbits(np.frombuffer(twice, "uint8"), count=len(cells)), 2)
            found = ((unit, cells[count[cells] == 2]) for unit, entries, _ in rows for cells in [decode_sorted(entries)])
            yield _rows([(unit, shard, encode_sorted(c), None) for unit, c in found if len(c)])
        give_back()

    return run


def _candidates(folder: str, at_text: int, window: int, width: int, depth: int, shards: int):
    """From the sketch's answers to a unit: its distinct windows estimated to repeat, by shard."""
    across = -(-width // shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, rows in groups(batches):
            full: list[Members] = []
            for row in range(depth):
                mine = sorted((shard - row * shards, entries) for shard, entries, _ in rows if shard // shards == row)
                full.append(Members(np.concatenate([decode_sorted(e) + np.uint64(k * across) for k, e in mine]) if mine else np.empty(0, "uint64")))
            del rows
            first, second = [], []
            for _, texts in unit_batches(folder, unit, at_text):
                a, b, _, _ = text_windows(texts, window, True)
                for row in range(depth):
                    keep, _ = full[row].where(_cells(a, row, width))
                    a, b = a[keep], b[keep]
                first.append(a)
                second.append(b)
            keys, twice = _distinct_keys(np.concatenate(first), np.concatenate(second))
            del full, first, second
            cuts = np.searchsorted(keys["a"], _bounds(shards))
            yield _rows([(k, unit, e.tobytes(), np.packbits(t).tobytes()) for k, (e, t) in enumerate(zip(np.split(keys, cuts), np.split(twice, cuts), strict=True)) if len(e)])
        give_back()

    return run


KEY = np.dtype([("a", "<u8"), ("b", "<u8")])


def _bounds(shards: int) -> np.ndarray:
    """First lanes at which the second and later of ``shards`` even ranges begin."""
    return np.array([(k << 64) // shards for k in range(1, shards)], "uint64")


class Members:
    """Which values are in a sorted array: a table of hashed bits rules most others out before the search."""

    def __init__(self, values: np.ndarray):
        self.values = values
        bits = min(26, max(12, (8 * len(values)).bit_length()))
        self.shift, self.table = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.table[self._spot(values)] = True

    def _spot(self, x: np.ndarray) -> np.ndarray:
        return (x * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def where(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``x`` are members, the first place of each in the sorted array)."""
        some = np.flatnonzero(self.table[self._spot(x)])
        at = np.searchsorted(self.values, x[some])
        at[at == len(self.values)] = 0
        ok = self.values[at] == x[some] if len(self.values) else np.zeros(0, bool)
        return some[ok], at[ok]


class KeyMembers:
    """As Members, for windows by both lanes; ``keys`` are sorted by both."""

    def __init__(self, keys: np.ndarray):
        self.first, self.second = Members(np.ascontiguousarray(keys["a"])), np.ascontiguousarray(keys["b"])

    def where(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which windows are members."""
        left, at = self.first.where(a)
        found = []
        while len(left):  # once, unless different windows agree in the first lane
            same = self.second[at] == b[left]
            found.append(left[same])
            left, at = left[~same], at[~same] + 1
            ok = at < len(self.second)
            left, at = left[ok], at[ok]
            ok = self.first.values[at] == a[left]
            left, at = left[ok], at[ok]
        return np.sort(np.concatenate(found)) if found else np.empty(0, "int64")


def _distinct_keys(a: np.ndarray, b: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct windows sorted by both lanes, whether each counts two or more)."""
    order = np.argsort(a)
    x, y = a[order], b[order]
    if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any():  # different windows agree in the first lane
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    first = np.flatnonzero(new)
    keys = np.empty(len(first), KEY)
    keys["a"], keys["b"] = x[first], y[first]
    if weight is None:
        return keys, np.diff(first, append=len(x)) > 1
    return keys, (np.add.reduceat(weight[order], first) if len(first) else np.empty(0, "int64")) > 1


def _answer_exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What goes back to a unit are those of its windows that repeat anywhere."""
    for shard, rows in groups(batches):
        entries = [np.frombuffer(e, KEY) for _, e, _ in rows]
        weight = np.concatenate([1 + np.unpackbits(np.frombuffer(t, "uint8"), count=len(e)).astype("int64") for e, (_, _, t) in zip(entries, rows, strict=True)])
        every = np.concatenate(entries)
        keys, repeated = _distinct_keys(np.ascontiguousarray(every["a"]), np.ascontiguousarray(every["b"]), weight)
        known = KeyMembers(keys[repeated])
        del every, weight, keys
        found = ((unit, e[known.where(np.ascontiguousarray(e["a"]), np.ascontiguousarray(e["b"]))]) for (unit, _, _), e in zip(rows, entries, strict=True))
        yield _rows([(unit, shard, e.tobytes(), None) for unit, e in found if len(e)])
    give_back()


def _remove(folder: str, at_text: int, window: int, carried: list[str], with_text: bool):
    """From the exact answers to a unit (or none): its rows with the results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, rows in groups(batches):
            # shards are ranges of the first lane, so the parts of a unit in their order are sorted
            known = KeyMembers(np.concatenate([np.frombuffer(e, KEY) for _, e in sorted((shard, e) for shard, e, _ in rows)]))
            for b, texts in unit_batches(folder, unit, at_text, all_columns=True):
                x, y, places, offsets = text_windows(texts, window, True)
                starts = places[known.where(x, y)]  # each once, in order
                gone = np.zeros(offsets[-1] + 1, "int32")
                gone[starts] += 1
                gone[starts + window] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                removed, digest, kept_text = np.zeros(len(texts), "int64"), [], []
                for k, t in enumerate(texts):
                    g = gone[offsets[k] : offsets[k + 1]]
                    removed[k] = g.sum()
                    words = t.split()
                    kept = b" ".join(words if not removed[k] else list(itertools.compress(words, (~g).tolist())))
                    digest.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        kept_text.append(kept.decode())
                columns = [b.column(b.schema.get_field_index(name)) for name in carried] + [pa.array(np.diff(offsets)), pa.array(removed), pa.array(digest, pa.string())] + ([pa.array(kept_text, pa.string())] if with_text else [])
                yield pa.RecordBatch.from_arrays(columns, names=carried + RESULTS[: 3 + with_text])
        give_back()

    return run


def remove_repeated_passages(
    docs: DataFrame, *, text_col: str = "text", window: int = 35, unit_bytes: int | None = None, batch_bytes: int = 4_000_000, depth: int = 2, width_factor: int = 8, shard_windows: int | None = None, with_text: bool = True
) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256 and, if wanted, kept_text."""
    spark = docs.sparkSession
    carried = other_columns(docs, RESULTS)
    docs = docs.select(*quoted(list(dict.fromkeys([*carried, text_col]))))
    at_text, folder = docs.columns.index(text_col), shared_folder(spark, "passages")
    if unit_bytes is None:
        total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        unit_bytes = min(256_000_000, max(4_000_000, total // 1000))
    units = materialize(write_units(docs, folder, text_col, window, unit_bytes, min(batch_bytes, unit_bytes)))
    windows, n_units = units.agg(F.coalesce(F.sum("windows"), F.lit(0)), F.count(F.lit(1))).first()
    width = max(1 << 16, width_factor * windows)
    if shard_windows is None:
        shard_windows = min(32_000_000, max(1_000_000, windows // 2000))
    shards = max(RANGES, -(-windows // shard_windows))
    place = (folder, at_text, window)

    # dealt by number: what travels is small, what each unit or shard costs is not, so tasks must not be merged by size
    deal = lambda d, n: d.repartition(min(MOST_PARTS, n), "key").sortWithinPartitions("key")
    sketch = units.select("unit").repartition(min(MOST_PARTS, max(1, n_units))).mapInArrow(_sketch(*place, width, depth, shards), BLOBS_SQL)
    answers = deal(sketch, depth * shards).mapInArrow(_answer_sketch(width, shards), BLOBS_SQL)
    wanted = deal(answers, 2 * n_units + 1).mapInArrow(_candidates(*place, width, depth, shards), BLOBS_SQL)
    exact = deal(wanted, shards).mapInArrow(_answer_exact, BLOBS_SQL)
    everyone = units.select(F.col("unit").alias("key"), F.lit(0).cast("long").alias("unit"), F.lit(b"").alias("entries"), F.lit(None).cast("binary").alias("twice"))
    schema = extended(docs.select(*quoted(carried)).schema, "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    return deal(exact.unionByName(everyone), 2 * n_units + 1).mapInArrow(_remove(*place, carried, with_text), schema)
