"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds the ids of consecutive documents as little-endian unsigned 32-bit integers.
Each frame holds whole documents (about ``frame_ids`` ids; a longer document is a frame of
its own) and ends with zstandard's content checksum. After the frames comes the seek table
in a skippable frame, so any zstandard reader still reads the ids::

    u32 0x184D2A5E   u32 size of what follows
    per frame:  u32 compressed size, u32 decompressed size, u32 check (low half of XXH64 of the ids)
    u32 number of frames   u8 descriptor 0x80 (entries have checks)   u32 0x8F92EAB1

Before it lies an index in a skippable frame of another kind (0x184D2A50) with the documents:
ids and lengths, as 64-bit integers; the length of a document without id is stored as -1 - length. A reader takes the last bytes, then the tables, then only the frames that
hold the documents it is asked for, and checks each against its entry.

Writing: documents are range-partitioned by id, each range is encoded in id order and put
into the shared folder as numbered shards; a shard's row says how many ids it holds. The
starts of shards are a running sum over one row a shard. Reading maps over the shards.

Cases: ids are whole numbers; null texts are empty and get the end id alone; rows with equal ids stay, ordered by
text; null ids come first; an empty table gives no file and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryspark import sharedfs
from quarryspark.llm.tokens import encoder, text_groups
from quarryspark.runtime import materialize, shared_folder

#: fixed values of the seekable zstandard format
SKIPPABLE, SEEKABLE, WITH_CHECKS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: our own index, another of the skippable kinds
INDEX = 0x184D2A50


def frame_check(raw: bytes) -> int:
    """The format's check of a frame's content."""
    import xxhash

    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class ShardWriter:
    """Collects documents and turns them into one shard's bytes."""

    def __init__(self, frame_ids: int = 65_536, level: int = 1):
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress
        self.frame_ids, self.frames, self.entries = frame_ids, [], []
        self.open: list[np.ndarray] = []
        self.held = self.total = self.bytes = 0
        self.docs: list[tuple[int, int]] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append((0, -1 - len(ids)) if doc is None else (doc, len(ids)))
        self.open.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.frame_ids:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            raw = np.concatenate(self.open).astype("<u4", copy=False).tobytes()
            frame = self.compress(raw)
            self.frames.append(frame)
            self.entries.append((len(frame), len(raw), frame_check(raw)))
            self.bytes += len(frame)
            self.open, self.held = [], 0

    def parts(self) -> list[bytes]:
        self.close_frame()
        index = self.compress(np.array(self.docs, dtype="<i8").reshape(-1, 2).tobytes())
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), WITH_CHECKS, SEEKABLE)
        wrap = lambda magic, body: struct.pack("<II", magic, len(body)) + body
        return [*self.frames, wrap(INDEX, index), wrap(SKIPPABLE, table)]


class ShardReader:
    """Reads a shard through a seekable file; decompresses only what is asked for."""

    def __init__(self, file):
        import zstandard

        self.file, self.expand = file, zstandard.ZstdDecompressor().decompress
        size = file.size()
        frames, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or descriptor != WITH_CHECKS:
            raise ValueError("no seek table at the end of the file")
        table_at = size - 9 - 12 * frames
        self.entries = np.frombuffer(self._at(table_at, 12 * frames), dtype="<u4").reshape(-1, 3).astype("int64")
        self.starts = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        self.id_starts = np.concatenate([[0], np.cumsum(self.entries[:, 1] // 4)])
        index_at = int(self.starts[-1])
        kind, length = struct.unpack("<II", self._at(index_at, 8))
        if kind != INDEX:
            raise ValueError("no index before the seek table")
        self.docs = np.frombuffer(self.expand(self._at(index_at + 8, length)), dtype="<i8").reshape(-1, 2).copy()
        self.no_id = self.docs[:, 1] < 0
        self.docs[self.no_id, 1] = -1 - self.docs[self.no_id, 1]
        self.doc_starts = np.concatenate([[0], np.cumsum(self.docs[:, 1])])

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def frame(self, k: int) -> np.ndarray:
        raw = self.expand(self._at(int(self.starts[k]), int(self.entries[k, 0])), max_output_size=int(self.entries[k, 1]))
        if frame_check(raw) != self.entries[k, 2] or len(raw) != self.entries[k, 1]:
            raise ValueError(f"frame {k} fails its check")
        return np.frombuffer(raw, dtype="<u4")

    def document(self, n: int) -> np.ndarray:
        """The ids of the n-th document of this shard."""
        start = int(self.doc_starts[n])
        k = int(np.searchsorted(self.id_starts, start, side="right")) - 1
        begin = start - int(self.id_starts[k])
        return self.frame(k)[begin : begin + int(self.docs[n, 1])]

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc, start in the shard, ids) of all documents, a frame at a time."""
        k, ids = -1, np.empty(0, "<u4")
        for (doc, length), no_id, start in zip(self.docs.tolist(), self.no_id.tolist(), self.doc_starts[:-1].tolist(), strict=True):
            while length and start >= self.id_starts[k + 1]:
                k += 1
                ids = self.frame(k)
            begin = start - int(self.id_starts[k])
            yield (None if no_id else doc), start, ids[begin : begin + length]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, *, blanks: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 16_000_000, frame_ids: int = 65_536, partitions: int | None = None) -> DataFrame:
    """Encode ``docs`` into shards under ``folder``; one row a shard: shard, path, docs, ids.

    ``shard`` counts up in id order: the range partition in the upper bits, the number
    within it in the lower 20.
    """
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, n, out, writer = encoder(tokenizer, blanks), TaskContext.get().partitionId() << 20, [], ShardWriter(frame_ids)

        def close():
            nonlocal n, writer
            if writer.docs:
                path = f"{folder}/shard-{n:012d}.tok.zst"
                sharedfs.put(path, *writer.parts())
                out.append((n, path, len(writer.docs), writer.total))
                n, writer = n + 1, ShardWriter(frame_ids)

        end = np.array([end_id], dtype="<u4")
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in text_groups(texts):
                for doc, e in zip(ids[lo:hi], enc.encode([t or "" for t in texts[lo:hi]]), strict=True):
                    writer.add(doc, np.concatenate([e, end]))
                    if writer.total >= shard_ids:
                        close()
        close()
        yield pa.RecordBatch.from_pydict({c: [r[k] for r in out] for k, c in enumerate(("shard", "path", "docs", "ids"))}, schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    return ordered.mapInArrow(run, "shard long, path string, docs long, ids long")


def read_token_files(manifest: DataFrame, features) -> DataFrame:
    """Map over the shards of a manifest (path, start): ``features(doc, start, ids)`` gives a row's values.

    ``features`` is (schema string, arrow schema, function).
    """
    schema, arrow, function = features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                with sharedfs.open_random(path) as f:
                    rows = [function(doc, start + at, ids) for doc, at, ids in ShardReader(f)]
                for lo in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[lo : lo + 10_000], strict=True), arrow, strict=True)], schema=arrow)

    return manifest.mapInArrow(run, schema)


#: what op6 reports of each document
DIGEST = (
    "doc_id long, start long, n_tokens long, ids_crc32 long",
    pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]),
    lambda doc, start, ids: (doc, start, len(ids), zlib.crc32(ids.tobytes())),
)


def token_file_digests(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the files, then read them all back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    written = materialize(write_token_files(docs, shared_folder(spark, "tokens"), tokenizer, **options))
    # one row a shard, a shard being millions of ids: the running sum is over this short list
    start, rows = 0, []
    for r in sorted(written.collect(), key=lambda r: r.shard):
        rows.append((r.shard, r.path, start))
        start += r.ids
    tasks = max(1, len(rows))
    manifest = spark.createDataFrame(spark.sparkContext.parallelize(rows, tasks), "shard long, path string, start long")
    return read_token_files(manifest, DIGEST)
