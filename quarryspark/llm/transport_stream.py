"""Media columns: MPEG transport streams of 188-byte packets, written and read.

Writing puts a payload into one program with one private elementary stream: a program
association table, a program map table, then elementary packets (PES) of up to
``unit_bytes`` payload bytes with presentation times 1/25 s apart, the first transport
packet of each unit marked as a random-access point with a clock reference, continuity
counters per packet identifier, and stuffing in the adaptation field of a unit's last
packet. Reading trusts nothing: it finds the tables by their identifiers, checks their
CRC-32, follows the map to the elementary streams, checks continuity (a repeated counter
is a duplicate and dropped, a jump is counted), reassembles units across packets and
adaptation fields, and stores timestamps and the packet numbers of random-access points.

The payload is the text as UTF-8, padded with zeros to a positive multiple of 64; the
first unit's private data cannot be longer than a PES packet can be, so units are cut at
``unit_bytes``. Equal texts give equal streams.

Cases: a null text is empty and stored as 64 zeros; texts of any length become more units;
repeated rows are stored alike; an empty table gives no rows. A stream that is not
transport packets raises ValueError.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryspark.runtime import extended, other_columns, quoted

#: fixed values of the format
PACKET, SYNC, PAT_PID, PRIVATE_STREAM, PRIVATE_TYPE = 188, 0x47, 0x0000, 0xBD, 0x06
CLOCK, WRAP = 90_000, 1 << 33
#: our own choices
PROGRAM, MAP_PID, DATA_PID, UNIT_TICKS = 1, 0x1000, 0x0100, CLOCK // 25


@functools.cache
def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


@functools.lru_cache(maxsize=4096)
def crc32_mpeg(data: bytes) -> int:
    table, c = _crc_table(), 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ table[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _packet(pid: int, counter: int, first: bool, payload: bytes, adaptation: bytes = b"") -> bytes:
    """``adaptation`` is the field without its length byte; stuffing fills what is left."""
    room = PACKET - 4 - len(payload)
    control = 0x10
    field_ = b""
    if room:
        control = 0x30
        inner = adaptation or (b"\x00" if room > 1 else b"")
        field_ = bytes([room - 1]) + inner + b"\xff" * (room - 1 - len(inner))
    return bytes([SYNC, (0x40 if first else 0) | pid >> 8, pid & 0xFF, control | counter & 15]) + field_ + payload


def _clock_field(ticks: int) -> bytes:
    """Flags (random access, clock reference) and the reference."""
    base = ticks % WRAP
    return b"\x50" + (base << 15 | 0x7E00).to_bytes(6, "big")


def _stamp(ticks: int) -> bytes:
    t = ticks % WRAP
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


@functools.cache
def _tables() -> bytes:
    pat = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | MAP_PID).to_bytes(2, "big"))
    pmt = _section(0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
    fill = lambda s: b"\x00" + s + b"\xff" * (PACKET - 5 - len(s))
    return _packet(PAT_PID, 0, True, fill(pat)) + _packet(MAP_PID, 0, True, fill(pmt))


def mux(payload: bytes, unit_bytes: int = 8192) -> bytes:
    """One program with ``payload`` as its elementary stream."""
    out, counter, full = [_tables()], 0, PACKET - 4
    plain = [bytes([SYNC, DATA_PID >> 8, DATA_PID & 0xFF, 0x10 | c]) for c in range(16)]
    for k, at in enumerate(range(0, len(payload), unit_bytes)):
        ticks = CLOCK + k * UNIT_TICKS
        body = payload[at : at + unit_bytes]
        header = b"\x84\x80\x05" + _stamp(ticks)
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(header) + len(body)).to_bytes(2, "big") + header + body
        first = full - 8  # the clock field takes 8 bytes
        out.append(_packet(DATA_PID, counter, True, pes[:first], _clock_field(ticks)))
        counter += 1
        rest = len(pes) - first
        for spot in range(first, first + rest - rest % full if rest > 0 else first, full):
            out += (plain[counter & 15], pes[spot : spot + full])
            counter += 1
        if rest > 0 and rest % full:
            out.append(_packet(DATA_PID, counter, False, pes[len(pes) - rest % full :]))
            counter += 1
    return b"".join(out)


@dataclass
class Unit:
    """One elementary packet."""

    pid: int
    stream_id: int
    pts: int | None
    packet: int
    random_access: bool
    data: bytes


@dataclass
class Stream:
    """What a transport stream holds."""

    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)  # number to the map's identifier
    streams: dict[int, int] = field(default_factory=dict)  # identifier to stream type
    units: list[Unit] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)
    clocks: int = 0
    duplicates: int = 0
    discontinuities: int = 0
    bad_sections: int = 0

    def payload(self) -> bytes:
        return b"".join(u.data for u in self.units)


def _read_stamp(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def _read_unit(pid: int, raw: bytes, packet: int, random_access: bool) -> Unit | None:
    if raw[:3] != b"\x00\x00\x01" or len(raw) < 9:
        return None
    length, pts, begin = int.from_bytes(raw[4:6], "big"), None, 9 + raw[8]
    if raw[7] & 0x80 and raw[8] >= 5:
        pts = _read_stamp(raw[9:14])
    return Unit(pid, raw[3], pts, packet, random_access, raw[begin : 6 + length] if length else raw[begin:])


def demux(data: bytes) -> Stream:
    """Parse packets; sections may span packets, and several programs may be present."""
    if len(data) % PACKET or (data and data[0] != SYNC):
        raise ValueError("not a sequence of transport packets")
    s, sections, last, open_units = Stream(), {PAT_PID: bytearray()}, {}, {}
    pieces: dict[int, list[bytes]] = defaultdict(list)

    def close(pid: int) -> None:
        if pid in open_units:
            unit = _read_unit(pid, b"".join(pieces[pid]), *open_units.pop(pid))
            if unit is not None:
                s.units.append(unit)
        pieces[pid] = []

    def parse(pid: int) -> None:
        buffer = sections[pid]
        while len(buffer) >= 3 and buffer[0] != 0xFF:
            size = 3 + ((buffer[1] & 0x0F) << 8 | buffer[2])
            if len(buffer) < size:
                return
            section = bytes(buffer[:size])
            del buffer[:size]
            if crc32_mpeg(section[:-4]) != int.from_bytes(section[-4:], "big"):
                s.bad_sections += 1
            elif section[0] == 0x00:
                for at in range(8, size - 4, 4):
                    number, map_pid = int.from_bytes(section[at : at + 2], "big"), int.from_bytes(section[at + 2 : at + 4], "big") & 0x1FFF
                    if number:
                        s.programs[number] = map_pid
                        sections.setdefault(map_pid, bytearray())
            elif section[0] == 0x02:
                at = 12 + (int.from_bytes(section[10:12], "big") & 0x0FFF)
                while at + 5 <= size - 4:
                    s.streams[int.from_bytes(section[at + 1 : at + 3], "big") & 0x1FFF] = section[at]
                    at += 5 + (int.from_bytes(section[at + 3 : at + 5], "big") & 0x0FFF)

    for n, at in enumerate(range(0, len(data), PACKET)):
        sync, b1, b2, b3 = data[at : at + 4]
        if sync != SYNC:
            raise ValueError(f"packet {n} has no sync byte")
        s.packets += 1
        pid, begin, broken, entry = (b1 & 0x1F) << 8 | b2, at + 4, False, False
        if pid == 0x1FFF or b1 & 0x80:
            continue
        if b3 & 0x20:
            length = data[begin]
            if length:
                flags = data[begin + 1]
                broken, entry = bool(flags & 0x80), bool(flags & 0x40)
                s.clocks += flags >> 4 & 1
            begin += 1 + length
        if entry:
            s.random_access.append(n)
        if not b3 & 0x10:
            continue
        counter = b3 & 15
        if pid in last and not broken:
            if counter == last[pid]:
                s.duplicates += 1
                continue
            if counter != last[pid] + 1 & 15:
                s.discontinuities += 1
                if pid in open_units:  # what came before the gap can't be completed
                    open_units.pop(pid)
                    pieces[pid] = []
                if pid in sections:
                    sections[pid].clear()
        last[pid] = counter
        payload = data[begin : at + PACKET]
        if pid in s.streams:
            if b1 & 0x40:
                close(pid)
                open_units[pid] = n, entry
            if pid in open_units:
                pieces[pid].append(payload)
        elif pid in sections:
            if b1 & 0x40:
                sections[pid] += payload[1 : 1 + payload[0]]
                parse(pid)
                sections[pid] = bytearray(payload[1 + payload[0] :])
            else:
                sections[pid] += payload
            parse(pid)
    for pid in list(open_units):
        close(pid)
    return s


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def _mapped(df: DataFrame, source: str, add: dict[str, pa.DataType], spark_types: str, function) -> DataFrame:
    """``df`` with columns computed from ``source`` a slice of a batch at a time."""
    names = other_columns(df, list(add))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                rows = [function(v) for v in b.column(b.schema.get_field_index(source)).to_pylist()]
                columns = [b.column(b.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), add.values(), strict=True))], names=[*names, *add])

    kept = df.select(*quoted(list(dict.fromkeys([*names, source]))))
    return kept.mapInArrow(run, extended(df.select(*quoted(names)).schema, spark_types))


def stored(text: str | None, unit_bytes: int = 8192) -> tuple[int, bytes]:
    """(bytes of the text, its transport stream)."""
    return len((text or "").encode("utf-8", "surrogatepass")), mux(padded(text), unit_bytes)


#: what reading gives of each stream: name, Arrow type, Spark type
READ = (
    ("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "long"), ("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string"),
    ("pts", pa.list_(pa.int64()), "array<long>"), ("random_access", pa.list_(pa.int64()), "array<long>"), ("feature", pa.string(), "string"),
)


def read_back(media: bytes | None) -> tuple:
    """Values of READ from a stream's bytes alone."""
    s = demux(media or b"")
    payload = s.payload()
    stamps = [u.pts for u in s.units]
    feature = f"programs={len(s.programs)};streams={len(s.streams)};packets={s.packets};units={len(s.units)};first_pts={stamps[0] if stamps else '-'};last_pts={stamps[-1] if stamps else '-'};random_access={len(s.random_access)};clocks={s.clocks};discontinuities={s.discontinuities};duplicates={s.duplicates};bad_sections={s.bad_sections}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media or b""), hashlib.sha256(media or b"").hexdigest(), stamps, s.random_access, feature


_READ_SPARK = ", ".join(f"{n} {t}" for n, _, t in READ)


def store_media(docs: DataFrame, *, text_col: str = "text", unit_bytes: int = 8192) -> DataFrame:
    """``docs`` with n_bytes (of the text) and media (its transport stream)."""
    return _mapped(docs, text_col, {"n_bytes": pa.int64(), "media": pa.binary()}, "n_bytes long, media binary", lambda t: stored(t, unit_bytes))


def read_media(stored_: DataFrame, *, media_col: str = "media") -> DataFrame:
    """``stored_`` with what its streams hold: payload digests, timestamps, random-access points, counts."""
    return _mapped(stored_, media_col, {n: t for n, t, _ in READ}, _READ_SPARK, read_back)


def media_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored and its stored bytes read back, in one pass over the rows, so no stream travels."""

    def both(text: str | None) -> tuple:
        n, media = stored(text)
        return n, *read_back(media)

    out = _mapped(docs.select(F.col(id_col), F.col(text_col)), text_col, {"n_bytes": pa.int64()} | {n: t for n, t, _ in READ}, f"n_bytes long, {_READ_SPARK}", both)
    return out.select(id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "random_access")
