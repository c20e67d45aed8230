"""Media columns as MPEG transport streams.

A stream is a row of 188-byte packets. Program tables name the elementary streams; a program's packets carry a counter by
which a loss is seen; an elementary stream comes in timed units that may be marked as points where reading can begin.
demux() reads any such stream, also one with lost or repeated packets, and gives its programs, the units with their timestamps
and the bytes of the elementary stream; mux() writes 8-bit samples as one. Streams live in a binary column of a Parquet table.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.scratch import written

# Fixed values of the format: packet length, sync byte, packet ids of the program association table and of stuffing, clock.
PACKET, SYNC, PAT, NULL_PID, CLOCK = 188, 0x47, 0x0000, 0x1FFF, 90_000
WRAP = 1 << 33
#: What mux() writes: its packet ids, private data in private stream 1, one unit of samples, and how often tables and a
#: random-access point come. 4,096 samples at 48 kHz last 7,680 ticks of the clock.
PMT_PID, DATA_PID, STREAM_TYPE, STREAM_ID = 0x1000, 0x0100, 0x06, 0xBD
UNIT, RATE, EVERY = 4096, 48_000, 16
#: Results are passed on when they hold so many bytes.
FLUSH = 16 << 20


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    """The CRC of sections; 0 over a section that ends with its own."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


# ---- writing


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc_mpeg(head).to_bytes(4, "big")


_TABLES = ((PAT, _section(0, 1, b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big"))), (PMT_PID, _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")))


def _timestamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | t >> 29 & 0x0E | 1, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def mux(samples: bytes) -> bytes:
    """8-bit samples as a transport stream of one program with one elementary stream, a unit for each UNIT samples.

    Each EVERY-th unit, the first included, is a random-access point, with the tables before it and a clock reference.
    """
    out: list[bytes] = []
    turns = {PAT: 0, PMT_PID: 0, DATA_PID: 0}

    def head(pid: int, start: bool, field: bool) -> bytes:
        turn = turns[pid]
        turns[pid] = turn + 1 & 15
        return bytes([SYNC, start << 6 | pid >> 8, pid & 0xFF, (0x30 if field else 0x10) | turn])

    for nth, at in enumerate(range(0, len(samples), UNIT)):
        point = nth % EVERY == 0
        if point:
            for pid, section in _TABLES:
                out.append((head(pid, True, False) + b"\x00" + section).ljust(PACKET, b"\xff"))
        time = at * CLOCK // RATE % WRAP
        data = samples[at : at + UNIT]
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(2, time) + data
        done, start = 0, True
        while done < len(pes):
            field = b"\x50" + (time << 15 | 0x7E00).to_bytes(6, "big") if point and start else b""
            room = PACKET - 4 - (len(field) + 1 if field else 0)
            part = pes[done : done + room]
            lack = room - len(part)
            if field:
                field = bytes([len(field) + lack]) + field + b"\xff" * lack
            elif lack:
                field = b"\x00" if lack == 1 else bytes([lack - 1, 0]) + b"\xff" * (lack - 2)
            out.append(head(DATA_PID, start, bool(field)) + field + part)
            done, start = done + len(part), False
    return b"".join(out)


# ---- reading


class Unit(NamedTuple):
    """A unit of an elementary stream: its times in ticks (None if not given), its place and length in that stream, the
    packet that it begins in, whether reading can begin here, and whether it is whole."""

    pid: int
    pts: int | None
    dts: int | None
    at: int
    size: int
    packet: int
    random_access: bool
    whole: bool


class Streams(NamedTuple):
    """packets read, bytes skipped to find packets, breaks of a counter, tables that fail their CRC, the programs as (number,
    table's pid, clock's pid, ((pid, type), ...)), units in order of their begin, and the data of each pid."""

    packets: int
    skipped: int
    breaks: int
    bad_tables: int
    programs: list[tuple]
    units: list[Unit]
    data: dict[int, bytes]


class _Elementary:
    """Reassembles the units of one pid; times are unwrapped from 33 bits against the one before."""

    def __init__(self, pid: int):
        self.pid, self.parts, self.at, self.units = pid, [], 0, []
        self.open: list[bytes] | None = None
        self.packet, self.random, self.last = 0, False, None
        self.whole = True

    def begin(self, payload: bytes, packet: int, random: bool) -> None:
        self.close()
        self.open, self.packet, self.random, self.whole = [payload], packet, random, True

    def time(self, b: bytes) -> int:
        t = (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1
        if self.last is not None:
            t += (self.last - t + WRAP // 2) // WRAP * WRAP
        self.last = t
        return t

    def close(self) -> None:
        if self.open is None:
            return
        pes, self.open = b"".join(self.open), None
        if len(pes) < 6 or pes[:3] != b"\x00\x00\x01":
            return
        size = int.from_bytes(pes[4:6], "big")
        end = 6 + size if size else len(pes)
        pts = dts = None
        begin = 6
        # program stream maps, padding and the like have no such head
        if pes[3] not in (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF) and len(pes) >= 9 and pes[6] >> 6 == 2:
            begin = 9 + pes[8]
            if pes[7] & 0x80 and pes[8] >= 5 and len(pes) >= 14:
                pts = self.time(pes[9:14])
                if pes[7] & 0x40 and pes[8] >= 10 and len(pes) >= 19:
                    dts = self.time(pes[14:19])
        data = pes[begin:end]
        self.units.append(Unit(self.pid, pts, dts, self.at, len(data), self.packet, self.random, self.whole and len(pes) >= end))
        self.parts.append(data)
        self.at += len(data)


class _Tables:
    """Sections of one pid, over as many packets as they take."""

    def __init__(self):
        self.held = b""

    def feed(self, payload: bytes, start: bool) -> Iterator[bytes]:
        if start:
            pointer = payload[0] if payload else 0
            if self.held:
                self.held += payload[1 : 1 + pointer]
                yield from self.whole()
            self.held = payload[1 + pointer :]
        elif self.held:
            self.held += payload
        yield from self.whole()

    def whole(self) -> Iterator[bytes]:
        while len(self.held) >= 3 and self.held[0] != 0xFF:
            size = 3 + (int.from_bytes(self.held[1:3], "big") & 0x0FFF)
            if len(self.held) < size:
                return
            section, self.held = self.held[:size], self.held[size:]
            yield section
        if self.held[:1] == b"\xff":  # stuffing to the end of the packet
            self.held = b""


def _synced(data: bytes, at: int) -> int:
    """The next place at which a packet begins: a sync byte that another follows, or that ends the data a packet later."""
    while True:
        at = data.find(SYNC, at)
        if at < 0 or at + PACKET > len(data):
            return -1
        if at + PACKET == len(data) or data[at + PACKET] == SYNC:
            return at
        at += 1


def demux(data: bytes) -> Streams:
    """The programs, units and elementary streams of a transport stream.

    A packet that repeats the one before in counter and bytes is dropped; any other break of a counter marks the unit that it
    falls in as not whole, unless the stream announces it. Packets with a transport error and scrambled ones count as lost.
    Tables count only with a right CRC, the latest one of a program. Data of pids that no table names is not read: a unit
    before the first table is not either. Empty data gives no packets.
    """
    at, packets, skipped, breaks, bad = 0, 0, 0, 0, 0
    pat, pmt, programs = {}, {}, {}
    sections: dict[int, _Tables] = {PAT: _Tables()}
    streams: dict[int, _Elementary] = {}
    last: dict[int, tuple[int, bytes]] = {}
    while at + PACKET <= len(data):
        if data[at] != SYNC:
            found = _synced(data, at)
            skipped += (len(data) if found < 0 else found) - at
            if found < 0:
                at = len(data)
                break
            at = found
        b1, b2, b3 = data[at + 1], data[at + 2], data[at + 3]
        packet, nth = data[at : at + PACKET], packets
        at, packets = at + PACKET, packets + 1
        pid = (b1 & 0x1F) << 8 | b2
        if pid == NULL_PID or b1 & 0x80 or b3 & 0xC0 or not b3 & 0x30:
            continue
        begin, announced, random = 4, False, False
        if b3 & 0x20:
            begin = 5 + packet[4]
            if packet[4]:
                announced, random = bool(packet[5] & 0x80), bool(packet[5] & 0x40)
        if not b3 & 0x10 or begin > PACKET:
            continue  # no payload: the counter stands still
        turn, before = b3 & 15, last.get(pid)
        last[pid] = (turn, packet)
        if before is not None and turn != before[0] + 1 & 15 and not announced:
            if packet == before[1]:
                continue
            breaks += 1
            if pid in streams:
                streams[pid].whole = False
            if pid in sections:
                sections[pid].held = b""
        start, payload = bool(b1 & 0x40), packet[begin:]
        if pid in sections:
            for section in sections[pid].feed(payload, start):
                if crc_mpeg(section):
                    bad += 1
                elif pid == PAT and section[0] == 0:
                    pat = {int.from_bytes(section[i + 2 : i + 4], "big") & 0x1FFF: int.from_bytes(section[i : i + 2], "big") for i in range(8, len(section) - 4, 4)}
                    for p, number in pat.items():
                        if number:
                            sections.setdefault(p, _Tables())
                elif section[0] == 2 and pid in pat:
                    number, clock = int.from_bytes(section[3:5], "big"), int.from_bytes(section[8:10], "big") & 0x1FFF
                    i = 12 + (int.from_bytes(section[10:12], "big") & 0x0FFF)
                    listed = []
                    while i + 5 <= len(section) - 4:
                        listed.append((int.from_bytes(section[i + 1 : i + 3], "big") & 0x1FFF, section[i]))
                        i += 5 + (int.from_bytes(section[i + 3 : i + 5], "big") & 0x0FFF)
                    programs[number] = (number, pid, clock, tuple(listed))
                    for p, _ in listed:
                        if p not in streams:
                            streams[p] = _Elementary(p)
        elif pid in streams:
            s = streams[pid]
            if start:
                s.begin(payload, nth, random)
            elif s.open is not None:
                s.open.append(payload)
    skipped += len(data) - at
    for s in streams.values():
        s.close()
    units = sorted((u for s in streams.values() for u in s.units), key=lambda u: (u.packet, u.pid))
    return Streams(packets, skipped, breaks, bad, [programs[n] for n in sorted(programs)], units, {p: b"".join(s.parts) for p, s in streams.items()})


# ---- columns


def _sliced(rows: Iterator[tuple], schema: pa.Schema, weigh: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches that end once column weigh holds FLUSH bytes."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[weigh] or b"")
        if size >= FLUSH or len(held) >= 1000:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


def padded(text: bytes) -> bytes:
    """text with bytes 0 up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): whole texts in UTF-8, padded, as transport streams. Null counts as empty, and an empty text is 64
    bytes 0. Ids may be null or repeated; equal texts have equal streams; other columns are not read."""
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(id_col, F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                yield key.as_py(), len(text), mux(padded(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([(id_col, first.schema.field(0).type), ("n_bytes", pa.int64()), ("media", pa.binary())])
        yield from _sliced(rows(_chain(first, batches)), schema, 2)

    return read.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


_POINT = pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("packet", pa.int64()), ("random_access", pa.bool_()), ("whole", pa.bool_())])
_PROGRAM = pa.struct([("number", pa.int32()), ("pmt_pid", pa.int32()), ("pcr_pid", pa.int32()), ("streams", pa.list_(pa.struct([("pid", pa.int32()), ("type", pa.int32())])))])
_READ = [("packets", pa.int64()), ("skipped", pa.int64()), ("breaks", pa.int64()), ("bad_tables", pa.int64()), ("programs", pa.list_(_PROGRAM)), ("units", pa.list_(_POINT)), ("data", pa.binary())]
_DDL = "packets long, skipped long, breaks long, bad_tables long, programs array<struct<number: int, pmt_pid: int, pcr_pid: int, streams: array<struct<pid: int, type: int>>>>, units array<struct<pid: int, pts: long, dts: long, at: long, size: long, packet: long, random_access: boolean, whole: boolean>>, data binary"


def decode(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", carry: tuple[str, ...] = (), digests: bool = False) -> DataFrame:
    """(id, *carry, packets, skipped, breaks, bad_tables, programs, units, data) of transport streams; null counts as empty.

    units has the timestamps and random-access points of all elementary streams, data the bytes of the first stream of the
    first program (empty without one). With digests, data is left out and the columns of digest() follow instead, so bytes
    that have been read need not leave their task. carry names columns that are passed on; ids may be null or repeated.
    """
    own = [id_col, *carry]
    kinds = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in own)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for blob, *kept in zip(*batch.columns, strict=True):
                blob = blob.as_py() or b""
                s = demux(blob)
                first = next((p for _, _, _, listed in s.programs for p, _ in listed), None)
                data = s.data.get(first, b"")
                programs = [{"number": n, "pmt_pid": p, "pcr_pid": c, "streams": [{"pid": i, "type": t} for i, t in listed]} for n, p, c, listed in s.programs]
                found = (*(k.as_py() for k in kept), s.packets, s.skipped, s.breaks, s.bad_tables, programs, [u._asdict() for u in s.units])
                yield (*found, *digest(blob, s, data)) if digests else (*found, data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        fields = [*((c, first.schema.field(c).type) for c in own), *(_READ[:-1] + _DIGEST if digests else _READ)]
        yield from _sliced(rows(_chain(first, batches)), pa.schema(fields), -1)

    ddl = f"{_DDL.removesuffix(', data binary')}, {_DIGEST_DDL}" if digests else _DDL
    return media.select(F.col(media_col).alias("__media"), *own).mapInArrow(run, f"{kinds}, {ddl}")


_DIGEST = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
_DIGEST_DDL = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(blob: bytes, s: Streams, data: bytes) -> tuple:
    """Of samples read back and of their stream: length, SHA-256, crc32 of the last 64 samples, the stream's length and
    SHA-256, and a feature: length in ticks, units, random-access points, sum and sum of squares of the samples, and how often
    neighbours lie on two sides of 128."""
    x = np.frombuffer(data, dtype=np.uint8)
    high = x >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    squares = int(np.bincount(x, minlength=256) @ np.arange(256, dtype=np.int64) ** 2)
    points = sum(u.random_access for u in s.units)
    feature = f"ticks={len(data) * CLOCK // RATE} units={len(s.units)} points={points} sum={int(x.sum(dtype=np.int64))} squares={squares} crossings={crossings}"
    return len(data), sha256(data).hexdigest(), crc32(data[-64:]), len(blob), sha256(blob).hexdigest(), feature


def op12_transport_stream(spark, sf_dir: str) -> DataFrame:
    """Documents stored as transport streams in a table, read back and digested, with the times of their units and the places
    of their random-access points."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    media = written(encode(docs), "media", compression="zstd")
    read = decode(media, carry=("n_bytes",), digests=True)
    points = F.transform(F.filter("units", lambda u: u["random_access"]), lambda u: u["at"])
    digests = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return read.select("doc_id", "n_bytes", *digests, "packets", "breaks", F.col("units.pts").alias("pts"), points.alias("random_access_at"))
