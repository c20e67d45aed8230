from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from pagelathe.llm import transport_stream as ts

SF = "/root/testdata/sf0.001"


def packets(stream: bytes) -> list[bytes]:
    return [stream[i : i + 188] for i in range(0, len(stream), 188)]


def timestamp(t: int, mark: int) -> bytes:
    bits = f"{mark:04b}{t >> 30 & 7:03b}1{t >> 15 & 0x7FFF:015b}1{t & 0x7FFF:015b}1"
    return int(bits, 2).to_bytes(5, "big")


def section(table: int, number: int, body: bytes) -> bytes:
    """A section whose CRC is worked out bit by bit."""
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    c = 0xFFFFFFFF
    for byte in head:
        for i in range(7, -1, -1):
            c = (c << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if (c >> 31) ^ (byte >> i & 1) else 0)
    return head + c.to_bytes(4, "big")


class Writer:
    """An independent writer of foreign streams: several programs, two streams, DTS, tables over several packets."""

    def __init__(self):
        self.turn, self.out = {}, []

    def put(self, pid, payload, start=False, field=None, scrambled=0, error=0):
        turn = self.turn.get(pid, -1) + 1 & 15
        self.turn[pid] = turn
        room = 184 - len(payload)
        if field is not None or room:
            size = room - 1
            body = (field or b"\x00")[:size] + b"\xff" * (size - len(field or b"\x00")) if size else b""
            payload = bytes([size]) + body + payload
        kind = 0x30 if field is not None or room else 0x10
        self.out.append(bytes([0x47, error << 7 | start << 6 | pid >> 8, pid & 255, scrambled << 6 | kind | turn]) + payload)

    def tables(self, programs):
        body = b"\x00\x00\xe0\x10" + b"".join(n.to_bytes(2, "big") + (0xE000 | p).to_bytes(2, "big") for n, p, _ in programs)
        self.put(0, b"\x00" + section(0, 1, body) + b"\xff" * 20, True)
        for n, pid, streams in programs:
            listed = b"".join(bytes([t]) + (0xE000 | p).to_bytes(2, "big") + b"\xf0\x03abc" for p, t in streams)
            whole = b"\x02zz" + section(2, n, (0xE000 | streams[0][0]).to_bytes(2, "big") + b"\xf0\x00" + listed)
            cut = max(1, len(whole) // 2)
            self.put(pid, whole[:cut], True)
            self.put(pid, whole[cut:] + b"\xff" * 3)

    def unit(self, pid, data, pts=None, dts=None, random=False, stream=0xE0, bounded=True, lose=()):
        stamps = (timestamp(pts, 3 if dts is not None else 2) if pts is not None else b"") + (timestamp(dts, 1) if dts is not None else b"")
        rest = bytes([0x80, (0x80 if pts is not None else 0) | (0x40 if dts is not None else 0), len(stamps) + 2]) + stamps + b"\xff\xff" + data
        pes = b"\x00\x00\x01" + bytes([stream]) + (len(rest).to_bytes(2, "big") if bounded else b"\x00\x00") + rest
        first = True
        for nth in range(0, len(pes), 160):
            self.put(pid, pes[nth : nth + 160], first, b"\x40" if random and first else None)
            if nth // 160 in lose:
                self.out.pop()
            first = False


def test_round_trip():
    r = random.Random(0)
    for size in [0, 64, 128, 4032, 4096, 4160, 4096 * 16, 4096 * 17 + 64, 300_032, *(r.randrange(1, 5000) for _ in range(60))]:
        data = r.randbytes(size)
        stream = ts.mux(data)
        assert len(stream) % 188 == 0 and all(p[0] == 0x47 for p in packets(stream))
        s = ts.demux(stream)
        assert b"".join(s.data.values()) == data and (s.skipped, s.breaks, s.bad_tables) == (0, 0, 0)
        assert [u.pts for u in s.units] == [i * 7680 for i in range(-(-size // 4096))]
        assert [u.at for u in s.units if u.random_access] == list(range(0, size, 4096 * 16)) and all(u.whole for u in s.units)
        assert s.programs == ([(1, 0x1000, 0x100, ((0x100, 6),))] if size else [])


def test_foreign_stream():
    """Two programs, tables over several packets, unbounded units, DTS, null packets, and times that wrap."""
    w = Writer()
    w.tables([(5, 0x20, [(0x31, 0x1B), (0x32, 0x0F)]), (9, 0x21, [(0x41, 0x02)])])
    top = (1 << 33) - 3000
    video = [random.Random(i).randbytes(700 + i) for i in range(6)]
    for i, data in enumerate(video):
        t = (top + i * 3600) % (1 << 33)
        w.unit(0x31, data, pts=(t + 7200) % (1 << 33), dts=t, random=i % 3 == 0, bounded=i % 2 == 0)
        w.unit(0x32, bytes([i]) * 50, pts=t, stream=0xC0)
        w.out.append(b"\x47\x1f\xff\x10" + b"\xff" * 184)
        w.unit(0x41, b"q" * 300, stream=0xE1)
        w.put(0x99, b"unlisted" * 23, True)
    s = ts.demux(b"".join(w.out))
    assert s.programs == [(5, 0x20, 0x31, ((0x31, 0x1B), (0x32, 0x0F))), (9, 0x21, 0x41, ((0x41, 2),))]
    assert s.data[0x31] == b"".join(video) and s.data[0x32] == b"".join(bytes([i]) * 50 for i in range(6)) and s.data[0x41] == b"q" * 1800
    own = [u for u in s.units if u.pid == 0x31]
    assert [u.dts - own[0].dts for u in own] == [i * 3600 for i in range(6)] and all(u.pts - u.dts == 7200 for u in own)
    assert [u.random_access for u in own] == [True, False, False] * 2 and all(u.whole for u in s.units)
    assert all(u.pts is None for u in s.units if u.pid == 0x41) and 0x99 not in s.data and (s.breaks, s.skipped) == (0, 0)


def test_damage():
    """Lost and repeated packets, lost sync, transport errors, scrambled packets and tables that fail their CRC."""
    w = Writer()
    w.tables([(1, 0x20, [(0x31, 0x1B)])])
    w.unit(0x31, b"a" * 600, pts=0)
    w.unit(0x31, b"b" * 600, pts=1, lose={2})
    w.unit(0x31, b"c" * 600, pts=2)
    s = ts.demux(b"".join(w.out))
    assert s.breaks == 1 and [u.whole for u in s.units] == [True, False, True] and s.data[0x31].endswith(b"c" * 600)
    good = ts.mux(bytes(range(256)) * 64)
    rows = packets(good)
    assert ts.demux(b"".join(p for x in rows for p in (x, x)))[2:] == (0, 0, *ts.demux(good)[4:5], [u._replace(packet=u.packet * 2) for u in ts.demux(good).units], ts.demux(good).data)
    junk = b"\x00\x47junk" + good[: 188 * 5] + b"noise" + good[188 * 5 :] + b"tail"
    s = ts.demux(junk)
    assert s.data == ts.demux(good).data and s.skipped == 6 + 5 + 4
    for bad in (bytes([0x47, rows[5][1] | 0x80]) + rows[5][2:], rows[5][:3] + bytes([rows[5][3] | 0xC0]) + rows[5][4:]):
        s = ts.demux(b"".join([*rows[:5], bad, *rows[6:]]))
        assert s.breaks == 1 and not s.units[0].whole and s.units[1].whole
    broken = rows[0][:10] + bytes([rows[0][10] ^ 1]) + rows[0][11:]
    s = ts.demux(broken + b"".join(rows[1:]))
    assert s.bad_tables == 1
    announced = Writer()
    announced.tables([(1, 0x20, [(0x31, 0x1B)])])
    announced.unit(0x31, b"x" * 100, pts=0)
    announced.turn[0x31] = 9
    announced.put(0x31, b"\x00\x00\x01\xe0\x00\x00\x80\x00\x00y", True, b"\x80")
    assert ts.demux(b"".join(announced.out)).breaks == 0
    for cut in range(0, 400, 7):  # any cut and any garbage is read without failing
        ts.demux(good[cut : cut + 1000])
    r = random.Random(1)
    for _ in range(50):
        noisy = bytearray(good[: 188 * 20])
        for _ in range(30):
            noisy[r.randrange(len(noisy))] = r.randrange(256)
        ts.demux(bytes(noisy))


def test_padding():
    assert [len(ts.padded(b"x" * n)) for n in (0, 1, 63, 64, 65, 128)] == [64, 64, 64, 64, 128, 128]


TEXTS = [(1, "hello"), (2, None), (3, ""), (None, "hello"), (3, "é" * 100_000), (3, "é" * 100_000), (5, "\x00" * 64), (6, "a" * 64)]


def test_columns(spark, monkeypatch):
    monkeypatch.setattr(ts, "FLUSH", 1000)
    df = spark.createDataFrame([(*x, "clash", "clash") for x in TEXTS], "doc_id long, text string, media string, data string")
    media = ts.encode(df)
    got = ts.decode(media, carry=("n_bytes",)).collect()
    want = sorted(((i, len((t or "").encode()), ts.padded((t or "").encode())) for i, t in TEXTS), key=str)
    assert sorted(((x.doc_id, x.n_bytes, bytes(x.data)) for x in got), key=str) == want
    assert all(x.programs[0].streams[0].type == 6 and x.units[0].random_access and x.breaks == 0 for x in got)
    assert [(x.packets, x.units, bytes(x.data)) for x in ts.decode(spark.createDataFrame([(1, None), (2, b"")], "doc_id long, media binary")).collect()] == [(0, [], b"")] * 2
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ts.decode(ts.encode(empty)).collect() == []


@pytest.mark.parametrize("where", ["sf", "odd"])
def test_query(spark, tmp_path, where):
    """Against digests of the texts themselves."""
    sf = SF
    if where == "odd":
        sf = str(tmp_path)
        spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = ts.op12_transport_stream(spark, sf).collect()
    want = []
    for i, t in docs:
        p = t + b"\0" * (-len(t) % 64 if t else 64)
        stream = ts.mux(p)
        want.append((i, len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(stream), hashlib.sha256(stream).hexdigest()))
    assert sorted((tuple(x[:7]) for x in got), key=str) == sorted(want, key=str)
    by_text = {}
    for x in got:
        by_text.setdefault(x.payload_sha256, set()).add((x.feature, x.media_sha256))
        assert x.breaks == 0 and x.pts == [n * 7680 for n in range(-(-x.payload_bytes // 4096))] and x.random_access_at == list(range(0, x.payload_bytes, 65536))
    assert all(len(v) == 1 for v in by_text.values())
