"""WARC archives in ZIP packages: a writer, and a reader that range-reads records without extracting anything.

The writer's packages hold stored (uncompressed) members: archive/data.warc.gz, a warcinfo record and one gzip member for
each record, and indexes/index.cdxj, a line for each record of its SURT key, timestamp and JSON. The reader takes packages of
any writer: it parses the end record, the ZIP64 locator and end record, the central directory and its ZIP64 extra fields,
finds every stored *.warc.gz or *.warc member behind its local header, reads the CDXJ indexes (plain, gzipped, or deflated by
the ZIP) and then only the ranges they name; a member that no index covers is scanned once for its records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.scratch import BROADCAST_ROWS, new_path, written

#: A package is closed and another begun after so many bytes of records; ranges of neighbouring records are read together
#: up to RANGE_BYTES.
PACKAGE_BYTES, RANGE_BYTES = 256 << 20, 4 << 20
#: A reading task takes about so many bytes of records; fewer where that leaves cores idle.
TASK_BYTES = 64 << 20
#: A payload shorter than this is never a revisit.
REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_URN = "urn:pagelathe:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NO_URL = "urn:pagelathe:no-url"
#: Record types that stand for a page.
PAGES = ("response", "revisit", "resource")


# ---- ZIP


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int


def _read(f, at: int, size: int) -> bytes:
    f.seek(at)
    got = f.read(size)
    if len(got) != size:
        raise ValueError(f"truncated archive: {len(got)} of {size} bytes at {at}")
    return got


def directory(f, size: int) -> list[Member]:
    """The members that the central directory of a seekable file of size bytes lists."""
    tail_at = max(0, size - 65557)
    tail = _read(f, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):  # the comment may hold the mark
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        locator = _read(f, tail_at + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record = _read(f, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    table, at, out = _read(f, start, length), 0, []
    for _ in range(count):
        if table[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, plain = (struct.unpack_from("<H", table, at + 10)[0], *struct.unpack_from("<II", table, at + 20))
        n_name, n_extra, n_note = struct.unpack_from("<HHH", table, at + 28)
        header = struct.unpack_from("<I", table, at + 42)[0]
        name = table[at + 46 : at + 46 + n_name]
        extra, x = table[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while x + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, x)
            if kind == 1:  # the 64-bit values stand in this order, each only if its field is all ones
                y = x + 4
                if plain == 0xFFFFFFFF:
                    plain, y = struct.unpack_from("<Q", extra, y)[0], y + 8
                if packed == 0xFFFFFFFF:
                    packed, y = struct.unpack_from("<Q", extra, y)[0], y + 8
                if header == 0xFFFFFFFF:
                    header = struct.unpack_from("<Q", extra, y)[0]
            x += 4 + width
        utf8 = struct.unpack_from("<H", table, at + 8)[0] & 0x800
        out.append(Member(name.decode("utf-8" if utf8 else "cp437"), method, plain, packed, header))
        at += 46 + n_name + n_extra + n_note
    return out


def data_start(f, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; only stored members can be range-read")
    head = _read(f, member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header for {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


# ---- WARC


def target(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else _NO_URL


def surt(url: str) -> str:
    """The sort-friendly key of a URL: its host's labels from the last to the first, then path and query in lower case."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        host = None
    if not host:
        return url.lower()
    labels = re.sub(r"^www[0-9]*\.", "", host).split(".")
    extra = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return f"{','.join(reversed(labels))}{extra}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def _build(head: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(name: str) -> bytes:
    """The record that opens an archive."""
    block = b"software: pagelathe\r\nformat: WARC File Format 1.1\r\n"
    return _build(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], block)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """A response record, or a revisit that keeps the HTTP headers and refers to the record of another page."""
    kind = "response" if refers_to is None else "revisit"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{_URN}{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target(url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_URN}{refers_to}>", f"WARC-Refers-To-Target-URI: {target(refers_url)}", f"WARC-Refers-To-Date: {DATE}", f"WARC-Profile: {_PROFILE}"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return _build([*head, "Content-Type: application/http; msgtype=response"], block + (payload if refers_to is None else b""))


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _matches(named: str, payload: bytes) -> bool:
    """Whether a labelled digest (hexadecimal or base 32) is that of a payload; unknown algorithms are taken on trust."""
    kind, _, value = named.rpartition(":")
    if kind not in ("sha256", "sha1", "md5"):
        return True
    own = hashlib.new(kind, payload).digest()
    return value.lower() == own.hex() or value.rstrip("=").upper() == base64.b32encode(own).decode().rstrip("=")


def _own_id(uri: str | None) -> int | None:
    """The page id in one of the writer's record ids."""
    m = re.fullmatch(rf"<?{re.escape(_URN)}(-?\d+)>?", uri or "")
    return int(m[1]) if m else None


def parse(raw: bytes) -> dict:
    """A record's fields; page_id and refers_to are null for records of another writer. A payload is checked against its digest.

    payload_digest is the bare SHA-256 of a payload; of a revisit, what its header names, without a label of sha256.
    named_digest is the header's own, by which a revisit finds its response.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    warc = _headers(head)
    length = int(warc["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] not in (b"\r\n\r\n", b""):
        raise ValueError("record length does not fit")
    kind, named = warc.get("warc-type", ""), warc.get("warc-payload-digest", "")
    out = {"page_id": _own_id(warc.get("warc-record-id")), "record_id": warc.get("warc-record-id", "").strip("<>"), "url": warc.get("warc-target-uri"), "record_type": kind, "payload_digest": named.removeprefix("sha256:") or None, "named_digest": named or None, "payload_bytes": None, "refers_to": None, "refers_to_url": None, "payload": None}
    if kind not in PAGES:
        return out
    http, mark, payload = block.partition(b"\r\n\r\n") if "application/http" in warc.get("content-type", "application/http") else (b"", b"", block)
    if kind == "revisit":
        size = _headers(http).get("content-length", "")
        out |= {"refers_to": _own_id(warc.get("warc-refers-to")), "refers_to_url": warc.get("warc-refers-to-target-uri"), "payload_bytes": int(size) if size.isdigit() else None}
    else:
        if not _matches(named, payload):
            raise ValueError(f"payload of {out['record_id']} does not match its digest")
        out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
    return out


class Package:
    """One archive being written to a stream that need not be seekable."""

    def __init__(self, path: str, level: int) -> None:
        fs, inner = pafs.FileSystem.from_uri(path)
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
        self.path, self.level, self.at, self.rows = path, level, 0, []
        self._raw = fs.open_output_stream(inner)
        self._zip = zipfile.ZipFile(self._raw, "w", zipfile.ZIP_STORED, allowZip64=True)
        self._data = self._zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self._put(info(DATA.rpartition("/")[2]))

    def _put(self, raw: bytes) -> tuple[int, int]:
        packed = gzip.compress(raw, self.level, mtime=0)
        self._data.write(packed)
        self.at += len(packed)
        return self.at - len(packed), len(packed)

    def add(self, url: str | None, digest: str, refers_to: int | None, raw: bytes) -> None:
        offset, length = self._put(raw)
        fields = {"url": target(url), "mime": "text/html" if refers_to is None else "warc/revisit", "status": "200", "digest": f"sha256:{digest}", "length": str(length), "offset": str(offset), "filename": DATA.rpartition("/")[2]}
        self.rows.append(f"{surt(target(url))} {re.sub('[^0-9]', '', DATE)} {json.dumps(fields)}\n")

    def close(self) -> tuple[str, int, int]:
        self._data.close()
        self._zip.writestr(zipfile.ZipInfo(INDEX), "".join(sorted(self.rows)))
        self._zip.close()
        self._raw.close()
        return self.path, len(self.rows), self.at


def write_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: int = 1) -> DataFrame:
    """Packages of one record for each row in a folder that all executors share; returns (path, records, bytes).

    Of equal payloads of at least REVISIT_BYTES the row with the smallest id is the response and others revisit it; rows
    repeated with that id, and rows with a null id where no other has one, are responses too. A null html is an empty
    payload, a null url gets a fixed URN. A task that is run again writes other files; the returned table, written
    before it is read, names only those of the tasks that count. An empty table gives no packages.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url")))
    firsts = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(least.alias("least"), F.count("*").alias("n"))
    firsts = written(firsts.where("n > 1 AND least IS NOT NULL").select("digest", F.col("least.id").alias("first"), F.col("least.url").alias("first_url")), "firsts")
    if firsts.count() <= BROADCAST_ROWS // 4:
        firsts = F.broadcast(firsts)
    again = ~F.col("id").eqNullSafe(F.col("first"))
    rows = rows.join(firsts, "digest", "left").select("id", "url", "payload", "digest", F.when(again, F.col("first")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None
        for batch in batches:
            for page_id, url, payload, digest, refers_to, refers_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = now or Package(f"{folder}/{uuid.uuid4().hex}.zip", level)
                now.add(url, digest, refers_to, record(page_id, url, payload, digest, refers_to, refers_url))
                if now.at >= PACKAGE_BYTES:
                    done.append(now.close())
                    now = None
        if now:
            done.append(now.close())
        if done:
            path, n, size = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(n, pa.int64()), pa.array(size, pa.int64())], ["path", "records", "bytes"])

    return written(rows.mapInArrow(run, "path string, records long, bytes long"), "packages")


def _index_lines(f, member: Member) -> Iterator[dict]:
    """The JSON part of each line of an index member, which may be gzipped, or deflated by the ZIP."""
    head = _read(f, member.header, 30)
    raw = _read(f, member.header + 30 + sum(struct.unpack_from("<HH", head, 26)), member.packed)
    if member.method == 8:
        raw = zlib.decompress(raw, -15)
    elif member.method:
        raise ValueError(f"{member.name} is compressed in a way that is not supported")
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    for line in raw.splitlines():
        at = line.find(b"{")
        if at >= 0 and not line.startswith(b"!"):
            yield json.loads(line[at:])


def _scan(f, at: int, size: int) -> Iterator[tuple[int, int]]:
    """Position and length of each record of an archive, found by reading through it."""
    done = 0
    plain = _read(f, at, min(2, size)) != b"\x1f\x8b"
    while done < size:
        if plain:
            head = b""
            while b"\r\n\r\n" not in head and done + len(head) < size:
                head += _read(f, at + done + len(head), min(4096, size - done - len(head)))
            top = head.partition(b"\r\n\r\n")[0]
            length = min(len(top) + 8 + int(_headers(top)["content-length"]), size - done)
        else:
            d, length = zlib.decompressobj(31), 0
            while not d.eof and done + length < size:
                some = _read(f, at + done + length, min(1 << 16, size - done - length))
                d.decompress(some)
                length += len(some) - len(d.unused_data)
        yield at + done, length
        done += length


def ranges(path: str) -> Iterator[tuple[int, list[int]]]:
    """(position in the file, lengths of the records there), neighbours together up to RANGE_BYTES."""
    fs, inner = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(inner) as f:
        members = directory(f, f.size())
        archives = {m.name.rpartition("/")[2]: m for m in members if re.search(r"\.warc(?:\.gz)?$", m.name)}
        found: dict[str, dict[int, int]] = {}
        for m in members:
            if re.search(r"\.cdxj?(?:\.gz)?$", m.name):
                for x in _index_lines(f, m):
                    name = x.get("filename", "").rpartition("/")[2] or (next(iter(archives)) if len(archives) == 1 else "")
                    if name in archives and "offset" in x and "length" in x:
                        found.setdefault(name, {})[int(x["offset"])] = int(x["length"])
        for name, m in sorted(archives.items()):
            base = data_start(f, m)
            at, lengths = None, []
            records = ((base + o, n) for o, n in sorted(found[name].items())) if name in found else _scan(f, base, m.size)
            for here, n in records:
                if lengths and (here != at + sum(lengths) or sum(lengths) + n > RANGE_BYTES):
                    yield at, lengths
                    lengths = []
                at = at if lengths else here
                lengths.append(n)
            if lengths:
                yield at, lengths


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            found = list(ranges(path))
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], ["path", "at", "lengths"])


RECORD = "page_id long, record_id string, url string, payload_bytes long, payload_digest string, named_digest string, record_type string, refers_to long, refers_to_url string"


def _fetch(payloads: bool):
    kinds = {"page_id": pa.int64(), "record_id": pa.string(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "named_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "refers_to_url": pa.string()}
    kinds |= {"payload": pa.binary()} if payloads else {}
    kinds |= {"archive": pa.string(), "position": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, inner = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(inner) as f:
                    data = _read(f, at, sum(lengths))
                rows, x = [], 0
                for n in lengths:
                    one = data[x : x + n]
                    row = parse(zlib.decompress(one, 31) if one[:2] == b"\x1f\x8b" else one)
                    if row["record_type"] in PAGES:
                        rows.append(row | {"archive": path.rpartition("/")[2], "position": at + x})
                    x += n
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))

    return run


def read_packages(packages: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each page record of the packages at packages.path: the columns of RECORD, payload if asked for (null for
    revisits, see resolve), archive, position. Requests, metadata and the like are passed over.

    A package without archives gives nothing; one that is broken, or whose archive is compressed by the ZIP, is an error.
    Tasks read ranges, not packages, so one large package is read by many; their number follows from the bytes.
    """
    spark = packages.sparkSession
    paths = packages.select("path")
    listed = written(paths.repartition(max(1, paths.count())).mapInArrow(_list, "path string, at long, lengths array<long>"), "ranges")
    n, total = listed.agg(F.count("*"), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    tasks = max(1, min(n, max(-(-total // TASK_BYTES), 2 * spark.sparkContext.defaultParallelism)))
    schema = RECORD + ", payload binary" * payloads + ", archive string, position long"
    return listed.repartition(tasks).mapInArrow(_fetch(payloads), schema)


def resolve(records: DataFrame) -> DataFrame:
    """records, read with payloads, with the payload that each revisit refers to; null where its response isn't there.

    Responses that some revisit names by digest are reduced to one for each digest before the join.
    """
    first = records.where("record_type <> 'revisit'").groupBy("named_digest").agg(F.first("payload").alias("__payload"))
    wanted = records.where("record_type = 'revisit'").select("named_digest").distinct()
    found = first.join(wanted, "named_digest", "left_semi").withColumnRenamed("named_digest", "__digest")
    same = (F.col("record_type") == "revisit") & (F.col("named_digest") == F.col("__digest"))
    return records.join(found, same, "left").withColumn("payload", F.coalesce("payload", "__payload")).drop("__payload", "__digest")


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Pages written to packages in the shared folder and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    packages = write_pages(pages, new_path(spark, "warc"))
    return read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY h)
SELECT page_id, strlen(p.h) AS payload_bytes, sha256(p.h) AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""
