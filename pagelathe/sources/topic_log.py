"""A topic log: messages in topics and partitions with offsets, read and written as data source "topic_log".

A topic's partition is a folder of Parquet segments, named by the offset of their first message, how many they hold and the
write that made them. A write puts its segments aside, task by task; its commit gives them offsets and moves them into place, its
abort deletes them. A streaming write is known by its name and batch, so a batch that is committed again adds nothing. Readers
take whole or part segments in tasks; a streaming read has an offset for each partition, and commits what it has processed
under its group, from which queue_depth() tells what is pending. One write commits to a topic at a time.

    spark.dataSource.register(TopicLog)
    df.write.format("topic_log").option("path", p).mode("append").save()      # columns topic, value, and key if any
    spark.readStream.format("topic_log").option("path", p).option("topics", "high,low").load()

Options: path; topics (comma-separated, default all); partitions of new messages (default 4); group and max_poll (messages that a
micro-batch takes) of a streaming read; name of a streaming write. The path may be of any file system that pyarrow reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

SCHEMA = "topic string, partition int, offset bigint, key string, value string"
_ARROW = pa.schema([("topic", pa.string()), ("partition", pa.int32()), ("offset", pa.int64()), ("key", pa.string()), ("value", pa.string())])
#: A segment of a task's messages is closed at so many.
SEGMENT_ROWS = 100_000


class Segment(NamedTuple):
    """count messages of a topic's partition from offset start, in a file; made by a write."""

    topic: str
    partition: int
    start: int
    count: int
    by: str
    file: str


class Staged(WriterCommitMessage):
    """What a task has put aside: (topic, partition, count, file)."""

    def __init__(self, found: list[tuple[str, int, int, str]]):
        self.found = found


class Slice(InputPartition):
    """Messages from begin up to end, without it, of a segment."""

    def __init__(self, segment: Segment, begin: int, end: int):
        self.segment, self.begin, self.end = segment, begin, end


class Folder:
    """The files of a log."""

    def __init__(self, path: str):
        self.fs, self.root = fs.FileSystem.from_uri(path)
        self.root = self.root.rstrip("/")

    def _list(self, path: str) -> list[fs.FileInfo]:
        return self.fs.get_file_info(fs.FileSelector(path, allow_not_found=True))

    def topics(self) -> list[str]:
        return sorted(x.base_name for x in self._list(f"{self.root}/log") if x.type == fs.FileType.Directory)

    def segments(self, topic: str) -> list[Segment]:
        """Of all partitions, in order."""
        out = []
        for folder in self._list(f"{self.root}/log/{topic}"):
            for x in self._list(folder.path):
                start, count, by = x.base_name.removesuffix(".parquet").split("-", 2)
                out.append(Segment(topic, int(folder.base_name), int(start), int(count), by, x.path))
        return sorted(out)

    def ends(self, topics: list[str] | None) -> dict[str, int]:
        """The offset after the last message of each partition, by "topic/partition"."""
        return {f"{s.topic}/{s.partition}": s.start + s.count for t in topics or self.topics() for s in self.segments(t)}

    def read_json(self, name: str) -> dict | None:
        path = f"{self.root}/{name}"
        if self.fs.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def write_json(self, name: str, value: dict) -> None:
        """Written aside and moved, so readers see the old or the new."""
        path = f"{self.root}/{name}"
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        aside = f"{path}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(aside) as f:
            f.write(json.dumps(value).encode())
        self.fs.move(aside, path)

    def discard(self, run: str) -> None:
        path = f"{self.root}/staging/{run}"
        if self.fs.get_file_info(path).type == fs.FileType.Directory:
            self.fs.delete_dir(path)


# ---- writing


def _stage(folder: Folder, run: str, partitions: int, batches: Iterator[pa.RecordBatch]) -> Staged:
    """A task's messages as segments aside. A key decides the partition; without one the task and the row do, in turn."""
    context = TaskContext.get()
    task = f"{context.partitionId()}-{context.taskAttemptId()}" if context else uuid.uuid4().hex
    turn = context.partitionId() if context else 0
    writers: dict[tuple[str, int], tuple[pq.ParquetWriter, str, int]] = {}
    done: list[tuple[str, int, int, str]] = []
    schema = pa.schema([("key", pa.string()), ("value", pa.string())])

    def close(to: tuple[str, int]) -> None:
        writer, file, count = writers.pop(to)
        writer.close()
        done.append((*to, count, file))

    folder.fs.create_dir(f"{folder.root}/staging/{run}", recursive=True)
    for batch in batches:
        n = batch.num_rows
        keys = batch.column("key").cast(pa.string()) if "key" in batch.schema.names else pa.nulls(n, pa.string())
        values, topics = batch.column("value").cast(pa.string()), batch.column("topic").to_pylist()
        parts = [(turn + i if k is None else crc32(k.encode())) % partitions for i, k in enumerate(keys.to_pylist())]
        turn += n
        for to in sorted(set(zip(topics, parts, strict=True))):
            rows = pa.array([i for i, x in enumerate(zip(topics, parts, strict=True)) if x == to])
            if to not in writers:
                file = f"{folder.root}/staging/{run}/{task}-{len(done)}-{len(writers)}-{uuid.uuid4().hex}.parquet"
                writers[to] = (pq.ParquetWriter(file, schema, filesystem=folder.fs), file, 0)
            writer, file, count = writers[to]
            writer.write_batch(pa.RecordBatch.from_arrays([keys.take(rows), values.take(rows)], schema=schema))
            writers[to] = (writer, file, count + len(rows))
            if count + len(rows) >= SEGMENT_ROWS:
                close(to)
    for to in list(writers):
        close(to)
    return Staged(done)


def _publish(folder: Folder, run: str, by: str, messages: list) -> None:
    """Gives staged segments offsets and moves them into place. What this write has moved before is not moved again: segments
    bear the write's name and their place among its own."""
    found = sorted(x for m in messages if m is not None for x in m.found)
    for topic in sorted({x[0] for x in found}):
        there = folder.segments(topic)
        moved = {s.by for s in there}
        ends = {s.partition: s.start + s.count for s in there}
        for nth, (_, partition, count, file) in enumerate(x for x in found if x[0] == topic):
            name = f"{by}-{nth}"
            if name in moved:
                continue
            start = ends.get(partition, 0)
            folder.fs.create_dir(f"{folder.root}/log/{topic}/{partition}", recursive=True)
            folder.fs.move(file, f"{folder.root}/log/{topic}/{partition}/{start:020d}-{count}-{name}.parquet")
            ends[partition] = start + count
    folder.discard(run)


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.partitions, self.run = options["path"], int(options.get("partitions", 4)), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return _stage(Folder(self.path), self.run, self.partitions, iterator)

    def commit(self, messages: list) -> None:
        _publish(Folder(self.path), self.run, self.run, messages)

    def abort(self, messages: list) -> None:
        Folder(self.path).discard(self.run)


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        self.path, self.partitions, self.run, self.name = options["path"], int(options.get("partitions", 4)), uuid.uuid4().hex, options["name"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return _stage(Folder(self.path), self.run, self.partitions, iterator)

    def commit(self, messages: list, batchId: int) -> None:
        folder = Folder(self.path)
        mark = f"commits/{self.name}.json"
        if (folder.read_json(mark) or {"batch": -1})["batch"] >= batchId:  # committed before a restart
            folder.discard(self.run)
            return
        _publish(folder, self.run, f"{self.name}_{batchId}", messages)
        folder.write_json(mark, {"batch": batchId})

    def abort(self, messages: list, batchId: int) -> None:
        Folder(self.path).discard(self.run)


# ---- reading


def _read(path: str, part: Slice | None) -> Iterator[pa.RecordBatch]:
    """The messages of a slice; none for None, which stands for a log without segments."""
    if part is None:
        return
    s = part.segment
    at = s.start
    with pq.ParquetFile(s.file, filesystem=Folder(path).fs) as file:
        for batch in file.iter_batches(8192):
            begin, end = max(part.begin, at), min(part.end, at + batch.num_rows)
            if begin < end:
                own = batch.slice(begin - at, end - begin)
                n = own.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([s.topic] * n, pa.string()), pa.array([s.partition] * n, pa.int32()), pa.array(range(begin, end), pa.int64()), *own.columns], schema=_ARROW)
            at += batch.num_rows


def _topics(options: dict) -> list[str] | None:
    return [t.strip() for t in options["topics"].split(",")] if options.get("topics") else None


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.topics = options["path"], _topics(options)

    def partitions(self) -> list[Slice]:
        folder = Folder(self.path)
        return [Slice(s, s.start, s.start + s.count) for t in self.topics or folder.topics() for s in folder.segments(t)]

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)


class StreamReader(DataSourceStreamReader):
    """Offsets are {"topic/partition": next offset}; a partition that is not named is at 0."""

    def __init__(self, options: dict):
        self.path, self.topics, self.group = options["path"], _topics(options), options.get("group", "default")
        self.most = int(options.get("max_poll", 0))
        self.at = Folder(self.path).read_json(f"groups/{self.group}.json") or {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The ends of the partitions, or as far as max_poll messages lead from where the stream is, the same from each."""
        ends = Folder(self.path).ends(self.topics)
        pending = {p: end - self.at.get(p, 0) for p, end in ends.items() if end > self.at.get(p, 0)}
        if self.most and sum(pending.values()) > self.most:
            share, more = divmod(self.most, len(pending))
            ends |= {p: self.at.get(p, 0) + min(n, share + (i < more)) for i, (p, n) in enumerate(sorted(pending.items()))}
        return self.at | ends

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        self.at = {p: max(self.at.get(p, 0), n) for p, n in end.items()}
        out = []
        folder = Folder(self.path)
        for topic in sorted({p.rsplit("/", 1)[0] for p in end}):
            for s in folder.segments(topic):
                p = f"{topic}/{s.partition}"
                a, b = max(s.start, start.get(p, 0)), min(s.start + s.count, end.get(p, 0))
                if a < b:
                    out.append(Slice(s, a, b))
        return out

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)

    def commit(self, end: dict) -> None:
        """What is before end has been processed by the group."""
        folder = Folder(self.path)
        before = folder.read_json(f"groups/{self.group}.json") or {}
        folder.write_json(f"groups/{self.group}.json", {p: max(n, before.get(p, 0)) for p, n in (before | end).items()})


class TopicLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "topic_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("a topic log is only appended to")
        return Writer(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TopicLog)


def queue_depth(path: str, topic: str, group: str = "default") -> int:
    """Messages of a topic that a group has not committed, without the partitions of which it has committed none; 0 for an
    unknown topic, -1 for a group that has committed nothing at all."""
    folder = Folder(path)
    committed = folder.read_json(f"groups/{group}.json")
    if committed is None:
        return -1
    return sum(end - committed[p] for p, end in folder.ends([topic]).items() if p in committed)
