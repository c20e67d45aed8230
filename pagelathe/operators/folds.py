"""Ordered per-key computations: admission, politeness, time-to-live deduplication, smoothing, control and breakers.

A Fold is a state machine over a key's rows in order. In batch, rows are dealt by key and sorted in their partition, and a
task holds the state of the key at hand, never a key's rows; streams keep the same state from batch to batch
(pagelathe.streaming.stateful). A fold takes whole columns of a key's run of rows and skips ahead where it can, so admission
and spacing cost a step for each admitted row, breakers one for each change of state.

Once a key has more than CHUNK_ROWS rows, rows are dealt by ranges of key and order instead, in parts of about that many, so
one key is spread over many tasks. A key's run in a part is digested to what the state at its end depends on (`brief`: a jump
table for spacing, else the compressed columns the fold reads); a task chains a key's digests, one piece of PIECE_ROWS at a
time, to the state at each part's begin; then all parts are folded side by side from there. Results are the same.

A row whose time or any of whose columns is null (or NaN) has a null output and leaves the state as it is. Rows with a null key
make one chain. Repeated rows are rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import pickle
import zlib
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

State = tuple
Columns = list[np.ndarray]

#: A key with more rows is folded in parts of about so many rows; a digest is passed on in pieces of so many.
CHUNK_ROWS, PIECE_ROWS = 1_000_000, 1024


class Fold(NamedTuple):
    """run(state, columns) gives the state after some rows of a key and an output for each; columns are numpy arrays.

    state is the DDL of the state, start its first value, kind the type of the outputs. expires(state) is the time, in the
    unit of the first column, after which the state equals start for any later row; None if it never does. brief(columns)
    digests the columns of a run to arrays of one length, and jump(state, pieces of them) gives the state after the run, piece
    by piece; by default the digest is the columns and the jump a run.
    """

    state: str
    start: State
    kind: str
    run: Callable[[State, Columns], tuple[State, list]]
    expires: Callable[[State], float | None] = lambda _: None
    brief: Callable[[Columns], Columns] | None = None
    jump: Callable[[State, Columns], State] | None = None


_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "bigint": pa.int64()}


def usable(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray | None:
    """Which rows have no null (or NaN) in columns; None if all have none."""
    lacking = [pc.is_null(batch.column(c), nan_is_null=True) for c in dict.fromkeys(columns)]
    lacking = [x.to_numpy(zero_copy_only=False) for x in lacking if x.true_count]
    return ~np.logical_or.reduce(lacking) if lacking else None


def _runs(batch: pa.RecordBatch, by: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """Values, begin and end of each run of equal values of the columns by."""
    encoded = [pc.run_end_encode(batch.column(c)) for c in by]
    ends = np.unique(np.concatenate([np.asarray(e.run_ends) for e in encoded])).tolist()
    values = [e.values.to_pylist() for e in encoded]
    stops = [np.asarray(e.run_ends) for e in encoded]
    begin = 0
    for end in ends:
        yield tuple(v[int(np.searchsorted(s, begin, "right"))] for v, s in zip(values, stops, strict=True)), begin, end
        begin = end


def _arrays(batch: pa.RecordBatch, columns: list[str], begin: int, end: int, valid: np.ndarray | None) -> Columns:
    found = [batch.column(c)[begin:end] for c in columns]
    if valid is not None:
        mask = pa.array(valid[begin:end])
        found = [c.filter(mask) for c in found]
    return [c.to_numpy(zero_copy_only=False) for c in found]


def _folded(batches: Iterator[pa.RecordBatch], by: list[str], name: str, time: str, columns: list[str], fold: Fold, out: str, entry: str | None = None) -> Iterator[pa.RecordBatch]:
    """(last of by, name, out) of sorted rows: fold over each run of equal by. A row with an entry gives the state to begin
    with and has no output."""
    at: Any = object()
    state = fold.start
    for batch in batches:
        if not batch.num_rows:
            continue
        if entry:
            entries = batch.column(entry)
            marks = pc.is_valid(entries).to_numpy(zero_copy_only=False)
        valid = usable(batch, [time, *columns])
        results: list = []
        kept: list[np.ndarray] = []
        for k, begin, end in _runs(batch, by):
            if k != at:
                at, state = k, fold.start
            if entry and marks[begin]:
                state, begin = tuple(json.loads(entries[begin].as_py())), begin + 1
            if entry:
                kept.append(np.arange(begin, end))
            state, found = fold.run(state, _arrays(batch, columns, begin, end, valid)) if begin < end else (state, [])
            if valid is None:
                results += found
            else:
                rest = iter(found)
                results += [next(rest) if v else None for v in valid[begin:end].tolist()]
        if entry:
            batch = batch.take(pa.array(np.concatenate(kept)))
        yield pa.RecordBatch.from_arrays([batch.column(by[-1]), batch.column(name), pa.array(results, _ARROW[fold.kind])], [by[-1], name, out])


def ordered(df: DataFrame, key: str, order: list[str], columns: list[str], fold: Fold, out: str) -> DataFrame:
    """(key, last of order, out): fold over each key's rows in order, given columns. Rows are counted by key first."""
    name = order[-1]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    picked = df.select(key, *order, *(c for c in columns if c not in order))
    total, most = picked.groupBy(key).agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    schema = f"`{key}` {types[key]}, `{name}` {types[name]}, `{out}` {fold.kind}"
    if (most or 0) <= CHUNK_ROWS:
        dealt = picked.repartition(F.col(key)).sortWithinPartitions(key, *order)
        return dealt.mapInArrow(lambda batches: _folded(batches, [key], name, order[0], columns, fold, out), schema)
    rows, entries, parts = _parted(picked, key, order, columns, fold, -(-total // CHUNK_ROWS))
    both = rows.withColumn("__entry", F.lit(None).cast("string")).unionByName(entries, allowMissingColumns=True)
    dealt = both.repartition(parts, "__part").sortWithinPartitions("__part", key, F.col("__entry").isNull(), *order)
    return dealt.mapInArrow(lambda batches: _folded(batches, ["__part", key], name, order[0], columns, fold, out, "__entry"), schema)


def _parted(picked: DataFrame, key: str, order: list[str], columns: list[str], fold: Fold, parts: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows with the part that they are in, and for each key that goes on from an earlier part its state at the part's begin
    (key, __part, __entry)."""
    from pagelathe.sources.stored import stored

    brief = fold.brief or (lambda x: x)
    jump = fold.jump or (lambda state, x: fold.run(state, x)[0])
    kinds = {f.name: f.dataType.simpleString() for f in picked.schema.fields}
    fields = picked.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows as they are, then the digests of the first and the last key of the part; those between lie within it."""
        at: Any = object()
        held: list[Columns] = []
        first, part, empty = True, None, None

        def digests(k: Any) -> Iterator[pa.RecordBatch]:
            arrays = brief([np.concatenate(x) for x in zip(*held, strict=True)])
            for nth, begin in enumerate(range(0, max(1, len(arrays[0])), PIECE_ROWS)):
                blob = zlib.compress(pickle.dumps([a[begin : begin + PIECE_ROWS] for a in arrays]), 1)
                found = {c: pa.nulls(1, empty.field(c).type) for c in fields} | {key: pa.array([k], empty.field(key).type), "__part": pa.array([part], pa.int32()), "__piece": pa.array([nth], pa.int32()), "__brief": pa.array([blob], pa.binary())}
                yield pa.RecordBatch.from_arrays(list(found.values()), list(found))

        for batch in batches:
            if not batch.num_rows:
                continue
            empty, part = batch.schema, batch.column("__part")[0].as_py()
            valid = usable(batch, [order[0], *columns])
            for (k,), begin, end in _runs(batch, [key]):
                if k != at:
                    if held and first:
                        yield from digests(at)
                        first = False
                    at, held = k, []
                held.append(_arrays(batch, columns, begin, end, valid))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields), batch.column("__part"), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], [*fields, "__part", "__piece", "__brief"])
        if held:
            yield from digests(at)

    ranged = picked.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).withColumn("__part", F.spark_partition_id())
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in fields) + ", __part int, __piece int, __brief binary"
    table = stored(ranged.mapInArrow(cut, schema), "parts")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: Any = object()
        state, inside = fold.start, None
        for batch in batches:
            found: list[tuple] = []
            for k, part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if k != at:
                    at, state, inside = k, fold.start, part
                if part != inside:
                    inside = part
                    found.append((k, part, json.dumps(state, default=lambda v: v.item())))
                state = jump(state, pickle.loads(zlib.decompress(blob.as_py())))
            cols = list(zip(*found, strict=True)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], [key, "__part", "__entry"])

    pieces = table.where("__piece IS NOT NULL").select(key, "__part", "__brief", "__piece")
    # digests of one key are chained in one task, a piece at a time
    sorted_ = pieces.repartition(F.col(key)).sortWithinPartitions(key, "__part", "__piece").drop("__piece")
    entries = stored(sorted_.mapInArrow(chain, f"`{key}` {kinds[key]}, __part int, __entry string"), "entries")
    return table.where("__piece IS NULL").drop("__piece", "__brief"), entries, parts


# ---- admission


def admission(us: int, most: int) -> Fold:
    """Greedy sliding window over times: admitted if fewer than most rows were admitted in the us microseconds before."""

    def run(s: State, columns: Columns) -> tuple[State, list]:
        t = columns[0]
        ok = np.zeros(len(t), dtype=bool)
        live, i = list(s[0]), 0
        while i < len(t):
            if len(live) >= most:  # the row after which the oldest of the last most admitted has left the window
                i = max(i, int(np.searchsorted(t, live[-most] + us, "left")))
                if i >= len(t):
                    break
            ok[i] = True
            live = [*live[-most + 1 :], int(t[i])] if most > 1 else [int(t[i])]
            i += 1
        return (live,), ok.tolist()

    return Fold("admitted array<bigint>", ([],), "boolean", run, lambda s: s[0][-1] + us if s[0] else None)


def spacing(us: int) -> Fold:
    """Allowed when us microseconds have passed since the last allowed row: politeness, or deduplication by key."""
    one = admission(us, 1)

    def run(s: State, columns: Columns) -> tuple[State, list]:
        (live,), ok = one.run(([] if s[0] is None else [s[0]],), columns)
        return (live[0] if live else None,), ok

    def brief(columns: Columns) -> Columns:
        """A jump table: for the rows that can be the first allowed one of a run, which lie within us of its begin, the time
        of the last allowed row then. Chains of allowed rows are followed by doubling; rows in a row that lead to the same
        end are one entry, with the last of them as time."""
        t = columns[0].astype(np.int64)
        n = len(t)
        if not n:
            return [t, t]
        onward = np.maximum(np.searchsorted(t, t + us, "left"), np.arange(n) + 1)
        end = np.where(onward < n, onward, np.arange(n))
        while True:
            further = end[end]
            if (further == end).all():
                break
            end = further
        some = min(n, int(np.searchsorted(t, t[0] + us, "left")) + 1)
        last = np.append(end[1:some] != end[: some - 1], True)
        return [t[:some][last], t[end[:some][last]]]

    def jump(s: State, pieces: Columns) -> State:
        at = 0 if s[0] is None else int(np.searchsorted(pieces[0], s[0] + us, "left"))
        return (int(pieces[1][at]),) if at < len(pieces[0]) else s

    return Fold("last bigint", (None,), "boolean", run, lambda s: None if s[0] is None else s[0] + us, brief, jump)


def _timed(df: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    return df.select(key, F.unix_micros(ts).alias("__t"), order)


def admit(df: DataFrame, key: str, ts: str, order: str, most: int, seconds: float = 1.0) -> DataFrame:
    """(key, order, ok) by admission."""
    return ordered(_timed(df, key, ts, order), key, ["__t", order], ["__t"], admission(int(seconds * 1e6), most), "ok")


def spaced(df: DataFrame, key: str, ts: str, order: str, seconds: float = 1.0) -> DataFrame:
    """(key, order, ok) by spacing; with the URL as key, deduplication with a time to live from the first sighting."""
    return ordered(_timed(df, key, ts, order), key, ["__t", order], ["__t"], spacing(int(seconds * 1e6)), "ok")


def waiting(us: int, most: int, timeout: int) -> Fold:
    """Microseconds that a row waits for a slot; null if that reaches timeout, and then it takes none.

    Rows queue in order. Each takes the first time, not before its own or the last one taken, at which fewer than most
    slots were taken in the us before; a slot counts from when it is taken.
    """

    def run(s: State, columns: Columns) -> tuple[State, list]:
        taken, out = list(s[0]), []
        for t in columns[0].tolist():
            at = max(t, taken[-1]) if taken else t
            if len(taken) >= most:
                at = max(at, taken[-most] + us)
            if at - t < timeout:
                taken = [*taken, at][-most:]
                out.append(at - t)
            else:
                out.append(None)
        return (taken,), out

    return Fold("taken array<bigint>", ([],), "bigint", run, lambda s: s[0][-1] + us if s[0] else None)


# ---- smoothing and control


def buckets(log: DataFrame, seconds: int, by: str = "domain") -> DataFrame:
    """Per key and time bucket: block, captcha and failure rates of a fetch log, by the outcome that holds first."""
    from pagelathe.operators.aggregates import outcome

    o = outcome(F.col("status_code"), F.col("challenge_type"))
    g = log.groupBy(by, F.floor(F.unix_micros("ts") / (seconds * 1_000_000)).alias("bucket"))
    rate = lambda k: (F.count_if(o == k) / F.count("*")).alias(k)
    return g.agg(rate("blocked"), rate("captcha"), rate("failed"))


def raw_ban(block: Column, captcha: Column, failure: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.4 * block + 0.4 * captcha + 0.2 * (failure * 0.5)))


def smoothing(keep: float = 0.7, start: float = 0.0) -> Fold:
    """keep of the score before and the rest of the new value."""

    def run(s: State, columns: Columns) -> tuple[State, list]:
        (score,), out = s, []
        for x in columns[-1].tolist():
            score = score * keep + x * (1 - keep)
            out.append(score)
        return (score,), out

    return Fold("score double", (start,), "double", run)


def control(dt: float = 10.0, target: float = 0.05, kp: float = 0.5, ki: float = 0.1, kd: float = 0.05, qps: float = 1.0, low: float = 0.1, high: float = 10.0, keep: float = 0.0) -> Fold:
    """Rate control toward a target block rate; the last two columns are the block rate and the ban score.

    With keep, the block rate is smoothed first. Errors under 0.05 leave the state as it is, also when the ban score would
    brake. The integral is kept in [-2, 2].
    """

    def run(s: State, columns: Columns) -> tuple[State, list]:
        (smooth, i, last, q), out = s, []
        for block, ban in zip(columns[-2].tolist(), columns[-1].tolist(), strict=True):
            smooth = smooth * keep + block * (1 - keep) if keep else block
            error = target - smooth
            if abs(error) >= 0.05:
                i = max(-2.0, min(2.0, i + error * dt))
                if ban > 0.7:
                    q = low
                else:
                    q = max(low, min(high, q + (kp * error + ki * i + kd * (error - last) / dt) * q))
                last = error
            out.append(q)
        return (smooth, i, last, q), out

    return Fold("smooth double, i double, last double, q double", (0.0, 0.0, 0.0, qps), "double", run)


def ema(df: DataFrame, key: str, order: str, value: Column, keep: float = 0.7, start: float = 0.0) -> DataFrame:
    """(key, order, score): smoothing along a key's buckets."""
    return ordered(df.select(key, order, value.alias("__x")), key, [order], ["__x"], smoothing(keep, start), "score")


def pid(df: DataFrame, key: str, order: str, block: Column, ban: Column, **settings: float) -> DataFrame:
    """(key, order, qps): control along a key's buckets."""
    return ordered(df.select(key, order, block.alias("__b"), ban.alias("__s")), key, [order], ["__b", "__s"], control(**settings), "qps")


def decayed_mean(df: DataFrame, key: str, ts: str, order: str, value: Column, keep: float, start: float, seconds: int = 3600) -> DataFrame:
    """(key, score): smoothing after the last row of each key, as a sum: a row weighs (1 - keep) * keep ** (rows after it).

    Rows are ranked within a time bucket only, and buckets by their counts, so a hot key is spread over its buckets.
    """
    bucket = F.floor(F.unix_micros(ts) / (seconds * 1_000_000))
    rows = df.select(key, F.col(ts).alias("__ts"), F.col(order).alias("__o"), bucket.alias("__b"), value.cast("double").alias("__x"))
    latest = Window.partitionBy(key, "__b").orderBy(F.desc("__ts"), F.desc("__o"))
    within = rows.withColumn("__after", F.row_number().over(latest) - 1)
    sums = within.groupBy(key, "__b").agg(F.count("*").alias("__n"), F.sum(F.lit(1 - keep) * F.pow(F.lit(keep), "__after") * F.col("__x")).alias("__s"))
    later = Window.partitionBy(key).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    shifted = sums.withColumn("__later", F.coalesce(F.sum("__n").over(later), F.lit(0)))
    total = F.sum(F.col("__s") * F.pow(F.lit(keep), "__later")) + F.lit(start) * F.pow(F.lit(keep), F.sum("__n"))
    return shifted.groupBy(key).agg(total.alias("score"))


# ---- breakers; the columns are the time in seconds and whether the row succeeded

_NAMES = np.array(["closed", "open", "half_open"], dtype=object)
_CLOSED, _OPEN, _HALF = range(3)


def _since(t: np.ndarray, begin: int, opened: float, cooldown: float) -> int:
    """The first row from begin at which cooldown has passed since opened."""
    at = max(begin, int(np.searchsorted(t, opened + cooldown, "left")))
    while at > begin and t[at - 1] - opened >= cooldown:
        at -= 1
    while at < len(t) and t[at] - opened < cooldown:
        at += 1
    return at


def _streaks(new: np.ndarray, carry: int) -> np.ndarray:
    """The place, from 1, of each row in its streak; new marks the first rows of streaks, carry is what the first row goes on
    from if it is not new."""
    n = np.arange(len(new))
    begin = np.maximum.accumulate(np.where(new, n, -1))
    return np.where(begin < 0, n + 1 + carry, n - begin + 1)


def _next(places: np.ndarray, begin: int, n: int) -> int:
    """The first of sorted places from begin, n without one."""
    at = int(np.searchsorted(places, begin, "left"))
    return int(places[at]) if at < len(places) else n


def domain_breaker(threshold: int = 10, cooldown: float = 60.0, probes: int = 3, forget: float = 3600.0) -> Fold:
    """A domain's breaker; the output is the state after the row.

    Each row first asks whether it may run; a row that may not leaves the state alone and gives "open". The first row after
    the cooldown is a probe that closes or opens again at once, so of probes one is ever needed. A success in the state that
    has never been set does not clear the failures; failures older than forget are forgotten when the next one comes later
    than that.
    """

    def run(s: State, columns: Columns) -> tuple[State, list]:
        state, failures, opened, tried, at = s
        t, ok = columns[0], columns[1].astype(bool)
        n, i = len(t), 0
        out = np.full(n, _CLOSED, dtype=np.int8)
        bad = np.flatnonzero(~ok)
        gaps = np.diff(t[bad]) > forget
        # the first failure goes on from the failures before, unless they are forgotten or, once closed, cleared
        fresh = len(bad) and at is not None and bool(t[bad[0]] - at > forget)
        hits = {}

        def streaks(unset: bool) -> np.ndarray:
            new = np.append(fresh or (not unset and bad[:1] > 0), gaps if unset else gaps | (np.diff(bad) > 1))[: len(bad)]
            return _streaks(new.astype(bool), failures_in)

        failures_in = failures
        while i < n:
            if state == "open":
                j = _since(t, i, opened, cooldown)
                out[i:j] = _OPEN
                if j < n:
                    if ok[j]:
                        state, failures = "closed", 0
                    else:
                        opened, out[j] = float(t[j]), _OPEN
                i = j + 1
                continue
            if state not in hits:
                counts = streaks(state is None)
                hits[state] = (counts, bad[counts >= threshold])
            counts, places = hits[state]
            j = _next(places, i, n)
            seen = int(np.searchsorted(bad, min(j, n - 1), "right"))  # failures up to the row that opens, or to the end
            if seen and bad[seen - 1] >= i:
                failures, at = int(counts[seen - 1]), float(t[bad[seen - 1]])
            if j < n:
                state, opened, out[j] = "open", float(t[j]), _OPEN
            elif state == "closed" and ok[n - 1]:
                failures = 0
            i = j + 1
        return (state, failures, opened, 0, at), _NAMES[out].tolist()

    return Fold("state string, failures int, opened double, probes int, at double", (None, 0, 0.0, 0, None), "string", run)


def lazy_breaker(threshold: int = 10, cooldown: float = 60.0) -> Fold:
    """A breaker that is evaluated after every row: half open closes once no failure stands."""

    def run(s: State, columns: Columns) -> tuple[State, list]:
        state, failures, opened = s
        t, ok = columns[0], columns[1].astype(bool)
        n, i = len(t), 0
        out = np.full(n, _CLOSED, dtype=np.int8)
        good, bad = np.flatnonzero(ok), np.flatnonzero(~ok)
        counts = _streaks(np.append(bad[:1] > 0, np.diff(bad) > 1)[: len(bad)], failures)
        hits = bad[counts >= threshold]
        while i < n:
            if state == "closed":
                j = _next(hits, i, n)
                if j < n:
                    state, opened, out[j] = "open", float(t[j]), _OPEN
            elif state == "open":
                j = _since(t, i, opened, cooldown)
                out[i:j] = _OPEN
                if j < n:
                    state, out[j] = "half_open", _HALF
            else:
                j = _next(good, i, n)
                out[i:j] = _HALF
                if j < n:
                    state = "closed"
            i = j + 1
        if n:
            failures = 0 if ok[n - 1] else int(counts[-1])
        return (state, failures, opened), _NAMES[out].tolist()

    return Fold("state string, failures int, opened double", ("closed", 0, 0.0), "string", run)


def component_breaker(threshold: int = 5, cooldown: float = 30.0) -> Fold:
    """A breaker in memory: open turns half open after the cooldown, any success closes it, and failures in half open
    never open it again."""

    def run(s: State, columns: Columns) -> tuple[State, list]:
        state, failures, opened = s
        t, ok = columns[0], columns[1].astype(bool)
        n, i = len(t), 0
        out = np.full(n, _CLOSED, dtype=np.int8)
        good, bad = np.flatnonzero(ok), np.flatnonzero(~ok)
        counts = _streaks(np.append(bad[:1] > 0, np.diff(bad) > 1)[: len(bad)], failures)
        hits = bad[counts >= threshold]
        while i < n:
            if state == "closed":
                j = _next(hits, i, n)
                if j < n:
                    state, opened, out[j] = "open", float(t[j]), _OPEN
            else:  # until the next success, half open from the end of the cooldown on
                j = _next(good, i, n)
                half = i if state == "half_open" else min(j, _since(t, i, opened, cooldown))
                out[i:half], out[half:j] = _OPEN, _HALF
                state = "closed" if j < n else "half_open" if half < n else "open"
            i = j + 1
        if n:
            failures = 0 if ok[n - 1] else int(counts[-1])
        return (state, failures, opened), _NAMES[out].tolist()

    return Fold("state string, failures int, opened double", ("closed", 0, 0.0), "string", run)


def aimd(most: float = 5.0, least: float = 1.0) -> Fold:
    """Concurrency: half a slot more after eight successes in a row, half of it after two failures in a row."""

    def run(s: State, columns: Columns) -> tuple[State, list]:
        now, good, bad = s
        ok = columns[-1].astype(bool)
        n = len(ok)
        if not n:
            return s, []
        begins = np.append(0, np.flatnonzero(ok[1:] != ok[:-1]) + 1)
        ends = np.append(begins[1:], n)
        need = np.where(ok[begins], 8, 2)
        # runs too short to change anything are skipped; the first goes on from the rows before
        places, values = [0], [now]
        for k in np.union1d(0, np.flatnonzero(ends - begins >= need)).tolist():
            up, step = bool(ok[begins[k]]), int(need[k])
            before = (good if up else bad) if k == 0 else 0
            for at in range(int(begins[k]) + step - before - 1, int(ends[k]), step):
                new = min(most, now + 0.5) if up else max(least, now / 2)
                if new == now:
                    break
                now = new
                places.append(at)
                values.append(now)
        length = int(ends[-1] - begins[-1])
        up = bool(ok[n - 1])
        total = length + ((good if up else bad) if len(begins) == 1 else 0)
        out = np.repeat(np.array(values), np.diff(np.append(places, n)))
        return (now, total % 8 if up else 0, 0 if up else total % 2), out.tolist()

    return Fold("slots double, good int, bad int", (most, 0, 0), "double", run)
