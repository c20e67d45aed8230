"""How far the sources of a language differ in their terms, by systolic rotation.

A group (language, source) is a vector of term counts. Terms are dealt to shards, so a vector is as many compressed pieces as
its language has shards. A language's groups, the language itself among them as one more, sit in blocks. Blocks stay where
they are, in persisted partitions keyed by (language, shard, block); in each round of a round-robin tournament the compressed
vectors of every second block travel to the block that they meet, which evaluates all pairs of the meeting in both
directions. No round shuffles a resident, and a task holds two blocks of one shard. Sums of a shard are added at the end;
where the language itself is met, a heap keeps the shard's first terms, and heaps are merged by rank.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.llm.scratch import discard, written

SCALE, SMOOTH = 1_000_000_000, 5
#: About so many terms of a language in a shard, so a decoded vector of a shard is about 32 KiB.
SHARD_TERMS = 4096
#: A block has at least so many vectors, and about the square root of a language's: rounds grow with that root, too.
BLOCK = 8
#: A long text is cut between terms into pieces of about so many bytes; a task's counts are passed on when so many.
WINDOW, FLUSH = 1 << 20, 200_000

# A-Z to a-z; a-z and bytes of other characters as they are; the rest to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _windows(data: bytes) -> Iterator[list[bytes]]:
    data = data.translate(_FOLD)
    at = 0
    while at < len(data):
        to = data.find(b" ", at + WINDOW)
        to = len(data) if to < 0 else to
        yield data[at:to].split()
        at = to


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group and the documents (rows) that have it, over whole
    texts. Null languages, sources and texts are ''. Each group has a row with a null term, too. Tasks sum first, so
    a hot group is no hot key."""
    schema = "lang string, source string, term string, n long, docs long"

    def emit(n: dict, rows: dict) -> pa.RecordBatch:
        flat = [(g, t, c) for g, counts in n.items() for t, c in counts.items()]
        langs, sources = [[g[i] for g in n] + [g[i] for g, _, _ in flat] for i in (0, 1)]
        blank = [None] * len(n)
        terms = pa.array(blank + [t for _, t, _ in flat], pa.binary()).cast(pa.string())
        counts = pa.array([0] * len(n) + [c for _, _, c in flat], pa.int64())
        found = pa.array([0] * len(n) + [rows[g][t] for g, t, _ in flat], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()), terms, counts, found], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = {}
        rows: dict[tuple, Counter] = {}
        held = 0
        for batch in batches:
            for *group, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), strict=True):
                group = tuple(group)
                counts, own = n.setdefault(group, Counter()), rows.setdefault(group, Counter())
                held -= len(counts)
                seen: set[bytes] = set()
                for terms in _windows(text.as_py()):
                    counts.update(terms)
                    seen.update(terms)
                own.update(seen)
                held += len(counts)
                if held >= FLUSH:
                    yield emit(n, rows)
                    n, rows, held = {}, {}, 0
        if n:
            yield emit(n, rows)

    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    return read.mapInArrow(run, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# ---- vectors


def _pack(at: pa.Array, n: pa.Array) -> pa.Array:
    """Compresses a shard's vectors, lists of places in order and of their counts: steps from place to place, then counts."""
    squeeze = zstandard.ZstdCompressor(level=3)
    out = []
    for places, counts in zip(at, n, strict=True):
        places, counts = (np.asarray(x.values, dtype=np.int64) for x in (places, counts))
        out.append(squeeze.compress(np.concatenate([places[:1], np.diff(places), counts]).tobytes()))
    return pa.array(out, pa.binary())


def unpack(blob: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of a compressed vector; a null one is empty."""
    if blob is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    steps, n = np.frombuffer(zstandard.decompress(blob), dtype=np.int64).reshape(2, -1)
    return np.cumsum(steps), n


def share(n: np.ndarray | int, total: int) -> np.ndarray:
    """1 + floor(SCALE * n / total) exactly, for 0 <= n <= total: by long division in base 1000, as SCALE * n may need more
    than 64 bits; beyond 9e15 by Python's integers."""
    n = np.asarray(n, dtype=np.int64)
    if total >= 9 * 10**15:
        return np.array([1 + SCALE * int(x) // total for x in n.ravel()], dtype=np.int64).reshape(n.shape)
    out, rest = np.zeros_like(n), n
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


class Vectors:
    """The groups of a block in one shard, decoded: names, whether it is the language, counts, shares."""

    def __init__(self, rows: pa.Table):
        rows = rows.select(["source", "seat", "total", "width", "vector"]).to_pylist()
        self.names = [r["source"] for r in rows]
        self.field = [r["seat"] == 0 for r in rows]
        self.counts = np.zeros((len(rows), rows[0]["width"] if rows else 0), dtype=np.int64)
        self.shares = np.zeros_like(self.counts)
        for i, r in enumerate(rows):
            at, n = unpack(r["vector"])
            self.counts[i, at] = n
            if r["width"]:
                self.shares[i] = share(self.counts[i] + SMOOTH, r["total"])


_MET = "lang string, shard int, source string, item string, at int, value long"
_ARROW = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("source", pa.string()), ("item", pa.string()), ("at", pa.int32()), ("value", pa.int64())])


def _meet(key: tuple, here: Vectors, there: Vectors | None, top: int) -> pa.Table:
    """The rows of a meeting: of each pair of groups both directions, and of a group that meets the language its first terms.

    without there, here meets itself.
    """
    found: list[tuple] = []
    other = there or here
    if not other.names:
        return pa.table([[], [], [], [], [], []], schema=_ARROW)
    for i, name in enumerate(here.names):
        after = i + 1 if there is None else 0
        apart = np.abs(other.shares[after:] - here.shares[i]).sum(axis=1).tolist()
        for j, value in enumerate(apart, after):
            if here.field[i] or other.field[j]:
                side, k, base = (other, j, here.shares[i]) if here.field[i] else (here, i, other.shares[j])
                more = side.shares[k] - base
                heap = heapq.nsmallest(top, ((-int(more[t]), int(t)) for t in np.flatnonzero((more > 0) & (side.counts[k] > 0))))
                found += [(side.names[k], None, t, -v) for v, t in heap]
            else:
                found += [(name, other.names[j], None, value), (other.names[j], name, None, value)]
    cols = list(zip(*found, strict=True)) if found else [[], [], [], []]
    return pa.table([[key[0]] * len(found), [key[1]] * len(found), *cols], schema=_ARROW)


def opponent(block: Column, rounds: Column, nth: int) -> Column:
    """Whom a block meets in a round, from 0, of a tournament of an even number of blocks in rounds = blocks - 1 rounds."""
    last = rounds
    facing = F.pmod(F.lit(nth) - block, rounds)
    middle = F.pmod(F.lit(nth) * ((rounds + 1) / 2).cast("int"), rounds)
    return F.when(block == last, middle).when(facing == block, last).otherwise(facing).cast("int")


def host(a: Column, b: Column) -> Column:
    """Which block of a meeting stays where it is: by turns the lower and the higher, so all travel about as often."""
    return F.when((a + b) % 2 == 0, F.least(a, b)).otherwise(F.greatest(a, b))


# ---- the audit


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group (language, source) all other sources of its language by their
    distance to it (part pair), and the top terms that it has more of than its language (part term).

    A language keeps the terms that at least `least` of its documents have. A term's share of a group is 1 + floor(SCALE *
    (its count + SMOOTH) / (the group's count of kept terms + SMOOTH * kept terms)); a pair's value is the sum of the
    differences of the shares of all kept terms, 0 without any, a term's that of the group's and the language's. Ranks start
    from 1, larger values first, then smaller items in UTF-8.

    Null languages, sources and texts are ''; empty texts have no terms, but their group occurs. Repeated rows are documents
    of their own. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    counts = written(term_counts(docs, lang_col, source_col, text_col), "terms")
    own = counts.where("term IS NOT NULL")
    kept = own.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "term")
    kept = written(kept, "kept")
    langs = counts.select("lang").distinct().join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"))
    langs = langs.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("v") / SHARD_TERMS)).cast("int"))
    langs = written(langs, "langs")
    in_order = Window.partitionBy("lang", "shard").orderBy("term")
    placed = kept.join(langs, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), "shards").cast("int"))
    placed = written(placed.select("lang", "shard", "term", (F.row_number().over(in_order) - 1).alias("at")), "placed")

    # vectors of the sources, and of the languages with a null source
    sparse = own.join(placed, ["lang", "term"]).select("lang", "source", "shard", "at", "n")
    whole = sparse.groupBy("lang", "shard", "at").agg(F.sum("n").alias("n")).select("lang", F.lit(None).cast("string").alias("source"), "shard", "at", "n")
    entries = F.array_sort(F.collect_list(F.struct("at", "n"))).alias("e")  # at most a shard's terms
    lists = sparse.unionByName(whole).groupBy("lang", "source", "shard").agg(entries, F.sum("n").alias("n"))
    pack = F.arrow_udf(_pack, "binary")
    vectors = written(lists.select("lang", "source", "shard", "n", pack(F.col("e.at"), F.col("e.n")).alias("vector")), "vectors")

    # everyone's seat: 0 for the language, then its sources
    seats = counts.select("lang", "source").distinct().withColumn("seat", F.row_number().over(Window.partitionBy("lang").orderBy("source")))
    seats = seats.unionByName(langs.select("lang", F.lit(None).cast("string").alias("source"), F.lit(0).alias("seat")))
    sums = vectors.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    same = lambda a, b, *also: [a["lang"] == b["lang"], a["source"].eqNullSafe(b["source"]), *(a[c] == b[c] for c in also)]
    sizes = seats.groupBy("lang").agg(F.count("*").alias("players"))
    players = seats.join(sums, same(seats, sums), "left").select(seats["lang"], seats["source"], "seat", F.coalesce("n", F.lit(0)).alias("n")).join(langs, "lang").join(sizes, "lang")
    size = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt("players"))).cast("int")
    blocks = F.ceil(F.col("players") / size).cast("int")
    players = players.select("lang", "source", "seat", "shards", (F.col("n") + SMOOTH * F.col("v")).alias("total"), F.floor(F.col("seat") / size).cast("int").alias("block"), blocks.alias("blocks"), (blocks + blocks % 2 - 1).alias("rounds"))
    players = players.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    widths = placed.groupBy("lang", "shard").agg(F.count("*").cast("int").alias("width"))
    seated = players.join(vectors.drop("n"), same(players, vectors, "shard"), "left").select(players["lang"], players["shard"], "block", "blocks", "rounds", players["source"], "seat", "total", "vector")
    seated = written(seated.join(widths, ["lang", "shard"], "left").withColumn("width", F.coalesce("width", F.lit(0))), "seated")
    for done in (kept, vectors):
        discard(done)

    cell = ["lang", "shard", "block"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    resident = seated.repartition(parts, *cell).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        resident.count()  # once it is there, its partitioning is known and no round shuffles it
        met = [written(resident.groupBy(*cell).applyInArrow(lambda key, rows: _meet(_plain(key), Vectors(rows), None, top), _MET), "met")]
        rounds = seated.agg(F.max("rounds")).first()[0] or 0
        for nth in range(rounds):
            to = opponent(F.col("block"), F.col("rounds"), nth)
            travel = seated.where(F.col("rounds") > nth).withColumn("to", to).where((F.col("to") < F.col("blocks")) & (host(F.col("block"), F.col("to")) == F.col("to")))
            visitors = travel.withColumn("block", F.col("to")).drop("to").repartition(parts, *cell)
            both = resident.groupBy(*cell).cogroup(visitors.groupBy(*cell))
            met.append(written(both.applyInArrow(lambda key, a, b: _meet(_plain(key), Vectors(a), Vectors(b), top), _MET), "met"))
    finally:
        resident.unpersist()
    found = met[0]
    for more in met[1:]:
        found = found.unionByName(more)
    pairs = found.where("item IS NOT NULL").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    terms = found.where("at IS NOT NULL").join(placed, ["lang", "shard", "at"]).select("lang", "source", F.col("term").alias("item"), "value", F.lit("term").alias("part"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(ranked).alias("rank")
    out = [df.select("lang", "source", "part", "item", "value", rank) for df in (pairs, terms)]
    return out[0].unionByName(out[1].where(F.col("rank") <= top))


def _plain(key: tuple) -> tuple:
    return tuple(k.as_py() for k in key)


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language of documents, and the first 50 terms of each source."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_P = "1 + (1000000000::HUGEINT * (coalesce({n}, 0) + 5)) // ({total} + 5 * v)"

ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n, {_P.format(n="c.n", total="g.total")} AS p FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
lc AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM c GROUP BY lang, term),
q AS (SELECT lang, term, {_P.format(n="n", total="total")} AS q FROM lc JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) z ON z.lang = a.lang AND z.source = a.source AND z.item = b.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM u) WHERE part = 'pair' OR rank <= 50
"""
