"""Near-duplicate detection: MinHash banding, sequential Bayesian verification, exact verification of survivors.

1. Each text becomes its set of word shingles (pagelathe.llm.words), a 128-bit key of that set and a MinHash
   signature. Texts with the same set form a class; only the class's smallest id goes on.
2. The signature is cut into bands. Members of a bucket are compared with the bucket's smallest id (a star), which
   costs a row for each member, never all pairs of a bucket.
3. A candidate pair's signatures are compared batch by batch. After n hashes with m agreements and a uniform prior,
   similarity follows Beta(m + 1, n - m + 1); P(similarity >= threshold) equals the binomial tail
   P(Bin(n + 1, threshold) <= m). A pair goes when that falls below the chosen miss probability.
4. Survivors are verified on the full shingle sets of the whole texts.
5. Links give components. Buckets of three or more whose members still lie in different components are compared across
   components: members outside the component of the bucket's center against all members, in a grid of blocks of the former
   by blocks of the latter, so m members of which k lie outside take about m * k / BLOCK rows twice and no square of m. Blocks
   first carry signatures only, and give back the members that have a plausible partner in another component; a pair counts
   only in the first band where it agrees. Texts are fetched for those members alone, in parts of at most PART_SHINGLES on
   each side (or one text), and their pairs verified on the full sets, likeliest first; a link is returned for each pair of
   components that it joins, and once joined, further pairs between them need no check. Nothing is capped, and no pair is
   emitted that isn't a link.

Sets are of 64-bit hashes of shingles, so "exact" is up to a collision of two shingles in one pair of texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.graph import components
from pagelathe.llm.scratch import BROADCAST_ROWS, by_ids, discard, sized, written
from pagelathe.llm.words import common, mix, shingle_sets

#: Bands and hashes in a band. At similarity 0.8 a pair shares no band with probability (1 - 0.8**5)**32 = 3e-6.
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Hashes compared at a time, and the probability of dropping a pair that reaches the threshold, for each batch.
BATCH, MISS = 32, 1e-6
#: Members of an unresolved bucket on each side of a block of comparisons.
BLOCK = 1024
#: Shingles of the texts on each side of a part of a block in which texts are compared; a longer text is a side of its own.
PART_SHINGLES = 2_000_000
#: Buckets with more members than this get their center by a broadcast.
LARGE = 1000
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 2**63, HASHES, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima, upper 32 bits each, of a non-empty set of 64-bit hashes."""
    low = None
    for at in range(0, len(shingles), 512):
        x = np.multiply.outer(shingles[at : at + 512], _A)
        x += _B
        m = x.min(axis=0)
        low = m if low is None else np.minimum(low, m)
    return (low >> np.uint64(32)).astype("<u4")


@lru_cache(maxsize=64)
def fewest(n: int, num: int, den: int, miss: float) -> int:
    """The smallest m for which P(similarity >= num/den | m of n agree) is at least miss."""
    t = num / den
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def plausible(a: np.ndarray, b: np.ndarray, num: int, den: int, miss: float) -> np.ndarray:
    """Which rows of two signature matrices survive the sequential test; later batches are read for survivors only."""
    alive = np.arange(len(a))
    agree = np.zeros(len(a), dtype=np.int64)
    for at in range(0, HASHES, BATCH):
        if not len(alive):
            break
        to = min(HASHES, at + BATCH)
        agree = agree + (a[alive, at:to] == b[alive, at:to]).sum(axis=1)
        ok = agree >= fewest(to, num, den, miss)
        alive, agree = alive[ok], agree[ok]
    return alive


def _matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.frombuffer(b"".join(col.to_pylist()), dtype="<u4").reshape(-1, HASHES)


def _sketcher(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, keys, sigs = [], [], []
                for s in shingle_sets(part.column(1), n_words):
                    sizes.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sigs.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["id", "n_shingles", "key", "sig"])
        pa.default_memory_pool().release_unused()

    return run


def _pruner(num: int, den: int, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alive = plausible(_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b")), num, den, miss)
                yield batch.select(["a", "b"]).take(pa.array(alive))

    return run


def _verifier(n_words: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                # a hub's text stands in many neighbouring rows: it is shingled once in a slice
                texts, index = {}, {}
                for side in ("text_a", "text_b"):
                    index[side] = [texts.setdefault(t, len(texts)) for t in part.column(side).to_pylist()]
                sets = list(shingle_sets(pa.array(list(texts), pa.string()), n_words))
                for k, (i, j) in enumerate(zip(index["text_a"], index["text_b"], strict=True)):
                    x, y = sets[i], sets[j]
                    if den * min(len(x), len(y)) >= num * max(len(x), len(y)):
                        both = common(x, y)
                        if den * both >= num * (len(x) + len(y) - both):
                            keep.append(at + k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
        pa.default_memory_pool().release_unused()

    return run


def _block_pairs(block: pa.Table, num: int, den: int, miss: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Plausible pairs across components in a block of a bucket, with the hashes that agree: columns asks, id, label, main,
    center, band, sig.

    Those that ask lie outside the component of the bucket's center, and are compared with those that don't ask: members of
    all components.
    """
    sig = _matrix(block.column("sig"))
    ids, labels, main, center, asks = (block.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "main", "center", "asks"))
    band = block.column("band")[0].as_py()
    minor = labels != main
    left, right, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero(asks):
        # the center has been compared with all; of two members that both ask only the smaller id does
        other = np.flatnonzero(~asks & (labels != labels[i]) & (ids != center) & (~minor | (ids > ids[i])))
        agree = np.zeros(len(other), dtype=np.int64)
        for at in range(0, HASHES, BATCH):
            if not len(other):
                break
            to = min(HASHES, at + BATCH)
            agree = agree + (sig[other, at:to] == sig[i, at:to]).sum(axis=1)
            ok = agree >= fewest(to, num, den, miss)
            other, agree = other[ok], agree[ok]
        if len(other) and band:
            head = band * ROWS
            ok = ~(sig[other, :head] == sig[i, :head]).reshape(len(other), band, ROWS).all(axis=2).any(axis=1)
            other, agree = other[ok], agree[ok]
        left.append(np.full(len(other), i))
        right.append(other)
        score.append(agree)
    return np.concatenate(left), np.concatenate(right), np.concatenate(score)


def _parts(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each row the part of its side that it falls into: runs of the distinct rows with at most PART_SHINGLES together."""
    own = np.unique(rows)
    part, total, parts = 0, 0, np.zeros(len(own), np.int64)
    for k, n in enumerate(sizes[own].tolist()):
        if total and total + n > PART_SHINGLES:
            part, total = part + 1, 0
        total += n
        parts[k] = part
    return parts[np.searchsorted(own, rows)]


def _block_members(num: int, den: int, miss: float):
    """The rows of a block that stand in a plausible pair, in each part of the block that has pairs of theirs."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        left, right, _ = _block_pairs(block, num, den, miss)
        sizes = block.column("n_shingles").to_numpy()
        p, q = _parts(left, sizes), _parts(right, sizes)
        rows, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part in np.unique(p * (1 << 31) + q):
            own = p * (1 << 31) + q == part
            found = np.unique(np.concatenate((left[own], right[own])))
            rows.append(found)
            parts.append(np.full(len(found), part))
        return block.take(pa.array(np.concatenate(rows))).append_column("part", pa.array(np.concatenate(parts), pa.int64()))

    return run


def _block_linker(n_words: int, num: int, den: int, miss: float):
    """Links that join components within a part of a block, given its rows of _block_members with their texts."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        ids, labels = (block.column(c).to_numpy() for c in ("id", "label"))
        left, right, score = _block_pairs(block, num, den, miss)
        sets = list(shingle_sets(block.column("text"), n_words))
        found: list[tuple[int, int]] = []
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while x in root:
                x = root[x]
            return x

        for k in np.argsort(-score, kind="stable").tolist():
            i, j = int(left[k]), int(right[k])
            a, b = find(int(labels[i])), find(int(labels[j]))
            if a != b:
                x, y = sets[i], sets[j]
                if den * min(len(x), len(y)) >= num * max(len(x), len(y)):
                    both = common(x, y)
                    if den * both >= num * (len(x) + len(y) - both):
                        root[max(a, b)] = min(a, b)
                        found.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _grid(open_: DataFrame) -> DataFrame:
    """The members of open buckets (m of them, k outside the center's component) in the cells of a grid: those outside as such
    that ask, in one row of cells, and all as such that are asked, in one column."""
    rows, cols = F.ceil(F.col("k") / BLOCK).cast("int"), F.ceil(F.col("m") / BLOCK).cast("int")
    place = F.xxhash64("id")
    members = open_.select("bucket", "band", "id", "center", "label", "main", rows.alias("rows"), cols.alias("cols"))
    asking = members.where("label != main").withColumns({"asks": F.lit(True), "row": F.pmod(place, "rows").cast("int"), "col": F.explode(F.sequence(F.lit(0), F.col("cols") - 1))})
    asked = members.withColumns({"asks": F.lit(False), "row": F.explode(F.sequence(F.lit(0), F.col("rows") - 1)), "col": F.pmod(place, "cols").cast("int")})
    return asking.unionByName(asked).drop("rows", "cols")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, num: int = 80, den: int = 100, miss: float = MISS) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept. Two texts are linked when den * |A & B| >= num * |A | B|.

    component_id is the smallest id that links reach, itself included; kept tells whether it is the row's own id.
    Null and empty texts, and those without words, have n_shingles 0 and are linked with nothing. A row with a null
    id gets a null component, is linked with nothing and is kept. Rows of one id are one document, so if their texts
    differ they lie in one component, which has the links of all of them; if it is theirs, all are kept. An empty table
    gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = written(rows.mapInArrow(_sketcher(n_words), "id long, n_shingles long, key binary, sig binary"), "sketch")
    usable = sketch.where("key IS NOT NULL AND id IS NOT NULL")
    reps = written(usable.groupBy("key").agg(F.min(F.struct("id", "sig", "n_shingles")).alias("r")).select("key", "r.id", "r.sig", "r.n_shingles"), "reps")
    n_reps = reps.count()
    bands = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * (4 * ROWS) + 1, F.lit(4 * ROWS)))))
    bands = reps.select("id", bands.alias("band", "bucket"))
    centers = written(bands.groupBy("bucket").agg(F.min("id").alias("center"), F.count("*").alias("m")).where("m > 1"), "centers")
    # members of large buckets find their center by a broadcast of those few, so that none is gathered in one task
    large = centers.where(F.col("m") > LARGE)
    n_large = large.count()
    if n_large > BROADCAST_ROWS:
        shared = bands.join(centers, "bucket")
    elif n_large:
        large = F.broadcast(large)
        shared = bands.join(large, "bucket").unionByName(bands.join(large.select("bucket"), "bucket", "left_anti").join(centers.where(F.col("m") <= LARGE), "bucket"))
    else:
        shared = bands.join(centers, "bucket")
    shared = written(shared.select("bucket", "id", "band", "center", "m"), "buckets")
    discard(centers)

    def texts_of(ids: DataFrame) -> DataFrame:
        return written(by_ids(rows, "id", ids, "left_semi").dropDuplicates(["id", "text"]), "texts")

    # stars
    star = shared.where("id != center").groupBy(F.col("center").alias("a"), F.col("id").alias("b")).agg(F.lit(1).alias("one")).select("a", "b")
    signed = star.join(reps.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b").join(reps.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")
    alive = written(signed.select("a", "b", "sig_a", "sig_b").mapInArrow(_pruner(num, den, miss), "a long, b long"), "alive")
    nodes = written(alive.select(F.col("a").alias("id")).union(alive.select("b")).distinct(), "nodes")
    texts = texts_of(nodes)
    full = alive.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
    links = full.select("a", "b", "text_a", "text_b").mapInArrow(_verifier(n_words, num, den), "a long, b long")
    # an id whose texts differ ties their classes together
    several = written(usable.groupBy("id").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x != y").select("id"), "several")
    n_several = several.count()
    if n_several:
        own = usable.select("id", "key").join(sized(several, n_several), "id").join(reps.select("key", F.col("id").alias("rep")), "key")
        links = links.unionByName(own.where("id != rep").select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b")))
    links = written(links, "links")
    for x in (texts, nodes, alive, several):
        discard(x)
    labels = components(links)

    # buckets that still hold several components
    n_labels = labels.count()
    named = shared.where("m > 2").join(sized(labels.toDF("id", "label"), n_labels), "id", "left").select("bucket", "band", "id", "center", "m", F.coalesce("label", "id").alias("label"))
    by_label = named.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.bool_or(F.col("id") == F.col("center")).alias("is_main"), F.max("m").alias("m"))
    main = F.max(F.when(F.col("is_main"), F.col("label"))).alias("main")
    split = by_label.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), main, F.max("m").alias("size"), F.sum(F.when(F.col("is_main"), 0).otherwise(F.col("n"))).alias("k"))
    split = written(split.where("lo != hi").select("bucket", "main", "size", "k"), "split")
    n_large = split.where(F.col("size") > LARGE).count()
    if 0 < n_large <= BROADCAST_ROWS:
        sides = [(named.where(F.col("m") > LARGE), F.broadcast(split.where(F.col("size") > LARGE))), (named.where(F.col("m") <= LARGE), split.where(F.col("size") <= LARGE))]
    else:
        sides = [(named, split)]
    open_ = written(reduce(DataFrame.unionByName, [x.join(y.drop("size"), "bucket") for x, y in sides]), "open")
    discard(split)
    if open_.limit(1).count():
        laid = _grid(open_).join(reps.select("id", "sig", "n_shingles"), "id")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in laid.schema.fields) + ", part long"
        members = written(laid.groupBy("bucket", "row", "col").applyInArrow(_block_members(num, den, miss), schema), "members")
        texts = texts_of(members.select("id").distinct())
        fresh = members.join(texts, "id").groupBy("bucket", "row", "col", "part").applyInArrow(_block_linker(n_words, num, den, miss), "a long, b long")
        links = written(links.unionByName(fresh), "links")
        for x in (members, texts):
            discard(x)
        labels = components(links)
    discard(open_)
    discard(shared)
    n_labels = labels.count()
    of = reps.select("key", F.col("id").alias("rep")).join(sized(labels.toDF("rep", "label"), n_labels), "rep", "left").select("key", F.coalesce("label", "rep").alias("label"))
    component = F.coalesce("label", "id")
    columns = [F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")]
    # rows that are linked with nothing don't take part in the join
    inner = usable.select("id", "n_shingles", "key").join(sized(of, n_reps), "key", "left").select(*columns)
    alone = sketch.where("key IS NULL OR id IS NULL").select("id", "n_shingles", F.lit(None).cast("long").alias("label")).select(*columns)
    return inner.unionByName(alone)


def op2_near_dup(spark, sf_dir: str) -> DataFrame:
    """Components of documents at 2-word shingles and similarity 0.8: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n_words=2)
