"""Packing into length buckets: boundaries by dynamic programming over the global histogram, then token-budget batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pagelathe.llm.scratch import BROADCAST_ROWS, written
from pagelathe.llm.words import blocks, spans

#: Longest sequence; a longer text gives several pieces, so the histogram has at most so many bins.
MAX_TOKENS = 2048
BUCKETS = 8
#: Padded tokens of a batch.
BUDGET = 65536
#: Rows that one window task ranks, about.
SHARD_ROWS = 4096


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [np.diff(spans(data, offsets)[2]) for _, data, offsets in blocks(batch.column(1))]
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], [batch.schema.names[0], "n_tokens"])


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens): words of the whole text; 0 for null."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_count_words, f"`{id_col}` {kind}, n_tokens long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The bucket lengths, ascending, that minimise the padding of counts[i] sequences of lengths[i] (ascending).

    best[k][j]: least padding of the first j lengths in k buckets. Of equal choices the one with the longest last
    bucket wins. Fewer buckets are returned if there are fewer lengths.
    """
    n = len(lengths)
    if not n:
        return []
    k_max = min(buckets, n)
    c = np.concatenate(([0], np.cumsum(counts, dtype=np.float64)))
    t = np.concatenate(([0], np.cumsum(counts.astype(np.float64) * lengths)))
    best = np.full(n + 1, np.inf)
    best[0] = 0
    back = np.zeros((k_max + 1, n + 1), dtype=np.int64)
    for k in range(1, k_max + 1):
        new = np.full(n + 1, np.inf)
        for j in range(k, n + 1):
            i = np.arange(k - 1, j)
            cost = best[i] + lengths[j - 1] * (c[j] - c[i]) - (t[j] - t[i])
            at = int(np.argmin(cost))
            new[j], back[k, j] = cost[at], i[at]
        best = new
    out, j = [], n
    for k in range(k_max, 0, -1):
        out.append(int(lengths[j - 1]))
        j = back[k, j]
    return out[::-1]


def pack(lengths: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Per piece: id, piece, start, n_tokens, bucket_len, batch.

    A text of more than max_tokens gives consecutive pieces of max_tokens and a rest; no token is lost. bucket_len is
    the padded length; batch numbers the batches of a bucket from 0, each of max(1, budget // bucket_len) pieces but
    for the last. Pieces are dealt by a hash of id and piece, ties by id, piece and length. A text without tokens (or
    a null length) gives one row with n_tokens 0, bucket_len 0 and a null batch. Null and repeated ids are packed as
    any row. An empty table gives an empty result.

    Only the histogram (at most max_tokens bins) comes to the driver. Ranks in a bucket come from shards of about
    SHARD_ROWS rows and the running count of the shards before, so no task sees a whole bucket.
    """
    n = F.coalesce(F.col(length_col).cast("long"), F.lit(0))
    piece = F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)), F.lit(max_tokens).cast("long")))
    pieces = lengths.select(F.col(id_col).alias("id"), n.alias("n"), piece.alias("piece", "start"))
    pieces = pieces.select("id", "piece", "start", F.least(F.col("n") - F.col("start"), F.lit(max_tokens)).alias("n_tokens"))
    pieces = written(pieces, "pieces")
    histogram = pieces.where("n_tokens > 0").groupBy("n_tokens").count().toPandas().sort_values("n_tokens")
    sizes, counts = histogram["n_tokens"].to_numpy(), histogram["count"].to_numpy()
    ends = boundaries(sizes, counts, buckets)
    bucket, room, shards = F.lit(0), F.lit(1), F.lit(1)
    low = 0
    for end in ends:
        inside = int(counts[(sizes > low) & (sizes <= end)].sum())
        here = (F.col("n_tokens") > low) & (F.col("n_tokens") <= end)
        bucket = F.when(here, end).otherwise(bucket)
        room = F.when(here, max(1, budget // end)).otherwise(room)
        shards = F.when(here, -(-inside // SHARD_ROWS)).otherwise(shards)
        low = end
    dealt = F.xxhash64("id", "piece")
    placed = pieces.where("n_tokens > 0").select("*", bucket.alias("bucket_len"), room.alias("room"), F.pmod(dealt, shards).alias("shard"), dealt.alias("dealt"))
    totals = placed.groupBy("bucket_len", "shard").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("bucket_len").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("bucket_len", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    if int(counts.sum()) // SHARD_ROWS + len(ends) <= BROADCAST_ROWS:
        totals = F.broadcast(totals)
    rank = F.row_number().over(Window.partitionBy("bucket_len", "shard").orderBy("dealt", "id", "piece", "n_tokens"))
    ranked = placed.withColumn("rank", rank).join(totals, ["bucket_len", "shard"])
    batch = F.floor((F.col("before") + F.col("rank") - 1) / F.col("room")).cast("long")
    full = ranked.select(F.col("id").alias(id_col), "piece", "start", "n_tokens", F.col("bucket_len").cast("int").alias("bucket_len"), batch.alias("batch"))
    empty = pieces.where("n_tokens <= 0").select(F.col("id").alias(id_col), "piece", "start", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).alias("bucket_len"), F.lit(None).cast("long").alias("batch"))
    return full.unionByName(empty)


def op1_pack(spark, sf_dir: str) -> DataFrame:
    """Batches of the words of documents."""
    return pack(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
