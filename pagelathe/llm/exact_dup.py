"""Exact deduplication by 128-bit content hash, with the bytes compared inside every group.

DataFrame functions only. The hash table carries no text. Texts are shuffled only for hashes that occur more than
once, grouped by (hash, text) so that each task sends a text once however many copies it holds; grouping by the text
itself is the byte comparison. Should two texts share a hash, their rows are told apart by text in a second branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.scratch import BROADCAST_ROWS, by_ids, discard, sized, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: Column) -> Column:
    """Null as empty, and A-Z in lower case. Texts of ASCII only take the faster lower()."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


#: A table of hashes is broadcast up to so many rows.
HASH_ROWS = BROADCAST_ROWS // 4


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256. Equal texts are those identical in normal() form.

    keep says whether the smallest or the largest id of a group stays. Null texts equal empty ones. A null id counts in
    group_size and stays only if its group has no other (keep_id is then null). Rows repeated with the id that stays
    are all marked kept. An empty table gives an empty result; other columns are not read.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("id"), normal(F.col(text_col)).alias("norm"))
    hashed = written(rows.select("id", F.unhex(F.md5("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha")), "hashes")
    several = written(hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "several")
    n_several = several.count()
    copies = rows.select("id", "norm", F.unhex(F.md5("norm")).alias("h")).join(sized(several.withColumnRenamed("h", "__h"), n_several, HASH_ROWS), F.col("h") == F.col("__h"), "left_semi")
    # one row for each distinct text among them; variants > 1 only where different bytes share a hash
    classes = copies.groupBy("h", "norm").agg(pick("id").alias("keep_id"), F.count("*").alias("group_size"))
    classes = classes.groupBy("h").agg(pick("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("variants"))
    classes = written(classes, "classes")
    plain = classes.where("variants = 1").select("h", "keep_id", "group_size")
    collided = classes.where("variants > 1").select("h")
    out = hashed
    n_collided = collided.count()
    if not n_collided:
        discard(several)
    else:
        out = hashed.join(sized(collided, n_collided, HASH_ROWS), "h", "left_anti")
    out = out.join(sized(plain, n_several, HASH_ROWS), "h", "left").select("id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.lower(F.hex("sha")).alias("text_sha256"))
    if n_collided:
        split = copies.join(sized(collided, n_collided, HASH_ROWS), "h", "left_semi")
        by_text = split.groupBy("h", "norm").agg(pick("id").alias("keep_id"), F.count("*").alias("group_size"))
        out = out.unionByName(split.join(by_text, ["h", "norm"]).select("id", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256")))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of docs, all columns, with one row left of each group of equal texts.

    Rows repeated with the same id and text leave one row; those with a null id leave one where no other row of their
    group has an id. An id on several texts is judged text by text, so a text that stands nowhere else stays.
    """
    found = written(exact_groups(docs, id_col, text_col, keep), "exact")
    own = found.where(F.col(id_col).isNotNull())
    # ids that need their texts looked at: those on several rows of which some stay
    odd = written(own.groupBy(id_col).agg(F.count("*").alias("n"), F.bool_or("kept").alias("stays")).where("n > 1 AND stays").select(id_col), "odd")
    n_odd, blank = odd.count(), found.where(F.col(id_col).isNull()).limit(1).count()
    gone = written(own.where(~F.col("kept")).select(id_col).distinct(), "gone")
    if not n_odd and not blank:
        return by_ids(docs, id_col, gone, "left_anti")
    sha = F.sha2(normal(F.col(text_col)), 256)
    plain = by_ids(docs.where(F.col(id_col).isNotNull()), id_col, written(gone.union(odd).distinct(), "gone"), "left_anti")
    # a kept row stands for its text: by id and text where it has an id, by text alone where it has none
    kept = by_ids(own.where("kept"), id_col, odd, "left_semi", n_odd).select(F.col(id_col).alias("__pl_id"), F.col("text_sha256").alias("__pl_text")).distinct()
    some = by_ids(docs.where(F.col(id_col).isNotNull()), id_col, odd, "left_semi", n_odd).withColumn("__pl_sha", sha)
    parts = [some.join(kept, (F.col(id_col) == F.col("__pl_id")) & (F.col("__pl_sha") == F.col("__pl_text")), "left_semi")]
    if blank:
        alone = found.where("keep_id IS NULL").select(F.col("text_sha256").alias("__pl_text")).distinct()
        nameless = docs.where(F.col(id_col).isNull()).withColumn("__pl_sha", sha)
        parts.append(nameless.join(alone, F.col("__pl_sha") == F.col("__pl_text"), "left_semi"))
    out = plain
    for part in parts:
        out = out.unionByName(part.dropDuplicates([id_col, "__pl_sha"]).drop("__pl_sha"))
    return out


def op3_exact_dup(spark, sf_dir: str) -> DataFrame:
    """Groups of equal texts of documents, the largest doc_id staying."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="max")


ORACLE = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, false) AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""
