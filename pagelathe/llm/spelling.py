"""Spelling variants by anagram hashing.

A letter has a value and a word's key is the sum of its letters' values, each the fifth power of the letter's rank, so
anagrams share a key and one letter added, removed or exchanged changes it by the values of the letters concerned. Each word
is put down under its key and under its key less the value of each of its letters: two words meet there when their keys
differ by one letter's value (addition, removal) or by the difference of two (exchange). One changed letter leaves either
the first or the last half of what remains in order, so that half is part of the join's key; the order of the other letters is
verified on the pairs that meet.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.scratch import discard, written

#: Letters are a-z, ranked from 1, and U+00C0 to U+00FF, ranked after z.
FIRST_ACCENTED = 0xC0
#: What a letter's rank is raised to.
POWER = 5
#: A long text is cut between words into pieces of about so many code points, and a task's counts are passed on when they
#: are so many.
WINDOW, FLUSH = 1 << 20, 200_000

# One byte a code point: A-Z to a-z, letters as they are, all else to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= FIRST_ACCENTED else 32 for c in range(256))


def _windows(text: str) -> Iterator[bytes]:
    """The runs of letters of a text, one byte a letter and spaces between, in pieces cut between runs."""
    data = text.encode("latin-1", "replace").translate(_FOLD)
    at = 0
    while at < len(data):
        to = data.find(b" ", at + WINDOW)
        to = len(data) if to < 0 else to
        yield data[at:to]
        at = to


def _utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1, drop: int = 0) -> DataFrame:
    """(word, n): occurrences of the words of at least `least` letters over whole texts, lower-cased in A-Z only.

    With drop, a word whose crc32 of `<id>:<word>` is divisible by drop loses the letter at that number modulo its length:
    planted misspellings, the same in every run. A null id counts as an empty one. Null and empty texts have no words; rows
    repeated count again. Tasks sum before they shuffle and hold no more than a window's words and FLUSH counts.
    """

    def emit(counts: Counter) -> pa.RecordBatch:
        words = pa.array([_utf8(w) for w in counts], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                prefix = crc32(f"{'' if key is None else key}:".encode())
                for window in _windows(text):
                    for word, n in Counter(window.split()).items():
                        if drop:
                            h = crc32(_utf8(word), prefix)
                            if h % drop == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                        if len(word) >= least:
                            total[word] += n
                    if len(total) >= FLUSH:
                        yield emit(total)
                        total.clear()
        if total:
            yield emit(total)

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_value(letter: Column) -> Column:
    c = F.ascii(letter)
    rank = F.when(c < FIRST_ACCENTED, c - 96).otherwise(c - FIRST_ACCENTED + 27).cast("long")
    value = rank
    for _ in range(POWER - 1):
        value = value * rank
    return value


def anagram_keys(words: DataFrame) -> DataFrame:
    """(word, n, gone, rest, size, side, half): a row for each letter that may go, none included, and each half.

    rest is the key of the letters that remain, size their number; half holds the first (side 0) or last (side 1) size / 2
    letters of the word. A word has at most 2 * 91 rows, one for each letter of the alphabet that it has.
    """
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    keyed = words.select("word", "n", F.length("word").alias("len"), F.array_distinct(letters).alias("letters"), F.aggregate(letters, F.lit(0).cast("long"), lambda a, c: a + letter_value(c)).alias("key"))
    gone = keyed.select("word", "n", "len", "key", F.explode(F.concat(F.array(F.lit("")), "letters")).alias("gone"))
    kept = F.col("gone") == ""
    gone = gone.select("word", "n", "len", "gone", (F.col("key") - F.when(kept, F.lit(0)).otherwise(letter_value(F.col("gone")))).alias("rest"), (F.col("len") - F.when(kept, 0).otherwise(1)).alias("size"))
    h = F.floor(F.col("size") / 2).cast("int")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), h).alias("half")), F.struct(F.lit(1).alias("side"), F.substring("word", F.col("len") - h + 1, h).alias("half")))
    return gone.withColumn("s", F.explode(sides)).select("word", "n", "gone", "rest", "size", F.col("s.side").alias("side"), F.col("s.half").alias("half"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n), a before b: the pairs of words that differ by exactly one letter added, removed or exchanged.

    The fifth powers of the ranks have distinct differences, so a pair meets under one key only, and on side 1 it counts only
    where the first halves differ. Words that meet but have their letters in another order are dropped inside the join.
    """
    keys = anagram_keys(words)
    a, b = keys.alias("a"), keys.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("rest", "size", "side", "half")]
    h = F.floor(F.col("a.size") / 2).cast("int")
    once = (F.col("a.side") == 0) | (F.substring("a.word", F.lit(1), h) != F.substring("b.word", F.lit(1), h))
    ordered = (F.col("a.word") < F.col("b.word")) & (F.col("a.gone") != F.col("b.gone")) & once & (F.levenshtein("a.word", "b.word", 1) == 1)
    met = same[0]
    for c in [*same[1:], ordered]:
        met = met & c
    return a.join(b, met).select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n"))


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """words(word, n) as (word, form, root, n, n_near, form_n).

    form is a word's near word of largest n, of equal ones the smallest in code-point order, if its n is at least ratio (over
    1) times the word's; root is where forms lead. Each form has ratio times its word's n, so there are no cycles and chains
    are short: roots are found by doubling, in a number of rounds that grows with the logarithm of the chain.
    Words with other letters than a-z and U+00C0 to U+00FF have no near words; null and empty words are dropped; rows
    repeated with a word are summed. An empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, or forms could lead in a circle")
    words = written(words.where(F.length("word") > 0).groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    pairs = near_pairs(words.where(F.col("word").rlike("^[a-zÀ-ÿ]+$")))
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("m"))))
    rows = pairs.select(both.alias("p")).select("p.*").unionByName(words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("m")))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("m")).alias("neg"), "near")))
    found = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    enough = -F.col("best.neg") >= ratio * F.col("n")
    chosen = found.select("word", F.when(enough, F.col("best.near")).alias("form"), "n", "n_near", F.when(enough, -F.col("best.neg")).alias("form_n"))
    chosen = written(chosen.withColumn("root", F.coalesce("form", "word")), "forms")
    discard(words)
    while True:
        # a word whose root has a form of its own takes that word's root: chains halve
        onward = chosen.where("form IS NOT NULL").select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = chosen.join(onward, chosen["root"] == onward["at"], "left").select("word", "form", "n", "n_near", "form_n", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went"))
        moved = written(moved, "roots")
        again = moved.where("went").limit(1).count()
        discard(chosen)
        chosen = moved.drop("went")
        chosen._scratch_path = moved._scratch_path
        if not again:
            return chosen.select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of documents of at least 5 letters that occur at least 3 times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return variants(word_counts(docs, least=5, drop=97).where("n >= 3"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
bytes AS (SELECT run, c, hex(encode(concat(doc_id, ':', run))) AS h FROM runs),
hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) AS h FROM bytes, tab),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
gaps AS (SELECT word, n, i, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS r FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS m FROM gaps a JOIN gaps b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT g.word, g.n, w.word, w.n FROM gaps g JOIN words w ON w.word = g.l || g.r
  UNION SELECT w.word, w.n, g.word, g.n FROM gaps g JOIN words w ON w.word = g.l || g.r),
best AS (SELECT word, count(*) AS n_near, arg_min({{'near': near, 'm': m}}, (-m, encode(near))) AS b FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.m >= 2 * w.n THEN b.near END AS form, CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n FROM words w LEFT JOIN best USING (word)),
roots AS (SELECT word, word AS at FROM forms UNION ALL SELECT r.word, f.form FROM roots r JOIN forms f ON f.word = r.at WHERE f.form IS NOT NULL),
ends AS (SELECT r.word, r.at AS root FROM roots r JOIN forms f ON f.word = r.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
