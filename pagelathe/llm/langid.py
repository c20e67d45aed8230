"""Language identification by compression: the smallest text under per-language zstandard raw-content dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: What a language is learned from: so many labelled texts, those with the smallest hashes of their ids, of at most
#: SAMPLE_CHARS each, joined up to DICT_BYTES. These bound the fit; predictions read whole texts.
SAMPLE_TEXTS, SAMPLE_CHARS, DICT_BYTES = 128, 20_000, 64 * 1024
#: Compression level, and the finer one that decides where the first leaves a margin of at most NARROW bytes.
LEVEL, FINE_LEVEL, NARROW = 6, 12, 2
#: Long texts are compressed in pieces of so many bytes, each under the dictionary alone, and the sizes summed: a piece
#: finds the words of the text before it as easily under any dictionary, so the share that tells languages apart would
#: shrink with the length.
PIECE = 4096
#: A prediction is rejected when the runner-up needs less than MARGIN bytes more (which decides short texts), or less than
#: the share RELATIVE of the smallest size more.
MARGIN, RELATIVE = 1, 0.03
UNKNOWN = "und"
#: ASCII bytes other than letters become spaces, so that digits, marks and markup weigh the same in every language.
_LETTERS = bytes(c if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain(text: str) -> bytes:
    """The whole text in lower case, its words of letters joined by single spaces."""
    return b" ".join(text.lower().encode().translate(_LETTERS).split()) + b" "


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary of raw content for each language among rows with text and label."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.length("text") > 0) & (F.length("text") <= SAMPLE_CHARS))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"))
    few = rows.select("lang", "text", F.row_number().over(order).alias("n")).where(F.col("n") <= SAMPLE_TEXTS)
    found: dict[str, list[str]] = {}
    for lang, text, _ in sorted(few.collect(), key=lambda r: (r.lang, r.n)):
        if text not in found.setdefault(lang, []):
            found[lang].append(text)
    out = {}
    for lang, texts in sorted(found.items()):
        out[lang] = b"".join(map(plain, texts))[:DICT_BYTES].ljust(8)
    return out


class Classifier:
    """Compressors of the learned languages; not picklable, so each task makes its own."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = list(dictionaries)
        self._by: dict[int, list[zstandard.ZstdCompressor]] = {LEVEL: [], FINE_LEVEL: []}
        for raw in dictionaries.values():
            for level, own in self._by.items():
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                own.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False))

    def sizes(self, text: str) -> list[int]:
        raw = plain(text)
        pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        out = [sum(len(c.compress(p)) for p in pieces) for c in self._by[LEVEL]]
        if len(out) > 1 and sorted(out)[1] - min(out) <= NARROW:
            out = [sum(len(c.compress(p)) for p in pieces) for c in self._by[FINE_LEVEL]]
        return out

    def predict(self, text: str | None) -> tuple[str, float, int, int]:
        """(language, score, margin in bytes, smallest size). The score weighs languages by 2 ** -(bytes above the smallest)."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0, 0
        sizes = self.sizes(text)
        least = min(sizes)
        margin = sorted(sizes)[1] - least if len(sizes) > 1 else len(text)
        return self.langs[sizes.index(least)], 1.0 / sum(2.0 ** -min(s - least, 60) for s in sizes), margin, least

    def rejected(self, found: tuple[str, float, int, int], margin: int, relative: float = RELATIVE) -> bool:
        return found[0] == UNKNOWN or (len(self.langs) > 1 and found[2] < max(margin, relative * found[3]))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: int = MARGIN, relative: float = RELATIVE) -> DataFrame:
    """Per row: id, lang_pred, score, margin, rejected.

    lang_pred is "und" with score 0 for a null text, one without a letter, or when nothing was learned. Ties go to the
    language that sorts first. rejected is true for "und" and where the margin is narrower than the given bytes
    or the given share of the smallest size.
    An empty table gives an empty result; ids may be null or repeated; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(shared.value)
        for batch in batches:
            found = [own.predict(t.as_py()) for t in batch.column(1)]
            lang, score, width, _ = zip(*found, strict=True) if found else ((), (), (), ())
            reject = [own.rejected(x, margin, relative) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(width, pa.int64()), pa.array(reject, pa.bool_())], [id_col, "lang_pred", "score", "margin", "rejected"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, margin long, rejected boolean")


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def drop_unidentified(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", margin: int = MARGIN, relative: float = RELATIVE) -> DataFrame:
    """The rows of docs, all columns, whose language is not rejected; each row is judged by its own text.

    Only texts go to Python, and verdicts come back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(labelled, id_col, text_col, lang_col))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Classifier(shared.value)
        for texts in batches:
            yield pa.array([not own.rejected(own.predict(t.as_py()), margin, relative) for t in texts], pa.bool_())
        pa.default_memory_pool().release_unused()

    return docs.where(F.arrow_udf(run, "boolean")(F.col(text_col)))


def op5_langid(spark, sf_dir: str) -> DataFrame:
    """Languages of documents, learned from those whose fold is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, learn(docs.where(fold() != 2)))
    return out.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")
