"""Token counts of a unigram tokenizer without building the tokens.

An Aho-Corasick automaton lists the vocabulary matches that end at each character, the longest first; dynamic
programming carries the best score and its number of pieces. Ties go as in the tokenizer: starts are tried from left
to right and only a strictly better score replaces one, so of equal scores the longest last piece stays. A character
that is no piece of its own costs the lowest vocabulary score less 10 and counts one piece for each of its UTF-8 bytes
where the vocabulary has bytes, else one for each run of such characters.

Counts of chunks are added up: no piece crosses a space that follows another character, nor a character that no piece
contains, so the best path passes such points whatever stands around them. The vocabulary is checked for this.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public tokenizers' files are, and the model whose pieces and scores are used. It is a BPE model, whose scores
#: are merge ranks and no log probabilities, for want of a unigram one there: the counts are those of the unigram rules on
#: its table, not those of its own tokenizer. token_counts() takes any other model or table by its path.
FOLDER, MODEL = os.environ.get("PAGELATHE_TOKENIZERS", "/opt/tokenizers"), "piece_bpe_32k.model"
SPACE = "▁"
#: Counts of so many chunks are remembered in a worker; then it begins anew.
REMEMBERED = 600_000
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Ordinary pieces with their scores, and whether all 256 bytes are pieces.

    path is a sentencepiece model, or a table of pieces and scores separated by tabs, whose name ends in .vocab or .tsv.
    """
    if path.endswith((".vocab", ".tsv")):
        with open(path, encoding="utf-8") as f:
            rows = [line.rstrip("\n").rpartition("\t") for line in f if "\t" in line]
        found = [(piece, float(score)) for piece, _, score in rows if piece and not re.fullmatch(r"<(?:unk|s|/s|pad)>", piece)]
        plain = [x for x in found if not re.fullmatch("<0x[0-9A-F]{2}>", x[0])]
        return plain, len(found) - len(plain) == 256
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = range(sp.get_piece_size())
    plain = [(sp.id_to_piece(i), sp.get_score(i)) for i in kinds if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return plain, sum(sp.is_byte(i) for i in kinds) == 256


class Counter(dict):
    """Chunk -> pieces, filled as chunks are asked for."""

    def __init__(self, pieces: list[tuple[str, float]], has_bytes: bool) -> None:
        super().__init__()
        self.has_bytes = has_bytes
        self.singles = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.splits = all(SPACE not in p.lstrip(SPACE) for p, _ in pieces)
        self.breaks = not any("\n" in p for p, _ in pieces)
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()

    def best(self, chunk: str) -> int:
        """Pieces of the best path through a chunk in which spaces are already SPACE."""
        n = len(chunk)
        score, pieces = [0.0] * (n + 1), [0] * (n + 1)
        reached = [True] + [False] * n
        run = [False] * (n + 1)  # the best path to here ends in an unknown character
        done = 0  # positions up to here are settled
        for end, (length, own) in self.automaton.iter(chunk):
            end += 1
            while done < end - 1:
                done += 1
                self._unknown(chunk, done, score, pieces, reached, run)
            start = end - length
            if reached[start] and (not reached[end] or score[start] + own > score[end]):
                score[end], pieces[end], reached[end], run[end] = score[start] + own, pieces[start] + 1, True, False
        while done < n:
            done += 1
            self._unknown(chunk, done, score, pieces, reached, run)
        return pieces[n]

    def _unknown(self, chunk, end, score, pieces, reached, run) -> None:
        c = chunk[end - 1]
        if c not in self.singles:
            if not reached[end] or score[end - 1] + self.unknown > score[end]:
                more = len(c.encode()) if self.has_bytes else 0 if run[end - 1] else 1
                score[end], pieces[end], reached[end], run[end] = score[end - 1] + self.unknown, pieces[end - 1] + more, True, True

    def __missing__(self, chunk: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.best(chunk)
        if len(chunk) <= 64:
            self[chunk] = n
        return n

    def count(self, text: str | None) -> int:
        """Pieces of a whole text, after a space is put before it and spaces become SPACE; 0 for null and empty."""
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if not self.splits or not self.has_bytes:
            return self.best(text)
        lines = text.split("\n") if self.breaks else [text]
        total = len(lines) - 1
        get = self.__getitem__
        for line in lines:
            if SPACE + SPACE in line:
                total += sum(map(get, _runs(line)))
            elif line:
                head, *rest = line.split(SPACE)
                total += sum(map(get, map(SPACE.__add__, rest)))
                if head:
                    total += get(head)
        return total


def _runs(line: str) -> Iterator[str]:
    """Cuts before each run of SPACE that follows another character."""
    at = 0
    for i in range(1, len(line)):
        if line[i] == SPACE and line[i - 1] != SPACE:
            yield line[at:i]
            at = i
    if line:
        yield line[at:]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of a model file, one for each worker process."""
    if path not in _counters:
        _counters[path] = Counter(*vocabulary(path))
    return _counters[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row: id, n_tokens of the whole text. Null and empty texts have 0; ids may be null or repeated.

    The model file is read on the executors, where it must stand at the same path.
    """
    path = path or os.path.join(FOLDER, MODEL)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            n = [own.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], [id_col, "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long")


def op9_token_count(spark, sf_dir: str) -> DataFrame:
    """Token counts of documents."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
