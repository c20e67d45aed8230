"""Words and shingles of whole texts as numpy arrays, straight from Arrow buffers.

Words are the runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z only. A word's hash is a
rolling 64-bit hash of its bytes, finished by a bijective mixer; a shingle's hash mixes those of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)
_LETTER = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_LETTER[65:91] = _LETTER[97:123]  # A-Z count as a-z
#: Texts are hashed together up to so many bytes; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(size: int, base: int) -> np.ndarray:
    p = np.full(size, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if size <= BLOCK_BYTES + 1:
        size = BLOCK_BYTES + 1
        return _powers(size, _BASE), _powers(size, _INVERSE)
    return _powers.__wrapped__(size, _BASE), _powers.__wrapped__(size, _INVERSE)


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets within them) of consecutive texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and for each text the index of its first word (one more at the end)."""
    word = np.zeros(len(data) + 1, dtype=bool)
    word[:-1] = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _windows(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces of about BLOCK_BYTES, cut where a word ends."""
    at = 0
    while at < len(data):
        to = at + BLOCK_BYTES
        while to < len(data):
            space = _SPACE[data[to : to + 4096]]
            if space.any():
                to += int(space.argmax())
                break
            to += 4096
        yield data[at:to]
        at = to


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LETTER[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of a block, and the index of each text's first word.

    A text of more than BLOCK_BYTES, which is a block of its own, is hashed in windows: a word's hash doesn't depend on where
    it stands, so its memory is that of its hashes, not of tables as long as itself.
    """
    if len(data) > BLOCK_BYTES:
        found = [np.zeros(0, np.uint64)]
        for window in _windows(data):
            starts, ends, _ = spans(window, np.array([0, len(window)]))
            found.append(_hashes(window, starts, ends) if len(starts) else found[0])
        h = np.concatenate(found)
        return h, np.where(offsets < len(data), 0, len(h))
    starts, ends, index = spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), index
    return _hashes(data, starts, ends), index


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles.

    With fewer words the whole sequence is the one shingle; without words the array is empty.
    """
    k = np.uint64(0xD6E8FEB86659FD93)
    for _, data, offsets in blocks(texts):
        h, index = word_hashes(data, offsets)
        s = h[: max(0, len(h) - n + 1)]
        for j in range(1, n):
            s = mix(s * k + h[j : len(h) - n + 1 + j])
        for a, b in zip(index[:-1].tolist(), index[1:].tolist(), strict=True):
            if b - a >= n:
                own = np.sort(s[a : b - n + 1])
                yield own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif b > a:
                one = h[a : a + 1]
                for j in range(a + 1, b):
                    one = mix(one * k + h[j : j + 1])
                yield mix(one + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))
