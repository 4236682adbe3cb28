"""Sets of word shingles as sorted 64-bit hashes, computed on Arrow buffers without a Python object per
word.

Two different shingles share a hash with a chance of 2 ** -64; sets are compared by their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; bounds the temporary arrays.
CHUNK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20240229)
BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
PLACE = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), BASE)]))


def word_hashes(text: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text's bytes, A-Z in lower case."""
    out, at = [], 0
    while at < len(text):
        end = min(at + CHUNK, len(text))
        while end < len(text) and not SPACE[text[end]]:  # never cut inside a word
            end += 1
        out.append(_hashes(text[at:end]))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _hashes(text: np.ndarray) -> np.ndarray:
    inside = ~SPACE[text]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return np.empty(0, np.uint64)
    text, inside, first = text[starts[0] :], inside[starts[0] :], starts[0]
    starts = starts - first
    begin = np.repeat(starts, np.diff(np.append(starts, len(text))))
    offset = np.arange(len(text)) - begin
    values = np.where(inside, BYTE[LOWER[text]], np.uint64(0)) * _powers(int(offset.max()) + 1)[offset]
    return mixed(np.add.reduceat(values, starts))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; with fewer words, of the whole sequence;
    without words, nothing."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        whole = np.append(words * PLACE[:n], PLACE[-1:] * np.uint64(n))
        return mixed(whole.sum(dtype=np.uint64, keepdims=True))
    total = words[: n - width + 1] * PLACE[0]
    for k in range(1, width):
        total = total + words[k : n - width + 1 + k] * PLACE[k]
    return np.unique(mixed(total))


def fingerprint(shingles: np.ndarray) -> int:
    """A number for the set as a whole."""
    parts = np.append(mixed(shingles * BASE + np.uint64(1)), np.uint64(len(shingles)))
    return int(mixed(parts.sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])


def text_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The shingle set of every text of an Arrow array; null texts have empty sets."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    nulls = texts.is_null().to_numpy(zero_copy_only=False)
    for i in range(len(texts)):
        part = data[:0] if nulls[i] else data[offsets[i] : offsets[i + 1]]
        yield shingle_set(word_hashes(part), width)
