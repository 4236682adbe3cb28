"""Texts of an Arrow column as bytes, in parts of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in parts of about so many bytes.
PART = 8 << 20


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the places where each begins and the last one ends.
    A null text is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_parts(
    texts: pa.Array, places: Callable[[np.ndarray], np.ndarray], most: int = PART
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first, data, offsets)`` of runs of texts with about ``most`` bytes: the number of the first
    text, their bytes, and where each begins and the last one ends.

    A text of more bytes is cut at some of the ``places`` that the function finds in it, and gives
    several parts of one text each. Where it has none, a part is as long as it must be.
    """
    data, offsets = text_bytes(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        part = data[offsets[at] : offsets[end]]
        if len(part) > most:  # one long text
            cuts = places(part)
            low = 0
            while low < len(part):
                k = int(np.searchsorted(cuts, low + most, "right"))
                inside = k > 0 and cuts[k - 1] > low
                high = len(part) if len(part) - low <= most else cuts[k - 1] if inside else cuts[k] if k < len(cuts) else len(part)
                yield at, part[low:high], np.array([0, high - low])
                low = int(high)
        else:
            yield at, part, offsets[at : end + 1] - offsets[at]
        at = end


def binary_array(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The slices of ``data`` that begin at ``starts``; the first start is 0 and each slice ends where
    the next one begins."""
    ends = np.append(starts, len(data)).astype(np.int64)
    data = np.ascontiguousarray(data)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def parts_of_batch(batch: pa.RecordBatch, column: str, most: int = PART) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about ``most`` bytes in ``column`` (a longer text is by itself)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end
