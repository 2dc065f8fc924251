"""Vectorised access to texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about so many bytes, which bounds a Python worker's memory.
SLICE_BYTES = 2 << 20

# The bytes that separate words.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts as UTF-8 (null: empty); at least one row in each."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start), [x or b"" for x in texts.slice(start, stop - start).to_pylist()]
            start = stop


class Words:
    """The words of some texts: one buffer (a newline after each text), word bounds, words per text."""

    def __init__(self, texts: list[bytes], lower: bool = True, separators: np.ndarray = _BLANK):
        joined = b"\n".join([*texts, b""])
        self.raw = joined.lower() if lower else joined  # of bytes: A-Z only
        self.data = np.frombuffer(self.raw, dtype=np.uint8)
        blank = separators[self.data]
        word = ~blank
        first, last = word.copy(), word.copy()
        first[1:] &= blank[:-1]
        last[:-1] &= blank[1:]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.text_starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.bounds = np.searchsorted(self.starts, self.text_starts)
        self.counts = np.diff(self.bounds)


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]; empty segments give 0."""
    total = np.concatenate([np.zeros(1, dtype=values.dtype), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]
