"""Words of Arrow batches as dictionary codes, so that each distinct word of a batch is handled once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 12_000_000  # of text per pass, which bounds the memory of a task; a longer text is a pass of its own


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``SLICE_BYTES`` of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``(codes, offsets, words)``: row i has the words ``words[codes[offsets[i]:offsets[i + 1]]]``; null has none.

    Words are runs of anything but the six ASCII white-space characters.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))]).astype(np.int64)
    coded = flat.filter(real).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), kept[ends], coded.dictionary


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each row."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def expand(codes: np.ndarray, starts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated ``values[starts[c]:starts[c + 1]]`` for each code, and how many each code gave."""
    counts = starts[codes + 1] - starts[codes]
    ends = np.cumsum(counts)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts[codes], counts)
    return values[at], counts
