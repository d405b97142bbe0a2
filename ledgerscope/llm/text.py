"""Words and word shingles of whole texts, in Arrow batches.

A word is a maximal run of characters other than U+0020 and U+0009..U+000D. Shingles are
hashed to 64 bits: words by a keyed hash, a shingle by mixing the hashes of its words in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one step of a task works on; a single longer text forms a step of its own.
SLICE_BYTES = 4 << 20
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def unused(columns: list[str], *wanted: str) -> list[str]:
    """Column names like those wanted that no column has, whatever the case of its letters."""
    there = {c.lower() for c in columns}
    return [next(n for n in (w + "_" * k for k in range(len(there) + 1)) if n.lower() not in there) for w in wanted]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices of a batch with about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, and the number of words of each text (null: none)."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    there = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
    base = offsets[0]
    return flat.filter(there), np.diff(kept[offsets - base])


def word_hashes(flat: pa.Array) -> np.ndarray:
    coded = flat.dictionary_encode()
    if not len(coded.dictionary):
        return np.zeros(0, dtype=np.uint64)
    hashed = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    return hashed[coded.indices.to_numpy()]


def shingles(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles in text order, their number per text, and words per text.

    A text of fewer words has its whole word sequence as its one shingle; one without words has none.
    """
    flat, counts = words(texts)
    hashed = word_hashes(flat)
    starts = np.cumsum(counts) - counts
    n = len(hashed)
    out = np.zeros(max(n - size + 1, 0), dtype=np.uint64)
    for j in range(size):
        out += mix(hashed[j : j + len(out)] * _MUL[j % 5] + np.uint64(j // 5))
    out = mix(out)
    per = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    if n:
        left = np.repeat(starts + counts, counts) - np.arange(n)  # words from here to the end of the text
        full = left >= size
        short = np.flatnonzero((counts > 0) & (counts < size))
        first = np.zeros(n, dtype=bool)
        first[starts[short]] = True
        values = np.zeros(n, dtype=np.uint64)
        values[: len(out)] = out
        for i in short:
            part = hashed[starts[i] : starts[i] + counts[i]]
            values[starts[i]] = mix((mix(part * _MUL[: len(part)] if len(part) <= 5 else part)).sum(dtype=np.uint64, keepdims=True) + np.uint64(counts[i]))[0]
        out = values[full | first]
    return out, per, counts
