"""Arrow helpers shared by the operators that split text inside tasks.

Everything here works on one Arrow batch at a time, so memory follows the batch and never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b" \t\n\x0b\x0c\r"


def lower_table() -> bytes:
    """Byte map that lower-cases A-Z and nothing else."""
    return bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def alnum_table() -> bytes:
    """Byte map that lower-cases A-Z and turns every other ASCII byte that is no letter or digit into a space."""
    low = lower_table()
    return bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in low)


def remap(texts: pa.Array, table: bytes) -> pa.Array:
    """Apply a byte map to all texts at once. Maps of ASCII to ASCII keep the offsets and the UTF-8 valid."""
    validity, offsets, data = texts.buffers()
    if data is None:
        return texts
    return pa.Array.from_buffers(
        texts.type, len(texts), [validity, offsets, pa.py_buffer(data.to_pybytes().translate(table))], texts.null_count, texts.offset
    )


def pieces(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about `max_bytes` of text, or one row where a single text is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + max_bytes, side="right")))
            yield compact(batch.slice(start, end - start))
            start = end


def compact(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Copy a slice, so that its buffers hold its own rows only."""
    return batch.take(pa.array(np.arange(batch.num_rows)))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space: all words of all rows, and for each row its first word's place (one more at the end).

    A null text has no words.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        at = np.concatenate([[0], np.cumsum(full)])[at]
        flat = flat.filter(pa.array(full))
    return flat, at


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words as small integers, and the distinct words they stand for."""
    d = words.dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary


def hashed(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each (distinct) word; the same on every machine."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64, a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def row_of(at: np.ndarray) -> np.ndarray:
    """For each word the row it belongs to, given the rows' first places."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def windows(hashes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows of each row, and the rows' first windows.

    A row of fewer words than n, but not none, has one window: all its words. The length goes into the hash.
    """
    count = np.diff(at)
    full = np.maximum(count - n + 1, 0)
    short = (count > 0) & (count < n)
    first = np.concatenate([[0], np.cumsum(full + short)])
    start = np.repeat(at[:-1] - first[:-1], full + short) + np.arange(first[-1])
    size = np.repeat(np.minimum(count, n), full + short)
    out = mixed(size.astype(np.uint64))
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    for k in range(n):
        step = mixed(out + padded[start + k])
        out = np.where(k < size, step, out)
    return out, first
