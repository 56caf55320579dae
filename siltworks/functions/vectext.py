"""Vectorised text helpers over Arrow batches: words, hashes and shingles of a whole batch at once.

A batch of texts becomes one flat array of word hashes and an array of row offsets; everything after that is numpy over the
flat array, so no Python loop touches single words. Distinct words are hashed once a batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_GAP = r"[^\p{L}\p{N}]+"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += _GOLD
        x ^= x >> np.uint64(30)
        x *= _M1
        x ^= x >> np.uint64(27)
        x *= _M2
        x ^= x >> np.uint64(31)
    return x


def hash_strings(values: Iterable[str]) -> np.ndarray:
    """Stable 64-bit hashes; independent of process and platform."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(v) for v in values), dtype=np.uint64)


def split_words(texts: pa.Array, gap: str = WORD_GAP, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Flat word strings and row offsets (len(texts) + 1); null texts have no words, empty pieces are dropped."""
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        filled = pc.utf8_lower(filled)
    lists = pc.split_pattern_regex(filled, gap)
    flat, offsets = lists.values, lists.offsets.to_numpy().astype(np.int64)
    flat = flat.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    keep = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    return flat.filter(pa.array(keep)), np.concatenate([[0], np.cumsum(keep)])[offsets]


def word_hashes(texts: pa.Array, gap: str = WORD_GAP, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """As split_words, with a 64-bit hash in place of each word."""
    flat, offsets = split_words(texts, gap, lower)
    coded = flat.dictionary_encode()
    table = hash_strings(coded.dictionary.to_pylist())
    codes = coded.indices.to_numpy()
    return (table[codes] if len(table) else np.zeros(0, np.uint64)), offsets


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a row, in order, and their row offsets."""
    n = len(words)
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    out = np.concatenate([[0], np.cumsum(counts)])
    if n < size:
        return np.zeros(0, np.uint64), out
    rolled = np.zeros(n - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            rolled = mix64(rolled * np.uint64(0x100000001B3) + words[k : n - size + 1 + k])
    starts = np.repeat(offsets[:-1], counts) + np.arange(out[-1]) - np.repeat(out[:-1], counts)
    return rolled[starts], out


def distinct_per_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, with multiplicities and new offsets."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if not len(values):
        return values, np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(values)))
    per_row = np.bincount(rows[at], minlength=len(offsets) - 1)
    return values[at], counts, np.concatenate([[0], np.cumsum(per_row)])


def row_set_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit key for the multiset of each row, 0 for an empty row."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(values), dtype=np.uint64)])
    with np.errstate(over="ignore"):
        sums = total[offsets[1:]] - total[offsets[:-1]]
        keys = mix64(sums + mix64(np.diff(offsets).astype(np.uint64)))
    keys[np.diff(offsets) == 0] = 0
    return keys


def rebatch(batches: Iterator[pa.RecordBatch], max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that no piece holds much more than max_bytes of data; a single long row is a piece of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        pieces = max(1, -(-batch.nbytes // max_bytes))
        step = max(1, batch.num_rows // pieces)
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
