"""Words and their hashes, vectorised over the texts of a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of the pair of hashes (a, b); wraps around."""
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x7F4A7C15F39CC060)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def fresh(texts: pa.Array) -> pa.Array:
    """The texts, null as "", in buffers of their own: some kernels misread slices."""
    return pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of all texts in a row, dictionary-encoded; words in each text."""
    lists = pc.split_pattern_regex(fresh(texts), "[ \t-\r]+")
    offsets = lists.offsets.to_numpy()
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    return pc.dictionary_encode(flat.filter(pa.array(full))), np.diff(before[offsets - offsets[0]])


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, A-Z in lower case; words in each text."""
    words, lens = split_words(pc.ascii_lower(fresh(texts)))
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(words.dictionary))
    return table[words.indices.to_numpy()] if len(table) else np.empty(0, np.uint64), lens


def shingles(hashes: np.ndarray, lens: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's ``k``-word shingles, text after text, and their numbers.

    A text of fewer than ``k`` words has one shingle, its whole sequence.
    """
    doc = np.repeat(np.arange(len(lens)), lens)
    keys, owners = [], []
    n = len(hashes) - k + 1
    if n > 0:
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = mix(h, hashes[j : j + n])
        inside = doc[:n] == doc[k - 1 :]
        keys.append(h[inside])
        owners.append(doc[:n][inside])
    starts = np.cumsum(lens) - lens
    for size in range(1, k):
        own = np.flatnonzero(lens == size)
        h = np.full(len(own), size, np.uint64)
        for j in range(size):
            h = mix(h, hashes[starts[own] + j])
        keys.append(h)
        owners.append(own)
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[first], np.bincount(owner[first], minlength=len(lens))
