"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer with full avalanche."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def plain(texts: pa.Array) -> pa.Array:
    """Large strings without nulls in buffers of their own: some Arrow kernels misread the offset of a slice."""
    return pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words per text); A-Z lower-cased, words cut at space and U+0009 to U+000D; null has none."""
    text = pc.ascii_trim_whitespace(pc.ascii_lower(plain(texts)))
    parts = pc.ascii_split_whitespace(text)
    n = np.diff(parts.offsets.to_numpy())
    n = np.where(pc.equal(text, "").to_numpy(zero_copy_only=False), 0, n)
    coded = parts.flatten().dictionary_encode()
    names = np.array(coded.dictionary.to_pylist(), dtype=object)
    hashes = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, np.uint64)
    code = coded.indices.to_numpy(zero_copy_only=False)
    if (n == 0).any():  # an empty text splits into one empty word
        keep = np.repeat(n > 0, np.maximum(n, 1))
        code = code[keep]
    return hashes[code], n


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes sorted within each text, number per text). Fewer words make one shingle."""
    h, n = word_hashes(texts)
    with np.errstate(over="ignore"):
        end = np.cumsum(n)
        start = end - n
        count = np.where(n == 0, 0, np.maximum(n - words + 1, 1))
        doc = np.repeat(np.arange(len(n)), count)
        first = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
        size = np.minimum(n, words)[doc]
        acc = size.astype(np.uint64) + _MIX
        padded = np.concatenate([h, np.zeros(words, np.uint64)])
        for k in range(words):
            step = mix64(acc ^ padded[first + k]) * _MIX
            acc = np.where(k < size, step, acc)
        acc = mix64(acc)
    order = np.lexsort((acc, doc))
    doc, acc = doc[order], acc[order]
    new = np.ones(len(acc), bool)
    new[1:] = (acc[1:] != acc[:-1]) | (doc[1:] != doc[:-1])
    return acc[new], np.bincount(doc[new], minlength=len(n))
