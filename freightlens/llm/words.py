"""Words of texts as 64-bit hashes, and their shingles, for whole batches at a time.

A word is a run of characters that are no white space, in lower case. A shingle is
``SHINGLE`` words in a row; a text of fewer words has one shingle of all of them,
and a text without words has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SHINGLE = 5
_STEPS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) + (i << 40) * 2) & (2**64 - 1) | 1 for i in range(SHINGLE)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the hashes of each text's words; null has none."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts) if lower else texts)
    coded = lists.flatten().dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    index = coded.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    empty = coded.dictionary.index("").as_py()  # at the ends of texts that begin or end with a blank
    if empty >= 0:
        doc, index = doc[index != empty], index[index != empty]
    hashes = known[index] if len(known) else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(lists)))]), hashes


def shingle_hashes(offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of the shingles of each text in order, repeats included."""
    lengths = np.diff(offsets)
    size = np.minimum(lengths, SHINGLE)
    count = np.where(lengths > 0, lengths - size + 1, 0)
    out = np.concatenate([[0], np.cumsum(count)])
    begin = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], count)
    total = np.zeros(out[-1], np.uint64)
    full = np.repeat(size == SHINGLE, count)
    for i in range(SHINGLE):
        at = begin + i
        inside = full | (at < np.repeat(offsets[1:], count))
        total[inside] += hashes[at[inside]] * _STEPS[i]
    return out, mixed(total + np.repeat(size, count).astype(np.uint64))
