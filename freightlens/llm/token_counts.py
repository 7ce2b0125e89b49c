"""Token counts by a compiled finite-state tokenizer.

Two transducers, both compiled once on the driver from the vocabulary (a bounded
size) and broadcast. The first splits text into pre-tokens (``pretokens``). The
second runs over a pre-token's bytes: a trie of the vocabulary's byte strings
whose transitions carry how many tokens more the longer string has than the
shorter, so the counts on a path add up to the count of its string. All distinct
pre-tokens of a slice walk it in step. One that leaves the trie is merged exactly.

Defined cases: a null or empty text has 0 tokens; each row is counted on its own,
whatever repeats; very long texts are slices of their own; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.llm import bpe
from freightlens.llm.common import flat, slices, taken
from freightlens.llm.pretokens import encoded_dictionary, split


@dataclass
class CountTransducer:
    """Transitions sorted by ``state * 256 + byte``: target state and tokens emitted."""

    keys: np.ndarray
    target: np.ndarray
    emitted: np.ndarray

    def walk(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The count of each string, -1 where it leaves the trie."""
        lengths = np.diff(offsets)
        count = np.zeros(len(lengths), np.int64)
        state = np.zeros(len(lengths), np.int64)
        active = np.flatnonzero(lengths > 0)
        for depth in range(int(lengths.max(initial=0))):
            active = active[lengths[active] > depth]
            if not len(active):
                break
            key = state[active] * 256 + data[offsets[active] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            count[active[~known]] = -1
            active, at = active[known], at[known]
            state[active] = self.target[at]
            count[active] += self.emitted[at]
        return count


def compile_counts(vocabulary: bpe.Vocabulary) -> CountTransducer:
    nodes: dict[bytes, int] = {b"": 0}
    for token in vocabulary.ids:
        for i in range(1, len(token) + 1):
            nodes.setdefault(token[:i], len(nodes))
    prefixes = list(nodes)  # numbered in this order
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in prefixes])])
    counts = np.diff(vocabulary.encode_many(offsets, np.frombuffer(b"".join(prefixes), np.uint8))[0]).tolist()
    rows = sorted((nodes[s[:-1]] * 256 + s[-1], n, counts[n] - counts[nodes[s[:-1]]]) for s, n in nodes.items() if s)
    keys, target, emitted = zip(*rows, strict=True)
    return CountTransducer(np.array(keys, np.int64), np.array(target, np.int32), np.array(emitted, np.int8))


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    spark = docs.sparkSession
    vocabulary = bpe.load(vocabulary_path)
    compiled = spark.sparkContext.broadcast((compile_counts(vocabulary), vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer, words = compiled.value
        for part in slices(batches):
            offsets, data = flat(part.column("text"))
            begin, text = split(offsets, data, words.special)
            total = np.zeros(part.num_rows, np.int64)
            if len(begin):
                distinct, index = encoded_dictionary(begin, data)
                d_off, d_data = _buffers(distinct)
                n = transducer.walk(d_off, d_data)
                # the special token's string is one token here, although its bytes may be in the trie
                rest = np.flatnonzero((n < 0) | (np.diff(d_off) == (len(words.special) or -1)))
                n[rest] = np.diff(words.encode_many(*taken(d_off, d_data, rest))[0])
                total += np.bincount(text, weights=n[index], minlength=part.num_rows).astype(np.int64)
            yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(total)], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def _buffers(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, off, data = distinct.buffers()
    return np.frombuffer(off, np.int64)[distinct.offset : distinct.offset + len(distinct) + 1], np.frombuffer(data, np.uint8)
