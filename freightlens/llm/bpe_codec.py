"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

One pass over all texts finds the frequent pre-tokens: each task keeps a summary
of ``COUNTERS`` counters (when it holds twice as many, the count of the first one
too many is taken off all of them), and the summaries add up. A word that makes up over 1 / ``COUNTERS`` of the
pre-tokens cannot be missed, and no task or driver holds more. The ``lexicon_words``
most frequent of at most ``WORD_BYTES`` bytes are merged once on the driver and compiled into a minimal acyclic
automaton: equal suffixes share their states, each transition carries the number of
words that its earlier siblings lead to, and the sum on a path is the word's place
in a table of ids. The file goes to the shared folder, Spark hands it to every
executor, and workers map it into memory. Words that are not in the lexicon merge
exactly, so the lexicon's content changes the speed only.

Defined cases: a null or empty text has no ids and decodes to the empty text; every
row is encoded by itself; an empty table gives no rows; other columns are not read.
Decoding bytes that are no UTF-8 gives replacement characters; an id that the
vocabulary lacks decodes to nothing; null ids decode to null.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightlens.llm import bpe
from freightlens.llm.common import flat, slices, strings, taken, written
from freightlens.llm.pretokens import encoded_dictionary, split
from freightlens.session import shared_folder

COUNTERS = 1 << 16
LEXICON_WORDS = 1 << 16
#: Longer words merge exactly and are not entered, so a lexicon is bounded in bytes.
WORD_BYTES = 64
_MAGIC = np.int64(0x4D415431)


def frequent_pretokens(rows: DataFrame, special: bytes, counters: int = COUNTERS) -> DataFrame:
    """(word, n) from the summaries of all tasks; ``rows`` has a column ``text``."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for part in slices(batches):
            begin, _ = split(*(cut := flat(part.column("text"))), special)
            if not len(begin):
                continue
            distinct, index = encoded_dictionary(begin, cut[1])
            for word, n in zip(distinct.to_pylist(), np.bincount(index, minlength=len(distinct)).tolist(), strict=True):
                held[word] = held.get(word, 0) + n
            if len(held) > 2 * counters:
                less = int(np.partition(np.fromiter(held.values(), np.int64, len(held)), -counters - 1)[-counters - 1])
                held = {word: n - less for word, n in held.items() if n > less}
        yield pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    found = rows.mapInArrow(summarise, "word binary, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """A minimal acyclic automaton as sorted transitions, and the ids of its words in order."""

    keys: np.ndarray  # state * 256 + byte
    target: np.ndarray
    before: np.ndarray  # words that smaller siblings lead to, and the word that ends in the state left
    final: np.ndarray
    offsets: np.ndarray
    ids: np.ndarray

    @staticmethod
    def compile(words: list[bytes], vocabulary: bpe.Vocabulary) -> Lexicon:
        """From distinct words; each state is shared by all prefixes with the same endings."""
        words = sorted(words)
        register: dict[tuple, int] = {}
        rows: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        path: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]  # open states of the last word
        last = b""

        def close(down_to: int) -> None:
            while len(path) > down_to + 1:
                final, out = path.pop()
                state = (final, tuple(out))
                if state not in register:
                    register[state] = len(rows)
                    rows.append(state)
                path[-1][1].append((last[len(path) - 1], register[state]))

        for word in words:
            same = len(os.path.commonprefix([last, word]))
            close(same)
            path.extend((False, []) for _ in word[same:])
            path[-1] = (True, path[-1][1])
            last = word
        close(0)
        root, many = len(rows), np.zeros(len(rows) + 1, np.int64)
        rows.append((path[0][0], tuple(path[0][1])))
        keys, target, before = [], [], []
        for state, (final, out) in enumerate(rows):  # targets come before the states that lead to them
            many[state] = final
            for byte, to in out:
                keys.append(state * 256 + byte)
                target.append(to)
                before.append(many[state])
                many[state] += many[to]
        offsets, ids = vocabulary.encode_many(np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)]), np.frombuffer(b"".join(words), np.uint8))
        final = np.array([f for f, _ in rows], np.int64)
        assert root == len(final) - 1
        return Lexicon(np.array(keys, np.int64), np.array(target, np.int64), np.array(before, np.int64), final, offsets, ids.astype(np.int64))

    def places(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Each string's place among the words, -1 if it is none of them."""
        lengths = np.diff(offsets)
        place = np.zeros(len(lengths), np.int64)
        state = np.full(len(lengths), len(self.final) - 1, np.int64)
        active = np.arange(len(lengths))
        if not len(self.keys):
            return place - 1
        for depth in range(int(lengths.max(initial=0))):
            active = active[lengths[active] > depth]
            if not len(active):
                break
            key = state[active] * 256 + data[offsets[active] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            state[active[~known]] = -1
            active, at = active[known], at[known]
            state[active] = self.target[at]
            place[active] += self.before[at]
        return np.where((state >= 0) & (self.final[state] == 1), place, -1)

    def parts(self) -> list[np.ndarray]:
        return [self.keys, self.target, self.before, self.final, self.offsets, self.ids]

    def to_bytes(self) -> bytes:
        head = np.array([_MAGIC, *map(len, self.parts())], np.int64)
        return b"".join(np.ascontiguousarray(p, np.int64).tobytes() for p in (head, *self.parts()))


@lru_cache(maxsize=2)
def mapped(path: str) -> Lexicon:
    """The lexicon of a file, mapped into memory."""
    data = np.memmap(path, np.int64, "r")
    if data[0] != _MAGIC:
        raise ValueError(f"{path} is no lexicon")
    ends = np.cumsum(data[1:7]) + 7
    return Lexicon(*(data[e - n : e] for e, n in zip(ends, data[1:7], strict=True)))


def _shipped(spark: SparkSession, content: bytes) -> str:
    """Write a small file to the shared folder and let Spark give every executor a copy; returns its name."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    target = f"{shared_folder(spark)}/{name}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(content))
    out.close()
    spark.sparkContext.addFile(target)
    return name


def build_lexicon(docs: DataFrame, vocabulary: bpe.Vocabulary, text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> Lexicon:
    counted = frequent_pretokens(docs.select(F.col(f"`{text_col}`").alias("text")), vocabulary.special)
    short = counted.filter(F.octet_length("word") <= WORD_BYTES)
    top = short.orderBy(F.desc("n"), "word").limit(lexicon_words).select("word").toArrow()
    return Lexicon.compile(top.column("word").to_pylist(), vocabulary)


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """One row per document: doc_id and its ids, an array of int.

    They are written: a task that also decoded them would keep a second Python worker beside this one.
    """
    spark = docs.sparkSession
    vocabulary = bpe.load(vocabulary_path)
    name = _shipped(spark, build_lexicon(docs, vocabulary, text_col, lexicon_words).to_bytes())
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lexicon = shared.value, mapped(SparkFiles.get(name))
        for part in slices(batches):
            offsets, data = flat(part.column("text"))
            begin, text = split(offsets, data, words.special)
            if len(begin):
                distinct, index = encoded_dictionary(begin, data)
                w_off, w_ids = _ids_of(distinct, words, lexicon)
                per_word = np.diff(w_off)[index]
                doc_len = np.bincount(text, weights=per_word, minlength=part.num_rows).astype(np.int64)
                _, ids = taken(w_off, w_ids, index)
            else:
                doc_len, ids = np.zeros(part.num_rows, np.int64), np.zeros(0, np.int64)
            cut = pa.array(np.concatenate([[0], np.cumsum(doc_len)]).astype(np.int32))
            yield pa.record_batch([part.column("doc_id"), pa.ListArray.from_arrays(cut, pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return written(rows.mapInArrow(run, "doc_id long, ids array<int>"))


def _ids_of(distinct: pa.Array, words: bpe.Vocabulary, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of distinct pre-tokens: known ones from the lexicon, the rest by merging."""
    _, off, raw = distinct.buffers()
    off, raw = np.frombuffer(off, np.int64)[: len(distinct) + 1], np.frombuffer(raw, np.uint8)
    place = lexicon.places(off, raw)
    known, rest = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
    k_off, k_ids = taken(lexicon.offsets, lexicon.ids, place[known])
    r_off, r_ids = words.encode_many(*taken(off, raw, rest))
    back = np.empty(len(distinct), np.int64)
    back[np.concatenate([known, rest])] = np.arange(len(distinct))
    return taken(np.concatenate([k_off, r_off[1:] + k_off[-1]]), np.concatenate([k_ids, r_ids.astype(np.int64)]), back)


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the column ``decoded``, the text that the ids stand for."""
    vocabulary = bpe.load(vocabulary_path)
    table = {i: s for s, i in vocabulary.ids.items()} | ({vocabulary.special_id: vocabulary.special} if vocabulary.special else {})
    pieces = [table.get(i, b"") for i in range(max(table) + 1)]
    t_off = np.concatenate([[0], np.cumsum([len(p) for p in pieces], dtype=np.int64)])
    shared = encoded.sparkSession.sparkContext.broadcast((t_off, np.frombuffer(b"".join(pieces), np.uint8)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p_off, p_data = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = part.column("ids")
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                counts = np.diff(lists.offsets.to_numpy()) * np.array(lists.is_valid(), dtype=np.int64)
                doc = np.repeat(np.arange(part.num_rows), counts)
                inside = (ids >= 0) & (ids < len(p_off) - 1)
                ids, doc = ids[inside], doc[inside]
                _, data = taken(p_off, p_data, ids)
                size = np.bincount(doc, weights=np.diff(p_off)[ids], minlength=part.num_rows).astype(np.int64)
                raw = strings(np.concatenate([[0], np.cumsum(size)]), data).to_pylist()
                text = [b.decode("utf-8", "replace") if ok.as_py() else None for b, ok in zip(raw, lists.is_valid(), strict=True)]
                yield pa.record_batch([part.column("doc_id"), lists, pa.array(text, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def with_digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
