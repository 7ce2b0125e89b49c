"""SentencePiece encoding and decoding of merge-type models by backtracking.

The library merges, of all adjacent symbols that together are a piece, those of the
best score first, then the leftmost. The same ids come from a walk over the text that
merges nothing: an Aho-Corasick automaton of the pieces finds the longest one that
begins at each position; a piece is taken if it is compatible with the piece before
it, that is if merging the text of both gives just these two back. Where none of
the pieces that begin at a position is, the walk goes back by one piece and tries a
shorter one, and a bitfield keeps the positions from which the end is not reached, so
that each fails once. A row of pieces whose neighbours are all compatible is the
result of merging the whole: the first merge across a border between two of them
would have been the best one in the text of these two alone as well. So there is
one such row only, and positions fail whatever the way to them was.

Texts are cut in front of each run of blanks, as no piece goes on behind one; each
distinct segment of a batch is encoded once. A character that is in no piece
never merges and becomes its bytes' pieces.

The model file is parsed here. Those read are BPE with byte pieces and without
normalisation rules, user-defined or unused pieces; any other raises ValueError.

Defined cases: a null or empty text has the begin and end ids only and decodes to the
empty text; every row is encoded by itself, repeated ids too; very long texts, also
without a blank, take time and memory in proportion to their length; other columns are
not read; an empty table gives no rows. Null ids decode to null, an id that the model
lacks to nothing, and each byte of a run that is no UTF-8 to a replacement character.
"""

from __future__ import annotations

import codecs
import hashlib
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.llm.common import flat, slices, strings, taken

BLANK = "▁"
#: Kinds of pieces, fixed values of the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Segments and pairs kept by a worker, and the longest segment kept.
KEPT, KEPT_PAIRS, KEPT_CHARS = 1 << 18, 1 << 19, 48
#: Ids handled at a time when decoding; one longer text is a slice of its own.
SLICE_IDS = 1 << 18


def _byte_by_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("byte_by_byte", _byte_by_byte)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = number(at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class PieceModel:
    """Pieces with a blank for each space mark, their kinds and scores."""

    pieces: list[str]
    kinds: list[int]
    scores: list[float]
    begin: int
    end: int
    unknown_text: str
    _segments: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)
    _pairs: dict[int, bool] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        normal = [(p, s, i) for i, (p, s, k) in enumerate(zip(self.pieces, self.scores, self.kinds, strict=True)) if k == NORMAL]
        self.ids = {p: i for p, _, i in normal}
        self.score = {p: s for p, s, _ in normal}
        self.byte_ids = {bytes([int(p[3:5], 16)]): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        letters = {c for p in self.ids for c in p}
        if not letters <= set(self.ids) or len(self.byte_ids) != 256:
            raise ValueError("each character of a piece and each byte must be a piece")
        if any(" " in p.lstrip(" ") for p in self.ids):
            raise ValueError("pieces with a blank behind other characters are not read")

    def __getstate__(self) -> dict[str, object]:
        kept = {k: v for k, v in self.__dict__.items() if k not in ("automaton", "shorter", "lengths")}
        return kept | {"_segments": {}, "_pairs": {}}

    @staticmethod
    def load(path: str) -> PieceModel:
        with open(path, "rb") as f:
            data = f.read()
        pieces, scores, kinds, trainer, rules = [], [], [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                entry = dict(_fields(value))
                pieces.append(entry[1].decode().replace(BLANK, " "))
                scores.append(struct.unpack("<f", entry.get(2, bytes(4)))[0])
                kinds.append(entry.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        plain = not rules.get(2) and rules.get(3, 1) and not rules.get(4, 1) and rules.get(5, 1)
        if trainer.get(3, 1) != 2 or not trainer.get(35) or trainer.get(24) or not plain or {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError(f"{path}: only BPE models with byte pieces and no rules of normalisation are read")
        at = {p: i for i, p in enumerate(pieces) if kinds[i] == CONTROL}
        return PieceModel(pieces, kinds, scores, at[trainer.get(46, b"<s>").decode()], at[trainer.get(47, b"</s>").decode()], trainer.get(44, b" \xe2\x81\x87 ").decode())

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging it: the rule that encoding has to meet."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Of the pieces that merging can give; the others are in no result."""
        out = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(self.merged(piece)) == 1:
                out.add_word(piece, i)
        out.make_automaton()
        return out

    @cached_property
    def shorter(self) -> list[int]:
        """For each piece the longest other one that it begins with, or -1."""
        out = [-1] * len(self.pieces)
        for piece, i in self.ids.items():
            for n in range(len(piece) - 1, 0, -1):
                if piece[:n] in self.automaton:
                    out[i] = self.ids[piece[:n]]
                    break
        return out

    @cached_property
    def lengths(self) -> list[int]:
        return [len(p) for p in self.pieces]

    def compatible(self, a: int, b: int) -> bool:
        """Merging the text of both pieces gives them back."""
        if len(self._pairs) >= KEPT_PAIRS:
            self._pairs.clear()
        pair = [self.pieces[a], self.pieces[b]]
        self._pairs[a << 32 | b] = out = self.merged("".join(pair)) == pair
        return out

    def segment_ids(self, text: str) -> Sequence[int]:
        known = self._segments.get(text)
        if known is None:
            known = self._walk(text)
            if len(text) <= KEPT_CHARS:
                if len(self._segments) >= KEPT:
                    self._segments.clear()
                self._segments[text] = known
        return known

    def _walk(self, text: str) -> tuple[int, ...]:
        size, lengths, shorter, pairs = len(text), self.lengths, self.shorter, self._pairs
        longest = [-1] * size
        for last, piece in self.automaton.iter(text):  # by last character, so longer ones come later
            longest[last - lengths[piece] + 1] = piece
        failed = bytearray(size // 8 + 1)
        taken_, at = [], 0  # pieces taken, unknown characters as -2 - code point
        piece = longest[0] if size else -1
        while at < size:
            if piece == -1 and longest[at] == -1:  # in no piece, so it merges with nothing
                taken_.append(-2 - ord(text[at]))
                at += 1
                piece = longest[at] if at < size else -1
                continue
            before = taken_[-1] if taken_ else -2
            while piece >= 0:
                to = at + lengths[piece]
                if not failed[to >> 3] >> (to & 7) & 1:
                    fits = before < 0 or pairs.get(before << 32 | piece)
                    if fits or (fits is None and self.compatible(before, piece)):
                        break
                piece = shorter[piece]
            if piece >= 0:
                taken_.append(piece)
                at = to
                piece = longest[at] if at < size else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                last = taken_.pop()
                while last < 0:
                    at -= 1
                    last = taken_.pop()
                at -= lengths[last]
                piece = shorter[last]
        if min(taken_, default=0) >= 0:
            return tuple(taken_)
        return tuple(i for t in taken_ for i in ((t,) if t >= 0 else [self.byte_ids[bytes([b])] for b in chr(-2 - t).encode()]))

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of each text, with the begin and end ids."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), BLANK, " ")
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(" ", texts, ""))
        offsets, data = flat(texts)
        full = np.flatnonzero(np.diff(offsets))
        blank = data == 32
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        cut[offsets[full]] = True
        begin = np.flatnonzero(cut)
        count = np.full(len(texts), 2, np.int64)
        per_text: tuple[np.ndarray, np.ndarray] | None = None
        if len(begin):
            coded = strings(np.append(begin, len(data)), data).dictionary_encode()
            found = [self.segment_ids(s.decode()) for s in coded.dictionary.to_pylist()]
            size = np.array([len(f) for f in found], np.int64)
            ids = np.fromiter((i for f in found for i in f), np.int32, int(size.sum()))
            index = coded.indices.to_numpy(zero_copy_only=False)
            text = np.searchsorted(offsets, begin, "right") - 1
            count += np.bincount(text, weights=size[index], minlength=len(texts)).astype(np.int64)
            per_text = taken(np.concatenate([[0], np.cumsum(size)]), ids, index)
        out_off = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(out_off[-1], np.int32)
        ends = np.zeros(len(out), bool)
        ends[out_off[:-1]] = ends[out_off[1:] - 1] = True
        out[out_off[:-1]], out[out_off[1:] - 1] = self.begin, self.end
        if per_text is not None:
            out[~ends] = per_text[1]
        return out_off, out

    def decode_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offsets, bytes, kinds) of what each id stands for."""
        said = {CONTROL: lambda p: b"", UNKNOWN: lambda p: self.unknown_text.encode(), BYTE: lambda p: bytes([int(p[3:5], 16)])}
        parts = [said.get(k, str.encode)(p) for p, k in zip(self.pieces, self.kinds, strict=True)]
        return np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.frombuffer(b"".join(parts), np.uint8), np.array(self.kinds, np.int8)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and its ids, an array of int."""
    shared = docs.sparkSession.sparkContext.broadcast(PieceModel.load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            offsets, ids = shared.value.encode_texts(part.column("text"))
            yield pa.record_batch([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def _id_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, offsets, ids) of about ``SLICE_IDS`` ids; null ids are no ids."""
    for batch in batches:
        size = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // SLICE_IDS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                rows = batch.slice(a, b - a)
                ids = pc.fill_null(rows.column("ids").flatten(), -1).to_numpy(zero_copy_only=False)
                yield rows, np.concatenate([[0], np.cumsum(size[a:b])]), ids


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the column ``decoded``, the text that the ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(PieceModel.load(model_path).decode_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, data, kinds = shared.value
        for rows, offsets, ids in _id_slices(batches):
            doc = np.repeat(np.arange(rows.num_rows), np.diff(offsets))
            inside = (ids >= 0) & (ids < len(kinds))
            ids, doc = ids[inside], doc[inside]
            off, raw = taken(table, data, ids)
            size = np.bincount(doc, weights=np.diff(table)[ids], minlength=rows.num_rows).astype(np.int64)
            said = np.flatnonzero(kinds[ids] != CONTROL)
            first = said[np.unique(doc[said], return_index=True)[1]]
            blank = np.zeros(rows.num_rows, bool)  # in front of the first piece: put there by encoding
            blank[doc[first[(kinds[ids[first]] == NORMAL) & (raw[off[first]] == 32)]]] = True
            begin = np.concatenate([[0], np.cumsum(size)])
            parts, valid = strings(begin, raw).to_pylist(), rows.column("ids").is_valid().to_pylist()
            # a control id in a run of bytes ends the run
            ended = np.flatnonzero((kinds[ids[1:]] == CONTROL) & (kinds[ids[:-1]] == BYTE) & (doc[1:] == doc[:-1])) + 1
            cuts: dict[int, list[int]] = {}
            for i in ended.tolist():
                cuts.setdefault(int(doc[i]), []).append(int(off[i] - begin[doc[i]]))
            text = []
            for i, (part, cut, ok) in enumerate(zip(parts, blank, valid, strict=True)):
                at = [int(cut), *cuts.get(i, []), len(part)]
                runs = [part[a:b].decode("utf-8", "byte_by_byte") for a, b in zip(at[:-1], at[1:], strict=True)]
                text.append("".join(runs) if ok else None)
            yield pa.record_batch([rows.column("doc_id"), rows.column("ids"), pa.array(text, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def with_digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offsets, ids in _id_slices(batches):
            raw = strings(offsets * 4, np.ascontiguousarray(ids, "<u4").view(np.uint8)).to_pylist()
            text = [hashlib.sha256((t or "").encode()).hexdigest() for t in rows.column("decoded").to_pylist()]
            digests = [hashlib.sha256(r).hexdigest() for r in raw]
            yield pa.record_batch([rows.column("doc_id"), pa.array(np.diff(offsets)), pa.array(digests), pa.array(text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return decoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
