"""Byte-level BPE vocabularies: loading and exact merging of one pre-token."""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

import numpy as np

#: Words up to this length merge in step with others of like length; longer ones each by a heap.
IN_STEP = 64
_NO_RANK = np.iinfo(np.int32).max


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by its public rule."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Ids of byte strings, ranks of merges, and the special token."""

    ids: dict[bytes, int]
    ranks: dict[tuple[bytes, bytes], int]
    special: bytes = b""
    special_id: int = -1
    pairs: PairTable | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        self.pairs = self.pairs or PairTable.of(self.ids, self.ranks)

    def merge(self, word: bytes) -> list[bytes]:
        """The pieces of a pre-token: of all adjacent pairs, that of least rank merges first, then the leftmost.

        With a heap, in n log n steps.
        """
        n, ranks = len(word), self.ranks
        parts: list[bytes] = [word[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue  # one of the two has merged with another meanwhile
            parts[i], parts[j] = a + b, b""
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p]

    def encode_many(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of every string that ``offsets`` cut out of ``data``."""
        lengths = np.diff(offsets)
        count = np.zeros(len(lengths), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # (string, its ids in order)
        low = 0
        for high in (4, 8, 12, 16, 24, 32, IN_STEP):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            low = high
            if len(rows):
                at, ids = self.pairs.merge_in_step(offsets[rows], lengths[rows], data, high)
                found.append((rows[at], ids))
        for row in np.flatnonzero(lengths > IN_STEP):
            pieces = self.merge(data[offsets[row] : offsets[row + 1]].tobytes())
            found.append((np.full(len(pieces), row), np.array([self.ids[p] for p in pieces], np.int32)))
        if self.special:
            for row in np.flatnonzero(lengths == len(self.special)):
                if data[offsets[row] : offsets[row + 1]].tobytes() == self.special:
                    found = [(r[r != row], i[r != row]) for r, i in found]
                    found.append((np.array([row]), np.array([self.special_id], np.int32)))
        if not found:
            return np.zeros(len(lengths) + 1, np.int64), np.zeros(0, np.int32)
        row, ids = np.concatenate([r for r, _ in found]), np.concatenate([i for _, i in found])
        order = np.argsort(row, kind="stable")
        count += np.bincount(row, minlength=len(lengths))
        return np.concatenate([[0], np.cumsum(count)]), ids[order]


@dataclass
class PairTable:
    """Merges as a hash table from a pair of ids to its rank; ``merged`` has the new id by rank."""

    keys: np.ndarray
    rank: np.ndarray
    merged: np.ndarray
    byte_id: np.ndarray
    bits: int

    @staticmethod
    def of(ids: dict[bytes, int], ranks: dict[tuple[bytes, bytes], int]) -> PairTable:
        bits = max(10, (len(ranks) * 8).bit_length())
        size = 1 << bits
        out = PairTable(np.full(size, -1, np.int64), np.full(size, _NO_RANK, np.int32), np.zeros(len(ranks), np.int32), np.zeros(256, np.int32), bits)
        for b in range(256):
            out.byte_id[b] = ids.get(bytes([b]), -1)
        pairs = list(ranks)
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        for (a, b), key, slot in zip(pairs, keys.tolist(), out._slots(keys).tolist(), strict=True):
            while out.keys[slot] >= 0:
                slot = (slot + 1) % size
            out.keys[slot], out.rank[slot], out.merged[ranks[a, b]] = key, ranks[a, b], ids[a + b]
        return out

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair, or an empty slot (whose rank is the largest number)."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64)
        slot = self._slots(keys)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slot[open_]]
            open_ = open_[(at != keys[open_]) & (at >= 0)]
        return slot

    def merge_in_step(self, begin: np.ndarray, lengths: np.ndarray, data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, id) of all tokens of many strings of at most ``width`` bytes; each round merges one pair of each."""
        column = np.arange(width, dtype=np.int16)
        inside = column < lengths[:, None]
        # one column more on the right, which stays empty
        symbols = np.full((len(begin), width + 1), -1, np.int32)
        symbols[:, :width][inside] = self.byte_id[data[(begin[:, None] + column)[inside]]]
        rank = np.full((len(begin), width + 1), _NO_RANK, np.int32)
        r, c = np.nonzero(inside[:, 1:])
        rank[r, c] = self.rank[self.find(symbols[r, c], symbols[r, c + 1])]
        rows, done = np.arange(len(begin)), []
        while len(rows):
            at = rank.argmin(axis=1)
            line = np.arange(len(rows))
            least = rank[line, at]
            ended = least == _NO_RANK
            if ended.any():
                done.append((rows[ended], symbols[ended, :width]))
                keep = ~ended
                rows, symbols, rank, at, least = rows[keep], symbols[keep], rank[keep], at[keep], least[keep]
                line = np.arange(len(rows))
            symbols[line, at] = self.merged[least]
            behind = column > at[:, None]  # moves up by one
            np.copyto(symbols[:, :width], symbols[:, 1:].copy(), where=behind)
            np.copyto(rank[:, :width], rank[:, 1:].copy(), where=behind)
            for left in (at - 1, at):
                ok = left >= 0
                i, j = line[ok], left[ok]
                a, b = symbols[i, j], symbols[i, j + 1]
                rank[i, j] = np.where(b >= 0, self.rank[self.find(a, b)], _NO_RANK)
        row = np.concatenate([r for r, _ in done])
        tokens = np.concatenate([t for _, t in done])
        i, j = np.nonzero(tokens >= 0)
        return row[i], tokens[i, j]


def load(path: str) -> Vocabulary:
    """A vocabulary from a tokenizer's JSON file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back, model = _byte_chars(), spec["model"]
    plain = lambda s: bytes(back[c] for c in s)
    added = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
    if model["type"] != "BPE" or model["ignore_merges"] or model["dropout"] or spec["normalizer"] or len(added) > 1:
        raise ValueError(f"{path}: only plain byte-level BPE with one special token is read")
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    ranks = {(plain(a), plain(b)): i for i, (a, b) in enumerate(pairs)}
    ids = {plain(t): i for t, i in model["vocab"].items() if t not in added}
    content, number = next(iter(added.items()), ("", -1))
    return Vocabulary(ids, ranks, content.encode(), number)
