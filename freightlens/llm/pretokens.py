"""Splitting text into pre-tokens with a finite-state transducer.

The byte-level tokenizers split a text before merging: contractions, runs of
letters, numbers or other signs with a space in front, and white space. That
split is compiled here into a deterministic transducer over character classes;
each transition says whether a pre-token begins at this character, at the one
before, or both. A batch is cut into chunks of equal length. Each chunk's map from
any state before it to the state after it is computed for all chunks at once; the
maps compose by a parallel prefix scan, which gives each chunk its true first
state, and a last pass reads off the boundaries.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

END, SP, WS, NUM, APOS, OTHER, LETTER, L_STMD, L_RV, L_E, L_L, JOIN = range(12)
CLASSES = 12
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, APOS_FIRST, APOS_RV, APOS_L, SP1, WS1, SP_RUN, WS_RUN = range(11)
STATES = 11
HERE, BEFORE = 1, 2
CHUNK = 256
_LETTERS = (LETTER, L_STMD, L_RV, L_E, L_L)


def _begin(cls: int) -> int:
    """State after a character that begins a pre-token."""
    if cls in _LETTERS:
        return IN_LETTERS
    return {END: FRESH, JOIN: FRESH, SP: SP1, WS: WS1, NUM: IN_NUMBERS, APOS: APOS_FIRST, OTHER: IN_OTHER}[cls]


def _after_space(cls: int) -> int:
    return IN_LETTERS if cls in _LETTERS else IN_NUMBERS if cls == NUM else IN_OTHER


def _step(state: int, cls: int) -> tuple[int, int]:
    letter, space = cls in _LETTERS, cls in (SP, WS)
    pending = BEFORE if state in (APOS_RV, APOS_L) else 0  # the letter after the apostrophe begins a run after all
    if cls == JOIN:
        return FRESH, 0
    if cls == END:
        return FRESH, HERE | pending
    if state == IN_LETTERS and letter or state == IN_NUMBERS and cls == NUM or state == IN_OTHER and cls in (OTHER, APOS):
        return state, 0
    if state == APOS_FIRST:
        if cls in (OTHER, APOS):
            return IN_OTHER, 0
        if cls == L_STMD:
            return FRESH, 0
        if cls in (L_RV, L_L):
            return (APOS_RV if cls == L_RV else APOS_L), 0
    if state == APOS_RV and cls == L_E or state == APOS_L and cls == L_L:
        return FRESH, 0
    if pending:
        return (IN_LETTERS, BEFORE) if letter else (_begin(cls), BEFORE | HERE)
    if state in (SP1, WS1, SP_RUN, WS_RUN):
        if space:
            return (SP_RUN if cls == SP else WS_RUN), 0
        if state == SP1:
            return _after_space(cls), 0
        if state == SP_RUN:
            return _after_space(cls), BEFORE
        return _begin(cls), HERE | (BEFORE if state == WS_RUN else 0)
    return _begin(cls), HERE


@cache
def transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, boundaries), both indexed by state * CLASSES + class."""
    both = [_step(s, c) for s in range(STATES) for c in range(CLASSES)]
    return np.array([x for x, _ in both], np.uint8), np.array([x for _, x in both], np.uint8)


@cache
def char_classes() -> np.ndarray:
    """The class of every code point, as the tokenizer library's own patterns see letters, numbers and blanks."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    points = np.r_[0:0xD800, 0xE000:0x110000]
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, cls in ((r"\p{L}+", LETTER), (r"\p{N}+", NUM), (r"\s+", WS)):
        rest = Split(Regex(pattern), behavior="removed")
        for block in np.split(points, range(4096, len(points), 4096)):
            hit = np.ones(len(block), bool)
            for _, (a, b) in rest.pre_tokenize_str("".join(map(chr, block.tolist()))):
                hit[a:b] = False
            out[block[hit]] = cls
    for chars, cls in ((" ", SP), ("'", APOS), ("stmd", L_STMD), ("rv", L_RV), ("e", L_E), ("l", L_L)):
        out[[ord(c) for c in chars]] = cls
    return out


def _scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps [chunks, states], doubling the reach each round."""
    reach = 1
    while reach < len(maps):
        maps = np.concatenate([maps[:reach], np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1)])
        reach *= 2
    return maps


def boundaries(codes: np.ndarray) -> np.ndarray:
    """Positions in ``codes`` where a pre-token begins."""
    n = len(codes)
    step, emit = transducer()
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, END, np.uint8)
    padded[:n] = codes
    by_step = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (chunks, 1))
    for column in by_step:
        maps = step[maps * np.uint8(CLASSES) + column[:, None]]
    state = np.zeros(chunks, np.uint8)
    state[1:] = _scan(maps)[:-1, FRESH]
    said = np.empty_like(by_step)
    for i, column in enumerate(by_step):
        at = state * np.uint8(CLASSES) + column
        said[i] = emit[at]
        state = step[at]
    said = said.T.reshape(-1)[:n]
    begins = (said & HERE).astype(bool)
    begins[:-1] |= (said[1:] & BEFORE).astype(bool)
    return np.flatnonzero(begins)


def _special(raw: bytes, special: bytes, ends: np.ndarray) -> list[int]:
    found, at = [], raw.find(special)
    while at >= 0:
        if np.searchsorted(ends, at, "right") == np.searchsorted(ends, at + len(special) - 1, "right"):
            found.append(at)
            at = raw.find(special, at + len(special))
        else:
            at = raw.find(special, at + 1)
    return found


def split(offsets: np.ndarray, data: np.ndarray, special: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """(begin, text) of each pre-token: its first byte and its text's index.

    ``offsets`` cut ``data`` (UTF-8) into texts. Pre-tokens fill the texts without
    gaps. Each occurrence of ``special`` is one pre-token, as a special token is.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = data.tobytes()
    first = np.flatnonzero((data & 0xC0) != 0x80)  # of each character
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    codes = char_classes()[points]
    if special:
        for at in _special(raw, special, offsets[1:]):
            i = np.searchsorted(first, at)
            codes[i] = END
            codes[i + 1 : i + len(special)] = JOIN
    char_off = np.searchsorted(first, offsets)
    lengths = np.diff(char_off)
    text = np.repeat(np.arange(len(lengths)), lengths)
    spread = np.full(len(codes) + len(lengths), END, np.uint8)  # an end after each text
    place = np.arange(len(codes)) + text
    spread[place] = codes
    begins = np.zeros(len(spread), bool)
    begins[boundaries(spread)] = True
    at = np.flatnonzero(begins[place])
    return first[at].astype(np.int64), text[at]


def encoded_dictionary(begin: np.ndarray, data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(distinct pre-tokens, index of each pre-token among them)."""
    from freightlens.llm.common import strings

    coded = strings(np.append(begin, len(data)), data).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
