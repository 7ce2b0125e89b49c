"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes a few counts and ratios. Each is cut into bins at its quantiles, and
the model is a sum: one table of log-odds per feature, one per chosen pair of
features on coarser bins. Boosting goes round the features in turn; each step fits
a tree of at most ``LEAVES`` leaves to the residuals over one feature's bins and adds
a part of it to that feature's table. Then the pairs whose cells explain most of
what is left are chosen and boosted in turn the same way, with two cuts each way. A
score is a sum of table entries, looked up for a whole batch at once.

Training takes about ``sample`` labelled rows, chosen by a hash of the id, to the
driver: a row is ``len(NAMES)`` numbers.

Defined cases: null and empty texts have the features of the empty text and a score
like any other; rows without id are scored, but nothing is learned from them; with
no labelled rows, or one label only, the score is the share of label 1 (0.5 if there
is none); ids with several labels count as their mean, rounded up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.llm.common import flat, held_out, learned_from, sampled, slices
from freightlens.llm.words import word_hashes

NAMES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "stop_mark", "comma", "line", "other_byte",
    "upper_start", "short_words", "long_words", "distinct_words", "top_word", "repeated_pairs", "end_marks", "words_per_mark",
)
BINS = 32
PAIR_BINS = 8
PAIRS = 10
ROUNDS = 120
PAIR_ROUNDS = 40
LEAVES = 3
RATE = 0.15
SAMPLE = 20_000
THRESHOLD = 0.7


def features(texts: pa.Array) -> np.ndarray:
    """[texts, len(NAMES)] of whole texts."""
    offsets, data = flat(texts)
    n_docs, size = len(offsets) - 1, np.diff(offsets).astype(float)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    kind = np.zeros(256, np.uint8)  # of each byte
    for value, chars in enumerate((range(65, 91), range(48, 58), b" \t\n\v\f\r", b".", b",", b"!?", range(128, 256)), 1):
        kind[list(chars)] = value
    kind[list(range(97, 123))] = 8
    of = kind[data]
    upper, digit, blank, stop, comma, mark, other, symbol = (per_text(of == k) for k in (1, 2, 3, 4, 5, 6, 7, 0))
    line = per_text(data == 10)
    begins = (of != 3).copy()
    begins[1:] &= of[:-1] == 3
    firsts = offsets[:-1][size > 0]
    begins[firsts] = of[firsts] != 3
    at = np.flatnonzero(begins)
    ends = (of != 3).copy()
    ends[:-1] &= of[1:] == 3
    lasts = offsets[1:][size > 0] - 1
    ends[lasts] = of[lasts] != 3
    length = np.flatnonzero(ends) - at + 1
    doc = np.searchsorted(offsets, at, "right") - 1
    words = np.bincount(doc, minlength=n_docs).astype(float)
    tally = lambda flags: np.bincount(doc[flags], minlength=n_docs).astype(float)
    w_off, hashes = word_hashes(texts)
    distinct, top, repeated = np.zeros(n_docs), np.zeros(n_docs), np.zeros(n_docs)
    for i, (a, b) in enumerate(zip(w_off[:-1], w_off[1:], strict=True)):
        if b > a:
            _, count = np.unique(hashes[a:b], return_counts=True)
            distinct[i], top[i] = len(count) / (b - a), count.max() / (b - a)
            if b - a > 1:
                pairs = hashes[a : b - 1] * np.uint64(31) + hashes[a + 1 : b]
                repeated[i] = 1 - len(np.unique(pairs)) / len(pairs)
    some, many = np.maximum(size, 1), np.maximum(words, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(words), (size - blank) / many, upper / some, digit / some, symbol / some, stop / some, comma / some,
        line / some, other / some, tally(of[at] == 1) / many, tally(length <= 3) / many, tally(length >= 12) / many, distinct, top, repeated,
        mark / some, words / (1 + stop + mark),
    ])


def _tree(gain: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Leaf values over ordered bins: the best tree of at most LEAVES leaves, grown split by split."""
    cuts = [0, len(gain)]
    g, w = np.concatenate([[0], np.cumsum(gain)]), np.concatenate([[0], np.cumsum(weight)])
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1)
    for _ in range(LEAVES - 1):
        best = max(
            ((worth(a, c) + worth(c, b) - worth(a, b), c) for a, b in zip(cuts[:-1], cuts[1:], strict=True) for c in range(a + 1, b)),
            default=(0, 0),
        )
        if best[0] <= 1e-9:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(gain))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1)
    return out


def _tree_2d(gain: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """(leaf values, gain) of the best cross of one cut in each direction."""
    g, w = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (gain, weight))
    inner = slice(1, -1)
    worth, leaves = np.zeros((len(g) - 2, len(g[0]) - 2)), []
    for top in (True, False):
        for left in (True, False):
            s = []
            for x in (g, w):
                a = x[inner, inner] if left else x[inner, -1:] - x[inner, inner]
                whole = x[-1:, inner] if left else x[-1:, -1:] - x[-1:, inner]
                s.append(a if top else whole - a)
            worth += s[0] ** 2 / (s[1] + 1)
            leaves.append(s[0] / (s[1] + 1))
    i, j = np.unravel_index(worth.argmax(), worth.shape)
    out = np.empty_like(gain)
    for leaf, rows, columns in zip(leaves, (slice(0, i + 1),) * 2 + (slice(i + 1, None),) * 2, (slice(0, j + 1), slice(j + 1, None)) * 2, strict=True):
        out[rows, columns] = leaf[i, j]
    return out, float(worth.max() - g[-1, -1] ** 2 / (w[-1, -1] + 1))


@dataclass
class Model:
    start: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    @staticmethod
    def train(x: np.ndarray, y: np.ndarray) -> Model:
        share = (y.mean() * len(y) + 0.5) / (len(y) + 1) if len(y) else 0.5
        if len(set(y.tolist())) < 2:
            return Model(float(np.log(share / (1 - share))), [], [], [], {})
        cut = lambda n: [np.unique(np.quantile(c, np.linspace(0, 1, n + 1)[1:-1])) for c in x.T]
        model = Model(float(np.log(share / (1 - share))), cut(BINS), [], cut(PAIR_BINS), {})
        model.tables = [np.zeros(len(e) + 1) for e in model.edges]
        bins, coarse = _binned(x, model.edges), _binned(x, model.pair_edges)
        odds = np.full(len(y), model.start)

        def residuals() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-odds))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for f, table in enumerate(model.tables):
                r, h = residuals()
                step = RATE * _tree(np.bincount(bins[f], r, len(table)), np.bincount(bins[f], h, len(table)))
                table += step
                odds += step[bins[f]]
        r, h = residuals()
        cells = {}
        for a, b in combinations(range(len(bins)), 2):
            shape = len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1
            if min(shape) > 1:
                cells[a, b] = (coarse[a] * shape[1] + coarse[b], shape)

        def fitted(pair: tuple[int, int], r: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
            cell, shape = cells[pair]
            grid = lambda v: np.bincount(cell, v, shape[0] * shape[1]).reshape(shape)
            return _tree_2d(grid(r), grid(h))

        gains = {pair: fitted(pair, r, h)[1] for pair in cells}
        chosen = sorted(gains, key=lambda p: -gains[p])[:PAIRS]
        model.pairs = {pair: np.zeros(cells[pair][1]) for pair in chosen}
        for _ in range(PAIR_ROUNDS):
            for pair, grid in model.pairs.items():
                step = RATE * fitted(pair, *residuals())[0]
                grid += step
                odds += step.reshape(-1)[cells[pair][0]]
        return model

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.start)
        for bins, table in zip(_binned(x, self.edges), self.tables, strict=True):
            odds += table[bins]
        coarse = _binned(x, self.pair_edges)
        for (a, b), table in self.pairs.items():
            odds += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-odds))


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
    return [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]


def _measured(rows: DataFrame, *extra: str) -> DataFrame:
    """``extra`` columns and ``x``, the features as doubles; ``rows`` has the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = features(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.reshape(-1)))
            yield pa.record_batch([*(part.column(e) for e in extra), lists], [*extra, "x"])

    kinds = dict(rows.dtypes)
    return rows.select("text", *extra).mapInArrow(run, ", ".join(f"{e} {kinds[e]}" for e in extra) + ", x array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, modulus: int = 4) -> Model:
    """``docs``: doc_id, text; ``labels``: doc_id, quality."""
    known = labels.filter(learned_from(F.col("doc_id"), modulus) & F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg(F.ceil(F.avg("quality")).cast("int").alias("label"))
    known = sampled(known, F.col("doc_id"), sample, known.count())
    rows = docs.select("doc_id", "text").join(known, "doc_id").select("text", "label", "doc_id")
    found = _measured(rows, "label", "doc_id").orderBy("doc_id", "x").collect()
    x = np.array([r["x"] for r in found], float).reshape(len(found), len(NAMES))
    return Model.train(x, np.array([r["label"] for r in found], float))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 4) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, modulus=modulus))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            score = shared.value.score(features(part.column("text")))
            yield pa.record_batch([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), modulus).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
