"""Language identification by hierarchical discrimination.

A text becomes the frequencies of its byte trigrams (lower case, everything but
letters as blanks), hashed to ``FEATURES`` columns. The language's family is
predicted first, by one linear SVM per family against the rest; within the family,
one-versus-one SVMs separate each pair of languages and vote. The models are trained
on the driver from a bounded sample: about ``per_language`` labelled rows of each
language, chosen by a hash of the id, and fewer of each where that makes more than
``MOST_ROWS``, but at least one; what is collected, and trained on, are their columns that
are not zero, at most ``FEATURES`` of 4 bytes each. Every language is learned, so the time grows
with their number.

The score is the product of the logistic margins of the family and of the closest
pair that the language won. It says how much nearer a language is than the others,
not that the text is in any of them (with two families it is never below 0.25). For
that, each language keeps the columns with ``COVERED`` of its training texts' trigrams:
a text fits one where the share of its trigrams in there, and some more the fewer it has,
reaches ``LEAST_FIT`` of what all but 1 % of the training texts reach.

Defined cases: a null text and one without any letter is ``und`` with score 0; an
empty training set gives ``und`` for all; one language only is always predicted; of
families, or pairs' votes, that tie, the first in alphabetical order wins; an empty table
gives no rows; rows without id are predicted, but nothing is learned from them; repeated
rows and clashing columns do not matter; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.llm import svm
from freightlens.llm.common import flat, held_out, learned_from, sample_limit, sample_place, slices

#: Families by language code; a language that is not listed is a family of its own.
FAMILIES = {
    "da": "germanic", "de": "germanic", "en": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "bg": "slavic", "cs": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "uk": "slavic",
}
FEATURES = 1 << 12
PER_LANGUAGE = 1000
MOST_ROWS = 16_000
UNKNOWN = "und"
COVERED, LEAST_FIT = 0.95, 2 / 3
#: Steepness of the logistic function of a margin.
SLOPE = 4.0


def trigrams(texts: pa.Array, features: int = FEATURES) -> np.ndarray:
    """[texts, features]: square roots of the trigram frequencies, of unit length."""
    offsets, data = flat(pc.utf8_lower(pc.fill_null(texts, "")))
    keep = np.zeros(256, bool)
    keep[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
    data = np.where(keep[data], data, 32).astype(np.uint32)
    out = np.zeros((len(offsets) - 1, features), np.float32)
    if len(data) >= 3:
        code = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - int(np.log2(features)))
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            if b - a >= 3:
                out[i] = np.bincount(code[a : b - 2], minlength=features)
    out = np.sqrt(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def _fit_to(x: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Share of each row's trigrams in these columns, with an allowance for rows of few trigrams."""
    return (x**2) @ columns + 1 / np.sqrt(np.maximum((x > 0).sum(axis=1), 1))


def _profile(x: svm.Rows) -> tuple[np.ndarray, float]:
    """(columns with most of the trigrams, least fit) of one language's training rows."""
    share = np.bincount(x.columns, weights=x.values**2, minlength=x.width) / len(x)
    order = np.argsort(-share, kind="stable")
    columns = np.zeros(x.width, np.float32)
    columns[order[: np.searchsorted(np.cumsum(share[order]), COVERED * share.sum()) + 1]] = 1
    fit = x.totals(x.values**2 * columns[x.columns]) + 1 / np.sqrt(np.maximum(np.diff(x.offsets), 1))
    return columns, LEAST_FIT * float(np.quantile(fit, 0.01))


@dataclass
class Model:
    """Weights of the family and pair machines; ``families`` lists each family's languages.

    ``profiles`` has each language's columns of frequent trigrams and the least fit to them.
    """

    families: list[list[str]]
    family_weights: np.ndarray
    pair_weights: dict[tuple[str, str], np.ndarray]
    profiles: dict[str, tuple[np.ndarray, float]]

    @staticmethod
    def train(x: svm.Rows, langs: np.ndarray, families: Mapping[str, str] = FAMILIES) -> Model:
        groups: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            groups.setdefault(families.get(lang, lang), []).append(lang)
        members = [groups[f] for f in sorted(groups)]
        against = [svm.train(x, np.where(np.isin(langs, m), 1, -1)) for m in members] if len(members) > 1 else [np.zeros(x.width + 1)]
        pairs = {}
        for m in members:
            for a, b in combinations(m, 2):
                rows = np.isin(langs, [a, b])
                pairs[a, b] = svm.train(x.pick(rows), np.where(langs[rows] == a, 1, -1))
        profiles = {lang: _profile(x.pick(langs == lang)) for lang in set(langs)}
        return Model(members, np.array(against, np.float32).T, {k: w.astype(np.float32) for k, w in pairs.items()}, profiles)

    def fits(self, x: np.ndarray) -> np.ndarray:
        """True where a row's trigrams are those of some language; a short text's may be another than is predicted."""
        out = np.zeros(len(x), bool)
        for columns, least in self.profiles.values():
            out |= _fit_to(x, columns) >= least
        return out

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) of each row."""
        sure = lambda margin: 1 / (1 + np.exp(-SLOPE * np.clip(margin, -20, 20)))
        margins = x @ self.family_weights[:-1] + self.family_weights[-1]
        family = margins.argmax(axis=1)
        score = sure(margins.max(axis=1)) if len(self.families) > 1 else np.ones(len(x))
        lang = np.full(len(x), UNKNOWN, object)
        for f, members in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            votes, least = np.zeros((len(rows), len(members))), np.full((len(rows), len(members)), np.inf)
            for (i, a), (j, b) in combinations(enumerate(members), 2):
                w = self.pair_weights[a, b]
                margin = x[rows] @ w[:-1] + w[-1]
                won, line = np.where(margin >= 0, i, j), np.arange(len(rows))
                votes[line, won] += 1
                least[line, won] = np.minimum(least[line, won], np.abs(margin))
            best, line = votes.argmax(axis=1), np.arange(len(rows))
            lang[rows] = np.array(members, object)[best]
            score[rows] *= np.where(np.isinf(least[line, best]), 1, sure(least[line, best]))
        return lang, score


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's columns that are not zero, and their values."""
    for part in slices(batches):
        for start in range(0, part.num_rows, 256):
            rows = part.slice(start, 256)
            x = trigrams(rows.column("text")).astype(np.float16)
            found = [(np.flatnonzero(r).astype(np.uint16).tobytes(), r[r != 0].tobytes()) for r in x]
            yield pa.record_batch([rows.column("lang"), *(pa.array(v, pa.binary()) for v in zip(*found, strict=True))], ["lang", "at", "x"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, modulus: int = 4) -> Model | None:
    """Train on about ``per_language`` rows of each language; None if there is nothing to learn from."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    rows = rows.filter(learned_from(F.col("doc_id"), modulus) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    place = sample_place(F.col("doc_id"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("first")).collect()
    if not counts:
        return None
    each = min(per_language, MOST_ROWS // len(counts))
    limits = [(r["lang"], max(r["first"] + 1, sample_limit(each, r["n"]))) for r in counts]
    limits = docs.sparkSession.createDataFrame(limits, "lang string, below long")
    found = rows.join(F.broadcast(limits), "lang").filter(place < F.col("below")).select("lang", "text").mapInArrow(_features, "lang string, at binary, x binary").toArrow()
    if not found.num_rows:
        return None
    found = found.sort_by([("lang", "ascending"), ("at", "ascending"), ("x", "ascending")])  # the same rows, the same model
    (offsets, at), (_, values) = (flat(found.column(c)) for c in ("at", "x"))
    x = svm.Rows(offsets // 2, at.view(np.uint16).astype(np.int32), values.view(np.float16).astype(np.float32), FEATURES)
    return Model.train(x, np.array(found.column("lang").to_pylist(), object))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = model or fit(docs, id_col, text_col, lang_col, modulus=modulus)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for start in range(0, part.num_rows, 256):
                rows = part.slice(start, 256)
                known = has_letter(rows.column("text"))
                lang, score = np.full(rows.num_rows, UNKNOWN, object), np.zeros(rows.num_rows)
                if shared.value is not None and known.any():
                    lang[known], score[known] = shared.value.predict(trigrams(rows.column("text").filter(pa.array(known))))
                yield pa.record_batch([rows.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), modulus).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that fit a language and have at least this score."""
    model = fit(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            for start in range(0, part.num_rows, 256):
                rows = part.slice(start, 256)
                text = rows.column(text_col)
                keep = has_letter(text)
                if shared.value is not None and keep.any():
                    x = trigrams(text.filter(pa.array(keep)))
                    keep[keep] = (shared.value.predict(x)[1] >= least_score) & shared.value.fits(x)
                yield rows.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
