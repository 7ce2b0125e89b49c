"""Token counts and BPE coding against the tokenizer library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from freightlens.llm import bpe
from freightlens.llm.bpe_codec import Lexicon, decode, encode, with_digests
from freightlens.llm.pretokens import STATES, _scan
from freightlens.llm.queries import VOCABULARY
from freightlens.llm.token_counts import count_tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load(VOCABULARY)


def wanted(library, rows):
    texts = [r["text"] or "" for r in rows]
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def noise(spark):
    rng = random.Random(5)
    letters = " \n\t'srtevmldlaéß1٣!?<|endoftext|>  漢🙂'"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(9)) for _ in range(1000)]
    texts += ["<|endoftext|>", "<|endoftext|", "ftext|>", "a<|endoftext|><|endoftext|> b", "ab" * 4000]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("name", ["docs", "odd", "noise"])
def test_counts_and_codes_equal_the_library(request, library, name):
    df = request.getfixturevalue(name)
    rows = df.collect()
    ids = wanted(library, rows)
    counts = count_tokens(df, VOCABULARY).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    want = sorted(zip(rows, ids, strict=True), key=lambda x: key(x[0]))
    for got, (row, tokens) in zip(sorted(counts, key=key), want, strict=True):
        assert tuple(got) == (row["doc_id"], len((row["text"] or "").encode()), len(tokens), len(tokens) > 1024)
    coded = decode(encode(df, VOCABULARY, lexicon_words=200), VOCABULARY).collect()
    for got, (row, tokens) in zip(sorted(coded, key=key), want, strict=True):
        assert got["ids"] == tokens
        assert got["decoded"] == library.decode(tokens, skip_special_tokens=False)


def test_digests(spark, library):
    df = spark.createDataFrame([(1, "the cat"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in with_digests(decode(encode(df, VOCABULARY), VOCABULARY)).collect()}
    ids = library.encode("the cat").ids
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert tuple(got[1])[1:] == (len(ids), digest(",".join(map(str, ids))), digest("the cat"))
    assert tuple(got[2])[1:] == (0, digest(""), digest(""))


def test_a_task_codes_or_decodes(docs):
    """Each operator in a chain keeps a Python worker of its own in every running task."""
    plan = with_digests(decode(encode(docs, VOCABULARY), VOCABULARY))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_empty_table(spark, docs):
    none = docs.limit(0)
    assert count_tokens(none, VOCABULARY).collect() == []
    assert decode(encode(none, VOCABULARY), VOCABULARY).collect() == []


def test_lexicon_is_minimal_and_finds_its_words(vocabulary):
    words = [b" walking", b" talking", b" walked", b" talked", b"w", b" w", b" walk"]
    lexicon = Lexicon.compile(words, vocabulary)
    # " " + w, t + "al" + k + (end) / "ing" / "ed": the endings are shared
    assert len(lexicon.keys) < len({w[:i] for w in words for i in range(1, len(w) + 1)})
    probe = [*sorted(words), b" wal", b" walkin", b"x", b" walkings"]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in probe])])
    places = lexicon.places(offsets, np.frombuffer(b"".join(probe), np.uint8))
    assert places.tolist() == [*range(len(words)), -1, -1, -1, -1]


def test_scan_composes_maps():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, STATES, (37, STATES)).astype(np.uint8)
    state, want = np.arange(STATES), []
    for m in maps:
        state = m[state]
        want.append(state)
    assert (_scan(maps) == np.array(want)).all()
