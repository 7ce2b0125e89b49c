"""SentencePiece coding against the library."""

from __future__ import annotations

import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from freightlens.llm.piece_codec import PieceModel, decode, encode, with_digests
from freightlens.llm.queries import PIECES


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def model():
    return PieceModel.load(PIECES)


@pytest.fixture(scope="module")
def noise(spark):
    rng = random.Random(7)
    letters = " \n\tthe ing▁aeé漢🙂\u0001<0x41></s><unk>  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["".join(rng.choice("abcdethionsr") for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(9)) for _ in range(500)]
    texts += ["▁", "▁▁a", " " * 400 + "x", "﻿a", "á é"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _by_id(rows):
    return sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


@pytest.mark.parametrize("name", ["docs", "odd", "noise"])
def test_ids_and_texts_equal_the_library(request, library, name):
    df = request.getfixturevalue(name)
    rows = _by_id(df.collect())
    coded = decode(encode(df, PIECES), PIECES)
    want = library.encode([r["text"] or "" for r in rows], add_bos=True, add_eos=True, num_threads=1)
    got = _by_id(coded.collect())
    assert len(got) == len(rows)
    for r, ids, row in zip(got, want, rows, strict=True):
        assert (r["doc_id"], r["ids"], r["decoded"]) == (row["doc_id"], ids, library.decode(ids))


def test_very_long_texts(spark, library):
    texts = ["a" * 3_000_000, "the" * 500_000, " " * 200_000, "word of many " * 200_000, "é漢🙂" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = _by_id(decode(encode(df, PIECES), PIECES).collect())
    want = library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
    assert all(r["ids"] == ids and r["decoded"] == text for r, ids, text in zip(got, want, texts, strict=True))


def test_decoding_of_any_ids(spark, library):
    rng = random.Random(3)
    lists = [[rng.choice([0, 1, 2, 13, rng.randint(3, 258), rng.randint(130, 258), rng.randint(259, 31999)]) for _ in range(rng.randint(0, 12))] for _ in range(2000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in decode(df, PIECES).collect()}
    assert got == {i: library.decode(x) for i, x in enumerate(lists)}
    odd = spark.createDataFrame([(1, None), (2, [10**6, -5, None]), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in decode(odd, PIECES).collect()} == {1: None, 2: "", 3: ""}


def test_walk_equals_merging_and_goes_back(model):
    rng = random.Random(11)
    shorter = 0
    for _ in range(4000):
        text = "".join(rng.choice(["th", "e", "in", "g", "er", " ", "a", "s", "t", "ion"]) for _ in range(rng.randint(1, 14)))
        ids = model._walk(text)
        assert [model.pieces[i] for i in ids] == model.merged(text)
        longest = max(n for n in range(1, len(text) + 1) if text[:n] in model.ids)
        shorter += len(model.pieces[ids[0]]) < longest
    assert shorter  # some texts do not begin with their longest piece


def test_digests_and_empty_table(spark, library, docs):
    df = spark.createDataFrame([(1, "the cat"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in with_digests(decode(encode(df, PIECES), PIECES)).collect()}
    ids = library.encode("the cat", add_bos=True, add_eos=True)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert tuple(got[1])[1:] == (len(ids), digest(b"".join(i.to_bytes(4, "little") for i in ids)), digest(b"the cat"))
    assert tuple(got[2])[1:] == (2, digest(b"\x01\0\0\0\x02\0\0\0"), digest(b""))
    none = with_digests(decode(encode(docs.filter(F.lit(False)), PIECES), PIECES))
    assert none.collect() == []


def test_other_models_are_refused(tmp_path):
    with open(PIECES, "rb") as f:
        data = f.read()
    path = tmp_path / "other.model"
    path.write_bytes(data.replace(b"\x0a\x08identity\x12\x00", b"\x0a\x08nmt_nfkc\x12\x00").replace(b"\x18\x02\x20\x80\xfa\x01", b"\x18\x01\x20\x80\xfa\x01"))
    with pytest.raises(ValueError, match="only BPE"):
        PieceModel.load(str(path))
