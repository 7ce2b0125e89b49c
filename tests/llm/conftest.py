from __future__ import annotations

import pytest


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, repeats, empty and odd texts, and extra columns with clashing names."""
    texts = [
        None, "", " ", "a", "a  b\tc", "a b c", "One two three four five six seven.", "One two three four five six seven.",
        "it's 'tis we'll 123 ... \n\n x<|endoftext|>y", "漢字 und Übergröße 🙂 !", "word " * 3000, "é" * 400,
    ]
    rows = [(i, t, None if i % 3 else "en", None, len(t or ""), "x", 1.0, True) for i, t in enumerate(texts)]
    rows += [rows[6], (None, "no id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __key string, score double, kept boolean")
