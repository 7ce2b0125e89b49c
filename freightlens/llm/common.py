"""Helpers shared by the operators: written tables, fold columns, batches of texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freightlens.session import shared_folder

#: Characters of text handled at a time inside a task; one longer text is a slice of its own.
SLICE_CHARS = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df``, written to the cluster's shared folder and read back.

    Later jobs start from the files, so a lost executor costs no recomputation
    and nothing is computed twice.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column, modulus: int) -> Column:
    """True where the remainder is 2; a null id is never held out (nor learned from)."""
    return F.coalesce(remainder(doc_id, modulus) == 2, F.lit(False))


def learned_from(doc_id: Column, modulus: int) -> Column:
    return F.coalesce(remainder(doc_id, modulus) != 2, F.lit(False))


SCALE = 1 << 30


def sample_place(key: Column) -> Column:
    """Where a hash of ``key`` puts a row, from 0 to ``SCALE``."""
    return F.pmod(F.xxhash64(key, F.lit(17)), F.lit(SCALE))


def sample_limit(bound: int, total: int) -> int:
    """About ``bound`` of ``total`` rows have their place below this."""
    return min(SCALE, int(SCALE * bound / max(total, 1)))


def is_sampled(key: Column, bound: int, total: int) -> Column:
    """True for about ``bound`` of ``total`` rows (all if there are fewer), by a hash of ``key`` alone."""
    return sample_place(key) < sample_limit(bound, total)


def sampled(rows: DataFrame, key: Column, bound: int, total: int) -> DataFrame:
    return rows.filter(is_sampled(key, bound, total))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that each slice holds about ``SLICE_CHARS`` of text, whole rows only."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // SLICE_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array, nulls as empty; offsets start at 0."""
    texts = pc.fill_null(texts, b"" if pa.types.is_large_binary(texts.type) else "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    off = off.astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """A binary array over ``data`` cut at ``offsets``."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)


def taken(offsets: np.ndarray, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, data) of the given rows of a ragged array, one behind the other."""
    lengths = (offsets[1:] - offsets[:-1])[rows]
    out = np.concatenate([[0], np.cumsum(lengths)])
    return out, data[np.arange(out[-1]) + np.repeat(offsets[rows] - out[:-1], lengths)]
