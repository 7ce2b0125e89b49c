"""Exact deduplication: two Bloom passes decide which rows need a shuffle at all.

Pass 1 hashes every normalised text into ``CELLS_PER_TEXT`` cells of a filter and
keeps the cells that were hit more than once. Pass 2 looks each text up: one of
whose cells was hit once only cannot repeat, and passes straight through. Only
the rest is grouped by SHA-256. The filter never misses a repeat, so the result
is exact; a crowded filter only sends more rows through the shuffle.

Defined cases. A null text counts as empty. Of equal texts the smallest doc_id
stays; null ids count last, and a group of null ids only keeps its rows. Rows
that repeat id and text are one document: ``exact_duplicates`` marks all of them
alike, ``drop_exact_duplicates`` leaves one. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.llm.common import written

#: Cells of the filter for each text that may come, and those that a text hits.
CELLS_FOR_TEXT = 16
CELLS_PER_TEXT = 2
#: Most cells of the filter. Its table has a row of 16 bytes for 64 cells, so at
#: most 4,194,304 rows and 64 MB go to each executor.
MOST_CELLS = 1 << 28
#: Tasks over which the rows of one group of equal texts are spread.
SALTS = 16


def normalised(text: Column) -> Column:
    """Each run of blanks, tabs and line breaks as one space; null as empty.

    The pattern leaves out single spaces, which are most of the runs.
    """
    runs = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
    return F.regexp_replace(F.coalesce(text, F.lit("")), runs, " ")


def _cells(key: Column, cells: int) -> list[Column]:
    return [F.pmod(key if i == 0 else F.xxhash64(key, F.lit(i)), F.lit(cells)) for i in range(CELLS_PER_TEXT)]


def filter_size(rows: int) -> int:
    return min(MOST_CELLS, 1 << max(10, (CELLS_FOR_TEXT * rows - 1).bit_length()))


def hit_cells(keys: DataFrame, cells: int, times: int) -> DataFrame:
    """Pass 1: the filter as rows ``__word`` (64 cells) and ``__bits``, of cells hit so often or more.

    ``keys`` has one column ``__key`` of 64-bit hashes.
    """
    hit = keys.select(F.explode(F.array(*_cells(F.col("__key"), cells))).alias("__cell"))
    twice = hit.groupBy("__cell").agg(F.count("*").alias("__n")).filter(F.col("__n") >= times)
    bit = F.expr("shiftleft(1L, cast(__cell % 64 as int))")
    return twice.groupBy(F.expr("__cell div 64").alias("__word")).agg(F.bit_or(bit).alias("__bits"))


def with_flag(rows: DataFrame, words: DataFrame, cells: int) -> DataFrame:
    """Pass 2: ``rows`` (with ``__key``) and ``__maybe``, true if the filter has all cells of the key."""
    out, tests = rows, []
    for i, cell in enumerate(_cells(F.col("__key"), cells)):
        side = words.select(F.col("__word").alias(f"__w{i}"), F.col("__bits").alias(f"__b{i}"))
        out = out.withColumn(f"__c{i}", cell)
        out = out.join(F.broadcast(side), F.expr(f"__c{i} div 64") == F.col(f"__w{i}"), "left")
        tests.append(F.expr(f"coalesce((shiftright(__b{i}, cast(__c{i} % 64 as int)) & 1L) = 1L, false)"))
    keep = [F.col(f"`{c}`") for c in rows.columns]
    return out.select(*keep, (tests[0] & tests[1]).alias("__maybe"))


def _with_key(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("__norm", normalised(F.col(f"`{text}`"))).withColumn("__key", F.xxhash64("__norm"))


def _filter_of(docs: DataFrame, text: str) -> tuple[DataFrame, int]:
    cells = filter_size(docs.count())
    return written(hit_cells(_with_key(docs.select(f"`{text}`"), text).select("__key"), cells, 2)), cells


def _judged(flagged: DataFrame) -> DataFrame:
    """``__id, __sha, __maybe`` with the id that stays and the group's size."""
    groups = (
        flagged.filter("__maybe").groupBy("__sha").agg(F.min("__id").alias("__keep"), F.count("*").alias("__size"))
    )
    salted = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    maybe = flagged.filter("__maybe").withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int"))
    hit = maybe.join(salted, ["__sha", "__salt"]).select("__id", "__sha", "__keep", "__size")
    rest = flagged.filter("not __maybe").select("__id", "__sha", F.col("__id").alias("__keep"), F.lit(1).cast("long").alias("__size"))
    return rest.unionByName(hit)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    words, cells = _filter_of(docs, text_col)
    rows = _with_key(docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text")), "__text")
    rows = rows.select("__id", "__key", F.sha2("__norm", 256).alias("__sha"))
    flagged = written(with_flag(rows, words, cells).select("__id", "__sha", "__maybe"))
    return _judged(flagged).select(
        F.col("__id").alias("doc_id"),
        F.col("__keep").alias("keep_id"),
        F.col("__size").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    words, cells = _filter_of(docs, text_col)
    flagged = with_flag(_with_key(docs, text_col), words, cells)
    rest = flagged.filter("not __maybe").select(*[f"`{c}`" for c in docs.columns])
    maybe = flagged.filter("__maybe").withColumn("__sha", F.sha2("__norm", 256))
    keep = maybe.groupBy("__sha").agg(F.min(f"`{id_col}`").alias("__keep"))
    keep = keep.select(F.col("__keep"), F.col("__sha").alias("__of"))
    stay = maybe.join(keep, F.col(f"`{id_col}`").eqNullSafe(F.col("__keep")) & (F.col("__sha") == F.col("__of")), "left_semi")
    stay = stay.dropDuplicates([id_col, "__sha"])
    return rest.unionByName(stay.select(*[f"`{c}`" for c in docs.columns]))
