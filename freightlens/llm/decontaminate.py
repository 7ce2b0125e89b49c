"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A seed is a fixed mask over word positions; words at its gaps are ignored, so a
substituted word there does not matter. Each mask hashes every position of the
benchmark's items and of the documents. The document hashes first meet a filter of
the benchmark's hashes, whose table has a fixed upper size and is broadcast; only
what may match is joined with the seeds. A hit names a document, an item and how
far they are shifted. The words of both are then compared along that shift: they
overlap where ``WINDOW`` words in a row agree in all but ``SUBSTITUTIONS``. The two
masks together find every such window (a test tries all substitutions), so the
result equals comparing everything.

Words are lower-case runs of characters other than blanks, tabs and line breaks.
Defined cases: null and empty texts have no overlaps; an item of fewer than
``WINDOW`` words is not looked for; a row is told by its id and the digest of its
text, so rows without id and rows that share an id are each judged by their own
text; clashing columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.llm.common import written
from freightlens.llm.exact_dedup import filter_size, hit_cells, with_flag

#: Positions of the words that count. Any 13 words with 2 substitutions still match one of the masks.
MASKS = ((0, 2, 4, 5, 6, 7), (0, 1, 2, 3, 6, 8))
WINDOW = 13
SUBSTITUTIONS = 2


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(words: str) -> Column:
    """Array of (mask's hash at a position, position) over the array column ``words``."""
    per_mask = []
    for number, mask in enumerate(MASKS):
        last = f"size({words}) - {mask[-1] + 1}"
        picked = ", ".join(f"{words}[__i + {o}]" for o in mask)
        per_mask.append(
            f"if({last} < 0, array(), transform(sequence(0, greatest({last}, 0)), __i -> struct(xxhash64({number}, {picked}) as key, __i as at)))"
        )
    return F.expr(f"concat({', '.join(per_mask)})")


def _hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (__doc, __row, __item, __shift) of seed matches."""
    seeds = items.select("__item", F.explode(_seeds("__iw")).alias("s")).select("__item", F.col("s.key").alias("__key"), F.col("s.at").alias("__item_at"))
    seeds = written(seeds.distinct())
    cells = filter_size(8 * seeds.count())
    words = written(hit_cells(seeds.select("__key"), cells, 1))
    found = docs.select("__doc", "__row", F.explode(_seeds("__dw")).alias("s")).select("__doc", "__row", F.col("s.key").alias("__key"), F.col("s.at").alias("__doc_at"))
    maybe = with_flag(found, words, cells).filter("__maybe").select("__doc", "__row", "__key", "__doc_at")
    shift = (F.col("__doc_at") - F.col("__item_at")).alias("__shift")
    return maybe.join(seeds, "__key").select("__doc", "__row", "__item", shift).distinct()


def _windows() -> Column:
    """Array of (first item position, agreeing words) of the windows along a shift that overlap."""
    flags = "transform(sequence(__lo, __hi), i -> if(__dw[i + __shift] = __iw[i], 1, 0))"
    return F.expr(
        f"""transform(array({flags}), f ->
              filter(
                transform(sequence(0, size(f) - {WINDOW}), s -> struct(s + __lo as at, aggregate(slice(f, s + 1, {WINDOW}), 0, (a, x) -> a + x) as agree)),
                w -> w.agree >= {WINDOW - SUBSTITUTIONS}))[0]"""
    )


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _judged(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """The (__doc, __row, __item, __shift) that overlap, with their windows ``__w``; __row is the text's digest."""
    items = benchmark.select(F.col(f"`{item_col}`").alias("__item"), word_hashes(F.col(f"`{item_text}`")).alias("__iw")).filter(F.size("__iw") >= WINDOW)
    items = written(items.distinct())
    rows = docs.select(F.col(f"`{id_col}`").alias("__doc"), _digest(F.col(f"`{text_col}`")).alias("__row"), F.col(f"`{text_col}`").alias("__text"))
    hits = written(_hits(rows.select("__doc", "__row", word_hashes(F.col("__text")).alias("__dw")), items))
    # the filter keeps documents without hits out of the join's shuffle
    ids = hits.select(F.xxhash64("__doc", "__row").alias("__key")).distinct()
    cells = filter_size(hits.count())
    chosen = with_flag(rows.withColumn("__key", F.xxhash64("__doc", "__row")), written(hit_cells(ids, cells, 1)), cells).filter("__maybe")
    once = chosen.select(F.col("__doc").alias("__d"), F.col("__row").alias("__r"), "__text").dropDuplicates(["__d", "__r"])
    joined = hits.join(once, (F.col("__row") == F.col("__r")) & F.col("__doc").eqNullSafe(F.col("__d")))
    joined = joined.join(items.withColumnRenamed("__item", "__i"), F.col("__item").eqNullSafe(F.col("__i")))
    joined = joined.withColumn("__dw", word_hashes(F.col("__text")))
    joined = joined.withColumns({"__lo": F.greatest(F.lit(0), -F.col("__shift")), "__hi": F.least(F.size("__iw"), F.size("__dw") - F.col("__shift")) - 1})
    return joined.filter(f"__hi - __lo + 1 >= {WINDOW}").withColumn("__w", _windows()).filter("size(__w) > 0")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per overlap: doc_id, item_id, shift, doc_from, doc_to (words, end excluded), item_from, agree (the most in a window)."""
    return _judged(docs, benchmark, id_col, text_col, item_col, item_text).select(
        F.col("__doc").alias("doc_id"),
        F.col("__item").alias("item_id"),
        F.col("__shift").cast("long").alias("shift"),
        F.expr("cast(array_min(__w.at) + __shift as long)").alias("doc_from"),
        F.expr(f"cast(array_max(__w.at) + __shift + {WINDOW} as long)").alias("doc_to"),
        F.expr("cast(array_min(__w.at) as long)").alias("item_from"),
        F.expr("cast(array_max(__w.agree) as long)").alias("agree"),
    ).distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` without overlaps."""
    found = _judged(docs, benchmark, id_col, text_col, item_col, item_text).select(F.col("__doc").alias("__gone"), "__row").distinct()
    same = (_digest(F.col(f"`{text_col}`")) == F.col("__row")) & F.col(f"`{id_col}`").eqNullSafe(F.col("__gone"))
    return docs.join(found, same, "left_anti")
