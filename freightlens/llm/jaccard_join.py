"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

1. One pass hashes each text's words: a key of its word sequence, and a signature of
   ``TREES`` labels of ``DEEPEST`` minima each. Texts of the same words form a class,
   and its smallest doc_id represents it.
2. Each tree is a prefix trie of labels. Matching starts at whole labels; a pair at
   the threshold is found there with a known probability, so the matched prefix is
   shortened level by level until that probability reaches the target recall. Only
   prefixes that two classes share go on.
3. A node's members are dealt to tiles of ``TILE`` by a hash, and each pair of tiles
   is a group of its own, so a node that holds a third of all texts is many bounded
   groups. A pair is looked at in the first tree that it shares and nowhere else.
   Signatures first drop pairs that are far from the threshold (at 6 standard deviations).
4. What remains is verified on the whole shingle sets. Groups return each text's
   number of links and its smallest connected member, never their pairs.
5. Connected components give each document its near-duplicate class.

Links are exact; one at the threshold is missed with a probability of at most
1 - target (less above it). Work inside a node grows with the square of its members,
as their links do; rows moved grow with members times tiles.

Defined cases. Null and empty texts have no shingles: they are copies of each
other and have no links. Rows without id get the class of their equal texts, or null.
Of an id repeated with different texts, the one of the smallest key takes part in
links; the others only have copies. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.llm.common import slices, written
from freightlens.llm.components import components
from freightlens.llm.words import mixed, shingle_hashes, word_hashes

THRESHOLD = 0.8
TREES = 16
DEEPEST = 6
TARGET_RECALL = 0.9995
TILE = 256
_LENGTH = TREES * DEEPEST
_FACTORS = mixed(np.arange(1, _LENGTH + 1, dtype=np.uint64)) | np.uint64(1)


def recall_at(depth: int, threshold: float) -> float:
    """The chance that a pair at the threshold shares a prefix of this depth in some tree."""
    return 1 - (1 - threshold**depth) ** TREES


def shortened(threshold: float, target: float) -> int:
    """The longest prefix that reaches the target recall."""
    for depth in range(DEEPEST, 0, -1):
        if recall_at(depth, threshold) >= target:
            return depth
    raise ValueError(f"no prefix reaches a recall of {target} at a similarity of {threshold}")


def least_agreement(threshold: float) -> int:
    """Equal minima that a pair at the threshold has but for 6 standard deviations."""
    return int(_LENGTH * threshold - 6 * (_LENGTH * threshold * (1 - threshold)) ** 0.5)


def signatures(offsets: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """[texts, TREES * DEEPEST] 16-bit fingerprints of minima; all texts have shingles."""
    out = np.empty((len(offsets) - 1, _LENGTH), np.uint16)
    for k, factor in enumerate(_FACTORS):
        low = np.minimum.reduceat((shingles * factor) >> np.uint64(24), offsets[:-1])
        out[:, k] = mixed(low + np.uint64(k)) >> np.uint64(48)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(rows)
    return pa.array([r.tobytes() for r in raw], pa.binary())


def _sketches(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            off, words = word_hashes(part.column("text"))
            keys = [hashlib.md5(words[a:b].tobytes()).digest() for a, b in zip(off[:-1], off[1:], strict=True)]
            s_off, shingles = shingle_hashes(off, words)
            some = np.flatnonzero(np.diff(s_off))
            found: list[bytes | None] = [None] * part.num_rows
            if len(some):
                for i, row in zip(some, signatures(np.append(s_off[some], s_off[-1]), shingles), strict=True):
                    found[i] = row.tobytes()
            yield pa.record_batch([part.column("doc_id"), pa.array(keys, pa.binary()), pa.array(found, pa.binary())], ["doc_id", "key", "sig"])

    return docs.mapInArrow(run, "doc_id long, key binary, sig binary")


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), _LENGTH)


def _nodes(reps: DataFrame, depth: int) -> DataFrame:
    """(rep, tree, node): the trie node that each class reaches at ``depth`` in each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                labels = _signs(batch.column("sig")).reshape(-1, TREES, DEEPEST)[:, :, :depth].astype(np.uint64)
                node = np.zeros(labels.shape[:2], np.uint64)
                for level in range(depth):
                    node = mixed(node * np.uint64(31) + labels[:, :, level])
                reps = np.repeat(batch.column("rep").to_numpy(), TREES)
                tree = np.tile(np.arange(TREES, dtype=np.int32), batch.num_rows)
                yield pa.record_batch([pa.array(reps), pa.array(tree), pa.array(node.reshape(-1).view(np.int64))], ["rep", "tree", "node"])

    return reps.select("rep", "sig").mapInArrow(run, "rep long, tree int, node long")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of equal keys of sorted batches, whole, also across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _candidates(group: pa.Table, depth: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the rows of a group that may be linked and that are looked at in this tree and tile pair."""
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(-1, _LENGTH)
    lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
    if lo == hi:
        left = right = np.arange(len(sig))
    else:
        side = group.column("tile").to_numpy()
        left, right = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
    tree = group.column("tree")[0].as_py()
    found_i, found_j = [], []
    for i in left:
        others = right[right > i] if lo == hi else right
        equal = sig[others] == sig[i]
        near = equal.sum(axis=1) >= least
        near &= group_first(equal, depth) == tree
        found_i.append(np.full(near.sum(), i))
        found_j.append(others[near])
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def group_first(equal: np.ndarray, depth: int) -> np.ndarray:
    """The first tree in which a pair shares the prefix, -1 for none."""
    shared = equal.reshape(-1, TREES, DEEPEST)[:, :, :depth].all(axis=2)
    return np.where(shared.any(axis=1), shared.argmax(axis=1), -1)


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common shingles of each pair."""
    if len(i) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    values, index, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    number = np.cumsum(count > 1) - 1  # only shingles of two texts or more can be common
    keep = count[index] > 1
    row, column = row[keep], number[index[keep]]
    total = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int((count > 1).sum()), 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        block = np.zeros((len(sets), 4096), np.float32)
        block[row[a:b], column[a:b] - start] = 1
        total += block @ block.T
    return total[i, j].astype(np.int64)


def _smallest(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of n rows, the smallest id in its component of the links (i, j)."""
    label = ids.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        if (new == label).all():
            return label
        label = new


_TASK = ["tree", "node", "lo", "hi"]


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            off, words = word_hashes(part.column("text"))
            s_off, shingles = shingle_hashes(off, words)
            ids, found = [], []
            for n, (doc, key) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("key").to_pylist(), strict=True)):
                if hashlib.md5(words[off[n] : off[n + 1]].tobytes()).digest() == key:
                    ids.append(doc)
                    found.append(np.unique(shingles[s_off[n] : s_off[n + 1]]).tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["rep", "shingles"])

    rows = docs.join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id").select("text", "doc_id", "key")
    return rows.mapInArrow(run, "rep long, shingles binary").dropDuplicates(["rep"])


def jaccard_links(docs: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, copy_of, n_links.

    ``copy_of`` is the smallest id of the same words, ``n_links`` the number of other
    classes of copies at the threshold or above, ``class_id`` the smallest id that
    links lead to.
    """
    depth, least = shortened(threshold, target_recall), least_agreement(threshold)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sketches = written(_sketches(docs))
    classes = sketches.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    classes = written(classes)
    reps = classes.filter("rep is not null and sig is not null")
    reps = written(reps.groupBy("rep").agg(F.min(F.struct("key", "sig")).alias("x")).select("rep", "x.key", "x.sig"))

    nodes = written(_nodes(reps, depth))
    shared = nodes.groupBy("tree", "node").agg(F.count("*").alias("n")).filter("n > 1")
    tiles = nodes.join(shared, ["tree", "node"]).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    tiles = tiles.withColumn("tile", F.pmod(F.xxhash64("rep", "tree"), "tiles").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    tasks = tiles.select("rep", "tree", "node", "tile", other)
    tasks = tasks.select("rep", "tree", "node", "tile", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, _TASK):
            i, j = _candidates(group, depth, least)
            if len(i):
                yield from group.take(np.unique(np.concatenate([i, j]))).combine_chunks().to_batches()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, _TASK):
            i, j = _candidates(group, depth, least)
            sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
            size = np.array([len(s) for s in sets])
            common = _intersections(sets, i, j)
            linked = common >= threshold * (size[i] + size[j] - common) - 1e-9
            i, j = i[linked], j[linked]
            if len(i):
                ids = group.column("rep").to_numpy()
                n = np.bincount(np.concatenate([i, j]), minlength=len(ids))
                some = np.flatnonzero(n)
                root = _smallest(len(ids), i, j, ids)
                yield pa.record_batch([pa.array(ids[some]), pa.array(root[some]), pa.array(n[some])], ["u", "v", "n"])

    fields = "rep long, tree int, node long, tile int, lo int, hi int, sig binary"
    dealt = tasks.join(reps.select("rep", "sig"), "rep").select("rep", *_TASK[:2], "tile", "lo", "hi", "sig")
    dealt = dealt.repartition(*_TASK).sortWithinPartitions(*_TASK, "rep")
    kept = written(dealt.mapInArrow(near, fields))
    wanted = kept.select("rep").distinct().join(reps.select("rep", "key"), "rep")
    sets = _shingle_sets(docs, wanted)
    full = kept.join(sets, "rep").repartition(*_TASK).sortWithinPartitions(*_TASK, "rep")
    links = written(full.mapInArrow(verify, "u long, v long, n long"))

    labels = components(links.select("u", "v"))
    degree = links.groupBy("u").agg(F.sum("n").alias("n_links"))
    of_rep = classes.select("key", "rep").join(degree.join(labels, F.col("u") == F.col("node")), F.col("rep") == F.col("u"), "left")
    of_rep = of_rep.join(reps.select(F.col("rep").alias("r2"), F.col("key").alias("k2")), (F.col("rep") == F.col("r2")) & (F.col("key") == F.col("k2")), "left")
    takes_part = F.col("r2").isNotNull() & F.col("label").isNotNull()
    of_rep = of_rep.select(
        "key",
        F.when(takes_part, F.col("label")).otherwise(F.col("rep")).alias("class_id"),
        F.col("rep").alias("copy_of"),
        F.when(takes_part, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )
    return sketches.select("doc_id", "key").join(of_rep, "key").select("doc_id", "class_id", "copy_of", "n_links")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each class the smallest id; rows without id all stay."""
    gone = jaccard_links(docs, threshold, id_col=id_col, text_col=text_col).filter("class_id <> doc_id")
    gone = gone.select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")
