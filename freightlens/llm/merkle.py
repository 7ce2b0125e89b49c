"""Merkle manifest of a dataset, with a proof for every row by pointer jumping.

A row is a leaf: the SHA-256 of its fields, each ``-`` if null, else its UTF-8 byte
count, ``:`` and the value. Leaves of one source, in the order of their ids, are
hashed in runs of ``FANOUT`` until one node is left, the source's subroot; subroots in
the order of the sources (null first, bytewise) are hashed in runs likewise, to the
root. Digests are joined as hex text.

Every node holds a pointer to an ancestor and the segment of siblings on the way to it
(what goes to the left and to the right of the running digest, by level). At first the
ancestor is the parent. Each round joins the nodes with themselves: a node takes over its
ancestor's pointer and puts that one's segment behind its own, which doubles
the distance, so a tree of depth d takes log2(d) rounds until all are at the root. The
leaves of a run share the node above them, so their run travels as one row and
is opened at the end, when each leaf gets its proof: the rest of its run, then that segment.

Ranks are taken without a group in one task: leaves are range-partitioned by (source, id),
numbered within their partition, and only the counts of (partition, source) are added
up. A node near the root is the ancestor of very many; each knows how many runs are below
it, and the join is salted by that number: the many are dealt to salts and the one node
repeated for each, ``SALT_RUNS`` runs a salt. All tables on the way are written, so a lost
executor costs a few tasks.

Defined cases: null fields are ``-``; equal ids of a source are ordered by digest; rows
without id come first in their source; repeated rows are leaves of their own; a source of one row
has its leaf as subroot, one source its subroot as root; an empty table gives no rows;
very long texts are hashed whole; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightlens.llm.common import remainder, written

FANOUT = 16
#: Bottom runs below a node for each repetition of it in a round's join.
SALT_RUNS = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Number of the tree over the subroots; those of the sources count from 0.
TOP = -1
_SEGMENT = "array<struct<left: string, right: string>>"


def leaf_digest(fields: dict[str, Column]) -> Column:
    def said(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[said(c) for c in fields.values()]), 256)


def _lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, key, leaf, tampered``: the key orders sources; ``tampered`` is null where nothing is tampered with."""
    fields = {name: F.col(f"`{name}`") for name in FIELDS}
    changed = fields | {"text": _lower_ascii(fields["text"])}
    key = F.coalesce(F.concat(F.lit("s"), fields["source"].cast("string")), F.lit("n"))
    tampered = F.when(remainder(fields["doc_id"], 5) == 0, leaf_digest(changed))
    return docs.select(fields["doc_id"].cast("long").alias("doc_id"), key.alias("key"), leaf_digest(fields).alias("leaf"), tampered.alias("tampered"))


def ranked(rows: DataFrame) -> DataFrame:
    """Written ``rows`` with ``tree`` (their source's number), ``place`` within it and its ``size``, from 0."""
    ordered = rows.withColumn("tie", F.monotonically_increasing_id())  # of written rows, so the same in a second try
    ordered = ordered.repartitionByRange("key", "doc_id", "leaf", "tie").sortWithinPartitions("key", "doc_id", "leaf", "tie").drop("tie")
    number = F.monotonically_increasing_id()
    rows = written(ordered.withColumn("at", number).select("*", F.shiftright("at", 33).alias("part")))
    spans = rows.groupBy("part", "key").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    spans = written(spans)  # a row for each source of each partition
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("key")
    offsets = spans.select("part", "key", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("size"), F.min("first").over(whole).alias("begin"))
    # sources by the partition that they begin in: the order of partitions is that of sources
    begun = spans.groupBy("key").agg(F.min("first").alias("begin")).withColumn("part", F.shiftright("begin", 33))
    sums = begun.groupBy("part").agg(F.count("*").alias("m"))
    sums = sums.select("part", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("sources"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("begin")) - 1
    trees = begun.withColumn("nth", nth).join(sums, "part").select("begin", (F.col("sources") + F.col("nth")).alias("tree"))
    spans = offsets.join(trees, "begin").select("part", "key", "first", "before", "size", "tree")
    return rows.join(spans, ["part", "key"]).select("doc_id", "leaf", "tampered", "tree", (F.col("before") + F.col("at") - F.col("first")).alias("place"), "size")


def _height(size: Column) -> Column:
    """Levels that turn ``size`` nodes into one, by comparisons with whole numbers only."""
    return reduce(lambda a, b: a + b, [(size > F.lit(FANOUT**k)).cast("int") for k in range(15)])


def bottom_runs(ranks: DataFrame) -> DataFrame:
    """Leaves by run: ``tree, run, height, members (place, doc_id, leaf, tampered), digest``."""
    members = F.sort_array(F.collect_list(F.struct("place", "doc_id", "leaf", "tampered")))
    runs = ranks.groupBy("tree", F.floor(F.col("place") / FANOUT).alias("run"), _height(F.col("size")).alias("height")).agg(members.alias("members"))
    joined = F.array_join(F.col("members.leaf"), "")
    return runs.withColumn("digest", F.when(F.col("height") == 0, F.col("members")[0]["leaf"]).otherwise(F.sha2(joined, 256)))


def _grouped(nodes: DataFrame) -> DataFrame:
    """The next level: ``tree, height, idx, children (idx, digest, weight), digest, weight``."""
    group = nodes.groupBy("tree", "height", F.floor(F.col("idx") / FANOUT).alias("idx"))
    level = group.agg(F.sort_array(F.collect_list(F.struct(F.col("idx"), "digest", "weight"))).alias("children"), F.sum("weight").alias("weight"))
    return level.withColumn("digest", F.sha2(F.array_join(F.col("children.digest"), ""), 256))


def _climb(nodes: DataFrame, level: int, most: int) -> list[tuple[int, DataFrame]]:
    """(level, its runs) of ``nodes``, which have ``tree, height, idx, digest, weight``, up to the highest tree."""
    out = []
    for at in range(level, most):
        runs = written(_grouped(nodes.filter(F.col("height") > at)))
        out.append((at, runs))
        nodes = runs.select("tree", "height", "idx", "digest", "weight")
    return out


def _pointers(level: int, runs: DataFrame) -> DataFrame:
    """Each child of a run with its parent as ancestor and its siblings as segment."""
    digests = F.col("children.digest")
    top = F.col("height") == level + 1  # the run's node is a source's subroot, a child of the tree over all
    rows = runs.select(
        "tree",
        F.posexplode("children").alias("pos", "child"),
        F.when((F.col("tree") != TOP) & top, F.lit(TOP)).otherwise(F.col("tree")).cast("long").alias("up_tree"),
        F.when((F.col("tree") != TOP) & top, 0).otherwise(level + 1).alias("up_level"),
        F.when((F.col("tree") != TOP) & top, F.col("tree")).otherwise(F.col("idx")).alias("up_idx"),
        F.col("weight").alias("up_weight"),
        digests.alias("digests"),
    )
    left = F.array_join(F.slice("digests", F.lit(1), F.col("pos")), "")
    right = F.array_join(F.slice("digests", F.col("pos") + 2, F.lit(FANOUT)), "")
    is_subroot = F.lit(level == 0) & (F.col("tree") == TOP)
    return rows.select(
        F.col("tree").cast("long").alias("tree"),
        F.lit(level).alias("level"),
        F.col("child.idx").alias("idx"),
        F.col("child.weight").alias("weight"),
        "up_tree",
        "up_level",
        "up_idx",
        "up_weight",
        F.array(F.struct(left.alias("left"), right.alias("right"))).cast(_SEGMENT).alias("segment"),
        F.when(is_subroot, F.col("child.digest")).alias("subroot"),
    )


def _at(level: str, tree: str, idx: str, root: tuple[int, int, int]) -> Column:
    return (F.col(tree) == root[0]) & (F.col(level) == root[1]) & (F.col(idx) == root[2])


def jump(pointers: DataFrame, root: tuple[int, int, int]) -> DataFrame:
    """One round: nodes whose ancestor is not the root take over its pointer."""
    done = _at("up_level", "up_tree", "up_idx", root)
    salts = lambda weight: F.ceil(F.col(weight) / SALT_RUNS)
    far = pointers.filter(~done).withColumn("salt", F.pmod(F.xxhash64("tree", "level", "idx"), salts("up_weight")))
    target = pointers.select(
        F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("idx").alias("up_idx"),
        F.col("up_tree").alias("to_tree"), F.col("up_level").alias("to_level"), F.col("up_idx").alias("to_idx"), F.col("up_weight").alias("to_weight"),
        F.col("segment").alias("more"), F.col("subroot").alias("its_subroot"),
        F.explode(F.sequence(F.lit(0).cast("long"), salts("weight") - 1)).alias("salt"),
    )
    moved = far.join(target, ["up_tree", "up_level", "up_idx", "salt"]).select(
        "tree", "level", "idx", "weight",
        F.col("to_tree").alias("up_tree"), F.col("to_level").alias("up_level"), F.col("to_idx").alias("up_idx"), F.col("to_weight").alias("up_weight"),
        F.concat("segment", "more").alias("segment"), F.coalesce("subroot", "its_subroot").alias("subroot"),
    )
    return pointers.filter(done).unionByName(moved)


def proofs(docs: DataFrame) -> DataFrame:
    """One row per leaf: ``doc_id, leaf, tampered, tree, rest`` (of its run: left, right), ``alone``, ``segment, subroot, root``."""
    ranks = ranked(written(leaves(docs)))
    bottom = written(bottom_runs(ranks))
    shape = bottom.agg(F.max("tree"), F.max("height")).first()
    if shape[0] is None:
        return bottom.select(F.lit(None).alias("segment"), F.lit("").alias("subroot"), F.lit("").alias("root"), F.explode("members").alias("m"), F.lit(0).alias("height"), "members")
    sources, height = shape[0] + 1, shape[1]
    one = F.lit(1).cast("long").alias("weight")
    levels = _climb(bottom.select("tree", "height", F.col("run").alias("idx"), "digest", one), 1, height)
    low = bottom.filter(F.col("height") <= 1).select("tree", "digest", one)
    tops = [low, *[runs.filter(F.col("height") == at + 1).select("tree", "digest", "weight") for at, runs in levels]]
    subroots = written(reduce(DataFrame.unionByName, tops))
    summit = next(k for k in range(15) if sources <= FANOUT**k)
    over = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(summit).alias("height"), F.col("tree").alias("idx"), "digest", "weight")
    above = _climb(over, 0, summit)
    top = above[-1][1] if above else over
    digest = top.select("digest").first()[0]
    root = (TOP, summit, 0)

    pointers = [_pointers(at, runs) for at, runs in levels + above]
    pointers = written(reduce(DataFrame.unionByName, pointers)) if pointers else None
    distance, depth = 1, max(height - 1, 0) + summit
    while distance < depth:
        pointers = written(jump(pointers, root))
        distance *= 2

    # a source whose one run is its subroot is a child of the tree over all
    low = F.col("height") <= 1
    node = bottom.select("members", "height", F.when(low, F.lit(TOP)).otherwise(F.col("tree")).cast("long").alias("tree"), F.when(low, 0).otherwise(1).alias("level"), F.when(low, F.col("tree")).otherwise(F.col("run")).alias("idx"))
    if pointers is None:  # one source of one run
        found = node.select("members", "height", F.lit(None).cast(_SEGMENT).alias("segment"), F.lit(digest).alias("subroot"))
    else:
        found = node.join(pointers.select("tree", "level", "idx", "segment", "subroot"), ["tree", "level", "idx"], "left")
    return found.select("segment", F.coalesce("subroot", F.lit(digest)).alias("subroot"), F.lit(digest).alias("root"), F.explode("members").alias("m"), "height", "members")


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``folded_root`` is computed from the tampered leaf, where there is one, and the siblings.
    """
    opened = proofs(docs)
    digests, pos = F.col("members.leaf"), F.col("m.place") % FANOUT
    opened = opened.select(
        "m.*", "subroot", "root", "height",
        F.coalesce("segment", F.array().cast(_SEGMENT)).alias("segment"),
        F.array_join(F.slice(digests, F.lit(1), pos.cast("int")), "").alias("left"),
        F.array_join(F.slice(digests, pos.cast("int") + 2, F.lit(FANOUT)), "").alias("right"),
    )
    siblings = F.concat("left", "right", F.array_join(F.transform("segment", lambda s: F.concat(s["left"], s["right"])), ""))
    mine = F.coalesce("tampered", "leaf")
    start = F.when(F.col("height") == 0, mine).otherwise(F.sha2(F.concat("left", mine, "right"), 256))
    folded = F.aggregate("segment", start, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))
    out = opened.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
