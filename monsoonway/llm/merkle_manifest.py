"""A Merkle manifest of a table of documents, kept as an external-memory store of nodes.

Each row is a leaf. The leaves of a language are a tree, its top the subroot; the subroots are the leaves of one more
tree, whose top is the root. In a tree every two consecutive nodes of a level become one of the next, the last one
alone if their number is odd, while more than one remains.

Leaves are range-sorted into runs whose places follow from counts per run, so no tree is ever ranked in one task. The store is
one Parquet folder with a partition for each level. A pass climbs ``SPAN`` levels: a task reads the nodes of aligned blocks of ``2 ** SPAN``
places in sequence and writes the levels above them, each made from the one before; the next pass reads the last of these levels.
Proofs are extracted by a merge-scan from the top pass down: a block's levels and the proof of its own top
are read in order of their coordinates, so a leaf meets all its siblings in one block a pass, and nothing is looked up by key.
A node travels once a climb and once a scan, whatever the height.

A proof is one binary value. Each level gives byte 0 (no sibling), or 1 or 2 and the sibling's digest (1: it stands to
the right); byte 3 and a digest mark the subroot. ``fold`` reads it.

Rows. A null in any column is a value of its own (``-``); a null language is a tree of its own, before all others. Null ids
come first in their tree, ties of an id go by digest, and rows equal in all five columns are leaves of their own side by side.
A text is hashed whole by the JVM, however long. An empty table has no root and no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._runtime import through_parquet, use_shared_checkpoints

#: Levels that a pass climbs: a block holds 2 ** SPAN nodes.
SPAN = 10
#: The level of the row that carries the proof of a block's top; it sorts before all others.
ABOVE = 1 << 20
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "level int, tree string, pos long, width long, digest binary, doc_id long, changed binary"
_PROOF = "tree string, pos long, width long, digest binary, doc_id long, changed binary, path binary"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**instead: Column) -> Column:
    """The digest of a row, as 32 bytes; ``instead`` replaces columns."""
    return F.unhex(F.sha2(F.concat(*(_field(instead.get(c, F.col(c))) for c in FIELDS)).cast("binary"), 256))


def h(*digests: bytes) -> bytes:
    """sha256 of digests as joined hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def height(width: int) -> int:
    """Levels above ``width`` nodes."""
    return max(width - 1, 0).bit_length()


def _height(width: Column) -> Column:
    return F.when(width > 1, F.length(F.bin(width - 1))).otherwise(0)


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves(tree, digest, ...)`` with pos, their place in the order of their tree from 0, and width, the tree's number of leaves."""
    runs = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    runs = through_parquet(runs.withColumn("run", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "merkle_runs")
    counted = runs.groupBy("tree", "run").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    of_tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(of_tree.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = counted.select("tree", "run", (before - F.col("first")).alias("shift"), F.sum("n").over(of_tree).alias("width"))
    return runs.join(counted, ["tree", "run"]).withColumn("pos", F.col("at") + F.col("shift")).drop("run", "at", "shift")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that agree in their first two columns, which come one after another."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != at:
                if held:
                    yield at, held
                at, held = row[:2], []
            held.append(row[2:])
    if held:
        yield at, held


def _climb(level: int, span: int):
    """Rows (tree, block, pos, width, digest) of ``level`` in order to the nodes of up to ``span`` levels above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (tree, block), rows in _blocks(batches):
            width, digests = rows[0][1], [r[2] for r in rows]
            for k in range(1, min(span, height(width)) + 1):
                width = (width + 1) // 2
                digests = [h(*digests[i : i + 2]) for i in range(0, len(digests), 2)]
                first = block << (span - k)
                out += [(level + k, tree, first + i, width, d) for i, d in enumerate(digests)]
            if len(out) >= 4 << span:
                yield _as_batch(out)
                out = []
        yield _as_batch(out)

    return run


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    columns = list(zip(*rows)) or [()] * 5
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
    return pa.record_batch([*arrays, pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.binary())], ["level", "tree", "pos", "width", "digest", "doc_id", "changed"])


@dataclass
class Store:
    """Nodes of trees under ``path``, a partition for each level; ``passes`` climbs of ``span`` levels made the tallest."""

    spark: SparkSession
    path: str
    passes: int
    span: int

    def nodes(self) -> DataFrame:
        return self.spark.read.schema(_NODE).parquet(self.path)

    def tops(self) -> DataFrame:
        """Rows (tree, digest, level) of the one node that remains of each tree."""
        return self.nodes().where("width = 1").select("tree", "digest", "level")


def build(leaves: DataFrame, span: int = SPAN) -> Store:
    """The store of ``leaves(tree, pos, width, digest, doc_id, changed)``."""
    spark = leaves.sparkSession
    use_shared_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/merkle-{uuid.uuid4().hex}"
    leaves.select(F.lit(0).alias("level"), "tree", "pos", "width", "digest", "doc_id", "changed").write.partitionBy("level").parquet(path)
    store = Store(spark, path, 1, span)
    tallest = height(store.nodes().where("level = 0").agg(F.max("width")).first()[0] or 0)
    store.passes = max(1, -(-tallest // span))
    for p in range(-(-tallest // span)):
        open_ = store.nodes().where((F.col("level") == p * span) & (F.col("width") > 1))
        blocks = open_.select("tree", F.shiftright("pos", span).alias("block"), "pos", "width", "digest").repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
        blocks.mapInArrow(_climb(p * span, span), _NODE).write.mode("append").partitionBy("level").parquet(path)
    return store


def _scan(lowest: int):
    """Rows (tree, block, level, pos, width, digest, doc_id, changed, path), levels falling and places rising, to the proofs of the lowest level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("tree", "pos", "width", "digest", "doc_id", "changed", "path")
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
        for (tree, _), rows in _blocks(batches):
            # what stands above each place of the level just read; a level adds its own siblings in front
            above, at, level = {0: b""}, 0, None
            top, levels = b"", {}
            for r in rows:
                if r[0] == ABOVE:
                    top = r[6]
                else:
                    levels.setdefault(r[0], []).append(r)
            for level in sorted(levels, reverse=True):
                own, now = levels[level], {}
                first = own[0][1]
                for i, r in enumerate(own):
                    pos = r[1]
                    if r[2] == 1:
                        now[pos] = top
                        continue
                    rest = above.get(pos >> 1, top) if at else top
                    j = (pos ^ 1) - first
                    if 0 <= j < len(own):
                        now[pos] = (b"\x02" if pos & 1 else b"\x01") + own[j][3] + rest
                    else:
                        now[pos] = b"\x00" + rest
                above, at = now, 1
            own = levels.get(lowest, [])
            if own:
                columns = ([tree] * len(own), [r[1] for r in own], [r[2] for r in own], [r[3] for r in own], [r[4] for r in own], [r[5] for r in own], [above[r[1]] for r in own])
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def proofs(store: Store, tops: DataFrame) -> DataFrame:
    """Rows (tree, pos, width, digest, doc_id, changed, path) of all leaves; ``tops(tree, path)`` says how the top of each tree goes on."""
    nodes = store.nodes()
    none = lambda kind: F.lit(None).cast(kind)
    ends = store.tops().select("tree", F.greatest(F.lit(0), F.ceil(F.col("level") / store.span).cast("int") - 1).alias("pass")).join(tops, "tree")
    found = None
    for p in reversed(range(store.passes)):
        low, high = p * store.span, (p + 1) * store.span
        block = F.expr(f"shiftright(pos, {high} - level)")
        own = nodes.where((F.col("level") >= low) & (F.col("level") < high)).select("tree", block.alias("block"), "level", "pos", "width", "digest", "doc_id", "changed", none("binary").alias("path"))
        # the single node of a tree that ends exactly at this pass's upper edge stands in no block of it
        up = ends.where(F.col("pass") == p).select("tree", F.lit(0).cast("long").alias("pos"), "path")
        if found is not None:
            up = up.unionByName(found.where("width > 1").select("tree", "pos", "path"))
        up = up.select("tree", F.col("pos").alias("block"), F.lit(ABOVE).alias("level"), "pos", none("long").alias("width"), none("binary").alias("digest"), none("long").alias("doc_id"), none("binary").alias("changed"), "path")
        dealt = own.unionByName(up).repartition("tree", "block").sortWithinPartitions(F.col("tree"), F.col("block"), F.col("level").desc(), F.col("pos"))
        found = dealt.mapInArrow(_scan(low), _PROOF)
    return found


def fold(leaf: bytes, path: bytes) -> tuple[bytes, list[bytes], bytes | None]:
    """The root that a leaf and its proof give, the proof's siblings, and the subroot that it names."""
    at, node, siblings, subroot = 0, leaf, [], None
    while at < len(path):
        kind = path[at]
        other = path[at + 1 : at + 33] if kind else b""
        at += 33 if kind else 1
        if kind == 3:
            subroot = other
        elif kind:
            siblings.append(other)
            node = h(node, other) if kind == 1 else h(other, node)
        else:
            node = h(node)
    return node, siblings, subroot


def manifest(docs: DataFrame, changed: Column | None = None, span: int = SPAN) -> tuple[bytes | None, DataFrame]:
    """The root of ``docs``, and rows (tree, pos, width, digest, doc_id, changed, path) with the proof of each.

    ``changed``: a digest to be checked in place of a row's own, null for the own.
    """
    tree = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    other = F.lit(None).cast("binary") if changed is None else changed
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf_digest().alias("digest"), other.alias("changed"), F.monotonically_increasing_id().alias("row"))
    leaves = through_parquet(read, "merkle_leaves")
    store = build(ranked(leaves, ["doc_id", "digest", "row"]), span)
    of_trees = store.tops().select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    named = through_parquet(ranked(of_trees, ["name"]), "merkle_trees")
    none = F.lit(None)
    upper = build(named.select("tree", "pos", "width", "digest", none.cast("long").alias("doc_id"), none.cast("binary").alias("changed")), span)
    top = upper.tops().first()
    ends = proofs(upper, upper.tops().select("tree", F.lit(b"").alias("path"))).select("pos", "path")
    mark = F.concat(F.lit(b"\x03"), F.col("digest"), F.col("path"))
    ends = through_parquet(named.join(ends, "pos").select(F.col("name").alias("tree"), mark.alias("path")), "merkle_ends")
    return (bytes(top["digest"]) if top else None), proofs(store, ends)


def _digests(root: bytes | None):
    """Proofs to the columns of ``verified``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, leaf, changed, path in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "changed", "path"))):
                folded, siblings, subroot = fold(changed or leaf, path)
                out.append((doc_id, leaf.hex(), subroot.hex(), root.hex(), h(*siblings).hex(), folded.hex(), folded == root))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), *[pa.string()] * 5, pa.bool_()))] if out else [pa.array([], k) for k in (pa.int64(), *[pa.string()] * 5, pa.bool_())], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def verified(root: bytes | None, found: DataFrame) -> DataFrame:
    """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): each proof folded from its changed digest, else its own."""
    return found.select("doc_id", "digest", "changed", "path").mapInArrow(_digests(root), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def tampered(docs: DataFrame) -> Column:
    """The digest of a row with 1 more in ``n_chars`` where 7 divides the crc32 of its id, else null."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf_digest(n_chars=F.col("n_chars") + 1))
