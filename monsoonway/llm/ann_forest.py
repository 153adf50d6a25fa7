"""Approximate nearest neighbours by a forest of random-projection trees.

The upper splits of ``TREES`` trees are fitted on at most about ``SAMPLE`` vectors chosen by a hash; below them each leaf
is split further, along directions between its own sample vectors at their medians, until it holds about ``ROWS``
rows of the table, however large that is. Every row is dropped down all trees. A query walks the forest through one
priority queue shared by all trees, nearest split margin first, and collects leaves until they hold ``READS`` rows, or
``SHARE`` of all entries if that is less. So the rows that a query reads do not grow with the table. Candidates are
reranked exactly, by Euclidean distance in double precision on the vectors as given.

Leaves travel in bundles of about ``BLOCK`` rows, and a leaf that a common vector fills is dealt in parts of about
that many, so no task gathers more; each returns no more than the ``k`` best for each of its queries.

Rows. Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do vectors of
another length than the most frequent (the smaller of equally frequent ones), nor rows without an id. Rows that share
a vec_id are one candidate, at their smallest distance, and as a query the one of the smallest vector. Ties go
to the smaller vec_id. An empty table, or one without usable vectors, gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import bounded_sample, worker_slot

TREES = 8
SAMPLE = 16_384
LEAF = 32
#: Rows that a leaf should hold, entries of leaves that a query reads, and the share of all entries that bounds them.
ROWS, READS, SHARE = 128, 80_000, 0.5
BLOCK = 8192
#: Rows that are dropped down a tree at once.
STRIP = 2048


class Tree:
    """Splits as arrays: rows go left below the threshold of their projection; a child < 0 is leaf ~child."""

    def __init__(self, sample: np.ndarray, leaf: int, seed: int) -> None:
        draw = np.random.default_rng(seed)
        normals, thresholds, children = [], [], []
        self.members: list[np.ndarray] = []

        def grow(rows: np.ndarray) -> int:
            if len(rows) > leaf:
                for _ in range(4):
                    a, b = sample[draw.choice(rows, 2, replace=False)]
                    normal = (a - b).astype(np.float64)
                    if (length := np.linalg.norm(normal)) == 0:
                        continue
                    normal /= length
                    along = sample[rows] @ normal
                    cut = float(np.median(along))
                    left = along < cut
                    if left.any() and not left.all():
                        at = len(normals)
                        normals.append(normal)
                        thresholds.append(cut)
                        children.append([0, 0])
                        children[at] = [grow(rows[left]), grow(rows[~left])]
                        return at
            self.members.append(rows)
            return ~(len(self.members) - 1)

        self.root = grow(np.arange(len(sample)))
        self.normals = np.array(normals).reshape(len(normals), sample.shape[1])
        self.thresholds, self.children = np.array(thresholds), np.array(children, np.int64).reshape(-1, 2)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.root)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            right = np.einsum("ij,ij->i", x[inner], self.normals[node]) >= self.thresholds[node]
            at[inner] = self.children[node, right.astype(np.int64)]
        return ~at


class Forest:
    """Trees over one sample of a table of ``total`` rows; leaves are numbered through all trees.

    A leaf of the table is a pair: the number of the sample's leaf, and a code with one bit for each further split.
    """

    def __init__(self, sample: np.ndarray, total: int | None = None, trees: int = TREES, leaf: int = LEAF, seed: int = 11) -> None:
        total = len(sample) if total is None else total
        self.sample, self.seed, self.total = sample, seed, total
        self.trees = [Tree(sample, leaf, seed + i) for i in range(trees)]
        self.members = [m for t in self.trees for m in t.members]
        self.base = np.concatenate([[0], np.cumsum([len(t.members) for t in self.trees])])
        #: Rows of the table that each leaf of the sample stands for.
        self.rows = np.array([len(m) for m in self.members]) * total / len(sample)
        self.depth = np.maximum(np.ceil(np.log2(np.maximum(self.rows, 1) / ROWS)), 0).astype(np.int64)
        self.further: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def splits(self, slot: int) -> tuple[np.ndarray, np.ndarray]:
        """Directions and thresholds of the further splits of a leaf."""
        if slot not in self.further:
            draw = np.random.default_rng([self.seed, slot])
            x = self.sample[self.members[slot]]
            normals = x[draw.integers(0, len(x), self.depth[slot])] - x[draw.integers(0, len(x), self.depth[slot])]
            flat = np.linalg.norm(normals, axis=1) == 0
            normals[flat] = draw.normal(size=(int(flat.sum()), x.shape[1]))
            normals /= np.linalg.norm(normals, axis=1, keepdims=True)
            self.further[slot] = normals, np.median(x @ normals.T, axis=0)
        return self.further[slot]

    def leaves_of(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree the leaf of each row: its number times 2**32, plus its code."""
        for t, b in zip(self.trees, self.base):
            slot = np.concatenate([t.leaf_of(x[i : i + STRIP]) for i in range(0, len(x), STRIP)]) + b if len(x) else np.zeros(0, np.int64)
            leaf = slot << 32
            deep = np.flatnonzero(self.depth[slot] > 0)
            if len(deep):
                deep = deep[np.argsort(slot[deep], kind="stable")]
                for rows in np.split(deep, np.flatnonzero(np.diff(slot[deep])) + 1):
                    normals, thresholds = self.splits(int(slot[rows[0]]))
                    leaf[rows] += ((x[rows] @ normals.T >= thresholds) << np.arange(len(thresholds))).sum(axis=1)
            yield leaf

    def search(self, query: np.ndarray, reads: int = READS) -> list[int]:
        """The leaves to read for a query, from one queue over all trees."""
        margins = [t.normals @ query - t.thresholds for t in self.trees]
        queue = [(0.0, i, t.root, 0, 0) for i, t in enumerate(self.trees)]
        heapq.heapify(queue)
        found, rows, most = [], 0.0, min(reads, SHARE * self.total * len(self.trees))
        while queue and rows < most:
            far, i, node, code, level = heapq.heappop(queue)
            while node >= 0:
                m = float(margins[i][node])
                near, other = self.trees[i].children[node, ::-1] if m >= 0 else self.trees[i].children[node]
                heapq.heappush(queue, (max(far, abs(m)), i, int(other), 0, 0))
                node = int(near)
            slot = int(self.base[i]) + ~node
            if level < (depth := int(self.depth[slot])):
                normals, thresholds = self.splits(slot)
                for j in range(level, depth):
                    m = float(normals[j] @ query - thresholds[j])
                    heapq.heappush(queue, (max(far, abs(m)), i, node, code | int(m < 0) << j, j + 1))
                    code |= int(m >= 0) << j
            found.append(slot << 32 | code)
            rows += self.rows[slot] / (1 << depth)
        return found


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _parts(forest: Forest, leaf: np.ndarray, block: int) -> np.ndarray:
    """Parts that a leaf is dealt in: a leaf of the sample that could not be split holds one vector many times."""
    held = np.where(np.array([len(m) for m in forest.members]) > LEAF, forest.rows, 1.0)
    return np.ceil(held / block).astype(np.int64)[leaf >> 32]


def _deal(held, token: str, block: int, bundles: int):
    """Rows to the leaves that they lie in, queries to all parts of the leaves that they read; leaves travel in bundles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = worker_slot(f"forest {token}", lambda: held.value)

        def batch_of(rows: pa.RecordBatch, at: np.ndarray, leaf: np.ndarray, part: np.ndarray, asks: bool) -> pa.RecordBatch:
            mixed = (leaf.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)
            bundle = (mixed % np.uint64(bundles)).astype(np.int32)
            return pa.record_batch([pa.array(bundle), pa.array(leaf * 1024 + part % 1024, pa.int64()), pa.array(np.full(len(leaf), asks)), rows.column(0).take(pa.array(at)), rows.column(2).take(pa.array(at))],
                                   ["bundle", "leaf", "asks", "vec_id", "vector"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(2))
            asks = batch.column(1).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(~asks)
            if len(rows):
                for leaf in forest.leaves_of(x[rows]):
                    part = (ids[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % _parts(forest, leaf, block)
                    yield batch_of(batch, rows, leaf, part, False)
            for i in np.flatnonzero(asks).tolist():
                leaf = np.array(forest.search(x[i]), np.int64)
                parts = _parts(forest, leaf, block)
                part = np.concatenate([np.arange(p) for p in parts]) if len(leaf) else leaf
                leaf = np.repeat(leaf, parts)
                yield batch_of(batch, np.full(len(leaf), i), leaf, part, True)

    return run


def _best(query: np.ndarray, found: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` nearest of each query, each id once, ties to smaller ids."""
    order = np.lexsort((distance, found, query))
    once = np.ones(len(order), bool)
    once[1:] = (query[order][1:] != query[order][:-1]) | (found[order][1:] != found[order][:-1])
    order = order[once]
    order = order[np.lexsort((found[order], distance[order], query[order]))]
    q = query[order]
    new = np.concatenate([[True], q[1:] != q[:-1]])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(q)), 0)) if len(q) else np.zeros(0, np.int64)
    return order[np.arange(len(q)) - begin < k]


def _compare(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query, id, distance) of candidates that hold the ``k`` nearest distinct ids of every query among the rows of a leaf."""
    near = (queries**2).sum(axis=1)[:, None] + (x**2).sum(axis=1) - 2 * queries @ x.T
    near[query_ids[:, None] == ids] = np.inf
    keep = np.isfinite(near)
    if len(ids) > 3 * k:
        slack = 1e-9 * (near[keep].max(initial=0.0) + (queries**2).sum(axis=1, keepdims=True) + 1)
        close = near <= np.partition(near, 2 * k, axis=1)[:, 2 * k : 2 * k + 1] + slack
        # repeated ids may crowd a query's list: then all rows of the leaf stay
        enough = np.array([len(np.unique(ids[c & m])) >= k for c, m in zip(close, keep)]) if len(np.unique(ids)) < len(ids) else np.ones(len(near), bool)
        keep &= close | ~enough[:, None]
    q, r = np.nonzero(keep)
    return query_ids[q], ids[r], np.sqrt(((x[r] - queries[q]) ** 2).sum(axis=1))


def _rerank(k: int):
    def run(table: pa.Table) -> pa.Table:
        leaf, asks, ids = (table.column(c).to_numpy() for c in ("leaf", "asks", "vec_id"))
        vectors = _matrix(table.column("vector").combine_chunks())
        order = np.lexsort((asks, leaf))
        out = []
        for rows in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
            cut = int(np.searchsorted(asks[rows], True))
            if 0 < cut < len(rows):
                x, q = rows[:cut], rows[cut:]
                for i in range(0, len(q), 256):
                    out.append(_compare(ids[x], vectors[x], ids[q[i : i + 256]], vectors[q[i : i + 256]], k))
        q, v, s = map(np.concatenate, zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        best = _best(q, v, s, k)
        return pa.table([pa.array(q[best], pa.int64()), pa.array(v[best], pa.int64()), pa.array(s[best], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, vector) that take part."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"  # floats travel as floats
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (lengths["n"] if lengths else 0))


def nearest(vectors: DataFrame, is_query, k: int = 10, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest found of the rows for which ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    got = bounded_sample(rows, "vec_id", sample, "forest", total).toPandas().sort_values("vec_id", kind="stable")
    if got.empty:  # rows that share few ids can all be left out
        got = rows.orderBy("vec_id").limit(1).toPandas()
    forest = Forest(np.stack(got["vector"].to_numpy()).astype(np.float64), total)
    held = spark.sparkContext.broadcast(forest)
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    both = rows.select("vec_id", F.lit(False).alias("asks"), "vector").unionByName(queries.select("vec_id", F.lit(True).alias("asks"), "vector"))
    bundles = max(1, -(-total * TREES // block))
    kind = rows.schema["vector"].dataType.simpleString()
    dealt = both.mapInArrow(_deal(held, uuid.uuid4().hex, block, bundles), f"bundle int, leaf long, asks boolean, vec_id long, vector {kind}")
    found = dealt.groupBy("bundle").applyInArrow(_rerank(k), "query_id long, vec_id long, score double")
    merged = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
