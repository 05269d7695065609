"""Approximate nearest neighbours by a forest of random-projection trees.

The splits of the trees are learned from a bounded sample of vectors; every vector is then
put into one leaf of each tree. A query descends all trees through one shared priority
queue of nodes, the closest side of a split first, and collects leaves until it has enough
candidates. Candidates are ranked by their exact distance on the original vectors, leaf by
leaf, and the best of all leaves are merged.

Equal vectors are represented by their smallest ids, as many as a result may need.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import keep

#: Trees, vectors they are learned from at most, and sample vectors of a leaf at most.
TREES = 12
SAMPLE = 16_384
LEAF = 128
SEED = 7

#: Part of all rows that a query's leaves hold together, as the sample tells, at every size.
#: Vectors without structure need a large part; clustered ones far less.
SHARE = 0.75

#: Rows of a leaf, and queries, that meet in one task.
LEAF_ROWS = 4_096
LEAF_QUERIES = 2_048


class Tree(NamedTuple):
    """Inner nodes: a direction, a threshold, two children. A child below 0 is leaf -child - 1."""

    direction: np.ndarray
    threshold: np.ndarray
    children: np.ndarray
    #: Sample vectors in each leaf.
    weight: np.ndarray


def grow(sample: np.ndarray, seed: int, leaf: int = LEAF) -> Tree:
    """Split at the median along the line through two random sample vectors of the node."""
    rng = np.random.default_rng(seed)
    directions, thresholds, children, weights = [], [], [], []

    def node(rows: np.ndarray) -> int:
        split = None
        if len(rows) > leaf:
            for _ in range(8):  # two equal vectors span no line
                a, b = sample[rng.choice(rows, 2, replace=False)]
                if np.any(a != b):
                    along = sample[rows] @ (a - b)
                    cut = np.median(along)
                    right = along > cut
                    if right.any():
                        split = (a - b, cut, right)
                        break
        if split is None:
            weights.append(len(rows))
            return -len(weights)
        at = len(directions)
        length = np.linalg.norm(split[0])
        directions.append(split[0] / length)
        thresholds.append(split[1] / length)
        children.append([0, 0])
        children[at] = [node(rows[~split[2]]), node(rows[split[2]])]
        return at

    node(np.arange(len(sample)))
    width = sample.shape[1]
    return Tree(
        np.array(directions).reshape(-1, width), np.array(thresholds), np.array(children, np.int64).reshape(-1, 2), np.array(weights)
    )


class Forest:
    def __init__(self, sample: np.ndarray, trees: int = TREES):
        self.trees = [grow(sample, SEED + t) for t in range(trees)]
        self.size = len(sample)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector (rows) in each tree (columns)."""
        out = np.zeros((len(vectors), len(self.trees)), np.int64)
        for t, tree in enumerate(self.trees):
            if not len(tree.children):
                continue
            at = np.zeros(len(vectors), np.int64)
            inner = np.arange(len(vectors))
            while len(inner):
                n = at[inner]
                right = np.einsum("ij,ij->i", vectors[inner], tree.direction[n]) > tree.threshold[n]
                at[inner] = tree.children[n, right.astype(np.int64)]
                inner = inner[at[inner] >= 0]
            out[:, t] = -at - 1
        return out

    def probe(self, vector: np.ndarray, wanted: float) -> list[tuple[int, int]]:
        """(tree, leaf) from the shared queue until the leaves hold ``wanted`` sample vectors.

        The priority of a node is the smallest margin on the way to it, negative on the far
        side of a split; a leaf counts in full for each tree it is found in.
        """
        margins = [tree.direction @ vector - tree.threshold for tree in self.trees]
        queue = [(-np.inf, t, 0 if len(tree.children) else -1) for t, tree in enumerate(self.trees)]
        found, held = [], 0
        while queue and held < wanted:
            priority, t, n = heapq.heappop(queue)
            if n < 0:
                found.append((t, -n - 1))
                held += self.trees[t].weight[-n - 1]
                continue
            margin = margins[t][n]
            left, right = self.trees[t].children[n]
            # The heap gives the smallest first, so priorities are turned round.
            heapq.heappush(queue, (max(priority, margin), t, left))
            heapq.heappush(queue, (max(priority, -margin), t, right))
        return found


def usable(vector: str) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = pa.chunked_array([column]) if isinstance(column, pa.Array) else column
    flat = flat.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0)


def learn(vectors: DataFrame, sample: int, trees: int) -> Forest | None:
    """A forest from at most ``sample`` vectors, fixed by the vectors alone: one of each
    cell of their hashes."""
    cells = vectors.groupBy(F.pmod(F.xxhash64("vector"), F.lit(sample)).alias("cell")).agg(
        F.min_by("vector", F.xxhash64("vector", F.lit(SEED))).alias("vector")
    )
    found = cells.select("vector").toArrow()
    points = matrix(found["vector"])
    if not len(points):
        return None
    return Forest(points[np.lexsort(points.T[::-1])], trees)


def _with_leaves(forest: Forest):
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = forest.leaves(matrix(batch.column("vector"))) if batch.num_rows else np.zeros((0, len(forest.trees)), np.int64)
            n, trees = leaves.shape
            rows = batch.take(pa.array(np.repeat(np.arange(n), trees)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), pa.array(leaves.ravel().astype(np.int32)), *rows.columns],
                ["tree", "leaf", *rows.schema.names],
            )

    return put


def _with_probes(forest: Forest, wanted: float):
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column("vector"))
            probes = [forest.probe(v, wanted) for v in vectors]
            rows = batch.take(pa.array(np.repeat(np.arange(len(probes)), [len(p) for p in probes])))
            pairs = np.array([x for p in probes for x in p], np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *rows.columns], ["tree", "leaf", *rows.schema.names])

    return put


def _ranked(k: int):
    def rank(_: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        """The k nearest rows of one leaf to each of its queries, by exact distance."""
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(rows):
            points, ids = matrix(rows["vector"]), rows["vec_id"].to_numpy()
            for query_id, vector in zip(queries["query_id"].to_numpy(), matrix(queries["vector"]), strict=True):
                score = np.sqrt(np.square(points - vector).sum(axis=1))
                others = np.flatnonzero(ids != query_id)
                if len(others) > k:
                    edge = np.partition(score[others], k - 1)[k - 1]
                    others = others[score[others] <= edge]
                best = others[np.lexsort((ids[others], score[others]))[:k]]
                out["query_id"].append(np.full(len(best), query_id))
                out["vec_id"].append(ids[best])
                out["score"].append(score[best])
        empty = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
        return pa.table({n: np.concatenate([np.zeros(0, empty[n]), *parts]).astype(empty[n]) for n, parts in out.items()})

    return rank


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    share: float = SHARE,
    trees: int = TREES,
    sample: int = SAMPLE,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for the rows where ``queries``.

    Nearness is Euclidean distance in double precision, ties to the smaller id. A query's
    own id is no candidate. Vectors that are null, empty, zero or not finite throughout,
    vectors without an id, and vectors of another length than most (the longer of equals)
    take no part; repeated rows count once, and an id with several vectors by the nearest.
    Where nothing is left the result is empty. Other columns are ignored. Fewer than k are found
    only where the leaves of a query hold fewer.
    """
    rows = vectors.where(usable(vector) & F.col(vec_id).isNotNull())
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), queries.alias("asks"))
    rows = keep(rows.distinct(), "vectors")
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if usual is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    rows = rows.where(F.size("vector") == usual["n"])
    # Of equal vectors the k + 1 smallest ids are enough: one may be the query itself. The
    # ranks are cut on the map side, so a vector that very many rows share stays small.
    same = Window.partitionBy("vector").orderBy("vec_id")
    points = keep(rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).select("vec_id", "vector"), "points")
    forest = learn(points, sample, trees)
    # As leaves of several trees overlap, the part they cover is smaller than their sum.
    wanted = forest.size * overlap_sum(share, trees)

    kind = points.schema["vector"].dataType.simpleString()
    placed = points.mapInArrow(_with_leaves(forest), f"tree int, leaf int, vec_id long, vector {kind}")
    asked = rows.where("asks").select(F.col("vec_id").alias("query_id"), "vector")
    probes = keep(asked.mapInArrow(_with_probes(forest, wanted), f"tree int, leaf int, query_id long, vector {kind}"), "probes")

    # At most TREES * SAMPLE leaves: a bounded table. Large leaves and crowds of queries
    # are dealt out in parts that all meet.
    row_parts = placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / LEAF_ROWS).cast("int").alias("row_parts"))
    query_parts = probes.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / LEAF_QUERIES).cast("int").alias("query_parts"))
    parts = keep(row_parts.join(query_parts, ["tree", "leaf"]), "parts")
    part = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = placed.join(parts, ["tree", "leaf"]).select("*", part("vec_id", "row_parts").alias("i"), every("query_parts").alias("j"))
    probes = probes.join(parts, ["tree", "leaf"]).select("*", part("query_id", "query_parts").alias("j"), every("row_parts").alias("i"))
    keys = ["tree", "leaf", "i", "j"]
    near = (
        probes.select(*keys, "query_id", "vector")
        .groupBy(*keys)
        .cogroup(placed.select(*keys, "vec_id", "vector").groupBy(*keys))
        .applyInArrow(_ranked(k), "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def overlap_sum(share: float, trees: int) -> float:
    """Sum of the parts of single trees whose union, were they independent, is ``share``."""
    return trees if share >= 1 else trees * (1 - (1 - share) ** (1 / trees))
