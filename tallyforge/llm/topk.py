"""Exact top-k by inner product: M-trees searched best first.

Largest inner products become nearest neighbours when every candidate gets one more component that brings all of
them to the same length; in that metric space pages of vectors form M-trees.  A tree's nodes have a routing
vector, a covering radius and, for each entry, the distance to the parent's routing vector.  A query descends
best bound first; a stored parent distance rules an entry out by the triangle inequality before its own distance
is computed.  Bounds are floating point with a margin; scores are exact integers.

Trees are built where the rows lie (a page of rows at a time, no shuffle), stored as blobs, and met by the
queries in blocks: a block goes to each group of trees once, so a task holds a few trees and one block.  A query visits
the trees of a group in order of the best score that each can hold, takes along what it has found, and skips a tree
that cannot beat it.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, need, ready, stash

#: Rows in a tree, entries in a node, queries in a block, trees that a block meets in one task, blocks that a group of
#: trees meets in one task, results of a query.
TREE_ROWS, NODE_ROWS, BLOCK_QUERIES, TREES_TOGETHER, BLOCKS_TOGETHER, TOP = 8192, 64, 512, 4, 64, 10
SCALE = 1024


class MTree:
    """Nodes in pages.  A leaf's page holds vectors; an inner node's page holds its children's routing vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, node_rows: int = NODE_ROWS):
        self.ids, self.vectors = ids, vectors
        exact = vectors.astype(np.float64)
        self.norm2 = np.einsum("ij,ij->i", exact, exact)
        self.longest2 = float(self.norm2.max())
        self.points = np.hstack([exact, np.sqrt(np.maximum(self.longest2 - self.norm2, 0.0))[:, None]])
        self.nodes: list[tuple] = []  # (leaf, members, routing vectors, radii, distances to the parent's routing vector)
        self.centre = self.points.mean(0)
        self.radius = float(np.linalg.norm(self.points - self.centre, axis=1).max())
        self.scored = 0  # rows whose score a search has computed
        rng = np.random.default_rng(len(ids))
        self.root = self._build(np.arange(len(ids)), None, node_rows, rng)

    def _build(self, rows: np.ndarray, parent: np.ndarray | None, size: int, rng) -> int:
        if len(rows) <= size:
            x = self.points[rows]
            to_parent = np.zeros(len(rows)) if parent is None else np.linalg.norm(x - parent, axis=1)
            self.nodes.append((True, rows, None, None, to_parent))
            return len(self.nodes) - 1
        fan = min(size, max(2, -(-len(rows) // size)))
        picks = rng.choice(rows, size=min(len(rows), fan), replace=False)
        routing = np.unique(self.points[picks], axis=0)
        near = np.empty(len(rows), dtype=np.int64)
        far = np.empty(len(rows))
        for a in range(0, len(rows), 4096):
            x = self.points[rows[a : a + 4096]]
            d2 = (x * x).sum(1)[:, None] - 2 * x @ routing.T + (routing * routing).sum(1)
            near[a : a + 4096] = d2.argmin(1)
            far[a : a + 4096] = np.linalg.norm(x - routing[near[a : a + 4096]], axis=1)
        if len(routing) == 1 or np.bincount(near).max() == len(rows):  # all alike: split by count
            parts = np.array_split(np.arange(len(rows)), fan)
            routing, near = np.repeat(routing[near[:1]], len(parts), axis=0), np.concatenate([np.full(len(p), k) for k, p in enumerate(parts)])
            far = np.linalg.norm(self.points[rows] - routing[0], axis=1)
        kept = [k for k in range(len(routing)) if (near == k).any()]
        children = [self._build(rows[near == k], routing[k], size, rng) for k in kept]
        radii = np.array([far[near == k].max() for k in kept])
        to_parent = np.zeros(len(kept)) if parent is None else np.linalg.norm(routing[kept] - parent, axis=1)
        self.nodes.append((False, np.array(children), routing[kept], radii, to_parent))
        return len(self.nodes) - 1

    def most(self, query: np.ndarray) -> float:
        """No row scores more than this."""
        q = np.append(query.astype(np.float64), 0.0)
        low = max(0.0, float(np.linalg.norm(q - self.centre)) - self.radius - self._margin(float(q @ q)))
        return (float(q @ q) + self.longest2 - low * low) / 2 + 1.0

    def _margin(self, q2: float) -> float:
        return 1e-7 * (np.sqrt(q2) + np.sqrt(self.longest2) + 1.0)

    def search(self, query: np.ndarray, own: int, k: int, best: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id; rows with the query's id take no part.

        ``best``, a heap of (score, -id) from other trees, is taken into account and changed.
        """
        best = [] if best is None else best  # the worst on top
        q = np.append(query.astype(np.float64), 0.0)
        q2 = float(q @ q)
        margin = self._margin(q2)
        exact = query.astype(np.int64)
        reach = np.inf  # distance beyond which nothing can enter
        if len(best) == k:
            reach = np.sqrt(max(0.0, q2 + self.longest2 - 2.0 * best[0][0])) + margin
        heap: list[tuple] = [(0.0, self.root, None)]  # lower bound, node, distance to its routing vector
        while heap:
            low, at, to_routing = heapq.heappop(heap)
            if low > reach:
                break
            leaf, members, routing, radii, to_parent = self.nodes[at]
            slack = reach + margin
            if leaf:
                rows = members if to_routing is None else members[np.abs(to_routing - to_parent) <= slack]
                if not len(rows):
                    continue
                scores = self.vectors[rows].astype(np.int64) @ exact
                self.scored += len(rows)
                if len(best) == k:
                    rows, scores = rows[scores >= best[0][0]], scores[scores >= best[0][0]]
                for score, vec in zip(scores.tolist(), self.ids[rows].tolist(), strict=True):
                    if vec == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -vec))
                    elif (score, -vec) > best[0]:
                        heapq.heapreplace(best, (score, -vec))
                if len(best) == k:
                    reach = np.sqrt(max(0.0, q2 + self.longest2 - 2.0 * best[0][0])) + margin
            else:
                live = np.arange(len(members)) if to_routing is None else np.flatnonzero(np.abs(to_routing - to_parent) - radii <= slack)
                d = np.linalg.norm(routing[live] - q, axis=1)
                for i, x in zip(live.tolist(), d.tolist(), strict=True):
                    low = max(0.0, x - radii[i] - margin)
                    if low <= reach:
                        heapq.heappush(heap, (low, int(members[i]), x))
        return sorted(((s, -v) for s, v in best), key=lambda b: (-b[0], b[1]))


def _quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """Integer vectors; those that are null, or hold a null or non-finite component, are left out."""
    v = F.col(f"`{vector_col}`")
    x = F.transform(v, lambda c: c.cast("double"))
    sound = v.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(F.coalesce(sound, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _pages(rows: int, tree: bool):
    """Pickled trees (or blocks of queries) of at most so many rows, as the partition's rows stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # by number of components
        schema = pa.schema([("part", pa.int64()), ("page", pa.int64()), ("size", pa.int64()), ("blob", pa.binary())])
        made = 0

        def page(width: int) -> pa.RecordBatch:
            nonlocal made
            ids = np.concatenate([h[0] for h in held[width]])
            x = np.concatenate([h[1] for h in held[width]])
            held[width] = []
            made += 1
            blob = pickle.dumps((width, MTree(ids, x) if tree else (ids, x)), protocol=5)
            return batch(schema, [[TaskContext.get().partitionId()], [made], [len(ids)], [blob]])

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            flat, off = b.column(1).flatten().to_numpy(), b.column(1).value_lengths().to_numpy()
            starts = np.concatenate([[0], np.cumsum(off)[:-1]])
            for width in np.unique(off):
                own = np.flatnonzero(off == width)
                x = flat[(starts[own][:, None] + np.arange(width)).ravel()].reshape(len(own), int(width))
                for a in range(0, len(own), rows):
                    some = held.setdefault(int(width), [])
                    some.append((ids[own[a : a + rows]], x[a : a + rows]))
                    if sum(len(h[0]) for h in some) >= rows:
                        yield page(int(width))
        for width in [w for w, h in held.items() if h]:
            yield page(width)

    return run


def _meet(k: int):
    """Rows (g, salt, side, blob) in this order: a group's trees (side 0), then the blocks that meet them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        last, trees = None, []
        for b in batches:
            keys = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            for key, side, blob in zip(keys, b.column(2).to_pylist(), b.column(3), strict=True):
                if key != last:
                    last, trees = key, []
                width, held = pickle.loads(blob.as_buffer())  # our own blobs, from the shared folder
                if side == 0:
                    trees.append((width, held))
                    continue
                fit = [t for w, t in trees if w == width]
                out = []
                for q, vec in zip(*held, strict=True):
                    best: list[tuple[int, int]] = []
                    for most, _, tree in sorted(((t.most(vec), -i, t) for i, t in enumerate(fit)), key=lambda x: x[:2], reverse=True):
                        if len(best) < k or most >= best[0][0]:
                            tree.search(vec, int(q), k, best)
                    out += [(int(q), -v, s) for s, v in best]
                if out:
                    yield batch(schema, [[o[i] for o in out] for i in range(3)])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = TOP, scale: int = SCALE, tree_rows: int = TREE_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest inner products of integer vectors
    ``floor(scale * x)``, ties to the smaller id, all if there are fewer.

    Rows with the query's own id take no part; neither do vectors that are null or hold a null or non-finite
    component, nor vectors of another number of components.  Repeated rows count as often as they occur.
    """
    need(vectors, id_col, vector_col)
    need(queries, id_col, vector_col)
    ready(vectors.sparkSession)
    page = "part long, page long, size long, blob binary"
    trees = stash(_quantised(vectors, id_col, vector_col, scale).filter("vec_id is not null").mapInArrow(_pages(tree_rows, True), page))
    blocks = stash(_quantised(queries, id_col, vector_col, scale).filter("vec_id is not null").repartition(max(1, queries.sparkSession.sparkContext.defaultParallelism // 4)).mapInArrow(_pages(block_queries, False), page))
    groups, salts = max(1, -(-trees.count() // TREES_TOGETHER)), max(1, -(-blocks.count() // BLOCKS_TOGETHER))
    place = lambda n: F.pmod(F.xxhash64("part", "page"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = trees.select(place(groups).alias("g"), every(salts).alias("salt"), F.lit(0).alias("side"), "blob")
    dealt = dealt.unionByName(blocks.select(every(groups).alias("g"), place(salts).alias("salt"), F.lit(1).alias("side"), "blob"))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.repartition(min(max(parts, 1), groups * salts), "g", "salt").sortWithinPartitions("g", "salt", "side")
    found = met.mapInArrow(_meet(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
