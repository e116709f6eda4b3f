"""Operator 2: exact top-k search by dual traversal of cover trees.

Vectors become integers, floor(1024 x).  Rows are dealt to near pivots, and each
pivot's rows into blocks of at most about ``BLOCK``; every block is a cover tree:
a node's children lie within half its radius of their centres, and it knows the
greatest distance to anything below it.  The queries form such trees too, at most
``QUERIES`` in one.  Two nodes cannot hold a pair that scores above

    <c, d> + |c| s + r |d| + r s      (centres c, d; covering radii r, s)

(in floats, with room for their rounding; scores themselves are whole numbers),
so a pair of nodes is left when that is below the least kth score among the
query node's queries.  Those scores start from the bounded sample of pivots, so
pruning works from the first block on.  Each block gives a query its best k at
most; the best of those are the result.

Broadcast: the pivots and one tree of at most ``QUERIES`` queries at a time.

Defined results: vectors that are NULL or hold NULL or non-finite components
take no part; an empty vector is the zero vector, shorter ones are filled with
zeros.  Components saturate at 2^62 and scores at the bounds of a long.
Repeated ids are rows of their own, as queries too (each has its own ranks), but
no row is a candidate for a query with its id.  NULL ids take no part.  Extra columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linktrove.sources.scratch import materialize

SCALE, BLOCK, LEAF, PIVOTS, QUERIES = 1024, 2048, 32, 256, 8192
SLACK = 1 + 1e-9


class Tree:
    """Cover tree over integer vectors; arrays only, so it travels well.

    Rows are stored in tree order: a leaf's rows, and all rows below a node, are a
    run ``first`` to ``last``.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.exact = vectors
        x = vectors.astype(np.float64)
        order: list[np.ndarray] = []
        self.centre, self.radius, self.children, self.first, self.last = [], [], [], [], []
        placed = 0

        def grow(rows: np.ndarray, centre: int, reach: np.ndarray) -> int:
            nonlocal placed
            node = len(self.centre)
            self.centre.append(centre)
            self.radius.append(float(reach.max()))
            self.children.append([])
            self.first.append(placed)
            self.last.append(placed)
            if len(rows) <= LEAF or not reach.any():
                order.append(rows)
                placed += len(rows)
            else:
                limit, rest = self.radius[node] / 2, rows
                pick, far = centre, reach
                while len(rest):
                    near = far <= limit
                    self.children[node].append(grow(rest[near], pick, far[near]))
                    rest = rest[~near]
                    if len(rest):
                        pick = int(rest[0])
                        far = np.sqrt(((x[rest] - x[pick]) ** 2).sum(axis=1))
            self.last[node] = placed
            return node

        if len(x):
            rows = np.arange(len(x))
            grow(rows, 0, np.sqrt(((x - x[0]) ** 2).sum(axis=1)))
        perm = np.concatenate(order) if order else np.zeros(0, int)
        self.ids, self.exact = ids[perm], vectors[perm]
        self.x = x[perm]
        self.centre = x[np.array(self.centre, int)] if len(x) else np.zeros((0, 0))
        self.norm = np.sqrt((self.centre ** 2).sum(axis=1))
        self.radius, self.first, self.last = np.array(self.radius), np.array(self.first), np.array(self.last)
        self.children = [np.array(c, int) for c in self.children]
        self.largest = float(np.sqrt((x ** 2).sum(axis=1).max())) if len(x) else 0.0


#: The least long: no score yet, and the floor of a query that takes every score.
LEAST = -(1 << 63)


class Best:
    """The k best (score, id) so far of each query, in the query tree's order; scores are longs."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None) -> None:
        self.score = np.full((n, k), LEAST, np.int64)
        self.id = np.full((n, k), -1, np.int64)
        self.held = np.zeros((n, k), bool)
        self.floor = np.full(n, LEAST, np.int64) if floor is None else floor

    def limits(self, first: int, last: int) -> np.ndarray:
        """Scores below which a candidate cannot be among the best; the least long where any can."""
        return np.maximum(np.where(self.held[first:last, -1], self.score[first:last, -1], LEAST), self.floor[first:last])

    def worst(self, first: int, last: int) -> float:
        least = int(self.limits(first, last).min())
        return -np.inf if least == LEAST else float(least)

    def offer(self, first: int, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Scores (queries x candidates) of the queries from ``first`` on; not those that ``own`` marks."""
        k = self.score.shape[1]
        wanted = (scores >= self.limits(first, first + len(scores))[:, None]) & ~own
        for q in np.flatnonzero(wanted.any(axis=1)):
            s = np.concatenate([self.score[first + q], scores[q]])
            i = np.concatenate([self.id[first + q], ids])
            held = np.concatenate([self.held[first + q], wanted[q]])
            top = np.lexsort((i, ~s, ~held))[:k]  # ~s falls as s grows, and never overflows
            self.score[first + q], self.id[first + q], self.held[first + q] = s[top], i[top], held[top]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products, saturating at the bounds of a long."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * a.shape[1] < 2.0 ** 53:
        return (x @ y.T).astype(np.int64)
    whole = a.astype(object) @ b.astype(object).T
    return np.vectorize(lambda v: max(LEAST, min(-LEAST - 1, int(v))), otypes=[np.int64])(whole) if whole.size else np.zeros(whole.shape, np.int64)


def dual_search(queries: Tree, data: Tree, best: Best) -> None:
    """Offer every data row that may be among the best of a query; leaves the other node pairs."""
    if not len(queries.ids) or not len(data.ids):
        return

    def bounds(q: int, nodes: np.ndarray) -> np.ndarray:
        r, s = queries.radius[q], data.radius[nodes]
        top = data.centre[nodes] @ queries.centre[q] + queries.norm[q] * s + r * data.norm[nodes] + r * s
        return top + np.abs(top) * 1e-9 + queries.largest * data.largest * 1e-12

    def visit(q: int, nodes: np.ndarray) -> None:
        first, last = queries.first[q], queries.last[q]
        top = bounds(q, nodes)
        keep = top >= best.worst(first, last)
        nodes, top = nodes[keep], top[keep]
        if not len(nodes):
            return
        inner = np.array([len(data.children[d]) > 0 for d in nodes])
        if len(queries.children[q]) and (not inner.any() or queries.radius[q] >= data.radius[nodes].max()):
            for child in queries.children[q]:
                visit(child, nodes)
        elif inner.any():
            visit(q, np.concatenate([nodes[~inner], *(data.children[d] for d in nodes[inner])]))
        else:
            order = np.argsort(-top, kind="stable")
            for k in range(0, len(order), 16):  # best bounds first
                part = order[k:k + 16]
                if top[part[0]] < best.worst(first, last):
                    break
                rows = np.concatenate([np.arange(data.first[d], data.last[d]) for d in nodes[part]])
                scores = products(queries.exact[first:last], data.exact[rows])
                best.offer(first, scores, data.ids[rows], queries.ids[first:last][:, None] == data.ids[rows][None, :])

    visit(0, np.array([0]))


def whole_vectors(table: DataFrame, vector: str, id: str) -> DataFrame:
    """(vec_id, v): integer vectors as little-endian bytes; unusable rows are left out."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    usable = F.col(id).isNotNull() & F.col(vector).isNotNull() & ~F.exists(
        F.col(vector), lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    source = table.where(usable).select(F.col(id).cast("long").alias("vec_id"), x.alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.clip(np.floor(np.array(v, np.float64) * SCALE), -2.0 ** 62, 2.0 ** 62).astype("<i8").tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["vec_id", "v"])

    return source.mapInArrow(run, "vec_id long, v binary")


def stacked(vectors: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, :len(v) // 8] = np.frombuffer(v, "<i8")
    return out


def build_index(points: DataFrame, pivots: np.ndarray, width: int, block: int = BLOCK) -> DataFrame:
    """(tree) rows: the points in blocks, near ones together, a pivot's rows in several blocks if many."""
    spark = points.sparkSession
    near = spark.sparkContext.broadcast(pivots.astype(np.float64))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = near.value
        half = (p ** 2).sum(axis=1) / 2
        for batch in batches:
            x = stacked(batch.column(1).to_pylist(), width).astype(np.float64)
            pivot = np.argmax(x @ p.T - half, axis=1) if len(p) else np.zeros(len(x), int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot, pa.int32())], names=["vec_id", "v", "pivot"])

    placed = materialize(points.mapInArrow(assign, "vec_id long, v binary, pivot int"), "placed", spark)
    sizes = materialize(placed.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("long").alias("blocks")), "pivot-sizes", spark)
    salted = placed.join(F.broadcast(sizes), "pivot").withColumn("salt", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), "blocks"))

    def plant(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        tree = Tree(table["vec_id"].to_numpy(), stacked(table["v"].to_pylist(), width))
        return pa.table({"tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return salted.groupBy("pivot", "salt").applyInArrow(plant, "tree binary")


def search(table: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", id: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for every row where ``is_query``."""
    spark = table.sparkSession
    schema = "query_row long, query_id long, vec_id long, score long"
    points = materialize(whole_vectors(table, vector, id), "integer-vectors", spark)
    width = int(points.agg(F.max(F.octet_length("v"))).first()[0] or 0) // 8
    sample = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).toPandas()
    pivots, pivot_ids = stacked(list(sample["v"]), width), sample["vec_id"].to_numpy(np.int64)
    index = materialize(build_index(points, pivots, width), "cover-trees", spark)

    wanted = points.where(is_query)
    parts = max(1, -(-wanted.count() // QUERIES))
    found = None
    for part in range(parts):
        rows = wanted.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)) == part).toPandas()
        tree = Tree(rows["vec_id"].to_numpy(np.int64), stacked(list(rows["v"]), width))
        start = Best(len(tree.ids), k)
        if len(tree.ids) and len(pivot_ids):
            start.offer(0, products(tree.exact, pivots), pivot_ids, tree.ids[:, None] == pivot_ids[None, :])
        shared = spark.sparkContext.broadcast((tree, start.limits(0, len(tree.ids))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, part=part) -> Iterator[pa.RecordBatch]:
            queries, floor = shared.value
            best = Best(len(queries.ids), k, floor)  # of all blocks of this task
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    dual_search(queries, pickle.loads(data), best)
            q, j = np.nonzero(best.held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q + part * (1 << 32)), pa.array(queries.ids[q]), pa.array(best.id[q, j]), pa.array(best.score[q, j])],
                names=["query_row", "query_id", "vec_id", "score"])

        got = index.mapInArrow(run, schema)
        found = got if found is None else found.union(got)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
