"""Approximate nearest neighbours by vantage-point trees, one per shard.

Largest inner product becomes smallest Euclidean distance by one more coordinate: each vector gets the length
that it lacks to the longest of its shard, each query gets 0. A tree node splits its points at the median
distance from a vantage point and remembers the range of distances on either side. A subtree is left out if,
by the triangle inequality, it can hold nothing nearer than the k-th found so far: its lower bound times
`factor` exceeds that distance. Factor 1 is exact; larger factors prune more. All queries of a block go down
a tree together.

Scores are sums of products in double precision over the original vectors. Vectors that are null, zero, or
hold null or non-finite components take no part, nor do null ids. Only vectors of one length are compared with each
other. Rows that repeat a vec_id are queries and candidates of their own. Ties go to the smaller vec_id. Fewer candidates than k give fewer rows;
an empty table gives none. Extra columns are not carried.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.blocks import keys_of, matrix_of, search, usable_vectors
from tidemark.llm.common import table

NEIGHBOURS, LEAF = 20, 64
#: 1 is exact search.
FACTOR = 1.0
#: Slack for rounding in bounds and matrix products; exact sums decide within it.
SLACK = 1e-9


def build(frame: pd.DataFrame) -> bytes:
    """A tree over a shard's vectors: points in leaf order, and nodes in pre-order.

    A node is (start, end, vantage row, right child, nearest and farthest left, nearest and farthest right);
    right child 0 marks a leaf.
    """
    frame = frame.sort_values("vec_id")
    ids, rows_of, points = frame["vec_id"].to_numpy(np.int64), keys_of(frame), matrix_of(frame)
    square = (points ** 2).sum(axis=1)
    lift = np.sqrt(np.maximum(square.max() - square, 0.0))
    lifted = np.concatenate([points, lift[:, None]], axis=1)
    order = np.arange(len(ids))
    nodes: list[list[float]] = []
    todo = [(0, len(ids), -1)]
    while todo:
        start, end, parent = todo.pop()
        if parent >= 0:
            nodes[parent][3] = len(nodes)
        node = [start, end, -1, 0, 0.0, 0.0, 0.0, 0.0]
        nodes.append(node)
        if end - start <= LEAF:
            continue
        rows = order[start:end]
        # The point farthest from the first one: distances from the rim spread the most.
        vantage = rows[int(np.argmax(((lifted[rows] - lifted[rows[0]]) ** 2).sum(axis=1)))]
        far = np.sqrt(((lifted[rows] - lifted[vantage]) ** 2).sum(axis=1))
        if far.max() == 0.0:
            continue  # copies of one vector stay a leaf
        half = len(rows) // 2
        split = np.argsort(far, kind="stable")
        order[start:end], far = rows[split], far[split]
        node[2] = int(vantage)
        node[4:] = [far[0], far[half - 1], far[half], far[-1]]
        todo += [(start + half, end, len(nodes) - 1), (start, start + half, -1)]
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    table_of_nodes = np.array(nodes)
    inner = table_of_nodes[:, 2] >= 0
    table_of_nodes[inner, 2] = place[table_of_nodes[inner, 2].astype(np.int64)]
    out = io.BytesIO()
    np.savez(out, ids=ids[order], rows=rows_of[order], points=points[order], lift=lift[order], nodes=table_of_nodes, top=square.max())
    return out.getvalue()


class Search:
    """The k best rows of a tree for a block of queries."""

    def __init__(self, index: bytes, query_rows: np.ndarray, queries: np.ndarray, k: int, factor: float) -> None:
        with np.load(io.BytesIO(index)) as held:
            self.ids, self.rows, self.points, self.lift = held["ids"], held["rows"], held["points"], held["lift"]
            self.nodes, self.top = held["nodes"], float(held["top"])
        self.query_rows, self.queries, self.k, self.factor = query_rows, queries, k, factor
        self.square = (queries ** 2).sum(axis=1)
        self.best = np.full((len(queries), k), -np.inf)
        self.best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)

    def _distance(self, active: np.ndarray, row: int) -> np.ndarray:
        product = self.queries[active] @ self.points[row]
        return np.sqrt(np.maximum(self.square[active] + self.top - 2 * product, 0.0))

    def _reach(self, active: np.ndarray) -> np.ndarray:
        """Distance of the k-th best so far; infinite as long as there are fewer than k."""
        worst = self.best[active, -1]
        return np.where(np.isinf(worst), np.inf, np.sqrt(np.maximum(self.square[active] + self.top - 2 * worst, 0.0)))

    def _leaf(self, active: np.ndarray, start: int, end: int) -> None:
        for at in range(start, end, 512):  # a leaf of copies may be long
            stop = min(at + 512, end)
            product = self.queries[active] @ self.points[at:stop].T
            q, p = np.nonzero(product >= self.best[active, -1][:, None] - SLACK)
            keep = self.query_rows[active[q]] != self.rows[at + p]
            q, p = q[keep], p[keep]
            for part in np.array_split(np.arange(len(q)), len(q) // 65536 + 1):
                self._offer(active[q[part]], at + p[part])

    def _offer(self, query: np.ndarray, row: np.ndarray) -> None:
        """Takes (query, row) pairs, grouped by query, into the best lists by exact score and id."""
        if not len(query):
            return
        score = (self.queries[query] * self.points[row]).sum(axis=1)
        touched, where, counts = np.unique(query, return_inverse=True, return_counts=True)
        order = np.lexsort((self.ids[row], -score, where))
        first = np.cumsum(counts) - counts
        nth = np.arange(len(order)) - first[where[order]]
        order, nth = order[nth < self.k], nth[nth < self.k]
        scores = np.full((len(touched), self.k), -np.inf)
        ids = np.full((len(touched), self.k), np.iinfo(np.int64).max)
        scores[where[order], nth], ids[where[order], nth] = score[order], self.ids[row[order]]
        scores = np.concatenate([self.best[touched], scores], axis=1)
        ids = np.concatenate([self.best_ids[touched], ids], axis=1)
        line = np.lexsort((ids, -scores), axis=1)[:, :self.k]
        self.best[touched] = np.take_along_axis(scores, line, axis=1)
        self.best_ids[touched] = np.take_along_axis(ids, line, axis=1)

    def run(self) -> None:
        everyone = np.arange(len(self.queries))
        home = self._descend(everyone)
        todo = [(0, everyone)]
        while todo:
            at, active = todo.pop()
            start, end, vantage, right, *ranges = self.nodes[at]
            if not right:
                active = active[home[active] != at]
                if len(active):
                    self._leaf(active, int(start), int(end))
                continue
            far = self._distance(active, int(vantage))
            reach = self._reach(active)
            for child, low, high in ((int(right), ranges[2], ranges[3]), (at + 1, ranges[0], ranges[1])):
                bound = np.maximum(np.maximum(low - far, far - high), 0.0)
                inside = active[bound * self.factor <= reach + 1e-6]
                if len(inside):
                    todo.append((child, inside))

    def _descend(self, everyone: np.ndarray) -> np.ndarray:
        """Each query's own leaf, searched first so that bounds are tight; the leaf per query."""
        home, todo = np.zeros(len(everyone), np.int64), [(0, everyone)]
        while todo:
            at, active = todo.pop()
            start, end, vantage, right, *ranges = self.nodes[at]
            if not right:
                home[active] = at
                self._leaf(active, int(start), int(end))
                continue
            near = self._distance(active, int(vantage)) <= (ranges[1] + ranges[2]) / 2
            todo += [(c, a) for c, a in ((at + 1, active[near]), (int(right), active[~near])) if len(a)]
        return home


def look_up(index: bytes, block: pd.DataFrame, k: int = NEIGHBOURS, factor: float = FACTOR):
    rows = keys_of(block)
    found = Search(index, rows, matrix_of(block), k, factor)
    found.run()
    some = found.best > -np.inf
    return np.repeat(rows, some.sum(axis=1)), found.best_ids[some], found.best[some]


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries among (vec_id, vector) rows."""
    return search(vectors, build, lambda index, block: look_up(index, block, k, factor), k, "score", largest=True)


def op6_vantage_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(usable_vectors(table(spark, sf_dir, "embeddings")))
