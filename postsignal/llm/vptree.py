"""Nearest neighbours by inner product: vantage-point trees per shard, searched by blocks of queries."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import stored

#: Vectors of a shard, of a tree's leaf, and queries of a block. A task holds one shard and one block.
SHARD_ROWS, LEAF, QUERY_ROWS = 8_192, 128, 32_768
#: Room for rounding in the pruning test, relative to the largest distance.
SLACK = 1e-9
FOUND = "query_id long, vec_id long, score double, n long"


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector as doubles) of the rows that take part: not null, no null or non-finite component, not zero."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0))


def inner_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The inner product of each row of `left` with the same row of `right`, added up component by
    component in order, so that a pair's value never depends on what else is computed."""
    total = np.zeros(len(left))
    for a, b in zip(left.T, right.T):
        total += a * b
    return total


class Tree:
    """A vantage-point tree over vectors with one more component, which makes all lengths equal.

    With that, and a zero added to the query, a smaller distance is a larger inner
    product, so metric pruning applies. A node is a vantage point, the median
    distance to it, and two subtrees: rows nearer and rows farther.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, counts: np.ndarray, root=None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.counts = ids[order], vectors[order], counts[order]
        self.longest = float(np.sqrt((self.vectors**2).sum(axis=1).max()))
        squares = (self.vectors**2).sum(axis=1)
        self.radius2 = float(squares.max())
        self.points = np.hstack((self.vectors, np.sqrt(np.maximum(0, self.radius2 - squares))[:, None]))
        self.root = self._node(np.arange(len(ids)), np.random.default_rng(len(ids))) if root is None else root

    def packed(self) -> bytes:
        """Plain arrays, from which `unpacked` makes the tree again."""
        return pickle.dumps((self.ids, self.vectors, self.counts, self.root))

    @classmethod
    def unpacked(cls, data: bytes) -> "Tree":
        return cls(*pickle.loads(data))

    def _node(self, rows: np.ndarray, chance: np.random.Generator):
        if len(rows) <= LEAF:
            return rows
        vantage = self.points[rows[chance.integers(len(rows))]]
        distance = np.sqrt(((self.points[rows] - vantage) ** 2).sum(axis=1))
        middle = float(np.median(distance))
        near = distance <= middle
        if near.all():  # all equally far: nothing to split by
            return rows
        return vantage, middle, self._node(rows[near], chance), self._node(rows[~near], chance)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of each query's k nearest, itself left out; -1 where there are fewer.

        `factor` 1 visits every subtree that the triangle inequality cannot rule out,
        so the result is exact; below 1 the margin by which a subtree is ruled out
        shrinks in proportion, and some neighbours may be missed.
        """
        if queries.shape[1] != self.vectors.shape[1]:
            raise ValueError(f"queries have {queries.shape[1]} components, the index has {self.vectors.shape[1]}")
        self.k, self.factor = k, factor
        self.query_ids, self.queries = query_ids, queries
        self.lifted = np.hstack((queries, np.zeros((len(queries), 1))))
        self.lengths2 = (queries**2).sum(axis=1)
        self.best = np.full((len(queries), k), -np.inf)
        self.rows = np.full((len(queries), k), -1)
        self._visit(self.root, np.arange(len(queries)))
        return self.rows, self.best

    def _reach(self, who: np.ndarray) -> np.ndarray:
        """How far each query's k-th best so far is, as a distance; infinite before there are k."""
        return np.sqrt(np.maximum(0, self.lengths2[who] + self.radius2 - 2 * self.best[who, -1]))

    def _visit(self, node, who: np.ndarray) -> None:
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            for start in range(0, len(node), 8 * LEAF):
                self._compare(node[start : start + 8 * LEAF], who)
            return
        vantage, middle, near, far = node
        distance = np.sqrt(((self.lifted[who] - vantage) ** 2).sum(axis=1))
        inside = distance <= middle
        self._visit(near, who[inside])
        self._visit(far, who[~inside])
        # The other side is at least this far away.
        for other, mask in ((far, inside), (near, ~inside)):
            gap = np.abs(distance[mask] - middle)
            reach = self._reach(who[mask])
            self._visit(other, who[mask][gap <= self.factor * reach + SLACK * (1 + np.abs(distance[mask]))])

    def _compare(self, rows: np.ndarray, who: np.ndarray) -> None:
        for start in range(0, len(who), 2048):
            some = who[start : start + 2048]
            # A matrix product finds the pairs that can matter, with room for its rounding;
            # only those get their exact score.
            rough = self.queries[some] @ self.vectors[rows].T
            room = SLACK * np.sqrt(self.lengths2[some]) * self.longest
            query, row = np.nonzero(rough >= (self.best[some, -1] - room)[:, None])
            query, row = some[query], rows[row]
            other = self.query_ids[query] != self.ids[row]
            query, row = query[other], row[other]
            if not len(query):
                continue
            score = inner_products(self.queries[query], self.vectors[row])
            touched = np.unique(query)
            held = self.rows[touched] >= 0
            query = np.concatenate((query, np.repeat(touched, held.sum(axis=1))))
            row = np.concatenate((row, self.rows[touched][held]))
            score = np.concatenate((score, self.best[touched][held]))
            # Rows stand in id order, so the smaller row number wins a tie.
            order = np.lexsort((row, -score, query))
            query, row, score = query[order], row[order], score[order]
            first = np.searchsorted(query, touched)
            nth = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
            top = nth < self.k
            self.rows[query[top], nth[top]], self.best[query[top], nth[top]] = row[top], score[top]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def build(candidates: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The stored index of (id, vector) rows: one row (shard, tree) per shard of about `shard_rows` vectors.

    Vectors are dealt by hash, evenly. Rows that repeat both id and vector are held
    once, with their number (a hot one shrinks before its shuffle); rows that repeat
    an id only are candidates of their own. No rows give no shards.
    """
    different = candidates.groupBy("id", "vector").agg(F.count("*").alias("n"))
    shards = max(1, -(-candidates.count() // shard_rows))
    dealt = different.withColumn("shard", F.pmod(F.xxhash64("id", "vector"), F.lit(shards)))

    def tree(key: tuple, rows: pa.Table) -> pa.Table:
        made = Tree(rows["id"].to_numpy(), _matrix(rows["vector"].combine_chunks()), rows["n"].to_numpy())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "tree": pa.array([made.packed()], pa.binary())})

    return stored(dealt.groupBy("shard").applyInArrow(tree, "shard long, tree binary"), "ann-index")


def search(index: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest candidates of each query, nearest first.

    `index` is what `build` stored, `queries` are (id, vector) rows as `usable`
    gives them, with vectors of the index' length. Nearness is the largest inner
    product in double precision; ties go to the smaller id; a query does not
    find its own id. With fewer than k candidates all are returned; empty inputs
    give no rows.

    Every row counts: a pair of rows is in the result as often as its query and its
    candidate repeat, and rows of one query id, whatever their vectors, share one
    list of k. Each different (id, vector) is searched once; its number is applied
    to the pairs found.

    Queries go in blocks of about `query_rows`, a bounded number of vectors that is
    broadcast, and each block is one pass over the stored index, which is never
    shuffled. A task holds one shard and one block; k rows per query and shard
    leave it, and are reduced to k per query.
    """
    asked = stored(queries.groupBy("id", "vector").agg(F.count("*").alias("n")), "ann-queries")
    blocks = max(1, -(-asked.count() // query_rows))
    parts = None
    for n in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)) == n).toArrow()
        vectors = _matrix(block["vector"].combine_chunks())
        found = _pass(index, block["id"].to_numpy(), vectors, block["n"].to_numpy(), k, factor)
        if blocks > 1:
            found = stored(found, "ann-found")
        parts = found if parts is None else parts.unionByName(found)
    order = "over (partition by query_id order by score desc, vec_id, n"
    nearest = parts.withColumn("rank", F.expr(f"row_number() {order})")).filter(F.col("rank") <= k)
    before = F.expr(f"coalesce(sum(n) {order} rows between unbounded preceding and 1 preceding), 0)")
    ranks = F.sequence((F.col("before") + 1).cast("int"), F.least(F.col("before") + F.col("n"), F.lit(k)).cast("int"))
    nearest = nearest.withColumn("before", before).filter(F.col("before") < k)
    return nearest.select("query_id", F.explode(ranks).alias("rank"), "vec_id", "score")


def _pass(index: DataFrame, ids: np.ndarray, vectors: np.ndarray, counts: np.ndarray, k: int, factor: float) -> DataFrame:
    """Every shard's k nearest for one block of queries."""
    shared = index.sparkSession.sparkContext.broadcast((ids, vectors, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, asked, counts = shared.value
        for batch in batches:
            for blob in batch.column("tree") if len(query_ids) else ():
                tree = Tree.unpacked(blob.as_py())
                rows, scores = tree.search(query_ids, asked, k, factor)
                hit = rows >= 0
                times = hit.sum(axis=1)
                n = np.minimum(np.minimum(np.repeat(counts, times), k) * np.minimum(tree.counts[rows[hit]], k), k)
                out = (np.repeat(query_ids, times), tree.ids[rows[hit]], scores[hit], n)
                types = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, types)], names=["query_id", "vec_id", "score", "n"]
                )

    return index.select("tree").mapInArrow(run, FOUND)
