"""Exact top-k by inner product with a KD-tree for each shard.

Vectors are dealt into shards of bounded size by a hash of their id. Each shard
builds a KD-tree by median splits along the widest axis, with a tight bounding box
and the least id at every node. A query walks a tree best first: the box gives an
upper bound of any inner product inside, and the walk ends where the bound
falls below the k-th score known so far (or only ties it with larger ids).

Queries visit one shard first; the k-th score from there is propagated to all
other shards, where it prunes from the start. Queries come in blocks, so a task
holds one shard and one block. A group of equal vectors is spread over shards
by id, and a tree splits it by position.

Scores are exact integers: doubles serve where every sum is below 2**53, then 64-bit integers,
and unbounded integers where a sum could pass those. A score beyond the range of a long counts as the
nearest end of that range (so does a component, in the quantisation), and such scores tie.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part, neither as queries nor as candidates, and neither do
null ids; vectors of different lengths are scored only against their own
length; ties go to the smaller id; a query's own id is no candidate (repeated
rows of an id are one vector each, each a candidate for others); other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockyard.llm.common import stored

SHARD_ROWS = 16_384
QUERY_ROWS = 4_096
LEAF = 256
RESULT = "shard int, query_id long, vec_id long, score long"
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def sums_type(a: np.ndarray, b: np.ndarray) -> type:
    """What holds every inner product of rows of ``a`` and ``b`` exactly."""
    top = max(1, a.shape[1]) * max(1, abs(int(a.min())), abs(int(a.max()))) * max(1, abs(int(b.min())), abs(int(b.max())))
    return np.float64 if top < 1 << 53 else np.int64 if top < 1 << 63 else object


class KdTree:
    """Median splits over integer vectors; nodes are kept in arrays."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, sums: type = np.float64):
        order = np.argsort(ids, kind="stable")
        self.ids, self.sums = ids[order], sums
        vectors = vectors[order]
        self.low, self.high, self.least, self.child, self.rows = [], [], [], [], []
        self.visited = 0
        self._node(np.arange(len(ids)), vectors)
        self.low, self.high = np.array(self.low, dtype=np.float64), np.array(self.high, dtype=np.float64)
        self.vectors = vectors.astype(sums)

    def _node(self, rows: np.ndarray, vectors: np.ndarray) -> int:
        own = vectors[rows]
        low, high = own.min(axis=0), own.max(axis=0)
        n = len(self.low)
        self.low.append(low), self.high.append(high), self.least.append(int(self.ids[rows].min()))
        self.child.append(None), self.rows.append(rows)
        if len(rows) > LEAF:
            axis = int(np.argmax(high.astype(np.float64) - low))
            by = rows[np.argsort(own[:, axis], kind="stable")]
            half = len(by) // 2
            self.rows[n] = None
            self.child[n] = self._node(np.sort(by[:half]), vectors), self._node(np.sort(by[half:]), vectors)
        return n

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product of each query with any point of each node's box."""
        queries = queries.astype(np.float64)
        bound = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        if self.sums is not np.float64:        # rounded products: raised above any exact sum
            bound += (np.abs(queries) @ np.maximum(np.abs(self.high), np.abs(self.low)).T) * 2.0 ** -40 + 1
        return np.maximum(bound, LEAST)

    def best(self, query: np.ndarray, bounds: np.ndarray, own: int, k: int,
             limit: tuple[int, int] | None) -> list[tuple[int, int]]:
        """The k best (score, id), best first; ``limit`` is a (score, id) that the
        k-th result is known to reach elsewhere. ``visited`` counts the rows scored."""
        query = query.astype(self.sums)
        found: list[tuple[int, int]] = []              # heap of (score, -id): the worst on top
        floor = (limit[0], -limit[1]) if limit else (-np.inf, -np.inf)
        heap = [(-bounds[0], self.least[0], 0)]
        while heap:
            bound, least, n = heapq.heappop(heap)
            worst = max(found[0], floor) if len(found) == k else floor
            if -bound < worst[0]:
                break
            if (-bound, -least) < worst:
                continue
            if self.child[n] is not None:
                for c in self.child[n]:
                    heapq.heappush(heap, (-bounds[c], self.least[c], c))
                continue
            rows = self.rows[n]
            self.visited += len(rows)
            score = self.vectors[rows] @ query
            if self.sums is object:
                score = np.array([min(max(s, LEAST), MOST) for s in score], dtype=np.int64)
            near = np.flatnonzero(score >= worst[0])
            if len(near) > k:                          # ties beyond the k best go by id
                near = near[by_score(score[near].astype(np.int64), self.ids[rows[near]])[:k + 1]]
            for j in near:
                entry = (int(score[j]), -int(self.ids[rows[j]]))
                if -entry[1] == own:
                    continue
                if len(found) < k:
                    heapq.heappush(found, entry)
                elif entry > found[0]:
                    heapq.heapreplace(found, entry)
        return [(s, -i) for s, i in sorted(found, reverse=True)]


def by_score(score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places by falling score, then by id (no negation: the least long has none)."""
    return np.lexsort((ids, ~score))


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, v, dims): floor(scale * x) of each component, of usable vectors only."""
    x = F.col("embedding").cast("array<double>")
    usable = F.coalesce((F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))),
                        F.lit(False))
    return vectors.filter(usable & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(c * F.lit(scale)).cast("long")).alias("v"), F.size(x).alias("dims"))


def searched(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) for (vec_id, v, dims) vectors and queries."""
    n, m = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-m // QUERY_ROWS))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.col("dims").alias("qdims")).withColumn(
        "block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn(
        "home", F.pmod(F.xxhash64("query_id", F.lit(2)), F.lit(shards)).cast("int"))
    every_block = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    none = asked.select("*", F.lit(None).cast("long").alias("limit_score"), F.lit(None).cast("long").alias("limit_id"))

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        out: list[tuple[int, int, int, int]] = []
        if left.num_rows and right.num_rows:
            sizes = left["dims"].to_numpy()
            for d in np.unique(right["qdims"].to_numpy()):
                rows = np.flatnonzero(sizes == d)
                if not len(rows):
                    continue
                own = left.take(pa.array(rows))
                mine = right.filter(pa.array(right["qdims"].to_numpy() == d))
                points, vectors = components(mine["qv"], d), components(own["v"], d)
                tree = KdTree(own["vec_id"].to_numpy(), vectors, sums_type(vectors, points))
                limits = zip(mine["limit_score"].to_pylist(), mine["limit_id"].to_pylist(), strict=True)
                bounds = tree.bounds(points)
                for j, (q, limit) in enumerate(zip(mine["query_id"].to_pylist(), limits, strict=True)):
                    known = limit if limit[0] is not None else None
                    out += [(shard, q, i, s) for s, i in tree.best(points[j], bounds[j], q, k, known)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4,
                                                        [pa.int32()] + [pa.int64()] * 3, strict=True)],
                        names=["shard", "query_id", "vec_id", "score"])

    def run(points: DataFrame) -> DataFrame:
        return every_block.groupBy("shard", "block").cogroup(points.groupBy("shard", "block")).applyInArrow(search, RESULT)

    first = stored(run(none.withColumn("shard", F.col("home"))), "first_shard")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("r", F.row_number().over(best)).filter(F.col("r") == k).select(
        "query_id", F.col("score").alias("limit_score"), F.col("vec_id").alias("limit_id"))
    found = first
    if shards > 1:
        limited = asked.join(kth, "query_id", "left")
        others = limited.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard <> home")
        found = first.unionByName(run(others))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def components(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy().reshape(-1, int(dims))


def digest(embeddings: DataFrame, k: int = 20) -> DataFrame:
    vectors = stored(quantised(embeddings), "vectors")
    return searched(vectors, vectors.filter("vec_id % 20 = 0"), k)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""
