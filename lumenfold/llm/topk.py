"""Exact top-k inner-product search by the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into groups of bounded size; a group holds one sorted list per dimension. A
query walks all lists at once from the end that its sign prefers, scores every vector it meets by
random access, and stops when the sum of the list heads, which bounds everything unseen, is below
its kth score. Every group gives its k best; the groups' results are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import read

#: Rows of a candidate group, least and most.
GROUP = (4096, 65536)
EXACT = float(1 << 53)
#: The ends of a long, at which scores are held.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _held(score: int) -> int:
    return min(max(score, LEAST), MOST)


class SortedLists:
    """One group's vectors with, for each dimension, its rows in ascending order of value."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype(np.int32))
        self.sorted = np.take_along_axis(np.ascontiguousarray(x.T), self.order, axis=1)
        self.largest = float(np.abs(x).max()) if x.size else 0.0

    def _exact(self, q: np.ndarray) -> bool:
        return self.largest * float(np.abs(q).max(initial=0)) * max(1, len(q)) < EXACT

    def _scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self._exact(q):
            return self.x[rows] @ q  # integers below 2**53 are exact in double
        whole = [int(v) for v in q]
        return np.array([_held(sum(int(a) * b for a, b in zip(r, whole, strict=True))) for r in self.x[rows]], dtype=object)

    def _bound(self, heads: np.ndarray, q: np.ndarray) -> float | int:
        """The highest score that a row below the list heads can have, in the arithmetic of _scores."""
        if self._exact(q):
            return float(heads @ q)
        return _held(sum(int(a) * int(b) for a, b in zip(heads, q, strict=True)))

    def search(self, own: int, q: np.ndarray, k: int, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows for q whose id is not own; ties to the smaller id."""
        n = len(self.ids)
        dims = np.flatnonzero(q)
        seen = self.ids == own
        ids, scores = self.ids[:0], np.zeros(0)
        up, depth = q[dims] < 0, 0
        while True:
            deeper = min(depth + step, n) if len(dims) else n
            if len(dims):
                lists = self.order[dims]
                met = np.concatenate([lists[up, depth:deeper].ravel(), lists[~up, n - deeper : n - depth].ravel()])
                fresh = np.zeros(n, bool)
                fresh[met] = True
                rows = np.flatnonzero(fresh & ~seen)
            else:
                rows = np.flatnonzero(~seen)
            seen[rows] = True
            ids, scores = np.concatenate([ids, self.ids[rows]]), np.concatenate([scores, self._scores(rows, q)])
            if len(ids) > k:
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            depth = deeper
            if depth >= n:
                break
            if len(ids) >= k:
                heads = np.where(up, self.sorted[dims, depth - 1], self.sorted[dims, n - depth])
                if self._bound(heads, q[dims]) < scores.min():
                    break  # nothing unseen can reach the kth score, nor tie with it
            step *= 2
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    cuts = np.concatenate([[0], np.cumsum([len(v) if v is not None else 0 for v in column])])
    scaled = np.floor(1024.0 * flat)
    return [scaled[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def search_all(vectors: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query, its k highest integer inner products.

    Components are floor(1024 * x). Vectors that are null or hold a null or non-finite component,
    and rows without an id, take no part; vectors of another length than the query's are not
    compared with it. Repeated candidate rows each count; an id repeated among the queries asks
    once, with its least vector, and no row with its own id is an answer. Fewer than k candidates:
    all of them. Scores beyond a long are held at its ends. An empty table gives no rows.
    """
    x = F.col(embedding)
    sound = F.col(vec_id).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(vec_id).cast("long").alias("id"), x.cast("array<double>").alias("v"), is_query.alias("asks"))
    spark = vectors.sparkSession
    n = rows.count()
    size = min(max(n // (2 * spark.sparkContext.defaultParallelism), GROUP[0]), GROUP[1])
    groups = max(1, -(-n // size))
    # Row numbers stand in for ids here, so that a repeated id does not swell one group.
    candidates = rows.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("kind"), "id", "v")
    queries = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    queries = queries.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("kind"), "id", "v")
    dealt = candidates.unionByName(queries).repartition("g").sortWithinPartitions("g", "kind")

    def run(batches):
        group, parts, lists = None, {}, {}
        for batch in batches:
            g, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ids, vectors = batch.column(2).to_numpy(), _vectors(batch.column(3))
            out = []
            for i in range(len(g)):
                if g[i] != group:
                    group, parts, lists = g[i], {}, {}
                v = vectors[i]
                if kind[i] == 0:
                    a = parts.setdefault(len(v), ([], []))
                    a[0].append(ids[i])
                    a[1].append(v)
                    continue
                if len(v) not in parts and len(v) not in lists:
                    continue
                if len(v) not in lists:
                    own, held = parts.pop(len(v))
                    lists[len(v)] = SortedLists(np.array(own, np.int64), np.array(held).reshape(len(held), len(v)))
                found, scores = lists[len(v)].search(int(ids[i]), v, k)
                out.append((np.full(len(found), ids[i]), found, np.array([int(s) for s in scores], np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(best))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark, sf_dir):
    return search_all(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)) e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM p QUALIFY rank <= 10"""
