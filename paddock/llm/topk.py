"""Exact top-k search by Fagin's threshold algorithm.

Vectors become integers, floor(scale * component). Candidates are dealt into blocks by the hash
of their row's number, queries likewise; every pair of a query block and a candidate block is one group
of bounded size. Inside a group the candidates are kept as one sorted list per dimension. For each query
the lists are read from the end that its component favours, some entries deeper in every round;
a candidate seen for the first time is scored in full (the random access), and reading stops as
soon as the bound, the score of a made-up vector of the entries just read, is below the k-th best score
found (not merely equal, so that ties still go to the smaller id). The best of all blocks of a query are ranked at the end.

The work is queries times candidates at worst, which exact search over vectors without structure
comes down to; every group holds at most about ``query_block`` and ``block`` vectors, and a
vector or an id that many rows share is spread like any other.

Defined results: vectors that are null or empty or hold null or non-finite components take no part, nor do
null ids; rows that repeat an id are rows of their own, as queries and as candidates, so that a query's id can be among its
results; only vectors of equal length are compared; a query with fewer candidates than k lists them all; other columns are
ignored. Scores are exact up to the range of a 64-bit integer, beyond which they are cut to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.llm.common import cut, table

BLOCK, QUERY_BLOCK, DEPTH = 16_384, 1024, 64
SCALE, K = 256, 5


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(row, id, q): integer vectors, as doubles, with a number of their own."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return (vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0))
            .where(finite).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), q.alias("q")))


class Lists:
    """A block of candidates with one sorted list per dimension."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")  # by id: the first of equal scores is the smallest id
        self.ids, self.vectors = ids[order], vectors[order]
        self.at = {r: k for k, r in enumerate(rows[order].tolist())}
        # positions in ascending order of each component
        self.lists = np.argsort(self.vectors, axis=0, kind="stable")
        largest = np.abs(self.vectors).max(initial=0.0)
        self.largest = float(largest)

    def search(self, query: np.ndarray, own, k: int) -> tuple[list, list[int], int]:
        """(ids, scores, depth read) of the k best candidates but the row ``own``."""
        n, d = self.vectors.shape
        exact = float(np.abs(query).max(initial=0.0)) * self.largest * d < 2.0**53
        if not exact:  # products beyond the doubles' whole numbers: Python's integers
            whole = np.array([int(x) for x in query], object)
            scores = [sum(a * int(b) for a, b in zip(whole, row, strict=True)) for row in self.vectors]
            mine = self.at.get(own, -1)
            best = sorted((-s, i) for at, (s, i) in enumerate(zip(scores, self.ids, strict=True)) if at != mine)[:k]
            return [i for _, i in best], [max(-2**63, min(2**63 - 1, -s)) for s, _ in best], n
        axes = np.flatnonzero(query)
        if not len(axes):
            axes = np.arange(1)
        down = query[axes] >= 0  # read from the large end
        seen = np.zeros(n, bool)
        if own in self.at:
            seen[self.at[own]] = True
        where, scores = np.empty(0, np.int64), np.empty(0)
        depth, step = 0, DEPTH
        while depth < n:
            stop = min(n, depth + step)
            read = np.where(down, self.lists[::-1][depth:stop, axes], self.lists[depth:stop, axes])
            fresh = np.zeros(n, bool)
            fresh[read.ravel()] = True
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            where, scores = np.concatenate([where, new]), np.concatenate([scores, self.vectors[new] @ query])
            if len(scores) > k:  # keep the best k, ties to the smaller position
                keep = np.lexsort((where, -scores))[:k]
                where, scores = where[keep], scores[keep]
            depth, step = stop, step * 2
            if len(scores) >= k and float(query[axes] @ self.vectors[read[-1], axes]) < scores.min():
                break
        order = np.lexsort((where, -scores))[:k]
        return self.ids[where[order]].tolist(), [int(s) for s in scores[order]], depth


def top_k(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
          scale: int = SCALE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, id, score, depth) of the k best other vectors for every vector whose id meets
    ``queries``, once for each row that has the id; ``depth`` is how far the lists of the block that gave the row were read."""
    spark = vectors.sparkSession
    ready = cut(usable(vectors, id_col, vector_col, scale), "vectors")
    asked = ready.withColumnRenamed("id", id_col).where(queries).withColumnRenamed(id_col, "id")
    n, m = ready.count(), asked.count()
    blocks, asks = max(1, -(-n // block)), max(1, -(-m // query_block))
    kind = ready.schema["id"].dataType
    deal = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts))
    # every pair of blocks is a group: each side is dealt to the blocks of the other (a column that both sides
    # share is lost in the cogroup, hence the aliases)
    left = asked.select(F.size("q").alias("d"), deal("row", asks).alias("a"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"),
                        F.col("row").alias("row"), F.col("id").alias("who"), F.col("q").alias("v"))
    right = ready.select(F.size("q").alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asks - 1).cast("long"))).alias("a"),
                         deal("row", blocks).alias("b"), F.col("row").alias("row"), F.col("id").alias("who"), F.col("q").alias("v"))
    out = T.StructType([T.StructField("row", T.LongType()), T.StructField("query_id", kind), T.StructField("id", kind), T.StructField("score", T.LongType()),
                        T.StructField("depth", T.LongType())])

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.concatenate([np.asarray(c.flatten()) for c in t.column("v").chunks])
        return np.array(t.column("row").to_pylist()), np.array(t.column("who").to_pylist()), flat.reshape(len(t), -1)

    def search(asked_here: pa.Table, there: pa.Table) -> pa.Table:
        rows = {"row": [], "query_id": [], "id": [], "score": [], "depth": []}
        if len(asked_here) and len(there):
            numbers, ids, q = matrix(asked_here)
            lists = Lists(*matrix(there))
            for own, query_id, query in zip(numbers.tolist(), ids, q, strict=True):
                found, scores, depth = lists.search(query, own, k)
                rows["row"] += [own] * len(found)
                rows["query_id"] += [query_id] * len(found)
                rows["id"] += found
                rows["score"] += scores
                rows["depth"] += [depth] * len(found)
        from pyspark.sql.pandas.types import to_arrow_schema

        return pa.Table.from_pydict(rows, schema=to_arrow_schema(out))

    found = left.groupBy("d", "a", "b").cogroup(right.groupBy("d", "a", "b")).applyInArrow(search, out)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id_col), "score", "depth")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score")


OP2_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.own, a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.own <> b.own AND len(a.q) = len(b.q))
SELECT query_id, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) <= {K}"""
