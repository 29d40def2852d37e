"""Exact top-k search by inner product: MaxScore.

A vector's components are its terms; a shard holds, for each term, the postings (that
component of all its vectors) with their least and greatest value.  For a query, the
product with the better of the two bounds what a term can add, and the product with the
worse what it adds at least.  Terms are taken in the order of how widely they can move a
score.  Given the query's k-th best score so far, the trailing terms whose widths
together cannot lift a vector from the least possible score to it are non-essential.
Only the essential postings are traversed for all vectors; those that can still reach
the k-th best are probed in the non-essential terms, a slice after the other, and are
dropped as soon as the bound of the terms to come is too small.  A query's k best are
carried from one shard to the next.

All arithmetic is on integers held in doubles below 2**53, so scores are exact.

Vectors are written once, quantised.  Queries are dealt into blocks of about
``QUERY_BLOCK`` and vectors into groups of about ``GROUP_ROWS``; each cell of blocks and
groups is one task's work, so no list of queries reaches the driver, a query block is
read once a group, and a vector once a query block.  Cells' k best are merged per query.

Cases: vectors that are null, or hold a null or a non-finite component, take no part,
neither do empty ones and rows without an id; vectors of another length than the query's
score nothing with it; ties go to the smaller id; rows that repeat an id are candidates
one by one, but never for a query of their own id, and queries that repeat an id are one
query, whose hits are those of all its rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doctide.llm.work import Work

K, QUERY_BLOCK, GROUP_ROWS, SLICE, SHARD_ROWS = 5, 4096, 65_536, 8, 4096
RESULT = "query_id long, vec_id long, score long"


def quantise(df: DataFrame, vector: str, id_col: str, scale: int = 256) -> DataFrame:
    """id, v: floor(scale * x) of each component, of the vectors that take part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)
    scaled = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    return rows.select(F.col(id_col).cast("long").alias("id"), scaled.alias("v"))


class Shard:
    """Vectors of one length, term by term."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.terms = ids, np.ascontiguousarray(rows.T)
        self.low, self.high = self.terms.min(1), self.terms.max(1)

    def plan(self, query: np.ndarray, floor_: float) -> tuple[np.ndarray, int, np.ndarray]:
        """(order of the terms, number of essential ones, most that the terms from each place on can add)."""
        a, b = query * self.low, query * self.high
        most, least = np.maximum(a, b), np.minimum(a, b)
        width = most - least
        order = np.argsort(-width, kind="stable")
        tail = np.append(np.cumsum(width[order][::-1])[::-1], 0)
        # a vector that gets no more than the least from each essential term stays below the k-th best
        essential = int(np.searchsorted(-tail, -(floor_ - least.sum()), side="right")) if floor_ > -np.inf else len(order)
        return order, min(essential, len(order)), np.append(np.cumsum(most[order][::-1])[::-1], 0)

    def search(self, query: np.ndarray, own: int, k: int, best: list[tuple[float, int]]) -> list[tuple[float, int]]:
        """best, (-score, id) in order, after this shard; own is no candidate."""
        floor_ = -best[-1][0] if len(best) == k else -np.inf
        order, done, rest = self.plan(query, floor_)
        score = query[order[:done]] @ self.terms[order[:done]]
        alive = np.flatnonzero(score + rest[done] >= floor_)
        alive = alive[self.ids[alive] != own]
        score = score[alive]
        while done < len(order) and len(alive):
            now = order[done:done + SLICE]
            score = score + query[now] @ self.terms[np.ix_(now, alive)]
            done += len(now)
            keep = score + rest[done] >= floor_
            alive, score = alive[keep], score[keep]
        if len(alive) > k:  # ties with the k-th are all kept until ids decide
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            alive, score = alive[keep], score[keep]
        return sorted(best + list(zip((-score).tolist(), self.ids[alive].tolist())))[:k] if len(alive) else best


def _by_length(table: pa.Table):
    """(length, ids, vectors) of the rows of each length."""
    ids, vectors = table.column("id").to_numpy(), table.column("v").combine_chunks()
    offsets, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy()
    sizes = np.diff(offsets)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield int(n), ids[rows], flat[offsets[rows][:, None] + np.arange(n)]


def _cell(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if queries.num_rows and rows.num_rows:
            shards = {n: [Shard(ids[a:a + SHARD_ROWS], v[a:a + SHARD_ROWS]) for a in range(0, len(ids), SHARD_ROWS)]
                      for n, ids, v in _by_length(rows)}
            for n, ids, vectors in _by_length(queries):
                for q, vector in zip(ids.tolist(), vectors):
                    best: list[tuple[float, int]] = []
                    for shard in shards.get(n, ()):
                        best = shard.search(vector, q, k, best)
                    out += [(q, i, int(-s)) for s, i in best]
        return pa.table({name: pa.array([x[j] for x in out], pa.int64()) for j, name in enumerate(("query_id", "vec_id", "score"))})
    return run


def search(df: DataFrame, vector: str = "embedding", id_col: str = "vec_id", every: int = 50, k: int = K,
           query_block: int = QUERY_BLOCK, group_rows: int = GROUP_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by every, against all rows."""
    spark = df.sparkSession
    work = Work(spark, "topk")
    rows = work.put(quantise(df, vector, id_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    is_query = F.col("id") % every == 0
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    n_blocks = max(1, -(-n_queries // query_block))
    n_groups = max(1, -(-n // group_rows), min(-(-2 * spark.sparkContext.defaultParallelism // n_blocks), -(-n // 256)))
    dealt = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(parts)).cast("int")
    queries = rows.filter(is_query).select(
        "id", "v", dealt(1, n_blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("part"))
    vectors = rows.select(
        "id", "v", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), dealt(2, n_groups).alias("part"))
    # dealt by number: a cell is little data and much work, which sizes alone would put together in one task
    queries, vectors = (x.repartition(n_blocks * n_groups, "block", "part") for x in (queries, vectors))
    found = queries.groupBy("block", "part").cogroup(vectors.groupBy("block", "part")).applyInArrow(_cell(k), RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
