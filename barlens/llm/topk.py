"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into segments; of each its mean and deviation are kept. For two vectors the sum over segments
of length x ((difference of means)^2 + (difference of deviations)^2) is at most their squared distance, so with
the exact norms it bounds the inner product from above: length x (product of means + product of deviations).
Bounds go from coarse to fine segments; only candidates that may still reach a query's k-th best score are
computed exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.llm.util import keep

#: Bytes of queries and of candidates, 8 a component, that meet in one task; and candidates that are bounded at once.
QUERY_BYTES, VECTOR_BYTES, STEP = 2 << 20, 16 << 20, 1024
#: One block of candidates in so many is searched first: its scores are where the others begin.
FIRST = 8
#: Segments of the resolutions, coarse to fine.
SEGMENTS = (4, 16, 32)
#: Integers up to this size are exact in a double.
EXACT = 1 << 53


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each row's segments, each times the root of the segment's length."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    size = np.diff(cuts)
    total = np.add.reduceat(x, cuts[:-1], axis=1)
    square = np.add.reduceat(x * x, cuts[:-1], axis=1)
    mean = total / size
    return np.concatenate([mean * np.sqrt(size), np.sqrt(np.maximum(square - size * mean * mean, 0))], axis=1)


def search(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, vector id, score) of the k best of each query, in no order, and how many products were computed.

    q and x hold integers; equal scores go to the smaller id; a vector with the query's own id is passed over. `least`
    has a score for each query that k others are known to reach: what is below is left out.
    """
    big = max((np.abs(a).max(initial=0) for a in (q, x)), default=0)
    exact = bool(float(big) ** 2 * q.shape[1] < EXACT)
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    slack = 1e-9 * (1 + float(big) ** 2 * q.shape[1])
    q_stats, x_stats = ([statistics(a, s) for s in SEGMENTS] for a in (qf, xf))
    best = np.full(len(q), -np.inf) if least is None else least.astype(np.float64)  # the k-th best score so far
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    computed = 0
    for lo in range(0, len(x), STEP):
        at = slice(lo, lo + STEP)
        own = q_id[:, None] != x_id[None, at]
        alive = own & (q_stats[0] @ x_stats[0][at].T + slack >= best[:, None])
        for qs, xs in zip(q_stats[1:], x_stats[1:], strict=True):
            rows = alive.any(axis=1)
            alive[rows] &= qs[rows] @ xs[at].T + slack >= best[rows, None]
        i, j = np.nonzero(alive)
        j += lo
        computed += len(i)
        score = np.empty(len(i), np.int64)
        for a in range(0, len(i), 1 << 16):
            b = slice(a, a + (1 << 16))
            score[b] = np.einsum("ij,ij->i", qf[i[b]], xf[j[b]]) if exact else (q[i[b]] * x[j[b]]).sum(axis=1)
        near = score >= best[i]
        held.append((i[near], x_id[j[near]], score[near]))
        i, v, s = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((v, -s, i))
        i, v, s = i[order], v[order], s[order]
        start = np.searchsorted(i, np.arange(len(q)))
        top = np.arange(len(i)) - start[i] < k
        i, v, s = i[top], v[top], s[top]
        held = [(i, v, s)]
        count = np.bincount(i, minlength=len(q))
        full = count >= k
        best[full] = np.maximum(best[full], s[(np.cumsum(count) - 1)[full]])
    i, v, s = held[0] if held else (np.zeros(0, np.int64),) * 3
    return i, v, s, computed


def whole(vector: str) -> Column:
    """floor(1024 x) of each component, as integers; null where the vector has null or non-finite components."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * 1024).cast("bigint")))


def top_k(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best vectors of each query row: (query_id, rank, vec_id, score).

    Rows with a null id or a vector that is null or holds null or non-finite components take no part; vectors
    of other lengths than the query's are not compared. Rows that repeat an id are candidates of their own, but
    none of their own id's queries; a repeated query is answered once, with its least vector. Fewer candidates than k: all. An
    empty table gives no rows. Products beyond 64 bits wrap.

    All queries meet all candidates in blocks of QUERY_BYTES and VECTOR_BYTES: each block of queries is dealt to every
    block of candidates and the other way round, each pair of blocks keeps k rows a query, and the last window merges
    those. One block in FIRST comes first, and the k-th best scores there are what the others must reach. Rows are dealt by
    number, so rows that repeat an id or a vector are spread.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), whole(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = keep(rows.withColumn("deal", F.xxhash64("id", F.monotonically_increasing_id())), "vectors")
    width = 8 * F.size("v").cast("bigint")
    sizes = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(F.col("q"), width)), F.lit(0)).alias("asked")).first()
    x_blocks = max(-(-sizes["bytes"] // VECTOR_BYTES), min(2 * spark.sparkContext.defaultParallelism, -(-sizes["n"] // (4 * STEP))), 1)
    q_blocks = max(1, -(-sizes["asked"] // QUERY_BYTES))

    def every(lo: int, hi: int) -> Column:
        return F.explode(F.sequence(F.lit(lo), F.lit(hi - 1)))

    queries = rows.where("q").groupBy("id").agg(F.min("v").alias("v")).withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int"))
    # Columns of their own: both sides come from one table.
    dealt = rows.select(F.col("id").alias("x_id"), F.col("v").alias("x"), F.pmod("deal", F.lit(x_blocks)).cast("int").alias("xb"))

    def block(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(vectors):
            mine, theirs = queries["v"].map(len), vectors["x"].map(len)
            for n in sorted({*mine} & {*theirs} - {0}):
                a, b = queries[mine == n], vectors[theirs == n]
                i, v, s, _ = search(np.stack(a["v"]), a["id"].to_numpy(), np.stack(b["x"]), b["x_id"].to_numpy(), k, a["least"].fillna(-np.inf).to_numpy(float))
                out.append(pd.DataFrame({"query_id": a["id"].to_numpy()[i], "vec_id": v, "score": s}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})

    def found(asked: DataFrame, lo: int, hi: int) -> DataFrame:
        """What blocks lo .. hi - 1 of the candidates have for queries (id, v, qb, least)."""
        asked = asked.select("id", "v", "qb", "least", every(lo, hi).alias("xb"))
        there = dealt.where(F.col("xb").between(lo, hi - 1)).select("x_id", "x", "xb", every(0, q_blocks).alias("qb"))
        return asked.groupBy("qb", "xb").cogroup(there.groupBy("qb", "xb")).applyInPandas(block, "query_id bigint, vec_id bigint, score bigint")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    first = -(-x_blocks // FIRST)
    local = found(queries.withColumn("least", F.lit(None).cast("double")), 0, first)
    if first < x_blocks:
        local = keep(local, "first")
        # A double holds fewer integers than a score has: one step below is no more than the score.
        least = local.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id"), (F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * 1e-15).alias("least"))
        local = local.unionByName(found(queries.join(least, queries["id"] == least["query_id"], "left"), first, x_blocks))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
