"""Operator 5: exact top-k inner products by pivot-table elimination.

Vectors are integer (each component times 1024, rounded down).  A pivot table
holds the Euclidean distance of every vector to ``n_pivots`` pivots.  For a
query q and a row x, the triangle inequality gives d(q, x) >= |d(q, p) -
d(x, p)| for every pivot; the maximum over pivots, L, bounds the score from
above by (|q|^2 + |x|^2 - L^2) / 2.  Rows are evaluated in the order of that
bound and the search stops when the k-th best score exceeds the next bound,
so the result is exact; ties at the k-th score are evaluated, as they may
have a smaller id.

The pivot table is computed once and written: every vector with its distances
to the pivots of its length.  Rows and queries are dealt by hash into blocks
of bounded size, each length by itself, and each pair of a row block and a
query block is one task-sized piece of work (rows are repeated once per query
block, queries once per row block).  The k best of a piece are merged per
query.  Pivots are a bounded, hash-chosen sample of rows of each length; they
decide speed, never results.

Edge cases: vectors that are null, empty of components, or hold null or
non-finite components take no part, neither do null ids; a query is compared
with rows of its own length, as an inner product needs; repeated rows are rows
of their own, a repeated query id is one query for each length (its least
vector); a query leaves out every row with its own id; a query without other
rows gives none; a component beyond a long after scaling, and a score beyond
a long, is held at the bound; an empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

SCALE, TOP, PIVOTS = 1024, 10, 32
ROW_BLOCK, QUERY_BLOCK = 4096, 4096
CHUNK = 256


def quantised(c: Column, scale: int = SCALE) -> Column:
    """array<long> of floor(scale * x); null if any component is null or not finite."""
    good = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(c.isNotNull() & (F.size(c) > 0) & good, F.transform(c, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distance of every row of x to every pivot."""
    x = x.astype(np.float64)
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * (x @ pivots.T), 0.0))


def search_block(q_id: np.ndarray, q: np.ndarray, q_table: np.ndarray, x_id: np.ndarray, x: np.ndarray, table: np.ndarray, k: int) -> Iterator[tuple]:
    """(query id, row ids, scores, rows evaluated) of the k best rows of one block for every query of one block.

    q and x are whole-number vectors, q_table and table their distances to the same pivots.
    """
    order = np.argsort(x_id, kind="stable")  # ties to the smaller id
    x_id, x, table = x_id[order], x[order], table[order]
    largest = max(int(np.abs(v.astype(np.float64)).max(initial=0.0)) for v in (x, q))
    most = largest * largest * x.shape[1]
    exact = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object  # products and sums are exact in this type
    rows_of, ask_of = x.astype(exact), q.astype(exact)
    norm, ask_norm = (x.astype(np.float64) ** 2).sum(1), (q.astype(np.float64) ** 2).sum(1)
    for n in range(len(q)):
        gap = np.abs(table - q_table[n]).max(axis=1)
        both = norm + ask_norm[n]
        bound = (both - np.maximum(gap - 1e-3 - 1e-6 * np.sqrt(both), 0.0) ** 2) / 2 + 1.0 + 1e-6 * both  # rounding never cuts a row off
        own = x_id == q_id[n]
        bound[own] = -np.inf
        by_bound = np.argsort(-bound, kind="stable")[:len(x) - int(own.sum())]
        best_id, best, evaluated = np.empty(0, np.int64), np.empty(0, np.int64), 0
        for at in range(0, len(by_bound), CHUNK):
            rows = by_bound[at:at + CHUNK]
            if len(best) == k and best[-1] > bound[rows[0]]:
                break
            if len(best) == k:
                rows = rows[bound[rows] >= best[-1]]
            score = rows_of[rows] @ ask_of[n]
            if exact is object:
                score = np.array([min(max(int(v), -(1 << 63)), (1 << 63) - 1) for v in score], np.int64)
            evaluated += len(rows)
            best_id, best = np.concatenate([best_id, x_id[rows]]), np.concatenate([best, score.astype(np.int64)])
            first = np.lexsort((best_id, ~best))[:k]
            best_id, best = best_id[first], best[first]
        yield q_id[n], best_id, best, evaluated


def pivot_table(rows: DataFrame, n_pivots: int, row_block: int) -> DataFrame:
    """(id, v, is_query, size, r, far): every vector with its row block and its distances to the pivots of its length."""
    sizes = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).select("size", F.ceil(F.col("n") / row_block).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "size").withColumn("r", F.pmod(F.xxhash64("id", "v", F.lit(1)), F.col("blocks")).cast("int")).drop("blocks")
    place = F.row_number().over(Window.partitionBy("size").orderBy(F.xxhash64("v"), "id"))  # limited before its exchange
    pivots = rows.withColumn("place", place).where(F.col("place") <= n_pivots).join(sizes, "size") \
        .select(F.col("size").alias("p_size"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("p_r"), F.col("v").alias("p"))

    def fill(x: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        far = distances(np.stack(x["v"].to_numpy()), np.stack(p["p"].to_numpy()).astype(np.float64)) if len(x) else []
        return x.assign(far=list(far))[["id", "v", "is_query", "size", "r", "far"]]
    return dealt.groupBy("size", "r").cogroup(pivots.groupBy("p_size", "p_r")) \
        .applyInPandas(fill, "id long, v array<long>, is_query boolean, size int, r int, far array<double>")


def exact_top_k(table: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = TOP, scale: int = SCALE,
                n_pivots: int = PIVOTS, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, id, score): the k rows with the highest integer inner product for each query row."""
    rows = stored(table.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vec_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
                  .where("id is not null and v is not null").withColumn("size", F.size("v")), "vectors")
    rows = stored(pivot_table(rows, n_pivots, row_block), "pivot-table")
    counts = rows.groupBy("size").agg(F.max("r").alias("last"), F.ceil(F.count_if("is_query") / query_block).cast("int").alias("q_blocks")).where("q_blocks > 0")
    span = lambda last: F.explode(F.sequence(F.lit(0), last))
    left = rows.join(counts, "size").select("size", "r", span(F.col("q_blocks") - 1).alias("q"), "id", "v", "far")
    queries = rows.where("is_query").groupBy("size", "id").agg(F.min(F.struct("v", "far")).alias("s")).select("size", "id", "s.*").join(counts, "size")
    q = F.pmod(F.xxhash64("id", "v", F.lit(2)), F.col("q_blocks")).cast("int")
    right = queries.select(F.col("size").alias("q_size"), span(F.col("last")).alias("q_r"), q.alias("q_q"), F.col("id").alias("q_id"), F.col("v").alias("q_v"), F.col("far").alias("q_far"))

    def search(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(q):
            mat = lambda v: np.stack(v.to_numpy())
            for i, ids, scores, _ in search_block(q["q_id"].to_numpy(), mat(q["q_v"]), mat(q["q_far"]), x["id"].to_numpy(), mat(x["v"]), mat(x["far"]), k):
                out.append(pd.DataFrame({"size": q["q_size"].iat[0], "query_id": i, "id": ids, "score": scores}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("size", "query_id", "id", "score")})

    found = left.groupBy("size", "r", "q").cogroup(right.groupBy("q_size", "q_r", "q_q")).applyInPandas(search, "size int, query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("size", "query_id").orderBy(F.col("score").desc(), "id"))  # at most k rows per row block
    return found.select("query_id", rank.alias("rank"), F.col("id").alias(id_col), "score").where(F.col("rank") <= k)
