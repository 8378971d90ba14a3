"""Exact top-k inner-product search by columnar branch and bound.

Candidates and queries are dealt into tiles of bounded size: every candidate
row belongs to one tile and every query row to one block, and each (tile,
block) pair is one group. In a group the candidates are laid out vertically,
one array per block of dimensions. Scores are accumulated block by block; the
norm that is left in the remaining dimensions bounds what a candidate can still
gain or lose (Cauchy-Schwarz), and candidates that can't reach the k-th best
lower bound any more are compacted away. A first tile is searched alone; the
k-th best score it gives a query is a lower bound for that query in all other
tiles. The per-tile winners meet in a window per query.

Scores are integer inner products of ``floor(scale * x)``. They are exact:
float64 is used while every partial sum stays below 2**53, Python integers
beyond that; a score that does not fit a long is cut to the nearest long.

Defined results: vectors that are null, empty, or hold null or non-finite
components and rows without an id take no part. Repeated rows, and rows of an
equal id, are rows of their own: each query row gets its own ten, from every row
but itself. Vectors of different lengths are not compared. Ties go to the
smaller id. Empty tables give empty results, other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.llm.common import settle

#: Components taken in one step.
BLOCK = 8


def _quantised(vectors: pa.ChunkedArray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and floor(scale * x), as float64 where exact, else as Python integers."""
    rows = vectors.combine_chunks()
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.chunk(0) if rows.num_chunks else pa.array([], rows.type)
    if not len(rows):
        return np.zeros(0, int), np.zeros((0, 0))
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(rows), -1)
    good = np.isfinite(flat).all(axis=1)
    with np.errstate(over="ignore"):
        whole = np.floor(flat[good] * scale)
    if not np.isfinite(whole).all() or np.abs(whole).max(initial=0) ** 2 * max(1, whole.shape[1]) >= 2.0**53:
        exact = [[math.floor(int(x) * scale if abs(x) > 2.0**60 else x * scale) for x in row] for row in flat[good]]
        whole = np.array(exact, dtype=object).reshape(-1, flat.shape[1])
    return np.flatnonzero(good), whole


def search_block(q_rows, queries, floors, c_rows, c_ids, cands, k: int):
    """The k best candidates of each query in a tile: lists of query row, candidate id, score.

    ``floors`` are scores that k candidates of other tiles reach; candidates below are left out.
    """
    out_q, out_c, out_s = [], [], []
    if not len(c_ids) or not len(q_rows):
        return out_q, out_c, out_s
    exact = queries.dtype == object or cands.dtype == object
    if exact:
        queries, cands = queries.astype(object), cands.astype(object)
    size = cands.astype("f8")
    order = np.argsort(-np.square(size).sum(axis=0), kind="stable")
    parts = [order[i : i + BLOCK] for i in range(0, len(order), BLOCK)]
    vertical = [np.ascontiguousarray(cands[:, p].T) for p in parts]
    left_c = np.zeros((len(parts) + 1, len(c_ids)))
    for i in range(len(parts) - 1, -1, -1):
        left_c[i] = left_c[i + 1] + np.square(size[:, parts[i]]).sum(axis=1)
    left_c = np.sqrt(left_c) * (1 + 1e-9)
    for q_row, q, floor in zip(q_rows, queries, floors, strict=True):
        alive = np.flatnonzero(c_rows != q_row)
        score = np.zeros(len(alive), dtype=object if exact else "f8")
        wide = q.astype("f8")
        whole = len(alive) == len(c_ids)
        for i, p in enumerate(parts):
            score = score + q[p] @ (vertical[i] if whole else vertical[i][:, alive])
            if i + 1 < len(parts) and (len(alive) > k or floor > -math.inf):
                rest = np.sqrt(sum(np.square(wide[x]).sum() for x in parts[i + 1 :])) * left_c[i + 1][alive] + 1
                now = score.astype("f8")
                slack = 1e-9 * np.abs(now) + rest
                least = floor
                if len(alive) > k:
                    least = max(least, np.partition(now - slack, len(now) - k)[len(now) - k])
                keep = now + slack >= least
                if keep.sum() < 0.8 * len(keep):
                    alive, score, whole = alive[keep], score[keep], False
        ids = c_ids[alive]
        best = sorted(range(len(ids)), key=lambda j: (-score[j], ids[j])) if exact else np.lexsort((ids, -score))
        for j in best[:k]:
            out_q.append(int(q_row))
            out_c.append(int(ids[j]))
            out_s.append(min(max(int(score[j]), -(2**63)), 2**63 - 1))
    return out_q, out_c, out_s


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with a number ``row`` of each: its id, or where an id repeats, a number below all ids in use."""
    again = settle(rows.groupBy("id").count().where("count > 1").select("id"))
    if again.isEmpty():
        return rows.withColumn("row", F.col("id"))
    least = rows.agg(F.min("id")).first()[0]
    copies = settle(rows.join(again, "id", "left_semi").withColumn("row", F.lit(min(least, 0) - 1) - F.monotonically_increasing_id()))
    return rows.join(again, "id", "left_anti").withColumn("row", F.col("id")).unionByName(copies)


def exact_topk(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
    tile_rows: int = 4096,
    query_rows: int = 8192,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` best rows of ``vectors``.

    ``tile_rows`` and ``query_rows`` bound the mean size of a group; each
    candidate is sent once per query block, each query once per tile.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("q"))
    rows = rows.where(
        F.col("id").isNotNull()
        & F.col("v").isNotNull()
        & (F.size("v") > 0)
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ).withColumn("q", F.coalesce("q", F.lit(False)))
    rows = numbered(rows)
    total, asked = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    tiles, blocks = max(1, -(-total // tile_rows)), max(1, -(-asked // query_rows))
    number = F.xxhash64(F.col("row"))
    dims = F.size("v").alias("d")
    tile = F.pmod(number, F.lit(tiles)).alias("t")
    cands = rows.select("id", "row", "v", dims, tile, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    queries = rows.where("q").select("row", "v", dims, F.pmod(F.shiftright(number, 20), F.lit(blocks)).cast("int").alias("b"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at_q, q = _quantised(left["v"], scale)
        at_c, c = _quantised(right["v"], scale)
        of = lambda table, name, at: table[name].to_numpy()[at] if len(at) else np.zeros(0, "i8")
        found = search_block(of(left, "row", at_q), q, of(left, "floor", at_q), of(right, "row", at_c), of(right, "id", at_c), c, k)
        return pa.table([pa.array(x, pa.int64()) for x in found], names=["query_row", "vec_id", "score"])

    def search(asked: DataFrame, offered: DataFrame) -> DataFrame:
        asked, offered = asked.toDF(*asked.columns), offered.toDF(*offered.columns)  # both come from the same rows
        return asked.groupBy("d", "t", "b").cogroup(offered.groupBy("d", "t", "b")).applyInArrow(run, "query_row long, vec_id long, score long")

    nothing = F.lit(-math.inf)
    first = settle(search(queries.select("*", F.lit(0).cast("long").alias("t"), nothing.alias("floor")), cands.where("t = 0")))
    reached = first.groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    bounded = queries.join(reached.select(F.col("query_row").alias("row"), F.col("floor").cast("double")), "row", "left").withColumn("floor", F.coalesce("floor", nothing))
    near = first
    if tiles > 1:
        elsewhere = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(tiles - 1).cast("long")))
        near = near.union(search(bounded.withColumn("t", elsewhere), cands.where("t > 0")))
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ids = rows.where("q").select(F.col("row").alias("query_row"), F.col("id").alias("query_id"))
    return ranked.join(ids, "query_row").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
