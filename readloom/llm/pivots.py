"""Exact top-k search by inner product with a table of distances to pivots.

Components become integers, floor(256 * x). Every row's distances to the same
pivots are computed once and stored. For a query, the largest difference of the
two rows' distances to a pivot is a lower bound of their distance, and so an
upper bound of their inner product, as the lengths are known. Candidates are
evaluated in the order of that bound, until the next bound is below the k-th
best score; an equal bound is still evaluated, as ties go to the smaller id.

The stated queries meet all rows in blocks: each block of queries meets each
block of rows once, in one task of bounded size. Pivots are chosen from a
bounded sample; any choice gives the same result.

Defined results: vectors that are null, or hold a null or non-finite component,
take no part, nor do rows without vec_id. Rows of one vec_id are taken once. Of
vectors of unequal length the shorter has zeros at its end. Fewer candidates
than k give fewer rows; an empty table gives none. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.session import Workspace

SCALE = 256
PIVOTS, SAMPLE = 16, 512
ROWS_A_BLOCK, QUERIES_A_BLOCK = 8192, 1024


def integers(embedding: Column) -> Column:
    """Components as integers; null if the vector takes no part."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(embedding, lambda x: F.floor(SCALE * x.cast("double")).cast("long"))
    return F.when(fine, whole)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, with zeros at the end of the shorter ones."""
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = max(x.shape[1], pivots.shape[1])
    x, pivots = wide(x, width).astype(float), wide(pivots, width).astype(float)
    square = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def choose(vectors: DataFrame) -> np.ndarray:
    """Pivots far from each other, out of ``SAMPLE`` rows."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("vector").limit(SAMPLE).collect()
    if not rows:
        return np.zeros((0, 0), np.int64)
    sample = matrix(pa.array([r[0] for r in rows], pa.list_(pa.int64())))
    chosen = [0]
    near = distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(PIVOTS, len(sample)):
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def pivot_table(embeddings: DataFrame, work: Workspace) -> DataFrame:
    """vec_id, vector and the distances to the pivots, stored."""
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("vector"))
    vectors = vectors.where("vec_id is not null and vector is not null").groupBy("vec_id").agg(F.max("vector").alias("vector"))
    vectors = work.keep("vectors", vectors)
    pivots = choose(vectors)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = distances(matrix(batch.column("vector")), pivots)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(to) + 1, dtype=np.int32) * to.shape[1]), pa.array(to.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["vec_id", "vector", "to_pivots"])

    return work.keep("pivot_table", vectors.mapInArrow(measure, "vec_id long, vector array<long>, to_pivots array<double>"))


def best(query: np.ndarray, own: int, to: np.ndarray, rows: np.ndarray, ids: np.ndarray, table: np.ndarray, squares: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of a block, candidates in the order of their bounds."""
    length = float(query.astype(float) @ query)
    apart = np.abs(table - to).max(1) if table.shape[1] else np.zeros(len(rows))
    apart = np.maximum(apart - 1e-6 * (1 + apart), 0)  # rounding must not lower a bound
    bound = (length + squares - apart**2) / 2
    bound += 1e-9 * np.abs(bound) + 1e-6
    order = np.argsort(-bound)
    found: list[tuple[int, int]] = []
    at, step = 0, 64
    while at < len(order):
        if len(found) == k and bound[order[at]] < -found[-1][0]:
            break
        part = order[at : at + step]
        part = part[ids[part] != own]
        scores = rows[part] @ query
        found = sorted([*found, *zip((-scores).tolist(), ids[part].tolist(), strict=True)])[:k]
        at, step = at + step, min(2 * step, 4096)
    return found


def search(embeddings: DataFrame, is_query: Column, k: int, work: Workspace) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k best rows."""
    rows = pivot_table(embeddings, work)
    queries = rows.where(is_query)
    n = max(-(-rows.count() // ROWS_A_BLOCK), 1)
    m = max(-(-queries.count() // QUERIES_A_BLOCK), 1)
    place = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count))
    right = rows.select("*", place(n).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias("part"))
    left = queries.select("*", place(m).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("block"))

    def meet(asked: pa.Table, given: pa.Table) -> pa.Table:
        asked, given = asked.combine_chunks(), given.combine_chunks()
        out = []
        if len(asked) and len(given):
            q, x = (matrix(t.column("vector").combine_chunks()) for t in (asked, given))
            width = max(q.shape[1], x.shape[1])
            q, x = wide(q, width), wide(x, width)
            dq, dx = (np.stack(t.column("to_pivots").to_numpy()) for t in (asked, given))
            squares = (x.astype(float) ** 2).sum(1)
            ids = given.column("vec_id").to_numpy()
            if max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) ** 2 * max(width, 1) < 2**52:
                q, x = q.astype(float), x.astype(float)  # products are exact
            for i, own in enumerate(asked.column("vec_id").to_pylist()):
                out += [(own, int(vec), int(-score)) for score, vec in best(q[i], own, dq[i], x, ids, dx, squares, k)]
        return pa.table({name: pa.array([r[j] for r in out], pa.int64()) for j, name in enumerate(("query_id", "vec_id", "score"))})

    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
