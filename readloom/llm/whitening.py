"""Embedding whitening: vectors projected on the leading components of their covariance, to unit variance.

Components of vectors become integers, floor(256 * c). The model is fitted on
each distinct vector once: their number n and exact sums S are counted first;
then every task adds the outer products of its vectors less S / n to one matrix,
and the entries of the tasks' matrices are summed by key. The covariance has a
row and a column for each dimension, whatever the number of vectors, so it is
decomposed where the job is driven (``eigen``) and the components, a few
vectors, go to all tasks for the projection. A last pass over the distinct
vectors measures the covariance of what was projected.

Vectors travel packed, in as few bytes a number as the vector needs, so equal
vectors are equal bytes and are told apart exactly.

Defined results: vectors that are null, or hold a null or non-finite component,
take no part, nor do vectors of another length than the commonest one (of
equally common ones, the longest). Integers beyond 64 bits are held at their
bounds. Equal rows get equal results; a null id stays. A component without any
variance (fewer vectors or directions than components) gives no rows, so a
single vector or an empty table gives none. ``deviation`` is null where it does
not fit a long. Other columns are in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.eigen import leading
from readloom.session import Workspace

SCALE, COMPONENTS = 256, 4
ROWS = 4096  # vectors held as doubles at a time
LEAST = 1e-12  # share of the variance under which a component has none
WIDTHS = (2, 4, 8)
LIMIT = 2.0**63


@dataclass(frozen=True)
class Model:
    """n distinct vectors with ``sums``; ``components`` (rows) with ``values``, falling."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    total: float
    identity_error: float = 0.0


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integers of all vectors end to end, the lengths, and which vectors take part."""
    column = column.cast(pa.large_list(pa.float64()))
    sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pa.compute.fill_null(column.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    fine = np.isfinite(flat)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~fine)])
    takes = (bad[ends] == bad[ends - sizes]) & pa.compute.is_valid(column).to_numpy(zero_copy_only=False)
    x = np.floor(SCALE * np.where(fine, flat, 0.0))
    whole = np.where(x >= LIMIT, np.iinfo(np.int64).max, np.clip(x, -LIMIT, LIMIT * (1 - 2.0**-53)).astype(np.int64))
    return whole, sizes, takes


def pack(x: np.ndarray) -> bytes:
    """A vector in 2, 4 or 8 bytes a number; the first byte tells which."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    width = next(w for w in WIDTHS if -(1 << (8 * w - 1)) <= low and high < 1 << (8 * w - 1))
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def unpack(column: pa.Array, size: int) -> np.ndarray:
    """Packed vectors of one length as a matrix."""
    out = np.zeros((len(column), size), np.int64)
    data = [x.as_buffer() for x in column]
    width = np.array([memoryview(d)[0] for d in data], np.int64)
    for w in WIDTHS:
        which = np.flatnonzero(width == w)
        if len(which):
            joined = np.frombuffer(b"".join(memoryview(data[i])[1:] for i in which), f"<i{w}")
            out[which] = joined.reshape(-1, size)
    return out


def packed(vectors: DataFrame, column: str) -> DataFrame:
    """size and packed vector x of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes, takes = integers(batch.column(0))
            ends = np.cumsum(sizes)
            chosen = np.flatnonzero(takes)
            x = [pack(flat[ends[i] - sizes[i] : ends[i]]) for i in chosen.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(sizes[chosen], pa.int64()), pa.array(x, pa.binary())], names=["size", "x"])

    return vectors.select(F.col(f"`{column}`").cast("array<double>").alias("v")).mapInArrow(run, "size long, x binary")


def fit(vectors: DataFrame, work: Workspace, column: str = "embedding", components: int = COMPONENTS) -> Model:
    every = packed(vectors, column)
    distinct = work.keep("distinct_vectors", every.groupBy("size", "x").agg(F.count("*").alias("times")))
    # One row for each length that occurs at all.
    lengths = distinct.groupBy("size").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), F.desc("size")).limit(1).collect()
    size = int(lengths[0]["size"]) if lengths else 0
    if not size:
        return Model(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    distinct = distinct.where(F.col("size") == size).select("x")
    n, sums = totals(distinct, size)
    covariance = products(distinct, size, n, sums) / n
    values, rows = leading(covariance, components)
    total = float(np.trace(covariance))
    some = int((values > LEAST * total).sum())
    model = Model(n, sums, values[:some], rows[:some], total)
    if not some:
        return model
    got = spread_of(distinct, model)
    return Model(n, sums, values[:some], rows[:some], total, float(np.abs(got - np.eye(some)).max()))


def totals(distinct: DataFrame, size: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            x = unpack(batch.column("x"), size)
            count += len(x)
            # Upper and lower halves, so that no sum of a task leaves 64 bits.
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        each = pa.array(np.arange(size + 1), pa.int64())
        yield pa.RecordBatch.from_arrays([each, pa.array([count, *high.tolist()], pa.int64()), pa.array([0, *low.tolist()], pa.int64())], names=["at", "high", "low"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = distinct.mapInArrow(run, "at long, high long, low long").groupBy("at").agg(wide("high"), wide("low")).collect()  # one row a dimension
    found = {r["at"]: (int(r["high"]), int(r["low"])) for r in rows}
    return found[0][0], [(found[i + 1][0] << 32) + found[i + 1][1] for i in range(size)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n; the whole part of S / n is taken off exactly."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(float) - rest


def products(distinct: DataFrame, size: int, n: int, sums: list[int]) -> np.ndarray:
    """Sum of the outer products of the centred vectors."""
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = centred(unpack(batch.column("x").slice(at, ROWS), size), n, sums)
                total += x.T @ x
        places = pa.array(np.arange(len(upper[0])), pa.int64())
        yield pa.RecordBatch.from_arrays([places, pa.array(total[upper])], names=["place", "value"])

    rows = distinct.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros((size, size))
    where = rows["place"].to_numpy()
    out[upper[0][where], upper[1][where]] = rows["value"].to_numpy()
    return np.triu(out) + np.triu(out, 1).T


def projected(x: np.ndarray, model: Model) -> np.ndarray:
    return centred(x, model.n, model.sums) @ model.components.T / np.sqrt(model.values)


def spread_of(distinct: DataFrame, model: Model) -> np.ndarray:
    """Covariance of the projected vectors, about their own mean."""
    size, k = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = projected(unpack(batch.column("x").slice(at, ROWS), size), model)
                y = np.column_stack([y, np.ones(len(y))])
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange((k + 1) ** 2), pa.int64()), pa.array(total.reshape(-1))], names=["place", "value"])

    rows = distinct.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()  # (k + 1)^2 rows
    flat = np.zeros((k + 1) ** 2)
    for r in rows:
        flat[r["place"]] = r["value"]
    total = flat.reshape(k + 1, k + 1)
    mean = total[k, :k] / model.n
    return total[:k, :k] / model.n - np.outer(mean, mean)


def deviations(x: np.ndarray, model: Model) -> list[int | None]:
    """Sum over the dimensions of (n x - S)^2; null beyond a long."""
    most = max(int(np.abs(x.astype(float)).max(initial=0)) * model.n, 1) + max(map(abs, model.sums), default=0)
    if most * most * x.shape[1] < 2**62:
        apart = model.n * x - np.array(model.sums, np.int64)
        return (apart * apart).sum(1).tolist()
    exact = [sum((model.n * v - s) ** 2 for v, s in zip(row, model.sums, strict=True)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, model: Model, column: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the kept columns) and one row for each component, numbered from 1 by falling eigenvalue."""
    keep = vectors.columns if keep is None else keep
    source = vectors.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{column}`").cast("array<double>").alias("v"))
    out = T.StructType([source.schema["row"], *T._parse_datatype_string(OUT).fields])
    k, size = len(model.values), len(model.sums)
    explained = model.values / model.total if k else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if k else 0, ROWS):
                part = batch.slice(at, ROWS)
                flat, sizes, takes = integers(part.column("v"))
                ends = np.cumsum(sizes)
                chosen = np.flatnonzero(takes & (sizes == size))
                x = flat[(ends[chosen] - size)[:, None] + np.arange(size)]
                y, m = projected(x, model), len(chosen)
                rows = part.column("row").take(pa.array(np.repeat(chosen, k)))
                columns = [
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n), pa.int64()),
                    pa.array([d for d in deviations(x, model) for _ in range(k)], pa.int64()), pa.array(y.reshape(-1)),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays([rows, *columns], names=out.names)

    return source.mapInArrow(run, out)
