"""Token counts from flat token files: a vectorised separator scan stitched by a prefix scan.

A flat file is unsigned 16-bit ids end to end, documents closed by an
end-of-document id, without any index. It is stored as blocks of a fixed number
of ids that ignore the documents' bounds. Each block is searched for the end id
on its own and gives the ids before its first separator, the documents that lie
between two, and the ids after its last. A running total over the blocks of a
file then adds up the ids that a document has in earlier blocks; blocks without
any separator, of a document longer than a block, pass the total on.

``binary_files`` reads files of this form that other tools wrote.

Defined results: a document of no ids counts its end id alone. Ids after the
last separator of a file are a document that is not closed, reported with
closed = false. Rows without separator or files without ids give no documents.
An id past 65,535 is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.text import Texts, small_batches
from readloom.llm.token_files import VOCABULARY, word_codec

END = 49407
BLOCK_IDS = 1 << 14  # a batch of blocks has to fit a task

BLOCKS = "file long, block long, ids binary, names binary"


def flat_files(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, block: int = BLOCK_IDS) -> DataFrame:
    """One flat file for each partition of ``docs``, as rows (file, block, ids, names).
    ``names`` has the doc_ids of the documents that were added with the block, for
    labelling the counts later; the scan does not read it."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, file = word_codec(vocabulary, special=False), TaskContext.get().partitionId()
        waiting, number, names = b"", 0, b""

        def row(ids: bytes, names: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([ids], pa.binary()), pa.array([names], pa.binary())],
                names=["file", "block", "ids", "names"],
            )

        for batch in batches:
            texts, doc_ids = Texts(batch.column("text")), batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, last in texts.blocks():
                ids, sizes = own.encode(*texts.part(first, last))
                ids = np.insert(ids, np.cumsum(sizes), end)
                if ids.max(initial=0) > 0xFFFF:
                    raise ValueError("an id of this vocabulary does not fit 16 bits")
                waiting += ids.astype("<u2").tobytes()
                names += doc_ids[first:last].astype("<i8").tobytes()
                full = len(waiting) // (2 * block) * 2 * block
                for at in range(0, full, 2 * block):
                    yield row(waiting[at : at + 2 * block], names)
                    names, number = b"", number + 1
                waiting = waiting[full:]
        if waiting:
            yield row(waiting, names)

    rows = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, BLOCKS)


def binary_files(spark: SparkSession, path: str, block: int = BLOCK_IDS) -> DataFrame:
    """Flat files of a folder, each under 2 GB, as blocks."""
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file"), "path", "length", "content")
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(2 * block).cast("long"))
    rows = files.select("file", "content", F.posexplode(cuts).alias("block", "at"))
    return rows.select("file", F.col("block").cast("long"), F.expr(f"substring(content, cast(at + 1 as int), {2 * block})").alias("ids"))


def scan(blocks: DataFrame, end: int = END) -> DataFrame:
    """Per document of each file, in order: file, ordinal, start, n_tokens (with its end id), closed."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, inner, tail, size = [], [], [], []
            for ids in batch.column("ids"):
                values = np.frombuffer(ids.as_py(), "<u2")
                stops = np.flatnonzero(values == end) + 1
                head.append(int(stops[0]) if len(stops) else None)
                inner.append(np.diff(stops))
                tail.append(len(values) - (int(stops[-1]) if len(stops) else 0))
                size.append(len(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(head, pa.int64()), pa.array(inner, pa.list_(pa.int64())),
                 pa.array(tail, pa.int64()), pa.array(size, pa.int64())],
                names=["file", "block", "head", "inner", "tail", "size"],
            )

    found = blocks.select("file", "block", "ids").mapInArrow(
        find, "file long, block long, head long, inner array<long>, tail long, size long"
    )
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("resets", F.coalesce(F.count("head").over(before), F.lit(0)))
    found = found.withColumn("first", F.coalesce(F.sum(F.when(F.col("head").isNotNull(), 1 + F.size("inner")).otherwise(0)).over(before), F.lit(0)))
    found = found.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0)))
    # Ids since the last separator: a running total that starts anew after each block with one.
    open_ids = Window.partitionBy("file", "resets").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last_tail = F.last(F.when(F.col("head").isNotNull(), F.col("tail")), ignorenulls=True).over(before)
    found = found.withColumn("carry", F.coalesce(last_tail, F.lit(0)) + F.coalesce(F.sum(F.when(F.col("head").isNull(), F.col("size")).otherwise(0)).over(open_ids), F.lit(0)))
    sizes = F.concat(F.array(F.col("head") + F.col("carry")), F.col("inner"))
    closed = found.where(F.col("head").isNotNull()).select("file", "first", (F.col("base") - F.col("carry")).alias("begin"), F.posexplode(sizes).alias("k", "n_tokens"))
    inside = Window.partitionBy("file", "first").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    closed = closed.select(
        "file", (F.col("first") + F.col("k")).alias("ordinal"),
        (F.col("begin") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"), "n_tokens", F.lit(True).alias("closed"),
    )
    final = Window.partitionBy("file").orderBy(F.col("block").desc())
    rest = found.withColumn("r", F.row_number().over(final)).where("r = 1")
    left = F.when(F.col("head").isNull(), F.col("carry") + F.col("size")).otherwise(F.col("tail"))
    docs_so_far = F.col("first") + F.when(F.col("head").isNotNull(), 1 + F.size("inner")).otherwise(0)
    rest = rest.select("file", docs_so_far.alias("ordinal"), (F.col("base") + F.col("size") - left).alias("start"), left.alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionAll(rest.where("n_tokens > 0"))


def names(blocks: DataFrame) -> DataFrame:
    """file, ordinal and doc_id from the labels stored with the blocks."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, data in zip(*(batch.column(c) for c in ("file", "block", "names")), strict=True):
                ids = np.frombuffer(data.as_py(), "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), file.as_py())), pa.array(np.full(len(ids), block.as_py())), pa.array(np.arange(len(ids))), pa.array(ids)],
                    names=["file", "block", "k", "doc_id"],
                )

    rows = blocks.select("file", "block", "names").mapInArrow(unpack, "file long, block long, k long, doc_id long")
    sizes = blocks.select("file", "block", (F.octet_length("names") / 8).cast("long").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rows = rows.join(sizes, ["file", "block"])
    doc_id = F.nullif("doc_id", F.lit(-(2**63)))
    return rows.select("file", (F.col("first") + F.col("k")).alias("ordinal"), doc_id.alias("doc_id"))


def count_tokens(blocks: DataFrame) -> DataFrame:
    """doc_id, file, ordinal, start and n_tokens of every document."""
    return scan(blocks).join(names(blocks), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
