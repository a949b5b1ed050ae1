"""Which keys occur more than once: sorted keys of large blocks of windows meet in buckets.

A task takes a block of many documents, about a million windows, sorts the keys
of all its windows, and sends each stretch of the key range, as one row of
packed differences with the windows' slots, to the bucket of that stretch. The
bucket finds the keys that occur again and answers with their slots; the answers
of all buckets meet in the block. A key that occurs often in one block is sent
once, with its number, so a bucket gets it at most once for each block, however
often it occurs in the whole table. No row is made for each window.

Rows: (bucket, block, keys, slots, extra). ``extra`` holds what the block itself
will need; such rows pass through a bucket as they are.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.text import ByteClass, Texts, give_back, join_hashes, small_batches
from readloom.session import Workspace

ROWS = "bucket int, block long, keys binary, slots binary, extra binary"
SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("slots", pa.binary()), ("extra", pa.binary())])
BLOCK_WINDOWS = 1 << 20
BUCKET_WINDOWS = 1 << 20
BITS = 48  # of a key; chance matches only make candidates that the next step drops


def extent(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """About how many windows there are, and how many buckets: so many that one
    gets about ``BUCKET_WINDOWS`` windows, and at least four for each partition."""
    windows = (docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0) // 6 + 1
    return windows, int(max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), windows // BUCKET_WINDOWS + 1))


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as arrays:
        return {k: arrays[k] for k in arrays.files}


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs."""
    width = (int(numbers.max(initial=1)).bit_length() + 7) // 8
    return bytes([width]) + numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_numbers(data: bytes) -> np.ndarray:
    width = memoryview(data)[0]
    out = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return out.view("<u8").reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return pack_numbers(np.diff(keys, prepend=np.uint64(0))[1:]) + keys[:1].astype("<u8").tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    if len(data) < 8:
        return np.zeros(0, np.uint64)
    view = memoryview(data)
    steps = np.concatenate([np.frombuffer(view[-8:], "<u8"), unpack_numbers(view[:-8])])
    return np.cumsum(steps, dtype=np.uint64)


def rows(bucket: list, block: list, keys: list, slots: list, extra: list) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip((bucket, block, keys, slots, extra), SCHEMA.types, strict=True)], schema=SCHEMA)


def dealt(n: int, block: int, keys: np.ndarray, slots: np.ndarray, extra: bytes, bits: int = BITS) -> pa.Table:
    """Rows of a block to send: ascending keys cut at the bounds of n buckets, and
    the block's own row. ``slots`` go with the keys."""
    bounds = np.array([(i << bits) // n for i in range(n + 1)], np.uint64)
    cuts = np.searchsorted(keys, bounds)
    cuts[-1] = len(keys)
    full = np.flatnonzero(np.diff(cuts)).tolist()
    parts = [(i, int(cuts[i]), int(cuts[i + 1])) for i in full]
    return rows(
        [i for i, _, _ in parts] + [block % n], [block] * (len(parts) + 1),
        [pack_keys(keys[a:b]) for _, a, b in parts] + [None], [pack_numbers(slots[a:b]) for _, a, b in parts] + [None],
        [None] * len(parts) + [extra],
    )


class Bucket:
    """The rows that one bucket got, keys end to end."""

    def __init__(self, group: pa.Table):
        give_back()  # what the group before took
        own = pa.compute.is_null(group.column("keys"))
        self.passing, group = group.filter(own), group.filter(pa.compute.invert(own))
        self.blocks = group.column("block").to_pylist()
        keys = [unpack_keys(x.as_buffer()) for x in group.column("keys")]
        self.sizes = [len(x) for x in keys]
        self.keys = np.concatenate([np.zeros(0, np.uint64), *keys]).astype(np.uint64)
        self.slots = np.concatenate([np.zeros(0, np.uint64), *[unpack_numbers(x.as_buffer()) for x in group.column("slots")]])
        self.order = np.argsort(self.keys)
        ordered = self.keys[self.order]
        fresh = np.ones(len(ordered), bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        self.group = np.cumsum(fresh) - 1  # number of the key, in order

    def answers(self, keep: np.ndarray, values: np.ndarray, bucket: int) -> pa.Table:
        """For each block the kept slots with a value (64 bits) each; and the passing rows."""
        out = [[], [], [], [], []]
        at = 0
        for block, size in zip(self.blocks, self.sizes, strict=True):
            chosen = np.flatnonzero(keep[at : at + size]) + at
            at += size
            if len(chosen):
                for column, value in zip(out, (bucket, block, pack_numbers(values[chosen]), pack_numbers(self.slots[chosen]), None), strict=True):
                    column.append(value)
        return pa.concat_tables([rows(*out), self.passing.cast(SCHEMA)])


def answered(group: pa.Table) -> tuple[np.ndarray, np.ndarray, list[dict]]:
    """What a block got: slots, their values, and the contents of its own rows."""
    give_back()  # what the group before took
    values, slots, extra = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], []
    for k, s, e in zip(group.column("keys"), group.column("slots"), group.column("extra"), strict=True):
        if e.is_valid:
            extra.append(unpack(e.as_py()))
        else:
            values.append(unpack_numbers(k.as_buffer()))
            slots.append(unpack_numbers(s.as_buffer()))
    return np.concatenate(slots), np.concatenate(values), extra


def blocks(docs: DataFrame, kind: ByteClass, send: Callable[..., pa.Table]) -> DataFrame:
    """Rows that ``send(block, doc_ids, checks, first_word, words)`` makes of each block of documents.

    ``docs`` has doc_id, text and check, a hash of the text that tells rows of
    equal doc_id apart. A block is named by its partition, its number there and
    what is in it: equal blocks have names of their own, a repeated task gives the
    same names, and one that read its rows in another order does not.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size, number, partition = 0, 0, TaskContext.get().partitionId()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            ids, checks, counts, words = (np.concatenate(x) for x in zip(*held, strict=True))
            first = np.concatenate([[0], np.cumsum(counts)])
            parts = [ids.view(np.uint64), checks.view(np.uint64)]
            held_here = [np.bitwise_xor.reduce(x * np.arange(1, 2 * len(x), 2, dtype=np.uint64)) for x in parts]
            name = np.array([partition], np.uint64)
            for x in (number, *held_here):
                name = join_hashes(name, np.array([x], np.uint64))
            block, number = int(name[0] >> np.uint64(2)), number + 1
            yield from send(block, ids, checks, first, words).to_batches()

        for batch in batches:
            texts = Texts(batch.column("text"))
            ids = pa.compute.fill_null(batch.column("doc_id"), NO_ID).to_numpy(zero_copy_only=False)
            checks = batch.column("check").to_numpy(zero_copy_only=False)
            for a, b in texts.blocks():
                data, offsets = texts.part(a, b)
                starts, ends, first = kind.words(data, offsets)
                words = kind.hashes(data, starts, ends)
                counts = np.diff(first)
                # Cut where the block is full.
                at = 0
                while at < b - a:
                    room = max(BLOCK_WINDOWS - size, 1)
                    to = max(int(np.searchsorted(first, first[at] + room, "right")) - 1, at + (size == 0))
                    if to > at:
                        held.append((ids[a + at : a + to], checks[a + at : a + to], counts[at:to], words[first[at] : first[to]]))
                        size += int(first[to] - first[at])
                        at = to
                    if at < b - a or size >= BLOCK_WINDOWS:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()
        held.clear()
        give_back()

    return docs.mapInArrow(run, ROWS)


NO_ID = -(2**63)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and check; null texts are empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("check", F.xxhash64("text"))


def settled(docs: DataFrame, work: Workspace) -> DataFrame:
    """Rows that a repeated task reads in the same order. Files are read so; what
    comes out of a shuffle may not be, and is stored first."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return work.keep("settled", docs) if "Exchange" in plan else docs


def drop(work: Workspace, name: str) -> None:
    """Remove a stored step that nothing will read any more."""
    path = work.spark._jvm.org.apache.hadoop.fs.Path(work.path(name))
    path.getFileSystem(work.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark) -> None:
    """Ask the JVM to notice frames that are no longer used, so that Spark removes
    the shuffle files of finished steps."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
