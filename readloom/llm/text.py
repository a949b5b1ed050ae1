"""Whole texts as flat arrays inside Arrow tasks, and rows that keep their own columns.

Texts are worked on as the UTF-8 bytes of many documents end to end, with the
documents' offsets. Blocks are bounded by bytes; only a single document larger
than that makes a larger block, and its cost stays in proportion to its length.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BLOCK_BYTES = 4 << 20
ROWS_A_BATCH = 1000
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def process_cache(key: str, make: Callable[[], object]) -> object:
    """A value kept by the Python worker process from one task to the next, such
    as a loaded tokenizer or a bounded table of words already encoded."""
    holder = sys.modules.setdefault("readloom_worker_cache", types.ModuleType("readloom_worker_cache"))
    if key not in vars(holder):
        vars(holder)[key] = make()
    return vars(holder)[key]


def small_batches(spark: SparkSession) -> None:
    """Fewer rows in each Arrow batch, as texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_A_BATCH)


def give_back() -> None:
    """Return memory that is free to the system. Worker processes live on and hold
    it while other steps run beside them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Texts:
    """Texts end to end: ``data`` bytes, ``offsets`` of n + 1 boundaries. A null text is empty."""

    def __init__(self, column: pa.Array):
        column = pa.compute.fill_null(column, "").cast(pa.large_string())
        if column.offset:
            column = pa.concat_arrays([column, column.slice(0, 0)])
        _, offsets, data = column.buffers()
        self.offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
        first, last = int(self.offsets[0]), int(self.offsets[-1])
        self.data = np.frombuffer(data, np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
        self.offsets = self.offsets - first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def blocks(self, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
        """Ranges of documents, each of at most ``size`` bytes or one document."""
        first = 0
        while first < len(self):
            last = int(np.searchsorted(self.offsets, self.offsets[first] + size, "right")) - 1
            last = min(max(last, first + 1), len(self))
            yield first, last
            first = last

    def part(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of a range of documents."""
        offsets = self.offsets[first : last + 1] - self.offsets[first]
        base = int(self.offsets[first])
        return self.data[base : base + int(offsets[-1])], offsets


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, in place."""
    x ^= x >> np.uint64(32)
    x *= K2
    x ^= x >> np.uint64(29)
    return x


def join_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hashes of its two parts, in order."""
    return mix(a * K1 + b)


class ByteClass:
    """Words as runs of member bytes; ``fold`` lower-cases A-Z before hashing."""

    def __init__(self, member: np.ndarray, fold: bool):
        lower = np.arange(256, dtype=np.uint8)
        if fold:
            lower[65:91] += 32
        values = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
        self.member, self.lower = member, lower
        self.values = np.where(member, values[lower], np.uint64(0))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all words, and each document's first word (n + 1 values)."""
        inside = self.member[data]
        cut = offsets[:-1][offsets[:-1] < offsets[1:]]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[cut] = False
        after[cut[1:] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, offsets)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of every word: a polynomial of its bytes, spread."""
        out = np.zeros(len(starts), np.uint64)
        step = 1 << 16
        for at in range(0, len(starts), step):
            s, e = starts[at : at + step], ends[at : at + step]
            low, high = int(s[0]), int(e[-1])
            up, down = powers(high - low)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(self.values[data[low:high]] * up[: high - low], out=sums[1:])
            out[at : at + step] = (sums[e - low] - sums[s - low]) * down[s - low] + (e - s).astype(np.uint64)
        return mix(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers, modulo 2^64, of K1 and of its inverse."""
    table = process_cache("powers", dict)
    if len(table.get("up", ())) < n:
        size = 1 << max(n - 1, 1).bit_length()
        for name, base in (("up", int(K1)), ("down", pow(int(K1), -1, 1 << 64))):
            table[name] = np.full(size, base, np.uint64)
            table[name][0] = 1
            np.cumprod(table[name], out=table[name])
    return table["up"], table["down"]


def white_space() -> ByteClass:
    """Words [^\\x20\\x09-\\x0D]+."""
    member = np.ones(256, bool)
    member[[32, 9, 10, 11, 12, 13]] = False
    return ByteClass(member, False)


def folded(kind: ByteClass) -> ByteClass:
    return ByteClass(kind.member, True)


def alphanumeric() -> ByteClass:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z: every byte
    of a character past ASCII belongs to a word."""
    member = np.zeros(256, bool)
    member[48:58] = member[65:91] = member[97:123] = member[128:] = True
    return ByteClass(member, True)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` words by doubling, documents ignored."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    done, out, level, size = 0, None, words, 1
    while True:
        if width & size:
            part = level[done : done + len(words) - width + 1]
            out = part.copy() if out is None else join_hashes(out, part)
            done += size
        if size * 2 > width:
            return out
        level = join_hashes(level[: len(level) - size], level[size:])
        size *= 2


def windows_inside(first_word: np.ndarray, width: int) -> np.ndarray:
    """For each word, whether a window of ``width`` words starting there stays in its document."""
    room = np.repeat(first_word[1:], np.diff(first_word)) - np.arange(first_word[0], first_word[-1])
    return room >= width


def append(
    docs: DataFrame,
    kernel: Callable[[Texts], list[pa.Array]],
    schema: str,
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Columns that ``kernel`` makes from the texts of a batch, beside ``row``, a
    struct of the columns to keep, so that no name can clash."""
    small_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    source = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text")
    )
    added = T._parse_datatype_string(schema)
    out = T.StructType([source.schema["row"], *added.fields])
    arrow = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            at, total = 0, np.cumsum(sizes)
            while at < len(sizes):
                to = int(np.searchsorted(total, (total[at - 1] if at else 0) + 2 * BLOCK_BYTES, "right"))
                to = min(max(to, at + 1), len(sizes))
                part = batch.slice(at, to - at)
                columns = kernel(Texts(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), *(c.cast(f.type) for c, f in zip(columns, arrow, strict=True))],
                    names=["row", *arrow.names],
                )
                at = to
        give_back()

    return source.mapInArrow(run, out)


def ragged(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list column from flat values and the number of values of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
