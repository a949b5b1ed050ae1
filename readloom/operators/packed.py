"""K-mers of stored reads counted, indexed and joined without a row for each.

A task takes the k-mers of a block of reads, about eight million, sorts them by a
mixed value and sends each stretch of the value range, as one row of packed
differences with their places, to the bucket of that stretch: some four bytes a
k-mer, where a row of its own takes some forty. Their number decides how many
buckets there are, so a bucket is of the same size whatever the input. A k-mer
that one block has more often than the cutoff is sent once, without places, so
a bucket gets at most cutoff places of it for each block.

For seeds, k-mers next to each other go on as one stretch of bases, two bits each,
where their buckets agree: a k-mer's bucket there follows from the least of the few
shorter words in it, in either strand. Queries are read off the same stretches, so
they are not sent. K-mers that are hot, or too frequent in a block, go one by one.

Seeds that are wanted by query go on packed as well, to buckets of queries: a
row of them is sorted by target, whose id and size it names once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.arrow import run_starts
from readloom.functions.sequence import BASES
from readloom.operators.kmers import HOT_KMERS, HOT_SAMPLE, SHARE_HITS
from readloom.session import spread

BLOCK = 8_000_000  # bases whose k-mers are sorted at once
BUCKET = 12_000_000  # k-mers that meet in one bucket
GATHER = 4_000_000  # bases of the queries whose seeds are gathered in one bucket
PACK = 6_000_000  # meetings of a query and a target k-mer that are looked at and packed at once; about half are seeds
STEP = 500_000  # rows given out at once
ORDERED = 6_000_000  # k-mers that are sorted in one range
SAMPLED = 200  # k-mers looked at for where a range ends
SPAN = 5  # words of a k-mer that its bucket is chosen by; more make longer stretches and less even buckets
ODD = 0x9E3779B97F4A7C15  # spreads k-mers over the value range, and can be undone
OTHER = 0xC2B2AE3D27D4EB4F  # spreads least words over buckets

ROWS = "bucket int, volume_id long, data binary"
SCHEMA = pa.schema([("bucket", pa.int32()), ("volume_id", pa.int64()), ("data", pa.binary())])
_CODE = np.zeros(256, np.uint8)
for _i, _base in enumerate(BASES):
    _CODE[[ord(_base), ord(_base.lower())]] = _i
_LETTER = np.frombuffer(BASES.encode(), np.uint8)


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers from 0, byte by byte in as few bytes as the largest needs, compressed."""
    heads, bodies = [], []
    for a in arrays:
        width = max((int(a.max(initial=0)).bit_length() + 7) // 8, 1)
        heads += [len(a), width]
        bodies += [(a >> a.dtype.type(8 * i) if i else a).astype(np.uint8).tobytes() for i in range(width)]
    raw = np.array([len(heads), *heads], "<i8").tobytes() + b"".join(bodies)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), codec="zstd")
    raw = np.frombuffer(raw, np.uint8)
    heads = raw[8 : 8 + 8 * int(raw[:8].view("<i8")[0])].view("<i8").reshape(-1, 2).tolist()
    at, out = 8 + 16 * len(heads), []
    for n, width in heads:
        kind = np.uint64 if width > 4 else np.uint32
        whole = raw[at : at + n].astype(kind)
        for i in range(1, width):
            whole |= raw[at + i * n : at + (i + 1) * n].astype(kind) << kind(8 * i)
        out.append(whole)
        at += n * width
    return out


def steps(values: np.ndarray) -> np.ndarray:
    """Ascending numbers as differences."""
    return np.diff(values, prepend=values.dtype.type(0))


def summed(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=np.uint64)


def jumps(values: np.ndarray) -> np.ndarray:
    """Whole numbers in any order as differences from 0."""
    d = np.diff(values.astype(np.int64), prepend=0)
    return d << 1 ^ d >> 63


def landed(differences: np.ndarray) -> np.ndarray:
    d = differences.astype(np.uint64)
    return np.cumsum((d >> np.uint64(1)).astype(np.int64) ^ -(d & np.uint64(1)).astype(np.int64))


_FOUR = _LETTER[(np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3]  # the letters of a byte


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column without nulls."""
    whole = column.cast(pa.large_binary())
    whole = pa.concat_arrays([whole, whole.slice(0, 0)]) if whole.offset else whole
    _, offsets, data = whole.buffers()
    return np.frombuffer(offsets, np.int64, len(whole) + 1), np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _quarters(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where texts of these sizes begin at four bases a byte, and the place of each base among four of each byte."""
    ends = np.concatenate([[0], np.cumsum((sizes + 3) // 4)])
    first = np.cumsum(sizes) - sizes
    return ends, np.arange(int(sizes.sum())) + np.repeat(4 * ends[:-1] - first, sizes)


def quartered(df: DataFrame, keep: list[str]) -> DataFrame:
    """``seq``, of the letters A, C, G and T, as ``bases``, four a byte, and its length ``len``; null stays null."""
    kept = df.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq = batch.column("seq")
            offsets, data = text_bytes(seq.fill_null(""))
            sizes = np.diff(offsets)
            ends, places = _quarters(sizes)
            codes = np.zeros(4 * int(ends[-1]), np.uint8)
            codes[places] = _CODE[data[offsets[0] : offsets[-1]]]
            four = codes.reshape(-1, 4)
            whole = four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]
            none = seq.is_null().to_numpy(zero_copy_only=False)
            bases = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(seq), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(whole)])
            columns = [*[batch.column(c) for c in keep], bases.cast(pa.binary()), pa.array(sizes, pa.int32(), mask=none)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "bases", "len"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return df.select(*keep, "seq").mapInArrow(run, f"{fields}, bases binary, len int")


def spelled(df: DataFrame) -> DataFrame:
    """``seq`` again, in place of ``bases``."""
    keep = [c for c in df.columns if c != "bases"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column("bases"))
            none = batch.column("len").is_null().to_numpy(zero_copy_only=False)
            sizes = batch.column("len").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            places = _quarters(sizes)[1]
            letters = _FOUR[data[offsets[0] : offsets[-1]]].reshape(-1)[places]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            seq = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(letters)).cast(pa.string())
            if none.any():
                seq = pa.compute.if_else(pa.array(none), pa.scalar(None, pa.string()), seq)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], seq], names=[*keep, "seq"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != "bases")
    return df.mapInArrow(run, f"{fields}, seq string")


@dataclass(frozen=True)
class Code:
    """K-mers as numbers: two bits a base, and the mixed value they are dealt by."""

    k: int

    def __post_init__(self):
        if not 0 < self.k <= 31:
            raise ValueError("packed k-mers have 1 to 31 bases")

    @property
    def mask(self) -> int:
        return (1 << 2 * self.k) - 1

    def plain(self, codes: np.ndarray) -> np.ndarray:
        """The number of the k-mer at each place of an array of base codes."""
        kind = np.uint32 if self.k <= 16 else np.uint64
        n = max(len(codes) - self.k + 1, 0)
        out = np.zeros(n, kind)
        for i in range(self.k):
            out = (out << kind(2)) | codes[i : i + n]
        return out

    def reverse(self, plain: np.ndarray) -> np.ndarray:
        """The number of the reverse complement."""
        kind = plain.dtype.type
        out, rest = np.zeros_like(plain), plain.copy()
        for _ in range(self.k):
            out = (out << kind(2)) | (kind(3) - (rest & kind(3)))
            rest >>= kind(2)
        return out

    def mixed(self, plain: np.ndarray) -> np.ndarray:
        return (plain.astype(np.uint64) * np.uint64(ODD)) & np.uint64(self.mask)

    def unmixed(self, mixed: np.ndarray) -> np.ndarray:
        return (mixed * np.uint64(pow(ODD, -1, 1 << 64))) & np.uint64(self.mask)

    def least(self, codes: np.ndarray) -> np.ndarray:
        """For the k-mer at each place the least mixed word of it in either strand; the reverse complement has the same."""
        short = Code(max(self.k - SPAN + 1, 1))
        words = short.plain(codes)
        words = np.minimum(short.mixed(words), short.mixed(short.reverse(words)))
        n = max(len(codes) - self.k + 1, 0)
        out = words[:n].copy()
        for i in range(1, self.k - short.k + 1):
            np.minimum(out, words[i : i + n], out=out)
        return out

    def texts(self, mixed: np.ndarray) -> pa.Array:
        return self.spelled(self.unmixed(mixed))

    def spelled(self, plain: np.ndarray) -> pa.Array:
        rest = plain.astype(np.uint64)
        letters = np.empty((len(rest), self.k), np.uint8)
        for i in reversed(range(self.k)):
            letters[:, i] = _LETTER[(rest & np.uint64(3)).astype(np.uint8)]
            rest >>= np.uint64(2)
        offsets = np.arange(0, self.k * (len(rest) + 1), self.k, dtype=np.int32)
        return pa.StringArray.from_buffers(len(rest), pa.py_buffer(offsets), pa.py_buffer(letters.reshape(-1)))

    def order(self, mixed: np.ndarray) -> np.ndarray:
        """Sorted places of the values; equal ones in the order they come in."""
        n = len(mixed)
        bits = max(n - 1, 1).bit_length()
        if 2 * self.k + bits > 64:
            return np.argsort(mixed, kind="stable")
        both = (mixed << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
        both.sort()
        return (both & np.uint64((1 << bits) - 1)).astype(np.int64)


@dataclass
class Block:
    """Some reads of one volume end to end."""

    volume: int
    ids: np.ndarray
    starts: np.ndarray  # of the reads in the volume
    sizes: np.ndarray
    codes: np.ndarray

    def places(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the k-mers lie: index in the block, number of the read, place in it."""
        n = max(len(self.codes) - k + 1, 0)
        owner = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)[:n]
        first = (np.cumsum(self.sizes) - self.sizes).astype(np.int64)
        pos = (np.arange(n, dtype=np.int64) - first[owner]).astype(np.int32)
        fits = np.flatnonzero(pos <= self.sizes[owner] - k)
        return fits, owner[fits], pos[fits]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Reads of a partition, in the order they come in, in blocks of about BLOCK bases."""
    held: list[tuple] = []
    size = 0

    def joined() -> Block:
        volume, ids, starts, sizes, codes = zip(*held, strict=True)
        return Block(volume[0], *(np.concatenate(x) for x in (ids, starts, sizes, codes)))

    for batch in batches:
        text = batch.column("seq").cast(pa.large_string()).fill_null("")
        text = pa.concat_arrays([text, text.slice(0, 0)]) if text.offset else text
        _, offsets, data = text.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(text) + 1)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        ids, starts, volume = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("read_id", "sref", "volume_id"))
        at = 0
        while at < len(text):
            if held and (size >= BLOCK or held[0][0] != volume[at]):
                yield joined()
                held, size = [], 0
            full = int(np.searchsorted(offsets, offsets[at] + BLOCK - size, "left"))
            other = np.flatnonzero(volume[at:] != volume[at])
            to = min(max(full, at + 1), len(text), at + int(other[0]) if len(other) else len(text))
            part = _CODE[data[offsets[at] : offsets[to]]]
            held.append((volume[at], ids[at:to], starts[at:to], np.diff(offsets[at : to + 1]).astype(np.int32), part))
            size += len(part)
            at = to
    if held:
        yield joined()


def _placed(reads: DataFrame) -> DataFrame:
    extra = [F.col(c) if c in reads.columns else F.lit(0).cast("long").alias(c) for c in ("volume_id", "sref")]
    return reads.select("read_id", "seq", *extra)


def _buckets(reads: DataFrame, bases: int | None = None, each: int = 1) -> int:
    """So many that each gets about ``bases`` (BUCKET) k-mers, and ``each`` for each task at least."""
    spark = reads.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(each * least, (reads.agg(F.sum("len")).first()[0] or 0) // (bases or BUCKET) + 1)


def _bounds(n: int, k: int) -> np.ndarray:
    return np.array([((i << 2 * k) + n - 1) // n for i in range(n)], np.uint64)


def _cuts(ordered: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.append(np.searchsorted(ordered, bounds), len(ordered))


def _batch(bucket: list, volume: list, data: list) -> pa.RecordBatch:
    columns = [pa.array(x, t) for x, t in zip((bucket, volume, data), SCHEMA.types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=SCHEMA)


def kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    """How often each k-mer occurs. Needs seq and len."""
    code, n = Code(k), _buckets(reads)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _bounds(n, k)
        for block in blocks(batches):
            ordered = code.mixed(code.plain(block.codes)[block.places(k)[0]])
            ordered.sort()
            first = run_starts(ordered)
            counts, values = np.diff(np.append(first, len(ordered))), ordered[first]
            cuts = _cuts(values, bounds)
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                own = slice(cuts[i], cuts[i + 1])
                yield _batch([i], [0], [pack(steps(values[own]), counts[own])])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(x.as_buffer()) for batch in batches for x in batch.column("data")]
        values = np.concatenate([summed(p[0]) for p in parts])
        counts = np.concatenate([p[1] for p in parts]).astype(np.int64)
        order = code.order(values)
        ordered = values[order]
        first = run_starts(ordered)
        totals = np.add.reduceat(counts[order], first)
        for at in range(0, len(first), STEP):
            some = slice(at, at + STEP)
            yield pa.RecordBatch.from_arrays([code.texts(ordered[first[some]]), pa.array(totals[some])], names=["kmer", "n"])

    rows = _placed(reads.withColumn("read_id", F.lit(0).cast("long")).select("read_id", "seq")).mapInArrow(send, ROWS)
    return spread(rows, "bucket").groupBy("bucket").applyInArrow(add, "kmer string, n long")


def _hot(reads: DataFrame, code: Code, stride: int) -> dict[int, int]:
    """The queries' most frequent k-mers and into how many shares of about
    SHARE_HITS * HOT_SAMPLE each goes, by a fixed sample: at most HOT_KMERS."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            values, owner, off, _ = _queries(block, code, stride)
            at = (block.ids[owner].astype(np.uint64) * np.uint64(0x100000001B3) + off.astype(np.uint64)) * np.uint64(ODD)
            picked = values[(at >> np.uint64(40)) % np.uint64(HOT_SAMPLE) == 0]
            yield pa.RecordBatch.from_arrays([pa.array(picked.astype(np.int64))], names=["value"])

    counts = _placed(reads).mapInArrow(sample, "value long").groupBy("value").agg(F.count("*").alias("hits"))
    top = counts.where(F.col("hits") > SHARE_HITS).orderBy(F.desc("hits"), "value").limit(HOT_KMERS).collect()
    return {r["value"]: -(-r["hits"] // SHARE_HITS) for r in top}


def _queries(block: Block, code: Code, stride: int, plain: np.ndarray | None = None, placed: tuple | None = None) -> tuple:
    """Sampled k-mers of both strands: value, number of the read, 2 * place on the strand + strand,
    2 * index in the block + strand."""
    at, owner, pos = placed or block.places(code.k)
    plain = code.plain(block.codes) if plain is None else plain
    back = block.sizes[owner] - code.k - pos
    fwd, rev = np.flatnonzero(pos % stride == 0), np.flatnonzero(back % stride == 0)
    values = np.concatenate([code.mixed(plain[at[fwd]]), code.mixed(code.reverse(plain[at[rev]]))])
    off = np.concatenate([2 * pos[fwd].astype(np.int64), 2 * back[rev].astype(np.int64) + 1])
    return values, np.concatenate([owner[fwd], owner[rev]]), off, np.concatenate([2 * at[fwd], 2 * at[rev] + 1])


class Targets:
    """What one bucket knows of the target k-mers of one volume, after the cutoff."""

    def __init__(self, code: Code, rows: list[list[np.ndarray]], bases: list[int], max_count: int):
        values = np.concatenate([r[0] for r in rows])
        owner = np.concatenate([r[1] + base for r, base in zip(rows, bases, strict=True)])
        pos = np.concatenate([r[2] for r in rows])
        order = code.order(values)
        values = values[order]
        first = run_starts(values)
        sizes = np.diff(np.append(first, len(values)))
        kept = (sizes <= max_count) & ~np.isin(values[first], np.concatenate([r[3] for r in rows]))
        self.values, self.first, self.sizes = values[first][kept], first[kept], sizes[kept]
        self.owner, self.pos = owner[order], pos[order]


def _spread_runs(first: np.ndarray, sizes: np.ndarray, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members of many runs, about ``step`` at once: number of the run, index of the member."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = int(ends[at] - sizes[at])
        to = max(int(np.searchsorted(ends, done + step, "right")), at + 1)
        run = np.repeat(np.arange(at, to), sizes[at:to])
        yield run, first[run] + np.arange(len(run)) - (ends[run] - sizes[run] - done)
        at = to


NONE = np.zeros(0, np.uint64)


def _row(block: Block, bucket: int, *arrays: np.ndarray) -> pa.RecordBatch:
    """What a block sends to a bucket: target values, their places, values beyond the cutoff, query values, their places with
    the strand, and any stretches; with the block's reads."""
    starts = block.starts - np.cumsum(block.sizes, dtype=np.int64) + block.sizes
    table = [jumps(block.ids - block.ids[0]), jumps(starts - starts[0]), block.sizes, jumps(np.array([block.ids[0], starts[0]]))]
    values, at, dead, q, q_at, *stretches = arrays
    return _batch([bucket], [int(block.volume)], [pack(steps(values), at, steps(dead), steps(q), q_at, *table, *stretches)])


def _dealt(reads: DataFrame, code: Code, n: int, max_count: int) -> DataFrame:
    """Rows of all blocks: target k-mers with their places and those beyond the cutoff, dealt by value."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _bounds(n, code.k)
        for block in blocks(batches):
            fits = block.places(code.k)[0]
            values = code.mixed(code.plain(block.codes)[fits])
            order = code.order(values)
            values, at = values[order], fits[order]
            first = run_starts(values)
            sizes = np.diff(np.append(first, len(values)))
            dead = values[first[sizes > max_count]]
            few = np.repeat(sizes <= max_count, sizes)
            values, at = values[few], at[few]
            t_cuts, d_cuts = (_cuts(x, bounds) for x in (values, dead))
            for i in np.flatnonzero(np.diff(t_cuts) + np.diff(d_cuts)).tolist():
                t, d = slice(t_cuts[i], t_cuts[i + 1]), slice(d_cuts[i], d_cuts[i + 1])
                yield _row(block, i, values[t], at[t], dead[d], NONE, NONE)

    return _placed(reads).mapInArrow(send, ROWS)


def _stretches(block: Block, k: int, at: np.ndarray, bucket: np.ndarray) -> dict[int, list[np.ndarray]]:
    """The k-mers at these places, for each bucket as stretches: where they begin, as steps, how many k-mers each has, and
    their bases end to end, four a byte."""
    first = run_starts(bucket, at - np.arange(len(at)))
    counts = np.diff(np.append(first, len(at)))
    begin, to = at[first], bucket[first]
    order = np.argsort(to, kind="stable")
    cuts = np.append(run_starts(to[order]), len(order))
    out = {}
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = order[lo:hi]
        sizes = counts[own] + k - 1
        places = np.arange(int(sizes.sum())) + np.repeat(begin[own] - np.cumsum(sizes) + sizes, sizes)
        bases = np.zeros(-(-len(places) // 4) * 4, np.uint8)
        bases[: len(places)] = block.codes[places]
        four = bases.reshape(-1, 4)
        whole = four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]
        out[int(to[own[0]])] = [steps(begin[own]), counts[own], whole]
    return out


def _stretched(begin: np.ndarray, counts: np.ndarray, whole: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """The k-mers of stretches again: places and plain values."""
    counts = counts.astype(np.int64)
    sizes = counts + code.k - 1
    bases = ((whole.astype(np.uint8)[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & np.uint8(3)).reshape(-1)
    inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    plain = code.plain(bases[: int(sizes.sum())])[np.repeat(np.cumsum(sizes) - sizes, counts) + inside]
    return np.repeat(summed(begin).astype(np.int64), counts) + inside, plain


def _met(reads: DataFrame, code: Code, n: int, max_count: int, stride: int, hot: dict[int, int]) -> DataFrame:
    """Rows of all blocks: target k-mers with their places and those beyond the cutoff, and queries, dealt by least word."""
    listed = np.array(sorted(hot), np.uint64)
    shares = np.array([hot[int(x)] for x in listed], np.int64)
    extra = n + np.cumsum(shares) - shares  # the first bucket of each hot k-mer

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            fits, owner, pos = block.places(code.k)
            if not len(fits):
                continue
            plain = code.plain(block.codes)[fits]
            values = code.mixed(plain)
            bucket = ((code.least(block.codes)[fits] + np.uint64(1)) * np.uint64(OTHER) >> np.uint64(32)) % np.uint64(n)
            bucket = bucket.astype(np.int32)
            ordered = np.sort(values)
            first = run_starts(ordered)
            dead = ordered[first[np.diff(np.append(first, len(ordered))) > max_count]]
            del ordered, first
            beyond = np.isin(values, dead)
            single = beyond.copy()
            if len(listed):
                single |= np.isin(values, listed) | np.isin(code.mixed(code.reverse(plain)), listed)
            together = np.flatnonzero(~single)
            stretches = _stretches(block, code.k, fits[together], bucket[together])
            del together
            one = np.flatnonzero(single)
            back = block.sizes[owner[one]] - code.k - pos[one]
            fwd, rev = one[pos[one] % stride == 0], one[back % stride == 0]
            few = one[~beyond[one]]
            far = np.flatnonzero(beyond)
            far = far[np.unique(values[far], return_index=True)[1]]
            # Values, what goes with them, and their buckets, by bucket and value; hot ones have none.
            q = np.concatenate([values[fwd], code.mixed(code.reverse(plain[rev]))])
            q_at = np.concatenate([2 * fits[fwd], 2 * fits[rev] + 1])
            share = np.concatenate([block.ids[owner[fwd]] + 2 * pos[fwd].astype(np.int64), block.ids[owner[rev]] + 2 * back[back % stride == 0].astype(np.int64) + 1])
            kinds = [(values[few], fits[few], bucket[few]), (values[far], NONE, bucket[far]), (q, q_at, np.concatenate([bucket[fwd], bucket[rev]]))]
            sorted_, cuts = [], []
            for value, with_, to in kinds:
                to = np.where(np.isin(value, listed), n, to)
                order = np.lexsort((value, to))
                if value is q:
                    share = share[order]
                sorted_.append((value[order], with_[order] if len(with_) else with_))
                cuts.append(np.searchsorted(to[order], np.arange(n + 2)))
            (t_values, t_at), (d_values, _), (q_values, q_at) = sorted_
            full = np.flatnonzero(sum(np.diff(c[: n + 1]) for c in cuts)).tolist()
            for i in sorted({*full, *stretches}):
                t, d, a = (slice(c[i], c[i + 1]) for c in cuts)
                yield _row(block, i, t_values[t], t_at[t], d_values[d], q_values[a], q_at[a], *stretches.get(i, []))
            for value, number, to in zip(listed, shares.tolist(), extra.tolist(), strict=True):
                t, d, a = (slice(*(np.searchsorted(x[c[n] :], [value, value + np.uint64(1)]) + c[n])) for x, c in zip((t_values, d_values, q_values), cuts, strict=True))
                for i in range(number):
                    mine = np.flatnonzero(share[a] % number == i) + a.start
                    if t.stop > t.start or d.stop > d.start or len(mine):
                        yield _row(block, to + i, t_values[t], t_at[t], d_values[d], q_values[mine], q_at[mine])

    return _placed(reads).mapInArrow(send, ROWS)


def _received(code: Code, batches: Iterator[pa.RecordBatch], stride: int = 1) -> tuple:
    """A bucket's rows by volume, and its reads: ids, starts in their volume, sizes.

    A row: target values, their reads and places; values beyond the cutoff; query values, their reads and 2 * place on the
    strand + strand. Queries within stretches are every ``stride`` places of both strands.
    """
    by_volume: dict[int, tuple[list, list]] = {}
    ids, starts, sizes = [], [], []
    base = 0
    for batch in batches:
        for volume, data in zip(batch.column("volume_id").to_pylist(), batch.column("data"), strict=True):
            values, at, dead, q, q_at, id_jumps, start_jumps, size, origin, *stretches = unpack(data.as_buffer())
            at, q_at, size = (x.astype(np.int64) for x in (at, q_at, size))
            first = np.cumsum(size) - size
            q_owner = np.searchsorted(first, q_at >> 1, "right") - 1
            strand, pos = q_at & 1, (q_at >> 1) - first[q_owner]
            off = 2 * np.where(strand == 1, size[q_owner] - code.k - pos, pos) + strand
            values, q = summed(values), summed(q)
            owner = np.searchsorted(first, at, "right") - 1
            pos = at - first[owner]
            if stretches:
                there, plain = _stretched(*stretches, code)
                reading = np.searchsorted(first, there, "right") - 1
                inside = there - first[reading]
                back = size[reading] - code.k - inside
                fwd, rev = np.flatnonzero(inside % stride == 0), np.flatnonzero(back % stride == 0)
                mixed = code.mixed(plain)
                q = np.concatenate([q, mixed[fwd], code.mixed(code.reverse(plain[rev]))])
                q_owner = np.concatenate([q_owner, reading[fwd], reading[rev]])
                off = np.concatenate([off, 2 * inside[fwd], 2 * back[rev] + 1])
                values, owner, pos = (np.concatenate(x) for x in ((values, mixed), (owner, reading), (pos, inside)))
            rows, bases = by_volume.setdefault(volume, ([], []))
            rows.append([values, owner.astype(np.int32), pos.astype(np.int32), summed(dead), q, q_owner.astype(np.int32), off])
            bases.append(base)
            origin = landed(origin)
            ids.append(landed(id_jumps) + origin[0])
            starts.append(landed(start_jumps) + origin[1] + first)
            sizes.append(size.astype(np.int32))
            base += len(size)
    return by_volume, *(np.concatenate(x) for x in (ids, starts, sizes))


def kmer_index(reads: DataFrame, k: int, max_count: int) -> DataFrame:
    """Places of the k-mers that occur at most ``max_count`` times, per volume where reads have one.

    Needs read_id, seq and len.
    """
    code, n = Code(k), _buckets(reads)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_volume, ids, _, _ = _received(code, batches)
        for rows, bases in by_volume.values():
            kept = Targets(code, rows, bases, max_count)
            for run, at in _spread_runs(kept.first, kept.sizes):
                found = code.texts(kept.values[run]), pa.array(ids[kept.owner[at]]), pa.array(kept.pos[at])
                yield pa.RecordBatch.from_arrays(list(found), names=["kmer", "sid", "soff"])

    rows = _dealt(reads, code, n, max_count)
    return spread(rows, "bucket").groupBy("bucket").applyInArrow(keep, "kmer string, sid long, soff int")


def _ranges(values: np.ndarray, ids: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    """How many of the sorted (k-mer, read) cuts lie at or before each row; ``values`` are sorted."""
    known, reads = (np.array(x, t) for x, t in zip(zip(*cuts), (np.uint64, np.int64))) if cuts else (NONE, np.zeros(0, np.int64))
    out = np.searchsorted(known, values, "left").astype(np.int32)
    for at in run_starts(known).tolist():
        to = int(np.searchsorted(known, known[at], "right"))
        own = slice(*np.searchsorted(values, [known[at], known[at] + np.uint64(1)]))
        out[own] += np.searchsorted(reads[at:to], ids[own], "right").astype(np.int32)
    return out


def kmers_in_order(reads: DataFrame, k: int) -> DataFrame:
    """All k-mers with their read and place, sorted by these three over all partitions.

    K-mers go packed to ranges of (k-mer, read), one a task, of about ORDERED k-mers each as a sample of some
    SAMPLED a range says; a k-mer that fills many ranges is cut between reads. Needs read_id, seq and len.
    """
    code, n = Code(k), _buckets(reads, ORDERED)
    rate = max((reads.agg(F.sum("len")).first()[0] or 0) // (n * SAMPLED), 1)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            fits, owner, pos = block.places(k)
            at = (block.ids[owner].astype(np.uint64) * np.uint64(0x100000001B3) + pos.astype(np.uint64)) * np.uint64(ODD)
            some = np.flatnonzero((at >> np.uint64(40)) % np.uint64(rate) == 0)
            values = code.plain(block.codes)[fits[some]].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(block.ids[owner[some]])], names=["value", "read_id"])

    seen = sorted((r["value"], r["read_id"]) for r in _placed(reads).mapInArrow(sample, "value long, read_id long").collect())
    cuts = [seen[len(seen) * i // n] for i in range(1, n)] if seen else []

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            fits, owner, _ = block.places(k)
            plain = code.plain(block.codes)[fits].astype(np.uint64)
            order = code.order(plain)
            values, at = plain[order], fits[order]
            to = _ranges(values, block.ids[owner[order]], cuts)
            if (np.diff(to) < 0).any():
                order = np.argsort(to, kind="stable")
                values, at, to = values[order], at[order], to[order]
            ends = np.searchsorted(to, np.arange(n + 1))
            for i in np.flatnonzero(np.diff(ends)).tolist():
                own = slice(ends[i], ends[i + 1])
                yield _row(block, i, values[own], at[own], NONE, NONE, NONE)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        by_volume, ids, _, _ = _received(code, batches)
        parts = [(r, base) for rows, bases in by_volume.values() for r, base in zip(rows, bases, strict=True)]
        values = np.concatenate([r[0] for r, _ in parts])
        owner = np.concatenate([r[1] + base for r, base in parts])
        pos = np.concatenate([r[2] for r, _ in parts])
        known, rank = np.unique(ids, return_inverse=True)
        bits = len(known).bit_length()
        if 2 * k + bits <= 64:  # k-mers of a read come in the order of their places
            order = np.argsort(values << np.uint64(bits) | rank[owner].astype(np.uint64), kind="stable")
        else:
            order = np.lexsort((rank[owner], values))
        for at in range(0, len(order), STEP):
            some = order[at : at + STEP]
            columns = [code.spelled(values[some]), pa.array(ids[owner[some]]), pa.array(pos[some])]
            yield pa.RecordBatch.from_arrays(columns, names=["kmer", "read_id", "pos"])

    dealt = _placed(reads).mapInArrow(send, ROWS).repartitionById(n, F.col("bucket"))
    return dealt.mapInArrow(merge, "kmer string, read_id long, pos int")


SEEDS = "qid long, qsize int, qdir int, qoff int, sid long, ssize int, volume_id long, sref long, soff int"
SEED_SCHEMA = pa.schema([(n, pa.int64() if t == "long" else pa.int32()) for n, t in (f.split() for f in SEEDS.split(", "))])


def _meetings(code: Code, batches: Iterator[pa.RecordBatch], max_count: int, stride: int, step: int) -> Iterator[dict[str, np.ndarray]]:
    """A bucket's seeds, about ``step`` at once, each of one volume."""
    by_volume, ids, starts, sizes = _received(code, batches, stride)
    parts = [(r, base) for rows, bases in by_volume.values() for r, base in zip(rows, bases, strict=True)]
    asked = np.concatenate([r[4] for r, _ in parts])
    owner = np.concatenate([r[5] + base for r, base in parts])
    off = np.concatenate([r[6] for r, _ in parts])
    # In the order of the queries, as seeds are gathered by query next.
    order = np.argsort(2 * ids[owner] + (off & 1), kind="stable")
    asked, owner, off = asked[order], owner[order], off[order]
    for volume, (rows, bases) in by_volume.items():
        kept = Targets(code, rows, bases, max_count)
        if not len(kept.values):
            continue
        at = np.minimum(np.searchsorted(kept.values, asked), len(kept.values) - 1)
        met = np.flatnonzero(kept.values[at] == asked)
        for run, t in _spread_runs(kept.first[at[met]], kept.sizes[at[met]], step):
            query, target = met[run], kept.owner[t]
            fine = ids[target] < ids[owner[query]]
            query, target, t = query[fine], target[fine], t[fine]
            read = owner[query]
            yield {
                "qid": ids[read], "qsize": sizes[read], "qdir": (off[query] & 1).astype(np.int32), "qoff": (off[query] >> 1).astype(np.int32),
                "sid": ids[target], "ssize": sizes[target], "volume_id": np.full(len(t), volume), "sref": starts[target], "soff": kept.pos[t],
            }


def _seed_batch(found: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in SEED_SCHEMA], schema=SEED_SCHEMA)


def self_seeds(reads: DataFrame, k: int, stride: int, max_count: int) -> DataFrame:
    """Seeds of all reads against each other, each pair once, with the smaller id as target.

    Needs read_id, seq, len, volume_id and sref. K-mers that are hot among the
    queries have buckets of their own, as many as their number asks for; the target
    places, at most ``max_count``, are in each of these.
    """
    code, n = Code(k), _buckets(reads)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(_seed_batch, _meetings(code, batches, max_count, stride, STEP))

    rows = _met(reads, code, n, max_count, stride, _hot(reads, code, stride))
    return spread(rows, "bucket").groupBy("bucket").applyInArrow(meet, SEEDS)


BY_TARGET = "qid", "qdir", "sid", "soff", "qoff"
BY_BLOCK = "qid", "qdir", "goff", "qoff"
BY_VOLUME = "volume_id", *BY_BLOCK


@dataclass(frozen=True)
class Gathered:
    """Seeds on their way to buckets of queries, packed, and what unpacks and sorts those of a bucket.

    A step that takes sorted batches runs where the bucket is, so its seeds never become rows of Spark's.
    """

    sent: DataFrame
    gather: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
    block_size: int | None = None

    def with_blocks(self, block_size: int) -> Gathered:
        return replace(self, block_size=block_size)

    def mapInArrow(self, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What ``step`` makes of the seeds of each bucket, with their global offset, goff, and block_id if they have blocks."""
        gather, size = self.gather, self.block_size

        def placed(batch: pa.RecordBatch) -> pa.RecordBatch:
            goff = batch.column("sref").to_numpy() + batch.column("soff").to_numpy()
            batch = batch.append_column("goff", pa.array(goff))
            return batch if size is None else batch.append_column("block_id", pa.array(goff // size))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = gather(batches)
            yield from step(batch if batch.column("sref").null_count else placed(batch) for batch in found)

        return spread(self.sent, "bucket").groupBy("bucket").applyInArrow(run, schema)

    def rows(self) -> DataFrame:
        return spread(self.sent, "bucket").groupBy("bucket").applyInArrow(self.gather, SEEDS)


def gathered_seeds(reads: DataFrame, k: int, stride: int, max_count: int, order: tuple[str, ...] = BY_TARGET) -> DataFrame:
    """``self_seeds`` with all seeds of a query in one partition and in the given order there,
    for operators on ``gathered`` seeds. A bucket has the queries of about GATHER bases.

    ``order`` is BY_TARGET, BY_BLOCK or BY_VOLUME; ``sref`` is null in the first, which needs none.
    """
    return gathering(reads, k, stride, max_count, order).rows()


def gathering(reads: DataFrame, k: int, stride: int, max_count: int, order: tuple[str, ...] = BY_TARGET) -> Gathered:
    """The same for operators that run where the seeds are gathered."""
    if order not in (BY_TARGET, BY_BLOCK, BY_VOLUME):
        raise ValueError("no order that seeds are gathered in")
    code, n, to = Code(k), _buckets(reads), _buckets(reads, GATHER, 4)
    placed = order != BY_TARGET

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _meetings(code, batches, max_count, stride, PACK):
            bucket = found["qid"] % to
            by = np.lexsort((found["sid"], bucket))
            cuts = np.searchsorted(bucket[by], np.arange(to + 1))
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                own = by[cuts[i] : cuts[i + 1]]
                sid, strand = found["sid"][own], 2 * (found["qid"][own] // to) + found["qdir"][own]
                first = run_starts(sid)
                asking, one = np.unique(strand >> 1, return_index=True)
                data = pack(
                    strand, found["qoff"][own] // stride, found["soff"][own], steps(asking), found["qsize"][own][one],
                    steps(sid[first]), np.diff(np.append(first, len(sid))), found["ssize"][own][first],
                    *([jumps(found["sref"][own][first])] if placed else []),
                )
                yield _batch([i], [int(found["volume_id"][0])], [data])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[np.ndarray]] = {f.name: [] for f in SEED_SCHEMA}
        for batch in batches:
            numbers = zip(*(batch.column(c).to_pylist() for c in ("bucket", "volume_id")), batch.column("data"), strict=True)
            for bucket, volume, data in numbers:
                strand, qoff, soff, asking, qsize, sid, times, ssize, *sref = unpack(data.as_buffer())
                whole = {
                    "qid": (strand >> strand.dtype.type(1)).astype(np.int64) * to + bucket,
                    "qsize": qsize[np.searchsorted(summed(asking), strand >> strand.dtype.type(1))],
                    "qdir": strand & strand.dtype.type(1),
                    "qoff": qoff * qoff.dtype.type(stride),
                    "sid": np.repeat(summed(sid), times),
                    "ssize": np.repeat(ssize, times),
                    "volume_id": np.full(len(strand), volume),
                    "sref": np.repeat(landed(sref[0]), times) if placed else np.zeros(len(strand), np.int64),
                    "soff": soff,
                }
                for f in SEED_SCHEMA:
                    parts[f.name].append(whole[f.name].astype(f.type.to_pandas_dtype()))
        found = {name: np.concatenate(parts.pop(name)) for name in SEED_SCHEMA.names}
        strand = 2 * found["qid"] + found["qdir"]
        if placed:
            volume = [found["volume_id"]] if order == BY_VOLUME else []
            by = np.lexsort([found["qoff"], found["sref"] + found["soff"], strand, *volume])
        else:
            by = np.lexsort([found["soff"].astype(np.int64) << 32 | found["qoff"], found["sid"], strand])
        if not placed:
            found["sref"] = np.ma.masked_all(len(by), np.int64)
        for at in range(0, len(by), STEP):
            yield _seed_batch({name: found[name][by[at : at + STEP]] for name in SEED_SCHEMA.names})

    rows = _met(reads, code, n, max_count, stride, _hot(reads, code, stride))
    return Gathered(spread(rows, "bucket").groupBy("bucket").applyInArrow(send, ROWS), gather)


SLOTS = 1 << 21  # a k-mer of an index sets one


def _slots(code: Code, mixed: np.ndarray) -> np.ndarray:
    """The slot of each k-mer: the highest bits of its mixed value."""
    return (mixed >> np.uint64(max(2 * code.k - 21, 0))).astype(np.int64)


def slots(index: DataFrame, k: int) -> bytes:
    """Which slots the k-mers of an index set, a bit each. A task sends one map of that size."""
    code = Code(k)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(SLOTS, bool)
        for batch in batches:
            letters = np.frombuffer("".join(batch.column("kmer").to_pylist()).encode(), np.uint8)
            found[_slots(code, code.mixed(code.plain(_CODE[letters])[::k]))] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(found).tobytes()], pa.binary())], names=["found"])

    parts = index.select("kmer").mapInArrow(seen, "found binary").toLocalIterator()
    out = np.zeros(SLOTS // 8, np.uint8)
    for part in parts:
        out |= np.frombuffer(part["found"], np.uint8)
    return out.tobytes()


def met_queries(reads: DataFrame, k: int, stride: int, found: bytes) -> DataFrame:
    """Sampled k-mers of both strands as rows, those only that fall into a set slot."""
    code = Code(k)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_set = np.unpackbits(np.frombuffer(found, np.uint8)).astype(bool)
        for block in blocks(batches):
            values, owner, off, _ = _queries(block, code, stride)
            chosen = np.flatnonzero(is_set[_slots(code, values)])
            for at in range(0, len(chosen), STEP):
                some = chosen[at : at + STEP]
                read = owner[some]
                columns = [pa.array(x) for x in (block.ids[read], block.sizes[read], (off[some] & 1).astype(np.int32), (off[some] >> 1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, code.texts(values[some])], names=["qid", "qsize", "qdir", "qoff", "kmer"])

    return _placed(reads.select("read_id", "seq")).mapInArrow(ask, "qid long, qsize int, qdir int, qoff int, kmer string")
