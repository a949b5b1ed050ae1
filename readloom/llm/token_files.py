"""Token ids as ORC: integer run-length encoding, row indexes, Bloom filters on document ids.

Texts are dealt by ranges of doc_id before they are encoded, as they are smaller
than their ids, and each task writes one file in ascending order. Row groups and
stripes carry minima and maxima of doc_id, and Bloom filters, so a lookup of
documents reads only the row groups that can hold them; whole reads are split by
stripe. ``row_no`` numbers the rows, partition by partition, in that order.

Distinct pieces of the texts are encoded once (``pieces``). This changes no id:
the tokenizer splits at white space, and between letters and stops. A body of
plain letters goes to the merges directly, as its normalisation is known; any
other piece goes through the whole tokenizer.

Defined results: a null or empty text has the end id alone. Rows of equal doc_id
are ordered by text; a null doc_id comes first. Empty tables give no rows. Other
columns are not stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm import pieces
from readloom.llm.text import Texts, append, process_cache, ragged
from readloom.session import Workspace

VOCABULARY = "word_bpe_49k.json"
END = 2
ROW_GROUP = 1000  # rows between index entries
STRIPE_BYTES = 16 << 20
FILE_BYTES = 256 << 20  # of text in one file
class WordCodec:
    """The tokenizer of a file; ``special`` tells whether names of special tokens in a text are those tokens."""

    def __init__(self, path: str, special: bool = True):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = not special
        self.words = Tokenizer(self.whole.model)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        last = self.whole.model.end_of_word_suffix or ""
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if last and token.endswith(last)]] = True
        # Byte-level spelling: each byte as the character that stands for it.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        others = [b for b in range(256) if b not in plain]
        self.spelling = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.table = pieces.Table(self._new)

    def _new(self, spelled: list[bytes], tags: np.ndarray) -> list[np.ndarray]:
        out: list = [None] * len(spelled)
        bodies = np.flatnonzero(tags == pieces.BODY).tolist()
        for i, ids in zip(bodies, self._bodies([spelled[i] for i in bodies]), strict=True):
            out[i] = ids
        others = np.flatnonzero(tags != pieces.BODY).tolist()
        coded = self.whole.encode_batch_fast([spelled[i].decode() for i in others], add_special_tokens=False)
        for i, one in zip(others, coded, strict=True):
            out[i] = np.array(one.ids, np.uint32)
        return out

    def _bodies(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of lower-case words, many in one call; the last id of each word is one that ends words."""
        if not words:
            return []
        text = [w.decode() if w.isascii() else w.decode("latin-1").translate(self.spelling) for w in words]
        lines = [" ".join(text[i : i + 200]) for i in range(0, len(text), 200)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.words.encode_batch_fast(lines, add_special_tokens=False)])
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            raise ValueError("the vocabulary does not mark the ends of words")
        stops = stops.tolist()
        return [ids[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the number of ids of each."""
        p = pieces.cut(data, offsets)
        small = pieces.lower(data)
        body = pieces.keys(small, p.starts, p.middles, np.full(len(p.starts), pieces.BODY))
        raw = np.flatnonzero(~p.plain)
        body[raw] = pieces.keys(data, p.starts[raw], p.ends[raw], np.full(len(raw), pieces.RAW))
        stops, stop = np.zeros(len(body), np.uint64), p.ends > p.middles
        stops[stop] = pieces.keys(data, p.middles[stop], p.ends[stop], np.full(int(stop.sum()), pieces.STOPS))
        key, there = pieces.interleave((body, np.ones(len(body), bool)), (stops, stop))

        def spell(at: np.ndarray) -> tuple[list[bytes], np.ndarray]:
            piece, column = there[at] // 2, there[at] % 2
            tags = np.where(column == 1, pieces.STOPS, np.where(p.plain[piece], pieces.BODY, pieces.RAW))
            begins = np.where(column == 1, p.middles[piece], p.starts[piece])
            stops = np.where(column == 1, p.ends[piece], p.middles[piece])
            folded, plain = memoryview(small), memoryview(data)
            return [
                bytes((folded if t == pieces.BODY else plain)[a:b])
                for t, a, b in zip(tags.tolist(), begins.tolist(), stops.tolist(), strict=True)
            ], tags

        ids, sizes = self.table.lookup(key, spell)
        done = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(done[np.searchsorted(there, 2 * p.first)])


def word_codec(vocabulary: str, special: bool = True) -> WordCodec:
    path = public_tokenizers.path(vocabulary)
    return process_cache(f"words {path} {special}", lambda: WordCodec(path, special))


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END) -> None:
    """Encode all texts, each closed by ``end``, and write doc_id, row_no and ids."""

    def kernel(texts: Texts) -> list[pa.Array]:
        own, flat, counts = word_codec(vocabulary), [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for first, last in texts.blocks():
            ids, sizes = own.encode(*texts.part(first, last))
            flat.append(np.insert(ids, np.cumsum(sizes), end))
            counts.append(sizes + 1)
        return [ragged(np.concatenate(flat).astype(np.int32), np.concatenate(counts))]

    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(total // FILE_BYTES) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows = append(rows, kernel, "ids array<int>", keep=["doc_id"])
    rows = rows.select("row.doc_id", F.monotonically_increasing_id().alias("row_no"), "ids")
    writer = rows.write.mode("overwrite").option("compression", "lz4")
    for key, value in {
        "orc.create.index": "true", "orc.row.index.stride": ROW_GROUP, "orc.stripe.size": STRIPE_BYTES,
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
    }.items():
        writer = writer.option(key, str(value))
    writer.orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, row_no and ids; a filter on doc_id reaches the stripes' indexes and Bloom filters."""
    return spark.read.schema("doc_id long, row_no long, ids array<int>").orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a stated list of documents."""
    return read(spark, path).where(F.col("doc_id").isin(doc_ids))


def counts(spark: SparkSession, path: str, work: Workspace) -> DataFrame:
    """Per row of the files: doc_id, start, n_tokens and ids_crc32."""

    def checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), "<i4")
            sizes = pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False)
            edges = (4 * np.concatenate([[0], np.cumsum(sizes)])).astype(np.int64).tolist()
            data = memoryview(flat).cast("B") if len(flat) else memoryview(b"")
            sums = [zlib.crc32(data[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_no"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "row_no", "n_tokens", "ids_crc32"],
            )

    rows = read(spark, path).mapInArrow(checksum, "doc_id long, row_no long, n_tokens long, ids_crc32 long")
    rows = work.keep("token_counts", rows).withColumn("part", F.shiftright("row_no", 33))
    # One row for each file, then a running total inside each file.
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(files, "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
