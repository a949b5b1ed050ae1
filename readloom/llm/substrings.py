"""Substring dedup by level-wise doubling.

Windows of ``BASE`` words are compared over the whole table (``exchange``).
Those that occur again, and only they, are extended: a window of twice the
length can only repeat if the two windows that make it up do, so its key is made
of theirs and compared again. The last step before the wanted length overlaps
its halves. Beyond it the windows are doubled on, until no candidates survive,
if the longest repeats are asked for. Every word that a repeated window of the
wanted length covers is removed, judged on the input.

Keys of a level have as many bits as keep chance matches under a window in about
8,000, whatever the size of the table; they only make candidates, which must
match again at the next level with keys made anew. The last level's keys have 62 bits.

Defined results: a null or empty text has no words; a text shorter than the
window keeps all. A window that repeats within one text counts as well. Rows of
equal doc_id and text count as two, and lose the same words, also where the whole
table is there twice. Extra columns stay
with ``remove``. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm import exchange
from readloom.llm.text import Texts, join_hashes, white_space, window_hashes, windows_inside
from readloom.session import Workspace

WIDTH = 35
BASE = 18
LAST_BITS = 62


def compared(rows: DataFrame, n: int) -> DataFrame:
    """The windows whose key occurs again, with their keys, back at their blocks."""

    def repeated(key: tuple, group: pa.Table) -> pa.Table:
        got = exchange.Bucket(group)
        times = np.bincount(got.group) if len(got.group) else np.zeros(0, np.int64)
        again = np.zeros(len(got.keys), bool)
        again[got.order] = times[got.group] > 1
        # Slot 0 stands for a key that occurs again in its block; its windows are known there.
        several = np.zeros(len(times), bool)
        marked = got.slots[got.order] == 0
        several[got.group[marked]] = True
        again[got.order] |= several[got.group]
        return got.answers(again & (got.slots > 0), got.keys, key[0].as_py())

    return rows.groupBy("bucket").applyInArrow(repeated, exchange.ROWS)


def sent(n: int, block: int, places: np.ndarray, keys: np.ndarray, bits: int, **extra: np.ndarray) -> pa.Table:
    """Rows for windows at ``places``; keys that occur again in the block are sent
    once, and their windows kept in the block's own row."""
    keys = keys >> np.uint64(64 - bits)
    order = np.argsort(keys)
    keys, places = keys[order], places[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    alone = first.copy()
    alone[:-1] &= first[1:]
    slots = np.where(alone, places + 1, 0).astype(np.uint32)
    local = ~alone
    own = exchange.pack(places=places[local].astype(np.uint32), keys=keys[local], **extra)
    return exchange.dealt(n, block, keys[first], slots[first], own, bits)


def first_level(docs: DataFrame, n: int, size: int, bits: int) -> DataFrame:
    def send(block: int, ids: np.ndarray, checks: np.ndarray, first: np.ndarray, words: np.ndarray) -> pa.Table:
        inside = windows_inside(first, size)
        keys = window_hashes(words, size)
        places = np.flatnonzero(inside)
        return sent(n, block, places, keys[places], bits, ids=ids, checks=checks, first=first)

    return exchange.blocks(docs, white_space(), send)


def survivors(group: pa.Table) -> tuple[np.ndarray, np.ndarray, dict]:
    """Places and keys of a block's repeated windows, in order, and its own row."""
    slots, keys, extra = exchange.answered(group)
    if len(extra) != 1:
        raise ValueError("a block came back in parts: a repeated task read its rows in another order")
    own = extra[0]
    places = np.concatenate([slots.astype(np.int64) - 1, own.pop("places").astype(np.int64)])
    keys = np.concatenate([keys, own.pop("keys")])
    order = np.argsort(places)
    return places[order], keys[order], own


def next_level(answers: DataFrame, n: int, step: int, size: int, bits: int) -> DataFrame:
    """Windows of ``size`` words, made of two repeated windows ``step`` words apart."""

    def extend(key: tuple, group: pa.Table) -> pa.Table:
        places, keys, own = survivors(group)
        at = np.searchsorted(places, places + step)
        at[at == len(places)] = 0
        both = np.flatnonzero(places[at] == places + step) if len(places) else np.zeros(0, np.int64)
        document = np.searchsorted(own["first"], places[both], "right") - 1
        both = both[places[both] + size <= own["first"][document + 1]]
        # Keys take part with their level, so chance matches do not last.
        made = join_hashes(keys[both] * np.uint64(2 * size + 1), keys[at[both]])
        return sent(n, key[0].as_py(), places[both], made, bits, **own)

    return answers.groupBy("block").applyInArrow(extend, exchange.ROWS)


def covered(answers: DataFrame, width: int) -> DataFrame:
    """doc_id, check and spans (first and one past the last covered word, in turn)."""

    def cover(group: pa.Table) -> pa.Table:
        places, _, own = survivors(group)
        first, change = own["first"], np.zeros(int(own["first"][-1]) + 1, np.int64)
        np.add.at(change, places, 1)
        np.add.at(change, places + width, -1)
        hit = np.cumsum(change)[:-1] > 0
        edge = np.zeros(len(hit) + 1, bool)
        edge[first] = True
        begins = np.flatnonzero(hit & (~np.concatenate([[False], hit[:-1]])[: len(hit)] | edge[:-1]))
        ends = np.flatnonzero(hit & (~np.concatenate([hit[1:], [False]])[: len(hit)] | edge[1:])) + 1
        document = np.searchsorted(first, begins, "right") - 1
        spans = np.stack([begins - first[document], ends - first[document]], 1).reshape(-1).astype(np.int32)
        counts = 2 * np.bincount(document, minlength=len(own["ids"]))
        some = np.flatnonzero(counts)
        offsets = np.concatenate([[0], np.cumsum(counts[some])]).astype(np.int32)
        return pa.table({"doc_id": own["ids"][some], "check": own["checks"][some], "spans": pa.ListArray.from_arrays(pa.array(offsets), pa.array(spans))})

    return answers.groupBy("block").applyInArrow(cover, "doc_id long, check long, spans array<int>")


def repeats(docs: DataFrame, work: Workspace, width: int = WIDTH, base: int = BASE) -> DataFrame:
    """doc_id, check and spans of the documents with words that repeated windows cover."""
    docs = exchange.settled(exchange.keyed(docs), work)
    windows, n = exchange.extent(docs)
    size = min(base, width)
    rows = first_level(docs, n, size, LAST_BITS if size == width else bits(windows))
    before = None
    while True:
        answers = work.keep(f"repeats_{size}", compared(rows, n))
        rows = None
        if before:
            exchange.drop(work, f"repeats_{before}")
        exchange.release(docs.sparkSession)
        if size == width:
            break
        before, to = size, min(2 * size, width)
        rows = next_level(answers, n, to - size, to, LAST_BITS if to == width else bits(windows))
        size = to
    return covered(answers, width).dropDuplicates(["doc_id", "check"])


def bits(windows: int) -> int:
    return min(max(windows.bit_length() + 12, 32), LAST_BITS)


def longest(docs: DataFrame, work: Workspace, base: int = BASE) -> list[tuple[int, int]]:
    """Doubles until no candidates survive: (length, documents with a window of
    that length that occurs again), for each length with any."""
    docs = exchange.settled(exchange.keyed(docs), work)
    (_, n), size, out = exchange.extent(docs), base, []
    rows = first_level(docs, n, size, LAST_BITS)
    while True:
        answers = work.keep(f"longest_{size}", compared(rows, n))
        exchange.release(docs.sparkSession)
        found = covered(answers, size).count()
        if not found:
            return out
        out.append((size, found))
        rows = next_level(answers, n, size, 2 * size, LAST_BITS)
        size *= 2


def remove(
    docs: DataFrame, work: Workspace, keep: list[str] | None = None, digest: bool = False,
    width: int = WIDTH, base: int = BASE,
) -> DataFrame:
    """``row`` (the kept columns), n_words, n_removed and ``kept``, the words that
    stay, joined by one space, or the SHA-256 of that text if ``digest``."""
    keep = docs.columns if keep is None else keep
    spans = repeats(docs, work, width, base)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text.alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(exchange.NO_ID)).alias("doc_id"),
    ).withColumn("check", F.xxhash64("text"))
    rows = rows.join(spans, ["doc_id", "check"], "left").select("row", "spans", "text")
    out = T.StructType([rows.schema["row"], *T._parse_datatype_string("n_words long, n_removed long, kept string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts(batch.column("text"))
            data, edges, found = memoryview(texts.data), texts.offsets.tolist(), []
            for a, b, cut in zip(edges[:-1], edges[1:], batch.column("spans").to_pylist(), strict=True):
                words = bytes(data[a:b]).split()
                total = len(words)
                if cut:
                    edge = [0, *cut, total]
                    words = [w for i in range(0, len(edge), 2) for w in words[edge[i] : edge[i + 1]]]
                kept = b" ".join(words)
                found.append((total, total - len(words), hashlib.sha256(kept).hexdigest() if digest else kept.decode()))
            columns = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], names=["row", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, out)
