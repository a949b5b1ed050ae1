"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

The windows of the test items, 13 words or the whole of a shorter item, become
a sorted array of hashes that every task gets; their size is checked before.
A larger benchmark is dealt into slices under the bound, each of which is
scanned on its own, and the hits are joined. Every hash hit is verified on the
words themselves. Texts are scanned whole.

Defined results: a null or empty text, or one without words, has no words and
no hit. A null or wordless item has no windows. Items of equal text are all
reported. Rows are judged one by one, so repeated rows get equal results. Other
columns are kept inside ``row``, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.text import Texts, alphanumeric, append, window_hashes, windows_inside

WIDTH = 13
SLICE_BYTES = 16 << 20  # of item texts in one broadcast
SHARE = 20  # contaminated: at least one word in so many is hit
BITS = 22


class Windows:
    """Hash tables of the windows of some items, one for each width that occurs."""

    def __init__(self, items: list[tuple[object, str]], width: int):
        self.kind = alphanumeric()
        self.owners: dict[bytes, list] = {}
        by_width: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            data = np.frombuffer(text.encode(), np.uint8)
            starts, ends, _ = self.kind.words(data, np.array([0, len(data)]))
            size = min(width, len(starts))
            if not size:
                continue
            folded = self.kind.lower[data].tobytes()
            by_width.setdefault(size, []).append(window_hashes(self.kind.hashes(data, starts, ends), size))
            spelled = [folded[s:e] for s, e in zip(starts, ends, strict=True)]
            for window in {b" ".join(spelled[i : i + size]) for i in range(len(spelled) - size + 1)}:
                self.owners.setdefault(window, []).append(item)
        self.tables = {size: np.unique(np.concatenate(parts)) for size, parts in by_width.items()}

    def scan(self, texts: Texts) -> list[pa.Array]:
        """Per text: words, first and last word of each hit stretch, items."""
        n_words, spans, n_spans, items = [], [], [], []
        for first, last in texts.blocks():
            data, offsets = texts.part(first, last)
            starts, ends, first_word = self.kind.words(data, offsets)
            words = self.kind.hashes(data, starts, ends)
            change = np.zeros(len(starts) + 1, np.int64)
            found: list[set] = [set() for _ in range(last - first)]
            for size, table in self.tables.items():
                hashes = window_hashes(words, size)
                low = np.zeros(1 << BITS, bool)
                low[table & np.uint64((1 << BITS) - 1)] = True
                maybe = np.flatnonzero(low[hashes & np.uint64((1 << BITS) - 1)])
                maybe = maybe[windows_inside(first_word, size)[maybe]]
                place = np.minimum(np.searchsorted(table, hashes[maybe]), len(table) - 1)
                for i in maybe[table[place] == hashes[maybe]].tolist():
                    spelled = self.kind.lower[data[starts[i] : ends[i + size - 1]]].tobytes()
                    parts = [spelled[s - starts[i] : e - starts[i]] for s, e in zip(starts[i : i + size], ends[i : i + size], strict=True)]
                    owners = self.owners.get(b" ".join(parts))
                    if owners:
                        change[i] += 1
                        change[i + size] -= 1
                        found[int(np.searchsorted(first_word, i, "right")) - 1].update(owners)
            hit = np.cumsum(change)[:-1] > 0
            # A stretch ends where the document does.
            edge = np.zeros(len(hit) + 1, bool)
            edge[first_word] = True
            before = np.concatenate([[False], hit[:-1]])
            begins = np.flatnonzero(hit & (~before | edge[:-1]))
            after = np.concatenate([hit[1:], [False]]) if len(hit) else hit
            stops = np.flatnonzero(hit & (~after | edge[1:])) + 1
            document = np.searchsorted(first_word, begins, "right") - 1
            spans.append(np.stack([begins - first_word[document], stops - first_word[document]], 1).reshape(-1))
            n_spans.append(2 * np.bincount(document, minlength=last - first))
            n_words.append(np.diff(first_word))
            items.extend(sorted(x, key=str) for x in found)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (n_words, spans, n_spans)]
        lists = pa.ListArray.from_arrays(
            np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int32),
            pa.array([str(y) for x in items for y in x], pa.string()),
        )
        offsets = np.concatenate([[0], np.cumsum(flat[2])]).astype(np.int32)
        return [pa.array(flat[0]), pa.ListArray.from_arrays(offsets, pa.array(flat[1])), lists]


def hits(
    docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, width: int = WIDTH,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``row`` (the kept columns), n_words, spans (array of first and one past the
    last word of each hit stretch, in turn) and items (ids as strings, sorted)."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = int(size // slice_bytes) + 1
    schema = "n_words long, spans array<int>, items array<string>"
    if slices == 1:
        tables = Windows([tuple(r) for r in items.collect()], width)
        return append(docs, tables.scan, schema, keep=keep)
    parts = []
    for k in range(slices):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        tables = Windows([tuple(r) for r in some.collect()], width)
        parts.append(append(docs, tables.scan, schema, keep=keep))
    # Equal rows have equal hits, so they are counted and dealt out again.
    every = reduce(DataFrame.unionAll, [p.withColumn("slice", F.lit(k)) for k, p in enumerate(parts)])
    joined = every.groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_set("spans")).alias("raw"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.count_if(F.col("slice") == 0).alias("copies"),
    )
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("raw") - 1, F.lit(2)),
        lambda i: F.struct(F.element_at("raw", i + 1).alias("a"), F.element_at("raw", i + 2).alias("b")),
    )
    pairs = F.array_sort(F.when(F.size("raw") > 0, pairs).otherwise(F.expr("array_remove(array(named_struct('a', 0, 'b', 0)), named_struct('a', 0, 'b', 0))")))
    merged = F.aggregate(pairs, F.expr("cast(array() as array<int>)"), _merge)
    return (
        joined.withColumn("spans", merged)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("row", "n_words", "spans", "items")
    )


def _merge(done: Column, span: Column) -> Column:
    """Append a span, in order of start, to disjoint ones."""
    last = F.when(F.size(done) > 0, F.element_at(done, -1)).otherwise(F.lit(-1))
    longer = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.greatest(last, span["b"])))
    return F.when(span["a"] <= last, longer).otherwise(F.concat(done, F.array(span["a"], span["b"])))


def n_hit(spans: str = "spans") -> Column:
    """Words inside the stretches."""
    return F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("sign")),
        lambda s, x: F.struct((s["sum"] + s["sign"] * x).alias("sum"), (-s["sign"]).alias("sign")),
        lambda s: s["sum"],
    )


def report(found: DataFrame) -> DataFrame:
    """Hits with n_hit, n_items, items_sha256 and contaminated."""
    found = found.withColumn("n_hit", n_hit())
    return found.select(
        "row", "spans", "items", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that are not contaminated, with all their columns."""
    return report(hits(docs, benchmark)).where(~F.col("contaminated")).select("row.*")


def without_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All rows; words inside hit stretches are taken out of ``text``, the rest stays as it is."""
    found = hits(docs, benchmark)
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    gaps, words = F.split(F.col("row.text"), pattern, -1), F.regexp_extract_all("row.text", F.lit(pattern), F.lit(0))
    inside = lambda i: F.exists(
        F.sequence(F.lit(0), F.size("spans") - 1, F.lit(2)),
        lambda k: (F.element_at("spans", k + 1) <= i) & (i < F.element_at("spans", k + 2)),
    )
    kept = F.transform(words, lambda w, i: F.when(inside(i), F.lit("")).otherwise(w))
    text = F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), kept.alias("w")), lambda z: F.array(z["g"], F.coalesce(z["w"], F.lit(""))))), "")
    text = F.when(F.size("spans") > 0, text).otherwise(F.col("row.text"))
    return found.withColumn("row", F.col("row").withField("text", text)).select("row.*")
