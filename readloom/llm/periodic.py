"""Periodic run detection on grammar-compressed words.

A run is a longest stretch of words with a smallest period q that is at least
``LEAST`` words and ``TIMES`` periods long. The words of many documents are
compressed by pairs: in each round the most frequent pairs of neighbouring
symbols, where they do not overlap a more frequent one, become new symbols, until
no pair occurs again or a round takes off less than 1/64. What is left of each
document is halved into a balanced tree. So every stretch of two words or more
crosses the boundary of exactly one lowest symbol or tree node that holds it.

Runs across a symbol's boundary are found once, at one place where it occurs: a
period is a distance at which the words beside the boundary come again, and the
run is as far as they go on doing so within the symbol. Then they are translated
to all places that derive from the symbol. A run cut off by the end of a symbol
lies within the same run of a larger one; maximal intervals of a period stay.
The grammar only decides where work is shared: runs are the same whatever it is.

Two thirds of ``LEAST`` words of a run come again a period later. Documents in
which no window of that many words occurs twice hold no run and need no grammar.
Runs are compared with the words at the end, as hashes found them.

Defined results: a null or empty text has no words and no runs. Repeated rows
get equal results. A whole text is one row's work and costs n log n at most.
Other columns are in ``row``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.text import Texts, join_hashes, mix, small_batches, white_space, window_hashes, windows_inside

LEAST, TIMES = 24, 3
SHRINK = 64
PAIRS_AT_ONCE = 1 << 21
PRIMES = (2**31 - 1, 2**31 - 19)

#: Places of words to read instead of a document's own: (doc_id, words) -> places, or None for its own.
Places = Callable[[int, int], np.ndarray | None]


class Prefixes:
    """Sums that tell whether two stretches of one sequence are equal, modulo two primes."""

    def __init__(self, words: np.ndarray):
        self.sums, self.powers = [], []
        for k, p in enumerate(PRIMES):
            base, power = 1_000_003 + 7919 * k, np.ones(len(words) + 1, np.int64)
            done = 1
            while done < len(power):
                power[done : 2 * done] = power[: len(power) - done][:done] * pow(base, done, p) % p
                done *= 2
            values = (mix((words + k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) % np.uint64(p - 1)).astype(np.int64) + 1
            sums = np.zeros(len(words) + 1, np.int64)
            np.cumsum(values * power[:-1] % p, out=sums[1:])
            self.sums.append(sums % p)
            self.powers.append(power)

    def equal(self, a: np.ndarray, apart: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` words from a on come again ``apart`` words later."""
        out = np.ones(len(a), bool)
        for p, s, power in zip(PRIMES, self.sums, self.powers, strict=True):
            here, there = (s[a + size] - s[a]) % p, (s[a + apart + size] - s[a + apart]) % p
            out &= here * power[apart] % p == there
        return out

    def reach(self, a: np.ndarray, apart: np.ndarray, most: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from a on (or before a) come again ``apart`` words later."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) // 2
            fits = self.equal(a if forward else a - middle, apart, middle)
            low = np.where(open_ & fits, middle, low)
            high = np.where(open_ & ~fits, middle - 1, high)


class Grammar:
    """Boundaries of symbols: lo, mid and hi at one place each, and all places of symbol k
    at ``places[cuts[k] : cuts[k + 1]]``. Tree nodes have their one place. Symbols of
    fewer than ``least`` words are left out, as no run fits in."""

    def __init__(self, words: np.ndarray, first: np.ndarray, least: int = LEAST):
        symbol, place = words.astype(np.int64), np.arange(len(words))
        span, document = np.ones(len(words), np.int64), np.repeat(np.arange(len(first) - 1), np.diff(first))
        fresh = int(symbol.max(initial=0)) + 1
        lo, mid, hi, places, sizes = [], [], [], [], []

        def add(starts: np.ndarray, left: np.ndarray, size: np.ndarray, all_places: np.ndarray, counts: np.ndarray) -> None:
            for held, new in zip((lo, mid, hi, places, sizes), (starts, starts + left, starts + size, all_places, counts), strict=True):
                held.append(new)

        while len(symbol) > 1:
            chosen, kind = self.pairs(symbol, document, fresh)
            if not len(chosen):
                break
            # Rules in the order of their kinds, each with its places.
            order = np.argsort(kind, kind="stable")
            counts = np.bincount(kind)
            heads = np.cumsum(counts) - counts
            left, size = span[chosen], span[chosen] + span[chosen + 1]
            at = order[heads]
            long = size[at] >= least
            add(place[chosen[at]][long], left[at][long], size[at][long], place[chosen[order]][long[kind[order]]], counts[long])
            symbol[chosen], span[chosen] = fresh + kind, size
            fresh += len(counts)
            stay = np.ones(len(symbol), bool)
            stay[chosen + 1] = False
            symbol, place, span, document = symbol[stay], place[stay], span[stay], document[stay]
            if len(chosen) * SHRINK < len(symbol):
                break
        while len(place):  # the trees of what is left
            number = np.arange(len(document)) - np.searchsorted(document, document)
            left = np.flatnonzero((number[:-1] % 2 == 0) & (document[1:] == document[:-1]))
            if not len(left):
                break
            size = span[left] + span[left + 1]
            long = size >= least
            add(place[left][long], span[left][long], size[long], place[left][long], np.ones(int(long.sum()), np.int64))
            span[left] = size
            stay = np.ones(len(place), bool)
            stay[left + 1] = False
            place, span, document = place[stay], span[stay], document[stay]
        join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        self.lo, self.mid, self.hi, self.places = join(lo), join(mid), join(hi), join(places)
        self.cuts = np.concatenate([[0], np.cumsum(join(sizes))]).astype(np.int64)

    @staticmethod
    def pairs(symbol: np.ndarray, document: np.ndarray, fresh: int) -> tuple[np.ndarray, np.ndarray]:
        """First places of the pairs to replace, and numbers of their kinds from 0."""
        inside = np.flatnonzero(document[1:] == document[:-1])
        _, kind, times = np.unique(symbol[inside] * fresh + symbol[inside + 1], return_inverse=True, return_counts=True)
        rank = np.empty(len(times), np.int64)
        rank[np.argsort(times, kind="stable")] = np.arange(len(times))
        value = np.full(len(symbol) + 1, -1, np.int64)  # of the pair at a place, and -1 at both ends
        value[inside + 1] = np.where(times[kind] > 1, rank[kind], -1)
        change = np.flatnonzero(value[1:] != value[:-1]) + 1
        starts, ends = change, np.concatenate([change[1:], [len(value)]])
        best = (value[starts] > value[starts - 1]) & (value[starts] > value[np.minimum(ends, len(value) - 1)])
        # Places of one pair in a row overlap: every second one is taken.
        starts, ends = starts[best], ends[best]
        number = (ends - starts + 1) // 2
        chosen = np.repeat(starts, number) + 2 * (np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)) - 1
        _, kind, times = np.unique(value[chosen + 1], return_inverse=True, return_counts=True)
        again = times > 1
        chosen, kind = chosen[again[kind]], (np.cumsum(again) - 1)[kind[again[kind]]]
        return chosen, kind


def across(words: np.ndarray, grammar: Grammar, least: int) -> tuple[np.ndarray, ...]:
    """Runs across the boundary of each symbol, at its one place: symbol, start, end, period."""
    width = max((2 * least // TIMES + 1) // 2, 1)  # so many words from the anchor on, or back to it, come again
    known, prefixes = window_hashes(mix(words.astype(np.uint64) + np.uint64(1)), width), Prefixes(words)
    most = (grammar.hi - grammar.lo) // TIMES
    ends, out = np.cumsum(most), []
    at = 0
    while at < len(most):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")), at + 1)
        node = np.repeat(np.arange(at, to), most[at:to])
        period = np.arange(len(node)) - np.repeat(ends[at:to] - most[at:to] - (ends[at - 1] if at else 0), most[at:to]) + 1
        lo, mid, hi = grammar.lo[node], grammar.mid[node], grammar.hi[node]
        for anchor in (mid - 1, mid - period):
            fits = np.zeros(len(node), bool)
            for begin in (anchor, anchor - width + 1):
                inside = np.flatnonzero((begin >= lo) & (begin + period + width <= hi))
                b = begin[inside]
                fits[inside] |= known[b] == known[b + period[inside]]
            which = np.flatnonzero(fits)
            a, q = anchor[which], period[which]
            end = a + q + prefixes.reach(a, q, hi[which] - a - q, True)
            start = a - prefixes.reach(a, q, a - lo[which], False)
            long = end - start >= np.maximum(least, TIMES * q)
            out.append((node[which][long], start[long], end[long], q[long]))
        at = to
    node, start, end, period = (np.concatenate([np.zeros(0, np.int64), *[o[k] for o in out]]) for k in range(4))
    # Of one stretch only the smallest period.
    order = np.lexsort((period, end, start, node))
    node, start, end, period = node[order], start[order], end[order], period[order]
    head = np.ones(len(node), bool)
    head[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return node[head], start[head], end[head], period[head]


def runs(words: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs of many documents, by start, then period; ``words`` are
    numbers, those of document i at first[i] to first[i + 1]."""
    grammar = Grammar(words, first, least)
    node, start, end, period = across(words, grammar, least)
    counts = grammar.cuts[node + 1] - grammar.cuts[node]
    which = np.repeat(np.arange(len(node)), counts)
    number = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    shift = grammar.places[grammar.cuts[node[which]] + number] - grammar.lo[node[which]]
    start, end, period = start[which] + shift, end[which] + shift, period[which]
    document = np.searchsorted(first, start, "right") - 1
    order = np.lexsort((-end, start, period, document))
    document, start, end, period = document[order], start[order], end[order], period[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (document[1:] != document[:-1]) | (period[1:] != period[:-1])
    reach = end + (np.cumsum(fresh) - 1) * (len(words) + 1)
    largest = np.ones(len(start), bool)
    largest[1:] = reach[1:] > np.maximum.accumulate(reach)[:-1]
    document, start, end, period = document[largest], start[largest], end[largest], period[largest]
    order = np.lexsort((period, start))
    document, start, end, period = document[order], start[order], end[order], period[order]
    for d, s, e, q in zip(document.tolist(), start.tolist(), end.tolist(), period.tolist(), strict=True):
        whole = (words[s : e - q] == words[s + q : e]).all()
        if not whole or (s > first[d] and words[s - 1] == words[s - 1 + q]) or (e < first[d + 1] and words[e] == words[e - q]):
            raise ArithmeticError("hashes took different words for equal ones")
    return start, end, period


def suspects(hashes: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Documents with a window of 2/3 ``least`` words that occurs again in them."""
    width = max(least - least // TIMES, 1)
    places = np.flatnonzero(windows_inside(first, width))
    document = np.searchsorted(first, places, "right") - 1
    keys = join_hashes(mix(document.astype(np.uint64) + np.uint64(1)), window_hashes(hashes, width)[places]) if len(places) else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    again = keys[order][1:] == keys[order][:-1]
    return np.unique(document[order[1:][again]])


OUT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def collapse(
    docs: DataFrame, keep: list[str] | None = None, digest: bool = False, places: Places | None = None, least: int = LEAST
) -> DataFrame:
    """``row`` (the kept columns), n_words, the runs by start, then period, and ``collapsed``: the words that
    no run has after its first period, joined by one space, or the SHA-256 of that text if ``digest``.
    ``places`` may have words of a document read in another order; it needs doc_id."""
    keep = docs.columns if keep is None else keep
    small_batches(docs.sparkSession)
    own = F.col("doc_id").cast("long") if places else F.lit(None).cast("long")
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text").cast("string").alias("text"), own.alias("own"))
    out = T.StructType([source.schema["row"], *T._parse_datatype_string(OUT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = white_space()
        for batch in batches:
            texts, ids = Texts(batch.column("text")), batch.column("own").to_pylist()
            for a, b in texts.blocks():
                columns = block(kind, *texts.part(a, b), ids[a:b], places, least, digest)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), *columns], names=out.names)

    return source.mapInArrow(run, out)


def block(kind, data: np.ndarray, offsets: np.ndarray, ids: list, places: Places | None, least: int, digest: bool) -> list[pa.Array]:
    starts, ends, first = kind.words(data, offsets)
    read = np.arange(len(starts))  # the word to read at each place
    for i in range(len(ids)) if places else ():
        n = int(first[i + 1] - first[i])
        order = places(ids[i], n) if n else None
        if order is not None:
            read[first[i] : first[i + 1]] = first[i] + order
    some = suspects(kind.hashes(data, starts, ends)[read], first, least)
    # Exact numbers of the words of these documents, and their runs.
    texts, known, numbers, held = memoryview(data), {}, [], {}
    for i in some.tolist():
        words = bytes(texts[offsets[i] : offsets[i + 1]]).split()
        held[i] = [words[k] for k in (read[first[i] : first[i + 1]] - first[i]).tolist()]
        numbers.append(np.array([known.setdefault(w, len(known)) for w in held[i]], np.int64))
    own = np.concatenate([[0], np.cumsum([len(x) for x in numbers])]).astype(np.int64)
    start, end, period = runs(np.concatenate([np.zeros(0, np.int64), *numbers]), own, least)
    cuts = np.searchsorted(start, own)
    found = {i: slice(int(cuts[k]), int(cuts[k + 1])) for k, i in enumerate(some.tolist())}
    base = dict(zip(some.tolist(), own.tolist(), strict=False))
    collapsed, counts = [], np.zeros(len(ids), np.int64)
    for i in range(len(ids)):
        words = held.get(i)
        if words is None:
            words = bytes(texts[offsets[i] : offsets[i + 1]]).split()
            if places and (read[first[i] : first[i + 1]] != np.arange(first[i], first[i + 1])).any():
                words = [words[k] for k in (read[first[i] : first[i + 1]] - first[i]).tolist()]
        elif found[i].stop > found[i].start:
            s, e, q = (x[found[i]] for x in (start, end, period))
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, s + q - base[i], 1)
            np.add.at(change, e - base[i], -1)
            words = [words[k] for k in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]
            counts[i] = len(s)
        kept = b" ".join(words)
        collapsed.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
    shift = np.repeat(own[:-1], np.diff(cuts))
    struct = pa.StructArray.from_arrays([pa.array(start - shift), pa.array(end - start), pa.array(period)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), struct)
    return [pa.array(np.diff(first), pa.int64()), lists, pa.array(collapsed, pa.string())]


def strongest(column: str) -> F.Column:
    """The run with the greatest exact length / period; of equal ones the first."""
    more = lambda a, x: a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"])
    none = F.expr("cast(null as struct<start:bigint,length:bigint,period:bigint>)")
    return F.aggregate(column, none, lambda a, x: F.when(more(a, x), x).otherwise(a))


def digested(found: DataFrame) -> DataFrame:
    """``row``, number of runs, the strongest run, and digests of all runs and of the collapsed words."""
    line = lambda x: F.concat(F.concat_ws(",", *[x[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n"))
    best = found.select("row", "runs", "collapsed", strongest("runs").alias("best"))
    return best.select(
        "row", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"),
    )
