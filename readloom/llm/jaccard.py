"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its 4-word shingles. Sets that are equal are joined to
one class first. Shingles are ordered by the number of documents that have them,
rare ones first; the numbers come from one ``exchange`` of packed keys. A set of
n shingles that links with another lacks at most d = n - ceil(0.85 n) of its own
shingles there. So prefixes are extended until more than d of their shingles
would have to be missing if no signature were shared:

* a shingle that no other document has fills the prefix and gives no signature;
  a document with more than d of them links with nothing and is done;
* a rare shingle is a signature of its own;
* frequent shingles fall into classes by hash; within a class every pair in the
  prefix is a signature, and all but one of the class's shingles count. The
  number of classes goes with the size of the set; sets next to a bound between
  sizes give the signatures of both sides.

Of a pair the smaller set (either one, if they are equal in size) lacks fewer
shingles than d: n - ceil(2 * 0.85 / 1.85 * n). So each set has a short prefix for
meeting sets of its size or more, and the long one for meeting smaller sets only.

Candidates share a signature and pass a bound by sizes and shingles no other
document has. They are verified on their sets. To emit no pairs within large
groups, each document first meets one centre, the most typical document among
those that share a signature with it. Groups whose members are then in one
component are done, since links within a component change nothing. In the rest,
members outside the centre's component meet all members outside their own.

Shingles are 48-bit keys in the sets; sets that are equal are told by two sums of
64-bit hashes.

Defined results: a null or empty text has no shingles and is a component of its
own; with fewer than four words the whole sequence is one shingle. Rows of equal
text with words are of one component, as are rows of equal doc_id. A component
of rows without any doc_id is null. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm import exchange
from readloom.llm.components import components
from readloom.llm.heavy import heavy, lookup
from readloom.llm.text import folded, join_hashes, mix, white_space, window_hashes, windows_inside
from readloom.session import Workspace

WIDTH = 4
PERCENT = 85
RARE = 32  # a shingle in more documents is frequent

SETS = "doc_id long, check long, size long, sum1 long, sum2 long, alone long, shingles binary, short array<long>, long array<long>"


def shingles(docs: DataFrame, n: int) -> DataFrame:
    """Rows to the buckets: each distinct shingle of a block once, with the number of its documents."""

    def send(block: int, ids: np.ndarray, checks: np.ndarray, first: np.ndarray, words: np.ndarray) -> pa.Table:
        counts = np.diff(first)
        keys = window_hashes(words, WIDTH)
        place = np.flatnonzero(windows_inside(first, WIDTH))
        document = np.repeat(np.arange(len(ids)), counts)[place]
        keys = keys[place]
        short = np.flatnonzero((counts > 0) & (counts < WIDTH))
        if len(short):  # the whole sequence, with its length
            whole = []
            for i in short.tolist():
                h = np.array([counts[i]], np.uint64)
                for w in words[first[i] : first[i + 1]]:
                    h = join_hashes(h, np.array([w], np.uint64))
                whole.append(h[0])
            keys, document = np.concatenate([keys, np.array(whole, np.uint64)]), np.concatenate([document, short])
        # Distinct shingles of each document.
        order = np.argsort(keys, kind="stable")  # documents stay in order
        keys, document = keys[order], document[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (document[1:] != document[:-1])
        keys, document = keys[fresh], document[fresh]
        size = np.bincount(document, minlength=len(ids))
        sums = [np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)]
        np.add.at(sums[0], document, mix(keys ^ np.uint64(0x5851F42D4C957F2D)))
        np.add.at(sums[1], document, mix(keys + np.uint64(0x14057B7EF767814F)))
        keys = keys >> np.uint64(64 - exchange.BITS)
        start = np.ones(len(keys), bool)
        start[1:] = keys[1:] != keys[:-1]
        group = np.cumsum(start) - 1
        times = np.bincount(group) if len(keys) else np.zeros(0, np.int64)
        several = times > 1
        # Slots: 2 * document for a shingle of one document; 2 * number + 1 for one of several.
        number = np.cumsum(several) - 1
        slots = np.where(several, 2 * number + 1, 2 * document[start])
        local = several[group]
        own = exchange.pack(
            ids=ids, checks=checks, size=size, sum1=sums[0], sum2=sums[1], times=times[several],
            documents=document[local].astype(np.uint32), numbers=number[group[local]].astype(np.uint32),
        )
        table = exchange.dealt(n, block, keys[start], slots, own)
        # The numbers of documents go with the keys of several.
        return with_times(table, keys[start], slots, times, n)

    return exchange.blocks(docs, folded(white_space()), send)


def with_times(table: pa.Table, keys: np.ndarray, slots: np.ndarray, times: np.ndarray, n: int) -> pa.Table:
    """Put the numbers over 1, in order, into the extra column of the buckets' rows."""
    bounds = np.array([(i << exchange.BITS) // n for i in range(n + 1)], np.uint64)
    cuts = np.searchsorted(keys, bounds)
    cuts[-1] = len(keys)
    extra, at = [], 0
    full = np.flatnonzero(np.diff(cuts)).tolist()
    for i in full:
        part = times[cuts[i] : cuts[i + 1]]
        extra.append(part[part > 1].astype("<u4").tobytes())
        at += 1
    own = table.column("extra").to_pylist()[at:]
    return table.set_column(4, "extra", pa.array(extra + own, pa.binary()))


def counted(rows: DataFrame) -> DataFrame:
    """The shingles that several documents have, with their number, back at their blocks."""

    def count(key: tuple, group: pa.Table) -> pa.Table:
        got = exchange.Bucket(group)
        sent = group.filter(pa.compute.is_valid(group.column("keys")))
        many = [np.frombuffer(x.as_buffer(), "<u4") for x in sent.column("extra")]
        times = np.ones(len(got.keys), np.uint64)
        times[(got.slots & 1) == 1] = np.concatenate([np.zeros(0, np.uint32), *many])
        total = np.zeros(int(got.group[-1]) + 1 if len(got.group) else 0, np.uint64)
        np.add.at(total, got.group, times[got.order])
        number = np.zeros(len(got.keys), np.uint64)
        number[got.order] = total[got.group]
        # A value holds the number, at most 2^16 - 1, and the key: an order of all shingles.
        bound = np.minimum(number, np.uint64(0xFFFF)) << np.uint64(exchange.BITS)
        return got.answers(number > 1, bound | got.keys, key[0].as_py())

    return rows.groupBy("bucket").applyInArrow(count, exchange.ROWS)


def missing(size: int) -> int:
    """Most shingles of a set that a linked set can lack."""
    return size - -(-PERCENT * size // 100)


def missing_small(size: int) -> int:
    """Most shingles of a set that a linked set of its size or more can lack."""
    return size - -(-2 * PERCENT * size // (100 + PERCENT))


def signatures(size: int, alone: int, values: np.ndarray, most: int) -> np.ndarray:
    """Signatures of a set that lacks ``most`` of its shingles at most; ``values``
    are its shared shingles, rare ones first."""
    need = most + 1 - alone
    # Equal sets are one class; a set this small links with no other.
    if 100 * size < PERCENT * (size + 1) or need <= 0:
        return np.zeros(0, np.int64)
    number, key = values >> np.uint64(exchange.BITS), values & np.uint64((1 << exchange.BITS) - 1)
    rare = int(np.searchsorted(number, RARE, "right"))
    spread = mix(key * np.uint64(0x9FB21C651E98DF25) + np.uint64(1))
    out = [spread[: min(rare, need)]]
    need -= rare
    if need > 0:
        frequent = spread[rare:]
        low, high = (-(-PERCENT * size // 100)).bit_length() - 1, (100 * size // PERCENT).bit_length() - 1
        for band in range(low, high + 1):
            classes = max(1, (1 << band) // 10)
            kind = (frequent % np.uint64(classes)).astype(np.int64)
            # A class's first shingle does not count.
            order = np.argsort(kind, kind="stable")
            head = np.ones(len(order), bool)
            head[1:] = kind[order][1:] != kind[order][:-1]
            gain = np.ones(len(order), np.int64)
            gain[order[head]] = 0
            end = int(np.searchsorted(np.cumsum(gain), need)) + 1
            kind, part = kind[:end], frequent[:end]
            order = np.argsort(kind, kind="stable")
            kind, part = kind[order], part[order]
            for step in range(1, len(part)):
                same = np.flatnonzero(kind[step:] == kind[:-step])
                if not len(same):
                    break
                a, b = part[same], part[same + step]
                out.append(join_hashes(np.minimum(a, b) + np.uint64(band), np.maximum(a, b)))
    return np.unique(np.concatenate(out)).view(np.int64)


def sets(answers: DataFrame) -> DataFrame:
    """One row for each document; shingles and signatures of those that may link."""

    def collect(group: pa.Table) -> pa.Table:
        slots, values, extra = exchange.answered(group)
        if len(extra) != 1:
            raise ValueError("a block came back in parts: a repeated task read its rows in another order")
        own = extra[0]
        single = (slots & 1) == 0
        value_of = np.zeros(len(own["times"]), np.uint64)
        value_of[slots[~single].astype(np.int64) >> 1] = values[~single]
        document = np.concatenate([slots[single].astype(np.int64) >> 1, own["documents"]]).astype(np.int64)
        values = np.concatenate([values[single], value_of[own["numbers"]]])
        shared = np.bincount(document, minlength=len(own["ids"]))
        alone = own["size"] - shared
        wanted = np.array([missing(int(s)) for s in own["size"]]) + 1 - alone
        may = (wanted > 0) & (own["size"] > 0)
        chosen = may[document]
        document, values = document[chosen], values[chosen]
        order = np.lexsort((values, document))
        document, values = document[order], values[order]
        edges = np.searchsorted(document, np.arange(len(own["ids"]) + 1))
        packed, short, long = ([None] * len(may) for _ in range(3))
        for i in np.flatnonzero(may).tolist():
            part = values[edges[i] : edges[i + 1]]
            packed[i] = np.sort(part & np.uint64((1 << exchange.BITS) - 1)).astype("<u8").tobytes()
            size, lonely = int(own["size"][i]), int(alone[i])
            short[i] = signatures(size, lonely, part, missing_small(size)).tolist()
            long[i] = np.setdiff1d(signatures(size, lonely, part, missing(size)), short[i]).tolist()
        return pa.table(
            {
                "doc_id": pa.array(own["ids"]), "check": pa.array(own["checks"]), "size": pa.array(own["size"], pa.int64()),
                "sum1": pa.array(own["sum1"].view(np.int64)), "sum2": pa.array(own["sum2"].view(np.int64)),
                "alone": pa.array(alone, pa.int64()), "shingles": pa.array(packed, pa.binary()), "short": pa.array(short, pa.list_(pa.int64())), "long": pa.array(long, pa.list_(pa.int64())),
            }
        )

    return answers.groupBy("block").applyInArrow(collect, SETS)


def possible(a: str, b: str) -> Column:
    """Whether two sets may link by the prefixes that have the signature, their
    sizes and the shingles that only one document has. ``short``: the signature
    is of the short prefix, and the set may meet those of its size or more."""
    size_a, size_b = F.col(f"{a}.size"), F.col(f"{b}.size")
    role = (F.col(f"{a}.short") | (size_a > size_b)) & (F.col(f"{b}.short") | (size_b > size_a))
    most = F.least(F.col(f"{a}.size") - F.col(f"{a}.alone"), F.col(f"{b}.size") - F.col(f"{b}.alone"))
    return role & (100 * most >= PERCENT * (size_a + size_b - most))


def verified(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; ``own`` has rep, size and shingles."""
    left = own.select(F.col("rep").alias("a"), F.col("size").alias("size_a"), F.col("shingles").alias("set_a"))
    right = own.select(F.col("rep").alias("b"), F.col("size").alias("size_b"), F.col("shingles").alias("set_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "size_a", "size_b", "set_a", "set_b")

    def check(batches):
        for batch in batches:
            keep = []
            columns = [batch.column(c) for c in ("size_a", "size_b", "set_a", "set_b")]
            for n, m, x, y in zip(*columns, strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                every = np.sort(np.concatenate([x, y]))
                shared = int((every[1:] == every[:-1]).sum())
                keep.append(100 * shared >= PERCENT * (n.as_py() + m.as_py() - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def classes(docs: DataFrame, work: Workspace) -> DataFrame:
    """doc_id, check, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    rows = exchange.settled(exchange.keyed(docs), work)
    _, n = exchange.extent(rows)
    every = work.keep("sets", sets(counted(shingles(rows, n))))
    exchange.release(spark)
    real = F.col("doc_id") != exchange.NO_ID
    # Equal sets are one class, named by its smallest doc_id; so are rows of one doc_id.
    small, key = every.select("doc_id", "check", "size", "sum1", "sum2"), ["size", "sum1", "sum2"]
    rep = F.min(F.when(real, F.struct("doc_id", "check")))
    named = work.keep("classes", small.where("size > 0").groupBy(*key).agg(rep.alias("one"), F.count("*").alias("n")))
    named = named.select(*key, F.col("one.doc_id").alias("rep"), F.col("one.check").alias("check"), "n")
    large = heavy(named, every.count())
    members = lookup(small.where("size > 0"), named.select(*key, "rep"), key, large)
    members = work.keep("members", members.unionByName(small.where("size = 0").withColumn("rep", F.when(real, F.col("doc_id")))))
    able = every.where(F.col("shingles").isNotNull() & real)
    reps = able.join(named.select(F.col("rep").alias("doc_id"), "check"), ["doc_id", "check"], "left_semi")
    own = reps.select(F.col("doc_id").alias("rep"), "size", "alone", "sum1", "sum2", "shingles").dropDuplicates(["rep", "size", "sum1", "sum2"])
    of = lambda column, short: F.transform(column, lambda x: F.struct(x.alias("signature"), F.lit(short).alias("short")))
    roles = F.inline(F.concat(of("short", True), of("long", False)))
    signed = reps.select("doc_id", "size", "alone", "sum1", roles)
    signed = signed.select(F.struct(F.col("doc_id").alias("rep"), "size", "alone", "sum1", "short").alias("x"), "signature").distinct()
    signed = work.keep("signed", signed)
    typical = F.struct((F.col("x.alone") / F.col("x.size")).alias("share"), F.col("x").alias("x"))
    centres = signed.groupBy("signature").agg(F.min(typical).alias("c"), F.count("*").alias("n")).where("n > 1").select("signature", F.col("c.x").alias("c"))
    met = signed.join(centres, "signature").where((F.col("x.rep") != F.col("c.rep")) & possible("x", "c"))
    best = met.groupBy(F.col("x.rep").alias("a")).agg(F.min(F.struct((F.col("c.alone") / F.col("c.size")).alias("share"), F.col("c.rep").alias("b"))).alias("m"))
    tried = work.keep("tried", best.select("a", F.col("m.b").alias("b")))
    links = work.keep("links", verified(tried, own))
    labels = components(links, work, "first")
    exchange.release(spark)
    # Signatures whose documents are not in one component yet.
    label = labels.select(F.col("node").alias("rep"), "component")
    signed = signed.select("signature", "x", F.col("x.rep").alias("rep")).join(label, "rep", "left")
    signed = signed.withColumn("component", F.coalesce("component", "rep"))
    mixed = signed.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct(*[typical.alias("t"), F.col("component").alias("component")])).alias("c"))
    mixed = mixed.where("low < high").select("signature", F.col("c.component").alias("main"))
    left = work.keep("mixed", signed.join(mixed, "signature").select("signature", "x", "component", "main"))
    p, q = left.where("component != main").alias("p"), left.alias("q")
    cross = p.join(q, F.col("p.signature") == F.col("q.signature")).where((F.col("p.component") != F.col("q.component")) & possible("p.x", "q.x"))
    a, b = F.col("p.x.rep"), F.col("q.x.rep")
    cross = cross.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = work.keep("more_links", verified(cross.join(known, ["a", "b"], "left_anti"), own))
    every_link = links.unionAll(more)
    # Rows of one doc_id that are of several classes.
    first = members.where(real).groupBy("doc_id").agg(F.min("rep").alias("a"))
    same = members.join(first, "doc_id").where("rep != a").select("a", F.col("rep").alias("b")).distinct()
    final = components(every_link.unionAll(same), work, "final")
    out = lookup(members, final.select(F.col("node").alias("rep"), "component"), ["rep"], large)
    component = F.coalesce("component", "rep")
    return out.select(F.nullif("doc_id", F.lit(exchange.NO_ID)).alias("doc_id"), "check", F.col("size").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, work: Workspace) -> DataFrame:
    """All rows but those whose component has a row with a smaller doc_id, with all their columns."""
    found = classes(docs, work)
    gone = found.where(F.col("component_id") < F.col("doc_id")).select("doc_id", "check").distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("check"))
    return rows.join(gone, ["doc_id", "check"], "left_anti").select("row.*")
