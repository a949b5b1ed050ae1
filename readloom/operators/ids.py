"""Dense ids, running totals and volumes without a single-partition sort.

A global running total is taken in two levels. Rows fall into buckets whose
order agrees with the wanted row order; bucket totals (a small table) are
accumulated first, then rows are accumulated inside their bucket. With unique
integer ids a bucket ``id >> 16`` holds at most 65,536 rows whatever the data
look like, so no task ever sees more than that in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.packed import quartered, spelled
from readloom.session import Workspace, spread

BUCKET_BITS = 16


def id_bucket(id_: Column) -> Column:
    return F.shiftright(id_.cast("long"), BUCKET_BITS)


def running_total(
    df: DataFrame,
    value: Column,
    order: list[Column],
    buckets: list[tuple[Column, bool]],
    out: str,
    within: list[str] | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows up to and including this
    one, in ``order`` (a total order), restarted per ``within`` columns.

    ``buckets`` lists (expression, ascending) pairs that refine ``within`` and
    sort the same way as ``order``. The input is read twice, for the totals and
    for the rows, so it should be a stored table when it is costly to make.
    """
    within = within or []
    names = [f"__b{i}" for i in range(len(buckets))]
    keyed = df.select("*", value.cast("long").alias("__v"), *[b.alias(n) for (b, _), n in zip(buckets, names)])
    sorted_buckets = [F.col(n).asc() if up else F.col(n).desc() for n, (_, up) in zip(names, buckets)]
    before = (
        Window.partitionBy(*within).orderBy(*sorted_buckets).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = (
        keyed.groupBy(*within, *names)
        .agg(F.sum("__v").alias("__t"))
        .select(*within, *names, (F.sum("__t").over(before) - F.col("__t")).alias("__start"))
    )
    inside = (
        Window.partitionBy(*within, *names)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        keyed.withColumn("__r", F.sum("__v").over(inside))
        .join(totals, [*within, *names])
        .withColumn(out, F.col("__start") + F.col("__r"))
        .select(*df.columns, out)
    )


def dense_ids(df: DataFrame, key: str, out: str = "read_id") -> DataFrame:
    """Number the rows 0, 1, 2, ... by a unique integer column."""
    numbered = running_total(df, F.lit(1), [F.col(key)], [(id_bucket(F.col(key)), True)], "__n")
    return numbered.select((F.col("__n") - 1).alias(out), *df.columns)


def with_offsets(reads: DataFrame) -> DataFrame:
    """Add ``offset``: where each read starts in the concatenation by read_id."""
    total = running_total(
        reads, F.col("len"), [F.col("read_id")], [(id_bucket(F.col("read_id")), True)], "__end"
    )
    return total.withColumn("offset", F.col("__end") - F.col("len")).drop("__end")


RUN_BITS = 10


def placed_reads(keyed: DataFrame, key: str) -> DataFrame:
    """Number sequences by a unique integer key and place them end to end: read_id, seq, len, offset.

    Both totals are taken in one pass, so a sequence, which may hold A, C, G and T only, is
    shuffled once, four bases a byte. Buckets are runs of 1,024 keys and stay dealt out over
    all tasks, which keeps those that read the result busy. Rows without a key are left out.
    """
    run = F.shiftright(F.col(key).cast("long"), RUN_BITS)
    rows = quartered(keyed.select(F.col(key).alias("__key"), run.alias("__run"), "seq"), ["__key", "__run"])
    rows = spread(rows.where("__run IS NOT NULL"), "__run")
    earlier = Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda column: F.coalesce(F.sum(column).over(earlier), F.lit(0))
    # Totals that name every column are taken from the same shuffle as the rows.
    size = F.sum(F.when(F.col("bases").isNotNull(), F.col("len")))
    runs = rows.groupBy("__run").agg(F.count("__key").alias("__n"), size.alias("__size"))
    runs = runs.select("__run", before("__n").alias("__ids"), before("__size").alias("__start"))
    inside = Window.partitionBy("__run").orderBy("__key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = {"__rank": F.sum(F.lit(1)).over(inside), "__end": F.sum(F.col("len").cast("long")).over(inside)}
    placed = rows.withColumns(totals).join(runs, "__run").select(
        (F.col("__ids") + F.col("__rank") - 1).alias("read_id"),
        "bases",
        "len",
        (F.col("__start") + F.col("__end") - F.col("len")).alias("offset"),
    )
    return spelled(placed).select("read_id", "seq", "len", "offset")


def assign_volumes(reads: DataFrame, limit: int) -> DataFrame:
    """Batches of consecutive reads of about ``limit`` bases, by start offset.

    Needs ``offset``. Batches are near-equal in size; a read that crosses a
    limit stays in the batch it starts in.
    """
    return reads.withColumn("volume_id", F.expr(f"offset div {int(limit)}"))


def greedy_volumes(reads: DataFrame, limit: int, work: Workspace) -> DataFrame:
    """Add ``volume_id``: a volume is closed by the read with which it reaches ``limit`` bases.

    Needs dense read_id, len and offset. Where a volume starts depends on all
    before it, so every read is taken as a start: the read that would close its
    volume is the first whose end lies ``limit`` bases on, found by one sorted pass
    over starts and ends within blocks of ``limit`` bases. Pointers from each start to
    the next are then doubled, and the starts that the first read leads to are marked,
    twice as many in each round. There are no more than one for each ``limit`` bases.
    """
    place = lambda pos: F.floor(F.col(pos) / limit)
    ends = reads.select((F.col("offset") + F.col("len")).alias("pos"), F.lit(1).alias("kind"), "read_id")
    goals = reads.select((F.col("offset") + limit).alias("pos"), F.lit(0).alias("kind"), "read_id")
    both = goals.unionAll(ends).withColumn("block", place("pos"))
    ahead = Window.partitionBy("block").orderBy("pos", "kind", "read_id").rowsBetween(0, Window.unboundedFollowing)
    closing = F.first(F.when(F.col("kind") == 1, F.col("read_id")), ignorenulls=True)
    found = both.withColumn("closing", closing.over(ahead)).where("kind = 0").select("read_id", "block", "closing")
    # The first end of a later block, for starts that no end of their block closes. One row for each block.
    later = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    first = both.groupBy("block").agg(F.min(F.when(F.col("kind") == 1, F.struct("pos", "read_id"))).alias("end"))
    first = first.select("block", F.first("end.read_id", ignorenulls=True).over(later).alias("next_end"))
    step = found.join(first, "block").select("read_id", (F.coalesce("closing", "next_end") + 1).alias("next"))
    step = work.keep("steps_0", step.join(reads.select(F.col("read_id").alias("next")), "next").select("read_id", "next"))
    starts = work.keep("starts_0", reads.where("read_id = 0").select("read_id"))
    number = 0
    while True:
        number += 1
        more = work.keep(f"more_{number}", starts.join(step, "read_id").select(F.col("next").alias("read_id")))
        if more.isEmpty():
            break
        starts = work.keep(f"starts_{number}", starts.unionAll(more))
        second = step.select(F.col("read_id").alias("next"), F.col("next").alias("after"))
        step = work.keep(f"steps_{number}", step.join(second, "next").select("read_id", F.col("after").alias("next")))
    marked = reads.join(starts.withColumn("__first", F.lit(1)), "read_id", "left").withColumn("__first", F.coalesce("__first", F.lit(0)))
    marked = work.keep("marked", marked)
    total = running_total(marked, F.col("__first"), [F.col("read_id")], [(id_bucket(F.col("read_id")), True)], "__v")
    return total.select(*reads.columns, (F.col("__v") - 1).alias("volume_id"))


def volume_catalog(reads: DataFrame) -> DataFrame:
    return reads.groupBy("volume_id").agg(
        F.min("read_id").alias("read_start_id"),
        F.count("*").alias("read_count"),
        F.sum("len").cast("long").alias("n_bases"),
    )


def merge_reads(*parts: DataFrame, order: tuple[str, ...] = ("read_id",)) -> DataFrame:
    """Concatenate sequence sets in the given order and number them anew.

    ``order`` sorts the rows of each part; its first column is a read id.
    """
    keys = [f"__o{i}" for i in range(len(order))]
    tagged = [
        p.select(F.lit(i).alias("__part"), *[F.col(c).alias(k) for c, k in zip(order, keys)], "seq")
        for i, p in enumerate(parts)
    ]
    merged = tagged[0]
    for part in tagged[1:]:
        merged = merged.unionByName(part)
    numbered = running_total(
        merged,
        F.lit(1),
        [F.col("__part"), *map(F.col, keys)],
        [(F.col("__part"), True), (id_bucket(F.col(keys[0])), True)],
        "__n",
    )
    return with_offsets(numbered.select((F.col("__n") - 1).alias("read_id"), "seq", F.length("seq").alias("len")))
