"""Coverage and interval operators on half-open [beg, end) spans per target.

Every window here runs over positions of one target after equal positions have
been summed, so its size is bounded by the target's length, not by how many
alignments the target has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coverage(spans: DataFrame) -> DataFrame:
    """Maximal stretches between span ends, with their coverage above 0."""
    ends = F.array(
        F.struct(F.col("beg").alias("pos"), F.lit(1).alias("step")),
        F.struct(F.col("end").alias("pos"), F.lit(-1).alias("step")),
    )
    steps = spans.select("sid", F.inline(ends)).groupBy("sid", "pos").agg(F.sum("step").alias("step"))
    order = Window.partitionBy("sid").orderBy("pos")
    segments = steps.select(
        "sid",
        F.col("pos").alias("beg"),
        F.lead("pos").over(order).alias("end"),
        F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("cov"),
    )
    return segments.where(F.col("cov") > 0)


def islands(segments: DataFrame, min_cov: int, min_len: float) -> DataFrame:
    """Maximal runs with coverage of at least ``min_cov``, of this length or more."""
    order = Window.partitionBy("sid").orderBy("beg")
    covered = segments.where(F.col("cov") >= min_cov)
    starts = covered.withColumn(
        "__new", F.when(F.lag("end").over(order) == F.col("beg"), F.lit(0)).otherwise(F.lit(1))
    )
    runs = starts.withColumn(
        "__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    merged = runs.groupBy("sid", "__run").agg(F.min("beg").alias("beg"), F.max("end").alias("end")).drop("__run")
    return merged.where(F.col("end") - F.col("beg") >= min_len)


def gaps(intervals: DataFrame, sizes: DataFrame, min_len: int = 1000) -> DataFrame:
    """Stretches of each target in no interval, of ``min_len`` or more.

    ``sizes`` has (sid, size) for every target; a target without intervals is
    one gap. Intervals of a target must not overlap.
    """
    edge = sizes.select("sid", F.col("size").alias("beg"), F.col("size").alias("end"))
    order = Window.partitionBy("sid").orderBy("beg", "end")
    cut = intervals.select("sid", "beg", "end").union(edge)
    between = cut.select("sid", F.coalesce(F.lag("end").over(order), F.lit(0)).alias("beg"), F.col("beg").alias("end"))
    return between.where((F.col("end") - F.col("beg") >= min_len) & (F.col("end") > F.col("beg")))


def full_regions(regions: DataFrame, deep: DataFrame, slack: int = 200) -> DataFrame:
    """Add ``is_full``: all but ``slack`` positions of [beg, end) lie in ``deep``
    segments (sid, beg, end), those of sufficient coverage.

    Region ends are reduced to their distinct positions and merged with the
    segment starts; a running sum gives the covered positions left of each, and
    two equi-joins bring the counts back.
    """
    points = (
        regions.select("sid", F.explode(F.array("beg", "end")).alias("pos"))
        .groupBy("sid", "pos")
        .agg(F.lit(None).cast("int").alias("seg_end"))
    )
    full = deep.select("sid", F.col("beg").alias("pos"), F.col("end").cast("int").alias("seg_end"))
    # A segment that starts at a point counts from that point on.
    order = Window.partitionBy("sid").orderBy(F.col("pos"), F.col("seg_end").asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = points.unionByName(full).select(
        "sid",
        "pos",
        "seg_end",
        F.coalesce(F.sum(F.col("seg_end") - F.when(F.col("seg_end").isNotNull(), F.col("pos"))).over(before), F.lit(0)).alias("done"),
        F.coalesce(F.last("seg_end", ignorenulls=True).over(before), F.lit(0)).alias("open_end"),
    )
    left_of = merged.where(F.col("seg_end").isNull()).select(
        "sid", "pos", (F.col("done") - F.greatest(F.col("open_end") - F.col("pos"), F.lit(0))).alias("covered")
    )
    at_beg = left_of.select("sid", F.col("pos").alias("beg"), F.col("covered").alias("__c1"))
    at_end = left_of.select("sid", F.col("pos").alias("end"), F.col("covered").alias("__c2"))
    joined = regions.join(at_beg, ["sid", "beg"]).join(at_end, ["sid", "end"])
    full_enough = F.col("__c2") - F.col("__c1") + slack >= F.col("end") - F.col("beg")
    return joined.withColumn("is_full", full_enough).select(*regions.columns, "is_full")


BASES_OF_TASK = 16_000_000


def locate(points: DataFrame, reads: DataFrame, bin_size: int = 65536) -> DataFrame:
    """Read that holds each global offset: a range join through offset bins.

    Points stream past the reads of their task's bins, a hash table, and are not sorted;
    there are so many tasks that each has the reads of about BASES_OF_TASK bases.
    """
    spans = reads.where(F.col("len") > 0).select(
        "read_id",
        F.col("offset").alias("__beg"),
        (F.col("offset") + F.col("len")).alias("__end"),
    )
    binned = spans.withColumn(
        "__bin", F.explode(F.sequence(F.floor(F.col("__beg") / bin_size), F.floor((F.col("__end") - 1) / bin_size)))
    )
    keyed = points.withColumn("__bin", F.floor(F.col("goff") / bin_size))
    inside = (F.col("goff") >= F.col("__beg")) & (F.col("goff") < F.col("__end"))
    spark = reads.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    n = max(least, (reads.agg(F.sum("len")).first()[0] or 0) // BASES_OF_TASK + 1)
    met = keyed.repartition(n, "__bin").join(binned.repartition(n, "__bin").hint("shuffle_hash"), "__bin")
    return met.where(inside).select(*points.columns, "read_id")


def identity_samples(alignments: DataFrame, n: int = 10) -> DataFrame:
    """Up to ``n`` identities per target in rank order.

    Good overlaps first; a target with fewer than n of them uses its long-span
    alignments instead. Needs sid, rn, ident, good, long.
    """
    order = Window.partitionBy("sid").orderBy("rn")

    def first_n(flag: str) -> DataFrame:
        picked = alignments.where(F.col(flag)).withColumn("__k", F.row_number().over(order))
        return picked.where(F.col("__k") <= n).select("sid", "rn", "ident")

    good = first_n("good")
    enough = good.groupBy("sid").count().where(F.col("count") == n).select("sid")
    return good.join(enough, "sid", "left_semi").union(first_n("long").join(enough, "sid", "left_anti"))


def identity_cutoff(samples: DataFrame) -> DataFrame:
    """Mean identity minus five population deviations, from five samples up."""
    stats = samples.groupBy("sid").agg(
        F.count("*").alias("n"),
        F.avg("ident").alias("avg"),
        (F.avg("ident") - 5 * F.stddev_pop("ident")).alias("cutoff"),
    )
    return stats.where(F.col("n") >= 5)
