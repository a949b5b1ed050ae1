"""Length statistics, their report, and read splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.ids import id_bucket, running_total


def min_length(df: DataFrame, cutoff: int) -> DataFrame:
    return df.where(F.col("len") >= cutoff)


def read_counts(df: DataFrame, by: str = "file") -> DataFrame:
    """Reads and bases per file, and a row with a null file for all."""
    return df.rollup(by).agg(
        F.count("*").alias("n_reads"), F.sum("len").cast("long").alias("n_bases")
    )


def cumulative_lengths(df: DataFrame, id_col: str = "read_id") -> DataFrame:
    """Running sum of lengths, longest first."""
    return running_total(
        df.select(id_col, "len"),
        F.col("len"),
        [F.desc("len"), F.col(id_col)],
        [(F.col("len"), False), (id_bucket(F.col(id_col)), True)],
        "cum_len",
    )


def length_stats(lengths: DataFrame, cutoff: int = 0) -> DataFrame:
    """One row of twelve figures for the lengths of at least ``cutoff``.

    Everything follows from the histogram of lengths, whose size is bounded by
    the longest sequence: only that is shuffled and sorted. Thresholds are
    integer quarters of the total; the median is element n div 2 of the
    descending order.
    """
    histogram = min_length(lengths, cutoff).groupBy("len").agg(F.count("*").alias("n"))
    longest_first = Window.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    size = F.col("len").cast("long")
    steps = histogram.select(
        size.alias("len"),
        F.col("n"),
        F.sum("n").over(longest_first).alias("cum_n"),
        F.sum(F.col("n") * size).over(longest_first).alias("cum_len"),
        F.sum("n").over(everything).alias("all_n"),
        F.sum(F.col("n") * size).over(everything).alias("total"),
    )
    median = F.max(F.when(F.col("cum_n") > F.expr("all_n div 2"), F.col("len")))
    figures = [
        F.first("all_n").alias("n"),
        F.max("len").alias("max"),
        F.min("len").alias("min"),
        F.first("total").alias("total"),
        F.expr("first(total) div first(all_n)").alias("avg"),
        median.alias("median"),
    ]
    for name, goal in (("n25", "(total div 4)"), ("n50", "(total div 2)"), ("n75", "(3 * (total div 4))")):
        reached = F.expr(f"cum_len >= {goal}")
        # Sequences of this length still needed after all longer ones.
        before_n = F.col("cum_n") - F.col("n")
        missing = F.expr(f"{goal} - (cum_len - n * len)")
        needed = before_n + F.greatest(F.ceil(missing / F.col("len")), F.lit(1))
        figures.append(F.max(F.when(reached, F.col("len"))).alias(name + "_len"))
        figures.append(F.max_by(F.when(reached, needed), F.when(reached, F.col("len"))).alias(name + "_cnt"))
    # An empty input has no steps and reports nothing.
    return steps.agg(*figures).where(F.col("n").isNotNull())


def length_report(stats: DataFrame) -> DataFrame:
    """The figures as text lines, in report order."""
    # The text of the report format.
    labels = [
        ("Number of sequences:\t\t", "n"),
        ("Number of bps:\t\t\t", "total"),
        ("Max length:\t\t\t", "max"),
        ("Min length:\t\t\t", "min"),
        ("Average length:\t\t\t", "avg"),
        ("Median length:\t\t\t", "median"),
    ]
    lines = [F.concat(F.lit(label), F.format_number(col, 0)) for label, col in labels]
    for pct in (25, 50, 75):
        share = f"N{pct} stats:\t\t\t{pct}% of total sequences are contained in the "
        lines.append(
            F.concat(
                F.lit(share),
                F.format_number(f"n{pct}_cnt", 0),
                F.lit(" sequences having >= "),
                F.format_number(f"n{pct}_len", 0),
                F.lit(" bps"),
            )
        )
    return stats.select(F.posexplode(F.array(*lines)).alias("line", "value"))


def split_long(reads: DataFrame, min_len: int, max_len: int) -> DataFrame:
    """Cut reads into pieces of at most ``max_len`` bases, drop pieces shorter
    than ``min_len``, and number the rest in order."""
    pieces = (
        reads.where(F.length("seq") > 0)
        .select("read_id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - 1, F.lit(max_len))).alias("beg"))
        .select("read_id", "beg", F.col("seq").substr(F.col("beg") + 1, F.lit(max_len)).alias("seq"))
        .where(F.length("seq") >= min_len)
    )
    numbered = running_total(
        pieces,
        F.lit(1),
        [F.col("read_id"), F.col("beg")],
        [(id_bucket(F.col("read_id")), True)],
        "__n",
    )
    return numbered.select((F.col("__n") - 1).alias("id"), "read_id", "beg", "seq")
