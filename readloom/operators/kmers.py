"""K-mer extraction, counting and indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.sequence import kmer_hash, revcomp

# How many of the most frequent k-mers are looked at one by one when guarding
# against skew; this also bounds the broadcast list.
HOT_KMERS = 1024
HOT_SAMPLE = 1024
SHARE_HITS = 64


def kmers(reads: DataFrame, k: int, stride: int = 1, hashed: bool = False) -> DataFrame:
    """All k-mers of ``seq`` at positions 0, stride, 2*stride, ...

    Every other column of ``reads`` is kept. Sequences shorter than k give no
    rows. The sequence is sliced as bytes, which costs k per slice wherever the
    slice lies; slicing a string walks it from the start.
    """
    keep = [c for c in reads.columns if c != "seq"]
    placed = (
        reads.where(F.length("seq") >= k)
        .select(*keep, F.col("seq").cast("binary").alias("__b"))
        .select(*keep, "__b", F.explode(F.sequence(F.lit(0), F.length("__b") - k, F.lit(stride))).alias("pos"))
    )
    kmer = F.substring(F.col("__b"), F.col("pos") + 1, F.lit(k)).cast("string")
    return placed.select(*keep, "pos", (kmer_hash(kmer) if hashed else kmer).alias("kmer"))


def both_strands(reads: DataFrame) -> DataFrame:
    """Each read twice: as it is (qdir 0) and reverse-complemented (qdir 1)."""
    strands = F.array(
        F.struct(F.lit(0).alias("qdir"), F.col("seq")), F.struct(F.lit(1).alias("qdir"), revcomp(F.col("seq")).alias("seq"))
    )
    return reads.select(*[c for c in reads.columns if c != "seq"], F.inline(strands))


def query_kmers(reads: DataFrame, k: int, stride: int) -> DataFrame:
    """Sampled k-mers of both strands of every query read."""
    queries = both_strands(reads.select(F.col("read_id").alias("qid"), F.col("len").alias("qsize"), "seq"))
    return kmers(queries, k, stride).withColumnRenamed("pos", "qoff")


def target_kmers(reads: DataFrame, k: int) -> DataFrame:
    """All k-mers of the target reads, with whatever is needed to place them.

    ``sref`` is where the target starts in its volume (in the whole set when
    the reads carry no volumes).
    """
    extra = [c for c in ("volume_id", "sref") if c in reads.columns]
    targets = reads.select(F.col("read_id").alias("sid"), F.col("len").alias("ssize"), *extra, "seq")
    return kmers(targets, k).withColumnRenamed("pos", "soff")


def _proposed(kmer_rows: DataFrame, key: list[str], place: list[str]) -> DataFrame:
    """The HOT_KMERS most frequent k-mers of a fixed hash sample of the rows,
    with their count in it. ``place`` tells rows apart."""
    sampled = kmer_rows.where(F.pmod(F.xxhash64(*place), F.lit(HOT_SAMPLE)) == 0)
    counts = sampled.groupBy(*key).agg(F.count("*").alias("hits"))
    return counts.orderBy(F.desc("hits"), *key).limit(HOT_KMERS)


def frequent_kmers(kmer_rows: DataFrame, max_count: int) -> DataFrame:
    """At most HOT_KMERS k-mers that really occur more than ``max_count`` times.

    A hash sample only proposes k-mers; each proposal is then counted over all
    rows. A k-mer holding a noticeable share of all rows is always proposed, so
    after removing the result no single k-mer is large.
    """
    key = _key(kmer_rows)
    proposed = _proposed(kmer_rows, key, ["sid", "soff"]).select(*key)
    counted = kmer_rows.join(F.broadcast(proposed), key, "left_semi").groupBy(*key).count()
    return counted.where(F.col("count") > max_count).select(*key)


def query_shares(queries: DataFrame) -> DataFrame:
    """How often the queries' most frequent k-mers should be split: ``shares``
    of about SHARE_HITS * HOT_SAMPLE rows each. At most HOT_KMERS rows, none
    where no k-mer is that frequent."""
    proposed = _proposed(queries, ["kmer"], ["qid", "qdir", "qoff"]).where(F.col("hits") > SHARE_HITS)
    return proposed.select("kmer", F.ceil(F.col("hits") / SHARE_HITS).cast("int").alias("shares"))


def kmer_index(kmer_rows: DataFrame, max_count: int, shares: DataFrame | None = None) -> DataFrame:
    """Target k-mer rows whose k-mer occurs at most ``max_count`` times.

    Counting is per volume when the rows carry one. The frequent k-mers leave
    through a broadcast list of bounded length before the shuffle, so no task
    receives a frequent k-mer; the exact cutoff for all others is a count over
    the shuffled rows. The result is partitioned and sorted for the seed join.

    With ``shares`` a k-mer that the queries split is here once per share
    (column ``share``). Each copy has all its rows, so counts stay right, and
    there are at most ``max_count`` of them per share.
    """
    key = _key(kmer_rows)
    frequent = frequent_kmers(kmer_rows, max_count)
    rest = kmer_rows.join(F.broadcast(frequent), key, "left_anti")
    place = ["kmer"]
    if shares is not None:
        copies = F.sequence(F.lit(0), F.coalesce(F.col("shares"), F.lit(1)) - 1)
        rest = rest.join(F.broadcast(shares), "kmer", "left").withColumn("share", F.explode(copies)).drop("shares")
        place.append("share")
    own = [c for c in key if c != "kmer"]
    counted = rest.repartition(*place).withColumn("__n", F.count("*").over(Window.partitionBy(*place, *own)))
    return counted.where(F.col("__n") <= max_count).drop("__n")


def split_queries(queries: DataFrame, shares: DataFrame) -> DataFrame:
    """Add ``share``: which copy of the index a query k-mer row is to meet."""
    of = F.pmod(F.xxhash64("qid", "qdir", "qoff"), F.coalesce(F.col("shares"), F.lit(1))).cast("int")
    return queries.join(F.broadcast(shares), "kmer", "left").withColumn("share", of).drop("shares")


def _key(kmer_rows: DataFrame) -> list[str]:
    return ["kmer", "volume_id"] if "volume_id" in kmer_rows.columns else ["kmer"]
