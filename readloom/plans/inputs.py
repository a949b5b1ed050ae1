"""Read sets and derived inputs made from the text tables.

Every character of a text gives one base, and every text is a read. Texts share
passages and near copies, so their sequences overlap as reads do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.functions.sequence import project_text
from readloom.operators.candidates import mirror
from readloom.operators.chaining import band_chains
from readloom.operators.intervals import coverage, gaps, islands
from readloom.operators.kmers import kmers
from readloom.operators.packed import BY_TARGET, Gathered
from readloom.options import MapOptions
from readloom.plans.jobs import build_reads, seeds, seeds_by_query
from readloom.session import Workspace

# Longer k-mers than the default, and fewer of a kind, as whole texts are used.
OPTS = MapOptions(kmer_size=15, max_kmer_count=50)
VOTERS = 25  # reads that vote on one target

_stored: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projected(spark: SparkSession, sf_dir: str, name: str, key: str, column: str) -> DataFrame:
    return table(spark, sf_dir, name).select(key, project_text(F.col(column)).alias("seq"))


def reads_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of the documents table, not stored."""
    return build_reads(projected(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")


def targets_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target sequences of the benchmark table, not stored."""
    return build_reads(projected(spark, sf_dir, "benchmark", "item_id", "text"), "item_id")


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer target sequences of the pages table, not stored."""
    return build_reads(projected(spark, sf_dir, "pages", "page_id", "html"), "page_id")


def stored(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A read set as a table in the shared folder, written once per session.

    Searching starts from a stored read set, as every job on files would.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = Workspace(spark).keep(name, make(spark, sf_dir))
    return _stored[key]


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "reads", reads_of)


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "targets", targets_of)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "pages", pages_of)


def read_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds(reads(spark, sf_dir), OPTS)


def gathered_seeds(spark: SparkSession, sf_dir: str, order: tuple[str, ...] = BY_TARGET) -> Gathered:
    return seeds_by_query(reads(spark, sf_dir), OPTS, order)


def read_kmers(spark: SparkSession, sf_dir: str, stride: int = 1) -> DataFrame:
    """K-mers as rows, in one pass over the reads, which are not stored for it."""
    return kmers(reads_of(spark, sf_dir).select("read_id", "seq"), OPTS.kmer_size, stride)


def candidates_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by simplified chaining, which SQL elsewhere can repeat."""
    return band_chains(gathered_seeds(spark, sf_dir), OPTS.kmer_size, OPTS.min_block_score, gathered=True)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a table: later stages start from stored candidates."""
    return stored(spark, sf_dir, "candidates", candidates_of)


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate chains taken as overlaps; the share of the chain's query span
    that the score explains stands for the identity."""
    chained = candidates(spark, sf_dir)
    return chained.select(
        "qid", "sid", (100.0 * F.col("score") / (F.col("qend") - F.col("qbeg"))).alias("ident_perc"),
        F.col("score").alias("vscore"), "qdir", F.col("qbeg").alias("qoff"), "qend", F.col("qoff").alias("qext"),
        "qsize", "sdir", F.col("sbeg").alias("soff"), "send", F.col("soff").alias("sext"), "ssize",
    )


def best_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best one of each pair of reads and strand."""
    order = Window.partitionBy("qid", "qdir", "sid").orderBy(F.desc("vscore"), "qext", "sext", "qoff", "soff")
    return overlaps(spark, sf_dir).withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered target spans of candidates under both reads."""
    both = mirror(candidates(spark, sf_dir))
    return both.select("sid", F.col("sbeg").alias("beg"), F.col("send").alias("end"))


MIN_COV, MIN_ISLAND, MIN_GAP = 10, 200, 100


def covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands(coverage(spans(spark, sf_dir)), MIN_COV, MIN_ISLAND)


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select(F.col("read_id").alias("sid"), F.col("len").alias("size"))


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well covered stretches of reads, as records."""
    return _cut(spark, sf_dir, covered(spark, sf_dir))


def rests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other stretches, as records."""
    return _cut(spark, sf_dir, gaps(covered(spark, sf_dir), sizes(spark, sf_dir), MIN_GAP))


def _cut(spark: SparkSession, sf_dir: str, stretches: DataFrame) -> DataFrame:
    joined = stretches.join(reads(spark, sf_dir).withColumnRenamed("read_id", "sid"), "sid")
    return joined.select(
        F.col("sid").alias("id"), F.col("len").alias("org_size"), F.col("beg").alias("left"), F.col("end").alias("right"),
        F.col("seq").substr(F.col("beg") + 1, F.col("end") - F.col("beg")).alias("seq"),
    )


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned string pairs over whole reads: gaps put into both copies of a
    read by two patterns that never meet. Several reads vote on one target."""
    source = reads(spark, sf_dir)
    return source.select(
        F.expr(f"read_id div {VOTERS}").alias("sid"),
        F.col("read_id").alias("aln_id"),
        F.lit(0).alias("beg"),
        F.regexp_replace("seq", "AGA", "A-A").alias("qaln"),
        F.regexp_replace("seq", "TGT", "T-T").alias("taln"),
        F.lit(1.0).alias("weight"),
    )
