"""The user-facing jobs, composed of operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.sequence import normalize, on_strand, target_window
from readloom.operators.alignment import align_pairs, attach_sequences, with_windows
from readloom.operators.candidates import mirror, top_candidates, with_partition
from readloom.operators.chaining import chain_blocks
from readloom.operators.consensus import consensus
from readloom.operators.extension import extend_in_rounds, to_overlaps
from readloom.operators.ids import assign_volumes, merge_reads, placed_reads
from readloom.operators.index import StoredIndex
from readloom.operators.kmers import query_kmers, target_kmers
from readloom.operators.packed import BY_VOLUME, Gathered, gathering, self_seeds
from readloom.operators.seeds import find_seeds
from readloom.operators.stats import length_report, length_stats, split_long
from readloom.options import FAST, SENSITIVE, ConsensusOptions, MapOptions, PartitionOptions
from readloom.schemas import CANDIDATES
from readloom.session import Workspace, in_runs
from readloom.sources.sequences import list_paths, read_sequences, with_ordinal


def build_reads(sequences: DataFrame, key: str = "ordinal") -> DataFrame:
    """Number sequences by a unique integer key and place them end to end."""
    return placed_reads(sequences.select(key, normalize(F.col("seq")).alias("seq")), key)


def build_reads_from(spark: SparkSession, paths: str | list[str], is_list: bool = False) -> DataFrame:
    """The read set of files or folders, or of the files that a list file names."""
    paths = list_paths(spark, paths) if is_list else paths
    return build_reads(with_ordinal(read_sequences(spark, paths)))


def placed_targets(reads: DataFrame, volume_size: int) -> DataFrame:
    """Reads with their volume and where they start in it, ``sref``. Both
    follow from the read's own offset, so nothing is joined or shuffled."""
    return assign_volumes(reads, volume_size).withColumn("sref", F.col("offset") - F.col("volume_id") * volume_size)


def undivided(targets: DataFrame) -> DataFrame:
    """Separate targets are one set whatever its size: cutoff and ranks are over all of it."""
    return targets.withColumns({"volume_id": F.lit(0).cast("long"), "sref": F.col("offset")})


def seeds(reads: DataFrame, opts: MapOptions, targets: DataFrame | None = None) -> DataFrame:
    """Seeds of all reads against each other, or against separate targets."""
    if targets is None:
        return self_seeds(placed_targets(reads, opts.volume_size), opts.kmer_size, opts.stride, opts.max_kmer_count)
    queries = query_kmers(reads, opts.kmer_size, opts.stride)
    return find_seeds(queries, target_kmers(undivided(targets), opts.kmer_size), opts.max_kmer_count, pairwise=False)


def seeds_by_query(reads: DataFrame, opts: MapOptions, order: tuple[str, ...] = BY_VOLUME) -> Gathered:
    """Seeds of all reads against each other, gathered by query for the operators that take them so."""
    placed = placed_targets(reads, opts.volume_size)
    return gathering(placed, opts.kmer_size, opts.stride, opts.max_kmer_count, order)


def store_index(targets: DataFrame, opts: MapOptions, path: str) -> StoredIndex:
    """The k-mer index of separate targets as files, for reads that come later."""
    return StoredIndex.build(undivided(targets), opts, path)


def find_candidates(reads: DataFrame, opts: MapOptions = MapOptions()) -> DataFrame:
    """Candidate pairs of a read set, the best ``num_output`` per query and
    target volume."""
    found = chain_blocks(seeds_by_query(reads, opts), opts, gathered=True)
    return top_candidates(found, ["qid", "volume_id"], opts.num_output).select(*CANDIDATES.names)


def find_overlaps(reads: DataFrame, opts: MapOptions = MapOptions()) -> DataFrame:
    """Aligned overlaps of a read set."""
    found = chain_blocks(seeds_by_query(reads, opts), opts, gathered=True)
    best = top_candidates(found, ["qid", "volume_id"], opts.num_candidates)

    def align(some: DataFrame) -> DataFrame:
        return align_pairs(attach_sequences(some, reads), opts.error, opts.min_align_size)

    return to_overlaps(extend_in_rounds(best, align, Workspace(reads.sparkSession)))


def map_to_reference(
    reads: DataFrame, targets: DataFrame, opts: MapOptions = MapOptions(), index: StoredIndex | None = None
) -> DataFrame:
    """Aligned overlaps of reads with target sequences.

    Only the target stretch that the query can reach from the anchor travels
    with a candidate, cut out of tiles of the target. A stored ``index`` of the targets
    is used as it is.
    """
    found = chain_blocks(seeds(reads, opts, targets) if index is None else index.seeds(reads, opts), opts)
    best = top_candidates(found, ["qid", "volume_id"], opts.num_candidates)
    query = reads.select(F.col("read_id").alias("qid"), F.col("seq").alias("__q"))

    def align(some: DataFrame) -> DataFrame:
        placed = some.select("*", *[col.alias(name) for name, col in target_window().items()])
        cut = with_windows(placed, targets).join(query, "qid")
        cut = cut.withColumn("qseq", on_strand(F.col("__q"), F.col("qdir"))).drop("__q")
        local = cut.withColumn("anchor", F.col("soff")).withColumn("soff", F.col("srel"))
        aligned = align_pairs(local, opts.error, opts.min_align_size)
        return aligned.select(
            *some.drop("soff").columns,
            F.col("anchor").alias("soff"),
            "a_qoff",
            "a_qend",
            (F.col("a_soff") + F.col("sfrom")).alias("a_soff"),
            (F.col("a_send") + F.col("sfrom")).alias("a_send"),
            "ident",
        )

    return to_overlaps(extend_in_rounds(best, align, Workspace(reads.sparkSession)))


def mirror_partition(cands: DataFrame, opts: PartitionOptions = PartitionOptions()) -> DataFrame:
    """Candidates under both reads, with the batch of their target in ``pid``."""
    return with_partition(mirror(cands), opts.batch_size)


def correct_once(
    reads: DataFrame,
    work: Workspace,
    map_opts: MapOptions = MapOptions(),
    cns_opts: ConsensusOptions = ConsensusOptions(),
) -> tuple[DataFrame, DataFrame]:
    """One round: candidates, both sides, consensus. Each stage is a table, and
    one that an earlier run finished is read instead of made."""
    cands = work.stage("candidates", lambda: mirror_partition(find_candidates(reads, map_opts)))
    inner = Workspace(work.spark, work.path("consensus"))
    if not (work.finished("corrected") and work.finished("raw")):
        corrected, raw = consensus(reads, cands.drop("pid"), cns_opts, inner)
        work.keep("corrected", corrected)
        work.keep("raw", raw)
    read = work.spark.read.parquet
    return read(work.path("corrected")), read(work.path("raw"))


def correct(
    reads: DataFrame,
    n_iter: int,
    work: Workspace,
    sensitive: MapOptions = SENSITIVE,
    fast: MapOptions = FAST,
    cns_opts: ConsensusOptions = ConsensusOptions(),
    later_cns_opts: ConsensusOptions | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Repeated correction. The first round searches sensitively, later ones
    fast, and may have consensus options of their own; all but the last keep reads whole. The next round's reads are the
    corrected ones followed by the raw ones, numbered anew."""
    for round_ in range(1, n_iter + 1):
        here = Workspace(work.spark, work.path(f"round-{round_}"))
        stored = here.stage("reads", lambda reads=reads: in_runs(reads))
        corrected, raw = correct_once(
            stored,
            here,
            sensitive if round_ == 1 else fast,
            replace(cns_opts if round_ == 1 else later_cns_opts or cns_opts, full_consensus=round_ < n_iter),
        )
        if round_ < n_iter:
            reads = merge_reads(corrected, raw, order=("id", "left"))
    return corrected, raw


def report_lengths(lengths: DataFrame, cutoff: int = 0) -> DataFrame:
    return length_report(length_stats(lengths, cutoff))


__all__ = [
    "build_reads",
    "build_reads_from",
    "correct",
    "correct_once",
    "find_candidates",
    "find_overlaps",
    "length_stats",
    "map_to_reference",
    "mirror_partition",
    "read_sequences",
    "report_lengths",
    "split_long",
    "store_index",
]
