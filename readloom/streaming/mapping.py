"""Mapping of arriving read files against a fixed k-mer index.

``stream_files`` takes FASTA and FASTQ files as they appear in a folder, plain or
compressed. The stream itself is one of file names; each batch reads its files
with the batch reader, so records are put together across lines and splits
and errors name their file. The other functions take reads that are tables already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from readloom.functions.sequence import normalize
from readloom.operators.ids import dense_ids
from readloom.operators.kmers import query_kmers
from readloom.operators.seeds import seed_join
from readloom.options import MapOptions
from readloom.sources.sequences import read_sequences, with_ordinal

READ_FILES = "read_id long, seq string, len int"


def arriving_reads(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Reads from Parquet files that appear in a folder (read_id, seq, len)."""
    return spark.readStream.schema(READ_FILES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_seeds(
    spark: SparkSession, path: str, index: DataFrame, sink: str, progress: str, opts: MapOptions
) -> StreamingQuery:
    """Seeds of all files now in the folder, as a stream-static join on k-mers.

    No state is kept: a read's seeds depend on that read and the index only.
    """
    queries = query_kmers(arriving_reads(spark, path), opts.kmer_size, opts.stride)
    found = seed_join(queries, index, pairwise=False).select("qid", "qdir", "sid", "qoff", "soff")
    return (
        found.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


def stream_map(
    spark: SparkSession,
    path: str,
    map_batch: Callable[[DataFrame], DataFrame],
    sink: str,
    progress: str,
) -> StreamingQuery:
    """Run a batch mapping job on each batch of arriving reads.

    A batch's result goes to its own folder, so a repeated batch replaces
    itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        map_batch(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return (
        arriving_reads(spark, path)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, path: str, files_per_batch: int) -> DataFrame:
    """Names of files that appear in a folder or below it. Only names: the contents are not read here."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true")
    return files.option("maxFilesPerTrigger", files_per_batch).load(path).select("path")


def stream_files(
    spark: SparkSession,
    path: str,
    map_batch: Callable[[DataFrame], DataFrame],
    sink: str,
    progress: str,
    files_per_batch: int = 100,
) -> StreamingQuery:
    """Map the reads of FASTA and FASTQ files as they arrive.

    Reads are numbered on from batch to batch, in order of file name and place
    within a batch. ``map_batch`` gets read_id, seq and len. Each batch has a folder
    of its own in two tables, ``reads`` (read_id, name, len, seq) and ``found``, so
    a repeated batch replaces itself and takes the same numbers again.
    """

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        paths = sorted(r["path"] for r in batch.collect())  # at most files_per_batch
        records = with_ordinal(read_sequences(session, paths)).select("ordinal", "name", normalize(F.col("seq")).alias("seq"))
        before = 0
        if number:
            earlier = session.read.option("mergeSchema", "false").parquet(f"{sink}/reads").where(F.col("batch") < number)
            before = earlier.count()
        numbered = dense_ids(records, "ordinal").select((F.col("read_id") + before).alias("read_id"), "name", F.length("seq").alias("len"), "seq")
        here = f"{sink}/reads/batch={number}"
        numbered.write.mode("overwrite").parquet(here)
        reads = session.read.schema(numbered.schema).parquet(here)
        map_batch(reads.select("read_id", "seq", "len")).write.mode("overwrite").parquet(f"{sink}/found/batch={number}")

    return (
        arriving_files(spark, path, files_per_batch)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
