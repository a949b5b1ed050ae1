"""FASTA and FASTQ files, plain or compressed, and FASTA output."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.functions.sequence import fasta_header

# The first character of a file gives its format.
FIRST_CHARACTER = {">": "fasta", "@": "fastq"}
# File URIs come with one or three slashes after the scheme.
ONE_SLASH = ("^file:/+", "file:/")


def formats(spark: SparkSession, paths: list[str]) -> list[tuple[str, str]]:
    """(file, format) of every file of the given files and folders, from each
    file's first line that is not empty: fasta, fastq, empty or unknown. One job;
    the list has a row for each file."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"), F.substring("value", 1, 1).alias("mark"),
    )
    first = lines.where(F.length("mark") > 0).groupBy("file").agg(F.min_by("mark", F.struct("split", "row")).alias("mark"))
    seen = {r["file"]: FIRST_CHARACTER.get(r["mark"], "unknown") for r in first.collect()}
    every = {re.sub(*ONE_SLASH, file) for file in spark.read.text(paths).inputFiles()}
    seen = {re.sub(*ONE_SLASH, file): kind for file, kind in seen.items()}
    return sorted((file, seen.get(file, "empty")) for file in every | seen.keys())


def sniff(spark: SparkSession, path: str) -> str:
    """Format of a file, or of a folder whose files have one format: fasta, fastq, empty or unknown."""
    kinds = {kind for _, kind in formats(spark, [path])} - {"empty"}
    return kinds.pop() if len(kinds) == 1 else "unknown" if kinds else "empty"


def list_paths(spark: SparkSession, list_path: str) -> list[str]:
    """Paths in a list file, one per line. The list names files, so it is
    small next to what they hold."""
    return [row[0].strip() for row in spark.read.text(list_path).collect() if row[0].strip()]


def _places(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Place in the list of each given file or folder, by its full name. One
    row per name that the caller passed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def full(path: str) -> str:
        name = jvm.org.apache.hadoop.fs.Path(path)
        return re.sub(*ONE_SLASH, name.getFileSystem(conf).makeQualified(name).toUri().toString())

    return spark.createDataFrame([(full(p), i) for i, p in enumerate(paths)], "given string, list_pos int")


def _records(
    spark: SparkSession, paths: list[str], separator: str, files: list[str] | None = None
) -> DataFrame:
    """Pieces between separators, with ``list_pos``, ``file``, their place
    ``line`` in the file (0-based) and the number of ``lines`` of the file.
    ``paths`` are those given; ``files`` are the ones among them to read.

    A task reads a file split from front to back, so a running row id orders
    the pieces of a split; the pieces of earlier splits of the file are counted
    and added. That table has one row per split.
    """
    rows = (
        spark.read.option("lineSep", separator)
        .text(paths if files is None else files)
        .select(
            F.regexp_replace("_metadata.file_path", *ONE_SLASH).alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("row"),
            "value",
        )
    )
    folder = F.regexp_replace("file", "/[^/]*$", "")
    places = F.broadcast(_places(spark, paths))
    by_file = rows.join(places.withColumnRenamed("given", "file"), "file", "left")
    by_folder = places.select(F.col("given").alias("folder"), F.col("list_pos").alias("folder_pos"))
    rows = (
        by_file.withColumn("folder", folder)
        .join(F.broadcast(by_folder), "folder", "left")
        .withColumn("list_pos", F.coalesce("list_pos", "folder_pos", F.lit(0)))
        .drop("folder", "folder_pos")
    )
    key = ["list_pos", "file", "split"]
    before = (
        Window.partitionBy("list_pos", "file").orderBy("split").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    splits = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("row").alias("first")).select(
        *key, "first", (F.sum("n").over(before) - F.col("n")).alias("start"),
        F.sum("n").over(Window.partitionBy("list_pos", "file")).alias("lines"),
    )
    placed = rows.join(splits, key)
    return placed.select(
        "list_pos", "file", (F.col("start") + F.col("row") - F.col("first")).alias("line"), "lines", "value"
    )


def _header(text: Column) -> list[Column]:
    """Name and comment of a header line without its mark."""
    parts = F.split(text, r"\s", 2)
    return [parts[0].alias("name"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("comment")]


def read_fasta(spark: SparkSession, paths: list[str], files: list[str] | None = None) -> DataFrame:
    """A record reaches from one header mark at a line start to the next."""
    records = _records(spark, paths, "\n>", files)
    body = F.regexp_replace("value", "^>", "")
    lines = F.split(F.regexp_replace(body, "\r", ""), "\n", 2)
    return records.where(F.length("value") > 0).select(
        "list_pos", "file", F.col("line").alias("record"),
        *_header(lines[0]),
        F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), "\n", "").alias("seq"),
        F.lit(None).cast("string").alias("qual"),
    )


def read_fastq(spark: SparkSession, paths: list[str], files: list[str] | None = None) -> DataFrame:
    """Records of four lines. A last record that is cut short is left out; any
    other record that is not of this form is an error that names it, so none is lost."""
    lines = _records(spark, paths, "\n", files).select(
        "list_pos", "file", F.expr("line div 4").alias("record"), (F.col("line") % 4).alias("part"), "lines",
        F.regexp_replace("value", "\r$", "").alias("value"),
    )

    def part(i: int) -> Column:
        return F.max(F.when(F.col("part") == i, F.col("value")))

    records = lines.groupBy("list_pos", "file", "record").agg(
        part(0).alias("head"), part(1).alias("seq"), part(2).alias("plus"), part(3).alias("qual"), F.max("lines").alias("lines")
    )
    qual = F.coalesce("qual", F.lit(""))
    whole = F.col("head").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length(qual))
    blank = F.concat_ws("", "head", "seq", "plus", "qual") == ""
    # Lines after the last record may be empty; the last record may be cut.
    last = (F.col("record") + 1) * 4 >= F.col("lines")
    cut = last & F.col("head").startswith("@") & (F.length(qual) < F.length(F.coalesce("seq", F.lit("")))) & F.coalesce(F.col("plus").startswith("+"), F.lit(True))
    message = F.concat(F.lit("not a FASTQ record of four lines: record "), F.col("record").cast("string"), F.lit(" of "), F.col("file"))
    kept = F.when(F.coalesce(whole, F.lit(False)), True).when(F.coalesce(cut, F.lit(False)) | blank, False)
    records = records.withColumn("kept", kept.otherwise(F.raise_error(message).cast("boolean")))
    return records.where("kept").select(
        "list_pos", "file", "record", *_header(F.substring("head", 2, 1 << 30)), "seq", "qual"
    )


def read_sequences(spark: SparkSession, paths: str | list[str], format: str = "auto") -> DataFrame:
    """Sequences of files or folders, in list order.

    Columns list_pos, file, record (place in the file), name, comment, seq,
    qual. An empty file gives no rows. ``auto`` looks at every file first, so
    folders may hold both formats. All files of a format are one scan.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if len(set(paths)) < len(paths):
        raise ValueError("a path is given twice")
    if format != "auto":
        return (read_fasta if format == "fasta" else read_fastq)(spark, paths)
    kinds = formats(spark, paths)
    unknown = [file for file, kind in kinds if kind == "unknown"]
    if unknown:
        raise ValueError(f"neither FASTA nor FASTQ: {unknown}")
    fasta = [file for file, kind in kinds if kind == "fasta"]
    fastq = [file for file, kind in kinds if kind == "fastq"]
    found = [read(spark, paths, files) for read, files in ((read_fasta, fasta), (read_fastq, fastq)) if files]
    if not found:
        return read_fasta(spark, paths)
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def with_ordinal(sequences: DataFrame) -> DataFrame:
    """Add ``ordinal``, increasing in list, file and record order."""
    counts = sequences.groupBy("list_pos", "file").agg((F.max("record") + 1).alias("n"))
    order = Window.orderBy("list_pos", "file").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per file.
    starts = counts.select("list_pos", "file", (F.sum("n").over(order) - F.col("n")).alias("start"))
    return sequences.join(starts, ["list_pos", "file"]).withColumn("ordinal", F.col("start") + F.col("record"))


def to_fasta(records: DataFrame) -> DataFrame:
    """Corrected or raw records as text: header and sequence in one value."""
    header = fasta_header(F.col("id"), F.col("org_size"), F.col("left"), F.col("right"), F.col("seq"))
    return records.select(F.concat_ws("\n", header, F.col("seq")).alias("value"))


def write_fasta(records: DataFrame, path: str) -> None:
    to_fasta(records.sortWithinPartitions("id", "left")).write.text(path)
