"""Sources, sinks, stages and streaming."""

import gzip
import os

import pytest
from conftest import SMALL, rows

from readloom.operators.kmers import kmer_index, target_kmers
from readloom.options import MapOptions
from readloom.plans import inputs as inp
from readloom.plans import jobs
from readloom.session import Workspace, shared_folder
from readloom.sources import records, sequences
from readloom.streaming.mapping import stream_map, stream_seeds

FASTA = ">a first one\nACGT\nAC\n\nGT\n>b\r\nTTTT\r\n>c >d\tx\nGG"
FASTQ = "@a one\nACGT\n+\n@III\n@b\nAC\n+b\n++\n@cut\nACGT\n+\nII\n"


def write(path, text, opener=open):
    with opener(path, "wt") as f:
        f.write(text)
    return str(path)


def test_fasta(spark, tmp_path):
    path = write(tmp_path / "a.fa", FASTA)
    got = rows(sequences.read_sequences(spark, path), "record", "name", "comment", "seq")
    assert got == [(0, "a", "first one", "ACGTACGT"), (1, "b", "", "TTTT"), (2, "c", ">d\tx", "GG")]


def test_fastq_and_gzip(spark, tmp_path):
    path = write(tmp_path / "a.fq.gz", FASTQ, gzip.open)
    got = rows(sequences.read_sequences(spark, path), "name", "comment", "seq", "qual")
    assert got == [("a", "one", "ACGT", "@III"), ("b", "", "AC", "++")]


def test_list_of_files_keeps_order(spark, tmp_path):
    paths = [
        write(tmp_path / "z.fa", ">z0\nAA\n>z1\nCC\n"),
        write(tmp_path / "empty.fa", ""),
        write(tmp_path / "m.fq", "@m0\nGG\n+\nII\n"),
        write(tmp_path / "a.fa", ">a0\nTT\n"),
    ]
    listing = write(tmp_path / "list.txt", "\n".join(paths) + "\n")
    assert sequences.list_paths(spark, listing) == paths
    ordered = sequences.with_ordinal(sequences.read_sequences(spark, paths))
    assert [r.name for r in ordered.orderBy("ordinal").collect()] == ["z0", "z1", "m0", "a0"]
    reads = jobs.build_reads(ordered)
    assert rows(reads, "read_id", "seq", "offset") == [(0, "AA", 0), (1, "CC", 2), (2, "GG", 4), (3, "TT", 6)]


def test_sniff(spark, tmp_path):
    for name, text, kind in (("a", ">x\nA", "fasta"), ("b", "@x\nA\n+\nI", "fastq"), ("c", "", "empty"), ("d", "x", "unknown")):
        assert sequences.sniff(spark, write(tmp_path / name, text)) == kind
    with pytest.raises(ValueError):
        sequences.read_sequences(spark, str(tmp_path / "d"))


def test_file_in_many_splits(spark, tmp_path):
    n = 3000
    fasta = write(tmp_path / "big.fa", "".join(f">r{i}\n{'ACGT' * (i % 40 + 1)}\n" for i in range(n)))
    fastq = write(tmp_path / "big.fq", "".join(f"@r{i}\n{'A' * (i % 90 + 1)}\n+\n{'@' * (i % 90 + 1)}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for path, size in ((fasta, lambda i: 4 * (i % 40 + 1)), (fastq, lambda i: i % 90 + 1)):
            df = sequences.read_sequences(spark, path)
            got = [(r.record, r.name, len(r.seq)) for r in df.orderBy("record").collect()]
            assert got == [(i, f"r{i}", size(i)) for i in range(n)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_corrected_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(3, 100, 10, 15, "ACGTA"), (1, 9, 0, 2, "GG")], "id long, org_size int, left int, right int, seq string")
    sequences.write_fasta(df, str(tmp_path / "out"))
    got = rows(sequences.read_sequences(spark, str(tmp_path / "out")), "name", "seq")
    assert got == [("1_9_0_2_2", "GG"), ("3_100_10_15_5", "ACGTA")]


def test_records(spark, tmp_path):
    cands = inp.candidates(spark, SMALL)
    for format in ("csv", "parquet"):
        path = str(tmp_path / format)
        records.write_candidates(cands, path, format)
        assert rows(records.read_candidates(spark, path, format)) == rows(cands.drop("n_seeds"))
    path = str(tmp_path / "overlaps")
    records.write_overlaps(inp.overlaps(spark, SMALL), path)
    line = next(f for f in os.listdir(path) if f.endswith(".csv"))
    with open(os.path.join(path, line)) as f:
        parts = f.readline().rstrip("\n").split("\t")
    assert len(parts) == 14 and len(parts[2].split(".")[1]) == 2


def test_stage_runs_once(spark, work):
    runs = []

    def make():
        runs.append(1)
        return spark.range(3)

    assert work.stage("a", make).count() == 3
    assert Workspace(spark, work.folder).stage("a", make).count() == 3
    assert len(runs) == 1


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_streamed_seeds_equal_the_join(spark, work):
    reads, targets = inp.reads(spark, SMALL), inp.targets(spark, SMALL)
    folder, columns = work.path("arriving"), ["qid", "qdir", "sid", "qoff", "soff"]
    index = work.keep("index", kmer_index(target_kmers(targets, 13), 1000))
    arriving = reads.select("read_id", "seq", "len")
    for part in (0, 1):  # the second run reads only what came since
        arriving.where(f"read_id % 2 = {part}").write.mode("append").parquet(folder)
        stream_seeds(spark, folder, index, work.path("seeds"), work.path("progress"), MapOptions()).awaitTermination()
    got = spark.read.parquet(work.path("seeds"))
    assert rows(got, *columns) == rows(jobs.seeds(reads, MapOptions(), targets), *columns)


def test_streamed_mapping_equals_the_job(spark, work):
    reads, targets = inp.reads(spark, SMALL), inp.reads(spark, SMALL)
    folder = work.path("arriving")
    reads.select("read_id", "seq", "len").write.parquet(folder)
    query = stream_map(spark, folder, lambda batch: jobs.map_to_reference(batch, targets), work.path("out"), work.path("progress"))
    query.awaitTermination()
    got = spark.read.parquet(work.path("out")).drop("batch")
    want = jobs.map_to_reference(reads, targets)
    assert got.count() > 0 and rows(got) == rows(want)


def test_one_folder_of_both_formats(spark, tmp_path):
    write(tmp_path / "a.fa", ">a0\nAC\n>a1\nGG\n")
    write(tmp_path / "b.fq", "@b0\nTT\n+\nII\n")
    write(tmp_path / "empty.fa", "")
    got = sequences.with_ordinal(sequences.read_sequences(spark, str(tmp_path)))
    assert [r.name for r in got.orderBy("ordinal").collect()] == ["a0", "a1", "b0"]
    assert [k for _, k in sequences.formats(spark, [str(tmp_path)])] == ["fasta", "fastq", "empty"]


def test_records_of_other_forms_are_errors(spark, tmp_path):
    good = "@r0\nAC\n+\nII\n"
    for bad in ("@r1\nAC\nGT\n+\nII\nII\n", "r1\nAC\n+\nII\n", "@r1\nAC\n+\nIII\n", "@r1\nAC\n-\nII\n"):
        path = write(tmp_path / f"{abs(hash(bad))}.fq", good + bad + good)
        with pytest.raises(Exception, match="not a FASTQ record"):
            sequences.read_sequences(spark, path).count()
    ends = write(tmp_path / "ends.fq", good + "\n\n")
    assert sequences.read_sequences(spark, ends).count() == 1


def test_windows_of_tiles(spark):
    from readloom.operators.alignment import with_windows

    seq = "".join("ACGT"[i * i % 7 % 4] for i in range(97))
    targets = spark.createDataFrame([(0, seq), (1, "ACG")], "read_id long, seq string")
    spans = [(k, k % 2, a, b) for k, (a, b) in enumerate([(0, 97), (0, 3), (10, 11), (0, 1), (9, 21), (1, 2), (90, 97)])]
    cands = spark.createDataFrame(spans, "qid long, sid long, sfrom int, sto int")
    got = {r["qid"]: r["tseq"] for r in with_windows(cands, targets, tile=10).collect()}
    assert got == {k: (seq, "ACG")[s][a:b] for k, s, a, b in spans}
