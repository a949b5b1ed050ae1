"""Read files that arrive, and the stored index that they meet."""

import gzip
import os

import numpy as np
import pytest
from conftest import planted_reads, rows
from pyspark.sql import functions as F

from readloom.operators import kmers
from readloom.operators.index import StoredIndex
from readloom.options import MapOptions
from readloom.plans import jobs
from readloom.streaming.mapping import stream_files

SEEDS = ["qid", "qdir", "sid", "qoff", "soff", "qsize", "ssize", "volume_id", "sref"]
OPTS = MapOptions(kmer_size=11, max_kmer_count=50, min_align_size=200)


@pytest.fixture(scope="module")
def planted():
    return planted_reads(np.random.default_rng(5), 6000, 24, 500, 900, 0.08)


@pytest.fixture(scope="module")
def targets(spark, planted):
    genome = planted[0]
    parts = [(i, genome[at : at + 2500]) for i, at in enumerate(range(0, 6000, 2000))] + [(9, "ACG")]
    return jobs.build_reads(spark.createDataFrame(parts, "item long, seq string"), "item")


@pytest.fixture(scope="module")
def reads(spark, planted):
    return jobs.build_reads(spark.createDataFrame([(i, s) for i, s, *_ in planted[1]], "item long, seq string"), "item")


def fasta(path, some):
    path.write_text("".join(f">r{i} a comment\n{s[:70]}\n{s[70:].lower()}\n" for i, s, *_ in some))


def fastq_gz(path, some):
    with gzip.open(path, "wt") as out:
        out.write("".join(f"@r{i}\n{s}\n+\n{'@' * len(s)}\n" for i, s, *_ in some))


def test_files_that_arrive_in_turn(spark, work, tmp_path, planted, targets, reads):
    """Two formats and an empty file, in a second folder too; what was mapped before is not read again."""
    index = jobs.store_index(targets, OPTS, work.path("index"))
    folder, out = tmp_path / "in", work.path("out")
    (folder / "deep").mkdir(parents=True)

    def run(files_per_batch):
        def mapped(batch):
            return jobs.map_to_reference(batch, targets, OPTS, index)

        stream_files(spark, str(folder), mapped, out, work.path("progress"), files_per_batch).awaitTermination()
        found, names = spark.read.parquet(f"{out}/found"), spark.read.parquet(f"{out}/reads")
        assert sorted(r["read_id"] for r in names.collect()) == list(range(names.count()))
        named = found.join(names.select(F.col("read_id").alias("qid"), "name"), "qid")
        return rows(named.withColumn("qid", F.substring("name", 2, 9).cast("long")).drop("name", "batch"))

    some = planted[1]
    fasta(folder / "a.fa", some[:7])
    fastq_gz(folder / "b.fq.gz", some[7:12])
    run(1)
    fastq_gz(folder / "deep" / "c.fq.gz", some[12:20])
    fasta(folder / "d.fa", some[20:])
    (folder / "none.fa").write_text("")
    got = run(5)
    want = rows(jobs.map_to_reference(reads, targets, OPTS))
    order = jobs.map_to_reference(reads, targets, OPTS).columns
    found = spark.read.parquet(f"{out}/found")
    at = [found.drop("batch").columns.index(c) for c in order]
    assert len(want) > 10 and sorted(tuple(r[k] for k in at) for r in got) == want
    before = {f for _, _, files in os.walk(out.removeprefix("file://")) for f in files}
    assert run(5) == got and {f for _, _, files in os.walk(out.removeprefix("file://")) for f in files} == before


def test_index_is_not_moved(spark, work, targets, reads):
    """Equal seeds from the stored index, also in a session that only knows its path, and a plan that
    shuffles the queries alone."""
    want = rows(jobs.seeds(reads, OPTS, targets), *SEEDS)
    stored, stored_reads = jobs.store_index(targets, OPTS, work.path("index")), work.keep("reads", reads)
    for index in (stored, StoredIndex.open(spark, work.path("index"))):
        found = index.seeds(reads, OPTS)
        assert rows(found, *SEEDS) == want and len(want) > 100
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            plan = index.seeds(stored_reads, OPTS)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        join = plan[plan.index("SortMergeJoin") :]
        assert join.count("Exchange") == 1 and "Bucketed: true" in join
    with pytest.raises(ValueError, match="11 bases"):
        stored.seeds(reads, MapOptions())


def test_hot_queries_meet_the_index(spark, work, targets, reads, monkeypatch):
    """K-mers that are frequent among the queries stay where they are, with the same seeds."""
    stored = jobs.store_index(targets, OPTS, work.path("index"))
    want = rows(stored.seeds(reads, OPTS), *SEEDS)
    monkeypatch.setattr(kmers, "HOT_SAMPLE", 1)
    monkeypatch.setattr(kmers, "SHARE_HITS", 1)
    found = stored.seeds(reads, OPTS)
    assert "Union" in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found, *SEEDS) == want
