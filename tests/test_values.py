"""Worked values of column functions and small operators."""

import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from readloom.functions import sequence as seq
from readloom.operators import candidates as cand
from readloom.operators import ids, intervals, stats, tags
from readloom.operators.kmers import kmer_index, kmers


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_sequence_functions(spark):
    assert value(spark, seq.revcomp(F.lit("AACGT"))) == "ACGTT"
    assert value(spark, seq.revcomp(seq.revcomp(F.lit("AACGT")))) == "AACGT"
    assert value(spark, seq.kmer_hash(F.lit("ACGT"))) == 27
    assert value(spark, seq.encode(F.lit("acGTn-"))) == "012345"
    assert value(spark, seq.decode(F.lit("01234"))) == "ACGT-"
    assert value(spark, seq.normalize(F.lit("acNt"))) == "ACAT"
    assert value(spark, seq.subseq(F.lit("AACGT"), 1, 3)) == "AC"
    assert value(spark, seq.subseq(F.lit("AACGT"), 0, 2, 1)) == "AC"
    assert value(spark, seq.subseq(F.lit("AACGT"), 1, 4, F.lit(1))) == "CGT"


def test_ddf(spark):
    def ddf(*points):
        return value(spark, seq.ddf(*[F.lit(p) for p in points]))

    assert ddf(100, 200, 140, 250) == 0.25
    assert ddf(100, 200, 100, 250) == 1.0
    assert ddf(100, 200, 140, 200) == 1.0
    assert ddf(140, 200, 100, 250) == 0.25  # crossing seeds compare alike


@pytest.mark.parametrize(
    "row, kind",
    [
        ((100, 900, 1000, 500, 1300, 3000), "contained"),
        ((500, 1300, 3000, 100, 900, 1000), "contains"),
        ((2000, 2900, 3000, 50, 950, 3000), "overlap"),
        ((1000, 2000, 3000, 1000, 2000, 3000), "none"),
    ],
)
def test_overlap_class(spark, row, kind):
    df = spark.createDataFrame([row], "qoff int, qend int, qsize int, soff int, send int, ssize int")
    got = df.select(seq.overlap_class(200), seq.good_overlap(200)).first()
    assert tuple(got) == (kind, kind != "none")


def test_target_window(spark):
    df = spark.createDataFrame([(100, 300, 500, 600)], "qoff int, qsize int, soff int, ssize int")
    got = df.select(*[c.alias(n) for n, c in seq.target_window().items()]).first()
    assert got.asDict() == {"sfrom": 370, "sto": 600, "srel": 130}


def test_cigar_and_identity(spark):
    df = spark.createDataFrame([("ACTG-A", "AC-GTT")], "qaln string, taln string")
    ops = df.select(
        seq.edit_ops(F.col("qaln"), F.col("taln")).alias("a"),
        seq.edit_ops(F.col("qaln"), F.col("taln"), True).alias("b"),
        seq.identity(F.col("qaln"), F.col("taln")).alias("ident"),
    )
    got = ops.select(seq.cigar_runs(F.col("a")), seq.cigar_runs(F.col("b")), "ident").first()
    assert got[:2] == ("2M1I1M1D1M", "2=1I1=1D1X") and got[2] == 50.0
    assert value(spark, seq.identity(F.lit(""), F.lit(""))) == 0.0


CAND = "qid long, sid long, score int, qdir int, qbeg int, qend int, qoff int, qsize int, sdir int, sbeg int, send int, soff int, ssize int"


def test_flip(spark):
    row = (7, 3, 50, 1, 10, 60, 60, 100, 0, 20, 75, 75, 90)
    df = spark.createDataFrame([row], CAND)
    assert rows(cand.flip(df)) == [(3, 7, 50, 1, 15, 70, 15, 90, 0, 40, 90, 40, 100)]
    assert rows(cand.flip(cand.flip(df))) == [row]
    forward = spark.createDataFrame([(7, 3, 50, 0, *row[4:])], CAND)
    assert rows(cand.flip(forward)) == [(3, 7, 50, 0, 20, 75, 75, 90, 0, 10, 60, 60, 100)]
    assert cand.mirror(df).count() == 2


def test_top_candidates_and_batches(spark):
    data = [(i % 3, 100 + i, 5 * (i % 7), 0, 0, 10, 10, 50, 0, 0, 10, 10, 50) for i in range(60)]
    df = spark.createDataFrame(data, CAND)
    best = cand.top_candidates(df, ["qid"], 4)
    assert best.groupBy("qid").count().where("count != 4").isEmpty()
    one_target = spark.createDataFrame([(i, 9, i % 5, *d[3:]) for i, d in enumerate(data)], CAND)
    ranked = rows(cand.rank_batches(one_target, "sid", 50), "rank", "score", "qid", "batch")
    expected = sorted(((d[2], d[0]) for d in ((i, 9, i % 5) for i in range(60))), key=lambda x: (-x[0], x[1]))
    assert [(r[1], r[2]) for r in ranked] == expected
    assert [r[3] for r in ranked] == [0] * 50 + [1] * 10


@pytest.mark.parametrize(
    "lengths, expected",
    [
        ([10, 8, 6, 4, 2], (5, 10, 2, 30, 6, 6, 10, 1, 8, 2, 6, 3)),
        ([9, 7, 5, 3], (4, 9, 3, 24, 6, 5, 9, 1, 7, 2, 5, 3)),
        ([5, 5, 5, 5], (4, 5, 5, 20, 5, 5, 5, 1, 5, 2, 5, 3)),
    ],
)
def test_length_stats(spark, lengths, expected):
    df = spark.createDataFrame([(n,) for n in lengths], "len int")
    assert tuple(stats.length_stats(df).first()) == expected


def test_length_stats_cutoff_and_empty(spark):
    df = spark.createDataFrame([(5,), (50,)], "len int")
    assert stats.length_stats(df, 10).first().n == 1
    assert stats.length_stats(df, 1000).count() == 0
    report = [r.value for r in stats.length_report(stats.length_stats(df, 10)).orderBy("line").collect()]
    assert report[0] == "Number of sequences:\t\t1" and len(report) == 9


def test_split_long(spark):
    df = spark.createDataFrame([(0, "ACGTACGTACG"), (1, "ACG"), (2, "AC")], "read_id long, seq string")
    got = rows(stats.split_long(df, 3, 5), "id", "read_id", "beg", "seq")
    assert got == [(0, 0, 0, "ACGTA"), (1, 0, 5, "CGTAC"), (2, 1, 0, "ACG")]


def test_ids_and_offsets_over_many_buckets(spark):
    keys = [3, 70_000, 5, 10**9, 200_000, 65_536]
    df = spark.createDataFrame([(k, i + 1) for i, k in enumerate(keys)], "key long, len int")
    numbered = ids.with_offsets(ids.dense_ids(df, "key"))
    by_key = sorted((k, i + 1) for i, k in enumerate(keys))
    expected, offset = [], 0
    for i, (key, size) in enumerate(by_key):
        expected.append((i, key, size, offset))
        offset += size
    assert rows(numbered, "read_id", "key", "len", "offset") == expected
    volumes = ids.assign_volumes(numbered, 5)
    assert rows(volumes, "read_id", "volume_id") == [(r[0], r[3] // 5) for r in expected]


def test_merge_reads(spark):
    a = spark.createDataFrame([(0, "AC"), (1, "G")], "read_id long, seq string")
    b = spark.createDataFrame([(0, "TTT")], "read_id long, seq string")
    assert rows(ids.merge_reads(a, b), "read_id", "seq", "offset") == [(0, "AC", 0), (1, "G", 2), (2, "TTT", 3)]


def test_coverage_islands_gaps(spark):
    spans = spark.createDataFrame([(1, 0, 10), (1, 5, 15), (1, 15, 20), (2, 3, 4)], "sid long, beg int, end int")
    cov = intervals.coverage(spans)
    assert rows(cov) == [(1, 0, 5, 1), (1, 5, 10, 2), (1, 10, 15, 1), (1, 15, 20, 1), (2, 3, 4, 1)] or rows(cov) == [
        (1, 0, 5, 1), (1, 5, 10, 2), (1, 10, 20, 1), (2, 3, 4, 1)
    ]
    total = cov.select(F.sum((F.col("end") - F.col("beg")) * F.col("cov"))).first()[0]
    assert total == 10 + 10 + 5 + 1
    assert rows(intervals.islands(cov, 1, 2), "sid", "beg", "end") == [(1, 0, 20)]
    assert rows(intervals.islands(cov, 2, 5), "sid", "beg", "end") == [(1, 5, 10)]


def test_gaps(spark):
    sizes = spark.createDataFrame([(1, 5000), (2, 1500), (3, 900), (4, 3000)], "sid long, size int")
    cut = spark.createDataFrame([(1, 1500, 3000), (4, 0, 3000)], "sid long, beg int, end int")
    got = rows(intervals.gaps(cut, sizes), "sid", "beg", "end")
    assert got == [(1, 0, 1500), (1, 3000, 5000), (2, 0, 1500)]


def test_full_regions(spark):
    deep = spark.createDataFrame([(1, 100, 400), (1, 500, 600)], "sid long, beg int, end int")
    data = [(1, 0, 400), (1, 0, 301), (1, 50, 351), (1, 450, 1000), (1, 100, 700), (2, 0, 200), (2, 0, 201)]
    got = dict(((r[0], r[1], r[2]), r[3]) for r in intervals.full_regions(
        spark.createDataFrame(data, "sid long, beg int, end int"), deep, 200).collect())
    deep_set = set(range(100, 400)) | set(range(500, 600))
    for sid, beg, end in data:
        covered = len(deep_set & set(range(beg, end))) if sid == 1 else 0
        assert got[(sid, beg, end)] == (covered + 200 >= end - beg)


def test_locate(spark):
    reads = spark.createDataFrame([(0, 0, 70_000), (1, 70_000, 0), (2, 70_000, 10)], "read_id long, offset long, len int")
    points = spark.createDataFrame([(0,), (69_999,), (70_000,), (70_009,)], "goff long")
    assert rows(intervals.locate(points, reads)) == [(0, 0), (69_999, 0), (70_000, 2), (70_009, 2)]


def test_identity_cutoff(spark):
    data = [(1, i, x, True, True) for i, x in enumerate([90.0, 92.0, 94.0, 96.0, 98.0])]
    data += [(2, i, 90.0, True, True) for i in range(4)]
    df = spark.createDataFrame(data, "sid long, rn int, ident double, good boolean, long boolean")
    got = intervals.identity_cutoff(intervals.identity_samples(df)).collect()
    assert len(got) == 1 and got[0].cutoff == pytest.approx(94 - 5 * math.sqrt(8))


def test_identity_samples_fall_back(spark):
    # Nine good ones are too few, so the long ones are used instead.
    data = [(1, i, float(i), i < 9, i >= 5) for i in range(20)]
    df = spark.createDataFrame(data, "sid long, rn int, ident double, good boolean, long boolean")
    assert [r[1] for r in rows(intervals.identity_samples(df), "sid", "rn")] == list(range(5, 15))


def test_tags_and_links(spark):
    data = [(1, 0, 10, "ACTG-", "AC-GT", 1.0), (1, 1, 10, "ACTG-", "AC-GT", 1.0), (1, 2, 11, "CG", "CG", 1.0)]
    df = spark.createDataFrame(data, "sid long, aln_id long, beg int, qaln string, taln string, weight double")
    tag_rows = tags.alignment_tags(df)
    one = rows(tag_rows.where("aln_id = 0"), "t_pos", "delta", "q_base", "p_t_pos", "p_delta", "p_q_base")
    assert one == [
        (10, 0, "A", -1, 0, "-"), (11, 0, "C", 10, 0, "A"), (11, 1, "T", 11, 0, "C"),
        (12, 0, "G", 11, 1, "T"), (13, 0, "-", 12, 0, "G"),
    ]
    link_rows = tags.links(tag_rows)
    assert rows(tags.column_stats(link_rows), "t_pos", "coverage", "n_delta") == [
        (10, 2, 1), (11, 3, 2), (12, 3, 1), (13, 2, 1)
    ]
    majority = rows(tags.column_majority(link_rows), "t_pos", "delta", "base", "votes")
    assert majority == [(10, 0, "A", 2), (11, 0, "C", 3), (11, 1, "T", 2), (12, 0, "G", 3), (13, 0, "-", 2)]


def test_long_insertion_discards_alignment(spark):
    data = [(1, 0, 0, "A" + "C" * n + "G", "A" + "-" * n + "G", 1.0) for n in (254, 255)]
    df = spark.createDataFrame([(*d[:1], i, *d[2:]) for i, d in enumerate(data)],
                               "sid long, aln_id long, beg int, qaln string, taln string, weight double")
    assert [r[0] for r in rows(tags.alignment_tags(df).select("aln_id").distinct())] == [0]


def test_kmers_short_reads_and_index(spark):
    reads = spark.createDataFrame([(0, "ACGTA"), (1, "AC"), (2, "ACGT")], "read_id long, seq string")
    got = rows(kmers(reads, 4), "read_id", "pos", "kmer")
    assert got == [(0, 0, "ACGT"), (0, 1, "CGTA"), (2, 0, "ACGT")]
    placed = kmers(reads, 4).select(F.col("read_id").alias("sid"), F.col("pos").alias("soff"), "kmer")
    assert rows(kmer_index(placed, 1), "kmer") == [("CGTA",)]


def test_index_drops_a_k_mer_with_a_third_of_all_rows(spark):
    reads = spark.createDataFrame([(i, "A" * 40 + f"{i:b}".replace("0", "C").replace("1", "GT") * 6) for i in range(300)],
                                  "sid long, seq string")
    placed = kmers(reads, 5).withColumnRenamed("pos", "soff")
    n = {r.kmer: r["count"] for r in placed.groupBy("kmer").count().collect()}
    assert n["AAAAA"] > sum(n.values()) / 3
    assert {r.kmer for r in kmer_index(placed, 50).select("kmer").distinct().collect()} == {k for k, c in n.items() if c <= 50}


def test_seeds_with_a_hot_query_k_mer(spark, monkeypatch):
    # Over a third of all query k-mers are one that the targets hold twice.
    from readloom.operators import kmers as km
    from readloom.operators.seeds import find_seeds, seed_join

    monkeypatch.setattr(km, "HOT_SAMPLE", 4)
    monkeypatch.setattr(km, "SHARE_HITS", 8)
    queries = spark.createDataFrame(
        [(i, "C" + "A" * 60 + f"{i:b}".replace("0", "C").replace("1", "GT") * 5) for i in range(150)], "read_id long, seq string"
    ).withColumn("len", F.length("seq"))
    targets = spark.createDataFrame([(0, "GAAAAAAG"), (1, "CGTGTCCGTA")], "read_id long, seq string").withColumn("len", F.length("seq"))
    asked, rows_ = km.query_kmers(queries, 5, 1), km.target_kmers(targets, 5)
    shares = km.query_shares(asked)
    assert shares.where("shares > 10").count() >= 1
    got = find_seeds(asked, rows_, 10, pairwise=False)
    want = seed_join(asked, rows_, pairwise=False)
    columns = ["qid", "qdir", "qoff", "sid", "soff"]
    assert rows(got, *columns) == rows(want, *columns) and got.count() > 10_000


def test_placed_reads_shuffle_a_sequence_once(spark):
    from readloom.plans import jobs

    seqs = ["ACGTA", "", "acgn", "T" * 300, None, "AAAC", "G"]
    keys = [5, 2**40, 70_000, 3, 4_000, 1_024, None]
    want, at = [], 0
    for i, (_, seq) in enumerate(sorted((k, s) for k, s in zip(keys, seqs, strict=True) if k is not None)):
        seq = seq if seq is None else "".join(c if c in "ACGT" else "A" for c in seq.upper())
        want.append((i, seq, seq if seq is None else len(seq), None if seq is None else at))
        at += len(seq or "")
    made = spark.createDataFrame(list(zip(keys, seqs, strict=True)), "ordinal long, seq string").repartition(3)
    found = jobs.build_reads(made)
    assert found.columns == ["read_id", "seq", "len", "offset"] and rows(found) == want
    found.collect()  # one exchange of the rows, read again for the totals of runs
    text = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in text


def test_runs_of_reads_keep_all_tasks_busy(spark):
    from readloom.plans import jobs

    made = spark.range(20_000).selectExpr("id AS ordinal", "'ACG' AS seq").coalesce(1)
    found = jobs.build_reads(made).selectExpr("spark_partition_id() AS part", "read_id", "offset").toPandas()
    assert found["part"].nunique() > 2 and (found["offset"] == 3 * found["read_id"]).all() and found["read_id"].is_unique


def test_locate_does_not_sort_points(spark):
    reads = spark.createDataFrame([(i, 1000, 1000 * i) for i in range(300)], "read_id long, len int, offset long")
    points = spark.range(0, 300_000, 7).selectExpr("id AS goff")
    found = intervals.locate(points, reads)
    assert found.where("read_id <> goff div 1000").isEmpty() and found.count() == points.count()
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in text and "Sort " not in text and "SortMergeJoin" not in text
