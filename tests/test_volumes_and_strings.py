"""Volumes closed as they fill up, and aligned strings from run-length texts, against plain versions."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from readloom.functions import sequence as seq
from readloom.operators.ids import greedy_volumes

READS = "read_id long, len int, offset long"


def plain_volumes(lengths, limit):
    out, volume, held = [], 0, 0
    for i, n in enumerate(lengths):
        out.append((i, volume))
        held += n
        if held >= limit:
            volume, held = volume + 1, 0
    return out


@pytest.mark.parametrize("kind", ["mixed", "long", "short", "none"])
def test_greedy_volumes(spark, work, kind):
    """Reads of no bases, reads longer than several volumes, and fewer bases than one volume."""
    rng = random.Random(3)
    lengths = {
        "mixed": [rng.choice([0, 0, 1, 7, 30, 99, 100, 101, 950]) for _ in range(400)], "long": [250, 1000, 0, 350, 99, 1],
        "short": [1, 2, 3], "none": [],
    }[kind]
    table = [(i, n, sum(lengths[:i])) for i, n in enumerate(lengths)]
    reads = spark.createDataFrame(table, READS).repartition(4) if table else spark.createDataFrame([], READS)
    got = greedy_volumes(work.keep("reads", reads), 100, work)
    assert rows(got, "read_id", "volume_id") == plain_volumes(lengths, 100)


def alignment(rng, size):
    q, t = "", ""
    for _ in range(size):
        kind = rng.choice("MMMMID")
        a = rng.choice("ACGT")
        q, t = q + ("-" if kind == "D" else a), t + ("-" if kind == "I" else rng.choice([a, a, "C"]))
    return q, t


def test_strings_are_the_inverse_of_texts(spark):
    rng = random.Random(8)
    pairs = [alignment(rng, rng.randrange(0, 300)) for _ in range(60)] + [("", ""), ("A" * 5000, "A" * 5000), ("AC--", "--GT")]
    df = spark.createDataFrame([(i, q, t, q.replace("-", "") + "TT", t.replace("-", "") + "G") for i, (q, t) in enumerate(pairs)], "i long, a string, b string, query string, target string")
    for extended in (False, True):
        ops = df.withColumn("ops", seq.edit_ops(F.col("a"), F.col("b"), extended))
        ops = ops.withColumn("ops", F.when(F.col("a") == "", F.array().cast("array<string>")).otherwise(F.col("ops")))
        made = ops.withColumn("cigar", seq.cigar_runs(F.col("ops"))).select("i", "cigar", "query", "target")
        got = seq.with_aligned_strings(made, "cigar", "query", "target").orderBy("i").collect()
        assert [(r["qaln"], r["taln"]) for r in got] == pairs
        assert [(r["q_used"], r["t_used"]) for r in got] == [(len(r["query"]) - 2, len(r["target"]) - 1) for r in got]


def test_texts_of_other_forms(spark):
    make = lambda cigar: spark.createDataFrame([(cigar, "ACGT", "ACG")], "c string, q string, t string")
    assert seq.with_aligned_strings(make(None), "c", "q", "t").first()["qaln"] is None
    assert tuple(seq.with_aligned_strings(make("2=1I1="), "c", "q", "t").select("qaln", "taln").first()) == ("ACGT", "AC-G")
    for bad in ("5M", "3M1N", "M", "3M x", "4D"):
        with pytest.raises(Exception, match="not a text of this alignment"):
            seq.with_aligned_strings(make(bad), "c", "q", "t").collect()


def test_running_sums(spark):
    rng = random.Random(1)
    lists = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 7, 8, 9, 64, 65, 1000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i long, v array<long>")
    got = df.select("i", seq.running_sums(F.col("v")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [[sum(v[:k]) for k in range(len(v))] for v in lists]


def test_run_lengths_look_at_runs_not_at_pairs_of_columns(spark):
    df = spark.createDataFrame([(0, ["M"]), (1, []), (2, None), (3, ["="] * 70_000 + ["X", "D", "D"] * 2), (4, list("IIMDDM"))], "i int, ops array<string>")
    made = df.select("i", seq.cigar_runs(F.col("ops")).alias("c"))
    assert [r["c"] for r in made.orderBy("i").collect()] == ["1M", "", None, "70000=1X2D1X2D", "2I1M2D1M"]
    assert "sequence(" not in made._jdf.queryExecution().analyzed().toString()
