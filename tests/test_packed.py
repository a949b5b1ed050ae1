"""Packed k-mers and tags against plain ones, and that no row is shuffled for each of them."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import random_bases, rows, text
from pyspark.sql import functions as F

from readloom.operators import packed, tags
from readloom.operators.blocks import block_counts, block_scores
from readloom.operators.chaining import band_chains, seed_steps
from readloom.operators.kmers import kmer_index, kmers, query_kmers, target_kmers
from readloom.operators.seeds import find_seeds, with_blocks
from readloom.options import ChainOptions, MapOptions
from readloom.plans import jobs
from readloom.session import in_runs

K = 7


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    base = text(random_bases(rng, 400))
    out = [base[i : i + 120] for i in range(0, 280, 20)] + [text(random_bases(rng, int(n))) for n in rng.integers(0, 200, 12)]
    return [*out, "", "ACG", "A" * 90, "T" * 300, base[::-1]]


@pytest.fixture(scope="module")
def reads(spark, texts):
    made = spark.createDataFrame(list(enumerate(texts)), "ordinal long, seq string").repartition(5)
    return jobs.build_reads(made).cache()


def test_numbers_come_back():
    rng = np.random.default_rng(1)
    arrays = [rng.integers(0, 2**bits, 50).astype(np.uint64) for bits in (1, 8, 17, 33, 60)] + [np.zeros(0, np.uint64)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, packed.unpack(packed.pack(*arrays)), strict=True))


@pytest.mark.parametrize("k", [3, 16, 17, 31])
def test_kmer_numbers(k):
    codes = random_bases(np.random.default_rng(k), 100)
    code, letters = packed.Code(k), text(codes)
    plain = code.plain(codes)
    want = [letters[i : i + k] for i in range(100 - k + 1)]
    assert code.texts(code.mixed(plain)).to_pylist() == want
    turned = [w[::-1].translate(str.maketrans("ACGT", "TGCA")) for w in want]
    assert code.texts(code.mixed(code.reverse(plain))).to_pylist() == turned
    assert (code.mixed(plain)[code.order(code.mixed(plain))] == np.sort(code.mixed(plain))).all()


def test_blocks_keep_volumes_apart(monkeypatch):
    monkeypatch.setattr(packed, "BLOCK", 10)
    seqs, volumes = ["ACGTAC", "", "ACGTACGTACGT", "GG", "CC", None], [0, 0, 0, 0, 1, 1]
    batch = pa.RecordBatch.from_pydict({"read_id": list(range(6)), "seq": seqs, "sref": [0] * 6, "volume_id": volumes})
    found = list(packed.blocks([batch.slice(0, 4), batch.slice(4)]))
    assert [i for b in found for i in b.ids.tolist()] == list(range(6)) and max(len(b.codes) for b in found) <= 18
    assert all(volumes[i] == b.volume for b in found for i in b.ids.tolist())
    assert "".join(text(b.codes) for b in found) == "".join(s or "" for s in seqs)


def test_counts(reads, texts):
    want = Counter(s[i : i + K] for s in texts for i in range(len(s) - K + 1))
    found = packed.kmer_counts(reads, K)
    assert rows(found, "kmer", "n") == sorted(want.items())
    assert "explode" not in plan(found)


def test_index(reads):
    want = rows(kmer_index(target_kmers(reads, K), 6), "kmer", "sid", "soff")
    assert rows(packed.kmer_index(reads, K, 6), "kmer", "sid", "soff") == want


@pytest.mark.parametrize("volume", [10**9, 700])
@pytest.mark.parametrize("hot", [False, True])
def test_seeds(reads, monkeypatch, volume, hot):
    if hot:  # every k-mer is hot
        monkeypatch.setattr(packed, "_hot", lambda reads, code, stride: {int(code.mixed(np.array([x], np.uint64))[0]): 3 for x in range(4**K)[::9]})
    placed = jobs.placed_targets(reads, volume)
    want = find_seeds(query_kmers(placed, K, 3), target_kmers(placed, K), 20)
    columns = sorted(want.columns)
    got = packed.self_seeds(placed, K, 3, 20)
    assert sorted(got.columns) == columns and rows(got, *columns) == rows(want, *columns)


@pytest.mark.parametrize("order", [packed.BY_TARGET, packed.BY_BLOCK, packed.BY_VOLUME])
@pytest.mark.parametrize("volume", [10**9, 700])
def test_gathered_seeds(reads, monkeypatch, order, volume):
    monkeypatch.setattr(packed, "PACK", 50)
    placed = jobs.placed_targets(reads, volume)
    want = packed.self_seeds(placed, K, 3, 20)
    got = packed.gathered_seeds(placed, K, 3, 20, order)
    columns = [c for c in want.columns if c != "sref" or order != packed.BY_TARGET]
    assert got.columns == want.columns and rows(got, *columns) == rows(want, *columns)
    keys = [{"goff": "sref + soff"}.get(c, c) for c in order]
    parts = got.selectExpr("spark_partition_id() AS part", *keys).toPandas()
    here = parts.drop_duplicates(["part", "qid"])
    assert here["qid"].is_unique
    # The groups that operators cut partitions into are whole and in order.
    group = list(order)[:-2]
    starts = (parts[group] != parts[group].shift()).any(axis=1)
    assert not parts[group][starts].duplicated().any()
    by = parts.groupby(group, sort=False)
    places = list(parts.columns[-2:])
    assert all([tuple(r) for r in g[places].to_numpy()] == sorted(tuple(r) for r in g[places].to_numpy()) for _, g in by)


def sent(reads, k, n, max_count, stride, hot):
    return packed._met(reads, packed.Code(k), n, max_count, stride, hot).toPandas()


def test_stretches_are_sent_in_place_of_kmers(spark):
    """Under 2.5 bytes a base, queries included; k-mers one by one took more than 4."""
    letters = [text(random_bases(np.random.default_rng(i), 40_000)) for i in range(10)]
    made = spark.createDataFrame(list(enumerate(letters)), "ordinal long, seq string").coalesce(1)
    found = sent(jobs.placed_targets(jobs.build_reads(made), 10**9).coalesce(1), 15, 4, 50, 10, {})
    sizes = found.groupby("bucket")["data"].agg(lambda x: sum(map(len, x)))
    assert sizes.sum() < 2.5 * 400_000
    assert len(sizes) == 4 and sizes.max() < 1.3 * sizes.min()


def test_a_very_frequent_word_is_sent_once(spark):
    word = text(random_bases(np.random.default_rng(3), 60))
    made = spark.createDataFrame([(i, word * 40 + text(random_bases(np.random.default_rng(i), 400))) for i in range(50)], "ordinal long, seq string")
    found = sent(jobs.placed_targets(jobs.build_reads(made), 10**9).coalesce(1), 15, 8, 50, 10, {})
    targets = sum(len(packed.unpack(x)[0]) + int(packed.unpack(x)[10].sum()) for x in found["data"] if len(packed.unpack(x)) > 10)
    assert targets <= 50 * 420  # of 50 * 2800
    assert sum(len(packed.unpack(x)[2]) for x in found["data"]) == 60


@pytest.mark.parametrize("k", [3, 5, 15, 31])
def test_both_strands_have_one_least_word(k):
    codes = random_bases(np.random.default_rng(k), 200)
    assert (packed.Code(k).least(codes) == packed.Code(k).least(3 - codes[::-1])[::-1]).all()


def test_operators_take_gathered_seeds(reads):
    """Chains, steps and anchors are the same, and no row is shuffled for a seed."""
    placed = jobs.placed_targets(reads, 10**9)
    plain = packed.self_seeds(placed, K, 3, 20)
    by_target, by_block = (packed.gathered_seeds(placed, K, 3, 20, order) for order in (packed.BY_TARGET, packed.BY_BLOCK))
    opts = ChainOptions(min_score=20)
    pairs = [
        (band_chains(plain, K, 3, opts), band_chains(by_target, K, 3, opts, gathered=True)),
        (seed_steps(plain), seed_steps(by_target, gathered=True)),
        (block_scores(with_blocks(plain, 100), 3, 0.25), block_scores(with_blocks(by_block, 100), 3, 0.25, gathered=True)),
    ]
    for want, got in pairs:
        assert rows(got) == rows(want) and want.count() > 0
        exchanges = got._jdf.queryExecution().executedPlan().toString()
        # Two of packed rows; the reads are cached.
        assert exchanges.split("InMemoryTableScan")[0].count("Exchange hashpartitioning(bucket") == 2
        assert exchanges.split("InMemoryTableScan")[0].count("Exchange ") == 2


def test_band_chains_are_those_of_windows(reads):
    """Against the running sums in SQL, ties and breaks included."""
    seeds_ = packed.self_seeds(jobs.placed_targets(reads, 10**9), K, 3, 20)
    seeds_.createOrReplaceTempView("found_seeds")
    want = seeds_.sparkSession.sql(
        "WITH s AS (SELECT *, soff - lag(soff) OVER w AS ds, qoff - lag(qoff) OVER w AS dq FROM found_seeds"
        " WINDOW w AS (PARTITION BY qid, qdir, sid ORDER BY soff, qoff)), b AS (SELECT *, CASE WHEN ds IS NULL OR ds > 40 OR abs(ds - dq)"
        " > 5 THEN 1 ELSE 0 END AS brk FROM s), c AS (SELECT *, sum(brk) OVER (PARTITION BY qid, qdir, sid ORDER BY soff, qoff"
        " ROWS UNBOUNDED PRECEDING) AS chain FROM b) SELECT qid, qdir, sid, min(qoff) AS qbeg, max(soff) + 7 AS send,"
        " sum(CASE WHEN brk = 1 THEN 0 ELSE least(abs(dq), ds) END) AS score, count(*) AS n_seeds FROM c GROUP BY qid, qdir, sid, chain"
    ).where("n_seeds >= 2 AND score >= 10")
    got = band_chains(seeds_, K, 2, ChainOptions(max_dist=40, bandwidth=5, min_score=10))
    assert rows(got, *want.columns) == rows(want) and want.count() > 10


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_seeds_of_a_read_set_make_no_rows_of_kmers(reads):
    found = plan(jobs.seeds(reads, MapOptions(kmer_size=K)))
    assert "explode" not in found and "window" not in found.replace("windowgroup", "").split("logicalrdd")[0].split("inmemoryrelation")[0]


def test_tags_are_neither_shuffled_nor_sorted(spark):
    df = spark.createDataFrame([(1, 1, 0, "A-C", "AG-")], "sid long, aln_id long, beg int, qaln string, taln string")
    found = tags.alignment_tags(df)
    assert rows(found, "t_pos", "delta", "q_base", "p_t_pos", "p_delta", "p_q_base") == [
        (0, 0, "A", -1, 0, "-"), (1, 0, "-", 0, 0, "A"), (1, 1, "C", 1, 0, "-")]
    text_ = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text_ and "Sort" not in text_ and "Window" not in text_


def test_links_of_first_columns_and_empty_letters(spark):
    df = spark.createDataFrame([(1, i, 3, q, q, 1.0) for i, q in enumerate(["AC", "AC", ""])],
                               "sid long, aln_id long, beg int, qaln string, taln string, weight double")
    got = rows(tags.links(tags.alignment_tags(df)), *tags.TAG_KEY, "link_count")
    assert got == [(3, 0, "", -1, 0, "-", 1), (3, 0, "A", -1, 0, "-", 2), (4, 0, "C", 3, 0, "A", 2)]


def test_stored_reads_are_dealt_in_runs(spark):
    df = spark.range(5000).selectExpr("id AS read_id", "'A' AS seq").coalesce(1)
    dealt = in_runs(df)
    assert dealt.rdd.getNumPartitions() > 1 and dealt.count() == 5000
    assert kmers(dealt, 1).count() == 5000


def test_queries_that_no_target_has_make_no_rows(reads):
    index = spark_index(reads)
    found = packed.slots(index, K)
    assert rows(packed.met_queries(reads, K, 1, found).join(index, "kmer")) == rows(query_kmers(reads, K, 1).select("qid", "qsize", "qdir", "qoff", "kmer").join(index, "kmer").select("kmer", "qid", "qsize", "qdir", "qoff", "sid"))
    assert packed.met_queries(reads, K, 1, found).count() < query_kmers(reads, K, 1).count()


def spark_index(reads):
    return kmers(reads.where("read_id < 3").select(reads.read_id.alias("sid"), "seq"), K).select("kmer", "sid").distinct()


@pytest.mark.parametrize("k", [5, 15])
def test_kmers_in_order_over_all_partitions(spark, monkeypatch, k):
    """A k-mer that fills several ranges is cut between its reads; equal ones of a read follow each other."""
    monkeypatch.setattr(packed, "ORDERED", 150)
    rng = np.random.default_rng(k)
    texts = ["A" * 60 for _ in range(30)] + [text(random_bases(rng, 80)) for _ in range(30)] + ["", "ACG"]
    data = [(i, x, len(x)) for i, x in enumerate(texts)]
    reads = spark.createDataFrame(data, "read_id long, seq string, len int").repartition(5)
    made = packed.kmers_in_order(reads, k)
    got = [tuple(r) for r in made.collect()]
    want = sorted((x[p : p + k], i, p) for i, x, _ in data for p in range(len(x) - k + 1))
    assert got == want
    sizes = made.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < len(want) / 4
    assert "RangePartitioning" not in made._jdf.queryExecution().executedPlan().toString()


def test_steps_run_where_seeds_are_gathered(reads):
    """The same results as on rows, and no row of a seed in the plan."""
    placed = jobs.placed_targets(reads, 1 << 40)
    by_target, by_block = (packed.gathering(placed, K, 3, 20, order) for order in (packed.BY_TARGET, packed.BY_BLOCK))
    plain = packed.self_seeds(placed, K, 3, 20)
    pairs = [
        (band_chains(plain, K, 3, ChainOptions(min_score=5)), band_chains(by_target, K, 3, ChainOptions(min_score=5), gathered=True)),
        (seed_steps(plain), seed_steps(by_target, gathered=True)),
        (block_scores(with_blocks(plain, 100), 3, 0.25), block_scores(with_blocks(by_block, 100), 3, 0.25, gathered=True)),
        (block_counts(with_blocks(plain, 100), 3), block_counts(with_blocks(by_block, 100), 3)),
    ]
    for want, got in pairs:
        assert rows(got, *want.columns) == rows(want) and want.count() > 0
        assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow", 1)[0]
