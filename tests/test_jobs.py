"""Jobs on planted reads: the truth is known."""

import time

import numpy as np
import pytest
from conftest import planted_reads, rows
from pyspark.sql import functions as F

from readloom.operators import alignment as al
from readloom.operators import candidates as cand
from readloom.operators import consensus as cns
from readloom.operators.candidates import top_candidates
from readloom.operators.chaining import chain_blocks
from readloom.operators.extension import drop_contained
from readloom.operators.kmers import kmer_index, query_kmers, target_kmers
from readloom.operators.seeds import seed_join
from readloom.plans import jobs
from readloom.options import ConsensusOptions, MapOptions
from readloom.schemas import CANDIDATES
from readloom.session import Workspace

COMPLEMENT = str.maketrans("ACGT", "TGCA")


@pytest.fixture(scope="module")
def planted():
    return planted_reads(np.random.default_rng(7), 8_000, 60, 1500, 3000, 0.06)


@pytest.fixture(scope="module")
def reads(spark, planted):
    df = spark.createDataFrame([(i, s) for i, s, *_ in planted[1]], "ordinal long, seq string")
    return jobs.build_reads(df).cache()


@pytest.fixture(scope="module")
def cands(reads):
    return jobs.find_candidates(reads).cache()


def true_overlaps(planted, least):
    found = {}
    for i, _, a, b, strand in planted[1]:
        for j, _, c, d, other in planted[1]:
            if j < i and min(b, d) - max(a, c) >= least:
                found[i, j] = int(strand != other)
    return found


def test_candidates_find_planted_overlaps(cands, planted):
    # Blocks reach over two or three of these short reads and give one anchor
    # each, so candidates are a part of all overlaps; none may be wrong.
    truth = true_overlaps(planted, 100)
    got = {(r.qid, r.sid): r.qdir for r in cands.collect()}
    right = [pair for pair in got if truth.get(pair) == got[pair]]
    assert len(right) > 0.95 * len(got) and len(got) > 0.3 * len(true_overlaps(planted, 1000))
    assert cands.where("sid >= qid").isEmpty()
    assert cands.where("qbeg < 0 or qend > qsize or sbeg < 0 or send > ssize or qoff != qend").isEmpty()


def test_small_blocks_find_nearly_all(reads, planted):
    truth = true_overlaps(planted, 1000)
    got = {(r.qid, r.sid) for r in jobs.find_candidates(reads, MapOptions(block_size=600)).collect()}
    assert len(truth.keys() & got) > 0.9 * len(truth)


def test_each_volume_is_searched_on_its_own(reads):
    opts = MapOptions(volume_size=30_000)
    found = jobs.find_candidates(reads, opts)
    placed = jobs.placed_targets(reads, opts.volume_size)
    volumes = [r.volume_id for r in placed.select("volume_id").distinct().collect()]
    assert len(volumes) > 3
    one = placed.where("volume_id = 2")
    assert one.where("sref != offset % 30000").isEmpty() and one.count() > 3
    alone = seed_join(query_kmers(reads, 13, 10), kmer_index(target_kmers(one, 13), opts.max_kmer_count))
    want = top_candidates(chain_blocks(alone, opts), ["qid"], opts.num_output).drop("volume_id")
    got = found.join(one.select(F.col("read_id").alias("sid")), "sid", "left_semi").select(*want.columns)
    assert rows(got) == rows(want) and got.count() > 0


def test_overlaps(reads, planted):
    overlaps = jobs.find_overlaps(reads).collect()
    place = {i: (a, b, strand) for i, _, a, b, strand in planted[1]}
    seqs = {i: s for i, s, *_ in planted[1]}
    assert len(overlaps) > 50
    for o in overlaps:
        assert o.ident_perc > 70 and o.qend - o.qoff >= 400
        a, b, strand = place[o.sid]
        beg = a + o.soff if strand == 0 else b - o.send
        c, d, other = place[o.qid]
        q_forward = o.qoff if (other ^ o.qdir) == 0 else o.qsize - o.qend
        assert strand == other ^ o.qdir
        assert abs((c + q_forward) - beg) < 150  # positions drift with insertions
        assert o.qsize == len(seqs[o.qid]) and o.ssize == len(seqs[o.sid])


def test_mapping_to_the_genome(spark, planted, reads):
    genome = jobs.build_reads(spark.createDataFrame([(0, planted[0])], "ordinal long, seq string"))
    mapped = jobs.map_to_reference(reads, genome)
    best = {}
    for o in mapped.orderBy("vscore").collect():
        best[o.qid] = o
    assert len(best) == len(planted[1])
    for i, _, a, b, strand in planted[1]:
        o = best[i]
        assert o.qdir == strand and abs(o.soff - a) < 60 and abs(o.send - b) < 60
        assert o.soff <= o.sext <= o.send


def test_mirror_partition(cands):
    mirrored = jobs.mirror_partition(cands, jobs.PartitionOptions(batch_size=10))
    assert mirrored.count() == 2 * cands.count()
    assert mirrored.where("pid != sid div 10").isEmpty()


def identity_to(genome, seq):
    best = 0.0
    for text in (seq, seq.translate(COMPLEMENT)[::-1]):
        word = text[len(text) // 2 : len(text) // 2 + 14]
        for shift in range(0, 300, 7):
            word = text[len(text) // 2 + shift : len(text) // 2 + shift + 14]
            at = genome.find(word)
            if at >= 0 and len(word) == 14:
                q, t = (al.CODE[np.frombuffer(x.encode(), dtype=np.uint8)] for x in (text, genome))
                (r,) = al.align_from_anchors([q], [t], [len(text) // 2 + shift + 14], [at + 14], 0.5)
                best = max(best, r[4] * (r[1] - r[0]) / len(text))
                break
    return best


def test_correction_improves_reads(spark, planted, reads, work):
    opts = MapOptions(block_size=600)
    corrected, raw = jobs.correct_once(reads, work, opts)
    genome = planted[0]
    before = np.mean([identity_to(genome, s) for _, s, *_ in planted[1]])
    pieces = corrected.collect()
    after = np.mean([identity_to(genome, r.seq) for r in pieces])
    assert len(pieces) > 30 and after > before + 3
    for r in pieces:
        assert 0 <= r.left < r.right <= r.org_size and len(r.seq) >= 500
    voted = {r.id for r in pieces}
    assert {r.id for r in raw.collect()} | voted == {i for i, *_ in planted[1]}
    # A finished run is read, not made again.
    again, _ = jobs.correct_once(reads.where("false"), work, opts)
    assert again.count() == len(pieces)


def test_two_rounds_keep_every_read_in_the_first(reads, work):
    corrected, raw = jobs.correct(reads, 2, work, MapOptions(block_size=600), MapOptions(block_size=600, stride=20))
    first = work.spark.read.parquet(work.path("round-1/corrected")).unionByName(
        work.spark.read.parquet(work.path("round-1/raw"))
    )
    assert rows(first.select("id").distinct()) == rows(reads.select("read_id"))
    assert work.spark.read.parquet(work.path("round-2/reads")).count() == reads.count()
    assert corrected.count() > 30


def test_selection_equals_a_sequential_walk(spark, reads, work):
    opts = ConsensusOptions(min_align_size=300)
    mirrored = work.keep("mirrored", cand.mirror(jobs.find_candidates(reads, MapOptions(block_size=600))))
    got = {(r.sid, r.qid, r.a_soff) for r in cns.select_alignments(mirrored, reads, opts, work).collect()}

    seqs = {r.read_id: r.seq for r in reads.collect()}
    want = set()
    by_target = {}
    everything = mirrored.collect()

    def codes(text):
        return al.CODE[np.frombuffer(text.encode(), dtype=np.uint8)]

    queries = [codes(seqs[r.qid].translate(COMPLEMENT)[::-1] if r.qdir else seqs[r.qid]) for r in everything]
    targets = [codes(seqs[r.sid]) for r in everything]
    results = al.align_from_anchors(queries, targets, [r.qoff for r in everything], [r.soff for r in everything], opts.error)
    aligned = dict(zip(everything, results))
    for r in everything:
        by_target.setdefault(r.sid, []).append(r)
    for sid, group in by_target.items():
        if len(group) < opts.high_accuracy_coverage:
            continue
        group.sort(key=lambda r: (-r.score, r.qid, r.qdir, r.qoff, r.soff, r.qbeg, r.sbeg))

        def align(r):
            result = aligned[r]
            return result if len(result[5]) >= opts.min_align_size else None

        def good(r, a):
            ends = [(a[0], r.qsize - a[1]), (a[2], r.ssize - a[3]), (r.qsize - a[1], a[2]), (r.ssize - a[3], a[0])]
            return any(max(e) <= 200 for e in ends)

        first, seen, last = [], set(), min(50, len(group)) - 1
        for place, r in enumerate(group[:50]):
            if r.qid in seen or not (a := align(r)):
                continue
            seen.add(r.qid)
            first.append((r, a, good(r, a)))
            if sum(g for *_, g in first) == 10:
                last = place
                break
        idents = [a[4] for r, a, g in first if g]
        if len(idents) < 10:
            idents = [a[4] for r, a, _ in first
                      if a[1] - a[0] >= 0.6 * r.qsize or a[3] - a[2] >= 0.6 * r.ssize][:10]
        if len(idents) < 5:
            continue
        cutoff = np.mean(idents) - 5 * np.std(idents)
        depth = np.zeros(group[0].ssize, dtype=int)
        limit = opts.coverage_limit(cutoff)
        for r, a, _ in first:
            if a[4] >= cutoff:
                depth[a[2] : a[3]] += 1
                want.add((sid, r.qid, a[2]))
        for r in group[last + 1 :]:
            span = depth[r.sbeg : r.send]
            if r.qid in seen or (span >= limit).sum() + 200 >= len(span):
                continue
            a = align(r)
            if a and a[4] >= cutoff:
                seen.add(r.qid)
                depth[a[2] : a[3]] += 1
                want.add((sid, r.qid, a[2]))
    assert len(want) > 100 and got == want


def test_paths_equal_a_sequential_walk(spark):
    rng = np.random.default_rng(11)
    from conftest import noisy, random_bases, text

    data = []
    for sid in range(4):
        base = random_bases(rng, 300 + 50 * sid)
        for aln in range(12):
            lo = int(rng.integers(0, 30)) if aln % 3 else 0
            q = np.array(noisy(rng, base[lo:], 0.2), dtype=np.uint8)
            (r,) = al.align_from_anchors([q], [base], [1], [lo + 1], 1.0)
            data.append((sid, aln, int(r[2]), r[5].tobytes().decode(), r[6].tobytes().decode(), 1.0, 5))
    df = spark.createDataFrame(data, "sid long, aln_id long, beg int, qaln string, taln string, weight double, max_cov int")
    link_rows = cns.links(cns.alignment_tags(df), ["max_cov"])
    got = {r.sid: r for r in cns.consensus_pieces(link_rows, 100).collect()}

    order = {b: i for i, b in enumerate("ACGT-")}
    by_target = {}
    for r in link_rows.collect():
        by_target.setdefault(r.sid, []).append(r)
    checked = 0
    for sid, group in by_target.items():
        cover = {}
        for r in group:
            if r.delta == 0:
                cover[r.t_pos] = cover.get(r.t_pos, 0) + r.link_count
        runs, beg = [], None
        for x in range(max(cover) + 2):
            if cover.get(x, 0) >= 5 and beg is None:
                beg = x
            elif cover.get(x, 0) < 5 and beg is not None:
                runs.append((beg, x))
                beg = None
        (beg, end), = [r for r in runs if r[1] - r[0] >= 85]
        score, parent = {}, {}
        group.sort(key=lambda r: (r.t_pos, r.delta, order[r.q_base], r.p_t_pos, r.p_delta, r.p_q_base))
        for r in group:
            if not beg <= r.t_pos < end:
                continue
            node = (r.t_pos, r.delta, r.q_base)
            value = r.weight - 0.4 * 0.5 * cover[r.t_pos]
            before = (r.p_t_pos, r.p_delta, r.p_q_base)
            if r.p_t_pos >= 0:
                value += score.get(before, 0.0)
            if value > score.setdefault(node, -1.0):
                score[node], parent[node] = value, before if r.p_t_pos >= 0 else None
        best = max(score, key=lambda n: (score[n], -n[0], -n[1], -order[n[2]]))
        at, letters, left = best, [], 0
        while parent.get(at):
            letters.append(at[2])
            at = parent[at]
            left = at[0]
        want = "".join(reversed(letters)).replace("-", "")
        if len(want) >= 100:
            checked += 1
            r = got[sid]
            assert (r.seq, r.left, r.right, r.raw_from, r.raw_to) == (want, beg, end, left, best[0] + 1)
    assert checked >= 3


def test_unbroken_and_broken(spark):
    whole = "A" * 1200 + "C" * 600 + "G" * 1500
    targets = spark.createDataFrame([(1, whole), (2, "T" * 900), (3, "T" * 1100)], "sid long, seq string")
    pieces = spark.createDataFrame([(1, 1200, 1800, 1190, 1810, "c" * 550)],
                                   "sid long, left int, right int, raw_from int, raw_to int, seq string")
    got = dict(rows(cns.unbroken(pieces, targets), "id", "seq"))
    assert got == {1: "A" * 1190 + "c" * 550 + "G" * 1490, 2: "T" * 900, 3: "T" * 1100}
    corrected, raw = cns.broken(pieces, targets)
    assert rows(corrected, "id", "org_size", "left", "right") == [(1, 3300, 1200, 1800)]
    assert rows(raw, "id", "left", "right") == [(1, 0, 1200), (1, 1800, 3300), (3, 0, 1100)]


def test_drop_contained(spark):
    schema = "qid long, qdir int, sid long, score int, qoff int, soff int, a_qoff int, a_qend int, a_soff int, a_send int"
    data = [
        (1, 0, 0, 90, 500, 500, 0, 800, 0, 800),
        (1, 0, 0, 80, 700, 700, 100, 1500, 100, 1500),  # anchor in the first
        (1, 0, 0, 70, 1200, 1200, 900, 1500, 900, 1500),  # in the dropped one only
        (1, 1, 0, 60, 500, 500, 0, 800, 0, 800),  # other strand
    ]
    kept = drop_contained(spark.createDataFrame(data, schema))
    assert [r[0] for r in rows(kept, "score")] == [60, 70, 90]


def test_candidate_columns(cands):
    assert cands.columns == CANDIDATES.names
    assert cands.groupBy("qid").agg(F.count("*").alias("n")).where("n > 200").isEmpty()


def test_a_stored_table_leaves_no_shuffle_files(spark, tmp_path):
    def shuffled():
        status = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName() for f in (status.apply(i) for i in range(status.size())) if f.getName().startswith("shuffle_")}

    before = shuffled()
    df = spark.range(20_000).repartition(7, "id").groupBy((F.col("id") % 100).alias("k")).count()
    kept = Workspace(spark, str(tmp_path)).keep("counts", df)
    assert kept.count() == 100
    left = lambda: [name for name in shuffled() - before if name.endswith(".data")]
    until = time.time() + 20
    while len(left()) > 1 and time.time() < until:  # they go in the background
        time.sleep(0.2)
    assert len(left()) <= 1, left()  # that of the count above
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") in (None, "false")
