"""Arrow-batched steps against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import noisy, random_bases
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.functions.arrow import whole_groups
from readloom.operators import alignment as al
from readloom.operators.blocks import ddf_partners
from readloom.operators.chaining import best_predecessors, chains
from readloom.options import ChainOptions


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=80, unique=True))
def test_ddf_partners(points):
    points = sorted(points)
    group, q, s = (np.array(x) for x in zip(*points))
    got = ddf_partners(group, q, s, 0.25)
    for i in range(len(points)):
        want = sum(
            group[j] == group[i] and q[j] != q[i] and s[j] != s[i]
            and abs(1.0 - abs(int(s[j]) - int(s[i])) / abs(int(q[j]) - int(q[i]))) < 0.25
            for j in range(len(points))
        )
        assert got[i] == want


def slow_links(q, s, k, opts):
    """The chain recurrence, one seed and one predecessor at a time."""
    score, link, peak = [], [], []
    for i in range(len(q)):
        best, to, excess, parents = k, -1, 0, set()
        for j in reversed(range(i)):
            ds, dq = s[i] - s[j], abs(q[i] - q[j])
            if ds > opts.max_dist:
                break
            shift = abs(ds - dq)
            if dq > opts.max_dist or shift > opts.bandwidth:
                continue
            value = score[j] + min(ds, dq) - int(shift * 0.01 * k) - (max(shift.bit_length() - 1, 0) // 2)
            if value > best:
                best, to, excess = value, j, max(excess - 1, 0)
            elif j in parents:
                excess += 1
                if excess > opts.max_skip:
                    break
            parents.add(link[j])
        score.append(best)
        link.append(to)
        peak.append(max(best, peak[to]) if to >= 0 else best)
    return score, link, peak


@pytest.mark.parametrize("max_skip", [0, 2, 25])
def test_chain_links(max_skip):
    rng = np.random.default_rng(max_skip)
    opts = ChainOptions(max_skip=max_skip)
    lists = []
    for size in (1, 2, 5, 40, 300, 900):
        s = rng.integers(0, 30_000, size)
        on_line = rng.random(size) < 0.6
        q = np.where(on_line, s + rng.integers(-200, 200, size), rng.integers(0, 30_000, size)).clip(0)
        order = np.lexsort((q, s))
        lists.append((q[order], s[order]))
    starts = np.cumsum([0] + [len(q) for q, _ in lists])[:-1]
    q, s = (np.concatenate(x).astype(np.int64) for x in zip(*lists))
    score, link, peak = best_predecessors(starts, q, s, 13, opts)
    for a, (lq, ls) in zip(starts, lists):
        want = slow_links(lq.tolist(), ls.tolist(), 13, opts)
        b = a + len(lq)
        assert score[a:b].tolist() == want[0]
        assert [x - a if x >= 0 else -1 for x in link[a:b]] == want[1]
        assert peak[a:b].tolist() == want[2]


def test_chains_two_diagonals():
    line = np.arange(0, 2000, 50)
    s = np.concatenate([line, line + 5000])
    q = np.concatenate([line, line + 20_000])
    order = np.lexsort((q, s))
    found = chains(np.array([0]), q[order], s[order], 13, 3, ChainOptions())
    assert sorted((r[2], r[3], r[4], r[5]) for r in found.tolist()) == [(0, 1963, 0, 1963), (20_000, 21_963, 5000, 6963)]


def slow_distance(q, t):
    row = list(range(len(t) + 1))
    for i, c in enumerate(q):
        new = [i + 1]
        for j, d in enumerate(t):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (c != d)))
        row = new
    best = min(row[1:])
    return best, row[1:].index(best) + 1


def test_prefix_distance():
    rng = np.random.default_rng(1)
    queries = [random_bases(rng, int(n)) for n in rng.integers(1, 200, 80)]
    targets = [np.array(noisy(rng, q, 0.3) or [0], dtype=np.uint8) for q in queries]
    got, length, up, left = al.prefix_distance(queries, targets)
    for i, (q, t) in enumerate(zip(queries, targets)):
        assert (got[i], length[i]) == slow_distance(q.tolist(), t.tolist())
    for q, t, result, distance in zip(queries, targets, al.align_blocks(queries, targets, 1.0), got):
        if result is None:
            continue
        qaln, taln, used, _ = result
        assert bytes(al.LETTER[q]) == qaln[::-1].tobytes().replace(b"-", b"")
        assert bytes(al.LETTER[t[:used]]) == taln[::-1].tobytes().replace(b"-", b"")
        assert (qaln != taln).sum() == distance


def test_align_from_anchors():
    rng = np.random.default_rng(2)
    base = [random_bases(rng, 2500) for _ in range(20)]
    target = [np.array(noisy(rng, b, 0.15), dtype=np.uint8) for b in base]
    # Equal stretches around the anchors.
    for b, t in zip(base, target):
        t[1180:1220] = b[1180:1220]
    results = list(al.align_from_anchors([b[100:] for b in base], target, [1100] * 20, [1200] * 20, 0.5))
    for (qb, qe, tb, te, ident, qaln, taln), b, t in zip(results, base, target):
        assert bytes(al.LETTER[b[100:][qb:qe]]) == qaln.tobytes().replace(b"-", b"")
        assert bytes(al.LETTER[t[tb:te]]) == taln.tobytes().replace(b"-", b"")
        assert ident == pytest.approx(100 * (qaln == taln).mean())
        assert ident > 75 and qe - qb > 2000


def test_align_identical_and_unrelated():
    rng = np.random.default_rng(3)
    same = random_bases(rng, 3000)
    other = random_bases(rng, 3000)
    (one,) = al.align_from_anchors([same], [same], [1500], [1500], 0.5)
    assert one[:5] == (0, 3000, 0, 3000, 100.0)
    (two,) = al.align_from_anchors([same], [other], [1500], [1500], 0.1)
    assert len(two[5]) < 100


def test_whole_groups():
    keys = [0] * 3 + [1] * 10 + [2] + [3] * 30 + [4] * 2
    table = pa.table({"k": keys, "v": range(len(keys))})
    parts = list(whole_groups(iter(table.to_batches(max_chunksize=4)), ["k"], 5))
    assert [v for p in parts for v in p.column("v").to_pylist()] == list(range(len(keys)))
    seen = [set(p.column("k").to_pylist()) for p in parts]
    assert all(not (a & b) for i, a in enumerate(seen) for b in seen[i + 1 :])


@pytest.mark.parametrize("q, t", [([0, 1, 2, 1, 1], [0, 1, 2, 1]), ([0], [0]), ([0], [1]), ([0] * 8, [0] * 8), ([1, 0], [0] * 40)])
def test_align_tiny_blocks(q, t):
    q, t = np.array(q, dtype=np.uint8), np.array(t, dtype=np.uint8)
    for qoff in (0, len(q)):
        (r,) = al.align_from_anchors([q], [t], [qoff], [len(t) if qoff else 0], 0.5)
        assert bytes(al.LETTER[q[r[0] : r[1]]]) == r[5].tobytes().replace(b"-", b"")
