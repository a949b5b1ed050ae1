"""Co-linear chaining of seeds, and the selection of seeds to chain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.arrow import columns, run_starts, to_batch, whole_groups
from readloom.operators.blocks import best_of_runs, ddf_partners
from readloom.operators.packed import Gathered
from readloom.options import ChainOptions, MapOptions
from readloom.schemas import FWD
from readloom.session import spread

ROWS_PER_STEP = 400_000
LOOKBACK = 32, 512  # least and most predecessors looked at in one vector step
CELLS = 8192  # and about how many for all lists together
MINUS = -(1 << 40)


def gap_penalty(k: int, bandwidth: int) -> np.ndarray:
    """Cost of a diagonal shift of 0..bandwidth bases: 1 % of k per base, plus
    half the binary logarithm (whole numbers throughout)."""
    shift = np.arange(bandwidth + 1)
    log = np.zeros(bandwidth + 1, dtype=np.int64)
    log[1:] = np.floor(np.log2(shift[1:])).astype(np.int64)
    return (shift * 0.01 * k).astype(np.int64) + (log >> 1)


def best_predecessors(starts: np.ndarray, q: np.ndarray, s: np.ndarray, k: int, opts: ChainOptions):
    """Chain score, predecessor and best score on the way, for every seed.

    ``starts`` delimits independent lists of seeds sorted by (s, q). All lists
    advance together: step i extends the i-th seed of every list that has one,
    against a (lists x width) matrix of earlier seeds at a time.

    A search back ends early when, in excess of improvements, more than
    max_skip looked-at seeds already precede another looked-at seed. That
    excess is a walk held at zero from below, so it equals its free sum minus
    the lowest value of that sum so far.
    """
    n = len(q)
    sizes = np.diff(np.append(starts, n))
    score = np.full(n, k, dtype=np.int64)
    before = np.full(n, -1, dtype=np.int64)
    peak = np.full(n, k, dtype=np.int64)
    seen = np.full(n, -1, dtype=np.int64)
    penalty = gap_penalty(k, opts.bandwidth)
    owner = np.repeat(np.arange(len(starts)), sizes)
    span = int(s.max()) + opts.max_dist + 2 if n else 1
    flat = owner * span + s
    # First seed of the list within max_dist on the target.
    low = np.maximum(np.searchsorted(flat, flat - opts.max_dist), starts[owner])
    longest_first = starts[np.argsort(-sizes, kind="stable")]
    alive_at = np.searchsorted(np.sort(-sizes), -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
    for i in range(1, len(alive_at)):
        here = longest_first[: alive_at[i]] + i
        best, link = score[here].copy(), np.full(len(here), -1)
        excess = np.zeros(len(here), dtype=np.int64)
        open_rows = np.flatnonzero(low[here] < here)
        last = here - 1
        while len(open_rows):
            at = here[open_rows]
            width = min(i, max(LOOKBACK[0], min(LOOKBACK[1], CELLS // len(at))))
            back = last[open_rows][:, None] - np.arange(width)
            inside = back >= low[at][:, None]
            back = np.where(inside, back, at[:, None])
            ds = s[at][:, None] - s[back]
            dq = np.abs(q[at][:, None] - q[back])
            shift = np.abs(ds - dq)
            ok = inside & (dq <= opts.max_dist) & (shift <= opts.bandwidth)
            gain = np.minimum(ds, dq) - penalty[np.minimum(shift, opts.bandwidth)]
            reach = np.where(ok, score[back] + gain, MINUS)
            top = np.maximum.accumulate(np.column_stack([best[open_rows], reach]), axis=1)[:, :-1]
            better = reach > top
            parents = before[back]
            seen[parents[ok & (parents >= 0)]] = i
            stale = ok & ~better & (seen[back] == i)
            walk = excess[open_rows][:, None] + np.cumsum(stale.astype(np.int64) - better, axis=1)
            held = walk - np.minimum(np.minimum.accumulate(walk, axis=1), 0)
            stop = stale & (held > opts.max_skip)
            stopped = stop.any(axis=1)
            end = np.where(stopped, stop.argmax(axis=1), width)
            reach = np.where(np.arange(width) < end[:, None], reach, MINUS)
            pick = reach.argmax(axis=1)
            value = reach[np.arange(len(at)), pick]
            improved = value > best[open_rows]
            best[open_rows[improved]] = value[improved]
            link[open_rows[improved]] = back[np.arange(len(at)), pick][improved]
            excess[open_rows] = held[:, -1]
            last[open_rows] -= width
            open_rows = open_rows[~stopped & (last[open_rows] >= low[at])]
        score[here], before[here] = best, link
        has = link >= 0
        peak[here] = np.where(has, np.maximum(peak[np.where(has, link, 0)], best), best)
    return score, before, peak


def chains(starts: np.ndarray, q: np.ndarray, s: np.ndarray, k: int, min_seeds: int, opts: ChainOptions):
    """Disjoint chains of every list, best first, as rows (list, score, qbeg,
    qend, sbeg, send). A chain begins at its own first seed; one that runs into
    a better chain keeps the score gained since leaving it. A chain whose right
    end lies in the query or target span of a better kept one is dropped.
    """
    n = len(q)
    if n == 0:
        return np.zeros((0, 6), dtype=np.int64)
    score, before, peak = best_predecessors(starts, q, s, k, opts)
    followed = np.zeros(n, dtype=bool)
    followed[before[before >= 0]] = True
    tails = np.flatnonzero(~followed & (peak >= opts.min_score))
    owner = np.searchsorted(starts, tails, side="right") - 1
    f, p, top = score.tolist(), before.tolist(), peak.tolist()
    found: dict[int, list[tuple[int, int]]] = {}
    for of, tail in zip(owner.tolist(), tails.tolist()):
        end = tail
        while end >= 0 and f[end] < top[end]:
            end = p[end]
        end = tail if end < 0 else end
        found.setdefault(of, []).append((-f[end], end))
    taken = bytearray(n)
    out = []
    for of, ends in found.items():
        kept: list[tuple[int, ...]] = []
        for negative, end in sorted(ends):
            first, length, at = end, 0, end
            while True:
                first, length, taken[at] = at, length + 1, 1
                at = p[at]
                if at < 0 or taken[at]:
                    break
            value = -negative - (f[at] if at >= 0 else 0)
            if length >= min_seeds and (at < 0 or value >= opts.min_score):
                kept.append((-value, end, first))
        spans: list[tuple[int, int, int, int]] = []
        for negative, end, first in sorted(kept):
            qe, se = int(q[end]) + k, int(s[end]) + k
            if any(qb <= qe <= qx or sb <= se <= sx for qb, qx, sb, sx in spans):
                continue
            spans.append((int(q[first]), qe, int(s[first]), se))
            out.append((of, -negative, *spans[-1][:2], *spans[-1][2:]))
    return np.array(out, dtype=np.int64).reshape(-1, 6)


def seeds_to_chain(block_start, block_key, anchor_of_block, group_end, goff, q, sref, ssize, opts: MapOptions):
    """Seed lists to chain, one per anchor that is still free when its turn comes.

    Blocks are visited in order. The anchor of a free block gathers the seeds
    of its target from all free blocks around it that lie on a line with it; a
    block that gave at least a tenth of a quarter of its seeds is used up.
    Returns (anchor index, selected seed indexes) pairs.
    """
    n = len(goff)
    bounds = np.append(block_start, n)
    sizes = np.diff(bounds)
    quarter = sizes // 4
    free = np.ones(len(block_start), dtype=bool)
    size = opts.block_size
    anchored = np.flatnonzero(anchor_of_block >= 0)
    at = anchor_of_block[anchored]
    number = goff[at] // size
    left = np.maximum(number - (goff[at] - sref[at] + size - 1) // size, 0)
    right = number + (sref[at] + ssize[at] - goff[at] + size - 1) // size
    base = block_key[anchored] - number  # the key of block 0 of the same query strand
    first = np.searchsorted(block_key, base + left)
    last = np.minimum(np.searchsorted(block_key, base + right, side="right"), group_end[anchored])
    lists = []
    for block, seed, lo, hi in zip(anchored.tolist(), at.tolist(), first.tolist(), last.tolist()):
        if not free[block]:
            continue
        a, b = bounds[lo], bounds[hi]
        g, qq = goff[a:b], q[a:b]
        dg, dq = np.abs(g - goff[seed]), np.abs(qq - q[seed])
        with np.errstate(divide="ignore", invalid="ignore"):
            line = np.abs(1.0 - dg / dq) < opts.ddf_cutoff
        line &= (dg > 0) & (dq > 0) & (g >= sref[seed]) & (g < sref[seed] + ssize[seed])
        line[seed - a] = True
        line &= np.repeat(free[lo:hi], sizes[lo:hi])
        given = np.add.reduceat(line, bounds[lo:hi] - a, dtype=np.int64)
        free[lo:hi] &= given * 10 < quarter[lo:hi]
        lists.append((seed, np.flatnonzero(line) + a))
    return lists


CANDIDATE_ROWS = (
    "qid long, sid long, score int, qdir int, qbeg int, qend int, qoff int, qsize int,"
    " sdir int, sbeg int, send int, soff int, ssize int, volume_id long"
)
CANDIDATE_SCHEMA = pa.schema(
    [
        (name, pa.int64() if kind == "long" else pa.int32())
        for name, kind in (field.split() for field in CANDIDATE_ROWS.split(","))
    ]
)


BAND_ROWS = CANDIDATE_ROWS.replace("volume_id", "n_seeds")
BAND_SCHEMA = pa.schema([f if f.name != "volume_id" else f.with_name("n_seeds") for f in CANDIDATE_SCHEMA])


def candidate_rows(found: np.ndarray, fields: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Chains as candidate rows; the anchor is the right end of the chain."""
    _, score, qbeg, qend, sbeg, send = found.T
    rows = dict(fields, score=score, qbeg=qbeg, qend=qend, qoff=qend, sbeg=sbeg, send=send, soff=send)
    rows["sdir"] = np.zeros(len(found), dtype=np.int32)
    return to_batch(rows, CANDIDATE_SCHEMA)


def chain_blocks(
    seeds: DataFrame | Gathered, opts: MapOptions, chain_opts: ChainOptions = ChainOptions(), gathered: bool = False
) -> DataFrame:
    """Candidates of every query strand: block anchors, their seeds, chains.

    Needs qid, qdir, qsize, sid, ssize, sref, qoff, soff, volume_id. Used-up
    blocks make the order of anchors matter, so the key is one query strand
    against one volume: its seeds are bounded by the read length and the k-mer
    cutoff, not by the data. The cost does not depend on the number of keys.
    Seeds that are ``gathered`` BY_VOLUME (``operators/packed.py``) stay where they are.
    """
    keys = ["volume_id", "qid", "qdir"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, keys, ROWS_PER_STEP):
            volume, qid, qdir, goff, q, sref, ssize, qsize, sid = columns(
                part, "volume_id", "qid", "qdir", "goff", "qoff", "sref", "ssize", "qsize", "sid"
            )
            n = len(qid)
            starts = run_starts(volume, qid, qdir)
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
            number = goff // opts.block_size
            width = int(number.max()) + 1
            key = group * width + number
            block_start = run_starts(key)
            block_key = key[block_start]
            sizes = np.diff(np.append(block_start, n))
            block = np.repeat(np.arange(len(block_start)), sizes)
            big = sizes > opts.min_block_score
            anchor = np.full(len(block_start), -1, dtype=np.int64)
            rows = np.flatnonzero(big[block])
            if len(rows) == 0:
                continue
            partners = ddf_partners(block[rows], q[rows], goff[rows], opts.ddf_cutoff)
            best = best_of_runs(partners, run_starts(block[rows]))
            agreed = best[partners[best] >= opts.min_block_score]
            anchor[block[rows[agreed]]] = rows[agreed]
            last_block = np.append(block[starts[1:] - 1] + 1, len(block_start)) if len(starts) else starts
            group_end = last_block[group[block_start]]
            q = q.astype(np.int64)
            lists = seeds_to_chain(block_start, block_key, anchor, group_end, goff, q, sref, ssize.astype(np.int64), opts)
            if not lists:
                continue
            picked = np.concatenate([rows for _, rows in lists])
            list_start = np.cumsum([0] + [len(rows) for _, rows in lists])[:-1]
            found = chains(
                list_start, q[picked], goff[picked] - sref[picked], opts.kmer_size, opts.min_block_score, chain_opts
            )
            if len(found) == 0:
                continue
            of = np.array([seed for seed, _ in lists])[found[:, 0]]
            names = {"qid": qid, "qdir": qdir, "qsize": qsize, "sid": sid, "ssize": ssize, "volume_id": volume}
            yield candidate_rows(found, {name: values[of] for name, values in names.items()})

    if isinstance(seeds, Gathered):
        return seeds.mapInArrow(search, CANDIDATE_ROWS)
    rows = seeds.select(
        *keys, (F.col("sref") + F.col("soff")).alias("goff"), "qoff", "sref", "ssize", "qsize", "sid"
    )
    sorted_rows = rows if gathered else spread(rows, *keys).sortWithinPartitions(*keys, "goff", "qoff")
    return sorted_rows.mapInArrow(search, CANDIDATE_ROWS)


PAIR = ["qid", "qdir", "sid"]


def by_pair(seeds: DataFrame | Gathered, gathered: bool, *columns: str) -> DataFrame | Gathered:
    """Seeds of a pair next to each other in target order; those ``gathered`` BY_TARGET are so already."""
    if isinstance(seeds, Gathered):
        return seeds
    rows = seeds.select(*PAIR, "qoff", "soff", *columns)
    return rows if gathered else spread(rows, *PAIR).sortWithinPartitions(*PAIR, "soff", "qoff")


def chain_pairs(
    seeds: DataFrame | Gathered, k: int, min_seeds: int, opts: ChainOptions = ChainOptions(), gathered: bool = False
) -> DataFrame:
    """Chain all seeds of each (query strand, target) pair.

    Needs qid, qdir, qsize, sid, ssize, qoff, soff.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, PAIR, ROWS_PER_STEP):
            qid, qdir, sid, q, s, qsize, ssize = columns(part, *PAIR, "qoff", "soff", "qsize", "ssize")
            starts = run_starts(qid, qdir, sid)
            found = chains(starts, q.astype(np.int64), s.astype(np.int64), k, min_seeds, opts)
            of = starts[found[:, 0]]
            names = {"qid": qid, "qdir": qdir, "qsize": qsize, "sid": sid, "ssize": ssize}
            fields = {name: values[of] for name, values in names.items()}
            yield candidate_rows(found, dict(fields, volume_id=np.zeros(len(found), dtype=np.int64)))

    return by_pair(seeds, gathered, "qsize", "ssize").mapInArrow(search, CANDIDATE_ROWS).drop("volume_id")


def seed_steps(seeds: DataFrame | Gathered, gathered: bool = False) -> DataFrame:
    """Seeds with the one before them of their pair, in target order, as ``q0`` and ``s0``; the first of a pair has none
    and is left out.

    Needs qid, qdir, sid, qoff, soff.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, PAIR, ROWS_PER_STEP):
            later = np.ones(part.num_rows, dtype=bool)
            later[run_starts(*columns(part, *PAIR))] = False
            at = np.flatnonzero(later)
            names = [*PAIR, "qoff", "soff"]
            fields = [values[at] for values in columns(part, *names)] + [values[at - 1] for values in columns(part, "qoff", "soff")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in fields], names=[*names, "q0", "s0"])

    rows = "qid long, qdir int, sid long, qoff int, soff int, q0 int, s0 int"
    return by_pair(seeds, gathered).mapInArrow(step, rows)


def band_chains(
    seeds: DataFrame | Gathered, k: int, min_seeds: int, opts: ChainOptions = ChainOptions(), gathered: bool = False
) -> DataFrame:
    """Candidates by simplified chaining, which SQL can repeat: seeds of a pair in
    target order form one chain until the gap or the diagonal shift gets too
    large.

    Needs qid, qdir, qsize, sid, ssize, qoff, soff. One pair's seeds are
    bounded by the read lengths and the k-mer cutoff.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, PAIR, ROWS_PER_STEP):
            qid, qdir, sid, q, s, qsize, ssize = columns(part, *PAIR, "qoff", "soff", "qsize", "ssize")
            first = run_starts(qid, qdir, sid)
            ds, dq = np.diff(s.astype(np.int64), prepend=0), np.diff(q.astype(np.int64), prepend=0)
            breaks = (ds > opts.max_dist) | (np.abs(ds - dq) > opts.bandwidth)
            breaks[first] = True
            starts = np.flatnonzero(breaks)
            n_seeds = np.diff(np.append(starts, len(q)))
            score = np.add.reduceat(np.where(breaks, 0, np.minimum(np.abs(dq), ds)), starts)
            kept = np.flatnonzero((n_seeds >= min_seeds) & (score >= opts.min_score))
            of = starts[kept]
            qend, send = np.maximum.reduceat(q, starts)[kept] + k, np.maximum.reduceat(s, starts)[kept] + k
            qbeg, sbeg = np.minimum.reduceat(q, starts)[kept], np.minimum.reduceat(s, starts)[kept]
            fields = dict(qid=qid[of], qdir=qdir[of], qsize=qsize[of], sid=sid[of], ssize=ssize[of], n_seeds=n_seeds[kept])
            fields |= dict(score=score[kept], qbeg=qbeg, qend=qend, qoff=qend, sbeg=sbeg, send=send, soff=send)
            yield to_batch(dict(fields, sdir=np.full(len(of), FWD)), BAND_SCHEMA)

    return by_pair(seeds, gathered, "qsize", "ssize").mapInArrow(search, BAND_ROWS)
