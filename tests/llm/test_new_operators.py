"""Whitening, periodic runs and archives against plain versions, with nulls, empty and long values, repeats and clashing columns."""

import base64
import gzip
import hashlib
import random
from fractions import Fraction

import numpy as np
import pyarrow.fs
import pytest
from plain import sha
from pyspark.sql import functions as F

from readloom.llm import eigen, periodic, warc, whitening
from readloom.llm.queries import planted


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_leading_eigenvectors(n):
    """Random, equal, repeated, zero and widely spread eigenvalues."""
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    q, _ = np.linalg.qr(a)
    twice = np.ones(n)
    twice[: min(3, n)] = 5
    for m in (a + a.T, 3 * np.eye(n), q @ np.diag(twice) @ q.T, np.diag(np.arange(n) * 1.0), np.outer(a[0], a[0]) * 1e8, np.zeros((n, n)), q @ np.diag(10.0 ** -np.arange(n)) @ q.T):
        m = (m + m.T) / 2
        values, rows = eigen.leading(m, 4)
        size = max(np.abs(m).max(), 1e-300)
        assert np.allclose(values, np.linalg.eigvalsh(m)[::-1][:4], atol=1e-12 * n * size)
        assert np.abs(rows @ rows.T - np.eye(len(rows))).max() < 1e-10
        assert np.abs(m @ rows.T - rows.T * values).max() <= 1e-11 * n * size


def test_sturm_counts():
    rng = np.random.default_rng(0)
    d, e = rng.normal(size=30), rng.normal(size=29)
    e[10] = 0
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.concatenate([values[:-1] + np.diff(values) / 2, [-100, 100]])
    assert eigen.below(d, e, at).tolist() == [*range(1, 30), 0, 30]


def plain_whitening(vectors, k):
    """n, and deviation and whitened components of each vector."""
    x = {i: tuple(int(np.floor(256 * c)) for c in v) for i, v in vectors}
    fit = sorted(set(x.values()))
    n, m = len(fit), np.array(fit, float)
    sums = [sum(c) for c in zip(*fit, strict=True)]
    centred = m - np.array(sums) / n
    values, rows = np.linalg.eigh(centred.T @ centred / n)
    values, rows = values[::-1][:k], rows.T[::-1][:k]
    out = {i: (sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)), rows @ (np.array(v) - np.array(sums) / n) / np.sqrt(values)) for i, v in x.items()}
    return n, out, values / values.sum() if k >= m.shape[1] else values / np.trace(centred.T @ centred / n)


def test_whitening(spark, work):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(400, 9)) * np.arange(1, 10) * 0.1).astype("float32").astype(float).tolist()
    vectors[50:200] = [vectors[0]] * 150  # a third of the rows
    bad = {10: None, 11: [None, *vectors[1][1:]], 12: [float("nan")] * 9, 13: [float("inf")] * 9, 14: [], 15: [1.0, 2.0], 16: [-0.0] * 9}
    rows = [(i, bad.get(i, v), 1, -1, "r") for i, v in enumerate(vectors)] + [(None, vectors[3], 1, -1, "r")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, component int, row string").repartition(5)
    n, want, explained = plain_whitening([(r[0], r[1]) for r in rows if r[0] is None or not 10 <= r[0] <= 15], 4)
    model = whitening.fit(table, work)
    found = whitening.whiten(table, model)
    assert found.schema["row"].dataType.names == table.columns
    got = found.collect()
    assert len(got) == 4 * len(want) and {r["row"]["vec_id"] for r in got} == set(want)
    signs = [None] * 4
    for r in got:
        deviation, white = want[r["row"]["vec_id"]]
        c = r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation and abs(r["explained"] / explained[c] - 1) < 1e-9 and r["identity_error"] < 1e-9
        if abs(white[c]) > 1e-6:
            signs[c] = signs[c] or round(r["whitened"] / white[c])
            assert abs(r["whitened"] - signs[c] * white[c]) < 1e-8


def test_whitening_of_few_and_large(spark, work):
    schema = "vec_id long, embedding array<double>"
    count = lambda rows: whitening.whiten(t := spark.createDataFrame(rows, schema), whitening.fit(t, work)).count()
    assert count([]) == 0 and count([(1, [1.0, 2.0])]) == 0 and count([(1, []), (2, None)]) == 0
    assert count([(1, [1.0, 2.0]), (2, [1.5, 2.0]), (3, [1.0, 2.0])]) == 3  # one direction
    assert count([(i, [float(i % 3), float(i), 0.5]) for i in range(6)]) == 12
    large = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [1e12, 5.0])], schema)
    assert [r["deviation"] for r in whitening.whiten(large, whitening.fit(large, work)).collect()][0] is None
    rows = np.array([[3, 4], [2**30, -(2**30)]])
    for sums in ([2**31, 5], [2**41, 5]):
        exact = [sum((3 * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in rows.tolist()]
        assert whitening.deviations(rows, whitening.Model(3, sums, np.ones(1), np.ones((1, 2)), 1.0)) == [v if v < 2**63 else None for v in exact]


def plain_runs(w, least=24):
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(least, 3 * q) and not any(w[s : e - p] == w[s + p : e] for p in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def periodic_words(rng, size):
    w = []
    while len(w) < size:
        letters = rng.choice([1, 2, 3, 30])
        if rng.random() < 0.4:
            w += [f"w{rng.randrange(letters)}" for _ in range(rng.randrange(1, 60))]
        else:
            u = [f"w{rng.randrange(letters)}" for _ in range(rng.randrange(1, 30))]
            w += (u * rng.randrange(2, 9))[rng.randrange(len(u)) :]
    return w


def test_runs_against_all_periods():
    rng = random.Random(2)
    for trial in range(150):
        docs = [periodic_words(rng, rng.randrange(0, 250)) for _ in range(rng.randrange(1, 5))]
        least, known = rng.choice([24, 24, 6, 9]), {}
        numbers = np.array([known.setdefault(x, len(known)) for d in docs for x in d], np.int64)
        first = np.cumsum([0, *map(len, docs)])
        s, e, q = periodic.runs(numbers, first, least)
        want = [(int(f) + a, int(f) + a + n, p) for d, f in zip(docs, first, strict=False) for a, n, p in plain_runs(d, least)]
        assert list(zip(s.tolist(), e.tolist(), q.tolist(), strict=True)) == want, trial


def test_runs_of_long_and_odd_words():
    thue, fib, before = [0, 1], [0, 1], [0]
    while len(thue) < 30000:
        thue += [1 - x for x in thue]
    while len(fib) < 30000:
        before, fib = fib, fib + before
    check = lambda w: list(zip(*[x.tolist() for x in periodic.runs(np.array(w, np.int64), np.array([0, len(w)]))], strict=True))
    assert check(thue) == [] and len(check(fib)) > 1000
    assert check([7] * 100000) == [(0, 100000, 1)]
    assert check(list(range(1000)) * 100) == [(0, 100000, 1000)]
    assert check([]) == [] and check([1]) == []


def test_grammar_shares_work():
    """Symbols of a period that comes again many times are few."""
    w = np.array(list(range(40)) * 512, np.int64)
    grammar = periodic.Grammar(w, np.array([0, len(w)]))
    assert len(grammar.lo) < 60 and len(grammar.places) > len(grammar.lo)
    for k in range(len(grammar.lo)):
        one = w[grammar.lo[k] : grammar.hi[k]]
        assert all((w[p : p + len(one)] == one).all() for p in grammar.places[grammar.cuts[k] : grammar.cuts[k + 1]])


def plain_collapse(doc_id, text):
    w = (text or "").encode().split()
    order = planted(doc_id, len(w)) if w else None
    w = w if order is None else [w[i] for i in order]
    found = plain_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None,) * 3)
    runs = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (len(found), *best, best[1] * 1000 // best[2] if found else None, sha(runs.encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs(spark):
    rng = random.Random(6)
    texts = [" ".join(periodic_words(rng, rng.randrange(0, 200))) for _ in range(120)]
    texts += ["", None, " \t\n", "one", "a " * 23, "a " * 24, "x\ty\n" * 12, "é ü " * 30, "a b " * 11 + "a", "z" * 5000, *texts[:5]]
    schema = "doc_id long, text string, row string, runs string, n_runs string"
    docs = spark.createDataFrame([(i, t, "r", "x", "y") for i, t in enumerate(texts)] + [(None, "a " * 30, "r", "x", "y")], schema).repartition(3)
    found = periodic.digested(periodic.collapse(docs, digest=True, places=planted))
    assert found.schema["row"].dataType.names == docs.columns
    got = {r["row"]["doc_id"]: tuple(r)[1:] for r in found.collect()}
    assert got[None][:4] == (1, 0, 30, 1)
    for i, text in enumerate(texts):
        assert got[i] == plain_collapse(i, text), i
    plain = periodic.collapse(docs.where("doc_id = 125")).collect()[0]
    assert plain["collapsed"] == "a" and [tuple(r) for r in plain["runs"]] == [(0, 24, 1)] and plain["n_words"] == 24
    assert periodic.collapse(docs.where("false"), places=planted).count() == 0


def plain_archive(rows, least=0):
    newest = {}
    for i, t in rows:
        if i is not None:
            newest[t or ""] = max(newest.get(t or "", i), i)
    out = []
    for i, t in rows:
        data, top = (t or "").encode(), newest.get(t or "")
        revisit = top is not None and top != i and len(data) >= least
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if revisit else "response", top if revisit else None, True))
    return sorted(out, key=str)


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 100)


def pages_of(spark, rows):
    schema = "page_id long, url string, html string, id string, data string, chunk int"
    full = [(i, u, t, "x", "y", 3) for (i, t), u in zip(rows, ["http://a/é b?c=1&d\r\nX: 1", None, "http://x"] * len(rows), strict=False)]
    return spark.createDataFrame(full, schema).repartition(4) if rows else spark.createDataFrame([], schema)


ROWS = [(i, f"<p>{i % 7}</p>" * (i % 11 * 20)) for i in range(60)] + [(60, None), (61, ""), (62, "é" * 1000), (63, "x" * 99 + "é"), (64, "WARC/1.1\r\n\r\n"), (None, "<p>3</p>"), (None, "only"), (66, "é" * 1000), (66, "é" * 1000)]


@pytest.mark.parametrize("least", [0, 500])
def test_archives(spark, work, least):
    files = warc.write(pages_of(spark, ROWS), work, least=least)
    got = warc.table_of(warc.read(files, with_data=False)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_archive(ROWS, least)
    assert files.agg(F.sum("n_records")).first()[0] == len(ROWS)


def test_archives_are_read_by_others(spark, work):
    """Members are gzip, and blocks as long as they say; a plain reader finds the same payloads."""
    files = warc.write(pages_of(spark, ROWS), work, uri="url").collect()
    found = []
    for row in files:
        system, path = pyarrow.fs.FileSystem.from_uri(row["file"])
        data = system.open_input_stream(path, compression=None).read()
        assert len(data) == row["n_bytes"]
        data = gzip.decompress(data)
        while data:
            head, rest = data.split(b"\r\n\r\n", 1)
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            assert "X" not in fields
            size = int(fields["Content-Length"])
            payload = rest[:size].split(b"\r\n\r\n", 1)[1]
            assert rest[size : size + 4] == b"\r\n\r\n"
            data = rest[size + 4 :]
            if fields["WARC-Type"] == "response":
                assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
                found.append(payload.decode())
            else:
                assert payload == b"" and "WARC-Refers-To" in fields
    want = [t for (_, t), r in zip(sorted(ROWS, key=str), plain_archive([*ROWS]), strict=False)]
    assert len(want) == len(ROWS) and set(found) == {t or "" for _, t in ROWS}


def test_chunks_join_to_payloads(spark, work, small_chunks):
    """The table of chunks holds each payload in order, with the digest of all bytes so far."""
    text = "".join(map(str, range(500)))
    chunks = warc.read(spark.createDataFrame([(f"{work.path('hand')}.warc",)], "file string"))
    system, path = pyarrow.fs.FileSystem.from_uri(work.folder)
    system.create_dir(path, recursive=True)
    records = []
    for k, data in enumerate((text.encode(), b"", b"y" * 100, b"z" * 200)):
        records.append(f"WARC/1.0\r\nWARC-Type: resource\r\nwarc-record-id: <urn:x-page:{k}:a>\r\nX-Long: a\r\n b\r\nContent-Length: {len(data)}\r\n\r\n".encode() + data + b"\r\n\r\n")
    with system.open_output_stream(f"{path}/hand.warc") as out:
        out.write(b"".join(records))
    got = {}
    for r in sorted(chunks.collect(), key=lambda r: (r["record"], r["chunk"])):
        held = got.setdefault(r["record"], [])
        held.append(r)
        whole = b"".join(bytes(x["data"]) for x in held)
        assert r["payload_bytes"] == len(whole) and bytes(r["sha1"]) == hashlib.sha1(whole).digest() and len(r["data"]) <= 100
        assert r["chunk"] == len(held) - 1
    assert [sum(len(x["data"]) for x in got[k]) for k in range(4)] == [len(text), 0, 100, 200]
    assert all([x["last"] for x in v] == [False] * (len(v) - 1) + [True] for v in got.values())
    with system.open_output_stream(f"{path}/cut.warc") as out:
        out.write(records[0][:-200])
    with pytest.raises(Exception, match="ends inside"):
        warc.read(spark.createDataFrame([(f"{work.path('cut')}.warc",)], "file string")).collect()


def test_archives_of_an_empty_table(spark, work):
    files = warc.write(pages_of(spark, []), work)
    assert files.count() == 0 and warc.table_of(warc.read(files)).count() == 0
