"""The registered queries and the pipeline on a small table."""

import os

import duckdb
import numpy as np
import pytest
from conftest import SMALL
from plain import contamination, secrets, similar_components
from test_new_operators import plain_collapse

import corpus_pipeline
from readloom.llm import toxicity
from readloom.llm.queries import ORACLE, QUERIES
from readloom.llm.text import table
from tools.check_queries import normal


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in os.listdir(SMALL):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{file}'")
    return connection


@pytest.mark.parametrize("name", ORACLE)
def test_sql(spark, db, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), db.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    a, b = normal(got), normal(want)
    for column in a.columns:
        if not a[column].isna().all() or not b[column].isna().all():  # columns without any value may have any kind
            assert a[column].astype(str).tolist() == b[column].astype(str).tolist(), column


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE and n != "op11_whitening"])
def test_one_row_per_document(spark, name):
    rows = QUERIES[name](spark, SMALL).select("doc_id").collect()
    assert sorted(r[0] for r in rows) == list(range(200))


def test_whitening_query(spark):
    """Four components a vector, white over the distinct vectors."""
    got = QUERIES["op11_whitening"](spark, SMALL).toPandas()
    assert len(got) == 4 * got["vec_id"].nunique() == 4 * 500 and set(got["component"]) == {1, 2, 3, 4}
    white = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert abs(white.T @ white / len(white) - np.eye(4)).max() < 1e-9 and got["identity_error"].max() < 1e-9
    assert got.groupby("component")["explained"].max().is_monotonic_decreasing


def test_periodic_query(spark):
    """Against all periods of every text."""
    texts = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    short = [i for i, t in texts.items() if len((t or "").split()) < 600]
    assert set(got) == set(texts) and len(short) > 100 and any(got[i][0] for i in short)
    for i in short:
        assert got[i] == plain_collapse(i, texts[i]), i


def test_pipeline(spark):
    """Every stage against its plain version, on what the stage before kept."""
    docs = table(spark, SMALL, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "decontamination", "secrets", "byte_bpe"]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SMALL).cache())
    assert all(df.columns == docs.columns for df in seen[:-1])
    texts = [{r["doc_id"]: r["text"] for r in df.collect()} for df in seen[:-1]]
    model = toxicity.fit(docs, table(spark, SMALL, "labels"))
    scores = {r[0]: r[1] for r in toxicity.score(docs, model).select("row.doc_id", "score").collect()}
    assert set(texts[1]) == {i for i, s in scores.items() if s < toxicity.THRESHOLD}
    ids = list(texts[1])
    components = similar_components(ids, [texts[1][i] for i in ids])
    assert set(texts[2]) == {i for i, (_, c) in zip(ids, components, strict=True) if i == c}
    items = [tuple(r) for r in table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    marks = contamination(list(texts[2].values()), items)
    assert set(texts[3]) == {i for i, m in zip(texts[2], marks, strict=True) if not m[4]}
    assert set(texts[4]) == set(texts[3])
    assert all(texts[4][i] == t for i, t in texts[3].items() if not secrets(t))
    assert all(not secrets(t) for t in texts[4].values())
    last = {r["doc_id"] for r in seen[-1].collect()}
    assert last == set(texts[4])
    assert corpus_pipeline.run(spark, SMALL).count() == len(last)
    for df in seen[1:]:
        df.unpersist()
