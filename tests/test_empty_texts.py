"""Queries over a table with texts that have no character, against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import normal

TEXTS = ["", None, "ACGT" * 20, "AGA tgt " * 30, "", "x" * 90]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    rows = ", ".join(f"({i}::BIGINT, {'NULL' if t is None else repr(t)}::VARCHAR)" for i, t in enumerate(TEXTS))
    duckdb.execute(f"COPY (SELECT * FROM (VALUES {rows}) v(doc_id, text)) TO '{path}/documents.parquet' (FORMAT parquet)")
    return path


def test_strings_of_empty_texts_are_restored(spark, folder):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = normal(entry.queries()["f24_aligned_strings"](spark, folder).toPandas())
    want = normal(db.execute(entry.oracle_sql()["f24_aligned_strings"]).df())
    assert len(got) == 2 * len(TEXTS)
    for column in want.columns:
        assert got[column].astype(str).tolist() == want[column].astype(str).tolist(), column


def test_paths_are_voted_beside_empty_texts(spark, folder):
    assert entry.queries()["g10_voted_paths"](spark, folder).count() == 0  # ten have to agree
