"""One query for each operator of this subpackage, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import byte_bpe, decontaminate, jaccard, periodic, pii, pivots, secrets, separators, substrings, token_files, toxicity, warc, whitening
from readloom.llm.text import table
from readloom.session import Workspace


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark)
    token_files.write(table(spark, sf_dir, "documents"), work.path("ids.orc"))
    return token_files.counts(spark, work.path("ids.orc"), work)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = substrings.remove(docs, Workspace(spark), keep=["doc_id"], digest=True)
    return kept.select("row.doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.report(decontaminate.hits(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"]))
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.find(docs, Workspace(spark), ["doc_id"])).select("row.doc_id", "*").drop("row")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.round_trip(docs, keep=["doc_id"]).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digest(pii.find(docs, Workspace(spark), ["doc_id"])).select("row.doc_id", "*").drop("row")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "row.doc_id", (toxicity.remainder("row.doc_id") == 2).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op8_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark)
    blocks = work.keep("flat", separators.flat_files(table(spark, sf_dir, "documents")))
    return separators.count_tokens(blocks)


def op9_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5, Workspace(spark))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.classes(table(spark, sf_dir, "documents"), Workspace(spark))
    return found.select("doc_id", "n_shingles", "component_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors, Workspace(spark))
    found = whitening.whiten(vectors, model, keep=["vec_id"])
    return found.select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The words that the contract has a tenth of the documents repeat from a place on; a null id has none."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10:
        return None
    g = h // 10
    a = g % n
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return order


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.digested(periodic.collapse(docs, keep=["doc_id"], digest=True, places=planted))
    return found.select("row.doc_id", "*").drop("row")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write(table(spark, sf_dir, "pages"), Workspace(spark))
    found = warc.table_of(warc.read(files, with_data=False))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_orc, op2_substring_dedup, op3_decontamination, op4_secrets, op5_byte_bpe, op6_personal_data, op7_toxicity, op8_separator_scan,
        op9_pivot_search, op10_jaccard_join, op11_whitening, op12_periodic_runs, op13_warc,
    )
}

#: SQL of the lower-cased words of decontamination, and of words between white space.
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PARTS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_FOLDED)

ORACLE: dict[str, str] = {
    "op2_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_PARTS.format("coalesce(text, '')")} AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM d, range(1, len(w) - 33) r(i)),
        rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
        hit AS (SELECT DISTINCT doc_id, p FROM win SEMI JOIN rep USING (s), range(i, i + 35) q(p)),
        word AS (SELECT doc_id, p, w[p] AS x FROM d, range(1, len(w) + 1) q(p)),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op3_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
        bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM b, range(1, len(w) - n + 2) r(i)),
        dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM bw), range(1, len(w) - n + 2) r(i)),
        found AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, s)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, range(i, i + n) q(p) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM found) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items,
               sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op9_pivot_search": """
        WITH v AS (
            SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
            WHERE len(embedding) = len([x FOR x IN embedding IF isfinite(x)])
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 5""",
    "op10_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_PARTS.format(_FOLDED)} AS w FROM documents),
        g AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM d, range(1, greatest(len(w) - 2, 2)) r(i) WHERE len(w) > 0
        ),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        pairs AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
        ),
        link AS (
            SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)
        ),
        reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
        SELECT doc_id, coalesce(max(n.n), 0) AS n_shingles, least(doc_id, min(b)) AS component_id
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON a = doc_id GROUP BY doc_id""",
    "op13_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        h AS (SELECT page_id, t, strlen(t) AS n, sha1(t) AS d, max(page_id) OVER (PARTITION BY t) AS newest FROM p),
        v AS (SELECT *, [('0x' || substr(d, 5 * g + 1, 5))::BIGINT FOR g IN range(8)] AS five FROM h),
        b AS (SELECT *, list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            (1 + ((five[1 + i // 4] >> (15 - 5 * (i % 4))) & 31))::BIGINT, 1)) AS letters FROM v)
        SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(letters, '') AS payload_digest,
               CASE WHEN newest IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN newest IS DISTINCT FROM page_id THEN newest END AS refers_to, true AS verified
        FROM b""",
}
