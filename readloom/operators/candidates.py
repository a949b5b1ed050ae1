"""Candidate rows: ranking, flipping, mirroring and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.ids import id_bucket, running_total
from readloom.schemas import CANDIDATES, FWD, REV

# Ties of equal score are broken by these columns, so orders are total.
TIE_BREAK = ["sid", "qid", "qdir", "qoff", "soff", "qbeg", "sbeg"]


def by_score(df: DataFrame):
    return [F.desc("score"), *[F.col(c) for c in TIE_BREAK if c in df.columns]]


def top_candidates(cands: DataFrame, by: list[str], n: int, rank: str | None = None) -> DataFrame:
    """The ``n`` best rows per ``by`` key; ``rank`` names a column to keep it in.

    Spark cuts each input partition to n rows per key before the shuffle, so a
    key holding a large share of the rows is not gathered in one task.
    """
    name = rank or "__rank"
    ranked = cands.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*by_score(cands))))
    kept = ranked.where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def rank_batches(cands: DataFrame, by: str, batch: int) -> DataFrame:
    """Rank every candidate of a key and number the batches of ``batch`` rows.

    A key may hold any share of the rows, so ranks come from a running total
    over (score, id range) buckets instead of one sort per key.
    """
    other = "qid" if by == "sid" else "sid"
    ranked = running_total(
        cands,
        F.lit(1),
        [F.desc("score"), F.col(other), *[F.col(c) for c in TIE_BREAK if c not in (by, other)]],
        [(F.col("score"), False), (id_bucket(F.col(other)), True)],
        "rank",
        within=[by],
    )
    return ranked.withColumn("batch", F.floor((F.col("rank") - 1) / batch).cast("long"))


def _flipped() -> list[Column]:
    turned = F.col("qdir") == REV

    def side(prefix: str, part: str) -> Column:
        opposite = {"beg": "end", "end": "beg", "off": "off"}[part]
        mirrored = F.col(prefix + "size") - F.col(prefix + opposite)
        return F.when(turned, mirrored).otherwise(F.col(prefix + part))

    swap = {
        "qid": F.col("sid"),
        "sid": F.col("qid"),
        "score": F.col("score"),
        "qdir": F.when(turned, 1 - F.col("sdir")).otherwise(F.col("sdir")),
        "qsize": F.col("ssize"),
        "ssize": F.col("qsize"),
        "sdir": F.lit(FWD),
    }
    for part in ("beg", "end", "off"):
        swap["q" + part] = side("s", part)
        swap["s" + part] = side("q", part)
    return [swap[f.name].cast(f.dataType).alias(f.name) for f in CANDIDATES]


def flip(cands: DataFrame) -> DataFrame:
    """The same candidates seen from the query: it becomes the target.

    Targets stay on the forward strand, so for a reverse query both reads are
    turned around: every coordinate is counted from the other end.
    """
    return cands.select(*_flipped())


def mirror(cands: DataFrame) -> DataFrame:
    """Each candidate under both of its reads as target: twice the rows, from
    one pass over the input."""
    plain = [F.col(f.name).cast(f.dataType).alias(f.name) for f in CANDIDATES]
    return cands.select(F.inline(F.array(F.struct(*plain), F.struct(*_flipped()))))


def with_partition(cands: DataFrame, batch_size: int) -> DataFrame:
    return cands.withColumn("pid", F.floor(F.col("sid") / F.lit(batch_size)).cast("long"))


def sort_by_target(cands: DataFrame) -> DataFrame:
    """Globally ordered by target, best first, range-partitioned."""
    return cands.orderBy("sid", *by_score(cands))


def first_per_query(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per (target, query read): the lowest by ``order``."""
    others = [c for c in rows.columns if c not in ("sid", "qid")]
    best = rows.groupBy("sid", "qid").agg(
        F.min_by(F.struct(*others), F.struct(*order)).alias("__first")
    )
    return best.select("sid", "qid", "__first.*").select(*rows.columns)


def outside_overlaps(cands: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Candidates whose anchor lies in no overlap of the same read pair and
    strand (set form). Overlaps per pair are few, so the key is the pair."""
    spans = overlaps.select(
        "qid",
        "qdir",
        "sid",
        F.col("qoff").alias("o_qoff"),
        F.col("qend").alias("o_qend"),
        F.col("soff").alias("o_soff"),
        F.col("send").alias("o_send"),
    )
    same_pair = [cands[c] == spans[c] for c in ("qid", "qdir", "sid")]
    inside = cands["qoff"].between(spans["o_qoff"], spans["o_qend"]) & cands["soff"].between(
        spans["o_soff"], spans["o_send"]
    )
    condition = same_pair[0] & same_pair[1] & same_pair[2] & inside
    return cands.join(spans, condition, "left_anti")
