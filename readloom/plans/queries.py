"""One query per operator, over whole tables, with its SQL equivalent.

``columns`` lists the result columns: plain names are whole numbers, ``:d``
marks doubles (compared at six places) and ``:s`` text. Both sides are cast
alike. ``sql`` is the body; the common table expressions it names are in
``CTES``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import sequence as seq
from readloom.operators import blocks, candidates as cand, chaining, consensus as cns, extension, ids, intervals, kmers, packed, stats, tags
from readloom.operators import seeds as sd
from readloom.operators.alignment import attach_sequences
from readloom.plans import inputs as inp
from readloom.plans import jobs
from readloom.session import Workspace
from readloom.sources import records, sequences
from readloom.streaming.mapping import stream_files, stream_seeds

Run = Callable[[SparkSession, str], DataFrame]

K, Z, Q, BLOCK, SCORE, DDF = inp.OPTS.kmer_size, inp.OPTS.stride, inp.OPTS.max_kmer_count, 2000, 3, 0.25
_BASES = f"regexp_replace(translate(coalesce({{}}, ''), '{seq.LETTERS}', '{seq.LETTER_BASES}'), '[^ACGT]', 'A', 'g')"


@dataclass(frozen=True)
class Query:
    name: str
    columns: str
    run: Run
    sql: str | None

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        kinds = {"i": "bigint", "s": "string"}
        df = self.run(spark, sf_dir)
        out = []
        for col, kind in self._columns():
            out.append((F.round(F.col(col), 6) if kind == "d" else F.col(col).cast(kinds[kind])).alias(col))
        return df.select(*out)

    def oracle(self) -> str:
        casts = {"i": "CAST({0} AS BIGINT)", "s": "CAST({0} AS VARCHAR)", "d": "round(CAST({0} AS DOUBLE), 6)"}
        out = ", ".join(casts[kind].format(col) + f" AS {col}" for col, kind in self._columns())
        needed = [name for name in CTES if name in _closure(self.sql)]
        heads = ",\n".join(f"{name} AS ({CTES[name]})" for name in needed)
        return (f"WITH RECURSIVE {heads}\n" if heads else "") + f"SELECT {out} FROM ({self.sql}) result"

    def _columns(self) -> list[tuple[str, str]]:
        return [(c.partition(":")[0], c.partition(":")[2] or "i") for c in self.columns.split()]


def _closure(sql: str) -> set[str]:
    found: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in CTES.keys() & words - found:
            found.add(name)
            todo.append(CTES[name])
    return found


_CHAIN = "PARTITION BY qid, qdir, sid ORDER BY soff, qoff"
_HASH = " + ".join(f"((instr('ACGT', substr(kmer, {i + 1}, 1)) - 1)::BIGINT << {2 * (K - 1 - i)})" for i in range(K))


def _ddf(q1: str, s1: str, q2: str, s2: str) -> str:
    return (
        f"CASE WHEN {q1} = {q2} OR {s1} = {s2} THEN 1.0"
        f" ELSE abs(1.0 - abs({s1} - {s2})::DOUBLE / abs({q1} - {q2})) END"
    )


def _project(table: str, key: str, text: str) -> str:
    return (
        f"SELECT row_number() OVER (ORDER BY {key}) - 1 AS read_id, seq, length(seq) AS len"
        f" FROM (SELECT {key}, {_BASES.format(text)} AS seq FROM {table})"
    )


def _slices(source: str, columns: str, place: str, stride: int) -> str:
    """K-mers of a table of sequences. Sequences are cut into pieces of 500
    places first, as finding a place in a long string takes as long as it is."""
    return (
        f"SELECT {columns}, c + p AS {place}, substr(part, p + 1, {K}) AS kmer FROM"
        f" (SELECT *, unnest(range(0, least(500, len - {K} + 1 - c), {stride})) AS p FROM"
        f" (SELECT *, substr(seq, c + 1, {500 + K}) AS part FROM"
        f" (SELECT *, unnest(range(0, len - {K} + 1, 500)) AS c FROM {source})))"
    )


def _flip(prefix: str, part: str) -> str:
    mirrored = {"beg": "end", "end": "beg", "off": "off"}[part]
    return f"CASE WHEN qdir = 1 THEN {prefix}size - {prefix}{mirrored} ELSE {prefix}{part} END"


_CAND = "qid, sid, score, qdir, qbeg, qend, qoff, qsize, sdir, sbeg, send, soff, ssize"
_CLASS = (
    "CASE WHEN qoff <= 200 AND qsize - qend <= 200 THEN 'contained'"
    " WHEN soff <= 200 AND ssize - send <= 200 THEN 'contains'"
    " WHEN (qsize - qend <= 200 AND soff <= 200) OR (ssize - send <= 200 AND qoff <= 200) THEN 'overlap'"
    " ELSE 'none' END"
)
_TAG = "t_pos, delta, q_base, p_t_pos, p_delta, p_q_base"

CTES = {
    "reads": _project("documents", "doc_id", "text"),
    "placed": "SELECT *, sum(len) OVER (ORDER BY read_id) - len AS goff0 FROM reads",
    "next_starts": "SELECT a.read_id, min(b.read_id) + 1 AS next FROM placed a JOIN placed b ON b.goff0 + b.len >= a.goff0 + 50000"
    " GROUP BY a.read_id",
    "volume_walk": "SELECT 0::BIGINT AS volume_id, min(read_id)::BIGINT AS start FROM placed UNION ALL"
    " SELECT w.volume_id + 1, n.next::BIGINT FROM volume_walk w JOIN next_starts n ON n.read_id = w.start",
    "volume_starts": "SELECT volume_id, start, lead(start, 1, (SELECT count(*) FROM placed)) OVER (ORDER BY volume_id) AS stop FROM volume_walk",
    "refs": _project("benchmark", "item_id", "text"),
    "placed_refs": "SELECT *, sum(len) OVER (ORDER BY read_id) - len AS goff0 FROM refs",
    "all_kmers": _slices("placed", "read_id, goff0, len", "pos", 1),
    "sampled_kmers": _slices("placed", "read_id, goff0", "pos", Z),
    "strands": "SELECT read_id, len, 0 AS qdir, seq FROM reads UNION ALL"
    " SELECT read_id, len, 1 AS qdir, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM reads",
    "query_kmers": _slices("strands", "read_id AS qid, len AS qsize, qdir", "qoff", Z),
    "kept_kmers": f"SELECT kmer FROM all_kmers GROUP BY kmer HAVING count(*) <= {Q}",
    "kmer_table": "SELECT kmer, read_id AS sid, len AS ssize, goff0 AS sref, pos AS soff FROM all_kmers"
    " WHERE kmer IN (SELECT kmer FROM kept_kmers)",
    "seed_rows": "SELECT qid, qdir, qsize, qoff, sid, ssize, sref, soff FROM query_kmers"
    " JOIN kmer_table USING (kmer) WHERE sid < qid",
    "ref_kmers": _slices("placed_refs", "read_id, goff0, len", "pos", 1),
    "ref_table": "SELECT kmer, read_id AS sid, pos AS soff FROM ref_kmers WHERE kmer IN"
    f" (SELECT kmer FROM ref_kmers GROUP BY kmer HAVING count(*) <= {Q})",
    "ref_seeds": "SELECT qid, qdir, sid, qoff, soff FROM query_kmers JOIN ref_table USING (kmer)",
    "ref_steps": "SELECT qid, qdir, sid, qsize, s.len AS ssize, qoff, soff, soff - lag(soff) OVER c AS ds, qoff - lag(qoff) OVER c AS dq"
    " FROM query_kmers JOIN ref_table USING (kmer) JOIN refs s ON sid = s.read_id WINDOW c AS (" + _CHAIN + ")",
    "ref_chains": f"SELECT *, sum(CASE WHEN ds IS NULL OR ds > 10000 OR abs(ds - dq) > 500 THEN 1 ELSE 0 END) OVER ({_CHAIN} ROWS"
    " UNBOUNDED PRECEDING) AS chain, ds IS NULL OR ds > 10000 OR abs(ds - dq) > 500 AS brk FROM ref_steps",
    "block_rows": f"SELECT *, (sref + soff)::BIGINT // {BLOCK} AS block_id, sref + soff AS goff FROM seed_rows",
    "big_blocks": f"SELECT qid, qdir, block_id, count(*) AS n_seeds FROM block_rows GROUP BY ALL HAVING count(*) > {SCORE}",
    "big_rows": "SELECT block_rows.* FROM block_rows SEMI JOIN big_blocks USING (qid, qdir, block_id)",
    "block_pairs": "SELECT a.qid, a.qdir, a.block_id, a.sid, a.qoff, a.soff, a.goff, count(b.qid) AS score FROM big_rows a"
    " LEFT JOIN big_rows b ON a.qid = b.qid AND a.qdir = b.qdir AND a.block_id = b.block_id AND a.qoff <> b.qoff"
    f" AND a.goff <> b.goff AND {_ddf('a.qoff', 'a.goff', 'b.qoff', 'b.goff')} < {DDF}"
    " GROUP BY ALL",
    "block_best": "SELECT *, row_number() OVER (PARTITION BY qid, qdir, block_id ORDER BY score DESC, goff, qoff) AS rn"
    " FROM block_pairs",
    "anchors": f"SELECT * FROM block_best WHERE rn = 1 AND score >= {SCORE}",
    "stepped": f"SELECT *, soff - lag(soff) OVER ({_CHAIN}) AS ds, qoff - lag(qoff) OVER ({_CHAIN}) AS dq FROM seed_rows",
    "broken_steps": "SELECT *, CASE WHEN ds IS NULL OR ds > 10000 OR abs(ds - dq) > 500 THEN 1 ELSE 0 END AS brk FROM stepped",
    "numbered": f"SELECT *, sum(brk) OVER ({_CHAIN} ROWS UNBOUNDED PRECEDING) AS chain FROM broken_steps",
    "band": "SELECT qid, qdir, sid, qsize, ssize, chain, count(*) AS n_seeds,"
    " sum(CASE WHEN brk = 1 THEN 0 ELSE least(abs(dq), ds) END) AS score,"
    f" min(qoff) AS qbeg, max(qoff) + {K} AS qend, min(soff) AS sbeg, max(soff) + {K} AS send"
    f" FROM numbered GROUP BY ALL HAVING count(*) >= {SCORE} AND score >= 100",
    "cands": "SELECT *, qend AS qoff, send AS soff, 0 AS sdir FROM band",
    "turns": f"SELECT {_CAND}, greatest(qbeg - 60, 0) AS a_qoff, least(qend + 60, qsize) AS a_qend, greatest(sbeg - 60, 0) AS a_soff,"
    " least(send + 60, ssize) AS a_send, row_number() OVER (PARTITION BY qid, qdir, sid ORDER BY score DESC, qoff, soff, qbeg, sbeg)"
    " AS turn FROM cands",
    # One candidate of each pair a step, with the spans accepted before it.
    "visits": "SELECT qid, qdir, sid, 0::BIGINT AS turn, []::STRUCT(turn BIGINT, q0 BIGINT, q1 BIGINT, s0 BIGINT, s1 BIGINT)[] AS kept"
    " FROM turns WHERE turn = 1 UNION ALL SELECT v.qid, v.qdir, v.sid, t.turn, CASE WHEN a_qend - a_qoff < 180 OR len(list_filter("
    "v.kept, lambda m: qoff BETWEEN m.q0 AND m.q1 AND soff BETWEEN m.s0 AND m.s1)) > 0 THEN v.kept ELSE list_append(v.kept,"
    " {'turn': t.turn::BIGINT, 'q0': a_qoff::BIGINT, 'q1': a_qend::BIGINT, 's0': a_soff::BIGINT, 's1': a_send::BIGINT}) END"
    " FROM visits v JOIN turns t ON t.qid = v.qid AND t.qdir = v.qdir AND t.sid = v.sid AND t.turn = v.turn + 1",
    "visited": "SELECT qid, qdir, sid, unnest(arg_max(kept, turn)) AS m FROM visits GROUP BY qid, qdir, sid",
    "flipped": "SELECT sid AS qid, qid AS sid, score, CASE WHEN qdir = 1 THEN 1 - sdir ELSE sdir END AS qdir,"
    f" {_flip('s', 'beg')} AS qbeg, {_flip('s', 'end')} AS qend, {_flip('s', 'off')} AS qoff, ssize AS qsize, 0 AS sdir,"
    f" {_flip('q', 'beg')} AS sbeg, {_flip('q', 'end')} AS send, {_flip('q', 'off')} AS soff, qsize AS ssize FROM cands",
    "mirrored": f"SELECT {_CAND} FROM cands UNION ALL SELECT {_CAND} FROM flipped",
    "ovl": "SELECT qid, sid, 100.0 * score::DOUBLE / (qend - qbeg) AS ident_perc, score AS vscore, qdir, qbeg AS qoff, qend,"
    " qoff AS qext, qsize, sdir, sbeg AS soff, send, soff AS sext, ssize FROM cands",
    "aln": f"SELECT read_id // {inp.VOTERS} AS sid, read_id AS aln_id, regexp_replace(seq, 'AGA', 'A-A', 'g') AS qaln,"
    " regexp_replace(seq, 'TGT', 'T-T', 'g') AS taln FROM reads",
    "aln_cols": "SELECT sid, aln_id, pos, q, t FROM (SELECT sid, aln_id, unnest(range(1, length(qaln) + 1)) AS pos,"
    " unnest(string_split(qaln, '')) AS q, unnest(string_split(taln, '')) AS t FROM aln)",
    "tag_cols": "SELECT sid, aln_id, pos, q AS q_base, sum(CASE WHEN t <> '-' THEN 1 ELSE 0 END) OVER w - 1 AS t_pos,"
    " pos - coalesce(max(CASE WHEN t <> '-' THEN pos END) OVER w, 0) AS delta FROM aln_cols"
    " WINDOW w AS (PARTITION BY sid, aln_id ORDER BY pos ROWS UNBOUNDED PRECEDING)",
    "tag_rows": "SELECT sid, aln_id, t_pos, delta, q_base, coalesce(lag(t_pos) OVER w, -1) AS p_t_pos,"
    " coalesce(lag(delta) OVER w, 0) AS p_delta, coalesce(lag(q_base) OVER w, '-') AS p_q_base FROM tag_cols"
    " WINDOW w AS (PARTITION BY sid, aln_id ORDER BY pos)",
    "link_rows": f"SELECT sid, {_TAG}, count(*) AS link_count, count(*)::DOUBLE AS weight FROM tag_rows GROUP BY ALL",
    "nodes": "SELECT sid, t_pos, delta, q_base, sum(link_count) AS coverage FROM link_rows GROUP BY ALL",
    "span_rows": "SELECT sid, sbeg AS beg, send AS stop FROM mirrored",
    "steps": "SELECT sid, pos, sum(step) AS step FROM (SELECT sid, beg AS pos, 1 AS step FROM span_rows UNION ALL"
    " SELECT sid, stop AS pos, -1 AS step FROM span_rows) GROUP BY ALL",
    "cov": "SELECT sid, pos AS beg, lead(pos) OVER (PARTITION BY sid ORDER BY pos) AS stop,"
    " sum(step) OVER (PARTITION BY sid ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cov FROM steps",
    "deep": f"SELECT * FROM cov WHERE cov >= {inp.MIN_COV}",
    "deep_runs": "SELECT *, sum(CASE WHEN prev = beg THEN 0 ELSE 1 END) OVER (PARTITION BY sid ORDER BY beg ROWS"
    " UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(stop) OVER (PARTITION BY sid ORDER BY beg) AS prev FROM deep)",
    "island_rows": "SELECT sid, min(beg) AS beg, max(stop) AS stop FROM deep_runs GROUP BY sid, run"
    f" HAVING max(stop) - min(beg) >= {inp.MIN_ISLAND}",
    "gap_rows": "SELECT sid, beg, stop FROM (SELECT sid, coalesce(lag(stop) OVER (PARTITION BY sid ORDER BY beg, stop), 0)"
    " AS beg, beg AS stop FROM (SELECT sid, beg, stop FROM island_rows UNION ALL SELECT read_id, len, len FROM reads))"
    f" WHERE stop - beg >= {inp.MIN_GAP}",
    "piece_rows": "SELECT sid AS id, len AS org_size, beg AS lft, stop AS rgt, substr(seq, beg + 1, stop - beg) AS seq"
    " FROM island_rows JOIN reads ON sid = read_id",
    "rest_rows": "SELECT sid AS id, len AS org_size, beg AS lft, stop AS rgt, substr(seq, beg + 1, stop - beg) AS seq"
    " FROM gap_rows JOIN reads ON sid = read_id",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY sid ORDER BY score DESC, qid, qdir, qoff, soff, qbeg, sbeg) AS rn"
    " FROM mirrored",
    "idents": "SELECT sid, qid, rn, 100.0 * score::DOUBLE / (qend - qbeg) AS ident, "
    + _CLASS.replace("qoff", "qbeg").replace("soff", "sbeg")
    + " <> 'none' AS good, (qend - qbeg >= 0.6 * qsize OR send - sbeg >= 0.6 * ssize) AS long_ok FROM ranked",
    "good_ids": "SELECT sid, rn, ident, row_number() OVER (PARTITION BY sid ORDER BY rn) AS k FROM idents WHERE good",
    "long_ids": "SELECT sid, rn, ident, row_number() OVER (PARTITION BY sid ORDER BY rn) AS k FROM idents WHERE long_ok",
    "enough": "SELECT sid FROM good_ids WHERE k = 10",
    "samples": "SELECT sid, rn, ident FROM good_ids WHERE k <= 10 AND sid IN (SELECT sid FROM enough) UNION ALL"
    " SELECT sid, rn, ident FROM long_ids WHERE k <= 10 AND sid NOT IN (SELECT sid FROM enough)",
    "lens": "SELECT n_chars AS len FROM documents",
    "len_rank": "SELECT len, row_number() OVER (ORDER BY len DESC) AS rn, count(*) OVER () AS n, sum(len) OVER () AS total,"
    " sum(len) OVER (ORDER BY len DESC ROWS UNBOUNDED PRECEDING) AS cum FROM lens",
    "nxx": "SELECT (SELECT n FROM len_rank LIMIT 1) AS n, max(len) AS max, min(len) AS min, max(total)::BIGINT AS total,"
    " (max(total)::BIGINT // max(n)) AS avg, max(CASE WHEN rn = n // 2 + 1 THEN len END) AS median,"
    + ",".join(
        f" max(CASE WHEN cum >= {goal} THEN len END) AS {name}_len, min(CASE WHEN cum >= {goal} THEN rn END) AS {name}_cnt"
        for name, goal in (
            ("n25", "total::BIGINT // 4"), ("n50", "total::BIGINT // 2"), ("n75", "3 * (total::BIGINT // 4)")
        )
    )
    + " FROM len_rank",
}


def _text_lengths(spark: SparkSession, d: str) -> DataFrame:
    return inp.table(spark, d, "documents").select(F.col("n_chars").alias("len"))


def _seed_steps(spark: SparkSession, d: str) -> DataFrame:
    known = chaining.seed_steps(inp.gathered_seeds(spark, d), gathered=True)
    score = seq.ddf(F.col("qoff"), F.col("soff"), F.col("q0"), F.col("s0"))
    return known.withColumn("millionths", F.floor(score * 1e6))


def _block_seeds(spark: SparkSession, d: str) -> packed.Gathered:
    return sd.with_blocks(inp.gathered_seeds(spark, d, packed.BY_BLOCK), BLOCK)


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    return blocks.block_anchors(_block_seeds(spark, d), SCORE, DDF, gathered=True)


def _anchored(spark: SparkSession, d: str) -> DataFrame:
    rows = sd.with_blocks(inp.read_seeds(spark, d), BLOCK)
    found = sd.anchor_seeds(rows, _anchors(spark, d), DDF)
    return found.groupBy("qid", "qdir", "sid", "block_id").agg(
        F.count("*").alias("n"), F.min("soff").alias("first_soff"), F.max("soff").alias("last_soff")
    )


def _identities(spark: SparkSession, d: str) -> DataFrame:
    ranked = cand.rank_batches(cand.mirror(inp.candidates(spark, d)), "sid", 50)
    spans = ranked.withColumns({"qoff": F.col("qbeg"), "soff": F.col("sbeg")})
    return spans.select(
        "sid", F.col("rank").alias("rn"), (100.0 * F.col("score") / (F.col("qend") - F.col("qbeg"))).alias("ident"),
        seq.good_overlap().alias("good"), seq.long_span().alias("long"),
    )


def _fasta(spark: SparkSession, d: str) -> DataFrame:
    folder = Workspace(spark).path("fasta")
    lines = inp.reads(spark, d).select(F.concat(F.lit(">r"), "read_id", F.lit(" len="), "len", F.lit("\n"), "seq").alias("value"))
    lines.write.text(folder)
    return sequences.read_sequences(spark, folder)


def _fastq(spark: SparkSession, d: str) -> DataFrame:
    folder = Workspace(spark).path("fastq")
    quality = F.expr("repeat('@', len)")  # the hardest quality line to tell from a header
    parts = [F.concat(F.lit("@r"), F.col("read_id")), F.col("seq"), F.lit("+"), quality]
    inp.reads(spark, d).select(F.concat_ws("\n", *parts).alias("value")).write.option("compression", "gzip").text(folder)
    return sequences.read_sequences(spark, folder)


FILES = 6  # of each format


def _halves(spark: SparkSession, d: str, folder: str) -> None:
    """An empty folder, and the reads of even id as FASTA, the others as compressed FASTQ, in files by ranges of ids."""
    rows = inp.reads(spark, d)
    fasta = F.concat(F.lit(">r"), "read_id", F.lit("\n"), "seq")
    fastq = F.concat_ws("\n", F.concat(F.lit("@r"), F.col("read_id")), F.col("seq"), F.lit("+"), F.expr("repeat('I', len)"))
    for kind, half, value in (("fa", 0, fasta), ("fq", 1, fastq)):
        ranges = rows.where(F.col("read_id") % 2 == half).repartitionByRange(FILES, "read_id").sortWithinPartitions("read_id")
        ranges.select(value.alias("value")).write.text(f"{folder}/{kind}", compression="gzip" if half else None)
    spark.createDataFrame([], "value string").coalesce(1).write.text(f"{folder}/none")


def _listed(spark: SparkSession, d: str, read: Callable) -> DataFrame:
    """Through a list file that names the files of both formats and an empty folder."""
    folder = Workspace(spark).path("files")
    _halves(spark, d, folder)
    names = spark.createDataFrame([(f"{folder}/{k}",) for k in ("fa", "none", "fq")], "value string")
    names.coalesce(1).write.text(f"{folder}/list")
    return read(spark, sequences.list_paths(spark, f"{folder}/list"))


CHUNK = 100  # reads in a file


def _formats(spark: SparkSession, d: str) -> DataFrame:
    """The format of each file of one folder, told file by file; every third one is compressed, every fifth has no read."""
    folder = Workspace(spark).path("mixed")
    chunk, quality = F.expr(f"read_id div {CHUNK}"), F.expr("repeat('@', len)")
    fasta = F.concat(F.lit(">r\n"), "seq")
    fastq = F.concat_ws("\n", F.lit("@r"), "seq", F.lit("+"), quality)
    value = F.when(F.col("chunk") % 5 == 4, F.lit("")).otherwise(F.when(F.col("chunk") % 2 == 0, fasta).otherwise(fastq))
    rows = inp.reads(spark, d).withColumn("chunk", chunk)
    for packed in (True, False):
        some = rows.where((F.col("chunk") % 3 == 0) == F.lit(packed)).repartition("chunk")
        some.select("chunk", value.alias("value")).write.partitionBy("chunk").mode("append").text(folder, compression="gzip" if packed else None)
    found = [(int(re.search("chunk=([0-9]+)", path)[1]), kind) for path, kind in sequences.formats(spark, [folder])]
    return spark.createDataFrame(found, "chunk long, kind string")


def _candidate_files(format: str) -> Run:
    def run(spark: SparkSession, d: str) -> DataFrame:
        path = Workspace(spark).path("candidates")
        records.write_candidates(inp.candidates(spark, d), path, format)
        return records.read_candidates(spark, path, format)

    return run


def _overlap_files(spark: SparkSession, d: str) -> DataFrame:
    path = Workspace(spark).path("overlaps")
    records.write_overlaps(inp.overlaps(spark, d), path)
    return records.read_overlaps(spark, path)


def _partitions(spark: SparkSession, d: str) -> DataFrame:
    path = Workspace(spark).path("partitions")
    records.write_partitioned(cand.with_partition(cand.mirror(inp.candidates(spark, d)), 50), path)
    stored = records.read_partitions(spark, path)
    return stored.groupBy("pid").agg(
        F.count("*").alias("n"), F.min("sid").alias("first_sid"), F.max("sid").alias("last_sid"), F.sum("score").alias("score")
    )


def _stage(spark: SparkSession, d: str) -> DataFrame:
    work = Workspace(spark)
    work.stage("counts", lambda: packed.kmer_counts(inp.reads(spark, d), K))

    def fail() -> DataFrame:
        raise RuntimeError("a finished stage must not run again")

    return work.stage("counts", fail)


def _volumes(spark: SparkSession, d: str) -> DataFrame:
    return ids.volume_catalog(ids.assign_volumes(inp.reads(spark, d), 50_000))


def _links(spark: SparkSession, d: str, packed: bool = True) -> DataFrame:
    return tags.links(tags.alignment_tags(inp.alignments(spark, d), packed=True), packed=packed)


def _full(spark: SparkSession, d: str) -> DataFrame:
    spans = inp.spans(spark, d).distinct()
    deep = intervals.coverage(inp.spans(spark, d)).where(F.col("cov") >= inp.MIN_COV)
    return intervals.full_regions(spans, deep).withColumn("is_full", F.col("is_full").cast("int"))


REACH = 60  # bases that the plain extension of a chain adds at both ends


def _extended(spark: SparkSession, d: str) -> DataFrame:
    """Accepted extensions; a chain's span and some bases more stand for its alignment."""

    def stretch(some: DataFrame) -> DataFrame:
        ends = {"a_qoff": F.greatest(F.col("qbeg") - REACH, F.lit(0)), "a_qend": F.least(F.col("qend") + REACH, F.col("qsize")),
                "a_soff": F.greatest(F.col("sbeg") - REACH, F.lit(0)), "a_send": F.least(F.col("send") + REACH, F.col("ssize"))}
        return some.withColumns(ends).where(F.col("a_qend") - F.col("a_qoff") >= 3 * REACH)

    return extension.extend_in_rounds(inp.candidates(spark, d), stretch, Workspace(spark))


def _locate(spark: SparkSession, d: str) -> DataFrame:
    placed = kmers.kmers(inp.reads(spark, d).select("read_id", "offset", "seq"), K, Z)
    points = placed.select((F.col("offset") + F.col("pos")).alias("goff"))
    return intervals.locate(points, inp.reads(spark, d))


def _attached(spark: SparkSession, d: str) -> DataFrame:
    pairs = attach_sequences(inp.candidates(spark, d), inp.reads(spark, d))
    return pairs.withColumns({"qseq": F.md5("qseq"), "tseq": F.md5("tseq")})


def _batched(spark: SparkSession, d: str) -> DataFrame:
    return cand.rank_batches(cand.mirror(inp.candidates(spark, d)), "sid", 50)


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return inp.candidates(spark, d).withColumns(seq.target_window())


def _cigars(spark: SparkSession, d: str) -> DataFrame:
    pairs = inp.alignments(spark, d)
    ops = pairs.select(
        "aln_id",
        (F.length("qaln") == 0).alias("empty"),
        seq.edit_ops(F.col("qaln"), F.col("taln")).alias("plain"),
        seq.edit_ops(F.col("qaln"), F.col("taln"), extended=True).alias("full"),
    )
    return ops.select("aln_id", "empty", seq.cigar_runs(F.col("plain")).alias("cigar"), seq.cigar_runs(F.col("full")).alias("extended"))


def _restored(spark: SparkSession, d: str) -> DataFrame:
    """Aligned strings again, from the run-length texts of both forms and the sequences without gaps."""
    pairs = inp.alignments(spark, d)
    # The one column of an empty pair has no letter to restore.
    text = F.when(F.col("empty"), F.lit("")).otherwise(F.col("cigar")).alias("cigar")
    texts = _cigars(spark, d).select("aln_id", "empty", F.posexplode(F.array("cigar", "extended")).alias("is_full", "cigar"))
    texts = texts.select("aln_id", "is_full", text)
    bare = pairs.select("aln_id", F.regexp_replace("qaln", "-", "").alias("q"), F.regexp_replace("taln", "-", "").alias("t"))
    back = seq.with_aligned_strings(texts.join(bare, "aln_id"), "cigar", "q", "t")
    return back.withColumns({"q_md5": F.md5("qaln"), "t_md5": F.md5("taln")})


def _next_reads(spark: SparkSession, d: str) -> DataFrame:
    merged = ids.merge_reads(inp.pieces(spark, d), inp.rests(spark, d), order=("id", "left"))
    return merged.withColumn("digest", F.md5("seq"))


def _votes(spark: SparkSession, d: str) -> DataFrame:
    pairs = inp.alignments(spark, d).withColumn("max_cov", F.lit(10))
    return cns.consensus_pieces(tags.links(tags.alignment_tags(pairs, packed=True), ["max_cov"], packed=True, whole=True), 500)


def _consensus(full: bool) -> Run:
    def run(spark: SparkSession, d: str) -> DataFrame:
        reads = inp.reads(spark, d)
        work = Workspace(spark)
        cands = work.keep("candidates", cand.mirror(inp.candidates(spark, d)))
        opts = jobs.ConsensusOptions(full_consensus=full)
        corrected, raw = cns.consensus(reads, cands, opts, work)
        return corrected.withColumn("kind", F.lit("corrected")).union(raw.withColumn("kind", F.lit("raw")))

    return run


def _selected(spark: SparkSession, d: str) -> DataFrame:
    work = Workspace(spark)
    cands = work.keep("candidates", cand.mirror(inp.candidates(spark, d)))
    return cns.select_alignments(cands, inp.reads(spark, d), jobs.ConsensusOptions(), work)


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    best = cand.top_candidates(inp.candidates(spark, d), ["qid"], inp.OPTS.num_candidates)
    return cns.aligned_candidates(best, inp.reads(spark, d), jobs.ConsensusOptions())


def _cutoffs(spark: SparkSession, d: str) -> DataFrame:
    best = cand.top_candidates(cand.mirror(inp.candidates(spark, d)), ["sid"], cns.FIRST, rank="rank")
    aligned = cns.aligned_candidates(best, inp.reads(spark, d), jobs.ConsensusOptions())
    first = Workspace(spark).keep("first", cns.first_alignments(aligned))
    return cns.target_cutoffs(first, jobs.ConsensusOptions())


def _corrected(spark: SparkSession, d: str) -> DataFrame:
    corrected, raw = jobs.correct(inp.reads(spark, d), 2, Workspace(spark))
    return corrected.withColumn("kind", F.lit("corrected")).union(raw.withColumn("kind", F.lit("raw")))


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    work = Workspace(spark)
    inp.reads(spark, d).select("read_id", "seq", "len").write.parquet(work.path("arriving"))
    index = work.keep("index", kmers.kmer_index(kmers.target_kmers(inp.targets(spark, d), K), Q))
    query = stream_seeds(spark, work.path("arriving"), index, work.path("seeds"), work.path("progress"), inp.OPTS)
    query.awaitTermination()
    return spark.read.parquet(work.path("seeds"))


def _stream_chains(spark: SparkSession, d: str) -> DataFrame:
    """Reads in files of both formats, a few files a batch, chained against a stored index of the targets."""
    work = Workspace(spark)
    _halves(spark, d, work.path("arriving"))
    index = jobs.store_index(inp.targets(spark, d), inp.OPTS, work.path("index"))
    chained = lambda reads: chaining.band_chains(index.seeds(reads, inp.OPTS), K, SCORE)
    stream_files(spark, work.path("arriving"), chained, work.path("mapped"), work.path("progress"), FILES).awaitTermination()
    names = spark.read.parquet(work.path("mapped/reads")).select(F.col("read_id").alias("qid"), "name")
    found = spark.read.parquet(work.path("mapped/found")).join(names, "qid")
    return found.withColumn("qid", F.regexp_extract("name", "^r([0-9]+)$", 1).cast("long"))


def _ref_seeds(spark: SparkSession, d: str) -> DataFrame:
    return jobs.seeds(inp.reads(spark, d), inp.OPTS, inp.targets(spark, d))


_CAND_COLS = _CAND.replace(",", "")
_OVL_COLS = "qid sid ident_perc:d vscore qdir qoff qend qext qsize sdir soff send sext ssize"

QUERIES = [
    # Sources and sinks
    Query("s1_fasta_scan", "name:s comment:s seq:s", _fasta,
          "SELECT 'r' || read_id AS name, 'len=' || len AS comment, seq FROM reads"),
    Query("s1_fastq_gz_scan", "name:s seq:s qual:s", _fastq,
          "SELECT 'r' || read_id AS name, seq, repeat('@', len) AS qual FROM reads"),
    Query("s4_read_catalog", "read_id len global_off",
          lambda s, d: inp.reads_of(s, d).withColumnRenamed("offset", "global_off"),
          "SELECT read_id, len, goff0 AS global_off FROM placed"),
    Query("s5_volumes", "volume_id read_start_id read_count n_bases", _volumes,
          "SELECT goff0::BIGINT // 50000 AS volume_id, min(read_id) AS read_start_id, count(*) AS read_count,"
          " sum(len) AS n_bases FROM placed GROUP BY 1"),
    Query("s5_greedy_volumes", "volume_id read_start_id read_count n_bases",
          lambda s, d: ids.volume_catalog(ids.greedy_volumes(inp.reads(s, d), 50_000, Workspace(s))),
          "SELECT volume_id, start AS read_start_id, count(*) AS read_count, sum(len) AS n_bases FROM volume_starts v JOIN placed p"
          " ON p.read_id >= start AND p.read_id < stop GROUP BY ALL"),
    Query("s2_file_list", "name:s seq:s", lambda s, d: _listed(s, d, sequences.read_sequences),
          "SELECT 'r' || read_id AS name, seq FROM reads"),
    Query("s3_formats", "chunk kind:s", _formats,
          f"SELECT read_id // {CHUNK} AS chunk, CASE WHEN read_id // {CHUNK} % 5 = 4 THEN 'empty' WHEN read_id // {CHUNK} % 2 = 0"
          " THEN 'fasta' ELSE 'fastq' END AS kind FROM reads GROUP BY ALL"),
    Query("p1_build_reads", "read_id len global_off digest:s", lambda s, d: _listed(
              s, d, lambda spark, paths: jobs.build_reads_from(spark, paths)
              .withColumns({"global_off": F.col("offset"), "digest": F.md5("seq")})),
          "SELECT row_number() OVER (ORDER BY read_id % 2, read_id) - 1 AS read_id, len, sum(len) OVER (ORDER BY read_id % 2, read_id)"
          " - len AS global_off, md5(seq) AS digest FROM reads"),
    Query("s6_read_counts", "source:s n_reads n_bases",
          lambda s, d: stats.read_counts(inp.table(s, d, "documents").withColumnRenamed("n_chars", "len"), "source"),
          "SELECT source, count(*) AS n_reads, sum(n_chars) AS n_bases FROM documents GROUP BY ROLLUP (source)"),
    Query("s7_merge_read_sets", "read_id len global_off",
          lambda s, d: ids.merge_reads(inp.reads(s, d), inp.targets(s, d)).withColumnRenamed("offset", "global_off"),
          "SELECT read_id, len, sum(len) OVER (ORDER BY read_id) - len AS global_off FROM (SELECT read_id, len FROM reads"
          " UNION ALL SELECT read_id + (SELECT count(*) FROM reads), len FROM refs)"),
    Query("s8_candidate_text_files", _CAND_COLS, _candidate_files("csv"), f"SELECT {_CAND} FROM cands"),
    Query("s10_candidate_parquet_files", _CAND_COLS, _candidate_files("parquet"), f"SELECT {_CAND} FROM cands"),
    Query("s9_overlap_text_files", _OVL_COLS, _overlap_files,
          "SELECT * REPLACE (CAST(printf('%.2f', ident_perc) AS DOUBLE) AS ident_perc) FROM ovl"),
    Query("s11_partitioned_candidates", "pid n first_sid last_sid score", _partitions,
          "SELECT sid // 50 AS pid, count(*) AS n, min(sid) AS first_sid, max(sid) AS last_sid, sum(score) AS score"
          " FROM mirrored GROUP BY 1"),
    Query("s12_corrected_fasta", "value:s", lambda s, d: sequences.to_fasta(inp.pieces(s, d)),
          "SELECT '>' || id || '_' || org_size || '_' || lft || '_' || rgt || '_' || length(seq) || chr(10) || seq AS value"
          " FROM piece_rows"),
    Query("s13_raw_fasta", "value:s", lambda s, d: sequences.to_fasta(inp.rests(s, d)),
          "SELECT '>' || id || '_' || org_size || '_' || lft || '_' || rgt || '_' || length(seq) || chr(10) || seq AS value"
          " FROM rest_rows"),
    Query("s14_resumed_stage", "kmer:s n", _stage, "SELECT kmer, count(*) AS n FROM all_kmers GROUP BY kmer"),
    # Projections, filters, scalar functions
    Query("f1_encode", "doc_id codes:s",
          lambda s, d: inp.table(s, d, "documents").select("doc_id", seq.encode(F.col("text")).alias("codes")),
          "SELECT doc_id, translate(regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT-]', 'N', 'g'), 'ACGTN-', '012345')"
          " AS codes FROM documents"),
    Query("f2_decode", "doc_id seq:s",
          lambda s, d: inp.table(s, d, "documents").select(
              "doc_id", seq.decode(seq.encode(seq.project_text(F.col("text")))).alias("seq")),
          f"SELECT doc_id, {_BASES.format('text')} AS seq FROM documents"),
    Query("f3_reverse_complement", "read_id rc:s",
          lambda s, d: inp.reads(s, d).select("read_id", seq.revcomp(F.col("seq")).alias("rc")),
          "SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM reads"),
    Query("f4_subsequence", "read_id sub:s",
          lambda s, d: inp.reads(s, d).select(
              "read_id",
              seq.subseq(F.col("seq"), F.expr("len div 4"), F.expr("len - len div 3"), (F.col("read_id") % 2).cast("int")).alias("sub")),
          "SELECT read_id, substr(CASE WHEN read_id % 2 = 1 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END,"
          " len // 4 + 1, len - len // 3 - len // 4) AS sub FROM reads"),
    Query("f5_min_length", "doc_id len",
          lambda s, d: stats.min_length(inp.table(s, d, "documents").select("doc_id", F.col("n_chars").alias("len")), 1000),
          "SELECT doc_id, n_chars AS len FROM documents WHERE n_chars >= 1000"),
    Query("f6_kmers", "read_id pos kmer:s", lambda s, d: inp.read_kmers(s, d), "SELECT read_id, pos, kmer FROM all_kmers"),
    Query("f7_sampled_kmers", "read_id pos kmer:s", lambda s, d: inp.read_kmers(s, d, Z),
          "SELECT read_id, pos, kmer FROM sampled_kmers"),
    Query("f8_kmer_hash", "read_id pos hash",
          lambda s, d: kmers.kmers(inp.reads(s, d).select("read_id", "seq"), K, Z, hashed=True).withColumnRenamed("kmer", "hash"),
          f"SELECT read_id, pos, {_HASH} AS hash FROM sampled_kmers"),
    Query("f9_block_id", "qid qdir sid qoff soff block_id",
          lambda s, d: sd.with_blocks(inp.read_seeds(s, d), BLOCK),
          "SELECT qid, qdir, sid, qoff, soff, block_id FROM block_rows"),
    Query("f10_ddf_score", "qid qdir sid qoff soff millionths", _seed_steps,
          f"SELECT qid, qdir, sid, qoff, soff, floor(({_ddf('qoff', 'soff', '(qoff - dq)', '(soff - ds)')})::DOUBLE * 1000000) AS millionths FROM stepped"
          " WHERE ds IS NOT NULL"),
    Query("f11_overlap_class", "qid qdir sid qext sext kind:s",
          lambda s, d: inp.overlaps(s, d).withColumn("kind", seq.overlap_class(200)),
          f"SELECT qid, qdir, sid, qext, sext, {_CLASS} AS kind FROM ovl"),
    Query("f12_good_overlaps", _OVL_COLS, lambda s, d: inp.overlaps(s, d).where(seq.good_overlap(200)),
          f"SELECT * FROM ovl WHERE {_CLASS} <> 'none'"),
    Query("f13_long_spans", _OVL_COLS, lambda s, d: inp.overlaps(s, d).where(seq.long_span(0.6)),
          "SELECT * FROM ovl WHERE qend - qoff >= 0.6 * qsize OR send - soff >= 0.6 * ssize"),
    Query("f14_identity", "aln_id ident:d",
          lambda s, d: inp.alignments(s, d).select("aln_id", seq.identity(F.col("qaln"), F.col("taln")).alias("ident")),
          "SELECT aln_id, 100.0 * sum(CASE WHEN q = t THEN 1 ELSE 0 END)::DOUBLE / count(*) AS ident FROM aln_cols GROUP BY aln_id"),
    Query("f15_flip", _CAND_COLS, lambda s, d: cand.flip(inp.candidates(s, d)), f"SELECT {_CAND} FROM flipped"),
    Query("f16_target_window", "qid qdir sid qoff soff sfrom sto srel", _windows,
          "SELECT qid, qdir, sid, qoff, soff, soff - l AS sfrom, soff + r AS sto, l AS srel FROM (SELECT *,"
          " least(CASE WHEN qoff < soff THEN trunc(qoff * 1.3::DOUBLE)::BIGINT ELSE soff END, soff) AS l,"
          " least(CASE WHEN qsize - qoff < ssize - soff THEN trunc((qsize - qoff) * 1.3::DOUBLE)::BIGINT ELSE ssize - soff END,"
          " ssize - soff) AS r FROM cands)"),
    Query("f17_partition_id", "qid sid qdir qoff soff pid", lambda s, d: cand.with_partition(cand.mirror(inp.candidates(s, d)), 50),
          "SELECT qid, sid, qdir, qoff, soff, sid // 50 AS pid FROM mirrored"),
    Query("f18_split_long_reads", "id read_id beg seq:s", lambda s, d: stats.split_long(inp.reads(s, d), 100, 400),
          "SELECT row_number() OVER (ORDER BY read_id, beg) - 1 AS id, read_id, beg, substr(seq, beg + 1, 400) AS seq FROM"
          " (SELECT *, unnest(range(0, len, 400)) AS beg FROM reads) WHERE length(substr(seq, beg + 1, 400)) >= 100"),
    Query("f21_chain_seed_filter", "qid qdir sid block_id n first_soff last_soff", _anchored,
          "SELECT a.qid, a.qdir, a.sid, a.block_id, count(*) AS n, min(b.soff) AS first_soff, max(b.soff) AS last_soff"
          " FROM anchors a JOIN seed_rows b ON a.qid = b.qid AND a.qdir = b.qdir AND a.sid = b.sid"
          f" WHERE (a.qoff = b.qoff AND a.soff = b.soff) OR {_ddf('a.qoff', 'a.soff', 'b.qoff', 'b.soff')} < {DDF} GROUP BY 1, 2, 3, 4"),
    Query("f23_cigar", "aln_id cigar:s extended:s", _cigars,
          "SELECT aln_id, max(plain) AS cigar, max(ext) AS extended FROM (SELECT aln_id,"
          " string_agg(CASE WHEN k = 'p' THEN n || op END, '' ORDER BY start) AS plain,"
          " string_agg(CASE WHEN k = 'e' THEN n || op END, '' ORDER BY start) AS ext FROM (SELECT aln_id, k, op, min(pos) AS start,"
          " count(*) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY aln_id, k, op ORDER BY pos) AS run FROM"
          " (SELECT aln_id, pos, 'p' AS k, CASE WHEN t = '-' THEN 'I' WHEN q = '-' THEN 'D' ELSE 'M' END AS op FROM aln_cols"
          " UNION ALL SELECT aln_id, pos, 'e' AS k, CASE WHEN t = '-' THEN 'I' WHEN q = '-' THEN 'D' WHEN q = t THEN '='"
          " ELSE 'X' END AS op FROM aln_cols)) GROUP BY aln_id, k, op, run) GROUP BY aln_id, k) GROUP BY aln_id"),
    Query("f24_aligned_strings", "aln_id is_full q_used t_used q_md5:s t_md5:s", _restored,
          "SELECT aln_id, is_full, length(replace(qaln, '-', '')) AS q_used, length(replace(taln, '-', '')) AS t_used, md5(qaln) AS"
          " q_md5, md5(taln) AS t_md5 FROM aln, (SELECT unnest([0, 1]) AS is_full) f"),
    # Joins
    Query("j1_seed_self_join", "qid qdir sid qoff soff", inp.read_seeds, "SELECT qid, qdir, sid, qoff, soff FROM seed_rows"),
    Query("j1_pairs_by_seed_count", "qid qdir sid n_seeds sbeg last_soff",
          lambda s, d: sd.pair_counts(inp.read_seeds(s, d), SCORE),
          "SELECT qid, qdir, sid, count(*) AS n_seeds, min(soff) AS sbeg, max(soff) AS last_soff FROM seed_rows"
          f" GROUP BY qid, qdir, sid HAVING count(*) > {SCORE}"),
    Query("j2_target_seed_join", "qid qdir sid qoff soff", _ref_seeds, "SELECT * FROM ref_seeds"),
    Query("j3_attached_sequences", "qid qdir sid qoff soff qseq:s tseq:s", _attached,
          "SELECT qid, c.qdir, sid, qoff, soff, md5(q.seq) AS qseq, md5(t.seq) AS tseq FROM cands c"
          " JOIN strands q ON q.read_id = qid AND q.qdir = c.qdir JOIN reads t ON t.read_id = sid"),
    Query("j4_anchors_outside_overlaps", _CAND_COLS,
          lambda s, d: cand.outside_overlaps(
              inp.candidates(s, d).withColumns({"qoff": F.col("qbeg"), "soff": F.col("sbeg")}), inp.best_overlaps(s, d)),
          "SELECT qid, sid, score, qdir, qbeg, qend, qbeg AS qoff, qsize, sdir, sbeg, send, sbeg AS soff, ssize FROM cands c"
          " WHERE NOT EXISTS (SELECT 1 FROM (SELECT *, row_number() OVER (PARTITION BY qid, qdir, sid ORDER BY vscore DESC, qext,"
          " sext, qoff, soff) AS k FROM ovl) o WHERE k = 1 AND o.qid = c.qid AND o.qdir = c.qdir AND o.sid = c.sid"
          " AND c.qbeg BETWEEN o.qoff AND o.qend AND c.sbeg BETWEEN o.soff AND o.send)"),
    Query("j5_uncorrected_reads", 'id org_size seq:s', lambda s, d: cns.uncorrected(inp.reads(s, d), inp.pieces(s, d).select("id")),
          "SELECT read_id AS id, len AS org_size, seq FROM reads WHERE read_id NOT IN (SELECT sid FROM island_rows)"),
    Query("j6_first_per_query", _CAND_COLS,
          lambda s, d: cand.first_per_query(_batched(s, d), ["rank"]),
          f"SELECT {_CAND} FROM (SELECT *, row_number() OVER (PARTITION BY sid, qid ORDER BY rn) AS k FROM ranked) WHERE k = 1"),
    Query("j7_block_seed_pairs", "qid qdir block_id n_seeds n_pairs",
          lambda s, d: blocks.block_scores(_block_seeds(s, d), SCORE, DDF, gathered=True),
          "SELECT qid, qdir, block_id, count(*) AS n_seeds, sum(score)::BIGINT // 2 AS n_pairs FROM block_pairs GROUP BY 1, 2, 3"),
    Query("j8_located_offsets", "goff read_id", _locate, "SELECT goff0 + pos AS goff, read_id FROM sampled_kmers"),
    Query("j9_anchor_neighbours", "qid qdir sid n_anchors n_rows",
          lambda s, d: _anchored(s, d).groupBy("qid", "qdir", "sid").agg(F.count("*").alias("n_anchors"), F.sum("n").alias("n_rows")),
          "SELECT a.qid, a.qdir, a.sid, count(DISTINCT a.block_id) AS n_anchors, count(*) AS n_rows"
          " FROM anchors a JOIN seed_rows b ON a.qid = b.qid AND a.qdir = b.qdir AND a.sid = b.sid"
          f" WHERE (a.qoff = b.qoff AND a.soff = b.soff) OR {_ddf('a.qoff', 'a.soff', 'b.qoff', 'b.soff')} < {DDF} GROUP BY 1, 2, 3"),
    # Aggregations
    Query("a1_kmer_counts", "kmer:s n", lambda s, d: packed.kmer_counts(inp.reads(s, d), K),
          "SELECT kmer, count(*) AS n FROM all_kmers GROUP BY kmer"),
    Query("a2_kept_kmers", "kmer:s n", lambda s, d: packed.kmer_counts(inp.reads(s, d), K).where(F.col("n") <= 20),
          "SELECT kmer, count(*) AS n FROM all_kmers GROUP BY kmer HAVING count(*) <= 20"),
    Query("a3_kmer_index", "kmer:s sid soff", lambda s, d: packed.kmer_index(inp.reads(s, d), K, 20),
          "SELECT kmer, read_id AS sid, pos AS soff FROM all_kmers WHERE kmer IN"
          " (SELECT kmer FROM all_kmers GROUP BY kmer HAVING count(*) <= 20)"),
    Query("a4_block_counts", "qid qdir block_id n_seeds",
          lambda s, d: blocks.block_counts(_block_seeds(s, d), SCORE), "SELECT * FROM big_blocks"),
    Query("a5_block_anchors", "qid qdir block_id sid qoff soff score",
          _anchors, "SELECT * FROM anchors"),
    Query("a6_a7_length_stats", "n max min total avg median n25_len n25_cnt n50_len n50_cnt n75_len n75_cnt",
          lambda s, d: stats.length_stats(_text_lengths(s, d)), "SELECT * FROM nxx"),
    Query("a8_identity_cutoff", "sid n avg:d cutoff:d",
          lambda s, d: intervals.identity_cutoff(intervals.identity_samples(_identities(s, d))),
          "SELECT sid, count(*) AS n, avg(ident) AS avg, avg(ident) - 5 * stddev_pop(ident) AS cutoff FROM samples"
          " GROUP BY sid HAVING count(*) >= 5"),
    Query("a9_identity_samples", "sid rn ident:d", lambda s, d: intervals.identity_samples(_identities(s, d)), "SELECT * FROM samples"),
    Query("a10_coverage", "sid beg stop cov",
          lambda s, d: intervals.coverage(inp.spans(s, d)).withColumnRenamed("end", "stop"), "SELECT * FROM cov WHERE cov > 0"),
    Query("a11_full_regions", "sid beg stop is_full", lambda s, d: _full(s, d).withColumnRenamed("end", "stop"),
          "SELECT r.sid, r.beg, r.stop, CASE WHEN sum(CASE WHEN g.sid IS NULL THEN 0 ELSE least(r.stop, g.stop) - greatest(r.beg, g.beg) END) + 200"
          " >= r.stop - r.beg THEN 1 ELSE 0 END AS is_full FROM (SELECT DISTINCT * FROM span_rows) r LEFT JOIN deep g"
          " ON g.sid = r.sid AND g.beg < r.stop AND g.stop > r.beg GROUP BY r.sid, r.beg, r.stop"),
    Query("a12_link_votes", "sid t_pos delta q_base:s p_t_pos p_delta p_q_base:s link_count weight:d",
          lambda s, d: _links(s, d, packed=False),
          "SELECT * FROM link_rows"),
    Query("a13_node_coverage", "sid t_pos delta q_base:s coverage", lambda s, d: tags.node_coverage(_links(s, d)),
          "SELECT * FROM nodes"),
    Query("a14_a15_column_stats", "sid t_pos coverage n_delta", lambda s, d: tags.column_stats(_links(s, d)),
          "SELECT sid, t_pos, sum(CASE WHEN delta = 0 THEN link_count ELSE 0 END) AS coverage, max(delta) + 1 AS n_delta"
          " FROM link_rows GROUP BY 1, 2"),
    Query("a16_distinct_queries", "sid n_queries",
          lambda s, d: cand.mirror(inp.candidates(s, d)).select("sid", "qid").distinct().groupBy("sid").agg(F.count("*").alias("n_queries")),
          "SELECT sid, count(DISTINCT qid) AS n_queries FROM mirrored GROUP BY sid"),
    # Windows
    Query("w1_w2_ids_and_offsets", "doc_id read_id global_off",
          lambda s, d: ids.with_offsets(
              ids.dense_ids(inp.table(s, d, "documents").select("doc_id", F.col("n_chars").alias("len")), "doc_id")
          ).withColumnRenamed("offset", "global_off"),
          "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS read_id, sum(n_chars) OVER (ORDER BY doc_id) - n_chars"
          " AS global_off FROM documents"),
    Query("w3_query_ranks", "qid rank sid qdir score qoff soff",
          lambda s, d: cand.rank_batches(inp.candidates(s, d), "qid", 200),
          "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, sid, qdir, qoff, soff, qbeg, sbeg)"
          " AS rank, sid, qdir, score, qoff, soff FROM cands"),
    Query("w4_target_batches", "sid rank batch qid score", _batched,
          "SELECT sid, rn AS rank, (rn - 1) // 50 AS batch, qid, score FROM ranked"),
    Query("w5_w6_g8_alignment_tags", "sid aln_id t_pos delta q_base:s p_t_pos p_delta p_q_base:s",
          lambda s, d: tags.alignment_tags(inp.alignments(s, d)), "SELECT * FROM tag_rows"),
    Query("w7_coverage_islands", "sid beg stop", lambda s, d: inp.covered(s, d).withColumnRenamed("end", "stop"),
          "SELECT * FROM island_rows"),
    Query("w8_uncovered_gaps", "sid beg stop",
          lambda s, d: intervals.gaps(inp.covered(s, d), inp.sizes(s, d), inp.MIN_GAP).withColumnRenamed("end", "stop"),
          "SELECT * FROM gap_rows"),
    Query("w9_cumulative_lengths", "doc_id len cum_len",
          lambda s, d: stats.cumulative_lengths(inp.table(s, d, "documents").select("doc_id", F.col("n_chars").alias("len")), "doc_id"),
          "SELECT doc_id, n_chars AS len, sum(n_chars) OVER (ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS cum_len"
          " FROM documents"),
    Query("w10_target_ranges", "sid n best_score",
          lambda s, d: cand.mirror(inp.candidates(s, d)).groupBy("sid").agg(F.count("*").alias("n"), F.max("score").alias("best_score")),
          "SELECT sid, count(*) AS n, max(score) AS best_score FROM mirrored GROUP BY sid"),
    # Sorts and top-k
    Query("t1_sorted_seeds", "qid qdir sid soff qoff",
          lambda s, d: inp.read_seeds(s, d).repartition("qid", "qdir").sortWithinPartitions("qid", "qdir", F.col("sref") + F.col("soff"), "qoff"),
          "SELECT qid, qdir, sid, soff, qoff FROM seed_rows"),
    Query("t2_candidates_by_score", _CAND_COLS, lambda s, d: inp.candidates(s, d).orderBy(*cand.by_score(inp.candidates(s, d))),
          f"SELECT {_CAND} FROM cands ORDER BY score DESC, sid, qid, qdir, qoff, soff"),
    Query("t3_candidates_by_target", _CAND_COLS, lambda s, d: cand.sort_by_target(cand.mirror(inp.candidates(s, d))),
          f"SELECT {_CAND} FROM mirrored ORDER BY sid, score DESC"),
    Query("t4_kmer_order", "kmer:s read_id pos", lambda s, d: packed.kmers_in_order(inp.reads(s, d), K),
          "SELECT kmer, read_id, pos FROM all_kmers ORDER BY kmer, read_id, pos"),
    Query("t5_tag_order", "sid t_pos delta q_base:s p_t_pos p_delta p_q_base:s aln_id",
          lambda s, d: tags.in_order(inp.alignments(s, d)),
          f"SELECT sid, {_TAG}, aln_id FROM tag_rows ORDER BY ALL"),
    Query("t6_lengths_descending", "len", lambda s, d: _text_lengths(s, d).orderBy(F.desc("len")),
          "SELECT len FROM lens ORDER BY len DESC"),
    Query("t8_t9_top_candidates", _CAND_COLS, lambda s, d: cand.top_candidates(inp.candidates(s, d), ["qid"], 10),
          f"SELECT {_CAND} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, sid, qdir, qoff, soff, qbeg,"
          " sbeg) AS rank FROM cands) WHERE rank <= 10"),
    Query("t10_first_candidates", _CAND_COLS, lambda s, d: cand.top_candidates(cand.mirror(inp.candidates(s, d)), ["sid"], 50),
          f"SELECT {_CAND} FROM ranked WHERE rn <= 50"),
    # Set operations
    Query("u1_both_strands", "read_id qdir seq:s", lambda s, d: kmers.both_strands(inp.reads(s, d)),
          "SELECT read_id, qdir, seq FROM strands"),
    Query("u2_concatenated_seeds", "qid sid n",
          lambda s, d: _ref_seeds(s, d).select("qid", "sid").unionByName(inp.read_seeds(s, d).select("qid", "sid"))
          .groupBy("qid", "sid").agg(F.count("*").alias("n")),
          "SELECT qid, sid, count(*) AS n FROM (SELECT qid, sid FROM ref_seeds UNION ALL SELECT qid, sid FROM seed_rows) GROUP BY 1, 2"),
    Query("u3_mirrored_candidates", _CAND_COLS, lambda s, d: cand.mirror(inp.candidates(s, d)), f"SELECT {_CAND} FROM mirrored"),
    Query("u4_next_round_reads", "read_id len global_off digest:s",
          lambda s, d: _next_reads(s, d).withColumnRenamed("offset", "global_off"),
          "SELECT read_id, len, sum(len) OVER (ORDER BY read_id) - len AS global_off, digest FROM (SELECT row_number() OVER"
          " (ORDER BY part, id, lft) - 1 AS read_id, length(seq) AS len, md5(seq) AS digest FROM (SELECT 0 AS part, * FROM"
          " piece_rows UNION ALL SELECT 1 AS part, * FROM rest_rows))"),
    # Grouped operators and jobs
    Query("g4v_band_chains", _CAND_COLS + " n_seeds", inp.candidates_of, f"SELECT {_CAND}, n_seeds FROM cands"),
    Query("g4_chains", _CAND_COLS, lambda s, d: chaining.chain_pairs(inp.gathered_seeds(s, d), K, SCORE, gathered=True), None),
    Query("g5_accepted_extensions", _CAND_COLS + " a_qoff a_qend a_soff a_send", _extended,
          "SELECT t.* FROM turns t JOIN visited v ON t.qid = v.qid AND t.qdir = v.qdir AND t.sid = v.sid AND t.turn = v.m.turn"),
    Query("g3_aligned_pairs", "qid qdir sid qoff soff a_qoff a_qend a_soff a_send ident:d qaln:s taln:s", _aligned, None),
    Query("g6_target_cutoffs", "sid cutoff:d max_cov last_rank ssize", _cutoffs, None),
    Query("g7_selected_alignments", "sid rank qid qdir a_soff a_send ident:d qaln:s taln:s", _selected, None),
    Query("g10v_column_majority", "sid t_pos delta base:s votes", lambda s, d: tags.column_majority(_links(s, d)),
          "SELECT sid, t_pos, delta, q_base AS base, coverage AS votes FROM (SELECT *, row_number() OVER (PARTITION BY sid, t_pos,"
          " delta ORDER BY coverage DESC, instr('ACGT-', q_base)) AS k FROM nodes) WHERE k = 1"),
    Query("g10_voted_paths", "sid left right raw_from raw_to seq:s", _votes, None),
    Query("g11_broken_consensus", "id org_size left right seq:s kind:s", _consensus(False), None),
    Query("g12_full_consensus", "id org_size left right seq:s kind:s", _consensus(True), None),
    Query("p2_find_candidates", _CAND_COLS, lambda s, d: jobs.find_candidates(inp.reads(s, d), inp.OPTS), None),
    Query("p3_find_overlaps", _OVL_COLS, lambda s, d: jobs.find_overlaps(inp.reads(s, d), inp.OPTS), None),
    Query("p4_map_to_reference", _OVL_COLS, lambda s, d: jobs.map_to_reference(inp.reads(s, d), inp.pages(s, d), inp.OPTS), None),
    Query("p5_mirror_partition", _CAND_COLS + " pid",
          lambda s, d: jobs.mirror_partition(inp.candidates(s, d), jobs.PartitionOptions(batch_size=50)),
          f"SELECT {_CAND}, sid // 50 AS pid FROM mirrored"),
    Query("p7_two_correction_rounds", "id org_size left right seq:s kind:s", _corrected, None),
    Query("p8_length_report", "line value:s", lambda s, d: jobs.report_lengths(_text_lengths(s, d)),
          "SELECT unnest(range(0, 9)) AS line, unnest([" + ", ".join(
              [f"'{label}' || format('{{:,}}', {col}::BIGINT)" for label, col in (
                  ("Number of sequences:\t\t", "n"), ("Number of bps:\t\t\t", "total"), ("Max length:\t\t\t", "max"),
                  ("Min length:\t\t\t", "min"), ("Average length:\t\t\t", "avg"), ("Median length:\t\t\t", "median"))]
              + [f"'N{p} stats:\t\t\t{p}% of total sequences are contained in the ' || format('{{:,}}', n{p}_cnt::BIGINT) ||"
                 f" ' sequences having >= ' || format('{{:,}}', n{p}_len::BIGINT) || ' bps'" for p in (25, 50, 75)]
          ) + "]) AS value FROM nxx"),
    Query("x1_streamed_mapping", _CAND_COLS + " n_seeds", _stream_chains,
          f"SELECT qid, sid, sum(CASE WHEN brk THEN 0 ELSE least(abs(dq), ds) END) AS score, qdir, min(qoff) AS qbeg, max(qoff) + {K}"
          f" AS qend, max(qoff) + {K} AS qoff, qsize, 0 AS sdir, min(soff) AS sbeg, max(soff) + {K} AS send, max(soff) + {K} AS soff,"
          f" ssize, count(*) AS n_seeds FROM ref_chains GROUP BY qid, qdir, sid, qsize, ssize, chain HAVING count(*) >= {SCORE}"
          " AND sum(CASE WHEN brk THEN 0 ELSE least(abs(dq), ds) END) >= 100"),
    Query("x1_streamed_target_seeds", "qid qdir sid qoff soff", _streamed, "SELECT * FROM ref_seeds"),
]
