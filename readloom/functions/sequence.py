"""Column functions on sequences, coordinates and aligned strings (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The alphabet, its digit codes, and the complement.
BASES, DIGITS, COMPLEMENT = "ACGT", "0123", "TGCA"
# Texts as sequences: a letter of A-Z in either case is the base at its place
# in the alphabet modulo 4; every other character is A.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LETTER_BASES = "".join(BASES[i % 26 % 4] for i in range(52))
GAP = "-"


def normalize(seq: Column) -> Column:
    """Upper-case bases; any other letter becomes A."""
    return F.regexp_replace(F.translate(seq, BASES.lower(), BASES), "[^ACGT]", "A")


def project_text(text: Column) -> Column:
    """One base for every character of a text column; none for a null text."""
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), LETTERS, LETTER_BASES), "[^ACGT]", "A")


def encode(seq: Column) -> Column:
    """Base codes: A, C, G, T are 0 to 3, other letters 4, a gap 5."""
    bases = F.regexp_replace(F.translate(seq, BASES.lower(), BASES), "[^ACGT-]", "N")
    return F.translate(bases, "ACGTN-", "012345")


def decode(codes: Column) -> Column:
    return F.translate(codes, "01234", "ACGT-")


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, COMPLEMENT))


def on_strand(seq: Column, strand: Column | int) -> Column:
    if isinstance(strand, int):
        return revcomp(seq) if strand else seq
    return F.when(strand == 1, revcomp(seq)).otherwise(seq)


def subseq(seq: Column, beg, end, strand: Column | int = 0) -> Column:
    """Bases [beg, end) of the given strand."""
    beg, end = _col(beg), _col(end)
    n = F.length(seq)
    if isinstance(strand, int):
        first = n - end if strand else beg
    else:
        first = F.when(strand == 1, n - end).otherwise(beg)
    piece = seq.substr((first + 1).cast("int"), (end - beg).cast("int"))
    return on_strand(piece, strand)


def kmer_hash(kmer: Column) -> Column:
    """Two bits per base, first base in the highest bits."""
    return F.conv(F.translate(kmer, BASES, DIGITS), 4, 10).cast("long")


def block_id(global_offset: Column, block_size: int) -> Column:
    return F.floor(global_offset / F.lit(block_size)).cast("long")


def ddf(q1: Column, s1: Column, q2: Column, s2: Column) -> Column:
    """How far the two distances of a pair of seeds differ, as a ratio.

    Distances are absolute, so crossing seeds compare like parallel ones; two
    seeds sharing a coordinate get 1.0.
    """
    dq, ds = F.abs(q1 - q2), F.abs(s1 - s2)
    return F.when((dq == 0) | (ds == 0), F.lit(1.0)).otherwise(F.abs(1.0 - ds / dq))


def overlap_class(boundary: int = 200, prefix: str = "") -> Column:
    """Class of an overlap row from its overhangs; the first match wins.

    ``prefix`` goes before the span columns qoff, qend, soff, send.
    """
    q_left, q_right = F.col(prefix + "qoff"), F.col("qsize") - F.col(prefix + "qend")
    s_left, s_right = F.col(prefix + "soff"), F.col("ssize") - F.col(prefix + "send")

    def short(*overhangs: Column) -> Column:
        return F.greatest(*overhangs) <= boundary

    return (
        F.when(short(q_left, q_right), "contained")
        .when(short(s_left, s_right), "contains")
        .when(short(q_right, s_left) | short(s_right, q_left), "overlap")
        .otherwise("none")
    )


def good_overlap(boundary: int = 200, prefix: str = "") -> Column:
    return overlap_class(boundary, prefix) != "none"


def long_span(fraction: float = 0.6, prefix: str = "") -> Column:
    """At least this fraction of the query or of the target is aligned."""
    q_span = F.col(prefix + "qend") - F.col(prefix + "qoff")
    s_span = F.col(prefix + "send") - F.col(prefix + "soff")
    return (q_span >= F.col("qsize") * fraction) | (s_span >= F.col("ssize") * fraction)


def target_window(slack: float = 1.3) -> dict[str, Column]:
    """Target stretch [sfrom, sto) worth aligning around an anchor, and the
    anchor relative to it. The shorter side, stretched by the slack, decides."""
    qoff, soff = F.col("qoff"), F.col("soff")
    q_rest, s_rest = F.col("qsize") - qoff, F.col("ssize") - soff

    def reach(q_len: Column, s_len: Column) -> Column:
        stretched = F.when(q_len < s_len, (q_len * F.lit(slack)).cast("int")).otherwise(s_len)
        return F.least(stretched, s_len)

    left, right = reach(qoff, soff), reach(q_rest, s_rest)
    return {"sfrom": soff - left, "sto": soff + right, "srel": left}


def identity(qaln: Column, taln: Column) -> Column:
    """Percentage of equal columns of two aligned strings; 0 when empty."""
    equal = F.size(
        F.filter(F.zip_with(F.split(qaln, ""), F.split(taln, ""), lambda q, t: q == t), lambda same: same)
    )
    return F.when(F.length(qaln) == 0, F.lit(0.0)).otherwise(100.0 * equal / F.length(qaln))


def edit_ops(qaln: Column, taln: Column, extended: bool = False) -> Column:
    """One letter per alignment column: I, D and M, or I, D, = and X."""
    same, differ = ("=", "X") if extended else ("M", "M")
    return F.zip_with(
        F.split(qaln, ""),
        F.split(taln, ""),
        lambda q, t: F.when(t == GAP, "I").when(q == GAP, "D").when(q == t, same).otherwise(differ),
    )


def cigar_runs(ops: Column) -> Column:
    """Run-length text of an array column of operations, one letter each."""
    runs = F.regexp_extract_all(F.array_join(ops, ""), F.lit(r"(?s)(.)\1*+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda run: F.concat(F.length(run).cast("string"), F.left(run, F.lit(1)))), "")


def running_sums(values: Column) -> Column:
    """Sum of all values before each one, of an array column of whole numbers.

    Sums are taken in blocks of about the root of the size, since an array
    that grows is copied at every step. Pass a column of the input.
    """
    n = F.size(values)
    block = F.greatest(F.lit(8), F.ceil(F.sqrt(n)).cast("int"))
    blocks = F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / block).cast("int"))

    def part(k: Column) -> Column:
        return F.slice(values, k * block + 1, block)

    def sums(of: Column, start: Column) -> Column:
        return F.aggregate(of, F.array(start), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    zero = F.lit(0).cast("long")
    totals = F.transform(blocks, lambda k: F.aggregate(part(k), zero, lambda a, x: a + x))
    starts = F.arrays_zip(blocks.alias("k"), F.slice(sums(totals, zero), 1, F.size(blocks)).alias("base"))
    return F.flatten(F.transform(starts, lambda s: F.slice(sums(part(s["k"]), s["base"]), 1, F.size(part(s["k"])))))


def with_aligned_strings(df: DataFrame, cigar: str, query: str, target: str) -> DataFrame:
    """Add ``qaln`` and ``taln``, the two sequences with their gaps as the
    run-length text says, and ``q_used`` and ``t_used``, how much of each it takes.

    Both forms are read: M, I and D, or =, X, I and D. A null text gives nulls, an
    empty one empty strings. A text of another form, or one that takes more than
    there is of a sequence, is an error.
    """
    runs = F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDX=])"), F.lit(1))
    kinds = F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDX=])"), F.lit(2))
    takes = lambda gap: lambda n, op: F.when(op == gap, F.lit(0)).otherwise(n).cast("long")
    df = df.withColumns({"__n": F.transform(runs, lambda n: n.cast("long")), "__op": kinds})
    df = df.withColumns({"__q": F.zip_with("__n", "__op", takes("D")), "__t": F.zip_with("__n", "__op", takes("I"))})
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumns({"__qo": running_sums(F.col("__q")), "__to": running_sums(F.col("__t")), "q_used": total("__q"), "t_used": total("__t")})
    fine = F.col(cigar).rlike("^(?:[0-9]+[MIDX=])*+$") & (F.col("q_used") <= F.length(query)) & (F.col("t_used") <= F.length(target))
    message = F.concat(F.lit("not a text of this alignment: "), F.substring(cigar, 1, 60))

    def aligned(sequence: str, offsets: str, gap: str) -> Column:
        letters = F.col(sequence).cast("binary")  # a slice of bytes costs its own length, wherever it lies
        rows = F.arrays_zip(F.col("__n").alias("n"), F.col("__op").alias("op"), F.col(offsets).alias("o"))
        piece = lambda x: F.when(x["op"] == gap, F.repeat(F.lit(GAP), x["n"].cast("int"))).otherwise(
            F.substring(letters, (x["o"] + 1).cast("int"), x["n"].cast("int")).cast("string")
        )
        joined = F.array_join(F.transform(rows, piece), "")
        return F.when(F.col(cigar).isNull(), None).when(fine, joined).otherwise(F.raise_error(message))

    df = df.withColumns({"qaln": aligned(query, "__qo", "D"), "taln": aligned(target, "__to", "I")})
    return df.drop("__n", "__op", "__q", "__t", "__qo", "__to")


def fasta_header(id_: Column, org_size: Column, left: Column, right: Column, seq: Column) -> Column:
    return F.format_string(">%d_%d_%d_%d_%d", id_, org_size, left, right, F.length(seq))


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
