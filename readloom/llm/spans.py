"""Spans of patterns in texts, by DataFrame functions alone.

Spark has no function for the places of all matches. A text splits at the
matches into gaps; the lengths of gaps and matches add up to the places. The
running total is taken in blocks of about the root of the number n of matches,
since each block takes its part out of the whole array: the cost goes with n ** 1.5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 128
EMPTY = "cast(array() as array<struct<start:int,end:int,found:string>>)"
EMPTY_LEFT = "cast(array() as array<struct<start:int,end:int,found:string,left:string>>)"


def with_spans(df: DataFrame, name: str, pattern: str, gate: Column, text: str = "text", left: int = 0) -> DataFrame:
    """Column ``name``: array of (start, end, found) of the leftmost matches that
    do not overlap, in code points, end exclusive. Texts that do not pass
    ``gate`` are taken to have none. A null text has none. With ``left``, also so
    many characters before the match, back to the match before at most."""
    empty = F.expr(EMPTY_LEFT if left else EMPTY)
    g, m, z, s = (f"__{name}_{k}" for k in "gmzs")
    df = df.withColumn(m, F.when(F.coalesce(gate, F.lit(False)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    df = df.withColumn(g, F.when(F.size(m) > 0, F.split(text, pattern, -1)))
    lengths = F.zip_with(F.slice(g, 1, F.size(m)), m, lambda a, b: F.struct(F.char_length(a).alias("gap"), F.char_length(b).alias("size"), b.alias("found"), *([F.right(a, F.lit(left)).alias("left")] if left else [])))
    df = df.withColumn(z, F.when(F.size(m) > 0, lengths))
    block = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(2 * F.size(z))).cast("int"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(z) - 1) / block).cast("int"))
    part = lambda k: F.slice(z, k * block + 1, block)
    sums = F.transform(blocks, lambda k: F.aggregate(part(k), F.lit(0), lambda a, x: a + x["gap"] + x["size"]))
    bases = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    df = df.withColumn(s, F.when(F.size(m) > 0, bases))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        one = F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["found"].alias("found"), *([x["left"].alias("left")] if left else []))
        return F.struct((start + x["size"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    inside = lambda k: F.aggregate(
        part(k), F.struct(F.element_at(s, k + 1).alias("at"), empty.alias("out")), step, lambda acc: acc["out"]
    )
    df = df.withColumn(name, F.coalesce(F.when(F.size(m) > 0, F.flatten(F.transform(blocks, inside))), empty))
    return df.drop(g, m, z, s)


def named(kind: str, spans: Column | str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def masked(text: Column, spans: Column, mark: str = "[removed]") -> Column:
    """Text with each stretch that spans cover replaced; spans are in order of start."""

    def step(acc: Column, x: Column) -> Column:
        fresh = F.concat(acc["out"], F.array(F.when(x["start"] > acc["at"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"])).otherwise(F.lit("")), F.lit(mark)))
        return F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(x["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))))
