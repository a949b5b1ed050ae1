"""Personal data by weak supervision, with DataFrame functions alone.

Strict patterns give base spans, which always stand. Looser patterns give
candidates beside them. Five labelers vote on every span, for, against or not
at all: strict shape, gazetteer, words before it that name such data, words
before it that name other numbers, and an improbable run of digits. How often
each pattern of votes occurs is counted over the whole table; expectation-
maximisation on those counts (at most 3^5 for each of the kinds, whatever the
size of the table) estimates how far each labeler can be trusted, without any
label. The posteriors of the candidates are soft labels that train the final classifier, a naive
Bayes model of the votes, the kind, the shape and the word before the span,
again from counts. Candidates that it scores at ``ADD`` or more, and that
overlap no base span, are added.

Defined results: a null or empty text has no spans; failing matches are dropped
without another try. Without candidates nothing is trained and nothing added.
Repeated rows get equal spans; other columns stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.spans import digits, named, with_spans, written
from readloom.session import Workspace

#: Base patterns. A match starts where its run of characters does, or where the match before it ended.
#: Repeats are possessive, inside and outside of a group: no way back is kept, so no stack grows with the match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Looser ones.
LOOSE_PHONE = r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"
SPELLED = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++\x20?[(\[]dot[)\]]\x20?[A-Za-z]{2,10}"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
KINDS = ("email", "ip", "card", "phone", "loose_phone", "spelled", "social")
BASE = KINDS[:4]
#: Words that name personal data before it, and words that name other numbers.
NAMING = r"(?i)\b(tel|phone|call|fax|mobile|cell|mail|email|contact|reach|ssn|social|card|visa|address|at)\b[^A-Za-z0-9]*$"
OTHER = r"(?i)\b(version|order|invoice|isbn|issn|doi|page|figure|no|nr|number|part|item|section|release|build)\b[^A-Za-z0-9]*$"
DOMAINS = r"(?i)(\.|dot[)\]]\x20?)(com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$"
LEFT = 40
LABELERS = ("shape", "gazetteer", "naming", "other", "run")
ROUNDS, SMOOTH, ADD = 40, 2.0, 0.5
START, LOWEST = 0.8, 0.55  # a labeler's reliability at first, and at least


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(
        F.split(F.reverse(number), ""), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("odd")),
        lambda a, x: F.struct(
            (a["sum"] + F.when(a["odd"] == 1, twice(F.coalesce(x.try_cast("int"), F.lit(0)))).otherwise(F.coalesce(x.try_cast("int"), F.lit(0)))).alias("sum"),
            F.when(x == "", a["odd"]).otherwise(1 - a["odd"]).alias("odd"),
        ),
        lambda a: a["sum"],
    )
    return total % 10 == 0


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``row`` and an array of (start, end, found) for each kind; candidates also have the text before them."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    df = with_spans(df, "email", EMAIL, text.contains("@"), left=LEFT)
    df = with_spans(df, "ip", IP, text.rlike(r"[0-9]\.[0-9]"), left=LEFT)
    part = lambda x, i: F.element_at(F.split(x["found"], r"\."), i)
    small = lambda x, i: F.ltrim(part(x, i), F.lit("0")).try_cast("int").isNull() | (F.ltrim(part(x, i), F.lit("0")).try_cast("int") <= 255)
    short = lambda x: F.forall(F.split(x["found"], r"\."), lambda p: F.char_length(F.ltrim(p, F.lit("0"))) <= 3)
    df = df.withColumn("ip", F.filter("ip", lambda x: short(x) & small(x, 1) & small(x, 2) & small(x, 3) & small(x, 4)))
    df = with_spans(df, "card", CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), left=LEFT)
    df = df.withColumn("card", F.filter("card", lambda x: F.char_length(digits(x["found"])).between(16, 19)))
    df = df.withColumn("card", F.filter("card", lambda x: luhn(digits(x["found"]))))
    df = with_spans(df, "phone", PHONE, text.contains("+"), left=LEFT)
    df = df.withColumn("phone", F.filter("phone", lambda x: F.char_length(digits(x["found"])).between(8, 15)))
    df = with_spans(df, "loose_phone", LOOSE_PHONE, text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), left=LEFT)
    df = with_spans(df, "spelled", SPELLED, text.rlike(r"[(\[]at[)\]]"), left=LEFT)
    df = with_spans(df, "social", SOCIAL, text.rlike(r"[0-9]-[0-9]{2}-[0-9]"), left=LEFT)
    struct = lambda kind: lambda x: F.struct(
        F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found"), x["left"].alias("left")
    )
    every = F.concat(*[F.transform(k, struct(k)) for k in KINDS])
    return df.withColumn("candidates", every).drop("text")


def votes(spans: DataFrame) -> DataFrame:
    """One column of 1, -1 or 0 for each labeler."""
    kind, found, left = F.col("kind"), F.col("found"), F.col("left")
    number = digits(found)
    return spans.withColumns(
        {
            "shape": F.when(kind.isin(*BASE), 1).when(kind == "social", F.when(number.rlike("^(000|666|9)|^...00|0000$"), -1).otherwise(0)).otherwise(0),
            "gazetteer": F.when(kind.isin("email", "spelled"), F.when(found.rlike(DOMAINS), 1).otherwise(-1))
            .when(kind.isin("phone", "loose_phone"), F.when(number.rlike(r"[2-9][0-9]{2}[2-9][0-9]{6}$"), 1).otherwise(-1))
            .when(kind == "card", F.when(number.rlike("^(4|5[1-5]|3[47]|6011|65)"), 1).otherwise(-1)).otherwise(0),
            "naming": F.when(left.rlike(NAMING), 1).otherwise(0),
            "other": F.when(left.rlike(OTHER), -1).otherwise(0),
            "run": F.when(number.rlike(r"([0-9])\1{5,}|012345|123456|234567|345678|456789"), -1).otherwise(0),
        }
    )


def estimate(counts: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], float]:
    """Posterior of each pattern of votes by expectation-maximisation.

    A labeler that votes is right with a probability of its own, independent of
    the others; not voting tells nothing. It is held to be right more often than
    not, so the two classes cannot change places; without votes both are even.
    """
    sure, posterior = [START] * len(LABELERS), {}
    for _ in range(ROUNDS):
        for v in counts:
            odds = sum(x * math.log(a / (1 - a)) for x, a in zip(v, sure, strict=True))
            posterior[v] = 1 / (1 + math.exp(-max(min(odds, 30), -30)))
        for k in range(len(LABELERS)):
            voted = sum(n for v, n in counts.items() if v[k])
            right = sum(n * (posterior[v] if v[k] > 0 else 1 - posterior[v]) for v, n in counts.items() if v[k])
            sure[k] = min(max((right + SMOOTH * START) / (voted + SMOOTH), LOWEST), 1 - 1e-3)
    return posterior


def features() -> dict[str, Column]:
    """What the final classifier sees; each takes few values."""
    word = F.lower(F.regexp_extract("left", r"([A-Za-z]+)[^A-Za-z0-9]*$", 1))
    return {
        "f_kind": F.col("kind"),
        "f_votes": F.concat_ws(",", *[F.col(k).cast("string") for k in LABELERS]),
        "f_digits": F.concat(F.col("kind"), F.lit(":"), F.char_length(digits(F.col("found"))).cast("string")),
        "f_named": F.when(F.col("left").rlike(NAMING), F.lit("yes")).otherwise(F.lit("no")),
        "f_bucket": F.pmod(F.xxhash64(word), F.lit(64)).cast("string"),
    }


def classified(found: DataFrame) -> DataFrame:
    """row_no, kind, start, end and p of every candidate beside the base spans."""
    spans = found.where(F.size("candidates") > 0).select("row_no", F.explode("candidates").alias("x")).select("row_no", "x.*")
    spans = votes(spans)
    counts = {tuple(r[:-1]): r[-1] for r in spans.groupBy(*LABELERS).count().collect()}  # at most 3^5 rows
    posterior = estimate(counts) if counts else {}
    if not posterior:  # no span of any kind
        return spans.select("row_no", "kind", "start", "end", F.lit(0.0).alias("p"))
    soft = F.create_map(*[F.lit(x) for v, p in posterior.items() for x in (",".join(map(str, v)), float(p))])
    # Base spans stand anyway; the classifier judges the others, and learns from them.
    spans = spans.where(~F.col("kind").isin(*BASE)).withColumns(features())
    spans = spans.withColumn("soft", F.element_at(soft, F.col("f_votes")))
    names = list(features())
    long = spans.select("soft", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("f"))
    learned = long.groupBy("f.name", "f.value").agg(F.sum("soft").alias("yes"), F.sum(1 - F.col("soft")).alias("no")).collect()
    yes = sum(r["yes"] for r in learned) / len(names)
    no = sum(r["no"] for r in learned) / len(names)
    share = (yes + SMOOTH) / (yes + no + 2 * SMOOTH)
    weights = {}
    for r in learned:  # values of few-valued features; rare ones are drawn to the weight 0
        odds = (r["yes"] + SMOOTH * share) / (r["no"] + SMOOTH * (1 - share))
        weights[f"{r['name']}={r['value']}"] = math.log(odds) - math.log(share / (1 - share))
    if not weights:
        return spans.select("row_no", "kind", "start", "end", F.lit(0.0).alias("p"))
    table = F.create_map(*[F.lit(x) for key, w in weights.items() for x in (key, float(w))])
    score = F.lit(math.log(share / (1 - share)))
    for n in names:
        score = score + F.coalesce(F.element_at(table, F.concat(F.lit(f"{n}="), F.col(n))), F.lit(0.0))
    return spans.select("row_no", "kind", "start", "end", (1 / (1 + F.exp(-score))).alias("p"))


def find(docs: DataFrame, work: Workspace, keep: list[str]) -> DataFrame:
    """``row``, the base spans by kind, and ``spans``, all spans by kind as listed, then start."""
    found = candidates(docs, keep).withColumn("row_no", F.monotonically_increasing_id())
    found = work.keep("pii_candidates", found)
    scored = classified(found).where(F.col("p") >= ADD)
    added = scored.groupBy("row_no").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    found = found.join(added, "row_no", "left")
    base = F.concat(*[named(k, k) for k in BASE])
    none = F.expr("cast(array() as array<struct<start:int,kind:string,end:int>>)")
    apart = lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))
    extra = F.filter(F.coalesce("added", none), apart)
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    keyed = F.transform(F.concat(base, extra), lambda x: F.struct(rank(x).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    spans = F.transform(F.array_sort(keyed), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return found.select("row", *BASE, base.alias("base"), spans.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    size = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return found.select("row", *map(size, BASE), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
