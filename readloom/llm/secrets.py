"""Secret scans with multipart credential linking, by DataFrame functions alone.

Strong patterns (assignments, access identifiers, long hexadecimal strings) are
reported wherever they stand. Weak candidates, a bare random-looking string or
an endpoint, are reported only where complementary parts co-occur: parts are
joined as intervals, within ``SCOPE`` characters of an access identifier. A bare
secret needs the identifier; an endpoint needs an identifier that a secret of
any kind is linked with. The join is on (row, stretch of the text), so it meets
a bounded number of parts for each key, in however long or full a text.

Defined results: a null or empty text has no spans. Matches that fail a length
test are dropped without another try. Rows are scanned one by one, so repeated
rows get equal results; other columns stay as they are. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.spans import masked, named, with_spans, written
from readloom.session import Workspace

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
#: Weak on their own: 40 characters as of a secret key, and addresses of services.
BARE = r"(?<![A-Za-z0-9/+])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])"
ENDPOINT = r"""https?://[^\x00-\x20"'<>]+"""
KINDS = ("assign", "access", "hex", "secret", "endpoint")
SCOPE = 300


def parts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``row`` (the kept columns) and an array of (start, end, found) for each kind of part."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = with_spans(df, "assign", ASSIGN, F.col("text").rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"))
    df = df.withColumn("assign", F.filter("assign", lambda x: F.char_length(F.regexp_extract(x["found"], ASSIGN, 2)) >= 8))
    df = with_spans(df, "access", ACCESS, F.col("text").contains("AKIA"))
    df = with_spans(df, "hex", HEX, F.col("text").rlike(HEX))
    # Weak parts matter only where there is an access identifier.
    df = with_spans(df, "bare", BARE, F.size("access") > 0)
    mixed = lambda x: x["found"].rlike("[0-9]") & x["found"].rlike("[A-Z]") & x["found"].rlike("[a-z]")
    df = df.withColumn("bare", F.filter("bare", mixed))
    df = with_spans(df, "endpoint", ENDPOINT, F.size("access") > 0)
    return df.drop("text")


def linked(found: DataFrame) -> DataFrame:
    """row_no, kind, start and end of the weak candidates that complementary parts confirm."""
    part = lambda kind, column: found.where(F.size(column) > 0).where(F.size("access") > 0).select(
        "row_no", F.lit(kind).alias("kind"), F.explode(column).alias("x")
    ).select("row_no", "kind", "x.start", "x.end")
    access = found.where(F.size("access") > 0).select("row_no", F.explode("access").alias("x")).select("row_no", F.col("x.start").alias("a_start"), F.col("x.end").alias("a_end"))
    near = F.explode(F.sequence(F.floor((F.col("a_start") - SCOPE) / SCOPE), F.floor((F.col("a_end") + SCOPE) / SCOPE)))
    reach = access.select("*", near.alias("place"))
    others = part("assign", "assign").unionAll(part("hex", "hex")).unionAll(part("secret", "bare")).unionAll(part("endpoint", "endpoint"))
    # A part stands in every stretch that it touches; pairs that share several are made distinct below.
    others = others.select("*", F.explode(F.sequence(F.floor(F.col("start") / SCOPE), F.floor(F.col("end") / SCOPE))).alias("place"))
    met = others.join(reach, ["row_no", "place"]).where((F.col("start") < F.col("a_end") + SCOPE) & (F.col("end") > F.col("a_start") - SCOPE))
    # A bare part that only repeats a strong one adds nothing.
    secrets = met.where(F.col("kind") == "secret").select("row_no", "kind", "start", "end").distinct()
    strong = part("assign", "assign").unionAll(part("hex", "hex")).select("row_no", F.col("start").alias("s"), F.col("end").alias("e"))
    strong = strong.select("*", F.explode(F.sequence(F.floor(F.col("s") / SCOPE), F.floor(F.col("e") / SCOPE))).alias("place"))
    stretch = secrets.select("*", F.explode(F.sequence(F.floor(F.col("start") / SCOPE), F.floor(F.col("end") / SCOPE))).alias("place"))
    covered = (strong["s"] < stretch["end"]) & (strong["e"] > stretch["start"]) & (strong["row_no"] == stretch["row_no"]) & (strong["place"] == stretch["place"])
    secrets = stretch.join(strong, covered, "left_anti").select("row_no", "kind", "start", "end").distinct()
    full = met.where(F.col("kind") != "endpoint").select("row_no", "a_start").distinct()
    endpoints = met.where(F.col("kind") == "endpoint").join(full, ["row_no", "a_start"], "left_semi")
    return secrets.unionAll(endpoints.select("row_no", "kind", "start", "end").distinct())


def find(docs: DataFrame, work: Workspace, keep: list[str]) -> DataFrame:
    """``row``, the base spans as arrays assign, access and hex, and ``spans``, all
    spans in order of start, then of kind as listed."""
    found = parts(docs, keep).withColumn("row_no", F.monotonically_increasing_id())
    found = work.keep("secret_parts", found)
    added = linked(found).groupBy("row_no").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    found = found.join(added, "row_no", "left")
    base = F.concat(named("assign", "assign"), named("access", "access"), named("hex", "hex"))
    none = F.expr("cast(array() as array<struct<start:int,kind:string,end:int>>)")
    return found.select("row", "assign", "access", "hex", _ordered(base).alias("base"), _ordered(F.concat(base, F.coalesce("added", none))).alias("spans"))


def _ordered(spans: Column) -> Column:
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def digest(found: DataFrame) -> DataFrame:
    size = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return found.select("row", size("assign"), size("access"), size("hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def without_secrets(docs: DataFrame, work: Workspace) -> DataFrame:
    """All rows with all columns; what spans cover is masked in ``text``."""
    found = find(docs, work, docs.columns)
    text = F.when(F.size("spans") > 0, masked(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text"))
    return found.select(F.col("row").withField("text", text).alias("row")).select("row.*")
