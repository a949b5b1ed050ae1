"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY = 4096


def heavy(counts: DataFrame, total: int, n: str = "n") -> DataFrame:
    """The keys with more than one row in ``HEAVY`` of all rows. So there are fewer
    than ``HEAVY`` of them, whatever the size of the table, and what is known of
    them may be broadcast."""
    return counts.where(F.col(n) > total // HEAVY)


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], heavy: DataFrame) -> DataFrame:
    """Left join of ``table``, one row for each key, to ``rows``.

    Rows of heavy keys get the broadcast rows of the table. In the shuffle of all
    others they, and rows without a key, only travel along, dealt out evenly.
    """
    values = [c for c in table.columns if c not in keys]
    few = F.broadcast(heavy.select(*keys).distinct())
    near = table.join(few, keys, "left_semi").select(*keys, F.struct(*values, F.lit(1).alias("is_heavy")).alias("near_values"))
    far = table.join(few, keys, "left_anti").select(*keys, F.struct(*values).alias("far_values"), F.lit(0).cast("long").alias("dealt"))
    lost = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    out = rows.join(F.broadcast(near), keys, "left")
    out = out.withColumn("dealt", F.when(F.col("near_values").isNotNull() | lost, 1 + F.monotonically_increasing_id()).otherwise(0))
    out = out.join(far, [*keys, "dealt"], "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(f"near_values.{v}"), F.col(f"far_values.{v}")).alias(v) for v in values])
