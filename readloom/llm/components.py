"""Connected components of a graph given by its links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.heavy import heavy, lookup
from readloom.session import Workspace


MANY = 10_000  # narrow rows of a key that one task takes without being held up


def met_labels(rows: DataFrame, labels: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """Left join by a key that may have many rows. Without such a key a plain join is as good, and a smaller plan."""
    return rows.join(labels, key, "left") if heavy.isEmpty() else lookup(rows, labels, [key], heavy)


def components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """node and component (its smallest node) for every node of ``links`` (a, b).

    Every round each node takes the smallest label around it, and the label of
    its label; rounds go on until no label changes. Each round is a written table.
    """
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = work.keep(f"{name}_links", both)
    # Hubs have many links, and large components many nodes: their labels go to where the rows are.
    total = both.count()
    hubs = work.keep(f"{name}_hubs", heavy(both.groupBy("b").agg(F.count("*").alias("n")), total).where(F.col("n") > MANY)).select(F.col("b").alias("node"))
    labels = work.keep(f"{name}_0", both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")))
    done = 0
    while True:
        done += 1
        met = met_labels(both.withColumnRenamed("b", "node"), labels, "node", hubs)
        seen = met.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        own = labels.join(seen, "node")
        own = own.select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        far = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        large = heavy(labels.groupBy("component").agg(F.count("*").alias("n")), total).where(F.col("n") > MANY)
        own = met_labels(own, far, "component", large).select("node", "old", F.least("component", "far").alias("component"))
        own = work.keep(f"{name}_{done}", own)
        changed = own.where(F.col("old") != F.col("component")).limit(1).count()
        labels = own.select("node", "component")
        if not changed:
            return labels
