"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams of 3 to 6 characters (A-Z lower-cased). Training
texts give, for each feature, the ratio r of its share among toxic and other
texts; logistic regression is trained on the counts scaled by r. A text is
scored by the sum over all its n-grams, divided by the root of their number, so
that a few telling n-grams count in a long text as well.

The classifier is fitted on a bounded sample of the labelled rows, at most
``MAX_EACH`` per class, chosen by a hash of the id; scoring reads all rows and
whole texts. Rows with a null label take no part in the fit. The intercept is
moved from the odds of the sample to those of all labelled training rows, so
that scores mean the same at every size.

Defined results: a null or empty text has no features and is scored by the
intercept alone. Without any training row, or with one class only, every text
is scored by the (smoothed) share of toxic rows. Repeated rows get equal
scores; extra columns stay inside ``row``; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.text import Texts, append, give_back, small_batches

SIZES = (3, 4, 5, 6)
BITS = 20
MAX_EACH = {1: 3000, 0: 6000}  # training rows of a class
LEAST_TEXTS = 8  # a feature in fewer training texts is left out
LEAST_RATIO = 0.7  # as is one whose log-count ratio is nearer to zero
THRESHOLD = 0.3
STEPS, RATE, PENALTY = 300, 0.05, 1e-4
BLOCK = 1 << 20  # counts that a training step looks at together


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points, A-Z lower-cased, and the documents' offsets among them."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
    points[(points >= 65) & (points <= 90)] += 32
    leading = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=leading[1:])
    return points, leading[offsets]


def features(points: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """For each size the feature of the n-gram that starts at each character."""
    k1, k2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
    spread = points * k1
    spread ^= spread >> np.uint32(15)
    level = spread
    for size in range(2, max(sizes) + 1):
        if len(points) < size:
            return
        level = level[:-1] * k2 + spread[size - 1 :]
        if size in sizes:
            out = (level ^ (level >> np.uint32(16))) * np.uint32(0xC2B2AE35 + 2 * size)
            yield size, out >> np.uint32(32 - BITS)


@dataclass(frozen=True)
class Model:
    intercept: float
    feature: np.ndarray  # ids of the kept features
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.feature] = self.weight
        return out

    def score(self, texts: Texts) -> list[pa.Array]:
        weights, out = self.dense(), []
        for first, last in texts.blocks(1 << 20):
            points, edges = characters(*texts.part(first, last))
            total = np.zeros(last - first)
            for size, ids in features(points, SIZES):
                value = weights[ids].astype(np.float64)
                for shift in range(1, size):  # n-grams that run into the next document
                    at = edges[1:] - shift
                    value[at[(at >= 0) & (at < len(value))]] = 0
                sums = np.concatenate([[0.0], np.cumsum(value)])
                total += np.diff(sums[np.minimum(edges, len(value))])
            length = np.maximum(np.diff(edges), 1)
            out.append(1 / (1 + np.exp(-np.clip(self.intercept + total / np.sqrt(length), -30, 30))))
        return [pa.array(np.concatenate(out) if out else np.zeros(0))]


@dataclass(frozen=True)
class Counts:
    """Counts of kept features in the training texts from ``first`` to ``last``, text by text."""

    first: int
    last: int
    sizes: np.ndarray  # entries of each text
    column: np.ndarray
    count: np.ndarray

    def sums(self, weight: np.ndarray) -> np.ndarray:
        out, full = np.zeros(self.last - self.first), self.sizes > 0
        if full.any():
            out[full] = np.add.reduceat(self.count * weight[self.column], (np.cumsum(self.sizes) - self.sizes)[full])
        return out

    def slopes(self, error: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.column, self.count * np.repeat(error, self.sizes), n)


def counted(texts: list[str], place: np.ndarray) -> Iterator[Counts]:
    """Blocks of about ``BLOCK`` counts in as few bytes as they need."""
    first, sizes, column, count = 0, [], [], []
    for i, text in enumerate(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        points, _ = characters(data, np.array([0, len(data)]))
        found = [place[ids] for _, ids in features(points, SIZES)]
        found = np.concatenate(found) if found else np.zeros(0, np.int32)
        ids, counts = np.unique(found[found >= 0], return_counts=True)
        sizes.append(len(ids))
        column.append(ids)
        count.append(counts.astype(np.min_scalar_type(int(counts.max(initial=0)))))
        if sum(sizes) >= BLOCK or i == len(texts) - 1:
            yield Counts(first, i + 1, np.array(sizes), np.concatenate(column), np.concatenate(count))
            first, sizes, column, count = i + 1, [], [], []


def train(texts: list[str], toxic: np.ndarray, every: tuple[int, int] | None = None) -> Model:
    """Ratios, then logistic regression on the scaled counts. ``every`` has the
    numbers of other and of toxic rows that the texts were sampled from."""
    n, positives = len(texts), int(toxic.sum())
    every = every or (n - positives, positives)
    prior = (positives + 1) / (n + 2)
    constant = Model(float(np.log((every[1] + 1) / (every[0] + 1))), np.zeros(0, np.int64), np.zeros(0))
    if not 0 < positives < n:
        return constant
    root = np.ones(n)
    seen = {0: np.zeros(1 << BITS, np.int32), 1: np.zeros(1 << BITS, np.int32)}
    for i, text in enumerate(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        points, _ = characters(data, np.array([0, len(data)]))
        parts = [ids for _, ids in features(points, SIZES)]
        ids = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint32)
        root[i] = np.sqrt(max(len(points), 1))
        seen[int(toxic[i])][ids] += 1
    share = {c: (seen[c] + 1) / (np.sum(toxic == c) + 2) for c in (0, 1)}
    ratio = np.log(share[1] / share[0])
    keep = np.flatnonzero((seen[0] + seen[1] >= min(LEAST_TEXTS, n)) & (np.abs(ratio) >= LEAST_RATIO))
    if not len(keep):
        return constant
    place = np.full(1 << BITS, -1, np.int32)
    place[keep] = np.arange(len(keep))
    ratio = ratio[keep]
    del seen, share
    blocks = list(counted(texts, place))
    weight, bias = np.zeros(len(keep)), float(np.log(prior / (1 - prior)))
    state = [np.zeros(len(keep) + 1), np.zeros(len(keep) + 1)]
    for step in range(1, STEPS + 1):
        scaled, slope, errors = weight * ratio, np.zeros(len(keep)), 0.0
        for x in blocks:
            own = slice(x.first, x.last)
            margin = bias + x.sums(scaled) / root[own]
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - toxic[own]) / n
            slope += x.slopes(error / root[own], len(keep))
            errors += error.sum()
        slope = np.append(slope * ratio + PENALTY * weight, errors)
        state[0] = 0.9 * state[0] + 0.1 * slope
        state[1] = 0.999 * state[1] + 0.001 * slope**2
        move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        weight -= move[:-1]
        bias -= move[-1]
    shift = np.log(every[1] / every[0]) - np.log(positives / (n - positives))
    return Model(float(bias + shift), keep, weight * ratio)


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4


def fit(docs: DataFrame, labels: DataFrame, max_each: dict[int, int] = MAX_EACH) -> Model:
    """Train on labelled rows whose remainder is not 2. The chosen ids are bounded
    by ``max_each``, so they can be broadcast to the scan of the texts, and one
    task can hold their texts."""
    small_batches(docs.sparkSession)
    usable = labels.where((remainder() != 2) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = usable.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    totals = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    every = (totals.get(0, 0), totals.get(1, 0))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [usable.where(F.col("toxic") == c).orderBy(*order).limit(most) for c, most in max_each.items()]
    chosen = chosen[0].unionAll(chosen[1])
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        model = train(group["text"].tolist(), group["toxic"].to_numpy(), every)
        give_back()
        packed = (model.feature.astype("<i4").tobytes(), model.weight.astype("<f4").tobytes())
        return pd.DataFrame([[model.intercept, *packed]], columns=["intercept", "feature", "weight"])

    one = rows.groupBy(F.lit(1).alias("all")).applyInPandas(fitted, "intercept double, feature binary, weight binary").first()
    if one is None:
        return Model(0.0, np.zeros(0, np.int64), np.zeros(0))
    return Model(one[0], np.frombuffer(one[1], "<i4").astype(np.int64), np.frombuffer(one[2], "<f4"))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the kept columns) and score of every row."""
    return append(docs, model.score, "score double", keep=keep)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows scored under the threshold, with all their columns."""
    return score(docs, fit(docs, labels)).where(F.col("score") < THRESHOLD).select("row.*")
