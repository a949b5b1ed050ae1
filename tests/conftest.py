import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from readloom.session import Workspace, tuned  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.driver.memory", "8g")
    session = tuned(builder.config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def work(spark):
    return Workspace(spark)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def random_bases(rng, n):
    return rng.integers(0, 4, n).astype("uint8")


def noisy(rng, codes, rate):
    """Substitute, insert or delete bases at a total rate."""
    out = []
    for base in codes.tolist():
        event = rng.random()
        if event < rate / 3:
            continue
        if event < 2 * rate / 3:
            out.append(int(rng.integers(4)))
        elif event < rate:
            base = (base + int(rng.integers(1, 4))) % 4
        out.append(base)
    return out


def text(codes):
    return "".join("ACGT"[c] for c in codes)


def planted_reads(rng, genome_size, n_reads, low, high, rate):
    """Noisy slices of one random sequence: (id, seq, start, end, strand)."""
    genome = random_bases(rng, genome_size)
    out = []
    for i in range(n_reads):
        size = int(rng.integers(low, high))
        start = int(rng.integers(0, genome_size - size))
        codes = noisy(rng, genome[start : start + size], rate)
        strand = i % 2
        if strand:
            codes = [3 - c for c in reversed(codes)]
        out.append((i, text(codes), start, start + size, strand))
    return text(genome), out
