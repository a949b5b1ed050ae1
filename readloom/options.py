"""Job options. The defaults are fixed values that decide the results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MapOptions:
    """Options of candidate search, overlap search and reference mapping."""

    kmer_size: int = 13
    stride: int = 10  # distance between sampled query k-mers
    max_kmer_count: int = 1000  # k-mers occurring more often are dropped
    block_size: int = 2000
    min_block_score: int = 3
    num_candidates: int = 200  # best candidates per query that are aligned
    min_align_size: int = 500
    ddf_cutoff: float = 0.25
    error: float = 0.5
    num_output: int = 200  # best candidates per query that are reported
    volume_size: int = 2_000_000_000


@dataclass(frozen=True)
class ChainOptions:
    """Fixed values of co-linear chaining."""

    max_dist: int = 10000
    bandwidth: int = 500
    max_skip: int = 25
    min_score: int = 100


@dataclass(frozen=True)
class PartitionOptions:
    batch_size: int = 100_000


@dataclass(frozen=True)
class ConsensusOptions:
    min_align_size: int = 500
    high_accuracy_coverage: int = 10
    low_accuracy_coverage: int = 20
    min_size: int = 500
    full_consensus: bool = False
    error: float = 0.5
    # Identities are percentages while this switch is a fraction, so practically
    # every target counts as accurate; kept as an argument.
    accuracy_switch: float = 0.70

    def coverage_limit(self, ident_cutoff: float) -> int:
        if ident_cutoff >= self.accuracy_switch:
            return self.high_accuracy_coverage
        return self.low_accuracy_coverage


SENSITIVE = MapOptions(stride=10)
FAST = MapOptions(stride=20, block_size=1000)
