"""Settings of a run."""

from __future__ import annotations

import math
from dataclasses import dataclass

MODELS = ("haplotypes", "transcripts", "strains", "haplotype-transcripts")
LIBRARIES = ("unstranded", "fr", "rf")

# Fixed values that results depend on.
MATCH, MISMATCH, FULL_LENGTH_BONUS = 1, 4, 5
SCORE_LOG_BASE = 1.383325268738
NOISE_LOG_BASE = 1e-6
COMPARE_PRECISION = 2.220446049250313e-16 * 100
TRAINING_MAPQ = 30
EM_CONVERGED_ROUNDS, EM_MIN_ABUNDANCE = 10, 1e-8
GIBBS_GAMMA_PRIOR, GIBBS_MIN_ABUNDANCE = 1.0, 1e-8
HAPLOTYPE_CUT = 1e-8
#: Gibbs over path combinations: (base, per slot and path) of chains, burn-in and iterations.
GIBBS_CHAINS, GIBBS_BURN_IN, GIBBS_ITERATIONS = (10, 0.01), (50, 0.025), (100, 0.05)
INT_MIN = -(2**31)


@dataclass(frozen=True)
class EngineConfig:
    model: str = "transcripts"
    seed: int = 0
    library: str = "unstranded"
    single_path: bool = False
    single_end: bool = False
    long_reads: bool = False
    score_not_qual: bool = False
    frag_mean: float | None = None
    frag_sd: float | None = None
    max_num_sd_frag: int = 10
    max_partial_offset: int = 4
    max_score_diff: int = (MATCH + MISMATCH) * 4
    filt_best_score: float = 0.9
    use_allelic_mapq: bool = False
    min_noise_prob: float = 1e-4
    prob_precision: float = 1e-8
    path_node_cluster: bool = False
    ploidy: int = 2
    path_info: bool = False
    min_hap_prob: float = 0.001
    ind_hap_inference: bool = False
    use_hap_gibbs: bool = False
    num_gibbs_samples: int = 0
    gibbs_thin_its: int = 25
    max_em_its: int = 10_000
    max_rel_em_conv: float = 0.001
    exact_permutations: bool = False
    write_probs: bool = False

    def __post_init__(self):
        if self.model not in MODELS:
            raise ValueError(f"model must be one of {MODELS}")
        if self.library not in LIBRARIES:
            raise ValueError(f"library must be one of {LIBRARIES}")
        if (self.frag_mean is None) != (self.frag_sd is None):
            raise ValueError("frag_mean and frag_sd are given together or not at all")
        if self.long_reads:
            object.__setattr__(self, "single_end", True)
            object.__setattr__(self, "frag_mean", 1.0)
            object.__setattr__(self, "frag_sd", 1.0)
        elif self.single_end and self.frag_mean is None:
            raise ValueError("short single-end reads need frag_mean and frag_sd")
        if self.ploidy < 1:
            raise ValueError("ploidy must be 1 or more")
        if self.model == "haplotype-transcripts" and not self.path_info:
            raise ValueError("haplotype-transcripts needs path info")

    @property
    def collapse(self) -> bool:
        """Transcript estimates with path info are made per transcript name."""
        return self.model == "transcripts" and self.path_info

    @property
    def node_clusters(self) -> bool:
        return self.path_node_cluster or self.collapse

    @property
    def prob_digits(self) -> int:
        """Significant digits of probabilities in the dump."""
        return max(1, math.ceil(-math.log10(self.prob_precision)))
