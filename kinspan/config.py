"""Constants of the domain and settings of a phasing run."""

from __future__ import annotations

from dataclasses import dataclass
from math import log10

#: The largest gap between recombinations of one event, in bases.
MATERNAL_CUTOFF, PATERNAL_CUTOFF = 161332, 154265
#: Ends of the first and start of the second pseudoautosomal region of X.
PAR_BOUNDS = {"37": (2699520, 154931044), "38": (2781479, 155701383)}
#: Sex and phenotype codes of pedigree files.
MALE, FEMALE, UNAFFECTED, AFFECTED = "1", "2", "1", "2"
CHROMOSOMES = (*map(str, range(1, 23)), "X")


@dataclass(frozen=True)
class PhaseConfig:
    """Costs (-log10 of probabilities) and switches of the family model."""

    maternal_crossover: float = -log10(42) + log10(3e9)
    paternal_crossover: float = -log10(28) + log10(3e9)
    deletion: float = 2 * log10(3e9) - log10(3e9) - log10(200)
    region_switch: float = -log10(2000) + log10(3e9)
    upd: float = 20.0
    allow_deletions: bool = True
    allow_upd: bool = False
    n_regions: int = 1
    tie: float = 0.01
    assembly: str = "38"
