"""Scores of a molecule from its structural counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import ramp

# Weights of the complexity score's five parts, the ends of their ramps, and the decision's thresholds.
COMPLEXITY_WEIGHTS = {"accessibility": 0.45, "rings": 0.25, "sp3": 0.15, "macrocycle": 0.10, "stereo": 0.05}
ACCESSIBILITY, RINGS, SP3, STEREO = (2.5, 6.5), (0, 4), (0.2, 0.9), (0, 6)
BRIDGE_OR_SPIRO = 1.5
SINGLE_BELOW, ESCALATE_BELOW = 10.0, 30.0


def complexity(accessibility: str, fused: str, bridged: str, spiro: str, sp3: str, macrocycle: str, stereo: str) -> Column:
    """0 to 100: the weighted sum of synthetic accessibility, ring systems, sp3 share, macrocycles and stereocentres."""
    rings = F.col(fused) + BRIDGE_OR_SPIRO * (F.col(bridged) + F.col(spiro))
    parts = {
        "accessibility": ramp(accessibility, *ACCESSIBILITY),
        "rings": ramp(rings, *RINGS),
        "sp3": ramp(sp3, *SP3),
        "macrocycle": F.when(F.col(macrocycle), 1.0).otherwise(0.0),
        "stereo": ramp(stereo, *STEREO),
    }
    total = F.lit(0.0)
    for name, weight in COMPLEXITY_WEIGHTS.items():
        total = total + weight * parts[name]
    return 100 * total


def complexity_decision(score: str) -> Column:
    return F.when(F.col(score) < SINGLE_BELOW, "single_step").when(F.col(score) < ESCALATE_BELOW, "single_then_escalate").otherwise("multi_step_search")
