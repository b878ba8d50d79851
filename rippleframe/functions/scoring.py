"""Scores, ladders and gates. Thresholds are fixed values of the sensing domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rippleframe.functions.vectors import col, let, mean, var_pop

# Presence and motion weights, thresholds and component scales.
PRESENCE_THRESHOLD = 0.35
MOTION_THRESHOLD = 0.45
PRESENCE_WEIGHTS = {"mean": 0.50, "variance": 0.25, "motion": 0.15, "subcarrier": 0.10}
MOTION_WEIGHTS = {"delta": 0.35, "amplitude": 0.30, "phase": 0.20, "subcarrier": 0.15}
MOTION_ABSOLUTE = {"delta": 0.04, "amplitude": 0.03, "phase": 0.004, "subcarrier": 0.015}
MOTION_RELATIVE = {"delta": 0.03, "amplitude": 0.02, "phase": 0.003, "subcarrier": 0.01}
CONFIDENCE_LADDER = [(0.72, "valid"), (0.45, "degraded"), (0.18, "unreliable")]

# Coherence gate.
GATE = {
    "accept": 0.85,
    "reject": 0.5,
    "novelty_accept": 0.35,
    "novelty_reject": 0.7,
    "novelty_recalibrate": 0.95,
    "drift_predict": 0.6,
    "drift_recalibrate": 0.9,
    "max_stale": 200,
}


def clamp01(x: Column | str) -> Column:
    """Clamp to [0, 1]; NaN stays NaN."""
    x = col(x)
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def clamp01_or_zero(x: Column | str) -> Column:
    """Clamp to [0, 1]; NaN and infinities become 0."""

    def clamp(v):
        bad = F.isnan(v) | (F.abs(v) == float("inf"))
        return F.when(bad, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))

    return let(col(x).cast("double"), clamp)


def relative_increase(
    value: Column | str, reference: Column | str, relative: float = 1.0, absolute: float = 1.0
) -> Column:
    value, reference = col(value), col(reference)
    return clamp01(
        F.when(F.abs(reference) > 1e-12, (value - reference) / (F.abs(reference) * relative)).otherwise(
            value / absolute
        )
    )


def motion_components(stats: dict[str, Column], reference: dict[str, Column] | None = None) -> dict[str, Column]:
    """Four components from delta, amplitude, phase and subcarrier statistics."""
    if reference is None:
        return {k: clamp01(stats[k] / s) for k, s in MOTION_ABSOLUTE.items()}
    return {k: relative_increase(stats[k], reference[k], 1.0, s) for k, s in MOTION_RELATIVE.items()}


def motion_total(components: dict[str, Column]) -> Column:
    weights = sum(MOTION_WEIGHTS.values())
    return clamp01(sum(w * components[k] for k, w in MOTION_WEIGHTS.items()) / weights)


def presence_score(
    mean_amplitude: Column,
    amplitude_variance: Column,
    motion: Column,
    subcarrier_component: Column,
    reference: dict[str, Column] | None = None,
) -> Column:
    if reference is None:
        level = clamp01((mean_amplitude - 1.05) / 0.25)
        spread = clamp01(amplitude_variance / 0.03)
    else:
        level = relative_increase(mean_amplitude, reference["mean"], 0.15, 0.20)
        spread = relative_increase(amplitude_variance, reference["amplitude"], 0.8, 0.02)
    w = PRESENCE_WEIGHTS
    return clamp01(
        w["mean"] * level + w["variance"] * spread + w["motion"] * motion + w["subcarrier"] * subcarrier_component
    )


def presence_state(presence: Column, motion: Column) -> Column:
    return (
        F.when(presence < PRESENCE_THRESHOLD, "empty")
        .when(motion >= MOTION_THRESHOLD, "moving")
        .otherwise("still")
    )


def confidence_status(confidence: Column | str) -> Column:

    def ladder(value):
        out = None
        for floor, label in CONFIDENCE_LADDER:
            out = F.when(value >= floor, label) if out is None else out.when(value >= floor, label)
        return out.otherwise("unavailable")

    return let(clamp01_or_zero(confidence), ladder)


def amplitude_quality(cv: Column, fill: Column | None = None) -> Column:
    """Quality from the coefficient of variation, scaled by how full the history is."""
    q = (
        F.when(cv < 0.01, cv / 0.01 * 0.3)
        .when(cv < 0.3, 0.3 + 0.7 * F.greatest(F.lit(0.0), 1.0 - F.abs((cv - 0.15) / 0.15)))
        .otherwise(F.greatest(F.lit(0.1), F.least(F.lit(0.5), 1.0 - (cv - 0.3) / 0.7)))
    )
    fill = F.lit(1.0) if fill is None else clamp01_or_zero(fill)
    return clamp01_or_zero(q * (0.3 + 0.7 * fill))


def amplitude_vector_quality(v: Column | str) -> Column:
    level = mean(F.transform(col(v), F.abs))
    return F.when(level <= 1e-12, F.lit(0.0)).otherwise(amplitude_quality(F.sqrt(var_pop(v)) / level))


def motion_level(score: Column, presence: Column, active: float = 0.25, moving: float = 0.12) -> Column:
    """Level above ``active`` and ``moving``; a recording viewer uses .65 and .25."""
    return (
        F.when(~presence, "absent")
        .when(score > active, "active")
        .when(score > moving, "present_moving")
        .otherwise("present_still")
    )


def noise_multiplier(coherence: Column, accept=0.85, reject=0.5, max_inflation=3.0) -> Column:
    """1 above ``accept``, ``max_inflation`` below ``reject``, linear in between."""
    return (
        F.when(coherence >= accept, F.lit(1.0))
        .when(coherence <= reject, F.lit(max_inflation))
        .otherwise(1.0 + (accept - coherence) / (accept - reject) * (max_inflation - 1.0))
    )


def gate_decision(score: Column, novelty: Column, drift: Column, stale: Column) -> Column:
    """Gate for one observation, given the low-coherence count before it."""
    g = GATE
    after = stale + 1
    return (
        F.when(drift >= g["drift_recalibrate"], "recalibrate")
        .when(novelty >= g["novelty_recalibrate"], "recalibrate")
        .when(stale >= g["max_stale"], "recalibrate")
        .when(gate_accepts(score, novelty, drift), "accept")
        .when(after >= g["max_stale"], "recalibrate")
        .when((score >= g["reject"]) & (novelty < g["novelty_reject"]), "predict_only")
        .otherwise("reject")
    )


def gate_accepts(score: Column, novelty: Column, drift: Column) -> Column:
    g = GATE
    return (score >= g["accept"]) & (novelty <= g["novelty_accept"]) & (drift < g["drift_predict"])


def gate_counts(novelty: Column, drift: Column) -> Column:
    """Whether a non-accepted observation raises the low-coherence count."""
    g = GATE
    return (drift < g["drift_recalibrate"]) & (novelty < g["novelty_recalibrate"])


def intention_score(slope: Column, energy: Column, lead: Column) -> Column:
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return unit(
        0.42 * unit(F.greatest(slope, F.lit(0.0)) / 0.04)
        + 0.33 * unit(energy / 0.08)
        + 0.25 * unit(F.abs(lead) / 0.12)
    )


def identity_risk(*factors: Column) -> Column:
    out = F.lit(1.0)
    for f in factors:
        out = out * clamp01_or_zero(f)
    return out


def identity_gate(risk: Column) -> Column:
    """Fixed thresholds .5 / .7 / .9; NaN accepts."""
    return (
        F.when(F.isnan(risk), "accept")
        .when(risk >= 0.9, "recalibrate")
        .when(risk >= 0.7, "reject")
        .when(risk >= 0.5, "predict_only")
        .otherwise("accept")
    )
