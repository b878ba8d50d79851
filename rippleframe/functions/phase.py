"""Complex samples, phases and angles as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rippleframe.functions.vectors import col, total

TAU = 2 * math.pi


def wrap(angle: Column | str) -> Column:
    """Angle in (-pi, pi]."""
    a = col(angle)
    return F.atan2(F.sin(a), F.cos(a))


def circular_distance(a: Column | str, b: Column | str) -> Column:
    return F.abs(wrap(col(a) - col(b)))


def angular_distance(a: Column | str, b: Column | str) -> Column:
    d = F.pmod(col(a) - col(b), F.lit(TAU))
    return F.least(d, TAU - d)


def unwrap_step(delta: Column) -> Column:
    """Phase step with whole turns removed; a jump of exactly half a turn keeps its sign."""
    folded = F.pmod(delta + math.pi, F.lit(TAU)) - math.pi
    folded = F.when((folded == -math.pi) & (delta > 0), F.lit(math.pi)).otherwise(folded)
    return F.when(F.abs(delta) < math.pi, delta).otherwise(folded)


def polar(re: Column | str, im: Column | str) -> tuple[Column, Column]:
    """(amplitude, phase) of a complex sample."""
    return F.hypot(col(re), col(im)), F.atan2(col(im), col(re))


def rect(amplitude: Column | str, phase: Column | str) -> Column:
    """Array of complex structs from amplitude and phase arrays."""
    return F.zip_with(
        col(amplitude),
        col(phase),
        lambda a, p: F.struct((a * F.cos(p)).alias("re"), (a * F.sin(p)).alias("im")),
    )


def amplitudes(z: Column | str) -> Column:
    return F.transform(col(z), lambda c: F.hypot(c["re"], c["im"]))


def phases(z: Column | str) -> Column:
    return F.transform(col(z), lambda c: F.atan2(c["im"], c["re"]))


def rotate(z: Column | str, angle: Column) -> Column:
    """Every sample times e^(-i angle)."""
    c, s = F.cos(angle), F.sin(angle)
    return F.transform(
        col(z),
        lambda x: F.struct(
            (x["re"] * c + x["im"] * s).alias("re"), (x["im"] * c - x["re"] * s).alias("im")
        ),
    )


def inner(a: Column | str, b: Column | str) -> Column:
    """Struct (re, im) of sum(a * conj(b))."""
    re = total(F.zip_with(col(a), col(b), lambda x, y: x["re"] * y["re"] + x["im"] * y["im"]))
    im = total(F.zip_with(col(a), col(b), lambda x, y: x["im"] * y["re"] - x["re"] * y["im"]))
    return F.struct(re.alias("re"), im.alias("im"))


def energy(z: Column | str) -> Column:
    return total(F.transform(col(z), lambda c: c["re"] * c["re"] + c["im"] * c["im"]))


def lo_phase_offset(reference: Column | str, target: Column | str) -> Column:
    """Phase by which ``target`` leads ``reference``: arg of sum(target * conj(reference))."""
    z = inner(target, reference)
    return F.atan2(z["im"], z["re"])


def _clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def coherence(current: Column | str, reference: Column | str, eps: float = 1e-12) -> Column:
    """Struct of correlation, magnitude, phase stability and the weighted score.

    Weights .45 / .35 / .20.
    """
    a, b = col(current), col(reference)
    na, nb = F.sqrt(energy(a)), F.sqrt(energy(b))
    z = inner(a, b)
    both_zero = (na <= eps) & (nb <= eps)
    one_zero = (na <= eps) | (nb <= eps)

    def guarded(value: Column) -> Column:
        return F.when(both_zero, F.lit(1.0)).when(one_zero, F.lit(0.0)).otherwise(_clip01(value))

    corr = guarded(F.hypot(z["re"], z["im"]) / (na * nb))
    gap = F.sqrt(total(F.zip_with(amplitudes(a), amplitudes(b), lambda x, y: (x - y) * (x - y))))
    mag = F.when(na + nb <= eps, F.lit(1.0)).otherwise(_clip01(1.0 - gap / (na + nb)))
    # |sum w e^(i d)| with w = |a||b| is the modulus of sum a conj(b).
    weight = total(F.zip_with(amplitudes(a), amplitudes(b), lambda x, y: x * y))
    stab = guarded(F.when(weight <= eps, F.lit(0.0)).otherwise(F.hypot(z["re"], z["im"]) / weight))
    return F.struct(
        corr.alias("correlation"),
        mag.alias("magnitude"),
        stab.alias("stability"),
        _clip01(0.45 * corr + 0.35 * mag + 0.20 * stab).alias("score"),
    )
