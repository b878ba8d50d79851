"""Fusion of a few frequency bands per row and attention over the frames of a window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rippleframe.functions import phase as ph
from rippleframe.functions import vectors as vec


def unit_power(z: Column) -> Column:
    """Complex vector over its root mean square; zeros when there is no power."""
    rms = F.sqrt(ph.energy(z) / F.size(z))
    part = lambda c, s: F.when(s > 1e-12, c / s).otherwise(F.lit(0.0))
    return vec.let(
        rms,
        lambda s: F.transform(z, lambda c: F.struct(part(c["re"], s).alias("re"), part(c["im"], s).alias("im"))),
    )


def fuse_bands(bands: list[Column], weights: list[Column]) -> Column:
    """Struct (fused, coherence): bands of one length, phase-aligned to the first.

    The number of bands is a property of the receiver, so pairs of bands are pairs
    of expressions within one row.
    """
    first = unit_power(bands[0])
    aligned = [first] + [
        vec.let(unit_power(z), lambda u: vec.let(ph.lo_phase_offset(first, u), lambda a: ph.rotate(u, a))) for z in bands[1:]
    ]
    total = sum(weights[1:], weights[0])
    share = [F.when(total > 0, w / total).otherwise(1.0 / len(bands)) for w in weights]

    def finish(row):
        vs, ws = [row[f"v{i}"] for i in range(len(bands))], [row[f"w{i}"] for i in range(len(bands))]
        fused = F.transform(
            vs[0],
            lambda c, k: F.struct(
                sum((w * F.get(v, k)["re"] for v, w in zip(vs[1:], ws[1:])), ws[0] * c["re"]).alias("re"),
                sum((w * F.get(v, k)["im"] for v, w in zip(vs[1:], ws[1:])), ws[0] * c["im"]).alias("im"),
            ),
        )

        def agreement(a, b):
            norms = F.sqrt(ph.energy(a) * ph.energy(b))
            z = ph.inner(a, b)
            return F.when(norms > 1e-12, F.least(F.lit(1.0), F.hypot(z["re"], z["im"]) / norms)).otherwise(F.lit(0.0))

        pairs = [agreement(vs[i], vs[j]) for i in range(len(vs)) for j in range(i + 1, len(vs))]
        coherence = sum(pairs[1:], pairs[0]) / len(pairs) if pairs else F.lit(1.0)
        return F.struct(fused.alias("fused"), coherence.alias("coherence"))

    row = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(aligned)], *[w.alias(f"w{i}") for i, w in enumerate(share)])
    return vec.let(row, finish)


def attention_profile(rows: Column, priors: Column | None = None) -> Column:
    """Velocity profile of one window: attention-weighted sum of its frames.

    ``rows`` is an array of equally long vectors (one window); without ``priors``
    the frames count alike.
    """
    n = F.size(rows)
    prior = F.transform(rows, lambda r: 1.0 / n) if priors is None else vec.normalize_weights(priors)

    def combine(weights):
        return F.transform(
            F.get(rows, F.lit(0)), lambda x, k: vec.total(F.zip_with(rows, weights, lambda r, w: F.get(r, k) * w))
        )

    def attend(p):
        query = combine(p)
        logits = vec.let(
            query,
            lambda q: F.zip_with(rows, p, lambda r, w: vec.dot(r, q) / F.sqrt(F.size(r).cast("double")) + F.log(w + 1e-12)),
        )
        return vec.let(logits, vec.softmax)

    return vec.let(vec.let(prior, attend), combine)


def band_maxima(amplitude: Column | str, df: float, low: float, high: float, top: int = 5) -> Column:
    """Strongest local maxima of a spectrum between two frequencies, as (hz, power) structs."""
    p = F.transform(vec.col(amplitude), lambda x: x * x)

    def pick(power):
        peaks = F.transform(power, lambda x, i: F.struct((-x).alias("neg"), i.alias("i")))
        inside = lambda q: (q["i"] * df >= low) & (q["i"] * df <= high) & (q["i"] > 0) & (q["i"] < F.size(power) - 1)
        local = lambda q: (-q["neg"] >= F.get(power, q["i"] - 1)) & (-q["neg"] >= F.get(power, q["i"] + 1))
        kept = F.slice(F.array_sort(F.filter(peaks, lambda q: inside(q) & local(q))), 1, top)
        return F.transform(kept, lambda q: F.struct((q["i"] * df).alias("hz"), (-q["neg"]).alias("power")))

    return vec.let(p, pick)
