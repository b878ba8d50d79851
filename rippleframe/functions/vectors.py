"""Array columns as numeric vectors. All expressions stay on the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Without this the optimizer copies a shared sub-expression into every use, and
    deep formulas grow exponentially.
    """
    return F.get(F.transform(F.array(value), body), 0)


def total(v: Column | str) -> Column:
    return F.aggregate(col(v), F.lit(0.0), lambda acc, x: acc + x)


def mean(v: Column | str) -> Column:
    return total(v) / F.size(col(v))


def var_pop(v: Column | str) -> Column:
    v = col(v)
    squares = let(
        mean(v), lambda m: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m))
    )
    return squares / F.size(v)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 when either vector is (nearly) zero."""
    parts = F.struct(norm(a).alias("a"), norm(b).alias("b"), dot(a, b).alias("d"))
    return let(
        parts,
        lambda p: F.when((p["a"] <= TINY) | (p["b"] <= TINY), F.lit(0.0)).otherwise(p["d"] / (p["a"] * p["b"])),
    )


def scale(v: Column | str, factor: Column) -> Column:
    return F.transform(col(v), lambda x: x * factor)


def min_max_normalize(v: Column | str) -> Column:
    """(x - min) / (max - min); a constant vector gives zeros."""
    v = col(v)
    ends = F.struct(F.array_min(v).alias("lo"), F.array_max(v).alias("hi"))
    unit = lambda x, e: F.when(e["hi"] > e["lo"], (x - e["lo"]) / (e["hi"] - e["lo"])).otherwise(F.lit(0.0))
    return let(ends, lambda e: F.transform(v, lambda x: unit(x, e)))


def zscore_normalize(v: Column | str) -> Column:
    v = col(v)
    moments = F.struct(mean(v).alias("m"), F.sqrt(var_pop(v)).alias("s"))
    z = lambda x, k: F.when(k["s"] > TINY, (x - k["m"]) / k["s"]).otherwise(F.lit(0.0))
    return let(moments, lambda k: F.transform(v, lambda x: z(x, k)))


def l2_normalize(v: Column | str, eps: float = TINY) -> Column:
    return let(F.greatest(norm(v), F.lit(eps)), lambda n: F.transform(col(v), lambda x: x / n))


def normalize_weights(w: Column | str) -> Column:
    """Weights summing to one; all-zero weights become uniform."""
    w = col(w)
    return let(total(w), lambda s: F.transform(w, lambda x: F.when(s > 0, x / s).otherwise(1.0 / F.size(w))))


def softmax(v: Column | str) -> Column:
    v = col(v)
    e = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    return let(e, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def relu(v: Column | str) -> Column:
    return F.transform(col(v), lambda x: F.greatest(x, F.lit(0.0)))


def sigmoid(v: Column | str) -> Column:
    return F.transform(col(v), lambda x: 1.0 / (1.0 + F.exp(-x)))


def tanh(v: Column | str) -> Column:
    return F.transform(col(v), F.tanh)


def argmax(v: Column | str) -> Column:
    """0-based index of the maximum, lowest index on ties."""
    v = col(v)
    return F.array_position(v, F.array_max(v)) - 1


def top_indices(v: Column | str, limit: int = 8) -> Column:
    """0-based indices of the largest values; ties keep the lower index first."""
    pairs = F.transform(col(v), lambda x, i: F.struct((-x).alias("k"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, limit), lambda p: p["i"])


def fuse(a: Column | str, b: Column | str, weight: Column) -> Column:
    """weight * a + (1 - weight) * b."""
    return F.zip_with(col(a), col(b), lambda x, y: weight * x + (1.0 - weight) * y)


def subtract(v: Column | str, baseline: Column | str, clip: bool = True) -> Column:
    low = lambda d: F.greatest(d, F.lit(0.0)) if clip else d
    return F.zip_with(col(v), col(baseline), lambda x, b: low(x - b))


def resample(v: Column | str, target: int) -> Column:
    """Linear interpolation of the vector onto ``target`` evenly spaced points."""
    v = col(v)
    n = F.size(v)
    step = (n - 1) / F.lit(max(target - 1, 1))

    def at(i):
        x = i * step
        lo = F.least(F.floor(x).cast("int"), n - 1)
        hi = F.least(lo + 1, n - 1)
        a, b = F.element_at(v, lo + 1), F.element_at(v, hi + 1)
        return a + (b - a) * (x - lo)

    return F.transform(F.sequence(F.lit(0), F.lit(target - 1)), at)


def centre_crop(v: Column | str, target: int) -> Column:
    v = col(v)
    start = F.floor((F.size(v) - target) / 2).cast("int")
    return F.when(F.size(v) > target, F.slice(v, start + 1, F.lit(target))).otherwise(v)


def fit_length(v: Column | str, target: int) -> Column:
    """Keep the last ``target`` values, or pad with the last value."""
    v = col(v)
    n = F.size(v)
    pad = F.array_repeat(F.element_at(v, -1), F.greatest(F.lit(target) - n, F.lit(0)))
    return F.when(n >= target, F.slice(v, -target, target)).otherwise(F.concat(v, pad))


def weighted_mean(v: Column | str, w: Column | str) -> Column:
    """Mean across a vector with weights normalised by their absolute sum."""
    return dot(v, w) / total(F.transform(col(w), F.abs))


def smooth_phase_weights(phases: Column | str) -> Column:
    """exp(-|wrapped step to the next phase|); the last entry repeats the step before it."""
    p = col(phases)
    n = F.size(p)

    def weight(x, i):
        step = F.when(i < n - 1, F.get(p, i + 1) - x).otherwise(x - F.get(p, i - 1))
        return F.coalesce(let(step, lambda d: F.exp(-F.abs(F.atan2(F.sin(d), F.cos(d))))), F.lit(1.0))

    return F.transform(p, weight)


def phase_steps(phase: Column | str) -> Column:
    """First-order difference with a zero first element."""
    p = col(phase)
    return F.transform(p, lambda x, i: F.when(i == 0, F.lit(0.0)).otherwise(x - F.get(p, i - 1)))


def effective_viewpoints(azimuths: Column | str, sigma: float) -> Column:
    """n^2 / sum of squared Gaussian correlations between viewing angles."""
    a = col(azimuths)

    def row(x):
        def corr(y):
            d = F.abs(F.atan2(F.sin(x - y), F.cos(x - y)))
            return F.exp(-(d * d) / (2 * sigma * sigma))

        return F.aggregate(a, F.lit(0.0), lambda acc, y: acc + corr(y) * corr(y))

    return F.size(a) * F.size(a) / total(F.transform(a, row))


def concat_all(columns: list[Column]) -> Column:
    return reduce(F.concat, columns)
