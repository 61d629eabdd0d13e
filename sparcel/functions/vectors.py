"""Arithmetic, losses and norms on array columns, all as JVM-side higher-order functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: str | Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def zipped(a: Column, b: Column, op) -> Column:
    return F.zip_with(a, b, op)


def mapped(a: Column, op) -> Column:
    return F.transform(a, op)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def product(a: Column) -> Column:
    return F.aggregate(a, F.lit(1.0), lambda s, x: s * x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sample_std(a: Column) -> Column:
    """Standard deviation with n-1, two-pass."""
    n = F.size(a)
    m = mean(a)
    return F.sqrt(total(F.transform(a, lambda x: (x - m) * (x - m))) / (n - 1))


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def z_score(a: Column, means: Column, stds: Column) -> Column:
    return F.zip_with(F.zip_with(a, means, lambda x, m: x - m), stds, lambda x, s: x / s)


def from_z_score(a: Column, means: Column, stds: Column) -> Column:
    return F.zip_with(F.zip_with(a, stds, lambda x, s: x * s), means, lambda x, m: x + m)


# losses of two equally long arrays


def l1(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def mse(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def smooth_l1(a: Column, b: Column, beta: float = 1.0) -> Column:
    def one(x, y):
        d = F.abs(x - y)
        return F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)

    return mean(F.zip_with(a, b, one))


def psnr(a: Column, b: Column, peak: float = 1.0) -> Column:
    return 20 * F.log10(F.lit(peak) / F.sqrt(mse(a, b)))


def kl_to_unit(mu: Column, logvar: Column) -> Column:
    return mean(F.zip_with(mu, logvar, lambda m, v: m * m + F.exp(v) - v - 1)) * 0.5


def bce_logits(logits: Column, target: Column) -> Column:
    return mean(
        F.zip_with(logits, target, lambda x, t: F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x))))
    )


def normal_angle(a: Column, b: Column) -> Column:
    """Angle in degrees between two normals stored in [0, 1]; NULL when one has no length."""
    p, q = [F.transform(v, lambda x: x * 2 - 1) for v in (a, b)]
    norms = F.sqrt(dot(p, p)) * F.sqrt(dot(q, q))
    cosine = F.greatest(F.least(dot(p, q) / (norms + 1e-9), F.lit(1.0)), F.lit(-1.0))
    return F.when(norms > 1e-9, F.degrees(F.acos(cosine)))


def unit(a: Column) -> Column:
    """Scaled to length one; a zero vector stays zero."""
    norm = F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12))
    return F.transform(a, lambda x: x / norm)


def rms_norm(a: Column) -> Column:
    return F.transform(unit(a), lambda x: x * F.sqrt(F.size(a).cast("double")))


def relative_gap(x: Column, y: Column) -> Column:
    return F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1e-12))


# activations


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def margin_sigmoid(x: Column, margin: float) -> Column:
    """Sigmoid stretched so that it may leave [0, 1] by ``margin``."""
    return (1 + 2 * margin) * sigmoid(x) - margin


# rotary position phases


def rotary_frequencies(head_dim: int, axes: int = 3, base: float = 1.0, decay: float = 10000.0) -> list[float]:
    width = head_dim // 2 // axes
    return [base / decay ** (i / width) for i in range(width)]


def rotary_phases(coords: Sequence[Column], head_dim: int) -> Column:
    """One angle per channel pair: every axis in turn at all frequencies, zeros for the rest."""
    freqs = rotary_frequencies(head_dim, len(coords))
    angles = [c * F.lit(f) for c in coords for f in freqs]
    return F.array(*angles, *[F.lit(0.0)] * (head_dim // 2 - len(angles)))


def rotate_pairs(a: Column, phases: Column) -> Column:
    """Rotate consecutive channel pairs by the given angles."""

    def pair(p, i):
        x, y = F.get(a, i * 2), F.get(a, i * 2 + 1)
        return F.array(x * F.cos(p) - y * F.sin(p), x * F.sin(p) + y * F.cos(p))

    return F.flatten(F.transform(phases, pair))
