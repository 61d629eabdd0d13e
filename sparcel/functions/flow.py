"""Closed forms of the linear noise path between data and noise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGMA_MIN = 1e-5


def noise_scale(t: Column, sigma: float = SIGMA_MIN) -> Column:
    return sigma + (1 - sigma) * t


def diffuse(x0: Column, noise: Column, t: Column, sigma: float = SIGMA_MIN) -> Column:
    return F.zip_with(x0, noise, lambda x, e: (1 - t) * x + noise_scale(t, sigma) * e)


def undiffuse(xt: Column, noise: Column, t: Column, sigma: float = SIGMA_MIN) -> Column:
    return F.zip_with(xt, noise, lambda x, e: (x - noise_scale(t, sigma) * e) / (1 - t))


def velocity(x0: Column, noise: Column, sigma: float = SIGMA_MIN) -> Column:
    return F.zip_with(x0, noise, lambda x, e: (1 - sigma) * e - x)


def euler_step(xt: Column, v: Column, t: Column, t_next: Column) -> Column:
    return F.zip_with(xt, v, lambda x, d: x - (t - t_next) * d)


def start_from_velocity(xt: Column, v: Column, t: Column, sigma: float = SIGMA_MIN) -> Column:
    return F.zip_with(xt, v, lambda x, d: (1 - sigma) * x - noise_scale(t, sigma) * d)


def rescaled_time(t: Column, scale: float) -> Column:
    """Time warped towards its start when ``scale`` exceeds one."""
    return scale * t / (1 + (scale - 1) * t)


def schedule(steps: int, scale: float = 1.0) -> Column:
    """Array of (t, t_next) from 1 down to 0."""

    def at(i):
        return rescaled_time(1 - i / F.lit(float(steps)), scale)

    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.struct(at(i).alias("t"), at(i + 1).alias("t_next")))


def guided(pos: Column, neg: Column, strength: Column) -> Column:
    return F.zip_with(pos, neg, lambda p, n: strength * p + (1 - strength) * n)


def strength_in_interval(t: Column, strength: float, low: float, high: float) -> Column:
    """Guidance acts inside the interval; outside the strength is one."""
    return F.when(t.between(low, high), F.lit(float(strength))).otherwise(F.lit(1.0))
