"""Low-discrepancy sequences, camera sampling and seeded draws."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: bases of the Halton dimensions
PRIMES = [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53]


def radical_inverse(n: Column, base: int) -> Column:
    """Digits of ``n`` mirrored behind the point; enough digits for any 32-bit index."""
    digits = math.ceil(32 / math.log2(base))
    place = F.transform(
        F.sequence(F.lit(0), F.lit(digits - 1)),
        lambda k: F.pmod(F.floor(n / F.pow(F.lit(float(base)), k)), F.lit(base)) / F.pow(F.lit(float(base)), k + 1),
    )
    return F.aggregate(place, F.lit(0.0), lambda s, x: s + x)


def hammersley(n: Column, count: Column | int, dims: int) -> list[Column]:
    return [n / count, *[radical_inverse(n, PRIMES[i]) for i in range(dims - 1)]]


def sphere_direction(n: Column, count: Column | int, offset=(0.0, 0.0), remap: bool = True) -> tuple[Column, Column]:
    """Yaw and pitch of the n-th of ``count`` even directions; ``remap`` thins out one pole."""
    u, v = hammersley(n, count, 2)
    u, v = u + offset[0] / count, v + offset[1]
    if remap:
        u = F.when(u < 0.25, 2 * u).otherwise(2.0 / 3 * u + 1.0 / 3)
    return v * (2 * math.pi), F.acos(1 - 2 * u) - math.pi / 2


def camera_distance(u: Column, fov_min: float = 10, fov_max: float = 70) -> tuple[Column, Column]:
    """Radius and field of view (radians) from a uniform draw of 1/r²."""
    half = math.sqrt(3) / 2
    nearest = half / math.sin(fov_max / 360 * math.pi)
    farthest = half / math.sin(fov_min / 360 * math.pi)
    k = 1 / farthest**2 + u * (1 / nearest**2 - 1 / farthest**2)
    radius = 1 / F.sqrt(k)
    return radius, 2 * F.asin(half / radius)


def look_direction(yaw: Column, pitch: Column, yaw_from_y: bool = False) -> Column:
    """Unit vector towards (yaw, pitch); yaw counts from x, or from y as orbit renders do."""
    flat = (F.sin(yaw), F.cos(yaw)) if yaw_from_y else (F.cos(yaw), F.sin(yaw))
    return F.array(flat[0] * F.cos(pitch), flat[1] * F.cos(pitch), F.sin(pitch))


def projection(fx: Column, fy: Column, cx: Column, cy: Column, near: float, far: float) -> Column:
    """4x4 perspective matrix from normalised intrinsics."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(
        F.array(2 * fx, zero, 2 * cx - 1, zero),
        F.array(zero, 2 * fy, 1 - 2 * cy, zero),
        F.array(zero, zero, F.lit(far / (far - near)), F.lit(near * far / (near - far))),
        F.array(zero, zero, one, zero),
    )


def unit_draw(seed: int, *keys: Column) -> Column:
    """Uniform [0, 1) from the first 52 bits of an md5 of seed and keys; equal in any engine."""
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return F.conv(F.substring(text, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def logit_normal(u1: Column, u2: Column, mean: float, std: float) -> Column:
    """Sigmoid of a normal draw, the normal made from two uniforms."""
    normal = F.sqrt(-2 * F.log(1 - u1)) * F.cos(2 * math.pi * u2)
    return 1 / (1 + F.exp(-(normal * std + mean)))
