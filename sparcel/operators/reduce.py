"""Reductions: segments, losses over images, fits, logs."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparcel.functions import vectors as V
from sparcel.operators.nested import flatten_objects, nesting


def segment_reduce(df: DataFrame, batch: str, vector: Column, factor: Column | None = None) -> DataFrame:
    """Mean, sum and product over all channels of the rows of each batch, in one aggregation.

    The product (of ``factor`` if given, else of ``vector``) comes as ``sign`` and ``log_prod``, the logarithm of its size:
    as a number it would fall to 0 or overflow within a few thousand rows. A zero factor gives sign 0 and
    no logarithm.
    """
    factor = vector if factor is None else factor
    logs = F.aggregate(F.transform(factor, lambda x: F.log(F.abs(x))), F.lit(0.0), lambda a, x: a + x)
    signs = F.aggregate(factor, F.lit(1), lambda a, x: (a * F.signum(x)).cast("int"))
    rows = df.select(batch, V.mean(vector).alias("_m"), V.total(vector).alias("_s"), logs.alias("_l"), signs.alias("_g"))
    sign = F.when(F.bool_or(F.col("_g") == 0), 0).otherwise(1 - 2 * F.pmod(F.count_if(F.col("_g") < 0), F.lit(2)))
    return rows.groupBy(batch).agg(
        F.avg("_m").alias("mean"), F.sum("_s").alias("sum"), sign.cast("int").alias("sign"),
        F.when(F.bool_and(F.col("_g") != 0), F.sum("_l")).alias("log_prod"),
    )


def moment_std(value: Column) -> Column:
    """Population deviation from the first two moments; rounding below zero counts as zero."""
    return F.sqrt(F.greatest(F.avg(value * value) - F.avg(value) * F.avg(value), F.lit(0.0)))


def group_norm(df: DataFrame, batch: Sequence[str], vector: str, channels: int, groups: int, eps: float = 1e-5) -> DataFrame:
    """Normalise channel groups over all rows of a batch.

    Moments come from a partial aggregation and are joined back, so a batch of any
    size is fine where a window would hold it in one task.
    """
    width = channels // groups
    stats = []
    for g in range(groups):
        part = F.slice(vector, g * width + 1, width)
        count = F.count(F.lit(1)) * width
        mean = F.sum(V.total(part)) / count
        stats += [mean.alias(f"_m{g}"), (F.sum(V.dot(part, part)) / count - mean * mean).alias(f"_v{g}")]
    moments = df.groupBy(*batch).agg(*stats)
    means = F.array(*[F.col(f"_m{g}") for g in range(groups) for _ in range(width)])
    scales = F.array(*[F.sqrt(F.greatest(F.col(f"_v{g}"), F.lit(0.0)) + eps) for g in range(groups) for _ in range(width)])
    return df.join(moments, list(batch)).withColumn(vector, V.z_score(F.col(vector), means, scales)).select(*df.columns)


def gaussian_taps(width: int = 11, sigma: float = 1.5) -> list[float]:
    taps = [math.exp(-((i - width // 2) ** 2) / (2 * sigma * sigma)) for i in range(width)]
    return [t / sum(taps) for t in taps]


def blur(pixels: DataFrame, image: Sequence[str], values: Sequence[str], axis: str, sizes: DataFrame) -> DataFrame:
    """One axis of a gaussian filter: every pixel adds its weighted values to the pixels it reaches."""
    taps = gaussian_taps()
    half = len(taps) // 2
    reach = F.array(*[F.struct(F.lit(i - half).alias("d"), F.lit(t).alias("w")) for i, t in enumerate(taps)])
    sent = pixels.withColumn("_t", F.explode(reach)).withColumn(axis, F.col(axis) + F.col("_t.d"))
    inside = sent.join(sizes, list(image)).filter((F.col(axis) >= 0) & (F.col(axis) < F.col(f"_{axis}")))
    keys = [*image, "py", "px"]
    return inside.groupBy(*keys).agg(*[F.sum(F.col(v) * F.col("_t.w")).alias(v) for v in values])


def ssim(pixels: DataFrame, image: Sequence[str]) -> DataFrame:
    """Structural similarity per image of pixel values ``a`` and ``b`` at (py, px).

    The gaussian window is separable: two groupings of eleven offers per pixel.
    """
    values = ["a", "b", "aa", "bb", "ab"]
    sizes = pixels.groupBy(*image).agg((F.max("py") + 1).alias("_py"), (F.max("px") + 1).alias("_px"))
    products = pixels.withColumns({"aa": F.col("a") * F.col("a"), "bb": F.col("b") * F.col("b"), "ab": F.col("a") * F.col("b")})
    m = blur(blur(products, image, values, "px", sizes), image, values, "py", sizes)
    c1, c2 = 0.01**2, 0.03**2
    va = F.col("aa") - F.col("a") * F.col("a")
    vb = F.col("bb") - F.col("b") * F.col("b")
    cov = F.col("ab") - F.col("a") * F.col("b")
    score = ((2 * F.col("a") * F.col("b") + c1) * (2 * cov + c2)) / (
        (F.col("a") * F.col("a") + F.col("b") * F.col("b") + c1) * (va + vb + c2)
    )
    return m.groupBy(*image).agg(F.avg(score).alias("ssim"))


def bin_means(df: DataFrame, t: Column, value: Column, bins: int = 10) -> DataFrame:
    """Mean per equal-width bin of [0, 1); a time of exactly one falls outside."""
    binned = df.select(F.floor(t * bins).cast("int").alias("bin"), value.alias("_v"))
    return binned.filter((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy("bin").agg(F.avg("_v").alias("mean"))


def reduce_metrics(logs: DataFrame, metrics: str, special: Mapping[str, str]) -> DataFrame:
    """Reduce a map column key by key: the mean, or min/max for the keys named in ``special``."""
    flat = logs.select(F.explode(metrics).alias("key", "value"))
    value = F.avg("value")
    for key, how in special.items():
        value = F.when(F.col("key") == key, {"min": F.min, "max": F.max}[how]("value")).otherwise(value)
    return flat.groupBy("key").agg(value.alias("value"))


def reduce_nested(docs: DataFrame, text: str, special: Mapping[str, str]) -> DataFrame:
    """As ``reduce_metrics``, over a column of JSON objects of any depth; keys are paths joined with ``/``.

    Texts that are no JSON object, nulls and leaves that are no numbers take no part.
    """
    parsed = docs.filter(F.col(text).startswith("{")).select(F.col(text).alias("text"), F.try_parse_json(text).alias("doc")).filter("doc is not null")
    depth = parsed.agg(F.max(nesting("text"))).first()[0] or 0
    leaves = flatten_objects(parsed, [], "doc", depth).select("key", F.expr("try_cast(try_cast(value AS string) AS double)").alias("value"))
    metrics = leaves.filter("value is not null").select(F.create_map("key", "value").alias("m"))
    return reduce_metrics(metrics, "m", special)


def clip_limit(df: DataFrame, order: Sequence[str], value: str, size: int, percent: float, cap: float) -> DataFrame:
    """Percentile of the last ``size`` values (linear interpolation), capped."""
    last = df.orderBy(*[F.desc(c) for c in order]).limit(size)
    return last.agg(F.least(F.percentile(value, percent / 100), F.lit(cap)).alias("limit"))


def linear_fit(df: DataFrame, x: Column, y: Column) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def ema(values: Column, rate: float) -> Column:
    """Exponential moving average of an ordered array, starting from its first element."""
    rest = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.aggregate(rest, F.get(values, F.lit(0)), lambda s, x: s * rate + x * (1 - rate))


def principal_colors(df: DataFrame, key: str, vector: str, dim: int, channels: int = 3) -> DataFrame:
    """Leading left singular vectors of the (uncentered) feature matrix, each scaled to [0, 1].

    Executors sum the dim x dim Gram matrix; only that matrix, whose size does not
    depend on the rows, is decomposed on the driver.
    """
    def partial(batches):
        gram = np.zeros((dim, dim))
        for pdf in batches:
            block = np.stack(pdf[vector].to_numpy()).astype(np.float64)
            gram += block.T @ block
        i, j = np.indices((dim, dim))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": gram.ravel()})

    parts = df.select(vector).mapInPandas(partial, "i int, j int, v double")
    entries = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    gram = np.zeros((dim, dim))
    gram[entries["i"], entries["j"]] = entries["v"]
    values, basis = np.linalg.eigh(gram)
    lead = basis[:, ::-1][:, :channels] / np.sqrt(np.maximum(values[::-1][:channels], 1e-30))
    lead *= np.sign(lead[np.abs(lead).argmax(axis=0), range(channels)])
    scores = df.select(key, *[V.dot(V.as_double(vector), V.literal(lead[:, c])).alias(f"u{c}") for c in range(channels)])
    span = scores.agg(*[f(f"u{c}").alias(f"{n}{c}") for c in range(channels) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return scores.select(key, *[((F.col(f"u{c}") - span[f"lo{c}"]) / (span[f"hi{c}"] - span[f"lo{c}"])).alias(f"c{c}") for c in range(channels)])
