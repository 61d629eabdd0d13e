"""Feature vector queries: reductions, losses, normalisation, noise paths, step logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparcel.functions import flow, nulls, sampling
from sparcel.functions import vectors as V
from sparcel.operators import reduce as R
from sparcel.operators.ordered import trailing
from sparcel.plans.catalog import query
from sparcel.tables import load

E_SQL = "e AS (SELECT vec_id, label, CAST(i AS INTEGER) AS i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i))"


def vecs(spark, d):
    return load(spark, d, "embeddings").select("vec_id", "label", V.as_double("embedding").alias("v"))


def pairs(spark, d):
    """Each vector with its successor."""
    left = vecs(spark, d).select("vec_id", F.col("v").alias("a"))
    right = vecs(spark, d).select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("b"))
    return left.join(right, "vec_id")


PAIRS_SQL = f"{E_SQL}, p AS (SELECT a.vec_id, a.i, a.v AS a, b.v AS b FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND a.i = b.i)"


@query(
    "segment_reduce",
    "A10",
    f"""WITH {E_SQL}, r AS (SELECT vec_id, label, avg(v) AS m, sum(v) AS s, sum(ln(abs(1 + v))) AS l, count(*) FILTER (WHERE 1 + v < 0) AS k FROM e GROUP BY vec_id, label)
    SELECT label, round(avg(m), 9) AS mean, round(sum(s), 6) AS sum, round(sum(l), 6) AS log_prod, CAST(1 - 2 * (sum(k) % 2) AS INTEGER) AS sign FROM r GROUP BY label""",
)
def segment_reduce(spark, d):
    v = F.col("v")
    reduced = R.segment_reduce(vecs(spark, d), "label", v, V.mapped(v, lambda x: x + 1))
    return reduced.select("label", F.round("mean", 9).alias("mean"), F.round("sum", 6).alias("sum"), F.round("log_prod", 6).alias("log_prod"), "sign")


@query(
    "moment_std",
    "A11",
    f"""WITH {E_SQL} SELECT label, round(sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0)), 9) AS std FROM e GROUP BY label""",
)
def moment_std(spark, d):
    return vecs(spark, d).select("label", F.explode("v").alias("x")).groupBy("label").agg(
        F.round(R.moment_std(F.col("x")), 9).alias("std")
    )


@query(
    "sample_std",
    "A11 P11",
    f"""WITH {E_SQL} SELECT vec_id, round(stddev_samp(v), 9) AS std, TRUE AS finite FROM e GROUP BY vec_id""",
)
def sample_std(spark, d):
    return vecs(spark, d).select(
        "vec_id", F.round(V.sample_std(F.col("v")), 9).alias("std"), nulls.all_finite(F.col("v")).alias("finite")
    )


@query(
    "weighted_mean",
    "A13",
    """
    SELECT l_partkey, round(sum(w * l_extendedprice) / nullif(sum(w), 0), 4) AS price
    FROM (SELECT l_partkey, l_extendedprice, 1 - (l_quantity - 40) / 7.3::DOUBLE AS w FROM lineitem) GROUP BY l_partkey
    """,
)
def weighted_mean(spark, d):
    """Weights of one minus a signed distance, which may be negative."""
    w = 1 - (F.col("l_quantity") - 40) / F.lit(7.3)
    return load(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.round(F.try_divide(F.sum(w * F.col("l_extendedprice")), F.sum(w)), 4).alias("price")
    )


@query(
    "linear_fit",
    "A19",
    """SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept
    FROM (SELECT CAST(json_extract(props, '$.k') AS DOUBLE) AS x, value AS y FROM events)""",
)
def linear_fit(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    fit = R.linear_fit(load(spark, d, "events"), k, F.col("value"))
    return fit.select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query(
    "clip_limit",
    "A20",
    """SELECT least(round(quantile_cont(value, 0.95), 6), 120.0) AS "limit" FROM (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)""",
)
def clip_limit(spark, d):
    """Percentile over a ring buffer of the last 1,000 values, the buffer being the feature."""
    out = R.clip_limit(load(spark, d, "events"), ["ts", "event_id"], "value", 1000, 95, 120.0)
    return out.select(F.round("limit", 6).alias("limit"))


@query(
    "time_bin_means",
    "A21",
    """SELECT CAST(floor(l_quantity / 50 * 10) AS INTEGER) AS bin, round(avg(l_discount), 9) AS mean FROM lineitem
    WHERE floor(l_quantity / 50 * 10) < 10 GROUP BY 1""",
)
def time_bin_means(spark, d):
    means = R.bin_means(load(spark, d, "lineitem"), F.col("l_quantity") / 50, F.col("l_discount"))
    return means.withColumn("mean", F.round("mean", 9))


@query(
    "step_log_reduce",
    "A22 F34 M15 S24",
    """
    SELECT 'k' AS key, CAST(max(CAST(json_extract(props, '$.k') AS DOUBLE)) AS DOUBLE) AS value FROM events
    UNION ALL SELECT 'value', round(avg(value), 6) FROM events
    UNION ALL SELECT 'low', min(value) FROM events WHERE event_type = 'error'
    """,
)
def step_log_reduce(spark, d):
    """Nested metrics reduced per key; a row without a key takes no part in it."""
    logs = load(spark, d, "events").select(
        F.map_concat(
            F.from_json("props", "map<string,double>"),
            F.create_map(F.lit("value"), F.col("value")),
            F.when(F.col("event_type") == "error", F.create_map(F.lit("low"), F.col("value"))).otherwise(
                F.expr("cast(map() as map<string,double>)")
            ),
        ).alias("metrics")
    )
    reduced = R.reduce_metrics(logs, "metrics", {"k": "max", "low": "min"})
    return reduced.withColumn("value", F.round("value", 6))


@query(
    "nested_metrics_reduce",
    "A22 F34",
    """
    SELECT 'loss/main' AS key, round(avg(value), 6) AS value FROM events
    UNION ALL SELECT 'loss/aux/k', CAST(max(CAST(json_extract(props, '$.k') AS DOUBLE)) AS DOUBLE) FROM events
    UNION ALL SELECT concat('by/', event_type, '/value'), round(avg(value), 6) FROM events GROUP BY event_type
    """,
)
def nested_metrics_reduce(spark, d):
    """Metrics nested three deep, some of them only in some rows, reduced leaf by leaf."""
    own = F.concat(F.lit('{"main":'), F.col("value").cast("string"), F.lit(',"aux":'), F.col("props"), F.lit(',"note":"{{"}'))
    by = F.concat(F.lit('{"'), F.col("event_type"), F.lit('":{"value":'), F.col("value").cast("string"), F.lit("}}"))
    docs = load(spark, d, "events").select(F.concat(F.lit('{"loss":'), own, F.lit(',"by":'), by, F.lit("}")).alias("doc"))
    return R.reduce_nested(docs, "doc", {"loss/aux/k": "max"}).withColumn("value", F.round("value", 6))


@query(
    "metric_predicates",
    "F34",
    """SELECT event_id, greatest(value, CAST(json_extract(props, '$.k') AS DOUBLE)) > 90 AS any_high,
    least(value, CAST(json_extract(props, '$.k') AS DOUBLE)) > 5 AS all_set, value * 2 AS doubled FROM events""",
)
def metric_predicates(spark, d):
    metrics = F.map_concat(F.from_json("props", "map<string,double>"), F.create_map(F.lit("value"), F.col("value")))
    return load(spark, d, "events").select("event_id", metrics.alias("m")).select(
        "event_id",
        F.exists(F.map_values("m"), lambda v: v > 90).alias("any_high"),
        F.forall(F.map_values("m"), lambda v: v > 5).alias("all_set"),
        F.element_at(F.transform_values("m", lambda k, v: v * 2), "value").alias("doubled"),
    )


@query(
    "vector_losses",
    "A23 F35",
    f"""WITH {PAIRS_SQL} SELECT vec_id, round(avg(abs(a - b)), 9) AS l1, round(avg((a - b) * (a - b)), 9) AS l2,
    round(avg(CASE WHEN abs(a - b) < 0.2 THEN 0.5 * (a - b) * (a - b) / 0.2 ELSE abs(a - b) - 0.1 END), 9) AS smooth,
    round(20 * log10(1 / sqrt(avg((a - b) * (a - b)))), 6) AS psnr,
    round(avg(a * a + exp(b) - b - 1) * 0.5, 9) AS kl,
    round(avg(greatest(a, 0) - a * (b > 0)::INTEGER + ln(1 + exp(-abs(a)))), 9) AS bce,
    round(max(abs(a - b) / greatest(abs(a), abs(b), 1e-12)), 6) AS gap FROM p GROUP BY vec_id""",
)
def vector_losses(spark, d):
    a, b = F.col("a"), F.col("b")
    return pairs(spark, d).select(
        "vec_id",
        F.round(V.l1(a, b), 9).alias("l1"),
        F.round(V.mse(a, b), 9).alias("l2"),
        F.round(V.smooth_l1(a, b, 0.2), 9).alias("smooth"),
        F.round(V.psnr(a, b), 6).alias("psnr"),
        F.round(V.kl_to_unit(a, b), 9).alias("kl"),
        F.round(V.bce_logits(a, V.mapped(b, lambda x: (x > 0).cast("double"))), 9).alias("bce"),
        F.round(F.array_max(F.zip_with(a, b, V.relative_gap)), 6).alias("gap"),
    )


@query(
    "normal_angles",
    "A23 F19",
    f"""WITH {PAIRS_SQL}, n AS (SELECT vec_id, sum((2 * a - 1) * (2 * b - 1)) AS d, sqrt(sum((2 * a - 1) * (2 * a - 1))) * sqrt(sum((2 * b - 1) * (2 * b - 1))) AS w
      FROM p WHERE i <= 3 GROUP BY vec_id)
    SELECT vec_id, round(degrees(acos(greatest(least(d / (w + 1e-9), 1), -1))), 6) AS angle FROM n""",
)
def normal_angles(spark, d):
    a, b = F.slice("a", 1, 3), F.slice("b", 1, 3)
    return pairs(spark, d).select("vec_id", F.round(V.normal_angle(a, b), 6).alias("angle"))


IMG_SQL = f"""{PAIRS_SQL}, px AS (SELECT CAST(vec_id // 64 AS BIGINT) AS image, CAST(vec_id % 64 AS INTEGER) AS py, i - 1 AS px, a, b FROM p)"""


def image_pixels(spark, d):
    """Images of up to 64 rows: one vector a row, one channel a pixel."""
    zipped = F.posexplode(F.arrays_zip("a", "b")).alias("px", "z")
    return pairs(spark, d).select(F.expr("vec_id div 64").alias("image"), F.expr("cast(vec_id % 64 as int)").alias("py"), zipped).select(
        "image", "py", "px", "z.a", "z.b"
    )


def ssim_sql() -> str:
    taps = ", ".join(f"({i - 5}, {t!r}::DOUBLE)" for i, t in enumerate(R.gaussian_taps()))
    sums = ", ".join(f"sum(w * {v}) AS {v}" for v in ("a", "b", "aa", "bb", "ab"))
    return f"""WITH {IMG_SQL}, taps(d, w) AS (VALUES {taps}),
    size AS (SELECT image, max(py) AS h FROM px GROUP BY image),
    q AS (SELECT image, py, px, a, b, a * a AS aa, b * b AS bb, a * b AS ab FROM px),
    h AS (SELECT image, py, px + d AS px, {sums} FROM q, taps WHERE px + d BETWEEN 0 AND 63 GROUP BY 1, 2, 3),
    m AS (SELECT h.image, py + d AS py, px, {sums} FROM h, taps, size WHERE size.image = h.image AND py + d BETWEEN 0 AND size.h GROUP BY 1, 2, 3)
    SELECT image, round(avg(((2 * a * b + 0.0001::DOUBLE) * (2 * (ab - a * b) + 0.0009::DOUBLE)) / ((a * a + b * b + 0.0001::DOUBLE) * (aa - a * a + bb - b * b + 0.0009::DOUBLE))), 9) AS ssim
    FROM m GROUP BY image"""


@query("image_ssim", "A23", ssim_sql())
def image_ssim(spark, d):
    return R.ssim(image_pixels(spark, d), ["image"]).withColumn("ssim", F.round("ssim", 9))


@query(
    "image_alpha_bbox",
    "A17 G10",
    f"""WITH {E_SQL} SELECT vec_id // 64 AS image, min(i - 1) AS x0, max(i - 1) AS x1, CAST(min(vec_id % 64) AS INTEGER) AS y0, CAST(max(vec_id % 64) AS INTEGER) AS y1
    FROM e WHERE v > 0.3 GROUP BY 1""",
)
def image_alpha_bbox(spark, d):
    pixels = vecs(spark, d).select("vec_id", F.posexplode("v").alias("px", "alpha"))
    row = F.expr("cast(vec_id % 64 as int)")
    return pixels.filter("alpha > 0.3").groupBy(F.expr("vec_id div 64").alias("image")).agg(
        F.min("px").alias("x0"), F.max("px").alias("x1"), F.min(row).alias("y0"), F.max(row).alias("y1")
    )


@query(
    "z_score_channels",
    "F26",
    f"""WITH {E_SQL}, s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS sd FROM e GROUP BY i)
    SELECT vec_id, CAST(i - 1 AS INTEGER) AS channel, round((v - m) / sd, 6) AS z, round(v, 6) AS back FROM e JOIN s USING (i)""",
)
def z_score_channels(spark, d):
    """Fit per-channel moments (a fixed-size row), apply them as array literals, and undo."""
    table = vecs(spark, d)
    stats = table.agg(
        F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(64)]).alias("m"),
        F.array(*[F.stddev_pop(F.get("v", F.lit(i))) for i in range(64)]).alias("s"),
    ).first()
    means, stds = V.literal(stats["m"]), V.literal(stats["s"])
    z = table.select("vec_id", V.z_score(F.col("v"), means, stds).alias("z"))
    both = z.withColumn("back", V.from_z_score(F.col("z"), means, stds))
    return both.select("vec_id", F.posexplode(F.arrays_zip("z", "back")).alias("channel", "p")).select(
        "vec_id", "channel", F.round("p.z", 6).alias("z"), F.round("p.back", 6).alias("back")
    )


@query(
    "vector_arithmetic",
    "F27 F28",
    f"""WITH {PAIRS_SQL} SELECT vec_id, round(sum(a + b), 6) AS plus, round(sum(a - b), 6) AS minus, round(sum(a * b), 9) AS dot,
    round(sum(1 - a), 6) AS reversed, round(sum(-a), 6) AS negated, round(sum(a / (2 + b)), 6) AS ratio FROM p GROUP BY vec_id""",
)
def vector_arithmetic(spark, d):
    a, b = F.col("a"), F.col("b")
    cols = {
        "plus": (V.zipped(a, b, lambda x, y: x + y), 6),
        "minus": (V.zipped(a, b, lambda x, y: x - y), 6),
        "dot": (V.zipped(a, b, lambda x, y: x * y), 9),
        "reversed": (V.mapped(a, lambda x: 1 - x), 6),
        "negated": (V.mapped(a, lambda x: -x), 6),
        "ratio": (V.zipped(a, b, lambda x, y: x / (2 + y)), 6),
    }
    return pairs(spark, d).select("vec_id", *[F.round(V.total(c), n).alias(k) for k, (c, n) in cols.items()])


@query(
    "noise_path",
    "F29",
    f"""WITH {PAIRS_SQL}, q AS (SELECT vec_id, i, a, b, (vec_id % 10) / 10.0::DOUBLE AS t FROM p),
    x AS (SELECT *, (1 - t) * a + (1e-5 + (1 - 1e-5) * t) * b AS xt, (1 - 1e-5) * b - a AS v FROM q)
    SELECT vec_id, round(sum(xt), 6) AS xt, round(sum(v), 6) AS v, round(sum((xt - (1e-5 + (1 - 1e-5) * t) * b) / (1 - t)), 6) AS back,
           round(sum(xt - (t - t * 0.5) * v), 6) AS stepped FROM x GROUP BY vec_id""",
)
def noise_path(spark, d):
    t = F.expr("(vec_id % 10) / 10D")
    path = pairs(spark, d).withColumns({"t": t}).withColumns(
        {"xt": flow.diffuse(F.col("a"), F.col("b"), F.col("t")), "vel": flow.velocity(F.col("a"), F.col("b"))}
    )
    return path.select(
        "vec_id",
        F.round(V.total(F.col("xt")), 6).alias("xt"),
        F.round(V.total(F.col("vel")), 6).alias("v"),
        F.round(V.total(flow.undiffuse(F.col("xt"), F.col("b"), F.col("t"))), 6).alias("back"),
        F.round(V.total(flow.euler_step(F.col("xt"), F.col("vel"), F.col("t"), F.col("t") * 0.5)), 6).alias("stepped"),
    )


@query(
    "step_schedule",
    "F29",
    """WITH s AS (SELECT c_custkey, i, 3.0::DOUBLE * (1 - i / 12.0::DOUBLE) / (1 + 2 * (1 - i / 12.0::DOUBLE)) AS t,
      3.0::DOUBLE * (1 - (i + 1) / 12.0::DOUBLE) / (1 + 2 * (1 - (i + 1) / 12.0::DOUBLE)) AS n FROM customer, range(0, 12) r(i))
    SELECT c_custkey, CAST(i AS INTEGER) AS step, round(t, 9) AS t, round(n, 9) AS t_next FROM s""",
)
def step_schedule(spark, d):
    return load(spark, d, "customer").select("c_custkey", F.posexplode(flow.schedule(12, 3.0)).alias("step", "s")).select(
        "c_custkey", "step", F.round("s.t", 9).alias("t"), F.round("s.t_next", 9).alias("t_next")
    )


@query(
    "guidance_mix",
    "F30",
    f"""WITH {PAIRS_SQL}, q AS (SELECT vec_id, i, a, b, (vec_id % 10) / 10.0::DOUBLE AS t FROM p),
    g AS (SELECT *, CASE WHEN t BETWEEN 0.3 AND 0.7 THEN 7.5::DOUBLE ELSE 1::DOUBLE END AS s FROM q),
    m AS (SELECT *, s * a + (1 - s) * b AS mix FROM g)
    SELECT vec_id, round(sum(mix), 6) AS mix, round(stddev_samp(a) / stddev_samp(mix), 6) AS rescale FROM m GROUP BY vec_id""",
)
def guidance_mix(spark, d):
    t = F.expr("(vec_id % 10) / 10D")
    strength = flow.strength_in_interval(t, 7.5, 0.3, 0.7)
    mixed = pairs(spark, d).withColumn("m", flow.guided(F.col("a"), F.col("b"), strength))
    return mixed.select(
        "vec_id",
        F.round(V.total(F.col("m")), 6).alias("mix"),
        F.round(V.sample_std(F.col("a")) / V.sample_std(F.col("m")), 6).alias("rescale"),
    )


DRAW_SQL = "CAST(('0x' || substr(md5('{seed}:' || {key}), 1, 13)) AS BIGINT) / 4503599627370496::DOUBLE"


@query(
    "condition_drop",
    "F31",
    f"""SELECT o_orderkey, o_custkey, CASE WHEN {DRAW_SQL.format(seed=7, key='o_orderkey')} >= 0.1 THEN o_orderpriority END AS cond FROM orders""",
)
def condition_drop(spark, d):
    u = sampling.unit_draw(7, F.col("o_orderkey"))
    return load(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(u >= 0.1, F.col("o_orderpriority")).alias("cond"))


@query(
    "timestep_draws",
    "F32 F39",
    f"""WITH u AS (SELECT o_orderkey, {DRAW_SQL.format(seed=1, key='o_orderkey')} AS u1, {DRAW_SQL.format(seed=2, key='o_orderkey')} AS u2 FROM orders)
    SELECT o_orderkey, round(u1, 9) AS uniform, round(1 / (1 + exp(-(sqrt(-2 * ln(1 - u1)) * cos(2 * pi() * u2) * 1.5 + 0.5))), 9) AS logit_normal FROM u""",
)
def timestep_draws(spark, d):
    u1, u2 = sampling.unit_draw(1, F.col("o_orderkey")), sampling.unit_draw(2, F.col("o_orderkey"))
    return load(spark, d, "orders").select(
        "o_orderkey", F.round(u1, 9).alias("uniform"), F.round(sampling.logit_normal(u1, u2, 0.5, 1.5), 9).alias("logit_normal")
    )


@query(
    "rotary_embed",
    "F33",
    f"""WITH {E_SQL}, c AS (SELECT vec_id, k, CASE k // 10 WHEN 0 THEN vec_id % 64 WHEN 1 THEN vec_id // 64 WHEN 2 THEN CAST(label AS BIGINT) ELSE 0 END * CASE WHEN k < 30 THEN 1 / pow(10000, (k % 10) / 10.0::DOUBLE) ELSE 0 END AS p
      FROM embeddings, range(0, 32) r(k)),
    j AS (SELECT c.vec_id, k, p, x.v AS x, y.v AS y FROM c JOIN e x ON x.vec_id = c.vec_id AND x.i = 2 * k + 1 JOIN e y ON y.vec_id = c.vec_id AND y.i = 2 * k + 2)
    SELECT vec_id, CAST(2 * k AS INTEGER) AS channel, round(x * cos(p) - y * sin(p), 6) AS v FROM j
    UNION ALL SELECT vec_id, CAST(2 * k + 1 AS INTEGER), round(x * sin(p) + y * cos(p), 6) FROM j""",
)
def rotary_embed(spark, d):
    coords = [F.expr("vec_id % 64"), F.expr("vec_id div 64"), F.col("label")]
    rotated = vecs(spark, d).withColumn("p", V.rotary_phases(coords, 64)).withColumn("r", V.rotate_pairs(F.col("v"), F.col("p")))
    return rotated.select("vec_id", F.posexplode("r").alias("channel", "v")).withColumn("v", F.round("v", 6))


@query(
    "group_norm",
    "F40",
    f"""WITH {E_SQL}, s AS (SELECT label, (i - 1) // 16 AS g, avg(v) AS m, var_pop(v) AS q FROM e GROUP BY 1, 2)
    SELECT vec_id, CAST(i - 1 AS INTEGER) AS channel, round((v - m) / sqrt(q + 1e-5), 6) AS v FROM e JOIN s ON e.label = s.label AND (e.i - 1) // 16 = s.g""",
)
def group_norm(spark, d):
    normed = R.group_norm(vecs(spark, d), ["label"], "v", 64, 4)
    return normed.select("vec_id", F.posexplode("v").alias("channel", "v")).withColumn("v", F.round("v", 6))


@query(
    "rms_norm",
    "F40 F39",
    f"""WITH {E_SQL}, n AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM e GROUP BY vec_id)
    SELECT vec_id, CAST(i - 1 AS INTEGER) AS channel, round(v / greatest(n, 1e-12) * 8, 6) AS rms, round(ln(1 + exp(v)), 6) AS soft,
           round(1.2::DOUBLE / (1 + exp(-v)) - 0.1, 6) AS margin, round(v / (1 + exp(-v)), 6) AS silu FROM e JOIN n USING (vec_id)""",
)
def rms_norm(spark, d):
    v = F.col("v")
    return vecs(spark, d).select("vec_id", F.posexplode(F.arrays_zip(V.rms_norm(v).alias("r"), v.alias("x"))).alias("channel", "p")).select(
        "vec_id",
        "channel",
        F.round("p.r", 6).alias("rms"),
        F.round(V.softplus(F.col("p.x")), 6).alias("soft"),
        F.round(V.margin_sigmoid(F.col("p.x"), 0.1), 6).alias("margin"),
        F.round(V.silu(F.col("p.x")), 6).alias("silu"),
    )


@query(
    "patchify",
    "F41",
    f"""WITH {E_SQL} SELECT vec_id // 64 AS image, CAST((i - 1) // 4 AS INTEGER) AS tx, CAST((vec_id % 64) // 4 AS INTEGER) AS ty,
    CAST((vec_id % 4) * 4 + (i - 1) % 4 AS INTEGER) AS channel, v FROM e""",
)
def patchify(spark, d):
    """Image to patches: the place inside a 4x4 patch becomes the channel."""
    from sparcel.functions.patches import patch_of

    pixels = vecs(spark, d).select("vec_id", F.posexplode("v").alias("px", "v"))
    tile, channel = patch_of([F.expr("cast(vec_id % 64 as int)"), F.col("px")], 4)
    return pixels.select(
        F.expr("vec_id div 64").alias("image"), tile[1].alias("tx"), tile[0].alias("ty"), channel.alias("channel"), "v"
    )


@query("unpatchify", "F41", f"WITH {E_SQL} SELECT vec_id, CAST(i - 1 AS INTEGER) AS px, v FROM e")
def unpatchify(spark, d):
    from sparcel.functions.patches import pixel_of

    row, col = pixel_of([F.col("ty"), F.col("tx")], F.col("channel"), 4)
    return patchify(spark, d).select((F.col("image") * 64 + row).alias("vec_id"), col.alias("px"), "v")


@query(
    "camera_views",
    "F15 F16 F17",
    """
    WITH h AS (SELECT o_orderkey, (o_orderkey % 150) / 150.0::DOUBLE + 0.25::DOUBLE / 150 AS u0,
        list_sum(list_transform(range(0, 32), lambda k: (((o_orderkey % 150) >> CAST(k AS INTEGER)) & 1) / pow(2::DOUBLE, k + 1))) + 0.5::DOUBLE AS v,
        (o_custkey % 997) / 997.0::DOUBLE AS w FROM orders),
    r AS (SELECT o_orderkey, CASE WHEN u0 < 0.25 THEN 2 * u0 ELSE 2.0::DOUBLE / 3 * u0 + 1.0::DOUBLE / 3 END AS u, v,
        pow(sin(10 / 360.0::DOUBLE * pi()) / (sqrt(3) / 2), 2) + w * (pow(sin(70 / 360.0::DOUBLE * pi()) / (sqrt(3) / 2), 2) - pow(sin(10 / 360.0::DOUBLE * pi()) / (sqrt(3) / 2), 2)) AS k FROM h),
    a AS (SELECT o_orderkey, v * 2 * pi() AS yaw, acos(1 - 2 * u) - pi() / 2 AS pitch, 1 / sqrt(k) AS radius FROM r)
    SELECT o_orderkey, round(yaw, 6) AS yaw, round(pitch, 6) AS pitch, round(radius, 6) AS radius, round(2 * asin(sqrt(3) / 2 / radius), 6) AS fov,
           round(cos(yaw) * cos(pitch), 6) AS dx, round(sin(yaw) * cos(pitch), 6) AS dy, round(sin(pitch), 6) AS dz, round(sin(yaw) * cos(pitch), 6) AS ox FROM a
    """,
)
def camera_views(spark, d):
    n = F.expr("o_orderkey % 150")
    yaw, pitch = sampling.sphere_direction(n, 150, (0.25, 0.5))
    radius, fov = sampling.camera_distance(F.expr("(o_custkey % 997) / 997D"))
    placed = load(spark, d, "orders").select(
        "o_orderkey", yaw.alias("yaw"), pitch.alias("pitch"), radius.alias("radius"), fov.alias("fov")
    )
    look = sampling.look_direction(F.col("yaw"), F.col("pitch"))
    orbit = sampling.look_direction(F.col("yaw"), F.col("pitch"), yaw_from_y=True)
    return placed.select(
        "o_orderkey",
        *[F.round(c, 6).alias(c) for c in ("yaw", "pitch", "radius", "fov")],
        *[F.round(F.get(look, F.lit(i)), 6).alias(f"d{a}") for i, a in enumerate("xyz")],
        F.round(F.get(orbit, F.lit(0)), 6).alias("ox"),
    )


@query(
    "halton_points",
    "F15",
    """SELECT c_custkey, round(list_sum(list_transform(range(0, 32), lambda k: floor(c_custkey / pow(2::DOUBLE, k)) % 2 / pow(2::DOUBLE, k + 1))), 9) AS h2,
    round(list_sum(list_transform(range(0, 21), lambda k: floor(c_custkey / pow(3::DOUBLE, k)) % 3 / pow(3::DOUBLE, k + 1))), 9) AS h3 FROM customer""",
)
def halton_points(spark, d):
    n = F.col("c_custkey")
    return load(spark, d, "customer").select(
        "c_custkey", F.round(sampling.radical_inverse(n, 2), 9).alias("h2"), F.round(sampling.radical_inverse(n, 3), 9).alias("h3")
    )


@query(
    "camera_projection",
    "F18",
    """SELECT s_suppkey, round(2 * fx, 6) AS m00, round(2 * cx - 1, 6) AS m02, round(1 - 2 * cx, 6) AS m12, round(10 / (10 - 0.1::DOUBLE), 6) AS m22,
    round(0.1::DOUBLE * 10 / (0.1::DOUBLE - 10), 6) AS m23
    FROM (SELECT s_suppkey, 1 / (2 * tan(radians(20.0 + s_suppkey % 50) / 2)) AS fx, 0.5 + (s_suppkey % 7) / 70.0::DOUBLE AS cx FROM supplier)""",
)
def camera_projection(spark, d):
    fx = 1 / (2 * F.tan(F.radians(F.expr("20D + s_suppkey % 50")) / 2))
    cx = F.expr("0.5D + (s_suppkey % 7) / 70D")
    m = load(spark, d, "supplier").select("s_suppkey", sampling.projection(fx, fx, cx, cx, 0.1, 10.0).alias("m"))

    def at(i, j):
        return F.round(F.get(F.get("m", F.lit(i)), F.lit(j)), 6).alias(f"m{i}{j}")

    return m.select("s_suppkey", at(0, 0), at(0, 2), at(1, 2), at(2, 2), at(2, 3))


@query(
    "trailing_stats",
    "W14 A20",
    """SELECT event_id, round(sum(value) OVER w, 4) AS total, max(value) OVER w AS peak, count(*) OVER w AS n FROM events
    WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)""",
)
def trailing_stats(spark, d):
    events = load(spark, d, "events").select("event_id", "ts", "value")
    framed = trailing(
        events, ["ts", "event_id"], 1000,
        {"total": ("sum", F.col("value")), "peak": ("max", F.col("value")), "n": ("count", F.col("value"))},
    )
    return framed.select("event_id", F.round("total", 4).alias("total"), "peak", "n")


@query(
    "weight_ema",
    "A26",
    f"""WITH {E_SQL}, r AS (SELECT vec_id, max(CASE WHEN i = 1 THEN v END) * pow(0.9, 63) + sum(CASE WHEN i > 1 THEN v * (1 - 0.9::DOUBLE) * pow(0.9, 64 - i) ELSE 0 END) AS ema FROM e GROUP BY vec_id)
    SELECT vec_id, round(ema, 6) AS ema FROM r""",
)
def weight_ema(spark, d):
    return vecs(spark, d).select("vec_id", F.round(R.ema(F.col("v"), 0.9), 6).alias("ema"))


@query("principal_colors", "A25")
def principal_colors(spark, d):
    colors = R.principal_colors(load(spark, d, "embeddings"), "vec_id", "embedding", 64)
    return colors.select("vec_id", *[F.round(c, 6).alias(c) for c in ("c0", "c1", "c2")])
