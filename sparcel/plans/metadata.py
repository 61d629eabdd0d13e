"""Asset catalogue queries: overlays, cascades, pending work, shards, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparcel.functions.nulls import is_true, not_true
from sparcel.operators.cascade import cascade, cascade_counts, pending
from sparcel.operators.overlay import compact, overlay, overlay_all, stack
from sparcel.operators.sharding import contiguous_shards
from sparcel.plans.catalog import query
from sparcel.sources.catalogue import pick_instances
from sparcel.tables import load


def stage_labels(spark: SparkSession, d: str) -> DataFrame:
    """Sparse stage table: a score and a flag for part of the documents."""
    return load(spark, d, "labels").select(
        "doc_id", F.col("quality").cast("double").alias("score"), (F.col("toxic") == 1).alias("flagged")
    )


def assets(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")


@query(
    "overlay_assets",
    "J1 M1 M2",
    """
    SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.lang, l.flagged,
           coalesce(CASE WHEN d.n_chars % 3 <> 0 THEN d.n_chars END, l.n_chars) AS n_chars, l.score, d.source
    FROM documents d
    FULL JOIN (SELECT doc_id, CAST(quality AS DOUBLE) AS score, toxic = 1 AS flagged, doc_id * 10 AS n_chars FROM labels) l
      ON d.doc_id = l.doc_id
    """,
)
def overlay_assets(spark, d):
    left = assets(spark, d).withColumn("n_chars", F.when(F.col("n_chars") % 3 != 0, F.col("n_chars")))
    right = stage_labels(spark, d).withColumn("n_chars", F.col("doc_id") * 10)
    return overlay(left, right, ["doc_id"])


@query(
    "overlay_many",
    "J2",
    """
    WITH a AS (SELECT doc_id, n_chars FROM documents WHERE n_chars % 2 = 0),
         b AS (SELECT doc_id, CAST(quality AS BIGINT) AS quality, doc_id AS n_chars FROM labels),
         c AS (SELECT doc_id, CAST(7 AS BIGINT) AS quality, n_chars + 1 AS n_chars, lang FROM documents),
         k AS (SELECT doc_id FROM a UNION SELECT doc_id FROM b UNION SELECT doc_id FROM c)
    SELECT k.doc_id, coalesce(a.n_chars, b.n_chars, c.n_chars) AS n_chars,
           coalesce(b.quality, c.quality) AS quality, c.lang
    FROM k LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)
    """,
)
def overlay_many(spark, d):
    docs = assets(spark, d)
    a = docs.filter(F.col("n_chars") % 2 == 0).select("doc_id", "n_chars")
    b = load(spark, d, "labels").select(
        "doc_id", F.col("quality").cast("bigint").alias("quality"), F.col("doc_id").alias("n_chars")
    )
    c = docs.select("doc_id", F.lit(7).cast("bigint").alias("quality"), (F.col("n_chars") + 1).alias("n_chars"), "lang")
    return overlay_all([a, b, c], ["doc_id"])


@query(
    "log_compaction",
    "J3 M3 S5",
    """
    WITH log AS (
      SELECT user_id, ts, event_id, event_type,
             CASE WHEN event_type <> 'error' THEN value END AS value
      FROM events)
    SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type,
           arg_max(value, (ts, event_id)) FILTER (WHERE value IS NOT NULL) AS value
    FROM log GROUP BY user_id
    """,
)
def log_compaction(spark, d):
    log = load(spark, d, "events").select(
        "user_id", "ts", "event_id", "event_type",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
    )
    return compact(log, ["user_id"], ["ts", "event_id"])


@query(
    "cascade_by_source",
    "P3 P4 P7 P9 A2 A3 M4",
    """
    SELECT d.source, count(*) AS total,
           count(*) FILTER (WHERE l.quality >= 1) AS with_score,
           count(*) FILTER (WHERE l.quality >= 1 AND (l.toxic = 1) IS DISTINCT FROM TRUE) AS unflagged,
           count(*) FILTER (WHERE l.quality >= 1 AND (l.toxic = 1) IS DISTINCT FROM TRUE AND d.n_chars <= 2000) AS short_enough
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source
    """,
)
def cascade_by_source(spark, d):
    table = assets(spark, d).join(stage_labels(spark, d), "doc_id", "left")
    steps = [
        ("with_score", F.col("score") >= 1.0),
        ("unflagged", not_true(F.col("flagged"))),
        ("short_enough", F.col("n_chars") <= 2000),
    ]
    return cascade_counts(table, steps, by=["source"])


@query(
    "cascade_survivors",
    "P2 P3 P7 P9",
    """
    SELECT d.doc_id, d.n_chars, CAST(l.quality AS DOUBLE) AS score
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id
    WHERE l.quality >= 1 AND l.toxic = 0 AND d.n_chars <= 2000
    """,
)
def cascade_survivors(spark, d):
    table = assets(spark, d).join(stage_labels(spark, d), "doc_id", "left")
    steps = [
        ("with_score", F.col("score") >= 1.0),
        ("unflagged", is_true(~F.col("flagged"))),
        ("short_enough", F.col("n_chars") <= 2000),
    ]
    return cascade(table, steps).select("doc_id", "n_chars", "score")


@query(
    "texture_conjunction",
    "P8 P9",
    """
    SELECT count(*) AS total,
           count(*) FILTER (WHERE b > 0 AND m > 0 AND r > 0) AS full_set,
           count(*) FILTER (WHERE b > 0 AND m > 0 AND r > 0 AND q <= 60) AS bounded
    FROM (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS b,
                 count(*) FILTER (WHERE l_returnflag = 'N') AS m,
                 count(*) FILTER (WHERE l_returnflag = 'R') AS r, sum(l_quantity) AS q
          FROM lineitem GROUP BY l_orderkey)
    """,
)
def texture_conjunction(spark, d):
    stats = load(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") == "A").alias("b"),
        F.count_if(F.col("l_returnflag") == "N").alias("m"),
        F.count_if(F.col("l_returnflag") == "R").alias("r"),
        F.sum("l_quantity").alias("q"),
    )
    full = (F.col("b") > 0) & (F.col("m") > 0) & (F.col("r") > 0)
    return cascade_counts(stats, [("full_set", full), ("bounded", F.col("q") <= 60)])


@query(
    "flag_predicates",
    "P4 P5 A1",
    """
    SELECT count(*) AS n, count(l.quality) AS quality_present, CAST(sum(l.quality) AS BIGINT) AS quality_true,
           count(*) FILTER (WHERE (l.quality = 1) IS DISTINCT FROM TRUE) AS not_good,
           count(*) FILTER (WHERE (l.quality = 1) IS NOT DISTINCT FROM TRUE OR (l.toxic = 1) IS NOT DISTINCT FROM TRUE) AS either
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """,
)
def flag_predicates(spark, d):
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    table = assets(spark, d).join(load(spark, d, "labels"), "doc_id", "left")
    return table.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("quality").alias("quality_present"),
        F.sum("quality").alias("quality_true"),
        F.count_if(not_true(good)).alias("not_good"),
        F.count_if(is_true(good) | is_true(toxic)).alias("either"),
    )


@query(
    "pending_resolutions",
    "P1 P6",
    """
    SELECT d.doc_id, l.quality = 1 AS converted_256, e.label > 3 AS converted_512
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN embeddings e ON d.doc_id = e.vec_id
    WHERE (l.quality = 1) IS DISTINCT FROM TRUE OR (e.label > 3) IS DISTINCT FROM TRUE
    """,
)
def pending_resolutions(spark, d):
    low = load(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("converted"))
    high = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), (F.col("label") > 3).alias("converted"))
    table = (
        assets(spark, d)
        .select("doc_id")
        .join(low.withColumnsRenamed({"converted": "converted_256"}), "doc_id", "left")
        .join(high.withColumnsRenamed({"converted": "converted_512"}), "doc_id", "left")
    )
    return pending(table, ["converted_256", "converted_512"])


@query(
    "unprocessed_assets",
    "J4 P10 S9 U5",
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def unprocessed_assets(spark, d):
    return assets(spark, d).select("doc_id", "source").join(load(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    "instance_list",
    "S8 P10 J4",
    """
    SELECT c_custkey, c_name FROM customer
    WHERE CAST(c_custkey AS VARCHAR) IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT')
    """,
)
def instance_list(spark, d):
    wanted = load(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").cast("string").alias("instance")
    )
    return pick_instances(load(spark, d, "customer"), "c_custkey", wanted).select("c_custkey", "c_name")


@query(
    "contiguous_shards",
    "W1",
    """
    SELECT doc_id, pos, CAST(((pos + 1) * 7 - 1) // n AS INTEGER) AS shard FROM (
      SELECT doc_id, row_number() OVER (ORDER BY sha256(text), doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
    """,
)
def contiguous_shard_assignment(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return contiguous_shards(docs, ["sha256", "doc_id"], 7).select("doc_id", "pos", "shard")


@query(
    "shard_sizes",
    "W1",
    """
    SELECT shard, count(*) AS n, min(l_orderkey) AS first_order, max(l_orderkey) AS last_order FROM (
      SELECT l_orderkey, CAST((row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) * 13 - 1) // count(*) OVER () AS INTEGER) AS shard
      FROM lineitem) GROUP BY shard
    """,
)
def shard_sizes(spark, d):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    items = load(spark, d, "lineitem").select(*order)
    return contiguous_shards(items, order, 13).groupBy("shard").agg(
        F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first_order"), F.max("l_orderkey").alias("last_order")
    )


@query("content_hash", "S23", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query(
    "stage_report",
    "S21 A1 A2",
    """
    SELECT 'assets' AS stage, '' AS part, count(*) AS n FROM documents
    UNION ALL SELECT 'labelled', '', count(quality) FROM labels
    UNION ALL SELECT 'good', '', CAST(sum(quality) AS BIGINT) FROM labels
    UNION ALL SELECT 'latents', CAST(label AS VARCHAR), count(*) FROM embeddings GROUP BY label
    UNION ALL SELECT 'by_lang', lang, count(*) FROM documents GROUP BY lang
    """,
)
def stage_report(spark, d):
    one = F.count(F.lit(1)).alias("n")
    docs, labels = load(spark, d, "documents"), load(spark, d, "labels")

    def row(stage, df, agg):
        return df.agg(agg).select(F.lit(stage).alias("stage"), F.lit("").alias("part"), "n")

    # count and flag sum of one stage table share its single scan
    flags = labels.agg(F.count("quality").alias("labelled"), F.sum("quality").alias("good"))
    flags = flags.select(F.expr("stack(2, 'labelled', labelled, 'good', good) as (stage, n)")).select(
        "stage", F.lit("").alias("part"), "n"
    )
    latents = load(spark, d, "embeddings").groupBy(F.col("label").cast("string").alias("part")).agg(one)
    langs = docs.groupBy(F.col("lang").alias("part")).agg(one)
    return (
        row("assets", docs, one)
        .unionByName(flags)
        .unionByName(latents.select(F.lit("latents").alias("stage"), "part", "n"))
        .unionByName(langs.select(F.lit("by_lang").alias("stage"), "part", "n"))
    )


@query(
    "nested_object_stats",
    "A4 P13 M11",
    """
    SELECT o_custkey, CAST(sum(o_orderkey % 11) AS BIGINT) AS num_vertices, CAST(sum(o_orderkey % 5) AS BIGINT) AS num_faces,
           count(*) AS num_objects, CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS BIGINT) AS num_tex
    FROM orders WHERE o_orderkey % 11 > 0 AND o_orderkey % 5 > 0 GROUP BY o_custkey
    """,
)
def nested_object_stats(spark, d):
    """Sums over an asset's objects, empty ones skipped; kept exploded so that a huge asset aggregates in parts."""
    objects = load(spark, d, "orders").select(
        "o_custkey",
        F.expr("if(o_orderkey % 11 > 0, sequence(1, o_orderkey % 11), array())").alias("vertices"),
        F.expr("if(o_orderkey % 5 > 0, sequence(1, o_orderkey % 5), array())").alias("faces"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(1)).alias("tex"),
    )
    filled = objects.filter((F.size("vertices") > 0) & (F.size("faces") > 0))
    return filled.groupBy("o_custkey").agg(
        F.sum(F.size("vertices").cast("bigint")).alias("num_vertices"),
        F.sum(F.size("faces").cast("bigint")).alias("num_faces"),
        F.count(F.lit(1)).alias("num_objects"),
        F.count("tex").alias("num_tex"),
    )


@query(
    "multi_root_union",
    "U1 S7 M4",
    """
    SELECT 'customer' AS dataset, c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal, NULL FROM supplier
    """,
)
def multi_root_union(spark, d):
    customers = load(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    suppliers = load(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    return stack({"customer": customers, "supplier": suppliers})


@query(
    "multi_root_cascade",
    "A3 M4 P9",
    """
    SELECT dataset, count(*) AS total, count(*) FILTER (WHERE balance >= 0) AS solvent,
           count(*) FILTER (WHERE balance >= 0 AND segment = 'BUILDING') AS building
    FROM (SELECT 'customer' AS dataset, c_acctbal AS balance, c_mktsegment AS segment FROM customer
          UNION ALL SELECT 'supplier', s_acctbal, NULL FROM supplier) GROUP BY dataset
    """,
)
def multi_root_cascade(spark, d):
    return cascade_counts(
        multi_root_union(spark, d),
        [("solvent", F.col("balance") >= 0), ("building", F.col("segment") == "BUILDING")],
        by=["dataset"],
    )


@query(
    "dimension_lookup",
    "J5",
    """
    SELECT l_orderkey, l_linenumber, l_extendedprice, p_brand, p_size
    FROM lineitem JOIN part ON l_partkey = p_partkey
    """,
)
def dimension_lookup(spark, d):
    # no hint: the planner broadcasts the dimension while its measured size allows
    return load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "p_brand", "p_size"
    )


@query(
    "range_quarantine",
    "P12 P18 S22",
    """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.08 THEN 'discount out of range'
           WHEN l_quantity > 45 THEN 'quantity out of range' END AS error
    FROM lineitem WHERE l_discount > 0.08 OR l_quantity > 45
    """,
)
def range_quarantine(spark, d):
    """Rows that break a range rule are kept as data with their error."""
    error = F.when(F.col("l_discount") > 0.08, "discount out of range").when(
        F.col("l_quantity") > 45, "quantity out of range"
    )
    items = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", error.alias("error"))
    return items.filter(F.col("error").isNotNull())


@query(
    "path_parts",
    "F36",
    """
    SELECT page_id, split_part(url, '/', -1) AS last_token, regexp_replace(url, '\\?.*$', '') AS stem,
           starts_with(url, 'https://') AS secure, printf('page_%06d.html', page_id) AS file_name
    FROM pages
    """,
)
def path_parts(spark, d):
    url = F.col("url")
    return load(spark, d, "pages").select(
        "page_id",
        F.substring_index(url, "/", -1).alias("last_token"),
        F.regexp_replace(url, r"\?.*$", "").alias("stem"),
        url.startswith("https://").alias("secure"),
        F.format_string("page_%06d.html", "page_id").alias("file_name"),
    )
