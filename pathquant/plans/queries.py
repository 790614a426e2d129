"""Queries over the supplied tables, one or more per operator, and the same in SQL.

Bindings: ``part`` is the graph (node, length); a path is an order and its steps are the order's lines; ``orders``
is the path information (transcript = priority, haplotype = customer); a line also is an alignment row of the
read "order" to the path "supplier", in the cluster supplier % 5; ``events`` are fragment lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathquant.config import INT_MIN, EngineConfig
from pathquant.functions import fragments, scoring
from pathquant.functions.fragments import FragmentDist
from pathquant.operators import clusters, estimators, inference, matching, paths, probs
from pathquant.operators.components import connected_components
from pathquant.plans.store import stored
from pathquant.sources import sinks

DIST = FragmentDist(200.0, 60.0)
READ = ["cluster_id", "read_class_id"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- bindings

def nodes(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_size").alias("length"))


def steps(spark, sf):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_returnflag")
    rows = table(spark, sf, "lineitem").withColumn("ordinal", F.row_number().over(order) - 1)
    return rows.select(F.col("l_orderkey").alias("path_id"), "ordinal", F.col("l_partkey").alias("node_id"), (F.col("l_returnflag") == "R").alias("is_reverse"))


def align_rows(spark, sf):
    quantity, supplier, order = F.col("l_quantity").cast("int"), F.col("l_suppkey"), F.col("l_orderkey")
    noise = F.when(order % 7 == 0, -2302585).otherwise(INT_MIN)
    return table(spark, sf, "lineitem").select(
        (supplier % 5).alias("cluster_id"), (order * 5 + supplier % 5).alias("read_class_id"), (1 + order % 3).cast("long").alias("read_count"), (order % 61).cast("int").alias("min_mapq"),
        noise.cast("int").alias("noise_score"), supplier.alias("path_id"), (quantity - 4 * (F.col("l_linenumber") - 1)).cast("int").alias("score_sum"), quantity.alias("align_length"),
        (100 + F.col("l_partkey") % 200).alias("frag_length"), (100.0 + 7 * (supplier % 13)).cast("double").alias("effective_length"),
    )


def fragment_rows(spark, sf):
    return table(spark, sf, "events").select(F.floor("value").cast("int").alias("frag_length"), (F.col("event_type") == "view").alias("is_simple"), F.lit(60).alias("min_mapq"), F.lit(1).cast("long").alias("read_count"))


def members(spark, sf):
    supplier = F.col("s_suppkey")
    return table(spark, sf, "supplier").select((supplier % 5).alias("cluster_id"), supplier.alias("path_id"), F.col("s_name").alias("name"), F.lit(1000).cast("long").alias("length"), (100.0 + 7 * (supplier % 13)).cast("double").alias("effective_length"), (1 + supplier % 3).cast("int").alias("source_count"), F.floor(supplier / 10).cast("long").alias("group_id"), F.array((supplier % 7).cast("long"), (7 + supplier % 3).cast("long")).alias("source_ids"))


def path_probs_of(spark, sf):
    return probs.read_path_probs(align_rows(spark, sf), DIST)


STEPS = """steps AS (SELECT l_orderkey AS path_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_returnflag) - 1 AS INTEGER) AS ordinal, l_partkey AS node_id, l_returnflag = 'R' AS is_reverse FROM lineitem)"""
ROWS = """rows AS (SELECT l_suppkey % 5 AS cluster_id, l_orderkey * 5 + l_suppkey % 5 AS read_class_id, 1 + l_orderkey % 3 AS read_count, l_orderkey % 61 AS min_mapq, CASE WHEN l_orderkey % 7 = 0 THEN -2302585 ELSE -2147483648 END AS noise_score,
  l_suppkey AS path_id, CAST(l_quantity AS INTEGER) - 4 * (l_linenumber - 1) AS score_sum, CAST(l_quantity AS INTEGER) AS align_length, 100 + l_partkey % 200 AS frag_length, CAST(100 + 7 * (l_suppkey % 13) AS DOUBLE) AS effective_length FROM lineitem)"""
BEST = ROWS + """,
scored AS (SELECT *, score_sum * 1.383325268738::DOUBLE - ln(effective_length) - ln(60::DOUBLE) - 0.5 * ln(2 * pi()) - 0.5 * ((frag_length - 200) / 60::DOUBLE) * ((frag_length - 200) / 60::DOUBLE) AS log_prob FROM rows),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY cluster_id, read_class_id, path_id ORDER BY align_length DESC, log_prob DESC) = 1)"""
SOFT = BEST + """,
shifted AS (SELECT *, exp(log_prob - max(log_prob) OVER (PARTITION BY cluster_id, read_class_id)) AS e FROM best),
soft AS (SELECT *, e / sum(e) OVER (PARTITION BY cluster_id, read_class_id) AS p, CASE WHEN min_mapq <= 0 THEN 1.0::DOUBLE ELSE greatest(1e-4, pow(10.0::DOUBLE, -min_mapq / 10.0)) + (1 - greatest(1e-4, pow(10.0::DOUBLE, -min_mapq / 10.0))) * exp(1e-6::DOUBLE * noise_score) END AS base FROM shifted)"""
PROBS = SOFT + """,
clipped AS (SELECT *, CASE WHEN base >= 1 THEN 1.0::DOUBLE ELSE base + coalesce(sum(p) FILTER (p < 1e-8) OVER (PARTITION BY cluster_id, read_class_id), 0) * (1 - base) END AS noise_prob, p >= 1e-8 AND base < 1 AS live FROM soft),
probs AS (SELECT cluster_id, read_class_id, read_count, noise_prob, CASE WHEN live THEN path_id END AS path_id, CASE WHEN live THEN p * (1 - base) END AS prob FROM clipped
  QUALIFY live OR (NOT bool_or(live) OVER (PARTITION BY cluster_id, read_class_id) AND row_number() OVER (PARTITION BY cluster_id, read_class_id ORDER BY path_id) = 1))"""
MEMBERS = """members AS (SELECT s_suppkey % 5 AS cluster_id, s_suppkey AS path_id, s_name AS name, CAST(100 + 7 * (s_suppkey % 13) AS DOUBLE) AS effective_length, 1 + s_suppkey % 3 AS source_count FROM supplier)"""

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- paths

@query("WITH " + STEPS + " SELECT path_id, CAST(sum(p_size) AS BIGINT) AS length FROM steps JOIN part ON p_partkey = node_id GROUP BY path_id")
def path_length(spark, sf):
    return paths.path_lengths(steps(spark, sf), nodes(spark, sf))


@query("WITH " + STEPS + " SELECT path_id, ordinal, node_id, coalesce(p_size, -1) AS node_length, CAST(coalesce(sum(coalesce(p_size, -1)) OVER (PARTITION BY path_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum_offset FROM steps LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON p_partkey = node_id")
def node_lookup(spark, sf):
    return paths.with_offsets(steps(spark, sf), nodes(spark, sf).where("length > 5")).select("path_id", "ordinal", "node_id", "node_length", "cum_offset")


@query("SELECT o_orderkey AS path_id, CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderkey + 1 AS VARCHAR) ELSE concat(o_custkey, '_', o_orderpriority, '_', o_orderstatus, '_', 0) END AS name FROM orders")
def path_name(spark, sf):
    o = table(spark, sf, "orders")
    known = F.col("o_orderstatus") != "O"
    cols = {"sample": F.col("o_custkey").cast("string"), "contig": F.col("o_orderpriority"), "phase": F.col("o_orderstatus"), "count": F.lit("0")}
    return paths.path_names(o.select(F.col("o_orderkey").alias("path_id"), *[F.when(known, c).alias(k) for k, c in cols.items()]))


@query("WITH " + STEPS + " SELECT path_id, ordinal FROM steps WHERE node_id = 7 AND NOT is_reverse")
def path_find(spark, sf):
    return paths.find(steps(spark, sf), 7, False)


@query("WITH " + STEPS + " SELECT b.path_id, b.ordinal FROM steps a JOIN steps b ON a.path_id = b.path_id AND b.ordinal = a.ordinal + 1 WHERE NOT a.is_reverse AND b.node_id = 9 AND b.is_reverse = false")
def path_extend(spark, sf):
    s = stored(steps(spark, sf), "steps")
    return paths.extend(s.where("NOT is_reverse").select("path_id", "ordinal"), s, 9, False)


@query("WITH " + STEPS + " SELECT DISTINCT path_id FROM steps WHERE node_id = 11")
def path_locate(spark, sf):
    s = steps(spark, sf)
    return paths.locate(paths.find(s, 11, False).union(paths.find(s, 11, True)))


@query("WITH " + STEPS + ", n AS (SELECT node_id, is_reverse, lead(node_id) OVER w AS next_node, lead(is_reverse) OVER w AS next_reverse FROM steps WINDOW w AS (PARTITION BY path_id ORDER BY ordinal)) SELECT DISTINCT * FROM n WHERE next_node IS NOT NULL")
def out_edges(spark, sf):
    return paths.out_edges(steps(spark, sf))


@query("WITH " + STEPS + " SELECT path_id, CAST(max(ordinal) OVER (PARTITION BY path_id) - ordinal AS INTEGER) AS ordinal, node_id, NOT is_reverse AS is_reverse FROM steps")
def reverse_complement_steps(spark, sf):
    return paths.reverse_complement(steps(spark, sf))


# ---- alignments

def _matches(spark, sf):
    line = table(spark, sf, "lineitem")
    mate, at = 1 + F.col("l_linenumber") % 2, F.col("l_partkey") % 500
    return line.select(
        F.col("l_orderkey").alias("read_id"), mate.cast("int").alias("mate"), F.when(mate == 1, "+").otherwise("-").alias("strand"), (F.col("l_suppkey") % 3).alias("path_id"),
        F.lit(150).alias("length"), F.lit(160).alias("optimal"), F.lit(60).alias("mapq"), F.lit(False).alias("multimap"), F.floor(at / 50).cast("int").alias("first_step"), F.floor((at + F.col("l_quantity").cast("int")) / 50).cast("int").alias("last_step"),
        at.cast("long").alias("start_at"), (at + F.col("l_quantity").cast("int")).cast("long").alias("end_at"), (F.col("l_suppkey") % 4).cast("int").alias("cut_left"), (F.col("l_suppkey") % 2).cast("int").alias("cut_right"),
        (F.col("l_quantity").cast("int") - 4 * (F.col("l_linenumber") - 1)).cast("int").alias("adjusted"), (F.col("l_suppkey") % 2 == 1).alias("partial"),
    )


MATCHES = """m AS (SELECT l_orderkey AS read_id, CAST(1 + l_linenumber % 2 AS INTEGER) AS mate, l_suppkey % 3 AS path_id, (l_partkey % 500) // 50 AS first_step, (l_partkey % 500 + CAST(l_quantity AS INTEGER)) // 50 AS last_step, l_partkey % 500 AS start_at, l_partkey % 500 + CAST(l_quantity AS INTEGER) AS end_at,
  l_suppkey % 4 AS cut_left, l_suppkey % 2 AS cut_right, CAST(l_quantity AS INTEGER) - 4 * (l_linenumber - 1) AS adjusted, l_suppkey % 2 = 1 AS partial FROM lineitem)"""


@query("WITH " + MATCHES + """, p AS (SELECT DISTINCT a.read_id, a.path_id, a.adjusted + b.adjusted AS score_sum, 300 - a.cut_left - a.cut_right - b.cut_left - b.cut_right AS align_length, 300 + greatest(a.start_at, b.start_at) - least(a.end_at, b.end_at) - a.cut_right - b.cut_left AS frag_length,
  a.partial OR b.partial AS partial FROM m a JOIN m b ON a.read_id = b.read_id AND a.path_id = b.path_id AND a.mate = 1 AND b.mate = 2 AND b.first_step >= a.first_step AND b.last_step >= a.last_step AND (b.first_step > a.first_step OR b.start_at - b.cut_left >= a.start_at - a.cut_left)
  AND (b.last_step > a.last_step OR b.end_at + b.cut_right >= a.end_at + a.cut_right))
SELECT read_id, path_id, CAST(score_sum AS BIGINT) AS score_sum, CAST(align_length AS BIGINT) AS align_length, CAST(frag_length AS BIGINT) AS frag_length, partial FROM p WHERE frag_length <= 600""")
def paired_interval_join(spark, sf):
    out = matching.paired_matches(_matches(spark, sf), "fr", 600)
    return out.select("read_id", "path_id", *[F.col(c).cast("long").alias(c) for c in ("score_sum", "align_length", "frag_length")], "partial").distinct()


@query("WITH " + MATCHES + " SELECT read_id, mate, path_id, CAST(adjusted AS INTEGER) AS adjusted FROM m QUALIFY max(adjusted) OVER (PARTITION BY read_id, mate) - adjusted <= 20")
def score_diff_filter(spark, sf):
    return matching.score_filter(_matches(spark, sf), 20).select("read_id", "mate", "path_id", "adjusted")


@query("SELECT l_orderkey AS read_id, 1 AS mate, first_node FROM (SELECT l_orderkey, min(l_partkey) AS first_node FROM lineitem GROUP BY 1) WHERE first_node IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def start_in_graph(spark, sf):
    first = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("read_id")).agg(F.min("l_partkey").alias("first_node"))
    path = F.struct(F.array(*[F.struct(F.struct(F.col("first_node").alias("node_id")).alias("position")) for _ in range(2)]).alias("mapping"))
    reads = first.select("read_id", F.lit(1).alias("mate"), "first_node", path.alias("path"))
    return matching.start_in_graph(reads, nodes(spark, sf).where("length > 10")).select("read_id", "mate", "first_node")


def _ends(spark, sf):
    line = table(spark, sf, "lineitem")
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    a = F.struct(q.alias("score"), (q + 20).alias("length"), (n - 1).alias("left_clip"), (F.col("l_suppkey") % 3).cast("int").alias("right_clip"), (n % 2).alias("start_penalty"), (n % 2).alias("start_offset"), F.lit(0).alias("end_penalty"), (n % 3).alias("end_offset"))
    b = F.struct((q - n).alias("score"), (q + 10).alias("length"), F.lit(0).alias("left_clip"), n.alias("right_clip"), F.lit(0).alias("start_penalty"), F.lit(0).alias("start_offset"), F.lit(1).alias("end_penalty"), F.lit(1).alias("end_offset"))
    return line.select("l_orderkey", "l_linenumber", "l_partkey", F.array(a, b).alias("ends"), (F.col("l_partkey") % 50 - 10).cast("int").alias("insert"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) AS q, l_linenumber AS n, l_suppkey % 3 AS rc, l_partkey % 50 - 10 AS ins FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(2 * q + 30 + ins - rc - n % 3 AS BIGINT) AS fragment_length, CAST(q - n % 2 + q - n - 1 AS BIGINT) AS score_sum, CAST(q + 20 - (n - 1) - n % 2 - rc - n % 3 + q + 10 - n - 1 AS BIGINT) AS align_length,
  round(greatest(0, least(1, (q - n % 2) / CAST(q + 30 AS DOUBLE), (q - n - 1) / CAST(q + 20 AS DOUBLE))), 6) AS fraction, round(greatest((n - 1 + rc) / CAST(q + 20 AS DOUBLE), n / CAST(q + 10 AS DOUBLE)), 6) AS clipped, true AS partial FROM s""")
def alignment_statistics(spark, sf):
    e = F.col("ends")
    optima = F.transform(e, lambda x: scoring.optimal_score(x["length"]))
    return _ends(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", scoring.fragment_length(e, F.col("insert")).cast("long").alias("fragment_length"), scoring.score_sum(e).cast("long").alias("score_sum"), scoring.align_length(e).cast("long").alias("align_length"), F.round(scoring.optimal_fraction(e, optima), 6).alias("fraction"), F.round(scoring.soft_clip_fraction(e), 6).alias("clipped"), scoring.is_partial(e).alias("partial"))


@query("SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber = 1 THEN CAST(l_quantity AS INTEGER) ELSE 0 END AS left_clip, CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END AS right_clip, CAST(l_quantity AS INTEGER) + l_linenumber AS to_length FROM lineitem")
def soft_clip(spark, sf):
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    edits = F.array(F.struct(F.when(n > 1, q).alias("from_length"), q.alias("to_length")), F.struct(F.when(F.col("l_returnflag") != "R", n).alias("from_length"), n.alias("to_length")))
    mapping = F.array(F.struct(edits.alias("edit")))
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", mapping.alias("m"))
    return df.select("l_orderkey", "l_partkey", scoring.left_soft_clip(F.col("m")).alias("left_clip"), scoring.right_soft_clip(F.col("m")).alias("right_clip"), scoring.edit_length(F.get("m", F.lit(0))["edit"], "to_length").alias("to_length"))


@query("WITH r AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem GROUP BY 1) SELECT array_to_string(s, ',') AS paths, count(*) AS read_count FROM r GROUP BY 1")
def read_class_count(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.col("l_suppkey").alias("path_id"), F.lit(1).alias("score_sum"), F.lit(1).alias("align_length"), F.lit(1).cast("long").alias("frag_length"), F.lit(60).alias("min_mapq"), F.lit(INT_MIN).alias("noise_score"), F.lit(True).alias("is_simple"))
    return matching.read_classes(rows).select(F.concat_ws(",", F.transform("rows", lambda r: r["path_id"].cast("string"))).alias("paths"), "read_count")


@query("SELECT count(*) AS unaligned FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def unaligned_count(spark, sf):
    reads = table(spark, sf, "orders").select(F.col("o_orderkey").alias("read_id"))
    return matching.unaligned(reads, table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("read_id")))


# ---- fragments

@query("SELECT CAST(floor(value) AS INTEGER) AS frag_length, count(*) AS n FROM events WHERE event_type = 'view' AND floor(value) <= 100000 GROUP BY 1")
def fragment_histogram(spark, sf):
    return fragments.histogram(fragment_rows(spark, sf), 100_000)


@query("SELECT CAST(count(*) AS DOUBLE) AS n, round(avg(floor(value)), 6) AS mean, round(stddev_samp(floor(value)), 6) AS sd FROM events WHERE event_type = 'view' AND floor(value) <= 100000")
def normal_fit(spark, sf):
    return fragments.moments(fragments.histogram(fragment_rows(spark, sf), 100_000)).select("n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("WITH x AS (SELECT floor(value) AS v FROM events WHERE event_type = 'view' AND floor(value) <= 100000), m AS (SELECT avg(v) AS a, sqrt(avg(v * v) - avg(v) * avg(v)) AS s FROM x) SELECT round(avg(pow((v - a) / s, 3)), 4) AS skewness FROM x, m")
def fragment_moments(spark, sf):
    return fragments.moments(fragments.histogram(fragment_rows(spark, sf), 100_000)).select(F.round("skewness", 4).alias("skewness"))


@query()
def skew_normal_fit(spark, sf):
    import numpy as np

    hist = fragments.histogram(fragment_rows(spark, sf), 100_000).collect()  # a row per length
    d = fragments.fit_skew_normal(np.array([r["frag_length"] for r in hist]), np.array([r["n"] for r in hist]))
    return spark.createDataFrame([(d.loc, d.scale, d.shape)], "loc double, scale double, shape double")


# ---- probabilities

@query("WITH " + BEST + " SELECT cluster_id, read_class_id, path_id, round(log_prob, 6) AS log_prob FROM best")
def best_per_read_path(spark, sf):
    return probs.log_probs(align_rows(spark, sf), DIST, False).select(*READ, "path_id", F.round("log_prob", 6).alias("log_prob"))


@query("WITH " + SOFT + " SELECT cluster_id, read_class_id, path_id, round(p, 6) AS prob FROM soft")
def path_probs(spark, sf):
    return probs.normalise(probs.log_probs(align_rows(spark, sf), DIST, False)).select(*READ, "path_id", F.round("prob", 6).alias("prob"))


@query("WITH " + SOFT + " SELECT DISTINCT cluster_id, read_class_id, round(base, 6) AS noise_prob FROM soft")
def noise_prob(spark, sf):
    rows = align_rows(spark, sf)
    return rows.select(*READ, F.round(probs.base_noise(F.col("min_mapq"), F.col("noise_score"), 1e-4, 1e-8), 6).alias("noise_prob")).distinct()


@query("WITH " + PROBS + " SELECT cluster_id, read_class_id, path_id, round(prob, 6) AS prob, round(noise_prob, 6) AS noise_prob FROM probs")
def low_prob_clip(spark, sf):
    return path_probs_of(spark, sf).select(*READ, "path_id", F.round("prob", 6).alias("prob"), F.round("noise_prob", 6).alias("noise_prob"))


@query("WITH " + BEST + """, w AS (SELECT cluster_id, read_class_id, path_id // 10 AS transcript, log_prob + ln(CAST(1 + path_id % 3 AS DOUBLE)) AS l FROM best), t AS (SELECT *, max(l) OVER (PARTITION BY cluster_id, read_class_id) AS top FROM w),
g AS (SELECT cluster_id, read_class_id, transcript, sum(exp(l - top)) AS s FROM t GROUP BY ALL) SELECT cluster_id, read_class_id, transcript, round(s / sum(s) OVER (PARTITION BY cluster_id, read_class_id), 6) AS prob FROM g""")
def collapsed_probs(spark, sf):
    rows = align_rows(spark, sf).withColumn("transcript", F.floor(F.col("path_id") / 10)).withColumn("source_count", 1 + F.col("path_id") % 3)
    out = probs.normalise(probs.collapse(probs.log_probs(rows, DIST, False)))
    return out.select(*READ, F.col("path_id").alias("transcript"), F.round("prob", 6).alias("prob"))


@query("""WITH p AS (SELECT l_suppkey % 5 AS cluster_id, l_orderkey * 5 + l_suppkey % 5 AS read_class_id, l_suppkey AS path_id FROM lineitem GROUP BY ALL), s AS (SELECT cluster_id, read_class_id, list_sort(list(path_id)) AS shape FROM p GROUP BY 1, 2)
SELECT cluster_id, min(read_class_id) AS read_class_id, CAST(sum(1 + (read_class_id // 5) % 3) AS BIGINT) AS read_count FROM s GROUP BY cluster_id, shape""")
def merge_identical(spark, sf):
    rows = align_rows(spark, sf).select(*READ, "read_count", F.lit(0.1).alias("noise_prob"), "path_id").distinct()
    rows = rows.withColumn("prob", 0.9 / F.count("*").over(Window.partitionBy(*READ)))
    return probs.merge_identical(rows).select(*READ, "read_count").distinct()


@query("WITH " + ROWS + ", q AS (SELECT cluster_id, read_class_id, path_id, CAST(sum(align_length) AS DOUBLE) AS x FROM rows GROUP BY ALL) SELECT cluster_id, read_class_id, path_id, round(x / sum(x) OVER (PARTITION BY cluster_id, read_class_id) * 0.9, 6) AS prob FROM q")
def add_noise_normalize(spark, sf):
    rows = align_rows(spark, sf).groupBy(*READ, "path_id").agg(F.sum("align_length").cast("double").alias("prob")).withColumn("noise_prob", F.lit(0.1))
    return probs.add_noise_and_normalise(rows).select(*READ, "path_id", F.round("prob", 6).alias("prob"))


@query("WITH " + PROBS + " SELECT cluster_id, read_class_id, path_id // 10 AS group_id, round(sum(prob), 6) AS prob FROM probs WHERE path_id IS NOT NULL GROUP BY ALL")
def group_matrix(spark, sf):
    groups = members(spark, sf).select("cluster_id", "path_id", "group_id")
    return probs.grouped(path_probs_of(spark, sf), groups).select(*READ, "group_id", F.round("prob", 6).alias("prob"))


# ---- clusters

COMPONENTS = """WITH RECURSIVE e AS (SELECT DISTINCT u, v FROM (SELECT {a} AS u, {b} AS v FROM {t} UNION ALL SELECT {b}, {a} FROM {t})),
cc(id, comp) USING KEY (id) AS (SELECT DISTINCT u AS id, u AS comp FROM e UNION SELECT e.v, min(cc.comp) FROM cc JOIN e ON e.u = cc.id JOIN recurring.cc AS r ON r.id = e.v WHERE cc.comp < r.comp GROUP BY e.v)
"""


@query(COMPONENTS.format(a="l_orderkey", b="(-1 - l_partkey)", t="lineitem") + "SELECT id AS vertex, comp AS component FROM cc")
def components(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("a"), (-1 - F.col("l_partkey")).alias("b"))
    return connected_components(edges, "a", "b")


@query(COMPONENTS.format(a="o_orderkey", b="(1000000000 + o_custkey)", t="orders") + "SELECT o_orderkey AS path_id, dense_rank() OVER (ORDER BY comp) - 1 AS cluster_id FROM orders JOIN cc ON id = o_orderkey")
def node_clusters(spark, sf):
    o = table(spark, sf, "orders")
    none = spark.createDataFrame([], "rows array<struct<path_id:long>>")
    visits = o.select(F.col("o_orderkey").alias("path_id"), F.col("o_custkey").alias("node_id"), F.lit(False).alias("is_reverse"))
    return clusters.path_clusters(o.select(F.col("o_orderkey").alias("path_id")), none, visits).select("path_id", "cluster_id")


@query("SELECT cluster_id, CAST(row_number() OVER (ORDER BY n DESC, cluster_id DESC) AS INTEGER) AS rank FROM (SELECT l_suppkey AS cluster_id, count(*) AS n FROM lineitem GROUP BY 1)")
def cluster_rank(spark, sf):
    return clusters.cluster_ranks(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cluster_id")))


@query("SELECT s_suppkey % 5 AS cluster_id, s_suppkey AS path_id, CAST(row_number() OVER (PARTITION BY s_suppkey % 5 ORDER BY s_suppkey) - 1 AS INTEGER) AS path_idx FROM supplier")
def local_index(spark, sf):
    return clusters.local_index(members(spark, sf).select("cluster_id", "path_id"))


# ---- inference

POSTERIOR = PROBS + ", " + MEMBERS + """,
normal AS (SELECT *, coalesce(prob / nullif(sum(prob) OVER (PARTITION BY cluster_id, read_class_id), 0) * (1 - noise_prob), 0) AS pn FROM probs),
reads AS (SELECT DISTINCT cluster_id, read_class_id, read_count, noise_prob FROM normal),
freq AS (SELECT *, ln(source_count / CAST(sum(source_count) OVER (PARTITION BY cluster_id) AS DOUBLE)) AS f FROM members),
pairs AS (SELECT a.cluster_id, a.path_id AS i, b.path_id AS j, a.f + b.f + CASE WHEN a.path_id = b.path_id THEN 0 ELSE ln(2.0::DOUBLE) END AS prior FROM freq a JOIN freq b ON a.cluster_id = b.cluster_id AND a.path_id <= b.path_id),
base AS (SELECT cluster_id, sum(read_count * ln(noise_prob)) AS ll FROM reads GROUP BY 1),
hit AS (SELECT p.cluster_id, p.i, p.j, r.read_class_id, any_value(r.read_count) AS c, any_value(r.noise_prob) AS n, sum(CASE WHEN r.path_id = p.i AND r.path_id = p.j THEN r.pn WHEN r.path_id IN (p.i, p.j) THEN r.pn / 2 ELSE 0 END) AS s
  FROM pairs p JOIN normal r ON r.cluster_id = p.cluster_id AND r.path_id IN (p.i, p.j) GROUP BY 1, 2, 3, 4),
ll AS (SELECT p.cluster_id, p.i, p.j, any_value(p.prior) + any_value(b.ll) + coalesce(sum(h.c * (ln(h.n + h.s) - ln(h.n))), 0) AS l FROM pairs p JOIN base b USING (cluster_id) LEFT JOIN hit h USING (cluster_id, i, j) GROUP BY 1, 2, 3),
top AS (SELECT *, max(l) OVER (PARTITION BY cluster_id) AS m FROM ll)"""


@query("WITH " + POSTERIOR + " SELECT cluster_id, i AS first, j AS second, round(exp(l - m) / sum(exp(l - m)) OVER (PARTITION BY cluster_id), 5) AS posterior FROM top WHERE l >= m + ln(1e-8)")
def bounded_posterior(spark, sf):
    own = members(spark, sf).select("cluster_id", "path_id", "source_count", "group_id", "source_ids")
    out = inference.infer(path_probs_of(spark, sf), own, EngineConfig(model="haplotypes")).where("kind = 'group'")
    return out.select("cluster_id", F.get("path_ids", F.lit(0)).alias("first"), F.get("path_ids", F.lit(1)).alias("second"), F.round("posterior", 5).alias("posterior"))


def _em_sql(rounds: int) -> str:
    out = "WITH " + PROBS + """, cells AS (SELECT cluster_id, read_class_id, read_count, path_id, prob FROM probs WHERE path_id IS NOT NULL UNION ALL SELECT DISTINCT cluster_id, read_class_id, read_count, -1, noise_prob FROM probs),
total AS (SELECT cluster_id, CAST(sum(read_count) AS DOUBLE) AS t FROM (SELECT DISTINCT cluster_id, read_class_id, read_count FROM cells) GROUP BY 1), a0 AS (SELECT cluster_id, path_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY cluster_id) AS share FROM (SELECT DISTINCT cluster_id, path_id FROM cells))"""
    for i in range(rounds):
        out += f""", j{i} AS (SELECT c.*, prob * share AS joint FROM cells c JOIN a{i} USING (cluster_id, path_id)), n{i} AS (SELECT *, coalesce(joint / nullif(sum(joint) OVER (PARTITION BY cluster_id, read_class_id), 0), 0) * read_count AS mass FROM j{i}),
a{i + 1} AS (SELECT cluster_id, path_id, sum(mass) / any_value(t) AS share FROM n{i} JOIN total USING (cluster_id) GROUP BY 1, 2)"""
    return out + f" SELECT cluster_id, CASE WHEN path_id >= 0 THEN path_id END AS path_id, round(share, 6) AS share FROM a{rounds}"


@query(_em_sql(3))
def em_three_rounds(spark, sf):
    """The form of expectation-maximisation for clusters of any size."""
    return estimators.em_frames(stored(path_probs_of(spark, sf), "em-probs"), 3).select("cluster_id", "path_id", F.round("share", 6).alias("share"))


def _combinations(spark, sf):
    """Made-up combination posteriors: a customer's pair of priorities, weighted by its orders."""
    o = table(spark, sf, "orders")
    return o.groupBy((F.col("o_custkey") % 50).alias("cluster_id"), F.col("o_custkey").alias("g")).agg(F.min(F.length("o_orderpriority")).cast("long").alias("i"), F.max(F.length("o_orderpriority")).cast("long").alias("j"), F.count("*").alias("w"))


COMBOS = "g AS (SELECT o_custkey % 50 AS cluster_id, o_custkey AS g, min(length(o_orderpriority)) AS i, max(length(o_orderpriority)) AS j, count(*) AS w FROM orders GROUP BY 1, 2)"


def _result(spark, sf):
    g = _combinations(spark, sf)
    return g.select("cluster_id", F.lit("group").alias("kind"), F.array("i", "j").alias("path_ids"), (F.col("w") / 100.0).alias("posterior"), F.array(F.col("w").cast("double"), (F.col("w") * 2).cast("double")).alias("counts"))


@query("WITH " + COMBOS + ", e AS (SELECT cluster_id, i AS path_id, w / 100.0::DOUBLE AS post, CAST(w AS DOUBLE) AS c FROM g UNION ALL SELECT cluster_id, j, CASE WHEN i = j THEN 0 ELSE w / 100.0::DOUBLE END, w * 2.0 FROM g) SELECT cluster_id, path_id, round(sum(post), 6) AS posterior, round(sum(c), 6) AS read_count FROM e GROUP BY 1, 2")
def hap_marginals(spark, sf):
    out = inference.path_abundances(_result(spark, sf))
    return out.select("cluster_id", "path_id", F.round("posterior", 6).alias("posterior"), F.round("read_count", 6).alias("read_count"))


@query("WITH " + COMBOS + """, t AS (SELECT g, cluster_id, i, j, w FROM g WHERE w / 100.0 >= 0.05) SELECT concat('p', i) AS "Name_1", concat('p', j) AS "Name_2", cluster_id + 1 AS "ClusterID", CAST(w / 100.0 AS DOUBLE) AS "HaplotypingProbability", CAST(w AS DOUBLE) AS "ReadCount_1", round(w / CAST(i AS DOUBLE) / 1000 * 1e6, 4) AS "TPM_1", CAST(w * 2 AS DOUBLE) AS "ReadCount_2", round(w * 2 / CAST(j AS DOUBLE) / 1000 * 1e6, 4) AS "TPM_2" FROM t
UNION ALL SELECT 'Unknown', 'Unknown', 0, 0.0, 5.0, 0.0, 5.0, 0.0""")
def joint_output(spark, sf):
    names = _combinations(spark, sf).select("cluster_id", F.explode(F.array("i", "j")).alias("path_id")).distinct().select("cluster_id", "path_id", F.concat(F.lit("p"), F.col("path_id").cast("string")).alias("name"), F.col("path_id").cast("double").alias("effective_length"))
    out = sinks.joint_table(_result(spark, sf), names, 2, 0.05, 1000.0, 10.0)
    return out.withColumns({"TPM_1": F.round("TPM_1", 4), "TPM_2": F.round("TPM_2", 4)})


@query("""WITH c AS (SELECT l_suppkey AS path_id, CAST(sum(l_quantity) AS DOUBLE) AS n, CAST(100 + 7 * (l_suppkey % 13) AS DOUBLE) AS e FROM lineitem GROUP BY 1) SELECT path_id, round(n / e / (SELECT sum(n / e) FROM c) * 1e6, 4) AS tpm FROM c""")
def tpm(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("path_id")).agg(F.sum("l_quantity").cast("double").alias("read_count")).withColumn("effective_length", (100.0 + 7 * (F.col("path_id") % 13)).cast("double"))
    return c.select("path_id", F.round(inference.tpm(F.col("read_count"), F.col("effective_length"), inference.tpm_denominator(c)), 4).alias("tpm"))


@query("WITH " + PROBS + " SELECT round(sum(noise_prob * read_count), 4) AS unknown FROM (SELECT DISTINCT cluster_id, read_class_id, noise_prob, read_count FROM probs)")
def unknown_row(spark, sf):
    reads = path_probs_of(spark, sf).select(*READ, "noise_prob", "read_count").distinct()
    rows = reads.groupBy("cluster_id").agg(F.sum(F.col("noise_prob") * F.col("read_count")).alias("noise_count")).withColumn("kind", F.lit("cluster"))
    return spark.createDataFrame([(round(inference.unknown_count(rows), 4),)], "unknown double")


def _model(spark, sf, **settings):
    own = members(spark, sf).select("cluster_id", "path_id", "source_count", "group_id", "source_ids")
    return inference.infer(path_probs_of(spark, sf), own, EngineConfig(**settings))


@query()
def nested_independent(spark, sf):
    return inference.path_abundances(_model(spark, sf, model="haplotype-transcripts", path_info=True, ind_hap_inference=True))


def genes(spark, sf):
    """A pangenome of genes: an order is a gene with a node per line and two haplotype-specific transcripts, of which
    the second skips the second node; every line but the last is a read pair over its node and the next.

    Returns (alignments, nodes, steps, paths, path information).
    """
    line = steps(spark, sf).join(nodes(spark, sf), "node_id")
    last = F.max("ordinal").over(Window.partitionBy("path_id"))
    line = line.select(F.col("path_id").alias("gene"), "ordinal", last.alias("last"), (F.col("path_id") * 64 + F.col("ordinal")).alias("node_id"), (F.lit(60) + F.col("length") % 20).cast("int").alias("length"), (F.col("node_id") % 20).alias("jitter"))
    line = stored(line, "genes")
    walks = line.select((F.col("gene") * 2).alias("path_id"), "ordinal", "node_id", F.lit(False).alias("is_reverse"))
    kept = line.where((F.col("ordinal") != 1) | (F.col("last") < 2))
    second = kept.select((F.col("gene") * 2 + 1).alias("path_id"), (F.row_number().over(Window.partitionBy("gene").orderBy("ordinal")) - 1).alias("ordinal"), "node_id", F.lit(False).alias("is_reverse"))
    all_steps = stored(walks.unionByName(second), "genes-steps")
    names = all_steps.select("path_id").distinct().withColumn("name", F.concat(F.lit("t"), F.col("path_id").cast("string")))
    info = names.select("name", F.floor(F.col("path_id") / 2).cast("string").alias("transcript"), F.floor(F.col("path_id") / 2).alias("group_id"), F.array(F.col("path_id") % 2, 2 + F.col("path_id") % 2).alias("source_ids"), F.lit(2).alias("source_count"))

    def mapping(node, offset, back):
        return F.struct(F.array(F.struct(F.struct(node.cast("long").alias("node_id"), offset.cast("long").alias("offset"), F.lit(back).alias("is_reverse")).alias("position"), F.array(F.struct(F.lit(30).alias("from_length"), F.lit(30).alias("to_length"))).alias("edit"))).alias("mapping"))

    pair = line.where("ordinal < last").withColumn("read_id", F.col("node_id"))
    common = [F.lit("A" * 30).alias("sequence"), F.lit(40).alias("score"), F.lit(60).alias("mapping_quality"), F.lit(None).cast("binary").alias("quality"), F.lit(None).cast("map<string,string>").alias("annotation")]
    reads = pair.select("read_id", F.lit(1).alias("mate"), *common, mapping(F.col("node_id"), F.col("jitter"), False).alias("path"))
    reads = reads.unionByName(pair.select("read_id", F.lit(2).alias("mate"), *common, mapping(F.col("node_id") + 1, F.col("jitter") / 2, True).alias("path")))
    return reads, line.select("node_id", "length"), all_steps, names, info


@query()
def haplotype_transcripts(spark, sf):
    """The whole nested model, from read pairs to abundances."""
    from pathquant.plans import pipeline

    reads, graph, walks, names, info = genes(spark, sf)
    config = EngineConfig(model="haplotype-transcripts", path_info=True, library="fr", score_not_qual=True, single_path=True, frag_mean=110.0, frag_sd=30.0)
    return pipeline.run(reads, graph, walks, names, config, info).tables["abundances"]


@query()
def gibbs_counts(spark, sf):
    out = stored(_model(spark, sf, model="transcripts", num_gibbs_samples=3), "gibbs")
    return sinks.gibbs_table(out, members(spark, sf), 3, inference.unknown_samples(out, 3))


@query()
def gibbs_haplotypes(spark, sf):
    """The haplotype sampler over all read classes of the table, with their counts and noise; reads that are all noise too."""
    out = _model(spark, sf, model="haplotypes", use_hap_gibbs=True).where("kind = 'group'")
    return out.select("cluster_id", F.concat_ws(",", F.col("path_ids").cast("array<string>")).alias("paths"), F.round("posterior", 6).alias("posterior"))

