"""More queries over the supplied tables, each through the operator it is named for, and the same in SQL.

Bindings as in ``queries``; reads are made of two neighbouring lines of an order, walked as the order's path walks them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from pathquant.config import INT_MIN, EngineConfig
from pathquant.functions import fragments, mathfn, scoring
from pathquant.functions.fragments import FragmentDist
from pathquant.operators import clusters, estimators, inference, matching, paths, probs
from pathquant.operators.components import connected_components, extended_components
from pathquant.plans.queries import COMBOS, COMPONENTS, MEMBERS, ORACLE, POSTERIOR, PROBS, QUERIES, ROWS, STEPS, _result, align_rows, members, nodes, path_probs_of, query, steps, table  # noqa: F401
from pathquant.plans.store import shared_path, stored
from pathquant.sources import blockgzip, readers, sinks

# ---- alignments and walks

ERROR = "pow(10.0::DOUBLE, -q / 10.0)"
QUALITY = f"""CASE WHEN {ERROR} > 0.75 THEN 0 ELSE CAST(round(ln(((1 - {ERROR}) * exp(1.383325268738::DOUBLE) / 16 + {ERROR} * exp(-4 * 1.383325268738::DOUBLE) / 16) / (0.25 * ((1 - {ERROR}) * 0.25 + {ERROR} / 3 * 0.75))) / 1.383325268738) AS INTEGER) END"""
FULL = "(exp(5 * 1.383325268738::DOUBLE) / (1 + exp(5 * 1.383325268738::DOUBLE)))"
BONUS = f"""CASE WHEN q < 3 THEN 0 ELSE CAST(round(ln(((1 - 4 / 3.0::DOUBLE * {ERROR}) * {FULL} + 4 / 3.0::DOUBLE * {ERROR} * (1 - {FULL})) / (1 - {FULL})) / 1.383325268738) AS INTEGER) END"""


def _mapping(node, offset, back, *edits):
    """edits: pairs of bases of the node and of the read."""
    edit = F.array(*[F.struct(a.cast("int").alias("from_length"), b.cast("int").alias("to_length")) for a, b in edits])
    return F.struct(F.struct(node.cast("long").alias("node_id"), offset.cast("long").alias("offset"), back.alias("is_reverse")).alias("position"), edit.alias("edit"))


def _path(*mappings):
    return F.struct(F.array(*mappings).alias("mapping"))


WALK = ["nodes", "read_pos", "matched"]


@query(f"""WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER) AS score, l_linenumber AS clip, 20 + CAST(l_quantity AS INTEGER) AS len, 2 + l_partkey % 40 AS q, 2 * l_partkey + (l_returnflag = 'R')::INTEGER AS n, l_partkey % 5 AS off, least(l_partkey % 61, l_suppkey % 50) AS mapq FROM lineitem),
s AS (SELECT *, {QUALITY} AS ms, {BONUS} AS bonus FROM l)
SELECT l_orderkey AS read_id, '+' AS strand, concat(n, ',', 2 * l_suppkey) AS nodes, concat(0, ',', clip + 10) AS read_pos, concat(0, ',', ms * (clip + 10)) AS matched, len AS length, score, CAST(len * ms + 2 * bonus AS INTEGER) AS optimal, clip AS left_clip, 0 AS right_clip, CAST(ms * clip AS INTEGER) AS matched_left, CAST(ms * len AS INTEGER) AS matched_right, CAST(off AS INTEGER) AS start_off, CAST(len - 10 - clip AS INTEGER) AS end_off, CAST(mapq AS INTEGER) AS mapq FROM s
UNION ALL SELECT l_orderkey, '-', concat(2 * l_suppkey + 1, ',', n + 1 - 2 * (n % 2)), concat(0, ',', len - 10 - clip), concat(0, ',', ms * (len - 10 - clip)), len, score, CAST(len * ms + 2 * bonus AS INTEGER), 0, clip, 0, CAST(ms * (len - clip) AS INTEGER), CAST(len - 10 - clip AS INTEGER), CAST(off AS INTEGER), CAST(mapq AS INTEGER) FROM s""")
def walk_facts(spark, sf):
    """Walks of single-path alignments, with clips, base qualities and allelic mapping qualities."""
    line = table(spark, sf, "lineitem")
    n, length = F.col("l_linenumber"), 20 + F.col("l_quantity").cast("int")
    first = _mapping(F.col("l_partkey"), F.col("l_partkey") % 5, F.col("l_returnflag") == "R", (F.lit(0), n), (F.lit(10), F.lit(10)))
    second = _mapping(F.col("l_suppkey"), F.lit(0), F.lit(False), (length - 10 - n, length - 10 - n))
    reads = line.select(
        F.col("l_orderkey").alias("read_id"), F.lit(1).alias("mate"), F.expr("repeat('A', 20 + cast(l_quantity as int))").alias("sequence"), F.expr("cast(repeat(char(2 + l_partkey % 40), 20 + cast(l_quantity as int)) as binary)").alias("quality"),
        (F.col("l_partkey") % 61).cast("int").alias("mapping_quality"), F.create_map(F.lit("allelic_mapq"), (F.col("l_suppkey") % 50).cast("string")).alias("annotation"), F.col("l_quantity").cast("int").alias("score"), _path(first, second).alias("path"),
    )
    out = matching.walks(reads, EngineConfig(use_allelic_mapq=True, frag_mean=1.0, frag_sd=1.0))
    joined = [F.concat_ws(",", F.col(c).cast("array<string>")).alias(c) for c in WALK]
    return out.select("read_id", "strand", *joined, "length", "score", "optimal", "left_clip", "right_clip", "matched_left", "matched_right", "start_off", "end_off", "mapq")


def _placed(spark, sf):
    return stored(paths.with_offsets(steps(spark, sf), nodes(spark, sf)).withColumn("node", F.col("node_id") * 2 + F.col("is_reverse").cast("int")), "placed")


def _pairs_of_steps(placed):
    """(read_id, n1, r1, n2, r2) of neighbouring steps."""
    after = placed.select("path_id", (F.col("ordinal") - 1).alias("ordinal"), F.col("node_id").alias("n2"), F.col("is_reverse").alias("r2"))
    return placed.join(after, ["path_id", "ordinal"]).select((F.col("path_id") * 16 + F.col("ordinal")).alias("read_id"), F.col("node_id").alias("n1"), F.col("is_reverse").alias("r1"), "n2", "r2")


def _reads(pairs, **columns):
    common = {"mate": F.lit(1), "sequence": F.expr("repeat('A', 13)"), "quality": F.lit(None).cast("binary"), "mapping_quality": F.lit(30), "annotation": F.lit(None).cast("map<string,string>")}
    return pairs.select("read_id", *[c.alias(k) for k, c in (common | columns).items()])


ONE = EngineConfig(score_not_qual=True, single_end=True, frag_mean=1.0, frag_sd=1.0, filt_best_score=0.0)
NODES = STEPS + """, p AS (SELECT path_id, ordinal, 2 * node_id + is_reverse::INTEGER AS node FROM steps),
two AS (SELECT a.path_id, a.ordinal, a.node AS n1, b.node AS n2 FROM p a JOIN p b ON b.path_id = a.path_id AND b.ordinal = a.ordinal + 1),
r AS (SELECT path_id * 16 + ordinal AS read_id, n1, n2, n1 + 1 - 2 * (n1 % 2) AS f1, n2 + 1 - 2 * (n2 % 2) AS f2 FROM two)"""


@query("WITH " + NODES + """, m AS (SELECT r.read_id, t.path_id FROM r JOIN two t ON t.n1 = r.n1 AND t.n2 = r.n2 UNION SELECT r.read_id, t.path_id FROM r JOIN two t ON t.n1 = r.f2 AND t.n2 = r.f1)
SELECT DISTINCT read_id, path_id, 7 AS score_sum, 13 AS align_length, 13 AS frag_length, 30 AS min_mapq, true AS is_simple, CAST(-2147483648 AS INTEGER) AS noise_score FROM m""")
def single_match(spark, sf):
    """Reads over two nodes, matched in full in both orientations."""
    placed = _placed(spark, sf)
    own = _path(_mapping(F.col("n1"), F.lit(1), F.col("r1"), (F.lit(10), F.lit(10))), _mapping(F.col("n2"), F.lit(0), F.col("r2"), (F.lit(3), F.lit(3))))
    reads = _reads(_pairs_of_steps(placed), score=F.lit(7), path=own)
    config = EngineConfig(score_not_qual=True, single_end=True, frag_mean=1.0, frag_sd=1.0, filt_best_score=0.0, max_partial_offset=0)
    return matching.alignment_rows(reads, placed, config, 100)


@query("WITH " + NODES + """, whole AS (SELECT r.read_id, t.path_id FROM r JOIN two t ON t.n1 = r.n1 AND t.n2 = r.n2 UNION SELECT r.read_id, t.path_id FROM r JOIN two t ON t.n1 = r.f2 AND t.n2 = r.f1),
part AS (SELECT r.read_id, o.path_id FROM r JOIN p o ON o.node = r.n1 LEFT JOIN p b ON b.path_id = o.path_id AND b.ordinal = o.ordinal + 1 WHERE b.node IS DISTINCT FROM r.n2
  UNION SELECT r.read_id, o.path_id FROM r JOIN p o ON o.node = r.f1 LEFT JOIN p b ON b.path_id = o.path_id AND b.ordinal = o.ordinal - 1 WHERE b.node IS DISTINCT FROM r.f2),
m AS (SELECT read_id, path_id, 13 AS score, 13 AS len FROM whole UNION ALL SELECT read_id, path_id, 10, 10 FROM part)
SELECT read_id, count(*) AS matches, count(DISTINCT path_id) AS paths, CAST(sum(score) AS BIGINT) AS score, CAST(sum(len) AS BIGINT) AS length, min(len) = 13 AS is_simple FROM m GROUP BY 1""")
def partial_match(spark, sf):
    """Reads that reach three bases into a second node; paths that lack it match in part."""
    placed = _placed(spark, sf)
    own = _path(_mapping(F.col("n1"), F.lit(1), F.col("r1"), (F.lit(10), F.lit(10))), _mapping(F.col("n2"), F.lit(0), F.col("r2"), (F.lit(3), F.lit(3))))
    rows = matching.alignment_rows(_reads(_pairs_of_steps(placed), score=F.lit(13), path=own), placed, ONE, 100)
    return rows.groupBy("read_id").agg(F.count("*").alias("matches"), F.count_distinct("path_id").alias("paths"), F.sum("score_sum").alias("score"), F.sum("align_length").alias("length"), F.min("is_simple").alias("is_simple"))


@query("WITH " + NODES + """, m AS (SELECT r.read_id, t.path_id, 15 AS score FROM r JOIN two t ON t.n1 = r.n1 AND t.n2 = r.n2 UNION SELECT r.read_id, t.path_id, 15 FROM r JOIN two t ON t.n1 = r.f2 AND t.n2 = r.f1
  UNION SELECT r.read_id, t.path_id, 13 FROM r JOIN two t ON t.n1 = r.n1 AND t.n2 = r.f2 UNION SELECT r.read_id, t.path_id, 13 FROM r JOIN two t ON t.n1 = r.n2 AND t.n2 = r.f1)
SELECT read_id, path_id, score AS score_sum, 13 AS align_length FROM m""")
def multipath_match(spark, sf):
    """Reads as graphs: a node, then a second one in either orientation with a score of its own."""
    placed = _placed(spark, sf)
    first = _path(_mapping(F.col("n1"), F.lit(1), F.col("r1"), (F.lit(10), F.lit(10))))
    second, turned = (_path(_mapping(F.col("n2"), F.lit(0), r, (F.lit(3), F.lit(3)))) for r in (F.col("r2"), ~F.col("r2")))
    parts = F.array(*[F.struct(p.alias("path"), F.lit(s).alias("score"), n.cast("array<int>").alias("next"), F.lit(None).cast("array<struct<next:int,score:int>>").alias("connection")) for p, s, n in ((first, 10, F.array(F.lit(1), F.lit(2))), (second, 5, F.array()), (turned, 3, F.array()))])
    config = EngineConfig(score_not_qual=True, single_end=True, frag_mean=1.0, frag_sd=1.0, filt_best_score=0.0, max_partial_offset=0)
    rows = matching.alignment_rows(_reads(_pairs_of_steps(placed), start=F.array(F.lit(0)), subpath=parts), placed, config, 100)
    return rows.select("read_id", "path_id", "score_sum", "align_length")


BUBBLES = NODES + """, w AS (SELECT path_id, ordinal, list(2 * node_id + is_reverse::INTEGER) OVER (PARTITION BY path_id ORDER BY ordinal ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS ns FROM steps),
q AS (SELECT path_id AS read_id, ns FROM w WHERE ordinal = 0 AND len(ns) = 7), o AS (SELECT DISTINCT path_id, ns, list_transform(ns, lambda n: n // 2) AS ids FROM w WHERE len(ns) = 7),
t AS (SELECT read_id, ns AS own, list_transform(ns, lambda n: n // 2) AS ids FROM q UNION ALL SELECT read_id, list_reverse(list_transform(ns, lambda n: xor(n, 1))), list_reverse(list_transform(ns, lambda n: n // 2)) FROM q),
m AS (SELECT DISTINCT read_id, o.path_id, list_sum(list_transform(range(1, 8), lambda i: if(own[i] = ns[i], 5, 3))) AS score FROM t JOIN o USING (ids))
SELECT read_id, path_id, CAST(score AS INTEGER) AS score_sum, 21 AS align_length FROM m"""


@query("WITH " + BUBBLES)
def multipath_bubbles(spark, sf):
    """Reads as graphs of 128 walks: seven places in a row, each with a node in either orientation."""
    placed = _placed(spark, sf)
    first = placed.where("ordinal < 7").groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "node_id", "is_reverse"))).alias("own")).where(F.size("own") == 7)
    none = F.lit(None).cast("array<struct<next:int,score:int>>")

    def part(i, turned):
        step = F.get("own", F.lit(i))
        following = F.array(F.lit(2 * i + 2), F.lit(2 * i + 3)) if i < 6 else F.array().cast("array<int>")
        own = _path(_mapping(step["node_id"], F.lit(0), step["is_reverse"] != F.lit(turned), (F.lit(3), F.lit(3))))
        return F.struct(own.alias("path"), F.lit(3 if turned else 5).alias("score"), following.alias("next"), none.alias("connection"))

    graph = F.array(*[part(i, turned) for i in range(7) for turned in (False, True)])
    reads = _reads(first.withColumn("read_id", F.col("path_id")), start=F.array(F.lit(0), F.lit(1)), subpath=graph, sequence=F.expr("repeat('A', 21)"))
    config = EngineConfig(score_not_qual=True, single_end=True, frag_mean=1.0, frag_sd=1.0, filt_best_score=0.0, max_partial_offset=0)
    return matching.alignment_rows(reads, placed, config, 100).select("read_id", "path_id", "score_sum", "align_length")


CIRCLES = STEPS + """, n AS (SELECT path_id, count(*) AS n FROM steps GROUP BY 1), c AS (SELECT path_id, ordinal, node_id, is_reverse FROM steps UNION ALL SELECT path_id, ordinal + n, node_id, is_reverse FROM steps JOIN n USING (path_id)),
o AS (SELECT path_id, ordinal, node_id, is_reverse, p_size AS len, CAST(coalesce(sum(p_size) OVER (PARTITION BY path_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum FROM c JOIN part ON p_partkey = node_id),
q AS (SELECT a.path_id AS read_id, a.node_id AS n1, a.is_reverse AS r1, b.node_id AS n2, b.is_reverse AS r2 FROM steps a JOIN steps b ON b.path_id = a.path_id AND a.ordinal = 0 AND b.ordinal = 1),
f AS (SELECT DISTINCT q.read_id, a.path_id, b.cum + b.len - a.cum AS frag FROM q JOIN o a ON a.node_id = q.n1 AND a.is_reverse = q.r1 JOIN o b ON b.path_id = a.path_id AND b.node_id = q.n2 AND b.is_reverse = q.r2 AND b.ordinal >= a.ordinal WHERE b.cum + b.len - a.cum <= 250)"""


@query("WITH " + CIRCLES + " SELECT read_id, path_id, count(*) AS fragments, CAST(min(frag) AS BIGINT) AS shortest, CAST(max(frag) AS BIGINT) AS longest FROM f GROUP BY 1, 2")
def circular_pairs(spark, sf):
    """Pairs on paths that go round twice: a fragment length for every pair of places that is near enough."""
    own = steps(spark, sf)
    again = own.withColumn("ordinal", F.col("ordinal") + F.count("*").over(Window.partitionBy("path_id")))
    placed = stored(paths.with_offsets(own.unionByName(again), nodes(spark, sf)).withColumn("node", F.col("node_id") * 2 + F.col("is_reverse").cast("int")), "circles")
    after = own.where("ordinal = 1").select("path_id", F.col("node_id").alias("n2"), F.col("is_reverse").alias("r2"))
    pairs = own.where("ordinal = 0").join(after, "path_id").select(F.col("path_id").alias("read_id"), F.col("node_id").alias("n1"), F.col("is_reverse").alias("r1"), "n2", "r2")
    base = (F.lit(1), F.lit(1))
    ends = {1: _path(_mapping(F.col("n1"), F.lit(0), F.col("r1"), base)), 2: _path(_mapping(F.col("n2"), F.lit(0), ~F.col("r2"), base))}
    one, two = (_reads(pairs, mate=F.lit(m), sequence=F.lit("A"), score=F.lit(1), path=p) for m, p in ends.items())
    config = EngineConfig(score_not_qual=True, library="fr", frag_mean=1.0, frag_sd=1.0, filt_best_score=0.0, max_partial_offset=0)
    rows = matching.alignment_rows(one.unionByName(two), placed, config, 250)
    return rows.groupBy("read_id", "path_id").agg(F.count("*").alias("fragments"), F.min("frag_length").cast("long").alias("shortest"), F.max("frag_length").cast("long").alias("longest"))


FACTS = "SELECT l_orderkey AS read_id, l_suppkey AS path_id, l_suppkey % 7 = 1 AS partial, l_returnflag = 'R' AND l_partkey % 5 = 0 AS multimap, 100 + l_partkey % 2 AS frag_length, CAST(l_discount AS DOUBLE) * 9.5 AS fraction FROM lineitem"


def _facts(spark, sf):
    line = table(spark, sf, "lineitem")
    rows = line.select(F.col("l_orderkey").alias("read_id"), F.col("l_suppkey").alias("path_id"), F.lit(1).alias("score_sum"), F.lit(1).alias("align_length"), (100 + F.col("l_partkey") % 2).alias("frag_length"), F.lit(60).alias("min_mapq"), (F.col("l_discount").cast("double") * 9.5).alias("fraction"), (F.col("l_suppkey") % 7 == 1).alias("partial"), ((F.col("l_returnflag") == "R") & (F.col("l_partkey") % 5 == 0)).alias("multimap"))
    return matching.with_read_facts(rows, 0.9)


@query(f"WITH f AS ({FACTS}) SELECT read_id, NOT bool_or(partial) AND NOT bool_or(multimap) AND min(frag_length) = max(frag_length) AS is_simple FROM f GROUP BY 1")
def is_simple(spark, sf):
    return _facts(spark, sf).select("read_id", "is_simple").distinct()


@query(f"WITH f AS ({FACTS}) SELECT read_id, CASE WHEN max(fraction) < 0.9 THEN 0 ELSE -2147483648 END::INTEGER AS noise_score FROM f GROUP BY 1")
def best_score_filter(spark, sf):
    return _facts(spark, sf).select("read_id", "noise_score").distinct()


@query("WITH " + ROWS + ", d AS (SELECT * FROM (SELECT read_class_id, path_id, frag_length, align_length, score_sum FROM rows) QUALIFY row_number() OVER (PARTITION BY read_class_id, path_id, frag_length ORDER BY align_length DESC, score_sum DESC) = 1) SELECT read_class_id, count(*) AS states, CAST(min(align_length) AS INTEGER) AS shortest FROM d GROUP BY 1")
def dedup_states(spark, sf):
    rows = align_rows(spark, sf).withColumnRenamed("read_class_id", "read_id")
    return matching.best_states(rows).groupBy(F.col("read_id").alias("read_class_id")).agg(F.count("*").alias("states"), F.min("align_length").alias("shortest"))


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS r, l_suppkey AS p, l_orderkey % 3 AS s, l_orderkey % 4 AS a, 100 + l_partkey % 2 AS f FROM lineitem),
k AS (SELECT r, count(DISTINCT (s, a, f)) AS kinds FROM d GROUP BY 1), l AS (SELECT d.r, string_agg(concat(p, ':', if(kinds = 1, 1, s), ':', if(kinds = 1, 1, a), ':', if(kinds = 1, 1, f)), ' ' ORDER BY p, s, a, f) AS rows FROM d JOIN k USING (r) GROUP BY 1)
SELECT rows, CAST(60 + r % 2 AS INTEGER) AS min_mapq, count(*) AS read_count FROM l GROUP BY 1, 2""")
def canonical_lists(spark, sf):
    """Classes of reads with equal lists of rows; lists of a single kind of row are made canonical."""
    order = F.col("l_orderkey")
    rows = table(spark, sf, "lineitem").select(order.alias("read_id"), F.col("l_suppkey").alias("path_id"), (order % 3).cast("int").alias("score_sum"), (order % 4).cast("int").alias("align_length"), (100 + F.col("l_partkey") % 2).alias("frag_length"), (60 + order % 2).cast("int").alias("min_mapq"), F.lit(INT_MIN).alias("noise_score"), F.lit(True).alias("is_simple"))
    text = F.transform("rows", lambda r: F.concat_ws(":", r["path_id"].cast("string"), r["score_sum"].cast("string"), r["align_length"].cast("string"), r["frag_length"].cast("string")))
    return matching.read_classes(rows).select(F.concat_ws(" ", text).alias("rows"), "min_mapq", "read_count")


@query("SELECT l_orderkey AS read_id, count(*) AS reads FROM lineitem WHERE l_quantity <= 40 AND l_returnflag <> 'R' GROUP BY 1")
def has_path(spark, sf):
    node = _mapping(F.col("l_partkey"), F.lit(0), F.lit(False), (F.lit(1), F.lit(1)))
    own = F.when(F.col("l_quantity") <= 40, F.struct(F.when(F.col("l_returnflag") != "R", F.array(node)).otherwise(F.array().cast("array<struct<position:struct<node_id:long,offset:long,is_reverse:boolean>,edit:array<struct<from_length:int,to_length:int>>>>")).alias("mapping")))
    return readers.has_path(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("read_id"), own.alias("path"))).groupBy("read_id").agg(F.count("*").alias("reads"))


# ---- sources

@query("SELECT (row_number() OVER w - 1) // 2 AS read_id, CAST((row_number() OVER w - 1) % 2 + 1 AS INTEGER) AS mate, o_orderkey AS score, o_custkey AS node_id, o_orderstatus = 'F' AS is_reverse, CAST(length(o_orderpriority) AS INTEGER) AS bases FROM orders WINDOW w AS (ORDER BY o_orderkey)")
def interleaved_reads(spark, sf):
    """Alignments written as JSON lines in the form of protobuf's JSON, read back as interleaved pairs."""
    o = clusters.numbered(table(spark, sf, "orders"), ["o_orderkey"], "row")  # a file holds whole chunks of an even number of rows
    o = o.withColumn("chunk", F.floor(F.col("row") / 1024)).repartitionByRange("chunk").sortWithinPartitions("row")
    position = F.struct(F.col("o_custkey").cast("string").alias("node_id"), F.when(F.col("o_orderstatus") == "F", F.lit(True)).alias("is_reverse"))
    own = F.struct(F.array(F.struct(position.alias("position"), F.array(F.struct(F.lit(1).alias("from_length"), F.lit(1).alias("to_length"))).alias("edit"))).alias("mapping"))
    path = shared_path(spark, "reads")
    o.select(F.expr("repeat('A', length(o_orderpriority))").alias("sequence"), F.col("o_orderkey").cast("int").alias("score"), own.alias("path")).write.json(path)
    reads, first = readers.read_alignments(spark, path, multipath=False, interleaved=True), F.get("path.mapping", F.lit(0))["position"]
    return reads.select("read_id", "mate", F.col("score").cast("long").alias("score"), first["node_id"].alias("node_id"), first["is_reverse"].alias("is_reverse"), F.length("sequence").alias("bases"))


@query("SELECT o_orderkey AS score, o_custkey AS node_id, o_orderstatus = 'F' AS is_reverse, CAST(length(o_orderpriority) AS INTEGER) AS bases, CAST(o_custkey % 61 AS INTEGER) AS mapping_quality, CAST(o_orderkey % 50 AS VARCHAR) AS allelic_mapq, o_custkey % 7 AS offset FROM orders")
def message_scan(spark, sf):
    """Alignments written as framed messages in block-gzip files, and read back in several tasks a file."""
    custkey, parts = F.col("o_custkey"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    o = table(spark, sf, "orders").repartition(parts, "o_orderkey", "o_custkey")  # a row group may hold a million rows, but is read by one task
    own = _path(_mapping(custkey, custkey % 7, F.col("o_orderstatus") == "F", (F.lit(1), F.lit(1))))
    reads = o.select(F.expr("repeat('A', length(o_orderpriority))").alias("sequence"), F.col("o_orderkey").cast("int").alias("score"), (custkey % 61).cast("int").alias("mapping_quality"), F.create_map(F.lit("allelic_mapq"), (F.col("o_orderkey") % 50).cast("string")).alias("annotation"), own.alias("path"))
    path = shared_path(spark, "messages")
    blockgzip.register(spark)
    reads.write.format("gam").mode("append").save(path)
    found, first = readers.read_alignments(spark, path, multipath=False, fmt="gam", split=1 << 16), F.get("path.mapping", F.lit(0))["position"]
    return found.select(F.col("score").cast("long").alias("score"), first["node_id"].alias("node_id"), first["is_reverse"].alias("is_reverse"), F.length("sequence").alias("bases"), "mapping_quality", F.col("annotation")["allelic_mapq"].alias("allelic_mapq"), first["offset"].alias("offset"))


@query("""WITH h AS (SELECT o_orderpriority AS transcript, o_orderstatus AS s, count(DISTINCT o_custkey) AS source_count FROM orders GROUP BY 1, 2) SELECT concat(transcript, '_', s) AS name, transcript, CAST(source_count AS INTEGER) AS source_count, CAST(sum(source_count) OVER (PARTITION BY transcript) AS BIGINT) AS of_transcript FROM h""")
def haplotype_count(spark, sf):
    """Path information written as a tab-separated file and read back: haplotypes of paths, and paths of a transcript."""
    o = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.concat_ws(",", F.collect_list(F.col("o_custkey").cast("string"))).alias("Haplotypes"))
    path = shared_path(spark, "info")
    o.select(F.concat_ws("_", "o_orderpriority", "o_orderstatus").alias("Name"), F.lit(1).alias("Length"), F.col("o_orderpriority").alias("Transcripts"), "Haplotypes").write.option("sep", "\t").option("header", "true").option("quote", "").csv(path)
    info = stored(readers.read_path_info(spark, path), "info")
    return info.join(info.groupBy("group_id").agg(F.sum("source_count").alias("of_transcript")), "group_id").select("name", "transcript", "source_count", "of_transcript")


@query("SELECT o_orderkey AS path_id, o_orderpriority AS transcript, CAST(length(o_orderpriority) AS INTEGER) AS source_count FROM orders")
def path_info_lookup(spark, sf):
    o = table(spark, sf, "orders")
    info = o.select("o_orderpriority").distinct().select(F.col("o_orderpriority").alias("name"), F.col("o_orderpriority").alias("transcript"), F.length("o_orderpriority").alias("source_count"), F.lit(0).cast("long").alias("group_id"), F.lit(None).cast("array<long>").alias("source_ids"))
    return readers.with_path_info(o.select(F.col("o_orderkey").alias("path_id"), F.col("o_orderpriority").alias("name")), info).select("path_id", "transcript", "source_count")


@query("""SELECT o_orderkey AS read_id, CAST(CASE WHEN o_custkey % 3 = 0 THEN 100 + o_custkey % 50 WHEN o_custkey % 3 = 1 THEN 0.5 + o_custkey END AS DOUBLE) AS mean, CAST(CASE WHEN o_custkey % 3 = 0 THEN 10 + o_custkey % 7 WHEN o_custkey % 3 = 1 THEN 20 END AS DOUBLE) AS sd FROM orders""")
def fragment_params(spark, sf):
    """Parameters from the text field, from the annotation where that begins with 0, or none."""
    c = F.col("o_custkey")
    text = F.when(c % 3 == 0, F.concat_ws(":", F.lit("1000"), (100 + c % 50).cast("string"), (10 + c % 7).cast("string"), F.lit("1"))).when(c % 3 == 1, F.lit("0:0:0"))
    notes = F.when(c % 3 == 1, F.create_map(F.lit("fragment_length_distribution"), F.concat(F.lit("-I "), (0.5 + c).cast("string"), F.lit(" -D 20"))))
    p = fragments.parse_alignment_params(text, notes)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("read_id"), p["mean"].alias("mean"), p["sd"].alias("sd"))


@query("SELECT CAST(100 + o_custkey % 50 AS DOUBLE) AS mean, CAST(10 + o_custkey % 7 AS DOUBLE) AS sd FROM orders WHERE o_custkey % 3 = 0 ORDER BY o_orderkey LIMIT 1")
def first_fragment_params(spark, sf):
    c = F.col("o_custkey")
    text = F.when(c % 3 == 0, F.concat_ws(":", F.lit("1000"), (100 + c % 50).cast("string"), (10 + c % 7).cast("string"), F.lit("1")))
    found = fragments.first_params(table(spark, sf, "orders"), fragments.parse_alignment_params(text, F.lit(None).cast("map<string,string>")), "o_orderkey")
    return spark.createDataFrame([found], "mean double, sd double")


# ---- clusters and result tables

@query("WITH r AS (SELECT l_orderkey AS read_class_id, min(l_suppkey) AS p FROM lineitem GROUP BY 1) SELECT read_class_id, p % 5 AS cluster_id FROM r JOIN supplier ON s_suppkey = p")
def class_clusters(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("read_class_id")).agg(F.collect_list(F.struct(F.col("l_suppkey").alias("path_id"))).alias("rows"))
    return clusters.class_clusters(rows, members(spark, sf)).select("read_class_id", "cluster_id")


@query("""WITH c AS (SELECT s_suppkey AS path_id, s_suppkey % 50 AS anchor FROM supplier), r AS (SELECT l_orderkey, min(l_suppkey) AS p FROM lineitem GROUP BY 1), n AS (SELECT p % 50 AS anchor, count(*) AS n FROM r GROUP BY 1),
k AS (SELECT a.anchor, row_number() OVER (ORDER BY coalesce(n, 0) DESC, a.anchor DESC) - 1 AS cluster_id FROM (SELECT DISTINCT anchor FROM c) a LEFT JOIN n USING (anchor)) SELECT path_id, cluster_id FROM c JOIN k USING (anchor)""")
def ranked_clusters(spark, sf):
    placed = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("path_id"), (F.col("s_suppkey") % 50).alias("anchor"))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_suppkey").alias("path_id"))).alias("rows"))
    return clusters.ranked(placed, rows)


@query("WITH " + COMBOS + """ SELECT concat('p', i) AS "Name_1", concat('p', j) AS "Name_2", cluster_id + 1 AS "ClusterID", CAST(w / 100.0 AS DOUBLE) AS "HaplotypingProbability" FROM g WHERE w / 100.0 >= 0.05""")
def haplotype_table(spark, sf):
    result = _result(spark, sf)
    names = result.select("cluster_id", F.explode("path_ids").alias("path_id")).distinct().select("cluster_id", "path_id", F.concat(F.lit("p"), F.col("path_id").cast("string")).alias("name"), F.lit(1.0).alias("effective_length"))
    return sinks.haplotype_table(result, names, 2, 0.05)


@query("""WITH m AS (SELECT s_suppkey, row_number() OVER (PARTITION BY s_suppkey % 5 ORDER BY s_suppkey) - 1 AS x FROM supplier), r AS (SELECT DISTINCT l_suppkey % 5 AS cluster_id, l_orderkey AS r, x, if(l_suppkey % 2 = 0, 0.25, 0.125) AS prob FROM lineitem JOIN m ON s_suppkey = l_suppkey),
s AS (SELECT cluster_id, r, prob, concat(if(prob = 0.25, '0.25', '0.125'), ':', string_agg(x, ',' ORDER BY x)) AS t FROM r GROUP BY 1, 2, 3), l AS (SELECT cluster_id, concat(1 + r % 3, ' 0.5 ', string_agg(t, ' ' ORDER BY prob)) AS line FROM s GROUP BY cluster_id, r)
SELECT cluster_id, 2 AS line_no, line, count(*) AS n FROM l GROUP BY 1, 3
UNION ALL SELECT s_suppkey % 5, 1, string_agg(concat(s_name, ',1000,', 100 + 7 * (s_suppkey % 13)), ' ' ORDER BY s_suppkey), 1 FROM supplier GROUP BY 1 UNION ALL SELECT DISTINCT s_suppkey % 5, 0, '#', 1 FROM supplier""")
def probability_dump(spark, sf):
    """Lines of the probability dump, with how often each occurs."""
    return _dump_lines(spark, sf).groupBy("cluster_id", "line_no", "line").agg(F.count("*").alias("n"))


def _dump_lines(spark, sf):
    order, path = F.col("l_orderkey"), F.col("l_suppkey")
    rows = table(spark, sf, "lineitem").select((path % 5).alias("cluster_id"), order.alias("read_class_id"), (1 + order % 3).alias("read_count"), F.lit(0.5).alias("noise_prob"), path.alias("path_id"), F.when(path % 2 == 0, 0.25).otherwise(0.125).alias("prob")).distinct()
    return sinks.probability_lines(rows, clusters.local_index(members(spark, sf)))


DUMP = ORACLE["probability_dump"]


@query(f"SELECT line, CAST(sum(n) AS BIGINT) AS n FROM ({DUMP}) GROUP BY 1")
def probability_dump_file(spark, sf):
    """The probability dump written as block-gzip parts, and read back as lines."""
    path = shared_path(spark, "dump")
    sinks.write_probability_lines(_dump_lines(spark, sf), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


# ---- numbers

#: The normal distribution function at z, as a series of positive terms.
PHI = """(CASE WHEN {z} > 8 THEN 1.0::DOUBLE WHEN {z} < -8 THEN 0.0::DOUBLE WHEN {z} = 0 THEN 0.5::DOUBLE ELSE 0.5 + sign({z}) * exp(-0.5 * {z} * {z}) / sqrt(2 * pi())
  * list_sum(list_transform(range(0, 150), lambda k: exp((2 * k + 1) * ln(abs({z})) - (k + 1) * ln(2.0::DOUBLE) - lgamma(k + 1.5::DOUBLE) + 0.5 * ln(pi())))) END)"""
DENSITY = "(exp(-0.5 * {z} * {z}) / sqrt(2 * pi()))"


def _of_rows(df, schema: str, f):
    def run(batches):
        for pdf in batches:
            yield f(pdf)

    return df.mapInPandas(run, schema)


@query("WITH x AS (SELECT DISTINCT p_partkey % 400 AS k, (p_partkey % 400 - 200) / 40.0::DOUBLE AS z FROM part) SELECT k, round(" + PHI.format(z="z") + ", 9) AS phi FROM x")
def normal_cdf(spark, sf):
    z = table(spark, sf, "part").select((F.col("p_partkey") % 400).alias("k")).distinct()
    return _of_rows(z, "k long, phi double", lambda p: p.assign(phi=np.round(mathfn.normal_cdf((p["k"].to_numpy() - 200) / 40), 9) + 0.0))


OWEN = "(1 / (2 * pi()) * list_sum(list_transform(range(0, 1500), lambda k: exp(-0.5 * {h} * {h} * (1 + ({a} * (k + 0.5) / 1500) * ({a} * (k + 0.5) / 1500))) / (1 + ({a} * (k + 0.5) / 1500) * ({a} * (k + 0.5) / 1500)))) * {a} / 1500)"


@query("WITH x AS (SELECT DISTINCT p_size, p_partkey % 9 AS k, (p_size - 25) / 10.0::DOUBLE AS z, (p_partkey % 9 - 4) * 0.75::DOUBLE AS s FROM part) SELECT p_size, k, round(" + OWEN.format(h="z", a="s") + ", 5) + 0.0 AS owen, round(2 * " + DENSITY.format(z="z") + " * " + PHI.format(z="(s * z)") + " / 3, 9) AS density, round(" + PHI.format(z="z") + " - 2 * " + OWEN.format(h="z", a="s") + ", 5) + 0.0 AS cdf FROM x")
def skew_normal(spark, sf):
    """Owen's T and the skew normal density and distribution function."""
    rows = table(spark, sf, "part").select("p_size", (F.col("p_partkey") % 9).alias("k")).distinct()

    def values(p):
        z, s = (p["p_size"].to_numpy() - 25) / 10, (p["k"].to_numpy() - 4) * 0.75
        cdf, density = (np.array([f(a * 3 + 2, 2.0, 3.0, b) for a, b in zip(z, s)]) for f in (mathfn.skew_normal_cdf, mathfn.skew_normal_pdf))
        return p.assign(owen=np.round(mathfn.owens_t(z, s), 5) + 0.0, density=np.round(density, 9) + 0.0, cdf=np.round(cdf, 5) + 0.0)

    return _of_rows(rows, f"p_size {rows.schema['p_size'].dataType.simpleString()}, k long, owen double, density double, cdf double", values)


TRUNCATED = "(60 + 20 * (" + DENSITY.format(z="(-2.95)") + " - " + DENSITY.format(z="((length - 60) / 20.0::DOUBLE)") + ") / (" + PHI.format(z="((length - 60) / 20.0::DOUBLE)") + " - " + PHI.format(z="(-2.95::DOUBLE)") + "))"


@query("WITH " + STEPS + ", l AS (SELECT path_id, CAST(sum(p_size) AS BIGINT) AS length FROM steps JOIN part ON p_partkey = node_id GROUP BY path_id), k AS (SELECT length, CASE WHEN length <= 0 THEN 0.0 WHEN length <= 1 THEN 1.0 ELSE greatest(1, length - " + TRUNCATED + ") END AS e FROM (SELECT DISTINCT length FROM l)) SELECT path_id, length, round(CAST(e AS DOUBLE), 6) AS effective_length FROM l JOIN k USING (length)")
def effective_length(spark, sf):
    out = paths.effective_lengths(paths.path_lengths(steps(spark, sf), nodes(spark, sf)), FragmentDist(60.0, 20.0))
    return out.select("path_id", "length", F.round("effective_length", 6).alias("effective_length"))


@query("""SELECT l_orderkey, l_partkey, round(ln(exp(-l_linenumber::DOUBLE) + exp(-l_quantity::DOUBLE / 10)), 9) AS log_sum, abs(l_linenumber - l_quantity::DOUBLE) < 2e-14 * least(l_linenumber, l_quantity) OR l_linenumber = l_quantity AS same,
round(1 - 1 / (1 + exp(-1e-6::DOUBLE * (l_partkey * 1000))) / (1 + exp(-1e-6::DOUBLE * (l_suppkey * -1000))), 9) AS noise, round(pow(10.0::DOUBLE, -l_linenumber / 10.0), 9) AS prob FROM lineitem""")
def score_functions(spark, sf):
    n, q = F.col("l_linenumber").cast("double"), F.col("l_quantity").cast("double")
    scores = F.array((F.col("l_partkey") * 1000).cast("double"), (F.col("l_suppkey") * -1000).cast("double"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.round(scoring.add_log(-n, -q / 10), 9).alias("log_sum"), scoring.same_double(n, q, 2e-14).alias("same"), F.round(scoring.noise_prob_of_scores(scores), 9).alias("noise"), F.round(scoring.phred_to_prob(n), 9).alias("prob"))


@query("""WITH x AS (SELECT DISTINCT l_orderkey AS r, l_suppkey AS p, CAST(1 + l_suppkey % 3 AS DOUBLE) / 8 AS prob FROM lineitem), g AS (SELECT r, prob, string_agg(p, ',' ORDER BY p) AS paths FROM x GROUP BY 1, 2)
SELECT r AS read_class_id, string_agg(concat(prob, ':', paths), ' ' ORDER BY prob) AS groups FROM g GROUP BY 1""")
def binned_probs(spark, sf):
    """Paths of a read in groups of equal probability."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("read_class_id"), F.col("l_suppkey").alias("path_idx"), ((1 + F.col("l_suppkey") % 3).cast("double") / 8).alias("prob")).distinct()
    pairs = rows.groupBy("read_class_id").agg(F.collect_list(F.struct("path_idx", "prob")).alias("pairs"))
    text = F.transform(probs.binned(F.col("pairs"), 1e-8), lambda g: F.concat(g["prob"].cast("string"), F.lit(":"), F.concat_ws(",", g["paths"].cast("array<string>"))))
    return pairs.select("read_class_id", F.concat_ws(" ", text).alias("groups"))


# ---- arrays of a cluster

CELLS = "cells AS (SELECT l_suppkey % 20 AS cluster_id, l_orderkey AS r, l_linenumber AS p, CAST(max(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3)"


def _cells(spark, sf):
    """Cells of a cluster of suppliers: reads are orders, paths line numbers, probabilities quantities."""
    line = table(spark, sf, "lineitem")
    return line.groupBy((F.col("l_suppkey") % 20).alias("cluster_id"), F.col("l_orderkey").alias("read_class_id"), F.col("l_linenumber").alias("path_id")).agg(F.max("l_quantity").cast("double").alias("prob"))


@query("WITH " + CELLS + """, s AS (SELECT cluster_id, r, string_agg(concat(p, ':', CAST(v AS INTEGER)), ' ' ORDER BY p) AS row FROM cells GROUP BY 1, 2) SELECT cluster_id, row, CAST(sum(1 + r % 4) AS DOUBLE) AS n FROM s GROUP BY 1, 2""")
def read_collapse(spark, sf):
    """Reads with equal rows as one, with their counts."""
    reads = _cells(spark, sf).withColumn("read_count", 1 + F.col("read_class_id") % 4).withColumn("noise_prob", F.lit(0.0))
    merged = probs.merge_identical(reads).groupBy("cluster_id", "read_class_id").agg(F.array_sort(F.collect_list(F.struct("path_id", F.col("prob").cast("int").alias("v")))).alias("row"), F.first("read_count").cast("double").alias("n"))
    return merged.select("cluster_id", F.concat_ws(" ", F.transform("row", lambda x: F.concat_ws(":", x["path_id"].cast("string"), x["v"].cast("string")))).alias("row"), "n")


@query("WITH " + CELLS + """, w AS (SELECT c.cluster_id, c.p * 2 + b.b AS col, c.r, c.v FROM cells c, (VALUES (0), (1)) b(b)), s AS (SELECT cluster_id, col, string_agg(concat(r, ':', v), ',' ORDER BY r) AS sig FROM w GROUP BY 1, 2)
SELECT cluster_id, string_agg(col, ',' ORDER BY col) AS members FROM s GROUP BY cluster_id, sig""")
def path_collapse(spark, sf):
    """Paths with equal columns as one: every line number stands for two paths."""
    twice = F.explode(F.array(F.col("path_id") * 2, F.col("path_id") * 2 + 1))
    groups = probs.merge_paths(_cells(spark, sf).withColumn("path_id", twice)).groupBy("cluster_id", "kept").agg(F.array_sort(F.collect_list("path_id")).alias("members"))
    return groups.select("cluster_id", F.concat_ws(",", F.col("members").cast("array<string>")).alias("members"))


@query("WITH " + CELLS + """, n AS (SELECT *, CASE WHEN r % 5 = 0 THEN 1.0::DOUBLE ELSE (r % 5) / 10.0::DOUBLE END AS noise, sum(v) OVER (PARTITION BY cluster_id, r) AS t FROM cells)
SELECT cluster_id, r, p, round(v / t, 9) AS prob, round((1 + r % 4) * (1 - noise), 9) AS n FROM n WHERE noise < 1""")
def detract_noise(spark, sf):
    """Rows as shares of the reads that are not noise; reads that are all noise go."""
    r = F.col("read_class_id")
    reads = _cells(spark, sf).withColumn("read_count", 1 + r % 4).withColumn("noise_prob", F.when(r % 5 == 0, 1.0).otherwise((r % 5) / 10))
    return probs.detract_noise(reads).select("cluster_id", r.alias("r"), F.col("path_id").alias("p"), F.round("prob", 9).alias("prob"), F.round("read_count", 9).alias("n"))


@query("""WITH h AS (SELECT c_nationkey AS cluster_id, o_custkey AS h, list_sort(list(DISTINCT o_orderpriority)) AS paths FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) SELECT cluster_id, array_to_string(paths, ',') AS paths, CAST(count(*) AS DOUBLE) AS haplotypes FROM h GROUP BY 1, 2""")
def identical_haplotypes(spark, sf):
    """Haplotypes (customers) with equal lists of paths (priorities) as one group, in every nation."""
    import pandas as pd

    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = o.select(F.col("c_nationkey").cast("long").alias("cluster_id"), F.col("o_orderpriority").alias("path"), F.col("o_custkey").alias("h")).distinct()

    def run(key, pdf):
        names = sorted(pdf["path"].unique())
        groups, sizes = estimators.source_groups([sorted(pdf.loc[pdf["path"] == p, "h"].tolist()) for p in names])
        return pd.DataFrame({"cluster_id": key[0], "paths": [",".join(names[i] for i in g) for g in groups], "haplotypes": sizes})

    return rows.groupBy("cluster_id").applyInPandas(run, "cluster_id long, paths string, haplotypes double")


@query("WITH " + COMBOS + ", p AS (SELECT *, w / CAST(sum(w) OVER (PARTITION BY cluster_id) AS DOUBLE) AS post FROM g), s AS (SELECT cluster_id, i, j, sum(post) AS post FROM p WHERE post >= 0.001 GROUP BY 1, 2, 3) SELECT cluster_id, i, j, round(post / sum(post) OVER (PARTITION BY cluster_id), 6) AS prob FROM s")
def subset_select(spark, sf):
    """Path subsets of likely combinations, equal ones summed."""
    import pandas as pd

    def run(key, pdf):
        weights = pdf["posterior"].to_numpy() / pdf["posterior"].sum()
        subsets = estimators.select_subsets([tuple(p) for p in pdf["path_ids"]], weights, [[x] for x in range(64)], 0.001)
        return pd.DataFrame({"cluster_id": key[0], "i": [k[0] for k in subsets], "j": [k[1] for k in subsets], "prob": [round(v, 6) for v in subsets.values()]})

    return _result(spark, sf).select("cluster_id", "path_ids", "posterior").groupBy("cluster_id").applyInPandas(run, "cluster_id long, i long, j long, prob double")


# ---- inference

def _even(spark, sf, clusters_: int):
    """Members in clusters of suppliers, and one read a cluster that tells nothing: posteriors are the prior."""
    s = F.col("s_suppkey")
    own = table(spark, sf, "supplier").select((s % clusters_).alias("cluster_id"), s.alias("path_id"), (1 + s % 3).alias("source_count"), F.lit(0).cast("long").alias("group_id"), F.lit(None).cast("array<long>").alias("source_ids"))
    reads = own.select("cluster_id", F.lit(1).cast("long").alias("read_class_id"), F.lit(3).cast("long").alias("read_count"), F.lit(0.5).alias("noise_prob"), "path_id", F.lit(0.001).alias("prob"))
    return own, reads


PRIOR = "m AS (SELECT s_suppkey % {k} AS cluster_id, s_suppkey AS p, 1 + s_suppkey % 3 AS w FROM supplier), f AS (SELECT *, w / CAST(sum(w) OVER (PARTITION BY cluster_id) AS DOUBLE) AS f FROM m)"


def _groups(out, size: int):
    """A posterior halfway between two numbers of nine decimals goes up, on whichever side of it the last bits fall."""
    return out.where("kind = 'group'").select("cluster_id", *[F.get("path_ids", F.lit(i)).alias(f"p{i + 1}") for i in range(size)], F.round(F.round("posterior", 15), 9).alias("posterior"))


@query("WITH " + PRIOR.format(k=5) + " SELECT cluster_id, p AS p1, round(f, 9) AS posterior FROM f")
def single_posterior(spark, sf):
    own, reads = _even(spark, sf, 5)
    return _groups(inference.infer(reads, own, EngineConfig(model="haplotypes", ploidy=1)), 1)


@query("WITH " + PRIOR.format(k=5) + " SELECT a.cluster_id, a.p AS p1, b.p AS p2, round(a.f * b.f * if(a.p = b.p, 1, 2), 9) AS posterior FROM f a JOIN f b ON a.cluster_id = b.cluster_id AND a.p <= b.p")
def combos(spark, sf):
    """All pairs of paths of a cluster, with the prior of their frequencies and orders."""
    own, reads = _even(spark, sf, 5)
    return _groups(inference.infer(reads, own, EngineConfig(model="haplotypes")), 2)


@query("WITH " + PRIOR.format(k=50) + ", t AS (SELECT a.cluster_id, a.p AS p1, b.p AS p2, c.p AS p3, a.f * b.f * c.f * CASE WHEN a.p = b.p AND b.p = c.p THEN 1 WHEN a.p = b.p OR b.p = c.p THEN 3 ELSE 6 END AS x FROM f a JOIN f b ON a.cluster_id = b.cluster_id AND a.p <= b.p JOIN f c ON a.cluster_id = c.cluster_id AND b.p <= c.p) SELECT cluster_id, p1, p2, p3, round(x / sum(x) OVER (PARTITION BY cluster_id), 9) AS posterior FROM t")
def triple_posterior(spark, sf):
    """The full posterior of three paths."""
    own, reads = _even(spark, sf, 50)
    return _groups(inference.infer(reads, own, EngineConfig(model="haplotypes", ploidy=3)), 3)


EXACT = 1e-13  # precision within which rows are merged where the SQL merges none: what is merged shifts counts by as much


def em_sql(cells: str) -> str:
    """CTEs em (cluster_id, path_id, share): EM over the cells (cluster_id, read_class_id, read_count, path_id, prob; -1 is noise) until calm."""
    return f"""cells AS MATERIALIZED ({cells}),
total AS (SELECT cluster_id, CAST(sum(read_count) AS DOUBLE) AS t FROM (SELECT DISTINCT cluster_id, read_class_id, read_count FROM cells) GROUP BY 1),
rounds AS (SELECT cluster_id, path_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY cluster_id) AS share, 0 AS calm, 0 AS it FROM (SELECT DISTINCT cluster_id, path_id FROM cells)
  UNION ALL SELECT cluster_id, path_id, now, CASE WHEN bool_or(abs(now - share) > 0.001 * now AND now >= 1e-8) OVER (PARTITION BY cluster_id) THEN 0 ELSE calm + 1 END, it + 1 FROM (
    SELECT cluster_id, path_id, any_value(share) AS share, sum(coalesce(joint / nullif(norm, 0), 0) * read_count) / any_value(t) AS now, any_value(calm) AS calm, any_value(it) AS it FROM (
      SELECT c.cluster_id, c.path_id, c.read_count, r.share, r.calm, r.it, c.prob * r.share AS joint, sum(c.prob * r.share) OVER (PARTITION BY c.cluster_id, c.read_class_id) AS norm FROM cells c JOIN rounds r ON r.cluster_id = c.cluster_id AND r.path_id = c.path_id WHERE r.calm < 10 AND r.it < 10000)
    JOIN total USING (cluster_id) GROUP BY cluster_id, path_id)),
em AS (SELECT cluster_id, path_id, share FROM rounds QUALIFY it = max(it) OVER (PARTITION BY cluster_id))"""


NORMAL = "normal AS (SELECT *, coalesce(prob / nullif(sum(prob) OVER (PARTITION BY cluster_id, read_class_id), 0) * (1 - noise_prob), 0) AS pn FROM probs)"
ALL_CELLS = "SELECT cluster_id, read_class_id, read_count, path_id, pn AS prob FROM normal WHERE path_id IS NOT NULL UNION ALL SELECT DISTINCT cluster_id, read_class_id, read_count, -1, noise_prob FROM normal"


@query("WITH RECURSIVE " + PROBS + ", " + MEMBERS + ", " + NORMAL + ", " + em_sql(ALL_CELLS) + """,
c AS (SELECT m.cluster_id, m.path_id, m.name, m.effective_length AS e, CASE WHEN share >= 1e-8 THEN share * t ELSE 0 END AS n FROM members m LEFT JOIN em USING (cluster_id, path_id) LEFT JOIN total USING (cluster_id))
SELECT name AS "Name", cluster_id + 1 AS "ClusterID", 1000.0::DOUBLE AS "Length", e AS "EffectiveLength", round(coalesce(n, 0), 3) AS "ReadCount", round(coalesce(n, 0) / e / (SELECT sum(n / e) FROM c) * 1e6, 2) AS "TPM" FROM c
UNION ALL SELECT 'Unknown', 0, 0, 0, (SELECT round(sum(share * t), 3) FROM em JOIN total USING (cluster_id) WHERE path_id = -1 OR share < 1e-8), 0""")
def abundances(spark, sf):
    """Expected counts and TPM of all paths, by EM run to convergence in every cluster."""
    own = members(spark, sf)
    found = stored(inference.infer(path_probs_of(spark, sf), own.select("cluster_id", "path_id", "source_count", "group_id", "source_ids"), EngineConfig(model="transcripts", prob_precision=EXACT)), "abundances")
    counts = own.join(inference.path_abundances(found), ["cluster_id", "path_id"])
    out = sinks.abundance_table(found, own, inference.tpm_denominator(counts), inference.unknown_count(found))
    return out.withColumns({"ReadCount": F.round("ReadCount", 3), "TPM": F.round("TPM", 2)})


COVER = """live AS (SELECT cluster_id, read_class_id, read_count, list(path_id) AS paths FROM normal WHERE pn > 0 AND noise_prob < 1 - 1e-12 GROUP BY 1, 2, 3),
weight AS (SELECT cluster_id, path_id, -sum(ln(pn) * read_count) AS w FROM normal WHERE pn > 0 AND noise_prob < 1 - 1e-12 GROUP BY 1, 2),
cover AS (SELECT DISTINCT cluster_id, CAST([] AS BIGINT[]) AS chosen, 0 AS it FROM live
  UNION ALL SELECT cluster_id, list_append(any_value(chosen), first(path_id ORDER BY gain / w DESC, path_id)), any_value(it) + 1 FROM (
    SELECT g.cluster_id, any_value(chosen) AS chosen, any_value(it) AS it, path_id, sum(read_count) AS gain FROM (SELECT l.cluster_id, c.chosen, c.it, l.read_count, unnest(l.paths) AS path_id FROM live l JOIN cover c ON c.cluster_id = l.cluster_id WHERE NOT list_has_any(l.paths, c.chosen)) g GROUP BY g.cluster_id, path_id)
  JOIN weight USING (cluster_id, path_id) GROUP BY cluster_id),
chosen AS (SELECT cluster_id, unnest(chosen) AS path_id FROM (SELECT cluster_id, chosen FROM cover QUALIFY it = max(it) OVER (PARTITION BY cluster_id))),
own AS (SELECT n.cluster_id, n.read_class_id, n.read_count, n.noise_prob, n.path_id, n.pn / sum(n.pn) OVER (PARTITION BY n.cluster_id, n.read_class_id) * (1 - n.noise_prob) AS prob FROM normal n JOIN chosen USING (cluster_id, path_id) WHERE n.pn > 0)"""


@query("WITH RECURSIVE " + PROBS + ", " + MEMBERS + ", " + NORMAL + ", " + COVER + ", " + em_sql("SELECT cluster_id, read_class_id, read_count, path_id, prob FROM own UNION ALL SELECT DISTINCT cluster_id, read_class_id, read_count, -1, noise_prob FROM normal") + """
SELECT m.cluster_id, m.path_id, 1.0::DOUBLE AS posterior, round(CASE WHEN share >= 1e-8 THEN share * t ELSE 0 END, 3) AS read_count FROM members m LEFT JOIN em USING (cluster_id, path_id) LEFT JOIN total USING (cluster_id)""")
def strains(spark, sf):
    """The weighted minimum path cover, then EM over its paths."""
    own = members(spark, sf).select("cluster_id", "path_id", "source_count", "group_id", "source_ids")
    rows = stored(path_probs_of(spark, sf), "strain-probs")  # read more than once
    out = inference.path_abundances(inference.infer(rows, own, EngineConfig(model="strains", prob_precision=EXACT)))
    return out.withColumn("read_count", F.round("read_count", 3))


NESTED = """sources AS (SELECT s_suppkey % 5 AS cluster_id, s_suppkey AS path_id, unnest([s_suppkey % 7, 7 + s_suppkey % 3]) AS src FROM supplier),
kinds AS (SELECT cluster_id, list_sort(list(path_id)) AS paths FROM sources GROUP BY cluster_id, src),
haps AS (SELECT cluster_id, paths, count(*) AS n, row_number() OVER (PARTITION BY cluster_id ORDER BY paths) AS g FROM kinds GROUP BY 1, 2),
summed AS (SELECT p.cluster_id, p.read_class_id, p.read_count, p.noise_prob, g, sum(prob) AS s FROM probs p JOIN haps h ON h.cluster_id = p.cluster_id AND list_contains(h.paths, p.path_id) GROUP BY ALL),
scaled AS (SELECT *, s / sum(s) OVER (PARTITION BY cluster_id, read_class_id) * (1 - noise_prob) AS pn FROM summed),
freq AS (SELECT *, ln(n / CAST(sum(n) OVER (PARTITION BY cluster_id) AS DOUBLE)) AS f FROM haps),
pairs AS (SELECT a.cluster_id, a.g AS i, b.g AS j, list_sort(list_concat(a.paths, b.paths)) AS subset, a.f + b.f + CASE WHEN a.g = b.g THEN 0 ELSE ln(2.0::DOUBLE) END AS prior FROM freq a JOIN freq b ON a.cluster_id = b.cluster_id AND a.g <= b.g),
base AS (SELECT cluster_id, sum(read_count * ln(noise_prob)) AS ll FROM (SELECT DISTINCT cluster_id, read_class_id, read_count, noise_prob FROM probs) GROUP BY 1),
hit AS (SELECT p.cluster_id, p.i, p.j, r.read_class_id, any_value(r.read_count) AS c, any_value(r.noise_prob) AS n, sum(CASE WHEN r.g = p.i AND r.g = p.j THEN r.pn ELSE r.pn / 2 END) AS s FROM pairs p JOIN scaled r ON r.cluster_id = p.cluster_id AND r.g IN (p.i, p.j) GROUP BY 1, 2, 3, 4),
ll AS (SELECT p.cluster_id, p.i, p.j, any_value(p.subset) AS subset, any_value(p.prior) + any_value(b.ll) + coalesce(sum(h.c * (ln(h.n + h.s) - ln(h.n))), 0) AS l FROM pairs p JOIN base b USING (cluster_id) LEFT JOIN hit h USING (cluster_id, i, j) GROUP BY 1, 2, 3),
post AS (SELECT *, exp(l - m) / sum(exp(l - m)) OVER (PARTITION BY cluster_id) AS p FROM (SELECT *, max(l) OVER (PARTITION BY cluster_id) AS m FROM ll) WHERE l >= m + ln(0.001)),
subsets AS (SELECT *, row_number() OVER () AS sid FROM (SELECT cluster_id, subset, sum(p) / sum(sum(p)) OVER (PARTITION BY cluster_id) AS weight FROM post WHERE p >= 0.001 GROUP BY 1, 2) WHERE weight >= 0.001),
own AS (SELECT s.sid, p.read_class_id, p.read_count, p.noise_prob, p.path_id, p.prob / sum(p.prob) OVER (PARTITION BY s.sid, p.read_class_id) * (1 - p.noise_prob) AS prob FROM subsets s JOIN probs p ON p.cluster_id = s.cluster_id AND list_contains(s.subset, p.path_id))"""


@query("WITH RECURSIVE " + PROBS + ", " + NESTED + ", " + em_sql("SELECT sid AS cluster_id, read_class_id, read_count, path_id, prob FROM own UNION ALL SELECT DISTINCT s.sid, read_class_id, read_count, -1, noise_prob FROM subsets s JOIN probs p ON p.cluster_id = s.cluster_id") + """,
each AS (SELECT DISTINCT cluster_id, sid, weight, unnest(subset) AS path_id FROM subsets)
SELECT e.cluster_id, e.path_id, round(sum(weight), 5) AS posterior, round(sum(weight * CASE WHEN share >= 1e-8 THEN share * t ELSE 0 END), 2) AS read_count FROM each e LEFT JOIN em ON em.cluster_id = e.sid AND em.path_id = e.path_id LEFT JOIN total ON total.cluster_id = e.sid GROUP BY 1, 2""")
def nested_collapsed(spark, sf):
    """Likely pairs of haplotypes first, then EM over the paths of each, weighted."""
    own = members(spark, sf).select("cluster_id", "path_id", "source_count", "group_id", "source_ids")
    out = inference.path_abundances(inference.infer(path_probs_of(spark, sf), own, EngineConfig(model="haplotype-transcripts", path_info=True, prob_precision=EXACT)))
    return out.select("cluster_id", "path_id", F.round("posterior", 5).alias("posterior"), F.round("read_count", 2).alias("read_count"))


@query("""WITH m AS (SELECT s_suppkey % 5 AS cluster_id, s_suppkey AS path_id, s_suppkey // 10 AS transcript, 1000 + s_suppkey AS length, 100 + 7 * (s_suppkey % 13) AS e, 1 + s_suppkey % 3 AS w FROM supplier)
SELECT cluster_id, CAST(transcript AS VARCHAR) AS name, min(path_id) AS path_id, CAST(round(sum(w * length) / sum(w)) AS BIGINT) AS length, round(sum(w * e) / CAST(sum(w) AS DOUBLE), 9) AS effective_length, CAST(sum(w) AS BIGINT) AS source_count FROM m GROUP BY 1, transcript""")
def collapsed_paths(spark, sf):
    """Paths of a transcript in a cluster as one, lengths weighted by the haplotypes."""
    own = members(spark, sf).withColumn("transcript", F.col("group_id").cast("string")).withColumn("length", 1000 + F.col("path_id"))
    return clusters.collapsed(own).select("cluster_id", "name", "path_id", "length", F.round("effective_length", 9).alias("effective_length"), "source_count")


@query("WITH " + PROBS + ", t AS (SELECT sum(read_count) AS n FROM (SELECT DISTINCT cluster_id, read_class_id, read_count FROM probs)) SELECT s AS sample, CAST(n AS DOUBLE) + 7 AS total FROM t, range(1, 4) r(s)")
def gibbs_totals(spark, sf):
    """Every sample of the Gibbs table holds all reads, the unknown ones included; 7 reads are unaligned."""
    own = members(spark, sf).select("cluster_id", "path_id", "source_count", "group_id", "source_ids")
    out = stored(inference.infer(path_probs_of(spark, sf), own, EngineConfig(model="transcripts", num_gibbs_samples=3)), "gibbs")
    rows = sinks.gibbs_table(out, members(spark, sf), 3, inference.unknown_samples(out, 3, 7))
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("sample"), F.col(f"ReadCountSample_{i}").alias("n")) for i in (1, 2, 3)]))
    return rows.select(each.alias("x")).groupBy("x.sample").agg(F.round(F.sum("x.n"), 3).alias("total"))


@query("WITH " + STEPS + ", b AS (SELECT path_id, node_id, is_reverse FROM steps UNION ALL SELECT path_id, node_id, NOT is_reverse FROM steps) SELECT DISTINCT path_id FROM b WHERE node_id % 50 = 11 AND NOT is_reverse")
def bidirectional_locate(spark, sf):
    """Paths that visit some nodes in either orientation, found in one orientation of an index of both."""
    both = paths.both_orientations(steps(spark, sf))
    return paths.locate(both.where("node_id % 50 = 11 AND NOT is_reverse"), bidirectional=True)


# ---- samplers against what they converge to

NEAR = 0.08  # of a posterior: some three standard errors of the chains' frequencies, which depend on one another


@query("WITH " + POSTERIOR + ", p AS (SELECT cluster_id, i, j, exp(l - m) / sum(exp(l - m)) OVER (PARTITION BY cluster_id) AS posterior FROM top WHERE l >= m + ln(1e-8)) SELECT cluster_id, i AS first, j AS second, true AS near FROM p WHERE posterior >= 0.1")
def sampled_posteriors(spark, sf):
    """Every likely pair of paths is sampled about as often as its exact posterior says."""
    own = members(spark, sf).select("cluster_id", "path_id", "source_count", "group_id", "source_ids")
    rows = stored(path_probs_of(spark, sf), "sampled-probs")

    def pairs(**settings):
        out = inference.infer(rows, own, EngineConfig(model="haplotypes", **settings)).where("kind = 'group'")
        return out.select("cluster_id", F.get("path_ids", F.lit(0)).alias("first"), F.get("path_ids", F.lit(1)).alias("second"), "posterior")

    exact, drawn = pairs().where("posterior >= 0.1"), pairs(use_hap_gibbs=True).withColumnRenamed("posterior", "drawn")
    near = F.abs(F.col("posterior") - F.coalesce("drawn", F.lit(0.0))) < NEAR
    return exact.join(drawn, ["cluster_id", "first", "second"], "left").select("cluster_id", "first", "second", near.alias("near"))


#: With reads of one path each, and hardly any noise, shares are Dirichlet: means and variances of counts in closed form.
MOMENTS = """c AS (SELECT l_suppkey % 5 AS cluster_id, l_suppkey AS path_id, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY cluster_id) AS total, count(*) OVER (PARTITION BY cluster_id) + 1 AS k FROM c),
m AS (SELECT *, CAST(total AS DOUBLE) * (n + 1) / (total + k) AS mean FROM t)"""


@query("WITH " + MOMENTS + " SELECT cluster_id, path_id, round(mean, 6) AS mean, true AS near FROM m")
def gibbs_count_moments(spark, sf):
    """Means of sampled counts against those of the Dirichlet distribution that the samples come from."""
    samples, path = 200, F.col("l_suppkey")
    rows = stored(table(spark, sf, "lineitem").groupBy((path % 5).alias("cluster_id"), path.alias("path_id")).agg(F.count("*").alias("read_count")), "moment-rows")
    reads = rows.select("cluster_id", F.col("path_id").alias("read_class_id"), "read_count", F.lit(1e-12).alias("noise_prob"), "path_id", F.lit(1 - 1e-12).alias("prob"))
    own = rows.select("cluster_id", "path_id", F.lit(1).alias("source_count"), F.lit(0).cast("long").alias("group_id"), F.lit(None).cast("array<long>").alias("source_ids"))
    out = inference.infer(reads, own, EngineConfig(model="transcripts", num_gibbs_samples=samples, gibbs_thin_its=1)).where("kind = 'sample'")
    drawn = out.select("cluster_id", F.explode(F.arrays_zip("path_ids", "counts")).alias("x")).groupBy("cluster_id", F.col("x.path_ids").alias("path_id")).agg(F.avg("x.counts").alias("drawn"))
    return _moments(rows, samples).join(drawn, ["cluster_id", "path_id"], "left").select("cluster_id", "path_id", F.round("mean", 6).alias("mean"), (F.abs(F.col("drawn") - F.col("mean")) < 6 * F.col("error")).alias("near"))


def _moments(rows, samples: int):
    """(cluster_id, path_id, mean, error) of sampled counts of rows (cluster_id, path_id, read_count)."""
    whole = rows.withColumn("total", F.sum("read_count").over(Window.partitionBy("cluster_id"))).withColumn("k", F.count("*").over(Window.partitionBy("cluster_id")) + 1)
    alpha, weight = F.col("read_count") + 1.0, (F.col("total") + F.col("k")).cast("double")  # the cube of a few million is no long
    mean = F.col("total").cast("double") * alpha / weight
    error = F.col("total") * F.sqrt(alpha * (weight - alpha) / (weight * weight * (weight + 1)) / F.lit(samples))
    return whole.select("cluster_id", "path_id", mean.alias("mean"), error.alias("error"))


#: Noise in steps of 1 / 8192 and a precision of 5 of them: values on both sides of any rounding bound, and chains of near ones.
@query("""WITH r AS (SELECT l_suppkey % 5 AS c, l_suppkey % 50 AS p, l_orderkey * 7 % 1021 AS k, 1 + l_linenumber % 3 AS n FROM lineitem),
s AS (SELECT c, p, list_reduce(list_transform(list_sort(list(DISTINCT k)), lambda k: [k]), lambda stand, k: CASE WHEN k[1] - stand[-1] < 5 THEN stand ELSE list_concat(stand, k) END) AS stand FROM r GROUP BY 1, 2),
m AS (SELECT c, p, n, list_max(list_filter(stand, lambda x: x <= k)) AS k FROM r JOIN s USING (c, p)) SELECT c AS cluster_id, p AS path_id, k / 8192.0::DOUBLE AS noise, CAST(sum(n) AS BIGINT) AS read_count FROM m GROUP BY 1, 2, 3""")
def merge_within_precision(spark, sf):
    """Read classes whose noise is nearer than the precision to that of the class that stands become one with it."""
    supplier, noise = F.col("l_suppkey"), (F.col("l_orderkey") * 7 % 1021) / F.lit(8192.0)
    rows = table(spark, sf, "lineitem").select((supplier % 5).alias("cluster_id"), F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice").alias("read_class_id"), (1 + F.col("l_linenumber") % 3).cast("long").alias("read_count"), noise.alias("noise_prob"), (supplier % 50).alias("path_id"), F.lit(0.5).alias("prob"))
    return probs.merge_identical(rows, 5 / 8192).select("cluster_id", "path_id", F.col("noise_prob").alias("noise"), "read_count")


# ---- components with a hub, and in increments

#: Customers of orders, and a vertex 0 to which every third order is tied.
HUBS = COMPONENTS.format(a="a", b="b", t="(SELECT o_orderkey AS a, 1000000000 + o_custkey AS b FROM orders UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderkey % 3 = 0)") + "SELECT id AS vertex, comp AS component FROM cc"


def _hub_edges(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("a"), (1_000_000_000 + F.col("o_custkey")).alias("b")).union(o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit(0).cast("long")))


@query(HUBS)
def hub_components(spark, sf):
    """A vertex with a third of all edges."""
    return connected_components(_hub_edges(spark, sf), "a", "b").select("vertex", "component")


@query(HUBS)
def components_in_increments(spark, sf):
    """The same graph in three parts: each extends the components of those before."""
    edges = _hub_edges(spark, sf)
    found = stored(connected_components(edges.where("a % 4 < 2"), "a", "b"), "increment")
    for rest in (2, 3):
        found = stored(extended_components(found, edges.where(f"a % 4 = {rest}"), "a", "b"), "increment")
    return found
