"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into m segments, and every segment is indexed. A query looks up its segments with growing
radius: if all segments have been searched to radius r, every code within Hamming distance m (r + 1) - 1 has
been met; if the first j + 1 segments have been searched to radius r and the others to r - 1, every code
within m r + j. So a query whose k-th verified distance is known looks up only the segments that cover it,
and is done then. Candidates are verified by the distance of the whole codes, bucket by bucket, and only
those that can be in an answer become rows. Queries whose neighbours lie so far that a radius has too many masks go on in
an index of narrower segments, in which every radius can be enumerated; no query is ever compared with all codes as such.

Equal codes are one entry of the index, which keeps as many of its smallest ids as an answer can hold, and
equal queries are searched once: a code that a third of all rows share costs no more than another.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathquant.llm.common import stored

PROBES = 20_000  # masks of one radius; a search that needs more goes on in segments of at most FINE bits
FINE = 8  # bits: 256 values at most, so every radius can be enumerated
BLOCK_CODES = 1 << 16  # a bucket may be split into one block for so many codes of the whole index


def segments_for(n: int, k: int, bits: int) -> int:
    """Number of segments with the least estimated work for n codes that are spread evenly.

    The k-th neighbour's distance follows from the binomial distribution. Work is the lookups that cover it
    and, at 0.3 each, the codes met.
    """
    d, reached = 0, 0.0
    while d < bits:
        reached += n * comb(bits, d) / 2**bits
        if reached > k:
            break
        d += 1
    best = (float("inf"), 1)
    for m in range(1, min(16, bits) + 1):
        w = -(-bits // m)
        a, j = divmod(d, m)
        probes = m * sum(comb(w, i) for i in range(min(a, w + 1))) + (j + 1) * (comb(w, a) if a <= w else 0)
        best = min(best, (probes * (1 + 0.3 * n / 2**w), m))
    return best[1]


def sign_code(column):
    """64-bit code of the signs of a vector's numbers; null for a null vector, an error for a vector of more than 64."""
    whole = F.when(F.size(column) > 64, F.raise_error(F.lit("sign_code takes vectors of at most 64 numbers"))).otherwise(column)
    bits = F.transform(whole, lambda x, i: F.when(x > 0, F.expr("1L") * F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _distance(a, b):
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def top_k(rows: DataFrame, queries: DataFrame, *, id_col: str, code_col: str, k: int = 10, bits: int = 64, segments: int | None = None) -> DataFrame:
    """(query_id, rank, id, distance): for every query row the k rows nearest by Hamming distance, itself left out.

    Ties go to the smaller id. Rows with a null code or id are neither found nor answered. Repeated rows of
    one id are one row. If fewer than k other rows exist, all are returned. Empty tables give an empty result.
    """
    spark = rows.sparkSession
    known = rows.where(F.col(code_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(code_col).alias("code")).distinct()
    place = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    # partial minima first: a code's rows are cut to its k + 1 smallest ids of each salt before they meet
    salted = known.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = salted.withColumn("place", F.row_number().over(Window.partitionBy("code", "salt").orderBy("id"))).where(F.col("place") <= k + 1)
    members = stored(few.withColumn("place", place).where(F.col("place") <= k + 1).select("code", "id", "place"), "hamming-members")
    codes = stored(members.groupBy("code").agg(F.count("*").alias("ids")), "hamming-codes")
    n = codes.count()
    blocks = max(1, n // BLOCK_CODES)
    asked = queries.where(F.col(code_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("query_id"), F.col(code_col).alias("query")).distinct()
    asked = stored(asked, "hamming-queries")
    # reach: the distance within which k others and the query itself are known to lie
    open_ = stored(asked.select("query").distinct().withColumn("reach", F.lit(bits)), "hamming-open")
    found = done = None  # (query, code, ids, distance)

    def segment(code, low: int, size: int):
        return F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << size) - 1)) if size < 64 else code

    def near(met: DataFrame) -> DataFrame:
        """(query, code, ids, distance) of a bucket's codes that are within reach and among its k + 1 nearest, ties kept."""
        all_ = F.transform("codes", lambda c: F.struct(_distance(F.col("query"), c["code"]).alias("distance"), c["code"].alias("code"), c["ids"].alias("ids")))
        met = met.withColumn("all", F.filter(all_, lambda x: x["distance"] <= F.col("reach")))
        last = F.get(F.array_sort(F.transform("all", lambda x: x["distance"])), F.lit(k))
        met = met.withColumn("last", last).withColumn("x", F.explode(F.filter("all", lambda x: F.col("last").isNull() | (x["distance"] <= F.col("last")))))
        return met.select("query", "x.code", "x.ids", "x.distance")

    for m in (segments or segments_for(n, k, bits), -(-bits // FINE)):
        if open_.isEmpty():
            break
        width = -(-bits // m)
        cut = [(j, width * j, min(width, bits - width * j)) for j in range(m) if width * j < bits]
        m = len(cut)
        cells = codes.select("code", "ids", F.posexplode(F.array(*[segment(F.col("code"), low, size) for _, low, size in cut])).alias("seg", "value"))
        cells = cells.withColumn("block", F.pmod(F.xxhash64("code"), F.lit(blocks)))
        index = stored(cells.groupBy("seg", "value", "block").agg(F.collect_list(F.struct("code", "ids")).alias("codes")).drop("block"), "hamming-index")
        parts = F.array(*[segment(F.col("query"), low, size) for _, low, size in cut])
        radius = 0
        while sum(comb(size, radius) for *_, size in cut) <= PROBES and not open_.isEmpty():
            masks = [(j, sum(1 << b for b in c)) for j, _, size in cut for c in combinations(range(size), radius)]
            probes = spark.createDataFrame(masks, "seg int, mask long")  # PROBES rows at most
            # the segments that must be searched to this radius to cover the reach
            needed = F.least(F.col("reach") - m * radius, F.lit(m - 1))
            looked = open_.where(F.col("reach") >= m * radius).withColumn("parts", parts).withColumn("seg", F.explode(F.sequence(F.lit(0), needed)))
            looked = looked.join(F.broadcast(probes), "seg").select("query", "reach", "seg", F.get("parts", F.col("seg")).bitwiseXOR(F.col("mask")).alias("value"))
            met = near(looked.join(index, ["seg", "value"]))
            if found is not None:
                met = met.unionByName(found.join(open_.select("query"), "query", "left_semi"))
            nearer = F.sum("ids").over(Window.partitionBy("query").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1))
            found = stored(met.distinct().withColumn("nearer", F.coalesce(nearer, F.lit(0))).where(F.col("nearer") <= k).drop("nearer"), "hamming-found")
            covered = bits if radius >= width else m * (radius + 1) - 1
            within = Window.partitionBy("query").orderBy("distance").rangeBetween(Window.unboundedPreceding, 0)
            known = found.withColumn("within", F.sum("ids").over(within)).where(F.col("within") > k).groupBy("query").agg(F.min("distance").alias("now"))
            state = stored(open_.join(known, "query", "left").select("query", F.coalesce("now", F.lit(bits)).alias("reach"), (F.coalesce("now", F.lit(bits)) <= covered).alias("ready")), "hamming-state")
            closed = found.join(state.where("ready").select("query"), "query", "left_semi")
            done = closed if done is None else done.unionByName(closed)
            open_ = state.where("NOT ready").select("query", "reach")
            radius += 1
    if done is None:
        done = spark.createDataFrame([], "query long, code long, ids long, distance int")
    answers = asked.join(done, "query").join(members, "code").where(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def op8_multi_index_hashing(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", sign_code(F.col("embedding")).alias("code"))
    out = top_k(rows, rows.where(F.col("vec_id") % 100 == 0), id_col="vec_id", code_col="code")
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(len(list_filter(range(1, 65), lambda i: q.b[i] <> e.b[i])) AS INTEGER) AS distance
      FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance
FROM p QUALIFY rank <= 10
"""
