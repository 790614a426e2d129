"""Mixing sources to target weights by weighted fair queueing.

Every document enters the queue of its source in a shuffled order. An entry's virtual finish time is
the source's cumulative size up to and with that entry, divided by the source's target; a source that
must repeat enters its documents again, epoch after epoch. Entries are ordered by finish time over all
sources and the order is truncated at the total budget.

A source's running sum is a two-level prefix sum (sums of buckets, then a window inside one bucket), so no
source, however large, lands in one task. The place in the global order where the budget ends is found by
counting sizes in equal ranges of virtual time, again and again inside the range that holds it, until few
entries are left to be sorted. What a source gives in an epoch is then known by the last of its entries that
is taken, so the rows themselves are compared with that one and never shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathquant.llm.common import stored, word_count

RANGES = 4096  # ranges of virtual time in which sizes are counted at once
SORTED = 10_000  # entries that one task sorts in the end
SOURCES = 100_000  # sources whose facts (some 300 bytes each) are broadcast at most; beyond, rows meet them in salted tasks
SALTS = 16
BUCKET_ROWS = 1_000  # rows of one source in one window, while there are at most 65,536 windows


def targets(sizes: DataFrame, budget_share: float = 1.0, weights=(1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source, source_size) -> + rank, weight, target. One row per source, so the windows are small.

    Sources by code point, null last, get the weights in turn. The budget is split by weight; a source gets
    max_epochs times its size at most and the excess is shared again by weight among the others. In the
    order of size to weight, capped sources come first, which makes the result a closed form.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cases = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(order)).withColumn("weight", cases.cast("long"))
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("rank").asc())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    cap = F.col("source_size") * max_epochs
    level = (F.sum("source_size").over(Window.partitionBy()) * F.lit(budget_share) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(after)
    out = ranked.withColumn("cap", cap).withColumn("level", level)
    free = F.col("cap") > F.col("level") * F.col("weight")
    # the first source that is not capped sets the level of all that follow
    shared = F.min(F.when(free, F.struct(F.col("source_size") / F.col("weight"), "rank", "level"))).over(Window.partitionBy())["level"]
    capped = shared.isNull() | (F.col("cap") <= shared * F.col("weight"))
    return out.withColumn("target", F.when(capped, F.col("cap").cast("double")).otherwise(shared * F.col("weight"))).drop("cap", "level", "weight")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget_share: float = 1.0, weights=(1, 2, 3), max_epochs: int = 3, seed: int = 0, keep: bool = False) -> DataFrame:
    """Returns id, size, source_size, target, taken, copies for every row; with keep, also ``row``, a struct of the input's columns.

    Nulls: a null text has size 0 and is never taken; a null source is a source of its own, ordered last; a
    null id is shuffled by its text. Repeated rows are queued one by one. Ties in finish time go by source,
    then shuffle key. An empty table gives an empty result. Extra columns may have any name: they are only
    carried inside ``row``. Texts are counted whole, however long. Reruns agree, as the shuffle is a hash of seed, id
    and text; which of repeated rows is taken once more than another is left open.
    """
    ident, text = F.col(id_col), F.col(text_col)
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(ident.cast("string"), F.lit("null")), F.md5(F.coalesce(text.cast("binary"), F.lit(b"")))).cast("binary"))
    keyed = docs.select(ident.alias("id"), text.alias("text"), F.col(source_col).alias("source"), key.alias("key"), *([F.struct("*").alias("row")] if keep else []))

    def sized(df: DataFrame) -> DataFrame:
        return df.select("id", word_count("text").alias("size"), "source", "key", *(["row"] if keep else []))

    facts = stored(sized(keyed).drop("row"), "mix-facts")

    sizes = facts.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = stored(targets(sizes, budget_share, weights, max_epochs), "mix-sources")
    totals = sources.agg(F.sum("source_size"), F.sum("n"), F.count("*")).first()
    budget, rows = (totals[0] or 0) * budget_share, totals[1] or 0
    buckets = max(1, min(65_536, rows // BUCKET_ROWS))

    high = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    bucketed = facts.withColumn("bucket", F.floor(high * buckets / F.lit(2**32)))
    sums = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(by_bucket), F.lit(0)).alias("before"))
    sums = stored(sums.alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.*", "s.source_size", "s.rank", "s.target"), "mix-buckets")

    # cum: the source's size up to and with the row; tie: which of the rows of one key
    inside = Window.partitionBy("source", "bucket").orderBy("key")
    queued = bucketed.where("size > 0").alias("r").join(sums.where("target > 0").alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.bucket") == F.col("s.bucket")))
    queued = queued.select("r.*", "s.before", "s.source_size", "s.rank", "s.target").withColumn("place", F.row_number().over(inside)).withColumn("tie", F.col("place") - F.rank().over(inside) + 1)
    queued = queued.withColumn("cum", F.col("before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    entries = queued.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))).withColumn("finish", (F.col("cum") + F.col("source_size") * F.col("epoch")) / F.col("target"))
    entries = stored(entries.select("finish", "rank", "key", "tie", F.col("epoch").cast("int").alias("epoch"), "size"), "mix-entries")

    last = entries.where(_taken(entries, budget)).groupBy("rank", "epoch").agg(F.max(F.struct("key", "tie")).alias("last"))
    ends = last.groupBy("rank").agg(*[F.max(F.when(F.col("epoch") == e, F.col("last"))).alias(f"last_{e}") for e in range(max_epochs)])
    ends = stored(sources.select("source", "source_size", "target", "rank").join(ends, "rank", "left").drop("rank"), "mix-ends")

    def met(df: DataFrame) -> DataFrame:
        if totals[2] <= SOURCES:
            return df.alias("r").join(F.broadcast(ends.alias("s")), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", "s.source_size", "s.target", *[f"s.last_{e}" for e in range(max_epochs)])
        salted = df.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS))).alias("r")
        spread = ends.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("s")
        return salted.join(spread, F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.salt") == F.col("s.salt"))).select("r.*", "s.source_size", "s.target", *[f"s.last_{e}" for e in range(max_epochs)])

    def copies(tie):
        entry = F.struct(F.col("key").alias("key"), tie.cast("int").alias("tie"))
        return F.when(F.col("size") > 0, sum((F.when(entry <= F.col(f"last_{e}"), 1).otherwise(0) for e in range(max_epochs)), F.lit(0))).otherwise(0)

    # only rows of the key at which a source ends need to know which of their equals they are: they are numbered apart
    keys = ends.select(F.explode(F.array(*[F.col(f"last_{e}")["key"] for e in range(max_epochs)])).alias("key")).where("key IS NOT NULL").distinct()
    keys = F.broadcast(keys) if totals[2] <= SOURCES else keys
    equals = Window.partitionBy("source", "key").orderBy("key")
    clear = met(sized(keyed) if keep else facts)
    for e in range(max_epochs):
        clear = clear.where(~F.coalesce(F.col("key") == F.col(f"last_{e}")["key"], F.lit(False)))
    edge = met(sized(keyed.join(keys, "key", "left_semi")) if keep else facts.join(keys, "key", "left_semi"))
    at_end = reduce(or_, [F.coalesce(F.col("key") == F.col(f"last_{e}")["key"], F.lit(False)) for e in range(max_epochs)])
    clear, edge = clear.withColumn("copies", copies(F.lit(1))), edge.where(at_end).withColumn("copies", copies(F.row_number().over(equals)))
    out = clear.unionByName(edge)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("copies").cast("int").alias("copies"), *(["row"] if keep else []))


def _taken(entries: DataFrame, budget: float):
    """Whether an entry lies before the place, in the order of finish, rank, key, tie and epoch, where the budget ends."""
    n, low, high, before = entries.agg(F.count("*"), F.min("finish"), F.max("finish"), F.lit(0)).first()
    while n > SORTED and low < high:
        cell = F.least(F.floor((F.col("finish") - low) / F.lit(high - low) * RANGES), F.lit(RANGES - 1))
        cells = entries.where(F.col("finish").between(low, high)).groupBy(cell.alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("finish").alias("low"), F.max("finish").alias("high"))
        for c in sorted(cells.collect()):  # RANGES rows at most
            if before + c["size"] > budget:
                n, low, high = c["n"], c["low"], c["high"]
                break
            before += c["size"]
        else:
            return F.lit(True)  # the budget holds every entry
    if not n:
        return F.lit(True)
    place = F.struct("finish", "rank", "key", "tie", "epoch")
    inside = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    fits = entries.where(F.col("finish").between(low, high)).withColumn("cum", F.lit(before) + F.sum("size").over(inside)).where(F.col("cum") <= budget)
    cut = fits.agg(F.max(place).alias("cut")).first()["cut"]
    if cut is None:
        return F.col("finish") < low
    names = ("finish", "rank", "key", "tie", "epoch")
    limit = F.struct(*[F.lit(v).cast(entries.schema[c].dataType).alias(c) for c, v in zip(names, cut)])
    return (F.col("finish") < low) | (F.col("finish").between(low, high) & (place <= limit))


def op4_weighted_fair_queueing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).drop("copies")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws('|', '0', coalesce(CAST(doc_id AS VARCHAR), 'null'), md5(coalesce(text, '')))) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
w AS (SELECT *, (rk - 1) % 3 + 1 AS weight FROM r),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / CAST(sum(weight) OVER (ORDER BY source_size / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
f AS (SELECT level FROM l WHERE 3 * source_size > level * weight ORDER BY source_size / weight, rk LIMIT 1),
t AS (SELECT source, source_size, rk, CASE WHEN (SELECT level FROM f) IS NULL OR 3 * source_size <= (SELECT level FROM f) * weight
        THEN CAST(3 * source_size AS DOUBLE) ELSE (SELECT level FROM f) * weight END AS target FROM l),
q AS (SELECT d.*, t.source_size, t.rk, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT k, size, rk, epoch, (cum + source_size * epoch) / target AS finish FROM q, (VALUES (0), (1), (2)) AS x(epoch) WHERE size > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, rk, k, epoch ROWS UNBOUNDED PRECEDING) AS total FROM e),
c AS (SELECT k, count(*) AS copies FROM o WHERE total <= (SELECT sum(size) FROM d) GROUP BY k)
SELECT doc_id, size, source_size, target, CAST(size * coalesce(copies, 0) AS BIGINT) AS taken FROM q LEFT JOIN c USING (k)
"""
