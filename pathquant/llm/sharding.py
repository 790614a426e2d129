"""Sharding by histogram sort, with DataFrame functions only.

Documents are ordered by (group key, document key): the first 60 bits of the MD5 of the text, and of the id and text.
The splitters between shards start as wide key ranges. Each round counts the exact bytes below every candidate boundary
inside the open ranges (a partial aggregate per partition, at most a few thousand counts in all) and narrows
them, until every splitter meets the tolerance: the next edge of a group, or of a document in a group that is split,
for a tolerance of 0, which a few more rounds over ever fewer rows reach. Then the rows are exchanged once.

Equal texts share the group key, so a splitter prefers the edge of a group. A group of more than
``group_limit`` of a shard is split inside by the document key, as one shard cannot hold it and stay level.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathquant.llm.common import stored

BITS = 60
FIRST, STEP = 12, 8  # bits of the first histogram and of each refinement
CELL_ROWS = 4096


def _splitters(rows: DataFrame, total: int, shards: int, tolerance: float, group_limit: float) -> list[tuple[int, int]]:
    """(group key, document key) from which each shard but the first begins."""
    share = total / shards
    tol, limit = tolerance * share, group_limit * share
    done: dict[int, tuple[int, int]] = {}
    # splitter -> (start of its open range in group keys, bytes below it)
    open_ = {i: (0, 0) for i in range(1, shards)}
    inside: dict[int, tuple[int, int, int]] = {}  # splitter -> (group key, start in document keys, bytes below)
    shift, before = BITS - FIRST, BITS
    while open_ and before > 0:
        cells = rows if before == BITS else rows.where(F.shiftright("k1", before).isin(sorted({lo >> before for lo, _ in open_.values()})))
        counts = sorted(cells.groupBy(F.shiftright("k1", shift).alias("cell")).agg(F.sum("size"), F.min("k1"), F.max("k1")).collect())
        for i, (lo, below) in list(open_.items()):
            mine = [c for c in counts if lo <= c[0] << shift < lo + (1 << before)]
            if not mine:
                done[i] = (lo, 0)
                del open_[i]
                continue
            starts = list(accumulate((c[1] for c in mine), initial=below))
            goal = share * i
            j = next((j for j in range(len(mine)) if starts[j + 1] >= goal), len(mine) - 1)
            cell, size, least, most = mine[j]
            edges = [(abs(starts[j] - goal), cell << shift), (abs(starts[j + 1] - goal), (cell + 1) << shift)]
            if min(edges)[0] <= tol or (least == most and size <= limit):
                done[i] = (min(edges)[1], 0)
                del open_[i]
            elif least == most:
                inside[i] = (least, 0, starts[j])
                del open_[i]
            else:
                open_[i] = (cell << shift, starts[j])
        before, shift = shift, max(0, shift - STEP)
    done |= {i: (lo, 0) for i, (lo, _) in open_.items()}

    shift, before = BITS - FIRST, BITS
    while inside and before > 0:
        cells = rows.where(F.col("k1").isin(sorted({k for k, _, _ in inside.values()})))
        if before < BITS:
            cells = cells.where(F.shiftright("k2", before).isin(sorted({lo >> before for _, lo, _ in inside.values()})))
        counts = sorted(cells.groupBy("k1", F.shiftright("k2", shift).alias("cell")).agg(F.sum("size"), F.count("*")).collect())
        for i, (key, lo, below) in list(inside.items()):
            mine = [c for c in counts if c[0] == key and lo <= c[1] << shift < lo + (1 << before)]
            starts = list(accumulate((c[2] for c in mine), initial=below))
            goal = share * i
            j = next((j for j in range(len(mine)) if starts[j + 1] >= goal), len(mine) - 1)
            edges = [(abs(starts[j] - goal), mine[j][1] << shift), (abs(starts[j + 1] - goal), (mine[j][1] + 1) << shift)]
            if min(edges)[0] <= tol or mine[j][3] == 1 or shift == 0:
                done[i] = (key, min(edges)[1])
                del inside[i]
            else:
                inside[i] = (key, mine[j][1] << shift, starts[j])
        before, shift = shift, max(0, shift - STEP)
    return [done[i] for i in range(1, shards)]


def shard(docs: DataFrame, *, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.0, group_limit: float = 0.1) -> DataFrame:
    """Returns id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Size is the UTF-8 bytes of the text plus 1. A null text counts as an empty one; null ids are ordered
    by their text. Repeated rows each get a slot of their own, and lie in one shard. Slots run without a gap from 0
    in each shard, in the order of the document key, which is a shuffled order. Texts are hashed whole, however long,
    and not shuffled. An empty table gives an empty result. Other columns are not read, so their names cannot clash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def key(column):
        return F.conv(F.substring(column, 1, BITS // 4), 16, 10).cast("long")

    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text.cast("binary")).alias("digest"))
    both = F.md5(F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("null")), "digest").cast("binary"))
    rows = stored(rows.select("id", "size", "text_crc32", key(F.col("digest")).alias("k1"), key(both).alias("k2")), "shard-rows")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    splitters = _splitters(rows, total, shards, tolerance, group_limit) if n else []

    reached = [((F.col("k1") > a) | ((F.col("k1") == a) & (F.col("k2") >= b))).cast("int") for a, b in splitters]
    bits = max(0, min(20, (n // (shards * CELL_ROWS)).bit_length()))
    placed = rows.withColumn("shard", sum(reached, F.lit(0)).cast("int")).withColumn("cell", F.shiftright("k2", BITS - bits))
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("in_cell"))
    by_cell = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("in_cell").over(by_cell), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "cell").orderBy("k2", "id", "k1")
    out = placed.join(starts, ["shard", "cell"]).withColumn("slot", F.col("start") + F.row_number().over(order) - 1)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_histogram_sort(spark, sf_dir):
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Groups are texts, edges[i] lie around the goals; a group of more than a tenth of a shard is split between documents.
ORACLE = """
WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS t, md5(coalesce(text, '')) AS digest FROM documents),
k AS (SELECT doc_id, size, t, CAST('0x' || substr(digest, 1, 15) AS BIGINT) AS k1, CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), 'null'), digest)), 1, 15) AS BIGINT) AS k2 FROM d),
n AS (SELECT sum(size) / 16.0::DOUBLE AS share FROM k),
g AS (SELECT k1, sum(size) AS size, sum(sum(size)) OVER (ORDER BY k1) AS upto, lead(k1) OVER (ORDER BY k1) AS following FROM k GROUP BY k1),
goals AS (SELECT i, i * share AS goal, share FROM range(1, 16) r(i), n),
hit AS (SELECT i, goal, share, k1, size, upto, following FROM goals JOIN g ON upto >= goal AND upto - size < goal),
inside AS (SELECT a.i, a.goal, k.k1, k.k2, sum(sum(k.size)) OVER (PARTITION BY a.i ORDER BY k.k2) + any_value(a.upto - a.size) AS upto, sum(k.size) AS size, lead(k.k2) OVER (PARTITION BY a.i ORDER BY k.k2) AS following FROM hit a JOIN k USING (k1) WHERE a.size > 0.1 * a.share GROUP BY a.i, a.goal, k.k1, k.k2),
s AS (SELECT i, CASE WHEN goal - (upto - size) <= upto - goal THEN k1 ELSE following END AS k1, 0 AS k2 FROM hit WHERE size <= 0.1 * share
  UNION ALL SELECT i, k1, CASE WHEN goal - (upto - size) <= upto - goal THEN k2 ELSE k2 + 1 END FROM inside WHERE upto >= goal AND upto - size < goal),
p AS (SELECT k.*, (SELECT count(*) FROM s WHERE k.k1 > s.k1 OR (k.k1 = s.k1 AND k.k2 >= s.k2)) AS shard FROM k),
c AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS bytes FROM range(0, 256) r(i)),
h AS (SELECT k.t AS own, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(k.t)), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, b: xor(a >> 8, bytes[xor(a, b) % 256 + 1]))) AS crc32 FROM (SELECT DISTINCT t FROM k) k, c)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc32 AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY k2, doc_id, k1) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p JOIN h ON own = t
"""
