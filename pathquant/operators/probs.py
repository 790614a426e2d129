"""Probabilities of paths given reads.

Input in long form: (cluster_id, read_class_id, read_count, min_mapq, noise_score, path_id, score_sum,
align_length, frag_length, effective_length [, source_count, transcript]).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathquant.config import NOISE_LOG_BASE, SCORE_LOG_BASE
from pathquant.functions import scoring
from pathquant.functions.fragments import FragmentDist, with_log_prob
from pathquant.plans.store import stored

READ = ["cluster_id", "read_class_id"]


def base_noise(min_mapq: Column, noise_score: Column, min_noise_prob: float, precision: float) -> Column:
    """Noise before paths of low probability are added: 1 at mapping quality 0."""
    floor = F.greatest(F.lit(precision), F.lit(min_noise_prob), scoring.phred_to_prob(min_mapq.cast("double")))
    return F.when(min_mapq <= 0, F.lit(1.0)).otherwise(floor + (1 - floor) * F.exp(F.lit(NOISE_LOG_BASE) * noise_score))


#: Rows that one task takes, about, and members of clusters that every task may hold.
TASK_ROWS, HELD_MEMBERS = 500_000, 1_000_000


def _by_read(rows: DataFrame, size: int | None) -> DataFrame:
    """Rows dealt by read, so that all that goes read by read needs no further exchange; many rows to tasks by their number.

    Without a number Spark puts partitions together by their bytes, which are small in an exchange, but not in memory.
    size: the number of rows where that is known; else they are counted, so they should be a table.
    """
    spark, parts = rows.sparkSession, -(-(rows.count() if size is None else size) // TASK_ROWS)
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(max(parts, few), *READ) if parts > 1 else rows.repartition(*READ)


def log_probs(rows: DataFrame, dist: FragmentDist, single_end: bool, size: int | None = None) -> DataFrame:
    """Best log probability of each (read, path): of the longest rows the most probable. Paths without length are left out.

    size: the number of rows, which are counted if it is not given.
    """
    rows = _by_read(rows, size)
    score = F.col("score_sum") * F.lit(SCORE_LOG_BASE) - F.ln("effective_length")
    rows = rows.where(F.col("effective_length") > 0)
    if not single_end:
        rows = with_log_prob(rows, "frag_length", dist)
        score = score + F.col("frag_log_prob")
    best = F.max(F.struct("align_length", score.alias("log_prob")))
    carried = [c for c in ("source_count", "transcript") if c in rows.columns]
    return rows.groupBy(*READ, "read_count", "min_mapq", "noise_score", "path_id", *carried).agg(best.alias("best")).withColumn("log_prob", F.col("best.log_prob")).drop("best")


def collapse(rows: DataFrame, group: str = "transcript") -> DataFrame:
    """Per read and group: log of the sum over its paths of probability times source count. path_id becomes the group."""
    weighted = F.col("log_prob") + F.ln(F.col("source_count").cast("double"))
    keys = [*READ, "read_count", "min_mapq", "noise_score", group]
    top = rows.withColumn("w", weighted).withColumn("m", F.max("w").over(Window.partitionBy(*keys)))
    out = top.groupBy(*keys).agg(F.first("m").alias("m"), F.sum(F.exp(F.col("w") - F.col("m"))).alias("s"))
    return out.withColumn("log_prob", F.col("m") + F.ln("s")).withColumnRenamed(group, "path_id").drop("m", "s")


def normalise(rows: DataFrame) -> DataFrame:
    """log_prob -> prob: softmax over the paths of a read."""
    read = Window.partitionBy(*READ)
    shifted = rows.withColumn("e", F.exp(F.col("log_prob") - F.max("log_prob").over(read)))
    return shifted.withColumn("prob", F.col("e") / F.sum("e").over(read)).drop("e", "log_prob")


def read_path_probs(rows: DataFrame, dist: FragmentDist, *, single_end: bool = False, min_noise_prob: float = 1e-4, precision: float = 1e-8, group: str | None = None, size: int | None = None) -> DataFrame:
    """(cluster_id, read_class_id, read_count, noise_prob, path_id, prob), with the probabilities of a read and its noise adding to 1.

    Probabilities under the precision go to the noise. A read that is all noise has one row with a null path. size: the number of rows, if known.
    """
    found = log_probs(rows, dist, single_end, size)
    if group:
        found = collapse(found, group)
    found = normalise(found).withColumn("base", base_noise(F.col("min_mapq"), F.col("noise_score"), min_noise_prob, precision))
    read = Window.partitionBy(*READ)
    low = F.sum(F.when(F.col("prob") < precision, F.col("prob")).otherwise(0.0)).over(read)
    live = (F.col("prob") >= precision) & (F.col("base") < 1)
    found = found.withColumn("noise_prob", F.when(F.col("base") >= 1, 1.0).otherwise(F.col("base") + low * (1 - F.col("base"))))
    found = found.withColumn("live", live).withColumn("any", F.max("live").over(read)).withColumn("place", F.row_number().over(read.orderBy("path_id")))
    found = found.where(F.col("live") | (~F.col("any") & (F.col("place") == 1)))
    return found.select(*READ, "read_count", "noise_prob", F.when(F.col("live"), F.col("path_id")).alias("path_id"), F.when(F.col("live"), F.col("prob") * (1 - F.col("base"))).alias("prob"))


def binned(pairs: Column, precision: float) -> Column:
    """Groups an array of (path_idx, prob), by path index, into (prob, members): a probability joins the first group
    whose running mean is nearer than the precision."""
    start = F.array().cast("array<struct<prob:double,paths:array<long>>>")

    def put(groups, p):
        at = F.array_position(F.transform(groups, lambda g: F.abs(g["prob"] - p["prob"]) < precision), True)
        joined = F.transform(groups, lambda g, i: F.when(i + 1 == at, F.struct(((g["prob"] * F.size(g["paths"]) + p["prob"]) / (F.size(g["paths"]) + 1)).alias("prob"), F.array_append(g["paths"], p["path_idx"].cast("long")).alias("paths"))).otherwise(g))
        new = F.array_append(groups, F.struct(p["prob"].cast("double").alias("prob"), F.array(p["path_idx"].cast("long")).alias("paths")))
        return F.when(at > 0, joined).otherwise(new)

    return F.array_sort(F.aggregate(F.array_sort(pairs), start, put))


def _segments(values: DataFrame, keys: list[str], value: str, out: str, precision: float) -> DataFrame:
    """Distinct values with the number of their segment: a gap of the precision or more begins a new one."""
    along = Window.partitionBy(*keys).orderBy(value)
    kinds = values.select(*keys, value).distinct()
    gap = F.coalesce(F.col(value) - F.lag(value).over(along) >= precision, F.lit(False)).cast("int")
    return kinds.withColumn("gap", gap).withColumn(out, F.sum("gap").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("gap")


def merge_identical(probs: DataFrame, precision: float = 1e-8) -> DataFrame:
    """Read classes of a cluster that have the same paths and, within the precision, equal probabilities become one.

    In the lexicographic order of noise and probabilities a class joins the last one that stands for others if all its
    numbers are nearer to that one's than the precision; what stands keeps its numbers and gets the counts. Equal
    classes are counted before anything is sorted. The others are dealt by their paths, and by noise and first probability
    as far as gaps of the precision part them: no two classes on both sides of a gap can be merged, nor do they come between others.
    """
    shape = F.array_sort(F.collect_list(F.when(F.col("path_id").isNotNull(), F.struct("path_id", "prob"))))
    lists = probs.groupBy(*READ).agg(shape.alias("shape"), F.first("noise_prob").alias("noise"), F.first("read_count").cast("long").alias("n"))
    equal = lists.groupBy("cluster_id", "shape", "noise").agg(F.min("read_class_id").alias("read_class_id"), F.sum("n").alias("n"))
    equal = equal.select("cluster_id", "read_class_id", "noise", "n", F.transform("shape", lambda x: x["path_id"]).alias("paths"), F.transform("shape", lambda x: x["prob"]).alias("probs"))
    equal = stored(equal.withColumn("path", F.coalesce(F.get("paths", F.lit(0)), F.lit(-1))).withColumn("prob", F.coalesce(F.get("probs", F.lit(0)), F.lit(0.0))), "merge-classes")
    parted = equal.join(_segments(equal, ["cluster_id"], "noise", "noise_segment", precision), ["cluster_id", "noise"])
    parted = parted.join(_segments(equal, ["cluster_id", "path"], "prob", "prob_segment", precision), ["cluster_id", "path", "prob"])
    group = ["cluster_id", "paths", "noise_segment", "prob_segment"]
    rows = parted.select(*group, "noise", "probs", "read_class_id", "n").repartition(*group).sortWithinPartitions(*group, "noise", "probs", "read_class_id")
    merged = rows.select("cluster_id", "read_class_id", "n", "paths", F.concat(F.array("noise"), "probs").alias("cells")).mapInArrow(_merge(precision), "cluster_id long, read_class_id long, read_count long")
    merged = merged.groupBy(*READ).agg(F.sum("read_count").alias("read_count"))  # a class may go on in the next batch
    return probs.drop("read_count").join(merged, READ).select(*probs.columns)


def _merge(precision: float):
    def run(batches):
        before = None  # cluster, paths, numbers and id of the class that stands now
        for batch in batches:
            if not batch.num_rows:
                continue
            clusters, ids, n = (batch.column(i).to_numpy() for i in range(3))
            paths, cells = batch.column(3), batch.column(4)
            sizes, bounds = np.diff(cells.offsets.to_numpy()), cells.offsets.to_numpy()
            numbers, flat, first = cells.values.to_numpy(), paths.values.to_numpy(), paths.offsets.to_numpy()
            # only rows that are alike to the one before can be merged: noise rises, so what stands is no nearer
            noise = numbers[bounds[:-1]]
            alike = np.ones(len(ids), bool)
            alike[1:] = (clusters[1:] == clusters[:-1]) & (sizes[1:] == sizes[:-1]) & (np.abs(noise[1:] - noise[:-1]) < precision)
            out = ids.copy()

            def of(i):
                return clusters[i], flat[first[i] : first[i + 1]], numbers[bounds[i] : bounds[i + 1]], ids[i]

            for i in np.flatnonzero(alike).tolist():
                if i and not alike[i - 1]:  # which stands for itself
                    before = of(i - 1)
                own = of(i)
                if before is not None and before[0] == own[0] and len(before[2]) == len(own[2]) and np.array_equal(before[1], own[1]) and (np.abs(before[2] - own[2]) < precision).all():
                    out[i] = before[3]
                else:
                    before = own
            if not alike[-1]:
                before = of(len(ids) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(clusters), pa.array(out), pa.array(n)], names=["cluster_id", "read_class_id", "read_count"])

    return run


def add_noise_and_normalise(probs: DataFrame) -> DataFrame:
    """Scales a read's path probabilities to 1 - noise; 0 where they sum to 0."""
    total = F.sum("prob").over(Window.partitionBy(*READ))
    return probs.withColumn("prob", F.coalesce(F.col("prob") / F.nullif(total, F.lit(0.0)) * (1 - F.col("noise_prob")), F.lit(0.0)))


def grouped(probs: DataFrame, members: DataFrame) -> DataFrame:
    """Sums probabilities over groups of paths: members(cluster_id, path_id, group_id). Up to HELD_MEMBERS of them go to the reads, not these to them."""
    members = members.select("cluster_id", "path_id", "group_id")
    if members.limit(HELD_MEMBERS + 1).count() <= HELD_MEMBERS:
        members = F.broadcast(members)
    return probs.join(members, ["cluster_id", "path_id"]).groupBy(*READ, "read_count", "noise_prob", "group_id").agg(F.sum("prob").alias("prob"))


def detract_noise(probs: DataFrame) -> DataFrame:
    """A read's probabilities as shares of 1, and its count without noise; reads that are all noise go. ``estimators.without_noise`` for any size."""
    total = F.sum("prob").over(Window.partitionBy(*READ))
    share = F.coalesce(F.col("prob") / F.nullif(total, F.lit(0.0)), F.lit(0.0))
    return probs.where("noise_prob < 1").withColumn("prob", share).withColumn("read_count", F.col("read_count") * (1 - F.col("noise_prob")))


def merge_paths(probs: DataFrame, precision: float = 1e-8) -> DataFrame:
    """(cluster_id, path_id, kept): paths whose probabilities are equal within the precision at every read become one.

    In the order of their ids a path joins the first one kept to which it is near. A path that is near to another has a
    probability at the first read of that one, and nearly the same sum, weighted by hashes of the reads: only such pairs
    are compared read by read. No column is gathered. Paths without any probability have no row.
    """
    cells = stored(probs.where("prob != 0").select(*READ, "path_id", "prob"), "merge-cells")
    weighted = F.col("prob") * (F.xxhash64("read_class_id") / F.lit(2.0**63))
    facts = cells.groupBy("cluster_id", "path_id").agg(F.sum(weighted).alias("sketch"), F.sum(F.abs("prob")).alias("mass"), F.count("*").alias("n"), F.min(F.when(F.col("prob") >= precision, F.col("read_class_id"))).alias("read_class_id"))
    facts = stored(facts, "merge-facts")
    at = facts.where("read_class_id IS NOT NULL").select(*READ, F.col("path_id").alias("a")).join(cells.select(*READ, F.col("path_id").alias("b")), READ)
    faint = facts.where("read_class_id IS NULL").select("cluster_id", F.col("path_id").alias("b"), F.min("path_id").over(Window.partitionBy("cluster_id")).alias("a"))
    pairs = at.select("cluster_id", "a", "b").unionByName(faint).where("a != b").select("cluster_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for x in ("a", "b"):
        pairs = pairs.join(facts.select("cluster_id", F.col("path_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("sketch", "mass", "n")]), ["cluster_id", x])
    reach = precision * (F.col("n_a") + F.col("n_b")) + 1e-9 * (F.col("mass_a") + F.col("mass_b"))
    pairs = stored(pairs.where(F.abs(F.col("sketch_a") - F.col("sketch_b")) <= reach).select("cluster_id", "a", "b"), "merge-pairs")

    def apart(x: str, y: str) -> DataFrame:
        own, other = (cells.select(*READ, F.col("path_id").alias(z), F.col("prob").alias(f"prob_{z}")) for z in (x, y))
        met = own.join(pairs, ["cluster_id", x]).join(other, [*READ, y], "left")
        return met.where(F.abs(F.col(f"prob_{x}") - F.coalesce(f"prob_{y}", F.lit(0.0))) >= precision).select("cluster_id", "a", "b")

    near = stored(pairs.join(apart("a", "b").unionByName(apart("b", "a")).distinct(), ["cluster_id", "a", "b"], "left_anti"), "merge-near")
    left, done = facts.select("cluster_id", "path_id"), None
    while True:  # paths with no near one before them are kept; what is near to them joins; the rest go on among themselves
        bound = near.select("cluster_id", F.col("b").alias("path_id")).distinct()
        kept = left.join(bound, ["cluster_id", "path_id"], "left_anti")
        joined = near.join(kept.select("cluster_id", F.col("path_id").alias("a")), ["cluster_id", "a"]).groupBy("cluster_id", F.col("b").alias("path_id")).agg(F.min("a").alias("kept"))
        found = stored(kept.withColumn("kept", F.col("path_id")).unionByName(joined), "merged-paths")
        done = found if done is None else done.unionByName(found)
        left = stored(left.join(found, ["cluster_id", "path_id"], "left_anti"), "merge-left")
        if left.isEmpty():
            return done
        for x in ("a", "b"):
            near = near.join(left.select("cluster_id", F.col("path_id").alias(x)), ["cluster_id", x], "left_semi")
        near = stored(near, "merge-near")
