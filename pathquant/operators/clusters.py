"""Clusters of paths that share reads, and optionally nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathquant.operators.components import connected_components
from pathquant.plans.store import stored


def path_components(paths: DataFrame, classes: DataFrame, steps: DataFrame | None = None, bidirectional: bool = False) -> DataFrame:
    """(path_id, anchor): connected components of paths, called by their smallest path.

    Paths of one read class are linked to the class's first path. With steps, paths that visit a node are
    linked too: an oriented node, or in a bidirectional index a node in either orientation. Paths without a link are
    components of their own.
    """
    ids = F.transform("rows", lambda r: r["path_id"])
    links = classes.select(F.array_min(ids).alias("a"), F.explode(ids).alias("b"))
    if steps is not None:
        node = ["node_id"] if bidirectional else ["node_id", "is_reverse"]
        visits = steps.select(*node, "path_id").distinct()
        links = links.union(visits.join(visits.groupBy(*node).agg(F.min("path_id").alias("a")), node).select("a", F.col("path_id").alias("b")))
    comps = connected_components(links.where("a IS NOT NULL").distinct(), "a", "b")
    return paths.select("path_id").join(comps.withColumnRenamed("vertex", "path_id"), "path_id", "left").select("path_id", F.coalesce("component", "path_id").alias("anchor"))


def path_clusters(paths: DataFrame, classes: DataFrame, steps: DataFrame | None = None, bidirectional: bool = False) -> DataFrame:
    """(path_id, cluster_id, anchor): components with ids that rise from 0 with the anchor."""
    placed = path_components(paths, classes, steps, bidirectional)
    return placed.join(numbered(placed.select("anchor").distinct(), ["anchor"], "cluster_id"), "anchor").select("path_id", "cluster_id", "anchor")


def numbered(df: DataFrame, by: list, out: str) -> DataFrame:
    """Adds dense numbers from 0 in an order without ties, without putting all rows into one task.

    Rows are numbered within ranges; the counts of the ranges, one row each, are summed up before.
    """
    parts = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    parts = stored(parts, "numbered")  # the ranges must stay as they are for both uses
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return parts.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + own - 1).drop("_part", "_start")


def ranked(placed: DataFrame, classes: DataFrame) -> DataFrame:
    """(path_id, cluster_id) of paths with anchors: ids from 0 in the order of the clusters' ranks, most read classes first."""
    own = class_clusters(classes, placed.withColumnRenamed("anchor", "cluster_id"))
    return placed.withColumnRenamed("anchor", "cluster_id").join(cluster_ranks(own, placed.select(F.col("anchor").alias("cluster_id"))), "cluster_id").select("path_id", (F.col("rank") - 1).alias("cluster_id"))


def class_clusters(classes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Read classes with the cluster of their first path."""
    first = F.array_min(F.transform("rows", lambda r: r["path_id"]))
    return classes.withColumn("path_id", first).join(clusters.select("path_id", "cluster_id"), "path_id").drop("path_id")


def local_index(clusters: DataFrame) -> DataFrame:
    """Dense index of each path inside its cluster, by path id."""
    return clusters.withColumn("path_idx", F.row_number().over(Window.partitionBy("cluster_id").orderBy("path_id")) - 1)


def cluster_ranks(classes: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(cluster_id, rank): 1 for the cluster with the most read classes, ties to the larger id; with clusters, those without classes too."""
    sizes = classes.groupBy("cluster_id").agg(F.count("*").alias("n"))
    if clusters is not None:
        sizes = clusters.select("cluster_id").distinct().join(sizes, "cluster_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return numbered(sizes, [F.desc("n"), F.desc("cluster_id")], "place").select("cluster_id", (F.col("place") + 1).alias("rank"))


def collapsed(members: DataFrame) -> DataFrame:
    """Paths of a transcript as one, called by it: its smallest path, lengths as means by source count, the sum of those."""
    weight = F.col("source_count").cast("double")
    length, effective = (F.sum(weight * F.col(c)) / F.sum(weight) for c in ("length", "effective_length"))
    return members.groupBy("cluster_id", F.col("transcript").alias("name"), F.col("transcript")).agg(F.min("path_id").alias("path_id"), F.round(length).cast("long").alias("length"), effective.alias("effective_length"), F.sum("source_count").alias("source_count"), F.first("group_id").alias("group_id"), F.first("source_ids").alias("source_ids"))
