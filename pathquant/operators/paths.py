"""The path index as tables: which paths visit nodes, what follows, and how long paths are.

nodes(node_id, length); steps(path_id, ordinal, node_id, is_reverse); paths(path_id, name).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathquant.functions.fragments import FragmentDist


def node_lengths(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """steps + node_length; -1 for a node that the graph lacks."""
    return steps.join(nodes.select("node_id", F.col("length").alias("node_length")), "node_id", "left").withColumn("node_length", F.coalesce("node_length", F.lit(-1)))


def with_offsets(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """steps + node_length, cum_offset: the bases of the path before the step."""
    before = Window.partitionBy("path_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return node_lengths(steps, nodes).withColumn("cum_offset", F.coalesce(F.sum("node_length").over(before), F.lit(0)))


def path_lengths(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    return node_lengths(steps, nodes).groupBy("path_id").agg(F.sum("node_length").alias("length"))


def find(steps: DataFrame, node_id: int, is_reverse: bool) -> DataFrame:
    """Occurrences (path_id, ordinal) of an oriented node."""
    return steps.where((F.col("node_id") == node_id) & (F.col("is_reverse") == is_reverse)).select("path_id", "ordinal")


def extend(occurrences: DataFrame, steps: DataFrame, node_id: int, is_reverse: bool) -> DataFrame:
    """Occurrences whose next step is the node, moved on to it."""
    moved = occurrences.select("path_id", (F.col("ordinal") + 1).alias("ordinal"))
    return moved.join(find(steps, node_id, is_reverse), ["path_id", "ordinal"], "left_semi")


def locate(occurrences: DataFrame, bidirectional: bool = False) -> DataFrame:
    """Paths of occurrences; those in an index of both orientations are the paths themselves."""
    found = folded(occurrences) if bidirectional else occurrences
    return found.select("path_id").distinct()


def both_orientations(steps: DataFrame) -> DataFrame:
    """The index of both orientations: path i is 2 i as it is, and 2 i + 1 walked the other way."""
    own = steps.select((F.col("path_id") * 2).alias("path_id"), "ordinal", "node_id", "is_reverse")
    return own.unionByName(reverse_complement(steps).select((F.col("path_id") * 2 + 1).alias("path_id"), "ordinal", "node_id", "is_reverse"))


def folded(rows: DataFrame) -> DataFrame:
    """rows of an index of both orientations with the ids of the paths themselves."""
    return rows.withColumn("path_id", F.shiftright("path_id", 1))


def out_edges(steps: DataFrame) -> DataFrame:
    """Distinct (node_id, is_reverse, next_node, next_reverse) along paths."""
    order = Window.partitionBy("path_id").orderBy("ordinal")
    pairs = steps.select("node_id", "is_reverse", F.lead("node_id").over(order).alias("next_node"), F.lead("is_reverse").over(order).alias("next_reverse"))
    return pairs.where(F.col("next_node").isNotNull()).distinct()


def reverse_complement(steps: DataFrame) -> DataFrame:
    """The paths walked the other way."""
    last = F.max("ordinal").over(Window.partitionBy("path_id"))
    return steps.withColumn("ordinal", last - F.col("ordinal")).withColumn("is_reverse", ~F.col("is_reverse"))


def path_names(metadata: DataFrame) -> DataFrame:
    """(path_id, name): sample_contig_phase_count, or the id plus 1 where there is no metadata."""
    parts = [F.col(c).cast("string") for c in ("sample", "contig", "phase", "count")]
    known = F.coalesce(*parts).isNotNull()
    return metadata.select("path_id", F.when(known, F.concat_ws("_", *[F.coalesce(p, F.lit("")) for p in parts])).otherwise((F.col("path_id") + 1).cast("string")).alias("name"))


def effective_lengths(lengths: DataFrame, dist: FragmentDist, long_reads: bool = False) -> DataFrame:
    """lengths(path_id, length) + effective_length.

    The length less the mean fragment cut to [1, length], 1 at least; 0 for an empty path; for long reads the
    length itself. The mean is computed once per distinct length and joined back.
    """
    if long_reads:
        return lengths.withColumn("effective_length", F.col("length").cast("double"))

    def values(batches):
        for pdf in batches:
            length = pdf["length"].to_numpy(dtype=float)
            mean = dist.truncated_mean(length)
            short = np.where(np.isfinite(mean), np.maximum(1.0, length - mean), 1.0)
            pdf["effective_length"] = np.where(length <= 0, 0.0, short)
            yield pdf

    kinds = lengths.select("length").where("length IS NOT NULL").distinct()
    return lengths.join(kinds.mapInPandas(values, f"length {kinds.schema['length'].dataType.simpleString()}, effective_length double"), "length", "left")
