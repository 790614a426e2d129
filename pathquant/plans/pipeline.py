"""The four models from alignments to result tables.

Two actions are forced by the data: the fragment histogram (its fit gives the distribution that all
probabilities use) and the sum that scales abundances. All else is one lazy plan with written cuts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathquant.config import EngineConfig
from pathquant.functions.fragments import FragmentDist, first_params, fit_skew_normal, histogram, parse_alignment_params, parse_annotation_params
from pathquant.operators import clusters as C
from pathquant.operators import inference, matching, paths, probs
from pathquant.plans.store import stored
from pathquant.sources import readers, sinks


@dataclass
class Result:
    tables: dict[str, DataFrame]
    estimates: DataFrame
    probabilities: DataFrame
    members: DataFrame
    fragments: FragmentDist
    unaligned: int


def pre_fragments(alignments: DataFrame, config: EngineConfig) -> FragmentDist:
    if config.frag_mean is not None:
        return FragmentDist(config.frag_mean, config.frag_sd, 0.0, config.max_num_sd_frag)
    if "fragment_length_distribution" in alignments.columns:
        params = parse_alignment_params(F.col("fragment_length_distribution"), F.col("annotation"))
    else:
        params = parse_annotation_params(F.col("annotation"))
    found = first_params(alignments, params, "read_id")
    if not found:
        raise ValueError("no alignment carries fragment length parameters; give frag_mean and frag_sd")
    return FragmentDist(*found, 0.0, config.max_num_sd_frag)


def run(alignments: DataFrame, nodes: DataFrame, steps: DataFrame, path_names: DataFrame, config: EngineConfig, path_info: DataFrame | None = None, bidirectional: bool = False) -> Result:
    """alignments: read_id, mate and a path or subpaths; nodes(node_id, length); steps(path_id, ordinal, node_id, is_reverse); path_names(path_id, name).

    Bidirectional: the paths are indexed in both orientations, reads are searched in one, and what is found is folded.
    """
    pre = pre_fragments(alignments, config)
    indexed = paths.both_orientations(steps) if bidirectional else steps
    placed = stored(paths.with_offsets(indexed, nodes).withColumn("node", F.col("node_id") * 2 + F.col("is_reverse").cast("int")), "steps")
    usable = readers.has_path(alignments)
    found = matching.alignment_rows(usable, placed, config, pre.max_length, bidirectional, nodes)
    rows = stored(paths.folded(found).distinct() if bidirectional else found, "rows")
    lost = matching.unaligned(alignments, rows).first()["unaligned"]

    dist = pre
    if not config.single_end:
        lengths = rows.groupBy("read_id").agg(F.first("frag_length").alias("frag_length"), F.first("min_mapq").alias("min_mapq"), F.first("is_simple").alias("is_simple")).withColumn("read_count", F.lit(1))
        hist = histogram(lengths, pre.max_length).collect()  # a row per length
        fitted = fit_skew_normal(np.array([r["frag_length"] for r in hist]), np.array([r["n"] for r in hist]), config.max_num_sd_frag) if hist else None
        dist = fitted if fitted is not None and fitted.valid else pre

    classes = stored(matching.read_classes(rows), "classes")
    names = readers.with_path_info(path_names, path_info)
    lengths = paths.effective_lengths(paths.path_lengths(steps, nodes), dist, config.long_reads)
    components = stored(C.path_components(path_names, classes, steps if config.node_clusters else None, bidirectional), "placed")
    members = C.local_index(C.ranked(components, classes).join(names, "path_id").join(lengths, "path_id"))
    members = stored(members, "members")

    joined = C.class_clusters(classes, members).select("cluster_id", "read_class_id", "read_count", "min_mapq", "noise_score", F.explode("rows").alias("r"))
    joined = joined.select("cluster_id", "read_class_id", "read_count", "min_mapq", "noise_score", "r.*").join(members.select("path_id", "effective_length", F.col("source_count").cast("long").alias("source_count"), "transcript"), "path_id")
    found = probs.read_path_probs(joined, dist, single_end=config.single_end, min_noise_prob=config.min_noise_prob, precision=config.prob_precision, group="transcript" if config.collapse else None, size=classes.agg(F.sum(F.size("rows"))).first()[0] or 0)
    if config.collapse:
        ids = members.groupBy("cluster_id", "transcript").agg(F.min("path_id").alias("first"))
        found = found.withColumnRenamed("path_id", "transcript").join(ids, ["cluster_id", "transcript"], "left").withColumnRenamed("first", "path_id").drop("transcript")
        members = C.local_index(C.collapsed(members))
    found = stored(probs.merge_identical(found, config.prob_precision), "probs")
    result = stored(inference.infer(found, members.select("cluster_id", "path_id", "source_count", "group_id", "source_ids"), config), "estimates")

    tables: dict[str, DataFrame] = {}
    if config.model == "haplotypes":
        tables["haplotypes"] = sinks.haplotype_table(result, members, config.ploidy, config.prob_precision)
    else:
        counts = members.join(inference.path_abundances(result), ["cluster_id", "path_id"], "left")
        total = inference.tpm_denominator(counts)
        unknown = inference.unknown_count(result, lost)
        tables["abundances"] = sinks.abundance_table(result, members, total, unknown, config.model == "haplotype-transcripts")
        if config.model == "haplotype-transcripts":
            tables["joint"] = sinks.joint_table(result, members, config.ploidy, config.prob_precision, total, unknown)
        if config.num_gibbs_samples:
            tables["gibbs"] = sinks.gibbs_table(result, members, config.num_gibbs_samples, inference.unknown_samples(result, config.num_gibbs_samples, lost))
    if config.write_probs:
        tables["probs"] = sinks.probability_lines(found, members, config.prob_digits)
    return Result(tables, result, found, members, dist, lost)
