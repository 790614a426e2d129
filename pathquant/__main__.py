"""Command line: reads tables and alignments, infers with one of the models, and writes tab-separated tables.

The graph is a table of nodes (Parquet, or JSON lines with id and sequence). The paths folder holds two Parquet tables,
``steps`` (path_id, ordinal, node_id, is_reverse) and ``paths`` (path_id and name, or sample, contig, phase and count).
Alignments are JSON lines. Every output is a folder <prefix>..., beside it stands what was measured.
"""

from __future__ import annotations

import argparse
import sys
import time

from pathquant.config import LIBRARIES, MODELS, EngineConfig


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("pathquant", description="path posterior probabilities and abundances from graph read alignments")
    add = out.add_argument_group("required").add_argument
    add("-g", "--graph", required=True, help="table of nodes")
    add("-p", "--paths", required=True, help="folder of the tables steps and paths")
    add("-a", "--alignments", required=True, help="alignments as JSON lines")
    add("-o", "--output-prefix", required=True)
    add("-i", "--inference-model", required=True, choices=MODELS)
    add = out.add_argument_group("general").add_argument
    add("-t", "--threads", type=int, help="threads of a local session; without it the session that is configured")
    add("-r", "--rng-seed", type=int, default=None, help="seed (default: the time)")
    add = out.add_argument_group("alignment").add_argument
    add("-e", "--strand-specific", choices=LIBRARIES, default="unstranded", help="library type (fr: read 1 forward, rf: read 1 reverse)")
    add("-u", "--single-path", action="store_true", help="alignments have one path (default: graphs of subpaths)")
    add("-s", "--single-end", action="store_true")
    add("-l", "--long-reads", action="store_true", help="long single reads")
    add("--score-not-qual", action="store_true", help="scores are not adjusted by base quality")
    add("--interleaved", action="store_true", help="mates are consecutive lines, rather than told by pair_id and mate")
    add("--bidirectional", action="store_true", help="the path index is bidirectional")
    add = out.add_argument_group("fragment").add_argument
    add("-m", "--frag-mean", type=float)
    add("-d", "--frag-sd", type=float)
    add("--max-num-sd-frag", type=int, default=10)
    add = out.add_argument_group("probability").add_argument
    add("-b", "--write-probs", action="store_true", help="write the read path probabilities")
    add("--max-par-offset", type=int, default=4)
    add("--max-score-diff", type=int, default=EngineConfig.max_score_diff)
    add("--filt-best-score", type=float, default=0.9)
    add("--use-allelic-mapq", action="store_true")
    add("--min-noise-prob", type=float, default=1e-4)
    add("--prob-precision", type=float, default=1e-8)
    add("--path-node-cluster", action="store_true", help="cluster paths that share a node too")
    add = out.add_argument_group("haplotyping").add_argument
    add("-y", "--ploidy", type=int, default=2)
    add("-f", "--path-info", help="table of transcripts and haplotypes of the paths")
    add("--min-hap-prob", type=float, default=0.001)
    add("--ind-hap-inference", action="store_true")
    add("--use-hap-gibbs", action="store_true")
    add = out.add_argument_group("quantification").add_argument
    add("-n", "--num-gibbs-samples", type=int, default=0)
    add("--max-em-its", type=int, default=10_000)
    add("--max-rel-em-conv", type=float, default=0.001)
    add("--gibbs-thin-its", type=int, default=25)
    return out


def settings(args: argparse.Namespace) -> EngineConfig:
    same = "single_path single_end long_reads score_not_qual frag_mean frag_sd max_num_sd_frag max_score_diff filt_best_score use_allelic_mapq min_noise_prob prob_precision path_node_cluster ploidy min_hap_prob ind_hap_inference use_hap_gibbs num_gibbs_samples max_em_its max_rel_em_conv gibbs_thin_its write_probs"
    seed = int(time.time()) if args.rng_seed is None else args.rng_seed
    return EngineConfig(model=args.inference_model, seed=seed, library=args.strand_specific, max_partial_offset=args.max_par_offset, path_info=args.path_info is not None, **{k: getattr(args, k) for k in same.split()})


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    config = settings(args)
    from pyspark.sql import SparkSession

    from pathquant.plans import pipeline
    from pathquant.plans.store import stored, stored_run
    from pathquant.sources import readers, sinks

    builder = SparkSession.builder.appName("pathquant")
    spark = (builder.master(f"local[{args.threads}]") if args.threads else builder).getOrCreate()
    start = time.time()
    with stored_run(spark):
        reads = readers.read_alignments(spark, args.alignments, not config.single_path, args.interleaved)
        nodes = stored(readers.read_nodes(spark, args.graph, "json" if args.graph.endswith((".json", ".json.gz")) else "parquet"), "nodes")
        info = readers.read_path_info(spark, args.path_info, config.model == "haplotype-transcripts", config.collapse) if args.path_info else None
        result = pipeline.run(reads, nodes, readers.read_steps(spark, f"{args.paths}/steps"), readers.read_paths(spark, f"{args.paths}/paths"), config, info, args.bidirectional)
        names = {"haplotypes": "", "abundances": "", "joint": "_joint", "gibbs": "_gibbs", "probs": "_probs"}
        for name, table in result.tables.items():
            path = f"{args.output_prefix}{names[name]}"
            if name == "probs":
                sinks.write_probability_lines(table, path)
            else:
                sinks.write_tsv(table, path, gzip=name == "gibbs")
    print(f"{result.unaligned} reads or pairs unaligned; fragments {result.fragments}; {time.time() - start:.1f} s", file=sys.stderr)


if __name__ == "__main__":
    main()
