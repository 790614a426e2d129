"""The models for clusters of any size, as frames: nothing of a cluster is gathered in one worker.

Expectation-maximisation and count samples go over blocks of sparse cells (``packed``). A path cover is found in rounds of
picks that do not touch each other. Likelihoods of path combinations are sums over cells and over pairs of cells of a
read. Rows are those of ``inference``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathquant.config import EM_MIN_ABUNDANCE, GIBBS_MIN_ABUNDANCE, HAPLOTYPE_CUT, EngineConfig
from pathquant.operators import packed
from pathquant.operators.estimators import independent_draws
from pathquant.operators.probs import add_noise_and_normalise
from pathquant.plans.store import stored

READ = ["cluster_id", "read_class_id"]
CELL = [*READ, "read_count", "noise_prob"]


def supported(settings: EngineConfig) -> bool:
    """Whether the model has a form for large clusters: all but nested ones that sample counts or haplotypes, and combinations of more than two paths."""
    if settings.model in ("transcripts", "strains"):
        return True
    return settings.ploidy <= 2 and not (settings.use_hap_gibbs or settings.model == "haplotype-transcripts" and settings.num_gibbs_samples)


def infer(probs: DataFrame, members: DataFrame, settings: EngineConfig) -> DataFrame:
    """Result rows of the clusters of probs."""
    probs = stored(probs.select(*READ, F.col("read_count").cast("double").alias("read_count"), "noise_prob", F.col("path_id").cast("long").alias("path_id"), "prob"), "large-probs")
    members = stored(members.withColumn("path_id", F.col("path_id").cast("long")), "large-members")
    if settings.model == "haplotypes":
        return haplotypes(probs, members, settings)
    if settings.model == "haplotype-transcripts":
        return nested(probs, members, settings)
    if settings.model == "strains":
        return strains(probs, members, settings)
    return transcripts(probs, members, settings)


# ---- result rows

def _row(kind: str, path_ids: Column, posterior: Column, counts: Column, noise: Column, total: Column) -> list[Column]:
    return [F.col("cluster_id").cast("long").alias("cluster_id"), F.lit(kind).alias("kind"), path_ids.cast("array<long>").alias("path_ids"), posterior.cast("double").alias("posterior"), counts.cast("array<double>").alias("counts"), noise.cast("double").alias("noise_count"), total.cast("double").alias("total_count"), F.lit(None).cast("int").alias("sample")]


def _no() -> Column:
    return F.lit(None)


def totals(probs: DataFrame) -> DataFrame:
    return probs.select(*READ, "read_count").distinct().groupBy("cluster_id").agg(F.sum("read_count").alias("total"))


def _restricted(probs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of probs whose (cluster_id, path_id) is kept; reads without one keep a row with a null path."""
    own = probs.join(kept.select("cluster_id", "path_id"), ["cluster_id", "path_id"], "left_semi").select(probs.columns)
    bare = probs.select(CELL).distinct().join(own.select(READ).distinct(), READ, "left_anti")
    return own.unionByName(bare.select(*CELL, F.lit(None).cast("long").alias("path_id"), F.lit(None).cast("double").alias("prob")))


def _counts(probs: DataFrame, settings: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """(cluster_id, path_id, count) of paths that are not negligible, and (cluster_id, noise, total)."""
    blocks, items = packed.packed(add_noise_and_normalise(probs))
    return _of_shares(packed.named(packed.em_shares(blocks, settings.max_em_its, settings.max_rel_em_conv), items), probs)


def _of_shares(shares: DataFrame, probs: DataFrame) -> tuple[DataFrame, DataFrame]:
    lost = F.col("path_id").isNull() | (F.col("share") < EM_MIN_ABUNDANCE)
    found = stored(shares.join(totals(probs), "cluster_id").withColumn("lost", lost), "large-em")
    counts = found.where("NOT lost").select("cluster_id", "path_id", (F.col("share") * F.col("total")).alias("count"))
    return counts, found.groupBy("cluster_id").agg((F.sum(F.when(F.col("lost"), F.col("share")).otherwise(0.0)) * F.first("total")).alias("noise"), F.first("total").alias("total"))


# ---- counts of single paths

def transcripts(probs: DataFrame, members: DataFrame, settings: EngineConfig, paths: DataFrame | None = None) -> DataFrame:
    """Expectation-maximisation, and samples of counts, over all members or the given paths; members that probs lacks have a count of 0."""
    blocks, items = packed.packed(add_noise_and_normalise(probs), members if paths is None else paths)
    shares = packed.em_shares(blocks, settings.max_em_its, settings.max_rel_em_conv)
    counts, noise = _of_shares(packed.named(shares, items), probs)
    own = members.select("cluster_id", "path_id").join(counts, ["cluster_id", "path_id"], "left")
    groups = own.select(_row("group", F.array("path_id"), F.lit(1.0), F.array(F.coalesce("count", F.lit(0.0))), _no(), _no()))
    out = groups.unionByName(noise.select(_row("cluster", _no(), _no(), _no(), F.col("noise"), F.col("total"))))
    return out.unionByName(_samples(blocks, shares, items, probs, settings)) if settings.num_gibbs_samples else out


def _samples(blocks: DataFrame, shares: DataFrame, items: DataFrame, probs: DataFrame, settings: EngineConfig) -> DataFrame:
    """Samples of counts of the items; negligible ones count as noise. A cluster without items has none."""
    drawn = packed.count_samples(blocks.where("n > 0"), shares, settings.seed, settings.num_gibbs_samples, settings.gibbs_thin_its)
    each = drawn.select("cluster_id", "sample", F.posexplode("shares").alias("item", "share")).join(items, ["cluster_id", "item"], "left").join(totals(probs), "cluster_id")
    lost = F.col("path_id").isNull() | (F.col("share") < GIBBS_MIN_ABUNDANCE)
    count = F.col("share") * F.col("total")
    entry = F.when(F.col("path_id").isNotNull(), F.struct("path_id", F.when(lost, 0.0).otherwise(count).alias("n")))
    rows = each.groupBy("cluster_id", "sample").agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.sum(F.when(lost, count).otherwise(0.0)).alias("noise"), F.first("total").alias("total"))
    columns = _row("sample", F.transform("entries", lambda e: e["path_id"]), _no(), F.transform("entries", lambda e: e["n"]), F.col("noise"), F.col("total"))
    return rows.select(*columns[:-1], "sample")


def path_cover(cells: DataFrame) -> DataFrame:
    """(cluster_id, path_id) of the weighted minimum path cover of cells (cluster, read class, count, path, prob > 0).

    The greedy cover picks, again and again, the path with the most uncovered count to its weight. A path that beats all
    paths with which it shares uncovered reads is picked before any of them, whatever is picked elsewhere, as counts
    only fall. So each round takes all such paths, and the cover is that of single picks in far fewer rounds. A path that alone has
    an uncovered read is picked at some time; where all paths of a cluster that are left are such, their order does not matter.
    """
    weights = stored(cells.groupBy("cluster_id", "path_id").agg((-F.sum(F.ln("prob") * F.col("read_count"))).alias("weight")), "cover-weights")
    open_, chosen = stored(cells.where("read_count > 0").select(*READ, "read_count", "path_id"), "cover-cells"), None
    read = Window.partitionBy(*READ)
    while not open_.isEmpty():
        gain = open_.groupBy("cluster_id", "path_id").agg(F.sum("read_count").alias("gain")).join(weights, ["cluster_id", "path_id"])
        ratio = F.when(F.col("weight") > 0, F.col("gain") / F.col("weight")).otherwise(F.lit(float("inf")))
        rated = open_.join(gain.select("cluster_id", "path_id", ratio.alias("ratio")), ["cluster_id", "path_id"])
        order = F.struct("ratio", (-F.col("path_id")).alias("first"))  # of equals the first path
        best = rated.withColumn("best", order == F.max(order).over(read)).withColumn("alone", F.count("*").over(read) == 1)
        best = best.groupBy("cluster_id", "path_id").agg(F.min("best").alias("all"), F.max("alone").alias("alone"))
        needed = F.min("alone").over(Window.partitionBy("cluster_id"))
        picked = stored(best.withColumn("needed", needed).where("all OR needed").select("cluster_id", "path_id"), "cover-picked")
        marked = open_.join(picked.withColumn("hit", F.lit(1)), ["cluster_id", "path_id"], "left")
        open_ = stored(marked.withColumn("covered", F.max("hit").over(read)).where("covered IS NULL").select(open_.columns), "cover-cells")
        chosen = picked if chosen is None else chosen.unionByName(picked)
    return weights.select("cluster_id", "path_id").limit(0) if chosen is None else chosen


def strains(probs: DataFrame, members: DataFrame, settings: EngineConfig) -> DataFrame:
    """The weighted minimum path cover, then expectation-maximisation over its paths. A cluster's only path is its cover."""
    cells = add_noise_and_normalise(probs).where((F.col("prob") > 0) & (F.col("noise_prob") < 1 - 1e-12))
    only = members.groupBy("cluster_id").agg(F.min("path_id").alias("path_id"), F.count("*").alias("n")).where("n = 1").select("cluster_id", "path_id")
    cells = stored(cells.select(*CELL, "path_id", "prob"), "strain-cells")
    blocks, items = packed.packed(cells)
    chosen = packed.covers(blocks).join(items, ["cluster_id", "item"]).select("cluster_id", "path_id").unionByName(only)
    many = blocks.where("blocks > 1").select("cluster_id").distinct()
    if not many.isEmpty():
        chosen = chosen.unionByName(path_cover(cells.join(many, "cluster_id", "left_semi").select(*READ, "read_count", "path_id", "prob")))
    chosen = stored(chosen.distinct(), "cover")
    return transcripts(stored(_restricted(probs, chosen), "cover-probs"), members, settings, chosen)


# ---- combinations

def _dense(rows: pd.DataFrame):
    """Probabilities (reads by items), noise and counts of a block's rows."""
    first = np.unique(rows["read_class_id"].to_numpy(), return_index=True)[1]
    which = np.searchsorted(rows["read_class_id"].to_numpy()[first], rows["read_class_id"].to_numpy())
    out = np.zeros((len(first), int(rows["items"].iloc[0])))
    live = rows["item"].to_numpy() >= 0  # -1: a read that is all noise
    out[which[live], rows["item"].to_numpy()[live]] = rows["prob"].to_numpy()[live]
    return out, rows["noise_prob"].to_numpy()[first], rows["read_count"].to_numpy()[first]


def _gain(x: Column) -> Column:
    """What a probability x more than its noise adds to a read's log likelihood. Noise of 0 is taken as hardly any."""
    return F.col("read_count") * F.log1p(x / F.col("noise"))


def gains(matrix: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells that are not 0, and (cluster_id, item, freq, half, whole) of items: the log of their share of the sources, and by
    how much the log likelihood of the noise alone rises with the item in one of two slots, and in all."""
    cells = stored(matrix.where("item IS NOT NULL AND prob > 0").select(*READ, F.col("read_count").cast("double").alias("read_count"), F.greatest("noise_prob", F.lit(1e-300)).alias("noise"), F.col("item").cast("int").alias("item"), "prob"), "gain-cells")
    freq = F.ln(F.col("sources") / F.sum("sources").over(Window.partitionBy("cluster_id")))
    sums = cells.groupBy("cluster_id", "item").agg(F.sum(_gain(F.col("prob") / 2)).alias("half"), F.sum(_gain(F.col("prob"))).alias("whole"))
    own = items.select("cluster_id", F.col("item").cast("int").alias("item"), freq.alias("freq")).join(sums, ["cluster_id", "item"], "left")
    return cells, stored(own.fillna(0.0, ["half", "whole"]), "gain-items")


def shared_gains(cells: DataFrame, firsts: DataFrame, seconds: DataFrame, ordered: bool) -> DataFrame:
    """(cluster_id, i, j, shared) of items i of firsts and j of seconds that have a read in common: what both in a pair add to
    their own gains, which is 0 or less. ordered: only i < j."""
    a = cells.join(firsts.select("cluster_id", "item"), ["cluster_id", "item"], "left_semi").select(*READ, "read_count", "noise", F.col("item").alias("i"), F.col("prob").alias("p"))
    b = cells.join(seconds.select("cluster_id", "item"), ["cluster_id", "item"], "left_semi").select(*READ, F.col("item").alias("j"), F.col("prob").alias("q"))
    met = a.join(b, READ).where("i < j" if ordered else "i != j")
    both = _gain((F.col("p") + F.col("q")) / 2) - _gain(F.col("p") / 2) - _gain(F.col("q") / 2)
    return met.groupBy("cluster_id", "i", "j").agg(F.sum(both).alias("shared"))


def posteriors(matrix: DataFrame, items: DataFrame, size: int, cut: float) -> DataFrame:
    """(cluster_id, i, j, posterior) of all pairs of items, or with size 1 of items (i = j).

    matrix: (cluster_id, read_class_id, read_count, noise_prob, item, prob) normalised; items: (cluster_id, item, sources).
    The log likelihood of a pair is that of noise alone, and what each item adds by itself, and a sum over the reads that both
    have, which is 0 or less. So the first two bound it. With cut, pairs below it times the best likelihood are
    left out: the best item and all its partners set a likelihood to reach, and only items whose bound with the best
    partner reaches it are paired.
    """
    cells, facts = gains(matrix, items)
    own = Window.partitionBy("cluster_id")
    if size != 2:
        found = facts.select("cluster_id", F.col("item").alias("i"), F.col("item").alias("j"), (F.col("whole") + F.col("freq")).alias("like"))
    else:
        floor, two = math.log(cut) if cut > 0 else -math.inf, math.log(2)
        rated = facts.select("cluster_id", "item", (F.col("half") + F.col("freq")).alias("score"), (F.col("whole") + 2 * F.col("freq")).alias("alone"))
        best = stored(rated.groupBy("cluster_id").agg(F.max("alone").alias("alone"), F.max(F.struct("score", (-F.col("item")).alias("first"))).alias("best")).select("cluster_id", "alone", F.col("best.score").alias("top"), (-F.col("best.first")).alias("item")), "posterior-best")
        tied = shared_gains(cells, best, facts, False).withColumnRenamed("j", "item")
        partners = rated.select("cluster_id", "item", "score").join(best.select("cluster_id", F.col("item").alias("i"), "top"), "cluster_id").where("item != i").join(tied, ["cluster_id", "i", "item"], "left")
        reached = partners.groupBy("cluster_id").agg(F.max(F.col("score") + F.col("top") + F.coalesce("shared", F.lit(0.0)) + two).alias("pair"))
        reached = best.join(reached, "cluster_id", "left").select("cluster_id", "top", F.greatest("pair", "alone").alias("reached"))
        reached = stored(reached.select("cluster_id", "top", (F.col("reached") + F.lit(floor) - F.abs("reached") * 1e-12 - 1e-9).alias("least")), "posterior-reached")
        left = stored(rated.join(reached, "cluster_id").where((F.col("score") + F.col("top") + two >= F.col("least")) | (F.col("alone") >= F.col("least"))), "posterior-left")
        a, b = (left.select("cluster_id", F.col("item").alias(at), F.col("score").alias(f"score_{at}"), *rest) for at, rest in (("i", ["least"]), ("j", [])))
        pairs = a.join(b, "cluster_id").where((F.col("i") < F.col("j")) & (F.col("score_i") + F.col("score_j") + two >= F.col("least")))
        pairs = pairs.join(shared_gains(cells, left, left, True), ["cluster_id", "i", "j"], "left")
        like = pairs.select("cluster_id", "i", "j", (F.col("score_i") + F.col("score_j") + two + F.coalesce("shared", F.lit(0.0))).alias("like"))
        found = like.unionByName(left.select("cluster_id", F.col("item").alias("i"), F.col("item").alias("j"), F.col("alone").alias("like")))
        found = found.withColumn("top", F.max("like").over(own)).where(F.col("like") >= F.col("top") + F.lit(floor)).drop("top")
    weight = found.withColumn("weight", F.exp(F.col("like") - F.max("like").over(own)))
    return weight.select("cluster_id", "i", "j", (F.col("weight") / F.sum("weight").over(own)).alias("posterior"))


def haplotypes(probs: DataFrame, members: DataFrame, settings: EngineConfig) -> DataFrame:
    item = (F.row_number().over(Window.partitionBy("cluster_id").orderBy("path_id")) - 1).cast("long")
    named = stored(members.select("cluster_id", "path_id", item.alias("item"), F.col("source_count").cast("double").alias("sources")), "haplotype-items")
    matrix = add_noise_and_normalise(probs).join(named.select("cluster_id", "path_id", "item"), ["cluster_id", "path_id"])
    found = posteriors(matrix.select(*CELL, "item", "prob"), named, settings.ploidy, HAPLOTYPE_CUT if settings.ploidy == 2 else 0.0)
    for at in ("i", "j"):
        found = found.join(named.select("cluster_id", F.col("item").alias(at), F.col("path_id").alias(f"path_{at}")), ["cluster_id", at])
    ids = F.array("path_i", "path_j") if settings.ploidy == 2 else F.array("path_i")
    return found.select(_row("group", ids, F.col("posterior"), F.array(), _no(), _no())).unionByName(totals(probs).select(_row("cluster", _no(), _no(), _no(), F.lit(0.0), F.col("total"))))


def identical_haplotypes(members: DataFrame) -> DataFrame:
    """(cluster_id, paths, sources, item): haplotypes with equal lists of paths as one, numbered in the order of the lists."""
    lists = members.select("cluster_id", "path_id", F.explode("source_ids").alias("source")).groupBy("cluster_id", "source").agg(F.array_sort(F.collect_list("path_id")).alias("paths"))
    merged = lists.groupBy("cluster_id", "paths").agg(F.count("*").cast("double").alias("sources"))
    return merged.withColumn("item", (F.row_number().over(Window.partitionBy("cluster_id").orderBy("paths")) - 1).cast("long"))


def independent_subsets(probs: DataFrame, members: DataFrame, settings: EngineConfig) -> DataFrame:
    """(cluster_id, subset, weight): combinations of the paths of every transcript by itself, then joint draws over the transcripts of a cluster.

    A transcript of a cluster is a cluster of its own to ``posteriors``: reads that hit none of its paths add the same to all its combinations.
    """
    units = stored(members.select("cluster_id", "group_id").distinct().withColumn("unit", F.monotonically_increasing_id()), "draw-units")
    item = (F.row_number().over(Window.partitionBy("unit").orderBy("path_id")) - 1).cast("long")
    own = members.join(units, ["cluster_id", "group_id"]).select("cluster_id", "group_id", "unit", "path_id", item.alias("item"), F.greatest(F.lit(1), F.size("source_ids")).cast("double").alias("sources"))
    own = stored(own, "draw-paths")
    cells = probs.join(own.select("cluster_id", "path_id", "unit", "item"), ["cluster_id", "path_id"]).select(F.col("unit").alias("cluster_id"), "read_class_id", "read_count", "noise_prob", "item", "prob")
    found = posteriors(add_noise_and_normalise(cells), own.select(F.col("unit").alias("cluster_id"), "item", "sources"), settings.ploidy, settings.min_hap_prob if settings.ploidy == 2 else 0.0)
    kinds = found.groupBy(F.col("cluster_id").alias("unit")).agg(F.array_sort(F.collect_list(F.struct("i", "j", "posterior"))).alias("kinds")).join(units, "unit")
    kinds = kinds.join(own.groupBy("unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("item", "path_id"))), lambda x: x["path_id"]).alias("paths")), "unit")
    draws, seed, size = int(1 / settings.min_hap_prob), settings.seed, settings.ploidy

    def run(batches):
        for pdf in batches:
            for cluster, group, rows, paths in zip(pdf["cluster_id"], pdf["group_id"], pdf["kinds"], pdf["paths"]):
                picked = independent_draws(seed, cluster, group, np.array([r["posterior"] for r in rows]), draws)
                combos = [[int(paths[r["i"]])] if size == 1 else [int(paths[r["i"]]), int(paths[r["j"]])] for r in rows]
                yield pd.DataFrame({"cluster_id": int(cluster), "draw": np.arange(draws, dtype=np.int32), "own": [combos[k] for k in picked]})

    drawn = kinds.select("cluster_id", F.col("group_id").cast("long").alias("group_id"), "kinds", "paths").mapInPandas(run, "cluster_id long, draw int, own array<long>")
    joint = drawn.groupBy("cluster_id", "draw").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("subset"))
    return joint.groupBy("cluster_id", "subset").agg((F.count("*") / F.lit(draws)).alias("weight"))


def nested(probs: DataFrame, members: DataFrame, settings: EngineConfig) -> DataFrame:
    """Likely combinations of haplotypes first, then expectation-maximisation over the paths of each, every subset a cluster of its own."""
    if settings.ind_hap_inference:
        subsets = independent_subsets(probs, members, settings)
    else:
        subsets = joint_subsets(probs, members, settings)
    subsets = stored(subsets.where(F.col("weight") >= settings.min_hap_prob).select(F.monotonically_increasing_id().alias("subset_id"), "cluster_id", "subset", "weight"), "subsets")
    return subset_rows(probs, members, subsets, settings)


def joint_subsets(probs: DataFrame, members: DataFrame, settings: EngineConfig) -> DataFrame:
    """(cluster_id, subset, weight) of the likely combinations of haplotypes."""
    haps = stored(identical_haplotypes(members), "haplotypes")
    summed = probs.join(haps.select("cluster_id", "item", F.explode("paths").alias("path_id")), ["cluster_id", "path_id"]).groupBy(*CELL, "item").agg(F.sum("prob").alias("prob"))
    found = posteriors(add_noise_and_normalise(summed), haps, settings.ploidy, settings.min_hap_prob if settings.ploidy == 2 else 0.0).where(F.col("posterior") >= settings.min_hap_prob)
    for at in ("i", "j"):
        found = found.join(haps.select("cluster_id", F.col("item").alias(at), F.col("paths").alias(f"paths_{at}")), ["cluster_id", at])
    both = F.array_sort(F.concat("paths_i", "paths_j")) if settings.ploidy == 2 else F.col("paths_i")
    subsets = found.groupBy("cluster_id", both.alias("subset")).agg(F.sum("posterior").alias("p"))
    return subsets.select("cluster_id", "subset", (F.col("p") / F.sum("p").over(Window.partitionBy("cluster_id"))).alias("weight"))


def subset_rows(probs: DataFrame, members: DataFrame, subsets: DataFrame, settings: EngineConfig) -> DataFrame:
    """Result rows of subsets (subset_id, cluster_id, subset, weight): counts of each weighted, by the paths of a transcript in it."""
    each = stored(subsets.select("subset_id", "cluster_id", "weight", F.explode("subset").alias("path_id")).groupBy("subset_id", "cluster_id", "weight", "path_id").agg(F.count("*").alias("copies")), "subset-paths")
    reads = probs.select(CELL).distinct().join(subsets.select("subset_id", "cluster_id"), "cluster_id")
    own = probs.join(each.select("subset_id", "cluster_id", "path_id"), ["cluster_id", "path_id"])
    bare = reads.join(own.select("subset_id", "read_class_id").distinct(), ["subset_id", "read_class_id"], "left_anti")
    columns = [F.col("subset_id").alias("cluster_id"), "read_class_id", "read_count", "noise_prob"]
    apart = own.select(*columns, "path_id", "prob").unionByName(bare.select(*columns, F.lit(None).cast("long").alias("path_id"), F.lit(None).cast("double").alias("prob")))
    counts, noise = _counts(stored(apart, "subset-probs"), settings)
    counts = counts.withColumnRenamed("cluster_id", "subset_id")

    # every copy of a path gets its part; the paths of a transcript in a subset are one group
    rated = each.join(counts, ["subset_id", "path_id"], "left").join(members.select("cluster_id", "path_id", "group_id"), ["cluster_id", "path_id"])
    entry = F.array_repeat(F.struct("path_id", (F.coalesce("count", F.lit(0.0)) / F.col("copies")).alias("n")), F.col("copies").cast("int"))
    lists = rated.groupBy("cluster_id", "subset_id", "weight", "group_id").agg(F.array_sort(F.flatten(F.collect_list(entry))).alias("entries"))
    lists = lists.select("cluster_id", "weight", F.transform("entries", lambda e: e["path_id"]).alias("paths"), F.posexplode(F.transform("entries", lambda e: e["n"])).alias("place", "n"))
    summed = lists.groupBy("cluster_id", "paths", "place").agg(F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("n")).alias("n"))
    groups = summed.groupBy("cluster_id", "paths").agg(F.max("weight").alias("weight"), F.array_sort(F.collect_list(F.struct("place", "n"))).alias("counts"))
    groups = groups.select(_row("group", F.col("paths"), F.col("weight"), F.transform("counts", lambda c: c["n"]), _no(), _no()))
    lost = noise.select(F.col("cluster_id").alias("subset_id"), "noise").join(subsets.select("subset_id", "cluster_id", "weight"), "subset_id").groupBy("cluster_id").agg(F.sum(F.col("noise") * F.col("weight")).alias("noise"), F.sum("weight").alias("used"))
    lost = totals(probs).join(lost, "cluster_id", "left").select("cluster_id", (F.coalesce("noise", F.lit(0.0)) + F.greatest(F.lit(0.0), 1 - F.coalesce("used", F.lit(0.0))) * F.col("total")).alias("noise"), "total")
    return groups.unionByName(lost.select(_row("cluster", _no(), _no(), _no(), F.col("noise"), F.col("total"))))
