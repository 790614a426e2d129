"""Numbers, estimators and the four models."""

import json
import math
from pathlib import Path


import numpy as np
import pytest
from pyspark.sql import functions as F

from pathquant.config import INT_MIN, EngineConfig
from pathquant.functions import fragments, mathfn, scoring
from pathquant.functions.fragments import FragmentDist
from pathquant.operators import clusters, estimators, paths, probs
from pathquant.operators.components import connected_components
from pathquant.plans import pipeline
from pathquant.sources import readers, sinks


def test_fragment_distribution():
    d = FragmentDist(10, 2)
    assert (d.max_length, FragmentDist(10, 2, num_sd=5).max_length) == (30, 20)
    assert [float(d.log_prob(x)) for x in (9, 15, 10000)] == pytest.approx([-1.737085713764618, -4.737085713764618, -12475014.11208571])
    assert not FragmentDist(10, 0).valid and not FragmentDist(math.nan, 1).valid


def test_skew_normal():
    h, a = np.meshgrid(np.linspace(-3, 3, 7), [-20, -2.0, -0.5, 0.0, 0.3, 1.0, 5.0])
    x = (np.arange(4000) + 0.5) / 4000
    want = np.array([[sum(np.exp(-hh * hh * (1 + (aa * x) ** 2) / 2) / (1 + (aa * x) ** 2)) * aa / 4000 / 2 / math.pi for hh, aa in zip(r, q)] for r, q in zip(h, a)])
    assert np.allclose(mathfn.owens_t(h, a), want, atol=1e-6)
    t = np.linspace(-30, 12, 400001)
    density = mathfn.skew_normal_pdf(t, 1.0, 2.0, -3.0)
    cut = (t >= -4) & (t <= 2)
    assert mathfn.skew_normal_cdf(2.0, 1.0, 2.0, -3.0) == pytest.approx(density[t <= 2].sum() * (t[1] - t[0]), abs=1e-4)
    assert mathfn.truncated_skew_normal_mean(1.0, 2.0, -3.0, -4.0, 2.0) == pytest.approx((t * density)[cut].sum() / density[cut].sum(), abs=1e-4)
    for s in 2.0 ** np.arange(-10, 11, 4):
        for shape in (-1024.0, -1.0, 2.0, 1024.0):
            assert np.isfinite(mathfn.log_skew_normal_pdf(np.array([-1024.0, -0.001, 0.001, 1024.0]), 0.0, s, shape)).all()


def test_skew_normal_fit():
    rng = np.random.default_rng(4)
    delta = 4 / math.sqrt(17)
    drawn = np.round(50 + 10 * (delta * np.abs(rng.normal(size=200_000)) + math.sqrt(1 - delta**2) * rng.normal(size=200_000)))
    x, n = np.unique(drawn, return_counts=True)
    d = fragments.fit_skew_normal(x, n)
    assert (d.loc, d.scale, d.shape) == pytest.approx((50, 10, 4), rel=0.05)
    assert fragments.fit_skew_normal(np.array([5]), np.array([9])) is None


def test_small_functions():
    assert mathfn.golden_section_maximum(lambda x: -(x - 2) ** 2, 0, 5, 1e-8) == pytest.approx(2)
    assert mathfn.add_log(math.log(0.2), math.log(0.3)) == pytest.approx(math.log(0.5)) and mathfn.add_log(-math.inf, 1.0) == 1.0
    assert [mathfn.permutations(g) for g in ([1], [1, 1], [1, 2], [1, 1, 2], [1, 1, 2, 2])] == [1, 1, 2, 3, 4] and mathfn.permutations([1, 1, 2, 2], True) == 6
    assert [mathfn.clamp_int(x) for x in (0.5, -0.5, 2.4, 1e12)] == [1, -1, 2, 2**31 - 1]
    assert mathfn.phred_to_prob(mathfn.prob_to_phred(0.3)) == pytest.approx(0.3) and mathfn.same(1.0, 1.0 + 1e-15)


def test_parameters_from_alignments(spark):
    rows = [(1, None, {}), (2, "0:0:0:0:1", {}), (3, "100:10:2:0:1", {}), (4, None, {"fragment_length_distribution": "-I 20 -D 3"})]
    df = spark.createDataFrame(rows, "record long, t string, a map<string,string>")
    both = fragments.parse_alignment_params(F.col("t"), F.col("a"))
    got = {r["record"]: r["p"] and tuple(r["p"]) for r in df.select("record", both.alias("p")).collect()}
    assert got == {1: None, 2: None, 3: (10.0, 2.0), 4: (20.0, 3.0)}
    assert fragments.first_params(df, both, "record") == (10.0, 2.0) and fragments.first_params(df.where("record < 3"), both, "record") is None


def test_path_lengths(spark):
    nodes = spark.createDataFrame([(1, 4), (2, 32), (3, 1), (4, 2)], "node_id long, length int")
    steps = spark.createDataFrame([(p, i, n, False) for p, w in enumerate(([1, 2, 4], [1, 3, 4])) for i, n in enumerate(w)], "path_id long, ordinal int, node_id long, is_reverse boolean")
    lengths = paths.path_lengths(steps, nodes)
    for dist, want in ((FragmentDist(5, 2), (32.889504274642021, 2.4592743581826583)), (FragmentDist(20, 1), (18, 1))):
        got = {r["path_id"]: (r["length"], r["effective_length"]) for r in paths.effective_lengths(lengths, dist).collect()}
        assert (got[0][0], got[1][0]) == (38, 7) and (got[0][1], got[1][1]) == pytest.approx(want)
    assert {r["effective_length"] for r in paths.effective_lengths(lengths, FragmentDist(1, 1), True).collect()} == {38.0, 7.0}


def test_alignment_statistics(spark):
    end = "struct<score:int,length:int,left_clip:int,right_clip:int,start_penalty:int,start_offset:int,end_penalty:int,end_offset:int>"
    df = spark.createDataFrame([([(50, 100, 10, 30, 10, 10, 15, 20), (7, 10, 2, 0, 0, 0, 0, 0)], i) for i in (100, -8)], f"ends array<{end}>, insert int")
    e = F.col("ends")
    got = df.select(scoring.fragment_length(e, F.col("insert")), scoring.score_sum(e), scoring.align_length(e), scoring.optimal_fraction(e, F.array(F.lit(100), F.lit(10))), scoring.soft_clip_fraction(e), scoring.is_partial(e)).collect()
    assert [tuple(r) for r in got] == [(158, 32, 38, 0.25, 0.4, True), (50, 32, 38, 0.25, 0.4, True)]
    assert scoring.MATCH_SCORES[0] == 0 and scoring.MATCH_SCORES[40] == 1 and scoring.BONUSES[2] == 0 and scoring.BONUSES[40] == 5


def test_noise_scores():
    # walks of a branching read: one orientation each holds one of four, then both ends of one index
    forward, back = scoring.missing_score([8], [6, 6, 4]), scoring.missing_score([6], [8, 6, 4])
    assert scoring.noise_score([[forward], [back]]) == -2164501
    assert scoring.noise_score([[scoring.missing_score([8, 6], [6, 4])]]) == -2827626
    assert scoring.missing_score([5], []) == 2**31 - 1 and scoring.noise_score([[2**31 - 1]]) == INT_MIN
    assert scoring.noise_score([[-(2**31)]]) == 0


def test_collapsing():
    matrix, members = estimators.collapse_paths(np.array([[0.2, 0.5, 0.2], [0.1, 0.3, 0.1 + 1e-12]]))
    assert matrix.shape == (2, 2) and sorted(map(sorted, members)) == [[0, 2], [1]]
    rows, counts = estimators.without_noise(np.array([[0.3, 0.6], [0.0, 0.0]]), np.array([0.1, 1.0]), np.array([10.0, 4.0]))
    assert np.allclose(rows, [[1 / 3, 2 / 3]]) and counts.tolist() == [9.0]


def prob_rows(spark, rows, mapq=10, noise=INT_MIN, **eff):
    """rows: (path, score, align, frag); effective lengths default to 3."""
    data = [(0, 1, 1, mapq, noise, p, s, a, f, eff.get(f"p{p}", 3.0)) for p, s, a, f in rows]
    return spark.createDataFrame(data, "cluster_id long, read_class_id long, read_count long, min_mapq int, noise_score int, path_id long, score_sum int, align_length int, frag_length long, effective_length double")


def probabilities(df, **kw):
    rows = probs.read_path_probs(df, FragmentDist(10, 2), min_noise_prob=kw.pop("min_noise_prob", 0.0), **kw).collect()
    assert sum(r["prob"] or 0 for r in rows) + rows[0]["noise_prob"] == pytest.approx(1)
    return {r["path_id"]: r["prob"] for r in rows if r["path_id"] is not None}, rows[0]["noise_prob"]


def test_read_path_probabilities(spark):
    two = [(0, 3, 5, 10), (1, 3, 5, 10)]
    assert probabilities(prob_rows(spark, two)) == ({0: pytest.approx(0.45), 1: pytest.approx(0.45)}, pytest.approx(0.1))
    assert probabilities(prob_rows(spark, [(0, 3, 5, 10000), (1, 3, 5, 10000)]))[0] == {0: pytest.approx(0.45), 1: pytest.approx(0.45)}
    more = [*two, (3, 5, 8, 15)]
    got, _ = probabilities(prob_rows(spark, more))
    assert (got[3], got[0]) == pytest.approx((0.233044027062125, 0.333477986468937))
    # the longest row of a path counts, then the best score
    assert probabilities(prob_rows(spark, [*more, (3, 3, 10, 10)]))[0][3] == pytest.approx(0.3)
    assert probabilities(prob_rows(spark, [*more, (3, 3, 8, 15)]))[0][3] == pytest.approx(0.233044027062125)
    assert probabilities(prob_rows(spark, two, p1=2.0))[0] == {0: pytest.approx(0.36), 1: pytest.approx(0.54)}
    assert probabilities(prob_rows(spark, two, noise=-2302585))[1] == pytest.approx(0.190000008369464)
    got, noise = probabilities(prob_rows(spark, two, noise=-5000000), min_noise_prob=0.3)
    assert (noise, got[0]) == pytest.approx((0.304716562899359, 0.347641718550320))
    assert probabilities(prob_rows(spark, two, noise=0)) == ({}, 1.0) and probabilities(prob_rows(spark, two, mapq=0)) == ({}, 1.0)


def test_collapsed_probabilities(spark):
    rows = prob_rows(spark, [(0, 3, 5, 10), (1, 3, 5, 10), (2, 3, 5, 10)]).withColumn("source_count", F.when(F.col("path_id") == 0, 2).otherwise(1).cast("long")).withColumn("transcript", F.when(F.col("path_id") < 2, "a").otherwise("b"))
    got, noise = probabilities(rows, group="transcript")
    assert got == {"a": pytest.approx(0.9 * 3 / 4), "b": pytest.approx(0.9 / 4)} and noise == pytest.approx(0.1)


def test_binning_and_merging(spark):
    df = spark.createDataFrame([([(2, 0.3), (0, 0.333), (1, 0.333)],)], "x array<struct<path_idx:long,prob:double>>")
    one = df.select(probs.binned(F.col("x"), 0.1).alias("b")).first()["b"]
    assert [(round(g["prob"], 3), g["paths"]) for g in one] == [(0.322, [0, 1, 2])]
    assert [g["paths"] for g in df.select(probs.binned(F.col("x"), 1e-8).alias("b")).first()["b"]] == [[2], [0, 1]]
    rows = [(0, 1, 2, 0.1, 5, 0.9), (0, 2, 3, 0.1, 5, 0.9 + 1e-12), (0, 3, 4, 0.1, 6, 0.9), (0, 4, 1, 1.0, None, None)]
    merged = probs.merge_identical(spark.createDataFrame(rows, "cluster_id long, read_class_id long, read_count long, noise_prob double, path_id long, prob double"))
    assert sorted((r["read_class_id"], r["read_count"]) for r in merged.collect()) == [(1, 5), (3, 4), (4, 1)]


def test_clusters(spark):
    steps = spark.createDataFrame([(0, 1, False), (0, 2, False), (0, 4, False), (1, 1, True), (1, 6, True), (2, 3, False), (3, 6, True), (3, 7, True)], "path_id long, node_id long, is_reverse boolean")
    names = spark.range(4).select(F.col("id").alias("path_id"))
    none = spark.createDataFrame([], "rows array<struct<path_id:long>>")
    for both, want in ((False, [0, 1, 2, 1]), (True, [0, 0, 1, 0])):
        got = {r["path_id"]: r["cluster_id"] for r in clusters.path_clusters(names, none, steps, both).collect()}
        assert [got[i] for i in range(4)] == want
    reads = spark.createDataFrame([([(3,), (0,)],)], "rows array<struct<path_id:long>>")
    assert [r["cluster_id"] for r in clusters.path_clusters(names, reads).orderBy("path_id").collect()] == [0, 1, 2, 0]


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["vertex"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {v: find(v) for v in {x for p in pairs for x in p}}


def test_em():
    probs_, noise = np.array([[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]]), np.array([0.0, 0.0, 0.0])
    found, lost = estimators.em(estimators.with_noise(probs_, noise), np.array([30.0, 10.0, 40.0]))
    assert found == pytest.approx([60, 20], rel=1e-3) and lost == 0
    found, lost = estimators.em(estimators.with_noise(np.array([[1.0]]), np.array([0.1])), np.array([10.0]))
    assert found[0] + lost == pytest.approx(10)


def test_em_steps_agree():
    rng = np.random.default_rng(7)
    matrix = rng.random((300, 40)) * (rng.random((300, 40)) < 0.1)
    matrix[:, -1] = 0.01
    weights, share = rng.random(300), rng.random(40)
    assert estimators._sparse_step(matrix, weights)(share) == pytest.approx(estimators._dense_step(matrix, weights)(share))


def test_em_frames_agree(spark):
    rng = np.random.default_rng(1)
    cells = [(0, r, int(rng.integers(1, 9)), 0.1, p, 0.0) for r in range(12) for p in range(3)]
    weights = {(c[1], c[4]): rng.random() for c in cells}
    counts = {c[1]: c[2] for c in cells}
    rows = [(0, r, counts[r], 0.1, p, 0.9 * weights[r, p] / sum(weights[r, q] for q in range(3))) for _, r, _, _, p, _ in cells]
    df = spark.createDataFrame(rows, "cluster_id long, read_class_id long, read_count long, noise_prob double, path_id long, prob double")
    got = {r["path_id"]: r["share"] for r in estimators.em_frames(df, 6).collect()}
    matrix = np.array([[next(x[5] for x in rows if x[1] == r and x[4] == p) for p in range(3)] + [0.1] for r in range(12)])
    share, n = np.full(4, 0.25), np.array([counts[r] for r in range(12)])
    for _ in range(6):
        joint = matrix * share
        share = (joint / joint.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
    assert [got[i] for i in (0, 1, 2, None)] == pytest.approx(share.tolist())


def test_posteriors_agree():
    rng = np.random.default_rng(2)
    p, noise, counts, sources = rng.random((8, 5)), np.full(8, 0.05), rng.integers(1, 6, 8).astype(float), rng.integers(1, 4, 5).astype(float)
    p = estimators.with_noise(p, noise)[:, :-1]
    full = dict(zip(*estimators.group_posteriors(p, noise, counts, sources, 2)))
    by_hand = {}
    for i in range(5):
        for j in range(i, 5):
            by_hand[i, j] = np.exp(counts @ np.log(noise + (p[:, i] + p[:, j]) / 2)) * sources[i] * sources[j] / sources.sum() ** 2 * (1 if i == j else 2)
    total = sum(by_hand.values())
    assert full == pytest.approx({k: v / total for k, v in by_hand.items()})
    cut = dict(zip(*estimators.group_posteriors(p, noise, counts, sources, 2, 0.2)))
    best = max(full.values())
    assert set(cut) == {k for k, v in full.items() if v >= 0.2 * best} and sum(cut.values()) == pytest.approx(1)
    groups, drawn = estimators.gibbs_posteriors(p, noise, counts, sources, 2, np.random.default_rng)
    assert all(abs(full[g] - x) < 0.08 for g, x in zip(groups, drawn)) and sum(drawn) == pytest.approx(1)
    three = dict(zip(*estimators.group_posteriors(p, noise, counts, sources, 3)))
    assert len(three) == 35 and sum(three.values()) == pytest.approx(1)


def test_cover():
    cover, counts = np.array([[1, 0, 1], [0, 1, 0], [1, 0, 0], [0, 1, 1]], bool), np.array([1.0, 3, 1, 5])
    assert estimators.min_path_cover(cover, counts, np.ones(3)) == [0, 1]
    assert estimators.min_path_cover(cover, counts, np.array([1, 1, 0.01])) == [0, 1, 2]
    assert estimators.min_path_cover(cover[:, :1], counts, np.ones(1)) == [0]


def test_strains_and_noise():
    p = np.array([[0.9, 0.9, 0.0], [0.0, 0.9, 0.0]])
    found, lost, _, chosen = estimators.strains(p, np.array([0.1, 0.1]), np.array([5.0, 5.0]), 1000, 1e-3)
    assert chosen == [1] and found[0] == 0 and found.sum() + lost == pytest.approx(10)
    assert estimators.strains(np.zeros((1, 2)), np.ones(1), np.array([7.0]), 10, 1e-3)[1] == 7.0


def test_gibbs_counts():
    matrix = estimators.with_noise(np.array([[1.0, 0.0], [0.0, 1.0]]), np.zeros(2))
    drawn, noise = estimators.gibbs_counts(matrix, np.array([900.0, 100.0]), np.array([900.0, 100.0, 1e-9]), np.random.default_rng(0), 200, 2)
    assert drawn.shape == (200, 2) and np.allclose(drawn.sum(axis=1) + noise, 1000) and abs(drawn[:, 0].mean() - 900) < 5


@pytest.mark.parametrize("flags", [{}, {"ind_hap_inference": True}, {"use_hap_gibbs": True}, {"num_gibbs_samples": 6}])
def test_nested(flags):
    s = EngineConfig(model="haplotype-transcripts", path_info=True, **flags)
    # transcript 0 has paths 0 and 1, transcript 1 has path 2; reads tell 0 and 1 apart
    p = np.array([[0.9, 0.0, 0.0], [0.0, 0.9, 0.0], [0.0, 0.0, 0.9]])
    counts = np.array([40.0, 20.0, 40.0])
    found = estimators.nested(p, np.full(3, 0.1), counts, [0, 0, 1], [[1], [2], [1, 2]], s, 3)
    assert sum(g[1].sum() for g in found["groups"].values()) + found["noise"] == pytest.approx(100)
    assert found["groups"][0, 1][0] == pytest.approx(1, abs=0.02)
    assert found["groups"][0, 1][1].sum() > found["groups"][2, 2][1].sum()
    assert sum(len(x[1]) for x in found["samples"]) == flags.get("num_gibbs_samples", 0)


def test_path_info(spark, tmp_path):
    (tmp_path / "new.tsv").write_text("Name\tLength\tTranscripts\tHaplotypes\np1\t5\tt1\th1,h2\np2\t6\tt1\th3\n")
    (tmp_path / "old.tsv").write_text("Name\tLength\tTranscripts\tReference\tHaplotypes\np1\t5\tt1\tr\th1,h2,h1\n")
    rows = {r["name"]: r for r in readers.read_path_info(spark, str(tmp_path / "new.tsv")).collect()}
    assert rows["p1"]["source_count"] == 2 and rows["p1"]["group_id"] == rows["p2"]["group_id"] and not set(rows["p1"]["source_ids"]) & set(rows["p2"]["source_ids"])
    assert [r["source_count"] for r in readers.read_path_info(spark, str(tmp_path / "old.tsv"), parse_haplotypes=False).collect()] == [3]
    assert {r["name"] for r in readers.read_path_info(spark, str(tmp_path / "new.tsv"), collapse=True).collect()} == {"t1"}
    (tmp_path / "twice.tsv").write_text("Name\tLength\tTranscripts\tHaplotypes\np1\t5\tt1\th1\np1\t6\tt1\th3\n")
    with pytest.raises(ValueError):
        readers.read_path_info(spark, str(tmp_path / "twice.tsv"))


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Two haplotypes of a transcript that differ in one node, a transcript of its own, and pairs of reads as JSON."""
    folder = tmp_path_factory.mktemp("world")
    nodes = spark.createDataFrame([(i, 20) for i in range(1, 10)], "node_id long, length int")
    walks = {"a1": [1, 2, 4, 5], "a2": [1, 3, 4, 5], "b": [6, 7, 8, 9]}
    steps = spark.createDataFrame([(p, i, n, False) for p, w in enumerate(walks.values()) for i, n in enumerate(w)], "path_id long, ordinal int, node_id long, is_reverse boolean")
    names = spark.createDataFrame(list(enumerate(walks)), "path_id long, name string")
    lines, n = [], 0

    def read(node, offset, mate, reverse=False):
        position = {"node_id": str(node), "offset": str(offset)} | ({"is_reverse": True} if reverse else {})
        return {"pair_id": n, "mate": mate, "sequence": "A" * 10, "mapping_quality": 60, "start": [0], "subpath": [{"path": {"mapping": [{"position": position, "edit": [{"from_length": 10, "to_length": 10}]}]}, "score": 20}], "annotation": {"fragment_length_distribution": "-I 40 -D 8"}}

    for node, mate2, count in ((2, 4, 60), (3, 4, 30), (1, 4, 30), (6, 8, 80)):
        for i in range(count):
            n += 1
            lines += [json.dumps(read(node, i % 8, 1)), json.dumps(read(mate2, (i * 3) % 9, 2, True))]
    n += 1
    lines += [json.dumps(read(99, 0, 1)), json.dumps(read(4, 0, 2, True))]
    (folder / "reads.json").write_text("\n".join(lines))
    (folder / "info.tsv").write_text("Name\tLength\tTranscripts\tHaplotypes\na1\t80\tta\th1\na2\t80\tta\th2\nb\t80\ttb\th1,h2\n")
    return spark, readers.read_alignments(spark, str(folder / "reads.json")), nodes, steps, names, str(folder / "info.tsv"), folder


def test_tpm_where_all_reads_are_noise(spark):
    """As in SQL 0 of 0 is not a number; a slot without a path has 0, and so has the row of unknown reads."""
    from pathquant.operators import inference
    from pathquant.sources import sinks

    result = spark.createDataFrame([(0, "group", [1], 1.0, [0.0], None, None, None), (0, "cluster", None, None, None, 7.0, 7.0, None)], inference.RESULT)
    members = spark.createDataFrame([(0, 1, "a", 10, 8.0), (1, 2, "b", 10, 8.0)], "cluster_id long, path_id long, name string, length long, effective_length double")
    total = inference.tpm_denominator(members.join(inference.path_abundances(result), ["cluster_id", "path_id"]))
    rows = {r["Name"]: r for r in sinks.abundance_table(result, members, total, inference.unknown_count(result)).collect()}
    assert total == 0 and np.isnan([rows["a"]["TPM"], rows["b"]["TPM"]]).all() and (rows["Unknown"]["ReadCount"], rows["Unknown"]["TPM"]) == (7.0, 0.0)
    joint = sinks.joint_table(result, members, 2, 0.0, total, 7.0).where("ClusterID > 0").first()
    assert np.isnan(joint["TPM_1"]) and (joint["Name_2"], joint["TPM_2"]) == (".", 0.0)


def test_transcripts(world):
    spark, reads, nodes, steps, names, _, folder = world
    out = pipeline.run(reads, nodes, steps, names, EngineConfig(model="transcripts", library="fr", num_gibbs_samples=4))
    rows = {r["Name"]: r for r in out.tables["abundances"].collect()}
    assert out.unaligned == 1 and sum(r["ReadCount"] for r in rows.values()) == pytest.approx(201)
    assert sum(r["TPM"] for r in rows.values()) == pytest.approx(1e6)
    assert rows["a1"]["ReadCount"] == pytest.approx(80, abs=3) and rows["a2"]["ReadCount"] == pytest.approx(40, abs=3) and rows["b"]["ReadCount"] == pytest.approx(80, abs=1)
    assert rows["a1"]["ClusterID"] == rows["a2"]["ClusterID"] != rows["b"]["ClusterID"]
    gibbs = out.tables["gibbs"].collect()
    assert {r["Name"] for r in gibbs} == {"a1", "a2", "b", "Unknown"}
    assert all(sum(r[f"ReadCountSample_{k}"] for r in gibbs) == pytest.approx(201) for k in range(1, 5))
    # the cluster of a1 and a2 has more read classes than that of b
    classes = out.probabilities.groupBy("cluster_id").agg({"read_class_id": "count"}).orderBy("cluster_id").collect()
    assert rows["a1"]["ClusterID"] == 1 and rows["b"]["ClusterID"] == 2 and classes[0][1] >= classes[1][1]
    sinks.write_tsv(out.tables["abundances"], str(folder / "out"), gzip=True)
    assert spark.read.option("sep", "\t").option("header", "true").csv(str(folder / "out")).count() == 4
    lines = sinks.probability_lines(out.probabilities, out.members)
    assert lines.where("line = '#'").count() == 2 and lines.where("line_no = 2").count() == out.probabilities.select("read_class_id").distinct().count()
    sinks.write_probability_lines(lines, str(folder / "probs"))


def test_large_clusters_are_estimated_by_joins(world, monkeypatch):
    from pathquant.operators import inference

    _, reads, nodes, steps, names, _, _ = world
    config = EngineConfig(model="transcripts", library="fr")
    dense = pipeline.run(reads, nodes, steps, names, config)
    monkeypatch.setattr(inference, "DENSE_CELLS", 3)
    assert not inference.large_clusters(dense.probabilities, dense.members, 3).isEmpty()
    large = {r["Name"]: r for r in pipeline.run(reads, nodes, steps, names, config).tables["abundances"].collect()}
    for r in dense.tables["abundances"].collect():
        assert large[r["Name"]]["ReadCount"] == pytest.approx(r["ReadCount"], abs=1e-6) and large[r["Name"]]["ClusterID"] == r["ClusterID"]


def test_bidirectional_index(world):
    """Searching one orientation of reads in both of the paths gives what searching both of the reads gives."""
    from pathquant.operators import paths

    _, reads, nodes, steps, names, _, _ = world
    turned = paths.reverse_complement(steps).unionByName(steps.where("path_id = 9"))  # reads lie on the other strand of the paths
    for own in (steps, turned):
        out = [pipeline.run(reads, nodes, own, names, EngineConfig(model="transcripts", path_node_cluster=True), bidirectional=b) for b in (False, True)]
        one, two = ({r["Name"]: r["ReadCount"] for r in o.tables["abundances"].collect()} for o in out)
        assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-6) for k in one) and one["b"] > 70
        assert out[0].unaligned == out[1].unaligned == 1


def test_stored_tables_are_those_of_their_run(spark):
    """A run removes what it has stored, also where another run, in another thread, is not at its end."""
    import threading

    from pathquant.plans import store

    def place(df):
        return Path(df.inputFiles()[0].removeprefix("file://").removeprefix("file:")).parent

    inner, go, ready, kept = {}, threading.Event(), threading.Event(), []

    def other():
        with store.stored_run(spark):
            inner["table"] = store.stored(spark.range(3).toDF("x"), "other")
            ready.set()
            go.wait(60)
            kept.append(inner["table"].count())

    thread = threading.Thread(target=other)
    thread.start()
    assert ready.wait(60)
    with store.stored_run(spark):
        own = place(store.stored(spark.range(3).toDF("x"), "own"))
        assert own.exists()
    path = place(inner["table"])
    assert not own.exists() and path.exists()
    go.set()
    thread.join()
    assert kept == [3] and not path.exists()
    outside = place(store.stored(spark.range(2).toDF("x"), "outside"))
    store.remove_stored(spark, [store._outside.pop()])  # those of other tests stay
    assert not outside.exists()


def test_command_line(world):
    from pathquant.__main__ import main, parser

    spark, _, nodes, steps, names, info, folder = world
    nodes.write.parquet(f"{folder}/graph")
    steps.write.parquet(f"{folder}/index/steps")
    names.write.parquet(f"{folder}/index/paths")
    main(["-g", f"{folder}/graph", "-p", f"{folder}/index", "-a", f"{folder}/reads.json", "-o", f"{folder}/run", "-i", "haplotype-transcripts", "-f", info, "-e", "fr", "-r", "1", "-n", "2", "-b"])
    read = lambda name: spark.read.option("sep", "\t").option("header", "true").csv(f"{folder}/run{name}")
    assert {r["Name"] for r in read("").collect()} == {"a1", "a2", "b", "Unknown"}
    assert read("_joint").columns[:4] == ["Name_1", "Name_2", "ClusterID", "HaplotypingProbability"] and read("_gibbs").columns[-1] == "ReadCountSample_2"
    assert spark.read.text(f"{folder}/run_probs").where("value = '#'").count() == 2
    flags = {o for a in parser()._actions for o in a.option_strings if o.startswith("--")}
    assert len(flags - {"--interleaved", "--bidirectional"}) == 33


def test_records_stay_apart(spark, tmp_path):
    """Equal records without a name or pair id are reads of their own; pairs in consecutive lines meet; ids are the same in every run."""
    record = json.dumps({"sequence": "ACGT", "path": {"mapping": [{"position": {"node_id": "1"}, "edit": [{"from_length": 4, "to_length": 4}]}]}})
    for name, lines in (("a", 3), ("b", 4)):
        (tmp_path / f"{name}.json").write_text("\n".join([record] * lines))
    rows = [sorted(map(tuple, readers.read_alignments(spark, str(tmp_path), multipath=False).select("read_id", "mate").collect())) for _ in range(2)]
    assert rows[0] == rows[1] == [(i, 1) for i in range(7)]
    for n, wide in ((1, 4), (2, 300)):
        folder = tmp_path / f"pairs{n}"
        folder.mkdir()
        (folder / "a.json").write_text("\n".join(json.dumps({"sequence": "A" * wide, "name": str(i)}) for i in range(400)))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        got = readers.read_alignments(spark, str(folder), multipath=False, interleaved=True).select("read_id", "mate").collect()
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted(map(tuple, got)) == [(i // 2, i % 2 + 1) for i in range(400)]
    given = json.dumps({"sequence": "A", "pair_id": 9, "mate": 2})
    (tmp_path / "c.json").write_text(given + "\n" + record)
    assert sorted(r["read_id"] for r in readers.read_alignments(spark, str(tmp_path / "c.json"), multipath=False).collect()) == [9, 11]


def test_haplotypes(world):
    _, reads, nodes, steps, names, _, _ = world
    for gibbs in (False, True):
        out = pipeline.run(reads, nodes, steps, names, EngineConfig(model="haplotypes", library="fr", use_hap_gibbs=gibbs))
        rows = {tuple(sorted((r["Name_1"], r["Name_2"]))): r["HaplotypingProbability"] for r in out.tables["haplotypes"].collect()}
        assert rows["a1", "a2"] > 0.99 and rows["b", "b"] > 0.99


def test_strains(world):
    _, reads, nodes, steps, names, _, _ = world
    out = pipeline.run(reads, nodes, steps, names, EngineConfig(model="strains", library="fr"))
    rows = {r["Name"]: r["ReadCount"] for r in out.tables["abundances"].collect()}
    assert sum(rows.values()) == pytest.approx(201) and rows["a1"] > rows["a2"] > 0


def test_haplotype_transcripts(world):
    spark, reads, nodes, steps, names, info, _ = world
    config = EngineConfig(model="haplotype-transcripts", library="fr", path_info=True, num_gibbs_samples=3)
    out = pipeline.run(reads, nodes, steps, names, config, readers.read_path_info(spark, info))
    rows = {r["Name"]: r for r in out.tables["abundances"].collect()}
    assert sum(r["ReadCount"] for r in rows.values()) == pytest.approx(201) and rows["a1"]["HaplotypeProbability"] > 0.99 and rows["b"]["HaplotypeProbability"] > 0.99
    joint = out.tables["joint"].collect()
    assert sum(r["ReadCount_1"] + r["ReadCount_2"] for r in joint) == pytest.approx(201)
    assert {(r["Name_1"], r["Name_2"]) for r in joint if r["HaplotypingProbability"] > 0.5} == {("a1", "a2"), ("b", "b")}


def test_collapsed_transcripts(world):
    spark, reads, nodes, steps, names, info, _ = world
    out = pipeline.run(reads, nodes, steps, names, EngineConfig(model="transcripts", library="fr", path_info=True), readers.read_path_info(spark, info, parse_haplotypes=False))
    rows = {r["Name"]: r["ReadCount"] for r in out.tables["abundances"].collect()}
    assert set(rows) == {"ta", "tb", "Unknown"} and rows["ta"] == pytest.approx(120, abs=1)


def test_settings():
    for bad in ({"model": "x"}, {"ploidy": 0}, {"frag_mean": 1.0}, {"single_end": True}, {"model": "haplotype-transcripts"}, {"library": "ff"}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)
    assert EngineConfig(long_reads=True).single_end and EngineConfig(path_info=True).collapse


def test_em_on_lists_and_arrays(monkeypatch):
    rng = np.random.default_rng(4)
    for _ in range(200):
        n, k = rng.integers(1, 6), rng.integers(1, 6)
        matrix = estimators.with_noise(rng.random((n, k)) * (rng.random((n, k)) < 0.7), rng.random(n) * 0.2)
        counts = rng.integers(1, 9, n).astype(float)
        monkeypatch.setattr(estimators, "SMALL_CELLS", 48)
        one = estimators.em(matrix, counts)
        monkeypatch.setattr(estimators, "SMALL_CELLS", 0)
        two = estimators.em(matrix, counts)
        assert np.allclose(one[0], two[0], atol=1e-6) and one[1] == pytest.approx(two[1], abs=1e-6)


def test_reads_are_dealt_once_to_tasks_by_their_number(spark, monkeypatch):
    """Tasks hold a bounded number of rows, and nothing that goes read by read is exchanged again."""
    from pathquant.operators import probs as P
    from pathquant.plans.queries import DIST, align_rows, members

    rows = align_rows(spark, "/root/testdata/sf0.001")
    want = P.grouped(P.read_path_probs(rows, DIST), members(spark, "/root/testdata/sf0.001")).collect()
    monkeypatch.setattr(P, "TASK_ROWS", 1000)
    found = P.grouped(P.read_path_probs(rows, DIST), members(spark, "/root/testdata/sf0.001"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and found.rdd.getNumPartitions() == -(-rows.count() // 1000) > 4
    assert sorted(map(str, found.collect())) == sorted(map(str, want))


def test_more_rows_than_a_task_takes_are_not_put_together_again(spark, monkeypatch):
    """Where the session has more partitions than the rows need, as with 200 of them, the number of tasks is still given."""
    from pathquant.operators import probs as P
    from pathquant.plans.queries import DIST, align_rows

    rows = align_rows(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(P, "TASK_ROWS", -(-rows.count() // 2))
    assert P.read_path_probs(rows, DIST).rdd.getNumPartitions() == 4
    monkeypatch.setattr(P, "TASK_ROWS", rows.count())
    assert P.read_path_probs(rows, DIST).rdd.getNumPartitions() < 4  # few rows: by Spark's own choice


def test_the_lines_of_a_cluster_are_written_in_several_parts(spark, tmp_path):
    from pathquant.sources import sinks

    lines = spark.range(4000).selectExpr("id % 2 AS cluster_id", "2 AS line_no", "concat('1 0.5 ', lpad(id, 6, '0')) AS line")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join parts as small as these
    try:
        sinks.write_probability_lines(lines.repartition(4), str(tmp_path / "dump"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [[r["value"] for r in spark.read.text(str(p)).collect()] for p in sorted((tmp_path / "dump").glob("part*"))]
    parts = [p for p in parts if p]
    assert len(parts) > 2
    assert [x for p in parts for x in p] == [f"1 0.5 {i:06d}" for c in (0, 1) for i in range(c, 4000, 2)]
