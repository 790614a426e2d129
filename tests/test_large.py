"""Clusters as frames against clusters as arrays."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathquant.config import EngineConfig
from pathquant.operators import components, estimators, inference, large
from pathquant.plans.operator_queries import QUERIES

SF = "/root/testdata/sf0.001"


def world(spark, seed, noise=None):
    """Read probabilities and members of six clusters; one has a single path, one reads that are all noise, one none."""
    rng = random.Random(seed)
    probs, members = [], []
    for c in range(6):
        paths_ = [100 * c + k for k in range(1 if c == 0 else rng.randint(3, 7))]
        for p in paths_:
            members.append((c, p, rng.randint(1, 3), p % 3, sorted(rng.sample(range(6), rng.randint(1, 3)))))
        for r in range(0 if c == 5 else 14):
            own = rng.sample(paths_, rng.randint(1, min(4, len(paths_))))
            lost = 1.0 if c == 4 and r % 2 else noise if noise is not None else rng.choice([0.05, 0.2, 0.0001])
            if lost == 1.0:
                probs.append((c, 1000 * c + r, rng.randint(1, 9), 1.0, None, None))
                continue
            raw = [rng.choice([0.5, 1.0, 2.0]) for _ in own]
            probs += [(c, 1000 * c + r, 3 + r % 4, lost, p, x / sum(raw) * (1 - lost)) for p, x in zip(own, raw)]
    return (
        spark.createDataFrame(probs, "cluster_id long, read_class_id long, read_count long, noise_prob double, path_id long, prob double"),
        spark.createDataFrame(members, "cluster_id long, path_id long, source_count int, group_id long, source_ids array<long>"),
    )


def close(rows):
    """Rows by what they are of, with numbers."""
    return {(r["cluster_id"], r["kind"], tuple(r["path_ids"] or ())): (r["posterior"] or 0.0, list(r["counts"] or ()), r["noise_count"] or 0.0, r["total_count"] or 0.0) for r in rows}


@pytest.mark.parametrize("cells", [1, 40])
@pytest.mark.parametrize("settings", [{"model": "strains"}, {"model": "haplotypes"}, {"model": "haplotypes", "ploidy": 1}, {"model": "haplotype-transcripts", "path_info": True}, {"model": "haplotype-transcripts", "path_info": True, "ploidy": 1}], ids=str)
def test_frames_give_what_arrays_give(spark, monkeypatch, settings, cells):
    config = EngineConfig(**settings)
    assert large.supported(config)
    probs, members = world(spark, 7)
    want = close(inference.infer(probs, members, config).collect())
    monkeypatch.setattr(inference, "DENSE_CELLS", cells)
    got = close(inference.infer(probs, members, config).collect())
    assert got.keys() == want.keys()
    for key, (posterior, counts, noise, total) in want.items():
        own = got[key]
        assert own[0] == pytest.approx(posterior, rel=1e-6, abs=1e-9) and own[1] == pytest.approx(counts, rel=1e-4, abs=1e-4), key
        assert own[2] == pytest.approx(noise, rel=1e-4, abs=1e-4) and own[3] == pytest.approx(total), key


@pytest.mark.parametrize("seed", range(3))
def test_picks_in_rounds_are_the_greedy_cover(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(c), int(r), int(rng.integers(1, 6)), int(p), float(rng.choice([1.0, 0.5, 0.25, 0.1]))) for c in range(3) for r in range(60) for p in rng.choice(12, size=rng.integers(1, 5), replace=False)]
    counts = {(c, r): n for c, r, n, _, _ in rows}
    rows = [(c, r, float(counts[c, r]), p, x) for c, r, _, p, x in rows]
    got = {}
    for row in large.path_cover(spark.createDataFrame(rows, "cluster_id long, read_class_id long, read_count double, path_id long, prob double")).collect():
        got.setdefault(row["cluster_id"], []).append(row["path_id"])
    for c in range(3):
        cover, prob, n = np.zeros((60, 12), bool), np.ones((60, 12)), np.zeros(60)
        for c2, r, k, p, x in rows:
            if c2 == c:
                cover[r, p], prob[r, p], n[r] = True, x, k
        weights = 0.0 - (np.log(prob) * n[:, None]).sum(axis=0)
        assert sorted(got[c]) == estimators.min_path_cover(cover, n, weights)


def test_paths_that_reads_need_are_picked_at_once(spark, monkeypatch):
    """Every two of twelve paths share a read, and each has one of its own: one by one, they would take twelve rounds."""
    rounds = []
    monkeypatch.setattr(large, "stored", lambda df, name, own=large.stored: rounds.append(name) or own(df, name))
    pairs = [(i, j) for i in range(12) for j in range(i, 12)]
    rows = [(0, r, 1.0 + r % 3, p, 0.5) for r, pair in enumerate(pairs) for p in set(pair)]
    found = large.path_cover(spark.createDataFrame(rows, "cluster_id long, read_class_id long, read_count double, path_id long, prob double")).collect()
    assert sorted(r["path_id"] for r in found) == list(range(12)) and rounds.count("cover-picked") == 1


def test_a_weight_of_zero_is_picked_first():
    probs = np.array([[1.0, 0.0], [0.5, 0.5]])
    assert estimators.strains(probs[:1], np.zeros(1), np.ones(1), 100, 0.001)[3] == [0]
    assert estimators.min_path_cover(np.array([[True, True]]), np.ones(1), 0.0 - np.array([0.5, 0.0])) == [1]


@pytest.mark.parametrize("name", ["strains", "nested_collapsed", "bounded_posterior"])
def test_queries_as_frames(spark, monkeypatch, name):
    """The queries that have SQL give the same where every cluster is a large one."""
    want = sorted(map(tuple, QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(inference, "DENSE_CELLS", 1 if name == "strains" else 50)
    got = sorted(map(tuple, QUERIES[name](spark, SF).collect()))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=0.02 if name != "bounded_posterior" else 1e-5)


def test_all_combinations_are_weighed(monkeypatch):
    """Posteriors of the listed combinations do not depend on how many are listed."""
    rng = np.random.default_rng(3)
    probs, noise, counts = rng.random((20, 7)) ** 8, np.full(20, 1e-3), rng.integers(1, 9, 20).astype(float)
    for exact in (False, True):
        groups, post = estimators.group_posteriors(probs, noise, counts, np.ones(7), 3, exact=exact)
        assert len(groups) == 84 and post.sum() == pytest.approx(1)
        monkeypatch.setattr(estimators, "LISTED", 10)
        monkeypatch.setattr(estimators, "LISTED_CUT", 1e-3)
        monkeypatch.setattr(estimators, "GROUP_CELLS", 100)
        few, own = estimators.group_posteriors(probs, noise, counts, np.ones(7), 3, exact=exact)
        monkeypatch.undo()
        every = dict(zip(groups, post))
        assert 0 < len(few) < 84 and own == pytest.approx([every[g] for g in few])
        assert all(p < 1e-2 for g, p in every.items() if g not in few)


def test_chains_in_tasks_are_the_chains_of_one(spark, monkeypatch):
    """However the chains of the haplotype sampler are dealt, the samples are the same, and near the exact posteriors."""
    from pathquant.operators import samplers

    probs, members = world(spark, 3, noise=0.05)
    config = EngineConfig(model="haplotypes", use_hap_gibbs=True, seed=5)
    want = sorted(map(str, inference.infer(probs, members, config).collect()))
    assert want == sorted(map(str, inference.infer(probs.repartition(7), members.repartition(3), config).collect()))
    monkeypatch.setattr(samplers, "WORK", 2_000)
    assert want == sorted(map(str, inference.infer(probs, members, config).collect()))
    other = EngineConfig(model="haplotypes", use_hap_gibbs=True, seed=6)
    assert want != sorted(map(str, inference.infer(probs, members, other).collect()))
    rows = inference.infer(probs, members, config).collect()
    exact = {(r["cluster_id"], tuple(r["path_ids"])): r["posterior"] for r in inference.infer(probs, members, EngineConfig(model="haplotypes")).collect() if r["kind"] == "group"}
    drawn = {(r["cluster_id"], tuple(r["path_ids"])): r["posterior"] for r in rows if r["kind"] == "group"}
    assert all(abs(drawn.get(k, 0.0) - p) < 0.1 for k, p in exact.items())
    assert sum(drawn.values()) == pytest.approx(len({c for c, _ in drawn})) and {r["cluster_id"] for r in rows if r["kind"] == "cluster"} == set(range(6))


def brute_merge(rows, precision):
    """rows: (cells, count) -> merged in lexicographic order."""
    out = []
    for cells, n in sorted(rows):
        if out and all(abs(a - b) < precision for a, b in zip(out[-1][0], cells)):
            out[-1][1] += n
        else:
            out.append([cells, n])
    return [(c, n) for c, n in out]


@pytest.mark.parametrize("few", [0, 10**6])
@pytest.mark.parametrize("seed", range(4))
def test_rows_merge_within_the_precision(monkeypatch, seed, few):
    """Also rows on both sides of a rounding bound, and chains of near rows of which only those near to the first are merged."""
    monkeypatch.setattr(estimators, "FEW_CELLS", few)
    rng = np.random.default_rng(seed)
    precision = [0.05, 0.05, 1e-8, 0.125][seed]
    base = rng.choice([0.0, 0.1, 0.149999, 0.15, 0.25], size=(300, 3))
    matrix = np.clip(base + rng.choice([0, 0, 1e-9, 0.03, 0.0499], size=base.shape), 0, 1)
    counts = rng.integers(1, 5, 300).astype(float)
    want = brute_merge([(tuple(r), n) for r, n in zip(matrix.tolist(), counts.tolist())], precision)
    rows, merged = estimators.collapse_reads(matrix, counts, precision)
    assert sorted((tuple(r), n) for r, n in zip(rows.tolist(), merged.tolist())) == want
    kept, members = estimators.collapse_paths(np.ascontiguousarray(matrix.T), precision)
    assert sorted(len(m) for m in members) == sorted(len(g) for g in _groups(matrix, precision)) and kept.shape[1] == len(members)


def _groups(matrix, precision):
    groups = []
    for row in sorted(map(tuple, matrix.tolist())):
        if groups and all(abs(a - b) < precision for a, b in zip(groups[-1][0], row)):
            groups[-1].append(row)
        else:
            groups.append([row])
    return groups


def test_equal_hashes_do_not_merge_rows(monkeypatch):
    matrix = np.array([[0.1, 0.2], [0.2, 0.1], [0.1, 0.2], [0.3, 0.3]])
    monkeypatch.setattr(estimators, "_weights", lambda columns: np.zeros(columns, np.uint64))
    monkeypatch.setattr(estimators, "FEW_CELLS", 0)
    rows, counts = estimators.collapse_reads(matrix, np.ones(4))
    assert sorted((tuple(r), n) for r, n in zip(rows.tolist(), counts.tolist())) == [((0.1, 0.2), 2), ((0.2, 0.1), 1), ((0.3, 0.3), 1)]


@pytest.mark.parametrize("batch", [10_000, 3])
def test_classes_merge_within_the_precision(spark, batch):
    from pathquant.operators import probs

    rng = random.Random(batch)
    rows, want = [], {}
    for r in range(400):
        cluster, paths_ = r % 3, tuple(sorted(rng.sample(range(4), rng.randint(0, 3))))
        noise = rng.choice([0.1, 0.149, 0.151, 0.19, 0.2, 0.24]) if paths_ else 1.0
        cells = (noise, *(rng.choice([0.05, 0.1, 0.149, 0.151]) for _ in paths_))
        n = rng.randint(1, 5)
        want.setdefault((cluster, paths_), []).append((cells, n))
        rows += [(cluster, r, n, noise, p, x) for p, x in zip(paths_, cells[1:])] or [(cluster, r, n, noise, None, None)]
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, str(batch))
    try:
        merged = probs.merge_identical(spark.createDataFrame(rows, "cluster_id long, read_class_id long, read_count long, noise_prob double, path_id long, prob double"), 0.05).collect()
    finally:
        spark.conf.set(conf, before)
    got = {}
    for r in merged:
        got.setdefault((r["cluster_id"], r["read_class_id"], r["read_count"], r["noise_prob"]), []).append((r["path_id"], r["prob"]))
    found = {}
    for (cluster, _, n, noise), cells in got.items():
        cells = sorted((p, x) for p, x in cells if p is not None)
        found.setdefault((cluster, tuple(p for p, _ in cells)), []).append(((noise, *(x for _, x in cells)), n))

    def segments(values):
        out, number = {}, 0
        for before, x in zip([None, *sorted(values)], sorted(values)):
            number += before is not None and x - before >= 0.05
            out[x] = number
        return out

    # classes on two sides of a gap, in noise or in the first probability, do not come between each other
    noise = {c: segments({v[0] for (c2, _), own in want.items() for v, _ in own if c2 == c}) for c in range(3)}
    first = {(c, k): segments({v[1] for (c2, q), own in want.items() for v, _ in own if c2 == c and q[:1] == (k,)}) for c in range(3) for k in range(4)}
    parted = {}
    for (c, q), own in want.items():
        for v, n in own:
            parted.setdefault((c, q, noise[c][v[0]], first[c, q[0]][v[1]] if q else 0), []).append((v, n))
    merged_apart = {}
    for (c, q, *_), own in parted.items():
        merged_apart.setdefault((c, q), []).extend(brute_merge(own, 0.05))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in merged_apart.items()}


@pytest.mark.parametrize("seed", range(2))
def test_components_can_be_extended(spark, seed):
    from pathquant.operators.components import connected_components, extended_components

    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(0, i) for i in range(60, 75)] + [(None, 3), (80, 80)]
    rng.shuffle(edges)
    df = spark.createDataFrame([(a, b, i % 3) for i, (a, b) in enumerate(edges)], "a long, b long, part int")
    want = sorted(map(tuple, connected_components(df, "a", "b").collect()))
    labels = connected_components(df.where("part = 0"), "a", "b")
    for part in (1, 2):
        labels = extended_components(labels, df.where(f"part = {part}"), "a", "b")
    assert sorted(map(tuple, labels.collect())) == want
    assert sorted(map(tuple, extended_components(labels.limit(0), df, "a", "b").collect())) == want
    assert sorted(map(tuple, extended_components(connected_components(df, "a", "b"), df.limit(0), "a", "b").collect())) == want


@pytest.mark.parametrize("seed", range(2))
def test_paths_merge_without_an_array(spark, seed):
    """Paths near to the first one kept, chains of near ones, faint ones, and such as have equal sums only."""
    from pathquant.operators import probs

    rng, precision = random.Random(seed), 0.05
    columns = {}
    for c in range(3):
        base = [[rng.choice([0.0, 0.3, 0.7]) for _ in range(8)] for _ in range(3)]
        for p in range(12):
            columns[c, p] = [max(0.0, x + rng.choice([0, 0, 0.03, -0.03])) for x in rng.choice(base)]
        columns[c, 12], columns[c, 13] = [0.02] * 8, [0.0] * 7 + [0.04]
        columns[c, 14], columns[c, 15] = columns[c, 0][::-1], columns[c, 0]
    want = {}
    for c, p in sorted(columns):
        if any(columns[c, p]):
            want[c, p] = next((q for (c2, q), k in want.items() if c2 == c and q == k and all(abs(x - y) < precision for x, y in zip(columns[c, q], columns[c, p]))), p)
    rows = [(c, r, p, x) for (c, p), own in columns.items() for r, x in enumerate(own) if x]
    got = probs.merge_paths(spark.createDataFrame(rows, "cluster_id long, read_class_id long, path_id long, prob double"), precision)
    assert {(r["cluster_id"], r["path_id"]): r["kept"] for r in got.collect()} == want


@pytest.mark.parametrize("name", ["read_collapse", "path_collapse", "detract_noise"])
def test_no_cluster_is_gathered(spark, name):
    """Rows and columns of a cluster are merged as frames: no function gets a cluster as a group."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan


@pytest.mark.parametrize("cells", [10**6, 12])
def test_counts_are_sampled_without_an_array(spark, monkeypatch, cells):
    """Samples of large clusters, in one block or several, have the means that arrays give, and hold all reads; reruns agree."""
    from pathquant.operators import packed

    probs, members = world(spark, 3)
    config = EngineConfig(model="transcripts", num_gibbs_samples=4, gibbs_thin_its=1, max_em_its=4)
    want = close(inference.infer(probs, members, EngineConfig(model="transcripts", max_em_its=4)).collect())
    monkeypatch.setattr(inference, "DENSE_CELLS", 1)
    monkeypatch.setattr(packed, "BLOCK_CELLS", cells)
    rows = [r for r in inference.infer(probs, members, config).collect() if r["cluster_id"] < 5]
    got = close(r for r in rows if r["kind"] != "sample")
    assert all(got[k][1] == pytest.approx(v[1], rel=1e-4, abs=1e-4) for k, v in want.items() if k[0] < 5)
    drawn = {}
    for r in rows:
        if r["kind"] == "sample":
            assert sum(r["counts"]) + r["noise_count"] == pytest.approx(r["total_count"])
            drawn.setdefault((r["cluster_id"], tuple(r["path_ids"])), {})[r["sample"]] = r["counts"]
    assert {c for c, _ in drawn} == set(range(5)) and all(sorted(x) == list(range(1, 5)) for x in drawn.values())
    for (c, paths_), own in drawn.items():
        exact = np.array([want[c, "group", (p,)][1][0] for p in paths_])
        assert (np.abs(np.mean(list(own.values()), axis=0) - exact) < 25).all()
    again = [r for r in inference.infer(probs, members, config).collect() if r["kind"] == "sample" and r["cluster_id"] < 5]
    assert sorted(map(str, again)) == sorted(str(r) for r in rows if r["kind"] == "sample")


def test_pairs_are_sampled_without_an_array(spark, monkeypatch):
    """The sampler of pairs makes no array of reads by paths."""
    from pathquant.operators import samplers

    probs, members = world(spark, 3, noise=0.05)
    monkeypatch.setattr(samplers, "_dense", None)
    rows = inference.infer(probs, members, EngineConfig(model="haplotypes", use_hap_gibbs=True)).where("kind = 'group'").collect()
    assert {r["cluster_id"] for r in rows} == set(range(5))


def test_transcripts_are_drawn_without_an_array(spark, monkeypatch):
    """Nested models with every transcript by itself: frames draw the same subsets, and give the same counts, as arrays."""
    config = EngineConfig(model="haplotype-transcripts", path_info=True, ind_hap_inference=True, min_hap_prob=0.05)
    assert large.supported(config)
    probs, members = world(spark, 7)
    want = close(inference.infer(probs, members, config).collect())
    monkeypatch.setattr(inference, "DENSE_CELLS", 40)
    over = inference.large_clusters(probs, members, 40)
    own = [x.join(over, "cluster_id", "left_semi") for x in (probs, members)]
    got = close(large.infer(*own, config).collect())
    assert got and got.keys() == {k for k in want if k[0] in {c for c, *_ in got}}
    for key, own in got.items():
        assert own[0] == pytest.approx(want[key][0]) and own[1] == pytest.approx(want[key][1], rel=1e-4, abs=1e-4) and own[2] == pytest.approx(want[key][2], rel=1e-4, abs=1e-4), key


@pytest.mark.parametrize("ploidy, listed", [(2, 5_000_000), (3, 5_000_000), (3, 10)])
def test_combinations_in_tasks_are_those_of_one(spark, monkeypatch, ploidy, listed):
    from pathquant.operators import multisets

    config = EngineConfig(model="haplotypes", ploidy=ploidy)
    monkeypatch.setattr(estimators, "LISTED", listed)
    probs, members = world(spark, 7)
    want = close(estimated for estimated in inference._infer_dense(probs, members, config).where("cluster_id < 5").collect())
    monkeypatch.setattr(multisets, "MANY", 0)
    monkeypatch.setattr(multisets, "DEALT", 5)
    monkeypatch.setattr(multisets, "CHUNK", 3)
    assert multisets.many(probs, members, ploidy, 10_000).count() == 5
    got = close(inference.infer(probs, members, config).where("cluster_id < 5").collect())
    if listed > 10:
        assert got.keys() == want.keys()
    for key, (posterior, counts, noise, total) in got.items():
        assert posterior == pytest.approx(want[key][0], rel=1e-6, abs=1e-12) and total == pytest.approx(want[key][3]), key


def test_components_are_dealt_by_their_number(spark, monkeypatch):
    """Where edges are many, tasks are as many as they need, hubs stay where they are, and components are the same."""
    rng = random.Random(5)
    rows = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(1000, x) for x in range(2000, 2100)] + [(7, 7), (9000, 9000), (None, 3)]
    edges = spark.createDataFrame(rows, "a long, b long")
    want = {tuple(r) for r in components.connected_components(edges, "a", "b").collect()}
    dealt = []
    monkeypatch.setattr(components, "TASK_ROWS", 200)
    monkeypatch.setattr(components, "HOT", 50)
    real = components._dealt
    monkeypatch.setattr(components, "_dealt", lambda df, parts, *by: dealt.append(parts) or real(df, parts, *by))
    assert {tuple(r) for r in components.connected_components(edges, "a", "b").collect()} == want
    assert set(dealt) == {4}
    known = components.connected_components(edges.where("a != 1000"), "a", "b").localCheckpoint()
    assert {tuple(r) for r in components.extended_components(known, edges.where("a = 1000 OR a < 9"), "a", "b").collect()} == want
