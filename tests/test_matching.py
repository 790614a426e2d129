"""Matching on small graphs with known results."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pathquant.config import EngineConfig
from pathquant.operators import matching, paths
from tests_support import SCHEMA, index, m, multi, single

def found(spark, steps, reads, max_fragment=1000, bidirectional=False, **config):
    config = {"score_not_qual": True, "max_partial_offset": 0, "filt_best_score": 0.0, "frag_mean": 1.0, "frag_sd": 1.0, **config}
    df = spark.createDataFrame(reads, SCHEMA)
    return matching.alignment_rows(df, steps, EngineConfig(**config), max_fragment, bidirectional).collect()


def best(rows):
    """path -> (align length, score, fragment) of the longest, then best row."""
    out = {}
    for r in rows:
        out[r["path_id"]] = max(out.get(r["path_id"], (-1,)), (r["align_length"], r["score_sum"], r["frag_length"]))
    return out


def test_single(spark):
    steps = index(spark, {1: 4, 2: 1, 3: 1, 4: 8}, [1, 2, 4, "rc"], [1, 2])
    read = single([m(1, 2, offset=2), m(2, 1), m(4, 1, 2, 2)], 8, 4)
    rows = found(spark, steps, [read], single_end=True)
    assert best(rows) == {0: (8, 4, 8), 1: (8, 4, 8)} and all(r["is_simple"] and r["min_mapq"] == 10 for r in rows)
    assert found(spark, steps, [single([m(1, 2, offset=2), m(3, 1), m(4, 5)], 8, 4)], single_end=True) == []
    assert set(best(found(spark, steps, [read], single_end=True, library="fr"))) == {0}
    assert set(best(found(spark, steps, [read], single_end=True, library="rf"))) == {1}


def test_paired(spark):
    steps = index(spark, {1: 4, 2: 1, 3: 1, 4: 8, 5: 2, 6: 7}, [1, 2, 4, 5, 6], [-6, -4, -2, -1, "rc"], [1, 2, 6])
    one = single([m(1, 2, offset=2), m(2, 1), m(4, 5)], 8, 8)
    two = single([m(-6, 2, 1, 1, offset=1)], 4, 2, 20, 2)
    rows = found(spark, steps, [one, two])
    # path ids follow the order of insertion: 0, then 1 and its reverse 2, then 3
    assert best(rows) == {0: (12, 10, 19), 2: (12, 10, 17), 1: (12, 10, 17)}
    assert not any(r["is_simple"] for r in rows) and {r["min_mapq"] for r in rows} == {10}
    assert found(spark, steps, [one, single([m(6, 4, offset=1)], 4, 2, 20, 2)]) == []


def test_circular(spark):
    steps = index(spark, {1: 4, 2: 4, 3: 4}, [1, 2, 3], [1, 2, 2, 2, 3, "rc"])
    rows = found(spark, steps, [single([m(1, 2, offset=2)], 2, 2), single([m(-3, 2, offset=0)], 2, 2, 20, 2)])
    got = best(rows)
    assert set(got) == {0, 1, 2} and got[1][2] - got[0][2] == 8 and got[1] == got[2]


def test_multipath_single(spark):
    steps = index(spark, {1: 1, 2: 1, 3: 3, 4: 2, 5: 3, 6: 3}, [1, 3, 4, 5], [-6, -4, -3, -1])
    parts = [([m(1, 1)], 1, [2]), ([m(2, 1)], -1, [2]), ([m(3, 3), m(4, 2)], 5, [3, 4]), ([m(5, 2)], 2, None), ([m(6, 2)], 0, None)]
    assert best(found(spark, steps, [multi([0, 1], parts, 8)], single_end=True)) == {0: (8, 8, 8), 1: (8, 6, 8)}


PAIR = (
    multi([0, 1, 2], [([m(1, (None, 3), 1)], 1, [3]), ([m(1, 1), m(2, (1, None), 3)], 3, [3]), ([m(2, 4)], 4, [3]), ([m(3, 2)], 2, None)], 6),
    multi([0], [([m(-9, 1, offset=2)], 1, [1, 2, 5]), ([m(-8, 3)], 3, [8]), ([m(-7, 1)], 1, [3]), ([m(-7, (None, 1), offset=1)], -1, [4]), ([m(-7, 1, offset=1)], 1, [8]), ([m(-6, (None, 2))], -2, [6]), ([m(-6, (1, None))], -1, [7]), ([m(-6, (None, 1), offset=1)], -1, [8]), ([m(-5, 1, (None, 2))], 1, None)], 7, 20, 2, {"allelic_mapq": "5"}),
)


def wide(spark):
    return index(spark, {1: 1, 2: 4, 3: 2, 4: 4, 5: 2, 6: 1, 7: 2, 8: 3, 9: 3}, [1, 3, 5, 6, 9], [2, 3, 4, 5, 7, 9, "rc"])


def test_multipath_paired(spark):
    steps = wide(spark)
    rows = found(spark, steps, PAIR)
    assert best(rows) == {1: (11, 9, 16), 0: (8, 1, 12), 2: (11, 9, 16)} and {r["min_mapq"] for r in rows} == {10}
    assert {r["min_mapq"] for r in found(spark, steps, PAIR, use_allelic_mapq=True)} == {5}
    assert set(best(found(spark, steps, PAIR, library="rf"))) == {2}
    assert set(best(found(spark, steps, PAIR, max_fragment=12))) == {0} and found(spark, steps, PAIR, max_fragment=11) == []
    assert {r["noise_score"] for r in found(spark, steps, PAIR, filt_best_score=0.9)} == {0}


@pytest.fixture(scope="module")
def long_read():
    return single([m(1, 1, offset=1), m(3, 1), m(5, 3), m(6, 3), m(7, 3), m(8, 3), m(10, 3), m(11, 1)], 18)


NODES = {1: 2, 2: 1, 3: 1, 4: 1, 5: 3, 6: 3, 7: 3, 8: 2, 9: 3, 10: 3, 11: 1}


@pytest.mark.parametrize("k, want", [(0, {3}), (2, {1, 3}), (3, {1, 3}), (4, {1, 2, 3})])
def test_partial_single(spark, long_read, k, want):
    steps = index(spark, NODES, [1, 2, 5, 6, 7, 8, 9, 11], [1, 2, 5, 6, 7, 8, 10, 11], [1, 3, 5, 6, 7, 8, 9, 11], [1, 3, 5, 6, 7, 8, 10, 11])
    assert set(best(found(spark, steps, [long_read], single_end=True, library="fr", max_partial_offset=k))) == want


@pytest.mark.parametrize("path, k, hit", [([1, 3, 5, 6, 7, 8, 9, 11], 3, False), ([1, 3, 5, 6, 7, 8, 9, 11], 8, True), ([1, 2, 5, 6, 7, 8, 9, 11], 3, False), ([1, 2, 5, 6, 7, 8, 9, 11], 4, True), ([1, 2, 5, 6, 7, 8, 9, 11], 0, False)])
def test_partial_ends(spark, long_read, path, k, hit):
    assert bool(found(spark, index(spark, NODES, path), [long_read], single_end=True, library="fr", max_partial_offset=k)) == hit


def test_read_past_the_path(spark):
    assert found(spark, index(spark, {1: 2, 2: 1}, [1]), [single([m(1, 2), m(2, 1)], 3)], single_end=True, library="fr", max_partial_offset=1000)


def test_node_queries(spark):
    steps = index(spark, {1: 4, 2: 32, 3: 1, 4: 2}, [1, 2, 4], [1, 3, 4], [1, 2, 1, 2])
    assert sorted(map(tuple, paths.find(steps, 1, False).collect())) == [(0, 0), (1, 0), (2, 0), (2, 2)]
    moved = paths.extend(paths.find(steps, 1, False), steps, 2, False)
    assert sorted(map(tuple, moved.collect())) == [(0, 1), (2, 1), (2, 3)]
    assert sorted(r[0] for r in paths.locate(moved).collect()) == [0, 2]
    assert sorted((r["node_id"], r["next_node"]) for r in paths.out_edges(steps).collect()) == [(1, 2), (1, 3), (2, 1), (2, 4), (3, 4)]
    assert [(r["node_id"], r["is_reverse"]) for r in paths.reverse_complement(steps).where("path_id = 0").orderBy("ordinal").collect()] == [(4, True), (2, True), (1, True)]


def bubbles(k, seed):
    """A read over k bubbles, each with two nodes, as a graph of subpaths; lengths of nodes; random paths through them."""
    rng = random.Random(seed)
    parts, lengths = [([m(1, 3)], 3, [1, 2])], {1: 3}
    for b in range(k):
        left, right, join = 3 * b + 2, 3 * b + 3, 3 * b + 4
        lengths |= {left: 1, right: 1, join: 2}
        at = len(parts)
        parts += [([m(left, 1)], 1, [at + 2]), ([m(right, (1, 1))], -4, [at + 2]), ([m(join, 2)], 2, [at + 3, at + 4] if b < k - 1 else None)]
    paths = []
    for _ in range(5):
        path = [1]
        for b in range(k):
            path += [3 * b + 2 + rng.randint(0, 1), 3 * b + 4]
        paths.append(path)
    paths.append(paths[0][2:])  # begins inside the read
    paths.append(paths[1][:-1])
    paths.append([-x for x in reversed(paths[2])])
    return lengths, paths, multi([0], parts, 3 + 3 * k)


@pytest.mark.parametrize("partial", [0, 4])
def test_pruned_graphs_match_as_listed_ones(spark, partial):
    lengths, walks, read = bubbles(7, partial)
    steps = index(spark, lengths, *walks)
    assert matching.walk_count({"subpath": [{"next": p[2], "connection": p[3]} for p in read[8]], "start": [0]}) > matching.DIRECT
    config = EngineConfig(score_not_qual=True, max_partial_offset=partial, filt_best_score=0.0, frag_mean=1.0, frag_sd=1.0, single_end=True)
    reads = spark.createDataFrame([read], SCHEMA)
    every = matching.walks(reads, config).cache()
    assert every.where("strand = '+'").count() == 128
    listed = matching.score_filter(matching.accepted(matching.runs(every, steps, partial), every, partial), config.max_score_diff)
    want = sorted(map(tuple, matching.single_matches(listed, "unstranded").collect()))
    few = matching.walks(reads, config, steps).cache()
    pruned = matching.score_filter(matching.accepted(matching.runs(few, steps, partial), few, partial), config.max_score_diff)
    assert sorted(map(tuple, matching.single_matches(pruned, "unstranded").collect())) == want and want
    assert few.where("strand = '+'").count() < 30


def test_thirty_bubbles(spark):
    lengths, walks, read = bubbles(30, 1)
    rows = found(spark, index(spark, lengths, *walks[:5]), [read], single_end=True, max_score_diff=10_000)
    assert {r["path_id"] for r in rows} == {0, 1, 2, 3, 4} and {r["align_length"] for r in rows} == {93}


def test_paths_as_arrays_or_graphs(spark):
    """Single-path alignments give the walks of a graph with the one subpath."""
    rng = random.Random(9)
    rows = []
    for i in range(300):
        mappings, node = [], rng.randint(1, 4)
        for _ in range(rng.randint(0 if i % 9 == 0 else 1, 6)):
            edits = [(rng.choice([None, 0, 1, 2]), rng.choice([None, 0, 1, 3])) for _ in range(rng.randint(0, 3))]
            mappings.append(((node, rng.choice([None, 0, 2, 3]), rng.choice([None, True, False])), edits or rng.choice([[], None])))
            node = rng.choice([node, node, rng.randint(1, 4)])
        length = rng.randint(0, 12)
        quality = rng.choice([None, b"", bytes(rng.randint(0, 60) for _ in range(length))])
        notes = rng.choice([None, {"allelic_mapq": str(rng.randint(0, 60))}, {"x": "y"}])
        rows.append((i, 1 + i % 2, "A" * length if length else rng.choice([None, ""]), quality, rng.randint(0, 20), rng.choice([None, rng.randint(0, 60)]), (mappings,), None, None, notes))
    single_path = spark.createDataFrame(rows, SCHEMA)
    graphs = [(*r[:4], None, r[5], None, [0], [(r[6], r[4], None, None)], r[9]) for r in rows if r[6][0]]
    for config in ({"score_not_qual": True}, {"use_allelic_mapq": True}):
        config = EngineConfig(frag_mean=1.0, frag_sd=1.0, **config)
        got = sorted(map(str, matching.walks(single_path, config).collect()))
        assert got == sorted(map(str, matching.walks(spark.createDataFrame(graphs, SCHEMA), config).collect())) and len(got) > 300


def test_reads_that_start_outside_the_graph(spark):
    lengths = {1: 4, 2: 1, 4: 8}
    steps = index(spark, lengths, [1, 2, 4])
    nodes = spark.createDataFrame(list(lengths.items()), "node_id long, length int")
    config = EngineConfig(score_not_qual=True, max_partial_offset=9, filt_best_score=0.0, frag_mean=1.0, frag_sd=1.0, single_end=True)
    inside, outside = single([m(1, 2, offset=2), m(2, 1)], 3), (1, *single([m(9, 2), m(2, 1), m(4, 3)], 6)[1:])
    graph = (2, *multi([0, 1], [([m(1, 4)], 4, [2]), ([m(9, 1)], 1, [2]), ([m(2, 1)], 1, None)], 5)[1:])
    reads = spark.createDataFrame([inside, outside, graph], SCHEMA)
    rows = matching.alignment_rows(reads, steps, config, 100, nodes=nodes).collect()
    assert {r["read_id"] for r in rows} == {0}
    assert {r["read_id"] for r in matching.alignment_rows(reads, steps, config, 100).collect()} == {0, 1, 2}


def brute_runs(shape, paths_):
    """Maximal runs of a walk on paths that begin at lo or before and end at hi or after: (path, first index, ordinal, last index, ordinal)."""
    nodes, lo, hi = shape
    out = set()
    for p, path in paths_.items():
        for d in range(-len(nodes), len(path) + 1):
            i = 0
            while i < len(nodes):
                j = i
                while j < len(nodes) and 0 <= d + j < len(path) and nodes[j] == path[d + j]:
                    j += 1
                if j > i and i <= lo and j - 1 >= hi:
                    out.add((p, i, d + i, j - 1, d + j - 1))
                i = max(j, i + 1)
    return out


@pytest.mark.parametrize("seed, hot, block", [(0, 10_000, 64), (1, 2, 2), (2, 1, 4)])
def test_anchored_runs_are_all_runs(spark, monkeypatch, seed, hot, block):
    """Random walks over few nodes, so that paths are circular, anchors frequent and runs broken; whole and cut ends."""
    monkeypatch.setattr(matching, "HOT", hot)
    monkeypatch.setattr(matching, "BLOCK", block)
    rng = random.Random(seed)
    walks = {p: [rng.randint(1, 4) * rng.choice([1, 1, 1, -1]) for _ in range(rng.randint(1, 30))] for p in range(12)}
    steps = index(spark, {n: n for n in range(1, 5)}, *walks.values())
    oriented = {p: [abs(n) * 2 + (n < 0) for n in w] for p, w in walks.items()}
    reads = []
    for i in range(150):
        source = oriented[rng.randrange(12)]
        low = rng.randrange(len(source))
        nodes = source[low : low + rng.randint(1, 9)]
        if rng.random() < 0.4:
            nodes[rng.randrange(len(nodes))] = rng.randint(2, 9)
        pos = sorted(rng.sample(range(1, 40), len(nodes) - 1)) if len(nodes) > 1 else []
        reads.append((i % 100, 1, "+", i, nodes, [0, *pos], 40, rng.choice([0, 0, 3]), rng.choice([0, 0, 5])))
    for k in (0, 6, 60):
        df = spark.createDataFrame(reads, "read_id long, mate int, strand string, walk long, nodes array<long>, read_pos array<int>, length int, left_clip int, right_clip int")
        shapes = {(tuple(r["nodes"]), r["lo"], r["hi"]) for r in matching.shaped(df, k).collect()}
        got = {}
        for r in matching.runs(df, steps, k).collect():
            row = (r["path_id"], r["s"]["idx"], r["s"]["ordinal"], r["e"]["idx"], r["e"]["ordinal"])
            assert row not in got.setdefault((tuple(r["nodes"]), r["lo"], r["hi"]), set())
            got[tuple(r["nodes"]), r["lo"], r["hi"]].add(row)
        assert got.keys() <= shapes
        for shape in shapes:
            assert got.get(shape, set()) == brute_runs(shape, oriented), shape


@pytest.mark.parametrize("seed", [0, 1])
def test_runs_as_sets_of_paths(spark, seed):
    """No row is made of a walk and a path, and the sets hold the paths of the runs that are left of all."""
    rng = random.Random(seed)
    walks = {p: [rng.randint(1, 4) * rng.choice([1, 1, 1, -1]) for _ in range(rng.randint(1, 12))] for p in range(12)}
    steps = index(spark, {n: n for n in range(1, 5)}, *walks.values())
    oriented = {p: [abs(n) * 2 + (n < 0) for n in w] for p, w in walks.items()}
    reads = []
    for i in range(120):
        source = oriented[rng.randrange(12)]
        low = rng.randrange(len(source))
        nodes = source[low : low + rng.randint(1, 7)]
        if rng.random() < 0.4:
            nodes[rng.randrange(len(nodes))] = rng.randint(2, 9)
        pos = sorted(rng.sample(range(1, 40), len(nodes) - 1)) if len(nodes) > 1 else []
        reads.append((i, 1, "+", i, nodes, [0, *pos], 40, 0, 0))
    df = spark.createDataFrame(reads, "read_id long, mate int, strand string, walk long, nodes array<long>, read_pos array<int>, length int, left_clip int, right_clip int")
    df = matching.shaped(df, 6).where("lo <= hi").drop("lo", "hi")
    want, got = {}, {}
    for r in matching._uncut(matching.runs(df, steps, 6)).collect():
        want.setdefault((tuple(r["nodes"]), r["lo"], r["hi"], r["s"]["idx"], r["e"]["idx"]), set()).add(r["path_id"])
    for r in matching.run_sets(df, steps, 6).collect():
        key = (tuple(r["nodes"]), r["lo"], r["hi"], r["s"], r["e"])
        assert key not in got and len(set(r["paths"])) == len(r["paths"])
        got[key] = set(r["paths"])
    assert got == want and any(s or e < len(n) - 1 for n, _, _, s, e in got)


def test_the_anchor_is_the_rarest(spark):
    steps = index(spark, {n: 1 for n in range(1, 9)}, [1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 7], [1, 2, 3, 4, 8])
    df = spark.createDataFrame([(0, 1, "+", 0, [2, 4, 6, 8, 10, 12], [0, 1, 2, 3, 4, 5], 6, 0, 0)], "read_id long, mate int, strand string, walk long, nodes array<long>, read_pos array<int>, length int, left_clip int, right_clip int")
    grams = matching.gram_table(steps, [3])
    chosen = matching.anchors(matching.shaped(df, 0).select(*matching.SHAPE), grams.groupBy("k", *matching.GRAM).count().withColumnRenamed("count", "n")).first()
    assert (chosen["idx"], chosen["n0"], chosen["n1"], chosen["n2"]) == (2, 6, 8, 10)
    plan = matching.runs(df, steps, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and len(matching.runs(df, steps, 0).collect()) == 1


def test_paths_of_both_mates(spark, monkeypatch):
    """Rows of pairs are the same whether paths that one mate hits are left out first or not, and for walks of many places; library ends too."""
    steps = index(spark, {1: 10, 2: 10, 3: 10}, [1, 2, 3], [1, 3], [2, 3, 1, 2], [1, 2, 1, 2], [3, 2, "rc"])
    ends = [(1, [m(1, 10)]), (2, [m(-2, 10)]), (1, [m(2, 10)]), (2, [m(-3, 10)]), (1, [m(3, 10)]), (2, [m(3, 10)])]
    rows = [(i // 2, *single(path, 10, 10, mate=mate)[1:]) for i, (mate, path) in enumerate(ends)]
    reads = spark.createDataFrame(rows, SCHEMA).drop("start", "subpath")
    for library in ("fr", "unstranded"):
        config = EngineConfig(score_not_qual=True, library=library, frag_mean=1.0, frag_sd=1.0)
        found = []
        for few, hot in ((1e9, 10_000), (0, 10_000), (0, 2)):
            monkeypatch.setattr(matching, "FEW_PLACES", few)
            monkeypatch.setattr(matching, "HOT", hot)
            found.append(sorted(map(tuple, matching.alignment_rows(reads, steps, config, 100).collect())))
        assert found[0] and found[0] == found[1] == found[2]
    walked = matching.walks(reads, config)
    assert matching.usable_walks(walked, EngineConfig(library="fr", frag_mean=1.0, frag_sd=1.0)).count() * 2 == walked.count()


def test_graph_hits_need_bases(spark):
    """A path that holds one node of a graph is not asked for its walks."""
    steps = index(spark, {1: 5, 2: 5, 3: 5, 4: 5}, [1, 2, 3], [1, 4, 4], [4, 2, 4, 3])
    row = (0, 1, [0], [2], [1, 2], [0, 1, 2, 2], [2, 4, 6], [0, 1, 2, 3], [5, 5, 5], 15, 0, 0)
    graphs = spark.createDataFrame([row], matching.GRAPHS)
    assert [r["path_id"] for r in matching.graph_hits(graphs, steps, 0).collect()] == [0]
    assert sorted(r["path_id"] for r in matching.graph_hits(graphs, steps, 3).collect()) == [0, 2]


def test_forms_of_graphs_are_told_by_arrays():
    """Missing lists are empty ones; graphs of one form share its walks."""
    kind = pa.list_(pa.struct([("next", pa.list_(pa.int32())), ("connection", pa.list_(pa.int32()))]))
    part = {"next": [1, 2], "connection": None}
    graphs = [[part, {"next": None, "connection": [7]}, {"next": [], "connection": None}], None, [part, {"next": [], "connection": [8]}, {"next": [], "connection": []}], [{"next": [], "connection": None}]]
    parts, bounds = matching._list(pa.array(graphs, kind))
    forms, which = matching._forms(pa.array([[0], None, [0], [0]], pa.list_(pa.int32())), parts, bounds)
    assert [forms[i] for i in which] == [((0,), ((1, 2), (), ()), (0, 1, 0)), ((), (), ()), ((0,), ((1, 2), (), ()), (0, 1, 0)), ((0,), ((),), (0,))]
    assert len(forms) == 3


def test_no_missing_list_is_passed_on(spark):
    """Those are slow to pass to Python in large batches."""
    graph = (0, *multi([0], [([m(1, 4)], 4, [1]), ([m(2, 1)], 1, None)], 5)[1:])
    row = matching.with_lists(spark.createDataFrame([graph], SCHEMA)).first()
    assert row["annotation"] == {} and [(p["next"], p["connection"]) for p in row["subpath"]] == [([1], []), ([], [])]


def test_places_only_of_paths_with_enough_bases(spark):
    """Places, in either order, are those of paths that give all bases; the second path gives four of twelve."""
    steps = index(spark, {n: 4 for n in range(1, 4)}, [1, 2, 3], [1], [1, 3, 2])
    graphs = spark.createDataFrame([(5, 1, 12, 0, 0, [2, 4, 6], [4, 4, 4])], "read_id long, mate int, length int, left int, right int, nodes array<long>, bases array<int>")
    hits = matching.graph_hits(graphs, steps, 0)
    assert {r["path_id"]: sorted((h["node"], h["ordinal"]) for h in r["hits"]) for r in hits.collect()} == {0: [(2, 0), (4, 1), (6, 2)], 2: [(2, 0), (4, 2), (6, 1)]}


def test_best_walks_by_arrays():
    row, nodes, bounds = np.array([0, 0, 0, 1]), np.array([1, 2, 1, 2, 3, 1, 2]), np.array([0, 2, 4, 5, 7])
    stays, number = matching._best_walks(row, nodes, bounds, [np.zeros(4, int)], np.array([3, 5, 1, 2]), np.ones(4, bool))
    assert stays.tolist() == [False, True, True, True] and number[stays].tolist() == [0, 1, 0]
