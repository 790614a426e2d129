"""Matching reads to paths as joins.

1. ``walks`` turns an alignment (a path, or a graph of subpaths) into linear walks over oriented nodes, in both
   orientations. Paths are handled by array operations on whole batches. A graph with many walks is grown along the
   paths that visit its nodes (``surviving_chains``), so walks that no path holds are never listed.
2. ``runs`` collapses equal walks and joins each, on its rarest row of nodes that a match must hold, with an inverted
   table of such rows; what is found is compared with the path around it.
3. ``accepted`` keeps the runs that miss few bases at the ends, and charges those bases.
4. ``single_matches`` and ``paired_matches`` turn runs into alignment rows; mates are joined on the path, as
   intervals on its coordinates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathquant.config import FULL_LENGTH_BONUS, INT_MIN, EngineConfig
from pathquant.functions import scoring
from pathquant.plans.store import stored

WALKS = (
    "read_id long, mate int, strand string, walk long, nodes array<long>, read_pos array<int>, matched array<int>, length int, score int, optimal int, "
    "left_clip int, right_clip int, matched_left int, matched_right int, start_off int, end_off int, mapq int, multimap boolean"
)
#: Walks of one graph that are listed without asking the paths.
DIRECT = 64
GRAPH_ROWS = 1000  # graphs whose walks are held at a time
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def _schema(columns: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def _following(part) -> list[int]:
    return [int(n) for n in part["next"]] if part["next"] is not None else []


def _is_end(part) -> bool:
    return not _following(part) and not (part["connection"] is not None and len(part["connection"]))


def walk_count(row) -> int:
    """Number of linear walks of a subpath graph, at most DIRECT + 1."""
    parts, known = row["subpath"], {}
    for start in reversed(range(len(parts))):  # subpaths mostly point forward; others are settled by the stack
        stack = [start]
        while stack:
            at = stack[-1]
            open_ = [n for n in _following(parts[at]) if n not in known]
            if at in known or not open_:
                stack.pop()
                if at not in known:
                    known[at] = min(DIRECT + 1, _is_end(parts[at]) + sum(known[n] for n in _following(parts[at])))
            else:
                stack += open_
    return min(DIRECT + 1, sum(known[int(s)] for s in row["start"])) if row["start"] is not None else 0


def _chains(start, following: list[list[int]], ends: list[bool]) -> list[tuple[int, ...]]:
    """The linear walks of a subpath graph as lists of subpaths."""
    out, stack = [], [(int(s), ()) for s in start]
    while stack:
        at, chain = stack.pop()
        chain = (*chain, at)
        stack += [(n, chain) for n in following[at]]
        if ends[at]:
            out.append(chain)
    return out


def _forms(start, parts, bounds: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """The different forms of graphs (starts, following subpaths and number of connections of each subpath), and which one each has.

    Graphs with equal numbers of starts, subpaths and links are rows of a matrix.
    """
    links, link_bounds = _list(pc.struct_field(parts, "next"))
    starts, start_bounds = _list(start)
    links, starts, connected = _int(links), _int(starts), _int(pc.list_value_length(pc.struct_field(parts, "connection")))
    degree, count = np.diff(link_bounds), len(bounds) - 1
    numbers = np.column_stack([np.diff(start_bounds), np.diff(bounds), link_bounds[bounds[1:]] - link_bounds[bounds[:-1]]]) if count else np.zeros((0, 3), np.int64)
    sizes, of = np.unique(numbers, axis=0, return_inverse=True)
    forms, which = [], np.zeros(count, np.int64)
    for i, (n, k, m) in enumerate(sizes.tolist()):
        own = np.flatnonzero(of.ravel() == i)
        at = bounds[own][:, None] + np.arange(k)
        matrix = np.hstack([starts[start_bounds[own][:, None] + np.arange(n)], degree[at], connected[at], links[link_bounds[bounds[own]][:, None] + np.arange(m)]])
        kinds, kind = np.unique(matrix, axis=0, return_inverse=True) if matrix.shape[1] else (matrix[:1], np.zeros(len(own), np.int64))
        which[own] = len(forms) + kind.ravel()
        for row in kinds.tolist():
            ends = np.cumsum([0, *row[n : n + k]]).tolist()
            following = row[n + 2 * k :]
            forms.append((tuple(row[:n]), tuple(tuple(following[x:y]) for x, y in zip(ends, ends[1:])), tuple(row[n + k : n + 2 * k])))
    return forms, which


def _chain_rows(batch: pa.RecordBatch, every: bool, known: dict) -> pa.RecordBatch:
    """Subpath graphs as a row per linear walk: all of graphs with at most DIRECT of them (or of every one), or those of the
    column ``chains``. known: walks of graphs of the same form that were listed before."""
    parts, bounds = _list(batch.column("subpath"))
    if "chains" in batch.schema.names:
        chains = batch.column("chains").to_pylist()
    else:
        forms, which = _forms(batch.column("start"), parts, bounds)
        listed = []
        for form in forms:
            if form not in known:
                if len(known) > 1000:
                    known.clear()
                start, following, connected = form
                graph = {"start": start, "subpath": [{"next": n, "connection": [None] * c} for n, c in zip(following, connected)]}
                few = every or walk_count(graph) <= DIRECT
                known[form] = _chains(start, following, [_is_end(part) for part in graph["subpath"]]) if few else []
            listed.append(known[form])
        chains = [listed[i] for i in which.tolist()]
    count = np.array([len(c) for c in chains], np.int64)
    row = np.repeat(np.arange(len(chains)), count)
    sizes = np.array([len(c) for own in chains for c in own], np.int64)
    part = np.array([x for own in chains for c in own for x in c], np.int64) + np.repeat(bounds[row], sizes)
    chain_bounds = np.concatenate([[0], np.cumsum(sizes)])
    mappings, mapping_bounds = _list(pc.struct_field(pc.struct_field(parts, "path"), "mapping"))
    lengths = mapping_bounds[part + 1] - mapping_bounds[part]
    before = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(before[-1]) + np.repeat(mapping_bounds[part] - before[:-1], lengths)
    lists = pa.ListArray.from_arrays(pa.array(before[chain_bounds].astype(np.int32)), mappings.take(pa.array(at)))
    kept = [c for c in ("read_id", "mate", "sequence", "quality", "mapping_quality", "annotation") if c in batch.schema.names]
    own = batch.select(kept).take(pa.array(row))
    score = _sums(_int(pc.struct_field(parts, "score"))[part], chain_bounds)
    columns = [*own.columns, pa.array(score), pa.StructArray.from_arrays([lists], ["mapping"]), pa.array(row)]
    return pa.RecordBatch.from_arrays(columns, names=[*kept, "score", "path", "row"])


def _best_walks(row: np.ndarray, nodes: np.ndarray, bounds: np.ndarray, facts: list[np.ndarray], score: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which walks stay, of those of a read that visit equal nodes and have equal facts the best-scoring one, and their numbers."""
    own = np.flatnonzero(whole)
    stays, number, sizes = np.zeros(len(row), bool), np.zeros(len(row), np.int64), np.diff(bounds)[own]
    if not len(own):
        return stays, number
    kind, kinds = np.zeros(len(own), np.int64), 0  # of walks of equal read, nodes and facts
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        walks = own[at]
        found = np.unique(np.column_stack([row[walks], *[f[walks] for f in facts], nodes[bounds[walks][:, None] + np.arange(size)]]), axis=0, return_inverse=True)[1].ravel()
        kind[at] = kinds + found
        kinds += int(found.max()) + 1
    first = np.unique(kind, return_index=True)[1]  # its first walk
    order = np.lexsort((own, -score[own], kind))
    best = own[order[np.append(True, np.diff(kind[order]) > 0)]]  # by kind
    seen = np.argsort(first)  # reads come in order, so kinds of a read are neighbours
    owner = row[own[first[seen]]]
    begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    stays[best] = True
    number[best[seen]] = np.arange(len(seen)) - np.repeat(begins, np.diff(np.append(begins, len(seen))))
    return stays, number


def _clip(edits, take) -> int:
    return 0 if edits is None or not len(edits) or int(edits[take]["from_length"] or 0) else int(edits[take]["to_length"] or 0)


GRAPHS = "read_id long, mate int, start array<int>, ends array<int>, links array<int>, link_bounds array<int>, nodes array<long>, node_bounds array<int>, bases array<int>, length int, left int, right int"


def _graphs(batches):
    """Subpath graphs of more than DIRECT walks, flat: links and oriented nodes of all subpaths with their bounds, read bases of each node."""
    schema = _schema(GRAPHS)
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if not row["subpath"] or walk_count(row) <= DIRECT:
                continue
            links, bounds, nodes, node_bounds, bases, left, right = [], [0], [], [0], [], 0, 0
            for part in row["subpath"]:
                links += _following(part)
                bounds.append(len(links))
                mappings = part["path"]["mapping"]
                for m in mappings:
                    nodes.append(int(m["position"]["node_id"] or 0) * 2 + int(bool(m["position"]["is_reverse"])))
                    bases.append(sum(int(e["to_length"] or 0) for e in m["edit"] or ()))
                node_bounds.append(len(nodes))
                if len(mappings):
                    left, right = max(left, _clip(mappings[0]["edit"], 0)), max(right, _clip(mappings[-1]["edit"], -1))
            ends = [i for i, part in enumerate(row["subpath"]) if _is_end(part)]
            out.append((row["read_id"], row["mate"], [int(s) for s in row["start"]], ends, links, bounds, nodes, node_bounds, bases, len(row["sequence"] or ""), left, right))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _grown(row: dict, max_partial: int) -> list[list[int]]:
    """Chains of subpaths that may hold a run on the path of the row's hits. A chain is dropped as soon as none can.

    A run may begin only while the bases before it are few, and the bases after it must be few. Clips and steps
    inside one node are not told apart here, which only keeps some chains too many.
    """
    at: dict[int, set[int]] = {}
    for hit in row["hits"]:
        at.setdefault(hit["node"], set()).add(hit["ordinal"])
    none: set[int] = set()
    ends = set(row["ends"])
    out = []
    # subpath, chain before it, last node, ordinals alive along the path and against it, bases so far, bases where the last run ended
    stack = [(s, (), None, none, none, 0, -1) for s in row["start"]]
    while stack:
        part, chain, last, plus, minus, used, ended = stack.pop()
        chain, dead = (*chain, part), False
        for i in range(row["node_bounds"][part], row["node_bounds"][part + 1]):
            node = row["nodes"][i]
            here, there = at.get(node, none), at.get(node ^ 1, none)
            plus, minus = ({o for o in here if o - 1 in plus or node == last and o in plus}, {o for o in there if o + 1 in minus or node == last and o in minus})
            if used <= row["left"] + max_partial:
                plus, minus = plus | here, minus | there
            if not plus and not minus and ended < 0:
                ended = used
            if plus or minus:
                ended = -1
            used, last = used + row["bases"][i], node
            # with nothing alive, either a run may still begin or the last one may have ended close to the read's end
            dead = not plus and not minus and used > row["left"] + max_partial and row["length"] - ended > row["right"] + max_partial
            if dead:
                break
        if dead:
            continue
        if part in ends:
            out.append(list(chain))
        stack += [(n, chain, last, plus, minus, used, ended) for n in row["links"][row["link_bounds"][part] : row["link_bounds"][part + 1]]]
    return out


def graph_hits(graphs: DataFrame, steps: DataFrame, max_partial: int) -> DataFrame:
    """(read_id, mate, path_id, hits) of graphs and paths that may hold a run of them.

    The places of a run give at most the bases of all visits of their nodes, so a path whose places give fewer bases than a run needs
    holds none.
    """
    place = steps.select("path_id", F.col("ordinal").cast("int").alias("ordinal"), F.col("node").cast("long").alias("node"), F.shiftright(F.col("node").cast("long"), 1).alias("id"))
    bases = graphs.select("read_id", "mate", (F.col("length") - F.col("left") - F.col("right") - 2 * max_partial).alias("needed"), F.explode(F.arrays_zip("nodes", "bases")).alias("x"))
    bases = bases.groupBy("read_id", "mate", "needed", F.shiftright(F.col("x.nodes"), 1).alias("id")).agg(F.sum("x.bases").alias("bases"))
    rated = bases.join(place.select("path_id", "id"), "id").groupBy("read_id", "mate", "path_id").agg(F.sum("bases").alias("most"), F.first("needed").alias("needed"))
    # only of paths that have enough bases, which are few, the places are looked up
    few = rated.where("most >= needed").select("read_id", "mate", "path_id").join(graphs.select("read_id", "mate", F.transform("nodes", lambda n: F.shiftright(n, 1)).alias("ids")), ["read_id", "mate"])
    met = few.join(place, "path_id").where(F.array_contains("ids", F.col("id")))
    return met.groupBy("read_id", "mate", "path_id").agg(F.collect_list(F.struct("node", "ordinal")).alias("hits"))


def surviving_chains(alignments: DataFrame, steps: DataFrame, config: EngineConfig) -> DataFrame | None:
    """(read_id, mate, chains) of the reads whose graph has more than DIRECT walks: the chains of subpaths that paths may hold.

    Their nodes are joined with the path steps, and a graph is grown along one path at a time. None if there are no such reads.
    """
    # a walk is a start and a link of each subpath that it visits, so most graphs are known to have few without a look at them in Python
    choices = F.aggregate("subpath", F.size("start").cast("double"), lambda n, part: n * F.greatest(F.lit(1), F.size(F.coalesce(part["next"], F.array().cast("array<int>")))))
    graphs = stored(alignments.where(choices > DIRECT).select("read_id", "mate", "sequence", "start", "subpath").mapInArrow(_graphs, GRAPHS), "graphs")
    if graphs.isEmpty():
        return None
    limit = config.max_partial_offset
    hits = graph_hits(graphs, steps, limit)

    def run(batches):
        schema = _schema("read_id long, mate int, chain array<int>")
        for batch in batches:
            out = [(row["read_id"], row["mate"], chain) for row in batch.to_pylist() for chain in _grown(row, limit)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    chains = hits.join(graphs, ["read_id", "mate"]).mapInArrow(run, "read_id long, mate int, chain array<int>").distinct()
    found = graphs.select("read_id", "mate").distinct().join(chains.groupBy("read_id", "mate").agg(F.collect_list("chain").alias("chains")), ["read_id", "mate"], "left")
    return stored(found.withColumn("chains", F.coalesce("chains", F.array().cast("array<array<int>>"))), "chains")


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the slices between bounds."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _list(column) -> tuple[pa.Array, np.ndarray]:
    """Values of a list array and the bounds of its lists; a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten(), np.concatenate([[0], np.cumsum(sizes)])


def _int(column) -> np.ndarray:
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _path_walks(batch: pa.RecordBatch, scores: np.ndarray, use_quality: bool, allelic: bool):
    """Walks of single-path alignments, or of rows of ``_chain_rows``, as batches by strand: mappings that go on inside one node are one visit."""
    mapping = pc.struct_field(batch.column("path"), "mapping")
    batch = batch.filter(pc.greater(pc.fill_null(pc.list_value_length(mapping), 0), 0))
    n = batch.num_rows
    if not n:
        return
    mappings, bounds = _list(pc.struct_field(batch.column("path"), "mapping"))
    position = pc.struct_field(mappings, "position")
    node = _int(pc.struct_field(position, "node_id")) * 2 + pc.fill_null(pc.struct_field(position, "is_reverse"), False).to_numpy(zero_copy_only=False)
    offset = _int(pc.struct_field(position, "offset"))
    edits, edit_bounds = _list(pc.struct_field(mappings, "edit"))
    taken, given = _int(pc.struct_field(edits, "from_length")), _int(pc.struct_field(edits, "to_length"))
    used, bases = _sums(taken, edit_bounds), _sums(given, edit_bounds)

    def clip(mapping_at, last: bool):
        edit_at = edit_bounds[mapping_at + 1] - 1 if last else edit_bounds[mapping_at]
        has = edit_bounds[mapping_at + 1] > edit_bounds[mapping_at]
        edit_at = np.where(has, edit_at, 0)
        return np.where(has & (taken[edit_at] == 0), given[edit_at], 0) if len(taken) else np.zeros(n, np.int64)

    left, right = clip(bounds[:-1], False), clip(bounds[1:] - 1, True)
    first = np.zeros(len(node), dtype=bool)
    first[bounds[:-1]] = True
    goes_on = np.zeros(len(node), dtype=bool)
    goes_on[1:] = ~first[1:] & (node[1:] == node[:-1]) & (offset[1:] == offset[:-1] + used[:-1])
    visit = np.flatnonzero(~goes_on)
    visit_bounds = np.searchsorted(visit, bounds)
    ends = np.append(visit[1:], len(node)) - 1
    nodes, begin, reached, size = node[visit], offset[visit], (offset + used)[ends], _sums(bases, np.append(visit, len(node)))
    # a visit that comes back to its own node at an offset inside it is on no path
    back = np.zeros(len(visit), dtype=np.int64)
    back[1:] = ~first[visit][1:] & (nodes[1:] == nodes[:-1]) & (begin[1:] != 0)
    whole = _sums(back, visit_bounds) == 0

    length = pc.utf8_length(pc.fill_null(batch.column("sequence"), "")).to_numpy(zero_copy_only=False).astype(np.int64)
    gain, gain_bounds = np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    optimal, rated = length + 2 * FULL_LENGTH_BONUS, np.zeros(n, dtype=bool)
    if use_quality:
        quality = batch.column("quality")
        data = [q[:size] if q else b"" for q, size in zip(quality.to_pylist(), length.tolist())]
        gain = scores[np.frombuffer(b"".join(data), dtype=np.uint8)]
        gain_bounds = np.concatenate([[0], np.cumsum([len(d) for d in data])])
        rated = np.diff(gain_bounds) > 0
        bonus = np.array(scoring.BONUSES)
        ends_of = [(q[0], q[-1]) if q else (0, 0) for q in quality.to_pylist()]
        optimal = np.where(rated, _sums(gain, gain_bounds) + bonus[[a for a, _ in ends_of]] + bonus[[b for _, b in ends_of]], optimal)
    total = np.concatenate([[0], np.cumsum(gain)])

    def ahead(read, place):
        """What matches at the first bases of a read count: by quality, or 1 each."""
        place = np.minimum(place, length[read])
        return np.where(rated[read], total[gain_bounds[read] + np.minimum(place, np.diff(gain_bounds)[read])] - total[gain_bounds[read]], place)

    def behind(read, place):
        place = np.minimum(place, length[read])
        return ahead(read, length[read]) - ahead(read, length[read] - place)

    reads = np.arange(n)
    owner = np.repeat(reads, np.diff(visit_bounds))
    before = np.concatenate([[0], np.cumsum(size)])
    forward = before[:-1] - before[visit_bounds[owner]]
    turned = before[visit_bounds[owner + 1]] - before[1:]
    mirror = visit_bounds[owner] + visit_bounds[owner + 1] - 1 - np.arange(len(owner))
    mapq = _int(batch.column("mapping_quality"))
    if allelic:
        other = pc.map_lookup(batch.column("annotation"), "allelic_mapq", "first").to_pylist()
        mapq = np.array([q if x is None else min(q, int(float(x))) for q, x in zip(mapq.tolist(), other)], dtype=np.int64)
    score = _int(batch.column("score")) if "score" in batch.schema.names else np.zeros(n, np.int64)
    lists = pa.array(visit_bounds.astype(np.int32))
    head, tail = begin[visit_bounds[:-1]], reached[visit_bounds[1:] - 1]
    number, disconnected = np.zeros(n, np.int64), pa.array(np.zeros(n, dtype=bool))
    if "row" in batch.schema.names:
        whole, number = _best_walks(_int(batch.column("row")), nodes, visit_bounds, [head, tail, left, right], score, whole)
        disconnected = pc.is_valid(pc.map_lookup(batch.column("annotation"), "disconnected", "all"))
    for strand, own, places, counted, lc, rc, start, end in (("+", nodes, forward, ahead, left, right, head, tail), ("-", (nodes ^ 1)[mirror], turned[mirror], behind, right, left, tail, head)):
        columns = [
            batch.column("read_id"), batch.column("mate"), pa.array([strand] * n), pa.array(number), pa.ListArray.from_arrays(lists, pa.array(own)), pa.ListArray.from_arrays(lists, pa.array(places.astype(np.int32))),
            pa.ListArray.from_arrays(lists, pa.array(counted(owner, places).astype(np.int32))), length, score, optimal, lc, rc, counted(reads, lc), counted(reads, np.maximum(0, length - rc)), start, end, mapq, disconnected,
        ]
        arrays = [c if isinstance(c, pa.Array) else pa.array(c.astype(np.int32)) for c in columns]
        schema = _schema(WALKS)
        yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema).filter(pa.array(whole))


def with_lists(alignments: DataFrame) -> DataFrame:
    """Alignments with empty lists for missing ones in graphs and annotations: a batch with many missing lists is slow to pass to Python."""
    columns = {}
    if "annotation" in alignments.columns:
        none = F.array().cast("array<string>")
        columns["annotation"] = F.coalesce("annotation", F.map_from_arrays(none, none))
    if "subpath" in alignments.columns:
        kind = alignments.schema["subpath"].dataType.elementType
        fields = [f.name for f in kind.fields]

        def filled(part):
            return F.struct(*[(F.coalesce(part[c], F.array().cast(kind[c].dataType)) if c in ("next", "connection") else part[c]).alias(c) for c in fields])

        columns["subpath"] = F.transform("subpath", filled)
    return alignments.withColumns(columns) if columns else alignments


def walks(alignments: DataFrame, config: EngineConfig, steps: DataFrame | None = None) -> DataFrame:
    """Linear walks of reads that have a path, as read ('+') and reverse-complemented ('-').

    A multipath read whose walks visit equal nodes keeps the best-scoring one. With steps, graphs of many walks give only
    those that a path may hold.
    """
    scores = np.array(scoring.MATCH_SCORES)
    use_quality, allelic = not config.score_not_qual, config.use_allelic_mapq
    every = steps is None

    def run(batches):
        known: dict = {}
        for batch in batches:
            names = batch.schema.names
            if "subpath" in names:
                graphs = pc.is_valid(batch.column("subpath"))
                rows = batch.filter(graphs)
                for low in range(0, rows.num_rows, GRAPH_ROWS):
                    yield from _path_walks(_chain_rows(rows.slice(low, GRAPH_ROWS), every, known), scores, use_quality, allelic)
                batch = batch.filter(pc.invert(graphs))
            if "path" in names and batch.num_rows:
                yield from _path_walks(batch, scores, use_quality, allelic)

    wanted = ["read_id", "mate", "sequence", "quality", "mapping_quality", "annotation", "score", "path", "start", "subpath"]
    unused = {"quality"} if config.score_not_qual else set()
    unused |= set() if allelic or "subpath" in alignments.columns else {"annotation"}
    own = with_lists(alignments.select(*[c for c in wanted if c in alignments.columns and c not in unused]))
    found = own.mapInArrow(run, WALKS)
    chains = surviving_chains(own.where("subpath IS NOT NULL"), steps, config) if steps is not None and "subpath" in own.columns else None
    return found if chains is None else found.unionByName(own.join(chains, ["read_id", "mate"]).mapInArrow(run, WALKS))


def start_nodes(alignments: DataFrame) -> DataFrame:
    """(read_id, mate, node_id) of the nodes at which alignments start: of a path its first, of a graph the first of each start."""
    columns = []
    if "path" in alignments.columns:
        columns.append(F.slice(F.col("path.mapping.position.node_id"), 1, 1))
    if "subpath" in alignments.columns:
        columns.append(F.transform("start", lambda s: F.get(F.get("subpath", s)["path"]["mapping"], F.lit(0))["position"]["node_id"]))
    ids = F.concat(*[F.coalesce(c.cast("array<long>"), F.array().cast("array<long>")) for c in columns])
    return alignments.select("read_id", "mate", F.explode(ids).alias("node_id"))


def start_in_graph(alignments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Leaves out alignments that start at a node that the graph lacks."""
    starts = start_nodes(alignments)
    missing = stored(starts.select("node_id").distinct().join(nodes.select("node_id"), "node_id", "left_anti"), "missing-nodes")
    lost = stored(starts.join(missing, "node_id").select("read_id", "mate").distinct(), "lost-starts")
    return alignments.join(lost, ["read_id", "mate"], "left_anti")


#: Nodes of an anchor at most, steps of a block of a path at least, and places of one anchor that one task meets.
ANCHOR, BLOCK, HOT = 3, 64, 10_000
FEW_PLACES = 4  # of a walk on average, up to which paths that only one mate hits are not sought out first
#: Nodes of a walk, and places of an anchor, up to which runs are found and kept as sets of paths (``run_sets``).
SET_NODES, SET_PLACES = 8, 500
TASK_WALKS = 200_000  # whose sets of paths one task makes rows of, about
BIN = 8  # longest fragments in a bin of a path, in which mates meet
SHAPE = ["nodes", "lo", "hi"]
GRAM = [f"n{i}" for i in range(ANCHOR)]


def shaped(walked: DataFrame, max_partial: int) -> DataFrame:
    """Walks with the last index ``lo`` at which a run may begin, and the first, ``hi``, at which one may end.

    A run drops at most max_partial aligned bases before it, and unless a longer one hides it, after it. So every run
    that counts holds all nodes from lo to hi, or if hi comes first at least one of those from hi to lo.
    """
    lo = F.size(F.filter("read_pos", lambda x: x - F.col("left_clip") <= max_partial)) - 1
    hi = F.size(F.filter(F.slice("read_pos", 2, F.size("read_pos")), lambda x: x < F.col("length") - F.col("right_clip") - max_partial))
    return walked.withColumn("lo", lo).withColumn("hi", hi)


def gram_table(steps: DataFrame, sizes) -> DataFrame:
    """The inverted table: (k, n0, n1, n2) of k nodes in a row, and where on which path they lie: first and last of them."""
    along = Window.partitionBy("path_id").orderBy("ordinal")
    place = F.struct(F.col("ordinal").cast("long").alias("ordinal"), F.col("cum_offset").cast("long").alias("cum_offset"), F.col("node_length").cast("int").alias("node_length"))
    own = steps.select("path_id", "ordinal", F.col("node").cast("long").alias("n0"), place.alias("at0"))
    if max(sizes) > 1:  # one exchange by path serves all sizes
        own = own.select("path_id", "n0", "at0", *[F.lead(c, i).over(along).alias(f"{c[:-1]}{i}") for i in range(1, max(sizes)) for c in ("n0", "at0")])
    none = F.lit(-1).cast("long")
    rows = [own.where(F.col(f"n{k - 1}").isNotNull()).select(F.lit(k).alias("k"), *[F.col(g) if i < k else none.alias(g) for i, g in enumerate(GRAM)], "path_id", F.col("at0").alias("first"), F.col(f"at{k - 1}").alias("last")) for k in sorted(sizes)]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def anchors(shapes: DataFrame, counts: DataFrame | None) -> DataFrame:
    """shapes + idx, k and nodes of the anchor: of all rows of k nodes between lo and hi the one that paths hold least often.

    Where hi comes before lo, each node between them is an anchor of its own. counts: how often each gram occurs, None if
    no shape has a choice.
    """
    short = F.col("lo") > F.col("hi")
    size = F.when(short, 1).otherwise(F.least(F.lit(ANCHOR), F.col("hi") - F.col("lo") + 1))
    at = F.sequence(F.least("lo", "hi"), F.when(short, F.col("lo")).otherwise(F.col("hi") - size + 1))
    each = shapes.withColumn("k", size).withColumn("choices", F.when(short, 1).otherwise(F.size(at))).withColumn("idx", F.explode(at))
    each = each.select(*SHAPE, "choices", "k", "idx", *[F.when(F.lit(i) < F.col("k"), F.get("nodes", F.col("idx") + i)).otherwise(F.lit(-1)).cast("long").alias(g) for i, g in enumerate(GRAM)])
    only = each.where("choices = 1").drop("choices")
    if counts is None:
        return only
    # a gram that no path holds is the rarest: its shape then meets nothing
    rated = each.where("choices > 1").join(counts, ["k", *GRAM], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = rated.groupBy(*SHAPE).agg(F.min(F.struct("n", "idx", "k", *GRAM)).alias("a")).select(*SHAPE, "a.k", "a.idx", *[f"a.{g}" for g in GRAM])
    return only.unionByName(rarest)


def blocks(steps: DataFrame, size: int) -> DataFrame:
    """(path_id, block, first, path): steps block * size up to twice the size on, so that any stretch of that size lies in one block."""
    step = F.struct(F.col("ordinal").cast("long").alias("ordinal"), F.col("cum_offset").cast("long").alias("cum_offset"), F.col("node_length").cast("int").alias("node_length"), F.col("node").cast("long").alias("node"))
    own = F.floor(F.col("ordinal") / size)
    each = steps.select("path_id", F.explode(F.when(own > 0, F.array(own, own - 1)).otherwise(F.array(own))).alias("block"), step.alias("step"))
    return each.groupBy("path_id", "block").agg(F.array_sort(F.collect_list("step")).alias("path"))


def _extended(candidates: DataFrame, steps: DataFrame, size: int) -> DataFrame:
    """Candidates (shape, path_id, idx, first) as maximal runs around their anchor: nodes compared in one block of the path."""
    start = F.col("first.ordinal") - F.col("idx")
    placed = candidates.withColumn("start", start).withColumn("block", F.floor(F.greatest(start, F.lit(0)) / size))
    met = placed.join(blocks(steps, size), ["path_id", "block"])
    # same[i]: node i of the walk is the path's at its place
    place = F.col("start") - F.col("block") * size
    same = F.transform("nodes", lambda n, i: F.coalesce((place + i >= 0) & (F.get("path", (place + i).cast("int"))["node"] == n), F.lit(False)))
    met = met.withColumn("same", same).withColumn("place", place)
    before, after = F.array_position(F.reverse(F.slice("same", F.lit(1), F.col("idx"))), False), F.array_position(F.slice("same", F.col("idx") + 1, F.size("nodes")), False)
    s = (F.col("idx") - F.when(before == 0, F.col("idx")).otherwise(before - 1)).cast("int")
    e = (F.col("idx") + F.when(after == 0, F.size("nodes") - F.col("idx")).otherwise(after - 1) - 1).cast("int")
    met = met.withColumn("s", s).withColumn("e", e).where((F.col("s") <= F.col("lo")) & (F.col("e") >= F.col("hi")))

    def end(at):
        step = F.get("path", (F.col("place") + F.col(at)).cast("int"))
        return F.struct(F.col(at).alias("idx"), step["ordinal"].alias("ordinal"), step["cum_offset"].alias("cum_offset"), step["node_length"].alias("node_length"))

    # of several anchors of one walk each finds the run: the first of them gives it
    first = (F.col("lo") <= F.col("hi")) | (F.col("idx") == F.greatest("hi", "s"))
    return met.where(first).select(*SHAPE, "path_id", end("s").alias("s"), end("e").alias("e"))


def runs(walked: DataFrame, steps: DataFrame, max_partial: int) -> DataFrame:
    """Maximal matches of walks and paths that may count: (nodes, lo, hi, path_id, s, e), with s and e the first and last
    walk index and ordinal, and where they lie on the path.

    Equal walks are matched once. A walk is joined on its rarest anchor, a row of up to ANCHOR nodes that every run
    must hold, and what is found is compared with the path around it, in both directions; where the anchor is the whole walk,
    nothing is left to compare. Anchors with very many places are met in several tasks.

    steps: path_id, ordinal, node (oriented, 2 * id + is_reverse), node_length, cum_offset.
    """
    shapes = stored(shaped(walked, max_partial).select(*SHAPE).distinct(), "shapes")
    core = F.col("hi") - F.col("lo") + 1
    size = F.when(core < 1, 1).otherwise(F.least(F.lit(ANCHOR), core))
    whole = size == F.size("nodes")
    facts = shapes.agg(F.collect_set(size), F.max(F.size("nodes")), F.max(core > ANCHOR), F.max(~whole)).first()  # a few numbers
    if not facts[0]:
        facts = ([1], 1, False, False)
    grams = stored(gram_table(steps, facts[0]), "grams")
    counts = stored(grams.groupBy("k", *GRAM).agg(F.count("*").alias("n")), "gram-counts")
    chosen = anchors(shapes, counts if facts[2] else None)
    hot = counts.where(F.col("n") > HOT).select("k", *GRAM, F.ceil(F.col("n") / HOT).cast("int").alias("salts"))  # at most steps / HOT rows
    key = ["k", *GRAM]
    spread = chosen.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    dealt = grams.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64("path_id", "first"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    met = spread.join(dealt, [*key, "salt"])
    covered = F.col("k") == F.size("nodes")

    def end(column, at):
        return F.struct(at.cast("int").alias("idx"), F.col(column)["ordinal"].alias("ordinal"), F.col(column)["cum_offset"].alias("cum_offset"), F.col(column)["node_length"].alias("node_length"))

    done = met.where(covered).select(*SHAPE, "path_id", end("first", F.lit(0)).alias("s"), end("last", F.size("nodes") - 1).alias("e"))
    if not facts[3]:
        return done
    length = max(BLOCK, 1 << (facts[1] - 1).bit_length())
    return done.unionByName(_extended(met.where(~covered).select(*SHAPE, "path_id", "idx", "first"), steps, length))


def _sets(batches):
    """Rows (nodes, lo, hi, idx, places) as a row per run: its first and last node, and the paths that have it where its suffix may be dropped."""
    schema = _schema(SETS)
    for batch in batches:
        if not batch.num_rows:
            continue
        places, place_bounds = _list(batch.column("places"))
        walk, walk_bounds = _list(batch.column("nodes"))
        path, path_bounds = _list(pc.struct_field(places, "path"))
        walk, path, ids, at = (_int(x) for x in (walk, path, pc.struct_field(places, "path_id"), pc.struct_field(places, "at")))
        size, lo, hi = np.diff(walk_bounds), _int(batch.column("lo")), _int(batch.column("hi"))
        owner = np.repeat(np.arange(batch.num_rows), np.diff(place_bounds))
        idx = _int(batch.column("idx"))[owner]
        length, widest = np.diff(path_bounds), int(size.max())

        def same(w):
            """Whether node w of the walk is the path's at its place."""
            place = at - idx + w
            inside = (w >= 0) & (w < size[owner]) & (place >= 0) & (place < length)
            return inside & (path[np.where(inside, path_bounds[:-1] + place, 0)] == walk[np.where(inside, walk_bounds[owner] + w, 0)])

        s, e = idx.copy(), idx.copy()
        for end, step in ((s, -1), (e, 1)):
            alive = np.ones(len(owner), bool)
            for d in range(1, widest):
                alive &= same(idx + step * d)
                end[alive] += step
        kept = np.flatnonzero((s <= lo[owner]) & (e >= hi[owner]))
        kept = kept[np.lexsort((ids[kept], e[kept], s[kept], owner[kept]))]
        owner, s, e, ids = owner[kept], s[kept], e[kept], ids[kept]
        # a suffix may be dropped by runs that start where the earliest run still alive at their end starts
        known = np.zeros((batch.num_rows, widest, widest), bool)
        known[owner, s, e] = True
        alive = np.flip(np.logical_or.accumulate(np.flip(known, 2), axis=2), 2) & (np.arange(widest)[:, None] <= np.arange(widest))
        uncut = (e == size[owner] - 1) | (s == np.argmax(alive, axis=1)[owner, e])
        owner, s, e, ids = owner[uncut], s[uncut], e[uncut], ids[uncut]
        new = np.append(True, (owner[1:] != owner[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1]))[: len(owner)]
        once = new | np.append(True, ids[1:] != ids[:-1])[: len(owner)]
        ids, first = ids[once], np.flatnonzero(new[once])
        rows = pa.array(owner[once][first])
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(ids))
        columns = [*[batch.column(c).take(rows) for c in SHAPE], pa.array(s[once][first]), pa.array(e[once][first]), lists]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


SETS = "nodes array<long>, lo int, hi int, s int, e int, paths array<long>"


def run_sets(walked: DataFrame, steps: DataFrame, max_partial: int) -> DataFrame | None:
    """The runs of ``runs`` that ``_uncut`` leaves, as (nodes, lo, hi, s, e, paths): a row for all paths that have a run, without its places.

    The places of an anchor come as a list, each with the path around it, so no row is made of a walk and a path. None where a walk has more
    than SET_NODES nodes or several anchors, or an anchor more than SET_PLACES places.
    """
    shapes = stored(shaped(walked, max_partial).select(*SHAPE).distinct(), "shapes")
    core = F.col("hi") - F.col("lo") + 1
    facts = shapes.agg(F.collect_set(F.least(F.lit(ANCHOR), core)), F.max(F.size("nodes")), F.max(core > ANCHOR), F.min(core)).first()  # a few numbers
    if not facts[0] or facts[1] > SET_NODES or facts[3] < 1:
        return None
    reach, key = facts[1] - 1, ["k", *GRAM]
    along, none = Window.partitionBy("path_id").orderBy("ordinal").rowsBetween(-reach, ANCHOR - 1 + reach), F.lit(-1).cast("long")
    around = steps.select("path_id", F.col("ordinal").cast("long").alias("ordinal"), F.collect_list(F.col("node").cast("long")).over(along).alias("path"))
    around = around.withColumn("at", F.least("ordinal", F.lit(reach)).cast("int"))
    each = around.withColumn("k", F.explode(F.array(*[F.lit(k) for k in sorted(facts[0])]))).where(F.col("at") + F.col("k") <= F.size("path"))
    grams = stored(each.select("k", *[F.when(F.lit(i) < F.col("k"), F.get("path", F.col("at") + i)).otherwise(none).alias(g) for i, g in enumerate(GRAM)], F.struct("path_id", "at", "path").alias("place")), "grams")
    counts = stored(grams.groupBy(*key).agg(F.count("*").alias("n")), "gram-counts")
    if (counts.agg(F.max("n")).first()[0] or 0) > SET_PLACES:
        return None
    places = grams.groupBy(*key).agg(F.collect_list("place").alias("places"))
    met = anchors(shapes, counts if facts[2] else None).join(places, key)
    return met.select(*SHAPE, "idx", "places").mapInArrow(_sets, SETS)


def _uncut(found: DataFrame) -> DataFrame:
    """Runs whose suffix may be dropped: those that start where the earliest run still alive at their end starts.

    Which runs a walk has depends on its shape alone, so this is settled before reads come in.
    """
    kinds = F.collect_set(F.struct(F.col("s.idx").alias("first"), F.col("e.idx").alias("final"))).over(Window.partitionBy(*SHAPE))
    at = F.col("e.idx")
    main = F.array_min(F.transform(F.filter("kinds", lambda x: (x["first"] <= at) & (at <= x["final"])), lambda x: x["first"]))
    return found.withColumn("kinds", kinds).where((at == F.size("nodes") - 1) | (F.col("s.idx") == main)).drop("kinds")


def accepted(found: DataFrame, walked: DataFrame, max_partial: int, whole: bool = False) -> DataFrame:
    """Runs that drop at most max_partial aligned bases at each end, with scores and places on the path.

    found: runs of the walks' shapes, with the same max_partial, which bounds what they drop. A dropped suffix counts only for runs
    that start where the earliest run still alive at its end starts. whole: all runs are whole walks. Walks with a path_id meet that path only.
    """
    key = ["read_id", "mate", "strand", "walk"]
    r = shaped(walked, max_partial).join(found if whole else _uncut(found), [*SHAPE, "path_id"] if "path_id" in walked.columns else SHAPE)
    r, s, e, last = _dropped(r, "s.idx", "e.idx")
    plus = F.col("strand") == "+"
    # offsets of reversed walks are counted from the node's other end
    at_start = F.when(s > 0, F.lit(0)).otherwise(F.when(plus, F.col("start_off")).otherwise(F.col("s.node_length") - F.col("start_off")))
    at_end = F.when(e < last, F.col("e.node_length")).otherwise(F.when(plus, F.col("end_off")).otherwise(F.col("e.node_length") - F.col("end_off")))
    return r.select(
        *key, "path_id", "length", "optimal", "mapq", "multimap",
        F.col("s.ordinal").alias("first_step"), F.col("e.ordinal").alias("last_step"),
        (F.col("s.cum_offset") + at_start).alias("start_at"), (F.col("e.cum_offset") + at_end).alias("end_at"), *_kept(),
    )


def accepted_sets(sets: DataFrame, walked: DataFrame, max_partial: int) -> DataFrame:
    """``accepted`` for rows of ``run_sets``: paths instead of a path, and no places."""
    r, _, _, _ = _dropped(shaped(walked, max_partial).join(sets, SHAPE), "s", "e")
    return r.select("read_id", "mate", "strand", "walk", "paths", "length", "optimal", "mapq", "multimap", *_kept())


def _kept() -> list:
    return [
        (F.col("left_clip") + F.col("drop_left")).alias("cut_left"), (F.col("right_clip") + F.col("drop_right")).alias("cut_right"),
        (F.col("score") - F.col("pen_left") - F.col("pen_right")).alias("adjusted"),
        ((F.col("drop_left") > 0) | (F.col("drop_right") > 0)).alias("partial"),
    ]


def _dropped(r: DataFrame, first: str, final: str):
    """Rows with the aligned bases that a run drops at each end and what matched there, and the run's first and last index, and the walk's last."""
    s, e = F.col(first), F.col(final)
    last = F.size("nodes") - 1
    r = r.withColumn("drop_left", F.when(s == 0, 0).otherwise(F.greatest(F.lit(0), F.get("read_pos", s) - F.col("left_clip"))))
    r = r.withColumn("drop_right", F.when(e == last, 0).otherwise(F.greatest(F.lit(0), F.col("length") - F.col("right_clip") - F.get("read_pos", e + 1))))
    r = r.withColumn("pen_left", F.when(s == 0, 0).otherwise(F.get("matched", s) - F.col("matched_left")))
    r = r.withColumn("pen_right", F.when(e == last, 0).otherwise(F.col("matched_right") - F.get("matched", e + 1)))
    return r, s, e, last


def score_filter(matches: DataFrame, max_diff: int) -> DataFrame:
    """Drops matches whose score is more than max_diff under the best of the same read end and orientation."""
    best = F.max("adjusted").over(Window.partitionBy("read_id", "mate", "strand"))
    return matches.withColumn("best", best).where(F.col("best") - F.col("adjusted") <= max_diff).drop("best")


ROWS = ["read_id", "path_id", "score_sum", "align_length", "frag_length", "min_mapq", "fraction", "partial", "multimap"]


def mate_orders(library: str, bidirectional: bool) -> list[tuple[int, int]]:
    """Which mate may lie along the path, and which against it."""
    if library == "rf":
        return [(2, 1)]
    return [(1, 2)] if library == "fr" or bidirectional else [(1, 2), (2, 1)]


def usable_walks(walked: DataFrame, config: EngineConfig, bidirectional: bool = False) -> DataFrame:
    """Walks of the ends and orientations that the library allows; the others make no row."""
    if not config.single_end:
        orders = mate_orders(config.library, bidirectional)
        return walked if len(orders) > 1 else walked.where((F.col("strand") == "+") & (F.col("mate") == orders[0][0]) | (F.col("strand") == "-") & (F.col("mate") == orders[0][1]))
    if config.library == "rf":
        return walked.where("strand = '-'")
    return walked.where("strand = '+'") if config.library == "fr" or bidirectional else walked


def single_matches(matches: DataFrame, library: str, bidirectional: bool = False, path: str = "path_id") -> DataFrame:
    """Alignment rows of single reads, in the orientations that the library allows. path: the column of the path, or of paths that share a row."""
    if library == "rf":
        matches = matches.where("strand = '-'")
    elif library == "fr" or bidirectional:
        matches = matches.where("strand = '+'")
    fraction = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("adjusted") / F.col("optimal")))
    rows = matches.select("read_id", path, F.col("adjusted").alias("score_sum"), (F.col("length") - F.col("cut_left") - F.col("cut_right")).alias("align_length"), F.col("length").alias("frag_length"), F.col("mapq").alias("min_mapq"), fraction.alias("fraction"), "partial", "multimap")
    return rows.distinct() if path == "path_id" else rows


def met_by_both(walked: DataFrame, found: DataFrame, orders: list[tuple[int, int]]) -> DataFrame:
    """Walks of single-path pairs with a path_id: each path that both mates hit. No row is made of a path that only one of them hits.

    The paths of a walk are an array, and those of mates are intersected in a row. Walks with more than HOT places keep all
    paths of their mate, and of theirs those of it; pairs of two such walks meet all.
    """
    lists = found.groupBy(*SHAPE).agg(F.count("*").alias("n"))
    few = found.join(lists.where(F.col("n") <= HOT).select(*SHAPE), SHAPE, "left_semi").groupBy(*SHAPE).agg(F.collect_set("path_id").cast("array<bigint>").alias("paths"))
    hot = lists.where(F.col("n") > HOT)
    # joined, as a union of the two, equally hashed, is taken for one that is hashed so too, and then has twice the partitions
    own = walked.join(lists.select(*SHAPE).join(few, SHAPE, "left"), SHAPE).select("read_id", "mate", "strand", "paths")
    a, b = (own.where(F.col("strand") == strand).select("read_id", F.col("mate").alias(f"{x}_mate"), F.col("paths").alias(x)) for x, strand in (("a", "+"), ("b", "-")))
    allowed = F.lit(False)
    for first, second in orders:
        allowed = allowed | ((F.col("a_mate") == first) & (F.col("b_mate") == second))
    pairs = a.join(b, "read_id").where(allowed)
    both = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.array_intersect("a", "b")).otherwise(F.coalesce("a", "b"))
    pairs = stored(pairs.select("read_id", "a_mate", "b_mate", both.alias("paths")).where("paths IS NULL OR size(paths) > 0"), "met-pairs")
    ends = F.explode(F.array(F.struct(F.col("a_mate").alias("mate"), F.lit("+").alias("strand")), F.struct(F.col("b_mate").alias("mate"), F.lit("-").alias("strand"))))
    few = pairs.where("paths IS NOT NULL").select("read_id", ends.alias("x"), "paths").select("read_id", "x.mate", "x.strand", F.explode("paths").alias("path_id"))
    met = walked.join(few, ["read_id", "mate", "strand"])
    all_ = pairs.where("paths IS NULL").select("read_id", ends.alias("x")).select("read_id", "x.mate", "x.strand")
    rest = walked.join(all_, ["read_id", "mate", "strand"], "left_semi").join(found.join(hot.select(*SHAPE), SHAPE, "left_semi").select(*SHAPE, F.col("path_id").cast("long").alias("path_id")).distinct(), SHAPE)
    return met.unionByName(rest.select(met.columns))


def paired_matches(matches: DataFrame, library: str, max_fragment: int, bidirectional: bool = False) -> DataFrame:
    """Alignment rows of pairs: an interval join of mates on the path.

    The second mate is reverse-complemented and may neither begin left of the first nor end left of it; mates
    that overlap are merged. Every pair of occurrences makes a row, which covers circular paths. Mates meet in bins of the path:
    a second mate lies in the bin of its start, a first one in all bins in which its second may start (mostly one), so
    occurrences that are far apart on a path that a read hits often are not compared, and no pair is met twice.
    """
    orders = mate_orders(library, bidirectional)
    left = matches.where("strand = '+'").select(*[F.col(c).alias(f"a_{c}") for c in matches.columns])
    right = matches.where("strand = '-'").select(*[F.col(c).alias(f"b_{c}") for c in matches.columns])
    # the second mate starts at the first one's outer end or after it, and at most a fragment behind its inner end
    width = BIN * max(1, max_fragment)
    bins = F.sequence(F.floor((F.col("a_start_at") - F.col("a_cut_left")) / width), F.floor((F.col("a_end_at") + max_fragment) / width))
    left, right = left.withColumn("a_bin", F.explode(bins)), right.withColumn("b_bin", F.floor(F.col("b_start_at") / width))
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    allowed = F.lit(False)
    for first, second in orders:
        allowed = allowed | ((a("mate") == first) & (b("mate") == second))
    insert = F.greatest(a("start_at"), b("start_at")) - F.least(a("end_at"), b("end_at"))
    outer_a, outer_b = a("start_at") - a("cut_left"), b("start_at") - b("cut_left")
    right_a, right_b = a("end_at") + a("cut_right"), b("end_at") + b("cut_right")
    placed = (
        (b("first_step") >= a("first_step")) & (b("last_step") >= a("last_step"))
        & ((b("first_step") > a("first_step")) | (outer_b >= outer_a)) & ((b("last_step") > a("last_step")) | (right_b >= right_a))
    )
    frag = a("length") + b("length") + insert - a("cut_right") - b("cut_left")
    pairs = left.join(right, (a("read_id") == b("read_id")) & (a("path_id") == b("path_id")) & (a("bin") == b("bin")) & allowed & placed & (frag <= max_fragment))
    share = F.least(a("adjusted") / a("optimal"), b("adjusted") / b("optimal"))
    length = a("length") + b("length") - a("cut_left") - a("cut_right") - b("cut_left") - b("cut_right")
    return pairs.select(a("read_id").alias("read_id"), a("path_id").alias("path_id"), (a("adjusted") + b("adjusted")).alias("score_sum"), length.alias("align_length"), frag.alias("frag_length"), F.least(a("mapq"), b("mapq")).alias("min_mapq"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)).alias("fraction"), (a("partial") | b("partial")).alias("partial"), (a("multimap") | b("multimap")).alias("multimap")).repartition("read_id").distinct()


def alignment_rows(alignments: DataFrame, steps: DataFrame, config: EngineConfig, max_fragment: int, bidirectional: bool = False, nodes: DataFrame | None = None) -> DataFrame:
    """(read_id, path_id, score_sum, align_length, frag_length, min_mapq, is_simple, noise_score) of all matched reads.

    noise_score is 0 (all noise) where the best row reaches less than filt_best_score of the optimum, else the
    lowest integer (no noise from missing paths). With nodes, reads that start outside the graph are left out.
    """
    if nodes is not None:
        alignments = start_in_graph(alignments, nodes)
    limit = config.max_partial_offset
    walked = stored(shaped(usable_walks(walks(alignments, config, steps), config, bidirectional), limit), "walks")
    whole = walked.where("lo > 0 OR hi < size(nodes) - 1").isEmpty()
    sets = run_sets(walked, steps, limit) if config.single_end and not whole else None
    if sets is not None:
        parts = -(-walked.count() // TASK_WALKS)  # given, as sets are small in an exchange, but not the rows that are made of them
        matches = accepted_sets(sets, walked, limit)
        matches = matches.repartition(parts, "read_id") if parts > 1 else matches.repartition("read_id")
        matches = score_filter(matches, config.max_score_diff)
        return with_read_facts(single_matches(matches, config.library, bidirectional, "paths"), config.filt_best_score, "paths")
    if whole:  # a walk's score is that of its runs
        found = stored(runs(walked, steps, limit), "found")
        if "subpath" in alignments.columns:  # else a read end has one walk
            alive = walked.join(found.select(*SHAPE).distinct(), SHAPE, "left_semi").withColumn("adjusted", F.col("score"))
            walked = stored(score_filter(alive, config.max_score_diff).drop("adjusted"), "walks")
        elif not config.single_end:
            places = found.groupBy(*SHAPE).agg(F.count("*").alias("n")).agg(F.avg("n").alias("n")).first()["n"] or 0
            if places > FEW_PLACES:
                walked = met_by_both(walked, found, mate_orders(config.library, bidirectional))
        matches = accepted(found, walked, limit, True)
        matches = matches.repartition("read_id") if config.single_end else matches
    else:
        matches = accepted(runs(walked, steps, limit), walked, limit)
        # one exchange by read serves the filter and all that comes after it
        matches = score_filter(matches.repartition("read_id") if config.single_end else matches, config.max_score_diff)
    rows = single_matches(matches, config.library, bidirectional) if config.single_end else paired_matches(matches, config.library, max_fragment, bidirectional)
    return with_read_facts(rows, config.filt_best_score)


def with_read_facts(rows: DataFrame, filt_best_score: float, path: str = "path_id") -> DataFrame:
    """Rows with is_simple (one place, whole, one fragment length) and noise_score of their read, without what these were made of.

    path: the column of the path, or of paths that share a row, which then is made a row of each.
    """
    read = Window.partitionBy("read_id")
    simple = ~F.max("multimap").over(read) & ~F.max("partial").over(read) & (F.min("frag_length").over(read) == F.max("frag_length").over(read))
    noise = F.when(F.max("fraction").over(read) < filt_best_score, 0).otherwise(INT_MIN)
    rated = rows.withColumn("is_simple", simple).withColumn("noise_score", noise)
    if path != "path_id":
        # equal rows of a read become one, so each path is given out once
        rated = rated.groupBy(*[c for c in rated.columns if c != path]).agg(F.array_distinct(F.flatten(F.collect_list(path))).alias(path)).withColumn("path_id", F.explode(path))
    return rated.select("read_id", "path_id", "score_sum", "align_length", "frag_length", "min_mapq", "is_simple", "noise_score")


def unaligned(alignments: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: reads (or pairs) without an alignment row."""
    return alignments.select("read_id").distinct().join(rows.select("read_id").distinct(), "read_id", "left_anti").agg(F.count("*").alias("unaligned"))


def best_states(rows: DataFrame) -> DataFrame:
    """Of the rows of a read with equal path and fragment length the longest, then best-scoring."""
    best = Window.partitionBy("read_id", "path_id", "frag_length").orderBy(F.desc("align_length"), F.desc("score_sum"))
    return rows.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def read_classes(rows: DataFrame) -> DataFrame:
    """Reads with equal lists of alignment rows as one class: read_class_id, read_count, min_mapq, noise_score, is_simple, rows.

    Of rows with equal path and fragment length the longest, then best-scoring, stays. A list that has a
    single (score, length, fragment) combination is made canonical, as those then cancel out. Ids are numbers of this
    run: write the classes down before they are used twice.
    """
    lists = best_states(rows).groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("path_id", "score_sum", "align_length", "frag_length"))).alias("rows"), F.first("min_mapq").alias("min_mapq"), F.first("noise_score").alias("noise_score"), F.first("is_simple").alias("is_simple"))
    shapes = F.array_distinct(F.transform("rows", lambda r: F.struct(r["score_sum"].alias("s"), r["align_length"].alias("a"), r["frag_length"].alias("f"))))
    canonical = F.transform("rows", lambda r: F.struct(r["path_id"].alias("path_id"), F.lit(1).alias("score_sum"), F.lit(1).cast("int").alias("align_length"), F.lit(1).cast("long").alias("frag_length")))
    same_types = F.transform("rows", lambda r: F.struct(r["path_id"].alias("path_id"), r["score_sum"].cast("int").alias("score_sum"), r["align_length"].cast("int").alias("align_length"), r["frag_length"].cast("long").alias("frag_length")))
    lists = lists.withColumn("rows", F.when(F.size(shapes) == 1, canonical).otherwise(same_types))
    grouped = lists.groupBy("rows", "min_mapq", "noise_score").agg(F.count("*").alias("read_count"))
    return grouped.withColumn("read_class_id", F.monotonically_increasing_id())
