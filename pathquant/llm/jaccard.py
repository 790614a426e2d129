"""Exact n-gram Jaccard join: size-banded tiles, bitmap signatures, then sorted-array intersection.

1. One pass counts all shingles of the corpus in a fixed number of hashed counters, and gives every document
   the key of its shingle set (two 64-bit values), its size and a hashed bitmap of the set. Documents with equal sets
   are one class.
2. A second pass orders each set by those counts, rare shingles first, and sends only its prefix to tiles, one
   tile per shingle. Two sets that reach the threshold share a shingle of both prefixes, whatever the order
   (any total order does; the counts only keep common passages out of the prefixes).
3. In a tile, members are banded by size. Small tiles give the pairs that size and position allow. Large
   tiles give the links of every member to its band's pivot; the rest is settled in step 6. A shingle that many sets
   of one input chunk have is linked to pivots there, before the shuffle, and only the pivots go on to the tile.
4. The bit counts of two bitmaps bound the overlap from above: |A and B| <= (|A| + |B| - |bits differing|) / 2.
5. What is left is verified by intersecting the sorted shingle arrays. Here shingles are numbers of word sequences that
   were compared byte by byte, so no hash decides a link.
6. Members of a large tile that are not yet in one component are compared by their bitmaps with all others of
   the tile that are in another; what the bound leaves is verified too. Pairs inside a component are never made. A large
   tile is cut into blocks of some hundred members, and those outside its largest component visit every block, some
   hundred at a turn; a block and a turn are one group.

So no link between different components is lost, and a group of copies is never expanded into its pairs.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathquant.llm.common import stored
from pathquant.llm.shingles import exact_shingles, mix, shingle_sets, text_chunks
from pathquant.operators.components import connected_components

COUNTERS = 20  # bits of a shingle's hash that choose its counter
PART = 1 << 14  # counters in one row
BITS = (64, 4096)  # least and most bits of a bitmap
SMALL = 16  # members of a tile whose pairs are all made
ROWS = 1 << 20  # prefix rows in which common shingles are looked for before the shuffle
BLOCK = 512  # members of a large tile in a block, and visitors in a turn
SALTS = 16  # tasks over which the members of one tile meet the facts of the tile
TEXT = 4 << 20  # bytes of text verified at a time
_I64 = np.int64


def _needed(a, b, num: int, den: int):
    """Least overlap with which sets of sizes a and b link."""
    return -((-num * (a + b)) // (den + num))


def bitmap(hashes: np.ndarray) -> bytes:
    """As many bits as twice the set's size, rounded up to a power of two, within BITS."""
    bits = min(max(BITS[0], 1 << max(0, 2 * len(hashes) - 1).bit_length()), BITS[1])
    out = np.zeros(bits, dtype=np.uint8)
    out[(hashes & np.uint64(bits - 1)).astype(_I64)] = 1
    return np.packbits(out).tobytes()


def folded(data: bytes, size: int) -> np.ndarray:
    words = np.frombuffer(data, dtype=np.uint64)
    while len(words) * 8 > size:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """The key of a set: a class number, and a second value that tells classes of one number apart."""
    both = np.array([hashes.sum(dtype=np.uint64) ^ np.uint64(len(hashes)), (hashes * (hashes >> np.uint64(31))).sum(dtype=np.uint64)])
    return tuple(mix(both).astype(_I64).tolist())


def class_of(key: tuple[int, int], shared: frozenset) -> int:
    return key[0] ^ key[1] if key[0] in shared else key[0]


def _facts(k: int):
    names = ["doc_id", "n", "cls", "more", "bitmap", "part", "counts"]

    def run(batches):
        counts = np.zeros(1 << COUNTERS, dtype=np.int64)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids, sizes, keys, maps = batch.column(0), [], [], []
            for hashes in shingle_sets(batch.column(1), k):
                key = set_key(hashes)
                sizes.append(len(hashes))
                keys.append(key)
                maps.append(None)
                if key not in seen:  # equal sets of a partition count once
                    seen.add(key)
                    np.add.at(counts, (hashes >> np.uint64(64 - COUNTERS)).astype(_I64), 1)
                    maps[-1] = bitmap(hashes) if len(hashes) else None
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64()), pa.array(maps, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        parts = [(i, counts[i * PART : (i + 1) * PART]) for i in range((1 << COUNTERS) // PART)]
        parts = [(i, zlib.compress(c.astype(np.uint32).tobytes(), 1)) for i, c in parts if c.any()]
        n = len(parts)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64())] * 4 + [pa.nulls(n, pa.binary()), pa.array([i for i, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())], names=names)

    return run


def _classes(key, table):
    total = np.zeros(PART, dtype=np.int64)
    for data in table.column("counts"):
        total += np.frombuffer(zlib.decompress(data.as_py()), dtype=np.uint32)
    classes = np.round(2 * np.log2(np.maximum(total, 1))).astype(np.uint8)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "classes": [classes.tobytes()]})


#: What a row on its way to the tiles is: a member of a tile, or one that is a pivot of others already; a member that
#: is linked to such a pivot (its key is the class, so that they spread); a pair of classes.
MEMBER, PIVOT, LINKED, PAIR = range(4)


def _star(n, pos, cls, num: int, den: int):
    """Pairs of each member of a large tile with the pivots of its size band and of the band below; the pivots."""
    band = np.floor(np.log(n) / np.log(den / num) + 1e-9).astype(_I64)
    order = np.lexsort((cls, pos, band))
    heads = order[np.flatnonzero(np.concatenate([[True], np.diff(band[order]) > 0]))]  # nearest to what the tile has in common
    bands, every = band[heads], np.arange(len(cls))
    own, lower = heads[np.searchsorted(bands, band)], np.searchsorted(bands, band - 1)
    below = np.flatnonzero(bands[np.minimum(lower, len(bands) - 1)] == band - 1)
    i, j = np.concatenate([every, every[below]]), np.concatenate([own, heads[lower[below]]])
    keep = i != j
    keep[keep] = _possible(n, pos, i[keep], j[keep], num, den)
    return i[keep], j[keep], heads


def _batch(kind, key, n, pos, cls, other) -> pa.RecordBatch:
    """Rows with kind, size and place in one number."""
    info = (n << 32) | (pos << 2) | kind
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(info), pa.array(cls), pa.array(other)], names=["key", "info", "cls", "other"])


def _combined(token, n, pos, cls, num: int, den: int):
    """Rows of a chunk of prefixes. Shingles of more than SMALL sets are linked to pivots here."""
    order = np.argsort(token, kind="stable")
    token, n, pos, cls = (x[order] for x in (token, n, pos, cls))
    bounds = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]])
    common = np.flatnonzero(np.diff(bounds) > SMALL)
    kind, key, other = np.full(len(token), MEMBER), token, np.zeros(len(token), _I64)
    pairs = []
    for c in common.tolist():
        part = slice(bounds[c], bounds[c + 1])
        i, j, heads = _star(n[part], pos[part], cls[part], num, den)
        own = np.full(part.stop - part.start, LINKED)
        own[heads] = PIVOT
        kind[part] = own
        pairs.append(np.stack([cls[part][i], cls[part][j]], axis=1))
    if len(common):
        linked = kind == LINKED
        key, other = np.where(linked, cls, token), np.where(linked, token, 0)
    yield _batch(kind, key, n, pos, cls, other)
    if pairs:
        p = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
        none = np.zeros(len(p), _I64)
        yield _batch(none + PAIR, p[:, 0], none, none, p[:, 1], none)


def _prefixes(k: int, num: int, den: int, sent, shared: frozenset):
    def run(batches):
        classes, seen = np.frombuffer(sent.value, dtype=np.uint8), set()
        held, rows = [], 0
        for batch in batches:
            for hashes in shingle_sets(batch.column(0), k):
                n = len(hashes)
                cls = class_of(set_key(hashes), shared) if n else 0
                if not n or cls in seen:
                    continue
                seen.add(cls)
                length = n + (-num * n) // den + 1  # n - ceil(num n / den) + 1
                rank = classes[(hashes >> np.uint64(64 - COUNTERS)).astype(_I64)].astype(np.uint64)
                order = np.argsort((rank << np.uint64(56)) | (hashes >> np.uint64(8)), kind="stable")[:length]
                held.append((hashes[order].astype(_I64), np.full(len(order), n), np.arange(len(order)), np.full(len(order), cls)))
                rows += len(order)
                if rows >= ROWS:
                    yield from _combined(*map(np.concatenate, zip(*held)), num, den)
                    held, rows = [], 0
        if held:
            yield from _combined(*map(np.concatenate, zip(*held)), num, den)

    return run


def _runs(batches):
    """Runs of equal first column over sorted lists of arrays, as lists of arrays; single rows are left out."""
    held: list = []
    for cols in batches:
        if not len(cols[0]):
            continue
        bounds = np.concatenate([[0], np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1, [len(cols[0])]])
        if held and held[0][0][0] == cols[0][0]:
            held.append([c[: bounds[1]] for c in cols])
            if len(bounds) == 2:
                continue
            bounds = bounds[1:]
        if held and sum(len(h[0]) for h in held) > 1:
            yield [np.concatenate(x) for x in zip(*held)]
        for i in np.flatnonzero(np.diff(bounds[:-1]) > 1):
            yield [c[bounds[i] : bounds[i + 1]] for c in cols]
        held = [[c[bounds[-2] :] for c in cols]]
    if held and sum(len(h[0]) for h in held) > 1:
        yield [np.concatenate(x) for x in zip(*held)]


def _possible(n, pos, i, j, num, den):
    """Can members i and j of a tile link, by size and by the places of the tile's shingle?"""
    rest = np.minimum(n[i] - pos[i], n[j] - pos[j])
    return (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])) & (rest >= _needed(n[i], n[j], num, den))


def _tiles(num: int, den: int):
    names = ["x", "y", "token", "n", "pos"]

    def run(batches):
        pairs, members, held = [], [], 0

        def emit():
            p = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), _I64)
            m = np.concatenate(members) if members else np.zeros((0, 4), _I64)
            pairs.clear(), members.clear()
            a, b = len(p), len(m)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[:, 0], m[:, 3]])), pa.concat_arrays([pa.array(p[:, 1]), pa.nulls(b, pa.int64())]), *(pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(m[:, c])]) for c in range(3))], names=names)

        def inputs():
            """Rows of tiles; what was settled before the shuffle is passed on."""
            nonlocal held
            for batch in batches:
                key, info, cls, other = (c.to_numpy() for c in batch.columns)
                kind = info & 3
                if (kind >= LINKED).any():
                    linked, pair = kind == LINKED, kind == PAIR
                    members.append(np.stack([other[linked], info[linked] >> 32, (info[linked] >> 2) & (2**30 - 1), cls[linked]], axis=1))
                    pairs.append(np.stack([key[pair], cls[pair]], axis=1))
                    held += len(kind) - int((kind < LINKED).sum())
                    key, info, cls = (x[kind < LINKED] for x in (key, info, cls))
                yield [key, info, cls]

        for token, info, cls in _runs(inputs()):
            # a set that several partitions sent is one member; it is a pivot if it is one anywhere
            order = np.lexsort((-(info & 3), cls))
            first = order[np.concatenate([[True], cls[order][1:] != cls[order][:-1]])]
            n, pos, kind, own = info[first] >> 32, (info[first] >> 2) & (2**30 - 1), info[first] & 3, cls[first]
            if len(own) > SMALL or (kind == PIVOT).any():
                members.append(np.stack([np.full(len(own), token[0]), n, pos, own], axis=1))
                held += len(own)
                i, j, _ = _star(n, pos, own, num, den)
            elif len(own) > 1:
                i, j = np.triu_indices(len(own), 1)
                ok = _possible(n, pos, i, j, num, den)
                i, j = i[ok], j[ok]
            else:
                continue
            if len(i):
                a, b = own[i], own[j]
                pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
                held += len(a)
            if held > 50_000:
                yield emit()
                held = 0
        yield emit()

    return run


def _bounded(num: int, den: int):
    """Pairs whose bitmaps leave a link possible."""

    def run(batches):
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (a, b) in enumerate(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist())):
                size = min(len(a), len(b))
                differ = int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())
                keep[i] = (n[i] + m[i] - differ) // 2 >= _needed(n[i], m[i], num, den)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(keep))

    return run


def _verified(k: int, num: int, den: int):
    """Pairs that link, by their texts. A text that several pairs of a slice have is cut into shingles once."""

    def run(batches):
        for batch in batches:
            size = np.cumsum(pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3))).to_numpy().astype(_I64))
            cuts = [0, *(np.flatnonzero(np.diff(size // TEXT)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(low, high - low)
                if not part.num_rows:
                    continue
                both = np.concatenate([c.to_numpy() for c in part.columns[:2]])
                _, first, which = np.unique(both, return_index=True, return_inverse=True)
                texts = pa.concat_arrays(part.columns[2:]).take(pa.array(first))
                ((data, offsets),) = text_chunks(texts, 1 << 62)
                sets, keep = exact_shingles(data, offsets, k), []
                for a, b in zip(which[: len(which) // 2], which[len(which) // 2 :]):
                    small, large = sorted((sets[a], sets[b]), key=len)
                    common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                    keep.append(den * common >= num * (len(small) + len(large) - common))
                yield pa.RecordBatch.from_arrays(part.columns[:2], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def _texts(k: int, shared: frozenset):
    """(class, a text of it)"""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            rows, keys = [], []
            for i, hashes in enumerate(shingle_sets(batch.column(0), k)):
                key = class_of(set_key(hashes), shared)
                if len(hashes) and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    rows.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(0).take(pa.array(rows, pa.int64()))], names=["cls", "text"])

    return run


def _crossing(num: int, den: int):
    """In a block of a large tile: pairs of different components that the bitmaps leave possible.

    Rows come sorted by token, block, turn and role: the block's members, then those of the tile that visit it in this turn.
    """

    def run(batches):
        group, held, pairs = None, [], []
        sides: dict = {}  # bytes of a bitmap -> places, sizes, positions, classes, components and bitmaps of the members that have one

        def ready():
            sides.clear()
            for r in held:
                sides.setdefault(len(r[4]), []).append(r)
            for size, rows in sides.items():
                sides[size] = [np.array([r[c] for r in rows], dtype=_I64) for c in range(4)] + [{size: np.stack([np.frombuffer(r[4], dtype=np.uint64) for r in rows])}]
            held.clear()

        def visit(n, pos, cls, comp, data, main):
            for size, (ns, places, classes, comps, maps) in sides.items():
                ok = np.flatnonzero((comps != comp) & ((comps == main) | (classes > cls)))
                ok = ok[(den * np.minimum(ns[ok], n) >= num * np.maximum(ns[ok], n)) & (np.minimum(ns[ok] - places[ok], n - pos) >= _needed(ns[ok], n, num, den))]
                if not len(ok):
                    continue
                least = min(size, len(data))
                if least not in maps:
                    whole = maps[size]
                    while whole.shape[1] * 8 > least:
                        whole = whole[:, : whole.shape[1] // 2] | whole[:, whole.shape[1] // 2 :]
                    maps[least] = whole
                differ = np.bitwise_count(maps[least][ok] ^ folded(data, least)).sum(axis=1, dtype=_I64)
                ok = ok[(ns[ok] + n - differ) // 2 >= _needed(ns[ok], n, num, den)]
                if len(ok):
                    pairs.append(np.stack([np.minimum(classes[ok], cls), np.maximum(classes[ok], cls)], axis=1))

        def emit():
            p = np.unique(np.concatenate(pairs), axis=0)
            pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["x", "y"])

        for batch in batches:
            for token, block, turn, role, n, pos, cls, comp, main, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (token, block, turn) != group:
                    group = (token, block, turn)
                    held.clear(), sides.clear()
                if not role:
                    held.append((n, pos, cls, comp, data))
                else:
                    if held:
                        ready()
                    visit(n, pos, cls, comp, data, main)
            if len(pairs) > 5_000:
                yield emit()
        if pairs:
            yield emit()

    return run


def jaccard_components(docs: DataFrame, *, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links, its own included).

    Two documents link when den * |A and B| >= num * |A or B| for their sets of k-word shingles; a text with
    fewer words is one shingle, a null text or one without words has none and links with nothing. Null ids
    take part, but never name a component that has other ids. Repeated rows link as copies. An empty table
    gives an empty result. Other columns are not read. Texts are read whole, however long; a worker holds one text's
    shingles at a time, some 150 bytes a word.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    both = stored(base.mapInArrow(_facts(k), "doc_id long, n long, cls long, more long, bitmap binary, part int, counts binary"), "jaccard-facts")
    facts = both.where("n IS NOT NULL").drop("part", "counts")
    table = both.where("part IS NOT NULL").select("part", "counts").groupBy("part").applyInArrow(_classes, "part int, classes binary").collect()
    classes = bytearray(1 << COUNTERS)  # one byte per counter: a fixed size
    for row in table:
        classes[row["part"] * PART : (row["part"] + 1) * PART] = row["classes"]
    sent = spark.sparkContext.broadcast(bytes(classes))

    keys = facts.where("n > 0").groupBy("cls", "more")
    sets = stored(keys.agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bitmap", True).alias("bitmap")), "jaccard-classes")
    # class numbers that two sets share by chance: none below some 10 ** 9 sets, some 70 among 5 * 10 ** 10
    shared = frozenset(r["cls"] for r in sets.groupBy("cls").count().where("count > 1").select("cls").collect())
    if shared:
        own = F.when(F.col("cls").isin(list(shared)), F.col("cls").bitwiseXOR(F.col("more"))).otherwise(F.col("cls"))
        facts, sets = facts.withColumn("cls", own), sets.withColumn("cls", own)

    prefixes = base.select("text").mapInArrow(_prefixes(k, num, den, sent, shared), "key long, info long, cls long, other long")
    tiles = prefixes.repartition("key").sortWithinPartitions("key")
    tiled = stored(tiles.mapInArrow(_tiles(num, den), "x long, y long, token long, n long, pos long"), "jaccard-tiles")

    def linked(pairs: DataFrame) -> DataFrame:
        """Verifies candidate pairs of classes."""
        near = pairs.distinct()
        for c in ("x", "y"):
            near = near.join(sets.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("bitmap").alias(f"map_{c}")), c)
        near = stored(near.select("x", "y", "n_x", "map_x", "n_y", "map_y").mapInArrow(_bounded(num, den), "x long, y long"), "jaccard-near")
        wanted = near.select(F.explode(F.array("x", "y")).alias("cls")).distinct().join(sets.select("cls", "doc_id"), "cls").select("doc_id").distinct()
        found = base.alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi").select("text")
        texts = stored(found.mapInArrow(_texts(k, shared), "cls long, text string"), "jaccard-texts").dropDuplicates(["cls"])
        for c in ("x", "y"):
            near = near.join(texts.select(F.col("cls").alias(c), F.col("text").alias(f"text_{c}")).hint("merge"), c)  # texts are never broadcast
        return stored(near.select("x", "y", "text_x", "text_y").mapInArrow(_verified(k, num, den), "x long, y long"), "jaccard-links")

    links = linked(tiled.where("y IS NOT NULL").select("x", "y"))
    members = tiled.where("token IS NOT NULL").select("token", F.col("x").alias("cls"), "n", "pos").dropDuplicates(["token", "cls"])
    comps = connected_components(links, "x", "y", "jaccard-components")
    placed = members.join(comps.withColumnRenamed("vertex", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    placed = stored(placed.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS))), "jaccard-members")
    counts = placed.groupBy("token", "component").agg(F.count("*").alias("size"))
    mixed = counts.groupBy("token").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("all"), F.count("*").alias("components")).where("components > 1")
    parts = [F.ceil(n / BLOCK).cast("int").alias(name) for n, name in ((F.col("all"), "blocks"), (F.col("all") - F.col("top.size"), "turns"))]
    mixed = stored(mixed.select("token", F.col("top.component").alias("main"), *parts), "jaccard-mixed")
    if not mixed.isEmpty():
        rows = placed.join(mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["token", "salt"]).join(sets.select("cls", "bitmap"), "cls")
        columns = ["n", "pos", "cls", "component", "main", "bitmap"]

        def part_of(seed: int, count: str):
            return F.pmod(F.xxhash64("cls", F.lit(seed)), F.col(count)).cast("int")

        def each(count: str):
            return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

        residents = rows.select("token", part_of(3, "blocks").alias("block"), each("turns").alias("turn"), F.lit(0).alias("role"), *columns)
        visitors = rows.where("component != main").select("token", each("blocks").alias("block"), part_of(5, "turns").alias("turn"), F.lit(1).alias("role"), *columns)
        blocks = residents.unionByName(visitors).repartition("token", "block", "turn").sortWithinPartitions("token", "block", "turn", "role")
        more = stored(blocks.mapInArrow(_crossing(num, den), "x long, y long"), "jaccard-crossing")
        if not more.isEmpty():
            comps = connected_components(links.union(linked(more)), "x", "y", "jaccard-components")

    classes_of = sets.select("cls", "doc_id").join(comps.withColumnRenamed("vertex", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = classes_of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = stored(classes_of.join(named, "component").select("cls", "component_id"), "jaccard-named")
    out = facts.select("doc_id", "n", "cls").join(named, "cls", "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op6_bitmap_tile_join(spark, sf_dir):
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS c FROM r GROUP BY x) m USING (doc_id)
"""
