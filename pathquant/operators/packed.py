"""Sparse cells of clusters as blocks of arrays, and what goes over them again and again: expectation-maximisation and count samples.

A cluster's reads are dealt to blocks of bounded size, a row each. A cluster of one block is settled in one task. Of a larger
one every round is a job: tasks take the shares of its paths with a block of its reads, and give what the block adds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pathquant import config as C
from pathquant.plans.store import stored

BLOCK_CELLS = 1_000_000  # of a block, about
BLOCK = "cluster_id long, block int, blocks int, n int, bounds array<int>, items array<int>, probs array<double>, noise array<double>, counts array<double>"
SHARES = "cluster_id long, shares array<double>"


def _numbers(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _pack(batches):
    """Rows sorted by cluster, block and read as a row of arrays per block; item -1 is a read that is all noise."""
    held: list[pa.RecordBatch] = []

    def row():
        t = pa.Table.from_batches(held).combine_chunks()
        read, item, prob, noise, counts = (_numbers(t.column(c).combine_chunks()) for c in ("read_class_id", "item", "prob", "noise_prob", "read_count"))
        first = np.flatnonzero(np.append(True, read[1:] != read[:-1]))
        live = (item >= 0) & (prob > 0)
        bounds = np.append(0, np.cumsum(live))[np.append(first, len(read))]
        head = [[t.column(c)[0].as_py()] for c in ("cluster_id", "block", "blocks", "n")]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        arrays = [pa.array(bounds.astype(np.int32)), pa.array(item[live].astype(np.int32)), pa.array(prob[live]), pa.array(noise[first]), pa.array(counts[first].astype(float))]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in arrays]
        names = [c.split()[0] for c in BLOCK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(head, types)] + lists, names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        cluster, block = _numbers(batch.column("cluster_id")), _numbers(batch.column("block"))
        cuts = (np.flatnonzero((cluster[1:] != cluster[:-1]) | (block[1:] != block[:-1])) + 1).tolist()
        for low, high in zip([0, *cuts], [*cuts, len(cluster)]):
            if held and (held[0].column("cluster_id")[0].as_py(), held[0].column("block")[0].as_py()) != (cluster[low], block[low]):
                yield row()
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield row()


def packed(probs: DataFrame, paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Blocks of probs (cluster_id, read_class_id, read_count, noise_prob, path_id, prob), and (cluster_id, path_id, item) of
    paths (cluster_id, path_id), or of those of probs."""
    along = Window.partitionBy("cluster_id").orderBy("path_id")
    items = stored((probs if paths is None else paths).where("path_id IS NOT NULL").select("cluster_id", F.col("path_id").cast("long").alias("path_id")).distinct().withColumn("item", (F.row_number().over(along) - 1).cast("int")), "packed-paths")
    rows = probs.groupBy("cluster_id").agg(F.ceil(F.count("*") / BLOCK_CELLS).cast("int").alias("blocks"))
    sizes = stored(rows.join(items.groupBy("cluster_id").agg(F.count("*").cast("int").alias("n")), "cluster_id", "left").withColumn("n", F.coalesce("n", F.lit(0))), "packed-sizes")
    parts = sizes.agg(F.sum("blocks")).first()[0] or 1
    placed = probs.join(items, ["cluster_id", "path_id"], "left").join(sizes, "cluster_id").withColumn("block", F.pmod(F.xxhash64("read_class_id"), F.col("blocks")).cast("int"))
    placed = placed.select(F.col("cluster_id").cast("long").alias("cluster_id"), "block", "blocks", "n", F.col("read_class_id").cast("long").alias("read_class_id"), F.coalesce("item", F.lit(-1)).alias("item"), F.coalesce("prob", F.lit(0.0)).alias("prob"), "noise_prob", F.col("read_count").cast("double").alias("read_count"))
    dealt = placed.repartition(int(parts), "cluster_id", "block").sortWithinPartitions("cluster_id", "block", "read_class_id", "item")
    return stored(dealt.mapInArrow(_pack, BLOCK), "packed"), items


class Block:
    """A block in a task: cells by read, with the noise of a read as the cell of the last item."""

    def __init__(self, batch, i: int):
        def of(name):
            column = batch.column(name)
            low, high = column.offsets[i].as_py(), column.offsets[i + 1].as_py()
            return _numbers(column.values[low:high])

        self.cluster, self.number, self.n = (batch.column(c)[i].as_py() for c in ("cluster_id", "block", "n"))
        bounds, items, probs, noise, counts = (of(c) for c in ("bounds", "items", "probs", "noise", "counts"))
        at = bounds[1:] + np.arange(len(noise))  # where each read's noise comes, behind its cells
        self.items, self.probs = np.full(len(items) + len(noise), self.n, np.int32), np.empty(len(items) + len(noise))
        cell = np.ones(len(self.items), bool)
        cell[at] = False
        self.items[cell], self.probs[cell], self.probs[at] = items, probs, noise
        self.starts, self.sizes, self.counts = bounds[:-1] + np.arange(len(noise)), np.diff(bounds) + 1, counts
        self.read = np.repeat(np.arange(len(noise)), self.sizes)

    def masses(self, shares: np.ndarray) -> np.ndarray:
        """What an expectation step adds to each item."""
        joint = self.probs * shares[self.items]
        norm = np.add.reduceat(joint, self.starts)
        norm[norm == 0] = np.inf
        return np.bincount(self.items, joint * (self.counts / norm)[self.read], minlength=self.n + 1)

    def drawn(self, shares: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Reads dealt to items at random: a multinomial draw per read, as binomial draws place by place."""
        joint = self.probs * shares[self.items]
        rest = np.add.reduceat(joint, self.starts)
        left = np.where(rest > 0, self.counts, 0).astype(np.int64)
        out = np.zeros(self.n + 1)
        for k in range(int(self.sizes.max())):
            reads = np.flatnonzero((self.sizes > k) & (left > 0))
            if not len(reads):
                break
            at = self.starts[reads] + k
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(self.sizes[reads] == k + 1, 1.0, np.clip(np.nan_to_num(joint[at] / rest[reads], nan=1.0, posinf=1.0), 0.0, 1.0))
            got = rng.binomial(left[reads], p)
            np.add.at(out, self.items[at], got)
            left[reads] -= got
            rest[reads] -= joint[at]
        return out


def _blocks(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(batch, i), (_numbers(batch.column("shares").values[batch.column("shares").offsets[i].as_py() : batch.column("shares").offsets[i + 1].as_py()]) if "shares" in batch.schema.names else None), batch, i


def _lists(cluster: int, rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([cluster] * len(rows), pa.int64()), pa.array(rows, pa.list_(pa.float64()))], names=["cluster_id", "shares"])


def _added(blocks: DataFrame, f) -> DataFrame:
    """f(block, shares, its row) of all blocks, summed up by cluster: (cluster_id, sums)."""

    def run(batches):
        for block, shares, batch, i in _blocks(batches):
            yield _lists(block.cluster, [f(block, shares, batch, i)])

    each = blocks.mapInArrow(run, SHARES).select("cluster_id", F.posexplode("shares").alias("place", "x")).groupBy("cluster_id", "place").agg(F.sum("x").alias("x"))
    return each.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("sums"))


def covers(blocks: DataFrame) -> DataFrame:
    """(cluster_id, item) of the weighted minimum path cover of clusters of one block, greedily; see ``large.path_cover``."""

    def cover(block: Block) -> list[int]:
        cell = block.items < block.n
        items, read, logs = block.items[cell], block.read[cell], np.log(block.probs[cell])
        open_ = block.counts > 0
        weights = 0.0 - np.bincount(items, logs * block.counts[read], minlength=block.n)
        gain = np.bincount(items, block.counts[read], minlength=block.n)
        by_item = np.argsort(items, kind="stable")
        ends = np.searchsorted(items[by_item], np.arange(block.n + 1))
        chosen = []
        while True:
            with np.errstate(divide="ignore", invalid="ignore"):
                best = int(np.argmax(np.where(gain > 0, np.where(weights > 0, gain / weights, np.inf), -1.0)))
            if gain[best] <= 0:
                return chosen
            chosen.append(best)
            own = read[by_item[ends[best] : ends[best + 1]]]
            own = own[open_[own]]
            open_[own] = False
            sizes = block.sizes[own] - 1
            at = np.repeat(block.starts[own], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            gain -= np.bincount(block.items[at], block.counts[np.repeat(own, sizes)], minlength=block.n)

    def run(batches):
        for block, _, _, _ in _blocks(batches):
            chosen = cover(block) if block.n else []
            yield pa.RecordBatch.from_arrays([pa.array([block.cluster] * len(chosen), pa.int64()), pa.array(chosen, pa.int32())], names=["cluster_id", "item"])

    return blocks.where("blocks = 1").mapInArrow(run, "cluster_id long, item int")


def _moved(before: np.ndarray, now: np.ndarray, tolerance: float) -> bool:
    return bool(((np.abs(now - before) > tolerance * now) & (now >= C.EM_MIN_ABUNDANCE)).any())


def em_shares(blocks: DataFrame, max_its: int, tolerance: float | None) -> DataFrame:
    """(cluster_id, shares) by expectation-maximisation, noise last: until calm, or without tolerance all max_its rounds."""
    blocks_of_one = blocks.where("blocks = 1")

    def settle(batches):
        for block, _, _, _ in _blocks(batches):
            shares, calm, total = np.full(block.n + 1, 1 / (block.n + 1)), 0, block.counts.sum() or 1.0
            for _ in range(max_its):
                before, shares = shares, block.masses(shares) / total
                if tolerance is not None:
                    calm = 0 if _moved(before, shares, tolerance) else calm + 1
                    if calm == C.EM_CONVERGED_ROUNDS:
                        break
            yield _lists(block.cluster, [shares])

    done = stored(blocks_of_one.mapInArrow(settle, SHARES), "em-shares")
    many = blocks.where("blocks > 1")
    start = F.array_repeat(1 / (F.first("n") + 1), F.first("n") + 1)
    state = stored(many.groupBy("cluster_id").agg(F.sum(F.aggregate("counts", F.lit(0.0), lambda a, x: a + x)).alias("total"), start.alias("shares"), F.lit(0).alias("calm")), "em-state")
    if state.isEmpty():
        return done
    for _ in range(max_its):
        sums = _added(many.join(F.broadcast(state.select("cluster_id", "shares")), "cluster_id"), lambda block, shares, batch, i: block.masses(shares))
        now = state.join(F.broadcast(sums), "cluster_id").withColumn("now", F.transform("sums", lambda x: x / F.greatest("total", F.lit(1e-300))))
        pair = F.arrays_zip(F.col("shares").alias("a"), F.col("now").alias("b"))
        moved = F.exists(pair, lambda x: (F.abs(x["b"] - x["a"]) > (tolerance or 0.0) * x["b"]) & (x["b"] >= C.EM_MIN_ABUNDANCE))
        calm = F.lit(0) if tolerance is None else F.when(moved, 0).otherwise(F.col("calm") + 1)
        state = stored(now.select("cluster_id", "total", F.col("now").alias("shares"), calm.alias("calm")), "em-state")
        if tolerance is not None:
            settled = state.where(F.col("calm") >= C.EM_CONVERGED_ROUNDS).select("cluster_id", "shares")
            done, state = done.unionByName(settled), state.where(F.col("calm") < C.EM_CONVERGED_ROUNDS)
            if state.isEmpty():
                return done
    return done.unionByName(state.select("cluster_id", "shares"))


def named(shares: DataFrame, items: DataFrame) -> DataFrame:
    """(cluster_id, path_id, share); path_id null is noise."""
    each = shares.select("cluster_id", F.posexplode("shares").alias("item", "share"))
    return each.join(items, ["cluster_id", "item"], "left").select("cluster_id", "path_id", "share")


def count_samples(blocks: DataFrame, shares: DataFrame, seed: int, samples: int, thin: int) -> DataFrame:
    """(cluster_id, sample, shares): shares drawn from their posterior, with noise last, from those given on.

    Blocks and iterations have random streams of their own, so reruns agree.
    """
    from pathquant.operators.estimators import SAMPLES, stream

    def gamma(cluster, it, drawn):
        own = stream(seed, cluster, SAMPLES, it).gamma(drawn + C.GIBBS_GAMMA_PRIOR, 1.0)
        return own / own.sum()

    started = blocks.join(F.broadcast(shares), "cluster_id")

    def settle(batches):
        for block, own, _, _ in _blocks(batches):
            rows = []
            for it in range(samples * thin):
                own = gamma(block.cluster, it, block.drawn(own, stream(seed, block.cluster, SAMPLES, it, block.number)))
                if (it + 1) % thin == 0:
                    rows.append(own)
            yield pa.RecordBatch.from_arrays([pa.array([block.cluster] * samples, pa.int64()), pa.array(range(1, samples + 1), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["cluster_id", "sample", "shares"])

    out = stored(started.where("blocks = 1").mapInArrow(settle, "cluster_id long, sample int, shares array<double>"), "count-samples")
    many = blocks.where("blocks > 1")
    state = stored(shares.join(many.select("cluster_id").distinct(), "cluster_id", "left_semi"), "sample-state")
    if state.isEmpty():
        return out
    for it in range(samples * thin):
        sums = _added(many.join(F.broadcast(state), "cluster_id"), lambda block, own, batch, i, it=it: block.drawn(own, stream(seed, block.cluster, SAMPLES, it, block.number)))

        def run(batches, it=it):
            for batch in batches:
                for cluster, drawn in zip(batch.column("cluster_id").to_pylist(), batch.column("sums")):
                    yield _lists(cluster, [gamma(cluster, it, _numbers(drawn.values))])

        state = stored(sums.mapInArrow(run, SHARES), "sample-state")
        if (it + 1) % thin == 0:
            out = out.unionByName(state.select("cluster_id", F.lit((it + 1) // thin).cast("int").alias("sample"), "shares"))
    return out
