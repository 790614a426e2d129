"""Packing documents into sequences of a fixed length: exact-complement hashing, then best fit.

Pieces of one length are alike, so a packing is a list of patterns: how many sequences have which lengths. Patterns are
planned from the number of pieces of each length alone, at most ``capacity`` counts whatever the number of documents. Singles,
pairs and triples of available lengths are indexed by their sums (sets of sums, as bits): a sequence that some copies of a length
begin is filled exactly by a single, a pair or a triple with the sum of its gap, as often as all of its lengths are
available. What no combination completes is packed by best fit, in falling order of length. If best fit alone takes fewer
sequences (few small pieces among many large ones), its packing is taken.

Tasks number the pieces of each length that they make, and one sum over tasks gives a piece its number among all of its length.
A pattern takes a range of these numbers, so every piece finds its sequence and offset among the ranges of its length; no
documents are grouped or sent to the driver, and a length that a third of all pieces have is no hot key.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathquant.llm.common import stored
from pathquant.llm.encoding import default_path, encoder

CAPACITY = 2048
BROADCAST_ROWS = 500_000  # (task, length) pairs, of some 50 bytes, that are broadcast at most; beyond, pieces meet them by a shuffle
ROW_GROUP = 16 << 20  # bytes of pieces that a task holds before it writes them
PIECES = "part int, nth long, {id}, piece int, start long, length long, ids array<int>"


# --- planning: lengths and their counts


@dataclass
class Pattern:
    """``times`` sequences, each with some copies of each of ``lengths``."""

    times: int
    lengths: dict[int, int] = field(default_factory=dict)


class SumIndex:
    """Which sums singles, pairs and triples of available lengths have. Bit s of a set: there is a combination of sum s."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.capacity = counts, len(counts) - 1
        self.refresh()

    def refresh(self) -> None:
        self.lengths = np.flatnonzero(self.counts)[::-1].tolist()
        full = (1 << (self.capacity + 1)) - 1
        self.singles = sum(1 << a for a in self.lengths)
        self.pairs = self._plus(self.singles) & full
        self.triples = self._plus(self.pairs) & full

    def _plus(self, sums: int) -> int:
        out = 0
        for a in self.lengths:
            out |= sums << a
        return out

    def completes(self, gap: int, taken: dict[int, int]) -> tuple[int, ...] | None:
        """The lengths, at most three, that fill the gap exactly while ``taken`` are used; large ones first. None if there are none."""
        if self.singles >> gap & 1 and self._free((gap,), taken):
            return (gap,)
        if self.pairs >> gap & 1 and (found := self._pair(gap, gap, (), taken)):
            return found
        if self.triples >> gap & 1:
            for a in self.lengths:
                if a < gap and self.pairs >> (gap - a) & 1 and 3 * a >= gap and (found := self._pair(gap - a, a, (a,), taken)):
                    return found
        return None

    def _pair(self, total: int, most: int, before: tuple[int, ...], taken) -> tuple[int, ...] | None:
        for a in self.lengths:
            if 2 * a < total:
                return None
            if a < total and a <= most and self.singles >> (total - a) & 1 and self._free(found := (*before, a, total - a), taken):
                return found
        return None

    def _free(self, lengths: tuple[int, ...], taken) -> bool:
        return all(self.counts[a] >= lengths.count(a) + taken.get(a, 0) for a in set(lengths))


def _exact(counts: np.ndarray) -> list[Pattern]:
    """Takes from counts what combinations fill exactly, from the longest length on."""
    capacity, out, index = len(counts) - 1, [], SumIndex(counts)
    for length in range(capacity, 0, -1):
        copies = capacity // length
        while counts[length] and copies:
            copies = min(copies, int(counts[length]))
            gap, own = capacity - copies * length, {length: copies}
            others = index.completes(gap, own) if gap else ()
            if others is None:
                copies -= 1  # fewer copies leave another gap
                continue
            for a in others:
                own[a] = own.get(a, 0) + 1
            times = min(int(counts[a]) // k for a, k in own.items())
            for a, k in own.items():
                counts[a] -= times * k
            out.append(Pattern(times, own))
            if any(not counts[a] for a in own):
                index.refresh()
    return out


def _best_fit(counts: np.ndarray) -> list[Pattern]:
    """Packs all of counts, longest first, each into the open sequence with the least room for it."""
    capacity, done = len(counts) - 1, []
    room: dict[int, list[Pattern]] = {}  # open sequences by their gap
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            gap = next((g for g in range(length, capacity) if room.get(g)), None)
            if gap is None:  # as many new sequences as are needed: full ones, and one with the rest
                copies = capacity // length
                full, rest = divmod(left, copies)
                opened = [Pattern(full, {length: copies})] * bool(full) + [Pattern(1, {length: rest})] * bool(rest)
                left = 0
            else:
                old = room[gap].pop()
                each = min(gap // length, left)  # after one there is less room than in any other sequence, so the next follows it
                times = min(old.times, left // each)
                own = dict(old.lengths)
                own[length] = own.get(length, 0) + each
                opened = [Pattern(times, own)]
                left -= times * each
                if old.times > times:
                    room[gap].append(Pattern(old.times - times, old.lengths))
            for pattern in opened:
                gap = capacity - sum(a * k for a, k in pattern.lengths.items())
                (room.setdefault(gap, []) if gap else done).append(pattern)
    return done + [p for same in room.values() for p in same]


def plan(counts) -> list[Pattern]:
    """Patterns that hold counts[a] pieces of each length a, for a up to the capacity len(counts) - 1.

    Where pieces of more than half of the capacity outweigh the small ones, exact fills can use up what others would need:
    then best fit alone may take fewer sequences, and is kept.
    """
    left = np.array(counts, dtype=np.int64)
    plans = [_best_fit(left.copy()), _exact(left)]
    plans[1] += _best_fit(left)
    return min(reversed(plans), key=lambda patterns: sum(p.times for p in patterns))


def ranges(patterns: list[Pattern], capacity: int) -> dict[str, np.ndarray]:
    """Rows (length, low, copies, sequence, offset), by length and low: the pieces of a length numbered from ``low``.

    The x-th of them goes to sequence + x // copies, at offset + x % copies * length.
    """
    used, rows, sequence = [0] * (capacity + 1), [], 0
    for p in patterns:
        offset = 0
        for length, copies in sorted(p.lengths.items(), reverse=True):
            rows.append((length, used[length], copies, sequence, offset))
            used[length] += p.times * copies
            offset += length * copies
        sequence += p.times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "low", "copies", "sequence", "offset"), table.T.copy()))


# --- pieces and their places


def _cut(tokenizer: str, end_id: int, capacity: int):
    def run(batches):
        from pyspark import TaskContext

        enc, part, made = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            at = 0
            for ids, offsets in enc.encode_column(batch.column(1)):
                n = len(offsets) - 1
                ids = np.insert(ids, offsets[1:], end_id).astype(np.int32)
                offsets = offsets + np.arange(n + 1)
                sizes = np.diff(offsets)
                pieces = -(-sizes // capacity)
                doc = np.repeat(np.arange(n), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = (sizes - (pieces - 1) * capacity)[doc]
                start, length = np.where(piece > 0, head + (piece - 1) * capacity, 0), np.where(piece > 0, capacity, head)
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                nth = np.empty(len(doc), np.int64)
                nth[order] = made[ranked] + np.arange(len(doc)) - np.searchsorted(ranked, ranked)
                made += np.bincount(length, minlength=capacity + 1)
                lists = pa.ListArray.from_arrays(pa.array(np.append(offsets[doc] + start, offsets[-1]).astype(np.int32)), pa.array(ids))
                columns = [pa.array(np.full(len(doc), part, np.int32)), pa.array(nth), batch.column(0).slice(at, n).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "nth", "id", "piece", "start", "length", "ids"])
                at += n

    return run


def cut(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written pieces (part, nth, id, piece, start, length, ids) of every document, encoded whole, with end_id at its end.

    Only documents of more than ``capacity`` tokens are cut, into pieces of that length; the first may be shorter. A null text
    is an empty one: its piece has the end id alone. Null ids and repeated rows stay. An empty table gives no
    pieces. Other columns are not read. nth numbers the pieces of one length within ``part``, the task that made them.
    """
    ident = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(_cut(tokenizer or default_path(), end_id, capacity), PIECES.format(id=f"id {ident}")), "packing-pieces", **{"parquet.block.size": str(ROW_GROUP)})


def place(pieces: DataFrame, *, written: DataFrame | None = None, capacity: int = CAPACITY) -> DataFrame:
    """pieces (part, nth, length and any other columns) with sequence_id and offset instead of part and nth.

    written: the same pieces as ``cut`` has written them, where those given are derived; their lengths are counted there.
    Every sequence has at most ``capacity`` tokens, without a gap from offset 0 on. Ties between pieces of one length go by
    part and nth, so reruns over the same written pieces agree. Without pieces the result is empty.
    """
    by_part = stored((written or pieces).groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row per length, capacity at most
        counts[r["length"]] = r["n"]
    table = ranges(plan(counts), capacity)
    rows = list(zip(*(table[c].tolist() for c in ("length", "low", "copies", "sequence", "offset"))))
    found = pieces.sparkSession.createDataFrame(rows, "length long, low long, copies long, sequence long, offset long")  # some rows per length: bounded by the capacity
    found = found.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "copies", "sequence", "offset"))).alias("ranges"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    starts = F.broadcast(starts) if by_part.count() <= BROADCAST_ROWS else starts
    kept = [F.col(f"`{c}`") for c in pieces.columns if c not in ("part", "nth")]
    numbered = pieces.join(starts, ["part", "length"]).select(*kept, (F.col("before") + F.col("nth")).alias("_number")).join(F.broadcast(found), "length")
    own = F.element_at("ranges", F.size(F.filter("ranges", lambda r: r["low"] <= F.col("_number"))))
    placed = numbered.withColumn("_range", own).withColumn("_x", F.col("_number") - F.col("_range.low"))
    sequence = F.col("_range.sequence") + F.expr("_x div _range.copies")
    return placed.select(*kept, sequence.alias("sequence_id"), (F.col("_range.offset") + F.col("_x") % F.col("_range.copies") * F.col("length")).alias("offset"))


def pack(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids, sequence_id, offset) of every piece of every document; see ``cut`` and ``place``."""
    return place(cut(docs, tokenizer=tokenizer, end_id=end_id, capacity=capacity, id_col=id_col, text_col=text_col), capacity=capacity).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the tokens of each sequence. A sequence has at most as many pieces as tokens."""
    pieces = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    return pieces.select("sequence_id", F.flatten(F.transform("pieces", lambda p: p["ids"])).alias("ids"))


def _crc(batches):
    for batch in batches:
        lists = batch.column(6)
        values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
        crcs = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(crcs, pa.int64())], names=["part", "nth", "doc_id", "piece", "start", "length", "ids_crc32"])


def op13_best_fit_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = cut(docs)
    digests = written.mapInArrow(_crc, f"part int, nth long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")
    return place(digests, written=written)
