"""Runs of periodically repeated words, by a harmonic grid.

A run of period p that is at least 4 p words long holds two equal blocks of p words, one after the other, of which the
first begins at a multiple of 2 p. So for every period the grid points 0, 2 p, 4 p, ... are enough, n / (2 p)
of them, and all (period, grid point) pairs of a text are some n ln(n) / 2. They are handled at once, as arrays, together with
those of the other texts of a chunk: one comparison of prefix hashes tells whether the two blocks are equal, and
a binary search over prefix hashes, for all pairs that remain simultaneously, how far the equality reaches to the right
and to the left. Hashes only propose: each run is verified word by word, and a text
in which a hash was wrong is searched again with another base, in the end by words alone. Runs found from several grid points or periods are one run, that of the smallest period.

Words are numbered before, so that equal numbers are equal words, and texts are worked on whole: the pairs are taken in
slices, so memory is proportional to the longest text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathquant.llm.shingles import Segments, text_chunks, word_spans

PAIRS = 1 << 20  # (period, grid point) pairs, and words of verified runs, handled at a time
WORDS = 1 << 18  # words joined at a time
PRIME = (1 << 31) - 1
BASES = [5**13 * 48271**i % PRIME for i in range(6)]  # each is tried where those before gave one hash to different stretches


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of the words that are equal if and only if the words are, byte for byte."""
    if not len(starts):
        return np.zeros(0, np.int64)
    out = Segments().number(data, starts, ends, lambda *_: None)
    taken: dict[bytes, int] = {}  # words whose hash belongs to another word
    for i in np.flatnonzero(out < 0).tolist():
        out[i] = len(starts) + taken.setdefault(data[starts[i] : ends[i]].tobytes(), len(taken))
    return out


class PrefixHash:
    """Says by hash whether two stretches of a sequence are equal: never wrongly that they differ."""

    def __init__(self, words: np.ndarray, base: int):
        self.power = np.ones(len(words) + 1, np.int64)
        done = 1
        while done <= len(words):  # powers of the base, by doubling
            more = min(done, len(words) + 1 - done)
            self.power[done : done + more] = self.power[:more] * (int(self.power[done - 1]) * base % PRIME) % PRIME
            done += more
        self.sums = np.zeros(len(words) + 1, np.int64)
        np.cumsum((words + 1) % PRIME * self.power[: len(words)] % PRIME, out=self.sums[1:])  # under 2 ** 63 up to 2 ** 32 words

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of these lengths at a and b are equal; a <= b."""
        left = (self.sums[a + length] - self.sums[a]) % PRIME * self.power[b - a] % PRIME
        return left == (self.sums[b + length] - self.sums[b]) % PRIME


def _reach(equal_at, most: np.ndarray) -> np.ndarray:
    """The greatest length up to ``most`` for which equal_at(rows, length) holds, by binary search for all rows at once."""
    low, high = np.zeros_like(most), most.copy()
    live = np.flatnonzero(low < high)
    while len(live):
        middle = (low[live] + high[live] + 1) >> 1
        same = equal_at(live, middle)
        low[live[same]] = middle[same]
        high[live[~same]] = middle[~same] - 1
        live = live[low[live] < high[live]]
    return low


def _pairs(first: np.ndarray, repeats: int, least: int):
    """Yields (text, period, grid point) arrays of all pairs of the texts that begin at ``first``, in slices."""
    sizes = np.diff(first)
    periods = np.where(sizes >= least, sizes // repeats, 0)  # periods up to this can have a run
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    # a run leaves room for step + 1 places of its two blocks, one of which is a grid point
    step = np.maximum(least, repeats * period) - 2 * period
    points = (sizes[text] - 2 * period) // step + 1
    done = np.cumsum(points)
    low = 0
    while low < len(text):
        high = max(low + 1, int(np.searchsorted(done, done[low] - points[low] + PAIRS, side="right")))
        n = points[low:high]
        before = np.cumsum(n) - n
        own = np.repeat(np.arange(low, high), n)
        place = (np.arange(len(own)) - np.repeat(before, n)) * step[own]
        yield text[own], period[own], first[text[own]] + place
        low = high


def _wrong(words, start, length, period) -> np.ndarray:
    """Which runs do not hold when every word is compared with the one a period on."""
    size = length - period
    done, low, wrong = np.cumsum(size), 0, [np.zeros(0, np.int64)]
    while low < len(start):
        high = max(low + 1, int(np.searchsorted(done, done[low] - size[low] + PAIRS, side="right")))
        n = size[low:high]
        own = np.repeat(np.arange(low, high), n)
        at = start[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        wrong.append(np.unique(own[words[at] != words[at + period[own]]]))
        low = high
    return np.concatenate(wrong)


def _by_words(words: np.ndarray, repeats: int, least: int) -> np.ndarray:
    """Rows (0, start, end, period) of one text by comparing all words at every distance."""
    rows = []
    for p in range(1, len(words) // repeats + 1):
        edges = np.flatnonzero(np.diff(np.r_[0, (words[:-p] == words[p:]).astype(np.int8), 0]))
        starts, ends = edges[::2], edges[1::2] + p
        keep = ends - starts >= max(least, repeats * p)
        rows += [(0, a, b, p) for a, b in zip(starts[keep].tolist(), ends[keep].tolist())]
    return np.array(rows, dtype=np.int64).reshape(-1, 4)


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Of the rows (text, start, end, period) of one stretch that with the smallest period, by text, start and period."""
    import pandas as pd

    rows = rows[np.argsort(rows[:, 3], kind="stable")]
    rows = rows[~pd.DataFrame(rows[:, :3]).duplicated().to_numpy()]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _rows(words: np.ndarray, first: np.ndarray, repeats: int, least: int, attempt: int = 0) -> np.ndarray:
    """Rows (text, start, end, period) of all runs, places counted over all texts."""
    if attempt == len(BASES):
        return _by_words(words, repeats, least)
    hashes, found = PrefixHash(words, BASES[attempt]), [np.zeros((0, 4), np.int64)]
    for text, period, at in _pairs(first, repeats, least):
        keep = np.flatnonzero(words[at] == words[at + period])
        keep = keep[hashes.equal(at[keep], at[keep] + period[keep], period[keep])]
        text, period, at = text[keep], period[keep], at[keep]
        right = _reach(lambda i, n: hashes.equal(at[i], at[i] + period[i], n), first[text + 1] - at - period)
        left = _reach(lambda i, n: hashes.equal(at[i] - n, at[i] + period[i] - n, n), at - first[text])
        start, end = at - left, at + period + right
        keep = end - start >= np.maximum(least, repeats * period)
        found.append(_smallest(np.stack([text[keep], start[keep], end[keep], period[keep]], axis=1)))
    rows = _smallest(np.concatenate(found))
    wrong = _wrong(words, rows[:, 1], rows[:, 2] - rows[:, 1], rows[:, 3])
    if len(wrong):  # different stretches had one hash: their texts are searched again, with another base
        bad = np.unique(rows[wrong, 0])
        again = [_rows(words[first[t] : first[t + 1]], np.array([0, first[t + 1] - first[t]]), repeats, least, attempt + 1) + [t, first[t], first[t], 0] for t in bad]
        rows = _smallest(np.concatenate([rows[~np.isin(rows[:, 0], bad)], *again]))
    return rows


def find_runs(words: np.ndarray, first: np.ndarray, repeats: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of texts that lie one after another: (text, start in words, length, period), by text, start and period.

    A run has at least ``repeats`` (3 or more) periods and ``least`` words, its period is the smallest, and
    no neighbouring word extends it. words: numbers; first: the first word of each text, and one past the last.
    """
    text, start, end, period = _rows(words, first, repeats, least).T
    return text, start - first[text], end - start, period


@dataclass
class Chunk:
    """Texts that lie one after another, their words and runs."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    runs: tuple

    def dropped(self) -> np.ndarray:
        """Words that some run holds after its first period."""
        text, start, length, period = self.runs
        begin, end = self.first[text] + start + period, self.first[text] + start + length
        change = np.bincount(begin, minlength=len(self.starts) + 1) - np.bincount(end, minlength=len(self.starts) + 1)
        return np.cumsum(change[: len(self.starts)]) > 0

    def collapsed(self) -> pa.Array:
        """Each text's words without the dropped ones, joined by spaces."""
        kept = np.flatnonzero(~self.dropped())
        owner = np.searchsorted(self.first, kept, side="right") - 1
        last = np.ones(len(kept), bool)
        last[:-1] = owner[1:] != owner[:-1]
        size = self.ends[kept] - self.starts[kept] + ~last
        parts = [np.zeros(0, np.uint8)]
        for low in range(0, len(kept), WORDS):
            some, n = kept[low : low + WORDS], size[low : low + WORDS]
            done = np.cumsum(n)
            places = np.repeat(self.starts[some] - done + n, n) + np.arange(int(done[-1]))
            part = self.data[np.minimum(places, len(self.data) - 1)]
            part[(done - 1)[~last[low : low + WORDS]]] = 32
            parts.append(part)
        lengths = np.zeros(len(self.first), np.int64)
        np.add.at(lengths, owner + 1, size)
        return pa.LargeStringArray.from_buffers(len(self.first) - 1, pa.py_buffer(np.cumsum(lengths)), pa.py_buffer(np.concatenate(parts)))


def _chunks(column, repeats: int, least: int):
    for data, offsets in text_chunks(column):
        starts, ends = word_spans(data, offsets)
        first = np.searchsorted(starts, offsets)
        yield Chunk(data, starts, ends, first, find_runs(word_numbers(data, starts, ends), first, repeats, least))


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repeats: int = 4, least: int = 6) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row; runs: array of (start, length, period), by start, then period.

    Words are what stands between ASCII white space, compared byte for byte. A run has at least ``repeats`` periods
    and ``least`` words; collapsed has the words that no run holds after its first period, joined by one space. A
    null or empty text, or one of white space, has no words, no runs and an empty collapsed text. Null ids and repeated
    rows stay as they are. Texts are searched whole, however long: one of n words takes n ln(n) / 2 pairs, in slices. An
    empty table gives an empty result. Other columns are not read, so their names cannot clash.
    """
    ident = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at = 0
            for chunk in _chunks(batch.column(1), repeats, least):
                text, start, length, period = chunk.runs
                n = len(chunk.first) - 1
                offsets = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"])
                columns = [batch.column(0).slice(at, n), pa.array(np.diff(chunk.first)), pa.ListArray.from_arrays(pa.array(offsets), items), chunk.collapsed().cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])
                at += n

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {ident}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def with_planted_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): a tenth of the documents, chosen by h = crc32 of the id, with its words from some place on repeating.

    With g = h / 10, each word i >= a becomes word a + (i - a) % p, for a = g % n and p = 1 + (n - a) / (3 + g % 8).
    Texts without words and rows without an id stay as they are.
    """
    ident, text = F.col(id_col), F.col(text_col)
    h = F.crc32(ident.cast("string"))
    rows = docs.select(ident.alias("id"), text.alias("text"), F.when(h % 10 == 0, F.floor(h / 10)).alias("g"))
    words = F.when(F.col("g").isNotNull(), F.regexp_extract_all(F.col("text"), F.lit(r"([^\x20\x09-\x0D]+)")))
    rows = rows.withColumn("words", words).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1)
    place = F.when(F.col("n") > 0, F.expr("transform(words, (w, i) -> IF(i < a, w, words[CAST(a + (i - a) % p AS INT)]))"))
    return rows.select(F.col("id").alias(id_col), F.coalesce(F.array_join(place, " "), F.col("text")).alias(text_col))


def op12_periodic_runs(spark, sf_dir):
    docs = with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = periodic_runs(docs)
    # the greatest length / period: of fractions that are equal as doubles, the cross product decides
    best = F.expr("reduce(runs, CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>), (b, r) -> CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    rows = found.withColumn("best", best)
    milli = F.expr("best.length * 1000 div best.period")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
