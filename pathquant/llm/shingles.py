"""Words and word shingles of whole texts, vectorised over a batch of texts.

Words are maximal runs without ASCII white space, with A-Z lower-cased. A segment of bytes is hashed eight bytes at a
time; every step mixes the state and is one-to-one in the bytes it takes in, so no family of texts shares its hashes
by construction. Long segments are hashed by BLAKE2. Where equality decides a result, bytes are compared as well
(``Segments``, ``exact_shingles``): there a hash only says where to look.
"""

from __future__ import annotations

import hashlib

import numpy as np

CHUNK = 1 << 20  # bytes handled at a time; a longer text is a chunk of its own
SLICE = 1 << 18  # segments handled at a time, which bounds the arrays made on the way
LANES = 8  # eight-byte steps of a segment; a longer one goes to BLAKE2
_U64 = np.uint64
_LENGTH, _STEP = _U64(0x9E3779B97F4A7C15), _U64(0xD1342543DE82EF95)
_POSITION = np.array([pow(0xD1342543DE82EF95, i + 1, 1 << 64) for i in range(64)], dtype=_U64)
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=_U64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U64(32))) * _U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U64(29))) * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(32))


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on, as one number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the segments [start, end) of data (bytes)."""
    out, view = np.empty(len(starts), _U64), lanes(data)
    for low in range(0, len(starts), SLICE):
        at, size = starts[low : low + SLICE], ends[low : low + SLICE] - starts[low : low + SLICE]
        h = mix(size.astype(_U64) * _LENGTH + (view[at] & _KEEP[np.minimum(size, 8)]))
        for j in range(1, LANES):
            more = np.flatnonzero(size > 8 * j)
            if not len(more):
                break
            h[more] = mix(h[more] * _STEP + (view[at[more] + 8 * j] & _KEEP[np.minimum(size[more] - 8 * j, 8)]))
        for i in np.flatnonzero(size > 8 * LANES).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(data[at[i] : at[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
        out[low : low + SLICE] = h
    return out


def same_segments(data, starts, sizes, other, at, other_sizes) -> np.ndarray:
    """Which segments of data are, byte for byte, the segments of ``other`` that begin at ``at``. Either may be a view of ``lanes``."""
    a, b = (x if x.dtype == _U64 else lanes(x) for x in (data, other))
    out = sizes == other_sizes
    for low in range(0, len(starts), SLICE):
        live = low + np.flatnonzero(out[low : low + SLICE])
        for j in range(LANES):
            if j:
                live = live[sizes[live] > 8 * j]
            if not len(live):
                break
            differ = (a[starts[live] + 8 * j] ^ b[at[live] + 8 * j]) & _KEEP[np.minimum(sizes[live] - 8 * j, 8)]
            out[live[differ != 0]] = False
    for i in np.flatnonzero(out & (sizes > 8 * LANES)).tolist():
        n, step = int(sizes[i]), np.arange(8 * LANES, int(sizes[i]), 8)
        last = _KEEP[np.minimum(n - step, 8)]
        out[i] = not ((a[starts[i] + step] ^ b[at[i] + step]) & last).any()
    return out


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, where each comes first, and for every hash its place among them."""
    import pandas as pd

    codes, kinds = pd.factorize(hashes)
    first = np.empty(len(kinds), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    order = np.argsort(kinds)
    place = np.empty(len(kinds), np.int64)
    place[order] = np.arange(len(kinds))
    return kinds[order], first[order], place[codes]


class HashIndex:
    """Numbers distinct hashes from 0 in the order of their arrival. Lookups are of sorted hashes."""

    RECENT = 200_000  # hashes that wait to be merged into the large array

    def __init__(self):
        self.hashes, self.slots = np.zeros(0, _U64), np.zeros(0, np.int64)
        self.new_hashes, self.new_slots = np.zeros(0, _U64), np.zeros(0, np.int64)
        self.used = 0

    @staticmethod
    def _find(hashes, slots, wanted):
        if not len(hashes):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        return np.where(hashes[at] == wanted, slots[at], -1)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The numbers of the hashes, -1 for those not met."""
        return np.maximum(self._find(self.hashes, self.slots, wanted), self._find(self.new_hashes, self.new_slots, wanted))

    def add(self, wanted: np.ndarray) -> None:
        slots = self.used + np.arange(len(wanted))
        at = np.searchsorted(self.new_hashes, wanted)
        self.new_hashes, self.new_slots = np.insert(self.new_hashes, at, wanted), np.insert(self.new_slots, at, slots)
        self.used += len(wanted)
        if len(self.new_hashes) > self.RECENT:
            at = np.searchsorted(self.hashes, self.new_hashes)
            self.hashes, self.slots = np.insert(self.hashes, at, self.new_hashes), np.insert(self.slots, at, self.new_slots)
            self.new_hashes, self.new_slots = self.new_hashes[:0], self.new_slots[:0]


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array, doubled until it has room for ``size``."""
    while size > len(array):
        array = np.concatenate([array, np.zeros_like(array)])
    return array


class Segments:
    """Numbers distinct byte segments from 0 in the order of their arrival.

    They are looked up by hash and then compared byte by byte with the segment that has the number. A segment whose
    hash another one has taken gets no number: its caller handles it by itself.
    """

    def __init__(self):
        self.index, self.used = HashIndex(), 0  # used: bytes kept
        self.data = np.zeros(1 << 16, np.uint8)
        self.starts, self.sizes = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)

    def number(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, learn) -> np.ndarray:
        """The number of each segment [start, end) of data, or -1. learn(starts, ends) is told the new ones first, in the order of their numbers."""
        kinds, first, which = distinct(segment_hashes(data, starts, ends))
        at = self.index.find(kinds)
        new = at < 0
        if new.any():
            own = first[new]
            learn(starts[own], ends[own])
            self._keep(data, starts[own], ends[own] - starts[own])
            self.index.add(kinds[new])
            at = self.index.find(kinds)
        at = at[which]
        own = np.ndarray(len(self.data) - 7, dtype="<u8", buffer=self.data, strides=(1,))
        return np.where(same_segments(data, starts, ends - starts, own, self.starts[at], self.sizes[at]), at, -1)

    def _keep(self, data, starts, sizes):
        n, done = self.index.used, np.cumsum(sizes)
        places = np.repeat(starts - done + sizes, sizes) + np.arange(done[-1])
        self.data = grown(self.data, self.used + len(places) + 8)
        self.data[self.used : self.used + len(places)] = data[places]
        self.starts, self.sizes = grown(self.starts, n + len(starts)), grown(self.sizes, n + len(starts))
        self.starts[n : n + len(starts)] = self.used + done - sizes
        self.sizes[n : n + len(starts)] = sizes
        self.used += len(places)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words of texts that lie one after another in data."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[0] = after[-1] = False
    before[inner], after[inner - 1] = False, False
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words; for each text, its first word (and one past the last)."""
    starts, ends = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, _U64), np.zeros(len(offsets), np.int64)
    return segment_hashes(_LOWER[data], starts, ends), np.searchsorted(starts, offsets)


def _sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    words, first = word_hashes(data, offsets)
    full = np.zeros(max(0, len(words) - k + 1), _U64)
    for j in range(k):
        full += words[j : j + len(full)] * _POSITION[j]
    full = mix(full)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            out.append(np.unique(full[a : b - k + 1]))
        elif b > a:  # fewer words than a shingle: the whole sequence as one
            short = words[a:b] * _POSITION[: b - a]
            out.append(mix(short.sum(dtype=_U64, keepdims=True) + _U64(int(b - a) * 0x632BE59BD9B4E019 % 2**64)))
        else:
            out.append(np.zeros(0, _U64))
    return out


def text_chunks(column, limit: int = CHUNK):
    """Cuts an Arrow string column (null: empty) into chunks of whole texts, of some ``limit`` bytes: (bytes, offsets of the texts in them)."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    _, buffer, data = column.buffers()
    if not len(column):
        return
    offsets = np.frombuffer(buffer, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        end = min(end, len(column))
        yield data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def shingle_sets(column, k: int):
    """Yields the sorted distinct shingle hashes of each text of an Arrow string column; null: empty."""
    for data, offsets in text_chunks(column):
        yield from _sets(data, offsets, k)


def _numbers(values: np.ndarray) -> np.ndarray:
    import pandas as pd

    return pd.factorize(values)[0]


def exact_shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The distinct shingles of each text as numbers that are equal if and only if the shingles' words are; no hash decides."""
    starts, ends = word_spans(data, offsets)
    if not len(starts):
        return [np.zeros(0, np.int64)] * (len(offsets) - 1)
    lower, first = _LOWER[data], np.searchsorted(starts, offsets)
    words = Segments().number(lower, starts, ends, lambda *_: None)
    taken: dict[bytes, int] = {}  # words whose hash belongs to another word
    for i in np.flatnonzero(words < 0).tolist():
        words[i] = len(starts) + taken.setdefault(lower[starts[i] : ends[i]].tobytes(), len(taken))
    words = _numbers(words)
    n, full = int(words.max()) + 1, words
    for j in range(1, k):  # numbers of runs of j words and the next word: below 2 ** 31 each
        full = _numbers(full[: len(words) - j] * n + words[j:]) if len(words) > j else full[:0]
    short: dict[tuple, int] = {}
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(full[a : b - k + 1]))
        elif b > a:
            key = tuple(words[a:b].tolist())
            out.append(np.array([-1 - short.setdefault(key, len(short))]))
        else:
            out.append(np.zeros(0, np.int64))
    return out
