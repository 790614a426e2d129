"""Sums over all segmentations of long words into pieces, in time proportional to their bytes.

All places where pieces lie in a batch of words are found by walking a trie with arrays of positions. A position that no
piece crosses cuts a word into parts whose sums multiply; nearly all long words, like encoded data or text without
spaces, fall into short parts, which are summed side by side. A long part that pieces cross everywhere is scanned
position by position, with one product of small arrays each.
"""

from __future__ import annotations

import numpy as np

BYTES = 1 << 20  # bytes of words, or one word, handled at a time
PARTS = 1 << 14  # short parts summed at a time
BLOCK = 1 << 12  # positions of a long part for which probabilities are laid out at a time
CALM = 16  # positions between rescalings: no product of so many bytes leaves the range of doubles
TOP = 1e250


class Trie:
    """Pieces inside a word and pieces that end one, by bytes."""

    def __init__(self, inner: dict[bytes, int], final: dict[bytes, int]):
        known = {b"": 0}
        for raw in (*inner, *final):
            for i in range(1, len(raw) + 1):
                known.setdefault(raw[:i], len(known))
        pairs = sorted((known[p[:-1]] << 8 | p[-1], node) for p, node in known.items() if p)
        self.keys, self.child = (np.array(x, dtype=np.int64) for x in zip(*pairs))
        self.inner, self.final = np.full((2, len(known)), -1, dtype=np.int64)
        for ids, table in ((self.inner, inner), (self.final, final)):
            ids[[known[p] for p in table]] = list(table.values())

    def places(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, id) of all pieces in data; ends: for each byte, where its word ends."""
        at, node, size = np.arange(len(data)), np.zeros(len(data), np.int64), 0
        out = []
        while len(at):
            key = node << 8 | data[at + size]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            at, node, size = at[hit], self.child[place[hit]], size + 1
            over = at + size == ends[at]
            ids = np.where(over, self.final[node], self.inner[node])
            out.append((at[ids >= 0], size, ids[ids >= 0]))
            at, node = at[~over], node[~over]
        return tuple(np.concatenate(x) for x in zip(*((a, np.full(len(a), n), i) for a, n, i in out)))


class Parts:
    """Words of a batch cut into parts, and the pieces in them; starts and ends of pieces count from their part's start."""

    def __init__(self, words: list[bytes], trie: Trie):
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        start, size, self.ids = trie.places(data, np.repeat(bounds[1:], sizes))
        over = np.bincount(start + 1, minlength=len(data) + 1) - np.bincount(start + size, minlength=len(data) + 1)
        cuts = np.flatnonzero(np.cumsum(over)[: len(data)] == 0)
        self.sizes = np.diff(np.append(cuts, len(data)))
        self.word = np.searchsorted(bounds, cuts, side="right") - 1
        self.part = np.searchsorted(cuts, start, side="right") - 1
        self.start = start - cuts[self.part]
        self.end = self.start + size

    def groups(self, parts: np.ndarray, turned: bool = False):
        """For parts in rising order: their pieces as (rows among parts, from, to, places among the pieces), in an order in which sums can be made."""
        row = np.full(len(self.sizes), -1, np.int64)
        row[parts] = np.arange(len(parts))
        own = np.flatnonzero(row[self.part] >= 0)
        a, b = self.start[own], self.end[own]
        if turned:
            a, b = self.sizes[self.part[own]] - b, self.sizes[self.part[own]] - a
        key = b * 64 + (b - a)  # no piece has 64 bytes
        order = np.argsort(key, kind="stable")
        own, a, b, key = own[order], a[order], b[order], key[order]
        bounds = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key))
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield row[self.part[own[low:high]]], int(a[low]), int(b[low]), own[low:high]

    def short(self, parts: np.ndarray, probs: np.ndarray, first: float, turned: bool = False) -> np.ndarray:
        """Sums up to each position of short parts: (part, position, language)."""
        sums = np.zeros((len(parts), int(self.sizes[parts].max()) + 1, probs.shape[1]))
        sums[:, 0] = first
        for rows, a, b, at in self.groups(parts, turned):
            sums[rows, b] += sums[rows, a] * probs[self.ids[at]]
        return sums

    def scan(self, part: int, probs: np.ndarray, turned: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Sums up to each position of one part, and the logarithms of their scales."""
        low, high = np.searchsorted(self._order[0], [part, part + 1])
        own = self._order[1][low:high]
        n, langs = int(self.sizes[part]), probs.shape[1]
        a, b, ids = self.start[own], self.end[own], self.ids[own]
        if turned:
            a, b = n - b, n - a
        order = np.argsort(b, kind="stable")
        a, b, ids = a[order], b[order], ids[order]
        width = int((b - a).max())
        sums, scale, now = np.zeros((width + n + 1, langs)), np.zeros((width + n + 1, langs)), np.full(langs, -np.log(TOP))
        sums[width], scale[: width + 1] = TOP, now
        product, done = np.empty((width, langs)), 0  # done: where sums were rescaled last
        for first in range(0, n, BLOCK):
            last = min(n, first + BLOCK)
            some = slice(*np.searchsorted(b, [first + 1, last + 1]))
            block = np.zeros((last - first, width, langs))
            block[b[some] - 1 - first, width - (b - a)[some]] = probs[ids[some]]
            for e in range(first + 1, last + 1):
                np.multiply(sums[e : width + e], block[e - 1 - first], out=product)
                np.add.reduce(product, axis=0, out=sums[width + e])
                if e % CALM == 0 or e == n:
                    scale[width + done + 1 : width + e + 1] = now
                    recent = sums[e + 1 : width + e + 1]
                    most = np.maximum(recent.max(axis=0), 1e-300)
                    recent *= TOP / most
                    now = now + np.log(most) - np.log(TOP)
                    scale[e + 1 : width + e + 1], done = now, e
        return sums[width:], scale[width:]

    @property
    def _order(self):
        if not hasattr(self, "_sorted"):
            order = np.argsort(self.part, kind="stable")
            self._sorted = self.part[order], order
        return self._sorted


def batches(words: list[bytes]):
    """Ranges of words of some BYTES in all, or of one longer word."""
    low = size = 0
    for i, w in enumerate(words):
        if size and size + len(w) > BYTES:
            yield low, i
            low, size = i, 0
        size += len(w)
    if size:
        yield low, len(words)


def _short_and_long(sizes: np.ndarray, most: int):
    short = np.flatnonzero(sizes <= most)
    return [short[i : i + PARTS] for i in range(0, len(short), PARTS)], np.flatnonzero(sizes > most).tolist()


def log_sums(words: list[bytes], probs: np.ndarray, trie: Trie, most: int) -> np.ndarray:
    """Log probability of each word under each language. most: bytes of a part that is summed without rescaling."""
    out = np.zeros((len(words), probs.shape[1]))
    with np.errstate(divide="ignore"):
        for low, high in batches(words):
            parts = Parts(words[low:high], trie)
            own = out[low:high]
            short, long = _short_and_long(parts.sizes, most)
            for some in short:
                sums = parts.short(some, probs, TOP)
                np.add.at(own, parts.word[some], np.log(sums[np.arange(len(some)), parts.sizes[some]]) - np.log(TOP))
            for part in long:
                sums, scale = parts.scan(part, probs)
                own[parts.word[part]] += np.log(sums[-1]) + scale[-1]
    return out


def expected(words: list[bytes], counts: np.ndarray, probs: np.ndarray, trie: Trie, most: int, add) -> None:
    """Tells add(ids, values by language) how often pieces are expected in words with these counts by language."""
    for low, high in batches(words):
        parts = Parts(words[low:high], trie)
        weight = counts[low:high]
        short, long = _short_and_long(parts.sizes, most)
        for some in short:
            before, after = parts.short(some, probs, 1.0), parts.short(some, probs, 1.0, True)
            whole = before[np.arange(len(some)), parts.sizes[some]]
            share = np.divide(weight[parts.word[some]], whole, out=np.zeros_like(whole), where=whole > 0)
            for rows, a, b, at in parts.groups(some):
                add(parts.ids[at], before[rows, a] * probs[parts.ids[at]] * after[rows, parts.sizes[some][rows] - b] * share[rows])
        for part in long:
            with np.errstate(divide="ignore"):
                before, after = (np.log(sums) + scale for sums, scale in (parts.scan(part, probs), parts.scan(part, probs, True)))
                own = np.flatnonzero(parts.part == part)
                logs = before[parts.start[own]] + np.log(probs[parts.ids[own]]) + after[parts.sizes[part] - parts.end[own]] - before[-1]
            add(parts.ids[own], np.exp(logs) * weight[parts.word[part]])
