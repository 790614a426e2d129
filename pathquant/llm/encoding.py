"""Whole-text encoding with a tokenizer file, one encoder per Python worker.

Byte-level BPE never merges over a pre-token's edge. A space that other than white space follows always
begins a pre-token, and so do a newline between two non-spaces and a mark after an ASCII letter. Texts are
cut there, and the ids of each distinct piece of text are kept: bytes, places and ids in arrays, so that whole batches are
encoded by array operations and only new pieces reach the tokenizer's model. A piece is found by its hash and compared
byte by byte. Texts for which the rule can't be told from ASCII alone (other white space, special tokens spelled out), and
those with a piece whose hash belongs to another piece, go to the tokenizer whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np

from pathquant.llm.shingles import Segments, grown, text_chunks

#: The pre-token pattern of byte-level BPE vocabularies.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES, PIECE_BYTES = 850_000, 1 << 26  # pieces of text that a worker keeps, and their bytes; at more it starts anew, so memory is bounded
PRETOKENS = 100_000  # pre-tokens of longer pieces that it keeps
OTHER_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff]")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.zeros(256, dtype=bool)  # bytes that may begin other white space
_ODD[[11, 12, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_LETTER, _MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
_MARK[[*b",.;:!?()"]] = True


def byte_alphabet() -> dict[int, str]:
    """Byte -> the printable character that stands for it in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Gives the ids of ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
        self.special = [t["content"].encode() for t in spec.get("added_tokens", ())]
        self.model, self.split = self.tokenizer.model, regex.compile(PRETOKEN).findall
        self.letters = {b: ord(c) for b, c in byte_alphabet().items()}
        self.pretokens: dict[str, list[int]] = {}
        self._forget()

    def _forget(self):
        self.segments, self.used = Segments(), 0
        self.starts, self.counts = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _model(self, pretoken: str) -> list[int]:
        return [t.id for t in self.model.tokenize(pretoken.encode().decode("latin-1").translate(self.letters))]

    def _piece(self, text: str) -> list[int]:
        if text[0] == " " and text[1:].isalpha():  # a word after a space is a pre-token as it stands
            return self._model(text)
        out: list[int] = []
        for pretoken in self.split(text):
            ids = self.pretokens.get(pretoken)
            if ids is None:
                if len(self.pretokens) >= PRETOKENS:
                    self.pretokens.clear()
                ids = self.pretokens[pretoken] = self._model(pretoken)
            out += ids
        return out

    def _learn(self, raw: bytes, starts, ends):
        """Adds the ids of new pieces."""
        got = [self._piece(raw[a:b].decode()) for a, b in zip(starts.tolist(), ends.tolist())]
        counts = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        total, slot = int(counts.sum()), self.segments.index.used
        self.ids = grown(self.ids, self.used + total)
        self.starts, self.counts = grown(self.starts, slot + len(got)), grown(self.counts, slot + len(got))
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), dtype=np.uint32, count=total)
        self.starts[slot : slot + len(got)] = self.used + np.cumsum(counts) - counts
        self.counts[slot : slot + len(got)] = counts
        self.used += total

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, texts = len(data), len(offsets) - 1
        raw = data.tobytes()
        odd: dict[int, np.ndarray] = {}
        if not self.byte_level:
            suspects = np.arange(texts)
        else:
            places = np.flatnonzero(_ODD[data])
            suspects = np.unique(np.searchsorted(offsets, places, side="right") - 1) if len(places) else np.zeros(0, np.int64)
            if any(s in raw for s in self.special):
                suspects = np.arange(texts)
        for i in suspects.tolist():
            part = raw[offsets[i] : offsets[i + 1]]
            if not part:
                continue
            text = part.decode()
            if not self.byte_level or OTHER_SPACE.search(text) or any(s in part for s in self.special):
                odd[i] = self.whole(text)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(texts + 1, np.int64)

        space = _SPACE[data]
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        after[inner - 1] = True
        cut = (data == 32) & ~after | (data == 10) & ~after & ~before
        cut[1:] |= _MARK[data[1:]] & _LETTER[data[:-1]]
        cut[0] = True
        cut[inner] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        owner = np.searchsorted(offsets, starts, side="right") - 1
        if odd:
            plain = ~np.isin(owner, list(odd))
            starts, ends, owner = starts[plain], ends[plain], owner[plain]
        if self.segments.index.used > PIECES or self.segments.used > PIECE_BYTES:
            self._forget()
        at = self.segments.number(data, starts, ends, lambda a, b: self._learn(raw, a, b))
        if (at < 0).any():
            odd |= {i: self.whole(raw[offsets[i] : offsets[i + 1]].decode()) for i in np.unique(owner[at < 0]).tolist()}
            plain = ~np.isin(owner, list(odd))
            at, owner = at[plain], owner[plain]
        counts = self.counts[at].astype(np.int64)
        done = np.cumsum(counts)
        ids = self.ids[np.repeat(self.starts[at] - done + counts, counts) + np.arange(done[-1] if len(done) else 0)]
        lengths = np.bincount(owner, weights=counts, minlength=texts).astype(np.int64)
        if odd:
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            ids = np.concatenate([x for i in range(texts) for x in (odd.get(i, ids[bounds[i] : bounds[i + 1]]),)])
            for i, x in odd.items():
                lengths[i] = len(x)
        return ids, np.concatenate([[0], np.cumsum(lengths)])

    def encode_column(self, column):
        """Yields (ids, offsets of the texts' ids) for parts of an Arrow string column, in order; null: empty."""
        for data, offsets in text_chunks(column):
            yield self._chunk(data, offsets)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file; what it has learned serves all tasks of the worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
