"""Token counts by offset-mapped attribution.

A document is encoded once, whole. The character spans of its tokens are then joined as intervals to its
sections (a sorted merge of two interval lists, by binary search), and a token that crosses a boundary is
allocated by a stated rule:

* ``start``: to the section that holds its first character,
* ``majority``: to the section that holds most of its characters, the first of equals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathquant.llm.encoding import default_path, encoder

ROWS = 20_000


def token_spans(enc, text: str, ids: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Character starts and ends of the text's tokens. A token that holds part of a character spans all of it."""
    if ids is None:
        spans = np.array(enc.tokenizer.encode(text, add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2)
        return spans[:, 0], spans[:, 1]
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(token_bytes(enc)[ids])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    if text.isascii():
        return starts, ends
    char = np.cumsum((np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80) - 1
    return char[starts], char[ends - 1] + 1


def token_bytes(enc) -> np.ndarray:
    """Bytes of each token of a byte-level vocabulary; a special token has those of its spelling."""
    if not hasattr(enc, "lengths"):
        vocab = enc.tokenizer.get_vocab()
        enc.lengths = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            enc.lengths[i] = len(token)  # a character of the byte alphabet each byte
    return enc.lengths


def allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section; bounds are the sections' starts and, last, the text's end."""
    n = len(bounds) - 1
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    first, last = np.clip(first, 0, n - 1), np.clip(last, 0, n - 1)
    crossing = np.flatnonzero(last > first)
    owner = first.copy()
    if rule == "majority":
        for i in crossing:
            inside = [min(ends[i], bounds[s + 1]) - max(starts[i], bounds[s]) for s in range(first[i], last[i] + 1)]
            owner[i] = first[i] + int(np.argmax(inside))
    elif rule != "start":
        raise ValueError(f"rule must be start or majority, not {rule}")
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def line_bounds(text: str) -> np.ndarray:
    """A section is a line with its newline; the text's end closes the last."""
    if "\n" not in text:
        return np.array([0, len(text)], dtype=np.int64)
    if text.isascii():
        breaks = np.flatnonzero(np.frombuffer(text.encode(), dtype=np.uint8) == 10) + 1
    else:
        breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), dtype="<u4") == 10) + 1
    inner = breaks[breaks < len(text)]
    return np.concatenate([[0], inner, [len(text)]]).astype(np.int64)


def attribute(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "majority", tokenizer: str | None = None) -> DataFrame:
    """One row per document and section: id, section (from 0), start_char, end_char, n_tokens, n_crossing, doc_tokens.

    sections_col: an array of the sections' start characters, rising from 0; without it sections are lines.
    The n_tokens of a document's sections add up to doc_tokens. Null and empty texts have one empty section
    with no tokens. Repeated rows are counted one by one; an empty table gives an empty result. Other
    columns are not read. A text is encoded whole, however long. Tokens that cross bounds equally go to the first section.
    """
    path = tokenizer or default_path()

    def run(batches):
        enc = encoder(path)
        names = ["id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"]

        def emit(held):
            ids = pa.array([i for i, b, *_ in held for _ in range(len(b) - 1)], pa.int64())
            columns = [np.concatenate(x) for x in zip(*[(np.arange(len(b) - 1), b[:-1], b[1:], t, c, np.full(len(b) - 1, t.sum())) for _, b, t, c in held])]
            return pa.RecordBatch.from_arrays([ids, pa.array(columns[0].astype(np.int32))] + [pa.array(x.astype(np.int64)) for x in columns[1:]], names=names)

        held, rows = [], 0
        for batch in batches:
            row = 0
            for ids, offsets in enc.encode_column(batch.column(1)):
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    text = batch.column(1)[row].as_py() or ""
                    given = batch.column(2)[row].as_py() if sections_col else None
                    bounds = line_bounds(text) if given is None else np.array([*sorted({0, *(x for x in given if x is not None and 0 < x < len(text))}), len(text)], dtype=np.int64)
                    held.append((batch.column(0)[row].as_py(), bounds, *allocate(*token_spans(enc, text, ids[a:b] if enc.byte_level else None), bounds, rule)))
                    rows += len(bounds) - 1
                    row += 1
                    if rows >= ROWS:
                        yield emit(held)
                        held, rows = [], 0
        if held:
            yield emit(held)

    columns = [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *([F.col(sections_col).alias("sections")] if sections_col else [])]
    out = docs.select(*columns).mapInArrow(run, "id long, section int, start_char long, end_char long, n_tokens long, n_crossing long, doc_tokens long")
    return out.withColumnRenamed("id", id_col)


def op3_offset_attribution(spark, sf_dir):
    return attribute(spark.read.parquet(f"{sf_dir}/documents.parquet"))
