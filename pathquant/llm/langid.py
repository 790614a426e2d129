"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary with word ends. Per language, piece probabilities are
learned by expectation-maximisation from word counts; the probability of a word is the sum over all its
segmentations into pieces, by the forward algorithm, and that of a text is the product over its words. As
no piece holds white space, this is the sum over all segmentations of the whole text.

Only the fit uses a sample: about ``fit_docs`` documents per language, chosen by a hash of the id. Its expectation
steps run in tasks over the distinct words. Every document is scored on its whole text, in time proportional to it, however
long its words are.
"""

from __future__ import annotations

import json
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathquant.llm.encoding import byte_alphabet, default_path
from pathquant.llm.common import stored
from pathquant.llm.segmentations import TOP, Trie, expected, log_sums
from pathquant.llm.shingles import Segments, grown, text_chunks, word_spans

FIT_DOCS = 1_000  # documents per language that the fit reads, about
ROUNDS = 2  # of expectation-maximisation
WORDS, WORD_BYTES = 450_000, 1 << 26  # words that a worker keeps, and their bytes; at more it starts anew, so memory is bounded
ROWS = 512  # documents scored at a time
FIT_ROWS = 2_000  # distinct words of the fit handled at a time


@lru_cache(maxsize=2)
def pieces(path: str) -> Tables:
    """Pieces inside a word, pieces that end one, their number and the bytes of the longest. Every byte is a piece of either kind."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    back = {c: b for b, c in byte_alphabet().items()}
    inner, final = {}, {}
    for token, i in vocab.items():
        last = token.endswith("</w>")
        raw = token.removesuffix("</w>")
        if raw and all(c in back for c in raw):
            (final if last else inner)[bytes(back[c] for c in raw)] = i
    n = max(vocab.values(), default=-1) + 1
    for b in range(256):
        for table in (inner, final):
            if bytes([b]) not in table:
                table[bytes([b])] = n
                n += 1
    return Tables((inner, final, n, max(len(x) for x in (*inner, *final))))


def _edges(words: list[bytes], n: int, tables):
    """For words of n bytes: (start, end, piece ids of the words, -1 where there is none), by end."""
    inner, final, _, window = tables
    for end in range(1, n + 1):
        table = final if end == n else inner
        for start in range(max(0, end - window), end):
            ids = np.fromiter((table.get(w[start:end], -1) for w in words), dtype=np.int64, count=len(words))
            if (ids >= 0).any():
                yield start, end, ids


@lru_cache(maxsize=2)
def _trie(tables) -> Trie:
    return Trie(tables[0], tables[1])


class Tables(tuple):
    """What ``pieces`` returns; equal only to itself, so that a trie of it can be kept."""

    __hash__, __eq__ = object.__hash__, object.__eq__


def forward(words: list[bytes], probs: np.ndarray, tables) -> np.ndarray:
    """Log probability of each word under each language; words must not be empty. probs: pieces + 1 zero row, by language.

    Words of up to the bytes of the longest piece are summed by length, longer ones in parts (see ``segmentations``).
    """
    out, window = np.zeros((len(words), probs.shape[1])), tables[3]
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(min(len(w), window + 1), []).append(i)
    long = by_length.pop(window + 1, [])
    for n, rows in by_length.items():
        own = [words[i] for i in rows]
        alpha = np.zeros((n + 1, len(rows), probs.shape[1]))
        alpha[0] = TOP
        for start, end, ids in _edges(own, n, tables):
            alpha[end] += alpha[start] * probs[ids]
        with np.errstate(divide="ignore"):
            out[rows] = np.log(alpha[n]) - np.log(TOP)
    if long:
        out[long] = log_sums([words[i] for i in long], probs, _trie(tables), window)
    return out


def _expected(words: list[bytes], counts: np.ndarray, probs: np.ndarray, tables) -> np.ndarray:
    """Expected piece counts, by language, of words with counts by language."""
    total, window = np.zeros_like(probs), tables[3]
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(min(len(w), window + 1), []).append(i)
    long = by_length.pop(window + 1, [])

    def add(ids, value):
        for k in range(probs.shape[1]):
            total[:, k] += np.bincount(np.where(ids < 0, len(probs) - 1, ids), weights=value[:, k], minlength=len(probs))

    for n, rows in by_length.items():
        own, weight = [words[i] for i in rows], counts[rows]
        edges = list(_edges(own, n, tables))
        alpha, beta = np.zeros((2, n + 1, len(rows), probs.shape[1]))
        alpha[0] = beta[n] = 1
        for start, end, ids in edges:
            alpha[end] += alpha[start] * probs[ids]
        for start, end, ids in sorted(edges, key=lambda e: -e[0]):
            beta[start] += beta[end] * probs[ids]
        share = np.divide(weight, alpha[n], out=np.zeros_like(alpha[n]), where=alpha[n] > 0)
        for start, end, ids in edges:
            add(ids, alpha[start] * probs[ids] * beta[end] * share)
    if long:
        expected([words[i] for i in long], counts[long], probs, _trie(tables), window, add)
    total[-1] = 0
    return total


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS, vocabulary: str | None = None, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (pieces + 1 zero row, by language), from labelled rows.

    fit_docs bounds the sample per language; a language with fewer documents gives all of them. Rows with a
    null language, text or id are not used. The driver handles one row per language and per piece, whatever the texts.
    """
    spark, path = docs.sparkSession, vocabulary or default_path("word_bpe_49k.json")
    tables = pieces(path)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((tables[2] + 1, 0))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    limit = F.create_map([x for k in langs for x in (F.lit(k), F.lit(int(min(1, fit_docs / sizes[k]) * (1 << 30))))])
    words = rows.where(place < F.element_at(limit, F.col("lang"))).select("lang", F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("word")).where("word != ''")
    counts = words.groupBy("word").agg(F.array(*[F.count(F.when(F.col("lang") == k, 1)).cast("double") for k in langs]).alias("counts"))
    counts = stored(counts.repartition(2 * spark.sparkContext.defaultParallelism, "word"), "langid-words")
    probs = np.full((tables[2] + 1, len(langs)), 1 / tables[2])
    probs[-1] = 0
    for _ in range(rounds):
        total = _expected_of(counts, probs, path)
        smooth = 0.01
        probs = (total + smooth) / (total.sum(axis=0) + smooth * tables[2])
        probs[-1] = 0
    return langs, probs


def _expected_of(counts: DataFrame, probs: np.ndarray, path: str) -> np.ndarray:
    """Expected piece counts of a table (word, counts by language): tasks sum over words, Spark over tasks. The driver gets a row per piece."""
    spark, langs = counts.sparkSession, probs.shape[1]
    sent = spark.sparkContext.broadcast(probs)  # vocabulary x languages

    def run(batches):
        tables, total = pieces(path), np.zeros_like(sent.value)
        for batch in batches:
            for low in range(0, batch.num_rows, FIT_ROWS):
                part = batch.slice(low, FIT_ROWS)
                own = part.column(1).flatten().to_numpy().reshape(-1, langs)
                total += _expected([w.encode() for w in part.column(0).to_pylist()], own, sent.value, tables)
        ids = np.flatnonzero(total.any(axis=1))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(total[ids].ravel()), langs).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(ids), lists], names=["piece", "n"])

    each = counts.mapInArrow(run, "piece long, n array<double>")
    rows = each.groupBy("piece").agg(*[F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(langs)]).toArrow()
    total = np.zeros_like(probs)
    for k in range(langs):
        total[rows.column("piece").to_numpy(), k] = rows.column(f"n{k}").to_numpy()
    return total


class Scorer:
    """Scores texts by the sums over their words; keeps the words met, found by hash and compared byte by byte, and their scores."""

    def __init__(self, probs: np.ndarray, tables):
        self.probs, self.tables = probs, tables
        self._forget()

    def _forget(self):
        self.words, self.scores = Segments(), np.zeros((1 << 12, self.probs.shape[1]))

    def _learn(self, raw: bytes, starts, ends):
        used = self.words.index.used
        self.scores = grown(self.scores, used + len(starts))
        self.scores[used : used + len(starts)] = forward([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())], self.probs, self.tables)

    def score(self, column) -> np.ndarray:
        """Log probability of each text of an Arrow string column under each language."""
        out = []
        for data, offsets in text_chunks(column):
            starts, ends = word_spans(data, offsets)
            total = np.zeros((len(offsets) - 1, self.probs.shape[1]))
            if len(starts):
                if self.words.index.used > WORDS or self.words.used > WORD_BYTES:
                    self._forget()
                raw = data.tobytes()
                at = self.words.number(data, starts, ends, lambda a, b: self._learn(raw, a, b))
                own = self.scores[at]
                taken = np.flatnonzero(at < 0)  # words whose hash belongs to another word
                if len(taken):
                    own[taken] = forward([raw[starts[i] : ends[i]] for i in taken.tolist()], self.probs, self.tables)
                texts = np.searchsorted(offsets, starts, side="right") - 1
                cuts = np.flatnonzero(np.concatenate([[True], texts[1:] != texts[:-1]]))
                total[texts[cuts]] = np.add.reduceat(own, cuts, axis=0)
            out.append(total)
        return np.concatenate(out) if out else np.zeros((0, self.probs.shape[1]))


@lru_cache(maxsize=1)
def _scorer(token: str, path: str) -> list:
    """The worker's scorer of one model: an empty list until the first task fills it."""
    return []


def predict(docs: DataFrame, model, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, passed=(), evidence: bool = False) -> DataFrame:
    """Columns of ``passed``, then lang_pred and score (posterior of the language, with equal priors).

    With evidence, then ``evidence``: the bits per byte of its words by which the text is more probable under that
    language than under a background of equally likely bytes. Below 0, none of the languages explains the text.

    ``und`` with score and evidence 0 if the text is null or has no letter, or no language was learned. Repeated rows are
    scored one by one; an empty table gives an empty result. Ties go to the language that sorts first. Texts are scored
    whole, however long. ``passed`` must not hold the names of the added columns.
    """
    spark = docs.sparkSession
    path = vocabulary or default_path("word_bpe_49k.json")
    sent = spark.sparkContext.broadcast(model)  # vocabulary x languages: does not grow with the data
    passed = list(passed) or [id_col]
    kept, added = [f"c{i}" for i in range(len(passed))], ["lang_pred", "score", *(["evidence"] if evidence else [])]
    token = uuid.uuid4().hex

    def run(batches):
        langs, probs = sent.value
        scorer = _scorer(token, path)
        if not scorer:
            scorer.append(Scorer(probs, pieces(path)))
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                text = part.column(source)
                pred, value, bits = np.array(["und"] * len(text), dtype=object), np.zeros(len(text)), np.zeros(len(text))
                known = np.flatnonzero(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)) if langs else []
                if len(known):
                    lower = pc.utf8_lower(text.take(pa.array(known)))
                    logs = scorer[0].score(lower)
                    if evidence:
                        size = pc.binary_length(pc.replace_substring_regex(lower, r"[\x20\x09-\x0D]+", "")).to_numpy(zero_copy_only=False)
                        bits[known] = 8 + logs.max(axis=1) / np.log(2) / size
                    post = np.exp(logs - logs.max(axis=1, keepdims=True))
                    post /= post.sum(axis=1, keepdims=True)
                    best = post.argmax(axis=1)
                    pred[known] = np.array(langs, dtype=object)[best]
                    value[known] = np.minimum(1.0, post[np.arange(len(best)), best])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(pred.tolist(), pa.string()), pa.array(value), *([pa.array(bits)] if evidence else [])], names=[*kept, *added])

    source = passed.index(text_col) if text_col in passed else len(kept)
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(passed, kept)], *([] if text_col in passed else [F.col(text_col).alias("text")]))
    types = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in kept]
    out = rows.mapInArrow(run, ", ".join([*types, "lang_pred string", "score double", *(["evidence double"] if evidence else [])]))
    return out.toDF(*passed, *added)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op9_segmentation_marginalised_unigrams(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
