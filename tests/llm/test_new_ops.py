"""Whitening, periodic runs and packing against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathquant.llm import packing, periodic, whitening
from pathquant.llm.encoding import default_path
from pathquant.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# --- whitening


def numbers_of(vectors):
    return [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]


def check_whitening(got, kept, components):
    """got: rows of the operator; kept: (vec_id, vector) of the rows that stay."""
    x = np.array(numbers_of(v for _, v in kept), dtype=object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((fit * n - sums) / n).astype(float)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    want = ((x * n - sums) / n).astype(float) @ vectors / np.sqrt(values)
    deviation = {i: int(((row * n - sums) ** 2).sum()) for (i, _), row in zip(kept, x)}
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(kept) * components and set(by) == {(i, k + 1) for i, _ in kept for k in range(components)}
    for k in range(components):
        mine = np.array([by[i, k + 1]["whitened"] for i, _ in kept])
        sign = np.sign(mine[np.abs(want[:, k]).argmax()] * want[np.abs(want[:, k]).argmax(), k])
        assert np.allclose(mine * sign, want[:, k], rtol=1e-7, atol=1e-9)
        assert by[kept[0][0], k + 1]["explained"] == pytest.approx(values[k] / np.trace(cov), rel=1e-9)
    assert all(r["n"] == n and r["deviation"] == deviation[r["vec_id"]] for r in got)
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-9


def test_whitening_query(spark):
    kept = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    check_whitening(QUERIES["op11_embedding_whitening"](spark, SF).collect(), kept, 16)


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(c) for c in rng.normal(size=3) * [1, 20, 400]]) for i in range(60)] + [(100, [0.0, 0.0, 0.0]), (101, [0.0, 0.0, 0.0]), (102, [0.001, 0.002, 0.003])]
    bad = [(200, None), (201, [1.0, None, 2.0]), (202, [1.0, float("nan"), 2.0]), (203, [float("inf"), 1.0, 2.0]), (204, [float("-inf"), 1.0, 2.0]), (205, [])]
    rows = spark.createDataFrame([(i, v, "clash", 7) for i, v in [*good, *bad]], "vec_id long, embedding array<double>, whitened string, n int")
    check_whitening(whitening.whitened_components(rows).collect(), good, 3)
    check_whitening(whitening.whitened_components(rows.repartition(7), components=2).collect(), good, 2)
    assert whitening.whitened_components(rows.limit(0)).count() == 0
    assert whitening.whitened_components(rows.where("vec_id >= 200")).count() == 0
    assert whitening.whitened_components(rows.where("vec_id IN (100, 101)")).count() == 0  # no component has a variance
    ids = spark.createDataFrame([(None, [1.0, 2.0]), (5, [2.0, 1.0]), (5, [2.0, 1.0])], "vec_id long, embedding array<float>")
    got = whitening.whitened_components(ids).collect()
    assert Counter((r["vec_id"], r["component"]) for r in got) == {(None, 1): 1, (5, 1): 2} and {r["n"] for r in got} == {2}
    with pytest.raises(ValueError):
        whitening.whitened_components(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(OverflowError):
        whitening.whitened_components(spark.createDataFrame([(1, [1e15]), (2, [-1e15])], "vec_id long, embedding array<double>"))


def test_whitening_counts_copies_once(spark):
    rows = spark.createDataFrame([(i, [float(i % 5), float(i % 3), float(i % 7)]) for i in range(2000)] + [(5000 + i, [9.0, 9.0, 9.0]) for i in range(1500)], "vec_id long, embedding array<float>")
    check_whitening(whitening.whitened_components(rows).collect(), [(r["vec_id"], r["embedding"]) for r in rows.collect()], 3)


def test_deviation_beyond_a_long(spark):
    big = [(1, [3e12]), (2, [-3e12]), (3, [0.0])]
    got = {r["id"]: int(r["deviation"]) for r in whitening.whiten(whitening.whole_numbers(spark.createDataFrame(big, "vec_id long, embedding array<double>")), whitening.fit(whitening.whole_numbers(spark.createDataFrame(big, "vec_id long, embedding array<double>"))), 1).collect()}
    x = {i: v[0] for (i, _), v in zip(big, numbers_of(v for _, v in big))}
    assert got == {i: (3 * v - sum(x.values())) ** 2 for i, v in x.items()} and max(got.values()) > 2**63


# --- periodic runs


def brute_runs(words, repeats=4, least=6):
    n, found = len(words), {}
    for p in range(1, n // repeats + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, repeats * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((a, b - a, p) for (a, b), p in found.items())


def brute_collapse(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return periodic_words(text or "")


def periodic_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text)


def planted(doc_id, words):
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = planted(doc_id, split(text))
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, brute_collapse(words, runs))]
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha)


def test_periodic_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    small = [r for r in docs if len(r["text"] or "") < 12_000]
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs) and sum(r[1] > 0 for r in got.values()) > len(docs) / 40
    for r in small:
        assert got[r["doc_id"]] == expected(r["doc_id"], r["text"]), r["doc_id"]


def cases():
    rng = random.Random(3)
    texts = ["", None, " \t\n", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a", "x a b a b a b a b a y", "a " * 700, "a b " * 300 + "b a " * 300, "é é é é é é é é", "A a A a A a A a"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 90))) for _ in range(60)]
    texts += [" ".join(rng.choice("abc") for _ in range(300)) for _ in range(10)]
    for _ in range(30):
        block = [rng.choice("abcdefg") for _ in range(rng.randrange(1, 40))]
        texts.append("  ".join([rng.choice("abcdefg") for _ in range(rng.randrange(30))] + block * rng.randrange(3, 7) + block[: rng.randrange(len(block))] + [rng.choice("abcdefg") for _ in range(rng.randrange(30))]))
    return [(i, t) for i, t in enumerate(texts)]


def check_runs(rows):
    for r in rows:
        words = split(r["text"])
        runs = brute_runs(words)
        assert [tuple(x) for x in r["runs"]] == runs and r["n_words"] == len(words), r["text"]
        assert r["collapsed"] == brute_collapse(words, runs)


def test_periodic_runs(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in cases()] + [(None, "b b b b b b", "x"), (1, "b b b b b b", "x")], "doc_id long, text string, runs string").coalesce(1)
    got = periodic.periodic_runs(docs)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"] and got.count() == docs.count()
    check_runs(periodic.periodic_runs(docs.select(F.struct("doc_id", "text").alias("k"), "text").select(F.to_json("k").alias("k"), "text"), id_col="k").select(F.get_json_object("k", "$.text").alias("text"), "n_words", "runs", "collapsed").collect())
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def from_words(words, first):
    return [(t, *r) for t, (a, b) in enumerate(zip(first[:-1], first[1:])) for r in brute_runs(words[a:b].tolist())]


@pytest.mark.parametrize("bases", [None, [0, 0], [1, 0, 12345]])
def test_hashes_only_propose(monkeypatch, bases):
    """With bases that give all stretches of equal length, or of equal sums, one hash, the runs are the same."""
    if bases:
        monkeypatch.setattr(periodic, "BASES", bases)
    monkeypatch.setattr(periodic, "PAIRS", 50)
    rng = np.random.default_rng(5)
    for _ in range(40):
        sizes = rng.integers(0, 80, size=6)
        first = np.concatenate([[0], np.cumsum(sizes)])
        words = rng.integers(0, rng.integers(1, 4), size=first[-1])
        assert list(zip(*[x.tolist() for x in periodic.find_runs(words, first)])) == from_words(words, first)


def test_periodic_long_text(spark):
    rng = random.Random(8)
    head = [str(rng.randrange(1000)) for _ in range(150_000)]
    words = [*head, *(["lorem", "ipsum", "dolor"] * 50_000), *head[:40_000] * 4]
    r = periodic.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert {(150_000, 150_000, 3), (300_000, 160_000, 40_000)} <= {tuple(x) for x in r["runs"]}
    assert r["collapsed"] == brute_collapse(words, [tuple(x) for x in r["runs"]])


# --- packing


def check_packed(rows, want, capacity, end_id=0):
    """rows: pieces with ids; want: (doc_id, ids) of the documents."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    own = {}
    for d, ids in want:
        own.setdefault(d, []).append([*ids, end_id])
    for d, texts in own.items():
        pieces = sorted(by_doc.pop(d), key=lambda r: r["piece"])
        if len(texts) == 1:
            assert [r["piece"] for r in pieces] == list(range(len(pieces)))
            assert [r["start"] for r in pieces] == [sum(p["length"] for p in pieces[:i]) for i in range(len(pieces))]
            assert sum((list(r["ids"]) for r in pieces), []) == texts[0]
            assert all(r["length"] == capacity for r in pieces[1:]) and pieces[0]["length"] <= capacity
        else:
            assert Counter(tuple(r["ids"]) for r in pieces) == Counter(map(tuple, texts))
    assert not by_doc
    filled = {}
    for r in rows:
        assert r["length"] == len(r["ids"])
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


def tokens(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = tokens([r["text"] for r in docs])
    written = packing.pack(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    n = check_packed(written, [(r["doc_id"], x) for r, x in zip(docs, ids)], 2048)
    assert n <= -(-sum(len(x) + 1 for x in ids) // 2048) + 1
    want = {(r["doc_id"], r["piece"]): zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) for r in written}
    got = QUERIES["op13_best_fit_packing"](spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in got} == want and len(got) == len(want)
    assert {(r["doc_id"], r["piece"], r["sequence_id"], r["offset"]) for r in got} == {(r["doc_id"], r["piece"], r["sequence_id"], r["offset"]) for r in written}


def test_packing_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma!"]) for _ in range(rng.randrange(60))), "c") for i in range(300)]
    rows += [(1000, None, "c"), (1001, "", None), (None, "no id", "c"), (5000, "same", "c"), (5000, "same", "c"), (6000, "long " * 3000, "c")] + [(7000 + i, "a hot length", "c") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string").repartition(5)
    ids = tokens([t for _, t, _ in rows])
    got = packing.pack(docs, capacity=64)
    n = check_packed(got.collect(), [(r[0], x) for r, x in zip(rows, ids)], 64)
    assert n <= -(-sum(len(x) + 1 for x in ids) // 64) * 1.01 + 1
    assert packing.pack(docs.limit(0)).count() == 0
    flat = packing.sequences(got).collect()
    assert len(flat) == n and sum(len(r["ids"]) for r in flat) == sum(len(x) + 1 for x in ids)
    assert all(len(r["ids"]) <= 64 for r in flat)


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_all_pieces(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([7, 50, 300]))
    counts = rng.integers(0, [2, 5, 1000][seed % 3], size=capacity + 1)
    counts[0] = 0
    patterns = packing.plan(counts)
    held = np.zeros_like(counts)
    for p in patterns:
        assert p.times > 0 and sum(a * k for a, k in p.lengths.items()) <= capacity
        for a, k in p.lengths.items():
            held[a] += p.times * k
    assert (held == counts).all()
    total = int((counts * np.arange(capacity + 1)).sum())
    least = max(-(-total // capacity), counts[capacity // 2 + 1 :].sum())
    assert sum(p.times for p in patterns) <= least * 1.03 + 1


def test_exact_complements_come_first():
    counts = np.zeros(101, dtype=np.int64)
    counts[[60, 40, 70, 20, 10, 55, 25, 15, 5]] = [3, 2, 1, 2, 1, 1, 1, 1, 1]
    patterns = packing._exact(counts.copy())
    assert [(p.times, p.lengths) for p in patterns] == [(1, {70: 1, 25: 1, 5: 1}), (2, {60: 1, 40: 1}), (1, {60: 1, 20: 2})]
    full = np.zeros(101, dtype=np.int64)
    full[[50, 25]] = [3, 6]
    assert sum(p.times for p in packing.plan(full)) == 3


# --- long words in language identification


@pytest.fixture(scope="module")
def language_tables():
    from pathquant.llm import langid

    tables = langid.pieces(default_path("word_bpe_49k.json"))
    probs = np.random.default_rng(0).random((tables[2] + 1, 2)) ** 6
    probs /= probs.sum(axis=0)
    probs[-1] = 0
    return tables, probs


def slow_forward(word, probs, tables):
    alpha = [np.ones(probs.shape[1])]
    for end in range(1, len(word) + 1):
        ids = [(s, (tables[1] if end == len(word) else tables[0]).get(word[s:end], -1)) for s in range(max(0, end - tables[3]), end)]
        alpha.append(sum(alpha[s] * probs[i] for s, i in ids if i >= 0))
    return np.log(alpha[-1])


@pytest.mark.parametrize("most", [None, 1, 2])
def test_sums_of_long_words(language_tables, monkeypatch, most):
    """Parts, and scanned parts, give the sums and expected counts over all segmentations."""
    from pathquant.llm import langid, segmentations

    tables, probs = language_tables
    for name, value in (("BYTES", 90), ("PARTS", 3), ("BLOCK", 7)) if most else ():
        monkeypatch.setattr(segmentations, name, value)
    rng = random.Random(4)
    words = [b"a" * 40, "日本語のテキスト".encode() * 2, b"ha" * 21, b"internationalisation" * 2, *(bytes(rng.choice(b"abcq7.") for _ in range(rng.randrange(33, 60))) for _ in range(12))]
    window = most or tables[3]
    trie = langid._trie(tables)
    got = segmentations.log_sums(words, probs, trie, window)
    assert np.allclose(got, [slow_forward(w, probs, tables) for w in words], rtol=1e-12)
    lengths = np.zeros(len(probs))
    for table in tables[:2]:
        for raw, i in table.items():
            lengths[i] = len(raw)
    for w in words:
        total = np.zeros_like(probs)

        def add(ids, value):
            np.add.at(total, ids, value)

        segmentations.expected([w], np.array([[2.0, 3.0]]), probs, trie, window, add)
        assert np.allclose(lengths @ total, [2 * len(w), 3 * len(w)])
        # the derivative of the sum by a piece's probability, at a few pieces
        for i in np.flatnonzero(total[:, 0])[:3]:
            more = probs.copy()
            more[i] *= 1 + 1e-6
            rise = (slow_forward(w, more, tables) - slow_forward(w, probs, tables)) / 1e-6
            assert np.allclose(rise * [2, 3], total[i], rtol=1e-3, atol=1e-3)


def test_a_megabyte_without_spaces_takes_seconds(language_tables):
    import base64
    import time

    from pathquant.llm import langid

    tables, probs = language_tables
    langid._trie(tables)
    data = random.Random(1).randbytes(750_000)
    start = time.time()
    logs = langid.forward([base64.b64encode(data).lower(), data + data[:250_000]], probs, tables)
    assert np.isfinite(logs).all() and time.time() - start < 10


def test_fit_by_tasks_is_the_fit_of_all_words(spark, language_tables):
    """Expected counts summed over tasks are those of all words at once; long words take part."""
    from pathquant.llm import langid

    tables, probs = language_tables
    texts = [("the quick brown fox", "en"), ("le renard brun " + "x7" * 40, "fr"), ("the the lazy dog", "en")]
    counts = Counter((w, k) for t, k in texts for w in t.split())
    words = sorted({w for w, _ in counts})
    table = spark.createDataFrame([(w, [float(counts[w, "en"]), float(counts[w, "fr"])]) for w in words], "word string, counts array<double>").repartition(3)
    want = langid._expected([w.encode() for w in words], np.array([[counts[w, "en"], counts[w, "fr"]] for w in words], dtype=float), probs, tables)
    assert np.allclose(langid._expected_of(table, probs, default_path("word_bpe_49k.json")), want)


# --- names of topics in web pages

BODY = "<p>" + "This is a long sentence of the article, with commas, and more words to read. " * 5 + "</p>"


@pytest.mark.parametrize("part, kept", [
    ("<section class='discussion-of-results'><p>We discuss the results, which are, as expected, long enough to be read.</p></section>", True),
    ("<div class='share-price'><p>The price rose by five per cent, after the news, on Monday.</p></div>", True),
    ("<p class='alert'>Please note, this matters to everyone who reads it.</p>", True),
    ("<div class='lunch-menu'><p>Soup, bread and a salad, which is always fresh, every day.</p></div>", True),
    ("<div class='thread'><p>bob: nice article, thanks for it.</p></div>", False),
    ("<div class='comment-thread'><p>bob: nice article, thanks for it.</p></div>", False),
    ("<section class='discussion'><p>bob: nice article, thanks for it.</p></section>", False),
    ("<div class='share-buttons'><p>Send this on, please do.</p></div>", False),
    ("<div class='related-articles'><p>Read this other piece, it is good, we think so.</p></div>", False),
    ("<div class='alert alert-box'><p>We use your data, as all do.</p></div>", False),
    ("<div class='ad-price'><p>Buy this, it is cheap, today.</p></div>", False),
])
def test_names_of_topics_only_weigh(part, kept):
    from pathquant.llm import html_text

    text = html_text.main_text(f"<html><body><nav>home</nav><article><h1>T</h1>{BODY * 3}{part}{BODY}</article><footer>end</footer></body></html>")
    assert text.count("\n") == 4 + kept and "home" not in text and "end" not in text.split("\n")
