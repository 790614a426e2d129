"""Token output, token counts, HTML extraction, language ID and WARC."""

import base64
import hashlib
import html
import random
import re
import time
import zlib

import numpy as np
import pytest

from pathquant.llm import encoding, html_text, langid, token_counts, token_output, warc
from pathquant.llm.common import shared_path
from pathquant.llm.queries import QUERIES

TEXTS = ["hello world", "a  b", "a\n b", "x \n\n y", " lead", "trail \n", "don't we'll 'stop", "<|endoftext|> hi", "été çà", "\n", None, "", "\n\nab\n\ncd\n", "日本 語　x", "“quoted” — dash", "½ ²³ x²", "a\r\nb \r\n c", "word " * 3000, "x" * 20000]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(encoding.default_path())


def odd_docs(spark):
    """Nulls, repeats, ties and a column whose name clashes with inner ones."""
    rows = [(i, t, "en", "ids") for i, t in enumerate(TEXTS)] + [(None, "no id", None, "x"), (3, TEXTS[3], "en", "ids"), (3, "another", "en", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids string")


def test_encoder_equals_the_tokenizer(tokenizer):
    import random

    import pyarrow as pa

    rng = random.Random(5)
    parts = [" ", " ", "\n", "a", "B", "é", "1", ".", "'s", "\t", " ", "ß", "--", "the"]
    texts = TEXTS + ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(500)]
    got = [ids[a:b].tolist() for ids, off in encoding.Encoder(encoding.default_path()).encode_column(pa.array(texts)) for a, b in zip(off[:-1], off[1:])]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def thue_morse(size):
    """Two words of a and b, complements of each other, that polynomial hashes modulo a power of two confuse."""
    one, two = "a", "b"
    while len(one) < size:
        one, two = one + two, two + one
    return one, two


@pytest.mark.parametrize("patched", [False, True])
def test_pieces_are_compared_not_only_hashed(tokenizer, monkeypatch, patched):
    """The ids, section counts and scores of a text do not depend on what was met before, even if all pieces have one hash."""
    import pyarrow as pa

    from pathquant.llm import shingles

    if patched:
        monkeypatch.setattr(shingles, "segment_hashes", lambda d, s, e: np.zeros(len(s), np.uint64))
    texts = [*thue_morse(1024), "the cat", "the dog", "a b", "x" * 70 + "y", "x" * 70 + "z", None]
    enc = encoding.Encoder(encoding.default_path())
    for column in (texts[:1], texts[1:], texts):
        got = [ids[a:b].tolist() for ids, off in enc.encode_column(pa.array(column)) for a, b in zip(off[:-1], off[1:])]
        assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in column]
    tables = langid.pieces(encoding.default_path("word_bpe_49k.json"))
    probs = np.random.default_rng(2).random((tables[2] + 1, 2)) * 1e-3
    probs[-1] = 0
    scorer = langid.Scorer(probs, tables)
    for column in (texts[:1], texts[1:]):
        want = [langid.forward([w.encode() for w in t.split()], probs, tables).sum(axis=0) if t else np.zeros(2) for t in column]
        assert np.allclose(scorer.score(pa.array(column)), want)


def test_token_output_round_trip(spark, tokenizer):
    docs, path = odd_docs(spark), shared_path(spark, "t")
    token_output.write_tokens(docs, path)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], list(r["ids"])) for r in token_output.read_tokens(spark, path).collect()), key=lambda r: r[1])
    want = sorted((d["doc_id"], tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [2]) for d in docs.where("doc_id IS NOT NULL").collect())
    assert got[0][0] is None and sorted((r[0], r[3]) for r in got[1:]) == want
    assert [r[0] for r in got[1:]] == sorted(r[0] for r in got[1:])
    ends = np.cumsum([r[2] for r in got])
    assert [r[1] for r in got] == [0, *ends[:-1]]
    one = token_output.read_tokens(spark, path, doc_ids=[4]).collect()
    assert [(r["doc_id"], r["start"]) for r in one] == [(4, next(r[1] for r in got if r[0] == 4))]


def test_token_output_empty(spark):
    path = shared_path(spark, "t")
    token_output.write_tokens(odd_docs(spark).limit(0), path)
    assert token_output.read_tokens(spark, path).count() == 0


def test_op1_against_the_tokenizer(spark, sf_dir, tokenizer):
    got = {r["doc_id"]: r for r in QUERIES["op1_orc_token_ids"](spark, sf_dir).collect()}
    start = 0
    for d in sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda d: d["doc_id"]):
        ids = np.array(tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [2], dtype="<u4")
        r = got.pop(d["doc_id"])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


def test_token_counts(spark, tokenizer):
    rows = token_counts.attribute(odd_docs(spark)).collect()
    texts = {i: t or "" for i, t in enumerate(TEXTS) if i != 3}
    for i, text in texts.items():
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["section"])
        enc = tokenizer.encode(text, add_special_tokens=False)
        assert sum(r["n_tokens"] for r in own) == len(enc.ids) == own[0]["doc_tokens"]
        assert "".join(text[r["start_char"] : r["end_char"]] for r in own) == text
        for r in own:
            sizes = [max(0, min(b, r["end_char"]) - max(a, r["start_char"])) for a, b in enc.offsets]
            mine = 0
            for (a, b), s in zip(enc.offsets, sizes):
                others = [max(0, min(b, o["end_char"]) - max(a, o["start_char"])) for o in own]
                mine += s > 0 and others.index(max(others)) == r["section"]
            assert mine == r["n_tokens"]
    assert token_counts.attribute(odd_docs(spark).limit(0)).count() == 0


def test_crossing_tokens_by_rule():
    starts, ends, bounds = np.array([0, 2, 5]), np.array([2, 5, 6]), np.array([0, 3, 6])
    assert [x.tolist() for x in token_counts.allocate(starts, ends, bounds, "start")] == [[2, 1], [1, 0]]
    assert [x.tolist() for x in token_counts.allocate(starts, ends, bounds, "majority")] == [[1, 2], [0, 1]]
    with pytest.raises(ValueError):
        token_counts.allocate(starts, ends, bounds, "other")


def test_given_sections(spark):
    docs = spark.createDataFrame([(1, "one two three", [0, 4, 8, 99, None]), (2, None, [0]), (3, "x", None)], "doc_id long, text string, cuts array<int>")
    got = {(r["doc_id"], r["section"]): (r["start_char"], r["end_char"]) for r in token_counts.attribute(docs, sections_col="cuts").collect()}
    assert got == {(1, 0): (0, 4), (1, 1): (4, 8), (1, 2): (8, 13), (2, 0): (0, 0), (3, 0): (0, 1)}


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-banner">We use cookies, please agree.</div>
<aside>Side text that is quite long, really, with commas.</aside><article><h1>The &eacute;nd  of
it</h1><p>First paragraph, which is long enough; it has <b>bold</b> words.<p>Second one, unclosed, and <a href="q">linked</a>.</p>
<p>Short.</p><form><input value="v">Subscribe</form><ul><li>Item one</li><li>Item two</ul><script>bad()</script><!-- no --></article>
<div id="comments"><p>Great article, I read it all, twice, and more!</p></div><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "The énd of it\nFirst paragraph, which is long enough; it has bold words.\nSecond one, unclosed, and linked.\nShort.\nItem one\nItem two"


def test_main_text_without_article():
    page = "<html><body><div class='menu'><a href=1>Home</a></div><div><div><h2>Title</h2><p>" + "Some long text, with marks. " * 8 + "</p><p>Tiny</p></div></div><div><a href=2>next</a></div></body></html>"
    text = html_text.main_text(page)
    assert text.startswith("Title\nSome long text") and text.endswith("\nTiny") and "Home" not in text


def test_main_text_among_articles():
    long = "<p>" + "A sentence of the article, with words. " * 6 + "</p>"
    page = f"<html><body><main><article><h1>Head</h1>{long}<p>End.</p></article><article class='teaser'><p>Read this next, please, do.</p></article><article><p>Other.</p></article><section><article class='comment'>{long * 3}</article></section></main></body></html>"
    text = html_text.main_text(page)
    assert text.startswith("Head\nA sentence") and text.endswith("\nEnd.")


LONG = "A sentence of the article, with words. " * 6
P = f"<p>{LONG}</p>"
PAGES = {
    "class names that mislead": (f"<html><body><nav><a href=1>Home</a></nav><div class='content-with-sidebar'><h1 class='post-header'>T</h1>{P * 3}</div></body></html>", ["T", LONG, LONG, LONG]),
    "a note in an article": (f"<body><article><h1>Title</h1>{P}<div class='side-note'>Kept.</div>{P}</article></body>", ["Title", LONG, "Kept.", LONG]),
    "an article called a notice": (f"<body><div class=menu><a href=1>a</a></div><div class=notice>{P * 2}</div></body>", [LONG, LONG]),
    "a last line of links": (f"<body><div><h2>Head</h2>{P * 3}</div><div>Read more, about us, legal, and more of that.</div></body>", ["Head", LONG, LONG, LONG]),
    "a last line in the same element": (f"<body><div><h2>Head</h2>{P * 3}<div>Read more, about us, legal</div></div></body>", ["Head", LONG, LONG, LONG]),
    "a headline before the text": (f"<body><header><h1>Site</h1></header><div class='post'><h1><a href=x>Title</a></h1><div class='meta'>By me</div><div class='body'>{P * 3}</div></div><section id=comments>{P * 2}</section></body>", ["Title", LONG, LONG, LONG]),
    "a page in a form": (f"<body><form><div class=menu><a href=1>x</a></div><div id=x>{P * 2}</div></form></body>", [LONG, LONG]),
    "two articles and a sidebar": (f"<body><main><article>{P * 4}</article><article>{P}</article></main><aside>{P}</aside></body>", [LONG] * 5),
    "lines in a div": ("<body><div class='nav'>a b c</div><div>" + f"{LONG}<br>" * 3 + "</div><div>imprint</div></body>", [LONG] * 3),
    "comments in an article": (f"<body><article><h1>A</h1>{P * 3}<div class='comments'><div class='comment'>{P * 4}</div></div><div class='post-comments'>{P * 3}</div></article><footer>{P}</footer></body>", ["A", LONG, LONG, LONG]),
    "names of parts of the page": (f"<body><div class='page-header'><h1>Site</h1>{P}</div><div class='side-bar'>{P}</div><div class='post-header'><h2>T</h2></div><div class='post'>{P * 3}</div><div class='post-footer'>{P}</div></body>", [LONG, LONG, LONG]),
    "a headline of the site": (f"<body><div id=top><h1>Site</h1></div><div><h2>Title</h2>{P * 3}</div></body>", ["Title", LONG, LONG, LONG]),
    "a table": (f"<body><table><tr><td><a href=1>m</a><td>{P * 2}</table></body>", [LONG, LONG]),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text_by_scores(name):
    page, want = PAGES[name]
    assert html_text.main_text(page).split("\n") == [w.strip() for w in want]


def test_scores_choose_the_blocks(spark, sf_dir, monkeypatch):
    """Pages without an article element, among many short lines without names or links: the text is as in the article, by the scores."""
    lines = "".join(f"<div>line {i} of the table of times and dates</div>" for i in range(60))
    pages = [p["html"] for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    pages = [p for p in pages if len(html_text.main_text(p)) > 500]  # an article of two lines is no more than the lines are
    assert len(pages) > 10
    noisy = [re.sub("</article>", f"</div><section>{lines}</section>", re.sub("<article>", f"<section>{lines}</section><div>", p)) for p in pages]
    want = [html_text.main_text(p) for p in pages]
    assert [html_text.main_text(p) for p in noisy] == want
    monkeypatch.setattr(html_text, "path_scores", lambda page: dict.fromkeys(page.path, 1.0))
    assert all(html_text.main_text(p) != w for p, w in zip(noisy, want))


@pytest.mark.parametrize("part", ["<![CDATA[", "<div>x", "<a", '<a x=">">', "<li><ul><div>", "<!--", "<p><a>x", "<span hidden>a", "</", "&", "<a x='", "<td><li><dd>"])
def test_long_broken_pages(part):
    """Time grows with the page: a megabyte of any of these is a matter of seconds."""
    start = time.monotonic()
    html_text.main_text("<body>" + part * (1_000_000 // len(part)) + ">")
    assert time.monotonic() - start < 20


@pytest.mark.parametrize("page", ["", "<", "<p", "<!--", "<script>", "plain text", "</div></p>", "<div " + "a" * 5000, "<p>" * 3000, "&#xD800; &bogus;", "<a href='x>y</a>"])
def test_broken_pages(page):
    assert isinstance(html_text.main_text(page), str)


def test_extract(spark, sf_dir):
    pages = spark.createDataFrame([(1, "u", PAGE, "n"), (2, None, None, "n"), (None, "u", "", None), (1, "u", PAGE, "n")], "page_id long, url string, html string, text string")
    rows = html_text.extract(pages).collect()
    assert sorted((r["page_id"] or 0, len(r["text"])) for r in rows) == sorted([(0, 0), (1, rows[0]["n_chars"]), (1, rows[0]["n_chars"]), (2, 0)])
    assert html_text.extract(pages.limit(0)).count() == 0
    got = {r["page_id"]: r["text"] for r in QUERIES["op2_tag_path_ratios"](spark, sf_dir).collect()}
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", p["html"])[1]
        parts = re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", inner))
        assert got[p["page_id"]] == "\n".join(y for y in (" ".join(html.unescape(x).split()) for x in parts) if y)


def test_forward_sums_all_segmentations():
    tables = langid.pieces(encoding.default_path("word_bpe_49k.json"))
    probs = np.random.default_rng(0).random((tables[2] + 1, 2)) * 1e-3
    probs[-1] = 0

    def brute(word, at=0):
        if at == len(word):
            return np.ones(2)
        total = np.zeros(2)
        for end in range(at + 1, len(word) + 1):
            i = (tables[1] if end == len(word) else tables[0]).get(word[at:end])
            if i is not None:
                total = total + probs[i] * brute(word, end)
        return total

    words = [b"the", b"x", b"another", "thé".encode(), b"segment"]
    assert np.allclose(langid.forward(words, probs, tables), [np.log(brute(w)) for w in words])
    assert np.isfinite(langid.forward([b"ab" * 3000], probs, tables)).all()


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = QUERIES["op9_segmentation_marginalised_unigrams"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_id_odd_rows(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", "a"), (2, "le chat et la vache", "fr", "b"), (3, None, "en", None), (4, "12 -- !!", None, None), (None, "the dog", None, None), (5, "", "fr", None), (6, "w" * 30000, None, None)], "doc_id long, text string, lang string, score string")
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, None, 5)] == ["en", "fr", "und", "und", "en", "und"]
    assert got[4]["score"] == 0 and model[0] == ["en", "fr"]
    assert langid.predict(docs.limit(0), model).count() == 0
    none = langid.fit(docs.where("lang IS NULL"))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}


def test_fit_reads_long_words_and_pieces():
    tables = langid.pieces(encoding.default_path("word_bpe_49k.json"))
    assert max(map(len, (*tables[0], *tables[1]))) == tables[3] == 32
    probs = np.random.default_rng(1).random((tables[2] + 1, 2)) * 1e-3
    probs[-1] = 0
    words = [b"segmentation" * 4, "\u4eca\u65e5\u306f".encode() * 9, b"ab" * 600, b"a", b"the"]
    lengths = np.zeros(tables[2] + 1)
    for table in tables[:2]:
        for raw, i in table.items():
            lengths[i] = len(raw)
    for w in words:  # whatever the segmentation, its pieces have the bytes of the word
        assert np.allclose(lengths @ langid._expected([w], np.array([[2.0, 3.0]]), probs, tables), [2 * len(w), 3 * len(w)])


def test_languages_without_spaces(spark):
    rng = random.Random(4)

    def clause(base):
        return "".join(chr(base + rng.randrange(60)) for _ in range(rng.randint(14, 40)))

    rows = [(i, " ".join(clause(0x4E00 if i % 2 else 0x0E01) for _ in range(5)), "ab"[i % 2]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id < 40"))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs.where("doc_id >= 40"), model).collect()}
    assert got == {i: lang for i, _, lang in rows if i >= 40}


def test_warc_round_trip(spark, sf_dir):
    pages = spark.createDataFrame([(5, "http://a/ b", "<p>x</p>"), (2, None, "<p>x</p>"), (9, "u\r\nX: y", None), (7, "u", ""), (None, "u", "<p>x</p>"), (3, "u", "é\r\n\r\nWARC/1.1\r\n" * 5000)], "page_id long, url string, html string")
    folder = shared_path(spark, "w")
    made = warc.write_monolithic(pages.repartition(2), f"{folder}/a")
    done = warc.normalise(made, f"{folder}/b")
    assert made.groupBy().sum("records").first()[0] == done.groupBy().sum("records").first()[0] == 6
    got = {r["page_id"]: r for r in warc.read_records(spark, f"{folder}/b").collect()}
    kinds = {i: (r["record_type"], r["refers_to"]) for i, r in got.items()}
    assert kinds == {5: ("revisit", 2), 2: ("response", None), 9: ("revisit", 7), 7: ("response", None), None: ("revisit", 2), 3: ("response", None)}
    for p in pages.collect():
        data = (p["html"] or "").encode()
        assert (got[p["page_id"]]["payload_bytes"], got[p["page_id"]]["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())


def test_warc_members_stand_alone(spark):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>") for i in range(20)], "page_id long, url string, html string").coalesce(1)
    folder = shared_path(spark, "w")
    done = warc.normalise(warc.write_monolithic(pages, f"{folder}/a"), f"{folder}/b").collect()
    fs, path = warc.filesystem(done[0]["archive"])
    data = fs.open_input_stream(path, compression=None).read()
    members = 0
    while data:
        engine = zlib.decompressobj(31)
        assert engine.decompress(data).startswith(b"WARC/1.1")
        data, members = engine.unused_data, members + 1
    assert members == 20


def test_warc_cut_short():
    whole = warc.record(1, "u", b"payload", "D", None)
    assert [len(r) for r in warc.records([whole[:30], whole[30:] + whole])] == [len(whole)] * 2
    with pytest.raises(ValueError):
        list(warc.records([whole, whole[:-9]]))


def test_op10(spark, sf_dir):
    first, want = {}, {}
    pages = sorted(spark.read.parquet(f"{sf_dir}/pages.parquet").collect(), key=lambda p: p["page_id"])
    for p in pages:
        first.setdefault(p["html"] or "", p["page_id"])
        f = first[p["html"] or ""]
        want[p["page_id"]] = (len((p["html"] or "").encode()), "response" if f == p["page_id"] else "revisit", None if f == p["page_id"] else f)
    rows = QUERIES["op10_gzip_normaliser"](spark, sf_dir).collect()
    assert {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows} == want
    assert QUERIES["op10_gzip_normaliser"] and len(rows) == len(pages)


def test_warc_odd_tables(spark):
    """No rows, repeated rows, a payload that half of all pages share, columns with inner names; an archive is a task."""
    kind = "page_id long, url string, html string, digest string, salt int, archive string"
    rows = [(i, f"u{i}", "same" if i % 2 else f"own {i}", "d", 1, None) for i in range(200)] + [(1, "u1", "same", None, None, "a")]
    pages = spark.createDataFrame(rows, kind)
    folder = shared_path(spark, "w")
    made = warc.write_monolithic(pages, f"{folder}/a")
    done = warc.normalise(made, f"{folder}/b")
    assert sum(r["records"] for r in done.collect()) == 201 and done.count() == made.count()
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_records(spark, f"{folder}/b").collect())
    want = [(i, "response" if i % 2 == 0 or i == 1 else "revisit", None if i % 2 == 0 or i == 1 else 1) for i in range(200)] + [(1, "response", None)]
    assert got == sorted(want, key=lambda r: r[:2])
    none = warc.write_monolithic(pages.limit(0), f"{folder}/c")
    assert none.count() == 0 and warc.normalise(none, f"{folder}/d").count() == 0


def test_op3_against_the_tokenizer(spark, sf_dir, tokenizer):
    """Every section of every document, by the tokenizer's own offsets: most characters, the first of equals."""
    got = {}
    for r in QUERIES["op3_offset_attribution"](spark, sf_dir).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        text = d["text"] or ""
        own = sorted(got.pop(d["doc_id"]), key=lambda r: r["section"])
        assert "".join(text[r["start_char"] : r["end_char"]] for r in own) == text
        lines, want, crossing = text.splitlines(keepends=True) if "\r" not in text else None, [0] * len(own), [0] * len(own)
        assert lines is None or len(own) <= max(1, len(lines))
        at = 0
        for a, b in tokenizer.encode(text, add_special_tokens=False).offsets:
            while at + 1 < len(own) and own[at]["end_char"] <= a:
                at += 1
            inside = []
            for s in range(at, len(own)):
                if own[s]["start_char"] >= b:
                    break
                inside.append((min(b, own[s]["end_char"]) - max(a, own[s]["start_char"]), -s))
            best = -max(inside)[1]
            want[best] += 1
            crossing[best] += len(inside) > 1
        assert [(r["n_tokens"], r["n_crossing"]) for r in own] == list(zip(want, crossing))
    assert not got


def test_op9_against_plain_sums(spark, sf_dir):
    """Predictions and scores of the query are those of a word-by-word sum over all segmentations with the same model."""
    import math

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, probs = langid.fit(docs.where(~langid.held_out()))
    inner, final, _, window = langid.pieces(encoding.default_path("word_bpe_49k.json"))
    known = {}

    def log_prob(word: bytes):
        if word not in known:
            alpha, scale = [np.ones(len(langs))], np.zeros(len(langs))
            for end in range(1, len(word) + 1):
                total = np.zeros(len(langs))
                for start in range(max(0, end - window), end):
                    i = (final if end == len(word) else inner).get(word[start:end])
                    if i is not None:
                        total = total + alpha[start] * probs[i]
                alpha.append(total)
                if end % 20 == 0:
                    alpha, scale = [a / total for a in alpha], scale + np.log(total)
            known[word] = np.log(alpha[-1]) + scale
        return known[word]

    got = {r["doc_id"]: r for r in QUERIES["op9_segmentation_marginalised_unigrams"](spark, sf_dir).collect()}
    checked = 0
    for d in docs.collect():
        r, text = got.pop(d["doc_id"]), d["text"] or ""
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        logs = sum((log_prob(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text.lower())), np.zeros(len(langs)))
        assert r["lang_pred"] == langs[int(logs.argmax())]
        assert math.isclose(r["score"], 1 / np.exp(logs - logs.max()).sum(), abs_tol=1e-6)
        checked += 1
    assert checked > 100 and not got


def test_orc_stripes_indexes_and_encoding(spark, tmp_path):
    """Files have several stripes with a row index and a Bloom filter on doc_id; ids are run-length encoded."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 20), i -> sha2(cast(id * 100 + i AS string), 256))) AS text").coalesce(1)
    path = f"{tmp_path}/tokens"
    token_output.write_tokens(docs, path, stripe_mb=1, compression="none")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = [f for f in jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).listStatus(jvm.org.apache.hadoop.fs.Path(path)) if f.getPath().getName().endswith(".orc")]
    stripes, blooms, rows, size = 0, 0, 0, 0
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(f.getPath(), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        stripes += reader.getStripes().size()
        rows += reader.getNumberOfRows()
        size += f.getLen()
        assert reader.getRowIndexStride() == 2000
        for stripe in reader.getStripes():
            with open(f.getPath().toUri().getPath(), "rb") as raw:
                raw.seek(stripe.getOffset() + stripe.getIndexLength() + stripe.getDataLength())
                footer = jvm.org.apache.orc.OrcProto.StripeFooter.parseFrom(raw.read(stripe.getFooterLength()))
            kinds = {(s.getColumn(), s.getKind().name()) for s in footer.getStreamsList()}
            encodings = [e.getKind().name() for e in footer.getColumnsList()]
            assert (1, "ROW_INDEX") in kinds and "DIRECT_V2" == encodings[1] == encodings[3]
            blooms += any(c == 1 and k.startswith("BLOOM_FILTER") for c, k in kinds)
    assert rows == 4000 and stripes > len(files) and blooms == stripes
    assert size < 4 * spark.read.orc(path).selectExpr("sum(n_tokens)").first()[0]
    found = token_output.read_tokens(spark, path, doc_ids=[17, 3999])
    assert sorted(r["doc_id"] for r in found.collect()) == [17, 3999]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().executedPlan().toString()


def test_odd_tables_of_text_operators(spark):
    """Repeated rows, clashing columns, no rows."""
    kind = "doc_id long, text string, lang string, source string, score double, start long, n_tokens long, section int, ids string"
    rows = [(1, "the cat and the dog", "en", None, 1.0, 1, 1, 1, "x")] * 2 + [(2, "le chat et la vache", "fr", None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, kind)
    model = langid.fit(docs)
    assert sorted(r["lang_pred"] for r in langid.predict(docs, model).collect()) == ["en", "en", "fr"]
    assert langid.predict(docs.limit(0), model).count() == 0 and langid.fit(docs.limit(0))[0] == []
    counted = token_counts.attribute(docs).collect()
    assert [sum(r["doc_id"] == i for r in counted) for i in (1, 2)] == [2, 1]
