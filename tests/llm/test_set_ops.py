"""Mixing, sharding, Jaccard join, decontamination, top-k search and the pipeline."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from pathquant.llm import decontamination, hamming, jaccard, mixing, sharding
from pathquant.llm.queries import ORACLE, QUERIES
from pathquant.llm.shingles import shingle_sets

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLE[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want.project(", ".join(columns)).fetchall())


def odd(spark):
    rows = [(1, "a b c", "s", "x"), (2, None, "s", "x"), (3, "", None, None), (None, "d e f g", None, "x"), (4, "a b c", "t", "y"), (1, "a b c", "s", "x"), (5, "w " * 30000, "u", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def test_mix_odd_rows(spark):
    rows = mixing.mix(odd(spark), keep=True).collect()
    assert len(rows) == 7 and {r["row"]["size"] for r in rows} == {"x", "y", None}
    assert all(r["taken"] == r["size"] * r["copies"] <= 3 * r["size"] for r in rows)
    assert sum(r["taken"] for r in rows) <= sum(r["size"] for r in rows)
    assert mixing.mix(odd(spark).limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mix(odd(spark).where("doc_id IN (2, 3)")).collect()} == {0}


def test_mix_targets(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 500), (None, 300)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    weights = {"a": 1, "b": 2, "c": 3, None: 1}
    left, want = 1810.0, {}
    free = dict(weights)
    size = {"a": 1000, "b": 10, "c": 500, None: 300}
    while True:
        level = left / sum(free.values())
        over = [s for s in free if 3 * size[s] <= level * free[s]]
        if not over:
            break
        for s in over:
            want[s] = 3.0 * size[s]
            left -= want[s]
            del free[s]
    want |= {s: level * w for s, w in free.items()}
    assert {s: round(t, 6) for s, t in got.items()} == {s: round(t, 6) for s, t in want.items()}


def test_mix_comes_near_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), f"s{i % 4}") for i in range(4000)], "doc_id long, text string, source string")
    rows = mixing.mix(docs)
    by = docs.select("doc_id", "source").join(rows, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 14 for r in by)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_mix_repeated_rows(spark, monkeypatch):
    """Of rows that are equal, each is queued; the mix comes near its targets however few entries one task may sort."""
    rows = [(7, "same words here", "a")] * 900 + [(i, "one two " * (i % 3 + 1), "b") for i in range(500)] + [(i, "x " * 9, None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    wanted = mixing.mix(docs, keep=True).collect()
    monkeypatch.setattr(mixing, "SORTED", 3)
    monkeypatch.setattr(mixing, "RANGES", 5)
    monkeypatch.setattr(mixing, "SOURCES", 0)
    got = mixing.mix(docs, keep=True).collect()
    assert sorted(map(str, got)) == sorted(map(str, wanted)) and len(got) == len(rows)
    taken, target = Counter(), {}
    for r in got:
        taken[r["row"]["source"]] += r["taken"]
        target[r["row"]["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 18 for s, t in target.items()) and sum(taken.values()) <= sum(len(t.split()) for _, t, _ in rows)


def test_mix_late_entries(spark, tmp_path):
    """A source of one document far beyond its target is not taken, as in the SQL, though the rest leaves room."""
    for n, (large, small) in enumerate([(1000, [28] * 10), (100_000, [1] * 50), (3000, [700, 300, 5, 5, 5])]):
        rows = [(0, "w " * large, "a"), *((i + 1, "v " * x, "b" if i % 2 or n == 0 else "c") for i, x in enumerate(small))]
        spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{n}/documents.parquet/*.parquet'")
        got = QUERIES["op4_weighted_fair_queueing"](spark, f"{tmp_path}/{n}")
        want = con.sql(ORACLE["op4_weighted_fair_queueing"]).project(", ".join(got.columns)).fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert sum(r["taken"] for r in got.collect()) <= large + sum(small)


def check_shards(rows, tolerance):
    sizes, slots = Counter(), {}
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= s < 16 for s in slots)
    mean = sum(sizes.values()) / 16
    assert all(abs(sizes[s] - mean) <= tolerance * mean for s in range(16)), sizes


def test_shards(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdef ", k=rng.randint(1, 300))) for _ in range(4000)]
    docs = spark.createDataFrame([(i, rng.choice(texts[:50]) if i % 10 == 0 else texts[i]) for i in range(4000)], "doc_id long, text string")
    rows = sharding.shard(docs).collect()
    check_shards(rows, 0.1)  # a group of up to a tenth of a shard stays whole
    at = {}
    for r, t in zip(sorted(rows, key=lambda r: r["doc_id"]), [d["text"] for d in sorted(docs.collect(), key=lambda d: d["doc_id"])]):
        assert (r["size"], r["text_crc32"]) == (len(t) + 1, zlib.crc32(t.encode()))
        at.setdefault(t, set()).add(r["shard"])
    assert all(len(s) == 1 for s in at.values())


def test_shards_of_odd_tables_against_sql(spark, tmp_path):
    """A text that half of all rows share, large and repeated rows, nulls: the splitters are the exact ones."""
    rng = random.Random(12)
    for n, rows in enumerate([[(i, "copy" if i % 2 else "x" * rng.randint(0, 90)) for i in range(3000)], [(i, "w" * (20_000 if i == 7 else i % 13)) for i in range(500)], [(1, None), (None, "a"), (2, ""), (3, "b" * 50), (4, "b" * 50)]]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{n}/documents.parquet/*.parquet'")
        got = QUERIES["op5_histogram_sort"](spark, f"{tmp_path}/{n}")
        want = con.sql(ORACLE["op5_histogram_sort"]).project(", ".join(got.columns)).fetchall()
        assert Counter(map(tuple, got.collect())) == Counter(want)


def test_shards_split_a_hot_group(spark):
    docs = spark.createDataFrame([(i, "copy of the same text" if i % 2 else f"text {i} " * 3) for i in range(6000)], "doc_id long, text string")
    check_shards(sharding.shard(docs).collect(), 0.03)


def test_shards_odd_rows(spark):
    rows = sharding.shard(odd(spark)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter([1, 1, 2, 3, None, 4, 5]) and {r["size"] for r in rows if r["doc_id"] in (2, 3)} == {1}
    assert len({(r["shard"], r["slot"]) for r in rows}) == 7
    assert sharding.shard(odd(spark).limit(0)).count() == 0


def brute_components(docs, k, num, den):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k, num, block", [(4, 85, 512), (5, 80, 512), (4, 85, 7)])
def test_jaccard_against_brute_force(spark, monkeypatch, k, num, block):
    """Near copies around thresholds, one group too large for pairs, a passage that many share; small blocks cut every large tile."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(400)]

    def text(n):
        return rng.choices(vocabulary, k=n)

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return words

    common, base = text(40), text(120)
    docs = [text(rng.randint(1, 60)) + common * (rng.random() < 0.4) for _ in range(120)]
    docs += [edited(base, rng.randint(0, 6)) for _ in range(70)]
    docs += [edited(d, rng.randint(0, 2)) for d in docs[:60]]
    docs += [text(3), text(3), [], ["A", "b"], ["a", "B"]]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)] + [(len(docs), None), (len(docs) + 1, "\n ")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=k, num=num)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(rows, k, num, 100)


def test_jaccard_odd_rows(spark):
    rows = [(4, "a b c d e f"), (2, "A B c d e f"), (None, "a b c d e f"), (7, "z"), (7, "z"), (None, None), (8, "y " * 50000)]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, cls string, n int")
    got = Counter(tuple(r) for r in jaccard.jaccard_components(docs).collect())
    assert got == Counter({(4, 3, 2): 1, (2, 3, 2): 1, (None, 3, 2): 1, (7, 1, 7): 2, (None, 0, None): 1, (8, 1, 8): 1})
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def thue_morse(size):
    """Two words of a and b, complements of each other, that polynomial hashes modulo a power of two confuse."""
    one, two = "a", "b"
    while len(one) < size:
        one, two = one + two, two + one
    return one, two


def test_jaccard_does_not_trust_hashes(spark):
    one, two = thue_morse(1024)
    rows = [(1, one), (2, two), (3, one.upper()), (4, f"{one} x y z"), (5, f"{two} x y z"), (6, one[:64]), (7, two[:64])]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}


def test_exact_shingles_with_shared_hashes(monkeypatch):
    """The numbers are right even if all words have one hash."""
    import numpy as np
    import pyarrow as pa

    from pathquant.llm import shingles

    rng = random.Random(8)
    texts = [" ".join(rng.choices(["a", "B", "b", "word" * 30, "word" * 29 + "wore"], k=rng.randint(0, 40))) for _ in range(60)]
    ((data, offsets),) = shingles.text_chunks(pa.array(texts), 1 << 62)
    words = [t.lower().split() for t in texts]
    want = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set()) for w in words]
    for patched in (False, True):
        if patched:
            monkeypatch.setattr(shingles, "segment_hashes", lambda d, s, e: np.zeros(len(s), np.uint64))
        got = [set(x.tolist()) for x in shingles.exact_shingles(data, offsets, 3)]
        assert [len(g) for g in got] == [len(w) for w in want]
        assert all(len(a & b) == len(x & y) for a, x in zip(got, want) for b, y in zip(got, want))


def test_class_numbers_that_sets_share():
    assert jaccard.class_of((5, 9), frozenset()) == 5
    assert {jaccard.class_of((5, more), frozenset({5})) for more in (9, 10)} == {5 ^ 9, 5 ^ 10}


def test_bitmaps_bound_the_overlap():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(1)
    texts = [" ".join(rng.choices("abcdefgh", k=n)) for n in (5, 50, 300, 3000, 3000)]
    sets = list(shingle_sets(pa.array(texts), 4))
    for a in sets:
        for b in sets:
            x, y = jaccard.bitmap(a), jaccard.bitmap(b)
            size = min(len(x), len(y))
            differ = int(np.bitwise_count(jaccard.folded(x, size) ^ jaccard.folded(y, size)).sum())
            assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - differ) // 2


def test_containment_odd_rows(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, "x " * 20000 + item.upper().replace(" ", ", ") + " y" * 9), (2, None), (3, ""), (None, item), (4, "one two three four five six"), (5, "q " + item), (5, "q " + item), (6, "zz alpha beta yy")], "doc_id long, text string")
    items = spark.createDataFrame([(10, item, 1), (11, None, 1), (12, "!!", 1), (13, "Alpha, beta", 1), (14, "beta alpha", 1), (None, item, 1)], "item_id long, text string, h int")
    got = sorted(tuple(r) for r in decontamination.containment(docs, items).collect())
    assert got == [(1, 10, 6, 6), (5, 10, 6, 6), (6, 13, 1, 1)]
    assert decontamination.containment(docs.limit(0), items).count() == 0 and decontamination.containment(docs, items.limit(0)).count() == 0


def test_top_k_against_brute_force(spark):
    rng = random.Random(2)
    codes = [rng.getrandbits(64) - 2**63 for _ in range(300)] + [77] * 150
    rows = [(i, c) for i, c in enumerate(codes)] + [(900, None), (None, 5), (0, codes[0])]
    df = spark.createDataFrame([(i, c, "x") for i, c in rows], "vec_id long, code long, ids string")
    got = {}
    for r in hamming.top_k(df, df.where("vec_id % 50 = 0"), id_col="vec_id", code_col="code", k=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["id"]))
    for q in range(0, 450, 50):
        best = sorted((((codes[q] ^ c) & (2**64 - 1)).bit_count(), i) for i, c in enumerate(codes) if i != q)[:7]
        assert sorted(got.pop(q)) == [(n + 1, *b) for n, b in enumerate(best)]
    assert not got
    assert hamming.top_k(df.limit(0), df.limit(0), id_col="vec_id", code_col="code").count() == 0
    assert hamming.top_k(df.where("vec_id < 3"), df.where("vec_id = 0"), id_col="vec_id", code_col="code").count() == 2


def test_top_k_far_neighbours(spark, monkeypatch):
    """Neighbours too far for the first index's radii are found in the finer one, without a join that has no equal columns."""
    rng = random.Random(6)
    codes = [0, 2**64 - 1, 0x00FF00FF00FF00FF, *(rng.getrandbits(64) for _ in range(40))]
    codes = [c - 2**64 if c >= 2**63 else c for c in codes]
    df = spark.createDataFrame(list(enumerate(codes)), "vec_id long, code long")
    monkeypatch.setattr(hamming, "PROBES", 600)
    out = hamming.top_k(df, df.where("vec_id < 5"), id_col="vec_id", code_col="code", k=30, segments=2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString() and "Join Inner\n" not in plan
    got = {}
    for r in out.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["id"]))
    for q in range(5):
        best = sorted((((codes[q] ^ c) & (2**64 - 1)).bit_count(), i) for i, c in enumerate(codes) if i != q)[:30]
        assert sorted(got[q]) == [(n + 1, *b) for n, b in enumerate(best)]


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    kept = {}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        kept[name] = docs, out.cache()
        docs = kept[name][1]
    before, after = kept["ngram_jaccard_join"]
    want = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80, 100)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    before, after = kept["benchmark_decontamination"]

    def grams(t):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    items = [grams(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r["doc_id"] for r in before.collect() if not any(100 * len(i & grams(r["text"])) >= 80 * len(i) for i in items)]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(clean)
    assert kept["language_id"][1].count() == kept["language_id"][0].count()  # every document of the table has a language
    rows = p.run(spark, SF).collect()
    assert len(rows) == docs.count() and len({(r["shard"], r["slot"]) for r in rows}) == len(rows)


def test_pipeline_decides_by_row(spark):
    """Null and repeated ids are deduplicated and decontaminated like others, and a clean row of a rejected row's id stays."""
    import corpus_pipeline as p

    item = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r["text"].split()) >= 10)
    one, two, three = ("".join(f"{w}{i} " for i in range(12)) for w in ("ab", "cd", "ef"))
    rows = [(None, one), (None, one), (7, one), (9, two), (9, two), (9, three), (None, item + " " + three), (9, item), (None, "lone"), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(map(tuple, p.ngram_jaccard_join(spark, docs, SF).collect()), key=str)
    assert left == sorted([(7, one), (9, two), (9, three), (None, item + " " + three), (9, item), (None, "lone"), (None, None), (None, None)], key=str)
    clean = sorted(map(tuple, p.benchmark_decontamination(spark, docs, SF).collect()), key=str)
    assert clean == sorted((r for r in rows if not r[1] or item not in r[1]), key=str)


CLASHES = "doc_id long, text string, lang string, source string, score double, lang_pred string, evidence double, row_key long, component_id long, size long, copies int, row string, key string, c0 int, cls long, n int, h long, k int, shard int"


def test_pipeline_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, empty texts, columns with the names that stages use; then no rows at all."""
    import corpus_pipeline as p

    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").limit(60)
    extra = spark.createDataFrame([(None, None, None, None), (None, "", None, None), (3000, "the one and only text of it", None, None), (3000, "the one and only text of it", None, None), (None, " \n ", "en", None)], base.schema)
    rows = base.unionByName(extra)
    for field in CLASHES.split(", ")[4:]:
        name, kind = field.split()
        rows = rows.withColumn(name, F.lit(None).cast(kind) if name in ("lang_pred", "row") else F.lit(1).cast(kind))
    assert rows.columns == [f.split()[0] for f in CLASHES.split(", ")]
    for name, docs in (("all", rows), ("none", rows.limit(0))):
        here = f"{tmp_path}/{name}"
        docs.write.parquet(f"{here}/documents.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{here}/benchmark.parquet")
        got = spark.read.parquet(f"{here}/documents.parquet")
        for _, stage in p.STAGES[:-1]:
            out = stage(spark, got, here)
            assert out.columns == rows.columns and out.dtypes == rows.dtypes
            left = [tuple(r) for r in out.collect()]
            assert set(left) <= {tuple(r) for r in got.collect()}
            got = spark.createDataFrame(left, rows.schema)
        shards = p.run(spark, here).collect()
        assert len(shards) == len(left) and bool(shards) == (name == "all")
        assert sum(r["doc_id"] == 3000 for r in shards) in (0, 1, 2, 3) and (name == "none" or shards[0].asDict().keys() == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"})


def test_pipeline_rejects_what_no_language_explains(spark):
    import base64

    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bad = {-1: base64.b64encode(random.Random(0).randbytes(900)).decode(), -2: "Все люди рождаются свободными и равными в своем достоинстве и правах.", -3: "12 -- !!", -4: None, -5: random.Random(1).randbytes(300).hex()}
    both = docs.unionByName(spark.createDataFrame(list(bad.items()), "doc_id long, text string"), allowMissingColumns=True)
    left = [r["doc_id"] for r in p.language_id(spark, both, SF).collect()]
    assert sorted(left) == sorted(r["doc_id"] for r in docs.collect())
    unlabelled = p.language_id(spark, both.withColumn("lang", F.lit(None).cast("string")), SF)
    assert {r["doc_id"] for r in unlabelled.where("doc_id < 0").collect()} == {-1, -2, -5} and unlabelled.count() == len(left) + 3


def test_sign_code_takes_whole_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0] * 3 + [-1.0] * 61), (2, None)], "vec_id long, embedding array<double>")
    assert [r["code"] for r in rows.orderBy("vec_id").select(hamming.sign_code(F.col("embedding")).alias("code")).collect()] == [7, None]
    long = spark.createDataFrame([(1, [1.0] * 65)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="at most 64 numbers"):
        long.select(hamming.sign_code(F.col("embedding")).alias("code")).collect()


def brute_containment(docs, items, k=5, num=80, den=100):
    """Pairs by sets of word tuples: an item's are those of all its rows, each row's as long as it can give."""

    def words(text):
        return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]

    def shingles(ws, n):
        return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}

    own, held = {}, {}
    for i, t in items:
        ws = words(t)
        if i is not None and ws:
            own.setdefault(i, set()).update(shingles(ws, min(k, len(ws))))
    for d, t in docs:
        if d is not None:
            held.setdefault(d, set()).update(*[shingles(words(t), n) for n in range(1, k + 1)])
    return sorted((d, i, len(s), len(s & h)) for d, h in held.items() for i, s in own.items() if den * len(s & h) >= num * len(s))


@pytest.mark.parametrize("most", [decontamination.BROADCAST_BYTES, 0])
def test_containment_of_items_in_several_rows(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", most)
    rng = random.Random(11)
    items = [(7, "a b"), (7, "c d e f g h i"), (8, "x"), (8, "y z"), (8, "p q r s t u"), (9, "one two three four five six seven eight nine ten"), (9, "one two"), (None, "k l"), (10, None), (11, "a"), (11, "a")]
    docs = [(1, "a b c d e f g h i"), (2, "zz a b yy"), (3, "x y z p q r s t u"), (4, "x y z"), (5, "a"), (6, None), (None, "a b c d e f g h i"), (7, "one two three four five six seven eight nine ten"), (7, "a b")]
    pool = [t for _, t in items if t]
    docs += [(100 + n, " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 5)))) for n in range(60)]
    got = decontamination.containment(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = sorted(map(tuple, got.collect()))
    assert rows == brute_containment(docs, items)
    assert (1, 7, 4, 4) in rows and not any(d == 2 and i == 7 for d, i, _, _ in rows)


def test_containment_sql_covers_short_items(spark, tmp_path):
    docs = [(1, "a b c d e f g h i"), (2, "zz a b yy"), (3, "b a"), (4, None), (5, "Hello, World! again and again")]
    items = [(1, "a b"), (2, "c d e f g h i"), (3, "hello world"), (4, "again"), (5, "")]
    for name, rows, schema in (("documents", docs, "doc_id long, text string"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql(ORACLE["op7_minhash_containment"])
    got = QUERIES["op7_minhash_containment"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()) == brute_containment(docs, items)
