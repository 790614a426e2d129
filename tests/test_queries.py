"""Every query of the core against its SQL, or at least runs."""

import math
import os
from collections import Counter

import duckdb
import pytest

from pathquant.plans.operator_queries import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF)
    rows = Counter(tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect())
    assert sum(rows.values())
    if name in ORACLE:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(ORACLE[name])
        assert sorted(want.columns) == sorted(got.columns)
        columns = ", ".join(f'"{c}"' for c in sorted(want.columns))
        expected = Counter(tuple(plain(v) for v in r) for r in want.project(columns).fetchall())
        assert rows == expected, (list((rows - expected).items())[:4], list((expected - rows).items())[:4])


def test_gibbs_haplotypes_reads_every_class(spark):
    """The sampler's frequencies are the posteriors over all read classes, not over pooled ones."""
    exact = {(r["cluster_id"], f"{r['first']},{r['second']}"): r["posterior"] for r in QUERIES["bounded_posterior"](spark, SF).collect()}
    drawn = {(r["cluster_id"], r["paths"]): r["posterior"] for r in QUERIES["gibbs_haplotypes"](spark, SF).collect()}
    assert {k for k, v in drawn.items() if v > 0.1} == {k for k, v in exact.items() if v > 0.1}
    assert all(abs(drawn.get(k, 0.0) - exact.get(k, 0.0)) < 0.08 for k in drawn | exact)


def test_queries_without_sql_keep_their_sums(spark):
    """What the queries without SQL must give: all reads, a million TPM, posteriors of 1, and a fit that no near one beats."""
    import numpy as np
    from pyspark.sql import functions as F

    from pathquant.functions import fragments, mathfn
    from pathquant.plans.queries import align_rows, fragment_rows, genes

    out = QUERIES["haplotype_transcripts"](spark, SF).agg(F.sum("ReadCount"), F.sum("TPM")).first()
    pairs = genes(spark, SF)[0].select("read_id").distinct().count()
    assert out[0] == pytest.approx(pairs) and out[1] == pytest.approx(1e6)

    reads = align_rows(spark, SF).select("cluster_id", "read_class_id", "read_count").distinct()
    total = {r["cluster_id"]: r["n"] for r in reads.groupBy("cluster_id").agg(F.sum("read_count").alias("n")).collect()}
    sums = {r["cluster_id"]: r["n"] for r in QUERIES["nested_independent"](spark, SF).groupBy("cluster_id").agg(F.sum("read_count").alias("n")).collect()}
    assert sums.keys() == total.keys() and all(0.5 * total[c] < sums[c] <= total[c] + 1e-6 for c in total)

    drawn = QUERIES["gibbs_counts"](spark, SF).agg(*[F.sum(f"ReadCountSample_{i}") for i in (1, 2, 3)]).first()
    assert all(x == pytest.approx(sum(total.values())) for x in drawn)
    shares = QUERIES["gibbs_haplotypes"](spark, SF).groupBy("cluster_id").agg(F.sum("posterior").alias("p")).collect()
    assert all(r["p"] == pytest.approx(1, abs=1e-3) for r in shares)

    fit = QUERIES["skew_normal_fit"](spark, SF).first()
    hist = fragments.histogram(fragment_rows(spark, SF), 100_000).collect()
    x, n = (np.array([r[c] for r in hist], dtype=float) for c in ("frag_length", "n"))

    def likelihood(*p):
        return float((n * mathfn.log_skew_normal_pdf(x, *p)).sum())

    best = likelihood(*fit)
    for i in range(3):
        for step in (-0.01, 0.01):
            p = list(fit)
            p[i] += step * max(1.0, abs(p[i]))
            assert likelihood(*p) <= best + 1e-4 * abs(best)  # the data begin at 0: the likelihood rises without end, ever less, with the shape


def test_moments_of_millions_of_reads(spark):
    """The cube of a cluster's reads is no long."""
    from pathquant.plans.operator_queries import _moments

    rows = spark.createDataFrame([(0, 1, 4_000_000), (0, 2, 3_200_000)], "cluster_id long, path_id long, read_count long")
    found = {r["path_id"]: (r["mean"], r["error"]) for r in _moments(rows, 200).collect()}
    assert found[1][0] == pytest.approx(4_000_000, abs=1) and found[2][1] == pytest.approx(7_200_000 * (4 / 7.2 * 3.2 / 7.2 / 7_200_000 / 200) ** 0.5, rel=1e-3)


def test_halves_of_posteriors_go_up(spark):
    """A posterior halfway between two of nine decimals is rounded up, though its last bits say less."""
    from pathquant.plans.operator_queries import _groups

    half = 7.8125e-6
    rows = [(0, "group", [i], x) for i, x in enumerate((half, math.nextafter(half, 0), math.nextafter(half, 1), half - 1e-12))]
    found = _groups(spark.createDataFrame(rows, "cluster_id long, kind string, path_ids array<long>, posterior double"), 1)
    assert [r["posterior"] for r in found.orderBy("p1").collect()] == [7.813e-6, 7.813e-6, 7.813e-6, 7.812e-6]


def test_pairs_where_nothing_is_broadcast(spark):
    """Tables too large to be broadcast: a union of equally hashed ones was taken for one that is hashed so too."""
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        found = QUERIES["circular_pairs"](spark, SF).count()
    finally:
        spark.conf.set(conf, before)
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert found == con.sql(f"SELECT count(*) FROM ({ORACLE['circular_pairs']})").fetchall()[0][0] > 0
