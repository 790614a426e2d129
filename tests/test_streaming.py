"""Counts over a stream equal those of the batch job."""

from pyspark.sql import functions as F

from pathquant.config import EngineConfig
from pathquant.operators import matching
from pathquant.streaming import ingest
from tests_support import SCHEMA, index, m, single


def reads(n):
    out = []
    for i in range(n):
        one = list(single([m(1, 2, offset=i % 2), m(2, 1), m(4, 5)], 8, 8))
        one[0] = i
        out.append(tuple(one))
    return out


def test_match_batches(spark, tmp_path):
    steps = index(spark, {1: 4, 2: 1, 4: 8}, [1, 2, 4], [1, 2])
    config = EngineConfig(single_end=True, frag_mean=1.0, frag_sd=1.0, score_not_qual=True, filt_best_score=0.0)
    rows = spark.createDataFrame(reads(20), SCHEMA)
    for part in range(2):
        rows.where(F.col("read_id") % 2 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = ingest.match_batches(stream, steps, config, 1000, str(tmp_path / "out"), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    got = {r["read_class_id"]: r["read_count"] for r in ingest.merged_classes(spark, str(tmp_path / "out")).collect()}
    want = {r["read_class_id"]: r["read_count"] for r in matching.read_classes(matching.alignment_rows(rows, steps, config, 1000)).collect()}
    assert got == want and sum(got.values()) == 20


def test_class_counts(spark, tmp_path):
    lists = spark.createDataFrame([([1, 2], 60, 0), ([1, 2], 60, 0), ([3], 60, 0)], "rows array<int>, min_mapq int, noise_score int")
    lists.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lists.schema).parquet(str(tmp_path / "in"))
    query = ingest.class_counts(stream).writeStream.format("memory").queryName("classes").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["read_count"] for r in spark.table("classes").collect()) == [1, 2]


def test_mates_in_different_batches(spark, tmp_path):
    """Mates meet in whatever order and batches they come; one that is too late does not."""
    steps = index(spark, {1: 4, 2: 1, 3: 1, 4: 8, 5: 2, 6: 7}, [1, 2, 4, 5, 6], [1, 2, 6])
    config = EngineConfig(library="fr", frag_mean=1.0, frag_sd=1.0, score_not_qual=True, filt_best_score=0.0, max_partial_offset=0)

    def rows(ids, mate, minute):
        own = single([m(1, 2, offset=2), m(2, 1), m(4, 5)], 8, 8) if mate == 1 else single([m(-6, 2, 1, 1, offset=1)], 4, 2, 20, 2)
        return [(i, *own[1:], 1_700_000_000 + minute * 60) for i in ids]

    batches = [rows(range(6), 1, 0), rows([7], 2, 1), rows([0, 1, 2, 3, 4], 2, 2) + rows([7], 1, 2), rows([50], 1, 90) + rows([50], 2, 90), rows([51], 1, 91) + rows([51], 2, 91), rows([5], 2, 3)]
    for number, batch in enumerate(batches):
        df = spark.createDataFrame(batch, SCHEMA + ", at long").withColumn("at", F.timestamp_seconds("at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if not number:
            schema = df.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = ingest.match_batches(ingest.whole_pairs(stream, "at"), steps, config, 1000, str(tmp_path / "out"), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    got = ingest.merged_classes(spark, str(tmp_path / "out")).collect()
    every = spark.createDataFrame([r[:-1] for b in batches for r in b if r[0] != 5], SCHEMA)
    want = matching.read_classes(matching.alignment_rows(every, steps, config, 1000)).collect()
    assert sorted((str(r["rows"]), r["read_count"]) for r in got) == sorted((str(r["rows"]), r["read_count"]) for r in want)
    assert sum(r["read_count"] for r in got) == 8
