"""Token ids as ORC: run-length encoded integers, row indexes and Bloom filters on document ids.

Documents are range-partitioned by id and encoded in that order, so files, stripes and row groups hold
rising id ranges: a reader prunes stripes by their statistics and row groups by index and Bloom filter,
and stripes are read in parallel. ORC stores the integers with its run-length encoding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathquant.llm.common import shared_path
from pathquant.llm.encoding import default_path, encoder


def _encoded(tokenizer: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        enc, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for ids, offsets in enc.encode_column(batch.column(1)):
                n = len(offsets) - 1
                ids = np.insert(ids, offsets[1:], end_id).astype(np.int32)
                offsets = offsets + np.arange(n + 1)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), lists, pa.array(np.diff(offsets)), pa.array(before + offsets[:-1]), pa.array(np.full(n, part, np.int32))], names=["doc_id", "ids", "n_tokens", "file_start", "part"])
                before += int(offsets[-1])
                at += n

    return run


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", stripe_mb: int = 64, compression: str = "zstd") -> None:
    """Encodes every whole text, appends end_id, and writes (doc_id, ids, n_tokens, file_start, part) in id order.

    A null text is an empty one: its document has the end id alone. Null ids come first. Repeated rows stay
    repeated, ordered by text hash. An empty table writes no rows. Other columns are not read. A text is encoded whole,
    however long; a worker holds its bytes, cuts and ids at a time, some 40 bytes for each byte of it.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "text")
    out = rows.mapInArrow(_encoded(tokenizer or default_path(), end_id), "doc_id long, ids array<int>, n_tokens long, file_start long, part int")
    (out.write.option("compression", compression).option("orc.stripe.size", str(stripe_mb << 20)).option("orc.row.index.stride", "2000").option("orc.rows.between.memory.checks", "500").option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path))


SCHEMA = "doc_id long, ids array<int>, n_tokens long, file_start long, part int"


def read_tokens(spark: SparkSession, path: str, doc_ids=None) -> DataFrame:
    """The written rows with ``start``, the ids of all documents before. With doc_ids, other row groups are pruned."""
    rows = spark.read.schema(SCHEMA).orc(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per file written
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(list(doc_ids)))
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("file_start")).alias("start"), "n_tokens", "ids")


def _crc(batches):
    for batch in batches:
        lists = batch.column(3)
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        offsets = lists.offsets.to_numpy()
        crcs = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op1_orc_token_ids(spark, sf_dir):
    path = shared_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_tokens(spark, path).mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
