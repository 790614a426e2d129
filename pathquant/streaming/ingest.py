"""Read classes over a stream: counts of equal alignment lists, kept up to date as reads arrive.

Matching needs no state once mates have met, so a stream of alignments can be matched batch by batch; only waiting mates
and the counts of classes carry over. Inference needs the whole input and stays a batch job over the counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathquant.config import EngineConfig
from pathquant.operators import matching
from pathquant.plans.store import stored, stored_run


def class_counts(lists: DataFrame) -> DataFrame:
    """(rows, min_mapq, noise_score, read_count) of a stream of reads, one row per read with its list of alignment rows.

    The state is a count per distinct list. A read that is sent twice counts twice; give the stream a
    watermark and drop duplicates before where that can happen.
    """
    return lists.groupBy("rows", "min_mapq", "noise_score").agg(F.count("*").alias("read_count"))


def whole_pairs(alignments: DataFrame, time_col: str, delay: str = "10 minutes") -> DataFrame:
    """A stream of reads as it came, less ``time_col``, in which the mates of a pair come together.

    Mates may arrive in different batches: each waits in the state of a stream-stream join until the other is there, or until the
    stream's time has gone on by ``delay``. A mate that comes later than that, or never, is in no pair. So the state
    holds what ``delay`` of the stream brings.
    """
    kept = [c for c in alignments.columns if c != time_col]

    def mates(number: int, name: str) -> DataFrame:
        own = alignments.where(F.col("mate") == number)
        return own.select(F.col("read_id").alias(f"{name}_id"), F.col(time_col).alias(f"{name}_time"), F.struct(*kept).alias(name)).withWatermark(f"{name}_time", delay)

    near = f"one_id = two_id AND two_time BETWEEN one_time - INTERVAL {delay} AND one_time + INTERVAL {delay}"
    return mates(1, "one").join(mates(2, "two"), F.expr(near)).select(F.explode(F.array("one", "two")).alias("read")).select("read.*")


def match_batches(alignments: DataFrame, steps: DataFrame, config: EngineConfig, max_fragment: int, path: str, checkpoint: str):
    """Starts a query that matches every micro-batch and appends its read classes to a Parquet table.

    Both mates of a pair must come in one batch, as ``whole_pairs`` brings them. A batch that is run again overwrites its
    own part.
    """

    def one(batch: DataFrame, number: int) -> None:
        with stored_run(batch.sparkSession):
            whole = stored(batch, "batch")  # read once: a plan with state is not to be run again and again
            rows = matching.alignment_rows(whole, steps, config, max_fragment)
            matching.read_classes(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return alignments.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()


def merged_classes(spark, path: str) -> DataFrame:
    """The classes of all batches, counts added up."""
    rows = spark.read.parquet(path)
    merged = rows.groupBy("rows", "min_mapq", "noise_score").agg(F.sum("read_count").alias("read_count"))
    return merged.withColumn("read_class_id", F.monotonically_increasing_id())
