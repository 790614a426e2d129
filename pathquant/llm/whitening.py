"""Embedding whitening over exactly centred rows.

Entries become whole numbers x = floor(scale * c) + shift, so counts and sums over all rows are exact. The fit reads each
distinct x-vector once: with n of them and sums S per dimension, n * x - S is exact as well, and a row is centred
by one division of it. Covariances are Gramian matrices of MLlib's RowMatrix over these rows, divided by n: partial
matrices of dimension x dimension numbers are summed up a tree of tasks, however many rows there are. The matrix goes to
the driver, where its eigenvectors are found, and the projection back to the tasks; neither grows with the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathquant.llm.common import stored

LARGEST = 1 << 52  # |n * x - S| at most: as a double it is exact, and its parts below are
LOW_BITS = 24  # n * x - S is squared in two parts


@dataclass(frozen=True)
class Whitening:
    """What is learned: row counts and sums of the fit list, eigenvalues (falling) and unit eigenvectors (columns)."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def rank(self) -> int:
        """Components with a variance that is not 0 but for rounding."""
        return int((self.values > len(self.values) * np.finfo(float).eps * max(self.values, default=0.0)).sum())


def whole_numbers(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(id, x) of the rows whose vector is neither null nor empty and has only finite entries."""
    entry = F.col(vector_col)
    finite = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.where(entry.isNotNull() & (F.size(entry) > 0) & finite)
    return kept.select(F.col(id_col).alias("id"), F.transform(entry, lambda c: F.floor(c.cast("double") * float(scale)) + shift).alias("x"))


def _gramian(rows: DataFrame) -> np.ndarray:
    """Sum of the outer products of the rows' vectors (column v, arrays of doubles), by tasks of the JVM."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("v").alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def _literal(values: np.ndarray):
    return F.array(*[F.lit(int(v)) for v in values])


def _centred(n: int, sums: np.ndarray):
    """(n * x - S) / n of the column x: an exact long, and one division."""
    return F.zip_with("x", _literal(sums), lambda x, s: (x * n - s) / F.lit(float(n)))


def fit(numbers: DataFrame, components: int | None = None) -> Whitening:
    """Learns from the distinct vectors of ``whole_numbers``.

    Repeated vectors count once, however often they are there: tasks drop their own before the exchange, so a
    vector of a third of all rows is no hot key. Without rows, n is 0 and nothing can be whitened. Vectors of different
    lengths raise an error, as do numbers too large for exact arithmetic.

    ``identity_error`` is measured, not derived: the largest entry, of the covariance of the whitened fit list (its first
    ``components``, all without) less the identity, in absolute value.
    """
    distinct = stored(numbers.select("x").distinct(), "whitening-fit")
    n, shortest, longest, low, high = distinct.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if not n:
        return Whitening(0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0, 0.0)
    if shortest != longest:
        raise ValueError(f"vectors have from {shortest} to {longest} entries")
    if n * max(1, high - low) > LARGEST:
        raise OverflowError(f"{n} vectors with entries from {low} to {high} are more than exact sums can hold")
    sums = np.array(distinct.agg(*[F.sum(F.col("x")[i]) for i in range(longest)]).first(), dtype=np.int64)
    covariance = _gramian(distinct.select(_centred(n, sums).alias("v"))) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    model = Whitening(n, sums, values[::-1].copy(), vectors[:, ::-1].copy(), float(np.trace(covariance)), 0.0)
    k = min(model.rank, components or longest)
    if not k:
        return model
    white = whiten(distinct.select(F.lit(0).alias("id"), "x"), model, k)
    error = np.abs(_gramian(white.select(F.col("whitened").alias("v"))) / n - np.eye(k)).max()
    return Whitening(n, sums, model.values, model.vectors, model.trace, float(error))


def whiten(numbers: DataFrame, model: Whitening, components: int) -> DataFrame:
    """(id, deviation, whitened) of every row of ``whole_numbers``.

    whitened: its centred vector on the first components, each divided by its standard deviation; components without
    variance are left out. deviation: the exact sum of (n * x - S) ** 2, a decimal as it may outgrow a long.
    """
    spark = numbers.sparkSession
    ident = numbers.schema["id"].dataType.simpleString()
    k = min(components, model.rank)
    if not model.n or not k:
        return spark.createDataFrame([], f"id {ident}, deviation decimal(38,0), whitened array<double>")
    sent = spark.sparkContext.broadcast((model.n, model.sums, model.vectors[:, :k] / np.sqrt(model.values[:k])))

    def run(frames):
        n, sums, projection = sent.value
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame["x"].to_numpy())
            exact = x * n - sums
            if np.abs(exact).max() > LARGEST:
                raise OverflowError("a vector lies too far from the fit list for exact arithmetic")
            size = np.abs(exact)
            high, low = size >> LOW_BITS, size & ((1 << LOW_BITS) - 1)
            parts = {"high": (high * high).sum(axis=1), "middle": (high * low).sum(axis=1), "low": (low * low).sum(axis=1)}
            yield pd.DataFrame({"id": frame["id"], **parts, "whitened": list((exact / n) @ projection)})

    out = numbers.mapInPandas(run, f"id {ident}, high long, middle long, low long, whitened array<double>")
    high, middle, low = (F.col(c).cast("decimal(20,0)") * F.lit(1 << shift).cast("decimal(16,0)") for c, shift in (("high", 2 * LOW_BITS), ("middle", LOW_BITS + 1), ("low", 0)))
    return out.select("id", (high + middle + low).cast("decimal(38,0)").alias("deviation"), "whitened")


def whitened_components(rows: DataFrame, *, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per kept row and component, numbered from 1.

    Rows with a null or empty vector, or one with null or non-finite entries, are dropped; null ids are ids like
    others. Repeated rows are whitened one by one and fitted once. Equal eigenvalues come in any order, the same for all
    rows. Components without variance (constant dimensions, fewer vectors than dimensions) have no rows, so a table of one
    distinct vector, like an empty one, gives an empty result. Other columns are not read, so their names cannot clash.
    """
    numbers = whole_numbers(rows, id_col=id_col, vector_col=vector_col, scale=scale, shift=shift)
    model = fit(numbers, components)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values[: min(components, model.rank)]]) if model.rank else F.array(F.lit(0.0))
    each = whiten(numbers, model, components).select("id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(F.col("id").alias(id_col), (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("place")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op11_embedding_whitening(spark, sf_dir):
    """A deviation that does not fit a long is null here; ``whitened_components`` has it as a decimal."""
    out = whitened_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
