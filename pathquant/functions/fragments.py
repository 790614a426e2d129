"""Fragment length distributions: parameters from alignments, histograms, fits and log probabilities."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathquant.config import TRAINING_MAPQ
from pathquant.functions import mathfn


@dataclass(frozen=True)
class FragmentDist:
    """Normal, or skew normal where shape is not 0."""

    loc: float
    scale: float
    shape: float = 0.0
    num_sd: int = 10

    @property
    def valid(self) -> bool:
        return math.isfinite(self.loc) and math.isfinite(self.scale) and math.isfinite(self.shape) and self.loc >= 0 and self.scale > 0

    @property
    def skewed(self) -> bool:
        return not mathfn.same(self.shape, 0.0)

    @property
    def max_length(self) -> int:
        delta = self.shape / math.sqrt(1 + self.shape**2)
        sd = self.scale * (1 - 2 * delta**2 / math.pi)
        return math.ceil(self.loc + sd * self.num_sd)

    def log_prob(self, length):
        if self.skewed:
            return mathfn.log_skew_normal_pdf(length, self.loc, self.scale, self.shape)
        return mathfn.log_normal_pdf(length, self.loc, self.scale)

    def truncated_mean(self, length):
        if self.skewed:
            return mathfn.truncated_skew_normal_mean(self.loc, self.scale, self.shape, 1.0, length)
        return mathfn.truncated_normal_mean(self.loc, self.scale, 1.0, length)

    def log_prob_column(self, length: Column) -> Column:
        """The normal case is an expression; the skew normal one is a broadcast table, see ``log_prob_table``."""
        if self.skewed:
            raise ValueError("join log_prob_table for a skew normal distribution")
        z = (length - F.lit(self.loc)) / F.lit(self.scale)
        return F.lit(-math.log(self.scale) - 0.5 * math.log(2 * math.pi)) - F.lit(0.5) * z * z


def with_log_prob(df: DataFrame, length: str, dist: FragmentDist, out: str = "frag_log_prob") -> DataFrame:
    """Adds the log probability of a length column. Skew normal values are computed once per distinct length."""
    if not dist.skewed:
        return df.withColumn(out, dist.log_prob_column(F.col(length)))

    def values(batches):
        for pdf in batches:
            pdf[out] = dist.log_prob(pdf[length].to_numpy(dtype=float))
            yield pdf

    table = df.select(length).distinct().where(F.col(length).isNotNull())
    return df.join(table.mapInPandas(values, f"{length} {table.schema[length].dataType.simpleString()}, {out} double"), length, "left")


def parse_alignment_params(text: Column, annotation: Column) -> Column:
    """struct(mean, sd) of a single-path alignment: "n:mean:sd:..." unless it begins with 0, else the annotation's "-I mean -D sd"."""
    parts = F.split(F.coalesce(text, F.lit("")), ":")
    own = F.when((F.size(parts) >= 3) & ~F.coalesce(text, F.lit("0")).startswith("0"), F.struct(parts[1].cast("double").alias("mean"), parts[2].cast("double").alias("sd")))
    return F.coalesce(own, parse_annotation_params(annotation))


def parse_annotation_params(annotation: Column) -> Column:
    """struct(mean, sd) of "-I mean -D sd" under fragment_length_distribution, or null."""
    text = F.element_at(annotation, "fragment_length_distribution")
    mean, sd = F.regexp_extract(text, r"-I\s*([0-9.eE+-]+)", 1), F.regexp_extract(text, r"-D\s*([0-9.eE+-]+)", 1)
    return F.when((mean != "") & (sd != ""), F.struct(mean.cast("double").alias("mean"), sd.cast("double").alias("sd")))


def first_params(alignments: DataFrame, params: Column, order: str) -> tuple[float, float] | None:
    """Parameters of the first record, by an order column, that carries any."""
    row = alignments.select(F.col(order).alias("o"), params.alias("p")).where("p IS NOT NULL").agg(F.min_by("p", "o").alias("p")).first()
    return (row["p"]["mean"], row["p"]["sd"]) if row and row["p"] else None


def histogram(align_lists: DataFrame, max_length: int) -> DataFrame:
    """(frag_length, n) over lists that are simple, with mapping quality for training, weighted by read_count."""
    rows = align_lists.where(F.col("is_simple") & (F.col("min_mapq") >= TRAINING_MAPQ) & (F.col("frag_length") <= max_length))
    return rows.groupBy("frag_length").agg(F.sum("read_count").alias("n"))


def moments(hist: DataFrame) -> DataFrame:
    """One row: n, mean, sd (sample), skewness of a histogram, by one pass of weighted sums."""
    x, n = F.col("frag_length").cast("double"), F.col("n").cast("double")
    sums = hist.agg(F.sum(n).alias("n"), F.sum(n * x).alias("s1"), F.sum(n * x * x).alias("s2"), F.sum(n * x * x * x).alias("s3"))
    mean = F.col("s1") / F.col("n")
    m2 = F.col("s2") / F.col("n") - mean * mean
    m3 = F.col("s3") / F.col("n") - 3 * mean * F.col("s2") / F.col("n") + 2 * mean * mean * mean
    return sums.select("n", mean.alias("mean"), F.sqrt(m2 * F.col("n") / (F.col("n") - 1)).alias("sd"), (m3 / F.pow(m2, 1.5)).alias("skewness"))


def fit_normal(hist: DataFrame, num_sd: int = 10) -> FragmentDist | None:
    """None with fewer than two observations."""
    row = moments(hist).first()
    if not row["n"] or row["n"] < 2 or not row["sd"]:
        return None
    return FragmentDist(row["mean"], row["sd"], 0.0, num_sd)


def fit_skew_normal(lengths: np.ndarray, counts: np.ndarray, num_sd: int = 10, rounds: int = 200, tolerance: float = 1e-9) -> FragmentDist | None:
    """Maximum likelihood on a histogram (at most max-length rows, so it is fitted on the driver).

    Starts from moments, looks along the shape by golden section, then takes damped Newton steps in
    (location, log scale, shape).
    """
    x, n = np.asarray(lengths, dtype=float), np.asarray(counts, dtype=float)
    x, n = x[n > 0], n[n > 0]
    total = n.sum()
    if total < 2 or len(x) < 2:
        return None
    mean = (n * x).sum() / total
    sd = math.sqrt((n * (x - mean) ** 2).sum() / total)
    skew = (n * (x - mean) ** 3).sum() / total / sd**3

    def likelihood(p: np.ndarray) -> float:
        return float((n * mathfn.log_skew_normal_pdf(x, p[0], math.exp(p[1]), p[2])).sum()) / total

    def at_shape(shape: float) -> np.ndarray:
        """Location and scale whose moments agree, for a shape."""
        delta = shape / math.sqrt(1 + shape * shape)
        scale = sd / math.sqrt(1 - 2 * delta * delta / math.pi)
        return np.array([mean - scale * delta * math.sqrt(2 / math.pi), math.log(scale), shape])

    side = 1.0 if skew >= 0 else -1.0
    p = at_shape(side * math.exp(mathfn.golden_section_maximum(lambda t: likelihood(at_shape(side * math.exp(t))), math.log(0.05), math.log(60), 1e-3)))
    step = np.array([1e-3 * sd, 1e-4, 1e-3])
    value = likelihood(p)
    for _ in range(rounds):
        grad, hess = np.zeros(3), np.zeros((3, 3))
        for i in range(3):
            e = np.eye(3)[i] * step
            up, down = likelihood(p + e), likelihood(p - e)
            grad[i], hess[i, i] = (up - down) / (2 * step[i]), (up - 2 * value + down) / step[i] ** 2
            for j in range(i):
                g = np.eye(3)[j] * step
                hess[i, j] = hess[j, i] = (likelihood(p + e + g) - likelihood(p + e - g) - likelihood(p - e + g) + likelihood(p - e - g)) / (4 * step[i] * step[j])
        low = np.linalg.eigvalsh(hess)[-1]
        move = np.linalg.solve(hess - max(0.0, low + 1e-8) * np.eye(3), -grad)
        scale = 1.0
        while scale > 1e-10 and not likelihood(p + scale * move) > value:
            scale /= 2
        if scale <= 1e-10:
            break
        p = p + scale * move
        gain, value = likelihood(p) - value, likelihood(p)
        if gain < tolerance * 1e-3:
            break
    return FragmentDist(float(p[0]), math.exp(float(p[1])), float(p[2]), num_sd)
