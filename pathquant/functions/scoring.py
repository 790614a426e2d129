"""Scores, lengths and clips of alignments as column expressions.

An alignment end is a struct: score, length, left_clip, right_clip, and for a partial match start_penalty,
start_offset, end_penalty, end_offset (penalty and dropped bases at either side).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from pathquant.config import FULL_LENGTH_BONUS, INT_MIN, MATCH, MISMATCH, NOISE_LOG_BASE, SCORE_LOG_BASE
from pathquant.functions.mathfn import clamp_int, log_sum_exp

MAX_QUALITY = 255


def _score(p: float) -> int:
    return int(math.copysign(math.floor(abs(p) + 0.5), p))


def quality_match_scores() -> list[int]:
    """Score of a match by base quality: the log odds of the observed pair when the base may be wrong, at equal base frequencies."""
    same = math.exp(SCORE_LOG_BASE * MATCH) / 16
    other = math.exp(-SCORE_LOG_BASE * MISMATCH) / 16
    out = []
    for q in range(MAX_QUALITY + 1):
        error = 10 ** (-q / 10)
        joint = (1 - error) * same + error / 3 * 3 * other
        chance = 0.25 * ((1 - error) * 0.25 + error / 3 * 0.75)
        out.append(0 if error > 0.75 else _score(math.log(joint / chance) / SCORE_LOG_BASE))
    return out


def quality_bonuses() -> list[int]:
    """Bonus for aligning an end in full by the quality of its last base; the lowest qualities have none."""
    full = math.exp(SCORE_LOG_BASE * FULL_LENGTH_BONUS) / (1 + math.exp(SCORE_LOG_BASE * FULL_LENGTH_BONUS))
    first = math.ceil(-10 * math.log10(0.75)) + 1
    out = [0] * (MAX_QUALITY + 1)
    for q in range(first, MAX_QUALITY + 1):
        wrong = 4 / 3 * 10 ** (-q / 10)
        out[q] = _score(math.log(((1 - wrong) * full + wrong * (1 - full)) / (1 - full)) / SCORE_LOG_BASE)
    return out


MATCH_SCORES, BONUSES = quality_match_scores(), quality_bonuses()


def optimal_score(length: Column, quality: Column | None = None) -> Column:
    """Best score of a read: a match at every base and both bonuses. quality: array of base qualities, or None to ignore it."""
    plain = length * MATCH + 2 * FULL_LENGTH_BONUS
    if quality is None:
        return plain
    matches, bonuses = F.array(*map(F.lit, MATCH_SCORES)), F.array(*map(F.lit, BONUSES))
    adjusted = F.aggregate(quality, F.lit(0), lambda total, q: total + F.get(matches, q)) + F.get(bonuses, F.element_at(quality, 1)) + F.get(bonuses, F.element_at(quality, -1))
    return F.when(F.size(quality) > 0, adjusted).otherwise(plain)


def edit_length(edits: Column, field: str) -> Column:
    """Sum of from_length or to_length over the edits of a mapping."""
    return F.aggregate(F.coalesce(edits, F.array()), F.lit(0), lambda total, e: total + F.coalesce(e[field], F.lit(0)))


def soft_clip(edit: Column) -> Column:
    """Bases of an outermost edit that consumes no path."""
    return F.when(F.coalesce(edit["from_length"], F.lit(0)) == 0, F.coalesce(edit["to_length"], F.lit(0))).otherwise(0)


def left_soft_clip(mapping: Column) -> Column:
    return soft_clip(F.get(F.get(mapping, F.lit(0))["edit"], F.lit(0)))


def right_soft_clip(mapping: Column) -> Column:
    return soft_clip(F.element_at(F.element_at(mapping, -1)["edit"], -1))


def clipped_left(end: Column) -> Column:
    return end["left_clip"] + end["start_offset"]


def clipped_right(end: Column) -> Column:
    return end["right_clip"] + end["end_offset"]


def adjusted_score(end: Column) -> Column:
    return end["score"] - end["start_penalty"] - end["end_penalty"]


def score_sum(ends: Column) -> Column:
    return F.aggregate(ends, F.lit(0), lambda total, e: total + adjusted_score(e))


def align_length(ends: Column) -> Column:
    return F.aggregate(ends, F.lit(0), lambda total, e: total + e["length"] - clipped_left(e) - clipped_right(e))


def fragment_length(ends: Column, insert: Column) -> Column:
    """Of one end: its length, and with an insert its length up to the clip plus the insert. Of two: both and what lies between."""
    first, last = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
    one = F.when(insert == 0, first["length"]).otherwise(first["length"] + insert - clipped_right(first))
    return F.when(F.size(ends) == 1, one).otherwise(first["length"] + last["length"] + insert - clipped_right(first) - clipped_left(last))


def optimal_fraction(ends: Column, optima: Column) -> Column:
    """Least share of its optimal score that an end reaches, 0 at least."""
    shares = F.zip_with(ends, optima, lambda e, o: adjusted_score(e) / o.cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.array_min(shares)))


def soft_clip_fraction(ends: Column) -> Column:
    return F.array_max(F.transform(ends, lambda e: (e["left_clip"] + e["right_clip"]) / e["length"].cast("double")))


def is_partial(ends: Column) -> Column:
    return F.exists(ends, lambda e: (e["start_offset"] > 0) | (e["end_offset"] > 0))


def phred_to_prob(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / F.lit(10.0))


def add_log(x: Column, y: Column) -> Column:
    return F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y)))


def same_double(a: Column, b: Column, precision: float) -> Column:
    return (a == b) | (F.abs(a - b) < F.abs(F.least(a, b)) * precision)


def noise_prob_of_scores(scores: Column) -> Column:
    """1 - the product over scores of 1 / (1 + exp(-1e-6 score)): the chance that the read is from no path."""
    product = F.aggregate(scores, F.lit(1.0), lambda p, s: p / (1 + F.exp(-F.lit(NOISE_LOG_BASE) * s)))
    return 1 - product


def missing_score(hits, missing) -> int:
    """Score of one searched orientation: how far the walks that paths hold outweigh those that none holds.

    hits and missing are score sums of full walks. Without missing walks the score is as large as it can be.
    """
    if not len(hits) or not len(missing):
        return clamp_int(math.inf if len(hits) else -math.inf)
    weigh = lambda scores: float(log_sum_exp(np.asarray(scores, dtype=float) * SCORE_LOG_BASE))
    return clamp_int((weigh(hits) - weigh(missing)) / NOISE_LOG_BASE)


def noise_score(rows) -> int:
    """Noise of a read as a score: the least over noise rows, each a list of orientation scores; the lowest integer for none."""
    noise = 1.0
    for scores in rows:
        noise = min(noise, 1 - math.prod(1 / (1 + math.exp(min(700.0, -NOISE_LOG_BASE * s))) for s in scores))
    return clamp_int(math.log(noise) / NOISE_LOG_BASE) if noise > 0 else INT_MIN
