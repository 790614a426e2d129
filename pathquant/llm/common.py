"""Shared helpers: table loading and constant expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathquant.plans.store import shared_path, shared_root, stored  # noqa: F401


def word_count(text):
    """Words of a text; null counts 0."""
    return F.coalesce(F.expr(f"regexp_count({text}, '[^\\\\x20\\\\x09-\\\\x0D]+')"), F.lit(0)).cast("long")
