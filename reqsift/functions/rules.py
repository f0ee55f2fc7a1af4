"""Row rules: noise phrases, acceptance status, match tiers, truth-row and delivery rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from reqsift.functions.text import full_text, is_yes, once

# Phrases that mark a candidate as document noise.
NOISE_PHRASES = [
    "executive summary",
    "problem statement",
    "impacted system",
    "high level flow",
    "this document provides",
    "conceptual solution",
    "document overview",
]

# Similarity above which two records are duplicates, at which a
# record matches a truth row, and from which a judge may decide.
DUPLICATE_ABOVE = 0.45
MATCH_FROM = 0.30
JUDGE_FROM = 0.10

ACCEPTED = "accepted"
NOISE = "noise"
REJECTED = "rejected"
FAILED = "failed"


def is_noise(
    title: Column, description: Column, phrases: Sequence[str] = tuple(NOISE_PHRASES)
) -> Column:
    """True when a phrase occurs in the lower-cased title and description."""
    def holds(text: Column) -> Column:
        return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in phrases), F.lit(False))

    return once(F.lower(full_text(title, description)), holds)


def status(noise: Column, verdict: Column, error: Column | None = None) -> Column:
    """Where a candidate went: noise, failed (classifier error), accepted or rejected."""
    failed = F.lit(False) if error is None else error.isNotNull()
    return (
        F.when(noise, F.lit(NOISE))
        .when(failed, F.lit(FAILED))
        .when(is_yes(verdict), F.lit(ACCEPTED))
        .otherwise(F.lit(REJECTED))
    )


def tier(score: Column, match_from: float = MATCH_FROM, judge_from: float = JUDGE_FROM) -> Column:
    """Decision a score leads to: match, borderline or reject."""
    return (
        F.when(score >= match_from, F.lit("match"))
        .when(score >= judge_from, F.lit("borderline"))
        .otherwise(F.lit("reject"))
    )


def truthy(value: Column, type_name: str) -> Column:
    """True for a filled cell: not null, not the empty string, not zero, not false."""
    filled = value.isNotNull()
    if type_name == "string":
        return filled & (value != "")
    if type_name == "boolean":
        return filled & value
    if type_name in ("date", "timestamp", "timestamp_ntz"):
        return filled
    return filled & (value != 0)
