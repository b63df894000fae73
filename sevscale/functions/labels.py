"""Severity label columns.

Every function returns a Column and leaves its input untouched.  Missing numbers are
skipped, as a row sum over a frame does: NaN is first turned into NULL, then NULL into 0
where a sum is taken.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label columns and their weights.
SIX_FLAGS = ("toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate")
SUM_WEIGHTS = {
    "toxic": 1,
    "severe_toxic": 2,
    "obscene": 1,
    "threat": 1,
    "insult": 1,
    "identity_hate": 1,
}
MAX_PLUS_WEIGHTS = {
    "severe_toxic": 2.0,
    "obscene": 1.0,
    "threat": 1.0,
    "insult": 1.0,
    "identity_hate": 2.0,
}
SUB_SCORES = (
    "severe_toxicity",
    "obscene",
    "sexual_explicit",
    "identity_attack",
    "insult",
    "threat",
)
SCORE_GATE = 0.5


def present(name: str) -> Column:
    """The number as a double, with NaN read as missing."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def _sum(columns: Sequence[Column]) -> Column:
    total = columns[0]
    for column in columns[1:]:
        total = total + column
    return total


def row_sum(names: Sequence[str]) -> Column:
    """Sum over columns, missing values counted as nothing."""
    return _sum([F.coalesce(present(n), F.lit(0.0)) for n in names])


def severity_sum(weights: Mapping[str, float] = SUM_WEIGHTS) -> Column:
    """Weighted label sum as a whole number."""
    parts = [F.coalesce(present(n), F.lit(0.0)) * float(w) for n, w in weights.items()]
    return _sum(parts).cast("int")


def severity_max_weighted(
    flags: Sequence[str] = SIX_FLAGS, weights: Mapping[str, float] = MAX_PLUS_WEIGHTS
) -> Column:
    """Largest flag plus the weighted specific flags."""
    top = F.greatest(*[present(n) for n in flags])
    return top + _sum([present(n) * w for n, w in weights.items()])


def severity_gated(
    main: str = "toxicity", parts: Sequence[str] = SUB_SCORES, gate: float = SCORE_GATE
) -> Column:
    """The main score up to the gate, the sub-score sum above it (and where it is missing)."""
    value = present(main)
    return F.when(value <= gate, value).otherwise(row_sum(parts))


def clamp_floor(value: Column) -> Column:
    """Values at or below zero become 0.0; a missing value stays missing."""
    return F.when(value <= 0, F.lit(0.0)).otherwise(value.cast("double"))


def label_sum(flags: Sequence[str] = SIX_FLAGS) -> Column:
    return row_sum(flags).cast("bigint")


def any_label(flags: Sequence[str] = SIX_FLAGS) -> Column:
    return label_sum(flags) > 0


def stratum_round(y: Column) -> Column:
    """Nearest whole number, halves to even."""
    return F.rint(y).cast("bigint")


def stratum_tenths(y: Column) -> Column:
    """Nearest tenth as a whole number of tenths, halves to even."""
    return F.rint(y * 10).cast("bigint")
