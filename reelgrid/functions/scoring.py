"""Score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelgrid.schemas import THRESHOLD_AMBIGUOUS, THRESHOLD_CORRECT


def sigmoid(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-logit))


def verdict(score: Column) -> Column:
    """CORRECT, AMBIGUOUS or INCORRECT by score; no score is INCORRECT."""
    return (
        F.when(score >= THRESHOLD_CORRECT, F.lit("CORRECT"))
        .when(score >= THRESHOLD_AMBIGUOUS, F.lit("AMBIGUOUS"))
        .otherwise(F.lit("INCORRECT"))
    )


def grade(mean_average_precision: Column) -> Column:
    return (
        F.when(mean_average_precision >= 0.7, F.lit("excellent"))
        .when(mean_average_precision >= 0.5, F.lit("good"))
        .when(mean_average_precision >= 0.3, F.lit("fair"))
        .otherwise(F.lit("needs improvement"))
    )
