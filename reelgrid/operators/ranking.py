"""Ordering and cutting of result lists.

Every list is ordered by score, highest first, then id; scores are compared after rounding, so that
the order in which a sum was taken cannot swap two rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_DIGITS = 9


def rounded(score: Column | str, digits: int = SCORE_DIGITS) -> Column:
    """The score in whole units of its last digit: to order by, at a fraction of the cost of ``round``."""
    return F.rint((F.col(score) if isinstance(score, str) else score) * F.lit(float(10**digits)))


def by_score(score: str = "score", key: str = "segment_id", digits: int = SCORE_DIGITS) -> list[Column]:
    return [rounded(score, digits).desc(), F.col(key).asc()]


def with_rank(results: DataFrame, order: list[Column] | None = None, per: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """1-based position in each list."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(*(order or by_score()))))


def top_k(
    results: DataFrame, k: int, order: list[Column] | None = None, per: tuple[str, ...] = ("query_id",)
) -> DataFrame:
    """Best ``k`` rows of each list; Spark cuts each partition to ``k`` per list before the shuffle."""
    return with_rank(results, order, per).where(F.col("rank") <= k)


def union_rank(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Two result lists in one, by score, without removing doubles."""
    return top_k(
        first.unionByName(second), k, [rounded("score").desc(), F.col("segment_id"), F.col("source")]
    )


def splice(head: DataFrame, tail: DataFrame) -> DataFrame:
    """A reordered head followed by the untouched tail, whatever the tail's scores are."""
    tiers = head.withColumn("tier", F.lit(0)).unionByName(
        tail.withColumn("tier", F.lit(1)), allowMissingColumns=True
    )
    in_head = F.col("tier") == 0
    return with_rank(
        tiers,
        [
            F.col("tier"),
            F.when(in_head, -rounded("score")).otherwise(F.col("rank")),
            F.col("segment_id"),
        ],
    )
