"""Confidence verdicts per query, and the choice among retry rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions.scoring import verdict
from reelgrid.operators.ranking import rounded
from reelgrid.schemas import TOP_K_FINAL

MEAN_OVER = 3
CLEAR_GAP = 0.3
MANY_SOURCES = 3


def _at_rank(value: str, rank: int) -> Column:
    return F.max(F.when(F.col("rank") == rank, F.col(value)))


def _all_queries(verdicts: DataFrame, queries: DataFrame | None) -> DataFrame:
    """Queries without any result have the verdict of an empty list."""
    if queries is None:
        return verdicts
    return queries.select("query_id").join(verdicts, "query_id", "left").fillna("INCORRECT", ["verdict"])


def fast_verdict(results: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Verdict by the top score; a clear lead or support from many sources lifts AMBIGUOUS to CORRECT."""
    head = results.where(F.col("rank") <= 2).groupBy("query_id").agg(
        _at_rank("score", 1).alias("top_score"),
        _at_rank("score", 2).alias("second_score"),
        _at_rank("num_sources", 1).alias("top_sources") if "num_sources" in results.columns
        else F.lit(1).alias("top_sources"),
    )
    gap = F.round(F.col("top_score") - F.col("second_score"), 12)
    lifted = (gap > CLEAR_GAP) | (F.col("top_sources") >= MANY_SOURCES)
    plain = verdict(F.col("top_score"))
    final = F.when((plain == "AMBIGUOUS") & F.coalesce(lifted, F.lit(False)), "CORRECT").otherwise(plain)
    return _all_queries(head.withColumn("verdict", final), queries)


def with_verdict(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    return results.join(
        verdicts.select("query_id", F.col("verdict").alias("crag_verdict")), "query_id", "left"
    )


def mean_verdict(results: DataFrame, queries: DataFrame | None = None, per: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Verdict by the mean of the first three scores; no results give 0."""
    means = (
        results.where(F.col("rank") <= MEAN_OVER).groupBy(*per).agg(F.avg("score").alias("mean_score"))
    ).withColumn("verdict", verdict(F.round("mean_score", 12)))
    return _all_queries(means, queries).fillna(0.0, ["mean_score"])


def top_verdict(results: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Verdict by the top score, and whether the query should be worded anew."""
    tops = results.where(F.col("rank") == 1).select(
        "query_id", F.col("score").alias("top_score"), verdict(F.col("score")).alias("verdict")
    )
    judged = _all_queries(tops, queries)
    empty = F.col("top_score").isNull()
    return judged.withColumn("reformulate", (F.col("verdict") == "AMBIGUOUS") | empty)


def best_round(rounds: DataFrame, compat: bool = False) -> DataFrame:
    """Results of one round per query: the first CORRECT one, else the one with the highest mean.

    With ``compat`` round 0 is kept outright when it is CORRECT and otherwise counts as 0, so that any
    later round with a positive mean replaces it, the best one up to the first CORRECT one winning.
    """
    per_round = mean_verdict(rounds.where(F.col("rank") <= TOP_K_FINAL), per=("query_id", "round"))
    mean = F.col("mean_score")
    if compat:
        mean = F.when((F.col("round") == 0) & (F.col("verdict") != "CORRECT"), F.lit(0.0)).otherwise(mean)
    correct = F.min(F.when(F.col("verdict") == "CORRECT", F.col("round")))
    first = per_round.groupBy("query_id").agg(correct.alias("_stop"))
    # rounds after the first CORRECT one are never run
    seen = per_round.withColumn("mean_score", mean).join(first, "query_id")
    seen = seen.where(F.col("_stop").isNull() | (F.col("round") <= F.col("_stop")))
    leader = F.max_by("round", F.struct(rounded("mean_score", 12), -F.col("round")))
    chosen = seen.groupBy("query_id").agg(leader.alias("_leader"), F.max("_stop").alias("_stop"))
    pick = F.col("_leader") if compat else F.coalesce("_stop", "_leader")
    return rounds.join(chosen.select("query_id", pick.alias("round")), ["query_id", "round"], "left_semi")
