"""Rescoring of result lists from stored scores, ratings, feedback and answers.

``results`` are lists already cut by ``top_k`` and carry ``query_id``, ``segment_id``, ``rank`` and
``score``; every operator returns them reordered with a new ``rank``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.functions.scoring import sigmoid
from reelgrid.functions.text import non_empty
from reelgrid.operators.ranking import with_rank

KEY = ["query_id", "segment_id"]
TOP_JUDGED = 3
AUTO_PASS = 0.85


def passage(results: DataFrame) -> Column:
    """What a pair scorer reads: the text, or the id when there is none."""
    return F.coalesce(non_empty(F.col("text")), F.col("segment_id").cast("string"))


def rerank(results: DataFrame, pair_scores: DataFrame | None) -> DataFrame:
    """Order by pair score; its sigmoid becomes the score. Without a scorer the order stays."""
    if pair_scores is None:
        return results
    scored = results.join(pair_scores.select(*KEY, "logit"), KEY, "left").withColumnRenamed("logit", "rerank_raw")
    known = F.col("rerank_raw").isNotNull()
    scored = scored.withColumn("rerank_score", F.when(known, sigmoid(F.col("rerank_raw"))).otherwise(F.lit(0.0)))
    scored = scored.withColumn("score", F.when(known, F.col("rerank_score")).otherwise(F.col("score")))
    return with_rank(scored)


def blend_scores(results: DataFrame, ratings: DataFrame, weight: float = 0.7) -> DataFrame:
    """Mix ratings into the scores of rated rows; unrated rows keep theirs."""
    mixed = results.drop("rerank_score").join(
        ratings.select(*KEY, F.col("rating").alias("rerank_score")), KEY, "left"
    )
    blend = (1.0 - weight) * F.col("score") + weight * F.col("rerank_score")
    mixed = mixed.withColumn("score", F.when(F.col("rerank_score").isNotNull(), blend).otherwise(F.col("score")))
    return with_rank(mixed.fillna(0.0, ["rerank_score"]))


def apply_feedback(results: DataFrame, feedback: DataFrame) -> DataFrame:
    """Users' verdicts on the first three rows: raised by 1.3, halved, or skipped when there is none."""
    judged = results.join(feedback.select(*KEY, "relevant"), KEY, "left")
    asked = F.col("rank") <= TOP_JUDGED
    factor = (
        F.when(asked & F.col("relevant"), 1.3).when(asked & ~F.col("relevant"), 0.5).otherwise(1.0)
    )
    label = (
        F.when(asked & F.col("relevant"), "positive")
        .when(asked & ~F.col("relevant"), "negative")
        .when(asked, "skipped")
    )
    judged = judged.withColumn("user_feedback", label).withColumn("score", F.col("score") * factor)
    return with_rank(judged.drop("relevant"))


def apply_verification(results: DataFrame, answers: DataFrame) -> DataFrame:
    """Stored checks of the first three rows with text: not verified costs a fifth of the score."""
    checks = answers.select(
        *KEY,
        F.lit(True).alias("_answered"),
        F.coalesce("verified", F.lit(False)).alias("verified"),
        F.coalesce("confidence", F.lit(0.5)).alias("verify_confidence"),
    )
    asked = F.col("_answered") & (F.col("rank") <= TOP_JUDGED) & (F.coalesce("text", F.lit("")) != "")
    checked = results.join(checks, KEY, "left").withColumn("_asked", F.coalesce(asked, F.lit(False)))
    checked = checked.withColumn(
        "score", F.when(F.col("_asked") & ~F.col("verified"), F.col("score") * 0.8).otherwise(F.col("score"))
    )
    checked = checked.withColumn("verified", F.when(F.col("_asked"), F.col("verified"))).withColumn(
        "verify_confidence", F.when(F.col("_asked"), F.col("verify_confidence"))
    )
    return with_rank(checked.drop("_answered", "_asked"))


def verify_gate(results: DataFrame, answers: DataFrame) -> DataFrame:
    """Keep confident or confirmed rows, and rows without an answer; a query losing all keeps all."""
    answered = results.join(answers.select(*KEY, "answer"), KEY, "left")
    confirmed = F.col("answer").isNull() | F.upper("answer").contains("YES")
    gated = answered.withColumn("_keep", (F.col("score") > AUTO_PASS) | confirmed)
    gated = gated.withColumn("_any", F.bool_or("_keep").over(Window.partitionBy("query_id")))
    return with_rank(gated.where(F.col("_keep") | ~F.col("_any")).drop("_keep", "_any", "answer"), [F.col("rank")])
