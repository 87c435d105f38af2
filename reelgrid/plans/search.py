"""From a table of queries to final results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.operators.fusion import attach_segments, retrieve, rrf_fuse
from reelgrid.operators.lexical import LexicalIndex
from reelgrid.operators.models import Scorer, score_pairs
from reelgrid.operators.rerank import blend_scores, rerank, verify_gate
from reelgrid.operators.ranking import splice
from reelgrid.operators.verdict import best_round, fast_verdict, mean_verdict, with_verdict
from reelgrid.schemas import TOP_K_FINAL, TOP_K_RERANK, TOP_K_RETRIEVAL


def candidates(
    queries: DataFrame,
    segments: DataFrame,
    index: LexicalIndex | DataFrame | None,
    query_vectors: dict[str, DataFrame],
    vectors: dict[str, DataFrame],
    k: int = TOP_K_RETRIEVAL,
) -> DataFrame:
    """Fused candidates with their segments' metadata; only the fused rows are looked up."""
    fused = rrf_fuse(retrieve(queries, index, query_vectors, vectors, k), k=k)
    return attach_segments(fused, segments).withColumn("source", F.lit("fused"))


def auto_track(
    queries: DataFrame,
    found: DataFrame,
    scorer: Callable[[], Scorer] | None,
    depth: int = TOP_K_RERANK,
    final: int = TOP_K_FINAL,
) -> DataFrame:
    """The first ``depth`` candidates reordered by a pair scorer, judged by their scores, cut to ``final``."""
    head = found.where(F.col("rank") <= depth)
    if scorer is not None:
        asked = head.join(queries.select("query_id", F.col("original_query").alias("query")), "query_id")
        scored = score_pairs(asked, scorer)
        head = rerank(head, scored)
    judged = with_verdict(head, fast_verdict(head, queries))
    return judged.where(F.col("rank") <= final).withColumn("crag_method", F.lit("fast_heuristic"))


def semi_track(
    found: DataFrame,
    ratings: DataFrame,
    answers: DataFrame,
    retries: DataFrame | None = None,
    depth: int = TOP_K_RERANK,
    final: int = TOP_K_FINAL,
) -> DataFrame:
    """Candidates blended with stored ratings, the best of the stored retry rounds, gated by stored answers."""
    head = blend_scores(found.where(F.col("rank") <= depth), ratings)
    ordered = splice(head, found.where(F.col("rank") > depth)).drop("tier")
    if retries is not None:
        rounds = ordered.withColumn("round", F.lit(0)).unionByName(retries, allowMissingColumns=True)
        ordered = best_round(rounds).drop("round")
    shown = ordered.where(F.col("rank") <= final)
    return with_verdict(verify_gate(shown, answers), mean_verdict(shown))
