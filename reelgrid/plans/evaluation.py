"""From results and ground truth to metrics, means and a report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from reelgrid.operators.relevance import eval_report, evaluate, evaluate_all
from reelgrid.schemas import TOP_K_FINAL


def evaluation(
    results: DataFrame, gt: DataFrame, queries: DataFrame, k: int = TOP_K_FINAL
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(metrics, means, report)`` for a table of queries; ground truth without spans may hold null ids."""
    metrics = evaluate(results, gt.where("gt_id is not null"), queries, k)
    return metrics, evaluate_all(metrics), eval_report(metrics)
