"""Matching of results to ground truth and the metrics of one evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.functions.scoring import grade
from reelgrid.functions.text import strip
from reelgrid.functions.timing import iou
from reelgrid.schemas import DEFAULT_INTERVAL_SEC, IOU_THRESHOLD, TOP_K_FINAL
from reelgrid.spreading import lookup_join

BLOCK = 128  # results of one query held in one row while they are matched
DIGITS = 4


def _stop(start: str, end: str) -> Column:
    """End of an interval as it is compared: one without length has the default length."""
    return F.when(F.col(end) <= F.col(start), F.col(start) + DEFAULT_INTERVAL_SEC).otherwise(F.col(end))


def _matches(results: DataFrame, gt: DataFrame, match_media: bool) -> DataFrame:
    """Results and ground-truth rows of a query that share time, with their overlap ratio.

    Results come in short ranked lists; ground truth may be long and one query may own most of it.
    So results are packed into rows of at most ``BLOCK`` and looked up by salted key, and each
    ground-truth row takes from its blocks only the results that overlap it.
    """
    media = ["video_file"] if match_media else []
    fields = ["rank", "start_time", _stop("start_time", "end_time").alias("stop"), *media]
    blocks = (
        results.groupBy("query_id", F.floor((F.col("rank") - 1) / BLOCK).alias("_block"))
        .agg(F.collect_list(F.struct(*fields)).alias("_results"))
        .drop("_block")
    )
    facts = gt.select("query_id", "gt_id", "start", _stop("start", "end").alias("_gt_stop"), *media)
    met = lookup_join(facts.withColumnRenamed("video_file", "_gt_media"), blocks, ["query_id"], ["gt_id"], how="inner")

    def shares(r: Column) -> Column:
        timed = (r["start_time"] < F.col("_gt_stop")) & (r["stop"] > F.col("start"))
        return timed & (r["video_file"] == F.col("_gt_media")) if match_media else timed

    pairs = met.select("query_id", "gt_id", "start", "_gt_stop", F.inline_outer(F.filter("_results", shares)))
    return pairs.where(F.col("rank").isNotNull()).select(
        "query_id",
        "gt_id",
        "rank",
        iou(F.col("start_time"), F.col("stop"), F.col("start"), F.col("_gt_stop")).alias("iou"),
    )


def _best(matches: DataFrame) -> DataFrame:
    return matches.groupBy("query_id", "rank").agg(F.max("iou").alias("best_iou"))


def _found(matches: DataFrame, threshold: float) -> DataFrame:
    hit = matches.groupBy("query_id", "gt_id").agg(F.max("iou").alias("iou")).where(F.col("iou") >= threshold)
    return hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_found"))


def relevance(
    results: DataFrame, gt: DataFrame, threshold: float = IOU_THRESHOLD, match_media: bool = False
) -> DataFrame:
    """Results with their best overlap ratio and whether it reaches ``threshold``.

    The media item is not compared unless ``match_media`` asks for it.
    """
    best = _best(_matches(results, gt, match_media))
    judged = results.join(best, ["query_id", "rank"], "left").fillna(0.0, ["best_iou"])
    return judged.withColumn("relevant", F.col("best_iou") >= threshold)


def gt_found(
    results: DataFrame, gt: DataFrame, threshold: float = IOU_THRESHOLD, match_media: bool = False
) -> DataFrame:
    """Ground-truth rows met by at least one result, per query."""
    found = _found(_matches(results, gt, match_media), threshold)
    return gt_counts(gt).join(found, "query_id", "left").fillna(0, ["n_found"]).select("query_id", "n_found")


def gt_counts(gt: DataFrame) -> DataFrame:
    return gt.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gt"))


def average_precision(judged: DataFrame, gt: DataFrame, k: int = TOP_K_FINAL) -> DataFrame:
    """Sum of the precision at each relevant rank over the number of ground-truth rows; 0 for ``k`` means all."""
    seen = judged.where(F.col("rank") <= k) if k else judged
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    precision = F.sum(F.col("relevant").cast("int")).over(running) / F.col("rank")
    summed = (
        seen.withColumn("_p", F.when(F.col("relevant"), precision))
        .groupBy("query_id")
        .agg(F.sum("_p").alias("_sum"))
    )
    per_query = gt_counts(gt).join(summed, "query_id", "left")
    return per_query.select(
        "query_id", (F.coalesce("_sum", F.lit(0.0)) / F.col("n_gt")).alias("average_precision")
    )


def reciprocal_rank(judged: DataFrame) -> DataFrame:
    """One over the first relevant rank; 0 when there is none."""
    first = F.min(F.when(F.col("relevant"), F.col("rank")))
    return judged.groupBy("query_id").agg(F.coalesce(1.0 / first, F.lit(0.0)).alias("reciprocal_rank"))


def aspect_recall(results: DataFrame, gt: DataFrame) -> DataFrame:
    """Share of aspects found in the joined lower-case text of a query's results; repeats count.

    Equal aspects of a query are counted before they meet the text.
    """
    aspects = gt.select("query_id", F.explode("aspects").alias("aspect"))
    counted = aspects.groupBy("query_id", strip(F.lower("aspect")).alias("aspect")).agg(
        F.count(F.lit(1)).alias("n")
    )
    spoken = results.where(F.coalesce("text", F.lit("")) != "")
    ordered = F.sort_array(F.collect_list(F.struct("rank", F.lower("text").alias("text"))))
    joined = spoken.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("_all")
    )
    met = lookup_join(counted, joined, ["query_id"], ["aspect"])
    held = F.coalesce(F.col("_all"), F.lit("")).contains(F.col("aspect"))
    return met.groupBy("query_id").agg(
        (F.sum(F.when(held, F.col("n")).otherwise(0)) / F.sum("n")).alias("aspect_recall")
    )


def evaluate(
    results: DataFrame,
    gt: DataFrame,
    queries: DataFrame,
    k: int = TOP_K_FINAL,
    threshold: float = IOU_THRESHOLD,
    match_media: bool = False,
) -> DataFrame:
    """One row of metrics per query, rounded to four places; queries without results have zeros."""
    matches = _matches(results, gt, match_media)
    judged = results.select("query_id", "rank").join(_best(matches), ["query_id", "rank"], "left")
    judged = judged.fillna(0.0, ["best_iou"]).withColumn("relevant", F.col("best_iou") >= threshold)
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    judged = judged.withColumn("_seen", F.sum(F.col("relevant").cast("int")).over(running))
    in_cut = F.col("relevant") & (F.col("rank") <= k) if k else F.col("relevant")
    per_query = judged.groupBy("query_id").agg(
        F.sum(F.when(in_cut, F.col("_seen") / F.col("rank"))).alias("_precisions"),
        (1.0 / F.min(F.when(F.col("relevant"), F.col("rank")))).alias("mrr"),
        F.avg("best_iou").alias("avg_iou"),
        F.avg(F.col("relevant").cast("int")).alias("precision_at_k"),
        F.count(F.lit(1)).alias("num_results"),
        F.count_if("relevant").alias("num_relevant"),
    )
    merged = (
        queries.select("query_id")
        .join(gt_counts(gt).withColumnRenamed("n_gt", "num_ground_truth"), "query_id", "left")
        .join(per_query, "query_id", "left")
        .join(_found(matches, threshold), "query_id", "left")
        .join(aspect_recall(results, gt), "query_id", "left")
    )
    ratios = {
        "map_at_k": F.col("_precisions") / F.col("num_ground_truth"),
        "mrr": F.col("mrr"),
        "avg_iou": F.col("avg_iou"),
        "aspect_recall": F.col("aspect_recall"),
        "precision_at_k": F.col("precision_at_k"),
        "recall": F.col("n_found") / F.col("num_ground_truth"),
    }
    counts = ("num_results", "num_ground_truth", "num_relevant")
    return merged.select(
        "query_id",
        *[F.round(F.coalesce(v, F.lit(0.0)), DIGITS).alias(n) for n, v in ratios.items()],
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts],
    )


def evaluate_all(metrics: DataFrame) -> DataFrame:
    """Means of the rounded metrics over all queries, and the grade of the mean average precision."""
    means = metrics.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg("map_at_k").alias("mean_map"),
        F.avg("mrr").alias("mean_mrr"),
        F.avg("avg_iou").alias("mean_iou"),
    )
    return means.withColumn("grade", grade(F.round("mean_map", 12)))


def eval_report(metrics: DataFrame) -> DataFrame:
    """Report lines per query: metric values with four decimals, counts, and the grade."""
    shown = ["map_at_k", "mrr", "precision_at_k", "recall", "avg_iou", "aspect_recall"]
    return metrics.select(
        "query_id",
        "num_results",
        "num_ground_truth",
        "num_relevant",
        *[F.format_string("%.4f", F.col(c)).alias(c) for c in shown],
        grade(F.col("map_at_k")).alias("grade"),
    )
