"""Relevance and metrics: purchases and sign-ups as results, clicks and views as ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.operators import relevance as rel
from reelgrid.operators.ranking import top_k
from reelgrid.schemas import TOP_K_RERANK
from reelgrid.workloads.fixtures import Tables, with_ctes
from reelgrid.workloads.registry import query

EVAL = """,
results AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, segment_id) AS rank FROM (
    SELECT media_id AS query_id, event_id AS segment_id, t AS ps, t_end AS pe, value AS score,
           CASE WHEN value > 20 THEN upper(event_type || ' k' || k) ELSE '' END AS text
    FROM tl WHERE event_type IN ('purchase', 'signup'))
  QUALIFY rank <= 20),
ious AS (
  SELECT query_id, rank, gt_id, CASE WHEN u <= 0 THEN 0 ELSE shared / u END AS iou FROM (
    SELECT *, (pe1 - ps) + (e1 - s0) - shared AS u FROM (
      SELECT *, greatest(0, least(pe1, e1) - greatest(ps, s0)) AS shared FROM (
        SELECT query_id, rank, gt_id, ps, s0, CASE WHEN pe <= ps THEN ps + 5 ELSE pe END AS pe1,
               CASE WHEN e0 <= s0 THEN s0 + 5 ELSE e0 END AS e1 FROM results JOIN gt USING (query_id))))),
rel AS (
  SELECT r.*, coalesce(best, 0) AS best_iou, coalesce(best, 0) >= 0.3 AS relevant
  FROM results r LEFT JOIN (SELECT query_id, rank, max(iou) AS best FROM ious GROUP BY ALL) USING (query_id, rank)),
ngt AS (SELECT query_id, count(*) AS n_gt FROM gt GROUP BY query_id),
ap AS (
  SELECT query_id, sum(CASE WHEN relevant THEN seen / rank END) AS s FROM (
    SELECT *, sum(relevant::INT) OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM rel) WHERE rank <= 5 GROUP BY query_id),
found AS (
  SELECT query_id, count(*) FILTER (hit) AS n_found FROM (
    SELECT query_id, gt_id, bool_or(iou >= 0.3) AS hit FROM ious GROUP BY ALL) GROUP BY query_id),
said AS (SELECT query_id, string_agg(lower(text), ' ' ORDER BY rank) AS said FROM results WHERE text <> '' GROUP BY query_id),
aspect AS (
  SELECT query_id, count(*) FILTER (contains(coalesce(said, ''), trim(lower(a))))::DOUBLE / count(*) AS aspect_recall
  FROM (SELECT query_id, unnest(aspects) AS a FROM gt) LEFT JOIN said USING (query_id) GROUP BY query_id),
per AS (
  SELECT query_id, 1.0::DOUBLE / min(rank) FILTER (relevant) AS rr, avg(best_iou) AS avg_iou, avg(relevant::INT) AS prec,
         count(*) AS num_results, count(*) FILTER (relevant) AS num_relevant FROM rel GROUP BY query_id),
metrics AS (
  SELECT m.media_id AS query_id, round(coalesce(s / n_gt, 0), 4) AS map_at_k, round(coalesce(rr, 0), 4) AS mrr,
         round(coalesce(avg_iou, 0), 4) AS avg_iou, round(coalesce(aspect_recall, 0), 4) AS aspect_recall,
         round(coalesce(prec, 0), 4) AS precision_at_k, round(coalesce(n_found / n_gt, 0), 4) AS recall,
         coalesce(num_results, 0) AS num_results, coalesce(n_gt, 0) AS num_ground_truth, coalesce(num_relevant, 0) AS num_relevant
  FROM media m LEFT JOIN ngt ON ngt.query_id = m.media_id LEFT JOIN ap ON ap.query_id = m.media_id
  LEFT JOIN per ON per.query_id = m.media_id LEFT JOIN found ON found.query_id = m.media_id
  LEFT JOIN aspect ON aspect.query_id = m.media_id)"""


def _sql(body: str) -> str:
    return with_ctes("tl media gt", "").rstrip() + EVAL + "\n" + body


def results(t: Tables) -> DataFrame:
    """Per media item its twenty results of highest value, as a search returns them."""
    found = t.timeline().where(F.col("event_type").isin("purchase", "signup"))
    text = F.upper(F.concat(F.col("event_type"), F.lit(" k"), F.col("k")))
    return top_k(
        found.select(
            F.col("media_id").alias("query_id"),
            F.col("event_id").alias("segment_id"),
            F.col("t").alias("start_time"),
            F.col("t_end").alias("end_time"),
            F.col("value").alias("score"),
            F.when(F.col("value") > 20, text).otherwise("").alias("text"),
        ),
        TOP_K_RERANK,
    )


def asked(t: Tables) -> DataFrame:
    return t.media().select(F.col("media_id").alias("query_id"))


def metrics(t: Tables) -> DataFrame:
    return rel.evaluate(results(t), t.ground_truth(), asked(t))


@query("iou_relevance", _sql("SELECT query_id, segment_id, rank, round(best_iou, 6) AS best_iou, relevant FROM rel"))
def _iou_relevance(t: Tables) -> DataFrame:
    judged = rel.relevance(results(t), t.ground_truth())
    return judged.select("query_id", "segment_id", "rank", F.round("best_iou", 6).alias("best_iou"), "relevant")


@query(
    "average_precision",
    _sql("SELECT query_id, round(coalesce(s, 0) / n_gt, 9) AS average_precision FROM ngt LEFT JOIN ap USING (query_id)"),
)
def _average_precision(t: Tables) -> DataFrame:
    gt = t.ground_truth()
    ap = rel.average_precision(rel.relevance(results(t), gt), gt)
    return ap.select("query_id", F.round("average_precision", 9).alias("average_precision"))


@query("reciprocal_rank", _sql("SELECT query_id, coalesce(rr, 0) AS reciprocal_rank FROM per"))
def _reciprocal_rank(t: Tables) -> DataFrame:
    return rel.reciprocal_rank(rel.relevance(results(t), t.ground_truth()))


@query("gt_found", _sql("SELECT query_id, coalesce(n_found, 0) AS n_found FROM ngt LEFT JOIN found USING (query_id)"))
def _gt_found(t: Tables) -> DataFrame:
    return rel.gt_found(results(t), t.ground_truth())


@query("aspect_recall", _sql("SELECT query_id, round(aspect_recall, 9) AS aspect_recall FROM aspect"))
def _aspect_recall(t: Tables) -> DataFrame:
    return rel.aspect_recall(results(t), t.ground_truth()).select(
        "query_id", F.round("aspect_recall", 9).alias("aspect_recall")
    )


@query("evaluate", _sql("SELECT * FROM metrics"))
def _evaluate(t: Tables) -> DataFrame:
    return metrics(t)


GRADE = "CASE WHEN {m} >= 0.7 THEN 'excellent' WHEN {m} >= 0.5 THEN 'good' WHEN {m} >= 0.3 THEN 'fair' ELSE 'needs improvement' END"


@query(
    "evaluate_all",
    _sql(
        f"""SELECT count(*) AS n_queries, round(avg(map_at_k), 9) AS mean_map, round(avg(mrr), 9) AS mean_mrr,
  round(avg(avg_iou), 9) AS mean_iou, {GRADE.format(m='avg(map_at_k)')} AS grade FROM metrics"""
    ),
)
def _evaluate_all(t: Tables) -> DataFrame:
    means = rel.evaluate_all(metrics(t))
    rounded = [F.round(c, 9).alias(c) for c in ("mean_map", "mean_mrr", "mean_iou")]
    return means.select("n_queries", *rounded, "grade")


@query(
    "eval_report",
    _sql(
        f"""SELECT query_id, num_results, num_ground_truth, num_relevant, printf('%.4f', map_at_k) AS map_at_k, printf('%.4f', mrr) AS mrr,
  printf('%.4f', precision_at_k) AS precision_at_k, printf('%.4f', recall) AS recall, printf('%.4f', avg_iou) AS avg_iou,
  printf('%.4f', aspect_recall) AS aspect_recall, {GRADE.format(m='map_at_k')} AS grade FROM metrics"""
    ),
)
def _eval_report(t: Tables) -> DataFrame:
    return rel.eval_report(metrics(t))
