"""Reranking, rescoring and verdicts over fused lists of the embedding table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.operators import rerank as rr
from reelgrid.operators import verdict as vd
from reelgrid.operators.ranking import splice
from reelgrid.schemas import TOP_K_FINAL, TOP_K_RERANK
from reelgrid.spreading import stored
from reelgrid.workloads.fixtures import Tables, with_ctes
from reelgrid.workloads.registry import query
from reelgrid.workloads.search import FUSED_CTES, fused

RES = """,
res AS (
  SELECT query_id, segment_id, dense_score, visual_score, audio_score, num_sources, text, logit, 1 / (1 + exp(-logit)) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(1 / (1 + exp(-logit)), 9) DESC, segment_id) AS rank
  FROM (SELECT *, CASE WHEN num_sources > 1 THEN 'vec ' || segment_id ELSE '' END AS text,
               8 * dense_score + 2 * visual_score + audio_score - 6.2 - query_id * 0.1::DOUBLE AS logit
        FROM fused WHERE rank <= 20))"""


def candidates(t: Tables) -> DataFrame:
    """The fused head, written once: retrieval is the costly part and later steps read it repeatedly."""
    text = F.when(F.col("num_sources") > 1, F.concat(F.lit("vec "), F.col("segment_id").cast("string")))
    head = fused(t).where(F.col("rank") <= TOP_K_RERANK)
    return stored(head.withColumn("text", F.coalesce(text, F.lit(""))), "candidates")


def reranked(t: Tables) -> DataFrame:
    """The fused head ordered by pair scores made from its component scores."""
    head = candidates(t)
    logit = (
        8 * F.col("dense_score") + 2 * F.col("visual_score") + F.col("audio_score") - 6.2 - F.col("query_id") * 0.1
    )
    return rr.rerank(head, head.select("query_id", "segment_id", logit.alias("logit")))


def _sql(body: str, more: str = "") -> str:
    return with_ctes(FUSED_CTES, "").rstrip() + RES + more + "\n" + body


def _ranked(columns: str, score: str, source: str = "res", order: str | None = None) -> str:
    by = order or "round(new_score, 9) DESC, segment_id"
    return f"""SELECT query_id, segment_id, row_number() OVER (PARTITION BY query_id ORDER BY {by}) AS rank,
  round(new_score, 6) AS score{columns} FROM (SELECT *, {score} AS new_score FROM {source})"""


def _shown(results: DataFrame, *columns: str) -> DataFrame:
    return results.select("query_id", "segment_id", "rank", F.round("score", 6).alias("score"), *columns)


@query("rerank", _sql("SELECT query_id, segment_id, rank, round(score, 6) AS score, round(logit, 6) AS rerank_raw FROM res"))
def _rerank(t: Tables) -> DataFrame:
    return _shown(reranked(t), F.round("rerank_raw", 6).alias("rerank_raw"))


@query(
    "blend_scores",
    _sql(
        _ranked(
            ", round(rating, 6) AS rerank_score",
            "CASE WHEN num_sources >= 2 THEN 0.3 * score + 0.7 * audio_score ELSE score END",
            "(SELECT *, CASE WHEN num_sources >= 2 THEN audio_score ELSE 0 END AS rating FROM res)",
        )
    ),
)
def _blend_scores(t: Tables) -> DataFrame:
    results = reranked(t)
    ratings = results.where(F.col("num_sources") >= 2).select(
        "query_id", "segment_id", F.col("audio_score").alias("rating")
    )
    return _shown(rr.blend_scores(results, ratings), F.round("rerank_score", 6).alias("rerank_score"))


@query(
    "feedback_rescore",
    _sql(
        _ranked(
            ", user_feedback",
            "score * CASE user_feedback WHEN 'positive' THEN 1.3::DOUBLE WHEN 'negative' THEN 0.5::DOUBLE ELSE 1::DOUBLE END",
            """(SELECT *, CASE WHEN rank > 3 THEN NULL WHEN num_sources < 2 THEN 'skipped'
        WHEN visual_score > 0.6 THEN 'positive' ELSE 'negative' END AS user_feedback FROM res)""",
        )
    ),
)
def _feedback_rescore(t: Tables) -> DataFrame:
    results = reranked(t)
    feedback = results.where(F.col("num_sources") >= 2).select(
        "query_id", "segment_id", (F.col("visual_score") > 0.6).alias("relevant")
    )
    return _shown(rr.apply_feedback(results, feedback), "user_feedback")


@query(
    "verify_penalty",
    _sql(
        _ranked(
            ", verified",
            "CASE WHEN verified = FALSE THEN score * 0.8::DOUBLE ELSE score END",
            """(SELECT *, CASE WHEN rank <= 3 AND text <> '' AND dense_score > 0
        THEN coalesce(CASE WHEN audio_score > 0 THEN visual_score > 0.6 END, FALSE) END AS verified FROM res)""",
        )
    ),
)
def _verify_penalty(t: Tables) -> DataFrame:
    results = reranked(t)
    answers = results.where(F.col("dense_score") > 0).select(
        "query_id",
        "segment_id",
        F.when(F.col("audio_score") > 0, F.col("visual_score") > 0.6).alias("verified"),
        F.lit(None).cast("double").alias("confidence"),
    )
    return _shown(rr.apply_verification(results, answers), "verified")


@query(
    "verify_gate",
    _sql(
        """SELECT query_id, segment_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, round(score, 6) AS score
  FROM (SELECT *, bool_or(keep) OVER (PARTITION BY query_id) AS any_kept
        FROM (SELECT *, score > 0.85 OR num_sources = 1 AND query_id < 3 OR num_sources = 3 AND query_id < 6 AS keep FROM res))
  WHERE keep OR NOT any_kept"""
    ),
)
def _verify_gate(t: Tables) -> DataFrame:
    results = reranked(t)
    sources, asked = F.col("num_sources"), F.col("query_id")
    answer = F.when((sources == 3) & (asked < 6), "Yes, it is").otherwise("no")
    answers = results.where((sources > 1) | (asked >= 3)).select("query_id", "segment_id", answer.alias("answer"))
    return _shown(rr.verify_gate(results, answers))


VERDICT = """CASE WHEN {s} >= 0.7 THEN 'CORRECT' WHEN {s} >= 0.4 THEN 'AMBIGUOUS' ELSE 'INCORRECT' END"""


@query(
    "fast_verdict",
    _sql(
        f"""SELECT query_id, round(s1, 6) AS top_score, CASE WHEN v = 'AMBIGUOUS' AND (coalesce(s1 - s2 > 0.3, FALSE) OR n1 >= 3)
  THEN 'CORRECT' ELSE v END AS verdict FROM (
  SELECT *, {VERDICT.format(s='s1')} AS v FROM (
    SELECT query_id, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2,
           max(num_sources) FILTER (rank = 1) AS n1 FROM res GROUP BY query_id))"""
    ),
)
def _fast_verdict(t: Tables) -> DataFrame:
    return vd.fast_verdict(reranked(t)).select("query_id", F.round("top_score", 6).alias("top_score"), "verdict")


@query(
    "hybrid_verdict",
    _sql(
        f"""SELECT query_id, segment_id, rank, round(score, 6) AS score, first_value(CASE WHEN v = 'AMBIGUOUS' AND
  (coalesce(score - nxt > 0.3, FALSE) OR num_sources >= 3) THEN 'CORRECT' ELSE v END) OVER (PARTITION BY query_id ORDER BY rank) AS crag_verdict
  FROM (SELECT *, {VERDICT.format(s='score')} AS v, lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS nxt FROM res)
  QUALIFY rank <= 5"""
    ),
)
def _hybrid_verdict(t: Tables) -> DataFrame:
    results = reranked(t)
    judged = vd.with_verdict(results, vd.fast_verdict(results))
    return _shown(judged.where(F.col("rank") <= TOP_K_FINAL), "crag_verdict")


@query(
    "mean_verdict",
    _sql(
        f"""SELECT query_id, round(m, 6) AS mean_score, {VERDICT.format(s='round(m, 12)')} AS verdict
  FROM (SELECT query_id, avg(score) AS m FROM res WHERE rank <= 3 GROUP BY query_id)"""
    ),
)
def _mean_verdict(t: Tables) -> DataFrame:
    return vd.mean_verdict(reranked(t)).select("query_id", F.round("mean_score", 6).alias("mean_score"), "verdict")


@query(
    "top_verdict",
    _sql(
        f"""SELECT label::BIGINT AS query_id, round(score, 6) AS top_score, {VERDICT.format(s='coalesce(score, 0)')} AS verdict,
  score IS NULL OR (score >= 0.4 AND score < 0.7) AS reformulate
  FROM (SELECT label FROM vec UNION SELECT label + 1000 FROM vec) l LEFT JOIN (SELECT * FROM res WHERE rank = 1) r ON r.query_id = l.label"""
    ),
)
def _top_verdict(t: Tables) -> DataFrame:
    labels = t["embeddings"].select(F.col("label").cast("bigint").alias("query_id"))
    asked = labels.union(labels.select(F.col("query_id") + 1000)).distinct()  # half of them have no results
    return vd.top_verdict(reranked(t), asked).select(
        "query_id", F.round("top_score", 6).alias("top_score"), "verdict", "reformulate"
    )


ROUNDS = """,
rounds AS (
  SELECT *, 0 AS round, row_number() OVER (PARTITION BY query_id ORDER BY round(dense_score, 9) DESC, segment_id) AS r, dense_score AS s FROM res
  UNION ALL SELECT *, 1, row_number() OVER (PARTITION BY query_id ORDER BY round(score * 1.1, 9) DESC, segment_id), score * 1.1::DOUBLE FROM res
  UNION ALL SELECT *, 2, row_number() OVER (PARTITION BY query_id ORDER BY round(visual_score, 9) DESC, segment_id), visual_score FROM res),
means AS (SELECT query_id, round, avg(s) AS m FROM rounds WHERE r <= 3 GROUP BY query_id, round)"""


def _rounds(t: Tables) -> DataFrame:
    scores = [F.col("dense_score"), F.col("score") * 1.1, F.col("visual_score")]
    variants = F.array(*[F.struct(F.lit(i).alias("round"), s.alias("score")) for i, s in enumerate(scores)])
    rounds = reranked(t).select("query_id", "segment_id", F.inline(variants))
    return rr.with_rank(rounds, per=("query_id", "round"))


@query(
    "best_round",
    _sql(
        """SELECT query_id, segment_id, r AS rank, round, round(s, 6) AS score FROM rounds JOIN (
  SELECT query_id, coalesce(min(round) FILTER (round(m, 12) >= 0.7), arg_max(round, round(m, 12) * 1000 - round / 1e9)) AS round
  FROM means GROUP BY query_id) USING (query_id, round)""",
        ROUNDS,
    ),
)
def _best_round(t: Tables) -> DataFrame:
    return _shown(vd.best_round(_rounds(t)), "round")


@query(
    "best_round_compat",
    _sql(
        """SELECT query_id, segment_id, r AS rank, round, round(s, 6) AS score FROM rounds JOIN (
  SELECT query_id, arg_max(round, (CASE WHEN round = 0 AND m < 0.7 THEN 0 ELSE round(m, 12) END) * 1000 - round / 1e9) AS round
  FROM (SELECT *, min(CASE WHEN round(m, 12) >= 0.7 THEN round END) OVER (PARTITION BY query_id) AS stop FROM means)
  WHERE stop IS NULL OR round <= stop GROUP BY query_id) USING (query_id, round)""",
        ROUNDS,
    ),
)
def _best_round_compat(t: Tables) -> DataFrame:
    return _shown(vd.best_round(_rounds(t), compat=True), "round")


@query(
    "head_tail",
    _sql(
        """SELECT query_id, segment_id, row_number() OVER (PARTITION BY query_id ORDER BY tier, CASE WHEN tier = 0 THEN -round(score, 9) ELSE rank END, segment_id) AS rank, tier
  FROM (SELECT query_id, segment_id, rank, score, 0 AS tier FROM res
        UNION ALL SELECT query_id, segment_id, rank, score, 1 FROM fused WHERE rank > 20 AND rank <= 100)"""
    ),
)
def _head_tail(t: Tables) -> DataFrame:
    tail = fused(t).where((F.col("rank") > TOP_K_RERANK) & (F.col("rank") <= 100))
    return splice(reranked(t), tail).select("query_id", "segment_id", "rank", "tier")
