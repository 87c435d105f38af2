"""Whole searches: two sources, fusion, a track, final results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.operators.models import ALPHABET, encode_column, letter_profile, token_overlap
from reelgrid.plans.search import auto_track, candidates, semi_track
from reelgrid.spreading import stored
from reelgrid.workloads.fixtures import Tables
from reelgrid.workloads.registry import query
from reelgrid.workloads.search import BM25_SQL, _sql_tokens, documents, index

_PROFILE = """list_transform(range(97, 123), lambda c: (length(lower(text)) - length(replace(lower(text), chr(c::INTEGER), '')))::DOUBLE)"""
_UNIT = "list_transform(v, lambda x: (x / greatest(sqrt(list_dot_product(v, v)), 1e-8))::FLOAT::DOUBLE)"

FLOW_SQL = (
    "WITH "
    + BM25_SQL
    + f""",
dv AS (SELECT segment_id, {_UNIT} AS v FROM (SELECT doc_id AS segment_id, {_PROFILE} AS v FROM documents)),
qv AS (SELECT query_id, {_UNIT} AS v FROM (SELECT item_id AS query_id, {_PROFILE} AS v FROM benchmark)),
dense AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, segment_id) AS rank FROM (
    SELECT query_id, segment_id, list_dot_product(q.v, d.v) AS sim FROM qv q, dv d) QUALIFY rank <= 100),
lists AS (
  SELECT query_id, segment_id, rank, raw_score / best AS score, 0 AS list_no, 0.20::DOUBLE AS w FROM ranked WHERE rank <= 100
  UNION ALL SELECT query_id, segment_id, rank, (sim + 1) / 2, 1, 0.35::DOUBLE FROM dense),
found AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first_list, first_rank, segment_id) AS rank FROM (
    SELECT query_id, segment_id, sum(w / total / (60 + rank)) AS score, min(list_no) AS first_list, arg_min(rank, list_no) AS first_rank,
           coalesce(max(score) FILTER (list_no = 0), 0) AS sparse_score, coalesce(max(score) FILTER (list_no = 1), 0) AS dense_score,
           count(*) FILTER (score > 0) AS num_sources
    FROM lists JOIN (SELECT query_id, sum(w) AS total FROM lists WHERE rank = 1 GROUP BY query_id) USING (query_id)
    GROUP BY query_id, segment_id) QUALIFY rank <= 100),
qw AS (SELECT item_id AS query_id, list_distinct({_sql_tokens('text')}) AS qw FROM benchmark)"""
)


def found(t: Tables) -> DataFrame:
    """Fused candidates of the lexical index and of letter profiles as dense vectors, written once."""
    asked = t.text_queries()
    vectors = encode_column(documents(t), "text", letter_profile, ALPHABET).select("segment_id", "embedding")
    query_vectors = encode_column(asked, "original_query", letter_profile, ALPHABET)
    described = t.documents().select(
        "segment_id",
        F.concat(F.lit("doc_"), F.col("segment_id").cast("string"), F.lit(".mp4")).alias("video_file"),
        F.lit(0.0).alias("start_time"),
        F.lit(1.0).alias("end_time"),
        "text",
        F.lit("").alias("keyframe_path"),
    )
    source = "text_dense"
    fused = candidates(asked, described, index(t), {source: query_vectors}, {source: vectors})
    return stored(fused, "found")


@query(
    "auto_track",
    FLOW_SQL
    + """,
head AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, segment_id) AS r FROM (
    SELECT query_id, segment_id, num_sources, 1 / (1 + exp(-(len(list_intersect(qw, words)) / len(qw)::DOUBLE))) AS s
    FROM found JOIN doc USING (segment_id) JOIN qw USING (query_id) WHERE rank <= 20)),
verdicts AS (
  SELECT query_id, CASE WHEN s1 >= 0.7 OR s1 >= 0.4 AND (coalesce(s1 - s2 > 0.3, FALSE) OR n1 >= 3) THEN 'CORRECT'
                        WHEN s1 >= 0.4 THEN 'AMBIGUOUS' ELSE 'INCORRECT' END AS crag_verdict FROM (
    SELECT query_id, max(s) FILTER (r = 1) AS s1, max(s) FILTER (r = 2) AS s2, max(num_sources) FILTER (r = 1) AS n1 FROM head GROUP BY query_id))
SELECT query_id, segment_id, r AS rank, round(s, 6) AS score, num_sources, crag_verdict FROM head JOIN verdicts USING (query_id) WHERE r <= 5""",
)
def _auto_track(t: Tables) -> DataFrame:
    final = auto_track(t.text_queries(), found(t), token_overlap)
    return final.select("query_id", "segment_id", "rank", F.round("score", 6).alias("score"), "num_sources", "crag_verdict")


@query(
    "semi_track",
    FLOW_SQL
    + """,
blended AS (
  SELECT *, CASE WHEN rank > 20 THEN score WHEN sparse_score > 0 THEN 0.3 * score + 0.7 * sparse_score ELSE score END AS s FROM found),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank > 20, CASE WHEN rank <= 20 THEN -round(s, 9) ELSE rank END, segment_id) AS r FROM blended),
final AS (SELECT *, s > 0.85 OR num_sources = 2 AS keep FROM ordered WHERE r <= 5),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS k FROM (
  SELECT *, bool_or(keep) OVER (PARTITION BY query_id) AS any_kept FROM final) WHERE keep OR NOT any_kept),
verdicts AS (
  SELECT query_id, CASE WHEN round(m, 12) >= 0.7 THEN 'CORRECT' WHEN round(m, 12) >= 0.4 THEN 'AMBIGUOUS' ELSE 'INCORRECT' END AS crag_verdict
  FROM (SELECT query_id, avg(s) AS m FROM final WHERE r <= 3 GROUP BY query_id))
SELECT query_id, segment_id, k AS rank, round(s, 6) AS score, crag_verdict FROM kept JOIN verdicts USING (query_id)""",
)
def _semi_track(t: Tables) -> DataFrame:
    """Lexical scores stand for ratings; documents found by one source only are answered with no."""
    fused = found(t)
    key = ["query_id", "segment_id"]
    ratings = fused.where(F.col("sparse_score") > 0).select(*key, F.col("sparse_score").alias("rating"))
    answers = fused.select(*key, F.when(F.col("num_sources") == 2, "YES").otherwise("NO").alias("answer"))
    final = semi_track(fused, ratings, answers)
    return final.select(*key, "rank", F.round("score", 6).alias("score"), "crag_verdict")
