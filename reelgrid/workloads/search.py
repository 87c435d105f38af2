"""Lexical and vector search, fusion and labelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.functions.text import NOT_WORD, SPACES
from reelgrid.functions.vector import norm
from reelgrid.operators import vectors as vec
from reelgrid.operators.blockmax import read_block_index, search_blocks, write_block_index
from reelgrid.operators.cells import build_cells, read_cells, search_cells, write_cells
from reelgrid.operators.fusion import attach_segments, retrieve, rrf_fuse
from reelgrid.operators.lexical import LexicalIndex, bm25_search, bm25_stats, build_postings, with_tokens
from reelgrid.operators.models import encode_column, letter_profile, score_pairs, token_overlap
from reelgrid.operators.ranking import top_k, union_rank
from reelgrid.operators.rerank import rerank
from reelgrid.plans import upkeep
from reelgrid.schemas import TOP_K_FINAL, TOP_K_RERANK
from reelgrid.sources.tables import read_lexical_index, result_output, write_lexical_index
from reelgrid.spreading import scratch_path, spread, stored
from reelgrid.workloads.fixtures import Tables, whole_entries, with_ctes
from reelgrid.workloads.registry import query


def _sql_tokens(column: str) -> str:
    cleaned = f"regexp_replace(lower({column}), '{NOT_WORD}', '', 'g')"
    return f"list_filter(string_split_regex({cleaned}, '{SPACES}'), lambda x: x <> '')"


BM25_SQL = f"""
doc AS MATERIALIZED (SELECT doc_id AS segment_id, text, {_sql_tokens('text')} AS words FROM documents),
tf AS MATERIALIZED (
  SELECT segment_id, token, count(*) AS tf, any_value(doc_len) AS doc_len
  FROM (SELECT segment_id, len(words) AS doc_len, unnest(words) AS token FROM doc) GROUP BY segment_id, token),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(len(words)) AS avg_len FROM doc),
raw AS (SELECT token, count(*) AS df, ln((SELECT n FROM corpus) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw_idf
        FROM tf GROUP BY token),
idf AS (SELECT token, df, CASE WHEN raw_idf < 0 THEN 0.25 * (SELECT avg(raw_idf) FROM raw) ELSE raw_idf END AS idf FROM raw),
q AS (SELECT query_id, token, count(*) AS weight FROM (
        SELECT item_id AS query_id, unnest({_sql_tokens('text')}) AS token FROM benchmark) GROUP BY query_id, token),
scored AS (
  SELECT query_id, segment_id,
         sum(weight * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * doc_len / (SELECT avg_len FROM corpus)))) AS raw_score
  FROM q JOIN idf USING (token) JOIN tf USING (token) GROUP BY query_id, segment_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw_score, 9) DESC, segment_id) AS rank,
         max(raw_score) OVER (PARTITION BY query_id) AS best
  FROM scored WHERE raw_score > 0)"""


def documents(t: Tables) -> DataFrame:
    return spread(t.documents(), "segment_id")


def index(t: Tables) -> LexicalIndex:
    """The lexical index of the documents, written and read again."""
    path = scratch_path(t.spark, "lexical")
    write_lexical_index(stored(build_postings(documents(t)), "postings"), path)
    return read_lexical_index(t.spark, path)


@query(
    "tokens",
    f"""SELECT doc_id AS segment_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct, md5(array_to_string(w, ' ')) AS tokens_md5
  FROM (SELECT doc_id, {_sql_tokens('text')} AS w FROM documents)""",
)
def _tokens(t: Tables) -> DataFrame:
    return with_tokens(documents(t), "text").select(
        "segment_id",
        F.size("tokens").alias("n_tokens"),
        F.size(F.array_distinct("tokens")).alias("n_distinct"),
        F.md5(F.array_join("tokens", " ")).alias("tokens_md5"),
    )


@query("postings", "WITH " + BM25_SQL + "\nSELECT segment_id, token, tf, doc_len FROM tf")
def _postings(t: Tables) -> DataFrame:
    return index(t).entries


@query(
    "bm25_idf",
    f"""WITH held AS (SELECT unnest(list_distinct({_sql_tokens('text')})) AS token FROM documents),
n AS (SELECT count(*)::DOUBLE AS n FROM documents),
raw AS (SELECT token, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw_idf FROM (SELECT token, count(*) AS df FROM held GROUP BY token), n),
mean AS (SELECT avg(raw_idf) AS m FROM raw)
SELECT token, df, round(CASE WHEN raw_idf < 0 THEN 0.25 * m ELSE raw_idf END, 6) AS idf FROM raw, mean""",
)
def _bm25_idf(t: Tables) -> DataFrame:
    """Word counts alone: the figures need no index in the order of its words."""
    idf = bm25_stats(stored(build_postings(documents(t)), "postings"))[1]
    return idf.select("token", "df", F.round("idf", 6).alias("idf"))


@query(
    "bm25_topk",
    "WITH " + BM25_SQL + """
SELECT query_id, segment_id, rank, round(raw_score, 6) AS raw_score, round(raw_score / best, 6) AS score
FROM ranked WHERE rank <= 100""",
)
def _bm25_topk(t: Tables) -> DataFrame:
    hits = bm25_search(t.text_queries(), index(t))
    return hits.select(
        "query_id", "segment_id", "rank", F.round("raw_score", 6).alias("raw_score"), F.round("score", 6).alias("score")
    )


@query(
    "bm25_blocks",
    "WITH " + BM25_SQL + """
SELECT query_id, segment_id, rank, round(raw_score, 6) AS raw_score, round(raw_score / best, 6) AS score
FROM ranked WHERE rank <= 5""",
)
def _bm25_blocks(t: Tables) -> DataFrame:
    """The best five from an index of blocks with their maxima, written and read again."""
    path = scratch_path(t.spark, "blocks")
    write_block_index(stored(build_postings(documents(t)), "postings"), path, docs_per_range=64)
    hits = search_blocks(t.text_queries(), read_block_index(t.spark, path), k=TOP_K_FINAL)
    return hits.select(
        "query_id", "segment_id", "rank", F.round("raw_score", 6).alias("raw_score"), F.round("score", 6).alias("score")
    )


@query(
    "index_upkeep",
    "WITH " + BM25_SQL + """
SELECT query_id, segment_id, rank, round(raw_score, 6) AS raw_score, round(raw_score / best, 6) AS score
FROM ranked WHERE rank <= 5""",
)
def _index_upkeep(t: Tables) -> DataFrame:
    """The best five from an index kept up by batches: all documents are in it, as if it had been built at once.

    Some come late, some first come with another text, some are removed and added again; then the first part, of
    which more than a fifth is dead, is written again, and what no version reads any more is deleted.
    """
    path = scratch_path(t.spark, "upkeep")
    docs = documents(t).select(F.col("segment_id").cast("string").alias("media_id"), "segment_id", "text")
    group = F.pmod("segment_id", F.lit(10))
    outdated = F.when(group == 1, F.reverse("text")).otherwise(F.col("text"))
    upkeep.commit(t.spark, path, docs.where(group != 9).withColumn("text", outdated))
    upkeep.commit(t.spark, path, docs.where(group.isin(1, 9)))
    upkeep.commit(t.spark, path, removed=docs.where(group == 3))
    upkeep.commit(t.spark, path, docs.where(group == 3))
    upkeep.compact(t.spark, path, dead_share=0.2)
    upkeep.vacuum(t.spark, path, keep=1)
    hits = bm25_search(t.text_queries(), upkeep.read_index(t.spark, path).lexical, k=TOP_K_FINAL)
    return hits.select(
        "query_id", "segment_id", "rank", F.round("raw_score", 6).alias("raw_score"), F.round("score", 6).alias("score")
    )


@query(
    "search_lexical",
    "WITH " + BM25_SQL + """
SELECT query_id, rank, segment_id, 'doc_' || segment_id || '.mp4' AS video_file, segment_id::DOUBLE AS start_time,
  segment_id + 1::DOUBLE AS end_time, md5(text) AS text, round(raw_score / best, 4) AS score, 'text_sparse' AS source,
  CASE WHEN segment_id >= 3600 THEN printf('%02d:%02d:%02d', segment_id // 3600, segment_id % 3600 // 60, segment_id % 60)
       ELSE printf('%02d:%02d', segment_id // 60, segment_id % 60) END AS time_display, '' AS keyframe_path
FROM ranked JOIN doc USING (segment_id) WHERE rank <= 5""",
)
def search_lexical(t: Tables) -> DataFrame:
    """Shown results of lexical search; texts are returned as digests to keep the rows short."""
    found = top_k_of(bm25_search(t.text_queries(), index(t)), TOP_K_FINAL)
    described = t.documents().select(
        "segment_id",
        F.concat(F.lit("doc_"), F.col("segment_id").cast("string"), F.lit(".mp4")).alias("video_file"),
        F.col("segment_id").cast("double").alias("start_time"),
        (F.col("segment_id") + 1).cast("double").alias("end_time"),
        "text",
        F.lit("").alias("keyframe_path"),
    )
    shown = result_output(attach_segments(found, described))
    return shown.withColumn("text", F.md5("text"))


def top_k_of(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.where(F.col("rank") <= k)


@query(
    "score_pairs",
    "WITH " + BM25_SQL + f"""
SELECT query_id, segment_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, segment_id) AS rank,
  round(score, 6) AS score, round(logit, 6) AS rerank_raw FROM (
  SELECT query_id, segment_id, logit, 1 / (1 + exp(-logit)) AS score FROM (
    SELECT query_id, segment_id, len(list_intersect(qw, words)) / len(qw)::DOUBLE AS logit
    FROM ranked JOIN doc USING (segment_id)
    JOIN (SELECT item_id AS query_id, list_distinct({_sql_tokens('text')}) AS qw FROM benchmark) USING (query_id)
    WHERE rank <= 20))""",
)
def _score_pairs(t: Tables) -> DataFrame:
    found = stored(top_k_of(bm25_search(t.text_queries(), index(t)), TOP_K_RERANK), "candidates")
    asked = found.join(t.documents(), "segment_id").join(
        t.text_queries().select("query_id", F.col("original_query").alias("query")), "query_id"
    )
    ordered = rerank(found, score_pairs(asked, token_overlap))
    return ordered.select(
        "query_id", "segment_id", "rank", F.round("score", 6).alias("score"), F.round("rerank_raw", 6).alias("rerank_raw")
    )


@query(
    "encode_column",
    """WITH counted AS (
  SELECT doc_id, len(text) AS n, list_transform(range(97, 123), lambda c: (length(lower(text)) - length(replace(lower(text), chr(c::INTEGER), '')))::DOUBLE) AS v
  FROM documents)
SELECT doc_id AS segment_id, 26 AS dim, array_to_string(list_transform(v, lambda x:
  CAST(round((x / greatest(sqrt(list_dot_product(v, v)), 1e-8))::FLOAT::DOUBLE * 10000) AS BIGINT)), ',') AS shares FROM counted""",
)
def _encode_column(t: Tables) -> DataFrame:
    encoded = encode_column(documents(t), "text", letter_profile, 26)
    return encoded.select(
        "segment_id",
        F.size("embedding").alias("dim"),
        whole_entries("embedding", 10_000).alias("shares"),
    )


@query(
    "vector_topk",
    with_ctes(
        "vec label_means asked hits",
        """SELECT query_id, segment_id, rank, round(sim, 6) AS similarity, round(score, 6) AS score
  FROM hits WHERE source = 'text_dense'""",
    ),
)
def _vector_topk(t: Tables) -> DataFrame:
    hits = vec.vector_search(t.query_vectors()["text_dense"], t.vectors(), "text_dense", clamp=False)
    return hits.select(
        "query_id", "segment_id", "rank", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score")
    )


@query(
    "vector_topk_all",
    """WITH vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS segment_id, list_dot_product(a.v, b.v) AS sim FROM vec a, vec b WHERE a.vec_id % 50 = 0)
SELECT query_id, segment_id, rank, round(greatest(0, least(1, (sim + 1) / 2)), 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, segment_id) AS rank FROM pairs) WHERE rank <= 5""",
)
def _vector_topk_all(t: Tables) -> DataFrame:
    """Every fiftieth vector against all, in blocks of query vectors instead of one pass."""
    vectors = t.vectors()
    asked = vectors.where("segment_id % 50 = 0").withColumnRenamed("segment_id", "query_id")
    block = min(vec.MAX_SENT_VECTORS, max(1, vectors.count() // 100))
    hits = vec.vector_search(asked, vectors, "visual", k=TOP_K_FINAL, max_sent=block)
    return hits.select("query_id", "segment_id", "rank", F.round("score", 6).alias("score"))


@query(
    "vector_topk_cells",
    """WITH vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS segment_id, list_dot_product(a.v, b.v) AS sim FROM vec a, vec b WHERE a.vec_id % 50 = 0)
SELECT query_id, segment_id, rank, round(sim, 6) AS similarity, round(greatest(0, least(1, (sim + 1) / 2)), 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, segment_id) AS rank FROM pairs) WHERE rank <= 5""",
)
def _vector_topk_cells(t: Tables) -> DataFrame:
    """Every fiftieth vector against all, from an index by cells that is written and read again."""
    vectors, path = t.vectors(), scratch_path(t.spark, "cells")
    write_cells(build_cells(vectors), path)
    asked = vectors.where("segment_id % 50 = 0").withColumnRenamed("segment_id", "query_id")
    hits = search_cells(asked, read_cells(t.spark, path), "visual", k=TOP_K_FINAL)
    return hits.select(
        "query_id", "segment_id", "rank", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score")
    )


@query(
    "vector_normalize",
    """SELECT vec_id AS segment_id,
  array_to_string(list_transform(v, lambda x: CAST(round(x / greatest(sqrt(list_dot_product(v, v)), 1e-8) * 1000000) AS BIGINT)), ',') AS entries,
  round(sqrt(list_dot_product(v, v)) / greatest(sqrt(list_dot_product(v, v)), 1e-8), 6) AS norm FROM (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * vec_id) AS v FROM embeddings)""",
)
def _vector_normalize(t: Tables) -> DataFrame:
    scaled = t.vectors().withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * F.col("segment_id")))
    unit = vec.l2_normalize(scaled)
    return unit.select(
        "segment_id",
        whole_entries("embedding").alias("entries"),
        F.round(norm(F.col("embedding")), 6).alias("norm"),
    )


@query(
    "conform_dim",
    """SELECT vec_id AS segment_id, 48 AS cut, 80 AS padded, array_to_string(e[1:48], ',') AS cut_entries,
  array_to_string(list_concat(e, list_transform(range(len(e), 80), lambda i: 0::BIGINT)), ',') AS padded_entries FROM (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 1000000) AS BIGINT)) AS e FROM embeddings)""",
)
def _conform_dim(t: Tables) -> DataFrame:
    both = vec.conform_dim(
        vec.conform_dim(t.vectors().withColumn("longer", F.col("embedding")), 48), 80, col="longer"
    )
    return both.select(
        "segment_id",
        F.size("embedding").alias("cut"),
        F.size("longer").alias("padded"),
        whole_entries("embedding").alias("cut_entries"),
        whole_entries("longer").alias("padded_entries"),
    )


@query(
    "dim_audit",
    """SELECT 'label_' || label AS modality, len(embedding) AS dim, count(*) AS n_vectors FROM embeddings GROUP BY ALL""",
)
def _dim_audit(t: Tables) -> DataFrame:
    modality = F.concat(F.lit("label_"), F.col("label").cast("string")).alias("modality")
    return vec.dim_audit(t["embeddings"].select(modality, "embedding"))


@query(
    "vector_metadata",
    """SELECT 'label_' || label AS modality, count(*) AS n_vectors, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim
  FROM embeddings GROUP BY ALL""",
)
def _vector_metadata(t: Tables) -> DataFrame:
    modality = F.concat(F.lit("label_"), F.col("label").cast("string")).alias("modality")
    return vec.vector_metadata(t["embeddings"].select(modality, "embedding"))


LABEL_SQL = with_ctes(
    "vec label_means",
    """, unit AS (SELECT label, list_transform(v , lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-8)) AS v FROM label_means),
sims AS (
  SELECT x.segment_id, u.label, exp(list_dot_product(list_transform(x.v, lambda e: e / (sqrt(list_dot_product(x.v, x.v)) + 1e-8)), u.v)) AS w
  FROM vec x, unit u),
shares AS (SELECT *, w / sum(w) OVER (PARTITION BY segment_id) AS p FROM sims)
SELECT segment_id, coalesce(string_agg('label_' || label, '|' ORDER BY label) FILTER (round(p, 12) >= 0.105), '') AS labels
FROM shares GROUP BY segment_id""".lstrip(),
).replace("\n, unit", ", unit")


def _labels(t: Tables, **options: int) -> DataFrame:
    unit = vec.l2_normalize(t.label_means())
    labels = unit.select(
        F.col("label").alias("pos"), F.concat(F.lit("label_"), F.col("label").cast("string")).alias("label"), "embedding"
    )
    labels = labels.withColumn("pos", F.col("pos").cast("bigint"))
    found = vec.zero_shot_labels(t.vectors(), labels, threshold=0.105, **options)
    return found.withColumn("labels", F.array_join("labels", "|"))


@query("zero_shot_labels", LABEL_SQL)
def _zero_shot_labels(t: Tables) -> DataFrame:
    return _labels(t)


@query("zero_shot_labels_blocks", LABEL_SQL)
def _zero_shot_labels_blocks(t: Tables) -> DataFrame:
    """The same through blocks of labels, as for label sets too large to send at once."""
    return _labels(t, max_sent=2)


def hits(t: Tables) -> DataFrame:
    """Three lists per label from vector search."""
    asked = t.query_vectors()
    return retrieve(t.text_queries(), None, asked, {source: t.vectors() for source in asked})


def fused(t: Tables) -> DataFrame:
    return rrf_fuse(hits(t))


HITS_CTES = "vec label_means asked hits"
FUSED_CTES = HITS_CTES + " fused"


@query(
    "retrieve_lists",
    with_ctes(HITS_CTES, "SELECT query_id, source, segment_id, rank, round(score, 6) AS score FROM hits"),
)
def _retrieve(t: Tables) -> DataFrame:
    return hits(t).select("query_id", "source", "segment_id", "rank", F.round("score", 6).alias("score"))


@query(
    "rrf_fusion",
    with_ctes(
        FUSED_CTES,
        """SELECT query_id, segment_id, rank, round(score, 9) AS score, round(dense_score, 6) AS dense_score, 0 AS sparse_score,
  round(visual_score, 6) AS visual_score, round(audio_score, 6) AS audio_score, 0 AS temporal_score, num_sources FROM fused""",
    ),
)
def _rrf_fusion(t: Tables) -> DataFrame:
    components = ("dense_score", "sparse_score", "visual_score", "audio_score", "temporal_score")
    return fused(t).select(
        "query_id",
        "segment_id",
        "rank",
        F.round("score", 9).alias("score"),
        *[F.round(c, 6).alias(c) for c in components],
        "num_sources",
    )


@query(
    "top_k_cut",
    with_ctes(FUSED_CTES, "SELECT query_id, segment_id, rank FROM fused WHERE rank <= 20"),
)
def _top_k(t: Tables) -> DataFrame:
    return top_k(fused(t), TOP_K_RERANK, [F.col("rank")]).select("query_id", "segment_id", "rank")


@query(
    "union_rank",
    with_ctes(
        HITS_CTES,
        """SELECT query_id, source, segment_id, rank FROM (
  SELECT query_id, source, segment_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, segment_id, source) AS rank
  FROM hits WHERE source IN ('text_dense', 'visual')) WHERE rank <= 50""",
    ),
)
def _union_rank(t: Tables) -> DataFrame:
    asked = t.query_vectors()
    lists = [
        vec.vector_search(asked[s], t.vectors(), s).select("query_id", "source", "segment_id", "score")
        for s in ("text_dense", "visual")
    ]
    return union_rank(*lists, k=50).select("query_id", "source", "segment_id", "rank")
