"""Query tables, stored responses, and ingest bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.functions.text import clock
from reelgrid.operators import fanout as fo
from reelgrid.operators import stats as st
from reelgrid.operators.lexical import build_postings, indexable_text
from reelgrid.sources import tables as tb
from reelgrid.spreading import scratch_path
from reelgrid.workloads.fixtures import Tables, whole_entries, with_ctes
from reelgrid.workloads.registry import query
from reelgrid.workloads.timeline import ALL_CELLS, segments

SUB = ("visual", "temporal", "audio", "ocr", "text")


def _queries(t: Tables) -> DataFrame:
    """Benchmark texts as queries whose sub-queries are present, empty or missing by the text's length."""
    n = F.length("text")
    part = F.lower("text")
    return t["benchmark"].select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("original_query"),
        F.when(n >= 150, F.when(n >= 200, part).otherwise("")).alias("visual_query"),
        F.when(n >= 150, F.when(n >= 250, part).otherwise("")).alias("temporal_query"),
        F.when(n >= 150, F.when(n >= 200, part).otherwise("")).alias("audio_query"),
        F.when(n >= 150, F.lit("")).alias("ocr_query"),
        F.when(n >= 150, part).alias("text_query"),
        F.when(n >= 250, "entity_specific").when(n >= 200, "action").otherwise("other").alias("query_type"),
    )


FANNED = """WITH q AS (SELECT item_id AS query_id, text AS o, length(text) AS n, lower(text) AS p FROM benchmark),
fanned AS (
  SELECT query_id, o, n, CASE WHEN n >= 200 THEN p ELSE o END AS visual_query, CASE WHEN n >= 250 THEN p ELSE o END AS temporal_query,
         CASE WHEN n < 150 THEN o WHEN n >= 200 THEN p ELSE '' END AS audio_query, CASE WHEN n < 150 THEN o ELSE '' END AS ocr_query,
         CASE WHEN n < 150 THEN o ELSE p END AS text_query,
         CASE WHEN n >= 250 THEN 'entity_specific' WHEN n >= 200 THEN 'action' ELSE 'general' END AS query_type FROM q)
"""


@query(
    "query_fanout",
    FANNED + "SELECT query_id, o AS original_query, visual_query, temporal_query, audio_query, ocr_query, text_query, query_type FROM fanned",
)
def _query_fanout(t: Tables) -> DataFrame:
    return fo.fan_out_queries(_queries(t))


@query(
    "query_parts",
    FANNED
    + """SELECT query_id, modality, text FROM (
  SELECT query_id, unnest(['visual', 'temporal', 'audio', 'ocr', 'text']) AS modality,
         unnest([visual_query, temporal_query, audio_query, ocr_query, text_query]) AS text FROM fanned) WHERE text <> ''""",
)
def _query_parts(t: Tables) -> DataFrame:
    return fo.query_parts(fo.fan_out_queries(_queries(t)))


@query(
    "query_enrich",
    FANNED
    + """, known AS (SELECT conv_id AS query_id, string_agg(text, ' ' ORDER BY turn) AS k FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT query_id, query_type, coalesce(trim(k), '') AS entity_knowledge,
  CASE WHEN query_type = 'entity_specific' AND coalesce(trim(k), '') <> '' THEN visual_query || '. ' || trim(k)
       ELSE visual_query END AS visual_query
FROM fanned LEFT JOIN known USING (query_id)""",
)
def _query_enrich(t: Tables) -> DataFrame:
    said = t["conversations"].where(F.col("role") == "user").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("_said")
    )
    knowledge = said.select(
        F.col("conv_id").alias("query_id"),
        F.array_join(F.transform("_said", lambda x: x["text"]), " ").alias("knowledge"),
    )
    enriched = fo.enrich_queries(fo.fan_out_queries(_queries(t)), knowledge)
    return enriched.select("query_id", "query_type", "entity_knowledge", "visual_query")


@query(
    "parse_analysis",
    """SELECT conv_id * 1000 + turn AS query_id,
  CASE WHEN role = 'user' OR n < 100 OR n % 3 = 0 THEN text ELSE 'scene ' || n END AS visual_query,
  CASE WHEN role = 'user' OR n < 100 THEN text ELSE '' END AS audio_query,
  text AS temporal_query,
  CASE WHEN role = 'user' OR n < 100 THEN text ELSE '' END AS ocr_query,
  text AS text_query,
  CASE WHEN role = 'user' OR n < 100 OR n % 2 = 0 THEN 'general' ELSE 'action' END AS query_type,
  CASE WHEN role = 'user' OR n < 100 THEN '' ELSE 'a,b' END AS entities
FROM (SELECT *, length(text) AS n FROM conversations)""",
)
def _parse_analysis(t: Tables) -> DataFrame:
    """Assistant turns answer with fenced JSON, sometimes broken; user turns with plain text."""
    n = F.length("text")
    body = F.format_string(
        '{"visual_query": "%s", "entities": ["a", "b"], "query_type": "%s", "extra": 1}',
        F.when(n % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("scene "), n.cast("string"))),
        F.when(n % 2 == 0, F.lit("unheard of")).otherwise(F.lit("action")),
    )
    fenced = F.concat(F.lit("Here:\n```json\n"), F.when(n < 100, F.substring(body, 1, 40)).otherwise(body), F.lit("\n```"))
    responses = t["conversations"].select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.col("text").alias("original_query"),
        F.when(F.col("role") == "user", F.col("text")).otherwise(fenced).alias("response"),
    )
    parsed = fo.parse_analysis(responses)
    sub_queries = [f"{s}_query" for s in SUB]
    return parsed.select("query_id", *sub_queries, "query_type", F.array_join("entities", ",").alias("entities"))


@query(
    "parse_rating_lists",
    """SELECT conv_id AS query_id, 'turn_' || turn AS segment_id, CASE WHEN role = 'user' THEN 0 ELSE turn / 100::DOUBLE END AS rating
FROM conversations""",
)
def _parse_rating_lists(t: Tables) -> DataFrame:
    item = F.when(
        F.col("role") == "user", F.format_string('{"id": "turn_%d"}', F.col("turn"))
    ).otherwise(F.format_string('{"id": "turn_%d", "score": %s}', F.col("turn"), (F.col("turn") / 100).cast("string")))
    lists = t["conversations"].groupBy("conv_id").agg(F.collect_list(item).alias("_items"))
    responses = lists.select(
        F.col("conv_id").alias("query_id"),
        F.concat(F.lit("```json\n["), F.array_join("_items", ", "), F.lit("]\n```")).alias("response"),
    )
    return fo.parse_rating_lists(responses)


@query(
    "parse_rating_numbers",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE least(1, floor(value) / 100) END AS rating FROM events""",
)
def _parse_rating_numbers(t: Tables) -> DataFrame:
    answer = F.when(F.col("event_type") == "view", "no idea").otherwise(
        F.concat(F.lit("about "), F.col("value").cast("string"))
    )
    return fo.parse_rating_numbers(t["events"].select("event_id", answer.alias("response"))).drop("response")


@query("pending_media", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _pending_media(t: Tables) -> DataFrame:
    return st.pending_media(t["documents"].select("doc_id", "n_chars"), t["labels"], key="doc_id")


@query(
    "indexable_text",
    "SELECT doc_id AS segment_id, length(text) AS n FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''",
)
def _indexable(t: Tables) -> DataFrame:
    return indexable_text(t.documents()).select("segment_id", F.length("text").alias("n"))


@query(
    "ingest_stats",
    with_ctes(
        "tl media grid",
        """, bad AS (SELECT DISTINCT media_id FROM tl WHERE event_type = 'error' AND value > 200),
seg AS (SELECT media_id, count(*) AS n FROM grid GROUP BY media_id)
SELECT count(*) AS total_media, count(*) FILTER (b.media_id IS NULL) AS processed_media, count(b.media_id) AS failed_media,
  sum(n) FILTER (b.media_id IS NULL) AS total_segments, round(sum(duration) FILTER (b.media_id IS NULL), 3) AS total_duration_sec
FROM media m LEFT JOIN bad b ON b.media_id = m.media_id LEFT JOIN seg ON seg.media_id = m.media_id""",
    ).replace("\n, bad", ", bad"),
)
def _ingest_stats(t: Tables) -> DataFrame:
    from reelgrid.operators.grid import time_grid
    from reelgrid.workloads.fixtures import CELL_SEC

    media = t.media()
    bad = t.timeline().where((F.col("event_type") == "error") & (F.col("value") > 200))
    stats = st.ingest_stats(media, time_grid(media, CELL_SEC), bad.select("media_id"))
    return stats.withColumn("total_duration_sec", F.round("total_duration_sec", 3))


@query(
    "ingest_errors",
    with_ctes("tl media", """SELECT media_id, video_file, 'event ' || event_id AS error FROM tl JOIN media USING (media_id)
  WHERE event_type = 'error' AND value > 200"""),
)
def _ingest_errors(t: Tables) -> DataFrame:
    bad = t.timeline().where((F.col("event_type") == "error") & (F.col("value") > 200))
    failures = bad.select("media_id", F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("error"))
    return st.ingest_errors(t.media(), failures)


@query(
    "feature_stats",
    with_ctes(
        "tl asr audio ocr",
        """SELECT 'asr' AS kind, count(*) AS n_rows, sum(length(text)) AS n_items FROM asr
UNION ALL SELECT 'audio', count(*), sum(len(labels)) FROM audio UNION ALL SELECT 'ocr', count(*), sum(len(texts)) FROM ocr""",
    ),
)
def _feature_stats(t: Tables) -> DataFrame:
    streams = {"asr": t.asr(), "audio": t.audio(), "ocr": t.ocr()}
    rows = [st.feature_stats(kind, df) for kind, df in streams.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "index_status",
    """SELECT 'segments' AS index_name, count(*) AS n_rows, TRUE AS present FROM documents
UNION ALL SELECT 'text_sparse', count(*), TRUE FROM documents WHERE text <> '' UNION ALL SELECT 'visual', count(*), TRUE FROM embeddings
UNION ALL SELECT 'audio', 0, FALSE""",
)
def _index_status(t: Tables) -> DataFrame:
    tables = {
        "segments": t.documents(),
        "text_sparse": build_postings(t.documents()),
        "visual": t.vectors(),
        "audio": None,
    }
    return st.index_status(tables)


@query(
    "result_clock",
    """SELECT event_id, CASE WHEN s < 0 THEN '00:00' WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60)
  ELSE printf('%02d:%02d', s // 60, s % 60) END AS time_display FROM (SELECT event_id, floor(value * 40 - 100)::BIGINT AS s FROM events)""",
)
def _clock(t: Tables) -> DataFrame:
    return t["events"].select("event_id", clock(F.col("value") * 40 - 100).alias("time_display"))


@query(
    "stored_segments",
    with_ctes("tl media grid asr audio ocr", "").rstrip()
    + ","
    + ALL_CELLS
    + """
SELECT segment_id, media_id, seg_idx, start_time, end_time, asr_text, text, frame_idx IS NOT NULL AS has_frame_embedding,
  clip_pos IS NOT NULL AS has_video_embedding, audio_pos IS NOT NULL AS has_audio_embedding FROM segments""",
)
def _stored_segments(t: Tables) -> DataFrame:
    """Segments written as files and read back."""
    path = scratch_path(t.spark, "segment-files")
    tb.write_segments(segments(t), path)
    return tb.read_stored_segments(t.spark, path).select(
        "segment_id",
        "media_id",
        "seg_idx",
        "start_time",
        "end_time",
        "asr_text",
        "text",
        "has_frame_embedding",
        "has_video_embedding",
        "has_audio_embedding",
    )


@query(
    "stored_vectors",
    """SELECT vec_id AS segment_id, CASE WHEN label < 5 THEN 'visual' ELSE 'audio' END AS modality, len(embedding) AS dim,
  array_to_string(list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 1000000) AS BIGINT)), ',') AS entries FROM embeddings""",
)
def _stored_vectors(t: Tables) -> DataFrame:
    """Vector rows written per modality and read back."""
    path = scratch_path(t.spark, "vector-files")
    rows = t["embeddings"].select(
        F.col("vec_id").cast("string").alias("segment_id"),
        F.when(F.col("label") < 5, "visual").otherwise("audio").alias("modality"),
        "embedding",
    )
    tb.write_vectors(rows, path)
    return tb.read_vectors(t.spark, path).select(
        F.col("segment_id").cast("bigint").alias("segment_id"),
        "modality",
        F.size("embedding").alias("dim"),
        whole_entries("embedding").alias("entries"),
    )
