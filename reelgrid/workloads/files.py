"""Tables written as files and read back by the readers of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.sources import tables as tb
from reelgrid.spreading import scratch_path
from reelgrid.workloads.fixtures import Tables, with_ctes
from reelgrid.workloads.registry import query

ITEM_SEC = 43_200


def _as_json(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.json(path)
    return path


def _joined(name: str) -> Column:
    return F.array_join(name, "|").alias(name)


@query(
    "read_segments",
    """SELECT 'd' || doc_id AS segment_id, source || '.v.mp4' AS video_file, source || '.v' AS media_id, n_chars::DOUBLE AS start_time,
  CASE WHEN lang = 'en' THEN n_chars + 0.5::DOUBLE ELSE 0 END AS end_time, coalesce(text, '') AS asr_text,
  CASE WHEN doc_id % 3 = 0 THEN lang || '|' || source ELSE '' END AS audio_events, '' AS ocr_texts, '' AS action_labels, '' AS keyframe_path
FROM documents""",
)
def _read_segments(t: Tables) -> DataFrame:
    """Documents as segments in JSON Lines, some keys absent and one unknown."""
    files = t["documents"].select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("segment_id"),
        F.concat("source", F.lit(".v.mp4")).alias("video_file"),
        F.col("n_chars").cast("double").alias("start_time"),
        F.when(F.col("lang") == "en", F.col("n_chars") + 0.5).alias("end_time"),
        F.col("text").alias("asr_text"),
        F.when(F.col("doc_id") % 3 == 0, F.array("lang", "source")).alias("audio_events"),
        F.lit(1).alias("unknown"),
    )
    read = tb.read_segments(t.spark, _as_json(files, "segments-json"), lines=True)
    lists = ("audio_events", "ocr_texts", "action_labels")
    return read.select(*[_joined(c) if c in lists else c for c in read.columns])


@query(
    "read_features",
    with_ctes(
        "tl asr audio ocr",
        """SELECT 'asr' AS kind, media_id, pos, NULL::DOUBLE AS timestamp, s0 AS start, e0 AS "end", text AS content, NULL::DOUBLE AS entry FROM asr
UNION ALL SELECT 'audio', a.media_id, pos, NULL, s0, e0, array_to_string(labels, '|'), CASE WHEN has_embedding THEN CAST(value AS FLOAT)::DOUBLE END
  FROM audio a JOIN tl ON event_id = pos
UNION ALL SELECT 'ocr', media_id, pos, ts0, s0, e0, array_to_string(texts, '|'), NULL FROM ocr
UNION ALL SELECT 'clips', media_id, event_id, NULL, t, t_end, NULL, CAST(value AS FLOAT)::DOUBLE FROM tl
UNION ALL SELECT 'frames', media_id, event_id, t, NULL, NULL, NULL, CAST(value AS FLOAT)::DOUBLE FROM tl""",
    ),
)
def _read_features(t: Tables) -> DataFrame:
    """All five streams, as Parquet and as JSON Lines in turn."""
    streams = {"asr": t.asr(), "audio": t.audio(), "ocr": t.ocr(), "clips": t.clips(), "frames": t.frames()}
    content = {"asr": F.col("text"), "audio": _joined("event_labels"), "ocr": _joined("texts")}
    out = None
    for i, (kind, df) in enumerate(streams.items()):
        path, fmt = scratch_path(t.spark, f"features-{kind}"), ("parquet", "json")[i % 2]
        df.write.format(fmt).save(path)
        read = tb.read_features(t.spark, kind, path, fmt)

        def given(name: str, read: DataFrame = read) -> Column:
            return (F.col(name) if name in read.columns else F.lit(None).cast("double")).alias(name)

        entry = F.get("embedding", F.lit(0)) if "embedding" in read.columns else F.lit(None)
        part = read.select(
            F.lit(kind).alias("kind"),
            "media_id",
            F.col("idx" if kind == "frames" else "pos").alias("pos"),
            *[given(c) for c in ("timestamp", "start", "end")],
            content.get(kind, F.lit(None)).cast("string").alias("content"),
            entry.cast("double").alias("entry"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "read_ground_truth",
    with_ctes(
        "tl gt",
        f"""SELECT query_id AS query, item, row_number() OVER (PARTITION BY query_id, item ORDER BY gt_id) - 1 AS gt_id, s0 AS start, e0 AS "end",
  'item ' || item AS text, array_to_string(aspects, '|') AS aspects
FROM (SELECT *, CAST(floor(s0 / {ITEM_SEC}) AS BIGINT) AS item FROM gt)""",
    ),
)
def _read_ground_truth(t: Tables) -> DataFrame:
    """Items of one half day each, so that a query text stands in many items."""
    spans = t.ground_truth().withColumn("item", F.floor(F.col("start") / ITEM_SEC))
    text = F.concat(F.lit("item "), F.col("item").cast("string"))
    span = F.struct("gt_id", "start", "end", text.alias("text"), "aspects")
    items = spans.groupBy(F.col("query_id").alias("query"), "item").agg(F.sort_array(F.collect_list(span)).alias("segments"))
    read = tb.read_ground_truth(t.spark, _as_json(items, "ground-truth"), lines=True)
    item = F.substring_index("text", " ", -1).cast("bigint").alias("item")
    return read.select("query", item, "gt_id", "start", "end", "text", _joined("aspects"))


@query(
    "read_feedback",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, 'user_' || user_id AS query_id, json_extract_string(props, '$.k') AS segment_id,
  value >= 20 AS relevant, epoch_us(ts) // 1000 AS millis FROM events""",
)
def _read_feedback(t: Tables) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    told = t["events"].select(
        F.col("event_id").cast("string").alias("event_id"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("query_id"),
        F.get_json_object("props", "$.k").alias("segment_id"),
        (F.col("value") >= 20).alias("relevant"),
        F.timestamp_micros(micros).alias("ts"),
    )
    read = tb.read_feedback(t.spark, _as_json(told, "feedback-json"))
    return read.select("event_id", "query_id", "segment_id", "relevant", F.unix_millis("ts").alias("millis"))
