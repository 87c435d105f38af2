"""Grids, windows and alignment over the event timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.operators import align as al
from reelgrid.operators.grid import sample_plan, sliding_windows, time_grid
from reelgrid.operators.ocr import clean_ocr
from reelgrid.operators.runs import matched_by_runs
from reelgrid.operators.transcripts import clean_asr, merge_short, to_absolute
from reelgrid.workloads.fixtures import CELL_SEC, Tables, with_ctes
from reelgrid.workloads.registry import query

ASR_CELLS = """
asr_first AS (
  SELECT media_id, seg_idx, text, min(pos) AS p
  FROM grid g JOIN asr a USING (media_id)
  WHERE a.s0 < g.e AND (CASE WHEN a.e0 <= a.s0 THEN a.s0 + 0.001 ELSE a.e0 END) > g.s
  GROUP BY media_id, seg_idx, text),
asr_cell AS (
  SELECT media_id, seg_idx, string_agg(text, ' ' ORDER BY p) AS asr_text FROM asr_first GROUP BY media_id, seg_idx)"""

AUDIO_CELLS = """
audio_pair AS (
  SELECT media_id, seg_idx, pos, labels, has_embedding, least(e0, e) - greatest(s0, s) AS shared
  FROM grid g JOIN audio a USING (media_id)
  WHERE a.s0 < g.e AND (CASE WHEN a.e0 <= a.s0 THEN a.s0 + 0.001 ELSE a.e0 END) > g.s),
audio_label AS (
  SELECT media_id, seg_idx, label, min(pos * 10 + nth) AS p
  FROM (SELECT *, unnest(labels) AS label, generate_subscripts(labels, 1) AS nth FROM audio_pair)
  GROUP BY media_id, seg_idx, label),
audio_cell AS (
  SELECT media_id, seg_idx, string_agg(label, '|' ORDER BY p) AS audio_events FROM audio_label
  GROUP BY media_id, seg_idx),
audio_best AS (
  SELECT media_id, seg_idx, pos AS audio_pos FROM audio_pair WHERE has_embedding AND shared > 0
  QUALIFY row_number() OVER (PARTITION BY media_id, seg_idx ORDER BY shared DESC, pos) = 1)"""

OCR_CELLS = """
ocr_pair AS (
  SELECT media_id, seg_idx, pos, texts FROM grid g JOIN ocr o USING (media_id)
  WHERE (o.ts0 >= g.s AND o.ts0 < g.e) OR (o.s0 IS NOT NULL AND least(o.e0, g.e) - greatest(o.s0, g.s) > 0)),
ocr_first AS (
  SELECT media_id, seg_idx, text, min(pos * 10 + nth) AS p
  FROM (SELECT *, unnest(texts) AS text, generate_subscripts(texts, 1) AS nth FROM ocr_pair)
  GROUP BY media_id, seg_idx, text),
ocr_cell AS (
  SELECT media_id, seg_idx, string_agg(text, ' ' ORDER BY p) AS ocr_text FROM ocr_first GROUP BY media_id, seg_idx)"""

CLIP_CELLS = """
clip_cell AS (
  SELECT media_id, seg_idx, event_id AS clip_pos FROM grid g JOIN tl c USING (media_id)
  WHERE least(c.t_end, g.e) - greatest(c.t, g.s) > 0
  QUALIFY row_number() OVER (
    PARTITION BY media_id, seg_idx ORDER BY least(c.t_end, g.e) - greatest(c.t, g.s) DESC, event_id) = 1)"""

FRAME_CELLS = """
frame_cell AS (
  SELECT media_id, seg_idx, event_id AS frame_idx FROM grid g JOIN tl f USING (media_id)
  QUALIFY row_number() OVER (
    PARTITION BY media_id, seg_idx
    ORDER BY abs(f.t - (g.s + g.e) / 2) * (CASE WHEN f.t >= g.s AND f.t < g.e THEN 0.5::DOUBLE ELSE 1 END), event_id) = 1),
key_cell AS (
  SELECT media_id, seg_idx, event_id AS keyframe_idx, f.t AS keyframe_ts FROM grid g JOIN tl f USING (media_id)
  QUALIFY row_number() OVER (PARTITION BY media_id, seg_idx ORDER BY abs(f.t - (g.s + g.e) / 2), event_id) = 1)"""

SEGMENTS_SQL = """
segments AS (
  SELECT g.media_id, g.seg_idx, regexp_replace(g.video_file, '[.][^.]+$', '') || '_' || printf('%05d', CAST(floor(g.s) AS BIGINT)) AS segment_id,
         round(g.s, 3) AS start_time, round(g.e, 3) AS end_time, coalesce(asr_text, '') AS asr_text,
         audio_events, ocr_text, audio_pos, clip_pos, frame_idx,
         concat_ws(' ', asr_text, ocr_text, replace(audio_events, '|', ' ')) AS text
  FROM grid g LEFT JOIN asr_cell USING (media_id, seg_idx) LEFT JOIN audio_cell USING (media_id, seg_idx)
  LEFT JOIN audio_best USING (media_id, seg_idx) LEFT JOIN ocr_cell USING (media_id, seg_idx)
  LEFT JOIN clip_cell USING (media_id, seg_idx) LEFT JOIN frame_cell USING (media_id, seg_idx))"""

ALL_CELLS = ",".join([ASR_CELLS, AUDIO_CELLS, OCR_CELLS, CLIP_CELLS, FRAME_CELLS, SEGMENTS_SQL])


def segments(t: Tables) -> DataFrame:
    return al.with_full_text(
        al.align(t.stored_media(), CELL_SEC, t.asr(), t.audio(), t.ocr(), t.clips(), t.frames())
    )


@query(
    "time_grid",
    with_ctes(
        "tl media grid",
        """SELECT media_id, seg_idx, round(s, 3) AS start_time, round(e, 3) AS end_time,
  regexp_replace(video_file, '[.][^.]+$', '') || '_' || printf('%05d', CAST(floor(s) AS BIGINT)) AS segment_id FROM grid""",
    ),
)
def _time_grid(t: Tables) -> DataFrame:
    return time_grid(t.media(), CELL_SEC).select("media_id", "seg_idx", "start_time", "end_time", "segment_id")


def _windows_sql(length: int, stride: int, tail: str) -> str:
    return with_ctes(
        "tl media",
        f"""SELECT media_id, i AS win_idx, i * {stride}::DOUBLE AS start, least(i * {stride}::DOUBLE + {length}, duration) AS "end"
  FROM (SELECT *, unnest(range(0, CAST(ceil(duration / {stride}) AS BIGINT))) AS i FROM media)
  WHERE {tail}""",
    )


@query(
    "sliding_windows",
    _windows_sql(18000, 9000, "least(i * 9000::DOUBLE + 18000, duration) - i * 9000::DOUBLE >= 3600"),
)
def _sliding_windows(t: Tables) -> DataFrame:
    return sliding_windows(t.media(), 18_000, 9_000, min_tail=3_600)


@query("clip_windows", _windows_sql(14400, 7200, "i * 7200::DOUBLE + 14400 <= duration"))
def _clip_windows(t: Tables) -> DataFrame:
    return sliding_windows(t.media(), 14_400, 7_200, full_only=True)


@query(
    "sample_plan",
    with_ctes(
        "tl media",
        """SELECT media_id, j AS sample_idx, j * step AS frame_idx, j * step / fps AS timestamp FROM (
  SELECT *, unnest(range(0, CAST(ceil(total_frames / step) AS BIGINT))) AS j FROM (
    SELECT *, greatest(1, CAST(floor(fps / 1) AS BIGINT)) AS step FROM media))""",
    ),
)
def _sample_plan(t: Tables) -> DataFrame:
    return sample_plan(t.media(), 1.0)


@query(
    "to_absolute",
    with_ctes(
        "tl",
        """SELECT media_id, event_id AS pos, round(c + coalesce(CASE WHEN value >= 5 THEN value END, 0), 2) AS start,
  round(c + coalesce(CASE WHEN value < 300 THEN value + 60 END, 30000), 2) AS "end", event_type AS text
  FROM (SELECT *, floor(t / 30000) * 30000 AS c FROM tl) WHERE k <> '0'""",
    ),
)
def _to_absolute(t: Tables) -> DataFrame:
    start = F.floor(F.col("t") / 30_000) * F.lit(30_000.0)
    chunks = t.timeline().select(
        "media_id",
        F.col("event_id").alias("pos"),
        start.alias("chunk_start"),
        (start + 30_000).alias("chunk_end"),
        F.when(F.col("value") >= 5, F.col("value")).alias("rel_start"),
        F.when(F.col("value") < 300, F.col("value") + 60).alias("rel_end"),
        F.when(F.col("k") == "0", " \n").otherwise(F.concat(F.lit(" "), F.col("event_type"))).alias("text"),
    )
    return to_absolute(chunks)


@query(
    "merge_short",
    with_ctes(
        "tl asr",
        """SELECT media_id, min(pos) AS pos, arg_min(s0, pos) AS start, arg_max(e0, pos) AS "end",
  string_agg(text, ' ' ORDER BY pos) AS text, count(*) AS n_rows FROM (
    SELECT *, sum(brk) OVER (PARTITION BY media_id ORDER BY pos) AS run FROM (
      SELECT *, CASE WHEN e0 - s0 < 600 OR s0 - lag(e0) OVER (PARTITION BY media_id ORDER BY pos) <= 3600
                     THEN 0 ELSE 1 END AS brk FROM asr))
  GROUP BY media_id, run""",
    ),
)
def _merge_short(t: Tables) -> DataFrame:
    return merge_short(clean_asr(t.asr()), min_duration=600, max_gap=3_600)


@query(
    "overlap_join",
    with_ctes(
        "tl media grid asr",
        """SELECT media_id, seg_idx, pos, round(greatest(0, least(e0, e) - greatest(s0, s)), 6) AS overlap
  FROM grid g JOIN asr a USING (media_id)
  WHERE a.s0 < g.e AND (CASE WHEN a.e0 <= a.s0 THEN a.s0 + 0.001 ELSE a.e0 END) > g.s""",
    ),
)
def _overlap_join(t: Tables) -> DataFrame:
    pairs = al.overlap_join(t.media(), t.asr(), CELL_SEC)
    return pairs.select("media_id", "seg_idx", "pos", F.round("overlap", 6).alias("overlap"))


@query("align_asr", with_ctes("tl media grid asr", "") .rstrip() + "," + ASR_CELLS + "\nSELECT * FROM asr_cell")
def _align_asr(t: Tables) -> DataFrame:
    return al.align_asr(t.media(), t.asr(), CELL_SEC)


@query(
    "align_audio",
    with_ctes("tl media grid audio", "").rstrip()
    + ","
    + AUDIO_CELLS
    + "\nSELECT media_id, seg_idx, audio_events, audio_pos FROM audio_cell LEFT JOIN audio_best USING (media_id, seg_idx)",
)
def _align_audio(t: Tables) -> DataFrame:
    cells = al.align_audio(t.media(), t.audio(), CELL_SEC)
    return cells.withColumn("audio_events", F.array_join("audio_events", "|"))


@query("align_ocr", with_ctes("tl media grid ocr", "").rstrip() + "," + OCR_CELLS + "\nSELECT * FROM ocr_cell")
def _align_ocr(t: Tables) -> DataFrame:
    cells = al.align_ocr(t.media(), t.ocr(), CELL_SEC)
    return cells.select("media_id", "seg_idx", F.array_join("ocr_texts", " ").alias("ocr_text"))


@query("align_clips", with_ctes("tl media grid", "").rstrip() + "," + CLIP_CELLS + "\nSELECT * FROM clip_cell")
def _align_clips(t: Tables) -> DataFrame:
    return al.align_clips(t.media(), t.clips(), CELL_SEC)


@query("align_frames", with_ctes("tl media grid", "").rstrip() + "," + FRAME_CELLS + "\nSELECT * FROM frame_cell")
def _align_frames(t: Tables) -> DataFrame:
    return al.align_frames(t.media(), t.frames(), CELL_SEC).select("media_id", "seg_idx", "frame_idx")


@query("align_keyframe", with_ctes("tl media grid", "").rstrip() + "," + FRAME_CELLS + "\nSELECT * FROM key_cell")
def _align_keyframe(t: Tables) -> DataFrame:
    return al.align_frames(t.media(), t.frames(), CELL_SEC).drop("frame_idx")


@query(
    "segments_full_text",
    with_ctes("tl media grid asr audio ocr", "").rstrip()
    + ","
    + ALL_CELLS
    + "\nSELECT media_id, seg_idx, segment_id, start_time, end_time, text, audio_pos, clip_pos, frame_idx FROM segments",
)
def _segments_full_text(t: Tables) -> DataFrame:
    return segments(t).select(
        "media_id", "seg_idx", "segment_id", "start_time", "end_time", "text", "audio_pos", "clip_pos", "frame_idx"
    )


@query(
    "segments_by_runs",
    with_ctes("tl media grid asr audio ocr", "").rstrip()
    + ","
    + ALL_CELLS
    + "\nSELECT media_id, seg_idx, segment_id, start_time, end_time, text, audio_pos, clip_pos FROM segments",
)
def _segments_by_runs(t: Tables) -> DataFrame:
    found = al.align(t.stored_media(), CELL_SEC, t.asr(), t.audio(), t.ocr(), t.clips(), match=matched_by_runs)
    return al.with_full_text(found).select(
        "media_id", "seg_idx", "segment_id", "start_time", "end_time", "text", "audio_pos", "clip_pos"
    )


@query(
    "segment_vectors",
    with_ctes("tl media grid asr audio ocr", "").rstrip()
    + ","
    + ALL_CELLS
    + """
SELECT segment_id, modality, 1 AS dim, CAST(value AS FLOAT)::DOUBLE AS first_entry FROM (
  SELECT segment_id, unnest(['audio', 'temporal', 'visual']) AS modality, unnest([audio_pos, clip_pos, frame_idx]) AS event_id
  FROM segments) JOIN tl USING (event_id)""",
)
def _segment_vectors(t: Tables) -> DataFrame:
    rows = al.segment_vectors(segments(t), t.audio(), t.clips(), t.frames())
    return rows.select(
        "segment_id",
        "modality",
        F.size("embedding").alias("dim"),
        F.get("embedding", F.lit(0)).cast("double").alias("first_entry"),
    )


@query(
    "coverage",
    with_ctes("tl media grid asr audio ocr", "").rstrip()
    + ","
    + ALL_CELLS
    + """
SELECT media_id, count(*) AS n_segments, count(*) FILTER (asr_text <> '') AS n_asr,
  count(audio_events) AS n_audio, count(ocr_text) AS n_ocr, count(clip_pos) AS n_clips, count(frame_idx) AS n_frames
FROM segments GROUP BY ROLLUP (media_id)""",
)
def _coverage(t: Tables) -> DataFrame:
    return al.coverage(segments(t))


@query(
    "ocr_clean",
    """WITH lines AS (
  SELECT doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) AS pos, len(parts) AS n_lines
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
kept AS (
  SELECT doc_id, pos, trim(text, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)) AS text
  FROM lines WHERE pos::DOUBLE / n_lines >= 0.35),
firsts AS (
  SELECT doc_id, lower(text) AS folded, arg_min(text, pos) AS text, min(pos) AS pos FROM kept
  WHERE length(text) >= 2 AND (regexp_matches(text, '\\p{L}') OR length(text) >= 4) GROUP BY doc_id, lower(text))
SELECT 'doc_' || doc_id AS media_id, 0::DOUBLE AS timestamp, min(pos) AS pos, string_agg(text, '|' ORDER BY pos) AS texts
FROM firsts GROUP BY doc_id""",
)
def _ocr_clean(t: Tables) -> DataFrame:
    lines = t["documents"].select("doc_id", F.split("text", "\n").alias("_lines"))
    detections = lines.select("doc_id", F.size("_lines").alias("_n"), F.posexplode("_lines").alias("pos", "text"))
    detections = detections.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("media_id"),
        F.lit(0.0).alias("timestamp"),
        (F.col("pos") + 1).alias("pos"),
        "text",
        ((F.col("pos") + 1) / F.col("_n")).alias("confidence"),
    )
    return clean_ocr(detections).withColumn("texts", F.array_join("texts", "|"))
