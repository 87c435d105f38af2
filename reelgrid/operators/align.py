"""Alignment of the five feature streams onto the time grid.

The grid is uniform, so no interval join is planned: each item is turned into the numbers of the
cells it touches, the exact predicate is checked on the spot from the cell number and the media
duration, and everything after that is an equi-aggregate or equi-join on ``(media_id, seg_idx)``.
Transcripts, sounds, screen texts and clips are rows of one narrow union, so one lookup of durations
and one aggregate per cell serve them all. Embeddings never travel through the explode; a cell keeps the position of the chosen item, and
``segment_vectors`` fetches the vector by that position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.functions.text import full_text, strip
from reelgrid.functions.timing import POINT_WIDTH, overlap
from reelgrid.operators.grid import cell_count, cell_width, time_grid
from reelgrid.schemas import VECTORS
from reelgrid.spreading import SPAN, explode_count, explode_span, lookup_join

CELL = ["media_id", "seg_idx"]
SEGMENT_DEFAULTS = {
    "asr_text": ("string", "''"),
    "audio_events": ("array<string>", "array()"),
    "ocr_texts": ("array<string>", "array()"),
    "action_labels": ("array<string>", "array()"),
    "audio_pos": ("bigint", "null"),
    "clip_pos": ("bigint", "null"),
    "frame_idx": ("bigint", "null"),
    "keyframe_ts": ("double", "null"),
}


def with_duration(items: DataFrame, media: DataFrame, spread_by: str) -> DataFrame:
    durations = media.where(F.col("duration") > 0).select("media_id", "duration")
    return lookup_join(items, durations, ["media_id"], [spread_by], how="inner")


def _cell_start(d: float, cell: Column | None = None) -> Column:
    return (F.col("seg_idx") if cell is None else cell) * F.lit(d)


def _cell_end(d: float, cell: Column | None = None) -> Column:
    return F.least(((F.col("seg_idx") if cell is None else cell) + 1) * F.lit(d), F.col("duration"))


def _spans(items: DataFrame, *kept: str | Column, widen: bool, point: bool = False) -> DataFrame:
    """``kept`` columns with ``start``, ``end`` and where the item stops touching cells.

    ``widen`` gives points a small width; with ``point`` an item belongs to the one cell that holds its start.
    """
    start, end = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("start", "end"))
    stop = F.when(end <= start, start + POINT_WIDTH).otherwise(end) if widen else end
    return items.select(
        *kept, start.alias("start"), end.alias("end"), stop.alias("_stop"), F.lit(point).alias("_point")
    )


def _touched_cells(spans: DataFrame, media: DataFrame, d: float) -> DataFrame:
    """Items once per cell they overlap, open at both edges."""
    timed = with_duration(spans, media, "pos")
    # one cell of slack on both sides; the predicate below decides
    first = F.greatest(F.lit(0), F.floor(F.col("start") / d) - 1)
    last = F.least(F.ceil(F.col("_stop") / d), cell_count(d) - 1)
    cells = explode_span(timed, first, last, "seg_idx")
    begun = F.col("start") < _cell_end(d)
    going = F.when(F.col("_point"), F.col("start") >= _cell_start(d)).otherwise(F.col("_stop") > _cell_start(d))
    return cells.where(begun & going).drop("_stop", "_point")


def overlap_join(media: DataFrame, items: DataFrame, d: float = 1.0) -> DataFrame:
    """Pairs of cell and item that overlap, with the shared length."""
    d = cell_width(d)
    others = [c for c in items.columns if c not in ("start", "end")]
    cells = _touched_cells(_spans(items, *others, widen=True), media, d)
    return cells.withColumn(
        "overlap", overlap(F.col("start"), F.col("end"), _cell_start(d), _cell_end(d))
    ).drop("duration")


def best_item(d: float, cell: Column | None = None) -> Column:
    """Largest raw overlap with the cell, first item on ties; items sharing nothing are never chosen."""
    shared = overlap(F.col("start"), F.col("end"), _cell_start(d, cell), _cell_end(d, cell))
    usable = F.col("has_embedding") & (shared > 0)
    return F.when(usable, F.struct(shared.alias("overlap"), (-F.col("pos")).alias("neg_pos")))


def stream_spans(kind: str, items: DataFrame) -> list[DataFrame]:
    """Items of one stream in the common shape: texts, and whether they have a vector."""
    none = F.lit(None).cast("array<string>")
    texts = {"asr": F.array("text"), "audio": F.col("event_labels"), "ocr": F.col("texts"), "clips": none}[kind]
    vector = F.coalesce(F.size("embedding") > 0, F.lit(False)) if kind in ("audio", "clips") else F.lit(False)
    kept = [
        "media_id",
        F.lit(kind).alias("kind"),
        F.col("pos").cast("bigint").alias("pos"),
        texts.alias("texts"),
        vector.alias("has_embedding"),
    ]
    if kind == "asr":
        return [_spans(items.where(strip(F.col("text")) != ""), *kept, widen=True)]
    if kind == "audio":
        return [_spans(items, *kept, widen=True)]
    if kind == "clips":
        return [_spans(items.where(F.size("embedding") > 0), *kept, widen=False)]
    stamp = F.col("timestamp")
    out = [_spans(items.where(stamp >= 0).withColumns({"start": stamp, "end": stamp}), *kept, widen=False, point=True)]
    if {"start", "end"} <= set(items.columns):
        out.append(_spans(items.where(F.col("end") > F.col("start")), *kept, widen=False))
    return out


def _matched(media: DataFrame, d: float, **streams: DataFrame) -> DataFrame:
    """Per touched cell what the given streams have for it.

    Texts of a kind are distinct and in first-seen order; repeats are dropped before any list is built.
    """
    rows = [part for kind, items in streams.items() for part in stream_spans(kind, items)]
    spans = rows[0]
    for part in rows[1:]:
        spans = spans.unionByName(part)
    cells = _touched_cells(spans, media, d).withColumn("_best", best_item(d))
    return gathered(cells, CELL, list(streams))


def gathered(covered: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    """What the named streams have per ``keys``, from items that cover them, each with its ``_best``."""
    shown = covered.select(*keys, "kind", "pos", "_best", F.posexplode_outer("texts").alias("_nth", "_text"))
    shown = shown.withColumn("_text", strip(F.col("_text")))
    first = shown.groupBy(*keys, "kind", "_text").agg(
        F.min(F.struct("pos", "_nth")).alias("_at"), F.max("_best").alias("_best")
    )

    def texts(kind: str) -> Column:
        own = F.when((F.col("kind") == kind) & (F.col("_text") != ""), F.struct("_at", "_text"))
        return F.transform(F.sort_array(F.collect_list(own)), lambda x: x["_text"])

    def best(kind: str) -> Column:
        return -F.max(F.when(F.col("kind") == kind, F.col("_best")))["neg_pos"]

    found = {
        "asr": [F.array_join(texts("asr"), " ").alias("asr_text")],
        "audio": [texts("audio").alias("audio_events"), best("audio").alias("audio_pos")],
        "ocr": [texts("ocr").alias("ocr_texts")],
        "clips": [best("clips").alias("clip_pos")],
    }
    return first.groupBy(*keys).agg(*[c for kind in kinds for c in found[kind]])


def align_asr(media: DataFrame, asr: DataFrame, d: float = 1.0) -> DataFrame:
    """Whole texts of all transcripts touching a cell, distinct, in item order."""
    return _matched(media, cell_width(d), asr=asr)


def align_audio(media: DataFrame, audio: DataFrame, d: float = 1.0) -> DataFrame:
    """Distinct sound labels per cell, and the item whose embedding stands for the cell."""
    return _matched(media, cell_width(d), audio=audio)


def align_ocr(media: DataFrame, ocr: DataFrame, d: float = 1.0) -> DataFrame:
    """Distinct screen texts per cell: a point belongs to the cell that holds it, a range to all it shares."""
    return _matched(media, cell_width(d), ocr=ocr).where(F.size("ocr_texts") > 0)


def align_clips(media: DataFrame, clips: DataFrame, d: float = 1.0) -> DataFrame:
    """The clip sharing most with each cell; clips without a vector are skipped."""
    return _matched(media, cell_width(d), clips=clips).where(F.col("clip_pos").isNotNull())


def align_frames(media: DataFrame, frames: DataFrame, d: float = 1.0) -> DataFrame:
    """The frame nearest to each cell's midpoint, frames inside the cell counting half their distance.

    Frames first collapse to one row per cell: the last and first frame on each side of the midpoint
    and overall, all map-side. A cell then needs the nearest non-empty cell before and after it. That
    lookup runs in chunks of ``SPAN`` cells, with one summary row per chunk carrying across, so one
    very long media item is neither sorted nor held in one task.
    """
    d = cell_width(d)
    chosen = _with_frames(time_grid(media, d), media, frames, d).where(F.col("keyframe_ts").isNotNull())
    return chosen.select(*CELL, "frame_idx", "keyframe_idx", "keyframe_ts")


def _with_frames(grid: DataFrame, media: DataFrame, frames: DataFrame, d: float) -> DataFrame:
    """The grid's rows with the nearest frames; null for media items without any."""
    at = F.col("timestamp")
    timed = with_duration(frames.select("media_id", "idx", "timestamp"), media, "idx")
    timed = timed.withColumn(
        "seg_idx", F.greatest(F.lit(0), F.least(F.floor(at / d), cell_count(d) - 1)).cast("bigint")
    )
    middle = (_cell_start(d) + _cell_end(d)) / 2.0
    late = F.struct(at.alias("ts"), (-F.col("idx")).alias("neg_idx"))
    early = F.struct(at.alias("ts"), F.col("idx").alias("idx"))
    # both readers below use all four columns, so the aggregate is planned and run once
    per_cell = timed.groupBy(*CELL).agg(
        F.max(F.when(at <= middle, late)).alias("left_latest"),
        F.min(F.when(at <= middle, early)).alias("left_earliest"),
        F.max(F.when(at > middle, late)).alias("right_latest"),
        F.min(F.when(at > middle, early)).alias("right_earliest"),
    )
    latest = F.greatest("left_latest", "right_latest")
    earliest = F.least("left_earliest", "right_earliest")

    chunk = F.floor(F.col("seg_idx") / SPAN)
    keys = ["media_id", "_chunk"]

    def earlier(order: Column, *by: str) -> Window:
        return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    filled = per_cell.groupBy("media_id", chunk.alias("_chunk")).agg(
        F.max(latest).alias("latest"), F.min(earliest).alias("earliest")
    )
    timed_media = media.where(F.col("duration") > 0).select("media_id", "duration")
    chunks = explode_count(timed_media, F.ceil(cell_count(d) / SPAN), "media_id", "_chunk")
    chunks = chunks.select(*keys).join(filled, keys, "left").select(
        *keys,
        F.max("latest").over(earlier(F.col("_chunk"), "media_id")).alias("_latest_before"),
        F.min("earliest").over(earlier(F.col("_chunk").desc(), "media_id")).alias("_earliest_after"),
    )

    own = grid.columns
    cells = grid.withColumn("_chunk", chunk).join(per_cell, CELL, "left").select(
        *own,
        "_chunk",
        "left_latest",
        "right_earliest",
        F.max(latest).over(earlier(F.col("seg_idx"), *keys)).alias("_prior"),
        F.min(earliest).over(earlier(F.col("seg_idx").desc(), *keys)).alias("_next"),
    )
    before = F.coalesce("left_latest", "_prior", "_latest_before")
    after = F.coalesce("right_earliest", "_next", "_earliest_after")
    found = cells.join(chunks, keys).select(
        *own,
        ((F.col("t_start") + F.col("t_end")) / 2.0).alias("_mid"),
        before["ts"].alias("_b_ts"),
        (-before["neg_idx"]).alias("_b_idx"),
        after["ts"].alias("_a_ts"),
        after["idx"].alias("_a_idx"),
    )

    def distance(ts: str, halve: bool) -> Column:
        plain = F.abs(F.col(ts) - F.col("_mid"))
        inside = (F.col(ts) >= F.col("t_start")) & (F.col(ts) < F.col("t_end"))
        return F.when(inside, plain * 0.5).otherwise(plain) if halve else plain

    def takes_before(halve: bool) -> Column:
        b, a = distance("_b_ts", halve), distance("_a_ts", halve)
        closer = (b < a) | ((b == a) & (F.col("_b_idx") < F.col("_a_idx")))
        return F.col("_a_ts").isNull() | F.coalesce(closer, F.lit(False))

    framed, keyed = takes_before(True), takes_before(False)
    return found.select(
        *own,
        F.when(framed, F.col("_b_idx")).otherwise(F.col("_a_idx")).alias("frame_idx"),
        F.when(keyed, F.col("_b_idx")).otherwise(F.col("_a_idx")).alias("keyframe_idx"),
        F.when(keyed, F.col("_b_ts")).otherwise(F.col("_a_ts")).alias("keyframe_ts"),
    )


def align(
    media: DataFrame,
    d: float = 1.0,
    asr: DataFrame | None = None,
    audio: DataFrame | None = None,
    ocr: DataFrame | None = None,
    clips: DataFrame | None = None,
    frames: DataFrame | None = None,
    match: Callable[..., DataFrame] = _matched,
) -> DataFrame:
    """Segments: every cell of every media item with what each stream has for it; a missing stream is empty.

    ``match`` finds what the streams have per touched cell; ``runs.matched_by_runs`` gives the same rows from
    runs of cells, which pays where cells are short against the items.
    """
    d = cell_width(d)
    segments = time_grid(media, d)
    if frames is not None:
        segments = _with_frames(segments, media, frames, d).drop("keyframe_idx")
    segments = segments.drop("t_start", "t_end")
    streams = {"asr": asr, "audio": audio, "ocr": ocr, "clips": clips}
    given = {kind: items for kind, items in streams.items() if items is not None}
    if given:
        segments = segments.join(match(media, d, **given), CELL, "left")
    found = set(segments.columns)

    def or_default(name: str, kind: str, default: str) -> Column:
        fallback = F.expr(default).cast(kind)
        return (F.coalesce(F.col(name), fallback) if name in found else fallback).alias(name)

    return segments.select(
        *[c for c in segments.columns if c not in SEGMENT_DEFAULTS],
        *[or_default(name, *kind) for name, kind in SEGMENT_DEFAULTS.items()],
    )


def with_full_text(segments: DataFrame) -> DataFrame:
    return segments.withColumn(
        "text",
        full_text(F.col("asr_text"), F.col("ocr_texts"), F.col("action_labels"), F.col("audio_events")),
    )


def segment_vectors(
    segments: DataFrame,
    audio: DataFrame | None = None,
    clips: DataFrame | None = None,
    frames: DataFrame | None = None,
) -> DataFrame:
    """Vector rows of the segments, fetched by the position each segment recorded."""
    wanted = [
        ("audio", audio, "audio_pos", "pos"),
        ("temporal", clips, "clip_pos", "pos"),
        ("visual", frames, "frame_idx", "idx"),
    ]
    out = segments.sparkSession.createDataFrame([], VECTORS)
    for modality, features, reference, key in wanted:
        if features is None:
            continue
        asked = segments.where(F.col(reference).isNotNull()).select(
            "segment_id", "media_id", F.col(reference).alias(key)
        )
        held = features.where(F.size("embedding") > 0).select("media_id", key, "embedding")
        out = out.unionByName(
            asked.join(held, ["media_id", key]).select(
                "segment_id", F.lit(modality).alias("modality"), "embedding"
            )
        )
    return out


def coverage(segments: DataFrame) -> DataFrame:
    """Non-empty modalities per media item, and one total row without a media id."""

    def filled(condition: str, name: str) -> Column:
        return F.count_if(F.expr(condition)).alias(name)

    return segments.rollup("media_id").agg(
        F.count(F.lit(1)).alias("n_segments"),
        filled("asr_text <> ''", "n_asr"),
        filled("size(audio_events) > 0", "n_audio"),
        filled("size(ocr_texts) > 0", "n_ocr"),
        filled("clip_pos is not null", "n_clips"),
        filled("frame_idx is not null", "n_frames"),
    )
