"""Grids and windows on media time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions.text import file_stem
from reelgrid.functions.timing import segment_id
from reelgrid.schemas import WINDOWS
from reelgrid.spreading import explode_count

MIN_CELL = 0.1


def cell_width(d: float) -> float:
    return max(MIN_CELL, float(d))


def cell_count(d: float, duration: Column | None = None) -> Column:
    return F.ceil((F.col("duration") if duration is None else duration) / d)


def time_grid(media: DataFrame, d: float = 1.0) -> DataFrame:
    """Uniform cells of width ``d`` per media item; the last one ends at the duration."""
    d = cell_width(d)
    timed = media.where(F.col("duration") > 0).select(
        "media_id", "video_file", "duration", file_stem(F.col("video_file")).alias("_stem")
    )
    cells = explode_count(timed, cell_count(d), "media_id", "seg_idx")
    return cells.select(
        "media_id",
        F.col("seg_idx").cast("bigint").alias("seg_idx"),
        "video_file",
        "_stem",
        (F.col("seg_idx") * d).alias("t_start"),
        F.least((F.col("seg_idx") + 1) * F.lit(d), F.col("duration")).alias("t_end"),
    ).select(
        "media_id",
        "seg_idx",
        "video_file",
        "t_start",
        "t_end",
        segment_id(F.col("_stem"), F.col("t_start")).alias("segment_id"),
        F.round("t_start", 3).alias("start_time"),
        F.round("t_end", 3).alias("end_time"),
    )


def sliding_windows(
    media: DataFrame, length: float, stride: float, min_tail: float = 0.0, full_only: bool = False
) -> DataFrame:
    """Windows of ``length`` every ``stride``; short tails are kept from ``min_tail`` on, or never."""
    timed = media.where(F.col("duration") > 0).select("media_id", "duration")
    windows = explode_count(timed, F.ceil(F.col("duration") / stride), "media_id", "win_idx").select(
        "media_id",
        "win_idx",
        (F.col("win_idx") * F.lit(float(stride))).alias("start"),
        "duration",
    )
    windows = windows.withColumn("end", F.least(F.col("start") + float(length), F.col("duration")))
    keep = (
        F.col("start") + float(length) <= F.col("duration")
        if full_only
        else F.col("end") - F.col("start") >= float(min_tail)
    )
    return windows.where(keep).drop("duration")


def feature_windows(media: DataFrame, stream: str) -> DataFrame:
    """The windows one of the streams ``audio``, ``asr``, ``clips`` is cut into."""
    return sliding_windows(media, **WINDOWS[stream])


def sample_plan(media: DataFrame, rate: float) -> DataFrame:
    """Frame numbers and times read at ``rate`` per second: every k-th frame, k whole."""
    usable = media.where((F.col("fps") > 0) & (F.col("total_frames") > 0)).select(
        "media_id", "fps", "total_frames"
    )
    usable = usable.withColumn("step", F.greatest(F.lit(1), F.floor(F.col("fps") / F.lit(float(rate)))))
    samples = explode_count(usable, F.ceil(F.col("total_frames") / F.col("step")), "media_id", "sample_idx")
    return samples.select(
        "media_id",
        "sample_idx",
        (F.col("sample_idx") * F.col("step")).alias("frame_idx"),
        (F.col("sample_idx") * F.col("step") / F.col("fps")).alias("timestamp"),
    )
