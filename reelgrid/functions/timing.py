"""Interval expressions on media time, in seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelgrid.schemas import DEFAULT_INTERVAL_SEC

POINT_WIDTH = 0.001  # width given to an item without length when it is matched against cells


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Length shared by two intervals, never negative."""
    return F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Intersection over union; an interval without length is given the default one."""
    a_stop = F.when(a_end <= a_start, a_start + DEFAULT_INTERVAL_SEC).otherwise(a_end)
    b_stop = F.when(b_end <= b_start, b_start + DEFAULT_INTERVAL_SEC).otherwise(b_end)
    shared = overlap(a_start, a_stop, b_start, b_stop)
    union = (a_stop - a_start) + (b_stop - b_start) - shared
    return F.when(union <= 0, F.lit(0.0)).otherwise(shared / union)


def segment_id(stem: Column, start: Column) -> Column:
    """Display id: file stem and the whole second the cell starts at, in at least five digits."""
    second = F.floor(start).cast("string")
    return F.concat(stem, F.lit("_"), F.when(F.length(second) < 5, F.lpad(second, 5, "0")).otherwise(second))


def segment_key() -> Column:
    """Unique id of a segment, from ``media_id`` and ``seg_idx``; display ids of short cells can be equal."""
    return F.concat("media_id", F.lit("#"), F.col("seg_idx").cast("string"))
