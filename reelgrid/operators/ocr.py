"""On-screen text clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.functions.text import strip
from reelgrid.schemas import OCR_MIN_CONFIDENCE


def clean_ocr(detections: DataFrame, min_confidence: float = OCR_MIN_CONFIDENCE) -> DataFrame:
    """Texts per frame: confident, not too short, each spelling once whatever its case.

    Repeats collapse to their first spelling before a frame's list is collected.
    """
    text = strip(F.col("text"))
    kept = detections.where(F.col("confidence") >= min_confidence).select(
        "media_id", "timestamp", "pos", text.alias("text")
    )
    kept = kept.where(
        (F.length("text") >= 2) & (F.col("text").rlike(r"\p{L}") | (F.length("text") >= 4))
    )
    first = kept.groupBy("media_id", "timestamp", F.lower("text").alias("_folded")).agg(
        F.min(F.struct("pos", "text")).alias("_first")
    )
    frames = first.groupBy("media_id", "timestamp").agg(
        F.min("_first.pos").alias("pos"),
        F.transform(F.sort_array(F.collect_list("_first")), lambda x: x["text"]).alias("texts"),
    )
    return frames.withColumn("timestamp", F.round("timestamp", 2))
