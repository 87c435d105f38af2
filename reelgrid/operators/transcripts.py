"""Transcript rows: absolute times, clean-up, merging of short or touching intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.functions.text import is_blank, strip

CHUNK_ROWS = 32_768


def clean_asr(asr: DataFrame) -> DataFrame:
    """Drop blank transcripts and trim the others."""
    return asr.where(~is_blank(F.col("text"))).withColumn("text", strip(F.col("text")))


def to_absolute(chunk_rows: DataFrame) -> DataFrame:
    """Times relative to a chunk become media times; missing ones fall back to the chunk's bounds."""
    length = F.col("chunk_end") - F.col("chunk_start")
    return clean_asr(chunk_rows).select(
        *[c for c in chunk_rows.columns if c not in ("chunk_start", "chunk_end", "rel_start", "rel_end", "text")],
        F.round(F.col("chunk_start") + F.coalesce("rel_start", F.lit(0.0)), 2).alias("start"),
        F.round(F.col("chunk_start") + F.coalesce(F.col("rel_end"), length), 2).alias("end"),
        "text",
    )


def merge_short(asr: DataFrame, min_duration: float = 0.5, max_gap: float = 0.3) -> DataFrame:
    """Join each row to the previous one when it is short or close to it, in ``pos`` order.

    The merged interval ends where its *last* row ends, so the previous row's end is all a row has
    to know, and runs are found by a running count of breaks. ``pos`` is unique per media item, so
    rows are handled in chunks of at most ``CHUNK_ROWS`` positions; one summary row per chunk carries
    the last end and the number of breaks over to the next chunk, so a very long item is not sorted
    in one task.
    """

    def breaks(previous_end: Column, start: Column, end: Column) -> Column:
        joined = (end - start < min_duration) | (start - previous_end <= max_gap)
        return F.when(joined, F.lit(0)).otherwise(F.lit(1))

    in_chunk = Window.partitionBy("media_id", "_chunk").orderBy("pos")
    rows = asr.select(
        "media_id", "pos", "start", "end", "text", F.floor(F.col("pos") / CHUNK_ROWS).alias("_chunk")
    ).withColumn("_prev", F.lag("end").over(in_chunk))
    rows = rows.withColumn(
        "_break",
        F.when(F.col("_prev").isNull(), F.lit(0)).otherwise(
            breaks(F.col("_prev"), F.col("start"), F.col("end"))
        ),
    )

    chunks = rows.groupBy("media_id", "_chunk").agg(
        F.min_by("start", "pos").alias("_first_start"),
        F.min_by("end", "pos").alias("_first_end"),
        F.max_by("end", "pos").alias("_last_end"),
        F.sum("_break").alias("_inner"),
    )
    by_chunk = Window.partitionBy("media_id").orderBy("_chunk")
    chunks = chunks.withColumn("_carry", F.lag("_last_end").over(by_chunk)).withColumn(
        "_opening",
        F.when(F.col("_carry").isNull(), F.lit(1)).otherwise(
            breaks(F.col("_carry"), F.col("_first_start"), F.col("_first_end"))
        ),
    )
    chunks = chunks.select(
        "media_id",
        "_chunk",
        (
            F.sum(F.col("_opening") + F.col("_inner")).over(by_chunk.rowsBetween(Window.unboundedPreceding, 0))
            - F.col("_inner")
        ).alias("_offset"),
    )

    running = F.sum("_break").over(in_chunk.rowsBetween(Window.unboundedPreceding, 0))
    numbered = rows.withColumn("_running", running).join(chunks, ["media_id", "_chunk"])
    numbered = numbered.withColumn("_run", F.col("_offset") + F.col("_running"))

    ordered = F.sort_array(F.collect_list(F.struct("pos", "text")))
    parts = numbered.groupBy("media_id", "_chunk", "_run").agg(
        F.min("pos").alias("pos"),
        F.min_by("start", "pos").alias("start"),
        F.max_by("end", "pos").alias("end"),
        F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    ordered_parts = F.sort_array(F.collect_list(F.struct("_chunk", "text")))
    return (
        parts.groupBy("media_id", "_run")
        .agg(
            F.min("pos").alias("pos"),
            F.min_by("start", "_chunk").alias("start"),
            F.max_by("end", "_chunk").alias("end"),
            F.array_join(F.transform(ordered_parts, lambda x: x["text"]), " ").alias("text"),
            F.sum("n_rows").alias("n_rows"),
        )
        .drop("_run")
    )
