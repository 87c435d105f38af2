"""From feature streams to segments, indexes and statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.functions.timing import segment_key
from reelgrid.operators.align import align, coverage, segment_vectors, with_full_text
from reelgrid.operators.lexical import build_postings, indexable_text
from reelgrid.operators.models import Encoder, encode_column
from reelgrid.operators.ocr import clean_ocr
from reelgrid.operators.stats import ingest_stats
from reelgrid.operators.transcripts import clean_asr, merge_short, to_absolute
from reelgrid.sources.tables import read_postings, write_lexical_index, write_postings, write_segments, write_vectors
from reelgrid.spreading import stored


def ingest(
    media: DataFrame,
    d: float = 1.0,
    asr_chunks: DataFrame | None = None,
    audio: DataFrame | None = None,
    ocr_detections: DataFrame | None = None,
    clips: DataFrame | None = None,
    frames: DataFrame | None = None,
) -> DataFrame:
    """Segments with full text for all media items in one job."""
    if asr_chunks is not None and "pos" not in asr_chunks.columns:  # rows without a number keep their order
        asr_chunks = asr_chunks.withColumn("pos", F.monotonically_increasing_id())
    asr = merge_short(clean_asr(to_absolute(asr_chunks))) if asr_chunks is not None else None
    ocr = clean_ocr(ocr_detections) if ocr_detections is not None else None
    segments = with_full_text(align(media, d, asr, audio, ocr, clips, frames))
    return segments if "keyframe_path" in segments.columns else segments.withColumn("keyframe_path", F.lit(""))


def build_indexes(
    segments: DataFrame,
    path: str,
    audio: DataFrame | None = None,
    clips: DataFrame | None = None,
    frames: DataFrame | None = None,
    encoder: Callable[[], Encoder] | None = None,
    dim: int | None = None,
) -> None:
    """Write segments, the lexical index and vectors under ``path``; segments are computed once.

    Indexes know a segment by its key. With an ``encoder`` of ``dim`` numbers, the full texts get dense vectors too.
    """
    kept = stored(segments, "segments")
    write_segments(kept, f"{path}/segments")
    keyed = kept.withColumn("segment_id", segment_key())
    write_postings(build_postings(keyed), f"{path}/postings")
    write_lexical_index(read_postings(kept.sparkSession, f"{path}/postings"), f"{path}/lexical")
    vectors = segment_vectors(keyed, audio, clips, frames)
    if encoder is not None:
        texts = indexable_text(keyed).select("segment_id", F.lit("text_dense").alias("modality"), "text")
        vectors = vectors.unionByName(encode_column(texts, "text", encoder, dim).drop("text"))
    write_vectors(vectors, f"{path}/vectors")


def ingest_report(media: DataFrame, segments: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    return ingest_stats(media, segments, errors), coverage(segments)
