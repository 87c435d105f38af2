"""Segments, features, indexes, ground truth, feedback and results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.functions.text import clock, file_stem
from reelgrid.functions.timing import segment_key
from reelgrid.operators.lexical import LexicalIndex, lexical_index, ordered_entries
from reelgrid.schemas import FEATURES, FEEDBACK, GROUND_TRUTH, GROUND_TRUTH_FILE, SEGMENT_FILE, VECTORS

RESULT_COLUMNS = (
    "segment_id",
    "video_file",
    "start_time",
    "end_time",
    "text",
    "score",
    "source",
    "time_display",
    "keyframe_path",
)


def _defaults(df: DataFrame, fields: list) -> list:
    fallback = {"string": F.lit(""), "double": F.lit(0.0)}
    out = []
    for field in fields:
        kind = field.dataType.simpleString()
        empty = fallback[kind] if kind in fallback else F.array().cast(kind)
        out.append(F.coalesce(F.col(field.name), empty).alias(field.name))
    return out


def read_segments(spark: SparkSession, path: str, media_id_from: str = "video_file", lines: bool = False) -> DataFrame:
    """Segments from a JSON array: absent keys get defaults, others are ignored, the last row of an id counts.

    An array is read whole by one task. With ``lines`` the files are JSON Lines, which are split.
    """
    raw = spark.read.schema(SEGMENT_FILE).option("multiLine", not lines).json(path)
    rows = raw.select(*_defaults(raw, SEGMENT_FILE.fields), F.monotonically_increasing_id().alias("_nth"))
    last = rows.groupBy("segment_id").agg(F.max_by(F.struct(*SEGMENT_FILE.names), "_nth").alias("_row"))
    return last.select("_row.*").withColumn("media_id", file_stem(F.col(media_id_from)))


def write_segments(segments: DataFrame, path: str) -> None:
    """Segments without vectors, with their full text, their key and flags telling which vectors exist."""
    kept = [c for c in (*SEGMENT_FILE.names, "text") if c in segments.columns]
    segments.select(
        "media_id",
        "seg_idx",
        segment_key().alias("segment_key"),
        *kept,
        F.col("frame_idx").isNotNull().alias("has_frame_embedding"),
        F.col("clip_pos").isNotNull().alias("has_video_embedding"),
        F.col("audio_pos").isNotNull().alias("has_audio_embedding"),
    ).write.parquet(path)


def read_stored_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_features(spark: SparkSession, kind: str, path: str, fmt: str = "parquet") -> DataFrame:
    """One of the feature streams ``asr``, ``audio``, ``ocr``, ``clips``, ``frames``."""
    return spark.read.schema(FEATURES[kind]).format(fmt).load(path)


def write_postings(postings: DataFrame, path: str) -> None:
    postings.write.parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_lexical_index(postings: DataFrame, path: str) -> None:
    """The index in the order of its words, and the statistics of the corpus, counted once.

    Files are cut by word and document, so a frequent word spans several.
    """
    entries, idf, corpus = lexical_index(postings)
    idf.repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{path}/idf")
    corpus.write.parquet(f"{path}/corpus")
    counts = postings.sparkSession.read.parquet(f"{path}/idf")
    ordered_entries(entries, counts, ["token", "segment_id"]).write.parquet(f"{path}/entries")


def read_lexical_index(spark: SparkSession, path: str) -> LexicalIndex:
    return LexicalIndex(*[spark.read.parquet(f"{path}/{part}") for part in LexicalIndex._fields])


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vector rows, one folder per modality."""
    vectors.where(F.size("embedding") > 0).write.partitionBy("modality").parquet(path)


def read_vectors(spark: SparkSession, path: str, modality: str | None = None) -> DataFrame:
    vectors = spark.read.schema(VECTORS).parquet(path)
    return vectors if modality is None else vectors.where(F.col("modality") == modality)


def read_ground_truth(
    spark: SparkSession, path: str, flat_query: str | None = None, lines: bool = False
) -> DataFrame:
    """Ground truth from JSON: ``{query, segments}`` items, or with ``flat_query`` a flat list of spans for it.

    Items without a query are skipped. A query without spans keeps one row with a null ``gt_id``. With
    ``lines`` the files are JSON Lines.
    """
    raw = spark.read.schema(GROUND_TRUTH_FILE).option("multiLine", not lines).json(path)
    if flat_query is not None:
        nested = raw.select(
            F.lit(flat_query).alias("query"),
            F.lit(flat_query).alias("_item"),
            F.monotonically_increasing_id().alias("gt_id"),
            F.struct("start", "end", "text", "aspects").alias("s"),
        )
    else:
        asked = raw.where(F.coalesce("query", F.lit("")) != "")
        # One query text may stand in several items, each with spans of its own.
        item = F.concat_ws("\n", F.monotonically_increasing_id().cast("string"), "query")
        nested = asked.select("query", item.alias("_item"), F.posexplode_outer("segments").alias("gt_id", "s"))
    present = F.col("s").isNotNull()
    return nested.select(
        F.sha2("_item", 256).alias("query_id"),
        F.col("gt_id").cast("bigint").alias("gt_id"),
        "query",
        F.when(present, F.coalesce("s.start", F.lit(0.0))).alias("start"),
        F.when(present, F.coalesce("s.end", F.lit(0.0))).alias("end"),
        F.when(present, F.coalesce("s.text", F.lit(""))).alias("text"),
        F.when(present, F.coalesce("s.aspects", F.array().cast("array<string>"))).alias("aspects"),
    ).to(GROUND_TRUTH)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEEDBACK).json(path)


def stream_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(FEEDBACK).json(path)


def result_output(results: DataFrame) -> DataFrame:
    """The nine shown columns, with the score rounded and the start as a clock.

    Results that were found by segment key are shown with the segment's display id.
    """
    if "display_id" in results.columns:
        results = results.withColumn("segment_id", F.coalesce("display_id", "segment_id"))
    shown = results.withColumn("score", F.round("score", 4)).withColumn(
        "time_display", clock(F.col("start_time"))
    )
    lead = [c for c in ("query_id", "rank") if c in results.columns]
    return shown.select(*lead, *RESULT_COLUMNS)
