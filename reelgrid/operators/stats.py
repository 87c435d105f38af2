"""Ingest bookkeeping: what is still to do, what was done, what the tables hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.spreading import lookup_join

_FEATURE_SIZE = {
    "asr": F.length,
    "audio": F.size,
    "ocr": F.size,
}
_FEATURE_COLUMN = {"asr": "text", "audio": "event_labels", "ocr": "texts"}


def pending_media(media: DataFrame, completed: DataFrame, key: str = "media_id") -> DataFrame:
    """Media items without a stored transcript; an empty transcript counts as stored."""
    return media.join(completed.select(key), key, "left_anti")


def ingest_stats(media: DataFrame, segments: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: media items seen, processed and failed, their segments and total duration.

    The failures themselves stay rows of ``errors``; they are counted here, not collected.
    """
    failed = errors.select("media_id").distinct().withColumn("_failed", F.lit(1))
    counted = segments.groupBy("media_id").agg(F.count(F.lit(1)).alias("_segments"))
    per_media = media.join(failed, "media_id", "left").join(counted, "media_id", "left")
    ok = F.col("_failed").isNull()
    return per_media.agg(
        F.count(F.lit(1)).alias("total_media"),
        F.count_if(ok).alias("processed_media"),
        F.count_if(~ok).alias("failed_media"),
        F.coalesce(F.sum(F.when(ok, F.col("_segments"))), F.lit(0)).alias("total_segments"),
        F.coalesce(F.sum(F.when(ok, F.col("duration"))), F.lit(0.0)).alias("total_duration_sec"),
    )


def ingest_errors(media: DataFrame, errors: DataFrame) -> DataFrame:
    """The error list beside the statistics: ``media_id, video_file, error``, one row per failure.

    Failures of media items that are not in the inventory keep a null file.
    """
    files = media.select("media_id", "video_file")
    return lookup_join(errors.select("media_id", "error"), files, ["media_id"], ["error"]).select(
        "media_id", "video_file", "error"
    )


def feature_stats(kind: str, features: DataFrame) -> DataFrame:
    """Rows of one feature stream and its characters, labels or texts."""
    size = _FEATURE_SIZE[kind](_FEATURE_COLUMN[kind])
    return features.agg(
        F.lit(kind).alias("kind"),
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(size), F.lit(0)).alias("n_items"),
    )


def index_status(tables: dict[str, DataFrame | None]) -> DataFrame:
    """Rows and presence of every index; one that was never built counts 0."""
    present = {name: df for name, df in tables.items() if df is not None}
    spark = next(iter(present.values())).sparkSession
    names = spark.createDataFrame([(name,) for name in tables], "index_name string")
    counts = reduce(
        DataFrame.unionByName,
        [
            df.agg(F.lit(name).alias("index_name"), F.count(F.lit(1)).alias("n_rows"))
            for name, df in present.items()
        ],
    )
    return names.join(counts, "index_name", "left").select(
        "index_name",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.col("n_rows").isNotNull().alias("present"),
    )
