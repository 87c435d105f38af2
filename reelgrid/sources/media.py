"""Media files on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelgrid.functions.text import base_name, file_stem
from reelgrid.schemas import MEDIA_SUFFIXES


def media_inventory(spark: SparkSession, path: str) -> DataFrame:
    """One media file, or the media files directly in a folder; contents are never read.

    ``media_id`` is the file's stem, or its name where several files share a stem.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    stem, name = file_stem(F.col("path")), base_name(F.col("path"))
    alone = F.count(F.lit(1)).over(Window.partitionBy(stem)) == 1
    suffix = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    return files.where(suffix.isin(*MEDIA_SUFFIXES)).select(
        "path",
        name.alias("video_file"),
        F.when(alone, stem).otherwise(name).alias("media_id"),
        "length",
        "modificationTime",
    )
