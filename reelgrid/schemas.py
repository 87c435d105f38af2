"""Schemas and parameters of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Retrieval depths, fusion weights, lexical and verdict parameters.
TOP_K_RETRIEVAL = 100
TOP_K_RERANK = 20
TOP_K_FINAL = 5
RRF_K = 60
SOURCE_WEIGHTS = {
    "text_sparse": 0.20,
    "text_dense": 0.35,
    "visual": 0.25,
    "audio": 0.10,
    "temporal": 0.10,
}
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
THRESHOLD_CORRECT = 0.7
THRESHOLD_AMBIGUOUS = 0.4
IOU_THRESHOLD = 0.3
DEFAULT_INTERVAL_SEC = 5.0
LABEL_THRESHOLD = 0.15
OCR_MIN_CONFIDENCE = 0.35
QUERY_TYPES = ("entity_specific", "action", "audio", "general")
MEDIA_SUFFIXES = ("mp4", "avi", "mkv", "mov", "webm")

# How each stream is cut before it is encoded, in seconds, and frames read per second.
WINDOWS = {
    "audio": {"length": 5.0, "stride": 2.5, "min_tail": 1.0},
    "asr": {"length": 30.0, "stride": 29.0, "min_tail": 0.5},
    "clips": {"length": 4.0, "stride": 2.0, "full_only": True},
}
SAMPLE_RATES = {"frames": 1.0, "ocr": 0.5}

# Vector widths per index, and the sounds told apart by default.
VECTOR_DIMS = {"text_dense": 1024, "visual": 768, "temporal": 768, "audio": 512}
SOUND_LABELS = (
    "gunshot",
    "siren",
    "crowd",
    "music",
    "speech",
    "explosion",
    "car horn",
    "rain",
    "applause",
    "silence",
)

SOURCES = tuple(SOURCE_WEIGHTS)  # in the order the lists are searched
COMPONENT = {
    "text_sparse": "sparse_score",
    "text_dense": "dense_score",
    "visual": "visual_score",
    "audio": "audio_score",
    "temporal": "temporal_score",
}


_KINDS = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "strings": T.ArrayType(T.StringType()),
    "floats": T.ArrayType(T.FloatType()),
}


def _struct(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in fields.items()])


MEDIA = _struct(media_id="string", video_file="string", duration="double", fps="double", total_frames="bigint")

SEGMENT_FILE = _struct(
    segment_id="string",
    video_file="string",
    start_time="double",
    end_time="double",
    asr_text="string",
    audio_events="strings",
    ocr_texts="strings",
    action_labels="strings",
    keyframe_path="string",
)

FEATURES = {
    "asr": _struct(media_id="string", pos="bigint", start="double", end="double", text="string"),
    "audio": _struct(
        media_id="string", pos="bigint", start="double", end="double", event_labels="strings", embedding="floats"
    ),
    "ocr": _struct(
        media_id="string", pos="bigint", timestamp="double", start="double", end="double", texts="strings"
    ),
    "clips": _struct(media_id="string", pos="bigint", start="double", end="double", embedding="floats"),
    "frames": _struct(media_id="string", idx="bigint", timestamp="double", embedding="floats"),
}

_SPAN = {"start": "double", "end": "double", "text": "string", "aspects": "strings"}

GROUND_TRUTH_FILE = T.StructType(
    [*_struct(**_SPAN).fields, T.StructField("query", T.StringType()), T.StructField("segments", T.ArrayType(_struct(**_SPAN)))]
)

GROUND_TRUTH = _struct(query_id="string", gt_id="bigint", query="string", **_SPAN)

FEEDBACK = _struct(event_id="string", query_id="string", segment_id="string", relevant="boolean", ts="timestamp")

VECTORS = _struct(segment_id="string", modality="string", embedding="floats")

ANALYSIS = _struct(
    visual_query="string",
    temporal_query="string",
    audio_query="string",
    ocr_query="string",
    text_query="string",
    entities="strings",
    query_type="string",
)
