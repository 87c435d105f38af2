from __future__ import annotations

import json

from conftest import collect

from reelgrid.operators import fanout as fo
from reelgrid.operators import stats as st
from reelgrid.plans.ingest import build_indexes, ingest
from reelgrid.sources import tables as tb
from reelgrid.sources.media import media_inventory

RESPONSES = "query_id bigint, original_query string, response string"


def test_media_inventory(spark, tmp_path):
    for name in ("b.mp4", "a.webm", "notes.txt", "c.MP4"):
        (tmp_path / name).write_bytes(b"12345")
    (tmp_path / "inner").mkdir()
    (tmp_path / "inner" / "d.mp4").write_bytes(b"1")
    found = media_inventory(spark, str(tmp_path))
    assert collect(found, "video_file", "media_id", "length") == [("a.webm", "a", 5), ("b.mp4", "b", 5)]
    assert media_inventory(spark, str(tmp_path / "b.mp4")).count() == 1
    scan = found._jdf.queryExecution().executedPlan().toString().split("ReadSchema", 1)[-1]
    assert "content" not in scan.splitlines()[0]


def test_segments_from_json(spark, tmp_path):
    rows = [
        {"segment_id": "a_00000", "video_file": "a.mp4", "start_time": 0.0, "extra": 1},
        {"segment_id": "a_00001", "video_file": "a.mp4", "asr_text": "old"},
        {"segment_id": "a_00001", "video_file": "a.mp4", "asr_text": "new", "ocr_texts": ["t"]},
    ]
    (tmp_path / "s.json").write_text(json.dumps(rows))
    got = tb.read_segments(spark, str(tmp_path / "s.json"))
    assert collect(got, "segment_id", "media_id", "asr_text", "ocr_texts", "end_time") == [
        ("a_00000", "a", "", [], 0.0),
        ("a_00001", "a", "new", ["t"], 0.0),
    ]


def test_ground_truth_layouts(spark, tmp_path):
    nested = [
        {"query": "q1", "segments": [{"start": 1, "end": 2, "aspects": ["x"]}, {"start": 3}]},
        {"segments": [{"start": 1, "end": 2}]},
        {"query": "q2", "segments": []},
    ]
    (tmp_path / "n.json").write_text(json.dumps(nested))
    got = tb.read_ground_truth(spark, str(tmp_path / "n.json"))
    assert collect(got, "query", "gt_id", "start", "end", "aspects") == [
        ("q1", 0, 1.0, 2.0, ["x"]),
        ("q1", 1, 3.0, 0.0, []),
        ("q2", None, None, None, None),
    ]
    (tmp_path / "one.json").write_text(json.dumps(nested[0]))
    assert tb.read_ground_truth(spark, str(tmp_path / "one.json")).count() == 2
    (tmp_path / "f.json").write_text(json.dumps([{"start": 10.5, "end": 25.0, "text": "t", "aspects": ["a", "b"]}]))
    flat = tb.read_ground_truth(spark, str(tmp_path / "f.json"), flat_query="q")
    assert collect(flat, "query", "start", "end", "text", "aspects") == [("q", 10.5, 25.0, "t", ["a", "b"])]


def test_ingest_writes_and_reads_indexes(spark, rows, tmp_path):
    media = rows([("m", "m.mp4", 3.0, 25.0, 75)], "media_id string, video_file string, duration double, fps double, total_frames bigint")
    chunks = rows(
        [("m", 0, 0.0, 29.0, 0.0, 1.2, "hello there"), ("m", 1, 0.0, 29.0, 1.3, 1.9, "world")],
        "media_id string, pos bigint, chunk_start double, chunk_end double, rel_start double, rel_end double, text string",
    )
    clips = rows([("m", 0, 0.0, 2.0, [1.0, 2.0])], "media_id string, pos bigint, start double, end double, embedding array<float>")
    segments = ingest(media, asr_chunks=chunks, clips=clips)
    build_indexes(segments, str(tmp_path), clips=clips)
    stored = tb.read_stored_segments(spark, f"{tmp_path}/segments")
    assert collect(stored, "seg_idx", "asr_text", "has_video_embedding", "has_frame_embedding") == [
        (0, "hello there world", True, False),
        (1, "hello there world", True, False),
        (2, "", False, False),
    ]
    assert tb.read_postings(spark, f"{tmp_path}/postings").count() == 2
    assert tb.read_vectors(spark, f"{tmp_path}/vectors", "temporal").count() == 2
    status = st.index_status({"text_sparse": tb.read_postings(spark, f"{tmp_path}/postings"), "audio": None})
    assert collect(status) == [("audio", 0, False), ("text_sparse", 2, True)]


def test_pending_media_counts_empty_transcripts_as_done(rows):
    media = rows([("a",), ("b",), ("c",)], "media_id string")
    done = rows([("a",), ("c",)], "media_id string")
    assert collect(st.pending_media(media, done)) == [("b",)]


def test_ingest_stats(rows):
    media = rows([("a", 10.0), ("b", 5.0)], "media_id string, duration double")
    segments = rows([("a",), ("a",)], "media_id string")
    errors = rows([("b", "codec"), ("b", "again")], "media_id string, error string")
    assert collect(st.ingest_stats(media, segments, errors)) == [(2, 1, 1, 2, 10.0)]


def test_result_output(rows):
    results = rows(
        [("s", "v.mp4", 75.0, 76.0, "t", 0.123456, "fused", "k.jpg", 1)],
        "segment_id string, video_file string, start_time double, end_time double, text string, score double, source string, keyframe_path string, extra int",
    )
    assert collect(tb.result_output(results), "score", "time_display") == [(0.1235, "01:15")]


def test_fan_out_of_unanalyzed_queries(rows):
    schema = "query_id bigint, original_query string, visual_query string, temporal_query string, audio_query string, ocr_query string, text_query string, query_type string"
    queries = rows([(1, "o", None, None, None, None, None, None), (2, "o", "", "t", "", "", "", "audio")], schema)
    got = collect(fo.fan_out_queries(queries), "query_id", "visual_query", "temporal_query", "audio_query", "ocr_query", "text_query", "query_type")
    assert got == [(1, "o", "o", "o", "o", "o", "general"), (2, "o", "t", "", "", "o", "audio")]


def test_parse_analysis(rows):
    good = '{"visual_query": "v", "query_type": "action", "entities": ["e"]}'
    responses = rows(
        [
            (1, "o", f"Sure:\n```json\n{good}\n```\nbye"),
            (2, "o", f"text {good} text"),
            (3, "o", "{broken"),
            (4, "o", "```\n{}\n```"),
            (5, "o", '{"query_type": "strange", "audio_query": null}'),
        ],
        RESPONSES,
    )
    got = collect(fo.parse_analysis(responses), "query_id", "visual_query", "audio_query", "query_type", "entities")
    assert got == [
        (1, "v", "", "action", ["e"]),
        (2, "v", "", "action", ["e"]),
        (3, "o", "o", "general", []),
        (4, "o", "", "general", []),
        (5, "o", "", "general", []),
    ]


def test_parse_ratings(rows):
    responses = rows([(1, "", '```json\n[{"id": "a", "score": 0.5}, {"id": "b"}, {"id": "a", "score": 0.75}]\n```'), (2, "", "nope")], RESPONSES)
    assert collect(fo.parse_rating_lists(responses)) == [(1, "a", 0.75), (1, "b", 0.0)]
    numbers = rows([(1, "", "0.85"), (2, "", "85.5"), (3, "", "none"), (4, "", "about 300")], RESPONSES)
    assert collect(fo.parse_rating_numbers(numbers), "query_id", "rating") == [(1, 0.0), (2, 0.85), (3, None), (4, 1.0)]


def test_enrich_only_entity_queries(rows):
    queries = rows([(1, "v", "entity_specific"), (2, "v", "action"), (3, "v", "entity_specific")], "query_id bigint, visual_query string, query_type string")
    knowledge = rows([(1, " " + "k" * 600), (2, "x")], "query_id bigint, knowledge string")
    got = {r["query_id"]: (r["visual_query"], len(r["entity_knowledge"])) for r in fo.enrich_queries(queries, knowledge).collect()}
    assert got == {1: ("v. " + "k" * 600, 600), 2: ("v", 1), 3: ("v", 0)}
    cut = fo.enrich_queries(queries, knowledge, knowledge_chars=500, snippet_chars=200).where("query_id = 1").first()
    assert (cut["visual_query"], len(cut["entity_knowledge"])) == ("v. " + "k" * 200, 500)
