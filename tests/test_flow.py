"""Ingest to search end to end, the shared folder, and rows that are easily lost."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid import spreading
from reelgrid.operators.fusion import attach_segments, retrieve, rrf_fuse
from reelgrid.operators.models import encode_column, letter_profile, token_overlap
from reelgrid.operators.vectors import zero_shot_labels
from reelgrid.plans.ingest import build_indexes, ingest
from reelgrid.plans.search import auto_track, candidates
from reelgrid.sources.media import media_inventory
from reelgrid.sources.tables import read_ground_truth, read_lexical_index, read_stored_segments, read_vectors, result_output


def test_ingest_index_search(spark, rows, tmp_path):
    media = rows([("m", "m.mp4", 4.0, 25.0, 100), ("n", "n.mp4", 3.0, 25.0, 75)], "media_id string, video_file string, duration double, fps double, total_frames bigint")
    said = [("m", 0.0, 4.0, 0.0, 0.9, "red fox runs"), ("m", 0.0, 4.0, 2.0, 2.9, "blue bird sings"), ("n", 0.0, 3.0, 1.0, 1.9, "red bird sleeps")]
    chunks = rows(said, "media_id string, chunk_start double, chunk_end double, rel_start double, rel_end double, text string")
    path = str(tmp_path / "index")
    build_indexes(ingest(media, 1.0, asr_chunks=chunks), path, encoder=letter_profile, dim=26)
    segments = read_stored_segments(spark, f"{path}/segments")
    queries = rows([(1, "red fox", "red fox"), (2, "bird", "bird"), (3, "nothing", "zzz")], "query_id bigint, original_query string, text_query string")
    asked = encode_column(queries, "text_query", letter_profile, 26).select("query_id", "embedding")
    found = candidates(
        queries, segments, read_lexical_index(spark, f"{path}/lexical"),
        {"text_dense": asked}, {"text_dense": read_vectors(spark, f"{path}/vectors", "text_dense")},
    )
    final = auto_track(queries, found, token_overlap, depth=10, final=2)
    shown = result_output(final.select("*")).where("rank = 1").collect()
    best = {r.query_id: r.text for r in shown}
    assert "red fox" in best[1] and "bird" in best[2]
    assert all(r["rank"] <= 2 for r in final.collect())
    assert segments.where("text <> ''").count() == read_vectors(spark, f"{path}/vectors", "text_dense").count()


def test_short_cells_and_files_of_one_stem_stay_apart(spark, rows, tmp_path):
    folder = tmp_path / "media"
    folder.mkdir()
    for name in ("a.mp4", "a.avi", "b.mp4"):
        (folder / name).write_bytes(b"x")
    files = media_inventory(spark, str(folder))
    assert sorted(r.media_id for r in files.collect()) == ["a.avi", "a.mp4", "b"]
    media = files.select("media_id", "video_file", F.lit(2.0).alias("duration"), F.lit(25.0).alias("fps"), F.lit(50).cast("bigint").alias("total_frames"))
    said = [(m, 0.0, 2.0, s, s + 0.45, f"{w} word") for m in ("a.mp4", "a.avi") for s, w in ((0.0, "zero"), (0.51, "half"), (1.01, "one"))]
    chunks = rows(said, "media_id string, chunk_start double, chunk_end double, rel_start double, rel_end double, text string")
    path = str(tmp_path / "index")
    build_indexes(ingest(media, 0.5, asr_chunks=chunks), path)
    segments = read_stored_segments(spark, f"{path}/segments")
    assert segments.select("segment_id").distinct().count() < segments.count() == segments.select("segment_key").distinct().count()
    queries = rows([(1, "word", "word")], "query_id bigint, original_query string, text_query string")
    found = candidates(queries, segments, read_lexical_index(spark, f"{path}/lexical"), {}, {})
    spoken = segments.where("text <> ''")
    hits = found.select("video_file", "start_time").collect()
    assert len(hits) == len(set(hits)) <= spoken.count()
    assert {r.segment_id for r in result_output(found).collect()} <= {r.segment_id for r in segments.collect()}


def test_nothing_to_search_in(rows):
    queries = rows([(1, "a")], "query_id bigint, text_query string")
    assert retrieve(queries, None, {}, {}).collect() == []


def test_weights_count_lists_without_a_first_row(rows):
    hits = [(1, "text_dense", "x", 2, 0.5), (1, "text_sparse", "x", 1, 0.5)]
    got = rrf_fuse(rows(hits, "query_id int, source string, segment_id string, rank int, score double"), {"text_dense": 0.35, "text_sparse": 0.2}, 60).first()
    assert got["score"] == pytest.approx((0.35 / 62 + 0.2 / 61) / 0.55)


def test_segments_are_cut_to_the_hits_before_a_shuffle(spark, rows, tmp_path):
    wide = [(f"s{i}", "v", 0.0, 1.0, f"text {i}", "") for i in range(500)]
    path = str(tmp_path / "segments")
    rows(wide, "segment_id string, video_file string, start_time double, end_time double, text string, keyframe_path string").write.parquet(path)
    hits = rows([(1, "s3"), (2, "s9"), (2, "gone")], "query_id int, segment_id string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = attach_segments(hits, spark.read.parquet(path))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
        assert {(r.query_id, r.text) for r in found.collect()} == {(1, "text 3"), (2, "text 9"), (2, "")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_labels_of_repeated_ids_and_other_widths(rows):
    rng = np.random.default_rng(1)
    labels = [(i, f"l{i}", rng.normal(size=8).tolist()) for i in range(40)]
    held = [(i // 2, (4 * rng.normal(size=4 if i % 5 == 3 else 12 if i % 5 == 4 else 8)).tolist()) for i in range(40)]
    vectors = rows(held, "segment_id int, embedding array<double>")
    named = rows(labels, "pos int, label string, embedding array<double>")
    matrix = np.array([v for _, _, v in labels])
    expected = []
    for i, v in held:
        kept = []
        if len(v) == 8:
            weights = np.exp(matrix @ (np.array(v) / np.linalg.norm(v)))
            kept = [f"l{j}" for j in np.flatnonzero(np.round(weights / weights.sum(), 12) >= 0.05)]
        expected.append((i, kept))
    for sent in (100, 5):
        got = zero_shot_labels(vectors, named, 0.05, max_sent=sent)
        assert sorted((r.segment_id, r.labels) for r in got.collect()) == sorted(expected)


def test_failed_batches_are_flagged(rows):
    def broken():
        def encode(texts):
            if "bad" in texts:
                raise ValueError
            return np.ones((len(texts), 2))

        return encode

    table = rows([(1, "good"), (2, "bad"), (3, " ")], "id int, text string").repartition(3, "id")
    got = encode_column(table, "text", broken, 2, batch_size=1, flag="encoded").collect()
    assert {r.id: r.encoded for r in got} == {1: True, 2: False, 3: False}


def test_equal_query_texts_are_told_apart(spark, tmp_path):
    path = tmp_path / "gt.json"
    path.write_text('[{"query": "q", "segments": [{"start": 1, "end": 2}]}, {"query": "q", "segments": [{"start": 5, "end": 6}]}]')
    got = read_ground_truth(spark, str(path)).collect()
    assert len({r.query_id for r in got}) == 2 and {r.query for r in got} == {"q"}


def test_shared_folder_without_a_setting(spark, monkeypatch):
    class Session:
        """A session in which the folder is not set and settings cannot be written."""

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        sparkContext = spark.sparkContext  # noqa: N815

    monkeypatch.setattr(spreading, "_LOCAL", {})
    first = spreading.shared_dir(Session)
    assert spreading.shared_dir(Session) == first


def test_scratch_is_cleared(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(spreading, "shared_dir", lambda _: str(tmp_path))
    assert spreading.stored(spark.range(5), "numbers").count() == 5
    assert list(tmp_path.glob("reelgrid/*/numbers-*"))
    assert spreading.clear_scratch(spark) and not list(tmp_path.glob("reelgrid/*"))
