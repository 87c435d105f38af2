from __future__ import annotations

import random

import pytest
from conftest import collect
from pyspark.sql import functions as F

from reelgrid.operators import align as al
from reelgrid.operators import transcripts as tr
from reelgrid.operators.grid import feature_windows, sample_plan, sliding_windows, time_grid
from reelgrid.operators.ocr import clean_ocr

MEDIA = "media_id string, video_file string, duration double, fps double, total_frames bigint"
ITEMS = "media_id string, pos bigint, start double, end double, text string"


@pytest.fixture()
def media(rows):
    def make(duration, fps=25.0, frames=100):
        return rows([("m", "dir/m.x.mp4", float(duration), fps, frames)], MEDIA)

    return make


def test_grid_tail_and_ids(media):
    cells = collect(time_grid(media(10.4), 2.0), "seg_idx", "start_time", "end_time", "segment_id")
    assert len(cells) == 6
    assert cells[-1] == (5, 10.0, 10.4, "m.x_00010")


def test_grid_of_nothing_is_empty(media):
    assert time_grid(media(0), 1.0).count() == 0


def test_grid_width_has_a_floor(media):
    assert time_grid(media(1.0), 0.01).count() == 10


def test_grid_tiles_the_duration(media):
    for duration, d in ((1.0, 0.1), (7.3, 0.7), (20_000.5, 1.0)):
        cells = sorted(collect(time_grid(media(duration), d), "t_start", "t_end"))
        assert cells[0][0] == 0.0 and cells[-1][1] == duration
        assert all(a[1] == pytest.approx(b[0]) for a, b in zip(cells, cells[1:]))


def test_long_segment_id_is_not_cut(media):
    last = time_grid(media(360_001), 360_000).orderBy("seg_idx").collect()[-1]
    assert last["segment_id"] == "m.x_360000"


def test_sliding_windows(media):
    audio = collect(sliding_windows(media(6.0), 5, 2.5, min_tail=1.0), "start", "end")
    assert audio == [(0.0, 5.0), (2.5, 6.0), (5.0, 6.0)]
    clips = collect(sliding_windows(media(9.0), 4, 2, full_only=True), "start", "end")
    assert clips == [(0.0, 4.0), (2.0, 6.0), (4.0, 8.0)]


def test_feature_windows(media):
    assert collect(feature_windows(media(31.0), "asr"), "start", "end") == [(0.0, 30.0), (29.0, 31.0)]
    assert collect(feature_windows(media(5.0), "clips"), "start", "end") == [(0.0, 4.0)]
    assert collect(feature_windows(media(3.0), "audio"), "start", "end") == [(0.0, 3.0)]


def test_sampling_steps_are_whole(media):
    plan = collect(sample_plan(media(4, fps=29.97, frames=60), 1.0), "frame_idx", "timestamp")
    assert plan == [(0, 0.0), (29, 29 / 29.97), (58, 58 / 29.97)]
    assert sample_plan(media(4, fps=0.0), 1.0).count() == 0


def _asr(rows, items):
    return rows([("m", i, float(s), float(e), text) for i, (s, e, text) in enumerate(items)], ITEMS)


def test_overlap_edges_are_open(media, rows):
    cells = collect(al.align_asr(media(5), _asr(rows, [(1, 2, "a")])), "seg_idx", "asr_text")
    assert cells == [(1, "a")]


def test_distinct_texts_in_item_order(media, rows):
    items = _asr(rows, [(0, 1, " b "), (0.5, 0.5, "a"), (0.2, 0.9, "b"), (0.1, 0.2, "  ")])
    assert collect(al.align_asr(media(2), items), "seg_idx", "asr_text") == [(0, "b a")]


def test_overlap_join_equals_brute_force(media, rows):
    rnd = random.Random(7)
    items = []
    for _ in range(120):
        start = round(rnd.uniform(-2, 33), 2)
        items.append((start, round(start + rnd.choice([0, -1, 0.3, 1, 2.5, 40]), 2), "t"))
    duration, d = 30.35, 0.7
    pairs = set(collect(al.overlap_join(media(duration), _asr(rows, items), d), "seg_idx", "pos"))
    expected = set()
    for pos, (s, e, _) in enumerate(items):
        stop = s + 0.001 if e <= s else e
        for i in range(44):
            if s < min((i + 1) * d, duration) and stop > i * d:
                expected.add((i, pos))
    assert pairs == expected


AUDIO = "media_id string, pos bigint, start double, end double, event_labels array<string>, embedding array<float>"


def test_audio_picks_largest_overlap_and_keeps_point_labels(media, rows):
    audio = rows(
        [
            ("m", 0, 0.0, 0.4, ["x", " y"], [1.0]),
            ("m", 1, 0.2, 0.6, ["y"], [2.0]),
            ("m", 2, 0.0, 1.0, [], None),
            ("m", 3, 1.0, 1.0, ["z"], [3.0]),
        ],
        AUDIO,
    )
    cells = collect(al.align_audio(media(3), audio), "seg_idx", "audio_events", "audio_pos")
    assert cells == [(0, ["x", "y"], 0), (1, ["z"], None)]


OCR = "media_id string, pos bigint, timestamp double, start double, end double, texts array<string>"


def test_screen_text_points_and_ranges(media, rows):
    ocr = rows(
        [
            ("m", 0, 1.0, None, None, ["P", "p", "P"]),
            ("m", 1, 3.0, None, None, ["end"]),  # at the media's end: dropped
            ("m", 2, None, 0.5, 1.0, ["r"]),
            ("m", 3, None, 2.0, 2.0, ["none"]),
        ],
        OCR,
    )
    assert collect(al.align_ocr(media(3), ocr), "seg_idx", "ocr_texts") == [(0, ["r"]), (1, ["P", "p"])]


def _frames(rows, stamps):
    data = [("m", i, float(ts), [1.0]) for i, ts in enumerate(stamps)]
    return rows(data, "media_id string, idx bigint, timestamp double, embedding array<float>")


@pytest.mark.parametrize(
    ("stamps", "cell", "expected"), [([0.0, 1.0], 0, 0), ([0.5, 2.25], 1, 1), ([0.5, 2.5], 1, 0), ([2.5, 0.5], 1, 0)]
)
def test_nearest_frame(media, rows, stamps, cell, expected):
    found = dict(collect(al.align_frames(media(3), _frames(rows, stamps)), "seg_idx", "frame_idx"))
    assert found[cell] == expected


def test_nearest_frame_equals_brute_force_across_chunks(media, rows, monkeypatch):
    import reelgrid.spreading as spreading

    monkeypatch.setattr(al, "SPAN", 4)
    monkeypatch.setattr(spreading, "SPAN", 4)
    rnd = random.Random(3)
    stamps = [round(rnd.choice([rnd.uniform(0, 3), rnd.uniform(20, 22), rnd.uniform(39, 55)]), 1) for _ in range(40)]
    duration, d = 50.3, 1.0
    got = {r["seg_idx"]: r for r in al.align_frames(media(duration), _frames(rows, stamps), d).collect()}
    assert len(got) == 51
    for i, row in got.items():
        s, e = i * d, min((i + 1) * d, duration)
        mid = (s + e) / 2
        plain = min(range(len(stamps)), key=lambda j: (abs(stamps[j] - mid), j))
        halved = min(
            range(len(stamps)), key=lambda j: (abs(stamps[j] - mid) * (0.5 if s <= stamps[j] < e else 1.0), j)
        )
        assert (row["frame_idx"], row["keyframe_idx"]) == (halved, plain)


def test_assembled_segments(media, rows):
    asr = _asr(rows, [(0, 1.5, "said")])
    frames = _frames(rows, [0.4])
    segments = al.with_full_text(al.align(media(2.5), 1.0, asr=asr, frames=frames))
    assert collect(segments, "seg_idx", "asr_text", "audio_events", "frame_idx", "text") == [
        (0, "said", [], 0, "said"),
        (1, "said", [], 0, "said"),
        (2, "", [], 0, ""),
    ]
    assert collect(al.coverage(segments), "media_id", "n_segments", "n_asr", "n_clips", "n_frames") == [
        ("m", 3, 2, 0, 3),
        (None, 3, 2, 0, 3),
    ]
    vectors = al.segment_vectors(segments, frames=frames)
    assert vectors.count() == 3


def _merge_by_hand(items, min_duration, max_gap):
    merged = []
    for pos, (s, e, text) in enumerate(items):
        if merged and (e - s < min_duration or s - merged[-1][2] <= max_gap):
            merged[-1] = (merged[-1][0], merged[-1][1], e, merged[-1][3] + " " + text)
        else:
            merged.append((pos, s, e, text))
    return merged


@pytest.mark.parametrize(
    "items",
    [
        [(0, 1, "a"), (1.25, 2, "b")],
        [(0, 1, "a"), (5, 5.25, "b")],
        [(0, 1, "a"), (2, 3, "b")],
    ],
)
def test_merge_short(rows, items):
    got = collect(tr.merge_short(_asr(rows, items)), "pos", "start", "end", "text")
    assert got == _merge_by_hand(items, 0.5, 0.3)


def test_merge_runs_across_chunks(rows, monkeypatch):
    monkeypatch.setattr(tr, "CHUNK_ROWS", 3)
    rnd = random.Random(11)
    items, at = [], 0.0
    for i in range(100):
        at += rnd.choice([0.0, 0.2, 0.9])
        end = at + rnd.choice([0.25, 1.0])
        items.append((at, end, f"w{i}"))
        at = end
    got = sorted(collect(tr.merge_short(_asr(rows, items)), "pos", "start", "end", "text"))
    assert got == _merge_by_hand(items, 0.5, 0.3)


def test_chunk_times(rows):
    chunks = rows(
        [
            (0, 30.0, 59.0, 1.5, 2.5, " a "),
            (1, 30.0, 59.0, None, None, "b"),
            (2, 30.0, 59.0, 3.0, None, "\n"),
        ],
        "pos int, chunk_start double, chunk_end double, rel_start double, rel_end double, text string",
    )
    assert collect(tr.to_absolute(chunks)) == [(0, 31.5, 32.5, "a"), (1, 30.0, 59.0, "b")]


def test_clean_ocr(rows):
    texts = ["A", "12", "1234", "Hà", "hà", "low"]
    data = [("m", 1.234, i, t, 0.1 if t == "low" else 0.9) for i, t in enumerate(texts)]
    data.append(("m", 2.0, 0, "1", 0.9))
    got = clean_ocr(rows(data, "media_id string, timestamp double, pos int, text string, confidence double"))
    assert collect(got, "timestamp", "texts") == [(1.23, ["1234", "Hà"])]


def test_one_media_item_holding_most_rows_is_spread(media, rows):
    """Nothing before the last exchange is partitioned by media item alone."""
    items = _asr(rows, [(i * 0.5, i * 0.5 + 1, f"t{i % 7}") for i in range(400)])
    plan = al.align_asr(media(200), items)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("seg_idx" in line or "_salt" in line or "_block" in line for line in exchanges)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert al.align_asr(media(200), items).agg(F.count("*")).first()[0] == 200


def test_streams_share_one_pass(media, rows):
    """Transcripts and clips meet the durations, the cells and the grid in one pass."""
    asr = _asr(rows, [(0, 1.5, "said"), (1, 2, " ")])
    clips = rows([("m", 0, 0.0, 1.0, [1.0]), ("m", 1, 1.0, 2.5, [1.0])], "media_id string, pos bigint, start double, end double, embedding array<double>")
    segments = al.align(media(2.5), 1.0, asr=asr, clips=clips)
    assert collect(segments, "seg_idx", "asr_text", "ocr_texts", "clip_pos") == [
        (0, "said", [], 0),
        (1, "said", [], 1),
        (2, "", [], 1),
    ]
    plan = segments._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2
