"""Alignment by runs of cells against the alignment per cell."""

from __future__ import annotations

import random

import pytest
from conftest import collect

from reelgrid.operators import align as al
from reelgrid.operators import runs

MEDIA = "media_id string, video_file string, duration double, fps double, total_frames bigint"
ITEMS = "media_id string, pos bigint, start double, end double"


def _streams(rows, n, reach, seed=3):
    """Items of all four streams: points, ranges, reversed ends, some beyond either end of the media."""
    rnd = random.Random(seed)

    def times(i):
        start = round(rnd.uniform(-2, reach + 2), 2)
        return rnd.choice("mk"), i, start, round(start + rnd.choice([0, -1, 0.05, 0.3, 1, 2.5, reach]), 2)

    vector = lambda: rnd.choice([None, [], [1.0], [2.0]])
    asr = [(*times(i), rnd.choice(["a", "b", " ", None, "c d"])) for i in range(n)]
    audio = [(*times(i), rnd.choice([None, [], ["x", " y"], ["y", "x", "y"]]), vector()) for i in range(n)]
    clips = [(*times(i), vector()) for i in range(n)]
    ocr = [(m, p, s if p % 2 else None, None if p % 2 else s, None if p % 2 else e, ["P", "q"][: p % 3]) for m, p, s, e in map(times, range(n))]
    return {
        "asr": rows(asr, ITEMS + ", text string"),
        "audio": rows(audio, ITEMS + ", event_labels array<string>, embedding array<float>"),
        "ocr": rows(ocr, "media_id string, pos bigint, timestamp double, start double, end double, texts array<string>"),
        "clips": rows(clips, ITEMS + ", embedding array<float>"),
    }


def _media(rows, duration):
    return rows([(m, f"{m}.mp4", duration, 25.0, 100) for m in "mk"] + [("none", "n.mp4", None, 1.0, 1)], MEDIA)


@pytest.mark.parametrize("duration, d, span", [(30.35, 0.7, 4096), (12.0, 0.1, 4096), (12.34, 0.1, 16), (9.0, 3.0, 2)])
def test_runs_equal_cells(rows, monkeypatch, duration, d, span):
    monkeypatch.setattr(runs, "SPAN", span)
    media, streams = _media(rows, duration), _streams(rows, 40, duration)
    assert collect(runs.matched_by_runs(media, d, **streams)) == collect(al._matched(media, d, **streams))


def test_segments_by_runs_equal_segments_by_cells(rows):
    media, streams = _media(rows, 20.5), _streams(rows, 25, 20.0, seed=9)
    assert collect(al.align(media, 0.5, **streams, match=runs.matched_by_runs)) == collect(al.align(media, 0.5, **streams))


def test_a_long_item_is_few_rows_before_the_output(rows):
    """Ten hours in cells of a tenth of a second: one run per block of cells, 360,000 rows only at the end."""
    media = rows([("m", "m.mp4", 36_000.0, 25.0, 100)], MEDIA)
    asr = rows([("m", 0, 0.0, 36_000.0, "said"), ("m", 1, 100.0, 200.0, "more")], ITEMS + ", text string")
    found = runs.cover_runs(media, 0.1, asr=asr)
    assert found.count() == 88 + 2
    assert runs.expand_runs(found).count() == 360_000
    assert found.where("asr_text = 'said more'").selectExpr("seg_from", "seg_to").collect() == [(1000, 1999)]


def test_a_busy_media_item_is_spread(rows):
    """No exchange is partitioned by media item alone, and none is a cross join."""
    media = _media(rows, 30.0)
    plan = runs.cover_runs(media, 0.1, **_streams(rows, 30, 30.0))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("seg_from" in line or "_salt" in line or "_block" in line for line in exchanges)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_nothing_to_cover(rows):
    media, streams = _media(rows, 5.0), _streams(rows, 3, 5.0)
    empty = {kind: items.limit(0) for kind, items in streams.items()}
    assert runs.matched_by_runs(media, 1.0, **empty).count() == 0
    assert runs.matched_by_runs(media.limit(0), 1.0, **streams).count() == 0
