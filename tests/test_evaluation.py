from __future__ import annotations

import random

import pytest
from conftest import collect
from pyspark.sql import functions as F

from reelgrid.functions.timing import iou
from reelgrid.operators import relevance as rel
from reelgrid.plans.evaluation import evaluation

RESULTS = "query_id string, rank int, start_time double, end_time double, text string"
GT = "query_id string, gt_id bigint, start double, end double, aspects array<string>"


def _iou(a, b, c, d):
    b, d = (a + 5 if b <= a else b), (c + 5 if d <= c else d)
    shared = max(0.0, min(b, d) - max(a, c))
    union = (b - a) + (d - c) - shared
    return shared / union if union > 0 else 0.0


def test_iou(rows):
    cases = [(0, 0, 0, 5), (0, 2, 1, 3), (0, 1, 1, 2), (3, 1, 4, 9)]
    df = rows([tuple(map(float, c)) for c in cases], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(iou(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got == pytest.approx([_iou(*c) for c in cases])
    assert got[0] == 1.0


def test_average_precision_can_exceed_one(rows):
    results = rows([("q", 1, 0.0, 5.0, ""), ("q", 2, 0.0, 5.0, "")], RESULTS)
    gt = rows([("q", 0, 0.0, 5.0, [])], GT)
    judged = rel.relevance(results, gt)
    assert rel.average_precision(judged, gt).first()["average_precision"] == 2.0
    assert rel.average_precision(judged, gt, k=1).first()["average_precision"] == 1.0
    assert rel.average_precision(judged, gt, k=0).first()["average_precision"] == 2.0


def test_query_without_results_is_a_row_of_zeros(rows):
    results = rows([], RESULTS)
    gt = rows([("q", 0, 0.0, 5.0, ["a"])], GT)
    got = rel.evaluate(results, gt, rows([("q",), ("none",)], "query_id string"))
    assert collect(got, "query_id", "map_at_k", "mrr", "aspect_recall", "recall", "num_results", "num_ground_truth") == [
        ("none", 0.0, 0.0, 0.0, 0.0, 0, 0),
        ("q", 0.0, 0.0, 0.0, 0.0, 0, 1),
    ]


def test_media_is_compared_only_on_request(rows):
    schema = RESULTS + ", video_file string"
    results = rows([("q", 1, 0.0, 5.0, "", "a.mp4")], schema)
    gt = rows([("q", 0, 0.0, 5.0, [], "b.mp4")], GT + ", video_file string")
    assert rel.relevance(results, gt).first()["relevant"]
    assert not rel.relevance(results, gt, match_media=True).first()["relevant"]


def test_aspects(rows):
    results = rows([("q", 2, 0.0, 1.0, "CAR"), ("q", 1, 0.0, 1.0, "Red"), ("q", 3, 0.0, 1.0, "")], RESULTS)
    gt = rows([("q", 0, 0.0, 1.0, [" red CAR ", "red"]), ("q", 1, 0.0, 1.0, ["blue", "red"])], GT)
    assert rel.aspect_recall(results, gt).first()["aspect_recall"] == 0.75


def _by_hand(results, gt, k=5, threshold=0.3):
    best = [max((_iou(s, e, gs, ge) for gs, ge in gt), default=0.0) for s, e in results]
    good = [b >= threshold for b in best]
    ap, seen = 0.0, 0
    for i, g in enumerate(good[:k], 1):
        if g:
            seen += 1
            ap += seen / i
    found = sum(any(_iou(s, e, gs, ge) >= threshold for s, e in results) for gs, ge in gt)
    return (
        ap / len(gt),
        next((1 / i for i, g in enumerate(good, 1) if g), 0.0),
        sum(best) / len(best),
        sum(good) / len(good),
        found / len(gt),
    )


def test_metrics_equal_brute_force(rows, monkeypatch):
    monkeypatch.setattr(rel, "BLOCK", 3)  # lists longer than one packed row
    rnd = random.Random(9)
    result_rows, gt_rows, expected = [], [], {}
    for q in range(4):
        span = lambda: (lambda s: (s, round(s + rnd.choice([0, 1.0, 3.0, 9.0]), 1)))(round(rnd.uniform(0, 30), 1))
        results, gt = [span() for _ in range(10)], [span() for _ in range(1 + 40 * (q == 0))]
        result_rows += [(f"q{q}", i, s, e, "") for i, (s, e) in enumerate(results, 1)]
        gt_rows += [(f"q{q}", i, s, e, []) for i, (s, e) in enumerate(gt)]
        expected[f"q{q}"] = _by_hand(results, gt)
    metrics, means, report = evaluation(
        rows(result_rows, RESULTS), rows(gt_rows, GT), rows([(q,) for q in expected], "query_id string")
    )
    for r in metrics.collect():
        got = (r["map_at_k"], r["mrr"], r["avg_iou"], r["precision_at_k"], r["recall"])
        assert got == pytest.approx(expected[r["query_id"]], abs=6e-5)
    assert means.first()["n_queries"] == 4 and report.count() == 4


@pytest.mark.parametrize(("value", "grade"), [(0.7, "excellent"), (0.5, "good"), (0.3, "fair"), (0.29, "needs improvement")])
def test_grade(rows, value, grade):
    metrics = rows([(value, 0.5, 0.5)], "map_at_k double, mrr double, avg_iou double")
    assert rel.evaluate_all(metrics).first()["grade"] == grade
