from __future__ import annotations

import math

import pytest
from conftest import collect
from pyspark.sql import functions as F

from reelgrid.operators import rerank as rr
from reelgrid.operators import verdict as vd

RESULTS = "query_id bigint, segment_id string, rank int, score double, text string, num_sources int"


@pytest.fixture()
def results(rows):
    return rows(
        [(1, "a", 1, 0.9, "ta", 1), (1, "b", 2, 0.8, "", 1), (1, "c", 3, 0.7, "tc", 1), (1, "d", 4, 0.6, "td", 1)],
        RESULTS,
    )


def test_rerank(results, rows):
    logits = rows([(1, "a", -1.0), (1, "b", 2.0), (1, "c", 0.0), (1, "d", 1.0)], "query_id bigint, segment_id string, logit double")
    got = collect(rr.rerank(results, logits), "rank", "segment_id", "score", "rerank_raw")
    assert [g[:2] for g in got] == [(1, "b"), (2, "d"), (3, "c"), (4, "a")]
    assert got[0][2] == pytest.approx(1 / (1 + math.exp(-2))) and got[0][3] == 2.0
    assert rr.rerank(results, None) is results


def test_passage_falls_back_to_the_id(results):
    assert [r[0] for r in results.orderBy("rank").select(rr.passage(results)).collect()] == ["ta", "b", "tc", "td"]


def test_blend(results, rows):
    ratings = rows([(1, "a", 0.0), (1, "d", 1.0)], "query_id bigint, segment_id string, rating double")
    got = {r["segment_id"]: r for r in rr.blend_scores(results, ratings).collect()}
    assert got["a"]["score"] == pytest.approx(0.27) and got["a"]["rank"] == 4
    assert got["d"]["score"] == pytest.approx(0.88) and got["d"]["rank"] == 1 and got["d"]["rerank_score"] == 1.0
    assert got["b"]["score"] == 0.8 and got["b"]["rerank_score"] == 0.0


def test_feedback_reaches_only_the_first_three(results, rows):
    feedback = rows([(1, "a", False), (1, "b", True), (1, "d", True)], "query_id bigint, segment_id string, relevant boolean")
    got = {r["segment_id"]: (r["rank"], pytest.approx(r["score"]), r["user_feedback"]) for r in rr.apply_feedback(results, feedback).collect()}
    assert got["b"] == (1, 1.04, "positive")
    assert got["c"] == (2, 0.7, "skipped")
    assert got["d"] == (3, 0.6, None)
    assert got["a"] == (4, 0.45, "negative")


def test_verification_penalty(results, rows):
    answers = rows(
        [(1, "a", None, None), (1, "b", False, 0.9), (1, "c", True, 0.8), (1, "d", False, 0.1)],
        "query_id bigint, segment_id string, verified boolean, confidence double",
    )
    got = {r["segment_id"]: (pytest.approx(r["score"]), r["verified"], r["verify_confidence"]) for r in rr.apply_verification(results, answers).collect()}
    assert got["a"] == (0.72, False, 0.5)
    assert got["b"] == (0.8, None, None)  # no text: not asked
    assert got["c"] == (0.7, True, 0.8)
    assert got["d"] == (0.6, None, None)  # fourth: not asked


ANSWERS = "query_id bigint, segment_id string, answer string"


def test_gate(results, rows):
    answers = rows([(1, "a", "no"), (1, "b", "No."), (1, "c", " yes, it does")], ANSWERS)
    assert collect(rr.verify_gate(results, answers), "rank", "segment_id") == [(1, "a"), (2, "c"), (3, "d")]


def test_gate_keeps_all_when_nothing_passes(rows):
    results = rows([(1, "a", 1, 0.5, "", 1), (1, "b", 2, 0.4, "", 1)], RESULTS)
    answers = rows([(1, "a", "NO"), (1, "b", "NO")], ANSWERS)
    assert rr.verify_gate(results, answers).count() == 2


@pytest.mark.parametrize(
    ("scores", "sources", "expected"),
    [
        ([0.7, 0.1], 1, "CORRECT"),
        ([0.65, 0.30], 1, "CORRECT"),
        ([0.65, 0.35], 1, "AMBIGUOUS"),
        ([0.5, 0.45], 3, "CORRECT"),
        ([0.5], 1, "AMBIGUOUS"),
        ([0.3, 0.29], 5, "INCORRECT"),
    ],
)
def test_fast_verdict(rows, scores, sources, expected):
    results = rows([(1, f"s{i}", i + 1, s, "", sources) for i, s in enumerate(scores)], RESULTS)
    verdicts = vd.fast_verdict(results)
    assert verdicts.first()["verdict"] == expected
    assert {r["crag_verdict"] for r in vd.with_verdict(results, verdicts).collect()} == {expected}


def test_verdicts_of_queries_without_results(results, rows):
    asked = rows([(1,), (2,)], "query_id bigint")
    assert collect(vd.fast_verdict(results, asked), "query_id", "verdict") == [(1, "CORRECT"), (2, "INCORRECT")]
    assert collect(vd.mean_verdict(results, asked), "query_id", "mean_score", "verdict") == [
        (1, pytest.approx(0.8), "CORRECT"),
        (2, 0.0, "INCORRECT"),
    ]
    assert collect(vd.top_verdict(results, asked), "query_id", "verdict", "reformulate") == [
        (1, "CORRECT", False),
        (2, "INCORRECT", True),
    ]


def _rounds(rows, means):
    data = [(q, r, f"s{r}{i}", i + 1, m) for (q, r), m in means.items() for i in range(2)]
    return rows(data, "query_id bigint, round int, segment_id string, rank int, score double")


def test_best_round(rows):
    rounds = _rounds(
        rows,
        {(1, 0): 0.5, (1, 1): 0.8, (1, 2): 0.9, (2, 0): 0.5, (2, 1): 0.3, (2, 2): 0.45, (3, 0): 0.75, (3, 1): 0.9},
    )
    chosen = {r["query_id"]: r["round"] for r in vd.best_round(rounds).collect()}
    assert chosen == {1: 1, 2: 0, 3: 0}
    assert {r["query_id"]: r["round"] for r in vd.best_round(rounds, compat=True).collect()} == {1: 1, 2: 2, 3: 0}
