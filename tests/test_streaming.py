from __future__ import annotations

import os
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from conftest import collect
from pyspark.sql import functions as F

from reelgrid.schemas import FEEDBACK
from reelgrid.streaming import feeds
from reelgrid.workloads.streams import ROCKSDB, STATE_STORE

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def run(stream, path):
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").outputMode("append")
    writer.trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


@pytest.fixture()
def feed(spark, tmp_path):
    """A file stream that reads one written batch at a time."""

    def make(batches, schema):
        for i, batch in enumerate(batches):
            known = set(tmp_path.glob("in/*.parquet"))
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            for new in set(tmp_path.glob("in/*.parquet")) - known:
                os.utime(new, (1_700_000_000 + 60 * i,) * 2)  # files are read in the order of their times
        reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
        return reader.parquet(f"{tmp_path}/in")

    return make


def test_grid_drops_late_rows(feed, tmp_path):
    schema = "media_id string, ts timestamp, label string"
    batches = [
        [("m", at(1), "b"), ("m", at(5), "a"), ("m", at(8), "a")],
        [("m", at(100), "z")],
        [("m", at(105), "z")],  # rows are dropped by the watermark of the batch before
        [("m", at(2), "late"), ("m", at(200), "end")],
    ]
    cells = run(feeds.stream_grid(feed(batches, schema), "10 seconds", "20 seconds"), tmp_path)
    got = collect(cells.select("labels", "n_items", F.unix_timestamp("cell_start").alias("s")), "labels", "n_items")
    assert got == [(["a", "b"], 3), (["z"], 2)]


def test_merge_equals_the_batch_rule(spark, feed, tmp_path):
    schema = "media_id string, ts timestamp, pos bigint, start double, end double, text string"
    spans = [(0, 1, "a"), (1.25, 2, "b"), (10, 10.25, "c"), (20, 22, "d"), (22.1, 25, "e"), (60, 61, "f"), (400, 401, "g")]
    data = [("m", at(s), i, float(s), float(e), t) for i, (s, e, t) in enumerate(spans)]
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        merged = run(feeds.stream_merge(feed([data[:3], data[3:6], data[6:]], schema), "30 seconds"), tmp_path)
    finally:
        spark.conf.set(STATE_STORE, before)
    # the run that began last stays open
    assert collect(merged, "pos", "start", "end", "text", "n_rows") == [
        (0, 0.0, 10.25, "a b c", 3),
        (3, 20.0, 25.0, "d e", 2),
    ]


def test_merge_closes_idle_runs_whatever_the_batches(spark, feed, tmp_path):
    schema = "media_id string, ts timestamp, pos bigint, start double, end double, text string"
    spans = [(m, 40 * i + (i % 3), i) for i in range(24) for m in ("m", "n") if m == "m" or i < 9]
    data = [(m, at(s), i, float(s), s + 0.2, f"t{i}") for m, s, i in spans]
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        stream = feed([data[i : i + 6] for i in range(0, len(data), 6)], schema)
        merged = run(feeds.stream_merge(stream, "30 seconds", idle=40), tmp_path)
    finally:
        spark.conf.set(STATE_STORE, before)
    # a gap of 41 s ends a run although every row is short; the end of a media item does too
    got = sorted((r["media_id"], r["pos"], r["text"]) for r in merged.collect())
    expected = [("n", 0, "t0"), ("n", 1, "t1"), ("n", 2, "t2 t3"), ("n", 4, "t4"), ("n", 5, "t5 t6"), ("n", 7, "t7"), ("n", 8, "t8")]
    assert [g for g in got if g[0] == "n"] == expected
    assert [g for g in got if g[0] == "m"][:7] == [("m", i, t) for _, i, t in expected[:6]] + [("m", 8, "t8 t9")]


@pytest.mark.parametrize("compact_every", [20, 1])
def test_feedback_uses_all_verdicts_of_touched_lists(spark, rows, feed, tmp_path, compact_every):
    batches = [
        [("e1", "q", "a", False, at(1)), ("e1", "q", "a", False, at(1)), ("e2", "q", "b", True, at(2))],
        [("e3", "q", "a", True, at(50))],
    ]
    results = rows([("q", "a", 1, 1.0), ("q", "b", 2, 0.9), ("r", "a", 1, 1.0)], "query_id string, segment_id string, rank int, score double")
    seen = {}

    def write(df, batch_id):
        if rows_ := collect(df, "query_id", "segment_id", "user_feedback"):
            seen[batch_id] = rows_

    stream = feed(batches, FEEDBACK)
    writer = feeds.apply_feedback_stream(stream, results, "1 minute", f"{tmp_path}/log", write, compact_every=compact_every)
    writer.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert list(seen.values()) == [
        [("q", "a", "negative"), ("q", "b", "positive")],
        [("q", "a", "positive"), ("q", "b", "positive")],
    ]


class _Held(dict):
    """A map state in memory that counts the rows written to it."""

    written = 0
    exists = __bool__ = lambda self: len(self) > 0
    getValue = dict.__getitem__
    removeKey = dict.__delitem__

    def updateValue(self, key, value):
        self.written += len(value[0])
        self[key] = value


class _One:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class _Many(_One):
    def appendList(self, values):
        self.value = [*(self.value or []), *values]


class _Handle:
    def __init__(self):
        self.timers = set()
        self.getMapState = lambda *_: _Held()
        self.getValueState = lambda *_: _One()
        self.getListState = lambda *_: _Many()
        self.registerTimer = self.timers.add
        self.deleteTimer = self.timers.discard


def test_rows_written_do_not_grow_with_rows_that_wait():
    merge = feeds._MergeRuns(0.5, 0.3, None, bucket=10.0)
    merge.init(handle := _Handle())
    rows_ = [(i * 1_000_000, i, float(i), i + (0.9 if i % 3 else 0.2), f"t{i}") for i in range(400)]
    for at_ in range(0, 400, 20):
        before = merge.waiting.written
        list(merge.handleInputRows(("m",), iter([pd.DataFrame(rows_[at_ : at_ + 20], columns=["us", "pos", "start", "end", "text"])]), None))
        assert merge.waiting.written - before == 20
    out = []
    for second in range(7, 420, 7):
        before = merge.waiting.written
        due = {t for t in handle.timers if t < second * 1000}
        handle.timers -= due
        for _ in due:
            times = SimpleNamespace(getCurrentWatermarkInMs=lambda: second * 1000)
            out += pd.concat(merge.handleExpiredTimer(("m",), times, None)).values.tolist()
        assert merge.waiting.written - before < 10
    assert not merge.waiting and not merge.parts.exists()
    runs_, texts = [], []
    for _, pos, start, end, text in rows_:
        if runs_ and (end - start < 0.5 or start - runs_[-1] <= 0.3):
            texts[-1] += " " + text
        else:
            texts.append(text)
        runs_.append(end)
    assert [r[4] for r in out] == texts[:-1]


def test_thin_rows_wait_in_few_parts():
    merge = feeds._MergeRuns(0.5, 0.3, None, bucket=10.0)
    merge.init(handle := _Handle())
    columns = ["us", "pos", "start", "end", "text"]
    rows_ = [(i * 3_600_000_000, i, i * 3600.0, i * 3600 + 0.9, f"t{i}") for i in range(300)]
    list(merge.handleInputRows(("m",), iter([pd.DataFrame(rows_[::-1], columns=columns)]), None))
    assert len(merge.waiting) <= 10
    list(merge.handleInputRows(("m",), iter([pd.DataFrame([(1_081_000_000_000 + i, 300 + i, 0.0, 1.0, "") for i in range(2000)], columns=columns)]), None))
    assert max(len(v[0]) for v in merge.waiting.values()) <= feeds.PART_ROWS
    out = []
    for hour in (1, 50, 51, 299, 400):
        times = SimpleNamespace(getCurrentWatermarkInMs=lambda: hour * 3_600_000)
        out += pd.concat(merge.handleExpiredTimer(("m",), times, None)).values.tolist()
        assert sum(len(v[0]) for v in merge.waiting.values()) == (2000 + 300 - hour if hour < 300 else 0)
    assert [r[1] for r in out] == list(range(299))  # the last run is open


def test_feedback_log_drops_dead_folders_and_reads_its_buckets(spark, rows, feed, tmp_path):
    batches = [[(f"e{i}", f"q{i % 3}", "a", i % 2 == 0, at(i))] for i in range(8)]
    results = rows([(f"q{i}", "a", 1, 1.0) for i in range(3)], "query_id string, segment_id string, rank int, score double")
    feeds.store_results(results, f"{tmp_path}/results", buckets=4)
    stored = spark.read.parquet(f"{tmp_path}/results")
    seen, plans = {}, {}

    def write(df, batch_id):
        seen[batch_id] = collect(df, "query_id", "segment_id", "user_feedback")
        plans[batch_id] = df._jdf.queryExecution().executedPlan().toString()

    writer = feeds.apply_feedback_stream(feed(batches, FEEDBACK), stored, "1 minute", f"{tmp_path}/log", write, buckets=4, compact_every=2)
    writer.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    shown = [v for v in seen.values() if v]
    assert shown == [[(f"q{i % 3}", "a", "positive" if i % 2 == 0 else "negative")] for i in range(8)]
    assert all("PartitionFilters: [feedback_bucket" in p or "PartitionFilters: [isnotnull(feedback_bucket" in p for i, p in plans.items() if seen[i])
    last = max(seen)
    live = (last - 1) // 2 * 2
    assert min(map(int, os.listdir(f"{tmp_path}/log/batch"))) == live
    assert min(map(int, os.listdir(f"{tmp_path}/log/base"))) == live
