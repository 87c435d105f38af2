"""Grid cells, interval merging and feedback on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from reelgrid.operators.rerank import apply_feedback
from reelgrid.spreading import remove

FEEDBACK_BUCKETS = 64
RESULT_BUCKET = "feedback_bucket"
COMPACT_EVERY = 20
PART_ROWS = 512  # waiting rows of one part at most
FEW_ROWS = 8  # waiting rows that are one part whatever time they span


def stream_grid(events: DataFrame, width: str, delay: str) -> DataFrame:
    """Cells on event time: labels (and texts, if there are any) as sorted sets, and counts per media item.

    Late rows are dropped.
    """
    texts = [F.sort_array(F.collect_set("text")).alias("texts")] if "text" in events.columns else []
    cells = (
        events.withWatermark("ts", delay)
        .groupBy("media_id", F.window("ts", width).alias("cell"))
        .agg(F.sort_array(F.collect_set("label")).alias("labels"), *texts, F.count(F.lit(1)).alias("n_items"))
    )
    kept = [c for c in cells.columns if c not in ("media_id", "cell")]
    return cells.select("media_id", F.col("cell.start").alias("cell_start"), F.col("cell.end").alias("cell_end"), *kept)


def stream_sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Rows of a media item closer than ``gap`` as one session."""
    return (
        events.withWatermark("ts", delay)
        .groupBy("media_id", F.session_window("ts", gap).alias("session"))
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_rows"))
        .drop("session")
    )


class _MergeRuns(StatefulProcessor):
    """Holds rows until the watermark has passed them, then merges them in order of their time.

    Waiting rows are parts by time, named by their first time, of at most ``PART_ROWS`` rows. A batch's first part spans
    ``bucket`` seconds, each later one as long as it begins after the first row, and any ``FEW_ROWS`` rows, so thin
    rows make few parts. A batch adds parts and reads none; a timer reads and deletes the parts that the watermark has
    reached and writes again at most what is left of them, so what is written does not grow with the rows that wait.
    The open run's texts are appended, and a media item has one timer, for its first waiting row or the end of its open run.
    """

    def __init__(self, min_duration: float, max_gap: float, idle: float | None, bucket: float) -> None:
        self.min_duration = min_duration
        self.max_gap = max_gap
        self.bucket_us = max(1, round(bucket * 1_000_000))
        self.idle_us = None if idle is None else round(idle * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        held = "us array<bigint>, pos array<bigint>, start array<double>, end array<double>, text array<string>"
        self.waiting = handle.getMapState("waiting", "first bigint, part bigint", held)
        self.parts = handle.getValueState("parts", "n bigint")
        self.open = handle.getValueState("open", "pos bigint, start double, end double, last_us bigint, n_rows bigint")
        self.texts = handle.getListState("texts", "text string")
        self.timer = handle.getValueState("timer", "ms bigint")

    def _wake_at(self, ms: int) -> None:
        """Move the timer to ``ms`` unless it is due earlier."""
        if planned := self.timer.get():
            if planned[0] <= ms:
                return
            self.handle.deleteTimer(planned[0])
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def _hold(self, rows: list[tuple]) -> int:
        """Add rows as parts by time; the least time is returned."""
        rows = sorted(rows)
        held_parts: list[list[tuple]] = []
        until = 0
        for row in rows:
            held = len(held_parts[-1]) if held_parts else PART_ROWS
            if held >= PART_ROWS or held >= FEW_ROWS and row[0] >= until:
                held_parts.append([])
                until = row[0] + max(self.bucket_us, row[0] - rows[0][0])
            held_parts[-1].append(row)
        part = (self.parts.get() or (0,))[0]
        for held in held_parts:
            self.waiting.updateValue((held[0][0], part), tuple(list(c) for c in zip(*held)))
            part += 1
        self.parts.update((part,))
        return rows[0][0]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            held = [
                (int(us), int(pos), float(start), float(end), str(text))
                for us, pos, start, end, text in batch[["us", "pos", "start", "end", "text"]].itertuples(index=False)
            ]
            if held:
                least = self._hold(held)
                first = least if first is None else min(first, least)
        if first is not None:
            self._wake_at(first // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        until = timerValues.getCurrentWatermarkInMs() * 1000
        ready, later = [], []
        parts = [tuple(k) for k in self.waiting.keys()] if self.waiting.exists() else []
        for part in [k for k in parts if k[0] < until]:
            for row in zip(*self.waiting.getValue(part)):
                (ready if row[0] < until else later).append(row)
            self.waiting.removeKey(part)
        done = []
        opened = self.open.get()
        run = None if opened is None else list(opened)
        held_open = run is not None  # only then the state may hold texts
        fresh: list[str] = []  # texts of the open run that its state does not hold yet

        def close() -> None:
            nonlocal held_open
            said = [r[0] for r in self.texts.get()] if held_open else []
            if held_open:
                self.texts.clear()
                held_open = False
            done.append((key[0], run[0], run[1], run[2], " ".join([*said, *fresh]), run[4]))
            fresh.clear()

        for us, pos, start, end, text in sorted(ready):
            idle = run is not None and self.idle_us is not None and us - run[3] > self.idle_us
            if run is not None and not idle and (end - start < self.min_duration or start - run[2] <= self.max_gap):
                run[2:] = [end, us, run[4] + 1]
            else:
                if run is not None:
                    close()
                run = [pos, start, end, us, 1]
            fresh.append(text)
        if run is not None and self.idle_us is not None and until > run[3] + self.idle_us:
            close()
            run = None
        if run is None:
            self.open.clear()
        elif ready:
            self.open.update(tuple(run))
            if fresh:
                self.texts.appendList([(text,) for text in fresh])
        waits = [k[0] for k in parts if k[0] >= until]
        if later:
            waits.append(self._hold(later))
        if not waits:
            self.parts.clear()
        wake = [min(waits) // 1000 + 1] if waits else []
        if run is not None and self.idle_us is not None:
            wake.append((run[3] + self.idle_us) // 1000 + 1)
        if wake:
            self._wake_at(min(wake))
        yield pd.DataFrame(done, columns=["media_id", "pos", "start", "end", "text", "n_rows"])

    def close(self) -> None:
        pass


def stream_merge(
    asr: DataFrame,
    delay: str,
    min_duration: float = 0.5,
    max_gap: float = 0.3,
    idle: float | None = None,
    bucket: float = 60.0,
) -> DataFrame:
    """Merge short or touching transcript rows of an unbounded stream, exactly as the batch operator does.

    ``asr`` has an event time ``ts`` besides ``media_id, pos, start, end, text``. Rows are merged in
    time order once the watermark passes them; a run is emitted when the next one begins. With ``idle``
    seconds, a run also ends when its media item has no row for that long in event time, whatever the
    next row's length: media items that have ended leave no state, and the rows do not depend on how the
    stream is cut into batches. Waiting rows are held in parts of ``bucket`` seconds of event time or more, which
    changes no row. Needs the RocksDB state store.
    """
    return (
        asr.withWatermark("ts", delay)
        .withColumn("us", F.unix_micros("ts"))  # pandas would see local time
        .groupBy("media_id")
        .transformWithStateInPandas(
            _MergeRuns(min_duration, max_gap, idle, bucket),
            "media_id string, pos bigint, start double, end double, text string, n_rows bigint",
            "append",
            "EventTime",
        )
    )


def distinct_feedback(feedback: DataFrame, delay: str) -> DataFrame:
    """Feedback events without repeats; an event's id is remembered until the watermark passes it."""
    return feedback.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def _feedback_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("query_id"), F.lit(buckets)).cast("int")


def store_results(results: DataFrame, path: str, buckets: int = FEEDBACK_BUCKETS) -> None:
    """Write result lists in the buckets of the feedback log, one folder each.

    Read back as they are, a batch of feedback opens only the folders of its own queries.
    """
    bucketed = results.withColumn(RESULT_BUCKET, _feedback_bucket(buckets))
    bucketed.repartition(buckets, RESULT_BUCKET).write.partitionBy(RESULT_BUCKET).parquet(path)


def apply_feedback_stream(
    feedback: DataFrame,
    results: DataFrame,
    delay: str,
    log_path: str,
    write: Callable[[DataFrame, int], None],
    buckets: int = FEEDBACK_BUCKETS,
    compact_every: int = COMPACT_EVERY,
) -> DataStreamWriter:
    """Rescore result lists with every batch of new verdicts; ``write`` receives the touched lists.

    The last verdict of a query and segment, by ``ts`` and ``event_id``, counts. Verdicts are kept under
    ``log_path`` in ``buckets`` by query, so a batch reads only those of its own queries. Every
    ``compact_every`` batches the log begins anew with one row per query and segment. All folders are named
    by the batch's number, so a batch that runs twice, or was cut off midway, replaces its own, and the number
    tells which folders are live. Those that no batch can read any more, not even one that runs again, are
    deleted by the second batch after a compaction.

    ``results`` of ``store_results`` with the same ``buckets`` are read in the folders of the batch's queries
    only; any other table is read whole.
    """
    bucket = _feedback_bucket(buckets)
    columns = ["query_id", "segment_id"]

    def last(verdicts: DataFrame) -> DataFrame:
        newest = F.max_by(F.struct("relevant", "ts", "event_id"), F.struct("ts", "event_id")).alias("_v")
        return verdicts.groupBy("bucket", *columns).agg(newest).select("bucket", *columns, "_v.*")

    def keep(verdicts: DataFrame, path: str) -> None:
        verdicts.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)

    def rescore(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = f"{_ddl(batch)}, bucket int"

        def log(upto: int) -> DataFrame:
            """All verdicts before batch ``upto``: what the last compaction wrote, and the batches since."""
            start = (upto - 1) // compact_every * compact_every if upto else 0
            folders = [f"{log_path}/base/{start}"] if start else []
            folders += [f"{log_path}/batch/{i}" for i in range(start, upto)]
            parts = [spark.read.schema(schema).parquet(folder) for folder in folders]
            out = parts[0]
            for part in parts[1:]:
                out = out.unionByName(part)
            return out

        keep(last(batch.withColumn("bucket", bucket)).select(*batch.columns, "bucket"), f"{log_path}/batch/{batch_id}")
        if batch_id and batch_id % compact_every == 0:
            keep(last(log(batch_id)).select(*batch.columns, "bucket"), f"{log_path}/base/{batch_id}")
        mine = spark.read.schema(schema).parquet(f"{log_path}/batch/{batch_id}")
        read = [r["bucket"] for r in mine.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        touched = mine.select("query_id").distinct()
        lists = results
        if RESULT_BUCKET in results.columns:
            lists = results.where(F.col(RESULT_BUCKET).isin(read)).drop(RESULT_BUCKET)
        known = last(log(batch_id + 1).where(F.col("bucket").isin(read)).join(touched, "query_id", "left_semi"))
        rescored = apply_feedback(lists.join(touched, "query_id", "left_semi"), known.select(*columns, "relevant"))
        write(rescored, batch_id)
        start = (batch_id - 1) // compact_every * compact_every
        if start > 0 and batch_id == start + 1:  # the batch that wrote the base is committed
            remove(spark, f"{log_path}/base/{start - compact_every}")
            for old in range(start - compact_every, start):
                remove(spark, f"{log_path}/batch/{old}")

    return distinct_feedback(feedback, delay).writeStream.outputMode("append").foreachBatch(rescore)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
