"""The event table as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.operators.ranking import top_k
from reelgrid.spreading import scratch_path
from reelgrid.streaming.feeds import (
    apply_feedback_stream,
    stream_grid,
    stream_merge,
    stream_sessions,
)
from reelgrid.workloads.fixtures import Tables, with_ctes
from reelgrid.workloads.registry import query

DELAY_SEC = 3_600
DELAY = f"{DELAY_SEC} seconds"
IDLE_SEC = 86_400  # a media item silent for this long has ended its run
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _events(t: Tables) -> DataFrame:
    """The events as a stream with an event time of known zone."""
    schema = t["events"].schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return stream.select(
        "event_id",
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("media_id"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").alias("k"),
        micros.alias("us"),
        F.timestamp_micros(micros).alias("ts"),
    )


def _run(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all files there are, into parquet, and read that back."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-state")
    writer.outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


CLOSED = f"(SELECT max(us) - {DELAY_SEC}000000 FROM ev)"
EV = "ev AS (SELECT *, epoch_us(ts) - 1704067200000000 AS us FROM events)"


@query(
    "stream_grid",
    f"""WITH {EV}
SELECT 'user_' || user_id AS media_id, cell, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS labels,
  coalesce(string_agg(DISTINCT k, '|' ORDER BY k), '') AS texts, count(*) AS n_items
FROM (SELECT *, us // 21600000000 AS cell, json_extract_string(props, '$.k') AS k FROM ev) GROUP BY user_id, cell HAVING (cell + 1) * 21600000000 <= {CLOSED}""",
)
def _stream_grid(t: Tables) -> DataFrame:
    cells = _run(stream_grid(_events(t).withColumnsRenamed({"event_type": "label", "k": "text"}), "21600 seconds", DELAY), "grid")
    return cells.select(
        "media_id",
        (F.unix_micros("cell_start") / 21_600_000_000).cast("bigint").alias("cell"),
        F.array_join("labels", "|").alias("labels"),
        F.array_join("texts", "|").alias("texts"),
        "n_items",
    )


@query(
    "stream_sessions",
    f"""WITH {EV}, marked AS (
  SELECT *, CASE WHEN us - lag(us) OVER w < 7200000000 THEN 0 ELSE 1 END AS brk FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)),
runs AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY us) AS run FROM marked)
SELECT 'user_' || user_id AS media_id, min(us) AS first_us, max(us) AS last_us, count(*) AS n_rows FROM runs
GROUP BY user_id, run HAVING max(us) + 7200000000 <= {CLOSED}""",
)
def _stream_sessions(t: Tables) -> DataFrame:
    sessions = _run(stream_sessions(_events(t), "7200 seconds", DELAY), "sessions")
    return sessions.select(
        "media_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n_rows"
    )


@query(
    "stream_merge",
    with_ctes(
        "tl asr",
        f""", said AS (SELECT asr.*, us FROM asr JOIN (SELECT event_id AS pos, epoch_us(ts) AS us FROM events) USING (pos)),
passed AS (SELECT max(us) // 1000 * 1000 - {DELAY_SEC}000000 AS upto FROM said),
marked AS (
  SELECT *, CASE WHEN us - lag(us) OVER w <= {IDLE_SEC}000000 AND (e0 - s0 < 600 OR s0 - lag(e0) OVER w <= 3600) THEN 0 ELSE 1 END AS brk
  FROM said WHERE us < (SELECT upto FROM passed) WINDOW w AS (PARTITION BY media_id ORDER BY pos)),
runs AS (
  SELECT *, sum(brk) OVER (PARTITION BY media_id ORDER BY pos) AS run, max(CASE WHEN brk = 1 THEN pos END) OVER (PARTITION BY media_id) AS last_break
  FROM marked)
SELECT media_id, min(pos) AS pos, arg_min(s0, pos) AS start, arg_max(e0, pos) AS "end", string_agg(text, ' ' ORDER BY pos) AS text, count(*) AS n_rows
FROM runs GROUP BY media_id, run
HAVING max(pos) < any_value(last_break) OR max(us) + {IDLE_SEC}000000 < (SELECT upto FROM passed)""".lstrip(),
    ).replace("\n, said", ", said"),
)
def _stream_merge(t: Tables) -> DataFrame:
    """Runs closed by a following one or by silence; a run still open when the stream ends is not shown."""
    seconds = F.expr("us div 1000") / F.lit(1000.0)
    spoken = _events(t).where(F.col("event_type").isin("click", "view"))
    asr = spoken.select(
        "media_id",
        "ts",
        F.col("event_id").alias("pos"),
        seconds.alias("start"),
        (seconds + 60 * F.col("value")).alias("end"),
        F.concat_ws(":", "event_type", "k").alias("text"),
    )
    before = t.spark.conf.get(STATE_STORE)
    t.spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        return _run(stream_merge(asr, DELAY, min_duration=600, max_gap=3_600, idle=IDLE_SEC), "merge")
    finally:
        t.spark.conf.set(STATE_STORE, before)


def _feedback(t: Tables) -> DataFrame:
    return _events(t).select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("media_id").alias("query_id"),
        F.col("k").alias("segment_id"),
        (F.col("value") >= 20).alias("relevant"),
        "ts",
    )


@query(
    "stream_feedback",
    """SELECT query_id, segment_id, row_number() OVER (PARTITION BY query_id ORDER BY round(new_score, 9) DESC, segment_id) AS rank,
  round(new_score, 6) AS score, user_feedback FROM (
  SELECT *, score * CASE user_feedback WHEN 'positive' THEN 1.3::DOUBLE WHEN 'negative' THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS new_score FROM (
    SELECT *, CASE WHEN rank > 3 THEN NULL WHEN relevant THEN 'positive' ELSE 'negative' END AS user_feedback FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, segment_id) AS rank FROM (
        SELECT 'user_' || user_id AS query_id, json_extract_string(props, '$.k') AS segment_id, max(value) AS score, arg_max(value, event_id) >= 20 AS relevant
        FROM events GROUP BY ALL)) WHERE rank <= 5))""",
)
def _stream_feedback(t: Tables) -> DataFrame:
    """The last verdict of every segment arrives as a stream and rescores the lists it touches."""
    scored = t.timeline().groupBy(F.col("media_id").alias("query_id"), F.col("k").alias("segment_id")).agg(
        F.max("value").alias("score")
    )
    path = scratch_path(t.spark, "feedback")

    def write(rescored: DataFrame, batch_id: int) -> None:
        rescored.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    writer = apply_feedback_stream(_feedback(t), top_k(scored, 5), DELAY, f"{path}/log", write)
    writer.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    written = t.spark.read.parquet(f"{path}/out")
    last = written.groupBy("query_id").agg(F.max("batch").alias("batch"))
    final = written.join(last, ["query_id", "batch"], "left_semi")
    return final.select("query_id", "segment_id", "rank", F.round("score", 6).alias("score"), "user_feedback")
