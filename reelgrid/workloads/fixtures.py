"""Stand-ins for the operators' inputs, derived from the driver tables by Spark; and the same as SQL.

A user of ``events`` is a media item. Clicks and views are transcripts, purchases and sign-ups are
sounds, errors are screen texts, and every event is a clip and a frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.spreading import spread, stored

CELL_SEC = 21_600.0


def whole_entries(vector: str, scale: int = 1_000_000) -> Column:
    """All entries of a vector as whole multiples of ``1 / scale``, comma-joined."""
    return F.array_join(F.transform(vector, lambda x: F.round(x.cast("double") * scale).cast("bigint")), ",")


class Tables:
    """The driver tables of one folder, read lazily with only the columns a query uses."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self._read: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._read[name]

    # --- time-stamped streams -------------------------------------------------------------------

    def timeline(self) -> DataFrame:
        millis = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div 1000")
        return spread(self["events"], "event_id").select(
            "event_id",
            F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("media_id"),
            "event_type",
            "value",
            F.get_json_object("props", "$.k").alias("k"),
            (millis / F.lit(1000.0)).alias("t"),
        ).withColumn("t_end", F.col("t") + 60 * F.col("value"))

    def media(self) -> DataFrame:
        if "media" in self._read:
            return self._read["media"]
        per_user = self.timeline().groupBy("media_id").agg(
            F.max("t").alias("_last"), F.count(F.lit(1)).alias("_n")
        )
        self._read["media"] = per_user.select(
            "media_id",
            F.concat("media_id", F.lit(".mp4")).alias("video_file"),
            (F.col("_last") + 600).alias("duration"),
            F.when(F.col("_n") % 2 == 0, F.lit(29.97)).otherwise(F.lit(0.5)).alias("fps"),
            F.floor(F.col("_last") / 1000).alias("total_frames"),
        )
        return self._read["media"]

    def stored_media(self) -> DataFrame:
        """The media table as a file, for flows that look it up again and again."""
        self._read["media"] = stored(self.media(), "media")
        return self._read["media"]

    def asr(self) -> DataFrame:
        return (
            self.timeline()
            .where(F.col("event_type").isin("click", "view"))
            .select(
                "media_id",
                F.col("event_id").alias("pos"),
                F.col("t").alias("start"),
                F.col("t_end").alias("end"),
                F.concat_ws(":", "event_type", "k").alias("text"),
            )
        )

    def audio(self) -> DataFrame:
        sounds = self.timeline().where(F.col("event_type").isin("purchase", "signup"))
        return sounds.select(
            "media_id",
            F.col("event_id").alias("pos"),
            F.col("t").alias("start"),
            F.col("t_end").alias("end"),
            F.array("event_type", F.concat(F.lit("k"), F.substring("k", 1, 1))).alias("event_labels"),
            F.when(F.col("value") >= 5, F.array(F.col("value").cast("float"))).alias("embedding"),
        )

    def ocr(self) -> DataFrame:
        shown = self.timeline().where(F.col("event_type") == "error")
        ranged = F.col("value") >= 100
        return shown.select(
            "media_id",
            F.col("event_id").alias("pos"),
            F.when(~ranged, F.col("t")).alias("timestamp"),
            F.when(ranged, F.col("t")).alias("start"),
            F.when(ranged, F.col("t_end")).alias("end"),
            F.array(F.concat(F.lit("k "), F.col("k")), F.lit("error")).alias("texts"),
        )

    def clips(self) -> DataFrame:
        return self.timeline().select(
            "media_id",
            F.col("event_id").alias("pos"),
            F.col("t").alias("start"),
            F.col("t_end").alias("end"),
            F.array(F.col("value").cast("float")).alias("embedding"),
        )

    def frames(self) -> DataFrame:
        return self.timeline().select(
            "media_id",
            F.col("event_id").alias("idx"),
            F.col("t").alias("timestamp"),
            F.array(F.col("value").cast("float")).alias("embedding"),
        )

    # --- texts and vectors ----------------------------------------------------------------------

    def documents(self) -> DataFrame:
        return self["documents"].select(F.col("doc_id").alias("segment_id"), "text")

    def text_queries(self) -> DataFrame:
        return self["benchmark"].select(
            F.col("item_id").alias("query_id"), F.col("text").alias("original_query"), F.col("text").alias("text_query")
        )

    def vectors(self) -> DataFrame:
        return self["embeddings"].select(F.col("vec_id").alias("segment_id"), "embedding")

    def label_means(self) -> DataFrame:
        """Mean vector per label."""
        entries = self["embeddings"].select("label", F.posexplode("embedding").alias("i", "x"))
        means = entries.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
        ordered = F.sort_array(F.collect_list(F.struct("i", "x")))
        return means.groupBy("label").agg(F.transform(ordered, lambda e: e["x"]).alias("embedding"))

    def query_vectors(self) -> dict[str, DataFrame]:
        """Three query vectors per label: its mean, and the vectors with its lowest and highest id."""
        by_label = self["embeddings"].groupBy("label")
        first = by_label.agg(F.min_by("embedding", "vec_id").alias("embedding"))
        last = by_label.agg(F.max_by("embedding", "vec_id").alias("embedding"))
        asked = {"text_dense": self.label_means(), "visual": first, "audio": last}
        return {
            source: df.select(F.col("label").cast("bigint").alias("query_id"), F.col("embedding").cast("array<double>"))
            for source, df in asked.items()
        }

    # --- evaluation -----------------------------------------------------------------------------

    def ground_truth(self) -> DataFrame:
        return (
            self.timeline()
            .where(F.col("event_type").isin("click", "view"))
            .select(
                F.col("media_id").alias("query_id"),
                F.col("event_id").alias("gt_id"),
                F.col("t").alias("start"),
                F.col("t_end").alias("end"),
                F.array(F.concat(F.lit("K"), F.col("k")), "event_type").alias("aspects"),
            )
        )


# --- the same as common table expressions -------------------------------------------------------

CTE = {
    "tl": """tl AS (
  SELECT event_id, 'user_' || user_id AS media_id, event_type, value,
         json_extract_string(props, '$.k') AS k,
         ((epoch_us(ts) - 1704067200000000) // 1000) / 1000::DOUBLE AS t,
         ((epoch_us(ts) - 1704067200000000) // 1000) / 1000::DOUBLE + 60 * value AS t_end
  FROM events)""",
    "media": """media AS (
  SELECT media_id, media_id || '.mp4' AS video_file, max(t) + 600 AS duration,
         CASE WHEN count(*) % 2 = 0 THEN 29.97::DOUBLE ELSE 0.5::DOUBLE END AS fps,
         CAST(floor(max(t) / 1000) AS BIGINT) AS total_frames
  FROM tl GROUP BY media_id)""",
    "grid": f"""grid AS (
  SELECT media_id, video_file, duration, i AS seg_idx, i * {CELL_SEC}::DOUBLE AS s,
         least((i + 1) * {CELL_SEC}::DOUBLE, duration) AS e
  FROM (SELECT *, unnest(range(0, CAST(ceil(duration / {CELL_SEC}::DOUBLE) AS BIGINT))) AS i FROM media))""",
    "asr": """asr AS (
  SELECT media_id, event_id AS pos, t AS s0, t_end AS e0, event_type || ':' || k AS text
  FROM tl WHERE event_type IN ('click', 'view'))""",
    "audio": """audio AS (
  SELECT media_id, event_id AS pos, t AS s0, t_end AS e0, [event_type, 'k' || substr(k, 1, 1)] AS labels,
         value >= 5 AS has_embedding
  FROM tl WHERE event_type IN ('purchase', 'signup'))""",
    "ocr": """ocr AS (
  SELECT media_id, event_id AS pos, CASE WHEN value < 100 THEN t END AS ts0,
         CASE WHEN value >= 100 THEN t END AS s0, CASE WHEN value >= 100 THEN t_end END AS e0,
         ['k ' || k, 'error'] AS texts
  FROM tl WHERE event_type = 'error')""",
    "vec": """vec AS (
  SELECT vec_id AS segment_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)""",
    "label_means": """label_means AS (
  SELECT label, list(x ORDER BY i) AS v FROM (
    SELECT label, i, avg(x) AS x FROM (
      SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec) GROUP BY label, i)
  GROUP BY label)""",
    "asked": """asked AS (
  SELECT CAST(label AS BIGINT) AS query_id, 'text_dense' AS source, v FROM label_means
  UNION ALL SELECT CAST(label AS BIGINT), 'visual', arg_min(v, segment_id) FROM vec GROUP BY label
  UNION ALL SELECT CAST(label AS BIGINT), 'audio', arg_max(v, segment_id) FROM vec GROUP BY label)""",
    "hits": """hits AS (
  SELECT *, CASE WHEN source = 'text_dense' THEN (sim + 1) / 2 ELSE greatest(0, least(1, (sim + 1) / 2)) END AS score FROM (
    SELECT query_id, source, segment_id, sim,
           row_number() OVER (PARTITION BY query_id, source ORDER BY round(sim, 9) DESC, segment_id) AS rank
    FROM (SELECT a.query_id, a.source, x.segment_id, list_dot_product(a.v, x.v) AS sim FROM asked a, vec x))
  WHERE rank <= 100)""",
    "fused": """fused AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first_list, first_rank, segment_id) AS rank
  FROM (
    SELECT query_id, segment_id, sum(w / total / (60 + rank)) AS score,
           min(list_no) AS first_list, min_by(rank, list_no) AS first_rank,
           coalesce(max(score) FILTER (source = 'text_dense'), 0) AS dense_score,
           coalesce(max(score) FILTER (source = 'visual'), 0) AS visual_score,
           coalesce(max(score) FILTER (source = 'audio'), 0) AS audio_score,
           count(DISTINCT source) FILTER (score > 0) AS num_sources
    FROM (SELECT h.*, c.w, c.list_no, 0.35 + 0.25 + 0.10 AS total FROM hits h
          JOIN (VALUES ('text_dense', 0.35::DOUBLE, 1), ('visual', 0.25::DOUBLE, 2), ('audio', 0.10::DOUBLE, 3))
               c(source, w, list_no) USING (source))
    GROUP BY query_id, segment_id))""",
    "gt": """gt AS (
  SELECT media_id AS query_id, event_id AS gt_id, t AS s0, t_end AS e0, ['K' || k, event_type] AS aspects
  FROM tl WHERE event_type IN ('click', 'view'))""",
}


def with_ctes(names: str, body: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names.split()) + "\n" + body
