"""Vector tables: eligibility, width, normalisation, exact search, zero-shot labels.

Search is exact. Query vectors are sent to the tasks in blocks of bounded size, and each Arrow batch of
stored vectors is multiplied with a block, keeping only the best ``k`` per query and task. Stored vectors
are never copied or shuffled: more queries mean more passes over them, not more rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.functions.vector import NORM_FLOOR, conformed, normalized, unit_score
from reelgrid.operators.ranking import SCORE_DIGITS, rounded, top_k
from reelgrid.schemas import LABEL_THRESHOLD, TOP_K_RETRIEVAL
from reelgrid.spreading import scratch_path, stored

MAX_SENT_VECTORS = 4096
MAX_SCORES = 4_000_000  # similarities held at once by one task


def indexable_vectors(df: DataFrame, col: str = "embedding") -> DataFrame:
    return df.where(F.size(col) > 0)


def l2_normalize(df: DataFrame, col: str = "embedding") -> DataFrame:
    return df.withColumn(col, normalized(F.col(col)))


def conform_dim(df: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    return df.withColumn(col, conformed(F.col(col), dim))


def dim_audit(vectors: DataFrame, expected: dict[str, int] | None = None) -> DataFrame:
    """Rows per modality and width; with ``expected`` widths also whether they have theirs."""
    widths = vectors.groupBy("modality", F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n_vectors"))
    if expected is None:
        return widths
    known = F.create_map(*[F.lit(x) for item in expected.items() for x in item])
    return widths.withColumn("as_expected", F.coalesce(F.col("dim") == known[F.col("modality")], F.lit(False)))


def vector_metadata(vectors: DataFrame) -> DataFrame:
    """Row count and width range per modality."""
    return vectors.groupBy("modality").agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.min(F.size("embedding")).alias("min_dim"),
        F.max(F.size("embedding")).alias("max_dim"),
    )


def matrix_of(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _sortable(ids: np.ndarray) -> np.ndarray:
    return ids.astype(str) if ids.dtype == object else ids


def _keep_best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best by rounded score, then id."""
    if len(ids) <= k:
        return ids, scores
    order = np.lexsort((_sortable(ids), -np.round(scores, SCORE_DIGITS)))[:k]
    return ids[order], scores[order]


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per query (column of ``scores``) the rows that can be among its best ``k``."""
    levels = np.round(scores, SCORE_DIGITS)
    n = len(ids)
    bars = np.partition(levels, n - k, axis=0)[n - k] if n > k else np.full(scores.shape[1], -np.inf)
    for j in range(scores.shape[1]):
        chosen = np.nonzero(levels[:, j] >= bars[j])[0]
        yield _keep_best(ids[chosen], scores[chosen, j], k)


def _first_rows(df: DataFrame, max_rows: int) -> tuple[pa.Table | None, DataFrame]:
    """All rows of ``df`` where they are at most ``max_rows``; else none, and ``df`` written down.

    ``df`` may be the output of a model: its rows are made once, whichever way is taken.
    """
    held = df.persist()
    try:
        rows = held.limit(max_rows + 1).toArrow()
        return (rows, df) if rows.num_rows <= max_rows else (None, stored(held, "blocks"))
    finally:
        held.unpersist()


def _blocks(df: DataFrame, max_rows: int, *keys: str) -> Iterator[pa.Table]:
    """The rows of a written table by parts of about half of ``max_rows``; one part at a time is held."""
    n = -(-2 * df.count() // max_rows)
    dealt = stored(df.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(n))), "blocks")
    for b in range(n):
        rows = dealt.where(F.col("_block") == b).drop("_block").toArrow()
        if rows.num_rows:
            yield rows


def vector_search(
    query_vectors: DataFrame,
    vectors: DataFrame,
    source: str,
    k: int = TOP_K_RETRIEVAL,
    clamp: bool = True,
    max_sent: int = MAX_SENT_VECTORS,
) -> DataFrame:
    """Best ``k`` vectors per query by inner product, scored ``(s + 1) / 2``; other widths never match.

    Up to ``max_sent`` query vectors are answered in one lazy pass. More are answered in blocks: the stored
    vectors are read once per block, and what each block finds is written before the next one is sent. A
    task yields ``k`` rows per query of a block, whatever it reads.
    """
    asked = indexable_vectors(query_vectors).select("query_id", "embedding")
    held = indexable_vectors(vectors).select("segment_id", "embedding")
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, " + (
        f"segment_id {held.schema['segment_id'].dataType.simpleString()}, similarity double"
    )

    def ranked(best: DataFrame) -> DataFrame:
        return top_k(best, k, [rounded("similarity").desc(), F.col("segment_id")])

    rows, asked = _first_rows(asked, max_sent)
    if rows is not None:
        best = _search_sent(rows, held, kinds, k)[0]
    else:
        held, path = stored(held, "vectors"), scratch_path(held.sparkSession, "hits")
        # The row number spreads repeats of one query over the blocks.
        asked = stored(asked.withColumn("_nth", F.monotonically_increasing_id()), "asked")
        for block in _blocks(asked, max_sent, "query_id", "_nth"):
            found, sent = _search_sent(block, held, kinds, k)
            ranked(found).drop("rank").write.mode("append").parquet(path)
            sent.destroy()
        best = held.sparkSession.read.schema(kinds).parquet(path)
    scored = ranked(best).withColumn("score", unit_score(F.col("similarity"), clamp))
    return scored.select("query_id", F.lit(source).alias("source"), "segment_id", "rank", "similarity", "score")


def _by_width(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    widths = pa.compute.list_value_length(table["embedding"]).to_numpy()
    out = {}
    for dim in np.unique(widths):
        rows = table.filter(pa.array(widths == dim))
        out[int(dim)] = (rows["query_id"].to_numpy(), matrix_of(rows["embedding"], int(dim)))
    return out


def _search_sent(asked: pa.Table, held: DataFrame, kinds: str, k: int) -> tuple[DataFrame, Broadcast]:
    """The best ``k`` per query and task, and what was sent to find them."""
    sent = held.sparkSession.sparkContext.broadcast(_by_width(asked))

    def rank_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for dim, (_, matrix) in sent.value.items():
                rows = batch.filter(pa.compute.equal(pa.compute.list_value_length(batch["embedding"]), dim))
                if rows.num_rows == 0:
                    continue
                step = max(1, MAX_SCORES // len(matrix))
                for at in range(0, rows.num_rows, step):
                    part = rows.slice(at, step)
                    ids = part["segment_id"].to_numpy(zero_copy_only=False)
                    scores = matrix_of(part["embedding"], dim) @ matrix.T
                    for j, (new_ids, new_scores) in enumerate(best_of(ids, scores, k)):
                        old_ids, old_scores = kept.get((dim, j), (new_ids[:0], new_scores[:0]))
                        kept[dim, j] = _keep_best(
                            np.concatenate([old_ids, new_ids]), np.concatenate([old_scores, new_scores]), k
                        )
        for (dim, j), (ids, scores) in kept.items():
            asked_ids = sent.value[dim][0]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(asked_ids[j : j + 1], len(ids))),
                    pa.array(ids, type=schema.field("segment_id").type),
                    pa.array(scores),
                ],
                names=["query_id", "segment_id", "similarity"],
            )

    return held.mapInArrow(rank_batches, kinds), sent


def zero_shot_labels(
    vectors: DataFrame,
    label_vectors: DataFrame,
    threshold: float = LABEL_THRESHOLD,
    max_sent: int = MAX_SENT_VECTORS,
) -> DataFrame:
    """Labels whose share of a softmax over all label similarities reaches ``threshold``, in label order.

    Labels are handled in blocks of at most ``max_sent``. A block yields its part of the softmax sum and its
    largest ``1 / threshold`` entries; no more labels than that can pass, so the parts decide exactly. One row
    per row of ``vectors``; a vector of another width than the labels' has no labels.
    """
    labels = label_vectors.select("pos", "label", "embedding")
    per_block = int(1 / threshold) + 1
    parts_kind = (
        f"segment_id {vectors.schema['segment_id'].dataType.simpleString()}, _row bigint, total double, "
        "top array<struct<pos: bigint, label: string, weight: double>>"
    )
    entry = pa.struct([("pos", pa.int64()), ("label", pa.string()), ("weight", pa.float64())])

    def score_block(rows: pa.RecordBatch, block: tuple[pa.Array, pa.Array, np.ndarray]) -> pa.RecordBatch:
        """Softmax sums and top labels of a batch's rows; rows of another width have none."""
        positions, names, matrix = block
        widths = pc.list_value_length(rows["embedding"]).to_numpy(zero_copy_only=False)
        same = widths == matrix.shape[1]
        held = matrix_of(rows["embedding"].filter(pa.array(same)), matrix.shape[1])
        held = held / (np.linalg.norm(held, axis=1, keepdims=True) + NORM_FLOOR)
        weights = np.exp(held @ matrix.T)
        n_top = min(per_block, weights.shape[1])
        top = np.argpartition(-weights, n_top - 1, axis=1)[:, :n_top]
        at = pa.array(top.ravel())
        chosen = pa.array(np.take_along_axis(weights, top, 1).ravel())
        entries = pa.StructArray.from_arrays([positions.take(at), names.take(at), chosen], fields=list(entry))
        ends = np.concatenate(([0], np.cumsum(np.where(same, n_top, 0)))).astype(np.int32)
        totals = np.zeros(len(same))
        totals[same] = weights.sum(axis=1)
        return pa.RecordBatch.from_arrays(
            [rows["segment_id"], rows["_row"], pa.array(totals), pa.ListArray.from_arrays(pa.array(ends), entries)],
            names=["segment_id", "_row", "total", "top"],
        )

    def unpack(table: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray]:
        table = table.sort_by("pos").combine_chunks()
        dim = len(table["embedding"][0])
        position = pc.cast(table["pos"], pa.int64()).combine_chunks()
        return position, table["label"].combine_chunks(), matrix_of(table["embedding"], dim)

    def score(held: DataFrame, block: pa.Table) -> tuple[DataFrame, Broadcast]:
        sent = held.sparkSession.sparkContext.broadcast(unpack(block))

        def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield score_block(batch, sent.value)

        return held.mapInArrow(score_batches, parts_kind), sent

    # Ids may repeat: a row is known by its number.
    held = indexable_vectors(vectors).select("segment_id", "embedding", F.monotonically_increasing_id().alias("_row"))
    rows, labels = _first_rows(labels, max_sent)
    if rows is not None:
        parts = score(held, rows)[0]
    else:
        held, path = stored(held, "vectors"), scratch_path(held.sparkSession, "label-parts")
        for block in _blocks(labels, max_sent, "pos"):
            found, sent = score(held, block)
            found.write.mode("append").parquet(path)
            sent.destroy()
        parts = held.sparkSession.read.schema(parts_kind).parquet(path)
        parts = parts.groupBy("segment_id", "_row").agg(
            F.sum("total").alias("total"), F.flatten(F.collect_list("top")).alias("top")
        )
    passing = F.filter("top", lambda x: F.round(x["weight"] / F.col("total"), 12) >= threshold)
    return parts.select(
        "segment_id",
        F.transform(F.sort_array(passing), lambda x: x["label"]).alias("labels"),
    )
