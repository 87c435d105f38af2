"""Exact vector search that leaves out what cannot matter.

Vectors are stored by cell: the pivot they make the smallest angle with. A cell knows how far its members
turn away from the pivot at most and how long they are. The angle between a query and a member is at least
the query's angle to the pivot less that radius, so the inner product has an upper bound for the whole
cell. A query first visits the cells with the highest bounds that hold ``k`` members between them; the score
of its ``k``-th hit there is its bar, and only cells whose bound reaches the bar are visited after that. Visits
are a table of query and cell that is joined to the stored vectors, so all queries, however many, are
answered by the same few jobs, and a cell that no query visits is not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.functions.vector import unit_score
from reelgrid.operators.ranking import SCORE_DIGITS, rounded, top_k
from reelgrid.operators.vectors import best_of, indexable_vectors, matrix_of
from reelgrid.schemas import TOP_K_RETRIEVAL
from reelgrid.spreading import stored

MAX_CELLS = 1024  # pivots, over all widths
SAMPLE = 16_384  # vectors that pivots are chosen from, at most
MOVES = 6  # times that pivots move to the middle of their part of the sample
BLOCK = 8_192  # vectors of a cell, or queries, that meet in one group
SLACK = 1e-6  # added to angles and bounds against rounding


class VectorCells(NamedTuple):
    """``(segment_id, embedding, cell)`` and, per cell, ``(cell, dim, pivot, n, radius, shortest, longest)``."""

    entries: DataFrame
    cells: DataFrame


def _pivots(sample: np.ndarray, many: int) -> np.ndarray:
    """Unit vectors that the sample gathers around: seeds far apart, then moved to the middle of their own."""
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(many, len(sample)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    pivots = sample[chosen]
    for _ in range(MOVES):
        own = np.argmax(sample @ pivots.T, axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, own, sample)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(lengths > 0, sums / np.maximum(lengths, 1e-300), pivots)
    return pivots


def _choose(vectors: DataFrame, cells: int | None) -> dict[int, np.ndarray]:
    """Pivots by width, from a bounded sample in the order of a hash; any choice gives the same results."""
    n = vectors.count()
    wanted = min(MAX_CELLS, cells or max(1, round(n**0.5 / 2)))
    rows = vectors.orderBy(F.xxhash64("segment_id"), "segment_id").limit(min(SAMPLE, 64 * wanted)).toArrow()
    widths = pc.list_value_length(rows["embedding"]).to_numpy()
    out, left = {}, wanted
    for dim in np.unique(widths)[:MAX_CELLS]:
        held = matrix_of(rows["embedding"].filter(pa.array(widths == dim)), int(dim))
        lengths = np.linalg.norm(held, axis=1)
        held = held[np.isfinite(lengths) & (lengths > 0)]
        many = min(left, max(1, round(wanted * len(held) / max(1, len(widths)))))
        if len(held) and many:
            out[int(dim)] = _pivots(held / np.linalg.norm(held, axis=1, keepdims=True), many)
            left -= many
    return out


def _turn(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def build_cells(vectors: DataFrame, cells: int | None = None) -> VectorCells:
    """Cells of ``segment_id, embedding``; about half the square root of their number, 1,024 at most.

    Empty vectors and those with null or non-finite components are left out. Widths that no pivot has share a
    cell without one per width, whose bound is the length of its longest member. Zero vectors turn nowhere.
    """
    held = indexable_vectors(vectors).select("segment_id", "embedding")
    held = held.where(F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))))
    held = stored(held.where(~F.exists("embedding", F.isnan)), "vectors")
    pivots = _choose(held, cells)
    first = dict(zip(pivots, np.cumsum([0, *map(len, pivots.values())])[:-1].tolist(), strict=True))
    sent = held.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = pc.list_value_length(batch["embedding"]).to_numpy(zero_copy_only=False)
            cell, angle, length = -widths.astype(np.int64), np.zeros(len(widths)), np.zeros(len(widths))
            for dim in np.unique(widths).tolist():
                at = np.flatnonzero(widths == dim)
                x = matrix_of(batch["embedding"].take(pa.array(at)), dim)
                length[at] = np.linalg.norm(x, axis=1)
                if dim in sent.value:
                    cosines = x @ sent.value[dim].T / np.maximum(length[at], 1e-300)[:, None]
                    own = np.argmax(cosines, axis=1)
                    cell[at] = first[dim] + own
                    angle[at] = np.where(length[at] > 0, _turn(cosines[np.arange(len(at)), own]), 0)
            yield pa.RecordBatch.from_arrays(
                [batch["segment_id"], batch["embedding"], pa.array(cell), pa.array(widths.astype(np.int64)), pa.array(angle), pa.array(length)],
                names=["segment_id", "embedding", "cell", "dim", "angle", "length"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in held.schema}
    placed = stored(
        held.mapInArrow(
            place, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", cell bigint, dim bigint, angle double, length double"
        ),
        "placed",
    )
    sums = placed.groupBy("cell", "dim").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("angle").alias("radius"),
        F.min("length").alias("shortest"),
        F.max("length").alias("longest"),
    )
    told = [(first[d] + i, p.tolist()) for d, own in pivots.items() for i, p in enumerate(own)]
    named = held.sparkSession.createDataFrame(told, "cell bigint, pivot array<double>")
    cells_ = sums.join(F.broadcast(named), "cell", "left")
    return VectorCells(
        placed.select("segment_id", "embedding", "cell"),
        stored(cells_.select("cell", "dim", "pivot", "n", "radius", "shortest", "longest"), "cells"),
    )


class _Bounds:
    """Upper bounds of the inner products of queries with the members of each cell of one width."""

    def __init__(self, rows: list[dict]) -> None:
        self.cell, self.n = (np.array([r[c] for r in rows], np.int64) for c in ("cell", "n"))
        self.radius, self.shortest, self.longest = (np.array([r[c] for r in rows]) for c in ("radius", "shortest", "longest"))
        dim = rows[0]["dim"]
        self.known = np.array([r["pivot"] is not None for r in rows])
        self.pivots = np.array([r["pivot"] or [0.0] * dim for r in rows])

    def of(self, q: np.ndarray) -> np.ndarray:
        lengths = np.linalg.norm(q, axis=1, keepdims=True)
        turns = _turn(q @ self.pivots.T / np.maximum(lengths, 1e-300))
        least = np.where(self.known, np.maximum(turns - self.radius - SLACK, 0), 0)
        cosine = np.cos(least)
        most = np.where(cosine >= 0, cosine * self.longest, cosine * self.shortest) * lengths
        return most + SLACK * lengths * self.longest + 10.0**-SCORE_DIGITS


def _bounds(cells: DataFrame) -> dict[int, _Bounds]:
    by_width: dict[int, list[dict]] = {}
    for r in cells.toArrow().to_pylist():  # one row per pivot and width
        by_width.setdefault(r["dim"], []).append(r)
    return {dim: _Bounds(rows) for dim, rows in by_width.items()}


def _visits(asked: DataFrame, bounds: dict[int, _Bounds], k: int) -> DataFrame:
    """``asked`` once per cell to visit, with ``cell``.

    Without a column ``bar`` these are the cells with the highest bounds that hold ``k`` members together;
    with it, all others whose bound reaches the bar, or all others where it is null.
    """
    sent = asked.sparkSession.sparkContext.broadcast(bounds)
    second = "bar" in asked.columns

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = pc.list_value_length(batch["embedding"]).to_numpy(zero_copy_only=False)
            for dim in np.unique(widths).tolist():
                if dim not in sent.value:
                    continue
                own, at = sent.value[dim], np.flatnonzero(widths == dim)
                for start in range(0, len(at), 1024):
                    here = at[start : start + 1024]
                    most = own.of(matrix_of(batch["embedding"].take(pa.array(here)), dim))
                    order = np.argsort(-most, axis=1, kind="stable")
                    before = np.cumsum(own.n[order], axis=1) - own.n[order]
                    fit = np.zeros(most.shape, bool)
                    np.put_along_axis(fit, order, before < k, axis=1)
                    if second:
                        bar = batch["bar"].take(pa.array(here)).to_numpy(zero_copy_only=False).astype(float)
                        fit = ~fit & ~(most < bar[:, None])  # a null bar is no number, and below nothing
                    i, j = np.nonzero(fit)
                    rows = batch.take(pa.array(here[i]))
                    yield pa.RecordBatch.from_arrays(
                        [rows["row"], rows["query_id"], rows["embedding"], pa.array(own.cell[j])],
                        names=["row", "query_id", "embedding", "cell"],
                    )

    kinds = {f.name: f.dataType.simpleString() for f in asked.schema}
    return asked.mapInArrow(
        choose, f"row bigint, query_id {kinds['query_id']}, embedding {kinds['embedding']}, cell bigint"
    )


def _scored(visits: DataFrame, index: VectorCells, k: int, block: int) -> DataFrame:
    """``row, query_id, segment_id, similarity``: the best ``k`` of each visit's blocks.

    Cells are cut into blocks of vectors and the visits of a cell into parts of queries; each pair of them is
    one group. Folders of cells that nobody visits are not read.
    """
    visits = stored(visits, "visits")
    sizes = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("asked")).join(index.cells.select("cell", "n"), "cell")
    sizes = sizes.select(
        "cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.ceil(F.col("asked") / block).cast("int").alias("parts")
    )
    known = sizes.collect()  # one row per cell at most
    sizes = F.broadcast(visits.sparkSession.createDataFrame(known, "cell bigint, blocks int, parts int"))
    members = index.entries.where(F.col("cell").isin([r["cell"] for r in known])).join(sizes, "cell")
    share = lambda by, of: F.pmod(F.xxhash64(by), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = visits.join(sizes, "cell").withColumn("part", share("row", "parts")).withColumn("block", each("blocks"))
    right = members.withColumn("block", share("segment_id", "blocks")).withColumn("part", each("parts"))
    left = left.select("row", "query_id", "embedding", "cell", "block", "part")
    right = right.select("segment_id", "embedding", "cell", "block", "part")
    kinds = {f.name: f.dataType.simpleString() for d in (left, right) for f in d.schema}
    id_type = right.limit(0).toArrow().schema.field("segment_id").type
    query_type = left.limit(0).toArrow().schema.field("query_id").type

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if asked.num_rows and held.num_rows:
            dim = len(held["embedding"][0])
            ids, x = held["segment_id"].to_numpy(), matrix_of(held["embedding"], dim)
            q = matrix_of(asked["embedding"], dim)
            step = max(1, 4_000_000 // len(x))
            for at in range(0, len(q), step):
                found += best_of(ids, x @ q[at : at + step].T, k)
        rows = np.repeat(np.arange(len(found)), [len(i) for i, _ in found])
        taken = asked.select(["row", "query_id"]).take(pa.array(rows, pa.int64()))
        return pa.table(
            {
                "row": taken["row"],
                "query_id": taken["query_id"].cast(query_type),
                "segment_id": pa.array(np.concatenate([i for i, _ in found]) if found else [], id_type),
                "similarity": pa.array(np.concatenate([s for _, s in found]) if found else [], pa.float64()),
            }
        )

    groups = ["cell", "block", "part"]
    met = left.groupBy(*groups).cogroup(right.groupBy(*groups))
    return met.applyInArrow(
        meet, f"row bigint, query_id {kinds['query_id']}, segment_id {kinds['segment_id']}, similarity double"
    )


def _asked(query_vectors: DataFrame) -> DataFrame:
    rows = indexable_vectors(query_vectors).select("query_id", "embedding")
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "asked")


def _bars(asked: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """``asked`` with the similarity of each one's ``k``-th hit, null where it has fewer."""
    order = [rounded("similarity").desc(), F.col("segment_id")]
    kth = top_k(hits.withColumnRenamed("query_id", "asked_id").withColumnRenamed("row", "query_id"), k, order)
    kth = kth.where(F.col("rank") == k).select(F.col("query_id").alias("row"), F.col("similarity").alias("bar"))
    return asked.join(kth, "row", "left")


def visits_of(query_vectors: DataFrame, index: VectorCells, k: int = TOP_K_RETRIEVAL, block: int = BLOCK) -> DataFrame:
    """``query_id, cell, first``: the cells that an exact search visits, before and after the bar is known."""
    asked, bounds = _asked(query_vectors), _bounds(index.cells)
    first = _visits(asked, bounds, k)
    bars = _bars(asked, _scored(first, index, k, block), k)
    kept = lambda df, flag: df.select("query_id", "cell", F.lit(flag).alias("first"))
    return kept(first, True).unionByName(kept(_visits(bars, bounds, k), False))


def search_cells(
    query_vectors: DataFrame, index: VectorCells, source: str, k: int = TOP_K_RETRIEVAL, clamp: bool = True, block: int = BLOCK
) -> DataFrame:
    """What ``vector_search`` finds, from stored cells: the best ``k`` per query, ties by id, widths apart.

    The number of jobs does not depend on the number of queries. Only the cells' figures, at most one row per
    pivot and width, pass through the driver.
    """
    asked, bounds = _asked(query_vectors), _bounds(index.cells)
    first = stored(_scored(_visits(asked, bounds, k), index, k, block), "first-hits")
    rest = _scored(_visits(_bars(asked, first, k), bounds, k), index, k, block)
    hits = first.unionByName(rest).select("query_id", "segment_id", "similarity")
    best = top_k(hits, k, [rounded("similarity").desc(), F.col("segment_id")])
    scored = best.withColumn("score", unit_score(F.col("similarity"), clamp))
    return scored.select("query_id", F.lit(source).alias("source"), "segment_id", "rank", "similarity", "score")


def write_cells(index: VectorCells, path: str) -> None:
    """Vectors in a folder per cell, cut into files of about ``BLOCK`` rows, and the cells' figures."""
    sizes = F.broadcast(index.cells.select("cell", F.ceil(F.col("n") / BLOCK).alias("blocks")))
    dealt = index.entries.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("segment_id"), F.col("blocks")))
    dealt.repartition("cell", "block").drop("block", "blocks").write.partitionBy("cell").parquet(f"{path}/entries")
    index.cells.write.parquet(f"{path}/cells")


def read_cells(spark: SparkSession, path: str) -> VectorCells:
    entries = spark.read.parquet(f"{path}/entries")
    return VectorCells(entries.withColumn("cell", F.col("cell").cast("bigint")), spark.read.parquet(f"{path}/cells"))
