"""Hard negatives by the threshold algorithm over per-dimension sorted lists.

Of every chunk of rows each dimension is sorted once. An anchor reads all lists in step, from the top where
its component is positive and from the bottom where it is negative, so each list offers the largest
products first. Every row met that way is scored in full, in whole numbers. The products at the current
depth add up to a threshold that no row still unmet can exceed; once it is strictly below the score that
the last place of every wanted list holds, the anchor is done with the chunk. Strictly, because a row of an
equal score and a smaller id would still come before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgrid.llm.common import stored
from reelgrid.llm.integers import integer_vectors, matrix
from reelgrid.spreading import spread

CHUNK = 8_192  # rows whose lists are sorted together
BLOCK = 16_384  # anchors sent at once
SCALE = 256
FIRST = 16  # depth of the first step; each next one is twice as deep


class Lists:
    """Sorted lists of one chunk: rows ordered by id, so a smaller place is a smaller id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, x = ids[order], labels[order], x[order]
        self.most = int(np.abs(x).max(initial=0))
        self.x = x
        self.floats = x.astype(np.float64)
        self.down = np.argsort(-x, axis=0, kind="stable")
        self.depths: list[int] = []
        at = FIRST
        while at < len(x):
            self.depths.append(at)
            at *= 2
        self.depths.append(len(x))
        highest = np.take_along_axis(x, self.down, 0)
        ends = np.array(self.depths) - 1
        self.top, self.bottom = highest[ends], highest[len(x) - 1 - ends]

    def thresholds(self, q: np.ndarray) -> np.ndarray:
        """By anchor and step: what no row unmet at that depth can exceed."""
        return np.maximum(q, 0) @ self.top.T + np.minimum(q, 0) @ self.bottom.T

    def scores(self, places: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.most * int(np.abs(q).max(initial=0)) * len(q) < 1 << 53:  # exact as floats, and faster
            return (self.floats[places] @ q.astype(np.float64)).astype(np.int64)
        return self.x[places] @ q

    def steps(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places met first in each step of the sorted access, and their scores."""
        up, down = np.flatnonzero(q < 0), np.flatnonzero(q > 0)
        met, before, many = np.zeros(len(self.x), bool), 0, len(self.x)
        for depth in self.depths:
            now = np.zeros(many, bool)
            now[self.down[before:depth, down]] = True
            now[self.down[many - depth : many - before, up]] = True
            if depth == many:
                now[:] = True  # an anchor of zeros has no lists
            now &= ~met
            met |= now
            places = np.flatnonzero(now)
            yield places, self.scores(places, q)
            before = depth


class Best:
    """The ``k`` best ``(score, id)`` within ``low <= score <= high``; ties to the smaller id."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None) -> None:
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.high is not None:
            fit = (scores <= self.high) & (scores >= self.low)
            scores, ids = scores[fit], ids[fit]
        if len(self.ids) == self.k:
            fit = scores >= self.scores[-1]
            scores, ids = scores[fit], ids[fit]
        if len(ids):
            scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[order], ids[order]

    def done(self, threshold: int) -> bool:
        """No unmet row can change the list."""
        if self.low is not None and (self.low > self.high or threshold < self.low):
            return True
        return len(self.ids) == self.k and threshold < self.scores[-1]


def scan(lists: Lists, q: np.ndarray, thresholds: np.ndarray, wanted: list[Best], fit: np.ndarray) -> int:
    """Fill the wanted lists of one anchor from one chunk; returns how many rows were met."""
    met = 0
    for (places, scores), threshold in zip(lists.steps(q), thresholds.tolist(), strict=True):
        met += len(places)
        ok = fit[places]
        for best in wanted:
            best.add(scores[ok], lists.ids[places[ok]])
        if all(best.done(threshold) for best in wanted):
            break
    return met


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, Lists]]:
    """Rows as they come, in chunks, by width of the vector."""
    for batch in batches:
        for i in range(0, batch.num_rows, CHUNK):
            part = batch.slice(i, CHUNK)
            vecs = part.column("vec")
            ids, labels = (part.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
            out = {}
            for size in pc.unique(pc.binary_length(vecs)).to_pylist():
                if size:
                    at, x = matrix(vecs, size // 4)
                    out[size // 4] = Lists(ids[at], labels[at], x)
            yield out


def _scanned(rows: DataFrame, anchors: list[Row], windows: list[list[tuple[int, int]]] | None, k: int) -> DataFrame:
    """``anchor, place, id, score``: per task the best ``k`` rows of each anchor, or of each of its windows.

    ``anchor`` is a position in ``anchors``. Without windows rows of the anchor's own label are meant, else
    rows of other labels.
    """
    sent = rows.sparkSession.sparkContext.broadcast(
        ([(r["vec_id"], r["label"], bytes(r["vec"])) for r in anchors], windows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, within = sent.value
        wanted = [[Best(k, *w) for w in within[i]] if within else [Best(k)] for i in range(len(told))]
        by_width: dict[int, list[int]] = {}
        for i, (_, _, vec) in enumerate(told):
            if wanted[i]:
                by_width.setdefault(len(vec) // 4, []).append(i)
        q = {w: np.frombuffer(b"".join(told[i][2] for i in own), "<i4").reshape(len(own), w).astype(np.int64) for w, own in by_width.items() if w}
        for chunk in _chunks(batches):
            for width, lists in chunk.items():
                own = by_width.get(width, [])
                if not own:
                    continue
                if within:  # rows of any label are met, those of the anchor's label are passed over
                    bars = lists.thresholds(q[width])
                    for n, i in enumerate(own):
                        scan(lists, q[width][n], bars[n], wanted[i], lists.labels != told[i][1])
                    continue
                labelled: dict[int, list[int]] = {}
                for n, i in enumerate(own):
                    labelled.setdefault(told[i][1], []).append(n)
                for label, places in labelled.items():  # lists of one label's rows only
                    at = np.flatnonzero(lists.labels == label)
                    if not len(at):
                        continue
                    alike = Lists(lists.ids[at], lists.labels[at], lists.x[at])
                    bars = alike.thresholds(q[width][places])
                    for n, bar in zip(places, bars, strict=True):
                        scan(alike, q[width][n], bar, wanted[own[n]], alike.ids != told[own[n]][0])
        held = [(i, p, best) for i, lots in enumerate(wanted) for p, best in enumerate(lots) if len(best.ids)]
        if held:
            sizes = [len(best.ids) for _, _, best in held]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([i for i, _, _ in held], sizes)),
                    pa.array(np.repeat([p for _, p, _ in held], sizes)),
                    pa.array(np.concatenate([best.ids for _, _, best in held])),
                    pa.array(np.concatenate([best.scores for _, _, best in held])),
                ],
                ["anchor", "place", "id", "score"],
            )

    each = rows.mapInArrow(run, "anchor bigint, place bigint, id bigint, score bigint")
    order = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), "id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _mined(spark: SparkSession, rows: DataFrame, anchors: list[Row], positives: int, negatives: int, share: tuple[int, int]) -> DataFrame:
    """The result for one block of anchors."""
    told = _scanned(rows, anchors, None, positives).select("anchor", "rank", "id", "score").collect()
    found: list[list[Row]] = [[] for _ in anchors]
    for r in sorted(told, key=lambda r: (r["anchor"], r["rank"])):
        found[r["anchor"]].append(r)
    low, high = share
    windows = [[(-(-low * r["score"] // 100), high * r["score"] // 100) for r in own] for own in found]
    hard = _scanned(rows, anchors, windows, negatives)
    pairs = [(i, p, anchors[i]["vec_id"], r["id"], r["score"]) for i, own in enumerate(found) for p, r in enumerate(own)]
    schema = "anchor bigint, place bigint, anchor_id bigint, positive_id bigint, positive_score bigint"
    named = hard.join(F.broadcast(spark.createDataFrame(pairs, schema)), ["anchor", "place"])
    return named.select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


def mine(
    rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95), block: int = BLOCK
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``vec_id, label, vec`` and is read twice per block of anchors, so it should be stored.
    Anchors are the rows whose id ``every`` divides, all of them against all rows: blocks of about ``block``
    distinct anchors are sent to the tasks one after the other, and each block's result is written before the
    next, so the driver holds one block at a time. Rows that share the anchor's id are no partners of it; a
    row that is repeated takes a place each time, an anchor that is repeated is answered once. Vectors meet
    vectors of their own width only; empty ones meet none. An anchor of zeros scores 0 everywhere.
    """
    spark = rows.sparkSession
    rows = spread(rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()), "vec_id")
    anchors = rows.where((F.col("vec_id") % every == 0) & (F.length("vec") > 0)).distinct()
    blocks = max(1, -(-anchors.count() // block))
    told = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "vec"), F.lit(blocks)))
    parts = []
    for b in range(blocks):
        own = told.where(F.col("block") == b).drop("block").collect()
        found = _mined(spark, rows, own, positives, negatives, share)
        parts.append(stored(found, "hard-negatives") if blocks > 1 else found)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hard_negatives(vectors: DataFrame, relabel_every: int = 7, labels: int = 10, scale: int = SCALE, **how) -> DataFrame:
    """Hard negatives of an embeddings table, see ``mine``.

    Rows with a null id, label or vector, or with null or non-finite components, take no part. Where
    ``relabel_every`` divides the id, the label becomes ``(label + 1) % labels`` first; 0 leaves labels alone.
    Components become ``floor(scale * x)``. An empty table, or one without anchors, gives no row; other
    columns are left out, whatever their names.
    """
    rows = integer_vectors(vectors, scale).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    if relabel_every:
        moved = F.col("vec_id") % relabel_every == 0
        rows = rows.withColumn("label", F.when(moved, (F.col("label") + 1) % labels).otherwise(F.col("label")))
    return mine(stored(rows, "labelled-vectors"), **how)
