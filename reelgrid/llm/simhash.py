"""SimHash near-duplicates with vantage-point trees: exact pairs within a Hamming radius, and groups.

Equal fingerprints are one point. A tree of vantage points, built from a bounded sample, deals the
points into shards: a point's home is inside a vantage point's radius or outside. Points near enough
to a boundary from inside also go to the other side as guests, and guests go wherever the triangle
bounds leave room for a resident within the radius; so every pair meets in exactly one shard, whatever
the sample was. In a shard the same rule is applied on and on down to small blocks, which are compared
directly. A shard tells of each point only which group it is in, never all pairs of a group, and groups
of different shards are joined by alternating star contraction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import arrow_map, boxed, stored, texts

SHARD = 4_000  # points that a shard should have
SAMPLE = 16_384  # points that the dealing tree is built from, at most
LEAF = 192


# --- fingerprints -----------------------------------------------------------------------------------


def fingerprint(text: str, size: int = 3) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; 0 without words."""
    import xxhash

    found = text.encode().lower().split()  # A-Z and the six ASCII white-space characters only
    if not found:
        return 0
    laid = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    many = max(1, len(found) - size + 1)
    spans = zip(starts[:many].tolist(), ends[min(size, len(found)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(laid[a:b], 42) for a, b in spans), np.uint64, many)
    ones = np.zeros(64, np.int64)
    for at in range(0, many, 65_536):
        part = hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > many).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id, fp`` per row; the 64 bits as a signed integer. A null text is empty: 0."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, size) for t in batch.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return arrow_map(texts(docs), work, "doc_id bigint, fp bigint", by="text")


# --- vantage-point trees ----------------------------------------------------------------------------


def _split(points: np.ndarray, tries: int = 8) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that halve the points best; None when no point tells them apart."""
    best = None
    for i in np.linspace(0, len(points) - 1, min(tries, len(points))).astype(int):
        away = np.bitwise_count(points ^ points[i])
        for m in {int(np.median(away)), int(np.median(away)) - 1}:
            inside = int((away <= m).sum())
            if 0 < inside < len(points):
                lost = abs(2 * inside - len(points)) + int(((away >= m - 1) & (away <= m + 2)).sum())
                if best is None or lost < best[0]:
                    best = (lost, points[i], m)
    return best and (best[1], best[2])


def build_tree(sample: np.ndarray, leaves: int) -> list[tuple[int, int, int, int]]:
    """Nodes ``(vantage, radius, inside, outside)``; a child below zero is the leaf ``-1 - child``."""
    nodes: list[tuple[int, int, int, int]] = []
    count = 0

    def grow(points: np.ndarray, wanted: int) -> int:
        nonlocal count
        split = _split(points) if wanted > 1 and len(points) > 1 else None
        if split is None:
            count += 1
            return -count
        vantage, m = split
        inside = np.bitwise_count(points ^ vantage) <= m
        me = len(nodes)
        nodes.append((0, 0, 0, 0))
        children = grow(points[inside], (wanted + 1) // 2), grow(points[~inside], wanted // 2)
        nodes[me] = (int(vantage), m, *children)
        return me

    grow(np.unique(sample), leaves)
    return nodes


def route(points: np.ndarray, nodes: list, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(leaf, index of point, guest)`` of every visit."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    stack = [(0 if nodes else -1, np.arange(len(points)), np.zeros(len(points), bool))]
    while stack:
        at, who, guest = stack.pop()
        if at < 0:
            out.append((np.full(len(who), -1 - at, np.int32), who, guest))
            continue
        vantage, m, inside, outside = nodes[at]
        away = np.bitwise_count(points[who] ^ np.uint64(vantage)).astype(np.int64)
        into = np.where(guest, away <= m + radius, away <= m)
        beyond = away >= m + 1 - radius
        stack.append((inside, who[into], guest[into]))
        stack.append((outside, who[beyond], (guest | (away <= m))[beyond]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class _Groups:
    """Union-find over positions, with many links at a time."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        found = self.parent[x]
        while True:
            up = self.parent[found]
            if (up == found).all():
                self.parent[x] = found
                return found
            found = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.roots(a), self.roots(b)
        apart = a != b
        for x, y in np.unique(np.stack((a[apart], b[apart]), 1), axis=0).tolist():
            x, y = int(self.roots(np.array([x]))[0]), int(self.roots(np.array([y]))[0])
            if x != y:
                self.parent[max(x, y)] = min(x, y)


def group_shard(points: np.ndarray, guest: np.ndarray, radius: int) -> np.ndarray:
    """Of each point the position of its group's first; residents meet residents and guests."""
    groups = _Groups(len(points))

    def compare(own: np.ndarray, other: np.ndarray) -> None:
        for i in range(0, len(own), 512):
            mine = own[i : i + 512]
            for j in range(0, len(other), 2048):
                there = other[j : j + 2048]
                a, b = np.nonzero(np.bitwise_count(points[mine][:, None] ^ points[there][None, :]) <= radius)
                if len(a):
                    groups.link(mine[a], there[b])

    stack = [(np.flatnonzero(~guest), np.flatnonzero(guest))]
    while stack:
        own, guests = stack.pop()
        split = _split(points[own], 2) if len(own) > LEAF else None
        if split is None:
            compare(own, own)
            compare(own, guests)
            continue
        vantage, m = split
        away, far = (np.bitwise_count(points[x] ^ vantage).astype(np.int64) for x in (own, guests))
        stack.append((own[away <= m], guests[far <= m + radius]))
        near = own[(away <= m) & (away >= m + 1 - radius)]
        stack.append((own[away > m], np.concatenate((guests[far >= m + 1 - radius], near))))
    return groups.roots(np.arange(len(points)))


def close_groups(points: DataFrame, radius: int, shard: int = SHARD) -> DataFrame:
    """``fp, rep``: links that connect exactly the points within ``radius`` of each other, over chains.

    ``points`` has distinct ``fp``. A shard gives each point one link at most.
    """
    spark = points.sparkSession
    n = points.count()
    leaves = max(1, -(-n // shard))
    picked = points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(min(SAMPLE, 64 * leaves)).collect() if leaves > 1 else []
    nodes = build_tree(np.array([r[0] for r in picked], np.int64).view(np.uint64), leaves)
    sent = spark.sparkContext.broadcast(nodes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fp").to_numpy()
            leaf, who, guest = route(own.view(np.uint64), sent.value, radius)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(own[who]), pa.array(guest)], ["leaf", "fp", "guest"])

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["fp"].to_numpy()
        first = group_shard(own.view(np.uint64), pdf["guest"].to_numpy(), radius)
        linked = first != np.arange(len(own))
        return pd.DataFrame({"fp": own[linked], "rep": own[first[linked]]})

    dealt = points.select("fp").mapInArrow(deal, "leaf int, fp bigint, guest boolean")
    return dealt.groupBy("leaf").applyInPandas(settle, "fp bigint, rep bigint")


# --- groups over shards -----------------------------------------------------------------------------


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, rep`` for all nodes of undirected links: ``rep`` is the smallest node reachable.

    Alternating large-star and small-star rounds; a node's neighbours are reduced to their minimum, never
    gathered. Each round is written to the shared folder. Nodes must not be null.
    """
    edges = stored(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "links"
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            joined.select("u", F.col("m").alias("v"))
        )
        edges = stored(small.where("u != v").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("rep"))
    return ends.unionByName(ends.select(F.col("rep").alias("node"), "rep").distinct())


def near_duplicates(docs: DataFrame, radius: int = 2, size: int = 3, shard: int = SHARD) -> DataFrame:
    """``doc_id, fp, component_id`` per row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links between fingerprints at most
    ``radius`` bits apart; texts without words share fingerprint 0. Null ids are passed over by the
    minimum, and a group of null ids alone has a null component. Repeated rows are answered alike.
    """
    prints = stored(fingerprints(docs, size), "fingerprints")
    points = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
    groups = components(close_groups(points, radius, shard), "fp", "rep")
    found = points.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("rep", "fp").alias("rep")
    )
    lowest = found.groupBy("rep").agg(F.min("first").alias("component_id"))
    named = found.join(lowest, "rep").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(
    docs: DataFrame, radius: int = 2, size: int = 3, further: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """``docs`` with one row of each group: of those with the smallest ``doc_id``, one with the least text hash.

    A row is known by its id and a hash of its text, so rows that share an id are judged apart: a text that
    is no near-duplicate of another stays, whatever its id. Rows alike in id and text are copies of each
    other. Rows without an id take no part and stay. Other columns stay, whatever their names.

    ``further`` names a second rule: it is given ``doc_id, text`` with a number of its own for each id and
    text, and returns at least ``doc_id, component_id``, the smallest number of its group. Groups of either
    rule that share a row are one group.
    """
    rows = boxed(docs.where(F.col("doc_id").isNotNull()))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, size) for t in batch.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("mark"), pa.array(found.view(np.int64))], ["id", "mark", "fp"]
        )

    text = F.coalesce(F.col("row").getField("text"), F.lit("")).alias("text")
    plain = rows.select("id", "mark", text)
    prints = stored(arrow_map(plain, work, "id bigint, mark bigint, fp bigint", by="text"), "marked-fingerprints")
    points = stored(prints.groupBy("fp").agg(F.min(F.struct("id", "mark")).alias("first")), "points")
    groups = components(close_groups(points, radius), "fp", "rep").withColumnRenamed("node", "fp")
    found = points.join(groups, "fp", "left").select("fp", F.coalesce("rep", "fp").alias("rep"), "first")
    if further is None:
        kept = found.groupBy("rep").agg(F.min("first").alias("first")).select("first.*")
    else:
        kept = _one_of_joined(rows.select("id", "mark", text), prints, found.select("fp", "rep"), further)
    one = rows.join(kept, ["id", "mark"]).dropDuplicates(["id", "mark"]).select("row.*")
    return one.unionByName(docs.where(F.col("doc_id").isNull()))


def _one_of_joined(
    plain: DataFrame, prints: DataFrame, found: DataFrame, further: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``id, mark`` of the first row of each group of fingerprints, joined by what ``further`` groups."""
    marks = prints.groupBy("id", "mark").agg(F.min("fp").alias("fp"))
    marks = stored(marks.withColumn("number", F.monotonically_increasing_id()), "numbered-rows")
    asked = plain.join(marks.select("id", "mark", "number"), ["id", "mark"]).select(F.col("number").alias("doc_id"), "text")
    told = further(asked).select(F.col("doc_id").alias("number"), F.col("component_id").alias("other")).distinct()
    both = stored(marks.join(found, "fp").join(told, "number").select("id", "mark", "number", "rep", "other"), "both-rules")
    own = both.groupBy("rep").agg(F.min("number").alias("own"))
    both = both.join(own, "rep").select("id", "mark", "own", "other")
    joined = components(both.select("own", "other"), "own", "other")
    named = both.join(joined.select(F.col("node").alias("own"), F.col("rep").alias("whole")), "own", "left")
    first = named.groupBy(F.coalesce("whole", "own").alias("whole")).agg(F.min(F.struct("id", "mark")).alias("first"))
    return first.select("first.*")
